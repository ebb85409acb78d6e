"""Registered transaction-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefield.operators import graph as gr
from tracefield.operators import txgraph as tg
from tracefield.sources import tables as tb

QUERIES, ORACLE = {}, {}
TX, GRAPH = tb.TX, tb.GRAPH


def money(df, *cols):
    return df.select(*[F.round(c, 2).alias(c) if c in cols else c for c in df.columns])


def watch_lists(spark, d):
    s = tb.load(spark, d, "supplier")
    a = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("addr")
    return (
        s.filter("s_acctbal < 0").select(a, F.lit("blacklisted").alias("list_name"))
        .unionByName(s.filter("s_nationkey < 5").select(a, F.lit("exchange").alias("list_name")))
        .unionByName(s.filter("s_acctbal > 9000").select(a, F.lit("sanctioned").alias("list_name")))
    )


def all_addrs(spark, d):
    c = tb.load(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("addr"))
    s = tb.load(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("addr"))
    return c.unionByName(s)


ADDRS = """(select 'C' || c_custkey as addr, false as blacklisted, false as exchange, false as sanctioned from customer
 union all select 'S' || s_suppkey, s_acctbal < 0, s_nationkey < 5, s_acctbal > 9000 from supplier)"""

QUERIES["j11_watchlist_flag"] = lambda spark, d: tg.watchlist_flag(all_addrs(spark, d), watch_lists(spark, d), ["blacklisted", "exchange", "sanctioned"])
ORACLE["j11_watchlist_flag"] = f"select * from {ADDRS}"


def j14(spark, d):
    s = tb.load(spark, d, "supplier").join(tb.load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ent = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("addr"), F.col("s_name").alias("entity"),
        F.when(F.col("s_acctbal") > 5000, "exchange").otherwise("organization").alias("entity_type"),
        F.col("n_name").alias("country"), F.lit(0.9).alias("confidence"),
    )
    return tg.attribute_entities(all_addrs(spark, d), ent)


QUERIES["j14_attribute_entities"] = j14
ORACLE["j14_attribute_entities"] = f"""select addr, s_name as entity, case when s_acctbal > 5000 then 'exchange' when s_acctbal is not null then 'organization' end as entity_type,
 n_name as country, case when s_name is not null then 0.9 end::double as confidence
 from {ADDRS} left join (supplier join nation on s_nationkey = n_nationkey) on addr = 'S' || s_suppkey"""


def exchanges(spark, d):
    return watch_lists(spark, d).filter("list_name = 'exchange'").select("addr")


EXCH = "(select 'S' || s_suppkey from supplier where s_nationkey < 5)"
QUERIES["j15_exchange_flows"] = lambda spark, d: money(tg.exchange_flows(tb.tx_graph(spark, d), exchanges(spark, d)), "value")
ORACLE["j15_exchange_flows"] = f"""select 'deposit' as kind, from_addr as user, to_addr as exchange, round(sum(value), 2) as value, count(*) as n from {GRAPH} where to_addr in {EXCH} group by all
 union all select 'withdrawal', to_addr, from_addr, round(sum(value), 2), count(*) from {GRAPH} where from_addr in {EXCH} group by all""".replace("as user", 'as "user"')

QUERIES["j16_flows_between"] = lambda spark, d: money(tg.flows_between(tb.tx_graph(spark, d), "C7", "C11"), "v1", "v2").unionByName(
    money(tg.flows_between(tb.tx_graph(spark, d), "C7", "S3"), "v1", "v2"))
_between = f"""select 1 as hops, null as via, round(sum(value), 2) as v1, null::double as v2 from {GRAPH} where from_addr = '@a' and to_addr = '@b' having count(*) > 0
 union all select 2, x.to_addr, round(v1, 2), round(v2, 2) from (select to_addr, sum(value) as v1 from {GRAPH} where from_addr = '@a' and to_addr <> '@b' group by 1) x
 join (select from_addr, sum(value) as v2 from {GRAPH} where to_addr = '@b' and from_addr <> '@a' group by 1) y on x.to_addr = y.from_addr"""
ORACLE["j16_flows_between"] = _between.replace("@a", "C7").replace("@b", "C11") + " union all " + _between.replace("@a", "C7").replace("@b", "S3")

LEGS = f"(select tx_id, value, ts, to_addr as addr, 1 as sign, from_addr as other from {GRAPH} union all select tx_id, value, ts, from_addr, -1, to_addr from {GRAPH})"
QUERIES["a22_address_info"] = lambda spark, d: money(tg.address_info(tb.tx_graph(spark, d)), "balance")
ORACLE["a22_address_info"] = f"""select addr, round(sum(value*sign), 2) as balance, min(ts) as first_seen, max(ts) as last_seen, count(distinct tx_id) as tx_count from {LEGS} group by 1"""

PATTERNS = [("tumbler", 400, 1e6, 0.9), ("peel_chain", 100, 5e5, 0.7), ("layering", 20, 1e5, 0.5)]
QUERIES["a23_mixer_features"] = lambda spark, d: money(tg.mixer_features(tb.tx_graph(spark, d), PATTERNS), "volume")
ORACLE["a23_mixer_features"] = f"""select *, case pattern when 'tumbler' then 0.9 when 'peel_chain' then 0.7 when 'layering' then 0.5 end::double as confidence from
 (select addr, round(v, 2) as volume, counterparties, legs, case when counterparties >= 400 and v >= 1e6 then 'tumbler' when counterparties >= 100 and v >= 5e5 then 'peel_chain'
  when counterparties >= 20 and v >= 1e5 then 'layering' end as pattern from (select addr, sum(value) as v, count(distinct other) as counterparties, count(*) as legs from {LEGS} group by 1))"""


def g1(spark, d):
    return gr.connected_components(gr.star_edges(tb.tx_inputs(spark, d), "tx_id", "addr"))


CC = f"""star as (select distinct u, v from (select t.addr as u, m.v from {tb.TX_INPUTS} t join (select tx_id, min(addr) as v from {tb.TX_INPUTS} group by 1) m on m.tx_id = t.tx_id) where u <> v),
 e as (select u as a, v as b from star union all select v, u from star),
 cc(node, component) using key (node) as (select distinct a, a from e union
  (select e.b as node, min(c.component) as component from cc c join e on e.a = c.node join recurring.cc r on r.node = e.b where c.component < r.component group by e.b))"""
QUERIES["g1_address_clusters"] = g1
ORACLE["g1_address_clusters"] = f"with recursive {CC} select node, component from cc"

QUERIES["a24_cluster_summary"] = lambda spark, d: (lambda x: x.select("component", "members", F.round("balance", 2).alias("balance"), "first_seen", "last_seen", F.round("confidence", 6).alias("confidence")))(
    tg.cluster_summary(g1(spark, d), tb.tx_inputs(spark, d)))
ORACLE["a24_cluster_summary"] = f"""with recursive {CC} select component, count(distinct node) as members, round(sum(value), 2) as balance, min(ts) as first_seen, max(ts) as last_seen,
 round(1 - 1/count(distinct node), 6) as confidence from cc join {tb.TX_INPUTS} t on t.addr = node group by 1"""

QUERIES["a25_campaign_summary"] = lambda spark, d: money(tg.campaign_summary(tb.tx_edges(spark, d), tb.intel(spark, d)), "total_paid")
ORACLE["a25_campaign_summary"] = f"""select to_addr as campaign, round(sum(value), 2) as total_paid, count(distinct from_addr) as victims, min(ts) as first_payment, max(ts) as last_payment
 from {TX} where to_addr in {tb.INTEL} group by 1"""

QUERIES["a26_value_distribution"] = lambda spark, d: money(tg.value_distribution(tb.tx_edges(spark, d), 0.0, 100000.0, 20, 50000.0, 2000.0), "volume")
ORACLE["a26_value_distribution"] = f"""select (case when value < 0 then 0 when value >= 100000 then 21 else floor(value / 5000) + 1 end)::bigint as bucket, count(*) as n, round(sum(value), 2) as volume,
 count(*) filter (value >= 50000) as large, count(*) filter (value <= 2000) as micro from {TX} group by 1"""

QUERIES["k4_history"] = lambda spark, d: tg.history(tb.tx_edges(spark, d), "S7", 25).select("tx_id", "leg", "from_addr", "to_addr", "value", "ts", "direction")
ORACLE["k4_history"] = f"""select tx_id, leg, from_addr, to_addr, value, ts, 'Incoming' as direction from {TX} where to_addr = 'S7' order by ts desc, tx_id, leg, to_addr, value limit 25"""

QUERIES["k8_central_addresses"] = lambda spark, d: tg.central_addresses(tb.tx_edges(spark, d), 15)
ORACLE["k8_central_addresses"] = f"""select addr, count(distinct other) as degree from (select from_addr as addr, to_addr as other from {TX} union all select to_addr, from_addr from {TX})
 group by 1 order by degree desc, addr limit 15"""


def ledger(spark, d):
    """Transactions with input and output arrays, one per order line."""
    e = tb.tx_edges(spark, d)
    n = F.col("leg")
    return e.select(
        "tx_id", "leg", "from_addr", "to_addr", "value",
        F.when(n == 7, F.expr("cast(array() as array<string>)")).otherwise(F.array("from_addr", F.concat(F.lit("C"), n.cast("string")))).alias("inputs"),
        F.array(F.col("to_addr"), F.col("from_addr"), F.concat(F.lit("C"), (n * 3).cast("string"))).alias("outputs"),
    ).withColumn("addr", F.when(n % 2 == 0, F.col("to_addr")).otherwise(F.lit("C2")))


LEDGER = f"""(select tx_id, leg, from_addr, to_addr, value, case when leg = 7 then [] else [from_addr, 'C' || leg] end as inputs, [to_addr, from_addr, 'C' || leg*3] as outputs,
 case when leg % 2 = 0 then to_addr else 'C2' end as addr from {TX})"""
QUERIES["c8_direction"] = lambda spark, d: ledger(spark, d).select("tx_id", "leg", "to_addr", "value", tg.direction(F.col("inputs"), F.col("outputs"), F.col("addr")).alias("direction"))
ORACLE["c8_direction"] = f"select tx_id, leg, to_addr, value, case when len(inputs) > 0 then case when list_contains(outputs, addr) then 'Incoming' else 'Outgoing' end end as direction from {LEDGER}"
QUERIES["c9_counterparties"] = lambda spark, d: ledger(spark, d).select("tx_id", "leg", "to_addr", "value", F.array_join(tg.counterparties(F.col("inputs"), F.col("outputs"), F.col("addr")), ",").alias("others"))
ORACLE["c9_counterparties"] = f"select tx_id, leg, to_addr, value, array_to_string(list_filter(list_concat(inputs, outputs), lambda x: x <> addr), ',') as others from {LEDGER}"


def risk_flags(spark, d):
    flags = tg.watchlist_flag(all_addrs(spark, d), watch_lists(spark, d), ["blacklisted", "exchange", "sanctioned"])
    graph = tb.checkpoint(tb.tx_graph(spark, d))
    mix = tg.mixer_features(graph, PATTERNS)
    spikes = tg.activity_spikes(graph, 3.0).select("addr").distinct().withColumn("suspicious_timing", F.lit(True))
    out = flags.join(mix, "addr", "left").join(spikes, "addr", "left")
    no = F.lit(False)
    return tg.address_risk(out.select(
        "addr", "blacklisted", F.coalesce(F.col("pattern") == "tumbler", no).alias("mixer"), F.col("sanctioned").alias("darknet"),
        F.coalesce(F.col("pattern").isNotNull(), no).alias("suspicious_pattern"), F.coalesce("suspicious_timing", no).alias("suspicious_timing"),
    ))


DAILY = f"(select addr, ts::date as day, count(*) as n from {LEGS} group by 1, 2)"
SPIKES = f"(select d.addr, d.day, d.n from {DAILY} d join (select addr, avg(n) + @k * stddev_pop(n) as lim from {DAILY} group by 1) s on s.addr = d.addr where n > lim)"
RISK = f"""(select *, case when risk_score >= 7 then 'CRITICAL' when risk_score >= 4 then 'HIGH' when risk_score >= 2 then 'MEDIUM' else 'LOW' end as risk_category from
 (select *, (case when blacklisted then 4 else 0 end + case when mixer then 2 else 0 end + case when darknet then 2 else 0 end + suspicious_pattern::int + suspicious_timing::int)::double as risk_score from
 (select a.addr, blacklisted, coalesce(pattern = 'tumbler', false) as mixer, sanctioned as darknet, pattern is not null as suspicious_pattern, s.addr is not null as suspicious_timing
 from {ADDRS} a left join ({ORACLE['a23_mixer_features']}) m on m.addr = a.addr left join (select distinct addr from {SPIKES.replace('@k', '3.0')}) s on s.addr = a.addr)))"""
QUERIES["m4_address_risk"] = risk_flags
ORACLE["m4_address_risk"] = f"select * from {RISK}"
QUERIES["m5_compliance_report"] = lambda spark, d: tg.compliance_report(risk_flags(spark, d))
ORACLE["m5_compliance_report"] = f"""select *, case when violations > 0 then 'NON_COMPLIANT' when warnings > 0 then 'REVIEW' else 'COMPLIANT' end as status, violations > 0 as needs_reporting
 from (select count(*) as addresses, count(*) filter (blacklisted) as violations, count(*) filter (not blacklisted and risk_score >= 2) as warnings from {RISK})"""

QUERIES["w8_dormant_periods"] = lambda spark, d: tg.dormant_periods(tb.tx_graph(spark, d), 60)
ORACLE["w8_dormant_periods"] = f"""select * from (select addr, lag(day) over (partition by addr order by day) as previous_day, day, day - lag(day) over (partition by addr order by day) as gap_days from {DAILY}) where gap_days >= 60"""
QUERIES["w8_activity_spikes"] = lambda spark, d: tg.activity_spikes(tb.tx_graph(spark, d), 2.5)
ORACLE["w8_activity_spikes"] = f"select * from {SPIKES.replace('@k', '2.5')}"


def g2(spark, d):
    t = gr.trace_flow(tb.tx_graph(spark, d), "C7", 3)
    return t.select("source", "destination", "hops", F.array_join("intermediates", ">").alias("intermediates"), F.round("total", 2).alias("total"), "arrived")


QUERIES["g2_trace_flow"] = g2


def _level(k, time=False):
    cond = f" and (f.arrived is null or e.ts >= f.arrived)" if time else ""
    seen = " union all ".join(f"select addr from l{i}" for i in range(k))
    return f"""l{k} as (select e.to_addr as addr, {k} as hops, list_append(min(f.path), e.to_addr) as path, sum(e.value) as total, min(e.ts) as arrived
   from l{k - 1} f join g e on e.from_addr = f.addr{cond} where e.to_addr not in ({seen}) group by 1)"""


def trace_sql(source, depth, time=False):
    return f"""with g as (select * from {GRAPH}), l0 as (select '{source}' as addr, 0 as hops, ['{source}'] as path, 0.0::double as total, null::timestamp as arrived), """ + ", ".join(
        _level(k, time) for k in range(1, depth + 1)
    ) + f""" select '{source}' as source, addr as destination, hops, array_to_string(path[2:-2], '>') as intermediates, round(total, 2) as total, arrived from ({" union all ".join(f"select * from l{k}" for k in range(1, depth + 1))})"""


ORACLE["g2_trace_flow"] = trace_sql("C7", 3)
QUERIES["g2_trace_flow_in_time"] = lambda spark, d: (lambda t: t.select("source", "destination", "hops", F.array_join("intermediates", ">").alias("intermediates"), F.round("total", 2).alias("total"), "arrived"))(
    gr.trace_flow(tb.tx_graph(spark, d), "C7", 4, ordered_time=True))
ORACLE["g2_trace_flow_in_time"] = trace_sql("C7", 4, True)
QUERIES["g3_shortest_path"] = lambda spark, d: (lambda p: p.select("hops", F.array_join("path", ">").alias("path")))(gr.shortest_path(tb.tx_graph(spark, d), "C7", "C11"))
ORACLE["g3_shortest_path"] = trace_sql("C7", 4).split(" select 'C7' as source")[0] + " select hops, array_to_string(path, '>') as path from (" + " union all ".join(f"select * from l{k}" for k in range(1, 5)) + ") where addr = 'C11'"
