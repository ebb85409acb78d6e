"""Registered traffic and timeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefield.functions import fixed_values as fv
from tracefield.operators import ordered as od
from tracefield.operators import traffic as tr
from tracefield.session import small_table
from tracefield.sources import tables as tb

QUERIES, ORACLE = {}, {}
NET = tb.NET


def a13(spark, d):
    return tr.protocol_distribution(tb.net_packets(spark, d)).withColumn("share", F.round("share", 6))


QUERIES["a13_protocol_distribution"] = a13
PROTO_SQL = f"""select p.protocol, packets, bytes, first_seen, last_seen, endpoints, round(packets * 100.0 / (select count(*) from {NET}), 6)::double as share
from (select protocol, count(*) as packets, sum(size)::bigint as bytes, min(ts) as first_seen, max(ts) as last_seen from {NET} group by 1) p
join (select protocol, count(distinct ip) as endpoints from (select protocol, src_ip as ip from {NET} union all select protocol, dst_ip from {NET}) group by 1) e
 on e.protocol = p.protocol"""
ORACLE["a13_protocol_distribution"] = PROTO_SQL

QUERIES["a14_traffic_volume"] = lambda spark, d: tr.traffic_volume(tb.net_packets(spark, d))
ORACLE["a14_traffic_volume"] = f"""select sum(size)::bigint as total_bytes, sum(size) filter (direction = 'inbound')::bigint as inbound_bytes,
 sum(size) filter (direction <> 'inbound')::bigint as outbound_bytes from {NET}""".replace("sum(size) filter (direction = 'inbound')::bigint", "(sum(size) filter (direction = 'inbound'))::bigint").replace("sum(size) filter (direction <> 'inbound')::bigint", "(sum(size) filter (direction <> 'inbound'))::bigint")

HOST_SQL = f"""select host, sum(size)::bigint as bytes from (select src_ip || ':' || src_port as host, size from {NET}
 union all select dst_ip || ':' || dst_port, size from {NET}) group by 1"""
QUERIES["a15_host_traffic"] = lambda spark, d: tr.host_traffic(tb.net_packets(spark, d))
ORACLE["a15_host_traffic"] = HOST_SQL

QUERIES["k1_top_talkers"] = lambda spark, d: tr.top_talkers(tb.net_packets(spark, d))
ORACLE["k1_top_talkers"] = HOST_SQL + " order by bytes desc, host limit 10"

QUERIES["a16_flows"] = lambda spark, d: tr.flows(tb.net_packets(spark, d))
ORACLE["a16_flows"] = f"""select src_ip, src_port, dst_ip, dst_port, protocol, min(ts) as start_ts, max(ts) as end_ts, count(*) as packets,
 sum(size)::bigint as bytes from {NET} group by 1,2,3,4,5"""

QUERIES["a16_flow_segments"] = lambda spark, d: tr.flow_segments(tb.net_packets(spark, d))
ORACLE["a16_flow_segments"] = f"""select src_ip, src_port, dst_ip, dst_port, protocol, segment, min(ts) as start_ts,
 string_agg(payload, '' order by i) as payload_hex from (select *, row_number() over w - 1 as i, (row_number() over w - 1) // 1024 as segment from {NET}
 window w as (partition by src_ip, src_port, dst_ip, dst_port, protocol order by ts, packet_id)) group by 1,2,3,4,5,6"""

QUERIES["a17_bidirectional_flows"] = lambda spark, d: tr.bidirectional_flows(tb.net_packets(spark, d))
ORACLE["a17_bidirectional_flows"] = f"""select least(a, b) as end_a, greatest(a, b) as end_b, protocol, count(*) filter (a <= b) as packets_ab,
 count(*) filter (a > b) as packets_ba, coalesce(sum(size) filter (a <= b), 0)::bigint as bytes_ab, coalesce(sum(size) filter (a > b), 0)::bigint as bytes_ba,
 min(ts) as start_ts, max(ts) as end_ts from (select *, src_ip || ':' || src_port as a, dst_ip || ':' || dst_port as b from {NET}) group by 1,2,3"""

QUERIES["g7_contact_network"] = lambda spark, d: tr.contact_network(tb.net_packets(spark, d))
ORACLE["g7_contact_network"] = f"""select least(src_ip, dst_ip) as node_a, greatest(src_ip, dst_ip) as node_b, count(*) as contacts,
 sum(size)::bigint as weight from {NET} group by 1,2"""

SCAN_SQL = f"select src_ip, dst_ip, count(distinct dst_port) as ports from {NET} group by 1,2 having count(distinct dst_port) >= 3"
QUERIES["a18_port_scan"] = lambda spark, d: tr.port_scan(tb.net_packets(spark, d), 3)
ORACLE["a18_port_scan"] = SCAN_SQL

DDOS_SQL = f"""select dst_ip, date_trunc('day', ts)::timestamp as window_start, count(distinct src_ip) as sources from {NET}
 group by 1,2 having count(distinct src_ip) >= @n"""
QUERIES["a19_ddos"] = lambda spark, d: tr.ddos(tb.net_packets(spark, d), "1 day", 6)
ORACLE["a19_ddos"] = DDOS_SQL.replace("@n", "6")

QUERIES["a20_unusual_protocols"] = lambda spark, d: tr.unusual_protocols(tb.net_packets(spark, d), 20.0).withColumn("share", F.round("share", 6))
ORACLE["a20_unusual_protocols"] = f"select * from ({PROTO_SQL}) where packets * 100.0 / (select count(*) from {NET}) < 20.0"

EXF_SQL = f"""select * from (select src_ip, sum(size)::bigint as out_bytes from {NET} where direction <> 'inbound' group by 1)
 where out_bytes > (select avg(s) + @k * stddev_pop(s) from (select sum(size) as s from {NET} where direction <> 'inbound' group by src_ip))"""
QUERIES["a21_exfiltration"] = lambda spark, d: tr.exfiltration(tb.net_packets(spark, d), 1.0)
ORACLE["a21_exfiltration"] = EXF_SQL.replace("@k", "1.0")


def _starts(marks):
    return " or ".join(f"starts_with(payload, '{m.encode('latin-1').hex().upper()}')" for m in marks)


APP_SQL = "(select packet_id, unnest(range(len(l))) as rank, unnest(l) as app_protocol from (select packet_id, list_filter([" + ", ".join(
    f"case when {_starts(m)} then '{n}' end" for n, m in fv.PROTOCOL_SIGNATURES
) + f"], lambda x: x is not null) as l from {NET}))"
QUERIES["f19_protocol_by_payload"] = lambda spark, d: tr.protocol_by_payload(tb.net_packets(spark, d))
ORACLE["f19_protocol_by_payload"] = f"select packet_id, rank, app_protocol, rank = 0 as is_primary from {APP_SQL}"

BAD_SQL = "(select packet_id, src_ip, unnest(list_filter([" + ", ".join(
    f"case when regexp_matches(payload, '^(?:..)*?{p.hex().upper()}') then '{n}' end" for n, p in fv.MALICIOUS_PATTERNS
) + f"], lambda x: x is not null)) as threat from {NET})"
QUERIES["f20_malicious_payload"] = lambda spark, d: tr.malicious_payload(tb.net_packets(spark, d))
ORACLE["f20_malicious_payload"] = f"select * from {BAD_SQL}"

QUERIES["f28_extractable_flows"] = lambda spark, d: tr.extractable_flows(
    tr.protocol_by_payload(tb.net_packets(spark, d)).filter("is_primary")
).select("packet_id", "app_protocol", "route")
ORACLE["f28_extractable_flows"] = f"""select packet_id, app_protocol, case when app_protocol in ('HTTP','HTTPS','TLS') then 'web' when app_protocol = 'FTP' then 'ftp'
 else 'mail' end as route from {APP_SQL} where rank = 0 and app_protocol in ('HTTP','HTTPS','TLS','FTP','SMTP')"""


def j12(spark, d):
    domains = small_table(spark, [(x,) for x in fv.SUSPICIOUS_DOMAINS], "domain string")
    return tr.suspicious_domains(tb.net_packets(spark, d), domains).select("packet_id", "host")


QUERIES["j12_suspicious_domains"] = j12
ORACLE["j12_suspicious_domains"] = f"select packet_id, host from {NET} where " + " or ".join(
    f"host = '{x}' or ends_with(host, '.{x}')" for x in fv.SUSPICIOUS_DOMAINS
)


def geo_ranges(spark, d):
    base = (192 * 256 + 168) * 65536 + 256
    return tb.load(spark, d, "nation").select(
        (F.lit(base) + F.col("n_nationkey").cast("bigint") * 3).alias("ip_from"),
        (F.lit(base) + F.col("n_nationkey").cast("bigint") * 3 + 2).alias("ip_to"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("isp"), F.col("n_regionkey").cast("string")).alias("isp"),
        (F.col("n_nationkey") % 5 == 0).alias("is_vpn"),
    )


QUERIES["j13_geo_enrich"] = lambda spark, d: tr.geo_enrich(tb.net_packets(spark, d), geo_ranges(spark, d)).select(
    "packet_id", "dst_ip", "country", "isp", "is_vpn"
)
ORACLE["j13_geo_enrich"] = f"""select packet_id, dst_ip, n_name as country, 'isp' || n_regionkey as isp, n_nationkey % 5 = 0 as is_vpn
 from {NET} left join nation on split_part(dst_ip, '.', 4)::int between n_nationkey * 3 and n_nationkey * 3 + 2"""


def w5(spark, d):
    per_min = tb.net_packets(spark, d).groupBy("protocol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("tick")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counters = od.running_sum(per_min, ["protocol"], ["tick"], F.date_trunc("day", "tick"), F.col("n"), "counter")
    return tr.rate_per_tick(tb.checkpoint(counters.drop("n")), ["protocol"], "tick", "counter", F.date_trunc("day", "tick"))


QUERIES["w5_rate_per_tick"] = w5
ORACLE["w5_rate_per_tick"] = f"""with c as (select protocol, date_trunc('hour', ts)::timestamp as tick, count(*) as n from {NET} group by 1,2),
 s as (select protocol, tick, (sum(n) over (partition by protocol order by tick))::bigint as counter from c)
select *, counter - coalesce(lag(counter) over (partition by protocol order by tick), 0) as rate from s"""


def w13(spark, d):
    p = tr.periodic_flows(tb.net_packets(spark, d), 0.6, 3)
    return p.select("src_ip", "dst_ip", "gaps", F.round("mean_gap", 3).alias("mean_gap"), F.round("cv", 6).alias("cv"))


QUERIES["w13_periodic_flows"] = w13
ORACLE["w13_periodic_flows"] = f"""with g as (select src_ip, dst_ip, epoch_us(ts)/1e6 - lag(epoch_us(ts)/1e6) over (partition by src_ip, dst_ip order by ts, packet_id) as gap from {NET}),
 s as (select src_ip, dst_ip, count(*) as gaps, avg(gap) as m, stddev_pop(gap) as sd from g where gap is not null group by 1,2)
select src_ip, dst_ip, gaps, round(m, 3) as mean_gap, round(sd/m, 6) as cv from s where gaps >= 3 and m > 0 and sd/m < 0.6"""

QUERIES["u1_union_anomalies"] = lambda spark, d: tr.union_anomalies(tb.net_packets(spark, d), ports=3, sources=6, share_pct=20.0, k=1.0)
ANOM_SQL = f"""(select 'port_scan' as kind, src_ip || '>' || dst_ip as subject, 0.6::double as severity, ports as detail from ({SCAN_SQL})
 union all select 'ddos', dst_ip || '@' || strftime(window_start, '%Y-%m-%d'), 0.8, sources from ({DDOS_SQL.replace('@n', '6')})
 union all select 'malicious_traffic', src_ip || ':' || threat, 0.8, count(*) from {BAD_SQL} group by src_ip, threat
 union all select 'unusual_protocol', protocol, 0.4, packets from ({ORACLE['a20_unusual_protocols']})
 union all select 'exfiltration', src_ip, 0.9, out_bytes from ({EXF_SQL.replace('@k', '1.0')}))"""
ORACLE["u1_union_anomalies"] = f"select * from {ANOM_SQL}"
QUERIES["k5_rank_findings"] = lambda spark, d: tr.rank_findings(QUERIES["u1_union_anomalies"](spark, d))
ORACLE["k5_rank_findings"] = f"select * from {ANOM_SQL} order by severity desc, detail desc, kind, subject"

BURST_SQL = """select h::timestamp as first_seen, (h + interval 1 hour)::timestamp as last_seen, occurrences, 0.8::double as confidence, 0.6::double as suspicion, 'MEDIUM' as threat_level
 from (select date_trunc('hour', @t) as h, count(*) as occurrences from @src group by 1) where occurrences > 10"""
QUERIES["w1_hourly_bursts"] = lambda spark, d: tr.hourly_bursts(tb.load(spark, d, "events"), "ts")
ORACLE["w1_hourly_bursts"] = BURST_SQL.replace("@t", "ts").replace("@src", "events")
QUERIES["w1_file_bursts"] = lambda spark, d: tr.hourly_bursts(tb.fs_entries(spark, d), "modified")
ORACLE["w1_file_bursts"] = BURST_SQL.replace("@t", "modified").replace("@src", tb.FS)


def u7(spark, d):
    a = tb.load(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"))
    b = tb.load(spark, d, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("entity"))
    return tr.common_entities(a, b)


QUERIES["u7_common_entities"] = u7
ORACLE["u7_common_entities"] = "select 'u' || user_id as entity from events intersect select 'u' || c_custkey from customer where c_acctbal < 0"


def r16(spark, d):
    e = tb.fs_entries(spark, d)
    return tr.timeline(e.withColumn("accessed", F.col("modified")))


QUERIES["r16_timeline"] = r16
ORACLE["r16_timeline"] = f"""select path, created as ts, 'FILE_CREATED' as event, 0.9::double as confidence, 'STRONG' as evidence from {tb.FS}
 union all select path, modified, 'FILE_MODIFIED', 0.9, 'STRONG' from {tb.FS} where modified <> created
 union all select path, modified, 'FILE_ACCESSED', 0.7, 'MODERATE' from {tb.FS}"""


def r17(spark, d):
    net = tb.net_packets(spark, d).select("ts", F.lit("network").alias("source"), F.col("src_ip").alias("subject"), F.col("protocol").alias("event"))
    files = tr.timeline(tb.fs_entries(spark, d).withColumn("accessed", F.lit(None).cast("timestamp_ntz"))).select(
        "ts", F.lit("file").alias("source"), F.col("path").alias("subject"), "event")
    users = tb.op_log(spark, d).select("ts", F.lit("user").alias("source"), F.col("context").alias("subject"), F.col("level").alias("event"))
    return tr.unified_timeline(net, files, users)


QUERIES["r17_unified_timeline"] = r17
ORACLE["r17_unified_timeline"] = f"""select ts, 'network' as source, src_ip as subject, protocol as event from {NET}
 union all select created, 'file', path, 'FILE_CREATED' from {tb.FS} union all select modified, 'file', path, 'FILE_MODIFIED' from {tb.FS} where modified <> created
 union all select ts, 'user', context, level from {tb.LOG}"""
