"""Registered streaming queries: the given tables arrive as streams, are processed to the end, and the written tables are returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefield.catalog.carving import CARVED, sigs
from tracefield.session import small_table
from tracefield.sources import tables as tb
from tracefield.streaming import live as lv
from tracefield.streaming.images import GrowingImages

QUERIES, ORACLE = {}, {}


def read_out(spark, folder):
    df = spark.read.parquet(folder)
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else f.name for f in df.schema])


def events(spark, d):
    tb.load(spark, d, "events")
    return lv.stream_table(spark, d, "events")


def packets(spark, d):
    return events(spark, d).select(
        "ts", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("src_ip"), F.round(F.col("value") * 100).cast("bigint").alias("size"))


# a window is final once the watermark (latest time - 10 minutes) has passed its end
DONE = "(select max(ts) - interval 10 minute from events)"


def t1(spark, d):
    out = read_out(spark, lv.run_available(lv.stream_counters(packets(spark, d), "10 minutes")))
    return out.select("window_start", "packets", "bytes", F.round("packets_per_second", 6).alias("packets_per_second"), F.round("bytes_per_second", 4).alias("bytes_per_second"))


QUERIES["t1_stream_counters"] = t1
ORACLE["t1_stream_counters"] = f"""select w as window_start, packets, bytes, round(packets/600, 6) as packets_per_second, round(bytes/600, 4) as bytes_per_second from
 (select time_bucket(interval 10 minute, ts) as w, count(*) as packets, sum(round(value*100))::bigint as bytes from events group by 1) where w + interval 10 minute <= {DONE}"""

QUERIES["t2_stream_bursts"] = lambda spark, d: read_out(spark, lv.run_available(lv.stream_bursts(events(spark, d), 10)))
ORACLE["t2_stream_bursts"] = f"""select h::timestamp as first_seen, (h + interval 1 hour)::timestamp as last_seen, n as occurrences from (select date_trunc('hour', ts) as h, count(*) as n from events group by 1)
 where n > 10 and h + interval 1 hour <= {DONE}"""


def t3(spark, d):
    t = F.col("event_type")
    kind = F.when(t == "view", "change").when(t == "click", "connection").when(t == "error", "memory").when(t == "purchase", "cpu").otherwise("other")
    s = events(spark, d).select("ts", kind.alias("kind"), "value")
    return read_out(spark, lv.run_available(lv.stream_thresholds(s, 8, 8, 75.0, 80.0, "1 hour", "15 minutes")))


QUERIES["t3_stream_thresholds"] = t3
ORACLE["t3_stream_thresholds"] = f"""select * from (select time_bucket(interval 15 minute, ts) - k * interval 15 minute as window_start, count(*) filter (event_type = 'view') as changes, count(*) filter (event_type = 'click') as connections,
 max(value) filter (event_type = 'error') as memory, max(value) filter (event_type = 'purchase') as cpu from events cross join (select unnest(range(4)) as k) group by 1)
 where (changes > 8 or connections > 8 or memory > 75 or cpu > 80) and window_start + interval 1 hour <= {DONE}"""

QUERIES["t4_stream_sessions"] = lambda spark, d: read_out(spark, lv.run_available(lv.stream_sessions(packets(spark, d), ["src_ip"], "2 hours")))
ORACLE["t4_stream_sessions"] = f"""with g as (select 'u' as x, '10.0.0.' || user_id as src_ip, ts, round(value*100)::bigint as size, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as s from events),
 n as (select *, sum(s) over (partition by src_ip order by ts) as sid from g)
select src_ip, min(ts) as session_start, max(ts) + interval 2 hour as session_end, count(*) as packets, sum(size)::bigint as bytes from n group by src_ip, sid having max(ts) + interval 2 hour <= {DONE}"""

RULES = [("hot_errors", "error", ">", 10.0, 600), ("low_views", "view", "<=", 60.0, 3600), ("not_five", "click", "!=", 5.0, 7200)]


def t5(spark, d):
    m = events(spark, d).select("ts", F.col("event_type").alias("metric"), F.concat(F.lit("z"), (F.col("user_id") % 10).cast("string")).alias("subject"), "value")
    rules = small_table(spark, RULES, "rule_id string, metric string, op string, threshold double, duration int")
    out = read_out(spark, lv.run_available(lv.alert_rules(m, rules)))
    return out.select("rule_id", "subject", "started_us", "fired_us")


QUERIES["t5_alert_rules"] = t5
_cond = "case rule_id when 'hot_errors' then value > 10 when 'low_views' then value <= 60 else value <> 5 end"
# a condition holds until a row breaks it or a day without rows ends it; it fires if that is not before its duration, once a row or the watermark is past it
ORACLE["t5_alert_rules"] = f"""with m as (select 'z' || (user_id % 10) as subject, epoch_us(ts) as us, value, rule_id, duration, {_cond} as holds from events
  join (values ('hot_errors', 'error', 600), ('low_views', 'view', 3600), ('not_five', 'click', 7200)) r(rule_id, metric, duration) on metric = event_type),
 g as (select *, us - lag(us) over w > 86400000000 as anew from m window w as (partition by rule_id, subject order by us, holds desc)),
 i as (select *, sum(case when holds and not coalesce(anew, false) then 0 else 1 end) over (partition by rule_id, subject order by us, holds desc rows unbounded preceding) as island from g),
 h as (select rule_id, subject, duration, island, min(us) filter (holds) as started from i group by 1, 2, 3, 4),
 n as (select h.*, (select min(us) from m where m.rule_id = h.rule_id and m.subject = h.subject and not holds and us >= started) as broke,
  started + duration::bigint * 1000000 as fired_us, (select max(us) from m where m.rule_id = h.rule_id and m.subject = h.subject) as last from h where started is not null)
select rule_id, subject, started as started_us, fired_us from n
where fired_us <= coalesce(broke, fired_us) and (fired_us <= last or fired_us < epoch_us({DONE}))"""


def t6(spark, d):
    r = events(spark, d).select("ts", F.col("event_id").alias("request_id"), "user_id")
    return read_out(spark, lv.run_available(lv.stream_rate_limit(r, 2, 43200))).select("user_id", "request_id", "accepted")


QUERIES["t6_stream_rate_limit"] = t6
ORACLE["t6_stream_rate_limit"] = """with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
 w as (select user_id, null::bigint as event_id, 0::bigint as n, []::bigint[] as kept, null::boolean as accepted from (select distinct user_id from events)
  union all select e.user_id, e.event_id, e.n, case when len(k) < 2 then list_append(k, us) else k end, len(k) < 2 from
   (select w.user_id as u, w.n as pn, kept from w) p join (select * from e) e on e.user_id = p.u and e.n = p.pn + 1, lateral (select list_filter(kept, lambda t: us - t < 43200000000) as k))
select user_id, event_id as request_id, accepted from w where n > 0"""


def log_stream(spark, d):
    return events(spark, d).select("ts", F.col("event_type").alias("code"), F.lit("m").alias("message"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("context"))


def t7(spark, d):
    folder = lv.work_dir(spark) + "/errors-" + lv.uuid.uuid4().hex
    lv.run_available(lv.stream_error_counts(log_stream(spark, d)), batch=lv.append_batches(folder), mode="update")
    return lv.error_history(spark, folder)


QUERIES["t7_stream_error_dedup"] = t7
ORACLE["t7_stream_error_dedup"] = "select event_type as code, 'm' as message, 'u' || user_id as context, count(*) as occurrences, max(ts) as last_seen from events group by 1, 2, 3"


def t7_first(spark, d):
    return read_out(spark, lv.run_available(lv.stream_error_first(log_stream(spark, d)))).select("code", "message", "context")


QUERIES["t7_stream_error_first"] = t7_first
ORACLE["t7_stream_error_first"] = "select distinct event_type as code, 'm' as message, 'u' || user_id as context from events"


def t8(spark, d):
    li = lv.stream_table(spark, d, "lineitem")
    o = tb.load(spark, d, "orders").select("o_orderkey", "o_custkey")
    tx = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("tx_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("from_addr"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("to_addr"), F.col("l_extendedprice").alias("value"))
    return read_out(spark, lv.run_available(lv.stream_watchlist(tx, tb.intel(spark, d))))


QUERIES["t8_stream_watchlist"] = t8
ORACLE["t8_stream_watchlist"] = f"select tx_id, from_addr, to_addr, value, to_addr as addr, 'HIGH' as severity from {tb.TX} where to_addr in {tb.INTEL}"


def t10(spark, d):
    """The pages as one image whose chunks arrive in five batches, each of a file per core."""
    folder = lv.work_dir(spark) + "/growing-" + lv.uuid.uuid4().hex
    image = tb.ev_image(spark, d)
    cores = spark.sparkContext.defaultParallelism
    run = lambda n: F.floor(F.col("chunk_no") / n)
    file = F.pmod(run(7), F.lit(5)) * cores + F.pmod(run(35), F.lit(cores))
    image.repartitionById(5 * cores, file.cast("int")).write.parquet(f"{folder}/arrived")
    arrived = spark.readStream.schema(image.schema).option("maxFilesPerTrigger", cores).parquet(f"{folder}/arrived")
    growing = GrowingImages(spark, sigs(spark), folder, span=1 << 16)
    lv.run_available(arrived, batch=growing.step())
    return growing.finish()


QUERIES["t10_stream_carve"] = t10
ORACLE["t10_stream_carve"] = CARVED + "select image_id, name, start_offset, end_offset, is_complete, size from carved"
