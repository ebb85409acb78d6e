"""Registered log, job, series and index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefield.functions import fixed_values as fv
from tracefield.operators import graph as gr
from tracefield.operators import jobs as jb
from tracefield.operators import ordered as od
from tracefield.session import small_table
from tracefield.sources import tables as tb

QUERIES, ORACLE = {}, {}
LOG, JOBS = tb.LOG, tb.JOBS

QUERIES["f11_deleted_only"] = lambda spark, d: jb.deleted_only(tb.fs_entries(spark, d)).select("inode", "path", "created", "modified")
ORACLE["f11_deleted_only"] = f"select inode, path, created, modified from {tb.FS} where is_deleted"

RANK = "case level " + " ".join(f"when '{n}' then {i}" for i, n in enumerate(fv.LEVEL_RANK)) + " end"
QUERIES["f22_level_filter"] = lambda spark, d: jb.level_filter(tb.op_log(spark, d), "WARN").select("entry_id", "level")
ORACLE["f22_level_filter"] = f"select entry_id, level from {LOG} where {RANK} >= 3"
QUERIES["f22_audit_only"] = lambda spark, d: jb.audit_only(tb.op_log(spark, d)).select("entry_id", "operation", "context")
ORACLE["f22_audit_only"] = f"select entry_id, operation, context from {LOG} where level = 'AUDIT'"
QUERIES["f22_perf_only"] = lambda spark, d: jb.perf_only(tb.op_log(spark, d).withColumn("performance", F.col("value") > 20)).select("entry_id", "value")
ORACLE["f22_perf_only"] = f"select entry_id, value from {LOG} where value > 20"


def f23(spark, d):
    c = tb.load(spark, d, "customer")
    users = c.select(F.concat(F.lit("wf"), F.col("c_custkey").cast("string")).alias("user_id"),
                     F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role"),
                     F.array(F.concat(F.lit("p"), (F.col("c_custkey") % 6).cast("string"))).alias("permissions"))
    rows = tb.jobs(spark, d).select("job_id", F.col("workflow_id").alias("owner"), F.concat(F.lit("p"), F.col("priority").cast("string")).alias("permission"))
    return jb.owner_or_admin(rows, users, "wf2")


QUERIES["f23_owner_or_admin"] = f23
ORACLE["f23_owner_or_admin"] = f"""select job_id, workflow_id as owner, 'p' || priority as permission from {JOBS} where workflow_id = 'wf2' or 'p' || priority = 'p2'
 or exists (select 1 from customer where c_custkey = 2 and c_mktsegment = 'MACHINERY')"""


def errors(spark, d):
    return tb.op_log(spark, d).select(F.col("operation").alias("code"), "message", "context", "ts")


ERR = f"(select operation as code, message, context, ts from {LOG})"
QUERIES["a30_error_stats"] = lambda spark, d: jb.error_stats(errors(spark, d))
ORACLE["a30_error_stats"] = f"select code, count(*) as frequency, count(distinct (message, context)) as distinct_errors, max(ts) as last_seen from {ERR} group by 1"
QUERIES["a31_error_dedup"] = lambda spark, d: jb.error_dedup(errors(spark, d))
ORACLE["a31_error_dedup"] = f"select code, message, context, count(*) as occurrences, max(ts) as last_seen from {ERR} group by 1, 2, 3"
QUERIES["k2_top_errors"] = lambda spark, d: jb.top_errors(errors(spark, d).withColumn("code", F.concat_ws("-", "code", "context")), 5)
ORACLE["k2_top_errors"] = f"select code || '-' || context as code, count(*) as frequency from {ERR} group by 1 order by 2 desc, 1 limit 5"
QUERIES["a32_log_stats"] = lambda spark, d: jb.log_stats(tb.op_log(spark, d))
ORACLE["a32_log_stats"] = "select count(*) as total, " + ", ".join(f"count(*) filter (level = '{n}') as n_{n.lower()}" for n in fv.LEVEL_RANK) + f", min(ts) as session_start, max(ts) as last_entry from {LOG}"


def phases(spark, d):
    e = tb.load(spark, d, "events")
    return e.select(F.floor(F.col("event_id") / 2).alias("operation_id"), F.concat(F.lit("op"), (F.floor(F.col("event_id") / 2) % 7).cast("string")).alias("operation"),
                    F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("phase"), "ts")


QUERIES["a33_operation_durations"] = lambda spark, d: (lambda x: x.select("operation", "n", F.round("mean_seconds", 4).alias("mean_seconds"), F.round("max_seconds", 4).alias("max_seconds")))(jb.operation_durations(phases(spark, d)))
ORACLE["a33_operation_durations"] = """with p as (select event_id // 2 as oid, min(epoch_us(ts)) filter (event_id % 2 = 0) as a, max(epoch_us(ts)) filter (event_id % 2 = 1) as b from events group by 1)
select 'op' || (oid % 7) as operation, count(*) as n, round(avg(b/1e6 - a/1e6), 4) as mean_seconds, round(max(b/1e6 - a/1e6), 4) as max_seconds from p where a is not null and b is not null group by 1"""


def custody(spark, d):
    return tb.op_log(spark, d).select(F.get_json_object("message", "$.k").alias("evidence_id"), "entry_id", "ts", F.col("context").alias("holder"), F.col("operation").alias("action"))


QUERIES["w14_custody_chain"] = lambda spark, d: jb.custody_chain(custody(spark, d))
ORACLE["w14_custody_chain"] = f"""select *, sha256(evidence_id || '|' || entry_id || '|' || coalesce(previous_holder, '-') || '|' || holder || '|' || action) as link_hash from
 (select *, lag(holder) over (partition by evidence_id order by ts, entry_id) as previous_holder from
  (select json_extract_string(message, '$.k') as evidence_id, entry_id, ts, context as holder, operation as action from {LOG}))"""


def t9(spark, d):
    lvl = F.col("level")
    cls = F.when(lvl == "ERROR", "error").when(lvl == "AUDIT", "audit").when(lvl == "DEBUG", "main").when(lvl == "WARN", "performance").otherwise("structured")
    return jb.retention(tb.op_log(spark, d).withColumn("log_class", cls), F.to_date(F.lit("2024-04-10"))).select("entry_id", "log_class")


QUERIES["t9_retention"] = t9
ORACLE["t9_retention"] = f"""select entry_id, log_class from (select *, case level when 'ERROR' then 'error' when 'AUDIT' then 'audit' when 'DEBUG' then 'main' when 'WARN' then 'performance' else 'structured' end as log_class from {LOG})
 where date '2024-04-10' - ts::date <= case log_class when 'error' then 365 when 'audit' then 1825 when 'structured' then 90 else 30 end"""

QUERIES["w2_rate_limit"] = lambda spark, d: jb.rate_limit_bound(tb.load(spark, d, "events").select("event_id", "user_id", "ts"), 2).select("event_id", "user_id", "prior", "over_limit")
ORACLE["w2_rate_limit"] = """select event_id, user_id, n - 1 as prior, n > 2 as over_limit from (select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as n from events)"""


def progress(spark, d):
    e = tb.load(spark, d, "events").select("event_id", "user_id", "ts", "value")
    r = jb.recent_rate(tb.checkpoint(e), ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), F.col("value"), 10)
    r = od.running_sum(r, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), F.col("value"), "done")
    tot = e.groupBy("user_id").agg(F.sum("value").alias("total"), F.min("ts").alias("t0"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return r.join(tot, "user_id").withColumn("elapsed_ms", (us("ts") - us("t0")) / 1000)


PROG = """(select event_id, user_id, sum(value) over (w rows 9 preceding) / 10 as recent_rate, sum(value) over (w rows unbounded preceding) as done, sum(value) over (partition by user_id) as total,
 (epoch_us(ts) - epoch_us(min(ts) over (partition by user_id))) / 1000 as elapsed_ms from events window w as (partition by user_id order by ts, event_id))"""
QUERIES["w3_recent_rate"] = lambda spark, d: progress(spark, d).select("event_id", F.round("recent_rate", 5).alias("recent_rate"))
ORACLE["w3_recent_rate"] = f"select event_id, round(recent_rate, 5) as recent_rate from {PROG}"
QUERIES["w4_eta"] = lambda spark, d: (lambda x: x.select("event_id", F.round("average_rate", 6).alias("average_rate"), F.round("eta", 3).alias("eta")))(jb.eta(progress(spark, d)))
ORACLE["w4_eta"] = f"""select event_id, round(case when elapsed_ms > 0 then done*1000.0/elapsed_ms else 0 end, 6)::double as average_rate, round(case when recent_rate > 0 then (total - done)/recent_rate end, 3) as eta from {PROG}"""

QUERIES["a34_job_stats"] = lambda spark, d: (lambda x: x.select("total", "completed", "running", "queued", F.round("mean_seconds", 3).alias("mean_seconds"), F.round("utilisation", 6).alias("utilisation"), F.round("jobs_per_minute", 9).alias("jobs_per_minute")))(jb.job_stats(tb.jobs(spark, d), 1000))
ORACLE["a34_job_stats"] = f"""select count(*) as total, count(*) filter (status='COMPLETED') as completed, count(*) filter (status='RUNNING') as running, count(*) filter (status='QUEUED') as queued,
 round(avg((epoch_us(finished) - epoch_us(started))/1e6) filter (status='COMPLETED'), 3) as mean_seconds, round(coalesce(sum(units) filter (status='RUNNING'), 0)/1000, 6) as utilisation,
 round(count(*) filter (status='COMPLETED') / ((epoch_us(max(finished)) - epoch_us(min(started)))/1e6/60), 9) as jobs_per_minute from {JOBS}"""
QUERIES["a35_batch_stats"] = lambda spark, d: (lambda x: x.select("total", "succeeded", "failed", F.round("mean_seconds", 4).alias("mean_seconds"), F.round("throughput", 12).alias("throughput")))(jb.batch_stats(tb.repair_runs(spark, d)))
ORACLE["a35_batch_stats"] = f"select count(*) as total, count(*) filter (success) as succeeded, count(*) filter (not success) as failed, round(avg(seconds), 4) as mean_seconds, round(count(*)/sum(seconds), 12) as throughput from {tb.RUNS}"
QUERIES["a36_workflow_rollup"] = lambda spark, d: jb.workflow_rollup(tb.jobs(spark, d)).withColumn("progress", F.round("progress", 6))
ORACLE["a36_workflow_rollup"] = f"select workflow_id, count(*) as total, count(*) filter (status='COMPLETED') as completed, 0 as failed, count(*) filter (status='RUNNING') as running, round(count(*) filter (status='COMPLETED')/count(*), 6) as progress from {JOBS} group by 1"
QUERIES["a38_model_usage"] = lambda spark, d: jb.model_usage(tb.repair_runs(spark, d).select(F.col("tool").alias("model")))
ORACLE["a38_model_usage"] = f"select coalesce(tool, 'all') as model, count(*) as predictions from {tb.RUNS} group by rollup(tool)"


def a40(spark, d):
    lab = tb.load(spark, d, "labels")
    return jb.finding_counts(tb.load(spark, d, "documents").join(lab, "doc_id", "left").select(
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("deepfake"), F.when(F.col("toxic") == 1, "VIOLENCE").otherwise("SAFE").alias("category")))


QUERIES["a40_finding_counts"] = a40
ORACLE["a40_finding_counts"] = "select count(*) as files, count(*) filter (quality = 0) as deepfakes, count(*) filter (toxic = 1) as unsafe from documents left join labels on labels.doc_id = documents.doc_id"


def a41(spark, d):
    f = od.dense_index(tb.index_rows(spark, d), ["file_id"], ["slot"], F.floor(F.col("slot") / 512), "frame_no")
    return jb.corruption_rate(f.select("file_id", "frame_no", (F.col("size") > 30).alias("corrupt"))).withColumn("corrupt_pct", F.round("corrupt_pct", 6))


QUERIES["a41_corruption_rate"] = a41
ORACLE["a41_corruption_rate"] = f"""with f as (select file_id, size, row_number() over (partition by file_id order by slot) - 1 as i, count(*) over (partition by file_id) as frames from {tb.INDEX})
select file_id, max(frames) as frames, count(*) as sampled, round(avg((size > 30)::int)*100, 6) as corrupt_pct, avg((size > 30)::int)*100 < 50 as repairable from f where i % greatest(1, frames // 20) = 0 group by 1"""

QUERIES["k6_order_tasks"] = lambda spark, d: jb.order_tasks(tb.jobs(spark, d).select(F.col("job_id").alias("task_id"), "priority", F.col("started").alias("submitted")))
ORACLE["k6_order_tasks"] = f"select job_id as task_id, priority, started as submitted from {JOBS} order by priority desc, submitted, task_id"


def j20(spark, d):
    o = tb.load(spark, d, "orders")
    n = F.col("o_orderkey")
    deps = F.filter(F.array(n - 1, F.floor(n / 3)), lambda x: (x >= 0) & (x != n))
    return jb.ready_tasks(o.select(n.alias("task_id"), deps.alias("deps")), o.select(n.alias("task_id"), (F.col("o_orderstatus") != "P").alias("success")).filter("success or task_id > 0"))


QUERIES["j20_ready_tasks"] = j20
ORACLE["j20_ready_tasks"] = """select o_orderkey as task_id from orders o where not exists (select 1 from orders x where (x.o_orderkey = o.o_orderkey - 1 or x.o_orderkey = o.o_orderkey // 3) and x.o_orderkey <> o.o_orderkey and x.o_orderstatus = 'P')
 and not exists (select 1 from orders x where x.o_orderkey = 0 and x.o_orderstatus = 'P' and (o.o_orderkey - 1 = 0 or o.o_orderkey // 3 = 0) and o.o_orderkey <> 0)"""


def j19(spark, d):
    p = tb.load(spark, d, "part")
    k = F.col("p_partkey")
    return jb.conflicts(p.select(k.alias("item"), F.array_distinct(F.array((k * 7 + 1) % 1999, (k * 11 + 3) % 1999)).alias("conflicts_with")), p.filter("p_size > 25").select(k.alias("item")))


QUERIES["j19_conflicts"] = j19
ORACLE["j19_conflicts"] = """select item, other from (select distinct p_partkey as item, unnest([(p_partkey*7 + 1) % 1999, (p_partkey*11 + 3) % 1999]) as other from part) where other in (select p_partkey from part where p_size > 25)"""


def j17(spark, d):
    seen = tb.load(spark, d, "events").select(F.col("user_id").alias("pid")).distinct()
    return jb.hidden_processes(seen, tb.load(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("pid")), "pid")


QUERIES["j17_hidden_processes"] = j17
ORACLE["j17_hidden_processes"] = "select distinct user_id as pid from events where user_id not in (select c_custkey from customer where c_acctbal > 0)"


def found_algorithms(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("AES", "DES", "RSA", "ChaCha20", "ROT13")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return tb.load(spark, d, "documents").select(F.col("doc_id").alias("file_id"), name.alias("algorithm"), (F.col("n_chars") % 97 / 97).alias("confidence"))


FOUND = "(select doc_id as file_id, list_extract(['AES','DES','RSA','ChaCha20','ROT13'], (doc_id % 5 + 1)::bigint) as algorithm, n_chars % 97 / 97 as confidence from documents)"


def j18(spark, d):
    known = small_table(spark, [(n, k, s, b, ok) for n, k, s, b, ok in fv.KNOWN_ALGORITHMS], "algorithm string, kind string, key_sizes array<int>, block_size int, is_secure boolean")
    return jb.weak_algorithms(found_algorithms(spark, d), known).select("file_id", "algorithm", "kind", "block_size")


QUERIES["j18_weak_algorithms"] = j18
ORACLE["j18_weak_algorithms"] = f"select file_id, algorithm, 'SymmetricBlock' as kind, 8 as block_size from {FOUND} where algorithm = 'DES'"
QUERIES["u4_dedup_findings"] = lambda spark, d: jb.dedup_findings(found_algorithms(spark, d), "algorithm").withColumn("confidence", F.round("confidence", 6))
ORACLE["u4_dedup_findings"] = f"select algorithm, file_id, round(confidence, 6) as confidence from (select *, row_number() over (partition by algorithm order by confidence desc, file_id desc) as rn from {FOUND}) where rn = 1"


def preds(spark, d):
    """Order lines as class predictions of a file."""
    return tb.load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"),
        F.concat("l_returnflag", (F.col("l_suppkey") % 5).cast("string")).alias("class"), (F.col("l_quantity") / 50).alias("confidence"))


PREDS = "(select l_orderkey as file_id, l_linenumber*10000000 + l_partkey*1000 + l_suppkey as ord, l_returnflag || (l_suppkey % 5) as class, l_quantity/50 as confidence from lineitem)"
QUERIES["w12_top_prediction"] = lambda spark, d: jb.top_prediction(preds(spark, d)).withColumn("top", F.array_join("top", ","))
ORACLE["w12_top_prediction"] = f"""with c as (select * from (select *, row_number() over (partition by file_id, class order by confidence desc, ord) as rn from {PREDS}) where rn = 1),
 r as (select *, row_number() over (partition by file_id order by confidence desc, ord, class) as rk from c)
select file_id, max(class) filter (rk = 1) as best, max(confidence) as confidence, string_agg(class, ',' order by rk) filter (rk <= 3) as top from r group by 1"""


def u6(spark, d):
    p = preds(spark, d)
    return jb.merge_secondary(p.select("file_id", "ord", F.array("class", F.substring("class", 1, 1), F.lit("any")).alias("categories"))).withColumn("categories", F.array_join("categories", ","))


QUERIES["u6_merge_secondary"] = u6
ORACLE["u6_merge_secondary"] = f"""with e as (select file_id, ord, unnest([0, 1, 2]) as pos, unnest([class, class[1:1], 'any']) as category from {PREDS}), f as (select file_id, category, min(ord*10 + pos) as place from e group by 1, 2)
select file_id, string_agg(category, ',' order by place) as categories from f group by 1"""

QUERIES["w6_index_monotonic"] = lambda spark, d: jb.index_monotonic(tb.index_rows(spark, d), "slot", 512).select("file_id", "slot", "offset", "invalid")
MONO = f"""(select file_id, slot, "offset", "offset" <= coalesce(lag("offset") over (partition by file_id order by slot), 0) or size = 0 or size > 104857600 as invalid from {tb.INDEX})"""
ORACLE["w6_index_monotonic"] = f"select * from {MONO}"
QUERIES["w6_index_valid"] = lambda spark, d: jb.index_valid(jb.index_monotonic(tb.index_rows(spark, d), "slot", 512))
ORACLE["w6_index_valid"] = f"select file_id, bool_and(not invalid) as valid, count(*) filter (invalid) as bad_rows from {MONO} group by 1"


def w7(spark, d):
    i = tb.index_rows(spark, d).withColumn("size", F.when(F.col("size") == 13, 0).otherwise(F.col("size")))
    sizes = i.groupBy("file_id").agg((F.max("slot") - 100).alias("file_size"))
    return jb.index_repair(i, sizes, "slot", F.lit(40).cast("bigint"), 512).select("file_id", "slot", "new_offset", "new_size")


QUERIES["w7_index_repair"] = w7
# walked step by step, as the definition reads
ORACLE["w7_index_repair"] = f"""with recursive i as (select file_id, slot, "offset" as o, case when size = 13 then 1048576 else size end as s, row_number() over (partition by file_id order by slot) as n,
  max(slot) over (partition by file_id) - 100 as fs from {tb.INDEX}),
 w as (select file_id, 0::bigint as n, null::bigint as slot, null::bigint as new_offset, null::bigint as new_size, 40::bigint as cur from i where n = 1
  union all select file_id, n, slot, off, least(s, fs - off), off + least(s, fs - off) from
   (select i.*, case when o < cur or o >= fs then cur else o end as off from w join i on i.file_id = w.file_id and i.n = w.n + 1))
select file_id, slot, new_offset, new_size from w where n > 0"""

QUERIES["w10_gap_fill"] = lambda spark, d: jb.gap_fill(tb.series(spark, d), ["name"], "idx", "x").withColumn("x", F.round("x", 6))
ORACLE["w10_gap_fill"] = f"""with s as (select *, lead(idx) over w as ni, lead(x) over w as nx from {tb.SERIES} window w as (partition by name order by idx))
select name, idx, round(x, 6) as x, false as filled from s union all
select name, idx + k, round(x*(1 - k/(ni - idx)) + nx*(k/(ni - idx)), 6), true from (select *, unnest(range(1, ni - idx)) as k from s where ni - idx - 1 between 1 and 5)"""
QUERIES["w11_temporal_smooth"] = lambda spark, d: jb.temporal_smooth(tb.series(spark, d), ["name"], "idx", "x").select("name", "idx", F.round("smooth", 6).alias("smooth"))
ORACLE["w11_temporal_smooth"] = f"select name, idx, round(coalesce(x*0.8 + 0.2*lag(x) over (partition by name order by idx), x), 6) as smooth from {tb.SERIES}"


def g4(spark, d):
    p = tb.load(spark, d, "part")
    k = F.col("p_partkey")
    needs = F.filter(F.array(F.floor(k / 2), F.floor(k / 3), F.when(F.col("p_size") == 7, k + 1000000000)), lambda x: x.isNotNull() & (x != k))
    return gr.dependency_closure(p.select(k.alias("item")), p.select(k.alias("item"), F.explode(needs).alias("needs")))


QUERIES["g4_dependency_closure"] = g4
ORACLE["g4_dependency_closure"] = """with recursive l as (select p_partkey as item, unnest([p_partkey // 2, p_partkey // 3, case when p_size = 7 then p_partkey + 1000000000 end]) as needs from part),
 c as (select p_partkey as root, p_partkey as item from part union select c.root, l.needs from c join l on l.item = c.item where l.needs is not null and l.needs <> l.item)
select root, item, item in (select p_partkey from part) as known from c"""


def g5(spark, d):
    c = tb.load(spark, d, "customer")
    k = F.col("c_custkey")
    t = gr.process_tree(c.select(k.alias("pid"), F.when(k > 0, F.floor((k - 1) / 3)).alias("ppid")))
    return t.select("pid", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


QUERIES["g5_process_tree"] = g5
ORACLE["g5_process_tree"] = """with recursive t as (select c_custkey as pid, 0 as depth, c_custkey::varchar as path from customer where c_custkey = 0
 union all select c_custkey, depth + 1, path || '>' || c_custkey from t join customer on c_custkey > 0 and (c_custkey - 1) // 3 = t.pid) select * from t"""
