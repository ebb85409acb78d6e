"""Registered strategy and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefield.catalog.bytestats import ENT
from tracefield.functions import bytesops as by
from tracefield.functions import filetypes as ft
from tracefield.functions import fixed_values as fv
from tracefield.functions import scalars as sc
from tracefield.operators import strategy as st
from tracefield.operators.quantiles import exact_median
from tracefield.sources import tables as tb

QUERIES, ORACLE = {}, {}

S_ORDER = ["ts", "asset", "file_size_mb", "corruption_severity", "bitrate_mbps"]
O_ORDER = ["completed_at", "asset", "host", "seconds"]


def scen(spark, d, columns=None):
    return st.latest(tb.scenarios(spark, d), "scenario_id", S_ORDER, columns)


def outcomes(spark, d, columns=None):
    r = tb.repair_runs(spark, d)
    return st.latest(r, "scenario_id", O_ORDER, columns).withColumn(
        "tools_used", F.when(F.col("quality") < 0.8, F.array("tool", F.lit("ffmpeg"))).otherwise(F.array("tool"))
    ).withColumn("confidence", F.col("file_size_mb") / 50)


def _last(src, order):
    return f"(select * exclude (rn) from (select *, row_number() over (partition by scenario_id order by {', '.join(o + ' desc' for o in order)}) as rn from {src}) where rn = 1)"


SCEN = _last(tb.SCEN, S_ORDER)
OUT = f"(select *, case when quality < 0.8 then [tool, 'ffmpeg'] else [tool] end as tools_used, file_size_mb / 50 as confidence from {_last(tb.RUNS, O_ORDER)})"

QUERIES["u5_latest_outcome"] = lambda spark, d: outcomes(spark, d).select("scenario_id", "tool", "success", F.round("quality", 6).alias("quality"), "completed_at", "asset")
ORACLE["u5_latest_outcome"] = f"select scenario_id, tool, success, round(quality, 6) as quality, completed_at, asset from {OUT}"

QUERIES["j7_scenarios_with_outcomes"] = lambda spark, d: st.scenarios_with_outcomes(
    scen(spark, d).select("scenario_id", "container_format"), outcomes(spark, d).filter("success").select("scenario_id", "tool"))
ORACLE["j7_scenarios_with_outcomes"] = f"select s.scenario_id, container_format, tool from {SCEN} s join {OUT} o on o.scenario_id = s.scenario_id where success"

QUERIES["a27_tool_performance"] = lambda spark, d: st.tool_performance(outcomes(spark, d)).withColumn("success_rate", F.round("success_rate", 6))
TOOLS = f"(select tool, count(*) as total, count(*) filter (success) as successful, count(*) filter (success) / count(*) as rate from (select unnest(tools_used) as tool, success from {OUT}) group by 1)"
ORACLE["a27_tool_performance"] = f"select tool, total, successful, round(rate, 6) as success_rate from {TOOLS}"

QUERIES["a28_outcome_stats"] = lambda spark, d: (lambda x: x.select("total_repairs", *[F.round(c, 6).alias(c) for c in x.columns[1:]]))(st.outcome_stats(outcomes(spark, d)))
ORACLE["a28_outcome_stats"] = f"""select count(*) as total_repairs, round(avg(success::int), 6) as success_rate, round(avg(quality) filter (quality > 0), 6) as average_quality,
 round(median(quality) filter (quality > 0), 6) as median_quality from {OUT}"""

QUERIES["a29_threshold_sweep"] = lambda spark, d: st.threshold_sweep(outcomes(spark, d)).select("threshold", F.round("accuracy", 6).alias("accuracy"))
ORACLE["a29_threshold_sweep"] = f"""select t as threshold, round(acc, 6) as accuracy from (select t::double as t, count(*) filter (success) / count(*) as acc, count(*) as n from {OUT}
 cross join (select unnest([0.5, 0.6, 0.7, 0.8, 0.9]) as t) where confidence >= t group by 1) where n >= 10 order by acc desc, t limit 1"""


def vecs(spark, d):
    return scen(spark, d).select("*", st.feature_vector().alias("vec"))


def history(spark, d):
    """(scenario_id, vec, success, tool): each scenario's newest row beside its newest outcome.

    Both tables meet in one aggregation, with only the columns that are wanted.
    """
    s = tb.scenarios(spark, d).select("scenario_id", F.struct(*S_ORDER, st.feature_vector().alias("vec")).alias("s"))
    o = tb.repair_runs(spark, d).select("scenario_id", F.struct(*O_ORDER, "success", "tool").alias("o"))
    both = s.unionByName(o, allowMissingColumns=True).groupBy("scenario_id").agg(F.max("s").alias("s"), F.max("o").alias("o"))
    return both.filter("s is not null and o is not null").select("scenario_id", "s.vec", "o.success", "o.tool")


_one = lambda c: f"case when {c} then 1.0 else 0.0 end"
VEC_SQL = "[" + ", ".join(f"({x})::float::double" for x in [
    "file_size_mb", "duration_seconds", "bitrate_mbps", "width", "height", "corruption_severity", _one("header_corruption"), _one("metadata_corruption"),
    _one("stream_corruption"), _one("fragment_corruption"), "available_tools", _one("reference_file_available"), "max_processing_time / 3600.0",
    *[_one(f"container_format = '{f}'") for f in ("mp4", "mov", "avi", "mkv")], *[_one(f"contains(lower(video_codec), '{c}')") for c in ("h264", "h265", "prores")],
    *[_one(f"quality_requirements = '{q}'") for q in ("fast", "balanced", "high_quality")]]) + "]"
QUERIES["c14_feature_vector"] = lambda spark, d: vecs(spark, d).select("scenario_id", F.array_join(F.transform("vec", lambda x: F.round(x * 1000).cast("bigint").cast("string")), ",").alias("vec"))
ORACLE["c14_feature_vector"] = f"select scenario_id, array_to_string(list_transform({VEC_SQL}, lambda x: round(x * 1000)::bigint), ',') as vec from {SCEN}"


def neighbours(spark, d, k):
    """Targets are the newest scenario of each container; history is every other one with an outcome."""
    v = tb.checkpoint(vecs(spark, d).select("scenario_id", "container_format", "ts", "vec"))
    newest = v.groupBy("container_format").agg(F.max_by("scenario_id", F.struct("ts", "scenario_id")).alias("id"))
    t = v.join(newest.select("id"), F.col("scenario_id") == F.col("id"), "left_semi").select(F.col("scenario_id").alias("id"), "vec")
    h = v.join(newest.select("id"), F.col("scenario_id") == F.col("id"), "left_anti").select(F.col("scenario_id").alias("id"), "vec")
    n = st.similar_scenarios(t, h, k)
    o = outcomes(spark, d).select(F.col("scenario_id").alias("id"), "tool", "success", "tools_used")
    return n.join(o, "id")


NEIGH = f"""v as (select *, {VEC_SQL} as vec from {SCEN}), newest as (select arg_max(scenario_id, (ts, scenario_id)) as id from v group by container_format),
 pairs as (select t.scenario_id as target_id, h.scenario_id as id, round(list_cosine_similarity(t.vec, h.vec), 9) as similarity
  from v t, v h where t.scenario_id in (select id from newest) and h.scenario_id not in (select id from newest)),
 ranked as (select *, row_number() over (partition by target_id order by similarity desc, id) as rank from pairs),
 neigh as (select r.*, tool, success, tools_used from ranked r join {OUT} o on o.scenario_id = r.id where rank <= 20)"""
QUERIES["j8_similar_scenarios"] = lambda spark, d: neighbours(spark, d, 10).select("target_id", "rank", "id", F.round("similarity", 6).alias("similarity"))
ORACLE["j8_similar_scenarios"] = f"with {NEIGH} select target_id, rank, id, round(similarity, 6) as similarity from neigh where rank <= 10"
QUERIES["m7_similarity_vote"] = lambda spark, d: st.similarity_vote(neighbours(spark, d, 5)).withColumn("confidence", F.round("confidence", 6))
ORACLE["m7_similarity_vote"] = f"""with {NEIGH}, g as (select target_id, tool, count(*) as n, min(rank) as f, sum(similarity*0.8) as c from neigh where rank <= 5 and success and similarity > 0.6 group by 1, 2)
select target_id, arg_max(tool, n * 100 - f) as tool, round(sum(c)/sum(n), 6) as confidence from g group by 1"""


def m10s(spark, d):
    n = neighbours(spark, d, 20)
    chosen = n.select("target_id").distinct().withColumn("tool", F.explode(F.array(*map(F.lit, ("ffmpeg", "untrunc", "mp4recover", "photorec")))))
    return st.success_probability(chosen, n, st.tool_performance(outcomes(spark, d))).withColumn("success_probability", F.round("success_probability", 6))


QUERIES["m10_success_probability"] = m10s
ORACLE["m10_success_probability"] = f"""with {NEIGH}, c as (select distinct target_id, t as tool from neigh cross join (select unnest(['ffmpeg', 'untrunc', 'mp4recover', 'photorec']) as t)),
 near as (select target_id, tool, avg(success::int) as r from (select target_id, success, unnest(tools_used) as tool from neigh where similarity > 0.7) group by 1, 2)
select c.target_id, c.tool, round(case when t.rate is null then 0.5 else coalesce(near.r, t.rate) end, 6) as success_probability
from c left join near on near.target_id = c.target_id and near.tool = c.tool left join {TOOLS} t on t.tool = c.tool"""

QUERIES["m6_rules_match"] = lambda spark, d: st.rules_match(scen(spark, d)).select("scenario_id", "ord", "rule", "tool", "confidence")
RULES = f"""(select s.scenario_id, r.* from {SCEN} s, lateral (select unnest(list_filter([
 case when container_format = 'mp4' and file_size_mb <= 100 and header_corruption and corruption_severity <= 0.3 then {{'ord': 0, 'rule': 'small_mp4_header_corruption', 'tool': 'untrunc', 'confidence': 0.9::double}} end,
 case when file_size_mb >= 1000 and max_processing_time <= 1800 then {{'ord': 1, 'rule': 'large_file_time_constraint', 'tool': 'ffmpeg', 'confidence': 0.8::double}} end,
 case when (contains(lower(video_codec), 'prores') or contains(lower(video_codec), 'raw')) and quality_requirements = 'high_quality' then {{'ord': 2, 'rule': 'professional_format_preservation', 'tool': 'untrunc', 'confidence': 0.85::double}} end,
 case when corruption_severity >= 0.7 then {{'ord': 3, 'rule': 'severe_corruption_multiple_tools', 'tool': 'mp4recover', 'confidence': 0.6::double}} end,
 case when fragment_corruption and list_contains(corruption_patterns, 'fragmented') then {{'ord': 4, 'rule': 'fragmented_corruption', 'tool': 'mp4recover', 'confidence': 0.8::double}} end,
 case when reference_file_available and container_format in ('mp4', 'mov') then {{'ord': 5, 'rule': 'reference_file_available', 'tool': 'untrunc', 'confidence': 0.95::double}} end],
 lambda x: x is not null), recursive := true)) r)"""
ORACLE["m6_rules_match"] = f"select scenario_id, ord, rule, tool, confidence from {RULES}"

_reason = "case rule " + " ".join(f"when '{n}' then '{r}'" for n, r in [
    ("small_mp4_header_corruption", "Small MP4 with header corruption responds well to untrunc"), ("large_file_time_constraint", "Large files with time constraints need fast processing"),
    ("professional_format_preservation", "Professional formats need quality-preserving tools"), ("severe_corruption_multiple_tools", "Severe corruption requires multiple recovery approaches"),
    ("fragmented_corruption", "Fragmented corruption needs specialized recovery"), ("reference_file_available", "Reference file greatly improves untrunc success")]) + " end"
ENSEMBLE = f"""ranked as (select *, row_number() over (partition by scenario_id order by confidence desc, ord) as rk, {_reason} as reason from {RULES}),
 tools as (select scenario_id, tool, count(*) as votes, max(confidence) as best, min(rk) as f from ranked group by 1, 2),
 win as (select scenario_id, arg_max(tool, votes*best*1000000 - f) as primary_tool, max(votes*best) as sc, sum(votes) as n from tools group by 1),
 ens as (select w.*, least(sc / n, 1.0) as confidence,
  coalesce((select array_to_string((list(t.tool order by f))[1:3], ',') from tools t where t.scenario_id = w.scenario_id and t.tool <> w.primary_tool), '') as fallback_tools,
  (select array_to_string(list(reason order by rk), '|') from ranked r where r.scenario_id = w.scenario_id and rk <= 3) as reasons from win w)"""
QUERIES["m8_ensemble_vote"] = lambda spark, d: st.ensemble_vote(st.rules_match(scen(spark, d))).select(
    "scenario_id", "primary_tool", F.round("confidence", 6).alias("confidence"), F.array_join("fallback_tools", ",").alias("fallback_tools"), F.array_join("reasons", "|").alias("reasons"))
ORACLE["m8_ensemble_vote"] = f"with {ENSEMBLE} select scenario_id, primary_tool, round(confidence, 6) as confidence, fallback_tools, reasons from ens"

QUERIES["m9_default_strategy"] = lambda spark, d: scen(spark, d).select("scenario_id", st.default_tool(F.col("corruption_severity"), F.col("container_format")).alias("tool"), F.lit(0.5).alias("confidence"))
DEFAULT = "case when corruption_severity < 0.3 then 'ffmpeg' when container_format in ('mp4', 'mov') then 'untrunc' else 'ffmpeg' end"
ORACLE["m9_default_strategy"] = f"select scenario_id, {DEFAULT} as tool, 0.5::double as confidence from {SCEN}"

QUERIES["m10_strategy_estimates"] = lambda spark, d: st.recommend(scen(spark, d)).select(
    "scenario_id", "primary_tool", F.round("confidence", 6).alias("confidence"), "estimated_time", F.round("estimated_quality", 6).alias("estimated_quality"))
ORACLE["m10_strategy_estimates"] = f"""with {ENSEMBLE}, x as (select s.*, coalesce(primary_tool, {DEFAULT}) as pt, coalesce(confidence, 0.5) as cf from {SCEN} s left join ens on ens.scenario_id = s.scenario_id)
select scenario_id, pt as primary_tool, round(cf, 6) as confidence, least(floor(floor(file_size_mb*2*case pt when 'ffmpeg' then 1.0::double when 'untrunc' then 1.5::double when 'mp4recover' then 2.0::double end) * (1.0::double + corruption_severity*2.0::double)), max_processing_time)::bigint as estimated_time,
 round(least(0.8::double - corruption_severity*0.3::double + case pt when 'untrunc' then 0.1::double when 'mp4recover' then 0.05::double else 0.0::double end, 1.0), 6) as estimated_quality from x"""


def rated(spark, d):
    li = tb.load(spark, d, "lineitem")
    score = F.col("l_quantity") / 50
    avail = F.slice(F.array(F.lit("untrunc"), F.lit("ffmpeg"), F.lit("mp4recover")), 1, (F.col("l_linenumber") % 4).cast("int"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"), avail.alias("available"),
                     (F.col("l_tax") * 12).alias("container"), (F.col("l_discount") * 10).alias("stream"))


RATED = """(select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 as score, ['untrunc', 'ffmpeg', 'mp4recover'][1:l_linenumber % 4] as available,
 l_tax*12 as container, l_discount*10 as stream from lineitem)"""
ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
IDS = ID.split(", ")
FIVE = "case when score >= 0.95 then 'minimal' when score >= 0.85 then 'mild' when score >= 0.6 then 'moderate' when score >= 0.3 then 'severe' else 'critical' end"


def m11(spark, d):
    r = rated(spark, d).withColumn("severity", sc.severity_five(F.col("score")))
    return r.select(*IDS, "severity", F.array_join(st.recommend_tools(F.col("severity"), F.col("available")), ",").alias("tools"),
                    F.round(st.recovery_chance(F.col("severity"), F.col("container"), F.col("stream"), F.col("available")), 6).alias("chance"))


QUERIES["m11_recommend_tools"] = m11
ORACLE["m11_recommend_tools"] = f"""select {ID}, severity, array_to_string(list_filter(case severity when 'minimal' then ['ffmpeg','untrunc'] when 'mild' then ['untrunc','ffmpeg']
  when 'moderate' then ['untrunc','mp4recover','ffmpeg'] else ['mp4recover','untrunc','ffmpeg'] end, lambda t: list_contains(available, t)), ',') as tools,
 round(least(case severity when 'minimal' then 0.95 when 'mild' then 0.85 when 'moderate' then 0.65 when 'severe' then 0.35 else 0.15 end + case when container > 0.8 then 0.1 else 0 end
  + case when stream > 0.7 then 0.1 else 0 end + case when len(available) >= 3 then 0.05 when len(available) >= 2 then 0.03 else 0 end, 0.98), 6)::double as chance
 from (select *, {FIVE} as severity from {RATED})"""

QUERIES["c6_confidence_level"] = lambda spark, d: rated(spark, d).select(*IDS, sc.confidence_level(F.col("score")).alias("level"))
LEVEL = "case when score >= 0.95 then 'CERTAIN' when score >= 0.8 then 'VERY_HIGH' when score >= 0.6 then 'HIGH' when score >= 0.4 then 'MEDIUM' when score >= 0.2 then 'LOW' else 'VERY_LOW' end"
ORACLE["c6_confidence_level"] = f"select {ID}, {LEVEL} as level from {RATED}"
QUERIES["c7_severity"] = lambda spark, d: rated(spark, d).select(*IDS, sc.severity_overall(F.col("score")).alias("overall"), sc.severity_five(F.col("score")).alias("five"))
OVERALL = "case when score >= 0.8 then 'minimal' when score >= 0.6 then 'mild' when score >= 0.3 then 'moderate' else 'severe' end"
ORACLE["c7_severity"] = f"select {ID}, {OVERALL} as overall, {FIVE} as five from {RATED}"

QUERIES["c5_format_size"] = lambda spark, d: tb.load(spark, d, "lineitem").select(*IDS, sc.format_size(F.pow(F.col("l_quantity"), F.col("l_linenumber") * 1.4)).alias("size"))
_v = "pow(l_quantity, l_linenumber * 1.4)"
ORACLE["c5_format_size"] = f"select {ID}, case " + " ".join(
    f"when {_v} < 1024.0::double ** {i + 1} then printf('%.1f {u}', {_v} / 1024.0::double ** {i})" for i, u in enumerate(("B", "KB", "MB", "GB", "TB"))
) + f" else printf('%.1f PB', {_v} / 1024.0::double ** 5) end as size from lineitem"

ISSUES = ["HEADER_DAMAGE", "CONTAINER_STRUCTURE", "BITSTREAM_ERRORS", "MISSING_FRAMES", "INDEX_CORRUPTION", "SYNC_LOSS"]


def issue_rows(spark, d):
    names = F.array(*map(F.lit, ISSUES))
    picked = F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: F.element_at(names, ((F.col("l_partkey") * i + F.col("l_suppkey")) % 6 + 1).cast("int")))
    return tb.load(spark, d, "lineitem").select(*IDS, picked.alias("issues"))


ISSUE_SQL = f"(select {ID}, list_transform(range(1, l_linenumber + 1), lambda i: list_extract({ISSUES}, ((l_partkey*i + l_suppkey) % 6 + 1)::bigint)) as issues from lineitem)"
SCORE = f"list_sum(list_transform(issues, lambda x: case x when 'HEADER_DAMAGE' then 20.0 when 'CONTAINER_STRUCTURE' then 30.0 when 'BITSTREAM_ERRORS' then 25.0 when 'MISSING_FRAMES' then 15.0 when 'INDEX_CORRUPTION' then 10.0 else 5.0 end))::double"
QUERIES["c10_corruption_score"] = lambda spark, d: issue_rows(spark, d).select(*IDS, sc.corruption_score(F.col("issues")).alias("score"))
ORACLE["c10_corruption_score"] = f"select {ID}, {SCORE} as score from {ISSUE_SQL}"
QUERIES["c11_repairable"] = lambda spark, d: issue_rows(spark, d).select(*IDS, sc.repairable(F.col("issues"), sc.corruption_score(F.col("issues"))).alias("repairable"))
ORACLE["c11_repairable"] = f"select {ID}, not ({SCORE} > 80 or (list_contains(issues, 'HEADER_DAMAGE') and list_contains(issues, 'CONTAINER_STRUCTURE'))) as repairable from {ISSUE_SQL}"

FORMATS = ["mp4_h264", "mp4_h265", "mov_h264", "prores_422", "prores_4444", "red_r3d", "avi", "blackmagic_raw"]


def videos(spark, d):
    fmt = F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("l_partkey") % 8 + 1).cast("int"))
    return tb.load(spark, d, "lineitem").select(
        *IDS, fmt.alias("fmt"), (F.col("l_extendedprice") * 10000).alias("size"), (F.col("l_quantity") - 1).alias("duration"), (F.col("l_discount") * 8).alias("corruption"),
        (F.col("l_linenumber") * 3 - 3).alias("bad_frames"), F.when(F.col("l_suppkey") % 2 == 0, 1920).otherwise(1280).alias("width"), F.when(F.col("l_suppkey") % 3 == 0, 720).otherwise(1080).alias("height"))


VIDEOS = f"""(select {ID}, list_extract({FORMATS}, (l_partkey % 8 + 1)::bigint) as fmt, l_extendedprice*10000 as size, l_quantity - 1 as duration, l_discount*8 as corruption, l_linenumber*3 - 3 as bad_frames,
 case when l_suppkey % 2 = 0 then 1920 else 1280 end as width, case when l_suppkey % 3 = 0 then 720 else 1080 end as height from lineitem)"""
MBPS = "(size*8/(duration*1000000.0::double))"
PSNR = f"case when duration > 0 then case when {MBPS} > 50 then 45.0 when {MBPS} > 20 then 35.0 when {MBPS} > 5 then 25.0 else 15.0 end::double * (1.0::double - corruption) end"
SSIM = "case when duration > 0 then case when fmt in ('prores_422','prores_4444') then 0.95 when contains(fmt,'h265') then 0.85 when contains(fmt,'h264') then 0.8 else 0.75 end::double * (1.0::double - corruption) end"


def m13(spark, d):
    q = st.video_quality(F.col("size"), F.col("duration"), F.col("fmt"), F.col("corruption"))
    return videos(spark, d).select(*IDS, F.round(q["psnr"], 6).alias("psnr"), F.round(q["ssim"], 6).alias("ssim"))


QUERIES["m13_video_quality"] = m13
ORACLE["m13_video_quality"] = f"select {ID}, round({PSNR}, 6) as psnr, round({SSIM}, 6) as ssim from {VIDEOS}"


def m12(spark, d):
    v = videos(spark, d)
    q = st.video_quality(F.col("size"), F.col("duration"), F.col("fmt"), F.col("corruption"))
    t = st.recommend_techniques(F.col("corruption"), F.col("fmt"), F.col("bad_frames"), q["psnr"], F.col("width"), F.col("height"))
    v = v.withColumn("t", t)
    return v.select(*IDS, F.array_join("t", ",").alias("techniques"), F.array_contains("t", "HEADER_RECONSTRUCTION").alias("needs_reference"),
                    F.round(st.repair_time(F.col("duration"), F.col("width"), F.col("height"), F.col("corruption"), F.col("t")), 4).alias("seconds"))


QUERIES["m12_recommend_techniques"] = m12
_mult = "case x " + " ".join(f"when '{k}' then {v}" for k, v in fv.TECHNIQUE_MULTIPLIERS.items()) + " else 1.0 end"
ORACLE["m12_recommend_techniques"] = f"""select {ID}, array_to_string(t, ',') as techniques, list_contains(t, 'HEADER_RECONSTRUCTION') as needs_reference,
 round(duration*0.1::double*(width*height/(1920.0::double*1080.0))*(1.0::double + corruption*2.0)*greatest(coalesce(list_sum(list_transform(t, lambda x: ({_mult})::double)), 0), 1.0), 4) as seconds
 from (select *, case when corruption > 0 then list_filter([case when corruption > 0.2 then 'HEADER_RECONSTRUCTION' end, case when fmt in ('mp4_h264','mp4_h265','mov_h264','mov_h265') then 'INDEX_REBUILD' end,
 case when corruption > 0.5 then 'FRAGMENT_RECOVERY' end, case when bad_frames > 10 then 'CONTAINER_REMUX' end, case when psnr < 30 then 'AI_INPAINTING' end, case when psnr < 30 then 'DENOISING' end,
 case when width < 1920 or height < 1080 then 'SUPER_RESOLUTION' end, case when bad_frames > 0 then 'FRAME_INTERPOLATION' end,
 case when starts_with(fmt,'prores') or starts_with(fmt,'blackmagic') or starts_with(fmt,'red') or starts_with(fmt,'arri') then 'METADATA_RECOVERY' end], lambda x: x is not null) else [] end as t
 from (select *, {PSNR} as psnr from {VIDEOS}))"""


def tracks(spark, d):
    """Order lines as the tracks of an order's video."""
    n = F.col("l_linenumber")
    return tb.load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), (n * 100000 + F.col("l_partkey")).alias("track_no"),
        F.when(n == 1, "General").when(n == 2, "Video").when(n == 3, "Audio").otherwise("Text").alias("kind"),
        F.when(F.col("l_returnflag") == "R", "").otherwise("mp4").alias("format"), (F.col("l_quantity") - 5).alias("duration"),
        (F.col("l_extendedprice") - 20000).alias("file_size"), F.when(F.col("l_suppkey") % 4 == 0, "").otherwise("avc").alias("codec"), (F.col("l_partkey") % 3 * 640).alias("width"))


TRACKS = """(select l_orderkey as file_id, l_linenumber*100000 + l_partkey as track_no, case l_linenumber when 1 then 'General' when 2 then 'Video' when 3 then 'Audio' else 'Text' end as kind,
 case when l_returnflag = 'R' then '' else 'mp4' end as format, l_quantity - 5 as duration, l_extendedprice - 20000 as file_size, case when l_suppkey % 4 = 0 then '' else 'avc' end as codec, l_partkey % 3 * 640 as width from lineitem)"""
QUERIES["m22_container_score"] = lambda spark, d: st.container_score(tracks(spark, d)).withColumn("container_score", F.round("container_score", 6))
ORACLE["m22_container_score"] = f"""select file_id, round(least(sum(case when kind = 'General' then case when format <> '' then 0.3 else 0 end + case when duration > 0 then 0.3 else 0 end + case when file_size > 0 then 0.2 else 0 end
 when kind = 'Video' then case when codec <> '' then 0.1 else 0 end + case when width > 0 then 0.1 else 0 end else 0 end::double), 1.0), 6) as container_score from {TRACKS} group by 1"""


def m22q(spark, d):
    t = tracks(spark, d)  # an order without lines stands for a file that cannot be read
    sizes = tb.load(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_totalprice").alias("original_size"),
                                               (F.col("o_totalprice") * (F.col("o_custkey") % 11) / 10).alias("repaired_size"))
    return st.repair_quality(t, sizes).withColumn("quality", F.round("quality", 6))


QUERIES["m22_repair_quality"] = m22q
ORACLE["m22_repair_quality"] = f"""with g as (select file_id, bool_or(kind = 'Video') as v, bool_or(kind = 'Audio') as a, arg_min(width, track_no) filter (kind = 'Video') as w, arg_min(duration, track_no) filter (kind = 'Video') as du
  from {TRACKS} group by 1)
select o_orderkey as file_id, round(case when o_custkey % 11 = 0 then 0.0 when v is null then case when r >= 0.9 then 0.8 when r >= 0.7 then 0.6 when r >= 0.5 then 0.4 else 0.2 end
 else least(0.3 + case when v then 0.3 else 0 end + case when v and w > 0 then 0.1 else 0 end + case when v and du > 0 then 0.1 else 0 end + case when a then 0.2 else 0 end, 1.0) end::double, 6) as quality
from (select *, (o_totalprice * (o_custkey % 11) / 10) / o_totalprice as r from orders) o left join g on g.file_id = o_orderkey"""


def w15(spark, d):
    a = tb.load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"), F.concat(F.lit("tool"), (F.col("l_suppkey") % 3).cast("string")).alias("tool"),
        (F.col("l_returnflag") != "R").alias("success"), (F.col("l_quantity") / 50).alias("quality"))
    return st.best_attempt(a, 0.9)


QUERIES["w15_best_attempt"] = w15
ORACLE["w15_best_attempt"] = """with a as (select l_orderkey as file_id, l_linenumber*100000 + l_partkey as ord, 'tool' || (l_suppkey % 3) as tool, l_returnflag <> 'R' as success, l_quantity/50 as quality from lineitem),
 b as (select *, row_number() over (partition by file_id order by case when quality >= 0.9 then 0 else 1 end, case when quality >= 0.9 then ord end, quality desc, ord) as rn from a where success)
select file_id, ord, tool, quality from b where rn = 1"""


# --- file scoring ---------------------------------------------------------------
def scored(spark, d):
    """Typed files with a class confidence; ciphertext-like heads count as encrypted."""
    data = F.col("data")
    i = F.col("file_id")
    t = tb.typed_files(spark, d).select(
        "file_id", F.octet_length(data).alias("size"), by.entropy_udf(F.substring(data, 1, 512)).alias("header_entropy"),
        F.when(ft.magic_type(data) == "executable", "executable").when(ft.detect_type(data).isin("ZIP", "DOCX", "XLSX"), "archive").otherwise("document").alias("category"),
        (i % 20 / 20).alias("confidence"), (i % 6 == 0).alias("encrypted"), (i % 7 == 0).alias("hidden"))
    t = t.withColumn("risk", sc.file_risk(F.col("confidence"), F.col("category"), F.col("size"), F.col("header_entropy"), F.col("encrypted"), F.col("hidden")))
    return t.withColumn("level", sc.confidence_level(F.col("confidence")))


from tracefield.catalog.bytestats import HEAD_ENT, TYPE_SQL, starts  # noqa: E402

SCORED = f"""(select *, least(1.0, (1.0 - score)*0.3 + case category when 'executable' then 0.4 when 'archive' then 0.2 else 0 end + case when size = 0 then 0.3 when size > 1073741824 then 0.1 else 0 end
  + case when he > 7.5 then 0.2 else 0 end + case when encrypted then 0.3 else 0 end + case when hidden then 0.4 else 0 end)::double as risk, {LEVEL} as level from
 (select t.file_id, length(hx)//2 as size, coalesce(he, 0) as he, case when {starts('FFD8')} then 'document' when {starts('89504E470D0A1A0A')} then 'document' when {starts('25504446')} then 'document' when {starts('4D5A')} then 'executable'
   when {TYPE_SQL} in ('ZIP','DOCX','XLSX') then 'archive' else 'document' end as category, (t.file_id % 20) / 20 as score, t.file_id % 6 = 0 as encrypted, t.file_id % 7 = 0 as hidden
  from {tb.TYPED} t left join {HEAD_ENT} h on h.file_id = t.file_id))"""
QUERIES["m1_file_risk"] = lambda spark, d: scored(spark, d).select("file_id", "category", F.round("risk", 6).alias("risk"))
ORACLE["m1_file_risk"] = f"select file_id, category, round(risk, 6) as risk from {SCORED}"
QUERIES["m2_suspicious"] = lambda spark, d: scored(spark, d).select("file_id", "level", sc.suspicious(F.col("risk"), F.col("level")).alias("suspicious"),
                                                                 sc.manual_review(F.col("risk"), F.col("level"), F.col("hidden")).alias("review"))
_sus = "(round(risk, 9) > 0.7 or (level in ('LOW', 'VERY_LOW') and round(risk, 9) > 0.3))"
ORACLE["m2_suspicious"] = f"select file_id, level, {_sus.replace('round(risk, 9)', 'risk')} as suspicious, {_sus.replace('round(risk, 9)', 'risk')} or level in ('LOW', 'VERY_LOW') or hidden as review from {SCORED}"
CATS = ["SAFE", "VIOLENCE", "FRAUD", "TERRORISM", "MALWARE", "WEAPONS"]


def m3(spark, d):
    o = tb.load(spark, d, "orders")
    cat = F.element_at(F.array(*map(F.lit, CATS)), (F.col("o_custkey") % 6 + 1).cast("int"))
    tags = F.slice(F.array(*[F.lit(f"t{i}") for i in range(5)]), 1, (F.col("o_orderkey") % 5).cast("int"))
    imp = sc.forensic_importance(F.col("o_totalprice") % 100 / 100, cat, F.col("o_orderkey") % 13 == 0, tags)
    return o.select("o_orderkey", F.round(imp, 6).alias("importance"), sc.priority_of(F.round(imp, 6)).alias("priority"))


QUERIES["m3_forensic_importance"] = m3
ORACLE["m3_forensic_importance"] = f"""select *, case when importance >= 0.8 then 'URGENT' when importance >= 0.6 then 'HIGH' when importance >= 0.3 then 'NORMAL' else 'LOW' end as priority from
 (select o_orderkey, round(least(1.0, (o_totalprice % 100 / 100)*0.3 + case list_extract({CATS}, (o_custkey % 6 + 1)::bigint) when 'TERRORISM' then 0.8 when 'VIOLENCE' then 0.6 when 'WEAPONS' then 0.6 when 'FRAUD' then 0.4 when 'MALWARE' then 0.4 else 0 end
  + case when o_orderkey % 13 = 0 then 0.7 else 0 end + (o_orderkey % 5)*0.1), 6) as importance from orders)"""


def c21(spark, d):
    """Each vector against its own squares, even positions masked by label."""
    v = tb.vectors(spark, d)
    b = F.transform("embedding", lambda x: x * x)
    mask = F.transform("embedding", lambda x, i: F.when((i + F.col("label")) % 3 == 0, 1).otherwise(0))
    a = F.transform("embedding", lambda x: x.cast("double"))
    return v.select("vec_id", F.round(sc.masked_ncc(a, F.transform(a, lambda x: x * x), mask), 6).alias("ncc"))


QUERIES["c21_masked_ncc"] = c21
ORACLE["c21_masked_ncc"] = """with p as (select vec_id, label, unnest(range(len(embedding))) as i, unnest(embedding)::double as x from embeddings),
 k as (select vec_id, x as a, x*x as b from p where (i + label) % 3 <> 0), m as (select vec_id, avg(a) as ma, avg(b) as mb from k group by 1)
select k.vec_id, round(sum((a-ma)*(b-mb)) / (sqrt(sum((a-ma)**2))*sqrt(sum((b-mb)**2)) + 1e-6), 6) as ncc from k join m on m.vec_id = k.vec_id group by 1"""


def m18(spark, d):
    """Outlying files: distance of the size from the median in units of the median deviation."""
    f = tb.ev_files(spark, d).select("file_id", "ext", F.col("size").cast("double").alias("x"))
    med = exact_median(f, ["ext"], F.col("x"), "med")
    g = f.join(med, "ext").withColumn("dev", F.abs(F.col("x") - F.col("med")))
    mad = exact_median(g, ["ext"], F.col("dev"), "mad")
    z = F.col("dev") * 0.6745 / F.col("mad")
    return g.join(mad, "ext").filter((F.col("mad") > 0) & (z > 3.5)).select("file_id", "ext", F.round(z, 6).alias("score"))


QUERIES["m18_anomalies"] = m18
ORACLE["m18_anomalies"] = f"""with m as (select ext, median(size) as med from {tb.EV_FILES} group by 1), g as (select file_id, f.ext, abs(size - med) as dev from {tb.EV_FILES} f join m on m.ext = f.ext),
 q as (select ext, median(dev) as mad from g group by 1) select file_id, g.ext, round(dev*0.6745/mad, 6) as score from g join q on q.ext = g.ext where mad > 0 and dev*0.6745/mad > 3.5"""
