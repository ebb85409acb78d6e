"""Repair strategy: history statistics, rules, neighbours, votes, estimates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefield.functions import fixed_values as fv
from tracefield.functions.scalars import lookup
from tracefield.operators.quantiles import exact_median

#: targets that one pass over the history serves
TARGETS_PER_PASS = 1024


def latest(df: DataFrame, key: str, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per key, the last written; a max of structs, so it combines on the map side.

    Only ``columns`` are carried, if given: the optimizer drops none from within the struct.
    """
    rest = [c for c in (columns or df.columns) if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def scenarios_with_outcomes(scenarios: DataFrame, outcomes: DataFrame) -> DataFrame:
    return scenarios.join(outcomes, "scenario_id")


def feature_vector() -> Column:
    """23 numbers per scenario."""
    c, flag = F.col, lambda cond: F.when(cond, 1.0).otherwise(0.0)
    fmt, codec = F.lower("container_format"), F.lower("video_codec")
    return F.array(*[
        x.cast("float")
        for x in (
            c("file_size_mb"), c("duration_seconds"), c("bitrate_mbps"), c("width"), c("height"), c("corruption_severity"),
            flag(c("header_corruption")), flag(c("metadata_corruption")), flag(c("stream_corruption")), flag(c("fragment_corruption")),
            c("available_tools"), flag(c("reference_file_available")), c("max_processing_time") / 3600.0,
            *[flag(fmt == f) for f in ("mp4", "mov", "avi", "mkv")],
            *[flag(F.contains(codec, F.lit(x))) for x in ("h264", "h265", "prores")],
            *[flag(c("quality_requirements") == q) for q in ("fast", "balanced", "high_quality")],
        )
    ])


def similar_scenarios(targets: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """Top ``k`` of ``history(id, vec)`` per target(id, vec) by cosine.

    Targets are taken in blocks of a bounded size; a block travels to every
    task, and each task keeps its own best ``k`` per target, so no target x
    history rows are ever emitted. The tasks' lists are merged in two steps.
    Similarity is rounded to 9 places; ties go to the lower id.
    """
    blocks = max(1, -(-targets.count() // TARGETS_PER_PASS))
    local = None
    for block in range(blocks):
        part = targets if blocks == 1 else targets.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        rows = part.select("id", "vec").collect()
        if rows:
            found = _nearest(rows, history, k)
            local = found if local is None else local.unionByName(found)
    if local is None:
        local = history.select(F.col("id").alias("target_id"), "id", F.lit(0.0).alias("similarity")).filter("false")
    order = [F.desc("similarity"), F.asc("id")]
    some = Window.partitionBy("target_id", "_part").orderBy(*order)
    few = local.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    w = Window.partitionBy("target_id").orderBy(*order)
    return few.drop("_part").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest(rows: list, history: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each task for a block of targets."""
    ids = np.array([r.id for r in rows])
    t = np.array([r.vec for r in rows], np.float64)
    tn = np.linalg.norm(t, axis=1)

    def best(batches):
        top = [[] for _ in ids]
        for pdf in batches:
            if not len(pdf):
                continue
            h = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            norms = np.outer(tn, np.linalg.norm(h, axis=1))
            sim = np.divide(t @ h.T, norms, out=np.zeros_like(norms), where=norms > 0).round(9)
            hid = pdf["id"].to_numpy()
            for i in range(len(ids)):
                order = np.lexsort((hid, -sim[i]))[:k]
                top[i] = sorted(top[i] + [(-sim[i][j], hid[j]) for j in order])[:k]
        out = [(ids[i], h, -s) for i in range(len(ids)) for s, h in top[i]]
        yield pd.DataFrame(out, columns=["target_id", "id", "similarity"])

    return history.select("id", "vec").mapInPandas(best, "target_id long, id long, similarity double")


def tool_performance(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.select(F.explode("tools_used").alias("tool"), F.col("success").cast("bigint").alias("s"))
        .groupBy("tool")
        .agg(F.count(F.lit(1)).alias("total"), F.sum("s").alias("successful"), (F.sum("s") / F.count(F.lit(1))).alias("success_rate"))
    )


def outcome_stats(outcomes: DataFrame) -> DataFrame:
    q = F.when(F.col("quality") > 0, F.col("quality"))
    med = exact_median(outcomes, [], q).scalar()
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_repairs"),
        F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(q), F.lit(0.0)).alias("average_quality"),
    ).withColumn("median_quality", F.coalesce(med, F.lit(0.0)))


THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9]


def threshold_sweep(outcomes: DataFrame, default: float = 0.7) -> DataFrame:
    """Best of five thresholds in one pass; the lowest wins ties; none under 20 outcomes."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(THRESHOLDS):
        hit = F.col("confidence") >= t
        aggs += [F.sum(hit.cast("bigint")).alias(f"n{i}"), F.sum((hit & F.col("success")).cast("bigint")).alias(f"s{i}")]
    cands = F.array(*[
        F.when((F.col("n") >= 20) & (F.col(f"n{i}") >= 10),
               F.struct((F.col(f"s{i}") / F.col(f"n{i}")).alias("acc"), F.lit(-t).alias("neg")))
        for i, t in enumerate(THRESHOLDS)
    ])
    best = F.array_max(F.filter(cands, lambda x: x.isNotNull() & (x["acc"] > 0)))
    return outcomes.agg(*aggs).select(
        F.coalesce(-best["neg"], F.lit(default)).alias("threshold"), F.coalesce(best["acc"], F.lit(0.0)).alias("accuracy")
    )


def expert_rules() -> list[dict]:
    """Name, condition, tool, fallbacks, techniques, confidence, reason."""
    c = F.col

    def holds(column, cond):  # an unknown value does not veto a rule
        return c(column).isNull() | cond

    fmt, codec = F.lower("container_format"), F.lower("video_codec")
    return [
        dict(name="small_mp4_header_corruption", tool="untrunc", fallback=["ffmpeg"], techniques=[], confidence=0.9,
             reason="Small MP4 with header corruption responds well to untrunc",
             when=holds("container_format", fmt == "mp4") & holds("file_size_mb", c("file_size_mb") <= 100)
             & holds("header_corruption", c("header_corruption")) & holds("corruption_severity", c("corruption_severity") <= 0.3)),
        dict(name="large_file_time_constraint", tool="ffmpeg", fallback=[], techniques=["container_remux"], confidence=0.8,
             reason="Large files with time constraints need fast processing",
             when=holds("file_size_mb", c("file_size_mb") >= 1000) & holds("max_processing_time", c("max_processing_time") <= 1800)),
        dict(name="professional_format_preservation", tool="untrunc", fallback=["mp4recover"], techniques=[], confidence=0.85,
             reason="Professional formats need quality-preserving tools",
             when=holds("video_codec", F.contains(codec, F.lit("prores")) | F.contains(codec, F.lit("raw")))
             & holds("quality_requirements", F.lower("quality_requirements") == "high_quality")),
        dict(name="severe_corruption_multiple_tools", tool="mp4recover", fallback=["untrunc", "ffmpeg"],
             techniques=["fragment_recovery", "deep_scan"], confidence=0.6,
             reason="Severe corruption requires multiple recovery approaches",
             when=holds("corruption_severity", c("corruption_severity") >= 0.7)),
        dict(name="fragmented_corruption", tool="mp4recover", fallback=["ffmpeg"], techniques=["fragment_recovery"], confidence=0.8,
             reason="Fragmented corruption needs specialized recovery",
             when=holds("fragment_corruption", c("fragment_corruption"))
             & holds("corruption_patterns", F.array_contains("corruption_patterns", "fragmented"))),
        dict(name="reference_file_available", tool="untrunc", fallback=[], techniques=[], confidence=0.95,
             reason="Reference file greatly improves untrunc success",
             when=holds("reference_file_available", c("reference_file_available")) & holds("container_format", fmt.isin("mp4", "mov"))),
    ]


def rules_match(scenarios: DataFrame) -> DataFrame:
    """One row per (scenario, rule met), rule order kept in ``ord``."""
    met = [
        F.when(r["when"], F.struct(
            F.lit(i).alias("ord"), F.lit(r["name"]).alias("rule"), F.lit(r["tool"]).alias("tool"),
            F.lit(r["confidence"]).alias("confidence"), F.lit(r["reason"]).alias("reason")))
        for i, r in enumerate(expert_rules())
    ]
    return scenarios.select("scenario_id", F.inline(F.filter(F.array(*met), lambda x: x.isNotNull())))


def similarity_vote(neighbours: DataFrame) -> DataFrame:
    """neighbours(target_id, rank, similarity, success, tool): vote of the good ones among the first 5."""
    good = neighbours.filter((F.col("rank") <= 5) & F.col("success") & (F.col("similarity") > 0.6))
    per = good.groupBy("target_id", "tool").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.sum(F.col("similarity") * 0.8).alias("c")
    )
    return per.groupBy("target_id").agg(
        F.max_by("tool", F.struct("n", -F.col("first"))).alias("tool"), (F.sum("c") / F.sum("n")).alias("confidence")
    )


def ensemble_vote(recs: DataFrame) -> DataFrame:
    """recs(scenario_id, ord, tool, confidence, reason): weighted vote per scenario."""
    w = Window.partitionBy("scenario_id").orderBy(F.desc("confidence"), "ord")
    ranked = recs.withColumn("rank", F.row_number().over(w))
    per_tool = ranked.groupBy("scenario_id", "tool").agg(
        F.count(F.lit(1)).alias("votes"), F.max("confidence").alias("best"), F.min("rank").alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "reason")))).alias("why"),
    )
    score = F.col("votes") * F.col("best")
    g = per_tool.groupBy("scenario_id").agg(
        F.max_by("tool", F.struct(score, -F.col("first"))).alias("primary_tool"),
        F.max(score).alias("_score"),
        F.sum("votes").alias("_n"),
        F.array_sort(F.collect_list(F.struct("first", "tool"))).alias("_tools"),
        F.array_sort(F.flatten(F.collect_list("why"))).alias("_why"),
    )
    others = F.filter(F.transform("_tools", lambda x: x["tool"]), lambda t: t != F.col("primary_tool"))
    return g.select(
        "scenario_id", "primary_tool",
        F.slice(others, 1, 3).alias("fallback_tools"),
        F.least(F.col("_score") / F.col("_n"), F.lit(1.0)).alias("confidence"),
        F.slice(F.transform("_why", lambda x: x["reason"]), 1, 5).alias("reasons"),
    )


def default_tool(severity: Column, container: Column) -> Column:
    return F.when(severity < 0.3, "ffmpeg").when(F.lower(container).isin("mp4", "mov"), "untrunc").otherwise("ffmpeg")


def strategy_estimates(df: DataFrame, tool: str = "primary_tool") -> DataFrame:
    """Time bound and quality estimate of the chosen tool."""
    mult = lookup(fv.TOOL_TIME_MULTIPLIERS, F.col(tool), 1.5)
    base = F.floor(F.col("file_size_mb") * 2 * mult)
    secs = F.floor(base * (F.lit(1.0) + F.col("corruption_severity") * 2.0))
    bonus = lookup(fv.TOOL_QUALITY_BONUS, F.col(tool), 0.0)
    return df.withColumn("estimated_time", F.least(secs, F.col("max_processing_time").cast("bigint"))).withColumn(
        "estimated_quality", F.least(F.lit(0.8) - F.col("corruption_severity") * 0.3 + bonus, F.lit(1.0))
    )


def success_probability(chosen: DataFrame, neighbours: DataFrame, tools: DataFrame) -> DataFrame:
    """Success rate of the tool among close neighbours (similarity over .7), else its overall rate, else .5.

    chosen(target_id, tool); neighbours(target_id, similarity, success, tools_used); tools(tool, success_rate).
    """
    near = (
        neighbours.filter("similarity > 0.7")
        .select("target_id", F.col("success").cast("double").alias("s"), F.explode("tools_used").alias("tool"))
        .groupBy("target_id", "tool").agg(F.avg("s").alias("near_rate"))
    )
    return (
        chosen.join(near, ["target_id", "tool"], "left").join(tools.select("tool", "success_rate"), "tool", "left")
        .select("target_id", "tool", F.when(F.col("success_rate").isNull(), 0.5).otherwise(F.coalesce("near_rate", "success_rate")).alias("success_probability"))
    )


TOOLS_BY_SEVERITY = {
    "minimal": ["ffmpeg", "untrunc"],
    "mild": ["untrunc", "ffmpeg"],
    "moderate": ["untrunc", "mp4recover", "ffmpeg"],
    "severe": ["mp4recover", "untrunc", "ffmpeg"],
    "critical": ["mp4recover", "untrunc", "ffmpeg"],
}
BASE_CHANCE = {"minimal": 0.95, "mild": 0.85, "moderate": 0.65, "severe": 0.35, "critical": 0.15}


def recommend_tools(severity: Column, available: Column) -> Column:
    ladder = lookup({k: F.array(*map(F.lit, v)) for k, v in TOOLS_BY_SEVERITY.items()}, severity,
                    F.expr("cast(array() as array<string>)"))
    return F.filter(ladder, lambda t: F.array_contains(available, t))


def recovery_chance(severity: Column, container: Column, stream: Column, available: Column) -> Column:
    n = F.size(available)
    chance = (
        lookup(BASE_CHANCE, severity, None)
        + F.when(container > 0.8, 0.1).otherwise(0.0)
        + F.when(stream > 0.7, 0.1).otherwise(0.0)
        + F.when(n >= 3, 0.05).when(n >= 2, 0.03).otherwise(0.0)
    )
    return F.least(chance, F.lit(0.98))


INDEXED = ("mp4_h264", "mp4_h265", "mov_h264", "mov_h265")


def recommend_techniques(corruption: Column, fmt: Column, bad_frames: Column, psnr: Column, width: Column, height: Column) -> Column:
    pro = F.lit(False)
    for p in ("prores", "blackmagic", "red", "arri"):
        pro = pro | F.startswith(fmt, F.lit(p))
    picks = F.array(
        F.when(corruption > 0.2, "HEADER_RECONSTRUCTION"),
        F.when(fmt.isin(*INDEXED), "INDEX_REBUILD"),
        F.when(corruption > 0.5, "FRAGMENT_RECOVERY"),
        F.when(bad_frames > 10, "CONTAINER_REMUX"),
        F.when(psnr < 30.0, "AI_INPAINTING"),
        F.when(psnr < 30.0, "DENOISING"),
        F.when((width < 1920) | (height < 1080), "SUPER_RESOLUTION"),
        F.when(bad_frames > 0, "FRAME_INTERPOLATION"),
        F.when(pro, "METADATA_RECOVERY"),
    )
    found = F.filter(picks, lambda x: x.isNotNull())
    return F.when(corruption > 0, found).otherwise(F.expr("cast(array() as array<string>)"))


def repair_time(duration: Column, width: Column, height: Column, corruption: Column, techniques: Column) -> Column:
    mult = F.aggregate(techniques, F.lit(0.0), lambda a, t: a + lookup(fv.TECHNIQUE_MULTIPLIERS, t, 1.0))
    return duration * 0.1 * (width * height / (1920.0 * 1080.0)) * (1.0 + corruption * 2.0) * F.greatest(mult, F.lit(1.0))


def video_quality(size: Column, duration: Column, fmt: Column, corruption: Column) -> Column:
    """Struct (psnr, ssim) guessed from bit rate and format; null without a duration."""
    mbps = size * 8 / (duration * 1000000.0)
    psnr = F.when(mbps > 50, 45.0).when(mbps > 20, 35.0).when(mbps > 5, 25.0).otherwise(15.0)
    ssim = (
        F.when(fmt.isin("prores_422", "prores_4444"), 0.95).when(F.contains(fmt, F.lit("h265")), 0.85)
        .when(F.contains(fmt, F.lit("h264")), 0.80).otherwise(0.75)
    )
    keep = 1.0 - corruption
    return F.when(duration > 0, F.struct((psnr * keep).alias("psnr"), (ssim * keep).alias("ssim")))


def container_score(tracks: DataFrame) -> DataFrame:
    """tracks(file_id, kind, format, duration, file_size, codec, width) to a 0-1 score per file."""
    c = F.col
    general, video = c("kind") == "General", c("kind") == "Video"
    pts = (
        F.when(general & (c("format") != ""), 0.3).otherwise(0.0) + F.when(general & (c("duration") > 0), 0.3).otherwise(0.0)
        + F.when(general & (c("file_size") > 0), 0.2).otherwise(0.0) + F.when(video & (c("codec") != ""), 0.1).otherwise(0.0)
        + F.when(video & (c("width") > 0), 0.1).otherwise(0.0)
    )
    return tracks.groupBy("file_id").agg(F.least(F.sum(pts), F.lit(1.0)).alias("container_score"))


def repair_quality(tracks: DataFrame, sizes: DataFrame) -> DataFrame:
    """From the tracks of the repaired file; unreadable ones (no track rows) by size ratio.

    sizes(file_id, original_size, repaired_size); the first video track is the one with the least ``track_no``.
    """
    v = F.col("kind") == "Video"
    g = tracks.groupBy("file_id").agg(
        F.bool_or(v).alias("_v"), F.bool_or(F.col("kind") == "Audio").alias("_a"),
        F.min_by(F.struct("width", "duration"), F.when(v, F.col("track_no"))).alias("_f"),
    )
    ratio = F.col("repaired_size") / F.col("original_size")
    by_size = F.when(ratio >= 0.9, 0.8).when(ratio >= 0.7, 0.6).when(ratio >= 0.5, 0.4).otherwise(0.2)
    pt = lambda cond, w: F.when(cond, w).otherwise(0.0)
    by_track = F.least(
        F.lit(0.3) + pt(F.col("_v"), 0.3) + pt(F.col("_v") & (F.col("_f.width") > 0), 0.1)
        + pt(F.col("_v") & (F.col("_f.duration") > 0), 0.1) + pt(F.col("_a"), 0.2), F.lit(1.0))
    return sizes.join(g, "file_id", "left").select(
        "file_id", F.when(F.col("repaired_size") == 0, 0.0).when(F.col("_v").isNull(), by_size).otherwise(by_track).alias("quality")
    )


def best_attempt(attempts: DataFrame, threshold: float) -> DataFrame:
    """attempts(file_id, ord, tool, success, quality): first adequate one in order,
    else the successful one of highest quality, the earlier on ties."""
    row = F.struct("ord", "tool", "quality")
    good = F.col("success") & (F.col("quality") >= threshold)
    g = attempts.groupBy("file_id").agg(
        F.min_by(row, F.when(good, F.col("ord"))).alias("_a"),
        F.max_by(row, F.when(F.col("success"), F.struct("quality", -F.col("ord")))).alias("_b"),
    )
    best = F.coalesce("_a", "_b")
    return g.withColumn("_x", best).filter("_x is not null").select(
        "file_id", F.col("_x.ord").alias("ord"), F.col("_x.tool").alias("tool"), F.col("_x.quality").alias("quality")
    )


def recommend(scenarios: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """Rules, an optional similarity vote, then the ensemble; the default where nothing applies."""
    recs = rules_match(scenarios).select("scenario_id", "ord", "tool", "confidence", "reason")
    if votes is not None:
        recs = recs.unionByName(votes.select(
            F.col("target_id").alias("scenario_id"), F.lit(100).alias("ord"), "tool", "confidence",
            F.lit("Based on similar scenarios").alias("reason")))
    chosen = scenarios.join(ensemble_vote(recs), "scenario_id", "left")
    tool = F.coalesce("primary_tool", default_tool(F.col("corruption_severity"), F.col("container_format")))
    return strategy_estimates(
        chosen.withColumn("primary_tool", tool)
        .withColumn("fallback_tools", F.coalesce("fallback_tools", F.array(F.lit("ffmpeg"), F.lit("mp4recover"))))
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
        .withColumn("reasons", F.coalesce("reasons", F.array(F.lit("Default heuristic recommendation"))))
    )
