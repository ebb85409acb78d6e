"""Transaction-graph analytics over edges(tx_id, from_addr, to_addr, value, fee, ts)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefield.operators import ordered as od
from tracefield.session import checkpoint


def watchlist_flag(addrs: DataFrame, lists: DataFrame, names: list[str]) -> DataFrame:
    """A boolean per list name; lists(addr, list_name)."""
    flags = lists.groupBy("addr").agg(*[F.bool_or(F.col("list_name") == n).alias(n) for n in names])
    out = addrs.join(flags, "addr", "left")
    return out.select(*addrs.columns, *[F.coalesce(n, F.lit(False)).alias(n) for n in names])


def attribute_entities(addrs: DataFrame, entities: DataFrame) -> DataFrame:
    return addrs.join(entities, "addr", "left")


def exchange_flows(edges: DataFrame, exchanges: DataFrame, user: str | None = None) -> DataFrame:
    """Deposits (user to exchange) and withdrawals (exchange to user), summed per pair."""
    if user is not None:
        edges = edges.filter((F.col("from_addr") == user) | (F.col("to_addr") == user))
    pairs = edges.groupBy("from_addr", "to_addr").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    x = exchanges.select("addr").distinct()

    def side(kind, ex, us):
        return pairs.join(x.withColumnRenamed("addr", ex), ex, "left_semi").select(
            F.lit(kind).alias("kind"), F.col(us).alias("user"), F.col(ex).alias("exchange"), "value", "n"
        )

    return side("deposit", "to_addr", "from_addr").unionByName(side("withdrawal", "from_addr", "to_addr"))


def flows_between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Direct flow and every two-hop flow from ``a`` to ``b``; edges are summed per pair first."""
    direct = edges.filter((F.col("from_addr") == a) & (F.col("to_addr") == b)).agg(F.sum("value").alias("v1"), F.count(F.lit(1)).alias("n"))
    first = edges.filter((F.col("from_addr") == a) & (F.col("to_addr") != b)).groupBy(F.col("to_addr").alias("via")).agg(F.sum("value").alias("v1"))
    second = edges.filter((F.col("to_addr") == b) & (F.col("from_addr") != a)).groupBy(F.col("from_addr").alias("via")).agg(F.sum("value").alias("v2"))
    two = first.join(second, "via").select(F.lit(2).alias("hops"), "via", "v1", "v2")
    one = direct.filter("n > 0").select(F.lit(1).alias("hops"), F.lit(None).cast("string").alias("via"), "v1", F.lit(None).cast("double").alias("v2"))
    return one.unionByName(two)


def _legs(edges: DataFrame) -> DataFrame:
    """Two rows per edge, one per end."""
    return edges.select(
        "tx_id", "value", "ts",
        F.inline(F.array(
            F.struct(F.col("to_addr").alias("addr"), F.lit(1).alias("sign"), F.col("from_addr").alias("other")),
            F.struct(F.col("from_addr").alias("addr"), F.lit(-1).alias("sign"), F.col("to_addr").alias("other")),
        )),
    )


def address_info(edges: DataFrame) -> DataFrame:
    """Balance (in - out), number of transactions, first and last seen."""
    legs = _legs(edges)
    sums = legs.groupBy("addr").agg(
        F.sum(F.col("value") * F.col("sign")).alias("balance"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    txs = legs.select("addr", "tx_id").distinct().groupBy("addr").agg(F.count(F.lit(1)).alias("tx_count"))
    return sums.join(txs, "addr")


def mixer_features(edges: DataFrame, patterns: list[tuple[str, int, float, float]]) -> DataFrame:
    """Volume and distinct counterparties per address, and the strongest pattern met.

    patterns: (name, least counterparties, least volume, confidence).
    """
    legs = _legs(edges)
    pairs = legs.groupBy("addr", "other").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    g = pairs.groupBy("addr").agg(F.sum("v").alias("volume"), F.count(F.lit(1)).alias("counterparties"), F.sum("n").alias("legs"))
    pattern = conf = None
    for name, cps, vol, c in sorted(patterns, key=lambda p: -p[3]):
        hit = (F.col("counterparties") >= cps) & (F.col("volume") >= vol)
        pattern = F.when(hit, name) if pattern is None else pattern.when(hit, name)
        conf = F.when(hit, c) if conf is None else conf.when(hit, c)
    return g.withColumn("pattern", pattern).withColumn("confidence", conf)


def cluster_summary(members: DataFrame, activity: DataFrame) -> DataFrame:
    """Clusters with more than one member; members(node, component), activity(addr, value, ts).

    confidence grows with size: 1 - 1 / members.
    """
    per = activity.groupBy("addr").agg(F.sum("value").alias("v"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return (
        members.join(per, members.node == per.addr, "left")
        .groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("members"), F.sum("v").alias("balance"), F.min("a").alias("first_seen"),
            F.max("b").alias("last_seen"),
        )
        .filter("members > 1")
        .withColumn("confidence", 1 - 1 / F.col("members"))
        .orderBy(F.desc("confidence"), "component")
    )


def campaign_summary(edges: DataFrame, listed: DataFrame) -> DataFrame:
    """Per listed receiver: total paid, victims (distinct senders), first and last payment."""
    paid = edges.join(listed.select(F.col("addr").alias("to_addr")).distinct(), "to_addr", "left_semi")
    return (
        paid.groupBy("to_addr", "from_addr")
        .agg(F.sum("value").alias("v"), F.min("ts").alias("a"), F.max("ts").alias("b"))
        .groupBy(F.col("to_addr").alias("campaign"))
        .agg(F.sum("v").alias("total_paid"), F.count(F.lit(1)).alias("victims"), F.min("a").alias("first_payment"), F.max("b").alias("last_payment"))
    )


def value_distribution(edges: DataFrame, low: float, high: float, buckets: int, large: float, micro: float) -> DataFrame:
    v = F.col("value")
    return edges.groupBy(F.width_bucket(v, F.lit(low), F.lit(high), F.lit(buckets)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("volume"),
        F.sum((v >= large).cast("bigint")).alias("large"), F.sum((v <= micro).cast("bigint")).alias("micro"),
    )


def history(edges: DataFrame, addr: str, limit: int) -> DataFrame:
    """Newest first; direction as seen from ``addr``."""
    mine = edges.filter((F.col("from_addr") == addr) | (F.col("to_addr") == addr))
    return (
        mine.withColumn("direction", F.when(F.col("to_addr") == addr, "Incoming").otherwise("Outgoing"))
        .orderBy(F.desc("ts"), "tx_id", "leg", "to_addr", "value").limit(limit)
    )


def central_addresses(edges: DataFrame, k: int) -> DataFrame:
    """Most distinct counterparties."""
    return (
        _legs(edges).select("addr", "other").distinct().groupBy("addr").agg(F.count(F.lit(1)).alias("degree"))
        .orderBy(F.desc("degree"), "addr").limit(k)
    )


def direction(inputs: Column, outputs: Column, addr: Column) -> Column:
    """Incoming if any output pays the address, else Outgoing; null without inputs."""
    paid = F.exists(outputs, lambda o: o == addr)
    return F.when(F.size(inputs) > 0, F.when(paid, "Incoming").otherwise("Outgoing"))


def counterparties(inputs: Column, outputs: Column, addr: Column) -> Column:
    return F.filter(F.concat(inputs, outputs), lambda x: x != addr)


RISK_WEIGHTS = {"blacklisted": 4.0, "mixer": 2.0, "darknet": 2.0, "suspicious_pattern": 1.0, "suspicious_timing": 1.0}


def address_risk(flags: DataFrame) -> DataFrame:
    """0-10 score as a weighted sum of flags, and its category."""
    score = F.lit(0.0)
    for name, w in RISK_WEIGHTS.items():
        score = score + F.when(F.col(name), w).otherwise(0.0)
    s = F.col("risk_score")
    return flags.withColumn("risk_score", score).withColumn(
        "risk_category", F.when(s >= 7, "CRITICAL").when(s >= 4, "HIGH").when(s >= 2, "MEDIUM").otherwise("LOW")
    )


def compliance_report(risk: DataFrame) -> DataFrame:
    """One row: violations (listed addresses), warnings (risk of 2 and more without a listing), status."""
    v = F.sum(F.col("blacklisted").cast("bigint"))
    w = F.sum((~F.col("blacklisted") & (F.col("risk_score") >= 2)).cast("bigint"))
    return risk.agg(F.count(F.lit(1)).alias("addresses"), v.alias("violations"), w.alias("warnings")).select(
        "*",
        F.when(F.col("violations") > 0, "NON_COMPLIANT").when(F.col("warnings") > 0, "REVIEW").otherwise("COMPLIANT").alias("status"),
        (F.col("violations") > 0).alias("needs_reporting"),
    )


def daily_activity(edges: DataFrame) -> DataFrame:
    return _legs(edges).groupBy("addr", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def dormant_periods(edges: DataFrame, days: int) -> DataFrame:
    """Gaps of at least ``days`` between active days of an address."""
    d = checkpoint(daily_activity(edges))
    lagged = od.lag_value(d, ["addr"], ["day"], F.trunc("day", "year"), F.col("day"), "previous_day")
    return (
        lagged.withColumn("gap_days", F.date_diff("day", "previous_day"))
        .filter(F.col("gap_days") >= days)
        .select("addr", "previous_day", "day", "gap_days")
    )


def activity_spikes(edges: DataFrame, k: float) -> DataFrame:
    """Days with more than mean + k sd transactions of that address (k >= 0).

    Over ``days`` days, n > mean + k sd is n days - sum > k sqrt(days squares - sum^2):
    squared, both sides are whole numbers, so a day exactly at the limit is
    none whatever the order of the sums.
    """
    d = checkpoint(daily_activity(edges))
    n = F.col("n").cast("decimal(38,0)")
    s = d.groupBy("addr").agg(F.count(F.lit(1)).alias("_days"), F.sum(n).alias("_sum"), F.sum((n * n).cast("decimal(38,0)")).alias("_squares"))
    p, q = Fraction(str(k)).as_integer_ratio()
    whole = lambda e: F.expr(f"cast({e} as decimal(38,0))")
    s = s.select("addr", "_days", "_sum", whole("_days * _squares - _sum * _sum").alias("_spread"))
    j = d.join(s, "addr").withColumn("_over", whole("n * _days - _sum"))
    return j.filter((F.col("_over") > 0) & F.expr(f"{q * q} * _over * _over > {p * p} * _spread")).select("addr", "day", "n")
