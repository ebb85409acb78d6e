"""Iterative graph operators as joins over edge tables.

Each round is one or two equi-joins; its result is checkpointed to shared
storage, so a lost executor costs a round at most. Nothing is collected but
counters that decide whether to go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefield.session import checkpoint


def _grow(seen: DataFrame, new: DataFrame, round_no: int) -> DataFrame:
    """Add a level; every third round the levels are written as one table."""
    out = seen.unionByName(new)
    return checkpoint(out) if round_no % 3 == 2 else out


def star_edges(members: DataFrame, group: str, node: str) -> DataFrame:
    """Edges (u, v) from every member of a group to the group's least member: n, not n squared.

    A member listed twice gives its edge twice; ``connected_components`` takes them once.
    """
    low = members.groupBy(group).agg(F.min(node).alias("v"))
    return members.select(group, F.col(node).alias("u")).join(low, group).filter("u <> v").select("u", "v")


def _tangled(edges: DataFrame) -> DataFrame:
    """(v) of the distinct edges (u, v), v < u, that are no whole component: some member has another edge."""
    odd = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    parents = edges.select(F.col("v").alias("u"), F.lit(True).alias("up")).distinct()
    odd = odd.join(parents, "u", "left").filter("n > 1 or up").select("u")
    return checkpoint(edges.join(odd, "u", "left_semi").select("v").unionByName(odd.select(F.col("u").alias("v"))).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) by alternating large-star and small-star steps.

    ``component`` is the least node of the component. Nodes without an edge do
    not appear. A component that has become one star is set aside: only the
    others go through further rounds.
    """
    cur = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    stars = None
    while True:
        tangled = _tangled(cur)
        if tangled.isEmpty():
            break
        told = checkpoint(cur.join(tangled.withColumn("open", F.lit(True)), "v", "left"))
        whole = told.filter("open is null").select("u", "v")
        stars = whole if stars is None else stars.unionByName(whole)
        cur = told.filter("open").select("u", "v")
        # large star: every larger neighbour of u is hung on the least neighbour of u
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v")
        # small star: u and its smaller neighbours are hung on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        cur = checkpoint(small.filter("u <> v").distinct())
    stars = cur if stars is None else stars.unionByName(cur)
    # in a star every node but the root has one edge
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def trace_flow(edges: DataFrame, source: str, depth: int = 5, ordered_time: bool = False) -> DataFrame:
    """Addresses reached from ``source``, one row each.

    hops: fewest hops; path: least path of that length; total: value paid into
    the address by the addresses one hop before it; last_ts: earliest arrival.
    With ``ordered_time`` money moves on only at or after it arrived.
    """
    e = edges.select("from_addr", "to_addr", "value", "ts")
    if not ordered_time:  # every hop joins the edges: one per pair, written once
        e = e.groupBy("from_addr", "to_addr").agg(F.sum("value").alias("value"), F.min("ts").alias("ts"))
    e = checkpoint(e)
    ts_type = edges.schema["ts"].dataType
    seen = edges.sparkSession.range(1).select(
        F.lit(source).alias("addr"), F.lit(0).alias("hops"), F.array(F.lit(source)).alias("path"),
        F.lit(0.0).alias("total"), F.lit(None).cast(ts_type).alias("arrived"),
    )
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.select(F.col("addr").alias("from_addr"), "path", F.col("arrived").alias("_since")).join(e, "from_addr")
        if ordered_time:
            step = step.filter(F.col("_since").isNull() | (F.col("ts") >= F.col("_since")))
        reached = (
            step.groupBy(F.col("to_addr").alias("addr"))
            .agg(F.min("path").alias("path"), F.sum("value").alias("total"), F.min("ts").alias("arrived"))
            .join(seen.select("addr"), "addr", "left_anti")
            .select("addr", F.lit(hop).alias("hops"), F.concat("path", F.array("addr")).alias("path"), "total", "arrived")
        )
        frontier = checkpoint(reached)
        if frontier.isEmpty():
            break
        seen = _grow(seen, frontier, hop)
    return seen.filter("hops > 0").select(
        F.lit(source).alias("source"), F.col("addr").alias("destination"), "hops",
        F.slice("path", F.lit(2), F.size("path") - 2).alias("intermediates"), "total", "arrived",
    )


def shortest_path(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Fewest hops from ``a`` to ``b`` with the least such path; no row if there is none.

    Goes on, level by level, until ``b`` is met or nothing new is reached.
    """
    e = checkpoint(edges.select("from_addr", "to_addr").distinct())
    seen = edges.sparkSession.range(1).select(F.lit(a).alias("addr"), F.array(F.lit(a)).alias("path"))
    frontier, found, hop = seen, None, 0
    while found is None:
        nxt = (
            frontier.select(F.col("addr").alias("from_addr"), "path").join(e, "from_addr")
            .groupBy(F.col("to_addr").alias("addr")).agg(F.min("path").alias("path"))
            .join(seen.select("addr"), "addr", "left_anti")
            .select("addr", F.concat("path", F.array("addr")).alias("path"))
        )
        frontier = checkpoint(nxt)
        if frontier.isEmpty():
            break
        hit = frontier.filter(F.col("addr") == b)
        if not hit.isEmpty():
            found = hit
        seen = _grow(seen, frontier.select("addr", "path"), hop)
        hop += 1
    out = found if found is not None else seen.filter("false")
    return out.select((F.size("path") - 1).alias("hops"), "path")


def closure(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, item) pairs: every item reachable over links(item, needs), the root included.

    One level per round from the given roots, until a level brings nothing new;
    for all items at once see ``full_closure``.
    """
    step = links.select("item", "needs").distinct()
    seen = checkpoint(roots.select(F.col("item").alias("root"), "item").distinct())
    frontier, n = seen, 0
    while True:
        frontier = checkpoint(
            frontier.join(step, "item").select("root", F.col("needs").alias("item")).distinct()
            .join(seen, ["root", "item"], "left_anti")
        )
        if frontier.isEmpty():
            return seen
        seen = _grow(seen, frontier, n)
        n += 1


def _pairs(links: DataFrame) -> DataFrame:
    """(root, item) over links, by doubling: rounds grow with the logarithm of the depth, work with the ways between a pair."""
    reach = checkpoint(links.select(F.col("item").alias("root"), F.col("needs").alias("item")).distinct())
    while True:
        longer = reach.select("root", F.col("item").alias("_mid")).join(reach.select(F.col("root").alias("_mid"), "item"), "_mid").select("root", "item").distinct()
        new = checkpoint(longer.join(reach, ["root", "item"], "left_anti"))
        if new.isEmpty():
            return reach
        reach = checkpoint(reach.unionByName(new))


def full_closure(links: DataFrame, items: DataFrame, levels: int = 32) -> DataFrame:
    """``closure`` with every item a root: (root, item, known); ``known`` is false for what is not in ``items``.

    Items are taken up level by level, what needs nothing first: an item's set
    is the union of its needs' sets, made once, as two arrays (known, missing)
    in one row. What is in a cycle, above one, or more than ``levels`` deep is
    walked by doubling among itself and then handed the finished sets.
    """
    step = checkpoint(links.select("item", "needs").dropna().filter("item <> needs").distinct())
    known = items.select("item", F.lit(True).alias("there")).distinct()
    nodes = known.select("item").unionByName(step.select("item")).unionByName(step.select(F.col("needs").alias("item"))).distinct()
    nodes = checkpoint(nodes.join(known, "item", "left").select("item", F.coalesce("there", F.lit(False)).alias("there")))
    nothing = F.array().cast(T.ArrayType(nodes.schema["item"].dataType))
    mine = F.array("item")
    alone = nodes.select("item", "there", F.when(F.col("there"), mine).otherwise(nothing).alias("has"), F.when(F.col("there"), nothing).otherwise(mine).alias("lacks"))

    done = last = checkpoint(alone.join(step, "item", "left_anti"))
    unmet = step
    for _ in range(levels):
        still = checkpoint(unmet.join(last.select(F.col("item").alias("needs")), "needs", "left_anti").select("item", "needs"))
        ready = unmet.select("item").distinct().join(still, "item", "left_anti")
        sets = step.join(ready, "item", "left_semi").join(done.select(F.col("item").alias("needs"), "has", "lacks"), "needs")
        below = sets.groupBy("item").agg(*[F.flatten(F.collect_list(c)).alias(f"_{c}") for c in ("has", "lacks")])
        joined = [F.array_distinct(F.concat(c, f"_{c}")).alias(c) for c in ("has", "lacks")]
        last = checkpoint(alone.join(below, "item").select("item", "there", *joined))
        unmet = still
        if last.isEmpty():
            break
        done = done.unionByName(last)
    if_root = done.filter("there")
    out = if_root.select(F.col("item").alias("root"), F.explode("has").alias("item"), F.lit(True).alias("known")).unionByName(
        if_root.select(F.col("item").alias("root"), F.explode("lacks").alias("item"), F.lit(False).alias("known"))
    )
    if unmet.isEmpty():
        return out
    rest = checkpoint(unmet.select("item").distinct())
    inner = step.join(rest, "item", "left_semi").join(rest.select(F.col("item").alias("needs")), "needs", "left_semi")
    within = _pairs(inner).unionByName(rest.select(F.col("item").alias("root"), "item")).distinct()
    within = checkpoint(within.join(nodes.filter("there").select(F.col("item").alias("root")), "root", "left_semi"))
    edge = within.join(step, "item").select("root", "needs").distinct()
    handed = edge.join(done.select(F.col("item").alias("needs"), "has", "lacks"), "needs")
    beyond = handed.select("root", F.explode("has").alias("item"), F.lit(True).alias("known")).unionByName(
        handed.select("root", F.explode("lacks").alias("item"), F.lit(False).alias("known"))
    ).distinct()
    return out.unionByName(within.join(nodes, "item").select("root", "item", F.col("there").alias("known"))).unionByName(beyond)


def dependency_closure(items: DataFrame, links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Transitive needs per item, itself included; ``known`` is false for missing ones.

    ``roots`` (item) limits the answer to those items. Without it every (root,
    item) pair of the graph is listed, as many as there are: a choice for
    graphs whose items need few others.
    """
    if roots is None:
        return full_closure(links, items)
    known = items.select("item", F.lit(True).alias("known")).distinct()
    return closure(links, roots).join(known, "item", "left").select("root", "item", F.coalesce("known", F.lit(False)).alias("known"))


def process_tree(procs: DataFrame) -> DataFrame:
    """Depth and root path of every process; procs(pid, ppid).

    Roots have no living parent, or are their own. Each round doubles how far
    up every process looks, so rounds grow with the logarithm of the depth.
    Processes in a cycle, or below one, have null depth and path.
    """
    own = procs.select("pid", F.when(F.col("ppid") != F.col("pid"), F.col("ppid")).alias("up"))
    alive = procs.select(F.col("pid").alias("up"), F.lit(True).alias("there")).distinct()
    # up: the ancestor reached so far; path: from below it down to the process
    state = own.join(alive, "up", "left").select(
        "pid", F.when(F.col("there"), F.col("up")).alias("up"), F.array("pid").alias("path")
    )
    state, n = checkpoint(state), procs.count()
    for _ in range(max(1, n).bit_length() + 1):
        if state.filter("up is not null").isEmpty():
            break
        above = state.select(F.col("pid").alias("up"), F.col("up").alias("further"), F.col("path").alias("before"))
        moved = state.filter("up is not null").join(above, "up").select("pid", F.col("further").alias("up"), F.concat("before", "path").alias("path"))
        # a path longer than the processes there are goes round in circles
        moved = moved.withColumn("path", F.when(F.size("path") <= n, F.col("path")))
        state = checkpoint(state.filter("up is null").unionByName(moved.filter("path is not null")).unionByName(moved.filter("path is null").withColumn("up", F.lit(None).cast(procs.schema["pid"].dataType))))
    path = F.when(F.col("up").isNull(), F.col("path"))
    return state.select("pid", (F.size(path) - 1).alias("depth"), path.alias("path")).withColumn("depth", F.when(F.col("path").isNotNull(), F.col("depth")))
