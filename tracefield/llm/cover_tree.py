"""Exact near-duplicate vectors by dual traversal of cover trees.

Vectors on the unit sphere are linked at cosine >= t, that is at distance <=
sqrt(2 - 2t). A cover tree has nested levels of centres with halving radii: every
point lies within its level's radius of its centre, a centre stays a centre on
all finer levels. Two nodes whose centres are further apart than both covering
radii and the link distance hold no link; nodes close enough hold nothing but
links and are counted whole; other pairs go on to their children. What remains
at the leaves is compared in double precision, so no link is missed or made up.

On the cluster: equal vectors are one point with a multiplicity. The top of the
tree is a net over a bounded sample; each point goes to its nearest centre, and
cells are put together (or, hot ones, split by hash) to blocks of bounded size.
A task builds the tree of a block once. Pairs of blocks that the covering radii do not
rule out meet in a task that traverses both trees; it returns, for each of the
points, the number of links and one edge of a spanning forest, never the pairs.
Runs of blocks meet together, so that a block is sent once to a run, not once to each block of it.
The number of block pairs is the method's worst case: where all points are
about equally far apart no bound can prune, and every two blocks have to meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefield.operators.graph import connected_components
from tracefield.session import checkpoint

#: points of a block, and of the sample that the top of the tree is made of
BLOCK, SAMPLE, CELLS = 4096, 2048, 256
#: blocks, and components of their vectors, that meet in one task at most
SIDE, HELD = 8, 1 << 23
#: levels below the root: radii 1, 1/2, ... 1/32
LEVELS = 6
#: bounds decide only beyond this margin; nearer than that, the points themselves are compared
MARGIN = 1e-7
#: error allowed for a dot product of unit vectors in single precision
SLACK = 1e-5
STRIPE = 512


def unit(rows, kind: str) -> np.ndarray:
    """Unit vectors in double precision from their bytes."""
    x = np.frombuffer(b"".join(rows), kind).astype(float).reshape(len(rows), -1)
    # scaled first, so that squares of very large or small components stay in range
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def cells_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells; numpy finds rare ones much faster in one dimension than in two."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def net(x: np.ndarray, radius: float, parent: np.ndarray) -> np.ndarray:
    """Centre of each point: centres of the level above stay, each other point joins the first one near enough or becomes one."""
    center = np.full(len(x), -1)
    for top, members in pd.Series(np.arange(len(x))).groupby(parent).indices.items():
        if len(members) == 1:
            center[members] = top
            continue
        left, new = members, int(top)
        near_dot = 1.0 - radius * radius / 2
        while len(left):
            close = x[left] @ x[new] >= near_dot
            close[left == new] = True
            center[left[close]] = new
            left = left[~close]
            if len(left):
                new = int(left[0])
    return center


def build(x: np.ndarray) -> np.ndarray:
    """Centres by level, (points, LEVELS): nested nets with radii 1, 1/2, 1/4, ..."""
    out, parent = [], np.zeros(len(x), np.int64)
    for level in range(LEVELS):
        parent = net(x, 2.0 ** -level, parent)
        out.append(parent)
    return np.stack(out, 1)


class Tree:
    """A block's points with the nodes of each level: centre, members, covering radius, parent."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, path: np.ndarray):
        self.x, self.weight = x, weight
        self.levels = []
        above = np.zeros(len(x), np.int64)
        for k in range(path.shape[1]):
            center, node = np.unique(path[:, k], return_inverse=True)
            gap = np.sqrt(np.maximum(2.0 - 2.0 * np.einsum("ij,ij->i", x, x[path[:, k]]), 0))
            radius = np.zeros(len(center))
            np.maximum.at(radius, node, gap)
            radius[np.bincount(node) == 1] = 0.0
            parent = np.zeros(len(center), np.int64)
            parent[node] = above
            self.levels.append((center, node, radius, parent, np.bincount(node, weight, len(center))))
            above = node
        self.leaf = above
        order = np.argsort(above, kind="stable")
        self.order, self.first = order, np.searchsorted(above[order], np.arange(len(self.levels[-1][0]) + 1))

    def members(self, level: int, nodes: np.ndarray) -> dict[int, np.ndarray]:
        node = self.levels[level][1]
        wanted = np.flatnonzero(np.isin(node, nodes))
        return {int(k): wanted[v] for k, v in pd.Series(node[wanted]).groupby(node[wanted]).indices.items()}


class Forest:
    """Union-find over points; only what connects is kept, however many links there are."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def top(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, u: list, v: list) -> None:
        for x, y in zip(u, v, strict=True):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)


def traverse(a: Tree, b: Tree, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """(links of a's points, links of b's points, forest over a's points and, if they are others, b's after them)."""
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    links_a, links_b = np.zeros(len(a.x)), np.zeros(len(b.x))
    shift = 0 if same else len(a.x)
    linked = Forest(len(a.x) + (0 if same else len(b.x)))
    alive = np.ones((1, 1), bool)

    def whole(level: int, pairs: np.ndarray):
        """All points of both nodes are linked."""
        in_a, in_b = a.members(level, pairs[:, 0]), b.members(level, pairs[:, 1])
        size_a, size_b = a.levels[level][4], b.levels[level][4]
        for i, j in pairs.tolist():
            p, q = in_a[i], in_b[j]
            if same and i == j:
                links_a[p] += size_a[i] - a.weight[p]
                linked.join([int(p[0])] * (len(p) - 1), p[1:].tolist())
                continue
            links_a[p] += size_b[j]
            links_b[q] += size_a[i]
            linked.join([int(p[0])] * len(q), (q + shift).tolist())
            linked.join(p[1:].tolist(), [int(q[0]) + shift] * (len(p) - 1))

    def single(i: np.ndarray, j: np.ndarray):
        """Points compared one with one."""
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            hit = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= cosine
            p, q = p[hit], q[hit]
            np.add.at(links_a, p, b.weight[q])
            np.add.at(links_b, q, a.weight[p])
            linked.join(p.tolist(), (q + shift).tolist())

    # bounds are taken in single precision, with slack; what they leave open is decided in double precision
    xa, xb = a.x.astype(np.float32), b.x.astype(np.float32)
    for level in range(len(a.levels)):
        ca, node_a, ra, above_a, _ = a.levels[level]
        cb, node_b, rb, above_b, _ = b.levels[level]
        point_a, point_b = np.bincount(node_a) == 1, np.bincount(node_b) == 1
        live_a, live_b = np.flatnonzero(alive.any(1)[above_a]), np.flatnonzero(alive.any(0)[above_b])
        ahead = np.zeros((len(ca), len(cb)), bool)
        for ones_a in (True, False):
            for ones_b in (True, False):
                cols = live_b[point_b[live_b] == ones_b]
                some = live_a[point_a[live_a] == ones_a]
                for rows in np.array_split(some, -(-len(some) // STRIPE)) if len(some) and len(cols) else ():
                    dot = xa[ca[rows]] @ xb[cb[cols]].T
                    if ones_a and ones_b:
                        i, j = cells_of(dot >= 1.0 - (reach + MARGIN) ** 2 / 2 - SLACK)
                        i, j = rows[i], cols[j]
                        keep = alive[above_a[i], above_b[j]]
                        if same:
                            keep &= i < j
                        single(ca[i[keep]], cb[j[keep]])
                        continue
                    open_ = alive[above_a[rows]][:, above_b[cols]]
                    if same:
                        open_ &= cols[None, :] >= rows[:, None]
                    bound = ra[rows, None] + rb[None, cols]
                    # d > r + r' + reach, in terms of the dot product
                    open_ &= dot >= 1.0 - (bound + reach + MARGIN) ** 2 / 2 - SLACK
                    i, j = cells_of(open_)
                    inner = reach - ra[rows[i]] - rb[cols[j]] - MARGIN
                    full = (inner > 0) & (dot[i, j] >= 1.0 - np.maximum(inner, 0) ** 2 / 2 + SLACK)
                    if full.any():
                        whole(level, np.stack([rows[i[full]], cols[j[full]]], 1))
                    ahead[rows[i[~full]], cols[j[~full]]] = True
        # children need not lie in their parents' order
        alive = ahead | ahead.T if same else ahead
        if not alive.any():
            break
    for i, j in np.stack(cells_of(np.triu(alive) if same else alive), 1).tolist():  # leaves that the bounds leave open
        p, q = a.order[a.first[i] : a.first[i + 1]], b.order[b.first[j] : b.first[j + 1]]
        for part in np.array_split(p, -(-len(p) // STRIPE)):
            hit = a.x[part] @ b.x[q].T >= cosine
            if same and i == j:
                hit &= part[:, None] < q[None, :]
            links_a[part] += hit @ b.weight[q]
            links_b[q] += hit.T @ a.weight[part]
            u, v = cells_of(hit)
            linked.join(part[u].tolist(), (q[v] + shift).tolist())
    if same:
        links_a = links_a + links_b
    return links_a, links_b, linked


def runs_of(blocks: int, dim: int, cores: int) -> int:
    """Blocks of a run: as many as leave every core several pairs of runs, within the bounds on what a task holds."""
    return max(1, min(SIDE, HELD // (2 * BLOCK * dim), int(blocks / (8 * cores) ** 0.5)))


def meetings(partners: dict[int, list[int]], side: int) -> list[tuple[int, int, int]]:
    """(block, i, j): the block goes to where runs ``i`` and ``j`` of ``side`` blocks meet, as a partner of it lies there."""
    return sorted({(b, *sorted((b // side, o // side))) for b, others in partners.items() for o in others})


def points(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, node, vec): node is the md5 of the vector, null for vectors that link with nothing."""
    kind = vectors.schema[id_col].dataType.simpleString()
    code = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    cast = "array<float>" if code == "<f4" else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("vec")
            sizes = np.diff(np.asarray(col.offsets))
            flat = np.asarray(col.values.fill_null(np.nan), code)[col.offsets[0].as_py() :]
            ends = np.cumsum(sizes)
            raw = []
            valid = np.asarray(col.is_valid())
            for ok, n, e in zip(valid.tolist(), sizes.tolist(), ends.tolist(), strict=True):
                v = flat[e - n : e]
                good = ok and n and np.isfinite(v).all() and v.any()
                raw.append((v + 0.0).astype(code).tobytes() if good else None)  # + 0.0: no negative zero
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "vec"])

    out = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(cast).alias("vec")).mapInArrow(run, f"vec_id {kind}, vec binary")
    return out.withColumn("node", F.unhex(F.md5("vec")))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    least id reachable by links (its own included), ``kept`` marks that row.
    Null, empty and zero vectors and those with null or non-finite components
    link with nothing; nor do vectors of different length. Repeated rows are
    vectors of their own; null ids are never a component's id unless alone.
    """
    spark = vectors.sparkSession
    code = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    rows = checkpoint(points(vectors, id_col, vector_col))
    distinct = rows.filter("node is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"))
    distinct = checkpoint(distinct.withColumn("dim", F.octet_length("vec") / int(code[2])).withColumn("dim", F.col("dim").cast("int")))
    tops: dict[int, np.ndarray] = {}
    for r in distinct.groupBy("dim").count().orderBy("dim").collect():  # node is a random order, so this is a random sample
        sample = distinct.filter(F.col("dim") == r["dim"]).orderBy("node").limit(SAMPLE).collect()
        x = unit([s["vec"] for s in sample], code)
        tops[r["dim"]] = x[np.unique(net(x, 1.0, np.zeros(len(x), np.int64)))[:CELLS]]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros(len(b), np.int64)
            for dim, at in b.groupby("dim").indices.items():
                out[at] = (unit(b["vec"].to_numpy()[at], code) @ tops[dim].T).argmax(1)
            yield b.assign(cell=out)

    dealt = checkpoint(distinct.mapInPandas(cells, "node binary, vec binary, weight long, dim int, cell long"))
    first: dict[tuple, tuple[int, int]] = {}
    block = filled = 0
    last = None
    for r in dealt.groupBy("dim", "cell").count().orderBy("dim", "cell").collect():  # CELLS rows a dimension
        n = r["count"]
        if filled and (last != r["dim"] or filled + n > BLOCK):
            block, filled = block + 1, 0
        parts = -(-n // BLOCK)
        first[r["dim"], r["cell"]] = (block, parts)
        if parts > 1:
            block, filled = block + parts, 0
        else:
            filled += n
        last = r["dim"]
    places = spark.createDataFrame([(d, c, b, p) for (d, c), (b, p) in first.items()], "dim int, cell long, first int, parts int")
    blocks = dealt.join(F.broadcast(places), ["dim", "cell"]).select("node", "vec", "weight", "dim", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int").alias("block"))

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        x = unit(rows["vec"], code)
        center = x.mean(0)
        size = np.sqrt((center * center).sum())
        center = center / size if size > 1e-9 else x[0]
        rows["path"] = build(x).tolist()
        rows["center"] = [center.tolist() if i == 0 else None for i in range(len(x))]
        rows["radius"] = float(np.sqrt(np.maximum(2 - 2 * (x @ center), 0)).max())
        return rows

    trees = checkpoint(blocks.groupBy("block").applyInPandas(tree, "node binary, vec binary, weight long, dim int, block int, path array<int>, center array<double>, radius double"))
    partners: dict[int, list[int]] = {}
    reach = float(np.sqrt(2 - 2 * cosine))
    for dim, group in trees.filter("center is not null").select("block", "dim", "center", "radius").orderBy("block").toPandas().groupby("dim"):
        c, r, name = np.array(group["center"].tolist(), float), group["radius"].to_numpy(), group["block"].to_numpy()
        near = distance(c, c) <= r[:, None] + r[None, :] + reach + MARGIN
        near |= np.eye(len(c), dtype=bool)
        for i in range(len(c)):
            partners[int(name[i])] = name[near[i]].tolist()
    cores = spark.sparkContext.defaultParallelism
    side = runs_of(len(partners), max(tops, default=1), cores)
    met = spark.createDataFrame(meetings(partners, side), "block int, i int, j int")
    # few bytes, much work: a stated number of partitions is not coalesced by size
    tasks = max(8 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = trees.drop("center", "radius", "dim").join(F.broadcast(met), "block").repartition(tasks, "i", "j")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "node"], ignore_index=True)
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        names, trees_ = {}, {}
        for block, part in rows.groupby("block"):
            names[block] = part["node"].to_numpy()
            trees_[block] = Tree(unit(part["vec"], code), part["weight"].to_numpy(float), np.array(part["path"].tolist(), np.int64))
        out = []
        for a in (k for k in names if k // side == i):
            for b in (k for k in partners[a] if k >= a and k // side == j):
                links_a, links_b, linked = traverse(trees_[a], trees_[b], a == b, cosine)
                name = names[a] if a == b else np.concatenate([names[a], names[b]])
                links = links_a if a == b else np.concatenate([links_a, links_b])
                at = np.flatnonzero(links)
                out.append(pd.DataFrame({"node": name[at], "links": links[at].astype(np.int64), "root": name[[linked.top(x) for x in at.tolist()]]}))
        return pd.concat(out)

    found = checkpoint(pairs.groupBy("i", "j").applyInPandas(meet, "node binary, links long, root binary"))
    component = connected_components(found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    points_ = distinct.select("node", "weight").join(links, "node", "left").join(component, "node", "left")
    points_ = points_.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    joined = checkpoint(rows.select("vec_id", "node").join(points_, "node", "left"))
    least = joined.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = joined.join(least, "component", "left")
    alone = F.col("node").isNull()
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
