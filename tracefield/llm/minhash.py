"""Near-duplicate texts by ProbMinHash, banding and exact verification.

A text is the weighted set of its five-word shingles, weighted by how often
they occur. Each shingle is a Poisson process whose rate is its weight: its
arrivals come one after the other, each at a random component, which keeps the
earliest arrival and its shingle. A shingle stops as soon as its next arrival
would be later than the latest component's, so most stop at once. Two texts
agree in a component with the probability Jaccard similarity J_P; where weights
are equal this is the usual Jaccard similarity.

Equal texts are one node from the start. Texts that agree in a band (rows of
components) are candidates; J_P of candidates is computed from their whole
shingle sets, and links are pairs at or above the threshold. 1 - J_P is a
metric, but no bound is taken from it: within a bucket, pairs are left out only
if their sketches are far apart or a chain of links joins them already. Each
member is first compared with its bucket's least one; in buckets that are not
one component by then, members of different components are compared in groups
of bounded size that hold each text once: a spanning forest of the nearest
sketches first, then all near pairs that are still not joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefield.llm.common import mix, ragged, slices, utf8, words
from tracefield.llm.url_filter import bloom
from tracefield.operators.graph import connected_components
from tracefield.session import checkpoint

WORDS, THRESHOLD = 5, 0.8
#: a pair at the threshold shares a band with probability 1 - (1 - 0.8^4)^16 > 0.9997
BANDS, ROWS = 16, 4
COMPONENTS = BANDS * ROWS
#: sketches that agree in a smaller share of components are not verified: 3.9 standard errors below the threshold
FAR = 0.605
#: members of a bucket that one task compares; a larger bucket is cut in chunks and its pairs of chunks are dealt out
CHUNK = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a batch of texts: (text, hash of 40 bits, count), by text and hash.

    A text of one to four words has one shingle, all its words; a text without words has none.
    """
    h, _, _, doc = words(data, offsets)
    n = len(offsets) - 1
    size = np.bincount(doc, minlength=n)
    begin = np.cumsum(size) - size
    full = h.copy()
    for i in range(1, WORDS):
        full[: len(h) - i] = full[: len(h) - i] * _ODD + h[i:] if len(h) > i else full[: len(h) - i]
    place = np.arange(len(h)) - begin[doc]
    keep = place <= size[doc] - WORDS
    value, owner = full[keep], doc[keep]
    short = np.flatnonzero((size > 0) & (size < WORDS))
    for d in short.tolist():
        x = np.uint64(size[d])
        for w in h[begin[d] : begin[d] + size[d]]:
            x = mix(np.array([x ^ w]))[0]
        value, owner = np.append(value, x), np.append(owner, d)
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (mix(value) >> np.uint64(24)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    return (key[first] >> np.uint64(40)).astype(np.int64), key[first] & np.uint64((1 << 40) - 1), count


def sketch(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash of each text: (n, COMPONENTS) shingle hashes; all ones where a text has no shingle."""
    best = np.full(n * COMPONENTS, np.inf)
    late = np.full(n, np.inf)
    at, arrival, seed = np.arange(len(doc)), np.zeros(len(doc)), mix(shingle)
    winners: list[tuple] = []
    has = np.bincount(doc, minlength=n) > 0
    late[~has] = 0
    turn = 0
    while len(at):
        turn += 1
        r = mix(seed[at] + np.array([turn], np.uint64) * _ODD)
        u = ((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        arrival = arrival - np.log(u) / weight[at]
        open_ = arrival < late[doc[at]]
        at, arrival, r = at[open_], arrival[open_], r[open_]
        place = doc[at] * COMPONENTS + (mix(r) % np.uint64(COMPONENTS)).astype(np.int64)
        np.minimum.at(best, place, arrival)
        winners.append((place, arrival, at))
        late = np.where(has, best.reshape(n, COMPONENTS).max(1), 0)
    out = np.full(n * COMPONENTS, 0xFFFFFFFF, np.uint32)
    for place, when, who in winners:
        won = when == best[place]
        out[place[won]] = (seed[who[won]] >> np.uint64(32)).astype(np.uint32)
    return out.reshape(n, COMPONENTS)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    x = sketches.astype(np.uint64).reshape(len(sketches), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * _ODD + x[:, :, i])
    return key.view(np.int64)


def similarity(a: tuple, b: tuple) -> float:
    """J_P of two weighted sets (sorted distinct hashes, weights): sum over common d of 1 / sum over d' of max(a'/a, b'/b)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    every = np.union1d(ha, hb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ha)], y[np.searchsorted(every, hb)] = wa, wb
    both = (x > 0) & (y > 0)
    ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    low = np.cumsum(x[order])
    high = y.sum() - np.cumsum(y[order])
    last = np.searchsorted(ratio[order], ratio[both], "right") - 1
    return float((1.0 / (low[last] / x[both] + high[last] / y[both])).sum())


def may_link(sets: list[tuple], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Marks the pairs of set numbers whose J_P may reach the threshold, without taking any that does for one that does not.

    With p and q the shares that two sets hold of their weight in what both
    have, J_P is 1 / (1/p + 1/q - 1) at most, and just that where all weights
    are equal: a common d adds no more than 1 / (1/a + (1 - q)/b), a and b being
    its shares, which is concave and homogeneous, so the sum is bounded by its
    value at (p, q).
    """
    size = np.array([len(h) for h, _ in sets], np.int64)
    start = np.cumsum(size) - size
    number = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)[1]
    share = np.concatenate([w / w.sum() for _, w in sets])
    held, ok = np.zeros(len(number)), np.zeros(len(pairs), bool)
    order = np.argsort(pairs[:, 0], kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(pairs[order, 0])) + 1):
        a = pairs[run[0], 0]
        mine = slice(start[a], start[a] + size[a])
        held[number[mine]] = share[mine]
        for part in np.array_split(run, 1 + int(size[pairs[run, 1]].sum() >> 20)):
            b = pairs[part, 1]
            at, cut = ragged(start[b], size[b]), np.cumsum(size[b]) - size[b]
            both = held[number[at]]
            p, q = np.add.reduceat(both, cut), np.add.reduceat(share[at] * (both > 0), cut)
            ok[part] = (p > 0) & (p * q >= (threshold - 1e-9) * (p + q - p * q))
        held[number[mine]] = 0
    return ok


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, node, some, sketch, bands): ``node`` is the md5 of the text, ``some`` whether it has words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text"):
                doc, value, count = shingles(*utf8(b.column("text")))
                s = sketch(doc, value, count.astype(float), len(b))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(s).ravel()))
                some = pa.array(np.bincount(doc, minlength=len(b)) > 0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), some, pa.array([r.tobytes() for r in s.astype("<u4")], pa.binary()), bands], ["doc_id", "node", "some", "sketch", "bands"])

    return docs.select("doc_id", node_of().alias("node"), "text").mapInArrow(run, f"doc_id {kind}, node binary, some boolean, sketch binary, bands array<long>")


def node_of():
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose sketches agree in a share of FAR or more."""
    for b in batches:
        if len(b):
            x, y = (np.frombuffer(b"".join(b[c]), "<u4").reshape(len(b), COMPONENTS) for c in ("sketch_u", "sketch_v"))
            yield b.loc[(x == y).mean(1) >= FAR, ["u", "v"]]


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    s = nodes.select("node", "sketch")
    joined = pairs.join(s.toDF("u", "sketch_u"), "u").join(s.toDF("v", "sketch_v"), "v")
    return joined.mapInPandas(_agree, "u binary, v binary")


class Sets:
    """Shingle sets of texts, kept by node up to a bound."""

    def __init__(self, most: int = 2_000_000):
        self.kept: dict[bytes, tuple] = {}
        self.size, self.most = 0, most

    def get(self, node: bytes, text: str | None) -> tuple:
        found = self.kept.get(node)
        if found is None:
            if self.size > self.most:
                self.kept, self.size = {}, 0
            _, value, count = shingles(*utf8(pa.array([text], pa.string())))
            found = self.kept[node] = (value, count.astype(float))
            self.size += len(value)
        return found


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text), one row for each wanted node.

    A Bloom filter of the wanted nodes (10 bits a node, 32 MB at most) keeps
    other texts from moving; what it lets pass wrongly goes in the join.
    """
    keys = lambda c: [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]
    wanted = checkpoint(wanted.distinct())
    filtered = bloom(wanted.select(*keys("node")), max(1, wanted.count()), 0.01, 0)

    @F.pandas_udf("boolean")
    def maybe(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(filtered.hits(h1.to_numpy(), h2.to_numpy()))

    rows = docs.select(node_of().alias("node"), "text").filter(maybe(*keys("node")))
    return rows.groupBy("node").agg(F.first("text").alias("text")).join(wanted, "node", "left_semi")


def verify(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Those (u, v) whose texts have J_P at or above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for b in batches:
            u, v, x, y = (b.column(c) for c in ("u", "v", "text_u", "text_v"))
            ok = [
                similarity(sets.get(u[i].as_py(), x[i].as_py()), sets.get(v[i].as_py(), y[i].as_py())) >= threshold
                for i in range(len(b))
            ]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    texts = checkpoint(texts_of(docs, pairs.select(F.explode(F.array("u", "v")).alias("node"))))
    joined = pairs.join(texts.toDF("u", "text_u"), "u").join(texts.toDF("v", "text_v"), "v")
    with few_rows_a_batch(docs.sparkSession):
        return checkpoint(joined.select("u", "text_u", "v", "text_v").mapInArrow(run, "u binary, v binary"))


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 128):
    """Arrow batches of few rows while whole texts go to Python, so that long ones do not fill its memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _chunks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of buckets dealt to groups (bucket, i, j): every two members of a bucket meet in one."""
    dealt = members.join(sizes.select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), "bucket")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return dealt.select("bucket", "node", "component", "sketch", "bands", "part", other).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))


def near_pairs(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """(members of one group by node, pairs of row numbers whose sketches are near, nearest first).

    Only pairs of different components; a pair that shares several bands is
    taken in the bucket of the first of them, one that meets in several groups
    of a bucket in the one of its two parts.
    """
    rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
    bucket, cross = rows["bucket"].iloc[0], rows["i"].iloc[0] != rows["j"].iloc[0]
    s = np.frombuffer(b"".join(rows["sketch"]), "<u4").reshape(len(rows), COMPONENTS)
    bands = np.array(rows["bands"].tolist(), np.int64)
    here = int(np.flatnonzero((bands == bucket).all(0))[0])
    _, component = np.unique(rows["component"].to_numpy(), return_inverse=True)
    part = rows["part"].to_numpy()
    found = [np.zeros((0, 3))]
    for a in range(len(rows) - 1):
        ok = component[a + 1 :] != component[a]
        if cross:
            ok &= part[a + 1 :] != part[a]
        b = np.flatnonzero(ok) + a + 1
        if len(b) and here:
            b = b[(bands[b, :here] != bands[a, :here]).all(1)]
        if len(b):
            same = (s[b] == s[a]).mean(1)
            b, same = b[same >= FAR], same[same >= FAR]
            found.append(np.stack([np.full(len(b), a), b, -same], 1))
    pairs = np.concatenate(found)
    return rows, pairs[np.argsort(pairs[:, 2], kind="stable"), :2].astype(np.int64)


def _involved(rows: pd.DataFrame) -> pd.DataFrame:
    """Members of a group that are in some near pair."""
    rows, pairs = near_pairs(rows)
    return rows.loc[np.unique(pairs), ["bucket", "i", "j", "part", "node", "component"]]


def _links(threshold: float, forest: bool):
    """Function of one group with its texts: verified links, pairs already joined by links left out.

    With ``forest`` only a spanning forest of the near pairs, nearest first, is
    verified: a hub that joins its copies is found without comparing them all.
    Else a bound leaves out pairs that cannot be links, unless the group's sets
    are too large to be held at once.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, pairs = near_pairs(rows)
        _, component = np.unique(rows["component"].to_numpy(), return_inverse=True)
        root = list(range(int(component.max()) + 1))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        node, text, sets, out = rows["node"].tolist(), rows["text"].tolist(), Sets(), []
        if not forest and len(pairs):
            used, local = np.unique(pairs, return_inverse=True)
            held, total = [], 0
            for k in used.tolist():
                held.append(sets.get(node[k], text[k]))
                total += len(held[-1][0])
                if total > sets.most:
                    break
            else:
                pairs = pairs[may_link(held, local.reshape(pairs.shape), threshold)]
        for a, b in pairs.tolist():
            x, y = top(component[a]), top(component[b])
            if x == y:
                continue
            alike = similarity(sets.get(node[a], text[a]), sets.get(node[b], text[b])) >= threshold
            if alike:
                out.append((node[a], node[b]))
            if alike or forest:
                root[x] = y
        return pd.DataFrame(out, columns=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, keep_node: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id, kept, n_copies and, if asked for, node (md5 of the text).

    Classes are the components of links. ``class_id`` is the least doc_id of the
    class and ``kept`` marks that document (rows equal in id and text are one
    document and marked alike). ``n_copies`` counts the rows with the same text. Null texts count as empty; texts without words are alike only if
    equal; a null doc_id is a class's id only if it has no other. Other columns are
    ignored.
    """
    docs = docs.select("doc_id", "text")
    rows = checkpoint(describe(docs))
    nodes = checkpoint(rows.filter("some").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = checkpoint(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).filter("n > 1"))
    shared = checkpoint(members.join(sizes, "bucket"))
    # every member against its bucket's least: one pair per member
    star = shared.filter("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct()
    links = verify(checkpoint(_near(star, nodes)), docs, threshold)
    # buckets whose other members are not yet joined, as far as their first links tell
    first = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    rest = shared.filter("n > 2 and node <> low").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = checkpoint(rest.select("bucket", "node", "component", "n"))
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.first("n").alias("n")).filter("a <> b")
    held = rest.select("bucket", "node", "component").join(mixed.select("bucket"), "bucket", "left_semi").join(nodes, "node")
    group = ["bucket", "i", "j"]
    kept = _chunks(held, mixed).groupBy(*group).applyInPandas(_involved, "bucket long, i int, j int, part int, node binary, component binary")
    kept = checkpoint(kept)
    if kept.head(1):
        # first the nearest pairs of each group, then, knowing what these join, all near pairs left
        whole = checkpoint(nodes.join(texts_of(docs, kept.select("node")), "node"))
        links = links.unionByName(checkpoint(kept.join(whole, "node").groupBy(*group).applyInPandas(_links(threshold, True), "u binary, v binary")))
        component = connected_components(links)
        left = checkpoint(kept.drop("component").join(component, "node", "left").withColumn("component", F.coalesce("component", "node")))
        mixed = left.groupBy(*group).agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select(*group)
        left = left.join(mixed, group, "left_semi").join(whole, "node")
        links = links.unionByName(checkpoint(left.groupBy(*group).applyInPandas(_links(threshold, False), "u binary, v binary")))
    component = connected_components(links)
    joined = rows.select("doc_id", "node").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = checkpoint(joined)
    classes = joined.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "node")).alias("first"))
    copies = joined.groupBy("node").agg(F.count(F.lit(1)).alias("n_copies"))
    out = joined.join(classes, "component").join(copies, "node")
    return out.select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))).alias("kept"),
        "n_copies",
        *(["node"] if keep_node else []),
    )
