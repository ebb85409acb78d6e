"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf. Leaves of a source are appended in order to trees of 16
children a node. ``OpenTree`` is the streaming part: a run of siblings that is
not yet complete is open; when its last sibling arrives, the siblings are
attached to the witness of each subtree below, so a witness grows level by
level while the tree does and nothing is ever walked twice.

Spark cuts each source at multiples of 16**3 leaves, so a block is an aligned
subtree and one task's append. Its root is the next append of a tree one storey
up, again in blocks, until one node is left; the sources' roots are appended to
one last tree in the same way. A witness is kept once for each run of 16
leaves, and what a storey adds to it once for each block: the proofs of single
leaves are spelt out only in the last pass, and are never stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tracefield.llm.common import continued, partitions
from tracefield.session import checkpoint

FAN = 16
#: levels of a block: a block is FAN ** DEPTH nodes
DEPTH = 3
#: runs of 16 leaves whose proofs are spelt out at a time
RUNS = 256
#: one level of a witness: the place of the subtree among its siblings and the others' digests, left to right
LEVEL = pa.struct([("place", pa.int32()), ("siblings", pa.binary())])
LEVELS = pa.list_(LEVEL)
LEVEL_SQL = "array<struct<place:int,siblings:binary>>"


def parent(digests: list[bytes]) -> bytes:
    """H of a run: sha256 of the digests as hex text, one after the other."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class OpenTree:
    """Append digests; witnesses of the level-1 subtrees grow as runs above them complete.

    ``witness[i]`` holds the levels above run ``i`` of 16 leaves, ``runs[i]``
    the digests in it. ``close`` completes what is open up to ``depth`` levels.
    """

    def __init__(self, depth: int = DEPTH):
        self.depth = depth
        self.runs: list[list[bytes]] = []
        self.witness: list[list[tuple[int, bytes]]] = []
        # open siblings at each level from 1 on: (digest, first run below it)
        self.open: list[list[tuple[bytes, int]]] = []
        self.size = 0

    def append(self, digest: bytes):
        if self.size % FAN == 0:
            self.runs.append([])
            self.witness.append([])
        self.runs[-1].append(digest)
        self.size += 1
        if len(self.runs[-1]) == FAN:
            self._complete(parent(self.runs[-1]), len(self.runs) - 1, 0)

    def _complete(self, digest: bytes, first: int, level: int):
        """A subtree got complete: it joins its siblings, and if it is the last of them, they are complete."""
        if level + 1 == self.depth:
            self.root = digest
            return
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((digest, first))
        if len(self.open[level]) == FAN:
            self._extend(level)

    def _extend(self, level: int):
        """The open siblings of a level are all there: each attaches the others to the witnesses below it."""
        siblings, self.open[level] = self.open[level], []
        firsts = [f for _, f in siblings] + [len(self.runs)]
        for place in range(len(siblings)):
            others = b"".join(d for i, (d, _) in enumerate(siblings) if i != place)
            for run in range(firsts[place], firsts[place + 1]):
                self.witness[run].append((place, others))
        self._complete(parent([d for d, _ in siblings]), siblings[0][1], level + 1)

    def close(self) -> tuple[bytes, int, bytes]:
        """(root at the height where one node is left, that height, root at ``depth`` levels): open runs get complete as they are."""
        n, height = self.size, 0
        while n > 1:
            n, height = -(-n // FAN), height + 1
        root = self.runs[0][0]
        if len(self.runs[-1]) < FAN:
            self._complete(parent(self.runs[-1]), len(self.runs) - 1, 0)
        for level in range(self.depth - 1):
            if level < len(self.open) and self.open[level]:
                if level + 1 == height and len(self.open[level]) == 1:
                    root = self.open[level][0][0]
                self._extend(level)
        return (self.root if height == self.depth else root), height, self.root


def fold(digest: bytes, levels: list[tuple[int, str]]) -> bytes:
    """Root from a node and its witness (place, siblings' hex text) level by level."""
    for place, others in levels:
        text = others[: 64 * place] + digest.hex() + others[64 * place :]
        digest = hashlib.sha256(text.encode()).digest()
    return digest


def leaf_digest(columns: list[str], changed: dict[str, Column] | None = None) -> Column:
    """H of the row: each value as byte count, colon, value; ``-`` for null. Binary."""
    changed = changed or {}
    parts = []
    for c in columns:
        value = changed.get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` (written) with ``number``: place from 0 among the rows of the same ``key`` in ``order``, null keys alike.

    Range partitions keep the order; each numbers its keys' rows, and
    ``continued`` adds what lies in the partitions before.
    """
    tie = "_tie"
    parts = partitions(rows.sparkSession)
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, key, *order, tie)
    dealt = dealt.sortWithinPartitions(key, *order, tie).drop(tie)
    at = dealt.columns.index(key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, n = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            numbers = []
            for k in b.column(at).to_pylist():
                n = n + 1 if k == now else 0
                now = k
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int32()), pa.array(numbers, pa.int64())], [*b.schema.names, "_part", "number"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return continued(checkpoint(dealt.mapInArrow(count, f"{schema}, _part int, number long")), key, "_part", "number").drop("_part")


def grow_leaves(leaves: DataFrame, depth: int) -> DataFrame:
    """Runs of (source, number, doc_id, leaf, other): one row per 16 leaves with the witness that its block gives.

    Columns: source, block, doc_ids, leaves, others (a changed leaf or null),
    levels (place and siblings, ``depth`` - 1 of them), and the block's root,
    height, full (root at ``depth`` levels).
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        tree = OpenTree(depth)
        leaf, doc, other = (table.column(c).to_pylist() for c in ("leaf", "doc_id", "other"))
        for d in leaf:
            tree.append(d)
        root, height, full = tree.close()
        n = len(tree.runs)
        cut = lambda x: [x[i : i + FAN] for i in range(0, len(x), FAN)]
        first = table.slice(0, 1)
        return pa.table(
            [pa.array([first.column("source")[0].as_py()] * n, pa.string()), pa.array([first.column("block")[0].as_py()] * n, pa.int64()),
             pa.array(cut(doc), pa.list_(pa.int64())), pa.array(tree.runs, pa.list_(pa.binary())), pa.array(cut(other), pa.list_(pa.binary())),
             pa.array([[{"place": p, "siblings": s} for p, s in w] for w in tree.witness], LEVELS),
             pa.array([root] * n, pa.binary()), pa.array([height] * n, pa.int32()), pa.array([full] * n, pa.binary())],
            names=["source", "block", "doc_ids", "leaves", "others", "levels", "root", "height", "full"],
        )

    dealt = leaves.withColumn("block", F.floor(F.col("number") / FAN**depth).cast("long"))
    schema = f"source string, block long, doc_ids array<long>, leaves array<binary>, others array<binary>, levels {LEVEL_SQL}, root binary, height int, full binary"
    return checkpoint(dealt.groupBy("source", "block").applyInArrow(run, schema))


def grow_nodes(nodes: DataFrame, depth: int) -> DataFrame:
    """(key, number, levels, block, root, height, full) of (key, number, digest): one append per node, block by block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        tree = OpenTree(depth)
        for d in table.column("digest").to_pylist():
            tree.append(d)
        root, height, full = tree.close()
        n = len(table)
        levels = []
        for digests, above in zip(tree.runs, tree.witness, strict=True):
            rest = [{"place": p, "siblings": s} for p, s in above]
            for i in range(len(digests)):
                levels.append([{"place": i, "siblings": b"".join(digests[:i] + digests[i + 1 :])}, *rest])
        return pa.table(
            [table.column("key"), table.column("number"), pa.array(levels, LEVELS), table.column("block"),
             pa.array([root] * n, pa.binary()), pa.array([height] * n, pa.int32()), pa.array([full] * n, pa.binary())],
            names=["key", "number", "levels", "block", "root", "height", "full"],
        )

    dealt = nodes.withColumn("block", F.floor(F.col("number") / FAN**depth).cast("long"))
    return checkpoint(dealt.groupBy("key", "block").applyInArrow(run, f"key string, number long, levels {LEVEL_SQL}, block long, root binary, height int, full binary"))


def _roots(grown: DataFrame, key: str) -> DataFrame:
    """One row per block: key, block, root, height, full."""
    return grown.select(F.col(key).alias("key"), "block", "root", "height", "full").dropDuplicates(["key", "block"])


def finish(blocks: DataFrame, depth: int) -> DataFrame:
    """Tail of every block: (key, block, levels above it, keep: levels of its own that count, subroot).

    Blocks of keys with one block are done at their natural height; the others'
    roots are the appends of the next storey, which calls this again.
    """
    blocks = checkpoint(blocks)
    alone = blocks.groupBy("key").agg(F.max("block").alias("last")).filter("last = 0").select(F.col("key").alias("_k"))
    mark = blocks.join(alone, F.col("key").eqNullSafe(F.col("_k")), "left_semi")
    done = mark.select("key", "block", F.array().cast(LEVEL_SQL).alias("levels"), F.col("height").alias("keep"), F.col("root").alias("subroot"))
    more = blocks.join(alone, F.col("key").eqNullSafe(F.col("_k")), "left_anti")
    if not more.head(1):
        return done
    grown = grow_nodes(more.select("key", F.col("block").alias("number"), F.col("full").alias("digest")), depth)
    above = finish(_roots(grown, "key"), depth).withColumnRenamed("levels", "_above").withColumnRenamed("block", "_block").withColumnRenamed("key", "_k")
    joined = grown.join(above, F.col("key").eqNullSafe(F.col("_k")) & (F.col("block") == F.col("_block")))
    tails = joined.select("key", F.col("number").alias("block"), F.concat(F.slice("levels", F.lit(1), F.col("keep")), "_above").alias("levels"), F.lit(depth).alias("keep"), "subroot")
    return checkpoint(done.unionByName(tails))


def grow(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Runs of leaves with whole witnesses: doc_ids, leaves, others, levels (above the run), height (0: a lone leaf), subroot, root.

    ``leaves``: source, doc_id, leaf, other. Order: doc_id (null first, equal
    ones by leaf) in its source; sources bytewise, null first.
    """
    runs = grow_leaves(numbered(leaves, "source", ["doc_id", "leaf"]), depth)
    tails = checkpoint(finish(_roots(runs, "source"), depth).withColumnRenamed("levels", "above"))
    tops = checkpoint(tails.select(F.col("key").alias("name"), "subroot").distinct().withColumn("all", F.lit("")))
    nodes = numbered(tops, "all", ["name"])
    grown = grow_nodes(nodes.select(F.col("all").alias("key"), "number", F.col("subroot").alias("digest")), depth)
    ends = finish(_roots(grown, "key"), depth).select(F.col("block").alias("_block"), F.col("levels").alias("_above"), "keep", F.col("subroot").alias("top"))
    last = grown.join(ends, F.col("block") == F.col("_block"))
    last = last.select("number", F.concat(F.slice("levels", F.lit(1), F.col("keep")), "_above").alias("last"), "top")
    named = checkpoint(nodes.select("number", "name").join(last, "number").drop("number"))
    tails = tails.join(named, F.col("key").eqNullSafe(F.col("name"))).withColumnRenamed("block", "_block").drop("name")
    joined = runs.drop("root", "full", "height").join(tails, F.col("source").eqNullSafe(F.col("key")) & (F.col("block") == F.col("_block")))
    # the block's own levels that count, without the one of the run itself
    own = F.slice("levels", F.lit(1), F.greatest(F.col("keep") - 1, F.lit(0)))
    return joined.select("source", "doc_ids", "leaves", "others", F.concat(own, "above", "last").alias("levels"), (F.col("keep") > 0).alias("in_run"), "subroot", F.col("top").alias("root"))


def _leaves(row: dict) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(place in the run, witness as (place, siblings' hex) from the leaf to the root)."""
    above = [(x["place"], x["siblings"].hex()) for x in row["levels"]]
    names = [d.hex() for d in row["leaves"]]
    for i in range(len(names)):
        yield i, ([(i, "".join(names[:i] + names[i + 1 :])), *above] if row["in_run"] else above)


def leaves_of(docs: DataFrame, columns: list[str], changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(source, doc_id, leaf, other): digests of the rows; ``other`` of the row with ``changed`` values, only ``where`` asked for."""
    other = F.when(where, leaf_digest(columns, changed)) if changed else F.lit(None).cast("binary")
    return docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(columns).alias("leaf"), other.alias("other"))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def witnesses(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """doc_id, source, leaf, witness (array of place and siblings, leaf to root), subroot, root: one row per row of ``docs``.

    All digests are hex text. Null values count as ``-``; repeated rows are
    leaves of their own; an empty table has no rows and no root. Columns other
    than ``columns`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = len(row["leaves"])
                path = [[{"place": p, "siblings": [s[k : k + 64] for k in range(0, len(s), 64)]} for p, s in levels] for _, levels in _leaves(row)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["source"]] * n, pa.string()), pa.array([d.hex() for d in row["leaves"]]),
                     pa.array(path, pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))),
                     pa.array([row["subroot"].hex()] * n), pa.array([row["root"].hex()] * n)],
                    ["doc_id", "source", "leaf", "witness", "subroot", "root"],
                )

    grown = grow(checkpoint(leaves_of(docs, columns or COLUMNS)))
    return grown.mapInArrow(run, "doc_id long, source string, leaf string, witness array<struct<place:int,siblings:array<string>>>, subroot string, root string")


def prove(grown: DataFrame) -> DataFrame:
    """Each leaf's proof digest and the root folded from its ``other`` leaf (or its own) with its witness.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), RUNS):
                out = []
                for row in b.slice(start, RUNS).to_pylist():
                    root, subroot = row["root"].hex(), row["subroot"].hex()
                    for i, levels in _leaves(row):
                        proof = hashlib.sha256("".join(s for _, s in levels).encode()).hexdigest()
                        folded = fold(row["others"][i] or row["leaves"][i], levels).hex()
                        out.append((row["doc_ids"][i], row["leaves"][i].hex(), subroot, root, proof, folded, folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return grown.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``prove`` over ``docs``, where every fifth id by crc32 has its text's A-Z lower-cased in ``other``.

    Null ids are never tampered with; a text without capitals stays the same
    and verifies. One row per row of ``docs``; nulls, repeated rows, empty
    tables and other columns as in ``witnesses``.
    """
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return prove(grow(checkpoint(leaves_of(docs, columns or COLUMNS, {"text": lowered}, fifth))))
