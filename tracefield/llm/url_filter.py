"""URL rules decided by Bloom filter cascades.

A cascade holds a key set exactly, relative to a universe: level 1 encodes the
listed keys, level 2 the keys of the universe that level 1 lets pass wrongly,
level 3 the listed keys that level 2 lets pass, and so on until a level lets
nothing pass wrongly. Its universe here is every key that the urls of the whole
corpus can ask for, so asking needs no join and never errs. Building shuffles
distinct key hashes; asking is a scan of the urls.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefield.llm.common import mix
from tracefield.session import checkpoint

#: bits that one filter may have: what is broadcast stays below 32 MB; larger key sets are cut into shards
MAX_BITS = 1 << 28


@dataclass(frozen=True)
class Level:
    """One Bloom filter; ``depth`` turns the hashes, so that one level's errors are no errors of the next."""

    bits: np.ndarray
    n_bits: int
    n_hash: int
    depth: int

    def hits(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for i in range(self.n_hash):
            at = _position(h1, h2, i, self.n_bits, self.depth)
            ok &= (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok


def _position(h1, h2, i, n_bits, depth):
    a = mix(h1.astype(np.int64).view(np.uint64) + np.uint64(depth))
    b = mix(h2.astype(np.int64).view(np.uint64) + np.uint64(depth)) | np.uint64(1)
    return ((a + np.uint64(i) * b) % np.uint64(n_bits)).astype(np.int64)


def member(shards: list[list[Level]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed; keys are dealt to the shards by h1.

    The level that first says no decides, by its parity.
    """
    out = np.zeros(len(h1), bool)
    dealt = h1 % len(shards)
    for s, levels in enumerate(shards):
        left = np.flatnonzero(dealt == s)
        for depth, level in enumerate(levels):
            ok = level.hits(h1[left], h2[left])
            out[left[~ok]] = depth % 2 == 1
            left = left[ok]
        out[left] = len(levels) % 2 == 1
    return out


def bloom(keys: DataFrame, n: int, rate: float, depth: int) -> Level:
    """One Bloom filter over distinct (h1, h2); words of bits are or-ed by a shuffle, the driver sees n_bits / 64 of them."""
    n_bits = max(64, min(MAX_BITS, math.ceil(-n * math.log(rate) / math.log(2) ** 2)))
    n_hash = max(1, round(n_bits / n * math.log(2)))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.concatenate([_position(b["h1"].to_numpy(), b["h2"].to_numpy(), i, n_bits, depth) for i in range(n_hash)])
            at = np.unique(at)
            word = at >> 6
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
            yield pd.DataFrame({"word": word[first], "value": value.view(np.int64)})

    out = np.zeros((n_bits + 63) // 64, np.uint64)
    for r in keys.mapInPandas(bits, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toLocalIterator():
        out[r["word"]] = np.int64(r["value"]).view(np.uint64)
    return Level(out, n_bits, n_hash, depth)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[level.hits(b["h1"].to_numpy(), b["h2"].to_numpy())]

    return keys.mapInPandas(keep, keys.schema)


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> list[Level]:
    """Cascade of ``listed`` (distinct h1, h2), exact for the keys of ``universe`` (distinct h1, h2).

    Level 1 has the rate n / (universe * sqrt 2), later ones 1/2, the known
    choice for least total size. Every set shrinks by the rate of a level, so a
    few dozen levels do for any input; equal hashes of 128 bits count as equal keys.
    """
    n, size = listed.count(), universe.count()
    if not n:
        return []
    levels: list[Level] = []
    inside, outside, count = listed, universe.join(listed, ["h1", "h2"], "left_anti"), n
    for depth in range(max_levels):
        rate = min(0.5, n / (max(1, size) * math.sqrt(2))) if depth == 0 else 0.5
        level = bloom(inside, count, rate, depth)
        levels.append(level)
        wrong = checkpoint(_passing(outside, level))
        count = wrong.count()
        if not count:
            return levels
        inside, outside = wrong, inside
    raise RuntimeError("the cascade did not end; its keys are not distinct")


def url_parts(url) -> tuple:
    """(host, path) of a url: host after the first ``://``, A-Z lower-cased; path up to ``?`` or ``#``.

    Null, or no ``://``: both empty.
    """
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (or null) and verdict (``allow`` or ``block``).

    ``rules``: (host, path, action). A rule fits its host and all subdomains
    where the path starts with the rule's; the longest wins, the longer host
    among equally long ones, block where both actions have the same rule. No
    rule: ``default``. Null ids stay null, repeated pages give a row each, an
    empty table an empty result; other columns of ``pages`` are ignored.

    Only shapes of the rule list reach the driver: the label counts of hosts,
    the lengths of paths and the bits of the filters.
    """
    shape = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).agg(F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("length"))).first()
    labels, lengths = (shape[0] or []), (shape[1] or [])
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_u"))
    host, path = url_parts("_u")
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    parts = F.split("host", r"\.")
    keys = F.array(*[
        F.struct(
            F.when((F.size(parts) >= c) & (F.length("path") >= n), F.concat(F.substring_index("host", ".", -c), F.substring("path", 1, n))).alias("key"),
            F.lit(c).alias("labels"),
        )
        for c in labels for n in lengths
    ]) if labels else F.array().cast("array<struct<key:string,labels:int>>")
    keys = F.filter(keys, lambda k: k["key"].isNotNull())
    hashed = lambda k: [F.xxhash64(k, F.lit(11)).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2")]
    asked = base.withColumn("keys", F.transform(keys, lambda k: F.struct(k["key"].alias("key"), k["labels"].alias("labels"), *hashed(k["key"]))))
    universe = checkpoint(asked.select(F.explode("keys").alias("k")).select("k.h1", "k.h2").distinct())
    cascades = {}
    for action in ("allow", "block"):
        listed = rules.filter(F.col("action") == action).select(*hashed(F.concat("host", "path"))).distinct()
        shards = max(1, math.ceil(listed.count() * 32 / MAX_BITS))
        pick = lambda df, s, n=shards: df.filter(F.pmod("h1", F.lit(n)) == s) if n > 1 else df
        cascades[action] = [build_cascade(checkpoint(pick(listed, s)), pick(universe, s)) for s in range(shards)]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("keys")
            flat = col.flatten()
            key, n_labels = flat.field("key"), flat.field("labels").to_numpy(zero_copy_only=False)
            h1, h2 = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("h1", "h2"))
            row = np.repeat(np.arange(len(b)), np.asarray(pc.list_value_length(col)))
            found = {a: member(cascades[a], h1, h2) for a in cascades}
            hit = np.flatnonzero(found["allow"] | found["block"])
            length = np.asarray(pc.utf8_length(key), np.int64)[hit] if len(hit) else np.zeros(0, np.int64)
            order = hit[np.lexsort((n_labels[hit], length, row[hit]))]
            best = order[np.flatnonzero(np.r_[row[order][1:] != row[order][:-1], True])] if len(order) else order
            at = np.full(len(b), -1)
            at[row[best]] = best
            verdict = np.full(len(b), default, object)
            verdict[row[best]] = np.where(found["block"][best], "block", "allow")
            take = pa.array(np.where(at < 0, 0, at), mask=at < 0)
            rule = key.take(take) if len(key) else pa.nulls(len(b), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), rule, pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return asked.mapInArrow(decide, f"page_id {kind}, host string, path string, rule string, verdict string")
