"""No cap or size switch drops anything: long lists, deep graphs, long frames, gaps, hostile nesting."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tracefield.operators import carving as cv
from tracefield.operators import container as ct
from tracefield.operators import dedup as dd
from tracefield.operators import graph as gr
from tracefield.operators import imaging as im
from tracefield.operators import ordered as od
from tracefield.operators import raid as rd
from tracefield.session import small_table
from tracefield.sources import filesets
from tracefield.sources import records as rc
from tracefield.sources import signatures as sg


def image(spark, chunks):
    """Chunks from (offset, bytes)."""
    return spark.createDataFrame([("i", n, at, bytearray(b)) for n, (at, b) in enumerate(chunks)], "image_id string, chunk_no long, base_offset long, data binary")


def test_long_signature_list_over_edges_and_long_headers(spark):
    rng = random.Random(5)
    data = bytes(rng.randrange(97, 105) for _ in range(6000))
    heads = {bytes(rng.randrange(97, 105) for _ in range(4)) for _ in range(5000)} | {data[1000:1150], data[2490:2600], data[995:1005]}
    sigs = sg.signatures_of(spark, [(h.hex(), "", h.hex(), "", 9, 0) for h in heads])
    want = sorted((h.hex(), i) for h in heads for i in range(len(data) - len(h) + 1) if data.startswith(h, i))
    for step in (500, 64):
        chunks = image(spark, [(i, data[i : i + step]) for i in range(0, len(data), step)])
        got = sorted((r["name"], r["offset"]) for r in cv.match_signatures(chunks, sigs).collect())
        assert got == want


def test_nothing_is_found_across_a_missing_chunk(spark):
    sigs = sg.signatures_of(spark, [("A", "", b"abcd".hex(), "", 9, 0)])
    whole = [(0, b"..ab"), (4, b"cd.."), (8, b"abcd")]
    assert cv.match_signatures(image(spark, whole), sigs).count() == 2
    assert [r["offset"] for r in cv.match_signatures(image(spark, [whole[0], (6, b"cd.."), (10, b"abcd")]), sigs).collect()] == [10]


def test_frames_longer_than_a_block(spark):
    df = spark.range(200).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    got = od.rows_frame_sum(df, ["k"], ["t"], F.floor(F.col("t") / 50), F.col("v"), 40, "s", block=16)
    assert all(r["s"] == min(40, r["t"] + 1) for r in got.collect())


def test_range_counts_keep_equal_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 5, None), ("b", 5, "y")], "k string, t long, note string")
    got = sorted((r["k"], r["t"], r["n"]) for r in od.range_count(df, ["k"], F.col("t"), 5, "n").collect())
    assert got == [("a", 1, 2), ("a", 1, 2), ("a", 5, 3), ("b", 5, 1)]


def test_deep_graphs(spark):
    edges = spark.range(40).select(F.format_string("n%02d", "id").alias("from_addr"), F.format_string("n%02d", F.col("id") + 1).alias("to_addr"))
    assert gr.shortest_path(edges, "n00", "n40").first()["hops"] == 40
    assert gr.shortest_path(edges, "n40", "n00").count() == 0
    items = spark.range(71).select(F.col("id").alias("item"))
    links = spark.range(70).select(F.col("id").alias("item"), (F.col("id") + 1).alias("needs"))
    assert gr.dependency_closure(items, links).count() == 71 * 72 // 2
    assert gr.dependency_closure(items, links, items.filter("item = 65")).count() == 6


def test_dependency_closure_by_levels(spark, monkeypatch):
    """Cycles, depth beyond the levels, missing items: as walked; without cycles no pair is found twice by doubling."""
    rng = random.Random(4)
    links = [(a, rng.randrange(a)) for a in range(1, 60) for _ in range(2)] + [(a, 100 + a) for a in range(0, 60, 7)] + [(3, 9), (60, 60)]
    for edges, levels in ((links, 32), ([e for e in links if e != (3, 9)], 3), ([e for e in links if e != (3, 9)], 32)):
        want = set()
        for root in range(61):
            todo, seen = [root], {root}
            while todo:
                at = todo.pop()
                new = {b for a, b in edges if a == at} - seen
                seen |= new
                todo += new
            want |= {(root, x, x < 61) for x in seen}
        if levels == 32 and (3, 9) not in edges:
            monkeypatch.setattr(gr, "_pairs", None)
        items = spark.createDataFrame([(i,) for i in range(61)], "item long")
        got = [tuple(r) for r in gr.full_closure(spark.createDataFrame(edges, "item long, needs long"), items, levels).select("root", "item", "known").collect()]
        assert len(got) == len(want) and set(got) == want



def test_process_trees_deep_self_parented_and_cyclic(spark):
    rows = [(0, 0)] + [(i, i - 1) for i in range(1, 140)] + [(500, 999), (501, 500), (600, 601), (601, 600), (602, 601)]
    got = {r["pid"]: (r["depth"], r["path"]) for r in gr.process_tree(spark.createDataFrame(rows, "pid long, ppid long")).collect()}
    assert len(got) == len(rows)
    assert got[139] == (139, list(range(140))) and got[0] == (0, [0]) and got[501] == (1, [500, 501])
    assert got[600] == got[601] == got[602] == (None, None)


def test_hash_roots_fold_to_one(spark):
    chunks = image(spark, [(i, bytes([i])) for i in range(100)])
    assert im.hash_root(chunks, 4, 1).count() == 1


def test_long_rule_lists_are_tables(spark):
    assert small_table(spark, [(i,) for i in range(10_001)], "i int").count() == 10_001


def test_near_duplicates_chain(spark):
    rng = random.Random(1)
    rows = []
    for chain in range(8):  # K-A and A-B alike, K-B not
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for step in range(3):
            rows.append((len(rows), " ".join(words)))
            for _ in range(2):
                words[rng.randrange(300)] = f"w{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "id long, text string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(298)} for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.95 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    got = {r["id"]: r["group"] for r in dd.near_duplicates(df, "id", "text", 0.95).collect()}
    assert all(got.get(i, i) == top(i) for i in range(len(rows)))


def test_lost_stripes_show(spark):
    s = spark.createDataFrame([("a", d, n, bytearray([d + n])) for n in (0, 2) for d in range(3)], "array_id string, disk int, stripe_no long, data binary")
    out = rd.raid5(s, 3)
    assert out.count() == 6 and out.filter("data is null").count() == 2
    c = rd.rebuild_confidence(out).first()
    assert (c["recovered"], c["failed"]) == (4, 2)
    assert rd.raid1(s, spark.createDataFrame([("a", 0, 1)], "array_id string, disk int, bad_sectors int")).filter("data is null").count() == 1


def test_double_parity_is_told_from_single(spark):
    rng = random.Random(2)
    a, b = rng.randbytes(64), rng.randbytes(64)
    p = bytes(x ^ y for x, y in zip(a, b))
    q = bytes(x ^ ((y << 1) ^ (0x11D if y & 0x80 else 0)) & 0xFF for x, y in zip(a, b))
    rows = [("six", d, 0, bytearray(u)) for d, u in enumerate((p, q, a, b))] + [("five", d, 0, bytearray(u)) for d, u in enumerate((a, b, bytes(64), p))]
    s = spark.createDataFrame(rows, "array_id string, disk int, stripe_no long, data binary")
    got = {r["array_id"]: r["level"] for r in rd.raid_level(s.withColumnRenamed("stripe_no", "block_no"), s).collect()}
    assert got == {"six": "RAID6", "five": "RAID5"}


def test_deep_nesting_of_atoms():
    d = b""
    for _ in range(3000):
        d = struct.pack(">I", len(d) + 8) + b"moov" + d
    got = list(ct.walk_atoms(d, 0, len(d)))
    assert len(got) == 3000 and got[-1][4] == 2999 and got[0][1] == 0


def test_exported_files_of_two_images(spark, tmp_path):
    t = spark.createDataFrame([("x", "a.jpg", bytearray(b"1")), ("y", "a.jpg", bytearray(b"2"))], "image_id string, file_name string, content binary")
    rc.export_files(t, str(tmp_path))
    assert sorted((p.parent.name, p.read_bytes()) for p in tmp_path.rglob("*.jpg")) == [("x", b"1"), ("y", b"2")]


def test_files_appear_only_by_a_commit(spark, tmp_path):
    """Pieces in any order make whole files; what a lost attempt left goes; a failed write leaves no file."""
    rng = random.Random(6)
    whole = {("i", f"f{k}"): rng.randbytes(rng.choice([1, 10, 5000])) for k in range(40)} | {("j/x", "f0"): b"other", ("i", "empty"): b""}
    rows = [(d, n, at, bytearray(b[at : at + 700])) for (d, n), b in whole.items() for at in range(0, max(1, len(b)), 700)]
    rng.shuffle(rows)
    out = tmp_path / "out"
    lost = out / "_attempts/dead"
    lost.mkdir(parents=True)
    (lost / "00000000").write_bytes(b"half")
    (lost / "index.json").write_text('{"folder": "i", "file_name": "half", "file": "00000000", "attempt": "dead"}\n')
    schema = "folder string, file_name string, at bigint, piece binary"
    filesets.write_files(spark.createDataFrame(rows, schema).repartition(5), str(out))
    found = lambda: {(p.parent.name, p.name): p.read_bytes() for p in out.rglob("*") if p.is_file()}
    assert found() == {(d.replace("/", "_"), n): b for (d, n), b in whole.items()}
    filesets.publish(spark, str(out))
    with pytest.raises(Exception, match="a piece at 5 where 1 bytes are written"):
        filesets.write_files(spark.createDataFrame([("i", "bad", 0, bytearray(b"1")), ("i", "bad", 5, bytearray(b"2"))], schema), str(out))
    assert not any(p.name == "bad" for p in out.rglob("*"))
