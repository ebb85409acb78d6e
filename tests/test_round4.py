"""Small cases of this round: boot serials, index ends, spikes at their limit, bytes moved and rows read once, many small files."""

import datetime as dt
import hashlib
import random
import struct

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracefield.operators import fsmeta as fs
from tracefield.operators import imaging as im
from tracefield.operators import jobs as jb
from tracefield.operators import learning as ln
from tracefield.operators import txgraph as tg
from tracefield.sources import filesets
from tracefield.sources import image as src


def test_ntfs_serial_has_eight_bytes(spark):
    b = bytearray(512)
    b[3:11] = b"NTFS    "
    struct.pack_into("<HB", b, 0x0B, 512, 8)
    struct.pack_into("<Q", b, 0x48, 65537 * 70000 + 1)
    r = fs.ntfs_boot(spark.createDataFrame([("v", b)], "id string, data binary"), "id").first()
    assert int(r.serial) == 65537 * 70000 + 1


def walked(rows, size, header):
    """The definition, row by row."""
    now, out = header, []
    for slot, offset, n in rows:
        n = n or jb.MIB
        at = now if offset < now or offset >= size else offset
        n = min(n, size - at)
        out.append((slot, at, n))
        now = at + n
    return out


@pytest.mark.parametrize("size", [-20, 0, 30, 39, 40, 41, 95, 1000])
def test_index_repair_of_files_around_their_header(spark, size):
    rows = [(20, 20, 20), (55, -5, 35), (90, 90, 35), (120, 120, 30)]
    index = spark.createDataFrame([("f", *r) for r in rows], "file_id string, slot bigint, offset bigint, size bigint")
    sizes = spark.createDataFrame([("f", size)], "file_id string, file_size bigint")
    got = jb.index_repair(index, sizes, "slot", F.lit(40).cast("bigint"), 32).orderBy("slot")
    assert [(r.slot, r.new_offset, r.new_size) for r in got.collect()] == walked(rows, size, 40)


def test_a_day_at_the_limit_is_no_spike(spark):
    """A value of n over c - 1 equal ones lies sqrt(c - 1) deviations off; in floating point it may seem above."""
    start = dt.datetime(2020, 1, 1)
    rows, cases = [], [(base, top) for base in range(1, 5) for top in range(base + 1, base + 5)]
    for i, (base, top) in enumerate(cases):
        for day in range(10):  # 9 days of base, one of top: 3 deviations exactly
            rows += [(f"A{i}", f"B{i}", start + dt.timedelta(days=day))] * (top if day == 4 else base)
    edges = spark.createDataFrame(rows, "from_addr string, to_addr string, ts timestamp").withColumn("tx_id", F.monotonically_increasing_id()).withColumn("value", F.lit(1.0))
    assert tg.activity_spikes(edges, 3.0).count() == 0
    got = tg.activity_spikes(edges, 2.999).collect()
    assert sorted((r.addr, r.n) for r in got) == sorted((f"{s}{i}", top) for i, (_, top) in enumerate(cases) for s in "AB")


def shuffled(spark):
    g = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_equal_chains_are_gathered_once(spark):
    rng = random.Random(0)
    cells = {i: bytearray(rng.randbytes(20_000)) for i in range(6)}
    clusters = spark.createDataFrame(list(cells.items()), "cluster_no int, data binary")
    chains = [[0, 3, 1], [5, 5], [9, 2], [9], [], None]
    files = spark.createDataFrame([(i, chains[i % 6]) for i in range(300)], "id int, chain array<int>")
    before = shuffled(spark)
    got = {r.id: r.content for r in im.read_clusters(files, "id", "chain", clusters).select("id", F.md5("content").alias("content")).collect()}
    want = {i: b"".join(bytes(cells[c]) for c in chains[i % 6] if c in cells) for i in range(300) if chains[i % 6] and chains[i % 6] != [9]}
    assert got == {i: hashlib.md5(x).hexdigest() for i, x in want.items()}
    assert shuffled(spark) - before < 1_000_000  # 6 MB if each file carried its bytes


def test_small_files_share_partitions(spark, tmp_path):
    want = set()
    for i in range(200):
        body = bytes([i]) * (i * 20)
        (tmp_path / f"{i}.img").write_bytes(body)
        want |= {(f"{i}.img", n, n * 1024, min(1024, len(body) - n * 1024), body[n * 1024 : n * 1024 + 1030]) for n in range(-(-len(body) // 1024))}
    img = src.read_image(spark, str(tmp_path), 1024, 6)
    assert img.rdd.getNumPartitions() <= 64
    assert {(r.image_id.rsplit("/", 1)[1], r.chunk_no, r.base_offset, r.length, bytes(r.data)) for r in img.collect()} == want


def test_a_large_file_is_dealt_over_partitions(spark, tmp_path):
    (tmp_path / "a.img").write_bytes(bytes(range(256)) * 40_000)
    img = src.read_image(spark, str(tmp_path / "a.img"), 4096)
    assert img.rdd.getNumPartitions() == 10
    assert img.agg(F.sum("length")).first()[0] == 256 * 40_000


def test_heads_of_named_files(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [("i/j", "a b_1.x", 0, bytearray(b"abc")), ("i/j", "a b_1.x", 3, bytearray(b"de")), ("k", "e", 0, bytearray(b""))]
    pieces = spark.createDataFrame(rows, filesets.PIECE_SCHEMA)
    filesets.write_files(pieces, out)
    got = {(r.path.rsplit("/", 2)[1:][0], r.path.rsplit("/", 1)[1], r.length, bytes(r.head)) for r in filesets.read_heads(pieces.select("folder", "file_name"), out, 2).collect()}
    assert got == {("i_j", "a%20b_1.x", 5, b"ab"), ("k", "e", 0, b"")}
    with pytest.raises(Exception, match="gone"):
        filesets.read_heads(spark.createDataFrame([("k", "gone")], "folder string, file_name string"), out, 2).collect()


def test_a_fit_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(i):
        read.add(1)
        return True

    rows = spark.range(400).withColumn("success", seen("id")).select(
        F.col("id").alias("scenario_id"), F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("vec"), "success", F.concat(F.lit("t"), F.col("id") % 3).alias("tool"))
    assert ln.train_strategy_model(rows, trees=2, depth=2) is not None
    assert read.value == 400
    read.value = 0
    features = rows.select("success", "tool", array_to_vector("vec").alias("raw")).withColumn("tool", F.when(F.col("success"), F.col("tool")))
    ln.train_classifier(features, "tool", trees=2, depth=2, folds=0)
    assert read.value == 400
