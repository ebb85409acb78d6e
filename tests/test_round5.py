"""Small cases of this round: empty files as units and sectors, plain stripes that look like parity, models fitted on distinct rows, narrow histories."""

import random

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracefield.catalog import strategy as cs
from tracefield.operators import imaging as im
from tracefield.operators import learning as ln
from tracefield.operators import raid as rd
from tracefield.operators import strategy as st
from tracefield.sources import records as rc


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    """A folder whose documents are empty, null, or end at the edge of a unit."""
    texts = ["", None, "a", "x" * 255, "x" * 256, "x" * 257, "y" * 512, "y" * 513, "a\0b", "", "z" * 1024, "é" * 700]
    rows = [(i, texts[i % len(texts)], "en", "s", 0) for i in range(len(texts) * 3)]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["s5_read_sectors", "r6_raid0", "r7_raid1", "r8_raid5_left", "r8_raid5_right", "r9_raid6", "r10_raid10"])
def test_empty_files_are_a_unit_of_zeros(spark, odd_texts, name):
    con = compare.duckdb.connect()
    con.execute(f"create view documents as select * from '{odd_texts}/documents.parquet/*.parquet'")
    msg, ok = compare.compare(spark, con, odd_texts, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, msg


def test_sectors_of_empty_and_missing_images(spark):
    images = spark.createDataFrame([(0, b""), (1, None), (2, b"abc"), (3, b"abcd"), (4, b"abcde")], "file_id int, data binary")
    got = {(r.file_id, r.sector): bytes(r.bytes) for r in im.read_sectors(images, "file_id", 4).collect()}
    assert got == {(0, 0): bytes(4), (2, 0): b"abc\0", (3, 0): b"abcd", (4, 0): b"abcd", (4, 1): b"e\0\0\0"}


def test_plain_stripes_that_cancel_out_are_no_parity(spark):
    """Units of repeated text cancel out like parity; that the last stripe is short shows that they are plain."""
    text = random.Random(3).randbytes(60)
    unit = lambda i: bytearray(i.to_bytes(4, "big") + text)
    rows = [("plain", i % 4, i // 4, unit(i)) for i in range(10)] + [("short", i % 4, i // 4, unit(i)) for i in range(6)] + [("five", i % 4, i // 4, unit(i)) for i in range(12)]
    s = spark.createDataFrame(rows, "array_id string, disk int, stripe_no long, data binary")
    got = {r.array_id: r.level for r in rd.raid_level(s.withColumnRenamed("stripe_no", "block_no"), s).collect()}
    assert got == {"plain": "RAID0", "short": "UNKNOWN", "five": "RAID5"}


def test_history_is_each_newest_row(spark):
    """One aggregation gives what the two newest tables and their join give."""
    d = "/root/testdata/sf0.001"
    apart = cs.vecs(spark, d).select("scenario_id", "vec").join(cs.outcomes(spark, d).select("scenario_id", "success", "tool"), "scenario_id")
    got, want = cs.history(spark, d), apart.select("scenario_id", "vec", "success", "tool")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # orders only


def test_long_histories_are_fitted_on_distinct_rows(spark, monkeypatch):
    """600 outcomes of six kinds: the fit and the prediction go over six rows, with the same tools."""
    rows = [(i, [float(i % 6), 1.0], i % 6 != 5, f"tool{i % 3}") for i in range(600)]
    h = spark.createDataFrame(rows, "scenario_id long, vec array<float>, success boolean, tool string")
    counts, write = [], ln.checkpoint

    def counted(df):
        out = write(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(ln, "checkpoint", counted)
    model = ln.train_strategy_model(h, trees=40, depth=4, fold_above=500)
    got = {r.scenario_id: r.predicted for r in ln.predict_strategy(model, h).collect()}
    assert counts == [6, 6]
    assert got == {i: f"tool{i % 3}" for i in range(600) if i % 6 != 5}
    assert ln.train_strategy_model(h.limit(9), fold_above=500) is None


def test_history_files_are_compressed_and_narrow(spark, tmp_path):
    """Files are compressed and read back whole; only the wanted columns are carried to the newest row."""
    runs = spark.createDataFrame([(i % 7, i, f"t{i}", i % 2 == 0, "x" * 50) for i in range(30)], "scenario_id long, at int, tool string, success boolean, note string")
    newest = st.latest(runs, "scenario_id", ["at"], ["tool", "success"])
    assert newest.columns == ["scenario_id", "tool", "success"] and "note" not in newest._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, st.latest(runs, "scenario_id", ["at"]).select(*newest.columns).collect()))
    rc.write_history(newest.select("scenario_id", F.col("tool").alias("container_format")), newest.select("scenario_id", "success"), str(tmp_path))
    written = [p.name for p in tmp_path.glob("*/part-*")]
    assert written and all(name.endswith(".gz") for name in written)
    s, o = rc.read_history(spark, str(tmp_path), per_line=True, columns=["container_format", "success"])
    back = s.join(o, "scenario_id").select(F.col("scenario_id").cast("long"), "container_format", "success")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, newest.collect()))
