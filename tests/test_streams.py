"""Streams over several batches equal their batch definition."""

import random

import pytest
from pyspark.sql import functions as F

from tracefield.operators import carving as cv
from tracefield.operators import learning as ln
from tracefield.sources import image as src
from tracefield.sources import signatures as sg
from tracefield.streaming import live as lv
from tracefield.streaming.images import GrowingImages


def stream_of(spark, tmp_path, rows, schema, parts):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] if parts == 1 else rows[len(rows) * i // parts : len(rows) * (i + 1) // parts], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_rate_limit_across_batches(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", h * 60 + m, u) for h in range(6) for m in range(0, 60, 7) for u in (1, 2)]
    df = stream_of(spark, tmp_path, rows, "ts string, request_id bigint, user_id bigint", 4).withColumn("ts", F.to_timestamp("ts"))
    out = spark.read.parquet(lv.run_available(lv.stream_rate_limit(df, 3)))
    got = {(r.user_id, r.request_id): r.accepted for r in out.collect()}
    kept, want = {1: [], 2: []}, {}
    for _, t, u in sorted(rows, key=lambda r: r[1]):
        kept[u] = [x for x in kept[u] if t - x < 60]
        want[(u, t)] = len(kept[u]) < 3
        if want[(u, t)]:
            kept[u].append(t)
    assert got == want and not all(want.values())


def test_alert_needs_the_whole_duration(spark, tmp_path):
    vals = [95, 96, 97, 10, 99, 99, 99, 99]
    rows = [(f"2024-01-01 00:0{i}:00", "cpu", "host", float(v)) for i, v in enumerate(vals)]
    df = stream_of(spark, tmp_path, rows, "ts string, metric string, subject string, value double", 3).withColumn("ts", F.to_timestamp("ts"))
    rules = spark.createDataFrame([("r", "cpu", ">", 90.0, 120)], "rule_id string, metric string, op string, threshold double, duration int")
    out = spark.read.parquet(lv.run_available(lv.alert_rules(df, rules))).orderBy("fired_us").collect()
    t0 = out[0].started_us
    assert [((r.started_us - t0) // 60_000_000, (r.fired_us - t0) // 60_000_000) for r in out] == [(0, 2), (4, 6)]


def watched(spark, tmp_path, rows, parts, **more):
    df = stream_of(spark, tmp_path, rows, "ts string, metric string, subject string, value double", parts).withColumn("ts", F.to_timestamp("ts"))
    rules = spark.createDataFrame([("r", "cpu", ">", 90.0, 120)], "rule_id string, metric string, op string, threshold double, duration int")
    return lv.alert_rules(df, rules, **more)


def states(stream, tmp_path, mode="append"):
    """Rows written, and state rows after the last batch."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True)
    query = query.format("parquet").option("path", str(tmp_path / "out")).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / "out")), [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]


def test_alert_fires_without_a_further_row_and_its_state_goes(spark, tmp_path):
    """Host a holds and falls silent, b breaks too early, c is asked late; other hosts move the time on."""
    rows = [("2024-01-01 00:00:00", "cpu", "a", 95.0), ("2024-01-01 00:00:00", "cpu", "b", 95.0), ("2024-01-01 00:01:30", "cpu", "b", 10.0)]
    rows += [("2024-01-01 06:00:00", "cpu", "x", 1.0), ("2024-01-01 12:00:00", "cpu", "x", 1.0), ("2024-01-01 18:00:00", "cpu", "x", 1.0)]
    out, kept = states(watched(spark, tmp_path, rows, 4, forget=3600), tmp_path)
    got = [(r.subject, r.fired_us - r.started_us) for r in out.collect()]
    assert got == [("a", 120_000_000)]
    assert max(kept) > 0 and kept[-1] == 0


def test_alerts_do_not_depend_on_the_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", "cpu", f"h{m % 2}", float(rng.choice([10, 95, 96, 97]))) for m in range(300)]
    want = None
    for parts in (1, 3, 7):
        folder = tmp_path / str(parts)
        got = sorted(map(tuple, spark.read.parquet(lv.run_available(watched(spark, folder, rows, parts))).collect()))
        want = want or got
        assert got == want and len(got) > 20


def test_idle_users_are_forgotten(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", i, 1) for i in range(5)] + [(f"2024-01-01 {h:02d}:00:00", 10 + h, 2) for h in range(1, 12)]
    df = stream_of(spark, tmp_path, rows, "ts string, request_id bigint, user_id bigint", 8).withColumn("ts", F.to_timestamp("ts"))
    out, kept = states(lv.stream_rate_limit(df, 3), tmp_path)
    got = {(r.user_id, r.request_id): r.accepted for r in out.collect()}
    assert sum(got[1, i] for i in range(5)) == 3 and all(v for (u, _), v in got.items() if u == 2)
    assert max(kept) == 2 and kept[-1] == 1  # the last user only


def test_error_counts_forget_past_windows(spark, tmp_path):
    rows = [(f"2024-01-{1 + i // 10:02d} {i % 10:02d}:00:00", f"c{i % 3}", "m", "x") for i in range(60)]
    df = stream_of(spark, tmp_path, rows, "ts string, code string, message string, context string", 6).withColumn("ts", F.to_timestamp("ts"))
    folder = str(tmp_path / "state")
    stream = lv.stream_error_counts(df)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).foreachBatch(lv.append_batches(folder)).start()
    query.awaitTermination()
    assert {r.code: (r.occurrences, str(r.last_seen)) for r in lv.error_history(spark, folder).collect()} == {f"c{k}": (20, f"2024-01-06 0{7 + k}:00:00") for k in range(3)}
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def test_error_counts_in_update_mode(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", f"c{i % 3}", "m", "x") for i in range(30)]
    df = stream_of(spark, tmp_path, rows, "ts string, code string, message string, context string", 5).withColumn("ts", F.to_timestamp("ts"))
    folder = str(tmp_path / "state")
    lv.run_available(lv.stream_error_counts(df), batch=lv.append_batches(folder), mode="update")
    got = {r.code: r.occurrences for r in lv.latest_state(spark, folder, ["code", "message", "context"]).collect()}
    assert got == {"c0": 10, "c1": 10, "c2": 10}


SIGS = [("A", "", b"<a>".hex(), b"</a>".hex(), 60, 3), ("B", "", b"<b".hex(), "", 7, 0), ("C", "", b"<cc>".hex(), b"!".hex(), 2, 0), ("D", "", b"<a".hex(), b">".hex(), 30, 5)]


@pytest.mark.parametrize("mode, order", [("first", "forward"), ("first", "mixed"), ("last", "backward")])
def test_image_in_three_batches_is_carved_as_in_one(spark, tmp_path, mode, order):
    rng = random.Random(3)
    data = "".join(rng.choice(["<a>", "</a>", "<b", "<cc>", "!", ">", "xyz", "-"]) for _ in range(300)).encode()
    rows, at = [], 0
    while at < len(data):
        n = rng.choice([1, 2, 5, 40])
        rows.append(("one", at, at, bytearray(data[at : at + n])))
        at += n
    rows += [("two", 0, 0, bytearray(b"<a>..")), ("two", 5, 5, bytearray(b"..</")), ("two", 9, 9, bytearray(b"a>")), ("gap", 7, 7, bytearray(b"<a>xx</a>"))]
    schema = "image_id string, chunk_no bigint, base_offset bigint, data binary"
    sigs = sg.signatures_of(spark, SIGS)
    want = sorted(map(tuple, cv.carve(spark.createDataFrame(rows, schema), sigs, mode, span=64).collect()))
    if order == "backward":
        rows = rows[::-1]
    elif order == "mixed":
        rng.shuffle(rows)
    growing = GrowingImages(spark, sigs, str(tmp_path / "state"), mode, span=64)
    lv.run_available(stream_of(spark, tmp_path, rows, schema, 3), batch=growing.step())
    early = spark.read.parquet(str(tmp_path / "state/carved")).count()
    assert sorted(map(tuple, growing.finish().collect())) == want and len(want) > 100
    assert early > 50 if order == "forward" else True


def test_file_that_grows_is_read_once(spark, tmp_path):
    data = random.Random(4).randbytes(1000)
    (tmp_path / "img").mkdir()
    got = []
    stream = src.stream_image(spark, str(tmp_path / "img"), 128)
    for size in (100, 100, 612, 1000):
        (tmp_path / "img/a").write_bytes(data[:size])
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "o")).foreachBatch(lambda df, i: got.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    assert b"".join(bytes(r.data) for r in sorted(got, key=lambda r: r.base_offset)) == data
    assert sorted(r.base_offset for r in got) == [0, 100, 128, 256, 384, 512, 612, 640, 768, 896]


def test_model_is_fitted_anew_at_every_fiftieth_outcome(spark, tmp_path):
    """120 outcomes in batches of 40: models at 80 and 120, none at 40; a repeated batch changes nothing."""
    rows = [(i, [i % 2, i % 5, 1], i % 7 != 0, "a" if i % 2 else "b") for i in range(120)]
    schema = "scenario_id bigint, vec array<int>, success boolean, tool string"
    cycle = ln.ModelLifeCycle(spark, str(tmp_path / "cycle"), trees=5, depth=3)
    assert cycle.latest() is None
    seen = []

    def step(df, batch):
        cycle.step(df, batch)
        cycle.step(df, batch)
        seen.append(list(cycle.versions()))

    lv.run_available(stream_of(spark, tmp_path, rows, schema, 3), batch=step)
    assert seen == [[], [80], [80, 120]]
    got = ln.predict_strategy(cycle.latest(), spark.createDataFrame([(1, [1, 1, 1]), (2, [0, 2, 1])], "scenario_id bigint, vec array<int>")).collect()
    assert {r.scenario_id: r.predicted for r in got} == {1: "a", 2: "b"}
