"""Steps whose cost must follow the bytes, not the number of rows, files or rounds."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracefield.catalog import live
from tracefield.operators import carving as cv
from tracefield.operators import container as ct
from tracefield.sources import image as im
from tracefield.sources import records as rc


@pytest.mark.parametrize("count", [5, 80])
def test_short_rows_are_searched_together(monkeypatch, count):
    """The same hits as row by row, none over the seam of two rows, in a few searches."""
    rng = random.Random(count)
    patterns = sorted({bytes(rng.choices(b"ab<", k=rng.choice([1, 2, 3, 7]))) for _ in range(count)})
    rows = [bytes(rng.choices(b"ab<", k=rng.choice([0, 1, 2, 9, 40]))) for _ in range(500)] + [b"ab<" * 100_000, b"", b"<"]
    whole = lambda hits: [sorted(zip(*map(list, h), strict=True)) for h in hits]
    want = whole(cv.find_all(r, patterns) for r in rows)
    searches, plain = [], cv.finder
    monkeypatch.setattr(cv, "finder", lambda p: lambda d: searches.append(len(d)) or plain(p)(d))
    got = cv.scan_udf(patterns).func(pd.Series(rows))
    assert whole(zip(got["pid"], got["pos"], strict=True)) == want and sum(map(len, want)) > 1000
    assert len(searches) < 10


def test_growing_image_arrives_in_files_for_every_core(spark, monkeypatch):
    """A batch is several files: one row group each would leave a batch to one task."""
    seen = []
    monkeypatch.setattr(live.GrowingImages, "_step", lambda self, chunks, batch: seen.append(chunks.select(F.input_file_name()).distinct().count()))
    monkeypatch.setattr(live.GrowingImages, "finish", lambda self: None)
    live.t10(spark, "/root/testdata/sf0.1")
    assert len(seen) == 5 and min(seen) > 1, seen


def test_history_lines_are_parsed_once(spark, tmp_path):
    """One from_json a table in the plan, of the wanted fields; empty and broken lines give no rows."""
    (tmp_path / "scenarios").write_text('{"1": {"container_format": "mp4", "width": 4, "timestamp": "2024-01-01T00:00:00"}, "2": {}}\n{}\nbroken\n\n{"3": {"width": 7}}\n')
    (tmp_path / "outcomes").write_text('{"1": {"success": true, "tools_used": ["a", "b"]}}\n{"3": {"success": false}}\n')
    s, o = rc.read_history(spark, str(tmp_path), per_line=True)
    assert s._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert sorted((r.scenario_id, r.container_format, r.width) for r in s.collect()) == [("1", "mp4", 4), ("2", None, None), ("3", None, 7)]
    few, some = rc.read_history(spark, str(tmp_path), per_line=True, columns=["container_format", "success"])
    assert few.columns == ["scenario_id", "container_format"] and some.columns == ["scenario_id", "success"]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, s.select(*few.columns).collect()))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, o.select(*some.columns).collect())) == [("1", True), ("3", False)]


def test_files_are_listed_by_tasks(spark, tmp_path):
    """What Spark's binaryFile gives, of folders at several depths, without a plan that names the files."""
    names = ["a.de", "b.EN", "c.txt", "d.DE", "x y%20ü.en", ".hid.de", "_no.de", "_k=v.de", "empty.de"]
    for folder in ("", "one", "one/two", "three words", "_skip", ".git", "void/void"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for i, n in enumerate(names if "void" not in folder else []):
            (tmp_path / folder / n).write_bytes(b"" if n == "empty.de" else b"x" * (i + 1))
    got = im.scan_files(spark, str(tmp_path), [".de", ".En"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "one/two" not in plan
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    plain = plain.filter(F.lower("path").rlike("[.](de|en)$")).select("path", "modificationTime", (F.col("length") / (1 << 20)).alias("size_mb"))
    # binaryFile leaves out files without bytes
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, got.filter("size_mb > 0").collect())) == want and len(want) == 20
    assert got.filter("size_mb = 0").count() == 4
    assert sorted(map(tuple, im.scan_files(spark, f"file://{tmp_path}/", [".de", ".En"]).filter("size_mb > 0").collect())) == want
    alone = im.scan_files(spark, str(tmp_path / "a.de"), [".de"]).collect()
    assert [r.path for r in alone] == [f"file:{tmp_path}/a.de"]


def test_chains_are_followed_in_stretches(spark):
    """The same places as by following each chain; the rounds go over few of them."""
    rng = random.Random(31)
    rows, want = [], set()
    for image, n, far in (("a", 3000, 9), ("b", 1, 1), ("c", 700, 400), ("d", 900, 2)):
        tags = sorted(rng.sample(range(2**60, 2**60 + 10 * n), n))
        to = [tags[i + j] if (j := rng.randint(1, far)) + i < n else ct.NOWHERE for i in range(n)]
        rows += [(image, "moov", t, x) for t, x in zip(tags, to, strict=True)]
        lead, at = dict(zip(tags, to, strict=True)), tags[0]
        while at != ct.NOWHERE:
            want.add((image, "moov", at))
            at = lead[at]
    places = spark.createDataFrame(rows, "image_id string, atom_type string, tag bigint, nxt bigint")
    got = list(map(tuple, ct.chain_reach(places, ["image_id", "atom_type"]).collect()))
    assert len(got) == len(set(got)) and set(got) == want
