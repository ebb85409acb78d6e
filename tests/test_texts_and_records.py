import json
import math
import random
import re
from collections import Counter

import pytest

from tracefield.functions import bytesops as by
from tracefield.functions import fixed_values as fv
from tracefield.functions import scalars as sc
from tracefield.functions import textops as tx
from tracefield.operators import jobs as jb
from tracefield.operators import reports as rp
from tracefield.operators import strategy as st
from tracefield.sources import records as rc
from pyspark.sql import functions as F


def one(df):
    return df.first()


def test_moderation_branches(spark):
    texts = ["nothing here", "A Weapon", "weapon drug VIRUS", "hack exploit malware trojan"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [(r.flagged, r.category, r.severity, r.confidence, r.needs_review) for r in tx.keyword_moderation(df).orderBy("id").collect()]
    assert got == [(0, "SAFE", "LOW", 0.95, False), (1, "SAFE", "LOW", 0.8, False), (3, "SAFE", "LOW", 0.8, False), (4, "VIOLENCE", "MEDIUM", 0.7, True)]


def test_entities_match_python_regex(spark):
    t = "mail a.b@c.org, tel 555-123-4567 or 5551234567; ip 10.0.0.1, 999.1.1.1 é x@y.io"
    got = {(r.entity_type, r.entity, r.start_pos, r.end_pos) for r in tx.entities(spark.createDataFrame([(1, t)], "id int, text string"), "id").collect()}
    want = {(k, m.group(), m.start(), m.end()) for k, p, _ in fv.ENTITY_PATTERNS for m in re.finditer(p, t)}
    assert got == want and len(got) == 6


def test_text_type_branches(spark):
    texts = ["an ERROR", "Select x", "a,b\nc,d", ' {"a":1}', "<DIV x", "plain words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", tx.text_type(F.col("text")).alias("k"))
    assert [r.k for r in df.orderBy("id").collect()] == ["log_file", "sql_file", "csv_data", "json_data", "html_file", "plain_text"]


@pytest.mark.parametrize("n,want", [(0, "0.0 B"), (1023, "1023.0 B"), (1280, "1.2 KB"), (1792, "1.8 KB"), (5 << 20, "5.0 MB"), (3 << 50, "3.0 PB"), (3 << 60, "3072.0 PB")])
def test_format_size(spark, n, want):
    assert one(spark.range(1).select(sc.format_size(F.lit(float(n))).alias("x"))).x == want


def test_byte_reads_and_strings(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x00\xff\xd8\xffab\x00hello world\x01xyz"))], "id int, data binary")
    r = one(df.select(by.be_uint(F.col("data"), 0, 4).alias("be"), by.le_uint(F.col("data"), 0, 4).alias("le"), by.byte_at(F.col("data"), 3).alias("b"), by.byte_at(F.col("data"), 99).alias("n")))
    assert (r.be, r.le, r.b, r.n) == (0x00FFD8FF, 0xFFD8FF00, 255, None)
    assert [(x.offset, x.value) for x in by.extract_strings(df, "id").collect()] == [(7, "hello world")]
    big = spark.createDataFrame([(bytearray(b"\xff" * 8),)], "d binary")
    assert int(one(big.select(by.be_uint(F.col("d"), 0, 8).alias("x"))).x) == 2**64 - 1


def test_empty_entropy(spark):
    df = spark.createDataFrame([(1, bytearray()), (2, bytearray(range(256)))], "id int, data binary")
    assert [r.e for r in df.select(by.entropy_udf(F.col("data")).alias("e")).collect()] == [0.0, 8.0]


def test_recovery_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "size bigint, errors array<string>")
    r = one(rp.recovery_stats(empty))
    assert (r.total, r.valid, r.success_pct) == (0, 0, 0.0)


def test_report_files(spark, tmp_path):
    rows = [(i, "jpg", "image/jpeg" if i % 2 else None, 10, ["bad"] if i < 60 else []) for i in range(100)]
    v = spark.createDataFrame(rows, "id int, ext string, mime string, size bigint, errors array<string>")
    rp.write_report(v, "id", str(tmp_path), 50)
    lines = [r.value for r in spark.read.text(str(tmp_path / "text")).collect()]
    assert lines[0].startswith("files 100, valid 40 (40.0%), corrupted 60") and "... and 10 more" in lines
    assert spark.read.json(str(tmp_path / "failures")).count() == 50
    for fmt in ("json", "csv", "text", "parquet"):
        rp.export_results(v.select("id", "ext"), str(tmp_path / f"out.{fmt}"))


def test_history_files(spark, tmp_path):
    (tmp_path / "scenarios.json").write_text(json.dumps({"a": {"file_size_mb": 150.0, "container_format": "mp4", "corruption_severity": 0.4, "header_corruption": True}}))
    (tmp_path / "outcomes.json").write_text(json.dumps({"a": {"success": True, "tools_used": ["untrunc"]}, "b": {"success": False, "tools_used": []}}))
    s, o = rc.read_history(spark, str(tmp_path))
    assert one(s).container_format == "mp4" and one(s).file_size_mb == 150.0
    assert st.scenarios_with_outcomes(s.select("scenario_id"), o).count() == 1


def test_unknown_values_do_not_veto_rules(spark):
    s = spark.createDataFrame(
        [("x", None, 50.0, True, 0.2, 3600, "h264", "fast", False, ["a"], False)],
        "scenario_id string, container_format string, file_size_mb double, header_corruption boolean, corruption_severity double, max_processing_time int, video_codec string, quality_requirements string, fragment_corruption boolean, corruption_patterns array<string>, reference_file_available boolean",
    )
    assert [r.rule for r in st.rules_match(s).collect()] == ["small_mp4_header_corruption"]


def test_threshold_sweep_ties_and_minimum(spark):
    rows = [(True, 0.95)] * 15 + [(True, 0.55)] * 15
    assert one(st.threshold_sweep(spark.createDataFrame(rows, "success boolean, confidence double"))).threshold == 0.5
    few = spark.createDataFrame(rows[:5], "success boolean, confidence double")
    assert one(st.threshold_sweep(few)).threshold == 0.7


def test_index_repair_steps(spark):
    rows = [(1, 1, 10, 5), (1, 2, 3, 0), (1, 3, 99, 7)]
    i = spark.createDataFrame([(f, s, o, z) for f, s, o, z in rows], "file_id int, slot bigint, offset bigint, size bigint")
    got = jb.index_repair(i, spark.createDataFrame([(1, 60)], "file_id int, file_size bigint"), "slot", F.lit(8).cast("bigint"), 2)
    assert [(r.new_offset, r.new_size) for r in got.orderBy("slot").collect()] == [(10, 5), (15, 45), (60, 0)]


def test_bad_sector_file(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# bad\n1024\n2048,3\n4096\n")
    assert sorted(r.sector for r in rc.read_bad_sectors(spark, str(tmp_path / "b.txt")).collect()) == [1024, 2048, 4096]
    (tmp_path / "m.txt").write_text("# head\na=1=2\n\nb = x\nnothing\n")
    assert {(r.key, r.value) for r in rc.read_manifest(spark, str(tmp_path / "m.txt")).collect()} == {("a", "1=2"), ("b", "x")}


def test_randomness_of_cells_and_of_keys_of_several_cells(spark, monkeypatch):
    """Blocks are grouped only for keys of several cells; repeats over cells count, short and empty cells too."""
    rng = random.Random(4)
    block = rng.randbytes(16)
    cells = {
        1: [rng.randbytes(4096)], 2: [block + rng.randbytes(160) + block], 3: [b"abc"], 4: [block + b"x" * 5 + block], 5: [b""],
        6: [block + b"a" * 16, rng.randbytes(64) + block], 7: [b"ab", b"cd", b""], 8: [b"q" * 16, b""],
    }
    grouped, plain = [], by.blocks
    monkeypatch.setattr(by, "blocks", lambda df, *a: grouped.extend(r.k for r in df.collect()) or plain(df, *a))
    rows = spark.createDataFrame([(k, bytearray(c)) for k, cs in cells.items() for c in cs], "k int, data binary")
    got = {r.k: r for r in by.randomness(rows, "k").collect()}
    assert set(got) == set(cells) - {5} and set(grouped) == {6, 7}
    for k, r in got.items():
        whole = b"".join(cells[k])
        n = [c for c in Counter(whole).values()]
        pieces = [c[i : i + 16] for c in cells[k] for i in range(0, len(c) - 15, 16)]
        assert r["size"] == len(whole) and r.repeats == (len(set(pieces)) < len(pieces) if pieces else None)
        assert r.entropy == pytest.approx(-sum(c / len(whole) * math.log2(c / len(whole)) for c in n), abs=1e-9)
        assert r.chi_square == pytest.approx(sum(c * c for c in n) * 256 / len(whole) - len(whole))
