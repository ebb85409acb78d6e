import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefield.operators import carving as cv
from tracefield.operators import imaging as im
from tracefield.sources import image as src
from tracefield.sources import signatures as sg

JPEG = b"\xff\xd8\xff" + b"fake jpeg data" * 100 + b"\xff\xd9"
PNG = bytes.fromhex("89504E470D0A1A0A") + b"png text" * 300 + bytes.fromhex("49454E44AE426082")
PDF = b"%PDF-" + b"pdf body text " * 400 + bytes.fromhex("0A2525454F46")
SIGS = [
    ("JPEG", ".jpg", "FF D8 FF", "FFD9", 10 << 20, 1024),
    ("PNG", ".png", "89504E470D0A1A0A", "49454E44AE426082", 50 << 20, 2048),
    ("PDF", ".pdf", "255044462D", "0A2525454F46", 100 << 20, 4096),
]


def chunks_of(spark, data, size, image="img"):
    rows = [(image, i, i * size, bytearray(data[i * size : (i + 1) * size])) for i in range(-(-len(data) // size))]
    return spark.createDataFrame(rows, "image_id string, chunk_no bigint, base_offset bigint, data binary")


def ranges(df):
    return sorted((r.name, r.start_offset, r.end_offset, r.is_complete) for r in df.collect())


def test_six_files(spark):
    pad = b"\x00" * 1000
    data = pad + JPEG + pad + PNG + pad + JPEG + pad + PDF + pad + PNG + pad + JPEG + pad
    got = ranges(cv.carve(chunks_of(spark, data, 4096), sg.signatures_of(spark, SIGS)))
    assert {n: sum(g[0] == n for g in got) for n in ("JPEG", "PNG", "PDF")} == {"JPEG": 3, "PNG": 2, "PDF": 1}
    assert all(g[3] for g in got)
    bodies = {data[a:b] for _, a, b, _ in got}
    assert bodies == {JPEG, PNG, PDF}


def test_chunk_size_does_not_matter(spark):
    rng = random.Random(1)
    data = b"".join(rng.choice([JPEG[:50] + JPEG[-2:], PNG[:30], b"\x00" * 97, b"%PDF-", bytes.fromhex("FFD8"), b"\xff\xd8\xff\xd8\xff"]) for _ in range(200))
    sigs = sg.signatures_of(spark, [(n, e, h, f, 5000, 3) for n, e, h, f, _, _ in SIGS])
    one = ranges(cv.carve(chunks_of(spark, data, len(data)), sigs))
    assert one
    for size in (3, 7, 64, 1000):
        assert ranges(cv.carve(chunks_of(spark, data, size), sigs)) == one


def brute(data, header, footer, mx, fso, last=False):
    out = []
    at = data.find(header)
    while at != -1:
        end, done = -1, False
        if footer:
            find = data.rfind if last else data.find
            p = find(footer, at + fso, min(at + mx, len(data)))
            if p != -1:
                end, done = p + len(footer), True
        if end < 0:
            end, done = min(at + mx, len(data)), not footer
        out.append((at, end, done))
        at = data.find(header, at + 1)
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    data = bytes(rng.choice(b"abcd") for _ in range(6000))
    for mode in ("first", "last"):
        sigs = sg.signatures_of(spark, [("A", ".a", b"abc".hex(), b"dd".hex(), 40, 3), ("B", ".b", b"aa".hex(), "", 10, 0), ("C", ".c", b"cab".hex(), b"bbb".hex(), 25, 0)])
        got = ranges(cv.carve(chunks_of(spark, data, 512), sigs, mode, span=100))
        want = sorted(
            (n, a, b, c) for n, h, f, mx, fso in (("A", b"abc", b"dd", 40, 3), ("B", b"aa", b"", 10, 0), ("C", b"cab", b"bbb", 25, 0))
            for a, b, c in brute(data, h, f, mx, fso, mode == "last")
        )
        assert got == want


def test_footer_missing_and_not_expected(spark):
    data = b"\xff\xd8\xff" + b"x" * 500
    none = sg.signatures_of(spark, [("J", ".jpg", "FFD8FF", "", 200, 0)])
    want = sg.signatures_of(spark, [("J", ".jpg", "FFD8FF", "FFD9", 200, 0)])
    assert ranges(cv.carve(chunks_of(spark, data, 100), none)) == [("J", 0, 200, True)]
    assert ranges(cv.carve(chunks_of(spark, data, 100), want)) == [("J", 0, 200, False)]


def test_overlapping_patterns():
    def find(data, patterns):
        return sorted((int(p), int(x)) for p, x in zip(*cv.find_all(data, patterns)))

    assert find(b"this is a test string", [b"test", b"string"]) == [(0, 10), (1, 15)]
    assert find(b"abcd", [b"abc", b"bcd", b"b"]) == [(0, 0), (1, 1), (2, 1)]
    assert find(b"", [b"a"]) == [] and find(b"aaa", [b"aa"]) == [(0, 0), (0, 1)]


def test_many_patterns_cost_no_more_and_are_all_found():
    rng = random.Random(7)
    data = bytes(rng.randrange(97, 103) for _ in range(4000))
    patterns = list({bytes(rng.randrange(97, 103) for _ in range(rng.choice([1, 2, 3, 5, 9]))) for _ in range(3000)})
    patterns += [patterns[0], data[100:400], data]  # a repeated one, long ones
    want = sorted((n, i) for n, p in enumerate(patterns) for i in range(len(data) - len(p) + 1) if data.startswith(p, i))
    assert sorted(zip(*map(list, cv.find_all(data, patterns)))) == want
    assert len(cv.find_all(b"", patterns)[0]) == 0
    few = patterns[:60]
    assert sorted(zip(*map(list, cv.find_few(few, data)))) == [x for x in want if x[0] < 60]


def test_signature_list_that_stays_on_spark(spark, monkeypatch):
    data = b"..abcd..abce..xbcd\x00\xff" * 20
    sigs = sg.signatures_of(spark, [("A", "", b"abcd".hex(), "", 9, 0), ("B", "", b"abc".hex(), "", 9, 0), ("C", "", b"xbcd".hex(), "", 9, 0), ("D", "", b"abc".hex(), "", 9, 0), ("E", "", "00ff", "", 9, 0), ("F", "", b"none".hex(), "", 9, 0)])
    for step in (len(data), 7, 3):
        chunks = chunks_of(spark, data, step)
        few = sorted(map(tuple, cv.match_signatures(chunks, sigs).collect()))
        monkeypatch.setattr(cv, "SHORT_LIST", 2)
        assert sorted(map(tuple, cv.match_signatures(chunks, sigs).collect())) == few and len(few) == 140
        monkeypatch.undo()


def test_table_function_over_chunk_edges(spark):
    data = b"..abcd..abce..xbcd" * 20
    patterns = [b"abc", b"bcd..", b"x"]
    want = sorted((n, i) for n, p in enumerate(patterns) for i in range(len(data)) if data.startswith(p, i))
    for step in (len(data), 7, 2):
        assert sorted((r.pid, r.offset) for r in cv.scan_by_udtf(chunks_of(spark, data, step), patterns).collect()) == want


def test_carved_bytes_across_chunks(spark):
    data = b"\x00" * 777 + JPEG + b"\x01" * 321 + PNG
    chunks = chunks_of(spark, data, 100)
    carved = cv.carve(chunks, sg.signatures_of(spark, SIGS))
    got = {bytes(r.content) for r in cv.carved_bytes(carved, chunks, 256).collect()}
    assert got == {JPEG, PNG}


def test_default_signatures_and_round_trip(spark, tmp_path):
    sigs = sg.default_signatures(spark)
    assert sigs.count() == 63
    assert sigs.filter("footer is null").count() + sigs.filter("footer is not null").count() == 63
    assert {r.category for r in sigs.select("category").distinct().collect()} >= {"image", "video", "audio", "document", "archive", "executable"}
    sg.write_signatures(sigs, str(tmp_path / "sig"))
    back = sg.read_signatures(spark, str(tmp_path / "sig"))
    key = ["name", "header", "footer", "max_size", "footer_search_offset"]
    assert sorted(map(str, back.select(*key).collect())) == sorted(map(str, sigs.select(*key).collect()))
    (tmp_path / "bad.json").write_text("not json")
    assert sg.read_signatures(spark, str(tmp_path / "bad.json")).count() == 0


def test_read_image_source(spark, tmp_path):
    data = random.Random(2).randbytes(100_003)
    (tmp_path / "disk.img").write_bytes(data)
    rows = src.read_image(spark, str(tmp_path / "disk.img"), 4096, 7).orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data)[: r.length] for r in rows) == data
    assert bytes(rows[0].data) == data[: 4096 + 7]
    names = src.scan_files(spark, str(tmp_path), [".IMG"]).collect()
    assert len(names) == 1 and abs(names[0].size_mb - 100_003 / 2**20) < 1e-9


def test_image_writer_and_checksums(spark, tmp_path):
    import hashlib
    import zlib

    data = random.Random(3).randbytes(5000)
    chunks = chunks_of(spark, data, 512)
    im.write_image(chunks, str(tmp_path / "out"))
    rows = im.read_written_image(spark, str(tmp_path / "out")).orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in rows) == data and all(r.sound for r in rows)
    h = im.chunk_hashes(chunks).orderBy("chunk_no").first()
    assert h.sha512 == hashlib.sha512(data[:512]).hexdigest() and h.crc32 == zlib.crc32(data[:512])
    idx = im.image_index(chunks).orderBy("chunk_no").collect()
    assert [r.offset for r in idx] == [i * 512 for i in range(len(idx))]


def test_signature_list_longer_than_one_scan_takes(spark, monkeypatch):
    data = b"..abcd..abce..xbcd" * 20
    sigs = sg.signatures_of(spark, [("A", "", b"abcd".hex(), "", 9, 0), ("B", "", b"abc".hex(), "", 9, 0), ("C", "", b"xbcd".hex(), "", 9, 0)])
    chunks = chunks_of(spark, data, len(data))
    few = sorted(map(tuple, cv.match_signatures(chunks, sigs).collect()))
    monkeypatch.setattr(cv, "PATTERNS_PER_SCAN", 2)
    assert sorted(map(tuple, cv.match_signatures(chunks, sigs).collect())) == few


def test_skewed_offsets_are_kept(spark):
    """One image with most hits, footers everywhere: nothing is dropped."""
    data = b"ab" * 20000
    sigs = sg.signatures_of(spark, [("A", "", b"ab".hex(), b"ab".hex(), 6, 2)])
    c = cv.carve(chunks_of(spark, data, 1000), sigs, span=500)
    assert c.count() == 20000 and c.filter("is_complete").count() == 19999
    assert c.agg(F.sum("size")).first()[0] == 19999 * 4 + 2


def test_few_chunks_go_to_python_at_once(spark):
    """Python's memory in the scan does not follow the number of chunks of a task."""
    rows_of_batch = F.pandas_udf(lambda data: pd.Series([len(data)] * len(data)), T.LongType())
    chunks = spark.range(0, 2000, 1, 1).select(F.lit("i").alias("image_id"), F.col("id").alias("chunk_no"), (F.col("id") * 4).alias("base_offset"), F.lit(b"abcd").alias("data"))
    passed = cv.scan_pass(chunks, rows_of_batch("data"), 2)
    assert passed.count() == 2000 and passed.agg(F.max("hits")).first()[0] <= 256
