"""The pipeline: what each stage lets through, on planted rows, odd rows and empty tables."""

import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tracefield.llm import minhash  # noqa: E402
from tracefield.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_filter_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns, name
        assert 0.5 * docs.count() <= out.count() <= docs.count(), name
        docs = out
    classes = minhash.near_duplicates(docs)
    assert classes.count() >= classes.select("class_id").distinct().count() >= 0.98 * docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()))


def test_near_copies_leave_one_of_each_class(spark, odd):
    rows = corpus_pipeline.drop_near_copies(spark, odd, SF).select("doc_id", "text").collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "10", "11", "3", "5", "6", "7", "8", "9", "9"]


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_odd_rows_and_empty_tables(spark, odd, none, place):
    name, stage = corpus_pipeline.STAGES[place]
    assert stage(spark, odd, SF).count() > 0
    assert stage(spark, none, SF).count() == 0


CLASHING = ("score", "predicted", "_key", "node", "column 0", "text_u", "Text2")


def planted(spark, tmp_path):
    """A small corpus with rows that a stage must drop or change, each named by its id."""
    r = random.Random(12)
    vocabulary = ["".join(r.choice("etaoinshrdlucm") for _ in range(r.randint(3, 8))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = {i: prose(r.randint(80, 160)) for i in range(300)}
    bad = ["vile", "zorgle", "brumpf", "snarl"]
    toxic = {i: " ".join(x for w in prose(60).split() for x in (w, r.choice(bad))) for i in range(300, 420)}
    items = {i: prose(30) for i in range(6)}
    rows |= toxic
    copies = {500: rows[0], 501: " ".join([*rows[1].split()[:-1], "changed"]), 502: f"{rows[2]} tail"}
    leaks = {510: f"{prose(50)} {items[3]} {prose(50)}", 511: f"{prose(40)} {items[4][:60]}#{items[4][61:]} {prose(40)}", 512: f"{prose(40)} {items[5].upper()} {prose(9)}"}
    personal = {520: f"{prose(40)} mail ann.b1@mail.example.com {prose(20)}", 521: f"{prose(40)} call +49 151 2345 6789 {prose(20)}"}
    odd = {530: None, 531: ""}
    rows |= copies | leaks | personal | odd
    rows |= {540: prose(90) + "\n", 541: prose(2000)}
    out = tmp_path / "sf"
    data = [(i, t, "en", "s", len(t) if t is not None else None, *(f"{c} {i}" for c in CLASHING)) for i, t in rows.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    spark.createDataFrame(data, schema).repartition(3).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in rows if i < 420], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out), rows, set(toxic), set(copies), set(leaks), set(personal), set(odd), items


def shingles(text: str | None) -> set:
    words = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", (text or "").lower())
    return set(zip(*(words[k:] for k in range(5)), strict=False))


def test_planted_rows_stage_by_stage(spark, tmp_path):
    """Each stage against what brute force says of its own input; columns of any name come out as they went in."""
    sf, rows, toxic, copies, leaks, personal, odd, items = planted(spark, tmp_path)
    docs, own = table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == table(spark, sf, "documents").columns and set(after) <= set(before)
        assert len(after) == docs.count()
        for i, r in after.items():
            assert all(r[c] == f"{c} {i}" for c in CLASHING)
        gone = set(before) - set(after)
        own[name] = gone
        if name == "toxicity":
            assert gone == toxic
        elif name == "near copies":
            sets = {i: shingles(r["text"]) for i, r in before.items()}
            alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) if sets[a] or sets[b] else True
            want = {max(a, b) for a in copies | odd for b in before if a != b and alike(a, b)}
            assert gone == want == copies | {531}
        elif name == "decontamination":
            assert gone == leaks
        else:
            assert not gone
            changed = {i for i, r in after.items() if r["text"] != before[i]["text"]}
            assert changed == personal
            assert "<EMAIL>" in after[520]["text"] and "<PHONE>" in after[521]["text"] and "ann.b1@" not in after[520]["text"] and "6789" not in after[521]["text"]
            assert all(r["n_chars"] == len(r["text"]) for r in after.values() if r["text"] is not None)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.tokenizer_path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for i, r in after.items()}
    packed, used = corpus_pipeline.run(spark, sf).collect(), {}
    assert {r["doc_id"] for r in packed} == set(after)
    for i, want in ids.items():
        pieces = sorted((r for r in packed if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))] and sum(r["length"] for r in pieces) == len(want)
        for r in pieces:
            part = want[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in used.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))] and sum(n for _, n in spots) <= 1024
    room = []  # best fit decreasing, document by document
    for n in sorted((r["length"] for r in packed), reverse=True):
        fits = [k for k, left in enumerate(room) if left >= n]
        best = min(fits, key=room.__getitem__) if fits else len(room)
        room[best:] = [1024, *room[best + 1 :]] if best == len(room) else room[best:]
        room[best] -= n
    assert len(used) <= len(room)


def test_own_columns_of_odd_rows_stay(spark, odd):
    docs = odd.withColumn("_key", F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {(r["score"], r["predicted"], r["_key"], r["node"]) for r in out.collect()} == {("a", "d", "mine", "b")}
