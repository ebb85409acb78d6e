"""Merkle witnesses, archives with their index, ranked search: brute force, SQL, odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from tracefield.llm import lexical, merkle, queries, warc

ROW = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, text: str | None) -> str:
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)))


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """Each row's result with the trees built as whole lists in memory."""
    steps = {i: [] for i in range(len(rows))}

    def climb(nodes):
        while len(nodes) > 1:
            above = []
            for a in range(0, len(nodes), 16):
                run = nodes[a : a + 16]
                for k, (_, below) in enumerate(run):
                    for i in below:
                        steps[i].append((k, [d for j, (d, _) in enumerate(run) if j != k]))
                above.append((h(*(d for d, _ in run)), [i for _, below in run for i in below]))
            nodes = above
        return nodes[0]

    tops, subroot = [], {}
    for source in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted((r[0] is not None, r[0] or 0, leaf(r, r[4]), i) for i, r in enumerate(rows) if r[1] == source)
        tops.append(climb([(d, [i]) for _, _, d, i in own]))
        subroot |= dict.fromkeys(tops[-1][1], tops[-1][0])
    root, _ = climb(tops)
    out = []
    for i, r in enumerate(rows):
        text = r[4]
        if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        folded = leaf(r, text)
        for k, others in steps[i]:
            folded = h(*others[:k], folded, *others[k:])
        out.append((r[0], leaf(r, r[4]), subroot[i], root, h(*(d for _, s in steps[i] for d in s)), folded, folded == root))
    return out


def some_rows(sizes: dict, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    ident = lambda: r.choice([None, 3, 3]) if r.random() < 0.05 else r.randrange(10**9)
    rows = [(ident(), s, r.choice([None, "en"]), r.choice([None, i]), r.choice([None, "", "Ab", "ÉX y", f"T{i}"])) for s, n in sizes.items() for i in range(n)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "a": 1, "b": 16, "c": 17, "d": 256, "é": 257}, {f"s{i}": 2 for i in range(40)}, {"x": 4097, "y": 300}])
def test_manifest_equals_plain_trees(spark, sizes):
    rows = some_rows(sizes)
    got = [tuple(r) for r in merkle.tampered(spark.createDataFrame(rows, ROW).repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)


def test_block_roots_are_appends_of_further_storeys(spark):
    """Blocks of 16 leaves: four storeys for the largest source."""
    rows = some_rows({"a": 4500, "b": 16, "c": 17, None: 1}, 2)
    leaves = spark.createDataFrame(rows, ROW)
    grown = merkle.grow(merkle.checkpoint(merkle.leaves_of(leaves, merkle.COLUMNS)), depth=1)
    got = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in merkle.prove(grown).collect())
    assert got == sorted((str(r[0]), *r[1:5]) for r in plain_manifest(rows))


def test_witnesses_fold_to_the_root_and_appends_extend_them(spark):
    rows = some_rows({"a": 300, "b": 20}, 3)
    got = merkle.witnesses(spark.createDataFrame(rows, ROW)).collect()
    assert len(got) == 320
    for r in got:
        assert merkle.fold(bytes.fromhex(r["leaf"]), [(x["place"], "".join(x["siblings"])) for x in r["witness"]]).hex() == r["root"]
    tree = merkle.OpenTree()
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(4096)]
    grown = []
    for d in digests:
        tree.append(d)
        grown.append(len(tree.witness[0]))
    assert grown[254] == 0 and grown[255] == 1 and grown[4094] == 1 and grown[4095] == 2  # a level when its last sibling is complete
    assert tree.close()[1] == 3


def test_manifest_of_odd_rows(spark, odd, none):
    assert merkle.tampered(none).count() == 0 and merkle.witnesses(none).count() == 0
    rows = [tuple(r[c] for c in merkle.COLUMNS) for r in odd.collect()]
    assert sorted(map(tuple, merkle.tampered(odd).collect()), key=str) == sorted(plain_manifest(rows), key=str)


PAGE = "page_id long, url string, html string, score string"


def some_pages(n: int) -> list[tuple]:
    r = random.Random(4)
    return [
        (
            r.choice([None, 1, 2, 2]) if r.random() < 0.05 else i,
            r.choice([None, "", "no scheme", "http://A.b.com:80/x?y#z", "https://u@b.org", "http://é.com/\n"]) if r.random() < 0.5 else f"http://h{i % 7}.com/{i % 11}",
            r.choice([None, "", "a", "b\r\n\r\nc", "é" * 300]) if r.random() < 0.7 else str(i),
            "x",
        )
        for i in range(n)
    ]


def wide(index):
    return [tuple(r) for r in index.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")).collect()]


def duck(tables: dict, sql: str) -> list[tuple]:
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.sql(f"create table {name} ({columns})")
        if rows:
            con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    return con.sql(sql).fetchall()


def test_archives_and_merged_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_RECORDS", 100)
    monkeypatch.setattr(warc, "RANGE_ROWS", 300)
    rows = some_pages(3000)
    pages = spark.createDataFrame(rows, PAGE).repartition(7)
    seconds = F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) % 50)
    manifest = warc.write_archives(pages, warc.capture_folder(spark), seconds)
    index = warc.checkpoint(warc.merged_index(manifest))
    want = duck({"pages": ("page_id bigint, url varchar, html varchar, score varchar", rows)}, queries.OP12_SQL)
    assert sorted(wide(index), key=str) == sorted(want, key=str)
    entries = index.orderBy("range", "position").collect()
    keys = [tuple(r[k] for k in warc.KEY) for r in entries]
    assert keys == sorted(keys) and len({r["range"] for r in entries}) > 5
    seen = {}
    for r in entries:
        assert r["nth"] == seen.get(r["url_key"], 0)
        seen[r["url_key"]] = r["nth"] + 1
    assert [r["nth"] for r in warc.history(index, "http://a.B.com/x?y").collect()] == list(range(seen["com,b,a)/x?y"]))


def test_records_come_back_as_written(spark):
    rows = some_pages(400)
    back = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGE), warc.capture_folder(spark)), payloads=True).collect()
    html = sorted((h or "").encode() for _, _, h, _ in rows)
    whole = {r["payload_digest"]: bytes(r["payload"]) for r in back if r["record_type"] == "response"}
    assert sorted(whole[r["payload_digest"]] for r in back) == html
    assert sorted((str(r["page_id"]), str(r["url"])) for r in back) == sorted((str(i), str(u and u.replace("\n", "%0A"))) for i, u, _, _ in rows)
    raw = warc.record("7", "http://a.b/", "text", 0, hashlib.sha1(b"text").digest(), None)
    assert warc.parse(raw)["payload"] == b"text"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"\r\n\r\ntext", b"\r\n\r\nteXt"))


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "a", ""), (2, "u", "a", ""), (3, "u", "abc", ""), (4, "u", "abc", "")], PAGE)
    got = wide(warc.merged_index(warc.write_archives(pages, warc.capture_folder(spark), min_bytes=2)))
    assert sorted((r[0], r[3], r[4]) for r in got) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_no_pages(spark):
    pages = spark.createDataFrame([], PAGE)
    manifest = warc.write_archives(pages, warc.capture_folder(spark))
    assert manifest.count() == 0 and warc.merged_index(manifest).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 64])
def test_loser_tree_merges(k):
    r = random.Random(k)
    runs = [sorted(r.randrange(50) for _ in range(r.choice([0, 1, 20]))) for _ in range(k)]
    order = list(warc.merge(runs))
    assert [runs[s][i] for s, i in order] == sorted(x for run in runs for x in run)
    assert sorted(order) == [(s, i) for s, run in enumerate(runs) for i in range(len(run))]


SEARCHED = "doc_id long, text string, score string, rank string"


def some_texts(n: int) -> list[tuple]:
    r = random.Random(5)
    terms = ["a", "É", "é", "日本", "x1", "the", "_", "-", "zz", "Q", *(f"w{i}" for i in range(40))]
    long = lambda i: r.choice([1, 5, 50, 6000] if i % 50 == 0 else [1, 5, 50])
    text = lambda i: r.choice([None, "", " -_ "]) if r.random() < 0.1 else " ".join(r.choice(terms) * r.randint(1, 2) for _ in range(long(i)))
    return [(r.choice([None, 1, 2]) if r.random() < 0.1 else i, text(i), "s", "r") for i in range(n)]


ITEMS = [(1, "A b the w1"), (1, "A b the w1"), (2, None), (None, "é the the 日本 w7 w8"), (4, "--"), (5, "nothing"), (6, "x1 X1"), (7, "w3 w4 w5 w6")]


@pytest.mark.parametrize("most", [2, 256])
def test_search_equals_sql(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "MAX_ITEMS", most)
    rows = some_texts(600)
    docs, items = spark.createDataFrame(rows, SEARCHED).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = duck({"documents": ("doc_id bigint, text varchar, score varchar, rank varchar", rows), "benchmark": ("item_id bigint, text varchar", ITEMS)}, queries.OP13_SQL)
    assert len(want) > 80
    assert sorted(map(tuple, lexical.search(docs, items).collect()), key=str) == sorted(want, key=str)


def test_bounds_are_never_under_the_scores(spark):
    rows = [r for r in some_texts(300) if lexical.terms_of(r[1])]
    blocks = lexical.build(spark.createDataFrame(rows, SEARCHED)).filter("width > 0").collect()
    vocabulary = sorted({t for _, text in ITEMS for t in lexical.terms_of(text)})
    asked = [[vocabulary.index(t) for t in lexical.terms_of(text)] for _, text in ITEMS]
    q = lexical.Queries(asked, vocabulary, lexical.np.full(len(vocabulary), 1000), 300, 9000)
    text = {}
    for i, t, _, _ in rows:
        text.setdefault(i, []).append(t)
    hashes, column = lexical.term_hash(q.terms) >> lexical.U64(20), {t: i for i, t in enumerate(q.terms)}
    loose = 0.0
    for b in blocks:
        bound = q.bounds(hashes, q.matrix(float), b["width"], lexical.np.array(b["sizes"]), b["slices"])
        for j, i in enumerate(b["ids"]):
            exact = lexical.np.min([q.scores(t, column, q.matrix(lexical.np.int64)) for t in text[i]], axis=0)
            assert (bound[:, j] >= exact).all()
            loose += (bound[:, j] > 1.3 * exact).mean()
    assert sum(len(b["ids"]) for b in blocks) == len(rows)
    assert loose < 0.3 * len(rows)


def test_search_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "lang word1 x"), (2, "テキスト mail")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0
    got = lexical.search(odd, items).collect()
    assert {r["doc_id"] for r in got if r["item_id"] == 2} == {6, 11}
    assert [r["rank"] for r in sorted(got, key=lambda r: (r["item_id"], r["rank"])) if r["item_id"] == 2] == [1, 2]
