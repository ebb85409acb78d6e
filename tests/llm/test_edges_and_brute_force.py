"""Every operator on odd rows and empty tables, and against plain versions of what it computes."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from tracefield.llm import (  # noqa: E402
    cover_tree, decontaminate, language, minhash, packing, pii, quality, queries, token_files, toxicity, url_filter,
)
from tracefield.llm.common import table  # noqa: E402
from tracefield.llm.tokens import encoder  # noqa: E402

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def components(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


# ---- vectors


def brute_vectors(rows, cosine=0.9):
    ids = [r[0] for r in rows]
    ok = [r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                    links.append((i, j))
    n = Counter(x for e in links for x in e)
    top = components(len(rows), links)
    out = []
    for i in range(len(rows)):
        member = [ids[j] for j in range(len(rows)) if top[j] == top[i] and ids[j] is not None]
        least = min(member) if member else None
        out.append((ids[i], n[i], least, ids[i] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("dim,spread,block", [(2, 0.3, 16), (8, 0.1, 4096), (64, 0.02, 32)])
def test_vectors_against_all_pairs(spark, monkeypatch, dim, spread, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(20, dim))
    rows = [(i, [float(np.float32(x)) for x in base[rng.integers(20)] + rng.normal(size=dim) * spread]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(300, None), (301, []), (302, [0.0] * dim), (303, [None] + [1.0] * (dim - 1)), (304, [float("nan")] * dim), (305, [float("inf")] * dim), (306, [1.0] * (dim + 1)), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    got = sorted(map(tuple, cover_tree.near_vectors(df).collect()), key=str)
    assert got == brute_vectors(rows)


def test_vectors_registered_and_empty(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op1_cover_tree(spark, SF).collect()), key=str) == brute_vectors(rows)
    assert cover_tree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# ---- personal data

PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_given_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@x.y", ".", "1", "12", "255", "256", ".7", "+1", " ", "-", "(", ")", "4111111111111111", "\n", "é", "%", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "." * 1000) == []


def test_pii_registered_against_patterns(spark):
    texts = dict(documents(spark))
    for r in queries.op2_pii(spark, SF).collect():
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{PLAIN[k][0]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert set(base) <= {(int(s), pii.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)}


def test_skip_links_carry_labels():
    width = len(pii.LABELS)
    model = {"unary": np.zeros((pii.PLACES, width), np.float32), "chain": 6.0 * np.eye(width), "skip": 6.0 * np.eye(width)}
    text = "Call +1 (988) 555-2485 today. Words follow here. Or dial (988) 555-2485 tomorrow, order 77."
    (base, added), = pii.find([text], model, 0.9)
    assert [text[s:e] for s, _, e in base] == ["+1 (988) 555-2485"]
    assert [(text[s:e], pii.KINDS[k]) for s, k, e in added] == [("(988) 555-2485", "phone")]
    assert pii.masked(text, base + added) == "Call <PHONE> today. Words follow here. Or dial <PHONE> tomorrow, order 77."


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(1)
    unary, pair = rng.normal(size=(4, 3)), rng.normal(size=(3, 3, 3))
    edges = np.array([(0, 1), (1, 2), (1, 3)])
    got = pii.pass_messages(unary, edges, pair, rounds=60, damping=0.0)
    total = np.zeros((4, 3))
    for state in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(unary[i, s] for i, s in enumerate(state)) + sum(pair[k, state[a], state[b]] for k, (a, b) in enumerate(edges)))
        for i, s in enumerate(state):
            total[i, s] += p
    assert np.allclose(got, total / total.sum(1, keepdims=True), atol=1e-6)


def test_labels_reach_distant_repeats():
    """One phone that the patterns find, 40 repeats that they miss, weights at their limits and the threshold in use."""
    width = len(pii.LABELS)
    pair = np.where(np.eye(width) > 0, 4.0, -4.0)
    model = {"unary": np.zeros((pii.PLACES, width), np.float32), "chain": pair, "skip": pair}
    text = "Call +1-988-555-2485 now. " + "Then words stand here. Or (988)555-2485 again. " * 40
    (base, added), other = pii.find([text, "dial 77 now"], model)
    assert len(base) == 1 and len(added) >= 36 and {k for _, k, _ in added} == {pii.KINDS.index("phone")} and other == ([], [])
    # without a bound in the way, the marginals are those of the path: a product of the link tables
    edges, unary = np.array([(i, i + 1) for i in range(60)]), np.zeros((61, width))
    unary[0] = [-30, -30, -30, -30, 0]
    got = pii.pass_messages(unary, edges, np.repeat(pair[None], 60, 0), pii.ROUNDS + 4 * pii.longest_path(edges.tolist()))
    link = np.exp(pair) / np.exp(pair).sum(0)
    want = np.exp(unary[0]) / np.exp(unary[0]).sum() @ np.linalg.matrix_power(link, 60)
    assert np.allclose(got[60], want, atol=1e-3)


def test_pii_odd_rows(spark, odd, none):
    model = pii.learn(odd)
    assert pii.detect(odd, model).count() == odd.count()
    out = pii.mask(odd, model)
    assert out.columns == odd.columns and out.filter("doc_id = 6").first()["text"] == "mail <EMAIL> now"
    assert out.filter("text is null").count() == 2
    assert pii.detect(none, pii.learn(none)).count() == pii.mask(none, pii.learn(none)).count() == 0


# ---- benchmark leaks


def levenshtein_part(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_distance_against_the_table():
    rng = random.Random(2)
    for _ in range(300):
        item = bytes(rng.choice(b"ab c") for _ in range(rng.randint(1, 20)))
        text = bytes(rng.choice(b"ab c") for _ in range(rng.randint(0, 40)))
        want = levenshtein_part(item, text)
        most = rng.randint(0, 6)
        got = decontaminate.edits_within(item, text, most)
        assert (got[0] if got else None) == (want if want <= most and want < len(item) else None)


@pytest.mark.parametrize("share,recall", [(0.0, 1.0), (0.03, 0.99), (0.08, 0.9)])
def test_leaks_are_found_through_edits(spark, share, recall):
    rng = random.Random(7)
    items = [(r["item_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.1", "benchmark").collect()]
    texts = []
    for i, text in items:
        chars = list(text)
        for _ in range(int(share * len(text))):
            at, kind = rng.randrange(len(chars)), rng.randrange(3)
            if kind == 0:
                chars[at] = rng.choice("abcdefgh")
            elif kind == 1:
                del chars[at]
            else:
                chars.insert(at, rng.choice("abcdefgh"))
        texts.append((i, "Some words lead. " + "".join(chars) + " More words follow"))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"] for r in decontaminate.find_leaks(docs, bench).filter("doc_id = item_id").collect()}
    assert len(found) >= recall * len(items)


@pytest.mark.parametrize("length", [9, 16, 45, 55, 62, 80, 100, 200])
@pytest.mark.parametrize("share", [0.1, 0.12])
def test_leaks_recall_holds_in_every_length_class(length, share):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 9)))
    items, texts = [], []
    for _ in range(200):
        text = word()
        while len(text) < length:
            text += " " + word()
        chars = list(text)
        for _ in range(int(share * len(text))):
            at, kind = rng.randrange(len(chars)), rng.randrange(3)
            chars[at : at + (kind != 2)] = [] if kind == 1 else [rng.choice("abcdefgh ")]
        items.append((len(items), text.encode()))
        texts.append(" ".join([*(word() for _ in range(20)), "".join(chars), *(word() for _ in range(20))]))
    data, starts, offsets = decontaminate.normalised(pa.array(texts))
    raw, edits = data.tobytes(), decontaminate.EDITS
    want = {(i, i) for i, t in items if decontaminate.edits_within(t, raw[offsets[i] : offsets[i + 1]], int(edits * len(t)))}
    found = {x[:2] for x in decontaminate.leaks(decontaminate.Index(items), data, starts, offsets, edits)}
    assert len(want) > 190 and len(want & found) >= 0.99 * len(want)


def test_leaks_texts_without_word_starts():
    """Items of one long word: no walk starts inside it, pieces find it."""
    rng = random.Random(5)
    items = [(i, "".join(rng.choice("abcdefghijklmnop") for _ in range(80)).encode()) for i in range(50)]
    texts = [f"before x{t[:20].decode()}z{t[21:50].decode()}{t[51:].decode()}y after" for _, t in items]
    data, starts, offsets = decontaminate.normalised(pa.array(texts))
    assert len(decontaminate.leaks(decontaminate.Index(items), data, starts, offsets, decontaminate.EDITS)) == 50


def test_the_closest_copy_counts(spark):
    rng = random.Random(8)
    item = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(30))
    edited = lambda n: "".join(c if i % n else "#x"[i % 2] for i, c in enumerate(item))
    far, near = edited(12), item[:50] + "q" + item[51:120] + item[122:]
    docs = spark.createDataFrame([(1, f"{far} and so on {near} end"), (2, f"{near} then {far}"), (3, far), (4, f"{far} {near} {item}")], "doc_id long, text string")
    got = {r["doc_id"]: r["distance"] for r in decontaminate.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1] == got[2] == 3 and got[3] > 10 and got[4] == 0


@pytest.mark.parametrize("letters", ["абвгдежзиклмнопрст", "αβγδεζηθικλμνοπρστ", "éèàùçôîñöüßabcdefg", "abcdefghijklmnopqr"])
def test_leaks_in_capitals_of_any_script(letters):
    """Whole characters count: 10 % changed letters in capitals are found, one changed letter is distance 1."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    items = [" ".join(word() for _ in range(25)) for _ in range(60)]
    texts = []
    for i, t in enumerate(items):
        chars = list(t)
        for at in rng.sample(range(len(chars)), int(0.1 * len(chars)) if i % 2 else 1):
            chars[at] = rng.choice(letters.replace(chars[at], ""))
        texts.append(f"{word()} {word()} {''.join(chars).upper()} {word()}")
    rows = decontaminate.item_list(pa.table({"item_id": pa.array(range(60)), "text": pa.array(items)}))
    assert all(len(p) == len(t.casefold()) for (_, p), t in zip(rows, items, strict=True))
    found = {x[:2]: x[2] for x in decontaminate.leaks(decontaminate.Index(rows), *decontaminate.normalised(pa.array(texts)), decontaminate.EDITS)}
    assert {(i, i) for i in range(60)} <= set(found)
    if "ß" not in letters:
        assert all(found[i, i] <= 1 for i in range(0, 60, 2))


def test_characters_are_normalised_as_bytes_are():
    rng = random.Random(10)
    texts = ["".join(rng.choice("ab C_9-. \n") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "-"]
    plain = decontaminate.normalised(pa.array(texts))
    from tracefield.llm.common import word_characters

    assert all((x == y).all() for x, y in zip(plain, word_characters([(t or "").lower() for t in texts]), strict=True))


def test_leaks_registered_exact_passages(spark):
    plain = lambda t: re.sub(r"[^0-9a-z_\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m.group().lower(), t)).strip()
    items = [(r["item_id"], plain(r["text"])) for r in table(spark, SF, "benchmark").collect()]
    want = {(d, i) for d, t in documents(spark) for i, x in items if f" {x} " in f" {plain(t)} "}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op3_decontaminate(spark, SF).collect()}
    assert want <= set(got) and all(got[k] == 0 for k in want)


def test_leaks_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "other text under the same id"), (5, "!!")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, bench).collect()), key=str)
    assert got == [(5, 3), (5, 3), (9, None)]
    assert decontaminate.without_leaks(odd, bench).count() == odd.count() - 2
    assert decontaminate.find_leaks(none, bench).count() == decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(odd, bench.limit(0)).count() == odd.count()


# ---- near copies


def word_sets(text):
    words = re.findall(rb"[0-9A-Za-z_\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def plain_jp(a, b):
    both = a.keys() & b.keys()
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in both)


def test_similarity_against_the_sum():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = (Counter(rng.integers(0, 12, rng.integers(1, 30)).tolist()) for _ in range(2))
        sets = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)], float)) for x in (a, b)]
        assert minhash.similarity(*sets) == pytest.approx(plain_jp(a, b))


def test_bound_keeps_every_link():
    rng, sets = np.random.default_rng(3), []
    base = rng.choice(1 << 30, 40, replace=False)
    for most in (1, 1, 1, 5) * 15:
        h = np.sort(np.unique(np.where(rng.random(40) < rng.random() / 3, rng.choice(1 << 30, 40), base)))
        sets.append((h.astype(np.uint64), rng.integers(1, most + 1, len(h)).astype(float)))
    pairs = np.array([(a, b) for a in range(60) for b in range(a + 1, 60)])[rng.permutation(1770)]
    exact = np.array([minhash.similarity(sets[a], sets[b]) for a, b in pairs])
    for threshold in (0.5, 0.8):
        may = minhash.may_link(sets, pairs, threshold)
        assert 0 < (exact >= threshold).sum() and may[exact >= threshold].all()
        equal = np.array([(sets[a][1].max() == 1) & (sets[b][1].max() == 1) for a, b in pairs])
        assert (may[equal] == (exact[equal] >= threshold - 1e-9)).all()


def test_near_texts_that_are_no_links_are_not_verified_one_by_one(monkeypatch):
    rows, base = [], [f"w{i}" for i in range(300)]
    for k in range(40):  # each 21 words of its own: near by their sketches, J of 0.4 to 0.6
        text = " ".join(f"x{k}" if i % 15 == k % 15 else w for i, w in enumerate(base[:150])) + " " + " ".join(base[150:]) + f" y{k}" * 11
        rows.append({"bucket": 7, "i": 0, "j": 0, "part": 0, "node": bytes([k]), "component": bytes([k]), "text": text})
    rows = pd.DataFrame(rows)
    pairs = np.array([(a, b) for a in range(40) for b in range(a + 1, 40)])
    monkeypatch.setattr(minhash, "near_pairs", lambda r: (r, pairs))
    asked, plain = [], minhash.similarity
    monkeypatch.setattr(minhash, "similarity", lambda a, b: asked.append(1) or plain(a, b))
    sets = [minhash.Sets().get(n, t) for n, t in zip(rows["node"], rows["text"])]
    links = sum(plain(sets[a], sets[b]) >= 0.8 for a, b in pairs)
    out = minhash._links(0.8, False)(rows)
    assert len(asked) <= links + len(out) < len(pairs) / 4


def test_sketches_estimate_jp():
    rng = np.random.default_rng(5)
    got, want = [], []
    for _ in range(150):
        base = Counter(rng.integers(0, 2**40, 60).tolist())
        other = Counter(dict(list(base.items())[: rng.integers(20, 60)])) + Counter(rng.integers(0, 2**40, 10).tolist())
        docs = [np.array(sorted(x), np.uint64) for x in (base, other)]
        s = minhash.sketch(np.repeat([0, 1], [len(docs[0]), len(docs[1])]), np.concatenate(docs), np.concatenate([[x[int(k)] for k in d] for x, d in zip((base, other), docs)]).astype(float), 2)
        got.append((s[0] == s[1]).mean())
        want.append(plain_jp(base, other))
    assert abs(np.mean(got) - np.mean(want)) < 0.02


def brute_classes(rows):
    texts = [t or "" for _, t in rows]
    sets = [word_sets(t) for t in texts]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if texts[i] == texts[j] or len(sets[i].keys() & sets[j].keys()) * 3 > len(sets[i]) and plain_jp(sets[i], sets[j]) >= 0.8:
                links.append((i, j))
    top = components(len(rows), links)
    ids = {}
    for i, t in enumerate(top):
        ids.setdefault(t, []).append(rows[i][0])
    return sorted(((rows[i][0], min((x for x in ids[t] if x is not None), default=None)) for i, t in enumerate(top)), key=str)


def test_near_copies_registered(spark):
    got = sorted(((r["doc_id"], r["class_id"]) for r in queries.op4_minhash(spark, SF).collect()), key=str)
    assert got == brute_classes(documents(spark))


@pytest.mark.parametrize("chunk", [8, 512])
def test_near_copies_in_chains_and_mixed_buckets(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = random.Random(11)
    rows = []
    for family in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(14):  # each text is a changed copy of the one before: only neighbours are alike
            words = list(words)
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == brute_classes(rows)


def test_near_copies_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = minhash.near_duplicates(odd).collect()
    got = sorted(((r["doc_id"], r["class_id"]) for r in out), key=str)
    want = dict()
    for i, c in brute_classes(rows):
        want.setdefault((i, c), 0)
    assert len(out) == len(rows) and {c for _, c in got if c is not None} <= {c for _, c in want} | {None}
    assert minhash.near_duplicates(none).count() == 0


# ---- classifiers


def test_quality_separates_and_orders(spark):
    docs, sf = table(spark, "/root/testdata/sf0.01", "documents"), "/root/testdata/sf0.01"
    got = queries.op5_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    assert sum(r["selected"] == (r["quality"] == 1) for r in got) / len(got) > 0.97
    assert all(0 <= r["expected_grade"] <= 2 and r["p_good"] >= r["p_good_clean"] for r in got)
    held = docs.filter("doc_id % 2 = 0")
    rated = table(spark, sf, "labels").filter("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("grade"))
    tested = quality.grade_texts(held, quality.train(docs, rated)).join(table(spark, sf, "labels"), "doc_id").collect()
    assert sum(r["selected"] == (r["quality"] == 1) for r in tested) / len(tested) > 0.95


def test_quality_odd_rows(spark, odd, none):
    grades = spark.createDataFrame([(3, 2), (5, 0), (7, 1), (7, None), (None, 1), (99, 2)], "doc_id long, grade int")
    out = quality.grade_texts(odd, quality.train(odd, grades))
    assert out.count() == odd.count() and out.filter("expected_grade is null or isnan(expected_grade)").count() == 0
    assert quality.grade_texts(odd, quality.train(none, grades)).filter("selected").count() == odd.count()
    assert quality.grade_texts(none, quality.train(odd, grades)).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    caught = [r["predicted"] for r in got if r["toxic"] == 1]
    assert sum(caught) / len(caught) > 0.6 and sum(r["predicted"] for r in got if r["toxic"] == 0) <= 3
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in got)


def test_toxicity_counts_in_little_memory():
    text = "".join(map(chr, np.random.default_rng(5).integers(97, 123, toxicity.SLICE)))
    tracemalloc.start()
    toxicity.gram_places(*toxicity.codes([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 0, 1), (4, 1, 0), (4, 1, None), (None, 0, 1), (6, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    out = toxicity.score(odd, model)
    assert set(out.columns) == set(odd.columns) and out.count() == odd.count() and out.filter("score between 0 and 1").count() == odd.count()
    assert toxicity.judge(odd, labels.limit(0)).filter("score = 0.5 and predicted = 0").count() == odd.count()
    assert toxicity.judge(none, labels).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98


def test_rare_labels_are_learned_above_the_bound(spark):
    """2,400 labelled texts, a bound of 200, and 12 texts of the rare label."""
    rare = lambda i: i % 200 == 0
    text = lambda i: "vile zorgle brumpf words " * 3 if rare(i) else f"plain text about topic {i % 7} and more"
    docs = spark.createDataFrame([(i, text(i), "zz" if rare(i) else "en") for i in range(2400)], "doc_id long, text string, lang string")
    model = language.train(docs, language.load_pieces(queries.tokenizer_path("piece_bpe_32k.model")), bound=200)
    shares = Counter("zz" if rare(i) else "en" for i in range(2400) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert model["langs"] == ["en", "zz"] and np.allclose(np.exp(model["prior"]), [shares[x] / shares.total() for x in model["langs"]])
    labels = docs.selectExpr("doc_id", "cast(lang = 'zz' as int) as toxic", "if(lang = 'zz', 0, 1) as grade")
    learned = toxicity.train(docs, labels, bound=200)
    got = {r["lang"]: r["s"] for r in toxicity.score(docs, learned).groupBy("lang").agg(F.avg("score").alias("s")).collect()}
    assert len(learned["places"]) and got["zz"] > 0.5 > 0.05 > got["en"]
    graded = quality.grade_texts(docs, quality.train(docs, labels, bound=200)).join(docs, "doc_id")
    means = {r["lang"]: r["g"] for r in graded.groupBy("lang").agg(F.avg("expected_grade").alias("g")).collect()}
    assert means["zz"] < means["en"] - 0.1


def test_language_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    vocabulary, prob = language.Vocabulary(pieces), np.random.default_rng(0).random((len(pieces) + 1, 2))

    def total(text, k):
        if not text:
            return 1.0
        return sum((prob[pieces.index(text[:n]), k] if text[:n] in pieces else prob[-1, k] if n == 1 else 0) * total(text[n:], k) for n in range(1, len(text) + 1))

    words = ["ab", "aba", "bbab", "cab"]
    matrix, length, doc, word = language.letter_words([" ".join(words)], language.letter_table())
    got = language.forward(matrix, length, vocabulary, prob)[word]
    for i, w in enumerate(words):
        assert got[i] == pytest.approx([np.log(total("▁" + w, k)) for k in (0, 1)])
    counts = language.expect(matrix, length, np.ones(len(length)), vocabulary, prob[:, 0])
    assert (counts * np.array([1, 2, 1, 1, 2, 3, 2, 1])).sum() == pytest.approx(sum(len(w) + 1 for w in words))


def test_language_odd_rows(spark, odd, none):
    pieces = language.load_pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    model = language.train(odd, pieces)
    out = language.identify(odd, model)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == odd.count()
    assert sorted({r[2] for r in got}) == ["en", "und"] and {r[2] for r in got if r[0] in (1, 2, 10)} == {"und"}
    assert {r[2] for r in map(tuple, language.identify(odd, language.train(none, pieces)).collect())} == {"und"}
    assert language.identify(none, model).count() == 0


# ---- tokens, packing, files


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
def test_ids_are_the_librarys(path, kind):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ["", None, " a", "a \n \n b", "it's 'll we'd!!'s", "<|endoftext|> hi", "é́ x", "日本 語", "a\tb", "1234 56½ x²", "ÉCOLE Straße İ"]
    texts += ["".join(rng.choice([" ", " ", "\n", "a", "Be", "é", "'s", "1", "!", ".", "\t", "  ", "<|", "×", "ÿ"]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    ids, n = encoder(path, kind)(texts)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def library_ids(path, rows):
    from tokenizers import Tokenizer

    return [np.array([*e.ids, 2], "<u4") for e in Tokenizer.from_file(path).encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


def check_packing(rows, got):
    want = Counter()
    for (i, _), ids in zip(rows, library_ids(BYTE, rows), strict=True):
        bounds = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    return len(by), -(-sum(r["length"] for r in got) // 1024)


def test_packing_registered_and_odd(spark, odd, none):
    used, bound = check_packing(documents(spark), queries.op6_packing(spark, SF).collect())
    assert used <= 1.15 * bound
    check_packing([(r["doc_id"], r["text"]) for r in odd.collect()], packing.pack(odd, BYTE).collect())
    assert packing.pack(none, BYTE).count() == 0


def test_plans_fill_gaps_exactly():
    rng = np.random.default_rng(9)
    for counts in ({7: 3, 3: 3}, {5: 2, 3: 1, 2: 1}, {4: 1, 3: 1, 2: 1, 1: 1}, dict(zip(range(1, 1024), rng.integers(0, 50, 1023).tolist()))):
        size = 1024 if len(counts) > 10 else 10
        plan = packing.plan_sequences(counts, size)
        used = Counter()
        for lengths, n in plan:
            assert sum(lengths) <= size and n > 0
            for x in lengths:
                used[x] += n
        assert used == Counter({k: v for k, v in counts.items() if v})
        total = sum(k * v for k, v in counts.items())
        large = sum(v for k, v in counts.items() if 2 * k > size)  # no two of them share a sequence
        assert sum(n for _, n in plan) <= max(-(-total // size), large) * 1.006


def test_token_files_round_trip(spark, odd, none):
    rows = sorted(documents(spark))
    got = sorted((tuple(r) for r in queries.op7_token_files(spark, SF).collect()), key=lambda r: r[1])
    start, want = 0, []
    for (i, _), ids in zip(rows, library_ids(WORD, rows), strict=True):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    manifest = token_files.write_token_files(odd, token_files.token_folder(spark), WORD, docs_per_file=4)
    read = token_files.read_token_files(manifest, with_ids=True).orderBy("start").collect()
    known = Counter((i, x.tobytes()) for (i, _), x in zip([(r["doc_id"], r["text"]) for r in odd.collect()], library_ids(WORD, [(0, r["text"]) for r in odd.collect()])))
    assert Counter((r["doc_id"], np.array(r["ids"], "<u4").tobytes()) for r in read) == known
    order = [r["doc_id"] for r in read]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    some = token_files.read_token_files(manifest, wanted=[3, 12, 77]).collect()
    assert sorted(r["doc_id"] for r in some) == [3, 3, 12]
    assert token_files.read_token_files(token_files.write_token_files(none, token_files.token_folder(spark), WORD)).count() == 0


def test_token_file_is_plain_zstd_and_checked(spark, tmp_path):
    import zstandard

    docs = spark.createDataFrame([(1, "some words"), (2, "more words here")], "doc_id long, text string")
    manifest = token_files.write_token_files(docs, str(tmp_path), WORD)
    path = manifest.first()["path"]
    raw = open(path, "rb").read()
    ids = np.frombuffer(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(), "<u4")
    assert ids.tolist() == np.concatenate(library_ids(WORD, [(1, "some words"), (2, "more words here")])).tolist()
    open(path, "wb").write(raw[:9] + bytes([raw[9] ^ 1]) + raw[10:])
    with pytest.raises(Exception):
        token_files.read_token_files(manifest).collect()


# ---- url rules


def test_urls_odd_rows(spark):
    urls = [
        (1, "http://example.com/en/x"), (2, "https://WWW.Example.COM/en/?q"), (3, "x://a.net/es/"), (4, "a.net/es/"), (5, None), (6, ""), (7, "http://net/fr/1#t"),
        (8, "http://notexample.com/en/"), (9, "http://com?x"), (10, "://com/"), (None, "http://b.example.com/en/"), (1, "http://example.com/en/x"),
        (11, "http://" + "a." * 20_000 + "com/" + "y" * 100_000), (12, "http://a.net/e"), (13, "http://com"),
    ]
    df = spark.createDataFrame([(i, u, "h", "k") for i, u in urls], "page_id long, url string, host string, keys string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()}
    assert got == {
        (1, "example.com/en/", "block"), (2, "www.example.com/en/", "allow"), (3, "net/es/", "block"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"),
        (7, "net/fr/", "block"), (8, "com/", "allow"), (9, None, "allow"), (10, "com/", "allow"), (None, "example.com/en/", "block"), (11, "com/", "allow"), (12, None, "allow"), (13, None, "allow"),
    }
    assert url_filter.judge_urls(df, rules).count() == len(urls)
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert url_filter.judge_urls(df, rules.limit(0)).filter("rule is null and verdict = 'allow'").count() == len(urls)


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2")).cache()
    listed = universe.filter("h1 % 7 = 0")
    levels = url_filter.build_cascade(listed, universe)
    pdf = universe.toPandas()
    found = url_filter.member([levels], pdf["h1"].to_numpy(), pdf["h2"].to_numpy())
    assert len(levels) > 2 and (found == (np.fmod(pdf["h1"].to_numpy(), 7) == 0)).all()
