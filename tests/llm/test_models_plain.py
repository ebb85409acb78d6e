"""Trained models against plain versions: scorers by dictionary, losses by differences, sums over long words, whole texts."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tracefield.llm import language, learn, pii, quality, toxicity
from tracefield.llm.common import table

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def gram_place(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & M64
    return ((h * 0xBF58476D1CE4E5B9) & M64) >> 44


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def test_toxicity_scores_are_sums_over_a_dictionary_of_ngrams(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    weight = dict(zip(model["places"].tolist(), model["weights"].tolist(), strict=True))
    assert len(weight) > 1000

    def plain(text: str | None) -> float:
        t = f" {(text or '').lower()} "
        grams = {t[i : i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1)}
        return sigmoid(sum(weight.get(p, 0.0) for p in {gram_place(g) for g in grams}) + model["bias"])

    for r in toxicity.score(docs, model).limit(60).collect():
        assert r["score"] == pytest.approx(plain(r["text"]), abs=1e-9)


def test_quality_grades_are_sums_over_dictionaries_of_words_and_shapes(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    grades = table(spark, SF, "labels").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    model = quality.train(docs, grades)
    weight, theta = model["weight"].astype(float), model["theta"]
    word = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")

    def mix(x: int) -> int:
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
        return x ^ x >> 31

    def word_hash(w: str) -> int:
        total, data = 0, re.sub("[A-Z]", lambda m: m.group().lower(), w).encode()
        for i, c in enumerate(data):
            v = ((c + 1) * pow(0x9E3779B97F4A7C15, i & 63, 1 << 64)) & M64
            total += mix((v + (i >> 6)) & M64) if len(data) > 64 and i >= 64 else v
        return mix((total + len(data)) & M64)

    def plain(text: str | None) -> list[float]:
        text = text or ""
        z, hashes = 0.0, [word_hash(w) for w in word.findall(text)]
        for h in hashes:
            z += weight[h >> 47] / len(hashes)
        z += weight[0] * sum(a == b for a, b in zip(hashes, hashes[1:])) / max(1, len(hashes))
        kinds = [65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in text.encode()]
        runs = [k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k]
        for n in quality.SHAPE_SIZES:
            for i in range(len(runs) - n + 1):
                g = 0
                for k in runs[i : i + n]:
                    g = g * 257 + k + 1
                z += weight[mix((g + (n << 56)) & M64) >> 47] / len(runs)
        return [sigmoid(z * quality.SCALE - t) for t in theta]

    for r in quality.grade_texts(docs, model).join(docs, "doc_id").limit(40).collect():
        tails = plain(r["text"])
        assert r["tails"] == pytest.approx(tails, abs=1e-9) and r["expected_grade"] == pytest.approx(sum(tails), abs=1e-9)


def check_gradient(loss, x: np.ndarray, places: list[int]):
    _, g = loss(x)
    for i in places:
        step = np.zeros(len(x))
        step[i] = 1e-5
        assert g[i] == pytest.approx((loss(x + step)[0] - loss(x - step)[0]) / 2e-5, rel=1e-4, abs=1e-8)


def test_losses_have_the_gradients_they_give():
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 30, 8)) for _ in range(50)]
    y, ratio = r.integers(0, 2, 50).astype(float), r.normal(size=30)
    check_gradient(toxicity.scaled_logistic(learn.Rows(rows, None, 30), y, ratio, 0.7), r.normal(size=31), list(range(31)))
    x = learn.Rows([p % quality.PLACES for p in rows], [r.random(len(p)) for p in rows], quality.PLACES)
    grade = r.integers(0, 4, 50)
    loss = quality.cumulative_link(x, grade, r.random(50) + 0.5, 3, 0.05)
    check_gradient(loss, np.concatenate([r.normal(size=quality.PLACES) * 0.1, [-1.0, 0.2, -0.3]]), [*range(30), quality.PLACES, quality.PLACES + 1, quality.PLACES + 2])


def test_words_of_any_length_are_summed_whole():
    """Words of 500 and 5,000 letters and a piece of 30: logarithms of the plain sums, every letter counted."""
    long_piece = "▁" + "ab" * 15
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", long_piece]
    vocabulary, prob = language.Vocabulary(pieces), np.random.default_rng(0).random((len(pieces) + 1, 2)) * 1e-5
    rng = random.Random(6)
    words = ["ab" * 40, *("".join(rng.choice("abc") for _ in range(n)) for n in (47, 48, 49, 500, 5000)), "ab", "c"]

    def plain(text: str, k: int) -> float:
        logs = [0.0]
        for end in range(1, len(text) + 1):
            terms = [
                logs[i] + math.log(prob[pieces.index(text[i:end]) if text[i:end] in pieces else -1, k])
                for i in range(max(0, end - 31), end) if text[i:end] in pieces or end - i == 1
            ]
            top = max(terms)
            logs.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return logs[-1]

    found, length, doc, word = language.letter_words([" ".join(words)], language.letter_table())
    got = language.forward(found, length, vocabulary, prob)[word]
    for i, w in enumerate(words):
        assert got[i] == pytest.approx([plain("▁" + w, k) for k in (0, 1)], rel=1e-9)
    counts = language.expect(found, length, np.ones(len(length)), vocabulary, prob[:, 0])
    sizes = np.array([*map(len, pieces), 1])
    assert (counts * sizes).sum() == pytest.approx(sum(len(w) + 1 for w in words), rel=1e-9)
    # one word's counts are the derivatives of its log probability
    one = language.Words.of([words[4]])
    each = language.expect(one, one.lengths, np.ones(1), vocabulary, prob[:, 0])
    for p in range(len(pieces)):
        more = prob.copy()
        more[p, 0] *= 1 + 1e-6
        rise = language.forward(one, one.lengths, vocabulary, more) - language.forward(one, one.lengths, vocabulary, prob)
        assert each[p] == pytest.approx(rise[0, 0] / 1e-6, rel=1e-3, abs=1e-3)


def test_text_of_one_run_of_letters(spark):
    pieces = [*"abcdefgh", "▁", "▁ab", "cde", "fgh"]
    rows = [(i, ("abcde" if i % 2 else "fghab") * (1 + i % 3), "xx" if i % 2 else "yy") for i in range(60)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), pieces)
    long = spark.createDataFrame([(1, "abcde" * 100), (2, "fghab" * 100)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(long, model).collect()} == {1: "xx", 2: "yy"}


def test_personal_data_is_learned_from_whole_texts(spark):
    """1,000 candidate tokens, personal data only after the first 600: it sets the pair weights all the same."""
    filler = " ".join(f"n{i % 300}" for i in range(600))
    late = " ".join(f"call +49 151 2345 {1000 + i % 7} now" for i in range(100))
    docs = spark.createDataFrame([(i, f"{filler} {late}") for i in range(3)], "doc_id long, text string")
    assert len(pii.tokens(f"{filler} {late}")) >= 900
    model = pii.learn(docs)
    phone = pii.LABELS.index("phone")
    assert model["skip"][phone, phone] > 0.5 and model["chain"][phone, phone] > 0.5
