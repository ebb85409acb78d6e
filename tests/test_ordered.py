"""Bucketed ordered operators equal the plain window forms, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracefield.operators import dedup as dd
from tracefield.operators import ordered as od
from tracefield.operators import strategy as st
from tracefield.operators.quantiles import exact_median


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(0)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", i, rng.randrange(1000), rng.choice([None, 1, 2, 3])) for i in range(3000)]
    return spark.createDataFrame(data, "k string, i bigint, t bigint, v int").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def W():
    return Window.partitionBy("k").orderBy("t", "i")


def BUCKET():
    return F.floor(F.col("t") / 37)


def test_lag_and_carry(rows):
    same(od.lag_value(rows, ["k"], ["t", "i"], BUCKET(), F.col("v"), "x").select("i", "x"), rows.select("i", F.lag("v").over(W()).alias("x")))
    prev = W().rowsBetween(Window.unboundedPreceding, -1)
    same(od.carry_last(rows, ["k"], ["t", "i"], BUCKET(), F.col("v"), "x").select("i", "x"), rows.select("i", F.last("v", True).over(prev).alias("x")))
    nxt = W().rowsBetween(0, Window.unboundedFollowing)
    same(od.carry_next(rows, ["k"], ["t", "i"], BUCKET(), F.col("v"), "x", True).select("i", "x"), rows.select("i", F.first("v", True).over(nxt).alias("x")))


def test_running(rows):
    up = W().rowsBetween(Window.unboundedPreceding, 0)
    same(od.running_sum(rows, ["k"], ["t", "i"], BUCKET(), F.col("t"), "x").select("i", "x"), rows.select("i", F.sum("t").over(up).alias("x")))
    same(od.running_max(rows, ["k"], ["t", "i"], BUCKET(), F.col("v"), "x").select("i", "x"), rows.select("i", F.max("v").over(up).alias("x")))
    same(od.dense_index(rows, ["k"], ["t", "i"], BUCKET(), "x").select("i", "x"), rows.select("i", (F.row_number().over(W()) - 1).cast("bigint").alias("x")))


def test_frames(rows):
    last5 = W().rowsBetween(-4, 0)
    same(od.rows_frame_sum(rows, ["k"], ["t", "i"], BUCKET(), F.col("t"), 5, "x", block=16).select("i", "x"), rows.select("i", F.sum("t").over(last5).alias("x")))
    span = Window.partitionBy("k").orderBy("t").rangeBetween(-29, 0)
    same(od.range_count(rows, ["k"], F.col("t"), 30, "x").select("i", "x"), rows.select("i", F.count(F.lit(1)).over(span).alias("x")))


def test_asof(spark, rows):
    right = rows.filter("v = 1").select("k", F.col("t").alias("p"))
    got = {(r.i): r.x for r in od.next_at_or_after(rows, right, ["k"], "t", "p", 41, "x").collect()}
    back = {(r.i): r.x for r in od.last_at_or_before(rows, right, ["k"], "t", "p", 41, "x").collect()}
    pdf = rows.toPandas()
    for k, g in pdf.groupby("k"):
        p = np.sort(g[g.v == 1].t.to_numpy())
        for i, t in zip(g.i, g.t):
            a = np.searchsorted(p, t)
            assert got[i] == (p[a] if a < len(p) else None)
            b = np.searchsorted(p, t, "right") - 1
            assert back[i] == (p[b] if b >= 0 else None)


def test_exact_median(rows):
    got = {r.k: r["median"] for r in exact_median(rows, ["k"], F.col("t")).collect()}
    want = rows.toPandas().groupby("k").t.median().to_dict()
    assert got == want
    assert exact_median(rows, [], F.col("t")).first()["median"] == rows.toPandas().t.median()


def test_similar_scenarios_against_numpy(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(0, 4, (500, 6)).astype(float)
    t = rng.integers(0, 4, (7, 6)).astype(float)
    t[0] = 0
    hist = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(h)], "id bigint, vec array<double>").repartition(5)
    targ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "id bigint, vec array<double>")
    got = st.similar_scenarios(targ, hist, 9).toPandas()
    for i in range(7):
        n = np.linalg.norm(t[i]) * np.linalg.norm(h, axis=1)
        s = np.where(n > 0, h @ t[i] / np.where(n > 0, n, 1), 0).round(9)
        order = np.lexsort((np.arange(500), -s))[:9]
        g = got[got.target_id == i].sort_values("rank")
        assert list(g.id) == list(order) and np.allclose(g.similarity, s[order])


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(12)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        texts.append(" ".join(b))
        for _ in range(4):
            c = list(b)
            c[rng.randrange(len(c))] = "changed"
            texts.append(" ".join(c))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r.id: r.group for r in dd.near_duplicates(df, "id", "text", 0.95).collect()}

    def sh(x):
        w = x.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = [sh(x) for x in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.95:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts)) if sum(find(j) == find(i) for j in range(len(texts))) > 1}


def test_components_on_a_long_chain_and_a_hub(spark):
    from tracefield.operators import graph as gr

    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    e = spark.createDataFrame(chain + hub, "u bigint, v bigint")
    got = gr.connected_components(e).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(0, 201), (1000, 400)}


def test_whole_components_leave_the_rounds(spark, monkeypatch):
    """Stars of three, a chain and a few random edges: what is one star already is not written again."""
    import random

    from tracefield.operators import graph as gr

    written, keep = [], gr.checkpoint
    monkeypatch.setattr(gr, "checkpoint", lambda df: (lambda t: (written.append((t.columns, t.count())), t)[1])(keep(df)))
    rng = random.Random(7)
    edges = [(f"s{i}.{j}", f"s{i}.0") for i in range(100) for j in (1, 2)] + [(f"c{i}", f"c{i + 1}") for i in range(10)]
    edges += [(f"r{rng.randrange(30)}", f"r{rng.randrange(30)}") for _ in range(20)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    got = [(r.node, r.component) for r in gr.connected_components(spark.createDataFrame(edges * 2, "u string, v string")).collect()]
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert len(got) == len(linked) and dict(got) == {x: top(x) for x in linked}
    rounds = [n for columns, n in written if sorted(columns) == ["u", "v"]]
    assert rounds[0] > 200 and max(rounds[1:]) < 60
