"""Blocks of vectors that meet in runs: each near pair once, a block sent once to a run, the same links."""

import numpy as np
import pytest

from tracefield.llm import cover_tree


@pytest.mark.parametrize("side", [1, 3, 8])
def test_every_near_pair_meets_once(side):
    rng = np.random.default_rng(5)
    near = np.triu(rng.random((20, 20)) < 0.4)
    near |= near.T | np.eye(20, dtype=bool)
    partners = {b: np.flatnonzero(near[b]).tolist() for b in range(20)}
    sent = cover_tree.meetings(partners, side)
    at = {(i, j): {b for b, *ij in sent if tuple(ij) == (i, j)} for _, i, j in sent}
    for a, others in partners.items():
        for b in others:
            assert {a, b} <= at[tuple(sorted((a // side, b // side)))]
    assert len(sent) == len(set(sent)) and len(sent) <= near.sum() and (side == 1 or len(sent) < near.sum() / 1.5)


def test_runs_are_bounded():
    assert cover_tree.runs_of(13, 64, 8) == 1
    assert cover_tree.runs_of(10**5, 64, 8) == cover_tree.SIDE
    assert cover_tree.runs_of(10**5, 4096, 8) == 1


def test_true_cells():
    mask = np.random.default_rng(1).random((37, 53)) < 0.1
    assert all(np.array_equal(x, y) for x, y in zip(cover_tree.cells_of(mask), np.nonzero(mask), strict=True))
    assert [len(x) for x in cover_tree.cells_of(np.zeros((3, 4), bool))] == [0, 0]


def test_links_do_not_depend_on_runs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((60, 8)), 5, axis=0) + 0.25 * rng.standard_normal((300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(cover_tree, "BLOCK", 16)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T >= 0.9).sum(1) - 1).tolist()
    for side in (1, 4):
        monkeypatch.setattr(cover_tree, "runs_of", lambda *_, side=side: side)
        got = {r.vec_id: r.n_links for r in cover_tree.near_vectors(rows).collect()}
        assert [got[i] for i in range(300)] == want
