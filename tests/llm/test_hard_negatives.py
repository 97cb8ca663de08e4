"""Hard negatives: bit-planes against plain products, and whole results against brute force."""

import numpy as np
import pytest
from decidra.llm import hard_negatives as H
from pyspark.sql import functions as F


def brute(rows, anchor, k=H.POSITIVES, m=H.NEGATIVES, low=H.LOW, high=H.HIGH):
    """rows: (id, label, whole numbers), each distinct row once."""
    width = max((len(v) for _, _, v in rows), default=0)
    rows = sorted({(i, y, tuple(v) + (0,) * (width - len(v))) for i, y, v in rows})
    out = []
    for i in sorted({r[0] for r in rows if anchor(r[0])}):
        _, label, own = min(r for r in rows if r[0] == i)
        score = lambda r: sum(a * b for a, b in zip(own, r[2]))  # noqa: B023, E731
        ranked = sorted(rows, key=lambda r: (-score(r), r[0]))
        for p in [r for r in ranked if r[1] == label and r[0] != i][:k]:
            fit = [r for r in ranked if r[1] != label and low * score(p) <= 100 * score(r) <= high * score(p)][:m]
            out += [(i, p[0], n + 1, r[0], score(p), score(r)) for n, r in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("least", "most"), [(-1, 1), (-256, 256), (0, 5), (-7, 0), (-(10**5), 10**5), (-(2**30), 2**30)])
def test_planes_sum_to_the_products(least, most):
    rng = np.random.default_rng(3)
    rows, anchors = rng.integers(least, most + 1, (50, 9)), rng.integers(least, most + 1, (6, 9))
    seen = []

    def drop(low, high, open_):
        exact = anchors @ rows.T
        assert (low <= exact).all() and (exact <= high).all()
        seen.append((high - low).max())
        return open_

    i, j, score = H.survivors(anchors, H.Planes(rows), np.ones((6, 50), dtype=bool), drop)
    assert len(i) == 300 and (score == (anchors @ rows.T)[i, j]).all()
    assert seen == sorted(seen, reverse=True) and seen[-1] == 0  # intervals tighten to a point


def test_candidates_are_dropped_before_the_last_plane(monkeypatch):
    rng = np.random.default_rng(4)
    rows, anchors = np.floor(256 * rng.normal(size=(4000, 16))).astype(np.int64), np.floor(256 * rng.normal(size=(8, 16))).astype(np.int64)
    opens = []
    planes = H.Planes(rows)
    taken = []
    monkeypatch.setattr(planes, "plane", lambda b, kind: taken.append(b) or ((rows >> b) & 1).astype(kind))
    i, j, score = H.nearest(anchors, planes, np.ones((8, 4000), dtype=bool), np.arange(4000), 5)
    exact = anchors @ rows.T
    for a in range(8):
        assert sorted(j[i == a]) == sorted(np.lexsort((np.arange(4000), -exact[a]))[:5])
    assert min(taken) > 0 and opens == []


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, v array<int>")


@pytest.mark.parametrize("spread", [1, 3, 200])
def test_against_brute_force(spark, spread, monkeypatch):
    """Small spreads make ties everywhere."""
    monkeypatch.setattr(H, "BLOCK", 40)
    rng = np.random.default_rng(spread)
    rows = [(int(i), int(rng.integers(0, 3)), rng.integers(-spread, spread + 1, 6).tolist()) for i in range(150)]
    rows += [rows[0], rows[7], (151, 5, [1] * 6), (20, 1, [9] * 6), (160, 0, [1, 2]), (170, 1, []), (180, 1, [1] * 9)]
    out = H.mine(frame(spark, rows), F.col("id") % 10 == 0)
    assert sorted(map(tuple, out.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_hot_vector_and_range_ends(spark):
    """Many equal rows: ties go by id, through all blocks. Scores exactly at 30 and 90 percent belong to the range."""
    rows = [(i, i % 2, [10, 0]) for i in range(1, 400)] + [(0, 0, [10, 0]), (500, 0, [10, 10]), (501, 1, [3, 0]), (502, 1, [9, 0]), (503, 1, [2, 99])]
    out = H.mine(frame(spark, rows), F.col("id") == 0).collect()
    assert sorted(map(tuple, out)) == brute(rows, lambda i: i == 0)
    assert {r.negative_id for r in out} == {501, 502}


def test_negative_and_zero_scores(spark):
    rows = [(0, 0, [1, 0]), (1, 0, [-5, 0]), (2, 0, [0, 1]), (3, 1, [-4, 0]), (4, 1, [0, 7]), (5, 1, [-2, 0])]
    assert sorted(map(tuple, H.mine(frame(spark, rows), F.col("id") == 0).collect())) == brute(rows, lambda i: i == 0) == [(0, 2, 1, 4, 0, 0)]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5]), (1, 1, [0.25]), (2, None, [1.0]), (3, 1, None), (4, 1, [None]), (5, 1, [nan]), (6, 2, [inf]), (None, 2, [0.1]), (7, 2, [0.0999]), (8, 2, [-inf])]
    found = H.numbers(spark.createDataFrame(rows, "id long, label int, embedding array<float>"))
    assert sorted((r.id, r.label, r.v) for r in found.collect()) == [(0, 1, [128]), (1, 1, [64]), (7, 2, [25])]
    assert [tuple(r) for r in H.mine(found, F.col("id") == 0).collect()] == [(0, 1, 1, 7, 8192, 3200)]
    assert H.mine(found.limit(0), F.col("id") == 0).collect() == []
