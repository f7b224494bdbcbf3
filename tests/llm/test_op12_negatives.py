import math
import re

import numpy as np
import pytest

from bookstrata.llm import op12_negatives as H
from tests.llm.helpers import needs_data, same_as_sql

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, dim string, tree string, x string, rank string, chunk int"


def frame(spark, rows):
    """rows: (vec_id, vector, label)."""
    full = [(i, None if v is None else [None if c is None else float(c) for c in v], s, "u", "d", "t", "x", "r", 1) for i, v, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def brute(rows, every=50, n=5, m=3):
    """All anchors against all rows, with whole numbers of any size."""
    fit = []
    for i, v, s in rows:
        if s is not None and v is not None and all(c is not None and math.isfinite(256 * c) for c in v):
            fit.append((i, [math.floor(256 * float(c)) for c in v], s))
    hold = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for a, (i, v, s) in enumerate(fit):
        if i is None or i % every:
            continue
        scored = [(hold(sum(p * q for p, q in zip(v, w))), j is None, j or 0, j, t) for b, (j, w, t) in enumerate(fit) if b != a and len(w) == len(v)]
        scored.sort(key=lambda r: (-r[0], r[1], r[2]))
        for p in [r for r in scored if r[4] == s][:n]:
            inside = [r for r in scored if r[4] != s and 50 * p[0] <= 100 * r[0] <= 95 * p[0]][:m]
            out += [(i, p[3], k, r[3], p[0], r[0]) for k, r in enumerate(inside, 1)]
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@needs_data
def test_equals_sql(spark):
    same_as_sql(spark, "op12_hard_negatives")


def groups(seed, n, dim, labels, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, dim))
    return [(k, centres[k % 7 % labels] + rng.standard_normal(dim) * spread, k % labels) for k in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_equals_all_pairs_in_many_cells(spark, monkeypatch, spread):
    """Many small trees and chunks, vectors near and far from their centres, ties and repeated rows."""
    monkeypatch.setattr(H, "BLOCK", 6)
    monkeypatch.setattr(H, "CHUNK", 150)
    rows = groups(4, 900, 12, 4, spread)
    rows += rows[50:60] + [(i + 10_000, v, s) for i, v, s in rows[:40]] + [(None, v, s + 1) for _, v, s in rows[:30]]
    assert rows_of(H.hard_negatives(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (50, None, 1), (100, [1.0, None], 1), (150, [1.0, nan], 1), (200, [inf, 1.0], 1), (250, [1.0, 2.0], None)]
    rows += [(1, [1.0, 1.9], 1), (2, [1.0, 1.5], 2), (2, [1.0, 1.5], 2), (None, [1.0, 1.5], 2), (None, [1.0, 1.6], 1), (3, [1.0, 2.0, 3.0], 1), (300, [], 5), (301, [], 5), (302, [], 6)]
    rows += [(350, [-1.0, -2.0], 3), (4, [1.0, 2.0], 3), (0, [1.0, 2.0], 1), (-50, [0.5, 1.0], 1)]
    got = rows_of(H.hard_negatives(frame(spark, rows)))
    assert got == brute(rows) and len(got) > 10


def test_large_numbers(spark):
    """Components beyond what doubles multiply exactly, and scores beyond 64 bits."""
    rng = np.random.default_rng(6)
    rows = [(k, rng.standard_normal(3) * 10.0 ** rng.choice([0, 6, 10, 20, 200]), k % 2) for k in range(200)]
    assert rows_of(H.hard_negatives(frame(spark, rows))) == brute(rows)


def test_nothing(spark):
    assert H.hard_negatives(frame(spark, [])).count() == 0
    assert H.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0
    assert H.hard_negatives(frame(spark, [(50, [1.0], 1)])).count() == 0


def test_spanning_tree_is_least():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((40, 5))
    order, parent, edge = H.spanning_tree(x)
    away = np.linalg.norm(x[:, None] - x[None], axis=2)
    # Kruskal on all edges.
    part = list(range(len(x)))
    total = 0.0
    for i, j in sorted(((i, j) for i in range(40) for j in range(i)), key=lambda e: away[e]):
        if part[i] != part[j]:
            total += away[i, j]
            part = [part[i] if p == part[j] else p for p in part]
    assert abs(edge.sum() - total) < 1e-9
    assert sorted(order) == list(range(40)) and (parent == -1).sum() == 1
    assert all(order[parent[i]] < order[i] for i in range(40) if parent[i] >= 0)


def test_bounds_spare_most_scores():
    """With anchors close together a walk scores few candidates after the root, and finds all it is asked for."""
    rng = np.random.default_rng(8)
    anchors = np.floor(256 * (rng.standard_normal(16) + rng.standard_normal((50, 16)) * 0.01))
    rows = np.floor(256 * rng.standard_normal((4000, 16)))
    order, parent, edge = H.spanning_tree(anchors)
    by_place = np.argsort(order)
    scores = H.Scores(anchors[by_place], rows)
    places = np.where(parent[by_place] >= 0, order[parent[by_place]], -1)
    bottom, top = 400_000, 500_000
    scored = 0
    for k, pick, found in H.walk(scores, places, edge[by_place], lambda k, low, high: (high >= bottom) & (low <= top)):
        exact = rows @ anchors[by_place[k]]
        scored += len(pick) if k else 0
        assert set(np.flatnonzero((exact >= bottom) & (exact <= top))) <= set(pick)
        assert (found == exact[pick]).all()
    assert 0 < scored < 0.3 * 49 * 4000


def test_extra_columns_keep_their_names(spark):
    got = H.hard_negatives(frame(spark, groups(9, 60, 4, 2, 0.3)))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert not re.search("Cartesian", got._jdf.queryExecution().toString())
