import math

import numpy as np
import pytest

from bookstrata.llm import op3_vectors as V
from tests.llm.helpers import needs_data, same_as_sql

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, n string, kept string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "u", "n", "k") for i, v in vectors], SCHEMA)


def brute(vectors, cosine):
    """n_links, component and kept by all pairs."""
    fit = {}
    for at, (i, v) in enumerate(vectors):
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            fit[at] = V.unit(x[None])[0]
    near = {a: {b for b in fit if a != b and len(fit[a]) == len(fit[b]) and fit[a] @ fit[b] >= cosine} for a in fit}
    out = []
    for at, (i, _) in enumerate(vectors):
        seen, todo = {at}, [at]
        while todo:
            for b in near.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [vectors[b][0] for b in seen if vectors[b][0] is not None]
        component = min(ids) if ids else None
        out.append((i, len(near.get(at, ())), component, i == component))
    return out


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@needs_data
def test_equals_sql(spark):
    same_as_sql(spark, "op3_near_vectors")


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    vectors = [(1, None), (2, []), (3, [0.0] * 16), (4, [nan] + [1.0] * 15), (5, [None] + [1.0] * 15), (6, [inf] * 16)]
    vectors += [(7, base), (8, base), (8, base), (9, base * 1e-30), (10, base * 1e30), (None, base + 0.01), (None, -base), (11, [1.0, 2.0]), (12, [1.0, 2.1])]
    vectors += [(13, base[:15])]
    got = V.near_vectors(frame(spark, vectors))
    assert rows_of(got) == sorted(map(repr, brute(vectors, 0.9)))


def test_empty(spark):
    assert V.near_vectors(frame(spark, [])).count() == 0
    assert rows_of(V.near_vectors(frame(spark, [(1, None)]))) == ["(1, 0, 1, True)"]


def test_recall_and_tiles(spark, monkeypatch):
    """Groups around the threshold, with tiles far smaller than a bucket; nothing below links, 99 % above does."""
    monkeypatch.setattr(V, "TILE", 40)
    rng = np.random.default_rng(2)
    vectors = []
    for g in range(12):
        centre = rng.standard_normal(32)
        for _ in range(150 if g == 0 else 25):
            vectors.append((len(vectors), centre + rng.standard_normal(32) * rng.choice([0.05, 0.2, 0.33])))
    want = {r[0]: r for r in brute(vectors, 0.9)}
    got = {r.vec_id: r for r in V.near_vectors(frame(spark, vectors)).collect()}
    assert all(got[i].n_links <= want[i][1] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(r[1] for r in want.values())
    assert sum(got[i].component_id == want[i][2] for i in want) >= 0.99 * len(want)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = V.unit(rng.standard_normal((200, 64))), V.unit(rng.standard_normal((200, 64)))
    y[:100] = V.unit(x[:100] + y[:100] * 0.4)
    plan = V.Plan.of(10_000, 64)
    turns = V.rotations(64, plan.rotations)
    assert np.allclose(turns[0] @ turns[0].T, np.eye(64))
    _, signs, factor, _, _ = V.encode(x, turns, plan)
    _, _, _, small, step = V.encode(y, turns, plan)
    bound = V.upper_bounds(np.unpackbits(signs, axis=1).astype(np.float32) * 2 - 1, factor, small, step)
    assert (bound >= x @ y.T).mean() > 0.9999
    # The estimate itself, averaged over rotations, is unbiased.
    estimates = []
    for seed in range(400):
        turn = V.rotations(64, 1, seed)[0]
        sign = np.where(turn @ x[0] > 0, 1, -1) / 8
        estimates.append(sign @ (turn @ y[0]) / (sign @ (turn @ x[0])))
    assert abs(np.mean(estimates) - x[0] @ y[0]) < 0.02


@pytest.mark.parametrize("n", [1, 100, 51_282, 10**9])
def test_plan(n):
    plan = V.Plan.of(n, 64)
    found = 1 - (1 - (1 - math.acos(0.9) / math.pi) ** plan.bits) ** plan.bands
    assert found >= 0.999 and plan.rotations * 64 >= plan.bits * plan.bands
    assert n / 2**plan.bits <= V.BUCKET
