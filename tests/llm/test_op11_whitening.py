import math

import numpy as np
import pytest

from bookstrata.llm import op11_whitening as W
from tests.llm.helpers import SF, needs_data

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n string, dim string, whitened string"


def frame(spark, rows):
    full = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", "n", "d", "w") for i, v in rows]
    return spark.createDataFrame(full, SCHEMA)


def brute(vectors, k=32, weights="count"):
    """n, S, deviations, whitened rows, shares of the trace, straight from the definition."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = x if weights == "count" else [list(v) for v in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = lambda rows: np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in rows])
    covariance = centred(fit).T @ centred(fit) / n
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:k]
    return n, deviations, centred(x) @ directions[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance)


def compare(got, ids, vectors, k=32, weights="count"):
    n, deviations, rows, shares = brute(vectors, k, weights)
    k = len(shares)
    assert len(got) == len(ids) * k
    place = {i: at for at, i in enumerate(ids)}
    signs = np.zeros(k)
    for r in sorted(got, key=lambda r: -abs(rows[place[r.vec_id]][r.component - 1])):
        want = rows[place[r.vec_id]][r.component - 1]
        signs[r.component - 1] = signs[r.component - 1] or np.sign(want * r.whitened)
        assert abs(r.whitened * signs[r.component - 1] - want) < 1e-6
        assert r.n == n and r.deviation == deviations[place[r.vec_id]]
        assert abs(r.explained - shares[r.component - 1]) <= 1e-9 * shares[r.component - 1]
        assert r.identity_error < 1e-8


@needs_data
def test_sample_equals_the_definition(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    from bookstrata.llm.registry import QUERIES

    got = QUERIES["op11_whitening"](spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    compare(got.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("weights", ["count", "one"])
def test_multiplicities_are_weights(spark, monkeypatch, weights):
    """A third of all rows are one vector; batches are small."""
    monkeypatch.setattr(W, "BATCH", 17)
    rng = np.random.default_rng(1)
    vectors = [rng.standard_normal(6) * [1, 2, 3, 4, 5, 90] for _ in range(300)]
    vectors += [vectors[0]] * 150 + [v + 1e-9 for v in vectors[1:20]]
    ids = list(range(len(vectors)))
    got = W.whiten(frame(spark, list(zip(ids, vectors))), components=4, weights=weights).collect()
    compare(got, ids, vectors, 4, weights)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(3)) for i in range(20)]
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [nan, 1.0, 2.0]), (94, [1.0, -inf, 0.0])]
    got = W.whiten(frame(spark, good + odd)).collect()
    compare(got, [i for i, _ in good], [v for _, v in good])
    # Vectors of another length are fitted among themselves; null and repeated ids are rows.
    both = W.whiten(frame(spark, good + [(5, [1.0]), (5, [3.0]), (None, [1.0])]))
    assert both.where("n = 3").count() == 3 and both.where("n = 20").count() == 60
    assert both.where("vec_id is null").count() == 1


def test_no_extent(spark):
    got = W.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in got] == [(0.0, 0.0, 1.0, 0)] * 4
    # Fewer distinct vectors than dimensions: one component has all extent.
    got = W.whiten(frame(spark, [(1, [0.5, 0.25, 1.0]), (2, [0.75, 0.5, 2.0])])).collect()
    assert sorted((r.component, round(abs(r.whitened), 9)) for r in got) == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.0), (3, 0.0), (3, 0.0)]
    assert all(abs(r.explained - (r.component == 1)) < 1e-9 for r in got)


def test_empty(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, None)])).count() == 0


def test_large_numbers(spark):
    """Sums and squares beyond 64 bits stay exact or are held at the end."""
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e12, 3.0]), (4, [0.0, 4.0])]
    got = {(r.vec_id, r.component): r for r in W.whiten(frame(spark, rows)).collect()}
    assert len(got) == 8 and got[1, 1].deviation == W.TOP
    near = [(1, [1e9, 0.0]), (2, [1e9 + 1, 0.5]), (3, [1e9 + 2, 0.0])]
    compare(W.whiten(frame(spark, near)).collect(), [1, 2, 3], [v for _, v in near])


def test_packing_is_one_to_one():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-(1 << b), 1 << b, (50, 5)) for b in (3, 7, 15, 31, 62)]) + W.SHIFT
    import pyarrow as pa

    assert (W.unpacked(pa.array(W.packed(x), pa.binary()), 5) == x).all()
    assert W.packed(x[:1]) == W.packed(x[:1].copy()) and len(W.packed(x[:1])[0]) == 5
