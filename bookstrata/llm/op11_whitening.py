"""Whitening of vectors through a weighted covariance of distinct vectors.

Components become integers, ``floor(SCALE * c) + SHIFT``, and rows with equal integers are one distinct vector with its
number of rows. The fit uses each distinct vector once with that number as its weight (or with weight one): exact sums by
dimension, then the weighted product of vectors centred by ``sum / n``, a partial matrix for each batch of vectors. The
unit eigenvectors of the covariance, by falling eigenvalue, are the components; each distinct vector is projected on
them once, divided by the square root of the eigenvalue, and the result is joined back to the rows. How far the whitened
rows' own covariance is from the identity is measured from them.

Scale. Equal vectors are counted before they are shuffled. The driver gets the sums and the covariance, whose size
follows from the number of dimensions alone. A vector that very many rows have is many rows on one side of a join and
one on the other, which adaptive execution splits. Integers travel in as few bytes as a vector needs.

Defined results: a vector that is null or has a null or non-finite component is dropped; one of no components has no
rows. Vectors of each length are fitted among themselves. Integers are held at +-2^62. ``deviation`` beyond 64 bits is
held at their greatest value. A component whose eigenvalue is not above ``FLAT`` of the greatest (fewer distinct vectors
than dimensions, say) gives whitened 0, as the centred rows have no extent along it, and then identity_error is 1. With
no extent at all ``explained`` is 0. Rows of equal vec_id, or a null one, are rows each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.llm.common import materialize, table
from bookstrata.session import ship

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
FLAT = 1e-12
BATCH = 4096
TOP = (1 << 63) - 1
HOLD = 1 << 62


def packed(x: np.ndarray) -> list[bytes]:
    """Integers less the shift, in the fewest bytes that hold all of a row: equal rows give equal bytes."""
    x = x - SHIFT
    need = np.zeros(len(x), np.int64)
    for k, bits in enumerate((7, 15, 31)):
        need[((x < -(1 << bits)) | (x >= 1 << bits)).any(axis=1)] = k + 1
    kinds = ("<i1", "<i2", "<i4", "<i8")
    return [row.astype(kinds[k]).tobytes() for row, k in zip(x, need)]


def unpacked(rows: pa.Array, dim: int) -> np.ndarray:
    kinds = {dim: "<i1", 2 * dim: "<i2", 4 * dim: "<i4", 8 * dim: "<i8"}
    return np.stack([np.frombuffer(r, kinds[len(r)]).astype(np.int64) for r in rows.to_pylist()]) + SHIFT


def integers(rows: DataFrame) -> DataFrame:
    """vec_id, dim, x of the rows whose vector is whole."""
    spoilt = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & ~spoilt & (F.size("embedding") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            dims = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(dims)])
            flat = np.floor(np.clip(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), -HOLD, HOLD) * SCALE)
            flat = np.clip(flat, -float(HOLD), float(HOLD)).astype(np.int64) + SHIFT
            x: list[bytes] = [b""] * len(dims)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for i, b in zip(own, packed(flat[ends[own][:, None] + np.arange(dim)])):
                    x[i] = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(x, pa.binary())], names=["vec_id", "dim", "x"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"vec_id {kind}, dim int, x binary")


class Centred:
    """Vectors of a batch as ``n * x - S``, exact."""

    def __init__(self, x: np.ndarray, n: int, sums: list[int]) -> None:
        self.n = n
        largest = max(int(np.abs(x).max()) * n, *map(abs, sums)) * 2
        self.wide = largest >= 1 << 62
        if self.wide:
            self.times_n = x.astype(object) * n - np.array(sums, dtype=object)
        else:
            self.times_n = x * n - np.array(sums, np.int64)

    def rows(self) -> np.ndarray:
        """x - S / n."""
        return (self.times_n / self.n).astype(np.float64)

    def deviation(self) -> np.ndarray:
        """Sum of squares of ``n * x - S`` by row."""
        wide = self.wide or float(np.abs(self.times_n).max()) ** 2 * self.times_n.shape[1] >= 2.0**62
        if not wide:
            return (self.times_n**2).sum(axis=1)
        return np.array([min(TOP, sum(int(v) ** 2 for v in row)) for row in self.times_n], np.int64)


def totals(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Sum of weights, and exact weighted sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, dtype=object)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                w, x = part.column(1).to_numpy(), unpacked(part.column(0), dim)
                fits = float(np.abs(x).max()) * float(w.sum()) < 2.0**62
                sums += (w @ x if fits else w.astype(object) @ x.astype(object)).astype(object)
                n += int(w.sum())
        values = [Decimal(int(v)) for v in (n, *sums)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["at", "v"])

    found = vectors.select("x", "w").mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v"))
    by_place = {at: int(v) for at, v in found.collect()}
    return by_place[-1], [by_place[i] for i in range(dim)]


def products(rows: DataFrame, schema_of, dim: int) -> np.ndarray:
    """Sum over rows of weight times the outer product of the row with itself; ``schema_of(batch)`` gives weights and rows."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                w, y = schema_of(batch.slice(start, BATCH))
                total += (y * w[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int64)), pa.array(total[upper])], names=["at", "v"])

    # Partial matrices in order of size, so that the sum does not depend on the order of tasks.
    found = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sort_array(F.collect_list("v")).alias("v"))
    found = found.select("at", F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("v")).toArrow()
    out = np.zeros((dim, dim))
    at = found.column(0).to_numpy()
    out[upper[0][at], upper[1][at]] = found.column(1).to_numpy()
    return np.triu(out) + np.triu(out, 1).T


def fit(vectors: DataFrame, dim: int, weights: str = "count", components: int = COMPONENTS) -> dict:
    """n, sums, directions (a column each), eigenvalues of the first components, and the trace."""
    weighted = vectors.select("x", (F.col("n") if weights == "count" else F.lit(1).cast("long")).alias("w"))
    n, sums = totals(weighted, dim)

    def centred(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return part.column(1).to_numpy().astype(np.float64), Centred(unpacked(part.column(0), dim), n, sums).rows()

    covariance = products(weighted, centred, dim) / n
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return {"n": n, "sums": sums, "directions": directions[:, order], "values": values[order], "trace": float(np.trace(covariance))}


def whitened(vectors: DataFrame, model: dict, dim: int) -> DataFrame:
    """x, n, deviation, whitened (array) of each distinct vector."""
    n, sums = model["n"], model["sums"]
    flat = model["values"] <= FLAT * max(float(model["values"].max(initial=0)), 0.0)
    turn = np.where(flat, 0.0, model["directions"] / np.sqrt(np.where(flat, 1.0, model["values"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                own = Centred(unpacked(part.column(0), dim), n, sums)
                y = own.rows() @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * turn.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.deviation()), lists], names=["x", "n", "deviation", "whitened"])

    return vectors.select("x", "n").mapInArrow(run, "x binary, n long, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, weights: str, k: int) -> float:
    """Largest entry of the covariance of whitened (n, whitened), less the identity."""
    w = F.col("n") if weights == "count" else F.lit(1).cast("long")
    rows = rows.select(w.alias("w"), "whitened")

    def plain(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = part.column(1).flatten().to_numpy().reshape(-1, k)
        # A column of ones gives the sums of weights and of rows in the same product.
        return part.column(0).to_numpy().astype(np.float64), np.concatenate([y, np.ones((len(y), 1))], axis=1)

    total = products(rows, plain, k + 1)
    mean = total[:k, k] / total[k, k]

    def centred(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        w, y = plain(part)
        return w, y[:, :k] - mean

    return float(np.abs(products(rows, centred, k) / total[k, k] - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, weights: str = "count") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row a component of each whole vector.

    weights: "count" fits on all rows, "one" on each distinct vector once.
    """
    ship(rows.sparkSession)
    whole = materialize(integers(rows.select("vec_id", "embedding")), "integers")
    distinct = materialize(whole.groupBy("dim", "x").agg(F.count(F.lit(1)).alias("n")), "distinct")
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = None
    # One row for each length of vectors.
    for (dim,) in sorted(distinct.select("dim").distinct().collect()):
        own = distinct.where(F.col("dim") == dim)
        model = fit(own, dim, weights, components)
        done = materialize(whitened(own, model, dim), "whitened")
        error = identity_error(done, weights, len(model["values"]))
        trace = model["trace"]
        explained = [float(e / trace) if trace > 0 else 0.0 for e in model["values"]]
        back = whole.where(F.col("dim") == dim).select("vec_id", "x").join(done.drop("n"), "x")
        back = back.select("vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", F.array(*map(F.lit, explained)).alias("explained"))).alias("at", "y"))
        back = back.select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation",
            F.col("y.whitened").alias("whitened"), F.col("y.explained").alias("explained"), F.lit(error).alias("identity_error"),
        )
        out = back if out is None else out.union(back)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


# Eigenvectors are beyond SQL; tests compare with a plain version.
QUERIES = {"op11_whitening": op11_whitening}
ORACLE: dict[str, str] = {}
