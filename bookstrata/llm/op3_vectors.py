"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector x is rotated at random and replaced by the signs of its coordinates; with the code goes its
correction factor f = <x, x'>, where x' is the code turned back to a unit vector. For another unit vector y,
<x', y> / f estimates <x, y> without bias, and <x', y> lies within ``SIGMAS`` standard deviations of it but
for a chance below 1e-4 at worst. y takes part as its rotated coordinates in bytes, whose rounding is added
to the bound. Pairs whose upper bound is below the wanted cosine are dropped; all others are recomputed from
the vectors in double precision, and only those at or above it link.

Pairs to estimate come from bands of code bits. The number of bits of a band grows with the logarithm of the
number of vectors, so that a bucket holds about ``BUCKET`` unrelated vectors at any size, and the number of
bands is what it takes to find a pair at exactly the wanted cosine with probability ``RECALL``; closer pairs
are found more surely. Several rotations give the bits.

A large bucket is cut into tiles of about ``TILE`` vectors that meet pair by pair in tasks of their own; no
bucket is gathered. A pair in several buckets counts in the first of them only. Equal vectors are one, with
its number, so copies make no pairs.

Defined results: a vector that is null, empty, zero or has a null or non-finite component links with nothing
(n_links 0, itself as component, kept). Vectors of different lengths don't link. A null vec_id takes part;
component_id is the smallest id that is not null, and ``kept`` compares null as equal to null. Rows of equal
id and vector count as vectors each. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.llm.common import materialize, table
from bookstrata.llm.components import components
from bookstrata.session import ship

COSINE = 0.9
RECALL = 0.999
BUCKET = 64
TILE = 512
SIGMAS = 4.0
SEED = 3


@dataclass(frozen=True)
class Plan:
    """Bits of a band, number of bands, rotations that give as many bits."""

    bits: int
    bands: int
    rotations: int

    @classmethod
    def of(cls, n: int, dim: int, cosine: float = COSINE, recall: float = RECALL) -> Plan:
        bits = max(4, math.ceil(math.log2(max(n, 1) / BUCKET)))
        agree = (1 - math.acos(cosine) / math.pi) ** bits
        bands = math.ceil(math.log(1 - recall) / math.log(1 - agree))
        return cls(bits, bands, math.ceil(bits * bands / dim))


def rotations(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    """n random orthogonal matrices."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)])


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def encode(x: np.ndarray, turns: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For unit rows: number of each band, signs, correction factor, rotated coordinates in bytes and their step."""
    turned = np.concatenate([x @ t.T for t in turns], axis=1)
    bits = (turned > 0)[:, : plan.bits * plan.bands].reshape(len(x), plan.bands, plan.bits)
    numbers = bits @ (1 << np.arange(plan.bits, dtype=np.int64))
    own = turned[:, : x.shape[1]]
    factor = np.abs(own).sum(axis=1) / math.sqrt(x.shape[1])
    step = np.abs(own).max(axis=1) / 127
    small = np.rint(own / step[:, None]).astype(np.int8)
    return numbers, np.packbits(own > 0, axis=1), factor, small, step


def upper_bounds(signs: np.ndarray, factor: np.ndarray, small: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The highest likely cosine of each coded row (first axis) with each row in bytes (second axis)."""
    dim = signs.shape[1]
    product = (signs @ small.T.astype(np.float32)) * step[None, :].astype(np.float32) / math.sqrt(dim)
    spread = np.sqrt(np.maximum(1 - factor**2, 0) / max(dim - 1, 1)) * SIGMAS
    rounding = step[None, :] / 2 * math.sqrt(dim)
    return (product + spread[:, None] + rounding) / factor[:, None]


def coded(vectors: DataFrame, dim: int, plan: Plan) -> DataFrame:
    """uid, keys (array: one a band), and one binary payload: factor, step, signs, coordinates, keys."""
    turns = vectors.sparkSession.sparkContext.broadcast(rotations(dim, plan.rotations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                numbers, signs, factor, small, step = encode(unit(_matrix(part.column(1), dim)), turns.value, plan)
                keys = numbers + (np.arange(plan.bands, dtype=np.int64) << 40)
                payload = np.concatenate(
                    [np.stack([factor, step], axis=1).astype("<f4").view(np.uint8), signs, small.view(np.uint8), numbers.astype("<u4").view(np.uint8)],
                    axis=1,
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(keys), pa.list_(pa.int64())), pa.array([p.tobytes() for p in payload], pa.binary())],
                    names=["uid", "keys", "payload"],
                )

    return vectors.select("uid", "embedding").mapInArrow(run, "uid long, keys array<long>, payload binary")


def likely_pairs(codes: DataFrame, dim: int, plan: Plan, cosine: float = COSINE) -> DataFrame:
    """(a, b): pairs of one bucket whose upper bound reaches the cosine, each once."""
    slim = codes.select("uid", F.explode("keys").alias("key"))
    sizes = slim.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = codes.select("uid", F.explode("keys").alias("key"), "payload").join(sizes, "key")
    rows = rows.withColumn("own", F.pmod(F.hash("uid"), tiles))
    # A row meets the rows of every tile, its own among them.
    rows = rows.select("key", "uid", "payload", "own", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "uid", "payload")
    n_signs = (dim + 7) // 8

    def meet(group: pa.Table) -> pa.Table:
        uid = group.column("uid").to_numpy()
        order = np.argsort(uid)
        uid, own = uid[order], group.column("own").to_numpy()[order]
        raw = np.frombuffer(b"".join(group.column("payload").to_pylist()), np.uint8).reshape(len(uid), -1)[order]
        head = np.ascontiguousarray(raw[:, :8]).view("<f4")
        signs = np.unpackbits(raw[:, 8 : 8 + n_signs], axis=1)[:, :dim].astype(np.float32) * 2 - 1
        small = np.ascontiguousarray(raw[:, 8 + n_signs : 8 + n_signs + dim]).view(np.int8)
        bands = np.ascontiguousarray(raw[:, 8 + n_signs + dim :]).view("<u4")
        band, low, high = group.column("key")[0].as_py() >> 40, group.column("low")[0].as_py(), group.column("high")[0].as_py()
        left = np.flatnonzero(own == low)
        right = left if low == high else np.flatnonzero(own == high)
        bound = upper_bounds(signs[left], head[left, 0], small[right], head[right, 1])
        # Either of two may be the coded one; both bounds hold.
        bound = np.minimum(bound, upper_bounds(signs[right], head[right, 0], small[left], head[left, 1]).T)
        i, j = np.nonzero(bound >= cosine)
        a, b = left[i], right[j]
        if low == high:
            a, b = a[a < b], b[a < b]
        first = ~(bands[a, :band] == bands[b, :band]).any(axis=1)
        a, b = uid[a[first]], uid[b[first]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("key", "low", "high").applyInArrow(meet, "a long, b long")


def exact_links(pairs: DataFrame, vectors: DataFrame, dim: int, cosine: float = COSINE) -> DataFrame:
    """The pairs whose cosine in double precision is at least ``cosine``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x, y = _matrix(part.column(2), dim), _matrix(part.column(3), dim)
                cos = np.einsum("ij,ij->i", unit(x), unit(y))
                yield part.select([0, 1]).filter(pa.array(cos >= cosine))

    left = vectors.select(F.col("uid").alias("a"), F.col("embedding").alias("x"))
    right = vectors.select(F.col("uid").alias("b"), F.col("embedding").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(run, "a long, b long")


def near_vectors(rows: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    ship(rows.sparkSession)
    rows = rows.select("vec_id", "embedding")
    # A component that is null, not a number or infinite spoils the vector; so does a zero vector.
    spoilt = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    fit = F.coalesce(F.col("embedding").isNotNull() & ~spoilt & some, F.lit(False))
    usable = rows.where(fit)
    vectors = usable.groupBy("embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    vectors = vectors.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding"))
    vectors = materialize(vectors, "vectors")  # fixes uid
    links = None
    # One row for each length of vectors.
    for dim, n in sorted(tuple(r) for r in vectors.groupBy("dim").count().collect()):
        own, plan = vectors.where(F.col("dim") == dim), Plan.of(n, dim, cosine, recall)
        pairs = likely_pairs(materialize(coded(own, dim, plan), "codes"), dim, plan, cosine)
        found = exact_links(pairs, own, dim, cosine)
        links = found if links is None else links.union(found)
    plain = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if links is None:
        return plain
    links = materialize(links, "links")
    both = links.union(links.select("b", "a"))
    degrees = both.join(vectors.select(F.col("uid").alias("b"), "n"), "b").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("near"))
    labels = components(links).withColumnRenamed("id", "uid")
    placed = vectors.join(labels, "uid", "left").join(degrees, "uid", "left")
    placed = placed.withColumn("class", F.coalesce("label", "uid")).withColumn("n_links", F.coalesce("near", F.lit(0)) + F.col("n") - 1)
    heads = placed.groupBy("class").agg(F.min("first").alias("component_id"))
    placed = placed.join(heads, "class").select("embedding", "n_links", "component_id")
    found = usable.join(placed, "embedding").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return found.union(plain)


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


# All pairs, as SQL can afford to on small tables.
_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x : x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x : x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, c.b) AS component_id, e.vec_id = least(e.vec_id, c.b) AS kept
FROM e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a"""

QUERIES = {"op3_near_vectors": op3_near_vectors}
ORACLE = {"op3_near_vectors": _SQL}
