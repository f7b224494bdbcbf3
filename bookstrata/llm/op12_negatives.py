"""Hard negatives, mined with bounds that run along spanning trees of anchors.

A row's score for an anchor is the integer inner product of their components, each ``floor(256 * x)``. An anchor's
positives are its highest-scoring rows of the same label; for each positive the highest-scoring rows of other labels
are wanted whose score lies in a window below the positive's.

Anchors of one label that lie near one another form a spanning tree of least total edge length, of at most ``BLOCK``
anchors. For a candidate x and an edge from parent p to child c, ``score(c, x)`` is within ``|c - p| * |x|`` of
``score(p, x)``. So a tree's root is scored against a whole chunk of candidates, and every other anchor starts from
its parent's intervals, widened by the edge. Only candidates whose interval meets what is looked for (a window, or the
scores from the least certain positive upwards) are scored again, exactly, and their interval shrinks to a point. Where
most of a chunk is left, all of it is scored. Bounds decide what is scored, never what is returned.

Scale. Anchors and candidates meet in cells of some thousand anchors by ``CHUNK`` candidates, dealt by hash, so no
label, vector or anchor gathers its rows in one task; a cell returns the best few rows of each anchor, and the best of
all cells are ranked by anchor. Positives are looked for among rows of the anchor's label only. Trees are built once, a
task a tree: anchors share a tree if they agree in sign bits, as many as the label's number of anchors asks for, and
large classes of signs are split by hash. No vector reaches the driver.

Defined results: rows with a null label or vector, or with a component that is null or not finite, or that times 256
leaves the doubles, take no part. A null vec_id is no anchor and comes last among equal scores; rows of equal vec_id
are rows each, so an anchor id given twice is mined twice. Vectors of different lengths never meet. An anchor without
another row of its label, or a positive without a row in its window, has no rows. Scores beyond 64 bits are held at the
ends of their range. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookstrata.llm.common import materialize, table
from bookstrata.session import ship

POSITIVES = 5
NEGATIVES = 3
BLOCK = 1024
CHUNK = 1 << 15
SIGN_BITS = 24
SEED = 12
EXACT = float(1 << 53)
TOP = (1 << 63) - 1
# Beyond this share of a chunk all of it is scored: one product with a whole matrix is cheaper than picking rows.
MOST = 0.25


def packed(x: np.ndarray) -> list[bytes]:
    """Each row of integers in 16 bits a component where they fit, else as doubles; both are exact."""
    small = (np.abs(x) < 1 << 15).all(axis=1) if x.shape[1] else np.ones(len(x), bool)
    return [row.astype("<i2").tobytes() if s else row.astype("<f8").tobytes() for row, s in zip(x, small)]


def unpacked(rows: pa.ChunkedArray, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(rows), 0))
    found = [np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<f8") for r in rows.to_pylist()]
    return np.stack(found).astype(np.float64) if found else np.zeros((0, dim))


class Scores:
    """Inner products of anchors with a chunk of candidates, exact at any size of components."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray) -> None:
        self.anchors, self.rows = anchors, rows
        tall = lambda m: np.abs(m).max(axis=1, initial=0)
        self.anchor_top, self.row_top = tall(anchors) * max(anchors.shape[1], 1), tall(rows)
        self.norms = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * (1 + 1e-12)

    def unsure(self, k: int) -> np.ndarray:
        """Candidates whose product with anchor k may leave the integers that doubles hold."""
        return self.anchor_top[k] * self.row_top >= EXACT

    def of(self, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        out = np.clip(self.rows[at] @ self.anchors[k], -EXACT, EXACT).astype(np.int64)
        for i in np.flatnonzero(self.unsure(k)[at]):
            exact = sum(int(a) * int(b) for a, b in zip(self.anchors[k], self.rows[at][i]))
            out[i] = max(-TOP - 1, min(TOP, exact))
        return out


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of visits, parent (-1 at the root) and length of the edge to it, by anchor; least total length.

    The root is the anchor nearest to the mean. Smaller branches come first, so that a walk in this order keeps the
    state of few branches at a time.
    """
    n = len(x)
    parent, edge = np.full(n, -1), np.zeros(n)
    root = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    squares = (x**2).sum(axis=1)
    near, by, open_ = np.full(n, np.inf), np.full(n, root), np.ones(n, bool)
    at, joined = root, [root]
    open_[root] = False
    while len(joined) < n:
        away = squares + squares[at] - 2 * (x @ x[at])
        closer = open_ & (away < near)
        near[closer], by[closer] = away[closer], at
        at = int(np.where(open_, near, np.inf).argmin())
        if not open_[at]:  # distances beyond the doubles
            at = int(open_.argmax())
        parent[at] = by[at]
        edge[at] = np.linalg.norm(x[at] - x[by[at]]) * (1 + 1e-12)
        open_[at] = False
        joined.append(at)
    below = np.ones(n, np.int64)
    for i in reversed(joined[1:]):
        below[parent[i]] += below[i]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in joined[1:]:
        children[parent[i]].append(i)
    order, stack = np.zeros(n, np.int64), [root]
    for place in range(n):
        i = stack.pop()
        order[i] = place
        stack.extend(sorted(children[i], key=lambda c: (-below[c], c)))
    return order, parent, edge


def walk(scores: Scores, parents: np.ndarray, edges: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor of a tree in order of visits: its place, candidates and their exact scores.

    parents: places, -1 at the root. ``wanted(k, low, high)`` tells from the ends of the intervals which candidates of
    the anchor are to be scored; all others are left out.
    """
    left = np.bincount(parents[parents >= 0], minlength=len(parents))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, p in enumerate(parents):
        if p < 0:
            exact = scores.of(k)
            low = exact.astype(np.float64)
            high = low.copy()
        else:
            reach = edges[k] * scores.norms
            reach += 1 + reach * 1e-9
            low, high = held[p][0] - reach, held[p][1] + reach
            left[p] -= 1
            if not left[p]:
                del held[p]
        unsure = scores.unsure(k)
        low[unsure], high[unsure] = -np.inf, np.inf
        pick = np.flatnonzero(wanted(k, low, high))
        if p < 0:
            found = exact[pick]
        elif len(pick) > MOST * len(low):
            exact = scores.of(k)
            low = exact.astype(np.float64)
            high = low.copy()
            low[unsure], high[unsure] = -np.inf, np.inf
            found = exact[pick]
        else:
            found = scores.of(k, pick)
            low[pick] = high[pick] = found
            low[unsure], high[unsure] = -np.inf, np.inf
        if left[k]:
            held[k] = low, high
        yield k, pick, found


def best(scores: np.ndarray, last: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores; of equal ones those with an id first, by smaller id."""
    if len(scores) > 8 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= least)
        return some[best_order(scores[some], last[some], ids[some])[:n]]
    return best_order(scores, last, ids)[:n]


def best_order(scores: np.ndarray, last: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, last, ~scores))


def prepared(rows: DataFrame, anchor: Column) -> DataFrame:
    """uid, vec_id, label, anchor, dim, signs, x (packed integers) of the rows that take part."""
    spoilt = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) > 1.7e308 / 256))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~spoilt)
    rows = rows.select("vec_id", "label", F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3)
            ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = np.floor(256 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            dims = np.diff(ends)
            x: list[bytes] = [b""] * len(dims)
            signs = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                block = flat[ends[own][:, None] + np.arange(dim)]
                turn = np.random.default_rng(SEED + int(dim)).standard_normal((int(dim), SIGN_BITS))
                scale = np.abs(block).max(axis=1, initial=1)[:, None]
                signs[own] = ((block / scale) @ turn > 0) @ (1 << np.arange(SIGN_BITS, dtype=np.int64))
                for i, b in zip(own, packed(block)):
                    x[i] = b
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(dims, pa.int32()), pa.array(signs), pa.array(x, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "anchor", "dim", "signs", "x"])

    kinds = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}"
    packed_rows = rows.mapInArrow(run, f"{kinds}, anchor boolean, dim int, signs long, x binary")
    return packed_rows.withColumn("uid", F.monotonically_increasing_id())


def trees(rows: DataFrame) -> DataFrame:
    """uid, vec_id, label, dim, x of every anchor with its tree, place, parent's place and edge."""
    anchors = rows.where("anchor").select("uid", "vec_id", "label", "dim", "signs", "x")
    of_label = anchors.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / BLOCK)), F.lit(0)), F.lit(SIGN_BITS)).cast("int")
    of_label = of_label.select("dim", "label", F.expr("1L").alias("one"), bits.alias("bits"))
    anchors = anchors.join(of_label, ["dim", "label"])
    anchors = anchors.withColumn("class", F.col("signs").bitwiseAND(F.expr("shiftleft(one, bits)") - 1)).drop("signs", "one", "bits")
    sizes = anchors.groupBy("dim", "label", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    anchors = anchors.join(sizes, ["dim", "label", "class"]).withColumn("part", F.pmod(F.xxhash64("uid"), "parts"))

    def grow(group: pa.Table) -> pa.Table:
        x = unpacked(group.column("x"), group.column("dim")[0].as_py())
        order, parent, edge = spanning_tree(x)
        places = np.where(parent >= 0, order[parent], -1)
        for name, values in (("place", order.astype(np.int32)), ("parent", places.astype(np.int32)), ("edge", edge)):
            group = group.append_column(name, pa.array(values))
        return group.drop_columns(["class", "part"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"uid long, vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, x binary, tree long, place int, parent int, edge double"
    tree = F.xxhash64("dim", "label", "class", "part").alias("tree")
    keyed = anchors.select("uid", "vec_id", "label", "dim", "x", tree, "class", "part")
    return keyed.groupBy("dim", "label", "class", "part").applyInArrow(grow, schema)


class Cell:
    """Anchors and candidates of one cell, as arrays."""

    def __init__(self, anchors: pa.Table, rows: pa.Table) -> None:
        # Trees one after the other, each in order of visits; a label has its own trees.
        order = np.lexsort((anchors.column("place").to_numpy(), anchors.column("tree").to_numpy(), _codes(anchors.column("label"))[0]))
        self.anchors = anchors.take(pa.array(order))
        self.dim = anchors.column("dim")[0].as_py()
        self.x = unpacked(self.anchors.column("x"), self.dim)
        self.uid = self.anchors.column("uid").to_numpy()
        self.parent, self.edge = self.anchors.column("parent").to_numpy(), self.anchors.column("edge").to_numpy()
        self.rows = rows
        self.row_uid = rows.column("uid").to_numpy()
        ids = rows.column("vec_id")
        self.last = ids.is_null().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        self.row_x = unpacked(rows.column("x"), self.dim)

    def runs(self) -> Iterator[tuple[int, int]]:
        begins = np.append(np.flatnonzero(self.parent < 0), len(self.parent))
        yield from zip(begins[:-1], begins[1:])


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    found = column.combine_chunks().dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def positives(rows: DataFrame, anchors: DataFrame, n: int = POSITIVES) -> DataFrame:
    """anchor, positives: each anchor's uid and its best rows of the same label, best first."""
    key = ["dim", "label"]
    chunks = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    # Labels without an anchor are left out before rows are dealt.
    of_label = anchors.groupBy(*key, "tree").agg(F.lit(1).alias("one")).drop("one").join(chunks, key)
    dealt = rows.join(chunks.join(anchors.select(*key).distinct(), key), key).withColumn("chunk", F.pmod(F.xxhash64("uid"), "chunks"))
    cells = of_label.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(*key, "tree", "chunk")
    dealt = dealt.select(*key, "chunk", "uid", "vec_id", "x").join(cells, [*key, "chunk"])
    many = anchors.join(cells, [*key, "tree"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            cell = Cell(left, right)
            for start, stop in cell.runs():
                scores = Scores(cell.x[start:stop], cell.row_x)

                def wanted(k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    # One of those before the n + 1 surest may be the anchor itself.
                    if len(low) <= n + 1:
                        return np.ones(len(low), bool)
                    return high >= np.partition(low, len(low) - n - 1)[len(low) - n - 1]

                for k, pick, found in walk(scores, cell.parent[start:stop], cell.edge[start:stop], wanted):
                    own = cell.uid[start + k]
                    other = cell.row_uid[pick] != own
                    pick, found = pick[other], found[other]
                    top = best(found, cell.last[pick], cell.ids[pick], n)
                    out.append((np.full(len(top), own), pick[top], found[top]))
        anchor, pick, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.Table.from_arrays([pa.array(anchor), right.column("vec_id").take(pa.array(pick)), pa.array(score)], names=["anchor", "id", "score"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    cell_key = [*key, "tree", "chunk"]
    found = many.groupBy(*cell_key).cogroup(dealt.groupBy(*cell_key)).applyInArrow(meet, f"anchor long, id {kind}, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))


def negatives(rows: DataFrame, anchors: DataFrame, low: tuple[int, int], high: tuple[int, int], n: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; ``anchors`` carry their positives.

    low, high: the shares of a positive's score, as (numerator, denominator), that a negative's score must reach and
    must not pass.
    """
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    bins = anchors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("bins"))
    plan = bins.join(sizes, "dim")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt = rows.join(plan, "dim").select("dim", "uid", "vec_id", "label", "x", F.pmod(F.xxhash64("uid"), "chunks").alias("chunk"), upto("bins").alias("bin"))
    many = anchors.join(plan, "dim").select(*anchors.columns, F.pmod(F.xxhash64("tree"), "bins").alias("bin"), upto("chunks").alias("chunk"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            cell = Cell(left, right)
            sorts, kinds = _codes(right.column("label"))
            code = {kind: i for i, kind in enumerate(kinds)}
            of_anchor = cell.anchors.column("label").to_pylist()
            scored = [[p["score"] for p in ps] for ps in cell.anchors.column("positives").to_pylist()]
            for start, stop in cell.runs():
                other = np.flatnonzero(sorts != code.get(of_anchor[start], -1))
                if not len(other):
                    continue
                scores = Scores(cell.x[start:stop], cell.row_x[other])
                windows = [
                    [(-(-p * low[0] // low[1]), p * high[0] // high[1]) for p in scored[k]] for k in range(start, stop)
                ]

                def wanted(k: int, least: np.ndarray, most: np.ndarray) -> np.ndarray:
                    some = [w for w in windows[k] if w[0] <= w[1]]
                    if not some:
                        return np.zeros(len(least), bool)
                    # Windows of one anchor overlap, or lie so close that one test serves them all.
                    return (most >= min(w[0] for w in some)) & (least <= max(w[1] for w in some))

                for k, pick, found in walk(scores, cell.parent[start:stop], cell.edge[start:stop], wanted):
                    for place, (bottom, top) in enumerate(windows[k], 1):
                        inside = np.flatnonzero((found >= bottom) & (found <= top))
                        at = other[pick[inside]]
                        chosen = best(found[inside], cell.last[at], cell.ids[at], n)
                        out.append((np.full(len(chosen), cell.uid[start + k]), np.full(len(chosen), place), at[chosen], found[inside][chosen]))
        anchor, place, pick, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        columns = [pa.array(anchor), pa.array(place, pa.int32()), right.column("vec_id").take(pa.array(pick)), pa.array(score)]
        return pa.Table.from_arrays(columns, names=["anchor", "place", "negative_id", "negative_score"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    key = ["dim", "bin", "chunk"]
    found = many.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(meet, f"anchor long, place int, negative_id {kind}, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    named = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p"))
    named = named.select("anchor", "anchor_id", F.col("p.place").alias("place"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return found.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(
    rows: DataFrame,
    anchor: Column | None = None,
    low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id (an integer), label, embedding. anchor: which rows are anchors; those with ids divisible by 50 if
    not given. Shares with denominators other than those named keep windows exact integers too.
    """
    ship(rows.sparkSession)
    known = materialize(prepared(rows, F.col("vec_id") % 50 == 0 if anchor is None else anchor), "vectors")  # fixes uid
    anchors = materialize(trees(known), "trees")
    found = positives(known, anchors, n_positives).withColumnRenamed("anchor", "uid")
    return negatives(known, materialize(anchors.join(found, "uid"), "positives"), low, high, n_negatives)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    # A planted share of labels is moved on by one, as the contract asks.
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(rows.withColumn("label", moved))
    return found.select(*[F.col(c).cast("int" if c == "rank" else "long").alias(c) for c in found.columns])


# All anchors against all rows.
_SQL = f"""
WITH ok AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x : floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR isnan(x) OR isinf(256 * x::DOUBLE))) = 0),
s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM ok a JOIN ok b ON a.vec_id % 50 = 0 AND a.rid <> b.rid AND len(a.v) = len(b.v)),
p AS (
  SELECT anchor, anchor_id, rid AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= {POSITIVES})
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id NULLS LAST)::INTEGER AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= {NEGATIVES}"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE = {"op12_hard_negatives": _SQL}
