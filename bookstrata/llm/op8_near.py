"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded and verified.

A text is the weighted set of its five-word shingles (a text of one to four words is one shingle). A
shingle's weight is (1 + ln tf) * (1 + BOOST * idf), where idf falls from 1 for shingles in at most ``RARE``
of all documents to 0 for one in all of them. idf is damped by ``BOOST`` so that the rare shingles an edit
makes do not outweigh what two texts share. Document frequencies are counted over all documents in ``CELLS``
hashed cells; only cells above ``RARE`` are sent out, of which there are at most ``CELLS``.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of each text so that two texts agree in
one with the probability of their weighted Jaccard similarity; texts agreeing in all ``ROWS`` samples of some
band are candidates (0.9999 of pairs at similarity 0.8), and every candidate pair that decides anything is
verified by its exact weighted Jaccard similarity.

Scale. Equal texts are one *text*, found by digest; only texts are compared. A bucket of a band is not
expanded into its pairs: its members are compared with one centre, the member that shares most buckets with
most others; then, where the bucket still holds several components, with further centres; and of the pairs
across components that are left, only those are compared that the centre does not rule out by what each
shares with it, so no link between components is lost. Texts that are in no bucket with another are never
moved. Nothing but the cell frequencies reaches the driver.

Defined results: a null text is empty; a document without a word is alone in its class and kept; rows with a
null doc_id take part and the class id is the smallest id that is not null (null if there is none); of rows
equal in id and text one is kept; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookstrata.llm.common import WordBlock, blocks, materialize, mix, table, text_of
from bookstrata.llm.components import components
from bookstrata.session import ship

WORDS = 5
SIMILARITY = 0.8
BANDS = 13
ROWS = 3
CELLS = 1 << 20
RARE = 1e-3
BOOST = 0.1
EXTRA_ROUNDS = 2
CELL = 0.05
SLACK = 1e-3

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEPS = 1 << 16


def digest() -> Column:
    return F.md5(text_of().cast("binary"))


def shingles(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text of a block the distinct hashes of its shingles and how often each occurs."""
    words = WordBlock(data, ends)
    runs, offsets = words.runs(WORDS)
    for i in range(len(ends) - 1):
        own = runs[offsets[i] : offsets[i + 1]]
        if not len(own):
            few = words.hashes[words.offsets[i] : words.offsets[i + 1]]
            if not len(few):
                yield few, np.zeros(0, np.int64)
                continue
            own = few[:1]
            for h in few[1:]:
                own = mix(own * _GOLDEN ^ h)
            own = own ^ np.uint64(len(few))
        yield np.unique(own, return_counts=True)


def cell_frequencies(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of documents with a word; the cells in more than ``RARE`` of them and their frequencies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(CELLS, np.int64)
        texts = 0
        for batch in batches:
            for _, _, data, ends in blocks(batch.column(0)):
                cells = []
                for hashes, _ in shingles(data, ends):
                    texts += len(hashes) > 0
                    # A text counts once in a cell.
                    cells.append(np.unique((hashes & np.uint64(CELLS - 1)).astype(np.int64)))
                found += np.bincount(np.concatenate(cells), minlength=CELLS)
        for start in range(0, CELLS, 1 << 16):
            at = np.flatnonzero(found[start : start + (1 << 16)]) + start
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["cell", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([texts])], names=["cell", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "cells")
    total = counted.where("cell = -1").select("n").first()
    total = total[0] if total else 0
    often = counted.where((F.col("cell") >= 0) & (F.col("n") > RARE * total)).toArrow()
    return total, often.column(0).to_numpy(), often.column(1).to_numpy()


def cell_weights(total: int, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 + BOOST * idf of each cell."""
    out = np.full(CELLS, 1 + BOOST, np.float32)
    if len(cells):
        out[cells] = 1 + BOOST * np.log(total / counts) / np.log(1 / RARE)
    return out


def weigh(hashes: np.ndarray, counts: np.ndarray, by_cell: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)).astype(np.float32) * by_cell[(hashes & np.uint64(CELLS - 1)).astype(np.int64)]


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float, float]:
    """The weight two weighted sets (sorted distinct hashes, weights) share, and the weight of each."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    return float(common), float(a[1].sum(dtype=np.float64)), float(b[1].sum(dtype=np.float64))


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where two weighted sets differ: a number for each shingle and side that has more of it, and how much more."""
    found = np.union1d(a[0], b[0])
    more = np.zeros(len(found), np.float32)
    more[np.searchsorted(found, a[0])] = a[1]
    more[np.searchsorted(found, b[0])] -= b[1]
    at = np.flatnonzero(more)
    return np.where(more[at] > 0, found[at], mix(found[at] ^ _GOLDEN)).view(np.int64), np.abs(more[at])


class Sampler:
    """Draws the samples of a weighted set: for each one the element and level whose value is least.

    The Gamma(2, 1) and uniform variates of an element and a sample come from its hash, through quantiles
    at 65,536 steps.
    """

    def __init__(self, n: int = BANDS * ROWS) -> None:
        self.seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN)
        grid = np.linspace(0, 40, 2_000_001)
        cdf = 1 - (1 + grid) * np.exp(-grid)
        gamma = np.interp((np.arange(_STEPS) + 0.5) / _STEPS, cdf, grid)
        self.r, self.log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.inverse = (1 / gamma).astype(np.float32)

    def samples(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        best = np.full(len(self.seeds), np.inf, np.float32)
        chosen = np.zeros(len(self.seeds), np.uint64)
        step = 1 << 10
        columns = np.arange(len(self.seeds))
        for start in range(0, len(hashes), step):
            h = hashes[start : start + step]
            log_w = np.log(weights[start : start + step])[:, None]
            bits = (h[:, None] ^ self.seeds) * _GOLDEN
            bits ^= bits >> np.uint64(32)
            bits *= np.uint64(0xD6E8FEB86659FD93)
            at_r = (bits >> np.uint64(48)).astype(np.int32)
            at_c = (bits >> np.uint64(32)).astype(np.uint16)
            beta = (bits >> np.uint64(16)).astype(np.uint16).astype(np.float32) * np.float32(1 / _STEPS)
            r = self.r[at_r]
            level = np.floor(log_w * self.inverse[at_r] + beta)
            value = self.log_c[at_c] - r * (level - beta) - r
            least = value.argmin(axis=0)
            low = value[least, columns]
            found = mix(h[least] + level[least, columns].astype(np.int64).astype(np.uint64) * _GOLDEN)
            lower = low < best
            best[lower], chosen[lower] = low[lower], found[lower]
        return chosen

    def bands(self, hashes: np.ndarray, weights: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """One number a band, equal where all samples of the band are."""
        parts = self.samples(hashes, weights).reshape(-1, rows)
        out = np.arange(1, len(parts) + 1, dtype=np.uint64)
        for i in range(rows):
            out = mix(out * _GOLDEN ^ parts[:, i])
        return out.view(np.int64)


def signatures(docs: DataFrame, by_cell: np.ndarray) -> DataFrame:
    """doc_id, digest, bands of every document; bands are empty for a text without a word."""
    shared = docs.sparkSession.sparkContext.broadcast(by_cell)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            for first, stop, data, ends in blocks(batch.column(2)):
                bands = [
                    sampler.bands(h, weigh(h, n, shared.value)) if len(h) else np.zeros(0, np.int64)
                    for h, n in shingles(data, ends)
                ]
                columns = [batch.column(0).slice(first, stop - first), batch.column(1).slice(first, stop - first)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", digest().alias("digest"), text_of().alias("text"))
    return rows.mapInArrow(sign, f"doc_id {kind}, digest string, bands array<long>")


def compare(pairs: DataFrame, texts: DataFrame, by_cell: np.ndarray, similarity: float, differences: bool = False) -> DataFrame:
    """a, b of each pair with the weights of the two sets, the weight they share, whether they are similar and,
    where it is asked for, the shingles whose weights differ and by how much."""
    shared = pairs.sparkSession.sparkContext.broadcast(by_cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for _, _, data, ends in blocks(texts):
                for hashes, counts in shingles(data, ends):
                    yield hashes, weigh(hashes, counts, shared.value)

        for batch in batches:
            rows = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3))):
                common, wx, wy = overlap(x, y)
                alike = common >= similarity * (wx + wy - common)
                shingle, by = np.zeros(0, np.int64), np.zeros(0, np.float32)
                if differences:
                    shingle, by = difference(x, y)
                rows.append((common, wx, wy, alike, shingle, by))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["a", "b", "common", "weight_a", "weight_b", "alike", "shingles", "by"],
            )

    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(run, "a long, b long, common double, weight_a double, weight_b double, alike boolean, shingles array<long>, by array<float>")


def near_links(texts: DataFrame, docs: DataFrame, by_cell: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """id, label: the components of texts linked by similarity; texts without a link are absent."""
    keys = texts.select("uid", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(keys.join(sizes, "key"), "buckets")
    # The text that shares most buckets with most others, such as the one that others were made from.
    crowd = members.groupBy("uid").agg(F.sum("n").alias("crowd"))
    members = members.drop("n").join(crowd, "uid")
    # A bucket's centre: one row a bucket, by partial maxima.
    centres = members.groupBy("key").agg(F.max_by("uid", F.struct("crowd", "uid")).alias("centre"))
    members = materialize(members.join(centres, "key"), "members")
    # The texts of members, each once.
    wanted = texts.join(members.select("uid").distinct(), "uid").select("uid", "digest")
    held = docs.select(digest().alias("digest"), text_of().alias("text")).join(wanted, "digest")
    held = materialize(held.groupBy("uid").agg(F.any_value("text").alias("text")), "texts")

    def linked(compared: DataFrame) -> DataFrame:
        return compared.where("alike").select("a", "b")

    def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels with further links, of which only those between components are followed."""
        links = materialize(links, "links")
        for end in ("a", "b"):
            links = links.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
        across = links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b")
        across = materialize(across.distinct(), "across")
        if across.isEmpty():
            return labels
        merged = components(across)
        further = merged.join(labels, "id", "left_anti")
        moved = labels.join(merged.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left")
        return materialize(moved.select("id", F.coalesce("to", "label").alias("label")).unionByName(further), "labels")

    pairs = members.where("uid <> centre").select(F.col("uid").alias("a"), F.col("centre").alias("b")).distinct()
    facts = materialize(compare(pairs, held, by_cell, similarity, differences=True), "facts")
    labels = components(linked(facts))

    def unsettled() -> DataFrame:
        """Members of buckets that hold several components, with their component."""
        known = members.join(labels.withColumnRenamed("id", "uid"), "uid", "left")
        known = known.withColumn("part", F.coalesce("label", "uid")).drop("label")
        several = known.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
        return known.join(several.select("key"), "key")

    for _ in range(EXTRA_ROUNDS):
        # In buckets still open, the most crowded member outside the centre's component meets all other components.
        several = materialize(unsettled(), "open")
        home = several.where("uid = centre").select("key", F.col("part").alias("home"))
        outside = several.join(home, "key").where("part <> home").groupBy("key")
        outside = outside.agg(F.max_by(F.struct("uid", "part"), F.struct("crowd", "uid")).alias("next"))
        tried = several.join(outside, "key").where("part <> next.part").select(F.col("uid").alias("a"), F.col("next.uid").alias("b"))
        tried = _ordered(tried).join(facts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        labels = relabelled(labels, linked(compare(tried, held, by_cell, similarity)))

    # What is left: pairs of one bucket across components. Members similar to the centre take part too: a copy of one
    # of them may be too far from the centre itself.
    several = unsettled().where("uid <> centre").select("uid", "centre", "part").distinct()
    measured = facts.select(F.col("a").alias("uid"), F.col("b").alias("centre"), "common", "weight_a", "weight_b", "alike", "shingles", "by")
    beyond = _overlapping(several.join(measured, ["uid", "centre"]), similarity)
    return relabelled(labels, linked(compare(_ordered(beyond), held, by_cell, similarity)))


def _overlapping(rest: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of texts of one centre whose differences from it overlap enough for them to be similar.

    Let D be how much a text differs from the centre, over all shingles, and w its weight. Texts x and y differ by
    at least ``D + D' - 2 * overlap``, where the overlap counts differences to the same side in the same shingle, and
    similar texts differ by at most ``t * (w + w')`` with ``t = (1 - s) / (1 + s)``. So the overlap is at least
    ``(e + e') / 2`` with the excess ``e = D - t * w``. As one of the two is not similar to the centre (else both were
    one component), that is always above 0.

    Excesses come in cells of ``CELL`` of the centre's weight; for each cell of a partner a text has a least overlap,
    and its most common differences that together amount to less are left out. Two texts that overlap enough
    still have their rarest common difference among those left (prefix filtering), and both at least as much of an
    overlap from there on.
    """
    t = (1 - similarity) / (1 + similarity)
    away = F.col("weight_a") + F.col("weight_b") - 2 * F.col("common")
    facts = ("uid", "part", "alike", "excess")
    texts = rest.withColumn("excess", away - t * F.col("weight_a")).withColumn("most", away + t * F.col("weight_a"))
    texts = texts.select("centre", *facts, "most", F.col("weight_b").alias("unit"), "shingles", "by")
    cell = lambda e: F.floor(e / (CELL * F.col("unit"))).cast("int")
    texts = materialize(texts.withColumn("own", cell(F.col("excess"))), "differences")
    # The cells in which a centre's texts lie; of two texts one is not similar to the centre.
    cells = texts.groupBy("centre").agg(F.collect_set("own").alias("cells"), F.collect_set(F.when(~F.col("alike"), F.col("own"))).alias("unlike"))
    placed = texts.drop("shingles", "by").join(cells, "centre")
    placed = placed.withColumn("cells", F.when(F.col("alike"), F.col("unlike")).otherwise(F.col("cells"))).drop("unlike")
    # Most differences are of one component only; they are moved as narrow rows, and a text's facts join the others.
    rows = texts.select("centre", "uid", "part", F.explode(F.arrays_zip("shingles", "by")).alias("z"))
    rows = rows.select("centre", "uid", "part", F.col("z.shingles").alias("shingle"), F.col("z.by").alias("by"))
    held = rows.groupBy("centre", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
    rows = rows.drop("part").join(held.where("low <> high").select("centre", "shingle", "n"), ["centre", "shingle"])
    # One text's differences, the most common first: what is lost if this one and all before it are left out.
    common_first = Window.partitionBy("centre", "uid").orderBy(F.desc("n"), "shingle")
    rows = rows.withColumn("lost", F.sum(F.col("by").cast("double")).over(common_first)).drop("by", "n")
    rows = rows.join(placed, ["centre", "uid"])
    # A partner's excess: above t * unit where this text is similar to the centre, at least -t * unit in any case, and
    # so small that the overlap it asks for does not pass what the text differs by.
    least = F.when(F.col("alike"), t).otherwise(-t) * F.col("unit")
    low, high = cell(least) - 1, F.greatest(cell(least) - 1, cell(F.col("most")) + 1)
    rows = rows.withColumn("low", low).withColumn("high", high)
    rows = rows.withColumn("other", F.explode(F.filter("cells", lambda c: (c >= F.col("low")) & (c <= F.col("high")))))
    needed = (F.col("excess") + F.greatest(F.col("other") * CELL * F.col("unit"), least)) / 2 - SLACK
    rows = materialize(rows.where(F.col("lost") >= needed).select("centre", "shingle", "own", "other", *facts, "lost"), "overlaps")
    second = rows.select("centre", "shingle", F.col("own").alias("other"), F.col("other").alias("own"), *[F.col(c).alias(f"{c}_2") for c in (*facts, "lost")])
    pairs = rows.join(second, ["centre", "shingle", "own", "other"]).where((F.col("part") < F.col("part_2")) & ~(F.col("alike") & F.col("alike_2")))
    pairs = pairs.where(F.least("lost", "lost_2") >= (F.col("excess") + F.col("excess_2")) / 2 - SLACK)
    return pairs.select(F.col("uid").alias("a"), F.col("uid_2").alias("b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest, class_id, kept of every document."""
    ship(docs.sparkSession)
    by_cell = cell_weights(*cell_frequencies(docs))
    signed = materialize(signatures(docs, by_cell), "signatures")
    texts = signed.where(F.size("bands") > 0).groupBy("digest").agg(F.min("doc_id").alias("first"), F.any_value("bands").alias("bands"))
    texts = materialize(texts.withColumn("uid", F.monotonically_increasing_id()), "uids")  # fixed once written
    labels = near_links(texts, docs, by_cell, similarity)

    placed = texts.join(labels.withColumnRenamed("id", "uid"), "uid", "left")
    placed = placed.select("digest", "first", F.coalesce("label", "uid").alias("class"))
    first = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest")).alias("head")
    heads = placed.groupBy("class").agg(first)
    classes = placed.join(heads, "class").select("digest", F.col("head.first").alias("class_id"), F.col("head.digest").alias("head"))
    rows = signed.select("doc_id", "digest").join(classes, "digest", "left")
    alone = F.col("head").isNull()
    same = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("digest"))
    kept = (F.col("head") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("class_id")) & (same == 1)
    return rows.select(
        "doc_id",
        "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, same == 1).otherwise(kept).alias("kept"),
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


QUERIES = {"op8_near_duplicates": op8_near_duplicates}
ORACLE: dict[str, str] = {}
