"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its character n-grams (1 to 3 characters, words padded with one space,
lower case, letters only), hashed to ``BUCKETS`` dimensions, with logarithmic term counts and unit length.
Each language has several centroids, found by spherical k-means among its training texts, and a text takes
the language of the centroid with the highest cosine. A text further from that centroid than the language's
reach is rejected; so is a text without a letter, whose language is ``und`` and whose score is 0.

Short texts lie far from every centroid, so a language's reach depends on the number of letters, in bands of
powers of two. A quarter of the training texts takes no part in finding centroids. Stretches of all lengths are cut
from these, and the reach of a band is the ``TAIL`` quantile of their cosines, but no more than ``MIDDLE`` times their
median (a language's few long texts may be much alike) and no less than that of a shorter band. Bands without enough stretches, and all beyond the longest, take the reach of the next shorter one; texts of
fewer letters than any stretch are not rejected.

Training takes at most ``PER_LANGUAGE`` texts of each language, those whose seeded md5 of doc_id is lowest, and of
each text all of it; this is the documented bound under which a classifier may be fitted. Every lang value is
learned. Prediction covers all rows and whole texts, in a single pass without a shuffle; the model, ``BUCKETS`` x
centroids numbers (128 KB a language), is all that is sent to the executors.

Defined results: a null or empty text, or one without a letter, gives ``und``; a null lang is never
learned; if nothing can be learned every text gives ``und``; ties between centroids fall to the language
first in code-point order; rows with equal ids are judged each; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookstrata.llm.common import blocks, materialize, mix, table
from bookstrata.session import ship

BUCKETS = 1 << 13
CENTROIDS = 4
PER_LANGUAGE = 400
TAIL = 0.004
STRETCHES = (16, 32, 64, 128, 256, 512, 1024, 2048)
MIDDLE = 0.5
CUTS = 4
ENOUGH = 8
BANDS = 13
BROADCAST_ROWS = 1 << 20
# Texts whose counts are held at a time: a row of counts is ``BUCKETS`` numbers, however short its text.
BLOCK_ROWS = 128
SEED = "lang-1"

_SPACE = np.uint32(32)
_N = (1, 2, 3)


def _letters() -> np.ndarray:
    """For each code point below 0x30000 whether it is a letter; all above are taken as letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000)


class Vectors:
    """Turns texts into rows of n-gram counts."""

    def __init__(self) -> None:
        self.letter = _letters()

    def counts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Blocks of rows: (first, after the last, counts as rows x BUCKETS, number of letters)."""
        for start in range(0, len(texts), BLOCK_ROWS):
            for first, stop, out, letters in self._counts(texts.slice(start, BLOCK_ROWS)):
                yield start + first, start + stop, out, letters

    def _counts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for first, stop, data, ends in blocks(pc.utf8_lower(texts), 1 << 18):
            codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            # The characters before each byte offset: bytes that begin a character.
            begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            at = begins[ends]
            letters = self.letter[np.minimum(codes, 0x2FFFF)]
            n_letters = np.add.reduceat(np.append(letters, False).astype(np.int64), at[:-1])
            n_letters[np.diff(at) == 0] = 0
            # One space for each run of other characters, and one at each end of a text.
            line = np.where(letters, codes, _SPACE)
            line = np.insert(line, np.sort(np.concatenate([at[:-1], at[1:]])), _SPACE)
            row = np.repeat(np.arange(stop - first), np.diff(at) + 2)
            keep = np.ones(len(line), bool)
            keep[1:] = (line[1:] != _SPACE) | (line[:-1] != _SPACE) | (row[1:] != row[:-1])
            line, row = line[keep].astype(np.uint64), row[keep]
            out = np.zeros((stop - first) * BUCKETS, np.float32)
            for n in _N:
                if len(line) < n:
                    continue
                value = np.full(len(line) - n + 1, n, np.uint64)
                for i in range(n):
                    value = value * np.uint64(0x100000001B3) + line[i : len(line) - n + 1 + i]
                own = row[: len(value)] == row[n - 1 :]
                if n == 1:
                    own &= line != 32
                where = row[: len(value)][own] * BUCKETS + (mix(value[own]) & np.uint64(BUCKETS - 1)).astype(np.int64)
                out += np.bincount(where, minlength=len(out)).astype(np.float32)
            yield first, stop, out.reshape(-1, BUCKETS), n_letters


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


class Model:
    """Centroids of all languages, in code-point order of the languages; least: cosine by language and band."""

    def __init__(self, names: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, least: np.ndarray) -> None:
        self.names, self.idf, self.centroids, self.of, self.least = names, idf, centroids, of, least

    def predict(self, counts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, and whether the text is within the language's reach."""
        cosine = _unit(np.log1p(counts) * self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)
        return self.of[best], score, score >= self.least[self.of[best], band_of(letters)]


def band_of(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), BANDS - 1)


def stretches(text: str) -> list[str]:
    """Stretches of a text, of all lengths it has room for, at even distances; the whole text last."""
    out = []
    for size in STRETCHES:
        if size >= len(text):
            break
        cuts = min(CUTS, len(text) // size)
        out += [text[at : at + size] for at in (k * (len(text) - size) // max(cuts - 1, 1) for k in range(cuts))]
    return [*out, text]


def _cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means. Begins with the rows' own mean direction and then rows far from those chosen."""
    chosen = [_unit(rows.mean(axis=0, keepdims=True))[0]]
    while len(chosen) < min(k, len(rows)):
        nearest = (rows @ np.stack(chosen).T).max(axis=1)
        # The row at the lower tenth of cosines: far, but no outlier.
        chosen.append(rows[np.argsort(nearest, kind="stable")[len(rows) // 10]])
    centroids = np.stack(chosen)
    for _ in range(rounds):
        nearest = (rows @ centroids.T).argmax(axis=1)
        centroids = _unit(np.stack([rows[nearest == c].mean(axis=0) if (nearest == c).any() else centroids[c] for c in range(len(centroids))]))
    return centroids


def chosen_texts(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, text, held of at most ``per_language`` texts of each language; held: the quarter that tells reaches."""
    order = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = counts.count()

    def small(rows: DataFrame, n: int) -> DataFrame:
        # Beyond this many rows Spark chooses, and texts may be shuffled.
        return F.broadcast(rows) if n <= BROADCAST_ROWS else rows

    # About twice as many ids as wanted are ranked, whatever the size of a language. Ids first, so that only
    # chosen texts are moved.
    place = F.conv(F.substring(order, 1, 8), 16, 10).cast("long") / float(1 << 32)
    some = known.select("lang", "doc_id", order.alias("h"), place.alias("place")).join(small(counts, languages), "lang")
    some = some.where(F.col("place") < 2.0 * (per_language + 8) / F.col("n")).select("lang", "doc_id", "h")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = some.withColumn("rank", rank).where(F.col("rank") <= per_language).groupBy("lang", "doc_id").agg(F.min("rank").alias("rank"))
    # Equal ids may bring more texts than wanted: the bound holds for texts, too.
    texts = known.select("lang", "doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.join(small(picked, per_language * languages), ["lang", "doc_id"])
    last = F.row_number().over(Window.partitionBy("lang").orderBy("rank", F.md5(F.col("text").cast("binary"))))
    texts = texts.withColumn("n", last).where(F.col("n") <= per_language)
    return materialize(texts.select("lang", "text", (F.col("n") % 4 == 0).alias("held")), "language-texts")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, tail: float = TAIL) -> Model:
    """Train on rows with a text and a lang. See the module's description for the bounds."""
    ship(docs.sparkSession)
    texts = chosen_texts(docs, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            langs = batch.column(0)
            for first, stop, counts, letters in vectors.counts(batch.column(1)):
                used = np.flatnonzero(letters)
                packed = [counts[i][counts[i] > 0].tobytes() for i in used]
                where = [np.flatnonzero(counts[i]).astype(np.int32).tobytes() for i in used]
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(used + first)), pa.array(where, pa.binary()), pa.array(packed, pa.binary())],
                    names=["lang", "at", "n"],
                )

    found = texts.where(~F.col("held")).select("lang", "text").mapInArrow(count, "lang string, at binary, n binary")
    rows = sorted(found.collect())
    names = sorted({r[0] for r in rows})
    if not names:
        empty = np.zeros((0, BUCKETS), np.float32)
        return Model([], np.ones(BUCKETS, np.float32), empty, np.zeros(0, int), np.zeros((0, BANDS)))
    seen = sum((np.bincount(np.frombuffer(at, np.int32), minlength=BUCKETS) for _, at, _ in rows), np.zeros(BUCKETS, np.int64))
    idf = (1 + np.log((1 + len(rows)) / (1 + seen))).astype(np.float32)
    parts, of = [], []
    for i, name in enumerate(names):
        own = [(at, n) for lang, at, n in rows if lang == name]
        counts = np.zeros((len(own), BUCKETS), np.float32)
        for k, (at, n) in enumerate(own):
            counts[k, np.frombuffer(at, np.int32)] = np.frombuffer(n, np.float32)
        parts.append(_cluster(_unit(np.log1p(counts) * idf), centroids))
        of += [i] * len(parts[-1])
    model = Model(names, idf, np.concatenate(parts).astype(np.float32), np.array(of), np.zeros((len(names), BANDS)))
    model.least = reaches(texts.where("held"), model, tail)
    return model


def reaches(texts: DataFrame, model: Model, tail: float) -> np.ndarray:
    """Least cosine of each language and band, from texts that had no part in the centroids."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, known = Vectors(), shared.value
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = known.centroids[[known.names[i] == lang for i in known.of]]
                for _, _, counts, letters in vectors.counts(pa.array(stretches(text)[: -1] or [text])):
                    cosine = (_unit(np.log1p(counts) * known.idf) @ own.T).max(axis=1, initial=0.0)
                    some = letters > 0
                    bands = band_of(letters[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(bands), pa.string()), pa.array(bands.astype(np.int32)), pa.array(cosine[some].astype(np.float64))],
                        names=["lang", "band", "cosine"],
                    )

    # At most CUTS stretches of each size from a quarter of PER_LANGUAGE texts of each language.
    found = texts.where(F.col("lang").isin(model.names)).select("lang", "text").mapInArrow(measure, "lang string, band int, cosine double").toArrow()
    langs, bands, cosines = (found.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    least = np.zeros((len(model.names), BANDS))
    for i, name in enumerate(model.names):
        for band in range(BANDS):
            own = cosines[(langs == name) & (bands == band)]
            before = least[i, band - 1] if band else 0.0
            if len(own) >= ENOUGH:
                before = max(before, min(float(np.quantile(own, tail)), MIDDLE * float(np.median(own))))
            least[i, band] = before
    return least


def identify(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns ``keep`` of every row, and its language, score and whether it is rejected, under ``names``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in names]
    # A text that is kept is sent once.
    sent = "text" in keep and isinstance(docs.schema["text"].dataType, T.StringType)
    at = keep.index("text") if sent else len(keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, known = Vectors(), shared.value
        languages = np.array([*known.names, "und"], dtype=object)
        for batch in batches:
            n = batch.num_rows
            lang, score, near = np.full(n, len(languages) - 1), np.zeros(n), np.zeros(n, bool)
            if known.names:
                for first, stop, counts, letters in vectors.counts(batch.column(at)):
                    found, cosine, within = known.predict(counts, letters)
                    some = letters > 0
                    lang[first:stop][some], score[first:stop][some], near[first:stop][some] = found[some], cosine[some], within[some]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(languages[lang], pa.string()), pa.array(score), pa.array(~near)], names=[*keep, *names]
            )

    result = T.StructType([docs.schema[c] for c in keep])
    for name, kind in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType())):
        result = result.add(name, kind)
    text = [] if sent else [F.col("text").cast("string").alias("_language_text")]
    return docs.select(*keep, *text).mapInArrow(predict, result)


def held_out():
    """Rows that training leaves out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op4_language": op4_language}
ORACLE: dict[str, str] = {}
