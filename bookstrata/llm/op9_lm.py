"""Language-model scores by cross-entropy difference.

Two bigram models over one vocabulary, one of the target texts and one of all texts, give every token a loss;
a document's score is the mean of target loss minus background loss, so that low scores resemble the target.

The vocabulary is every lower-cased word, and both models hold every bigram, at any size of the corpus; no count
is left out. A model is P(w|v) = M * c(v,w)/c(v) for a bigram, plus the weight that bigrams leave for v, times
P(w), the add-one estimate of the word; each sums to one over the vocabulary.

Neither the driver nor a broadcast holds a model. Texts are cut into blocks of about ``BLOCK`` bytes, and a block
is stored as the numbers of its words. It sends its own counts of each distinct word and pair, as sorted hashes in one
row for each range of hashes; a range holds some ``RANGE`` tokens' keys, so there are more of them the more text there is.
A range adds up and answers each block by how much more there is elsewhere, in the order of the keys that the
block sent, so that answers need no keys. A word in every text is thus one key a block. The number of tokens
and of distinct words are all that reaches the driver.

Defined results: a null text is empty; a document without a word has no losses (null); labels without an id
or quality are ignored, of several for one id the highest counts; without any target text both models are
the background's and scores are 0; rows with equal ids are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.llm.common import WordBlock, blocks, materialize, mix as spread, table
from bookstrata.session import ship

MIX = 0.7
BLOCK = 1 << 24
RANGE = 1 << 19

_START = np.uint64(0x5851F42D4C957F2D)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of some texts: hashes of all of them and where each text's begin."""

    hashes: np.ndarray
    offsets: np.ndarray


def _word_blocks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.Table, Words]]:
    """Rows of whole texts of about ``size`` bytes, also across batches; words are found in a part of a block at a time."""
    rows: list[pa.RecordBatch] = []
    hashes: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    held = 0

    def block() -> tuple[pa.Table, Words]:
        return pa.Table.from_batches(rows), Words(np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]))

    for batch in batches:
        others = batch.drop_columns([batch.schema.names[column]])
        for start in range(0, batch.num_rows, 512):
            for first, stop, data, ends in blocks(pc.utf8_lower(batch.column(column).slice(start, 512)), min(size, 1 << 20)):
                words = WordBlock(data, ends)
                # Copies, as a slice would keep its whole batch.
                rows.append(others.take(pa.array(np.arange(start + first, start + stop))))
                hashes.append(words.hashes)
                lengths.append(np.diff(words.offsets))
                held += len(data)
                if held >= size:
                    yield block()
                    rows, hashes, lengths, held = [], [], [], 0
    if rows:
        yield block()


def squeezed(parts: list[np.ndarray]) -> bytes:
    """Arrays of numbers; of an array the first bytes of all numbers come first, then the second ones and so on."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in parts]
    data = [pa.compress(x, "zstd", asbytes=True) if x else b"" for x in planes]
    return b"".join([np.array([n for x, y in zip(parts, data) for n in (len(x), len(y))], np.int64).tobytes(), *data])


def unsqueezed(data: bytes, kinds: list[type]) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, 2 * len(kinds)).reshape(-1, 2).tolist()
    out, at = [], 16 * len(kinds)
    for kind, (n, size) in zip(kinds, sizes):
        width = np.dtype(kind).itemsize
        raw = pa.decompress(data[at : at + size], n * width, "zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n))
        at += size
    return out


_PACKED = [np.int32, np.uint8, np.uint64, np.uint32]


def packed(block: Words, target: np.ndarray) -> bytes:
    """A block as tokens of each text, whether it is a target, distinct words (the start among them, frequent ones first), and the tokens' words."""
    words, ids, counts = np.unique(np.append(block.hashes, _START), return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words))
    return squeezed([np.diff(block.offsets).astype(np.int32), target.astype(np.uint8), words[order], rank[ids[:-1]]])


@dataclass
class Counted:
    """A block's tokens as numbers of its distinct pairs, and the counts of its words and pairs.

    ``keys`` and ``counts`` have a row for each word, the start among them, and then one for each pair. Counts are n, m:
    how often it occurs in all texts and in target texts; c, d: how often a word comes first in a pair, there and there.
    """

    lengths: np.ndarray
    pair: np.ndarray
    before: np.ndarray
    word: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> Counted:
        """A block from its stored form."""
        lengths, target, words, ids = unsqueezed(data, _PACKED)
        ids = ids.astype(np.int64)
        start = int(np.flatnonzero(words == _START)[0])
        before = np.concatenate([[start], ids[:-1]]) if len(ids) else ids
        begins = np.cumsum(lengths) - lengths
        before[begins[lengths > 0]] = start
        good = np.repeat(target, lengths).astype(np.float64)
        codes, pair = np.unique(before * len(words) + ids, return_inverse=True)
        first, second = codes // len(words), codes % len(words)
        counts = np.zeros((len(words) + len(codes), 4), np.int64)
        for column, (at, weights) in enumerate(((ids, None), (ids, good), (before, None), (before, good))):
            counts[: len(words), column] = np.bincount(at, weights, len(words))
        counts[len(words) :, 0] = np.bincount(pair, minlength=len(codes))
        counts[len(words) :, 1] = np.bincount(pair, good, len(codes))
        keys = np.concatenate([words, spread(spread(words[first] + _GOLDEN) ^ words[second])])
        return cls(lengths, pair, first, second, keys, counts)

    def losses(self, words: int, tokens: int, target_tokens: int, mix: float) -> tuple[np.ndarray, np.ndarray]:
        """Sums of target and background losses of each text; ``counts`` are by now those of all texts."""
        text = np.repeat(np.arange(len(self.lengths)), self.lengths)
        own = len(self.counts) - len(self.before)
        out = []
        for i, total in ((1, target_tokens), (0, tokens)):
            seen = self.counts[self.before, i + 2]
            p = (self.counts[self.word, i] + 1) / (total + words + 1)
            p = np.where(seen > 0, (1 - mix) * p + mix * self.counts[own:, i] / np.maximum(seen, 1), p)
            out.append(np.bincount(text, -np.log(p)[self.pair], len(self.lengths)))
        return (out[0] if target_tokens else out[1]), out[1]


def mark_targets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, target of every row: whether the document is labelled good."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality > 0")
    good = good.select("doc_id", F.lit(True).alias("target"))
    return docs.select("doc_id", F.col("text").cast("string")).join(good, "doc_id", "left").withColumn("target", F.col("target").isNotNull())


def word_blocks(marked: DataFrame, size: int = BLOCK) -> DataFrame:
    """block, ids, n, m, packed: documents and tokens of each block, all and of targets."""
    kind = marked.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows, block in _word_blocks(batches, 1, size):
            rows = rows.combine_chunks()
            ids, target = rows.column(0).combine_chunks(), rows.column(1).to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            good = int(np.diff(block.offsets)[target].sum())
            columns = [pa.array([number]), lists, pa.array([len(block.hashes)]), pa.array([good]), pa.array([packed(block, target)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "n", "m", "packed"])
            number += 1

    rows = marked.select("doc_id", "text", "target")
    return materialize(rows.mapInArrow(pack, f"block long, ids array<{kind}>, n long, m long, packed binary"), "word-blocks")


def distinct_words(stored: DataFrame) -> int:
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = unsqueezed(data.as_py(), _PACKED)[2]
                yield pa.RecordBatch.from_arrays([pa.array(found[found != _START].view(np.int64))], names=["word"])

    return stored.select("packed").mapInArrow(words, "word long").distinct().count()


def counts_sent(stored: DataFrame, bits: int) -> DataFrame:
    """range, block, sent: the keys of a block in one of ``2 ** bits`` ranges, sorted, and their counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                counted = Counted.of(data.as_py())
                order = np.argsort(counted.keys)
                keys, counts = counted.keys[order], counted.counts[order].astype(np.uint32)
                ends = np.searchsorted(keys, [i << (64 - bits) for i in range(1, 1 << bits)]) if bits else np.zeros(0, np.int64)
                cuts = [0, *ends.tolist(), len(keys)]
                some = [i for i in range(1 << bits) if cuts[i] < cuts[i + 1]]
                sent = [squeezed([np.diff(keys[i:j], prepend=np.uint64(0)), *counts[i:j].T.copy()]) for i, j in ((cuts[i], cuts[i + 1]) for i in some)]
                for i in range(0, len(some), 256):
                    columns = [pa.array(some[i : i + 256], pa.int32()), pa.array([block] * len(some[i : i + 256])), pa.array(sent[i : i + 256], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["range", "block", "sent"])

    return stored.select("block", "packed").mapInArrow(send, "range int, block long, sent binary")


def _answers(rows: pa.Table) -> pa.Table:
    """What there is elsewhere of each key that a block sent, for all blocks of a range."""
    parts = [unsqueezed(x.as_py(), [np.uint64, *[np.uint32] * 4]) for x in rows.column("sent")]
    _, key = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
    more = []
    for i in range(1, 5):
        own = np.concatenate([p[i] for p in parts])
        more.append((np.bincount(key, own)[key] - own).astype(np.uint64))
    ends = np.cumsum([len(p[0]) for p in parts])
    told = [squeezed([m[i:j] for m in more]) for i, j in zip([0, *ends[:-1]], ends)]
    return pa.Table.from_arrays([rows.column("block"), rows.column("range"), pa.array(told, pa.binary())], names=["block", "range", "more"])


def score_all(marked: DataFrame, mix: float = MIX, size: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of a table of doc_id, text, target."""
    stored = word_blocks(marked, size)
    none = F.lit(0).cast("long")
    tokens, target_tokens = stored.agg(F.coalesce(F.sum("n"), none), F.coalesce(F.sum("m"), none)).first()
    words = distinct_words(stored)
    bits = (tokens // RANGE).bit_length()
    kind = marked.schema["doc_id"].dataType.simpleString()

    def finish(rows: pa.Table, own: pa.Table) -> pa.Table:
        counted = Counted.of(own.column("packed")[0].as_py())
        order = np.argsort(counted.keys)
        told = [unsqueezed(x.as_py(), [np.uint64] * 4) for x in rows.sort_by("range").column("more")]
        for i in range(4):
            counted.counts[order, i] += np.concatenate([x[i] for x in told]).astype(np.int64)
        n = counted.lengths.astype(np.int64)
        empty = n == 0
        target, background = (x / np.maximum(n, 1) for x in counted.losses(words, tokens, target_tokens, mix))
        columns = [pa.array(x, mask=empty) for x in (target, background, target - background)]
        return pa.Table.from_arrays([own.column("ids")[0].values, pa.array(n), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    answers = counts_sent(stored, bits).groupBy("range").applyInArrow(_answers, "block long, range int, more binary")
    both = answers.groupBy("block").cogroup(stored.select("block", "ids", "packed").groupBy("block"))
    return both.applyInArrow(finish, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return score_all(mark_targets(docs, labels))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The same models in SQL; sums of logarithms in another order agree to about 12 digits.
_SQL = f"""
WITH good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, doc_id IN (SELECT doc_id FROM good) AS tgt, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT rid, tgt, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
total AS (SELECT count(*) AS n, count_if(tgt) AS m FROM t),
u AS (SELECT w, count(*) AS n, count_if(tgt) AS m FROM t GROUP BY w),
size AS (SELECT count(*) + 1 AS v FROM u),
b AS (SELECT rid, tgt, w, coalesce(lag('w' || w) OVER (PARTITION BY rid ORDER BY i), 'start') AS v FROM t),
c AS (SELECT v, count(*) AS n, count_if(tgt) AS m FROM b GROUP BY v),
held AS (SELECT v, w, count(*) AS n, count_if(tgt) AS m FROM b GROUP BY v, w),
share AS (SELECT held.v, held.w, {MIX} * held.n / c.n AS pn, CASE WHEN c.m > 0 THEN {MIX} * held.m / c.m ELSE 0 END AS pm FROM held JOIN c ON held.v = c.v),
rest AS (SELECT v, 1 - sum(pn) AS rn, 1 - sum(pm) AS rm FROM share GROUP BY v),
p AS (SELECT b.rid, coalesce(s.pn, 0) + coalesce(r.rn, 1) * (u.n + 1) / (total.n + size.v) AS pn,
  coalesce(s.pm, 0) + coalesce(r.rm, 1) * (u.m + 1) / (total.m + size.v) AS pm
  FROM b JOIN u ON b.w = u.w LEFT JOIN share s ON b.v = s.v AND b.w = s.w LEFT JOIN rest r ON b.v = r.v, total, size),
x AS (SELECT rid, count(*) AS n, avg(-ln(pm)) AS tl, avg(-ln(pn)) AS bl FROM p GROUP BY rid)
SELECT doc_id, coalesce(x.n, 0) AS n_tokens, tl AS target_loss, bl AS background_loss, tl - bl AS score FROM d LEFT JOIN x ON d.rid = x.rid"""

QUERIES = {"op9_lm_scores": op9_lm_scores}
ORACLE = {"op9_lm_scores": _SQL}
