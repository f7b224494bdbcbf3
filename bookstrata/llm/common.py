"""What the operators share: input tables, words of a text, and words as 64-bit numbers in bulk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.session import materialize

__all__ = ["SPACE", "WORD", "WHITE", "materialize", "table", "text_of", "words_of", "word_count", "WordBlock", "blocks", "span_hashes"]

# A word is a run of characters other than the space and the five ASCII controls U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a text without one."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed != "", F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed != "", F.size(F.split(trimmed, SPACE))).otherwise(0).cast("long")


# ---------------------------------------------------------------------------------------------------------
# Words as numbers, for operators that run in Arrow batches. All steps are whole-array operations over the
# UTF-8 bytes of many texts at once, so no Python code runs per word.

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPAN = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_STEP = _powers(0xD1342543DE82EF95, _SPAN)
_LEAP_BASE = pow(0xD1342543DE82EF95, _SPAN, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finishing steps of a public 64-bit mixer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """One number for each stretch of bytes; stretches begin at ``starts`` (the first at 0) and bytes not ``inside`` do not count."""
    n = len(data)
    at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    values = _BYTE[data]
    if inside is not None:
        values[~inside] = 0
    values *= _STEP[at & (_SPAN - 1)]
    if n and int(at.max()) >= _SPAN:  # a stretch beyond 64 KiB
        values *= _powers(_LEAP_BASE, int(at.max()) // _SPAN + 2)[at >> 16]
    return mix(np.add.reduceat(values, starts))


class WordBlock:
    """The words of some texts: ``hashes`` of all of them and, by text, where they begin (``offsets``)."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        """data: bytes of the texts one after the other; ends: where each text begins, and the end."""
        n = len(data)
        inside = ~_IS_SPACE[data]
        first = inside.copy()
        if n > 1:
            first[1:] &= ~inside[:-1]
        # A text's first byte begins a word even where the text before ends in one.
        starts_of_texts = ends[:-1][ends[:-1] < n]
        first[starts_of_texts] = inside[starts_of_texts]
        starts = np.flatnonzero(first)
        self.offsets = np.searchsorted(starts, ends)
        if not len(starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        self.hashes = span_hashes(data[starts[0] :], starts - starts[0], inside[starts[0] :])

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n consecutive words within a text, and by text where they begin."""
        counts = np.maximum(np.diff(self.offsets) - (n - 1), 0)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        total = len(self.hashes) - (n - 1)
        if total <= 0 or not offsets[-1]:
            return np.zeros(0, np.uint64), offsets
        with np.errstate(over="ignore"):
            joined = np.zeros(total, np.uint64)
            for i in range(n):
                joined = (joined ^ self.hashes[i : i + total]) * _MULTIPLIER
                joined ^= joined >> np.uint64(29)
        pick = np.arange(offsets[-1]) + np.repeat(self.offsets[:-1] - offsets[:-1], counts)
        return mix(joined[pick]), offsets


def blocks(texts: pa.Array, size: int = 1 << 20):
    """Cut a column of texts into blocks of whole texts of about ``size`` bytes.

    Yields (first row, row after the last, bytes, ends) with ``ends`` as :class:`WordBlock` takes them. A
    null counts as an empty text. A text longer than ``size`` is a block of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
        stop = min(stop, len(texts))
        yield row, stop, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop
