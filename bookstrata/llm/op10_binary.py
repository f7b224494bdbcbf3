"""Token ids in a binary file format, compressed by a Re-Pair grammar for each block.

Documents are dealt by ranges of doc_id and put in order within a range; a task encodes its range, appends an
end id to each document and cuts the ids into blocks of about ``BLOCK`` ids at document ends. In a block,
frequent pairs of neighbouring symbols are replaced by new symbols again and again. Pairs are taken in
batches, most frequent first, and never reach across the end of a document, so every document is a run of
whole symbols. With each rule the length of its expansion is stored: running sums of lengths find a document
or any position without expanding what comes before it.

File format: a Parquet table, so that blocks are committed, split and read by Spark on any store. Columns:
shard, block (order of the blocks), n_tokens, doc_id (array, in order), doc_ends (int64: ids up to the end of
each document), vocabulary (first new symbol), rules (pairs of symbols; rule i makes symbol vocabulary + i),
lengths (uint32: ids each rule expands to), symbols. Symbols are little-endian uint16 where they fit, else
uint32; ``width`` says which.

Texts are cut at places where the vocabulary's splitting pattern always cuts, whatever stands around them, and
each distinct piece is encoded once by the library for a table of at most ``TABLE_ROWS`` pieces, which a worker keeps
from task to task. Pieces are found by hashes and compared byte by byte. A text with a piece that differs
from the table's, and one that holds the text of a special token, is encoded by the library as a whole.

Defined results: a null or empty text is the end id alone; null ids come last; rows of equal id come in the
order of a hash of their text; columns other than doc_id and text are ignored. Nothing passes through the
driver or a single task but one row a shard.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookstrata.llm.common import blocks, span_hashes, table
from bookstrata.session import scratch_path, ship

END = 2
BLOCK = 1 << 20
TABLE_ROWS = 600_000
ROUNDS = 16
LEAST = 8
_SLOTS = 18


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------------------------------ encoding

# Kinds of bytes. Letters are those of ASCII and U+00C0 to U+00FF but for two signs, whose first byte is
# C3; an apostrophe may begin a contraction, and all other bytes beyond ASCII may be anything.
_OTHER, _LETTER, _DIGIT, _MARK, _WHITE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[i for i in range(0x21, 0x7F) if i != 0x27]] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x09:0x0E] = _WHITE
# First bytes of characters that no version of Unicode calls white space.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xEF), *range(0xF0, 0xF5)]] = True


def cut(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of some texts begin, and the kind of each byte.

    A piece begins with a text, at a space before a character that is no white space, and where a letter, a digit or a
    mark is followed by another of the three or by a line end, a tab or the like.
    """
    kind = _KIND[data]
    c3 = np.flatnonzero(data[:-1] == 0xC3)
    c3 = c3[(data[c3 + 1] != 0x97) & (data[c3 + 1] != 0xB7)]
    kind[c3] = kind[c3 + 1] = _LETTER
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] != _OTHER) & (kind[:-1] != _OTHER) & (kind[:-1] != _WHITE)
    begins[:-2] |= (data[:-1] == 0x20) & _SOLID[data[1:]]
    # What follows a text's last byte is another text.
    begins[ends[1:-1] - 1] &= data[ends[1:-1] - 1] != 0x20
    begins[ends] = True
    return np.flatnonzero(begins[:-1]), kind


class Encoder:
    """Encodes texts by a table of distinct pieces."""

    held: dict[str, Encoder] = {}

    def __init__(self, path: str, rows: int = TABLE_ROWS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        # A task has one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Ids whose token begins with a space (written as U+0120).
        self.spaced = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.spaced[[i for token, i in self.library.get_vocab().items() if token.startswith("\u0120")]] = True
        # The same without a splitting pattern, for a space and letters, which are one chunk: the vocabulary writes bytes as
        # characters, those that print as themselves and the others from U+0100 on.
        self.model = Tokenizer.from_file(path)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = sorted(set(range(0x100)).difference(prints))
        written = [" \u0120" if b == 0x20 else chr(b if b in prints else 0x100 + rest.index(b)) for b in range(0x100)]
        self.written = np.frombuffer("".join(written).encode(), np.uint8)
        self.written_sizes = np.array([len(c.encode()) for c in written])
        self.rows = rows
        self.bits = np.uint64(64 - max(4, (3 * rows).bit_length()))
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker, which keeps it for its later tasks."""
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def clear(self) -> None:
        self.slots = np.full(1 << (64 - int(self.bits)), -1, np.int32)
        self.index = np.zeros(0, np.uint64)
        self.raw, self.flat = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.raw_starts, self.starts = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The table's row of each hash, -1 where there is none; a hash's row is in the slot of its first bits or a later one."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.index):
            return out
        open_, step = np.arange(len(hashes)), 0
        while len(open_):
            row = self.slots[((hashes[open_] >> self.bits).astype(np.int64) + step) & (len(self.slots) - 1)]
            found = (row >= 0) & (self.index[row] == hashes[open_])
            out[open_[found]] = row[found]
            open_, step = open_[(row >= 0) & ~found], step + 1
        return out

    def _place(self, hashes: np.ndarray) -> None:
        rows, step = np.arange(len(self.index), len(self.index) + len(hashes), dtype=np.int32), 0
        self.index = np.concatenate([self.index, hashes])
        while len(rows):
            slot = ((self.index[rows] >> self.bits).astype(np.int64) + step) & (len(self.slots) - 1)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]
            rows, step = rows[self.slots[slot] != rows], step + 1

    def _ids(self, texts: list[str], chunks: bool = False) -> list[np.ndarray]:
        """chunks: texts are of written bytes, with white space between chunks."""
        library = self.model if chunks else self.library
        return [np.array(e.ids, np.uint32) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, raw: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> None:
        """Add pieces: their bytes one after the other, where each ends, and how many bytes of each are of letters."""
        begins = np.concatenate([[0], ends[:-1]])
        # A space and letters: only the first token of such a piece begins with a space, so many are encoded as one text.
        word = (raw[begins] == 0x20) & (letters == ends - begins - 1) & (letters > 0)
        text = raw.tobytes()
        others = [text[i:j].decode() for i, j in zip(begins[~word].tolist(), ends[~word].tolist())]
        letters = gather(raw, begins[word], (ends - begins)[word])
        sizes = self.written_sizes[letters]
        text = gather(self.written, (np.cumsum(self.written_sizes) - self.written_sizes)[letters], sizes).tobytes()
        at = (np.cumsum(sizes) - sizes)[letters == 0x20]
        cuts = [*at[::2_000].tolist(), len(text)]
        joined = self._ids([text[i:j].decode() for i, j in zip(cuts[:-1], cuts[1:])], chunks=True)
        flat = np.concatenate([np.zeros(0, np.uint32), *joined])
        starts = np.flatnonzero(self.spaced[flat])
        if len(starts) != len(at):
            raise ValueError("a piece's tokens begin with more than one space")
        rest = self._ids(others)
        lengths = np.concatenate([np.diff(np.append(starts, len(flat))), [len(x) for x in rest]]).astype(np.int64)
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        sizes = (ends - begins)[order]
        self._place(hashes[order])
        self.flat = np.concatenate([self.flat, flat, *rest])
        self.raw = np.concatenate([self.raw, gather(raw, begins[order], sizes)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.raw_starts = np.concatenate([self.raw_starts, self.raw_starts[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).fill_null(False).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = []
        for first, stop, data, ends in blocks(texts, 1 << 22):
            out += self._encode(data, ends, whole[first:stop])
        for i in np.flatnonzero(whole):
            out[i] = self._ids([texts[int(i)].as_py()])[0]
        return out

    def _encode(self, data: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a block; ``whole`` gets those that are to be encoded without the table."""
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(whole)
        begins, kind = cut(data, ends)
        sizes = np.diff(np.append(begins, len(data)))
        hashes = span_hashes(data, begins)
        row = self._find(hashes)
        new, at = np.unique(hashes[row < 0], return_index=True)
        if len(self.index) + len(new) > self.rows and len(self.index):
            self.clear()
            row[:] = -1
            new, at = np.unique(hashes, return_index=True)
        if len(new):
            at = np.flatnonzero(row < 0)[at]
            until = np.cumsum(sizes[at])
            letters = np.add.reduceat(gather(kind, begins[at], sizes[at]) == _LETTER, until - sizes[at], dtype=np.int64)
            self._learn(new, gather(data, begins[at], sizes[at]), until, letters)
            row = np.where(row < 0, self._find(hashes), row)
        # Pieces of one hash that are not the same are told by their bytes.
        same = np.diff(self.raw_starts)[row] == sizes
        at = np.flatnonzero(same)
        equal = gather(self.raw, self.raw_starts[row[at]], sizes[at]) == (data if same.all() else gather(data, begins[at], sizes[at]))
        if not equal.all():
            same[at] = np.logical_and.reduceat(equal, np.cumsum(sizes[at]) - sizes[at])
        pieces = np.searchsorted(begins, ends)
        if not same.all():
            whole |= np.diff(np.concatenate([[0], np.cumsum(~same)])[pieces]) > 0
        lengths = self.starts[row + 1] - self.starts[row]
        ids = gather(self.flat, self.starts[row], lengths)
        until = np.concatenate([[0], np.cumsum(lengths)])[pieces]
        return [ids[i:j] for i, j in zip(until[:-1].tolist(), until[1:].tolist())]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts``, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[np.arange(total) + shift]


# ------------------------------------------------------------------------------------------ grammar


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, rounds: int = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (pairs, one a row) for ids; ``ends`` marks the last id of each document.

    A round replaces the most frequent pairs, at most one in ``rounds`` of the symbols that are free at first, and
    then pairs are counted again, so that rules are made of rules. Ends when no pair occurs ``least`` times, or when
    symbols run out (65,536 with 16 bits, as many new ones with 32).

    Places keep their numbers; ``after`` and ``before`` lead over those that went into a rule. A pair of older symbols
    never becomes more frequent, so after a round only places of frequent pairs and those beside a new symbol are
    counted again.
    """
    narrow = vocabulary < 1 << 16
    kind, bits = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
    multiplier, down = (kind(2654435761), kind(32 - _SLOTS)) if narrow else (kind(0x9E3779B97F4A7C15), kind(64 - _SLOTS))
    top = 1 << 16 if narrow else vocabulary + (1 << 16)
    share = max(1, (top - vocabulary) // rounds)
    n = len(ids)
    symbols, last, rules, new = ids.astype(kind), ends.copy(), [], vocabulary
    last[-1:] = True
    after, before, left = np.arange(1, n + 1), np.arange(-1, n), np.ones(n, bool)
    live = np.flatnonzero(~last[:-1])
    while new < top and len(live):
        right = after[live]
        code = (symbols[live] << bits) | symbols[right]
        ordered = np.sort(code)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        maybe = np.zeros(1 << _SLOTS, bool)
        maybe[(ordered[first[often]] * multiplier) >> down] = True
        room = min(share, top - new)
        often = often[np.argsort(-count[often], kind="stable")[:room]]
        pairs = ordered[first[often]]
        # A table of slots tells chosen pairs; of pairs that share a slot the most frequent is taken this round.
        slot = (pairs * multiplier) >> down
        chosen = np.sort(np.unique(slot, return_index=True)[1])
        pairs, slot = pairs[chosen], slot[chosen]
        held, made = np.zeros(1 << _SLOTS, kind), np.zeros(1 << _SLOTS, kind)
        held[slot], made[slot] = pairs, new + np.arange(len(pairs))
        slots = (code * multiplier) >> down
        hit = np.flatnonzero(held[slots] == code)
        hit = hit[made[slots[hit]] > 0]
        # Of overlapping places every second one, from the left.
        order = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(np.concatenate([[True], right[hit[:-1]] != live[hit[1:]]]), order, 0))
        hit = hit[((order - run) & 1) == 0]
        at, gone = live[hit], right[hit]
        symbols[at] = made[slots[hit]]
        last[at] |= last[gone]
        left[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        changed = np.concatenate([at, before[at]])
        changed = changed[changed >= 0]
        live = np.concatenate([live[maybe[slots]], changed])
        if 16 * len(live) < n:
            live = np.sort(live)
            live = live[np.diff(live, prepend=-1) > 0]
        else:
            again = np.zeros(n, bool)
            again[live] = True
            live = np.flatnonzero(again)
        live = live[left[live] & ~last[live]]
        rules.append(np.stack([pairs >> bits, pairs & kind((1 << int(bits)) - 1)], axis=1))
        new += len(pairs)
    return symbols[left], np.concatenate(rules) if rules else np.zeros((0, 2), kind)


def rule_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each rule expands to. A rule names symbols of earlier rules only."""
    lengths = np.zeros(len(rules), np.int64)
    known = np.zeros(len(rules), bool)
    while not known.all():
        total, ready = np.zeros(len(rules), np.int64), np.ones(len(rules), bool)
        for side in (0, 1):
            at = rules[:, side].astype(np.int64) - vocabulary
            ready &= (at < 0) | known[np.maximum(at, 0)]
            total += np.where(at < 0, 1, lengths[np.maximum(at, 0)])
        lengths[ready], known = total[ready], ready
    return lengths


class Grammar:
    """Expands symbols. All rules are expanded once, then symbols are looked up."""

    def __init__(self, vocabulary: int, rules: np.ndarray, lengths: np.ndarray) -> None:
        self.vocabulary = vocabulary
        flat = np.arange(vocabulary, vocabulary + len(rules), dtype=np.int64)
        while (new := flat >= vocabulary).any():
            times = np.where(new, 2, 1)
            at = (np.cumsum(times) - times)[new]
            pairs = rules[flat[new] - vocabulary]
            flat = np.repeat(flat, times)
            flat[at], flat[at + 1] = pairs[:, 0], pairs[:, 1]
        self.flat = flat.astype(np.uint32)
        self.lengths = lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def length(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        new = symbols >= self.vocabulary
        out[new] = self.lengths[symbols[new].astype(np.int64) - self.vocabulary]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        new = symbols >= self.vocabulary
        lengths = self.length(symbols)
        out = np.empty(int(lengths.sum()), np.uint32)
        begin = np.cumsum(lengths) - lengths
        out[begin[~new]] = symbols[~new]
        rule = symbols[new].astype(np.int64) - self.vocabulary
        where = np.repeat(begin[new] - (np.cumsum(lengths[new]) - lengths[new]), lengths[new]) + np.arange(int(lengths[new].sum()))
        out[where] = gather(self.flat, self.starts[rule], lengths[new])
        return out


def read_document(block: dict, i: int) -> np.ndarray:
    """The ids of one document of a block, expanding no other."""
    kind = np.dtype(f"<u{block['width']}")
    rules = np.frombuffer(block["rules"], kind).reshape(-1, 2)
    grammar = Grammar(block["vocabulary"], rules, np.frombuffer(block["lengths"], "<u4"))
    symbols = np.frombuffer(block["symbols"], kind)
    ends = np.frombuffer(block["doc_ends"], "<i8")
    until = np.cumsum(grammar.length(symbols))
    first = np.searchsorted(until, ends[i - 1], "right") if i else 0
    return grammar.expand(symbols[first : np.searchsorted(until, ends[i]) + 1])


# ------------------------------------------------------------------------------------------ files

_COLUMNS = (
    "shard int, block int, n_tokens long, doc_id array<{id}>, doc_ends binary, vocabulary int, width int, "
    "rules binary, lengths binary, symbols binary"
)


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, block: int = BLOCK) -> None:
    """Write the ids of all documents, in ascending doc_id order, as files of blocks under ``folder``."""
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType
    ship(docs.sparkSession)

    def pack(keys: list, arrow: pa.DataType, parts: list[np.ndarray], number: int, size: int) -> pa.RecordBatch:
        ends = np.cumsum([len(p) for p in parts])
        ids = np.concatenate(parts)
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        symbols, rules = compress(ids, last, size)
        lengths = rule_lengths(rules, size)
        width = 2 if size < 1 << 16 else 4
        values = [
            TaskContext.get().partitionId(), number, len(ids), keys, ends.astype("<i8").tobytes(), size, width,
            rules.astype(f"<u{width}").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
        ]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(arrow), pa.binary(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        size = max(encoder.size, end + 1)
        keys, parts, held, number = [], [], 0, 0
        for batch in batches:
            arrow = batch.schema.field(0).type
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = encoder.encode(part.column(1))
                for key, ids in zip(part.column(0).to_pylist(), found):
                    keys.append(key)
                    parts.append(np.append(ids, np.uint32(end)))
                    held += len(ids) + 1
                    if held >= block:
                        yield pack(keys, arrow, parts, number, size)
                        keys, parts, held, number = [], [], 0, number + 1
        if parts:
            yield pack(keys, arrow, parts, number, size)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(run, _COLUMNS.format(id=kind.simpleString())).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files."""
    files = spark.read.parquet(folder)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row a shard.
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")
    starts = files.select("shard", "block", within.alias("within")).join(shards, "shard")
    starts = starts.select("shard", "block", (F.col("before") + F.col("within")).alias("start"))
    rows = files.join(starts, ["shard", "block"]).drop("shard", "block", "n_tokens")
    kind = files.schema["doc_id"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys = row.column("doc_id").flatten()
                value = {k: v[0] for k, v in row.select([n for n in row.schema.names if n != "doc_id"]).to_pydict().items()}
                width = np.dtype(f"<u{value['width']}")
                rules = np.frombuffer(value["rules"], width).reshape(-1, 2)
                grammar = Grammar(value["vocabulary"], rules, np.frombuffer(value["lengths"], "<u4"))
                ids = grammar.expand(np.frombuffer(value["symbols"], width)).astype("<u4")
                ends = np.frombuffer(value["doc_ends"], "<i8")
                begins = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(begins + value["start"]), pa.array(ends - begins), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)


QUERIES = {"op10_token_files": op10_token_files}
ORACLE: dict[str, str] = {}
