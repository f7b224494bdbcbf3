"""SentencePiece encoding and decoding with a table of distinct chunks.

If no piece of the vocabulary has a white-space marker behind another character, no merge reaches across
the place where a marker follows a non-marker. There a text may be cut without changing any id. So texts
are cut before each run of markers, every distinct chunk of a batch is segmented once by the library, and
the ids are joined back by position. The same table decodes: a chunk's ids are decoded once. (Chunks hold
whole characters, so bytes of one character are never apart.) ``cuttable`` proves the property for the
model in use; another model is refused.

The table lives as long as its task and is emptied when it holds ``TABLE_ROWS`` chunks, which bounds its
memory; chunks beyond ``LONG`` characters are never held. No row is moved: encoding needs no shuffle, and a
lost task is simply run again.

Defined results: a null text is an empty text, without ids; rows with equal ids are encoded each; columns
other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.llm.common import table
from bookstrata.session import ship

TABLE_ROWS = 200_000
LONG = 1_000
MARK = "▁"
_CHUNK = re.compile(r" *[^ ]+| +")


def model_path() -> str:
    """The vocabulary file of this installation."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cuttable(processor) -> bool:
    """Whether no piece has a marker behind another character, a marker is put before a text, and characters stay as they are."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    marked = "".join(processor.encode("a  b", out_type=str)) == f"{MARK}a{MARK}{MARK}b"
    plain = processor.decode(processor.encode("\uff21\u3000\ufb01")) == "\uff21\u3000\ufb01"
    return marked and plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


class ChunkTable:
    """Ids and text of distinct chunks."""

    def __init__(self, path: str, rows: int = TABLE_ROWS) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        if not cuttable(self.processor):
            raise ValueError(f"pieces of {path} may cross white-space markers; texts can't be cut")
        self.rows, self.known = rows, {}

    def learn(self, chunks: set[str]) -> dict[str, tuple[str, int, list[int], str]]:
        """chunk -> (ids as text, their number, ids, decoded text)."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > self.rows:
            self.known.clear()
            new = list(chunks)
        # The library puts one marker before what it is given; the chunk's own first one is left out for that.
        ids = self.processor.encode([c[1:] for c in new], num_threads=1)
        # A chunk of one marker alone encodes as nothing without it.
        for i, c in enumerate(new):
            if len(c) == 1:
                ids[i] = self.processor.piece_to_id([MARK])
        texts = self.processor.decode(ids) if new else []
        table = {c: (",".join(map(str, x)), len(x), x, t) for c, x, t in zip(new, ids, texts)}
        if len(self.known) + len(table) <= self.rows:
            self.known.update((c, v) for c, v in table.items() if len(c) <= LONG)
            if all(len(c) <= LONG for c in table):
                return self.known
        return {**self.known, **table}

    def cut(self, text: str) -> list[str]:
        """The chunks of a text; each begins with a marker, written as a space."""
        return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def encode(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and, where asked for, ids and the decoded text of every row."""
    path = path or model_path()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                cut = [table.cut(t or "") for t in part.column(1).to_pylist()]
                known = table.learn(set().union(*cut))
                counts, sums, back, flat, texts = [], [], [], [], []
                for chunks in cut:
                    rows = [known[c] for c in chunks]
                    counts.append(sum(r[1] for r in rows))
                    sums.append(hashlib.sha256(",".join([r[0] for r in rows]).encode()).hexdigest())
                    # The marker that a chunk's decoding drops is a space, but for the first one.
                    text = " ".join([r[3] for r in rows])
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                    if ids:
                        flat.extend(r[2] for r in rows)
                        texts.append(text)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(sums), pa.array(back)]
                names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    values = np.fromiter(itertools.chain.from_iterable(flat), np.int32, offsets[-1])
                    columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(texts)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("key", F.col("text").cast("string")).mapInArrow(run, schema + ", ids array<int>, decoded string" * ids)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return encode(docs).withColumnRenamed("key", "doc_id")


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLE: dict[str, str] = {}
