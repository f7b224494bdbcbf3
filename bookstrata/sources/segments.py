"""Raw record segments: framed binary logs, one zstd stream per file.

A zstd stream cannot be split, so one task reads one file; files are dealt to a number of tasks that
follows from their bytes. The reader streams 64 KiB at a time through the file system the path names, so no file is held whole.
Records are framed a buffer at a time: only the chain of lengths is walked, then headers are one NumPy view and
payloads one Arrow array cut at the headers, so no record becomes a Python object. Only frames of a type that is stored
verbatim are looked at one by one.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bookstrata import schemas
from bookstrata.functions.clock import segment_hour

# Fixed values of the segment format: magic, version, file header and record header layouts.
MAGIC = b"TAPE"
FORMAT_VERSION = 1
FILE_HEADER = struct.Struct("<4sHI")
RECORD_HEADER = struct.Struct("<BHQQI")
# Record kinds.
KINDS = {1: "frame", 2: "command", 3: "gap", 4: "connection", 5: "audit"}
FACTS = 0

# The record header as NumPy reads it, and where its length stands.
_HEADERS = np.dtype([("kind", "u1"), ("conn", "<u2"), ("mono", "<u8"), ("wall", "<u8"), ("length", "<u4")])
_LENGTH = struct.Struct("<I")
_LENGTH_AT = RECORD_HEADER.size - _LENGTH.size

CHUNK = 1 << 16
# Decompressed bytes framed at once.
BLOCK = 1 << 20
# Compressed bytes a reading task should take.
TASK_BYTES = 64 << 20

_OUTPUT = T.StructType(
    [*schemas.RAW_RECORDS.fields, T.StructField("msg_text", T.StringType(), True)]
)
FACT_SCHEMA = (
    "bytes bigint, sha256 string, truncated boolean, corrupt string, conn_id int, "
    "use_yes_price boolean, header string"
)
# Frame types whose payload is stored exactly as received.
_VERBATIM = (b"lifecycle", b"event_fee_update")
_JSON = json.JSONDecoder()


def raw_message(payload: bytes) -> str | None:
    """The exact text of a frame's ``msg`` value, for types that store it verbatim."""
    if not any(mark in payload for mark in _VERBATIM):
        return None
    try:
        text = payload.decode("utf-8")
        at = text.index("{") + 1
        while True:
            while text[at] in " \t\r\n,":
                at += 1
            if text[at] == "}":
                return None
            key, at = _JSON.raw_decode(text, at)
            at = text.index(":", at) + 1
            while text[at] in " \t\r\n":
                at += 1
            _, end = _JSON.raw_decode(text, at)
            if key == "msg":
                return text[at:end]
            at = end
    except (ValueError, IndexError, UnicodeDecodeError):
        return None


class _Stream:
    """Bytes of one compressed file, hashed as they are read."""

    def __init__(self, path: str) -> None:
        import zstandard
        from pyarrow import fs

        system, location = fs.FileSystem.from_uri(path)
        self._file = system.open_input_stream(location, compression=None)
        self._zstd = zstandard.ZstdDecompressor().decompressobj()
        self._error = zstandard.ZstdError
        self._held = bytearray()
        self._at = 0
        self.done = False
        self.digest = hashlib.sha256()
        self.size = 0
        self.truncated = False
        self.damaged = False

    def take(self, count: int) -> bytes | None:
        """Exactly ``count`` bytes, or ``None`` when the stream ends first."""
        while len(self._held) - self._at < count and not self.done:
            self._more()
        if len(self._held) - self._at < count:
            return None
        out = bytes(self._held[self._at : self._at + count])
        self._at += count
        if self._at > CHUNK:
            del self._held[: self._at]
            self._at = 0
        return out

    def block(self, least: int) -> bytes:
        """All bytes at hand, at least ``least`` of them unless the stream ends first; :meth:`skip` takes them."""
        while len(self._held) - self._at < least and not self.done:
            self._more()
        with memoryview(self._held) as view:
            return bytes(view[self._at :])

    def skip(self, count: int) -> None:
        del self._held[: self._at + count]
        self._at = 0

    def _raw(self) -> bytes:
        chunk = self._file.read(CHUNK)
        self.digest.update(chunk)
        self.size += len(chunk)
        return chunk

    def _more(self) -> None:
        chunk = self._raw()
        if not chunk:
            self.done = True
            self.truncated = self.truncated or not self._zstd.eof
            return
        try:
            self._held += self._zstd.decompress(chunk)
        except self._error:
            self.done = self.damaged = True
            return
        if self._zstd.eof and self._zstd.unused_data:
            self.done = self.damaged = True

    def finish(self) -> None:
        """Read on to the file's end, so that size and hash cover all of it."""
        while self._raw():
            pass
        self._file.close()


def _frame(held: bytes) -> tuple[np.ndarray, int, int]:
    """Where the whole records of a buffer start, where the last one ends, and the bytes that the next one needs."""
    starts, at, size = [], 0, len(held)
    length, head = _LENGTH.unpack_from, RECORD_HEADER.size
    need = head
    while at + head <= size:
        need = head + length(held, at + _LENGTH_AT)[0]
        if at + need > size:
            break
        starts.append(at)
        at += need
        need = head
    return np.array(starts, np.int64), at, need


def _split(held: bytes, starts: np.ndarray, end: int) -> tuple[np.ndarray, pa.Array]:
    """Headers and payloads of the records of a buffer."""
    if not len(starts):
        return np.empty(0, _HEADERS), pa.array([], pa.binary())
    # Headers and payloads in turn are one binary array over the buffer.
    edges = np.empty(2 * len(starts) + 1, np.int64)
    edges[0:-1:2] = starts
    edges[1::2] = starts + RECORD_HEADER.size
    edges[-1] = end
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(held)])
    spots = starts[:, None] + np.arange(RECORD_HEADER.size)
    headers = np.frombuffer(held, np.uint8)[spots].reshape(-1).view(_HEADERS)
    return headers, both.take(pa.array(np.arange(1, len(edges) - 1, 2))).cast(pa.binary())


def _texts(headers: np.ndarray, payloads: pa.Array) -> pa.Array:
    """``msg_text`` of each record: NULL but for frames that hold the name of a verbatim type."""
    marked = headers["kind"] == 1
    named = [pc.match_substring(payloads, mark).to_numpy(zero_copy_only=False) for mark in _VERBATIM]
    texts = np.full(len(headers), None, object)
    for i in np.flatnonzero(marked & np.logical_or.reduce(named)):
        texts[i] = raw_message(payloads[int(i)].as_py())
    return pa.array(texts, pa.string())


def _batch(name: str, first: int, headers: np.ndarray, payloads: pa.Array, yes_price: bool, schema: pa.Schema) -> pa.RecordBatch:
    n = len(headers)
    columns = {
        "segment": pa.repeat(name, n), "ordinal": np.arange(first, first + n), "kind": headers["kind"], "conn_id": headers["conn"],
        "recv_mono_ns": headers["mono"].astype(np.int64), "recv_wall_ns": headers["wall"].astype(np.int64), "payload": payloads,
        "use_yes_price": pa.repeat(yes_price, n), "msg_text": _texts(headers, payloads),
    }
    made = [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in (columns[field.name] for field in schema)]
    return pa.RecordBatch.from_arrays([c.cast(field.type) for c, field in zip(made, schema, strict=True)], schema=schema)


def _records(path: str, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    stream = _Stream(path)
    corrupt, header, count = None, {}, 0
    head = stream.take(FILE_HEADER.size)
    if head is None:
        corrupt = "file shorter than the header"
    else:
        magic, version, length = FILE_HEADER.unpack(head)
        text = stream.take(length) if (magic, version) == (MAGIC, FORMAT_VERSION) else None
        if text is None:
            corrupt = "bad magic, version or header"
        else:
            try:
                header = json.loads(text)
                header["conn_id"] + 0
                header["use_yes_price"] and None
            except (ValueError, KeyError, TypeError):
                corrupt, header = "malformed header", {}
    yes_price = bool(header.get("use_yes_price", False))
    need = RECORD_HEADER.size
    while corrupt is None:
        held = stream.block(max(need, BLOCK))
        starts, end, need = _frame(held)
        if not len(starts):
            if not stream.done:
                continue
            stream.truncated = stream.truncated or len(held) > 0
            break
        headers, payloads = _split(held, starts, end)
        strange = np.flatnonzero(~np.isin(headers["kind"], list(KINDS)))
        if len(strange):
            corrupt = f"unknown record kind {headers['kind'][strange[0]]}"
            headers, payloads = headers[: strange[0]], payloads[: strange[0]]
        yield _batch(name, count, headers, payloads, yes_price, schema)
        count += len(headers)
        stream.skip(end)
    if stream.damaged and corrupt is None:
        corrupt = "decompression failed, or bytes followed the frame, before the end"
    stream.finish()
    facts = {
        "bytes": stream.size,
        "sha256": stream.digest.hexdigest(),
        "truncated": stream.truncated and corrupt is None,
        "corrupt": corrupt,
        "conn_id": header.get("conn_id"),
        "use_yes_price": yes_price,
        "header": json.dumps(header),
    }
    last = np.zeros(1, _HEADERS)
    last["kind"], last["conn"] = FACTS, int(header.get("conn_id") or 0)
    yield _batch(name, count, last, pa.array([json.dumps(facts).encode()], pa.binary()), yes_price, schema)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(_OUTPUT)
    for batch in batches:
        for path, name in zip(batch["path"].to_pylist(), batch["segment"].to_pylist(), strict=True):
            yield from _records(path, name, schema)


def read_segments(spark: SparkSession, root: str | list[str], suffix: str = ".zst") -> DataFrame:
    """Every record of the segments under ``root/YYYY-MM-DD/HH/``, and one facts row per file.

    ``root`` may also be a list of such hour folders.

    Rows of kind 0 carry a file's facts as JSON; see :func:`segment_facts`. A truncated tail ends a
    file quietly; damage, an unknown kind or a bad header ends it and is noted in the facts.
    """
    named = inventory(spark, root, suffix)
    # The listing's totals: one row.
    n, size = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # Few files: a task each, up to a few for every core; many: by bytes. Files are dealt in turn, large ones
    # first, so that tasks are loaded evenly. The window has one row for each file.
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))
    turn = F.row_number().over(Window.orderBy(F.desc("bytes"), "segment"))
    dealt = named.select("path", "segment", ((turn - 1) % tasks).alias("task")).repartitionById(tasks, "task")
    return dealt.select("path", "segment").mapInArrow(_read_files, _OUTPUT)


def inventory(spark: SparkSession, root: str | list[str], suffix: str = ".zst") -> DataFrame:
    """path, segment, hour_label and bytes of every segment file; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    tail = r"([0-9]{4}-[0-9]{2}-[0-9]{2}/[0-9]{2}/[^/]+)$"
    named = files.select("path", F.regexp_extract("path", tail, 1).alias("segment"), F.col("length").alias("bytes"))
    named = named.withColumn("hour_label", segment_hour("segment"))
    return named.where(F.col("hour_label").isNotNull())


def records(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("kind") != FACTS)


def segment_facts(raw: DataFrame) -> DataFrame:
    """One row per file: records, first and last wall time, truncation, damage, size and hash."""
    counted = raw.groupBy("segment").agg(
        F.count(F.when(F.col("kind") != FACTS, 1)).alias("records"),
        F.min_by("recv_wall_ns", F.when(F.col("kind") != FACTS, F.col("ordinal"))).alias(
            "first_recv_wall_ns"
        ),
        F.max_by("recv_wall_ns", F.when(F.col("kind") != FACTS, F.col("ordinal"))).alias(
            "last_recv_wall_ns"
        ),
        F.max(F.when(F.col("kind") == FACTS, F.col("payload").cast("string"))).alias("facts"),
    )
    parsed = counted.withColumn("facts", F.from_json("facts", FACT_SCHEMA))
    return parsed.select(
        "segment", segment_hour("segment").alias("hour_label"), "records", "first_recv_wall_ns",
        "last_recv_wall_ns", "facts.bytes", "facts.sha256", "facts.truncated", "facts.corrupt",
        "facts.conn_id",
    )


def file_digests(spark: SparkSession, root: str | list[str], pattern: str = "*") -> DataFrame:
    """SHA-256 and size of every file under a folder, read in pieces: no file is held whole."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch["path"]:
                system, location = fs.FileSystem.from_uri(path)
                seen, size = hashlib.sha256(), 0
                with system.open_input_stream(location, compression=None) as file:
                    while chunk := file.read(CHUNK):
                        seen.update(chunk)
                        size += len(chunk)
                rows.append((path, size, seen.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "bytes", "sha256"])

    tasks = max(1, min(found.count(), 4 * spark.sparkContext.defaultParallelism))
    return found.repartition(tasks).mapInPandas(digest, "path string, bytes bigint, sha256 string")


def logical_digest(df: DataFrame) -> DataFrame:
    """Order-independent digest of a table's content: row count and a sum of row hashes."""
    row = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row).alias("digest"))
