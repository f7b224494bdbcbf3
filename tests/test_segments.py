"""Framing of segment files beside a reader that takes one record after another."""

import json
import os
import random
import struct
import tempfile

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from bookstrata.sources import segments as G
from tests import segment_fixture as W


def plain(path):
    """Records of a file and how it ends, from the layout alone."""
    body, rows = zstandard.ZstdDecompressor().decompressobj().decompress(open(path, "rb").read()), []
    at = 10 + struct.unpack_from("<I", body, 6)[0]
    while at < len(body):
        if at + 23 > len(body):
            return rows, True, None
        kind, conn, mono, wall, length = struct.unpack_from("<BHQQI", body, at)
        if at + 23 + length > len(body):
            return rows, True, None
        if kind not in (1, 2, 3, 4, 5):
            return rows, False, f"unknown record kind {kind}"
        payload = body[at + 23 : at + 23 + length]
        rows.append((len(rows), kind, conn, mono, wall, payload, G.raw_message(payload) if kind == 1 else None))
        at += 23 + length
    return rows, False, None


def read(path):
    schema = to_arrow_schema(G._OUTPUT)
    table = pa.Table.from_batches(list(G._records(path, "s", schema)), schema).to_pylist()
    rows = [(r["ordinal"], r["kind"], r["conn_id"], r["recv_mono_ns"], r["recv_wall_ns"], r["payload"], r["msg_text"]) for r in table]
    return rows[:-1], rows[-1]


def random_records(rng, count, longest):
    names = [b"", b'{"type":"lifecycle","msg": {"a": [1, "}"]}}', b'{"type":"x","msg":1}', b'{"type":"event_fee_update","msg" : 2.50 }', b"\xff lifecycle"]
    pick = lambda: rng.choice(names) if rng.random() < 0.5 else rng.randbytes(rng.randrange(longest))
    return [(rng.randrange(1, 6), rng.randrange(2**40), 10**18 + n, pick()) for n in range(count)]


def test_framing_equals_a_plain_reader(monkeypatch):
    rng = random.Random(4)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    monkeypatch.setattr(G, "CHUNK", 512)
    for trial in range(60):
        monkeypatch.setattr(G, "BLOCK", rng.choice([1, 64, 5_000, 1 << 20]))
        records = random_records(rng, rng.randrange(0, 60), rng.choice([3, 200, 20_000]))
        if trial % 5 == 1:
            records.insert(rng.randrange(len(records) + 1), (9, 1, 2, b"strange"))
        name = f"2024-01-01/00/t{trial}.zst"
        W.write(folder, name, records, cut=rng.choice([0, 0, 1, 10, 25]) if len(records) > 2 else 0)
        path = os.path.join(folder, name)
        rows, truncated, corrupt = plain(path)
        got, facts = read(path)
        assert got == rows
        assert facts[:2] == (len(rows), G.FACTS)
        stated = json.loads(facts[5])
        assert (stated["truncated"], stated["corrupt"], stated["bytes"]) == (truncated, corrupt, os.path.getsize(path))


def test_large_files_go_to_tasks_of_their_own(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rng = random.Random(5)
    for n in range(12):
        size = 40_000 if n % 3 == 0 else 10
        W.write(folder, f"2024-01-01/00/f{n:02}.zst", [(1, n, 10**18 + n, rng.randbytes(size))])
    assert 4 * spark.sparkContext.defaultParallelism >= 12
    read_by = G.read_segments(spark, folder).select("segment", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(read_by) == 12 and len({r.task for r in read_by}) == 12
