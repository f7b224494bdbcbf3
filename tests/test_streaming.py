import json
import random
import tempfile

from pyspark.sql import functions as F

from bookstrata.operators.sequences import bus_continuity, sequence_verdicts
from bookstrata.streaming import jobs
from bookstrata.streaming import state as St


def as_stream(spark, df, pieces=3):
    """The rows as a stream of files cut at random arrival points."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/in"
    rows = df.orderBy("arrival").collect()
    cuts = sorted(random.Random(3).sample(range(1, len(rows)), pieces - 1))
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], df.schema).coalesce(1).write.mode("append").parquet(path)
    return jobs.stream_table(spark, path, df.schema, files_per_trigger=1)


def test_sequences_stream_equals_batch(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), 1, n, rng.choice([n // 2, n // 2 - 1, n // 2 + 3, None]), rng.random() < 0.05) for n in range(80)]
    df = spark.createDataFrame(rows, "conn_id int, sid int, arrival bigint, seq bigint, reset boolean")
    want = sequence_verdicts(df.withColumn("block", F.expr("arrival div 7")), ["conn_id", "sid"], ["block"], ["arrival"], reset="reset")
    got = jobs.run_available(spark, St.track_sequences(as_stream(spark, df)), "t")
    columns = ["conn_id", "arrival", "verdict", "expected_seq", "got_seq"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(map(tuple, want.select(columns).collect()), key=repr)


def test_bus_stream_equals_batch(spark):
    rng = random.Random(2)
    rows, seq, epoch = [], 0, 5
    for n in range(60):
        seq += rng.choice([1, 1, 1, 2, 0])
        if rng.random() < 0.05:
            epoch, seq = epoch + 1, 3
        rows.append(("p", n, epoch, seq, "x"))
    df = spark.createDataFrame(rows, "publisher string, arrival bigint, bus_epoch bigint, bus_seq bigint, body string")
    want = bus_continuity(df.withColumn("block", F.expr("arrival div 9")), ["publisher"], ["block"], ["arrival"])
    got = jobs.run_available(spark, St.follow_bus(as_stream(spark, df)), "t")
    columns = ["arrival", "reset", "missed", "generation"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_long_bus_stream_equals_batch(spark, monkeypatch):
    """Several publishers, some missing from a batch, in blocks of five arrivals; a later run goes on where one ended."""
    monkeypatch.setattr(jobs, "BUS_BLOCK", 5)
    rng = random.Random(4)
    rows, last = [], {}
    for n in range(150):
        who = rng.choice("pq") if n < 90 else rng.choice("pr")
        epoch, seq = last.get(who, (5, 0))
        seq += rng.choice([1, 1, 1, 2, 0, -3])
        if rng.random() < 0.05:
            epoch, seq = epoch + 1, rng.choice([1, 3])
        last[who] = epoch, seq
        rows.append((who, n, epoch, seq, "x"))
    df = spark.createDataFrame(rows, "publisher string, arrival bigint, bus_epoch bigint, bus_seq bigint, body string")
    columns = ["publisher", "arrival", "bus_epoch", "bus_seq", "reset", "missed", "generation", "body"]
    want = bus_continuity(df.withColumn("block", F.expr("arrival div 9")), ["publisher"], ["block"], ["arrival"]).select(columns)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    stream = as_stream(spark, df, 5)
    for _ in range(2):
        got = jobs.follow_long_bus(spark, stream, "t", f"{folder}/state", f"{folder}/out")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.columns == columns


def test_an_empty_bus(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = spark.createDataFrame([], "publisher string, arrival bigint, bus_epoch bigint, bus_seq bigint, body string").schema
    assert jobs.follow_long_bus(spark, jobs.stream_table(spark, path, schema), "t").collect() == []


SCHEMA = "ticker string, arrival bigint, generation bigint, event_type string, side int, price_e4 int, delta_e2 bigint, levels string, stale boolean"


def messages(spark, rows):
    return spark.createDataFrame([("M", n, *r) for n, r in enumerate(rows)], SCHEMA)


BOOK = json.dumps([[0, 4000, 5], [1, 6000, 5]])
FEED = [
    (1, "delta", 0, 4000, 1, None, False),
    (1, "snapshot", None, None, None, BOOK, False),
    (1, "refresh", None, None, None, BOOK, False),
    (1, "delta", 0, 4100, 3, None, False),
    (1, "delta", 0, 4000, -9, None, False),
    (1, "refresh", None, None, None, BOOK, True),
    (1, "delta", 0, 4000, 1, None, False),
    (1, "snapshot", None, None, None, BOOK, False),
    (1, "delta", 0, 6000, 1, None, False),
    (1, "refresh", None, None, None, BOOK, False),
    (2, "delta", 0, 4000, 1, None, False),
]


def run(spark, policy):
    out = jobs.run_available(spark, St.live_books(as_stream(spark, messages(spark, FEED)), policy), "t")
    return [(r.after, r.outcome, r.message) for r in out.orderBy("arrival").collect()]


def test_a_consumer_drops_broken_copies(spark):
    assert run(spark, "drop") == [
        ("unknown", "ignored", None), ("unknown", "ignored", None), ("fresh", "refreshed", "snapshot"),
        ("fresh", "applied", "delta"), ("unknown", "error", "resync"), ("stale", "refreshed", "snapshot"),
        ("stale", "ignored", None), ("fresh", "applied", "snapshot"), ("unknown", "error", "resync"),
        ("fresh", "refreshed", "snapshot"), ("unknown", "ignored", "resync"),
    ]


def test_a_recorder_stales_broken_books(spark):
    got = run(spark, "stale")
    assert [g[0] for g in got] == ["unknown", "fresh", "fresh", "fresh", "stale", "stale", "stale", "fresh", "stale", "fresh", "fresh"]


def test_a_viewer_never_tests_crossing(spark):
    got = run(spark, "discard")
    assert [g[0] for g in got] == ["unknown", "fresh", "fresh", "fresh", "unknown", "stale", "stale", "fresh", "fresh", "fresh", "unknown"]


def test_follow_ups_give_up(spark):
    rows = [("g", "E", n, u) for n, u in enumerate([1, 1, 0, 2, 2, 2, 2, 2, 2, 0])]
    df = spark.createDataFrame(rows, "group string, event_ticker string, arrival bigint, unpriced int")
    out = jobs.run_available(spark, St.follow_up_unpriced(as_stream(spark, df)), "t")
    got = [(r.arrival, r.outcome, r.attempts) for r in out.orderBy("arrival").collect()]
    assert got == [(0, "requested", 1), (1, "requested", 2), (2, "priced", 2), (3, "requested", 1), (4, "requested", 2),
                   (5, "requested", 3), (6, "requested", 4), (7, "gave_up", 4)]


def test_latest_row_per_key_over_batches(spark):
    rows = [(f"M{n % 3}", n, n * 10) for n in range(20)]
    df = spark.createDataFrame(rows, "ticker string, arrival bigint, v int")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    jobs.keep_latest(spark, as_stream(spark, df), "ticker", "arrival", f"{path}/t", f"{path}/c")
    last = spark.read.parquet(f"{path}/t/v2")
    assert sorted(map(tuple, last.select("ticker", "arrival").collect())) == [("M0", 18), ("M1", 19), ("M2", 17)]

