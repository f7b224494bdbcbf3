import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from bookstrata.operators import books as B
from bookstrata.plans.bake import bake, incremental_bake
from bookstrata.plans.catalog import Catalog
from bookstrata.sources import manifests as M
from bookstrata.sources import segments as Sg
from bookstrata.sources import tables as T
from tests.segment_fixture import S, delta, snap, write
from tests.sequential import run

START = 1_789_102_800 * S  # 2026-09-11T05:00:00Z


def money(e4):
    return f"{e4 // 10_000}.{e4 % 10_000:04d}"


@pytest.fixture(scope="module")
def archive(spark):
    """Three hours of two connections, as raw segments, baked; and the same events for a plain book."""
    rng = random.Random(4)
    raw = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    files, feed, seq = {}, [], 0
    for step in range(360):
        second = step * 30
        wall, mono = START + second * S, 50 * S + second * S
        conn = rng.randrange(2)
        ticker = f"M{conn}{rng.randrange(3)}"
        name = f"2026-09-11/{5 + second // 3600:02d}/conn-0{conn}-0001.zst"
        seq += 1
        base = {"ticker": ticker, "conn_id": conn, "sid": 1, "seq": seq}
        roll = rng.random()
        if roll < 0.03:
            record = (3, mono, wall, {"sid": 1, "expected_seq": seq, "got_seq": seq + 2})
            feed.append((wall, mono, "G", base))
        elif roll < 0.2:
            levels = [(0, 4000 + 100 * k, 100) for k in range(3)] + [(1, 5000 + 100 * k, 100) for k in range(3)]
            sides = [[(money(p), "1.00") for s, p, c in levels if s == side] for side in (0, 1)]
            record = (1, mono, wall, snap(ticker, 1, seq, *sides))
            feed.append((wall, mono, "S", {**base, "levels": levels}))
        else:
            side = rng.randrange(2)
            price = (4000 if side == 0 else 5000) + 100 * rng.randrange(4)
            change = rng.choice([50, 100, -50])
            record = (1, mono, wall, delta(ticker, 1, seq, money(price), f"{change / 100:.2f}", "yes" if side == 0 else "no"))
            feed.append((wall, mono, "D", {**base, "side": side, "price_e4": price, "delta_e2": change, "ts_ms": seq}))
        files.setdefault((name, conn), []).append(record)
    for (name, conn), records in files.items():
        write(raw, name, records, conn=conn)
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    bake(spark, raw, root)
    return raw, root, feed


def found(books):
    levels = {}
    for r in books.levels.collect():
        levels.setdefault(r.ticker, {})[r.side, r.price_e4] = r.count_e2
    return {r.ticker: (r.stale, r.last_ts_ms, levels.get(r.ticker, {})) for r in books.status.collect()}


def wanted(feed, at):
    return {t: (b.stale, b.ts, b.levels) for t, b in run([e for e in feed if e[0] <= at]).items()}


def test_books_from_a_baked_archive(spark, archive):
    _, root, feed = archive
    catalog = Catalog(spark, root)
    # No keyframe yet: the last day is replayed.
    T.write_keyframe(B.to_keyframe(catalog_books(spark, root, START + 5000 * S), START + 5000 * S), root)
    at = START + 9_000 * S
    full, kept = wanted(feed, at), found(catalog.books_at(at))
    base = wanted(feed, START + 5000 * S)
    changed = {e[3]["ticker"] for e in feed if START + 5000 * S < e[0] <= at and e[2] != "G"}
    for ticker, book in kept.items():
        # A gap stales only books that changed since the keyframe.
        expected = full[ticker] if ticker in changed else base[ticker]
        assert book == expected
    one = catalog.book_at("M00", at)
    assert found(one)["M00"] == kept["M00"]
    assert found(catalog.book_at("NEW", at))["NEW"] == (True, None, {})
    with pytest.raises(ValueError):
        catalog.books_at(at, start_ns=at + 1)


def catalog_books(spark, root, at):
    from bookstrata.operators.replay import replay

    parts = [T.scan(T.read_table(spark, root, n), 0, at, left_open=True) for n in ("deltas", "snapshots", "gaps")]
    return replay(*parts)


def test_ranges_and_pruning(spark, archive, capsys):
    _, root, feed = archive
    catalog = Catalog(spark, root)
    t0, t1 = START + 1_000 * S, START + 4_000 * S
    rows = catalog.deltas("M01", t0, t1).collect()
    want = [e[3]["seq"] for e in feed if e[2] == "D" and t0 <= e[0] < t1 and e[3]["ticker"] == "M01"]
    assert [r.seq for r in rows] == want
    capsys.readouterr()
    catalog.deltas("M01", t0, t1).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(ticker,M01)" in plan and "PartitionFilters: [isnotnull(dt" in plan


def test_a_hot_bucket_is_spread(spark):
    rows = spark.range(400).select(
        F.lit("HOT").alias("ticker"), F.col("id").alias("ts_ms"), F.lit(0).alias("recv_mono_ns"), F.lit(0).alias("recv_wall_ns"),
        F.lit(1).alias("conn_id"), F.lit(1).alias("sid"), F.col("id").alias("seq"), F.lit(0).alias("side"), F.lit(1).alias("price_e4"),
        F.lit(1).alias("delta_e2"), F.lit(None).cast("string").alias("own_client_order_id"), F.lit("2026-01-01T00").alias("hour_label"),
    )
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    T.write_table(rows, root, "deltas", max_rows=60, task_rows=100)
    back = T.read_table(spark, root, "deltas")
    files = back.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert back.select("seq").distinct().count() == 400
    assert len(files) > 6 and max(r.n for r in files) <= 60


def test_baking_again_changes_nothing(spark, archive):
    raw, root, _ = archive
    columns = ["ticker", "ts_ms", "seq", "recv_wall_ns", "side", "price_e4", "delta_e2"]
    before = Sg.logical_digest(T.read_table(spark, root, "deltas").select(columns)).first()
    again = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    now = START + 4 * 3_600 * S
    assert incremental_bake(spark, raw, again, now) == ["2026-09-11T05", "2026-09-11T06", "2026-09-11T07"]
    assert incremental_bake(spark, raw, again, now) == []
    assert Sg.logical_digest(T.read_table(spark, again, "deltas").select(columns)).first() == before
    files = T.read_table(spark, again, "deltas").select(F.input_file_name().alias("f"), "ticker", "ts_ms").collect()
    assert len(files) == before.rows


def test_bake_leaves_manifests(spark, archive):
    _, root, feed = archive
    day = Catalog(spark, root).integrity("2026-09-11")
    assert M.violations(day).count() == 0
    hours = {r.hour: r for r in M.manifest_hours(day).collect()}
    assert set(hours) == {5, 6, 7}
    assert sum(sum(h.accounting.records.values()) for h in hours.values()) == len(feed)
    parts = {r["table"]: r.n for r in M.manifest_parts(day).groupBy("table").agg(F.sum("rows").alias("n")).collect()}
    assert parts["deltas"] == sum(e[2] == "D" for e in feed)
    assert sum(h.integrity.gaps["count"] for h in hours.values()) == sum(e[2] == "G" for e in feed)


def test_a_growing_hour_waits_and_is_baked_whole(spark):
    raw, root = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(2))
    base = 1_789_102_800 * S
    rows = [(1, 50 * S + i, base + i * S, delta("M", 1, i, "0.4000", "1.00")) for i in range(1, 4)]
    name, late = "2026-09-11/05/conn-01-0001.zst", base + 2 * 3_600 * S
    write(raw, name, rows[:1])
    # The hour has not ended, or only just.
    assert incremental_bake(spark, raw, root, base + 1_800 * S) == []
    assert incremental_bake(spark, raw, root, base + 3_600 * S + 5 * S) == []
    assert incremental_bake(spark, raw, root, late) == ["2026-09-11T05"]
    write(raw, name, rows)
    write(raw, "2026-09-11/06/conn-01-0002.zst", rows[:2])
    assert incremental_bake(spark, raw, root, late) == ["2026-09-11T05"]
    assert T.read_table(spark, root, "deltas").count() == 3
    assert incremental_bake(spark, raw, root, late + 3_600 * S) == ["2026-09-11T06"]
    assert incremental_bake(spark, raw, root, late + 3_600 * S) == []
    days = M.read_manifests(spark, f"{root}/manifests")
    assert M.violations(days).count() == 0 and M.manifest_hours(days).count() == 2


def test_files_are_read_by_many_tasks(spark):
    raw = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i in range(40):
        write(raw, f"2026-09-11/05/conn-{i:02d}-0001.zst", [(1, i, 1, delta("M", 1, i, "0.4000", "1.00"))], conn=i)
    read = Sg.read_segments(spark, raw)
    tasks = read.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("segment").alias("n")).collect()
    assert len(tasks) >= 8 and max(r.n for r in tasks) <= 5
    digests = {r.sha256 for r in Sg.file_digests(spark, raw, "*.zst").collect()}
    assert digests == {r.sha256 for r in Sg.segment_facts(read).collect()}


def test_manifests_are_strict_and_checked(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    part = {"path": "deltas/dt=2026-09-11/hour=05/part-0.parquet", "hour": 5, "rows": 3, "bytes": 9, "sha256": "a"}
    empty = {"rows": 0, "files": []}
    hour = {
        "hour": 5, "bake_version": 1, "software_version": "1",
        "accounting": {"records": {"frame": 4}, "baked": {"trade": 3}, "not_baked": {}, "decode_failures": {}, "corrupt_segments": 0},
        "integrity": {"spans": [], "sleeps": [], "gaps": {"count": 0, "stale_market_ns": 0, "observed_market_ns": 0},
                      "audits": {"exact": 0, "consistent": 0, "inconsistent": 0, "undecidable": 0, "levels_mismatched": 0},
                      "writer_overflow_dropped": 0},
    }
    doc = {
        "version": 1, "date": "2026-09-11", "software_version": "1",
        "segments": [{"path": "2026-09-11/06/c.zst", "hour": 5, "bytes": 1, "sha256": "s", "records": 4,
                      "first_recv_wall_ns": 1, "last_recv_wall_ns": 2, "truncated": False}],
        "tables": {n: empty for n in M.TABLE_NAMES} | {"deltas": {"rows": 4, "files": [part]}},
        "bake": {"hours": [hour]},
        "pruned": [{"path": "2026-09-11/05/x.zst", "bytes": 1, "sha256": "s", "pruned_wall_ns": 1}],
    }
    with open(f"{root}/2026-09-11.json", "w") as f:
        json.dump(doc, f)
    days = M.read_manifests(spark, root)
    problems = {r.problem for r in M.violations(days).collect()}
    assert problems == {
        "records not accounted for", "segment not in its hour", "table rows differ from its files", "pruned segment was never baked",
    }
    assert M.manifest_parts(days).first().rows == 3
    M.write_manifests(days, f"{root}/out")
    assert M.manifest_hours(M.read_manifests(spark, f"{root}/out")).count() == 1
    with open(f"{root}/bad.json", "w") as f:
        f.write("{")
    with pytest.raises(Exception):
        M.read_manifests(spark, f"{root}/bad.json").collect()
