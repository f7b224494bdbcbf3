import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from bookstrata.operators import integrity as I
from bookstrata.operators import records as R
from bookstrata.session import materialize
from bookstrata.sources import segments as Sg
from tests.segment_fixture import S, delta, frame, snap, write

H = "2026-09-11/05"
BASE = 1_789_102_800 * S  # 2026-09-11T05:00:00Z


def at(second):
    return 10 * S + second * S, BASE + second * S


@pytest.fixture(scope="module")
def archive(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conn = lambda event, **k: (4, *at(k.pop("t")), {"event": event, **k})
    life = b'{"type":"market_lifecycle_v2","sid":3,"seq":1,"msg":{"event_type":"settled", "market_ticker":"M1","settled_ts":77,"x":1.10}}'
    first = [
        conn("open", t=1),
        (2, *at(1), {"cmd": "subscribe", "id": 1}),
        (1, *at(2), {"type": "subscribed", "id": 1, "msg": {"channel": "orderbook_delta", "sid": 7}}),
        (1, *at(3), snap("M1", 7, 1, [("0.40", "10.00"), ("0.41", "0.00")], [("0.60", "5.00")])),
        (1, *at(4), snap("M2", 7, 2)),
        (1, *at(5), delta("M1", 7, 3, "0.4100", "2.50")),
        (1, *at(6), delta("M1", 7, 4, "0.4100", "x")),
        (1, *at(6), b"not json"),
        (1, *at(6), frame("novel", 1, 1)),
        (3, *at(10), {"sid": 7, "expected_seq": 5, "got_seq": 9}),
        (1, *at(12), snap("M1", 7, 10, [("0.40", "1.00")])),
        (1, *at(15), snap("M2", 7, 11)),
        (3, *at(20), {"sid": 3, "expected_seq": 1, "got_seq": 4}),
        (3, *at(25), {"sid": 7, "expected_seq": 12, "got_seq": 14}),
        (1, *at(28), snap("M1", 7, 15)),
        (1, *at(29), life),
        (1, *at(29), frame("trade", 2, 1, trade_id="t", market_ticker="M1", yes_price_dollars="0.5",
                           no_price_dollars="0.5", count_fp="3", taker_book_side="ask", ts_ms=9)),
        (1, *at(29), frame("ticker", 4, None, market_ticker="M1", ts_ms=1, price_dollars="0.50")),
        (5, *at(30), {"ticker": "M1", "outcome": "exact", "levels_rest": 2, "send_mono_ns": 1,
                      "send_wall_ns": 1, "window_open_mono_ns": 1, "window_close_mono_ns": 2,
                      "window_events": 0, "mismatched_levels": 0}),
        conn("clock_jump", t=31, wall_ns_delta=9 * S, mono_ns_delta=2 * S),
        conn("writer_overflow", t=31, dropped=4),
        conn("close", t=40, detail="lost"),
    ]
    write(root, f"{H}/conn-01-0001.zst", first)
    second = [
        conn("open", t=50),
        (1, *at(51), snap("M1", 9, 1, [("0.30", "1.00")])),
        (2, *at(52), {"cmd": "update_subscription", "id": 2,
                      "params": {"sid": 9, "action": "get_snapshot", "market_tickers": ["M3"]}}),
        (1, *at(53), snap("M3", 9, 2)),
    ]
    write(root, f"{H}/conn-01-0002.zst", second)
    write(root, f"{H}/conn-02-0001.zst", [(1, *at(5), delta("M9", 1, 1, "0.10", "1.00", "no"))], conn=2,
          yes_price=False)
    write(root, f"{H}/conn-03-0001.zst", [(9, *at(5), b"{}")], conn=3)
    write(root, f"{H}/conn-04-0001.zst", [(1, *at(5), b"{}"), (1, *at(6), b"{}xxxx")], conn=4, cut=3)
    raw = materialize(Sg.read_segments(spark, root), "raw")
    return root, raw


def test_reader_facts(spark, archive):
    root, raw = archive
    facts = {r.segment: r for r in Sg.segment_facts(raw).collect()}
    assert facts[f"{H}/conn-01-0001.zst"].records == 22
    assert facts[f"{H}/conn-03-0001.zst"].corrupt == "unknown record kind 9"
    cut = facts[f"{H}/conn-04-0001.zst"]
    assert cut.truncated and cut.records == 1
    data = open(f"{root}/{H}/conn-01-0001.zst", "rb").read()
    assert facts[f"{H}/conn-01-0001.zst"].sha256 == hashlib.sha256(data).hexdigest()


def test_every_record_is_counted_once(spark, archive):
    _, raw = archive
    classified = R.classify(Sg.records(raw))
    account = R.accounting(classified)
    counts = {(r.outcome, r.key): r.n for r in account.groupBy("outcome", "key").agg(F.sum("records").alias("n")).collect()}
    assert counts["failure", "frame_envelope"] == 2
    assert counts["failure", "frame_unknown_type"] == 1
    assert counts["failure", "frame_payload"] == 1
    assert counts["baked", "orderbook_snapshot"] == 7
    assert counts["not_baked", "connection"] == 5
    assert R.accounting_check(account, Sg.segment_facts(raw)).count() == 0


def test_rows(spark, archive):
    _, raw = archive
    c = R.classify(Sg.records(raw))
    got = {(r.ticker, r.side, r.price_e4, r.delta_e2) for r in R.delta_rows(c).collect()}
    assert got == {("M1", 0, 4100, 250), ("M9", 1, 9000, 100)}
    snaps = R.snapshot_rows(c).orderBy("segment", "ordinal", "side", "price_e4").collect()
    rows = [(r.ticker, r.seq, r.side, r.price_e4, r.count_e2, r.reason) for r in snaps]
    assert rows == [
        ("M1", 1, 0, 4000, 1000, 0), ("M1", 1, 1, 6000, 500, 0), ("M2", 2, -1, 0, 0, 0),
        ("M1", 10, 0, 4000, 100, 1), ("M2", 11, -1, 0, 0, 1), ("M1", 15, -1, 0, 0, 1),
        ("M1", 1, 0, 3000, 100, 2), ("M3", 2, -1, 0, 0, 1),
    ]
    life = R.lifecycle_rows(c).collect()[0]
    assert life.ts_s == 77 and '"x":1.10}' in life.payload_json and '"settled", "market' in life.payload_json
    trade = R.trade_rows(c).collect()[0]
    assert (trade.price_e4, trade.count_e2, trade.taker_side, trade.is_block) == (5000, 300, 1, False)


def test_gaps_and_book_time(spark, archive):
    _, raw = archive
    c, facts = R.classify(Sg.records(raw)), Sg.segment_facts(raw)
    gaps = {r.expected_seq: r.resolved_recv_wall_ns for r in I.gap_rows(c, facts).collect()}
    assert gaps == {5: BASE + 15 * S, 1: None, 12: None}
    cost = I.gap_facts(c, facts).collect()[0]
    # M1 10-12 and 25-28, M2 10-15 and 25-40 stale; M1 3-40, M2 4-40, M1 51-53 and M3 observed.
    assert cost.gaps == 3
    assert cost.stale_market_ns == (2 + 3 + 5 + 15) * S
    assert cost.observed_market_ns == (37 + 36 + 2) * S


def test_spans_and_sleep(spark, archive):
    _, raw = archive
    c, facts = R.classify(Sg.records(raw)), Sg.segment_facts(raw)
    spans = {(r.segment[-13:-4], (r.start_wall_ns - BASE) // S, (r.end_wall_ns - BASE) // S, r.opened, r.closed)
             for r in I.connection_spans(c, facts).collect()}
    assert ("n-01-0001", 1, 40, True, True) in spans
    assert ("n-01-0002", 50, 53, True, False) in spans
    assert ("n-02-0001", 0, 5, False, False) in spans
    up = I.uptime(I.connection_spans(c, facts), I.host_sleeps(c)).collect()[0]
    # Open 0-5, 1-40 and 50-53 seconds; asleep 24-31.
    assert up.seconds_recording == 43 - 7
    assert I.overflow_dropped(c).collect()[0].dropped == 4
