"""Write small raw segments for tests."""

import json
import os

import zstandard

from bookstrata.sources.segments import FILE_HEADER, FORMAT_VERSION, MAGIC, RECORD_HEADER

S = 1_000_000_000


def write(root, name, records, conn=1, yes_price=True, cut=0, tail=b""):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    header = json.dumps({"conn_id": conn, "use_yes_price": yes_price, "subscriptions": []}).encode()
    body = FILE_HEADER.pack(MAGIC, FORMAT_VERSION, len(header)) + header
    for kind, mono, wall, payload in records:
        raw = payload if isinstance(payload, bytes) else json.dumps(payload).encode()
        body += RECORD_HEADER.pack(kind, conn, mono, wall, len(raw)) + raw
    packed = zstandard.ZstdCompressor(level=3).compress(body[: len(body) - cut] if cut else body)
    with open(path, "wb") as f:
        f.write(packed + tail)


def frame(kind, sid, seq, **msg):
    return {"type": kind, "sid": sid, "seq": seq, "msg": msg}


def snap(ticker, sid, seq, yes=(), no=()):
    return frame("orderbook_snapshot", sid, seq, market_ticker=ticker,
                 yes_dollars_fp=[list(p) for p in yes], no_dollars_fp=[list(p) for p in no])


def delta(ticker, sid, seq, price, change, side="yes"):
    return frame("orderbook_delta", sid, seq, market_ticker=ticker, price_dollars=price,
                 delta_fp=change, side=side, ts_ms=seq)
