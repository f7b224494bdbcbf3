"""Keyed state: sequence tracking, bus continuity and live books.

Rows of a key arrive in any order within a micro-batch, so each batch is sorted by its arrival
number before it is applied. A processor holds one key's small state; books of different markets
are independent keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIRST_BUS_SEQ = 1

VERDICT_SCHEMA = (
    "conn_id int, sid int, arrival bigint, seq bigint, verdict string, expected_seq bigint, "
    "got_seq bigint, messages bigint, gaps bigint, duplicates bigint"
)
CONTINUITY_SCHEMA = (
    "publisher string, arrival bigint, bus_epoch bigint, bus_seq bigint, reset string, "
    "missed bigint, generation bigint, body string"
)
BOOK_SCHEMA = (
    "ticker string, arrival bigint, generation bigint, event_type string, before string, "
    "after string, outcome string, message string, best_bid int, best_ask int, levels int"
)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values("arrival", kind="stable")


def _number(value: Any) -> int | None:
    return None if value is None or value != value else int(value)


class SequenceTracker(StatefulProcessor):
    """Sequence verdicts per (connection, subscription)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState(
            "sequence", "last_seq bigint, messages bigint, gaps bigint, duplicates bigint"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, messages, gaps, duplicates = None, 0, 0, 0
        if self._state.exists():
            last, messages, gaps, duplicates = self._state.get()
        out = []
        for row in _in_order(rows).itertuples(index=False):
            seq = _number(row.seq)
            if row.reset:
                last = None
            messages += 1
            verdict, expected = "ok", None
            if seq is not None:
                if last is None:
                    verdict, last = "first", seq
                elif seq == last + 1:
                    last = seq
                elif seq > last:
                    verdict, expected, last, gaps = "gap", last + 1, seq, gaps + 1
                else:
                    verdict, expected, duplicates = "duplicate", last + 1, duplicates + 1
            got = seq if expected is not None else None
            out.append((key[0], key[1], row.arrival, seq, verdict, expected, got, messages, gaps, duplicates))
        self._state.update((last, messages, gaps, duplicates))
        names = [c.split()[0] for c in VERDICT_SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=names).astype(
            {"seq": "Int64", "expected_seq": "Int64", "got_seq": "Int64"}
        )

    def close(self) -> None:
        pass


def track_sequences(messages: DataFrame) -> DataFrame:
    """Streaming sequence verdicts over ``(conn_id, sid, arrival, seq, reset)``."""
    return messages.groupBy("conn_id", "sid").transformWithStateInPandas(
        SequenceTracker(), outputStructType=VERDICT_SCHEMA, outputMode="Append", timeMode="None"
    )


class BusContinuity(StatefulProcessor):
    """Generation number per publisher: it rises whenever a message may have been lost.

    One key per publisher by nature; its state is three integers, and books stay parallel after it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("bus", "epoch bigint, seq bigint, generation bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        epoch, seq, generation = self._state.get() if self._state.exists() else (None, None, 0)
        out = []
        for row in _in_order(rows).itertuples(index=False):
            reset, missed = None, 0
            if epoch is None:
                reset = "start"
            elif row.bus_epoch != epoch:
                reset, missed = "epoch", row.bus_seq - FIRST_BUS_SEQ
            elif row.bus_seq != seq + 1:
                reset, missed = "gap", max(row.bus_seq - seq - 1, 0)
            epoch, seq = int(row.bus_epoch), int(row.bus_seq)
            generation += reset is not None
            out.append((key[0], row.arrival, epoch, seq, reset, missed, generation, row.body))
        self._state.update((epoch, seq, generation))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CONTINUITY_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def follow_bus(messages: DataFrame) -> DataFrame:
    """Streaming continuity over ``(publisher, arrival, bus_epoch, bus_seq, body)``.

    A publisher's share of a micro-batch is held by one task; for large ones there is ``jobs.follow_long_bus``.
    """
    return messages.groupBy("publisher").transformWithStateInPandas(
        BusContinuity(), outputStructType=CONTINUITY_SCHEMA, outputMode="Append", timeMode="None"
    )


class LiveBook(StatefulProcessor):
    """One market's live book under one of three policies.

    ``stale``: a violation stales the book until the next image (recorder). ``drop``: a violation
    forgets the copy until the next refresh (bus consumer). ``discard``: as ``drop``, but crossing is
    not tested and any image restores the book (viewer).

    A message of a newer generation finds whatever was held unknown.
    """

    def __init__(self, policy: str) -> None:
        if policy not in ("stale", "drop", "discard"):
            raise ValueError(f"unknown policy {policy!r}")
        self._policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("book", "status string, generation bigint, levels string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._status, self._generation, self._levels = "unknown", 0, {}
        if self._state.exists():
            self._status, self._generation, text = self._state.get()
            self._levels = {(s, p): c for s, p, c in json.loads(text)}
        out = []
        for row in _in_order(rows).itertuples(index=False):
            before = self._status
            if row.generation != self._generation:
                self._generation = int(row.generation)
                if self._status != "unknown" and self._policy != "stale":
                    self._forget()
            lost = before != "unknown" and self._status == "unknown"
            outcome = self._apply(row)
            message = self._message(row.event_type, before, outcome, lost)
            bid, ask = self._best(0), self._best(1)
            out.append((
                key[0], row.arrival, self._generation, row.event_type, before, self._status,
                outcome, message, bid, ask, len(self._levels),
            ))
        text = json.dumps([[s, p, c] for (s, p), c in self._levels.items()])
        self._state.update((self._status, self._generation, text))
        names = [c.split()[0] for c in BOOK_SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"best_bid": "Int32", "best_ask": "Int32"})

    def close(self) -> None:
        pass

    def _forget(self) -> None:
        self._status, self._levels = "unknown", {}

    def _best(self, side: int) -> int | None:
        prices = [p for s, p in self._levels if s == side]
        if not prices:
            return None
        return max(prices) if side == 0 else min(prices)

    def _crossed(self) -> bool:
        bid, ask = self._best(0), self._best(1)
        return bid is not None and ask is not None and bid >= ask

    def _violated(self) -> str:
        if self._policy == "stale":
            if self._status != "unknown":
                self._status = "stale"
        else:
            self._forget()
        return "error"

    def _apply(self, row: Any) -> str:
        kind = row.event_type
        if kind in ("refresh", "snapshot"):
            if kind == "snapshot" and self._status == "unknown" and self._policy == "drop":
                return "ignored"
            outcome = self._image(row.levels, kind == "refresh" and bool(row.stale))
            return "refreshed" if outcome == "applied" and kind == "refresh" else outcome
        if kind == "delta":
            return self._delta(int(row.side), int(row.price_e4), int(row.delta_e2))
        if kind == "gap":
            if self._policy == "stale" and self._status == "fresh":
                self._status = "stale"
            elif self._policy == "discard":
                self._forget()
            return "gap"
        return "other"

    def _image(self, levels: Any, stale: bool) -> str:
        seen: dict[tuple[int, int], int] = {}
        bad = False
        for side, price, count in json.loads(levels):
            bad = bad or count <= 0 or (side, price) in seen
            seen[side, price] = count
        held, self._levels = self._levels, seen
        if bad or (self._policy != "discard" and self._crossed()):
            self._levels = held
            return self._violated()
        self._status = "stale" if stale else "fresh"
        return "applied"

    def _delta(self, side: int, price: int, change: int) -> str:
        if self._status != "fresh":
            return "ignored"
        count = self._levels.get((side, price), 0) + change
        if count < 0:
            return self._violated()
        if count:
            self._levels[side, price] = count
        else:
            self._levels.pop((side, price), None)
        if self._policy != "discard" and self._crossed():
            return self._violated()
        return "applied"

    def _message(self, kind: str, before: str, outcome: str, lost: bool) -> str | None:
        """What a follower of the market is sent for this message."""
        after = self._status
        if kind in ("trade", "ticker"):
            return kind
        if after == "unknown":
            return "resync" if before != "unknown" else None
        if before == "unknown" or lost or (before != after and after == "fresh"):
            return "snapshot"
        if before != after:
            return "book"
        if outcome in ("applied", "refreshed") and kind == "delta":
            return "delta"
        if kind == "snapshot" and outcome != "ignored":
            return "snapshot"
        return None


def live_books(messages: DataFrame, policy: str = "drop") -> DataFrame:
    """Streaming books per market over one row per message.

    Columns: ``ticker, arrival, generation, event_type, side, price_e4, delta_e2, levels`` (JSON
    text of ``[side, price, count]`` rows), ``stale``.
    """
    return messages.groupBy("ticker").transformWithStateInPandas(
        LiveBook(policy), outputStructType=BOOK_SCHEMA, outputMode="Append", timeMode="None"
    )


class RefreshingBook(LiveBook):
    """A live book that also repeats its whole state every interval of processing time."""

    def __init__(self, policy: str, every_ms: int) -> None:
        super().__init__(policy)
        self._every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not list(self._handle.listTimers()):
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._every_ms)
        yield from super().handleInputRows(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._status, self._generation, text = self._state.get()
        self._levels = {(s, p): c for s, p, c in json.loads(text)}
        self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._every_ms)
        row = (
            key[0], -1, self._generation, "image", self._status, self._status, "image", "snapshot",
            self._best(0), self._best(1), len(self._levels),
        )
        names = [c.split()[0] for c in BOOK_SCHEMA.split(", ")]
        yield pd.DataFrame([row], columns=names).astype({"best_bid": "Int32", "best_ask": "Int32"})


def refreshing_books(messages: DataFrame, policy: str = "stale", every_ms: int = 10_000) -> DataFrame:
    """Live books with a periodic image of each; see :func:`live_books` for the input."""
    return messages.groupBy("ticker").transformWithStateInPandas(
        RefreshingBook(policy, every_ms),
        outputStructType=BOOK_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


FOLLOW_UP_TRIES = 4
FOLLOW_UP_SCHEMA = "group string, event_ticker string, arrival bigint, outcome string, attempts int"


class FollowUps(StatefulProcessor):
    """Re-listings asked for while an admitted event still holds a market without a price.

    An event is asked for at most four times, then given up until all of its markets are priced.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("follow_up", "attempts int, gave_up boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        attempts, gave_up = self._state.get() if self._state.exists() else (0, False)
        out = []
        for row in _in_order(rows).itertuples(index=False):
            if row.unpriced == 0:
                if attempts and not gave_up:
                    out.append((*key, row.arrival, "priced", attempts))
                attempts, gave_up = 0, False
            elif not gave_up and attempts >= FOLLOW_UP_TRIES:
                gave_up = True
                out.append((*key, row.arrival, "gave_up", attempts))
            elif not gave_up:
                attempts += 1
                out.append((*key, row.arrival, "requested", attempts))
        self._state.update((attempts, gave_up))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLLOW_UP_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def follow_up_unpriced(listings: DataFrame) -> DataFrame:
    """Follow-up requests over ``(group, event_ticker, arrival, unpriced)`` listing results."""
    return listings.groupBy("group", "event_ticker").transformWithStateInPandas(
        FollowUps(), outputStructType=FOLLOW_UP_SCHEMA, outputMode="Append", timeMode="None"
    )
