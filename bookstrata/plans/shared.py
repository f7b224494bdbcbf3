"""Results several queries read, computed once per session and input folder."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from bookstrata.operators import replay as R
from bookstrata.session import materialize
from bookstrata.sources import sample

_held: dict[tuple[str, str, str], tuple[Any, list[DataFrame]]] = {}

# An instant in the middle of the sample feed: 2024-01-15T00:00:00Z.
MIDDLE_NS = 1_705_276_800_000_000_000
# 2024-01-08T00:00:00Z.
QUARTER_NS = 1_704_672_000_000_000_000


def _present(spark: SparkSession, frames: list[DataFrame]) -> bool:
    """Whether the files behind some written results still exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for name in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(name)
            if not path.getFileSystem(conf).exists(path):
                return False
    return True


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], tuple[Any, list[DataFrame]]]) -> Any:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held or not _present(spark, _held[key][1]):
        _held[key] = make()
    return _held[key][0]


def forget() -> None:
    """Drop every shared result, so that the next query starts from the input tables."""
    _held.clear()


def whole_replay(spark: SparkSession, sf_dir: str, slice_rows: int = R.SLICE_ROWS) -> R.Books:
    """Replay of the whole sample feed, not shared: what a caller of the catalog runs."""
    parts = sample.deltas(spark, sf_dir), sample.snapshots(spark, sf_dir), sample.gaps(spark, sf_dir)
    return R.replay(*parts, slice_rows=slice_rows)


def _written(books: R.Books) -> tuple[R.Books, list[DataFrame]]:
    levels, status = materialize(books.levels, "levels"), materialize(books.status, "status")
    return R.Books(levels, status), [levels, status]


def final_books(spark: SparkSession, sf_dir: str) -> R.Books:
    return once(spark, sf_dir, "final", lambda: _written(whole_replay(spark, sf_dir)))


def middle_books(spark: SparkSession, sf_dir: str) -> R.Books:
    """Books at the middle instant."""

    def make() -> tuple[R.Books, list[DataFrame]]:
        parts = [
            t.where(t.recv_wall_ns <= MIDDLE_NS)
            for t in (sample.deltas(spark, sf_dir), sample.snapshots(spark, sf_dir), sample.gaps(spark, sf_dir))
        ]
        return _written(R.replay(*parts))

    return once(spark, sf_dir, "middle", make)


def timeline(spark: SparkSession, sf_dir: str, slice_rows: int = R.SLICE_ROWS) -> R.Timeline:
    def make() -> tuple[R.Timeline, list[DataFrame]]:
        parts = sample.deltas(spark, sf_dir), sample.snapshots(spark, sf_dir), sample.gaps(spark, sf_dir)
        line = R.timeline(*parts, slice_rows=slice_rows)
        return line, [line.log, line.cuts]

    return once(spark, sf_dir, f"timeline-{slice_rows}", make)


# Of the sample's gaps the calm feed keeps those of ids divisible by this.
CALM = 400


def calm_timeline(spark: SparkSession, sf_dir: str) -> R.Timeline:
    def make() -> tuple[R.Timeline, list[DataFrame]]:
        gaps = sample.gaps(spark, sf_dir).where(f"expected_seq % {CALM} = 0")
        line = R.timeline(sample.deltas(spark, sf_dir), sample.snapshots(spark, sf_dir), gaps)
        return line, [line.log, line.cuts]

    return once(spark, sf_dir, "timeline-calm", make)


def top_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best prices over time, written once."""

    def make() -> tuple[DataFrame, list[DataFrame]]:
        rows = materialize(timeline(spark, sf_dir).top_of_book(), "top")
        return rows, [rows]

    return once(spark, sf_dir, "top", make)
