import pytest
from pyspark.sql import functions as F

from bookstrata.llm import op2_mixing as M
from tests.llm.helpers import docs_frame, empty_docs, needs_data, odd_rows, same_as_sql, words


@needs_data
def test_equals_sql(spark):
    same_as_sql(spark, "op2_mixing")


def poured(sizes, weights, wanted, epochs):
    """Water-filling by bisection."""
    low, high = 0.0, max(epochs * s / w for s, w in zip(sizes, weights)) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(level * w, epochs * s) for s, w in zip(sizes, weights)) < wanted:
            low = level
        else:
            high = level
    return [min(high * w, epochs * s) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("sizes", [[100, 1, 1, 1], [1, 10, 100, 1000, 10_000], [7, 7, 7], [5], [0, 3, 0]])
@pytest.mark.parametrize("share", [0.3, 1.5, 2.0])
def test_water_fill(spark, sizes, share):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    frame = spark.createDataFrame(list(enumerate(zip(sizes, weights))), "i int, x struct<source_size:long,weight:int>").select("i", "x.*")
    got = [r.target for r in M.water_fill(frame, share * sum(sizes), 2).orderBy("i").collect()]
    assert got == pytest.approx(poured(sizes, weights, share * sum(sizes), 2), abs=1e-6)


def test_odd_rows(spark):
    docs = docs_frame(spark, odd_rows())
    got = M.mix(docs, ("doc_id", "text", "source"))
    rows = got.select("doc_id", "text", "source", "mixed.*").collect()
    again = M.mix(docs.repartition(3), ("doc_id", "text", "source")).select("doc_id", "text", "source", "mixed.*").collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert r.size == len(words(r.text)) and 0 <= r.taken <= 2 * r.size
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6


def test_empty(spark):
    assert M.mix(empty_docs(spark)).count() == 0


def test_ranks_are_by_code_point(spark):
    names = ["b", "a", "\U0001f600", "￿", "Z", None, ""]
    frame = spark.createDataFrame([(f"s{n}" if n is not None else "null", n, 1) for n in names], "name string, source string, source_size long")
    got = {r.source: r["rank"] for r in M.ranked_sources(frame).collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == ["", "Z", "a", "b", "￿", "\U0001f600", None]


def test_other_weights(spark):
    docs = docs_frame(spark, [(i, "word " * 10, "en", "ab"[i % 2]) for i in range(100)])
    got = M.mix(docs, weights=lambda rank: F.when(rank == 0, 1).otherwise(3), share=1.0)
    assert {r.target for r in got.select("mixed.target").distinct().collect()} == {250.0, 750.0}
