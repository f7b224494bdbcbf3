import math

import pytest
from pyspark.sql import functions as F

from bookstrata.llm import op1_quality as Q
from tests.llm.helpers import docs_frame, empty_docs, needs_data, odd_rows, same_as_sql, words


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, kept string")


@needs_data
def test_equals_sql(spark):
    same_as_sql(spark, "op1_quality_rules")


@pytest.mark.parametrize(("k", "n", "p"), [(0, 1, 0.5), (3, 40, 0.1), (2, 5000, 0.01), (0, 0, 0.2), (30, 20000, 0.002)])
def test_binomial(spark, k, n, p):
    frame = spark.createDataFrame([(k, n)], "k long, n long")
    got = frame.select(Q.binomial_cdf(F.col("k"), F.col("n"), p)).first()[0]
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k <= n * p else 1.0
    assert math.isclose(got, want, rel_tol=1e-9)


def plain(text):
    w = words(text)
    spans = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, s in enumerate(spans) if spans.count(s) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>") if text else 0, len(lines) - len(set(lines)), len(covered)


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] not in (7, 8)] + [(20, "a b c a b c a b # | c\nx\nx \nx\n", "en", "a")]
    got = Q.quality(docs_frame(spark, rows), labels_frame(spark, [(4, 1, 0, ""), (None, 1, 0, ""), (5, None, 0, ""), (5, 0, 1, "")]))
    found = sorted(((r.doc_id is None, r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect())
    want = sorted(((i is None, i), *plain(t)) for i, t, _, _ in rows)
    assert repr(found) == repr(want)


def test_long_text(spark):
    got = Q.quality(docs_frame(spark, [r for r in odd_rows() if r[0] in (7, 8)]), labels_frame(spark, [])).collect()
    assert [(r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in got] == [(48_000, 48_000, True, False)] * 2


def test_empty(spark):
    assert Q.quality(empty_docs(spark), labels_frame(spark, [])).count() == 0


def test_risk_is_held(spark):
    """A rule that would reject many good rows is refused; one that meets bad rows alone is used."""
    rows, marks = [], []
    for i in range(4_000):
        bad = i % 10 == 0
        body = " ".join(f"w{i}x{j}" + ("###" if bad else "") for j in range(60))
        shout = " ".join(f"W{i}X{j}".upper() for j in range(60)) if i % 3 == 0 and not bad else ""
        rows.append((i, f"{body} {shout}", "en", "a"))
        marks.append((i, 0 if bad else 1, 0, ""))
    measured = Q.measures(docs_frame(spark, rows)).persist()
    cutoffs = Q.certify(measured, labels_frame(spark, marks))
    used = {r.rule: r for r in cutoffs.collect()}
    assert "symbols_per_word" in used and used["symbols_per_word"].good_rejected == 0
    assert "capital_share" not in used
    # Too few labels certify nothing.
    assert Q.certify(measured, labels_frame(spark, marks[:200])).count() == 0
    kept = Q.apply_rules(measured, cutoffs).groupBy("kept").count().collect()
    assert {(r.kept, r["count"]) for r in kept} == {(True, 3600), (False, 400)}
    measured.unpersist()
