import hashlib

import pytest

import corpus_pipeline as P
from bookstrata.llm import op2_mixing, op5_pieces
from tests.llm.helpers import SF, docs_frame, empty_docs, needs_data, odd_rows, words
from tests.llm.test_op7_lines import plain as plain_lines
from tests.llm.test_op8_near import brute


def test_stages():
    assert [name for name, _ in P.STAGES] == ["language", "lines", "near_duplicates", "mix", "pieces"]


@needs_data
def test_each_stage_equals_a_plain_version(spark):
    """Every stage on what the one before it kept."""
    duckdb = pytest.importorskip("duckdb")
    spm = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns

    def keep(stage, docs):
        out = stage(spark, docs, SF)
        assert out.columns == columns and out.schema == docs.schema
        rows = out.collect()
        return rows, spark.createDataFrame(rows, docs.schema)

    first = docs.collect()
    rows, docs = keep(P.language, docs)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in first} and len(rows) >= 0.98 * len(first)
    assert set(rows) <= set(first)

    before = [(r.doc_id, r.text) for r in rows]
    rows, docs = keep(P.lines, docs)
    want = {i: t for (i, _), (t, n, gone) in plain_lines(before).items() if n > gone}
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)

    classes = brute([(r.doc_id, r.text, None, None) for r in rows], 1.0)
    rows, docs = keep(P.near_duplicates, docs)
    assert sorted(r.doc_id for r in rows) == sorted(set(classes.values()))

    con = duckdb.connect()
    con.execute("CREATE TABLE left_over (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO left_over VALUES (?, ?, ?)", [(r.doc_id, r.source, r.text) for r in rows])
    sql = op2_mixing.ORACLE_TEMPLATE.format(seed=op2_mixing.SEED, docs="left_over", share=op2_mixing.SHARE, epochs=op2_mixing.EPOCHS)
    want = sorted(i for i, n in con.execute(sql + "SELECT doc_id, repeats FROM m").fetchall() for _ in range(n))
    rows, docs = keep(P.mix, docs)
    assert sorted(r.doc_id for r in rows) == want

    library = spm.SentencePieceProcessor(model_file=op5_pieces.model_path())
    text = {r.doc_id: r.text for r in rows}
    got = P.pieces(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == want
    for r in got:
        assert r.ids == library.encode(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids).encode()).hexdigest()


def test_odd_rows(spark):
    docs = docs_frame(spark, odd_rows())
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "pieces":
            assert out.columns == docs.columns
            assert all(words(r.text) for r in rows) or name == "language"
            assert rows
            docs = spark.createDataFrame(rows, docs.schema)
        else:
            assert out.columns[0] == "doc_id" and rows


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_empty(spark, name, stage):
    assert stage(spark, empty_docs(spark), SF).count() == 0
