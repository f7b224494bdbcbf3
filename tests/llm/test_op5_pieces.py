import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bookstrata.llm import op5_pieces as P
from tests.llm.helpers import SF, docs_frame, empty_docs, needs_data, odd_rows

spm = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=P.model_path())


def expected(library, text):
    ids = library.encode(text or "")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))


def through_table(table, text):
    chunks = table.cut(text)
    rows = [table.learn(set(chunks))[c] for c in chunks]
    return [i for r in rows for i in r[2]], " ".join([r[3] for r in rows])


PARTS = st.one_of(st.sampled_from([" ", "  ", "▁", "\n", "\t", "the", "<s>", "<0x0A>", "　", "é", "\U0001d4e3", "\x00"]), st.text(max_size=4))


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_any_text(text):
    library = spm.SentencePieceProcessor(model_file=P.model_path())
    table = P.ChunkTable(P.model_path(), rows=50)
    text = text.encode("utf-8", "ignore").decode()
    ids = library.encode(text)
    assert through_table(table, text) == (ids, library.decode(ids))


@needs_data
def test_query_equals_library(spark, library):
    import __spark_entry__ as entry

    got = {r.doc_id: tuple(r)[1:] for r in entry.queries()["op5_sentencepiece"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {i: expected(library, t) for i, t in docs}


def test_odd_rows(spark, library):
    docs = docs_frame(spark, odd_rows()).withColumn("key", __import__("pyspark").sql.functions.col("doc_id"))
    got = P.encode(docs, ids=True).collect()
    want = sorted(map(repr, ((i, *expected(library, t)) for i, t, _, _ in odd_rows())))
    assert sorted(map(repr, ((r.key, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got))) == want
    assert all(len(r.ids) == r.n_tokens and library.decode(r.ids) == r.decoded for r in got)
    assert P.encode(empty_docs(spark)).count() == 0


def test_a_full_table_is_emptied(library):
    table = P.ChunkTable(P.model_path(), rows=3)
    for text in ("a b c d e f", "g h", "a b", "i j k l"):
        assert through_table(table, text)[0] == library.encode(text)
        assert len(table.known) <= 3


def test_other_models_are_refused():
    class Crossing:
        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁a", "a▁b"][i]

        def encode(self, text, out_type=int):
            return ["▁a", "▁▁b"] if out_type is str else text

        def decode(self, ids):
            return ids

    assert not P.cuttable(Crossing())
