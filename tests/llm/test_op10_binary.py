import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bookstrata.llm import op10_binary as B
from bookstrata.session import scratch_path
from tests.llm.helpers import SF, docs_frame, empty_docs, needs_data, odd_rows

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(B.tokenizer_path())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, B.END]


def expected(library, rows):
    """rows in order: (id, text)."""
    out, start = [], 0
    for i, t in rows:
        ids = ids_of(library, t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@needs_data
def test_query_equals_library(spark, library):
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = entry.queries()["op10_token_files"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(library, docs)


def test_odd_rows(spark, library):
    rows = [*odd_rows(), (13, "a <|endoftext|> b", "en", "s"), (14, "don't we'LL 's ''s \U0001fae8 x", "en", "s")]
    folder = scratch_path(spark, "odd")
    B.write(docs_frame(spark, rows).repartition(3), folder, block=2_000)
    got = [tuple(r) for r in B.read(spark, folder).orderBy("start").collect()]
    # Rows of a null id: the order between them is that of a hash of their texts.
    known = sorted(((i, t) for i, t, _, _ in rows if i is not None), key=lambda r: r[0])
    assert got[: len(known)] == expected(library, known)
    assert [r[0] for r in got[len(known) :]] == [None, None]
    assert sorted(r[2:] for r in got[len(known) :]) == sorted(r[2:] for r in expected(library, [(None, t) for i, t, _, _ in rows if i is None]))
    blocks = spark.read.parquet(folder)
    assert blocks.count() > 3
    ordered = [i for r in blocks.orderBy("shard", "block").collect() for i in r.doc_id]
    assert ordered == [r[0] for r in got]
    # One document at a time, without the others.
    texts = dict(known)
    for r in blocks.collect():
        block = r.asDict()
        for at, i in enumerate(block["doc_id"]):
            if i is not None:
                assert list(B.read_document(block, at)) == ids_of(library, texts[i])


def test_empty(spark):
    folder = scratch_path(spark, "none")
    B.write(empty_docs(spark), folder)
    assert B.read(spark, folder).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=8), st.sampled_from([6, 70_000]), st.integers(1, 40))
def test_grammar_round_trip(docs, vocabulary, batch):
    ids = np.concatenate([np.array([*d, 2], np.uint32) for d in docs])
    ends = np.cumsum([len(d) + 1 for d in docs])
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    symbols, rules = B.compress(ids, last, vocabulary, rounds=batch, least=2)
    lengths = B.rule_lengths(rules, vocabulary)
    grammar = B.Grammar(vocabulary, rules, lengths)
    assert (grammar.expand(symbols) == ids).all()
    # Every document is a run of whole symbols.
    assert set(ends) <= set(np.cumsum(grammar.length(symbols)))
    assert len(symbols) <= len(ids)


def test_grammar_shortens():
    ids = np.tile(np.arange(100, dtype=np.uint32), 1_000)
    last = np.zeros(len(ids), bool)
    last[-1] = True
    symbols, rules = B.compress(ids, last, 50_257)
    assert len(symbols) + 2 * len(rules) < len(ids) / 50


def test_a_full_table_is_emptied(library):
    encoder = B.Encoder(B.tokenizer_path(), rows=4)
    for texts in (["a b c d"], ["e f", "g"], ["a b", "", "x"]):
        assert [list(x) for x in encoder.encode(texts)] == [ids_of(library, t)[:-1] for t in texts]
        assert len(encoder.index) <= 4


def test_rules_of_rules():
    """More frequent pairs than free symbols, and passages that come again: rules nest, a passage becomes few symbols."""
    rng = np.random.default_rng(4)
    vocabulary = 50_257
    passage = rng.integers(3, vocabulary, 256)
    common = rng.integers(3, vocabulary, (9_000, 2))
    parts = [common[rng.integers(0, len(common), 40)].ravel() if k % 2 else passage for k in range(7_000)]
    ids = np.concatenate(parts).astype(np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    symbols, rules = B.compress(ids, ends, vocabulary)
    assert (rules >= vocabulary).any(axis=1).mean() > 0.02
    lengths = B.rule_lengths(rules, vocabulary)
    assert lengths.max() >= 256 and len(rules) <= 65_536 - vocabulary
    grammar = B.Grammar(vocabulary, rules, lengths)
    assert (grammar.expand(symbols) == ids).all()
    # 256 ids of a passage are at most a few symbols, so that they and the pairs between take less than half of the rest.
    assert len(symbols) < 0.15 * len(ids)


def test_rounds_count_what_may_still_be_frequent(monkeypatch):
    """Later rounds leave out places whose pairs are rare: all rounds together sort few times as many pairs as there are ids."""
    rng = np.random.default_rng(5)
    common = rng.integers(3, 50_257, (9_000, 2))
    ids = np.concatenate([common[rng.integers(0, len(common), 40)].ravel() if k % 2 else rng.integers(3, 50_257, 100) for k in range(8_000)]).astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[::500] = last[-1] = True
    counted, sort = [], np.sort
    monkeypatch.setattr(B.np, "sort", lambda x, *rest: counted.append(len(x) if x.dtype == np.uint32 else 0) or sort(x, *rest))
    symbols, rules = B.compress(ids, last, 50_257)
    monkeypatch.undo()
    counted = [n for n in counted if n]
    assert len(counted) > 8 and sum(counted) < 0.5 * len(counted) * len(symbols)
    grammar = B.Grammar(50_257, rules, B.rule_lengths(rules, 50_257))
    assert (grammar.expand(symbols) == ids).all()


TEXTS = ["it's  'sad'.\n\n Don't,we'LL x1y2 z_", " ", "a ", "", " b\xa0c  d​e", "fin. É×÷ûí é́!", "x\ty\r\n z \x85 \x1c!'s", "日本 語 \U0001d4e3 été", "1'2's"]


def test_pieces_of_one_hash(library, monkeypatch):
    """Other texts than those of the table go to the library, also where all hashes are the same."""
    monkeypatch.setattr(B, "span_hashes", lambda data, starts: np.diff(np.append(starts, len(data))).astype(np.uint64) % np.uint64(2) << np.uint64(62))
    encoder = B.Encoder(B.tokenizer_path())
    for texts in (TEXTS, TEXTS[::-1], ["Adam eats an egg", "Edam oats in ice"]):
        assert [list(x) for x in encoder.encode(texts)] == [ids_of(library, t)[:-1] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aEé×÷'s.,!1² \n\t\r\xa0 　᠎́д語-_"), max_size=12), min_size=1, max_size=4))
def test_pieces_equal_library(library, texts):
    encoder = B.Encoder.of(B.tokenizer_path())
    assert [list(x) for x in encoder.encode(texts)] == [ids_of(library, t)[:-1] for t in texts]
