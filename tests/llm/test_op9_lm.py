import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bookstrata.llm import op9_lm as M
from tests.llm.helpers import docs_frame, empty_docs, needs_data, odd_rows, same_as_sql, words


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, text string")


@needs_data
def test_equals_sql(spark):
    same_as_sql(spark, "op9_lm_scores")


def plain_losses(rows, targets, mix=M.MIX):
    """Sum of target and background losses of each text, from counts in dictionaries; and the two models."""
    texts = [words((t or "").lower()) for _, t, _, _ in rows]
    models = []
    for some in ([t for (i, *_), t in zip(rows, texts) if i in targets], texts):
        word, first, pair = Counter(), Counter(), Counter()
        for t in some:
            word.update(t)
            first.update([None, *t][: len(t)])
            pair.update(zip([None, *t], t))
        models.append((word, first, pair, sum(word.values())))
    size = len(models[1][0]) + 1

    def chance(model, before, w):
        word, first, pair, total = model
        own = (word[w] + 1) / (total + size)
        return mix * pair[before, w] / first[before] + (1 - mix) * own if first[before] else own

    if not models[0][3]:
        models[0] = models[1]
    losses = [[sum(-math.log(chance(m, v, w)) for v, w in zip([None, *t], t)) for m in models] for t in texts]
    return losses, texts, lambda i, v, w: chance(models[i], v, w)


def test_models_sum_to_one():
    rows = [(i, f"a b c d{i % 3} a b e{i}", "en", "s") for i in range(30)]
    _, texts, chance = plain_losses(rows, set(range(7)))
    vocabulary = {w for t in texts for w in t} | {"a word never seen"}
    for i in (0, 1):
        for before in (None, "a", "b", "d1", "e29"):
            assert abs(sum(chance(i, before, w) for w in vocabulary) - 1) < 1e-9


@pytest.mark.parametrize("size", [1 << 24, 60])
def test_scores_equal_plain_counting(spark, size):
    rows = [(i, f"A b c d{i % 3} a b e{i}" if i % 7 else "", "en", "s") for i in range(60)] + [(5, "a b", "en", "s"), (99, None, "en", "s")]
    targets = set(range(9))
    losses, texts, _ = plain_losses(rows, targets)
    marked = docs_frame(spark, rows).selectExpr("doc_id", "text", "doc_id < 9 AS target")
    got = sorted((r.doc_id, r.n_tokens, *(None if x is None else round(x, 9) for x in r[2:])) for r in M.score_all(marked, size=size).collect())
    want = []
    for (i, *_), t, (target, background) in zip(rows, texts, losses):
        n = len(t)
        means = (target / n, background / n, (target - background) / n) if n else (None,) * 3
        want.append((i, n, *(None if x is None else round(x, 9) for x in means)))
    assert list(map(repr, got)) == list(map(repr, sorted(want, key=repr))) or sorted(map(repr, got)) == sorted(map(repr, want))


def test_target_like_texts_score_low(spark):
    rows = [(i, "the old house on the hill " * 5 if i % 2 else "buy cheap pills now online " * 5, "en", "s") for i in range(40)]
    labels = labels_frame(spark, [(i, i % 2, "") for i in range(20)] + [(None, 1, ""), (3, None, "")])
    got = {r.doc_id: r for r in M.cross_entropy_difference(docs_frame(spark, rows), labels).collect()}
    assert max(got[i].score for i in range(1, 40, 2)) < min(got[i].score for i in range(0, 40, 2))
    assert all(abs(r.target_loss - r.background_loss - r.score) < 1e-12 for r in got.values())


def test_odd_rows(spark):
    got = M.cross_entropy_difference(docs_frame(spark, odd_rows()), labels_frame(spark, [(4, 1, ""), (7, 0, "")])).collect()
    assert sorted(repr((r.doc_id, r.n_tokens)) for r in got) == sorted(repr((i, len(words(t)))) for i, t, _, _ in odd_rows())
    assert all((r.score is None) == (r.n_tokens == 0) for r in got)
    assert M.cross_entropy_difference(empty_docs(spark), labels_frame(spark, [])).count() == 0


def test_no_target(spark):
    got = M.cross_entropy_difference(docs_frame(spark, [(1, "a b c", "en", "s"), (2, "", "en", "s")]), labels_frame(spark, [])).collect()
    assert [r.score for r in sorted(got, key=lambda r: r.doc_id)] == [0.0, None]


def test_rare_words_and_pairs_count_at_any_size(spark):
    """A word and a pair far below the shares of a larger corpus still make a target text score low."""
    common = "the old house stands on the hill " * 200_000
    rows = [(0, common, "en", "s"), (1, common, "en", "s"), (2, "zebra quark", "en", "s"), (3, "zebra quark", "en", "s"), (4, "quark zebra", "en", "s")]
    rows += [(5, "lone word", "en", "s")]
    docs = docs_frame(spark, rows)
    got = {r.doc_id: r for r in M.cross_entropy_difference(docs, labels_frame(spark, [(2, 1, "")])).collect()}
    assert got[3].score == got[2].score < min(0, got[4].score, got[5].score)
    losses, texts, _ = plain_losses(rows, {2})
    for (i, *_), t, (target, background) in zip(rows, texts, losses):
        assert abs(got[i].score - (target - background) / len(t)) < 1e-9


def test_blocks_do_not_matter(spark):
    rows = [(i, f"a b c d{i % 3} a b e{i}" if i % 7 else "", "en", "s") for i in range(60)] + [(5, "a b", "en", "s"), (None, "b a", "en", "s")]
    marked = docs_frame(spark, rows).selectExpr("doc_id", "text", "coalesce(doc_id < 9, false) AS target")
    want, got = (sorted(map(repr, M.score_all(marked, size=size).selectExpr("doc_id", "n_tokens", "round(score, 9)").collect())) for size in (1 << 24, 40))
    assert got == want and len(got) == len(rows)


def test_counts_travel_as_few_bytes(spark):
    """A block sends one row a range of keys, and some seven bytes for each of its words and pairs."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 50_000}" for _ in range(1_000)), "en", "s") for i in range(300)]
    marked = docs_frame(spark, rows).coalesce(1).selectExpr("doc_id", "text", "doc_id < 30 AS target")
    stored = M.word_blocks(marked)
    sent = M.counts_sent(stored, 3).collect()
    keys = sum(len(M.Counted.of(r.packed).keys) for r in stored.collect())
    assert keys > 40_000 and len(sent) == 8 * stored.count()
    assert sum(len(r.sent) for r in sent) < 8 * keys


def test_squeezed_numbers_return():
    parts = [np.arange(5, dtype=np.uint64) << np.uint64(60), np.zeros(0, np.int32), np.array([7], np.uint8)]
    back = M.unsqueezed(M.squeezed(parts), [np.uint64, np.int32, np.uint8])
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(parts, back))


def test_blocks_span_batches_and_are_read_in_parts(monkeypatch):
    """A block's words are found a megabyte at a time, and a batch's end does not end it."""
    sizes, real = [], M.WordBlock
    monkeypatch.setattr(M, "WordBlock", lambda data, ends: sizes.append(len(data)) or real(data, ends))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["Some words " * 1_000] * 300)], names=["doc_id", "text"])
    found = list(M._word_blocks(iter([batch, batch.slice(0, 0), batch]), 1, 1 << 24))
    assert len(found) == 1 and max(sizes) <= 1 << 20
    rows, words = found[0]
    assert rows.column(0).to_pylist() == [*range(300)] * 2 and set(np.diff(words.offsets)) == {2_000} and len(words.hashes) == 1_200_000
