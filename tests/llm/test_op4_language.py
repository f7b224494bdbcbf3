import math
import random
import tracemalloc

import pyarrow as pa

from bookstrata.llm import op4_language as L
from tests.llm.helpers import SF, docs_frame, empty_docs, needs_data, odd_rows


@needs_data
def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    got = entry.queries()["op4_language"](spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 200
    assert sum(r.rejected for r in rows) <= 2


def noise(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    return [" ".join(word() for _ in range(rng.choice([5, 20, 80, 300]))) for _ in range(n)]


@needs_data
def test_unlearned_languages_and_noise_are_rejected(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs.where(~L.held_out()).where("lang <> 'es'"))
    other = docs_frame(spark, [(i, t, "xx", "s") for i, t in enumerate(noise(1, 100))])
    share = lambda rows: rows.agg({"rejected": "count"}).first()[0] and rows.where("rejected").count() / rows.count()
    assert share(L.identify(docs.where("lang = 'es'"), model, ["doc_id"])) >= 0.9
    assert share(L.identify(other, model, ["doc_id"])) >= 0.9
    assert share(L.identify(docs.where(L.held_out()).where("lang <> 'es'"), model, ["doc_id"])) <= 0.02


def test_predictions_equal_a_plain_version(spark):
    """Centroids, cosines and reaches applied number by number."""
    docs = docs_frame(spark, corpus())
    model = L.fit(docs)
    texts = [t for _, t, _, _ in corpus()[:6]] + noise(2, 6) + ["der", "a", "the hill and der hund"]
    got = {r.doc_id: r for r in L.identify(docs_frame(spark, [(i, t, None, "s") for i, t in enumerate(texts)]), model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        (_, _, counts, letters), = L.Vectors().counts(pa.array([text]))
        weight = {k: math.log(1 + c) * float(model.idf[k]) for k, c in enumerate(counts[0].tolist()) if c}
        length = math.sqrt(sum(w * w for w in weight.values()))
        cosines = [sum(w / length * float(centroid[k]) for k, w in weight.items()) for centroid in model.centroids]
        best = max(range(len(cosines)), key=lambda c: (cosines[c], -c))
        n = sum(c.isalpha() for c in text)
        band = min(n.bit_length() - 1, L.BANDS - 1)
        assert n == letters[0]
        assert got[i].lang_pred == model.names[model.of[best]]
        assert abs(got[i].score - max(0.0, min(1.0, cosines[best]))) < 1e-5
        assert got[i].rejected == (cosines[best] < model.least[model.of[best], band])


def test_all_languages_are_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 5, f"l{i % 300}", "s") for i in range(600)]
    assert len(L.fit(docs_frame(spark, rows)).names) == 300


def test_stretches():
    assert L.stretches("") == [""] and L.stretches("a" * 16) == ["a" * 16]
    text = "".join(chr(97 + i % 26) for i in range(200))
    found = L.stretches(text)
    assert found[-1] == text and {len(s) for s in found} == {16, 32, 64, 128, 200}
    assert all(s in text for s in found) and found[0] == text[:16] and found[3] == text[-16:]


def corpus():
    english = "the cat and the dog went over the hill with their friends to see what was there "
    german = "der hund und die katze gingen mit ihren freunden über den hügel um zu sehen was dort war "
    return [(i, (english if i % 2 else german) * (1 + i % 3), "en" if i % 2 else "de", "a") for i in range(60)]


def test_odd_rows(spark):
    model = L.fit(docs_frame(spark, corpus()))
    assert model.names == ["de", "en"] and len(set(model.of)) == 2
    got = L.identify(docs_frame(spark, odd_rows()), model, ["doc_id", "text", "score", "lang"]).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert letters or (r.score == 0 and r.rejected)
    foreign = docs_frame(spark, [(1, "это совсем другой язык и другие буквы", None, "a"), (2, "the dog and the hill", None, "a"), (3, "die katze und der hügel", None, "a")])
    found = {r.doc_id: r for r in L.identify(foreign, model, ["doc_id"]).collect()}
    assert found[1].rejected and not found[2].rejected and not found[3].rejected
    assert (found[2].lang_pred, found[3].lang_pred) == ("en", "de")


def test_nothing_to_learn(spark):
    model = L.fit(empty_docs(spark))
    assert model.names == []
    got = L.identify(docs_frame(spark, [(1, "some text", "en", "a"), (2, None, None, None)]), model, ["doc_id"]).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in got} == {("und", 0.0, True)}
    assert L.identify(empty_docs(spark), L.fit(docs_frame(spark, corpus())), ["doc_id"]).count() == 0


def test_training_is_bounded(spark):
    model = L.fit(docs_frame(spark, corpus()), per_language=5, centroids=2)
    assert len(model.of) <= 4
    assert L.chosen_texts(docs_frame(spark, corpus() * 3), 5).groupBy("lang").count().agg({"count": "max"}).first()[0] == 5
    # Rows of null lang or without letters teach nothing.
    assert L.fit(docs_frame(spark, [(1, "abc", None, "a"), (2, "12", "en", "a")])).names == []


def test_counts_equal_plain_counting():
    texts = ["Ab, c", "", "é", "12 x  y", None, "a" * 50]
    found = {}
    for first, stop, counts, letters in L.Vectors().counts(pa.array(texts)):
        for i in range(first, stop):
            found[i] = (counts[i - first], int(letters[i - first]))

    def grams(text):
        line = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        while "  " in line:
            line = line.replace("  ", " ")
        return [line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if line[i : i + n] != " "]

    for i, text in enumerate(texts):
        want = grams(text) if any(c.isalpha() for c in text or "") else []
        if want:
            assert found[i][0].sum() == len(want), text
            assert (found[i][0] > 0).sum() <= len(set(want))
        assert found[i][1] == sum(c.isalpha() for c in text or "")


def test_counts_of_many_short_texts_are_held_a_few_rows_at_a_time():
    texts = pa.array(["ab cd"] * 5_000 + [None, ""])
    vectors = L.Vectors()
    tracemalloc.start()
    rows = letters = 0
    for first, stop, counts, some in vectors.counts(texts):
        assert first == rows and counts.shape == (stop - first, L.BUCKETS)
        rows, letters = stop, letters + int(some.sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and letters == 20_000
    assert peak < 64 << 20
