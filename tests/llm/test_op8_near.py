import random

import numpy as np
import pyarrow as pa
import pytest

from bookstrata.llm import components as C
from bookstrata.llm import op8_near as D
from bookstrata.llm.common import WordBlock, blocks
from tests.llm.helpers import docs_frame, empty_docs, odd_rows, words



def weighted_sets(rows):
    """Each distinct text with a word as a dictionary of shingle weights, by plain counting."""
    grams = {}
    for _, t, _, _ in rows:
        w = words(t)
        runs = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or ([" ".join(w)] if w else [])
        counts = {}
        for g in runs:
            counts[g] = counts.get(g, 0) + 1
        grams[t] = counts
    return grams


def brute(rows, weight):
    """Class of each row, by all pairs: (class id, whether a row of it may be kept)."""
    grams = weighted_sets(rows)
    texts = [t for t, c in grams.items() if c]
    sets = {t: {g: (1 + np.log(n)) * weight for g, n in grams[t].items()} for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            low = sum(min(w, sets[b].get(g, 0)) for g, w in sets[a].items())
            if low >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - low) - 1e-9:
                root[find(a)] = find(b)
    ids = {}
    for i, t, _, _ in rows:
        if grams[t] and i is not None:
            ids[find(t)] = min(i, ids.get(find(t), i))
    return {(i, t): ids.get(find(t)) if grams[t] else i for i, t, _, _ in rows}


def run(spark, rows):
    docs = docs_frame(spark, rows)
    got = D.near_duplicates(docs).collect()
    text = {r.digest: r.text for r in docs.select(D.digest().alias("digest"), "text").collect()}
    return got, text


def test_odd_rows(spark):
    rows = odd_rows()
    got, text = run(spark, rows)
    want = brute([(i, t or "", a, b) for i, t, a, b in rows], 1.0)
    assert len(got) == len(rows)
    for r in got:
        assert r.class_id == want[r.doc_id, text[r.digest] or ""], r
    kept = [r.class_id for r in got if r.kept and words(text[r.digest])]
    assert len(kept) == len(set(kept)) == len({r.class_id for r in got if words(text[r.digest])})
    assert all(r.kept for r in got if not words(text[r.digest]))
    assert D.near_duplicates(empty_docs(spark)).count() == 0


def copies(rng, n, edits, size=80):
    """A text and n copies of it, each with its own words in some places."""
    base = [f"w{rng.random()}" for _ in range(size)]
    out = [base]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.choice(edits)):
            copy[rng.randrange(size)] = f"e{rng.random()}"
        out.append(copy)
    return [" ".join(c) for c in out]


def test_groups_equal_all_pairs(spark):
    """Groups whose members link to the original but hardly to each other, chains, and a shared passage."""
    rng = random.Random(5)
    texts = copies(rng, 60, (1, 1, 2, 3)) + copies(rng, 20, (1, 2, 5))
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"o{rng.random()}" for _ in range(rng.choice((3, 6, 40)))) for _ in range(30)]
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join(chain[4 * i : 4 * i + 70]) for i in range(8)]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got, _ = run(spark, rows)
    want = brute(rows, 1.0)
    # Common shingles weigh a little less, so pairs at the very threshold may fall either way; none is here.
    assert {r.doc_id: r.class_id for r in got} == {i: c for (i, _), c in want.items()}
    assert sum(r.kept for r in got) == len(set(want.values()))


def test_copies_of_copies_in_one_bucket(spark):
    """An original with many copies, each with a copy of its own that is too far from the original."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(150):
        copy = list(base)
        for at in (rng.randrange(10, 30), rng.randrange(40, 60)):
            copy[at] = f"e{i}-{at}"
        second = list(copy)
        second[rng.randrange(70, 90)] = f"f{i}"
        texts += [" ".join(copy), " ".join(second)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, " ".join(base)])]
    docs = docs_frame(spark, rows)
    # All in one bucket, whose centre is the original: of texts in equally many buckets the one with the highest uid.
    held = docs.selectExpr("doc_id AS uid", "md5(cast(text AS binary)) AS digest", "array(1L) AS bands")
    labels = D.near_links(held, docs, D.cell_weights(0, np.zeros(0, int), np.zeros(0, int)))
    got = {r.id: r.label for r in labels.collect()}
    want = {i: c for (i, _), c in brute(rows, 1.0).items()}
    assert set(want.values()) == {0}
    assert {i: got.get(i, i) for i in want} == want


def test_compared_pairs_grow_with_a_group(spark, monkeypatch):
    """Near copies at about 0.75 of an original and at about 0.7 of each other: twice the copies, about twice the pairs."""
    counts = {}
    plain = D.compare
    for n in (150, 300):
        rng = random.Random(11)
        rows = [(i, t, "en", "s") for i, t in enumerate(copies(rng, n, (1, 2, 3, 4), 100))]
        seen = []
        monkeypatch.setattr(D, "compare", lambda pairs, *a, seen=seen, **k: seen.append(pairs.count()) or plain(pairs, *a, **k))
        got, _ = run(spark, rows)
        counts[n] = sum(seen)
        want = brute(rows, 1.0)
        assert sum(r.class_id == want[r.doc_id, t] for r, (_, t, _, _) in zip(sorted(got), rows)) >= 0.99 * len(rows)
    assert counts[300] <= 2.6 * counts[150], counts


def test_differences():
    a = (np.array([1, 3, 5, 9], np.uint64), np.array([1, 2, 3, 4], np.float32))
    b = (np.array([2, 3, 5], np.uint64), np.array([1, 2, 1], np.float32))
    shingles, by = D.difference(a, b)
    more = dict(zip(shingles.view(np.uint64).tolist(), by.tolist()))
    assert more.pop(1) == 1 and more.pop(5) == 2 and more.pop(9) == 4 and list(more.values()) == [1]
    # The same shingle on the other side has another number.
    back, _ = D.difference(b, a)
    assert not set(back.tolist()) & set(shingles.tolist())
    assert len(D.difference(a, a)[0]) == 0


def test_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    sampler = D.Sampler(3_000)
    hashes = np.sort(rng.integers(1, 1 << 63, 300).astype(np.uint64))
    a = (hashes[:220], rng.uniform(0.5, 4, 220).astype(np.float32))
    b = (hashes[60:], rng.uniform(0.5, 4, 240).astype(np.float32))
    common, wa, wb = D.overlap(a, b)
    agree = (sampler.samples(*a) == sampler.samples(*b)).mean()
    assert abs(agree - common / (wa + wb - common)) < 0.03
    assert (sampler.samples(*a) == sampler.samples(*a)).all()


def test_common_cells_weigh_less():
    weights = D.cell_weights(1_000, np.array([3, 7]), np.array([1_000, 10]))
    assert weights[3] == pytest.approx(1.0) and weights[0] == pytest.approx(1 + D.BOOST)
    assert weights[3] < weights[7] < weights[0]


def test_words_are_told_apart():
    texts = ["a bc", "ab c", "", None, "a  bc\n", "é \x1f x", "x" * 200_000 + " y", "x" * 200_001 + " y"]
    found = {}
    for first, stop, data, ends in blocks(pa.array(texts), 64):
        block = WordBlock(data, ends)
        for i in range(first, stop):
            found[i] = tuple(block.hashes[block.offsets[i - first] : block.offsets[i - first + 1]])
    assert found[0] == found[4] != found[1]
    assert [len(found[i]) for i in range(8)] == [len(words(t)) for t in texts]
    assert found[6][0] != found[7][0] and found[6][1] == found[7][1]


@pytest.mark.parametrize("n", [1, 2, 33])
def test_components_of_chains(spark, n):
    links = [(i, i + 1) for i in range(n)] + [(100 + i, 100) for i in range(1, 5)] + [(200, 200)]
    got = {r.id: r.label for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = dict.fromkeys(range(n + 1), 0) | dict.fromkeys(range(100, 105), 100)
    assert got == want


def test_components_of_nothing(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlaps_are_asked_only_of_cells_that_hold_texts(spark, monkeypatch):
    """A difference is sent once for each cell of excess in which some text lies, not for each cell that might hold one."""
    kept, write = {}, D.materialize

    def watch(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(D, "materialize", watch)
    # Texts 1 to 6 differ from the centre 0 by as much and share their differences in pairs.
    rest = spark.createDataFrame(
        [(i, 0, i, 80.0, 100.0, 100.0, False, [i // 2 * 50 + j for j in range(40)], [1.0] * 40) for i in range(2, 8)],
        "uid long, centre long, part long, common double, weight_a double, weight_b double, alike boolean, shingles array<long>, by array<float>",
    )
    pairs = {(r.a, r.b) for r in D._overlapping(rest, D.SIMILARITY).collect()}
    assert pairs == {(2, 3), (4, 5), (6, 7)}
    assert kept["overlaps"].select("other").distinct().count() == 1


def test_links_within_a_component_are_not_followed(spark, monkeypatch):
    """Classes are those of all links together while later rounds follow only links between components."""
    followed, real = [], D.components
    monkeypatch.setattr(D, "components", lambda links: followed.append(links.count()) or real(links))
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]]), "en", "s") for k in range(0, 60, 2)]
    got = D.near_duplicates(docs_frame(spark, rows)).collect()
    want = brute(rows, 1.0)
    assert {r.doc_id: r.class_id for r in got} == {i: c for (i, _), c in want.items()}
    assert all(n <= 1 for n in followed[1:])
