import random

from bookstrata.operators import integrity as I


def brute(gaps, stints, images):
    """Every gap against every market."""
    out = {}
    for segment, sid, gap in gaps:
        waiting = [s for s in stints if s[:2] == (segment, sid) and s[3] < gap < s[4]]
        after = []
        for s in waiting:
            later = [(o, w) for seg, sub, ticker, o, w in images if (seg, sub, ticker) == s[:3] and o > gap]
            after.append(min(later, default=None))
        if waiting:
            out[segment, gap] = None if None in after else max(after)[1]
    return out


def test_gaps_meet_spans(spark):
    rng = random.Random(3)
    gaps, stints, images, at = [], [], [], 0
    for segment in ("a", "b"):
        numbers = rng.sample(range(1, 200_000), 1_500)
        for sid in (1, 2):
            for ticker in "UVWXYZ":
                ordinal = rng.randrange(5_000)
                while ordinal < 180_000 and rng.random() < 0.8:
                    end = ordinal + rng.randrange(10, 90_000)
                    stints.append((segment, sid, ticker, ordinal, end if rng.random() < 0.7 else I._FAR))
                    if stints[-1][4] == I._FAR:
                        break
                    ordinal = end + rng.randrange(5_000)
            for _ in range(400):
                at = numbers.pop()
                if rng.random() < 0.3:
                    gaps.append((segment, sid, at))
                else:
                    images.append((segment, sid, rng.choice("UVWXYZ"), at, at * 7))
    gaps += [("a", None, 77), ("c", 1, 5)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = I._resolved(
        frame(gaps, "segment string, sid int, ordinal bigint"),
        frame(stints, "segment string, sid int, ticker string, from_ordinal bigint, to_ordinal bigint"),
        frame(images, "segment string, sid int, ticker string, ordinal bigint, wall bigint"),
    )
    want = brute(gaps, stints, images)
    assert {(r.segment, r.gap_at): r.resolved for r in got.collect()} == want
    assert len(want) > 300 and None in want.values()
