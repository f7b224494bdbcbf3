from bookstrata.llm import op7_lines as N
from tests.llm.helpers import docs_frame, empty_docs, needs_data, odd_rows, same_as_sql, words


@needs_data
def test_equals_sql(spark):
    same_as_sql(spark, "op7_line_dedup")


def plain(rows):
    """What is left of each distinct (id, text), in order of id, null last."""
    distinct = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for i, t in distinct:
        lines = (t or "").split("\n")
        worded = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(lines) if words(x)]
        gone = set()
        for j in range(len(worded) - 2):
            window = tuple(x for _, x in worded[j : j + 3])
            if window in seen:
                gone |= {k for k, _ in worded[j : j + 3]}
            seen.add(window)
        left = t if not gone else "" if len(gone) == len(worded) else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out[i, t] = (left, len(worded), len(gone))
    return out


def compare(spark, rows):
    got = N.dedup_lines(docs_frame(spark, rows)).select("doc_id", "text", "n_lines", "n_removed").collect()
    want = plain([(i, t) for i, t, _, _ in rows])
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *want[i, t])) for i, t, _, _ in rows)


def test_odd_rows(spark):
    # Of rows with a null id only one has lines, so their order among each other decides nothing.
    compare(spark, odd_rows())


def test_overlaps(spark):
    a, b = "\n".join("abcdef"), "\n".join("xabcdy")
    rows = [(1, a, "en", "s"), (2, b, "en", "s"), (3, "q\n\n a \n\nb\nc\n r", "en", "s"), (4, "\n".join("zzzzzz"), "en", "s"), (5, "c\nd\ny\nb", "en", "s"), (6, a, "en", "s")]
    compare(spark, rows)
    got = {r.doc_id: r.text for r in N.dedup_lines(docs_frame(spark, rows)).collect()}
    assert got[1] == a and got[6] == "" and got[2] == "x\ny" and got[4] == "z"


def test_other_columns_pass_through(spark):
    docs = docs_frame(spark, odd_rows())
    got = N.dedup_lines(docs, ("one", "two"))
    assert got.columns == [*docs.columns, "one", "two"]
    assert N.dedup_lines(empty_docs(spark)).count() == 0
