"""Small tables and plain Python versions that tests compare with."""

from __future__ import annotations

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")

LONG = "lorem ipsum dolor sit amet, consectetur. " * 8_000

# Clashing names: columns the operators make or work with.
DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, size int, kept string, "
    "digest string, n_lines int, score string, uid int, bands string, mixed string, h int, bin int"
)


def docs_frame(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    extra = ("k", 1, "x", "d", 2, "s", 3, "b", "m", 4, 5)
    full = [(i, t, lang, s, None if t is None else len(t), *extra) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    """Nulls, empty and white texts, a very long one, ties, equal rows."""
    poem = "\n".join(f"line number {i} of the poem says word{i} again" for i in range(6))
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", None, "b"),
        (4, poem, "en", "b"),
        (5, poem, "en", None),
        (5, poem, "en", None),
        (6, "short text", "fr", "b"),
        (None, poem, None, None),
        (None, None, None, None),
        (7, LONG, "en", "a"),
        (8, LONG, "en", "c"),
        (9, "!!! 123 ???", "en", "c"),
        (10, "日本語 \U0001d4e3 é́ \x00 �", "xx", "c"),
        (11, "x" * 100_000, "en", "c"),
        (12, "\n" * 5_000, "en", "c"),
    ]


def empty_docs(spark):
    return docs_frame(spark, [])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def same_as_sql(spark, name, sf=SF):
    """Whether a query equals its SQL in DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from tools.check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, rel.fetchall())
