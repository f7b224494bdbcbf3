"""Line dedup by overlapping three-line windows [native].

The lines of a text that hold a word, trimmed of white space, form a window for every three that follow each
other. A window that occurs more than once, in whatever documents, is kept where it occurs first (by doc_id,
null last; then by a hash of the text; then by position) and every later occurrence marks its three lines.
Marked positions are merged and removed. Windows are told apart by two 64-bit hashes of their lines.

Windows are pre-aggregated before they are shuffled, so a window that a third of all documents share is one
row a task; marking is a join against one row for each repeated window, which adaptive execution splits.
Texts move once, to meet the positions to remove.

Defined results: a null text stays null; a text of fewer than three lines with a word has no window and
stays as it is; blank lines stay, unless no line with a word is left, which leaves an empty text; rows equal
in id and text count as one document and get the same result; columns other than doc_id and text pass
through, but for those this operator adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.llm.common import WHITE, materialize, table, text_of

# Columns the operator works with; they can't clash with any that pass through.
_ID, _HASH, _RANKS = "_line_id", "_line_hash", "_line_ranks"


def _worded(text: Column) -> Column:
    """Array of (position, trimmed line) of the lines with a word."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(WHITE)).alias("line")))
    return F.filter(lines, lambda z: z["line"] != "")


def windows(docs: DataFrame) -> DataFrame:
    """id, hash of the text, rank of the first line, and two hashes of each window of three lines."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), _worded(text_of()).alias("z"))
    rows = rows.where(F.size("z") >= 3)
    line = lambda j: F.get("z", j)["line"]
    each = F.transform(
        F.sequence(F.lit(0), F.size("z") - 3),
        lambda j: F.struct(
            j.alias("rank"),
            F.xxhash64(line(j), line(j + 1), line(j + 2)).alias("w1"),
            F.xxhash64(F.lit("second"), line(j), line(j + 1), line(j + 2)).alias("w2"),
        ),
    )
    return rows.select("id", "h", F.inline(each))


def later_occurrences(found: DataFrame) -> DataFrame:
    """id, h, rank of the windows that occurred before."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "rank")
    firsts = found.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    return found.join(firsts.drop("n"), ["w1", "w2"]).where(place != F.col("first")).select("id", "h", "rank")


def dedup_lines(docs: DataFrame, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with its text freed of repeated windows; ``names`` are the counts of lines with a word, and removed."""
    later = later_occurrences(materialize(windows(docs), "windows"))
    marked = later.groupBy(F.col("id").alias(_ID), F.col("h").alias(_HASH)).agg(F.sort_array(F.collect_set("rank")).alias(_RANKS))
    same = (F.xxhash64("text") == F.col(_HASH)) & F.col("doc_id").eqNullSafe(F.col(_ID))
    # Few rows on the right; hashing them spares sorting the texts.
    rows = docs.join(marked.hint("shuffle_hash"), same, "left")
    rows = rows.withColumn("_line_all", _worded(text_of()))
    gone = F.array_distinct(F.flatten(F.transform(_RANKS, lambda j: F.slice("_line_all", j + 1, 3)["i"])))
    rows = rows.withColumn("_line_gone", F.coalesce(gone, F.array().cast("array<int>")))
    lines = F.split("text", "\n", -1)
    rows = rows.withColumn("_line_split", F.when(F.size("_line_gone") > 0, lines))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_line_split") - 1), F.col("_line_gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.get("_line_split", i)), "\n")
    n_lines, n_gone = F.size("_line_all").cast("long"), F.size("_line_gone").cast("long")
    text = F.when(n_gone == 0, F.col("text")).when(n_gone == n_lines, F.lit("")).otherwise(rest)
    rows = rows.withColumns({"text": text, names[0]: n_lines, names[1]: n_gone})
    return rows.drop(_ID, _HASH, _RANKS, "_line_all", "_line_gone", "_line_split")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# Reads a relation ``{docs}`` with unique doc_id; leaves ``line_dedup`` (doc_id, n_lines, n_removed, new_text).
SQL_STEPS = r"""
line_all AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {docs}),
line_word AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM line_all),
line_rank AS (SELECT *, row_number() OVER w AS r, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(pos) OVER w AS p2, lead(pos, 2) OVER w AS p3
  FROM line_word WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
line_again AS (SELECT *, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id NULLS LAST, r) AS k FROM line_rank WHERE l3 IS NOT NULL),
line_gone AS (SELECT DISTINCT doc_id, unnest([pos, p2, p3]) AS pos FROM line_again WHERE k > 1),
line_rest AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.pos) AS rest
  FROM line_all a LEFT JOIN line_gone g ON a.doc_id = g.doc_id AND a.pos = g.pos WHERE g.pos IS NULL GROUP BY a.doc_id),
line_count AS (SELECT doc_id, count(*) AS n FROM line_rank GROUP BY doc_id),
line_cut AS (SELECT doc_id, count(*) AS n FROM line_gone GROUP BY doc_id),
line_dedup AS (SELECT d.*, coalesce(c.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed,
  CASE WHEN g.n IS NULL THEN d.text WHEN g.n = c.n THEN '' ELSE r.rest END AS new_text
  FROM {docs} d LEFT JOIN line_count c ON d.doc_id = c.doc_id LEFT JOIN line_cut g ON d.doc_id = g.doc_id LEFT JOIN line_rest r ON d.doc_id = r.doc_id)
"""

QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE = {
    "op7_line_dedup": "WITH " + SQL_STEPS.format(docs="documents") + "SELECT doc_id, n_lines, n_removed, md5(new_text) AS text_md5 FROM line_dedup"
}
