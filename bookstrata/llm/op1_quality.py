"""Quality rules whose cutoffs are certified on labelled rows [native].

Each rule rejects a text whose measure exceeds a cutoff. Cutoffs are not set by hand: for every stratum
(by default the language) and every candidate cutoff of a fixed grid, the labelled good rows of that
stratum are a holdout that no cutoff was fitted to. A cutoff may be used only if the exact binomial
(Clopper-Pearson) upper bound of its false-rejection rate stays within the rule's share of ``risk``, at the
confidence that a Bonferroni correction over all strata, rules and cutoffs demands. So with probability
``1 - error`` no stratum loses more than ``risk`` of its good rows to all rules together. Among certified
cutoffs the one that rejects most bad rows, less the good ones it rejects, is taken; of equal ones the
most lenient. A stratum with too few labelled rows certifies nothing and keeps everything.

The bound is tested in its dual form: the upper bound is at most ``a`` exactly if P(Bin(n, a) <= k) is at
most the error share. The sum has k + 1 terms, and a cutoff with k > a*n is refused without it.

Defined results: a null text is empty; null is a stratum of its own; label rows with a null id or quality
are ignored, and of several labels of one id the highest counts; repeated rows are judged each; columns
other than the named ones are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.llm.common import materialize, table, text_of

# Parameters: measure -> candidate cutoffs, from strict to lenient.
GRID = {
    "symbols_per_word": (0.1, 0.2, 0.4, 0.8, 1.6, 3.2),
    "repeated_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5),
    "equal_line_share": (0.1, 0.2, 0.3, 0.4, 0.6, 0.8),
    "capital_share": (0.1, 0.2, 0.3, 0.4, 0.6, 0.8),
    "exclamations_per_word": (0.1, 0.2, 0.4, 0.6, 0.8, 1.2),
    "word_length": (8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
}
RISK = 0.05
ERROR = 0.05
SYMBOLS = "[^#*$%&|<>]+"
COUNTED = r"[^#*$%&|<>!\p{Lu}]+"
# From each word, itself and the next two; a match goes on where the last one ended.
TRIPLE = r"\G(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++ "


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the base counts and one column for each measure of ``GRID``. Texts are read once."""
    rows = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), text_of().alias("t"))
    # The words with one space between them, and the few characters that measures count.
    plain = F.btrim(F.regexp_replace("t", r"[\x09-\x0D]", " "))
    rows = rows.select("*", plain.alias("u"), F.regexp_replace("t", COUNTED, "").alias("c"))
    rows = rows.withColumn("u", F.when(F.contains("u", F.lit("  ")), F.regexp_replace("u", "  +", " ")).otherwise(F.col("u")))
    lines = F.filter(F.split("t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    chars = F.length(F.replace("u", F.lit(" "), F.lit("")))
    rows = rows.select(
        "doc_id",
        "stratum",
        F.when(F.col("u") == "", 0).otherwise(F.length("u") - chars + 1).cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        F.length(F.regexp_replace("c", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("c", "[^!]+", "")).cast("long").alias("n_exclamations"),
        F.length(F.regexp_replace("c", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        lines.alias("lines"),
        F.regexp_extract_all("u", F.lit(TRIPLE), 1).alias("h"),
    )
    # Only a text with some equal triples needs them in order.
    pairs = F.sort_array(F.arrays_zip(F.col("h").alias("h"), F.sequence(F.lit(0), F.size("h") - 1).alias("i")))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs))
    follows = F.zip_with(F.col("s")["h"], F.slice(F.col("s")["h"], 2, F.size("s")), lambda a, b: a == b)
    rows = rows.withColumn("f", follows)  # whether the next one in order is equal; null after the last
    either = F.arrays_zip(F.col("s")["i"].alias("i"), F.col("f").alias("f"), F.concat(F.array(F.lit(False)), "f").alias("b"))
    equal = F.transform(F.filter(either, lambda z: z["f"] | z["b"]), lambda z: z["i"])
    rows = rows.withColumn("r", F.when(F.col("s").isNotNull(), equal))
    covered = F.size(F.array_distinct(F.flatten(F.transform("r", lambda i: F.array(i, i + 1, i + 2)))))
    n_lines = F.size("lines")
    rows = rows.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("r").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        "n_exclamations",
        "n_capitals",
        n_lines.alias("n_lines"),
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_repeat_words", "n_words").alias("repeated_share"),
        share("n_dup_lines", "n_lines").alias("equal_line_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_exclamations", "n_words").alias("exclamations_per_word"),
        share("word_chars", "n_words").alias("word_length"),
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term; 1 without summing where k exceeds the mean n*p."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("term"), F.lit(0.0).alias("total"))
    step = lambda acc, j: F.struct(
        (acc["term"] + F.log((n - j).cast("double") / (j + 1)) + F.lit(odds)).alias("term"),
        (acc["total"] + F.exp(acc["term"])).alias("total"),
    )
    summed = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda acc: acc["total"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(summed)


def certify(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, grid: dict = GRID) -> DataFrame:
    """stratum, rule, cutoff of every rule that a stratum may use, with the counts it was certified by."""
    judged = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("quality") > 0).alias("good"))
    )
    held = rows.where(~F.col("base_failed")).join(judged, "doc_id")
    # How many cutoffs of its grid, strict ones first, each value exceeds.
    exceeded = [
        F.struct(
            F.lit(rule).alias("rule"),
            sum(((F.col(rule) > c).cast("int") for c in cutoffs), F.lit(0)).alias("exceeds"),
        )
        for rule, cutoffs in grid.items()
    ]
    counts = (
        held.select("stratum", "good", F.inline(F.array(*exceeded)))
        .groupBy("stratum", "rule", "exceeds")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    spark = rows.sparkSession
    steps = [(rule, i + 1, float(c)) for rule, cutoffs in grid.items() for i, c in enumerate(cutoffs)]
    candidates = spark.createDataFrame(steps, "rule string, step int, cutoff double")
    beyond = F.col("exceeds") >= F.col("step")
    tested = (
        counts.join(candidates, "rule")
        .groupBy("stratum", "rule", "cutoff")
        .agg(
            F.sum("good").alias("n_good"),
            F.sum(F.when(beyond, F.col("good")).otherwise(0)).alias("good_rejected"),
            F.sum(F.when(beyond, F.col("bad")).otherwise(0)).alias("bad_rejected"),
        )
    )
    strata = counts.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    share = risk / len(grid)
    p_value = binomial_cdf(F.col("good_rejected"), F.col("n_good"), share)
    tested = tested.join(F.broadcast(strata))  # one row
    certified = tested.where(p_value <= F.lit(error) / (F.col("strata") * len(steps)))
    gain = F.col("bad_rejected") - F.col("good_rejected")
    best = F.max_by(F.struct("cutoff", "n_good", "good_rejected", "bad_rejected"), F.struct(gain, "cutoff"))
    return certified.where(gain > 0).groupBy("stratum", "rule").agg(best.alias("best")).select("stratum", "rule", "best.*")


def apply_rules(rows: DataFrame, cutoffs: DataFrame, grid: dict = GRID) -> DataFrame:
    """``rows`` with ``rules_broken`` (rules whose cutoff the row exceeds) and ``kept``."""
    by_stratum = cutoffs.groupBy(F.col("stratum").alias("of")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits")
    )  # at most one entry a rule
    limits = rows.join(by_stratum, F.col("stratum").eqNullSafe(F.col("of")), "left")
    broken = F.array_compact(
        F.array(*[F.when(F.col(rule) > F.try_element_at("limits", F.lit(rule)), F.lit(rule)) for rule in grid])
    )
    return limits.withColumn("rules_broken", broken).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rules_broken") == 0)
    ).drop("of", "limits")


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per document: its measures, ``base_failed``, ``rules_broken`` and ``kept``."""
    rows = materialize(measures(docs, stratum), "quality")
    return apply_rules(rows, certify(rows, labels, risk, error))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    grid = ", ".join(f"('{rule}', {float(c)})" for rule, cutoffs in GRID.items() for c in cutoffs)
    values = " UNION ALL ".join(f"SELECT doc_id, stratum, good, '{rule}' AS rule, {rule} AS v FROM held" for rule in GRID)
    broken = " OR ".join(
        f"coalesce({rule} > (SELECT cutoff FROM best b WHERE b.rule = '{rule}' AND b.stratum IS NOT DISTINCT FROM m.stratum), false)"
        for rule in GRID
    )
    a = RISK / len(GRID)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x : regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
triples AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM triples) WHERE n > 1),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM twice) GROUP BY rid),
c AS (SELECT w.rid, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(again.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '!')) AS ex, len(regexp_extract_all(t, '\\p{{Lu}}')) AS up, len(l) AS nl
  FROM w LEFT JOIN again ON w.rid = again.rid),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeated_share,
  coalesce(n_dup_lines / nullif(nl, 0), 0) AS equal_line_share, coalesce(up / nullif(word_chars, 0), 0) AS capital_share,
  coalesce(ex / nullif(n_words, 0), 0) AS exclamations_per_word, coalesce(word_chars / nullif(n_words, 0), 0) AS word_length FROM c),
j AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT m.*, j.good FROM m JOIN j ON m.doc_id = j.doc_id WHERE NOT base_failed),
v AS ({values}),
g(rule, cutoff) AS (VALUES {grid}),
tested AS (SELECT v.stratum, v.rule, g.cutoff, count_if(good) AS n, count_if(good AND v > cutoff) AS k, count_if(NOT good AND v > cutoff) AS bad
  FROM v JOIN g ON v.rule = g.rule GROUP BY ALL),
p AS (SELECT *, CASE WHEN k > n * {a!r} THEN 1.0 ELSE list_sum(list_transform(range(0, (k + 1)::BIGINT), lambda i :
  exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a!r}) + (n - i) * ln(1 - {a!r})))) END AS p FROM tested),
best AS (SELECT stratum, rule, arg_max(cutoff, (bad - k) * 1000 + cutoff) AS cutoff FROM p
  WHERE bad > k AND p <= {ERROR!r} / ((SELECT count(*) FROM (SELECT DISTINCT stratum FROM held)) * {sum(map(len, GRID.values()))}) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({broken}) AS kept FROM m"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE = {"op1_quality_rules": _sql()}
