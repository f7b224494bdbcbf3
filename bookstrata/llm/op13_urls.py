"""URL filters: rules by host and path, and for all other URLs a logistic regression on hashed character n-grams.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path
what then follows up to ``?``, ``#`` or the end. A rule holds for its host and all subdomains where the path begins
with the rule's; of several the longest decides, the host's length first.

The model sees the sets of character n-grams of the host and, apart from them, of the path, each between marks for
its ends, hashed to ``FEATURES`` places. It learns from a small labelled table: at most ``SAMPLE`` distinct URLs of each
verdict, those of least hash. Without a table of its own the query takes URLs that a rule decides, labelled by it.
``score`` is the probability of ``block``, and 0.5 or more blocks.

Scale. Rules are met once for each distinct host, by joins on its suffixes, so any number of rules will do; hosts that
meet some are joined back, a hot host being many rows on one side of a join, which adaptive execution splits. All other
work is row by row. The sample is bounded, so training costs the same at any size.

Defined results: a null URL, or one without ``://``, has an empty host and path, which no rule fits and the model
judges as it stands. Rules with a null or empty host never fit, a null path counts as empty, of equal rules ``allow``
wins. If only one verdict is labelled, all URLs get it (score 0 or 1); if none is, all are allowed. Rows are judged one
by one, so repeated rows stay; only page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookstrata.llm.common import table
from bookstrata.session import materialize, ship

GRAMS = (3, 4, 5)
FEATURES = 1 << 16
SAMPLE = 2_000
REGULAR = 1e-3
ITERATIONS = 60

# The rules of the contract (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    # The dot does not matter here: only the three ends do, and line breaks are like other characters.
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host and path) and the struct ``fit``: host, path, verdict of the longest rule that fits."""
    rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    # a.b.c, b.c and c: each suffix begins at a label. No rule has more labels than the deepest one.
    deepest = rules.agg(F.max(F.size(labels))).first()[0] or 0
    last = F.slice(labels, -F.least(F.size(labels), F.lit(deepest)), F.size(labels))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, F.size(last)), "."))
    hosts = urls.select("host").where("host <> ''").where(F.lit(deepest > 0)).distinct()
    met = hosts.select("host", F.explode(suffixes).alias("suffix")).join(rules.withColumnRenamed("host", "suffix"), "suffix")
    met = met.groupBy("host").agg(F.collect_list(F.struct(F.length("suffix").alias("length"), F.length("path").alias("depth"), F.col("suffix").alias("host"), "path", "verdict")).alias("rules"))
    rows = urls.join(met, "host", "left")
    fitting = F.filter("rules", lambda r: F.startswith("path", r["path"]))
    # Of two suffixes of one host, or two beginnings of one path, the longer differs from the shorter by its length.
    return rows.withColumn("fit", F.array_max(fitting)).drop("rules")


def _marker(part: str) -> Callable[[Column], Column]:
    return lambda gram: F.concat(F.lit(f"{part} "), gram)


def with_grams(urls: DataFrame, sizes: tuple[int, ...] = GRAMS) -> DataFrame:
    """``urls`` (with host and path) and the array ``grams``."""
    for part in ("host", "path"):
        own = F.when(F.col(part) != "", F.split(part, "")).otherwise(F.array().cast("array<string>"))
        ends = F.concat(F.array(F.lit("^")), own, F.array(F.lit("$")))
        urls = urls.withColumn(f"_{part}", ends)
        for n in sizes:
            urls = NGram(n=n, inputCol=f"_{part}", outputCol=f"_{part}{n}").transform(urls)
    marked = [F.transform(f"_{part}{n}", _marker(part)) for part in ("host", "path") for n in sizes]
    rows = urls.withColumn("grams", F.concat(*marked))
    return rows.drop("_host", "_path", *[f"_{part}{n}" for part in ("host", "path") for n in sizes])


@dataclass
class UrlModel:
    """A fitted regression, or the one score that all URLs get."""

    fitted: LogisticRegressionModel | None
    fixed: float

    def judge(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with host and path) and ``score``, the probability of block."""
        if self.fitted is None:
            return urls.withColumn("score", F.lit(self.fixed))
        rows = _features(with_grams(urls))
        rows = self.fitted.transform(rows)
        return rows.withColumn("score", vector_to_array("_probability")[1]).drop("grams", "_features", "_raw", "_probability", "_class")


def _features(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="_features").transform(rows)


def train(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """labelled: host, path, verdict (allow or block; other rows are left out). Distinct URLs are learned once."""
    rows = labelled.where(F.col("verdict").isin("allow", "block")).groupBy("host", "path", "verdict").agg(F.lit(1).alias("one"))
    first = Window.partitionBy("verdict").orderBy(F.xxhash64("host", "path"), "host", "path")
    rows = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample)
    # At most two samples: one partition in a fixed order, so that sums of doubles agree from run to run.
    chosen = materialize(rows.select("host", "path", "verdict"), "urls")
    kinds = {r[0] for r in chosen.select("verdict").distinct().collect()}
    if len(kinds) < 2:
        return UrlModel(None, 1.0 if kinds == {"block"} else 0.0)
    chosen = chosen.coalesce(1).sortWithinPartitions("host", "path", "verdict")
    chosen = _features(with_grams(chosen)).select("_features", (F.col("verdict") == "block").cast("double").alias("_label"))
    regression = LogisticRegression(
        featuresCol="_features", labelCol="_label", rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_class",
        regParam=REGULAR, maxIter=ITERATIONS, standardization=False,
    )
    return UrlModel(regression.fit(chosen), 0.0)


def judge_urls(pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of (page_id, url).

    labelled: url, verdict of a table to learn from; without it URLs decided by a rule are learned from.
    """
    ship(pages.sparkSession)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if labelled is None:
        known = with_rules(rows, rules).select("host", "path", F.col("fit.verdict").alias("verdict"))
    else:
        known = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "verdict")
    # Scores first: they are most of the work, and a join by host leaves a hot host's rows together.
    judged = with_rules(train(known, sample).judge(rows), rules)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.concat("fit.host", "fit.path").alias("rule"), verdict.alias("verdict"), "score")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


# A fitted regression is beyond SQL; tests compare rules, features, model and verdicts with plain versions.
QUERIES = {"op13_url_filter": op13_url_filter}
ORACLE: dict[str, str] = {}
