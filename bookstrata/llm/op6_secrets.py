"""Secret scans through a trigram inverted index [native].

From the parse tree of each rule's regular expression a Boolean query over trigrams is derived: an OR of
alternatives, each an AND of the trigrams of its mandatory literals. The index holds a posting (trigram,
document) for each trigram that some query names, over lower-cased texts. Intersecting the postings of an
alternative gives its candidate documents, and only candidates are scanned with the expression itself; a
rule with an alternative that has no mandatory trigram scans every text.

Matches of a rule are leftmost and do not overlap; those whose secret part is shorter than the rule's least
length are dropped after matching. Positions are code points.

Postings and candidates name a document by a hash of id and text, so copies of one text are spread. Equal
hashes of different documents only add a document to be scanned, never a match.

Defined results: a null text is empty and has no span; rows with equal ids are scanned each; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import re._constants as tokens
import re._parser as parser
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.llm.common import materialize, table, text_of


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: for Java's and Python's syntax alike; group: the secret; least: its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("live_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login_url", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@"),
)
RULES = BASE + MORE

_GAP = "\0"
_MOST = 256


def _skeletons(node: Iterable) -> list[str]:
    """What a parsed expression may match, as literals with gaps for all that isn't one character."""
    found = [""]
    for kind, value in node:
        if kind is tokens.LITERAL:
            parts = [chr(value)]
        elif kind is tokens.IN and all(k is tokens.LITERAL for k, _ in value):
            parts = [chr(v) for _, v in value]
        elif kind is tokens.SUBPATTERN:
            parts = _skeletons(value[-1])
        elif kind is tokens.BRANCH:
            parts = [s for branch in value[1] for s in _skeletons(branch)]
        elif kind in (tokens.MAX_REPEAT, tokens.MIN_REPEAT, tokens.POSSESSIVE_REPEAT):
            low, high, inner = value
            once = _skeletons(inner)
            if (low, high) == (0, 1):
                parts = ["", *once]
            elif low == high and low <= 8:
                parts = ["".join(p) for p in itertools.islice(itertools.product(once, repeat=low), _MOST + 1)]
            else:
                parts = [s + _GAP + s for s in once] if low else [_GAP]
        elif kind is tokens.AT:
            parts = [""]
        else:
            parts = [_GAP]
        if len(found) * len(parts) > _MOST:
            parts = [_GAP]
        found = [a + b for a in found for b in parts]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The alternatives of a pattern, each as the trigrams it demands; empty if some demands none."""
    alternatives = set()
    for skeleton in _skeletons(parser.parse(pattern)):
        runs = skeleton.lower().split(_GAP)
        alternatives.add(frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)))
    if frozenset() in alternatives:
        return []
    # An alternative that demands more than another adds nothing.
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The index: trigram, key for every document that holds the trigram."""
    low = docs.select(_key().alias("key"), F.lower(text_of()).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("key", F.explode(held).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """key, kinds: the rules some alternative of which has all its trigrams in the document."""
    clauses = [
        (kind, a, gram, 1 << i, (1 << len(alternative)) - 1)
        for kind, alternatives in queries.items()
        for a, alternative in enumerate(alternatives)
        for i, gram in enumerate(sorted(alternative))
    ]
    demands = index.sparkSession.createDataFrame(clauses, "kind string, alternative int, gram string, bit long, whole long")
    # Broadcast: one row for each trigram of each alternative of the rules.
    met = index.join(F.broadcast(demands), "gram").groupBy("key", "kind", "alternative", "whole").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = whole").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans of every document: an array of (start, rank of the rule, end), in this order."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for alternatives in queries.values() for a in alternatives for g in a})
    rows = docs.withColumn("key", _key())
    if grams:
        index = materialize(postings(docs, grams), "postings")
        found = candidates(index, {k: q for k, q in queries.items() if q})
        rows = rows.join(found.hint("shuffle_hash"), "key", "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    rows = rows.select("doc_id", text_of().alias("t"), F.coalesce("kinds", none).alias("kinds"))
    for r in rules:
        every = F.regexp_extract_all("t", F.lit(r.pattern), 0)
        if queries[r.kind]:
            every = F.when(F.array_contains("kinds", r.kind), every).otherwise(none)
        rows = rows.withColumn(f"m_{r.kind}", every)
    for r in rules:
        some = F.size(f"m_{r.kind}") > 0
        rows = rows.withColumn(f"p_{r.kind}", F.when(some, F.split("t", r.pattern, -1)))
        secret = F.regexp_extract_all("t", F.lit(r.pattern), r.group) if r.group else F.col(f"m_{r.kind}")
        rows = rows.withColumn(f"s_{r.kind}", F.when(some, secret))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    spans = []
    for rank, r in enumerate(rules):
        n = F.size(f"m_{r.kind}")
        # The pieces between matches; the one after the last is left out.
        zipped = F.arrays_zip(F.slice(f"p_{r.kind}", 1, n).alias("p"), F.col(f"m_{r.kind}").alias("m"), F.col(f"s_{r.kind}").alias("s"))
        begun = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
        walked = F.aggregate(zipped, begun, _step(rank, r.least), lambda acc: acc["out"])
        spans.append(F.coalesce(F.when(n > 0, walked), nothing))
    return rows.select("doc_id", F.sort_array(F.concat(*spans)).alias("spans"))


def _step(rank: int, least: int) -> Callable[[Column, Column], Column]:
    """Adds the span of a match, which follows its piece, if its secret is long enough."""

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["p"])
        end = start + F.length(z["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        out = F.when(F.length(z["s"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return step


def as_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def _of_rank(rank: int) -> Column:
    return F.filter("spans", lambda s: s["rank"] == rank)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [F.size(_of_rank(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    digest = F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, as_text(F.col("spans")).alias("spans"))


def _sql() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {rank} AS k, '{r.kind}' AS kind, m, p, s FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, "
            f"string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', {r.group}) AS s FROM d) WHERE len(m) > 0"
        )
    least = "[" + ", ".join(str(r.least) for r in RULES) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
q AS (SELECT rid, k, kind, list_sum(list_transform(p[1:i], lambda x : length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x : length(x))), 0) AS a,
  length(m[i]) AS n FROM i WHERE length(s[i]) >= {least}[k + 1]),
x AS (SELECT rid, k, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span, a FROM q),
g AS (SELECT rid, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (k < 3), '') AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM x GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.rid = g.rid"""


QUERIES = {"op6_secrets": op6_secrets}
ORACLE = {"op6_secrets": _sql()}
