"""Make the scalar functions available to SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from bookstrata.functions.levels import _mix64

# SQL bodies of the functions people call from SQL; Catalyst inlines them, so they stay in codegen.
_SQL_FUNCTIONS = {
    "parse_price_e4": (
        "(t STRING) RETURNS INT RETURN CASE WHEN regexp_like(t, "
        "'^-?[0-9]+([.][0-9]{1,4}0*)?$') AND NOT endswith(t, '\\n') AND "
        "try_cast(t AS DECIMAL(38,18)) BETWEEN 0 AND 1 "
        "THEN CAST(try_cast(t AS DECIMAL(38,18)) * 10000 AS INT) END"
    ),
    "format_price_e4": (
        "(p BIGINT) RETURNS STRING RETURN concat(if(p < 0, '-', ''), "
        "CAST(abs(p) div 10000 AS STRING), '.', lpad(CAST(abs(p) % 10000 AS STRING), 4, '0'))"
    ),
    "format_count_e2": (
        "(c BIGINT) RETURNS STRING RETURN concat(if(c < 0, '-', ''), "
        "CAST(abs(c) div 100 AS STRING), '.', lpad(CAST(abs(c) % 100 AS STRING), 2, '0'))"
    ),
    "complement_e4": "(p INT) RETURNS INT RETURN 10000 - p",
    "notional_e6": "(p BIGINT, c BIGINT) RETURNS BIGINT RETURN p * c",
    "series_of": "(t STRING) RETURNS STRING RETURN substring_index(t, '-', 1)",
    "hour_label": (
        "(ns BIGINT) RETURNS STRING RETURN concat(CAST(date_add(DATE'1970-01-01', "
        "CAST((ns - pmod(ns, 86400000000000)) div 86400000000000 AS INT)) AS STRING), 'T', "
        "lpad(CAST(pmod(ns, 86400000000000) div 3600000000000 AS STRING), 2, '0'))"
    ),
}


def register(spark: SparkSession) -> None:
    """Publish the scalar functions as temporary SQL functions of the session."""
    for name, body in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("level_mix64", _mix64)
