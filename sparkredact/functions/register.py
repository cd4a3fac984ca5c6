"""The scalar functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .python import edits_within, sound_code

#: SQL bodies, compiled into the query like any built-in; parameters by name.
SQL_FUNCTIONS = {
    "normalize_key(term STRING) RETURNS STRING": r"trim(regexp_replace(translate(regexp_replace(lower(term), '[''’]', ''), '-', ' '), '(?U)\\s+', ' '))",
    "passes_luhn(term STRING) RETURNS BOOLEAN": r"length(regexp_replace(term, '[^0-9]', '')) >= 13 AND luhn_check(regexp_replace(term, '[^0-9]', ''))",
    "f_beta(p DOUBLE, r DOUBLE, beta DOUBLE) RETURNS DOUBLE": "CASE WHEN p = 0 AND r = 0 THEN 0D ELSE (1 + beta * beta) * p * r / (beta * beta * p + r) END",
}


def register(spark: SparkSession) -> list[str]:
    """Register everything as temporary functions; the names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("sound_code", sound_code, T.StringType())
    spark.udf.register("edits_within", edits_within, T.IntegerType())
    return [*(h.split("(")[0] for h in SQL_FUNCTIONS), "sound_code", "edits_within"]
