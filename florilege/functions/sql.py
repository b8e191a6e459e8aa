"""The shared value rules as SQL functions of a session, scalar, table-valued and aggregate: Catalyst inlines them, so they run in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from florilege.functions.text import MISSING_WORDS

_MISSING = ", ".join(f"'{w}'" for w in ("", *MISSING_WORDS))
#: Name, parameters, result and body of each function.
FUNCTIONS = (
    ("fl_squish", "s STRING", "STRING", r"trim(regexp_replace(s, '[\\s\\pZ]+', ' '))"),
    ("fl_known", "s STRING", "BOOLEAN", rf"coalesce(lower(trim(regexp_replace(s, '[\\s\\pZ]+', ' '))) NOT IN ({_MISSING}), false)"),
    ("fl_words_key", "s STRING", "STRING", r"array_join(array_sort(filter(split(trim(regexp_replace(lower(coalesce(s, '')), '[^\\p{L}\\p{Nd}]+', ' ')), ' '), w -> w <> '')), ' ')"),
    ("fl_slug", "s STRING", "STRING", r"regexp_replace(regexp_replace(s, '[^A-Za-z0-9]+', '_'), '^_+|_+$', '')"),
    ("fl_confidence_rank", "s STRING", "INT", "CASE lower(trim(s)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"),
)
TABLE_FUNCTIONS = (("fl_terms", "s STRING", "term STRING", r"SELECT DISTINCT trim(t) FROM (SELECT explode(split(coalesce(s, ''), '[;|]')) AS t) WHERE trim(t) <> ''"),)


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session, replacing older ones; returns their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, parameters, result, body in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({result}) RETURN {body}")
    return [f[0] for f in (*FUNCTIONS, *TABLE_FUNCTIONS)]
