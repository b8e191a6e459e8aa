"""Selection and mapping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.operators import selection as S
from florilege.session import table


def _rows(spark, d):
    return table(spark, d, "plant_compounds")


def compound_priorities(spark, d):
    return S.compound_priorities(_rows(spark, d))


def coverage_selection(spark, d):
    return S.coverage_first(_rows(spark, d), "species", 250)


def spaced_species(spark, d):
    rows = table(spark, d, "plant_metadata").select("metadata_id", F.coalesce("family", F.lit("none")).alias("family"))
    return S.spaced_pick(rows, "family", "metadata_id", 3)


def query_map(spark, d):
    return S.query_map(_rows(spark, d))


def record_identity(spark, d):
    rows = _rows(spark, d)
    exact = rows.filter("confidence = 'high'").select("source_database", F.col("source_record_id").alias("record_id"), "inchikey")
    loose = rows.filter("method_group = 'NMR'").select(F.lit(None).cast("string").alias("source_database"), F.col("source_record_id").alias("record_id"), "inchikey")
    return S.record_identity(rows, exact.unionByName(loose))


def merged_accounts(spark, d):
    meta = table(spark, d, "plant_metadata")
    make = lambda k: meta.select(F.col("metadata_id").alias("plant_id"), F.lit("S").alias("source"), F.when(F.col("metadata_id") % k == 0, "records").when(F.col("metadata_id") % k == 1, "fallback_only").otherwise("no_records").alias("status"), F.lit(k).alias("n_direct"), F.lit(0).alias("n_fallback"))
    return S.merge_accounts([make(2), make(3), make(5)])


QUERIES = {f.__name__: f for f in (compound_priorities, coverage_selection, spaced_species, query_map, record_identity, merged_accounts)}

from florilege.queries.evidence import non  # noqa: E402

_PRI = f"pr AS (SELECT compound_id, count(*) FILTER (coalesce(contains(lower(trim(evidence_tier)), 'direct'), false)) AS n_direct, count(DISTINCT {non('species')}) AS n_species, count(DISTINCT nullif(lower(trim(source_database)), '')) AS n_sources, count(*) AS n_records FROM plant_compounds WHERE {non('compound_id')} IS NOT NULL GROUP BY 1)"
_ORDER = "n_direct DESC, n_species DESC, n_sources DESC, n_records DESC, compound_id"
_NAME = "nullif(lower(regexp_replace(compound_name, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), '')"
_SEL = f"coalesce('cid:' || cid, 'inchikey:' || upper({non('inchikey')}), 'name:' || {_NAME})"
_STATUS = "CASE WHEN coalesce(k1, k2) > 1 THEN 'conflict' WHEN k1 IS NOT NULL THEN 'exact' WHEN k2 IS NOT NULL THEN 'any_source' ELSE 'none' END"
ORACLES = {
    "compound_priorities": f"WITH {_PRI} SELECT * FROM pr",
    "coverage_selection": f"WITH {_PRI}, m AS (SELECT DISTINCT species, compound_id FROM plant_compounds WHERE {non('species')} IS NOT NULL), cv AS (SELECT DISTINCT compound_id FROM (SELECT species, compound_id FROM m JOIN pr USING (compound_id) QUALIFY row_number() OVER (PARTITION BY species ORDER BY {_ORDER}) = 1)) SELECT pr.*, pr.compound_id IN (SELECT compound_id FROM cv) AS covers FROM pr ORDER BY covers DESC, {_ORDER} LIMIT 250",
    "spaced_species": "WITH n AS (SELECT metadata_id, coalesce(family, 'none') AS family, count(*) OVER (PARTITION BY coalesce(family, 'none')) AS n, row_number() OVER (PARTITION BY coalesce(family, 'none') ORDER BY metadata_id) - 1 AS p FROM plant_metadata) SELECT metadata_id, family FROM n WHERE p = 0 OR floor(p * 3 / n) <> floor((p - 1) * 3 / n)",
    "query_map": f"WITH c AS (SELECT {_NAME} AS name, {_SEL} AS selector, count(*) AS n_rows FROM plant_compounds WHERE {_NAME} IS NOT NULL GROUP BY 1, 2) SELECT name, selector, n_rows, count(*) OVER (PARTITION BY name) = 1 AS eligible FROM c",
    "record_identity": f"WITH e AS (SELECT nullif(lower(trim(source_database)), '') AS db, source_record_id, count(DISTINCT inchikey) AS k1, min(inchikey) AS v1 FROM plant_compounds WHERE confidence = 'high' AND source_record_id IS NOT NULL GROUP BY 1, 2), l AS (SELECT source_record_id, count(DISTINCT inchikey) AS k2, min(inchikey) AS v2 FROM plant_compounds WHERE method_group = 'NMR' AND source_record_id IS NOT NULL GROUP BY 1) SELECT occurrence_id, {_STATUS} AS identity_status, CASE WHEN {_STATUS} IN ('exact', 'any_source') THEN coalesce(v1, v2) END AS identity FROM plant_compounds p LEFT JOIN e ON e.db = nullif(lower(trim(p.source_database)), '') AND e.source_record_id = p.source_record_id LEFT JOIN l ON l.source_record_id = p.source_record_id",
    "merged_accounts": "WITH a AS (SELECT metadata_id AS plant_id, k, CASE WHEN metadata_id % k = 0 THEN 0 WHEN metadata_id % k = 1 THEN 1 ELSE 2 END AS r FROM plant_metadata, (VALUES (2), (3), (5)) v(k)) SELECT plant_id, 'S' AS source, ['records', 'fallback_only', 'no_records'][r + 1] AS status, k AS n_direct, 0 AS n_fallback FROM a QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY r, k DESC) = 1",
}
