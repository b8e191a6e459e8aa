"""Queries of the operators for training data, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.llm.canonical import match_rows, named_rows, unmatched_names
from florilege.llm.copies import COMPOUND_IGNORED, COMPOUND_WORDED, collapse_copies, copy_links
from florilege.llm.encoding import damaged_texts
from florilege.llm.leakage import MIN_RUN, find_leaks
from florilege.llm.mixing import mix_sources
from florilege.llm.survivors import CONFIDENCE_ORDER, TIER_ORDER, best_of_findings, golden_records
from florilege.queries.problems import words_sql
from florilege.session import table

_COMPOUND_COLUMNS = (
    "compound_id", "source_database", "source_record_id", "evidence_tier", "matched_rank", "occurrence_status", "confidence", "smiles", "inchikey", "cid", "molecular_formula",
    "comparison_scope", "comparison_group", "comparison_subgroup", "comparable_for_matrix", "plant_part_group", "tissue_group", "method_group", "citation_or_url", "curation_flag",
)


def p2_found(spark, d):
    return copy_links(table(spark, d, "plant_compounds"), "occurrence_id", COMPOUND_WORDED, COMPOUND_IGNORED)


def p2_collapsed(spark, d):
    return collapse_copies(table(spark, d, "plant_compounds"), "occurrence_id", COMPOUND_WORDED, COMPOUND_IGNORED)


def p5_found(spark, d):
    return best_of_findings(table(spark, d, "plant_compounds"), table(spark, d, "provider_sources"))


def p5_golden(spark, d):
    return golden_records(table(spark, d, "plant_compounds"), table(spark, d, "provider_sources"))


def p6_found(spark, d):
    return match_rows(named_rows(table(spark, d, "plant_compounds"), table(spark, d, "standard_data")), table(spark, d, "chemical_library"))


def p6_misses(spark, d):
    return unmatched_names(named_rows(table(spark, d, "plant_compounds"), table(spark, d, "standard_data")), table(spark, d, "chemical_library"))


def p7_found(spark, d):
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark, d):
    """Per leaked item, in how many documents it stands."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_mix(spark, d):
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark, d):
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark, d):
    return damaged_texts(table(spark, d, "documents")).select("doc_id")


def p9_restored(spark, d):
    return damaged_texts(table(spark, d, "documents"))


def p9_ways(spark, d):
    """How many documents each way of finding damage has found, and how many of them came out whole."""
    return damaged_texts(table(spark, d, "documents")).groupBy("found_by").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("fully_restored").alias("n_fully_restored"))


_KEYED = f"SELECT *, {words_sql('species')} AS sw, {words_sql('compound_name')} AS nw FROM plant_compounds"
_SAME = "sw, nw, " + ", ".join(_COMPOUND_COLUMNS)


def _place(column: str, order: tuple[str, ...]) -> str:
    return f"CASE lower(trim({column})) " + " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(order)) + f" ELSE {len(order) + 1} END"


_FINDINGS = f"""
WITH t AS (SELECT lower(trim(source_database)) AS p, min(trust_rank) AS trust FROM provider_sources WHERE trim(source_database) <> '' GROUP BY 1),
r AS (SELECT c.*, {words_sql("species")} AS sw, {_place("evidence_tier", TIER_ORDER)} AS tr, {_place("confidence", CONFIDENCE_ORDER)} AS cr, coalesce(trust, 2147483647) AS trust,
  CASE WHEN trim(compound_id) <> '' THEN 0 ELSE 1 END AS ir
  FROM plant_compounds c LEFT JOIN t ON lower(trim(c.source_database)) = t.p
  WHERE trim(inchikey) <> '' AND trim(citation_or_url) <> '' AND {words_sql("species")} <> '')
"""


def _golden(field: str, *ranks: str) -> str:
    return f"arg_min(trim({field}), ROW({', '.join(ranks)}, -coalesce(epoch_us(retrieved_at), -4611686018427387904), occurrence_id)) FILTER (trim({field}) <> '')"


QUERIES = {
    "p2_found": p2_found, "p2_collapsed": p2_collapsed, "p5_found": p5_found, "p5_golden": p5_golden, "p6_found": p6_found, "p6_misses": p6_misses,
    "p7_found": p7_found, "p7_items": p7_items, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_restored": p9_restored, "p9_ways": p9_ways,
}

_P7 = f"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items),
runs AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[k:k + {MIN_RUN - 1}], ' ') || ' ' AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - {MIN_RUN - 2})) AS k FROM iw WHERE len(w) >= {MIN_RUN})),
dw AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS t FROM documents),
found AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN runs ON contains(t, run))
"""

ORACLES = {
    "p2_found": f"SELECT first_id, copy_id FROM (SELECT min(occurrence_id) OVER (PARTITION BY {_SAME}) AS first_id, occurrence_id AS copy_id FROM ({_KEYED})) WHERE first_id <> copy_id",
    "p2_collapsed": f"SELECT p.*, n_copies FROM plant_compounds p JOIN (SELECT min(occurrence_id) AS occurrence_id, count(*) AS n_copies FROM ({_KEYED}) GROUP BY {_SAME}) USING (occurrence_id)",
    "p5_found": _FINDINGS
    + """SELECT first_id, keep_id FROM (SELECT occurrence_id AS keep_id, min(occurrence_id) OVER w AS first_id, count(*) OVER w AS n,
  row_number() OVER (PARTITION BY sw, inchikey, citation_or_url ORDER BY tr, cr, trust, ir, retrieved_at DESC NULLS LAST, occurrence_id) AS place
  FROM r WINDOW w AS (PARTITION BY sw, inchikey, citation_or_url)) WHERE n >= 2 AND place = 1""",
    "p5_golden": _FINDINGS
    + f"""SELECT min(occurrence_id) AS first_id, count(*) AS n_rows, lower({_golden("compound_id", "trust", "tr", "cr")}) AS compound_id,
  lower({_golden("evidence_tier", "tr", "trust")}) AS evidence_tier, lower({_golden("confidence", "cr", "tr", "trust")}) AS confidence,
  upper({_golden("source_database", "trust", "tr")}) AS source_database FROM r GROUP BY sw, inchikey, citation_or_url""",
    "p7_found": _P7 + "SELECT doc_id, item_id FROM found",
    "p7_items": _P7 + "SELECT item_id, count(*) AS n_documents FROM found GROUP BY item_id",
}
