"""Intake, context and comparability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions import rules
from florilege.operators import context as C
from florilege.session import table

STATUSES = ("reported", "inferred")


def _rows(spark, d):
    return table(spark, d, "plant_compounds")


def context_groups(spark, d):
    return _rows(spark, d).select("occurrence_id", C.plant_part(F.concat_ws(" ", "plant_part_group", "tissue_group")).alias("part"), C.method(F.col("method_group")).alias("method"))


def clean_names(spark, d):
    return table(spark, d, "standard_data").select("peak_id", C.clean_compound(F.col("compound_name")).alias("name_key"))


def comparability(spark, d):
    scope, group, comparable = C.comparability(F.col("comparison_subgroup"), F.col("comparison_group"), F.col("compound_name_clean"), F.col("method_group") == "GC-MS")
    return _rows(spark, d).select("occurrence_id", scope.alias("scope"), group.alias("comparison"), comparable.alias("comparable"))


def comparison_dictionary(spark, d):
    return C.comparison_dictionary(spark)


def _intake(spark, d):
    return C.standardize_intake(_rows(spark, d).select("species", "compound_name", "source_database", "source_record_id", "evidence_tier", "confidence", F.col("plant_part_group").alias("plant_part"), F.col("method_group").alias("method")))


def intake(spark, d):
    return _intake(spark, d)


def intake_filtered(spark, d):
    return C.filter_evidence(_intake(spark, d), min_confidence="medium").select("species_key", "compound_key", "source", "source_record_id")


def text_context(spark, d):
    return C.text_context(table(spark, d, "documents"), "doc_id", "text", "species")


def context_audit(spark, d):
    return C.context_audit(_rows(spark, d), "source_database")


def level_features(spark, d):
    return C.level_features(_rows(spark, d), "plant_part_group", ["comparison_scope", "method_group"])


def level_features_confidence(spark, d):
    return C.level_features(_rows(spark, d), "plant_part_group", ["comparison_scope", "method_group"], "confidence")


def comparable_features(spark, d):
    return C.comparable_features(_rows(spark, d), "species", "specialized_metabolites", ("leaf", "root"))


def similarity_input(spark, d):
    return C.prepare_similarity_input(_rows(spark, d), "species", STATUSES)


def metadata_counts(spark, d):
    return C.join_metadata(table(spark, d, "plant_metadata").select("metadata_id", "species"), _rows(spark, d), "species")


def qa_report(spark, d):
    return C.qa_report(table(spark, d, "plant_list"), _rows(spark, d))


def exploded_aliases(spark, d):
    return C.explode_taxa(table(spark, d, "chemical_library").select("library_id", "also_called"), "also_called", "alias").select("library_id", "alias")


def pathway_groups(spark, d):
    return _rows(spark, d).select("occurrence_id", rules.pathway_group(F.concat_ws(" ", F.regexp_replace("comparison_group", "_", " "), F.regexp_replace("comparison_subgroup", "_", " "))).alias("pathway_group"), rules.enzyme_class(F.concat((F.col("occurrence_id") % 9).cast("string"), F.lit(".1.1.1"))).alias("enzyme_class"))


def candidate_scores(spark, d):
    rows = _rows(spark, d).filter("species is not null")
    share = lambda c: F.avg(c.cast("int").cast("double"))
    summary = rows.groupBy("species").agg(
        share(F.coalesce(F.col("matched_rank") == "species", F.lit(False))).alias("direct_species"), share(F.col("inchikey").isNotNull()).alias("resolved_compounds"), (F.countDistinct("source_database") / F.lit(30.0)).alias("source_coverage"),
        share(F.coalesce(F.col("citation_or_url").contains("/doc/"), F.lit(False))).alias("literature"), share(F.col("tissue_group").isNotNull()).alias("traits"),
    )
    return C.candidate_scores(summary).select("species", F.round("score", 3).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        context_groups, clean_names, comparability, comparison_dictionary, intake, intake_filtered, text_context, context_audit, level_features, level_features_confidence, comparable_features, similarity_input,
        metadata_counts, qa_report, exploded_aliases, pathway_groups, candidate_scores,
    )
}

from florilege.functions.text import GREEK  # noqa: E402
from florilege.queries.evidence import _SLUG, known, non  # noqa: E402
from florilege.queries.problems import words_sql  # noqa: E402


def _first(column: str, rules_: tuple, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{v}'" for p, v in rules_) + f" ELSE {other} END"


def _clean(column: str) -> str:
    s = f"lower(trim(regexp_replace({column}, '[\\s\\pZ]+', ' ', 'g')))"
    for letter, name in GREEK.items():
        s = f"replace({s}, '{letter}', '{name}')"
    return f"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace({s}, '^\\(\\+\\)', 'plus '), '^\\(-\\)', 'minus '), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"


_PART = f"CASE WHEN {non('{0}')} IS NULL THEN 'unknown' ELSE " + _first("{0}", C.PART_RULES, "'other'") + " END"
_METHOD = f"CASE WHEN {non('{0}')} IS NULL THEN 'unknown' ELSE " + _first("{0}", C.METHOD_RULES, "'other'") + " END"
_CONF = "CASE lower(trim(confidence)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_SPECIAL = "fam IN (" + ", ".join(f"'{x}'" for x in C.SPECIALIZED) + ")"
_SCOPE = "CASE WHEN fam IN ('carbohydrate', 'amino_acid', 'organic_acid', 'nucleoside_nucleotide') THEN 'primary_metabolites' WHEN fam = 'fatty_acid_lipid' THEN 'lipids_fatty_acids' WHEN fam = 'plant_hormone_signal' THEN 'plant_hormone_signaling' WHEN (" + _SPECIAL + " AND vol) OR fam = 'volatile' THEN 'volatile_specialized_metabolites' WHEN " + _SPECIAL + " THEN 'specialized_metabolites' ELSE 'unknown' END"
_INTAKE = f"""WITH r AS (SELECT {words_sql("species")} AS species_key, {_clean("compound_name")} AS compound_key, upper(trim(regexp_replace(source_database, '[\\s\\pZ]+', ' ', 'g'))) AS source, source_record_id, lower(trim(evidence_tier)) AS t, {_PART.format("plant_part_group")} AS p, {_METHOD.format("method_group")} AS m, {_CONF} AS c FROM plant_compounds),
g AS (SELECT species_key, compound_key, source, source_record_id, count(*) AS n_rows, string_agg(DISTINCT nullif(p, 'unknown'), '; ' ORDER BY nullif(p, 'unknown')) AS plant_parts, string_agg(DISTINCT nullif(m, 'unknown'), '; ' ORDER BY nullif(m, 'unknown')) AS methods,
  bool_or(coalesce(regexp_matches(t, 'manual|curated'), false)) AS cu, bool_or(coalesce(contains(t, 'direct'), false)) AS di, bool_or(coalesce(contains(t, 'candidate'), false)) AS ca, max(c) AS c FROM r GROUP BY 1, 2, 3, 4),
i AS (SELECT species_key, compound_key, source, source_record_id, n_rows, plant_parts, methods, CASE c WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS confidence, c, CASE WHEN cu THEN 'curated_reported' WHEN di AND NOT ca THEN 'direct_reported' WHEN ca THEN 'candidate' ELSE 'taxon_fallback' END AS occurrence_status FROM g),
o AS (SELECT *, CASE WHEN occurrence_status IN ('curated_reported', 'direct_reported') AND species_key <> '' AND compound_key IS NOT NULL THEN 'Yes' ELSE 'No' END AS analysis_ready,
  round(0.4::DOUBLE * (occurrence_status IN ('curated_reported', 'direct_reported'))::INT + 0.2::DOUBLE * (plant_parts IS NOT NULL)::INT + 0.2::DOUBLE * (methods IS NOT NULL)::INT + 0.2::DOUBLE * (c >= 2)::INT, 2) AS quality_score FROM i)
"""
_VALID = "coalesce(regexp_full_match(upper(trim(inchikey)), '[A-Z]{14}-[A-Z]{10}-[A-Z]'), false)"
_STRUCT = f"CASE WHEN {_VALID} THEN regexp_replace(upper(trim(inchikey)), '[^A-Za-z0-9]+', '_', 'g') WHEN cid > 0 THEN 'cid_' || cid END"
_WHY = f"concat_ws('; ', CASE WHEN NOT coalesce(lower(trim(occurrence_status)) IN ('reported', 'inferred'), false) THEN 'occurrence_status_not_allowed' END, CASE WHEN {_CONF} < 2 THEN 'below_minimum_confidence' END, CASE WHEN {non('species')} IS NULL THEN 'missing_group_value' END, CASE WHEN {_STRUCT} IS NULL THEN 'missing_valid_inchikey_or_cid' END, CASE WHEN coalesce(contains(lower(curation_flag), 'review'), false) THEN 'identity_review_required' END)"


def _level(value: str) -> str:
    part = lambda f: f"SELECT plant_part_group, compound_id, {_CONF} AS c, '{f}__' || {_SLUG.format(f)} AS feature FROM plant_compounds WHERE {known('plant_part_group')} AND {non('compound_id')} IS NOT NULL AND {known(f)}"
    return f"SELECT plant_part_group, feature, {value} AS value FROM ({part('comparison_scope')} UNION ALL {part('method_group')}) GROUP BY 1, 2"


_QA = f"WITH p AS (SELECT {words_sql('species')} AS k, bool_or(coalesce({known('compound_id')} AND lower(matched_rank) = 'species', false)) AS ready, bool_or({known('plant_part_group')}) AS ctx FROM plant_compounds GROUP BY 1), m AS (SELECT * FROM (SELECT DISTINCT {words_sql('species')} AS k FROM plant_list) LEFT JOIN p USING (k)), c AS (SELECT 'species_with_records' AS \"check\", round(avg((ready IS NOT NULL)::INT), 4) AS value, 0.5::DOUBLE AS least FROM m UNION ALL SELECT 'analysis_ready', round(avg(coalesce(ready, false)::INT), 4), 0.25 FROM m UNION ALL SELECT 'context', round(avg(coalesce(ctx, false)::INT), 4), 0.25 FROM m UNION ALL SELECT 'resolved', round(avg(({known('inchikey')} OR {known('cid')})::INT), 4), 0.5 FROM plant_compounds)"
_DICT = [f"('primary_metabolites', '{f}', '{f}', 'primary_metabolism', 'nonvolatile_or_unspecified', 'Yes')" for f in C.PRIMARY]

_DICT += [f"('specialized_metabolites', '{f}', '{f}', 'specialized_metabolism', 'nonvolatile_or_unspecified', 'Yes'), ('volatile_specialized_metabolites', 'volatile_{f}', '{f}', 'specialized_metabolism', 'volatile_semivolatile', 'Yes')" for f in C.SPECIALIZED]
_DICT += ["('lipids_fatty_acids', 'fatty_acid_lipid', 'fatty_acid_lipid', 'lipid_metabolism', 'nonvolatile_or_unspecified', 'Yes')", "('plant_hormone_signaling', 'plant_hormone_signal', 'plant_hormone_signal', 'plant_hormone_signaling', 'nonvolatile_or_unspecified', 'Yes')", "('broad_or_uncertain', 'broad_or_uncertain', 'broad_or_uncertain', 'broad_or_uncertain', 'nonvolatile_or_unspecified', 'No')", "('xenobiotic_or_contaminant', 'unknown', 'unknown', 'xenobiotic_or_contaminant', 'unknown', 'No')", "('unknown', 'unknown', 'unknown', 'unknown', 'unknown', 'No')"]

ORACLES = {
    "comparison_dictionary": "SELECT * FROM (VALUES " + ", ".join(_DICT) + ") v(comparison_scope, comparison_group, biosynthetic_family, metabolism_domain, chemical_behavior, comparable_for_matrix)",
    "text_context": f"""WITH s AS (SELECT doc_id, lower(trim(regexp_replace(species, '[\\s\\pZ]+', ' ', 'g'))) AS sp, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM documents WHERE text IS NOT NULL AND {non("species")} IS NOT NULL),
e AS (SELECT doc_id, sp, unnest(ss) AS t, (generate_subscripts(ss, 1) - 1)::INT AS sentence_no FROM s), n AS (SELECT * FROM e WHERE contains(lower(t), sp))
SELECT * FROM (SELECT doc_id, sentence_no, 'plant_part' AS kind, {_first("t", C.PART_RULES)} AS value FROM n UNION ALL SELECT doc_id, sentence_no, 'method', {_first("t", C.METHOD_RULES)} FROM n) WHERE value IS NOT NULL""",
    "candidate_scores": "SELECT species, round(round(0.25::DOUBLE * avg(coalesce(matched_rank = 'species', false)::INT) + 0.2::DOUBLE * avg((inchikey IS NOT NULL)::INT) + 0.2::DOUBLE * (count(DISTINCT source_database) / 30.0::DOUBLE) + 0.15::DOUBLE * avg(coalesce(contains(citation_or_url, '/doc/'), false)::INT) + 0.2::DOUBLE * avg((tissue_group IS NOT NULL)::INT), 4), 3) AS score FROM plant_compounds WHERE species IS NOT NULL GROUP BY species",
    "context_groups": f"SELECT occurrence_id, {_PART.format('x')} AS part, {_METHOD.format('method_group')} AS method FROM (SELECT *, concat_ws(' ', plant_part_group, tissue_group) AS x FROM plant_compounds)",
    "clean_names": f"SELECT peak_id, {_clean('compound_name')} AS name_key FROM standard_data",
    "comparability": f"WITH f AS (SELECT occurrence_id, coalesce({_first('comparison_subgroup', C.FAMILY_RULES)}, {_first('comparison_group', C.FAMILY_RULES)}, {_first('compound_name_clean', C.FAMILY_RULES)}) AS fam, coalesce(method_group = 'GC-MS', false) AS vol FROM plant_compounds) SELECT occurrence_id, {_SCOPE} AS scope, CASE WHEN {_SCOPE} = 'unknown' THEN 'unknown' WHEN {_SPECIAL} AND vol THEN 'volatile_' || fam ELSE fam END AS comparison, CASE WHEN {_SCOPE} = 'unknown' THEN 'No' ELSE 'Yes' END AS comparable FROM f",
    "intake": _INTAKE + "SELECT * EXCLUDE (c) FROM o",
    "intake_filtered": _INTAKE + "SELECT species_key, compound_key, source, source_record_id FROM o WHERE occurrence_status IN ('curated_reported', 'direct_reported') AND analysis_ready = 'Yes' AND c >= 2",
    "context_audit": "SELECT upper(trim(source_database)) AS provider, count(*) AS n_rows, " + ", ".join(f"count(*) FILTER ({known(c)}) AS n_{c}" for c in ("plant_part_group", "tissue_group", "method_group")) + " FROM plant_compounds GROUP BY 1",
    "level_features": _level("count(DISTINCT compound_id)::DOUBLE"),
    "level_features_confidence": _level("round(max(CASE c WHEN 3 THEN 0.9::DOUBLE WHEN 2 THEN 0.65 WHEN 1 THEN 0.35 ELSE 0 END), 2)"),
    "comparable_features": f"SELECT species, 'comparison_group__specialized_metabolites__' || lower(regexp_replace(comparison_group, '[^A-Za-z0-9]+', '_', 'g')) AS feature, count(DISTINCT compound_id)::DOUBLE AS value FROM plant_compounds WHERE lower(trim(comparable_for_matrix)) IN ('true', 't', 'yes', 'y', '1', 'present', 'high', 'medium') AND comparison_scope = 'specialized_metabolites' AND {known('comparison_group')} AND {known('species')} AND plant_part_group IN ('leaf', 'root') GROUP BY 1, 2",
    "similarity_input": f"SELECT occurrence_id, species, {_STRUCT} AS structure_id, {_WHY} = '' AS eligible, nullif({_WHY}, '') AS exclusion_reason FROM plant_compounds",
    "metadata_counts": f"WITH c AS (SELECT {words_sql('species')} AS k, count(*) AS n_records, count(DISTINCT {non('compound_id')}) AS n_compounds FROM plant_compounds WHERE {non('species')} IS NOT NULL GROUP BY 1) SELECT metadata_id, species, coalesce(n_records, 0) AS n_records, coalesce(n_compounds, 0) AS n_compounds FROM plant_metadata m LEFT JOIN c ON c.k = {words_sql('m.species')}",
    "qa_report": _QA + " SELECT *, CASE WHEN value >= least THEN 'pass' ELSE 'warn' END AS status FROM c",
    "exploded_aliases": "SELECT library_id, trim(a) AS alias FROM (SELECT library_id, unnest(string_split(also_called, ';')) AS a FROM chemical_library) WHERE trim(a) <> ''",
    "pathway_groups": f"SELECT occurrence_id, {_first('x', rules.PATHWAY_RULES, chr(39) + 'Other KEGG pathway' + chr(39))} AS pathway_group, CASE occurrence_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in rules.EC_CLASSES.items()) + " END AS enzyme_class FROM (SELECT *, replace(comparison_group, '_', ' ') || ' ' || replace(comparison_subgroup, '_', ' ') AS x FROM plant_compounds)",
}
