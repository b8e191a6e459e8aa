"""Evidence, feature and summary queries over the occurrence records."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions.text import words_key
from florilege.operators import evidence as E
from florilege.session import table

SCOPES = ["primary_metabolites", "specialized_metabolites", "volatiles"]
SOURCES = ["PHYDOREX", "HERBORUM", "CHEMAREA", "NOWHERE"]
FEATURES = ["comparison_scope__" + s for s in SCOPES]


def _rows(spark, d):
    return table(spark, d, "plant_compounds")


def _review(spark, d):
    """Reviews made of curation flags: checked and flagged records by id, automatic ones by their key."""
    rows = _rows(spark, d)
    none = [F.lit(None).cast("string").alias(c) for c in ("species", "compound_name_clean", "source_database", "source_record_id")]
    by_id = rows.filter("curation_flag in ('needs_review', 'checked')").select("occurrence_id", *none, F.when(F.col("curation_flag") == "needs_review", "exclude").otherwise("confirmed_literature").alias("decision"))
    by_key = rows.filter("curation_flag = 'auto' and species is not null").select(F.lit(None).cast("bigint").alias("occurrence_id"), "species", "compound_name_clean", "source_database", "source_record_id", F.lit("direct_species_database").alias("decision"))
    return by_id.unionByName(by_key)


def evidence_grades(spark, d):
    return E.grade_evidence(_rows(spark, d))


def evidence_grades_reviewed(spark, d):
    return E.grade_evidence(_rows(spark, d), _review(spark, d)).select("occurrence_id", "evidence_grade", "decision")


def evidence_direct(spark, d):
    return E.filter_direct(E.grade_evidence(_rows(spark, d))).select("occurrence_id", "evidence_grade")


def evidence_comparable(spark, d):
    return E.filter_comparable(E.grade_evidence(_rows(spark, d))).select("occurrence_id", "evidence_grade")


def evidence_review_required(spark, d):
    return E.filter_review_required(E.grade_evidence(_rows(spark, d))).select("occurrence_id", "evidence_grade")


def evidence_dictionary(spark, d):
    return E.grade_dictionary(spark)


def evidence_summary(spark, d):
    return E.grade_summary(E.grade_evidence(_rows(spark, d)))


def review_reasons(spark, d):
    return E.review_reasons(_rows(spark, d))


def metadata_standardized(spark, d):
    return E.standardize_metadata(table(spark, d, "plant_metadata"))


def _overrides(spark, d):
    lib = table(spark, d, "chemical_library")
    by_name = lib.select(F.lit(None).cast("string").alias("compound_id"), F.lower("compound").alias("compound_name_clean"), F.lit("volatiles").alias("comparison_scope"), F.when(F.col("compound_type").isNotNull(), "terpenoid").alias("comparison_group"))
    by_id = lib.filter("also_called is not null").select(F.concat(F.lit("cid_"), (F.col("library_id") + 700000).cast("string")).alias("compound_id"), F.lit(None).cast("string").alias("compound_name_clean"), F.lit("primary_metabolites").alias("comparison_scope"), F.lit(" ").alias("comparison_group"))
    return by_name.unionByName(by_id)


def overrides_applied(spark, d):
    rows = _rows(spark, d).select("occurrence_id", "compound_id", "compound_name_clean", "comparison_scope", "comparison_group")
    return E.apply_overrides(rows, _overrides(spark, d), ["comparison_scope", "comparison_group"]).select("occurrence_id", "comparison_scope", "comparison_group")


def overrides_invalid(spark, d):
    allowed = _rows(spark, d).select("comparison_scope", "comparison_group")
    rows = _overrides(spark, d).filter("comparison_group is not null")
    return E.invalid_overrides(rows, allowed, ["comparison_scope", "comparison_group"]).select("compound_id", "compound_name_clean", "comparison_scope", "comparison_group")


def _features(mode):
    def query(spark, d):
        return E.feature_long(_rows(spark, d), "comparison_scope", mode)

    return query


def feature_matrix(spark, d):
    long = E.feature_long(_rows(spark, d), "comparison_scope", "fraction")
    return E.feature_matrix(long, table(spark, d, "plant_list"), FEATURES)


def species_metadata(spark, d):
    rows = _rows(spark, d)
    return E.species_metadata(E.grade_evidence(rows), rows, table(spark, d, "plant_list"))


def species_summary(spark, d):
    return E.species_summary(_rows(spark, d))


def mode_or_mixed(spark, d):
    return E.mode_or_mixed(_rows(spark, d), "species", "plant_part_group")


def _coverage(spark, d):
    return E.source_coverage(_rows(spark, d), "compound_id", "source_database", SOURCES)


def source_coverage(spark, d):
    return _coverage(spark, d)


def coverage_summary(spark, d):
    return E.coverage_summary(_coverage(spark, d))


def missing_species(spark, d):
    return E.missing_species(table(spark, d, "plant_list"), _rows(spark, d), words_key(F.col("species")))


def membership_enriched(spark, d):
    rows = _rows(spark, d)
    return E.enrich_membership(rows.select("occurrence_id", "compound_id", "smiles", "molecular_formula"), rows, ["smiles", "molecular_formula"]).select("occurrence_id", "smiles", "molecular_formula")


def direct_sources(spark, d):
    rows = _rows(spark, d)
    return E.grade_sources(E.grade_evidence(rows), rows)


QUERIES = {
    f.__name__: f
    for f in (
        evidence_grades, evidence_grades_reviewed, evidence_direct, evidence_comparable, evidence_review_required, evidence_dictionary, evidence_summary, review_reasons, metadata_standardized, overrides_applied,
        overrides_invalid, feature_matrix, species_metadata, species_summary, mode_or_mixed, source_coverage, coverage_summary, missing_species, membership_enriched, direct_sources,
    )
} | {f"features_{m}": _features(m) for m in ("count", "binary", "fraction", "confidence")}

_NON = "nullif(trim(regexp_replace({0}, '[\\s\\pZ]+', ' ', 'g')), '')"
_MISSING = "('', 'unknown', 'unspecified', 'not_reported', 'not reported', 'na', 'none')"


def known(c: str) -> str:
    return f"coalesce(lower(trim(regexp_replace({c}::VARCHAR, '[\\s\\pZ]+', ' ', 'g'))) NOT IN {_MISSING}, false)"


def non(c: str) -> str:
    return _NON.format(c)


_GRADE = f"""CASE WHEN decision IN ('exclude', 'excluded', 'remove', 'do_not_use', 'reject') THEN 'excluded_by_review'
  WHEN decision IN ('promote_direct_species_database', 'direct_species_database', 'confirmed_direct_database') THEN 'direct_species_database_record'
  WHEN decision IN ('promote_direct_species_literature', 'direct_species_literature', 'confirmed_literature') THEN 'direct_species_literature_supported_record'
  WHEN NOT ({known("compound_name")} OR {known("compound_name_clean")} OR {known("compound_id")}) OR contains(ti, 'unresolved') OR contains(st, 'unresolved') THEN 'unresolved_or_review_required'
  WHEN contains(ti, 'direct_species_database') OR (rk = 'species' AND NOT regexp_matches(so, 'pubmed|pubtator|literature|candidate') AND {known("source_record_id")}) THEN 'direct_species_database_record'
  WHEN contains(ti, 'direct_species_literature') OR (rk = 'species' AND regexp_matches(so, 'pubmed|literature') AND NOT regexp_matches(ti, 'candidate|pubtator')) THEN 'direct_species_literature_supported_record'
  WHEN regexp_matches(ti, 'genus|family|fallback') OR rk IN ('genus', 'family') THEN 'source_backed_genus_family_fallback'
  WHEN regexp_matches(ti, 'pubtator|candidate|co.?mention') OR contains(so, 'pubtator') OR (contains(so, 'pubmed') AND NOT contains(ti, 'direct')) THEN 'pubtator_pubmed_candidate_only'
  ELSE 'unresolved_or_review_required' END"""
_LOW = ", ".join(f"lower(coalesce(trim(regexp_replace({c}, '[\\s\\pZ]+', ' ', 'g')), '')) AS {a}" for c, a in (("evidence_tier", "ti"), ("source_database", "so"), ("matched_rank", "rk"), ("occurrence_status", "st")))
_GRADED = f"""WITH g AS (SELECT *, {_GRADE} AS evidence_grade FROM (SELECT *, 'not_reviewed' AS decision, {_LOW} FROM plant_compounds)),
h AS (SELECT *, CASE evidence_grade WHEN 'direct_species_database_record' THEN 1 WHEN 'direct_species_literature_supported_record' THEN 2 WHEN 'source_backed_genus_family_fallback' THEN 3 WHEN 'pubtator_pubmed_candidate_only' THEN 4 WHEN 'excluded_by_review' THEN 99 ELSE 5 END AS rank,
  {known("smiles")} OR {known("inchikey")} OR {known("cid")} AS sr,
  coalesce(lower(trim(comparable_for_matrix)) IN ('true', 't', 'yes', 'y', '1', 'present', 'high', 'medium'), false) AND lower(coalesce(trim(comparison_scope), '')) NOT IN ('', 'unknown') AS cm FROM g),
k AS (SELECT *, rank IN (3, 4, 5) OR coalesce(contains(lower(curation_flag), 'review'), false) AS rr FROM h)
"""
_YN = "CASE WHEN {0} THEN 'Yes' ELSE 'No' END"
_DIRECT = "rank <= 2 AND NOT rr AND sr"
_CONF = "CASE lower(trim(confidence)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_SLUG = "lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
_FEAT = f"SELECT species, {non('compound_id')} AS compound_id, 'comparison_scope__' || {_SLUG.format('comparison_scope')} AS feature, {_CONF} AS c FROM plant_compounds WHERE {known('species')} AND {known('comparison_scope')}"
_META = "trim(regexp_replace(regexp_replace(species, '[_''\"“”\\[\\]();.,!?<>*/]+', ' ', 'g'), '[\\s\\pZ]+', ' ', 'g'))"


def _share(c: str, name: str) -> str:
    return f"round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END), 4) AS {name}"


def _dom(c: str) -> str:
    return f"(SELECT species, v AS dominant_{c} FROM (SELECT species, {c} AS v, count(*) AS n FROM plant_compounds WHERE {known(c)} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY species ORDER BY n DESC, v) = 1)"


_COV = f"WITH c AS (SELECT q.compound_id AS query, s.source, count(p.compound_id) AS n_records FROM (SELECT DISTINCT compound_id FROM plant_compounds WHERE compound_id IS NOT NULL) q, (SELECT unnest({SOURCES}) AS source) s LEFT JOIN plant_compounds p ON p.compound_id = q.compound_id AND p.source_database = s.source GROUP BY 1, 2)"
_WORDS = "array_to_string(list_sort(regexp_extract_all(lower(coalesce(species, '')), '[\\p{L}\\p{Nd}]+')), ' ')"
_OV = """ov AS (SELECT NULL AS compound_id, lower(compound) AS compound_name_clean, 'volatiles' AS comparison_scope, CASE WHEN compound_type IS NOT NULL THEN 'terpenoid' END AS comparison_group FROM chemical_library
UNION ALL SELECT 'cid_' || (library_id + 700000), NULL, 'primary_metabolites', ' ' FROM chemical_library WHERE also_called IS NOT NULL)"""
_REASONS = (
    ("no_structure", f"NOT ({known('smiles')} OR {known('inchikey')})"), ("no_compound_id", f"NOT {known('compound_id')}"), ("no_citation", f"NOT {known('citation_or_url')}"), ("low_confidence", f"{_CONF} <= 1"),
    ("weak_tier", "coalesce(regexp_matches(lower(evidence_tier), 'candidate|fallback|unresolved'), true)"), ("flagged", "coalesce(contains(lower(curation_flag), 'review'), false)"),
)

_TRUE = "lower(trim(comparable_for_matrix)) IN ('true', 't', 'yes', 'y', '1', 'present', 'high', 'medium')"


def _many(value: str, where: str) -> str:
    return f"count(DISTINCT CASE WHEN {where} THEN {value} END)"


def _mean(c: str) -> str:
    return f"round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END), 4)"


_ID = non("compound_id")
_META_COUNTS = {
    "n_occurrences": "count(*)", "n_compounds": f"count(DISTINCT {_ID})", "n_comparable": _many(_ID, _TRUE), "n_with_structure": _many(_ID, f"({known('smiles')} OR {known('inchikey')})"), "n_sources": f"count(DISTINCT {non('source_database')})",
    "n_scopes": _many("comparison_scope", known("comparison_scope")), "n_groups": _many("comparison_group", known("comparison_group")), "n_with_part": f"count(*) FILTER ({known('plant_part_group')})", "n_with_tissue": f"count(*) FILTER ({known('tissue_group')})",
    "n_with_method": f"count(*) FILTER ({known('method_group')})", "n_with_context": f"count(*) FILTER ({known('plant_part_group')} OR {known('tissue_group')})", **{f"n_grade_{r}": f"count(*) FILTER (rank = {r})" for r in range(1, 6)},
}
_IS_DIRECT = "coalesce(contains(lower(evidence_tier), 'direct_species') AND NOT contains(lower(evidence_tier), 'candidate'), false)"
_SUMMARY = {
    "n_compounds": f"count(DISTINCT {_ID})", "n_with_structure": _many(_ID, known("smiles")), "n_inchikeys": _many("inchikey", known("inchikey")), "n_cids": "count(DISTINCT cid)", "n_names": f"count(DISTINCT {non('compound_name_clean')})", "n_records": "count(*)",
    "n_source_records": f"count(DISTINCT {non('source_record_id')})", "n_citations": f"count(DISTINCT {non('citation_or_url')})", "n_sources": f"count(DISTINCT {non('source_database')})", "n_comparable": _many(_ID, _TRUE),
    "n_direct_records": f"count(*) FILTER ({_IS_DIRECT})", "n_direct_compounds": _many(_ID, _IS_DIRECT), "n_genus_records": "count(*) FILTER (lower(trim(matched_rank)) = 'genus')", "n_review_records": "count(*) FILTER (contains(lower(curation_flag), 'review'))",
    **{n: _many(c, known(c)) for n, c in (("n_scopes", "comparison_scope"), ("n_groups", "comparison_group"), ("n_subgroups", "comparison_subgroup"), ("n_parts", "plant_part_group"), ("n_methods", "method_group"))},
    "mean_confidence": "round(sum(CASE lower(trim(confidence)) WHEN 'high' THEN 90 WHEN 'medium' THEN 65 WHEN 'low' THEN 35 END) / count(*) FILTER (lower(trim(confidence)) IN ('high', 'medium', 'low')) / 100, 4)",
    "structure_known": _mean(f"({known('smiles')} OR {known('inchikey')})"), "part_known": _mean(known("plant_part_group")), "tissue_known": _mean(known("tissue_group")), "method_known": _mean(known("method_group") + " AND lower(method_group) NOT IN ('database_record', 'literature_curation')"),
    "context_known": _mean(f"({known('plant_part_group')} OR {known('tissue_group')})"),
}

ORACLES = {
    "evidence_grades": _GRADED + f"SELECT occurrence_id, species, compound_id, evidence_grade, rank AS evidence_grade_rank, {_YN.format('rank <= 3')} AS source_backed, {_YN.format('sr')} AS structure_resolved, {_YN.format('cm')} AS comparable_for_analysis, {_YN.format('rr')} AS review_required, decision, evidence_grade || '__' || CASE WHEN sr THEN 'structure_resolved' ELSE 'structure_unresolved' END || '__' || CASE WHEN cm THEN 'comparable' ELSE 'not_comparable' END AS analysis_filter_key FROM k",
    "evidence_grades_reviewed": f"""WITH ki AS (SELECT occurrence_id, CASE WHEN curation_flag = 'needs_review' THEN 'exclude' ELSE 'confirmed_literature' END AS di FROM plant_compounds WHERE curation_flag IN ('needs_review', 'checked')),
kk AS (SELECT DISTINCT species, compound_name_clean, source_database, source_record_id, 'direct_species_database' AS dk FROM plant_compounds WHERE curation_flag = 'auto' AND species IS NOT NULL),
j AS (SELECT p.*, coalesce(dk, di, 'not_reviewed') AS decision, {_LOW} FROM plant_compounds p LEFT JOIN ki USING (occurrence_id) LEFT JOIN kk USING (species, compound_name_clean, source_database, source_record_id))
SELECT occurrence_id, {_GRADE} AS evidence_grade, decision FROM j""",
    "evidence_direct": _GRADED + f"SELECT occurrence_id, evidence_grade FROM k WHERE {_DIRECT}",
    "evidence_comparable": _GRADED + f"SELECT occurrence_id, evidence_grade FROM k WHERE {_DIRECT} AND cm",
    "evidence_review_required": _GRADED + "SELECT occurrence_id, evidence_grade FROM k WHERE rr",
    "evidence_summary": _GRADED + f"SELECT evidence_grade, rank AS evidence_grade_rank, count(*) AS n_rows, count(DISTINCT {non('species')}) AS n_species, count(DISTINCT {non('compound_id')}) AS n_compounds, count(*) FILTER (sr) AS n_structure FROM k GROUP BY 1, 2",
    "review_reasons": "SELECT * FROM (SELECT occurrence_id, concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _REASONS) + ") AS reasons FROM plant_compounds) WHERE reasons <> ''",
    "metadata_standardized": f"SELECT metadata_id, {_META} AS species, coalesce({non('accepted_species_name')}, {_META}) AS accepted_species_name, coalesce({non('genus')}, nullif(regexp_extract(upper({_META}[1]) || lower({_META}[2:]), '^([A-Z][a-z-]+)', 1), '')) AS genus, {non('family')} AS family, CASE WHEN {non('family')} IS NULL THEN 'missing' ELSE 'supplied' END AS family_status FROM plant_metadata",
    "overrides_applied": f"WITH {_OV}, i AS (SELECT compound_id, max({non('comparison_scope')}) AS s, max({non('comparison_group')}) AS g FROM ov WHERE compound_id IS NOT NULL GROUP BY 1), n AS (SELECT compound_name_clean, max({non('comparison_scope')}) AS s, max({non('comparison_group')}) AS g FROM ov WHERE compound_id IS NULL GROUP BY 1) SELECT occurrence_id, coalesce(i.s, n.s, comparison_scope) AS comparison_scope, coalesce(i.g, n.g, comparison_group) AS comparison_group FROM plant_compounds LEFT JOIN i USING (compound_id) LEFT JOIN n USING (compound_name_clean)",
    "overrides_invalid": f"WITH {_OV} SELECT * FROM ov WHERE comparison_group IS NOT NULL AND (comparison_scope, comparison_group) NOT IN (SELECT (comparison_scope, comparison_group) FROM plant_compounds WHERE comparison_scope IS NOT NULL AND comparison_group IS NOT NULL)",
    "feature_matrix": f"WITH f AS ({_FEAT}), v AS (SELECT species, feature, count(DISTINCT compound_id) / greatest(any_value(t), 1) AS value FROM f JOIN (SELECT species, count(DISTINCT compound_id) AS t FROM f GROUP BY 1) USING (species) GROUP BY 1, 2) SELECT species, " + ", ".join(f"coalesce(max(round(value, 6)) FILTER (feature = '{x}'), 0)::DOUBLE AS {x}" for x in FEATURES) + f", 'species__' || {_SLUG.format('species')} AS species_id FROM (SELECT DISTINCT species FROM plant_list) LEFT JOIN v USING (species) GROUP BY species",
    "evidence_dictionary": "SELECT * FROM (VALUES ('direct_species_database_record', 1, 'Direct species database record', 'Yes', 'Yes'), ('direct_species_literature_supported_record', 2, 'Direct species literature-supported record', 'Yes', 'Yes'), ('source_backed_genus_family_fallback', 3, 'Source-backed genus or family fallback', 'No', 'Yes'), ('pubtator_pubmed_candidate_only', 4, 'PubTator or PubMed candidate only', 'No', 'No'), ('unresolved_or_review_required', 5, 'Unresolved or review-required', 'No', 'No'), ('excluded_by_review', 99, 'Excluded by review', 'No', 'No')) v(evidence_grade, evidence_grade_rank, label, is_direct, source_backed)",
    "species_metadata": _GRADED + f", c AS (SELECT species, {', '.join(f'{v} AS {n}' for n, v in _META_COUNTS.items())} FROM k GROUP BY species) SELECT species, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _META_COUNTS) + ", CASE WHEN n_occurrences > 0 THEN 'records_present' ELSE 'no_records_in_membership' END AS record_status FROM (SELECT DISTINCT species FROM plant_list) LEFT JOIN c USING (species)",
    "species_summary": f"""WITH s AS (SELECT species, {", ".join(f"{v} AS {n}" for n, v in _SUMMARY.items())} FROM plant_compounds WHERE {non("species")} IS NOT NULL GROUP BY species)
SELECT s.*, dominant_comparison_scope, dominant_comparison_group, dominant_plant_part_group, dominant_source_database, CASE WHEN n_compounds < 1 THEN 'no_species_level_public_profile' WHEN n_compounds >= 50 AND n_with_structure / n_compounds >= 0.8 AND n_records >= 50 THEN 'robust_public_species_profile' WHEN n_compounds >= 10 AND n_with_structure / n_compounds >= 0.5 THEN 'moderate_public_species_profile' ELSE 'limited_public_species_profile' END AS quality_tier
FROM s LEFT JOIN {_dom("comparison_scope")} USING (species) LEFT JOIN {_dom("comparison_group")} USING (species) LEFT JOIN {_dom("plant_part_group")} USING (species) LEFT JOIN {_dom("source_database")} USING (species)""",
    "mode_or_mixed": f"SELECT species, CASE WHEN count(*) > 1 THEN 'mixed' ELSE max(v) END AS mode_plant_part_group FROM (SELECT species, {non('plant_part_group')} AS v, count(*) AS n FROM plant_compounds WHERE {non('plant_part_group')} IS NOT NULL GROUP BY 1, 2 QUALIFY n = max(n) OVER (PARTITION BY species)) GROUP BY species",
    "source_coverage": _COV + " SELECT query, source, n_records, CASE WHEN n_records > 0 THEN 'Yes' ELSE 'No' END AS present FROM c",
    "coverage_summary": _COV + " SELECT source, count(*) FILTER (n_records > 0) AS n_covered, count(*) AS n_queries, sum(n_records)::BIGINT AS n_records, round(count(*) FILTER (n_records > 0) / count(*), 4) AS coverage FROM c GROUP BY source",
    "missing_species": f"SELECT list_id, species FROM plant_list WHERE {_WORDS} NOT IN (SELECT {_WORDS} FROM plant_compounds)",
    "membership_enriched": f"WITH r AS (SELECT compound_id, max({non('smiles')}) AS s, max({non('molecular_formula')}) AS m FROM plant_compounds WHERE compound_id IS NOT NULL GROUP BY 1) SELECT occurrence_id, coalesce({non('smiles')}, s) AS smiles, coalesce({non('molecular_formula')}, m) AS molecular_formula FROM plant_compounds LEFT JOIN r USING (compound_id)",
    "direct_sources": _GRADED + "SELECT species, string_agg(DISTINCT upper(trim(source_database)), '; ' ORDER BY upper(trim(source_database))) AS sources, count(*) AS n_records FROM k WHERE rank <= 2 AND NOT rr GROUP BY species",
    "features_count": f"SELECT species, feature, count(DISTINCT compound_id)::DOUBLE AS value FROM ({_FEAT}) GROUP BY ALL",
    "features_binary": f"SELECT species, feature, (count(DISTINCT compound_id) > 0)::INT::DOUBLE AS value FROM ({_FEAT}) GROUP BY ALL",
    "features_fraction": f"WITH f AS ({_FEAT}) SELECT species, feature, round(count(DISTINCT compound_id) / greatest(any_value(t), 1), 6) AS value FROM f JOIN (SELECT species, count(DISTINCT compound_id) AS t FROM f GROUP BY 1) USING (species) GROUP BY 1, 2",
    "features_confidence": f"SELECT species, feature, round(sum(CASE w WHEN 3 THEN 0.9 WHEN 2 THEN 0.65 WHEN 1 THEN 0.35 ELSE 0 END)::DOUBLE, 6) AS value FROM (SELECT species, feature, compound_id, max(c) AS w FROM ({_FEAT}) WHERE compound_id IS NOT NULL GROUP BY ALL) GROUP BY 1, 2",
}
