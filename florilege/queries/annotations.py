"""Annotation profiles over texts that are written out of the occurrence records."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.operators import annotations as A
from florilege.session import table

#: What is annotated, by occurrence_id % 6: heading and text; {n} is the id's last four digits, {t} the subgroup.
TEXTS = (
    ("GHS Classification", "Danger: H319 and H225, P280; eye and skin, {t}"),
    ("FEMA Flavor Profile", "FEMA No. {n}; GRAS; sweet citrus flavor of {t}"),
    ("Drug and Medication", "Boxed Warning: oral tablet, pregnancy; {t}"),
    ("MeSH Tree", "D02.455.{n}; Pharmacologic Action of {t}"),
    ("Literature", "PMID: {n}; doi 10.1234/ab.{n}; patent US{n}567"),
    ("LOTUS natural products", "LTS000{n} taxonomy {n} family: Rosaceae; plant terpenoid"),
)


def _n():
    return F.lpad((F.col("occurrence_id") % 10000).cast("string"), 4, "0")


def _annotations(spark, d):
    rows = table(spark, d, "plant_compounds").filter("compound_id is not null")
    pick = (F.col("occurrence_id") % 6).cast("int") + 1
    value = F.replace(F.replace(F.element_at(F.array(*[F.lit(t) for _, t in TEXTS]), pick), F.lit("{n}"), _n()), F.lit("{t}"), F.coalesce("comparison_subgroup", F.lit("none")))
    return rows.select(F.col("compound_id").alias("query"), "cid", F.element_at(F.array(*[F.lit(h) for h, _ in TEXTS]), pick).alias("heading"), F.lit(None).cast("string").alias("name"), value.alias("value"), F.col("source_database").alias("source"))


def _make(name):
    def query(spark, d):
        return getattr(A, name)(_annotations(spark, d))

    query.__name__ = name
    return query


def assay_classes(spark, d):
    rows = table(spark, d, "events")
    assay = F.concat(F.lit("Inhibitors of human kinase assay, "), "event_type", F.when(F.col("event_id") % 3 == 0, F.lit(" cell line viability")).otherwise(""))
    return A.bioactivities(rows.select(F.col("user_id").alias("query"), F.col("event_id").alias("aid"), assay.alias("assay_name"), F.when(F.col("event_id") % 2 == 0, "IC50").otherwise("Potency").alias("activity_name"), F.when(F.col("event_type") == "click", "Active").otherwise("Inactive").alias("outcome"), F.lit(None).cast("string").alias("target_name"), F.lit(None).cast("string").alias("accession"), F.lit(None).cast("string").alias("gene"), F.col("value"), F.lit("uM").alias("unit")))


def long_terms(spark, d):
    rows = table(spark, d, "plant_compounds").filter("compound_id is not null")
    return A.terms([(rows.select(F.col("compound_id").alias("query"), F.concat_ws("; ", "comparison_group", "comparison_subgroup").alias("class_name")), "classification", ["class_name"]), (rows.select(F.col("compound_id").alias("query"), "tissue_group"), "occurrence", ["tissue_group"])]).select("query", "domain", "term_type", "term_raw")


def pathway_rows(spark, d):
    lib = table(spark, d, "chemical_library")
    ident = F.concat(F.lit("map"), F.lpad(F.col("library_id").cast("string"), 5, "0"))
    records = lib.select(F.col("library_id").alias("record"), F.lit("PATHWAY").alias("field"), F.concat(ident, F.lit("  "), "compound", F.lit(" acid biosynthesis purine")).alias("value"))
    links = lib.select(F.col("library_id").alias("record"), F.lit("pathway").alias("target_db"), ident.alias("target_id"), "also_called").filter("also_called is not null").drop("also_called")
    return A.pathway_rows(records, links, lib.filter("compound_type = 'class A'").select(ident.alias("id"), F.lit("Starch metabolism").alias("name")))


_PROFILES = ("safety_profile", "flavour_profile", "label_profile", "subject_profile", "literature_profile", "natural_profile")
QUERIES = {n: _make(n) for n in _PROFILES} | {f.__name__: f for f in (assay_classes, long_terms, pathway_rows)}

from florilege.queries.evidence import non  # noqa: E402

_N = "lpad((occurrence_id % 10000)::VARCHAR, 4, '0')"


def _oracle(k: int, columns: str, more: str = "") -> str:
    """Profile rows of the texts of kind k; ``more`` names other kinds whose text belongs to the profile, too."""
    return f"WITH a AS (SELECT compound_id AS query, cid, source_database AS source, {columns} FROM plant_compounds WHERE compound_id IS NOT NULL AND (occurrence_id % 6 = {k}{more})) SELECT * EXCLUDE (source), count(*) AS n_rows, nullif(string_agg(DISTINCT {non('source')}, '; ' ORDER BY {non('source')}), '') AS sources FROM a GROUP BY ALL"


_TEXT = "CASE occurrence_id % 6 " + " ".join(f"WHEN {k} THEN '{h} {t}'" for k, (h, t) in enumerate(TEXTS)) + " END"
_ALL = f"""WITH an AS (SELECT compound_id AS query, cid, source_database AS source, replace(replace({_TEXT}, '{{n}}', {_N}), '{{t}}', coalesce(comparison_subgroup, 'none')) AS x FROM plant_compounds WHERE compound_id IS NOT NULL)"""


def _sorted(pattern: str) -> str:
    return f"nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(x, '{pattern}'))), '; '), '')"


def _terms(words: str) -> str:
    return "nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN regexp_matches(x, '(?i)\\b{w}\\b') THEN '{w}' END" for w in words.split(",")) + "), '')"


def _full(belongs: str, columns: str) -> str:
    """Profile rows of all texts that belong to a profile."""
    return _ALL + f", a AS (SELECT query, cid, source, {columns} FROM an WHERE regexp_matches(x, '(?i){belongs}')) SELECT * EXCLUDE (source), count(*) AS n_rows, nullif(string_agg(DISTINCT {non('source')}, '; ' ORDER BY {non('source')}), '') AS sources FROM a GROUP BY ALL"


_ODOURS = _terms("citrus,lemon,orange,lime,floral,rose,green,herbal,mint,pine,woody,earthy,fruity,berry,apple,banana,sweet,bitter,sour,fatty,waxy,spicy,pepper,smoky,nutty,almond,vanilla,phenolic,sulfurous,alliaceous,camphor,terpene,fresh")
_H = "regexp_extract(x, '\\b(H[0-9]{3}[A-Za-z]?)\\b', 1)"
ORACLES = {
    "safety_profile": _full(
        "Safety|Hazard|GHS|Toxicity|Toxicological|Fire|Exposure|Handling|Warning|Danger|H[0-9]{3}|P[0-9]{3}",
        _sorted("\\bH[0-9]{3}[A-Za-z]?\\b") + " AS hazard_codes, " + _sorted("\\bP[0-9]{3}[A-Za-z]?\\b") + " AS precaution_codes, CASE WHEN regexp_matches(x, '(?i)\\bdanger\\b') THEN 'Danger' WHEN regexp_matches(x, '(?i)\\bwarning\\b') THEN 'Warning' END AS signal_word, "
        + f"CASE WHEN {_H} LIKE 'H2%' THEN 'physical_hazard' WHEN {_H} LIKE 'H3%' THEN 'health_hazard' WHEN {_H} LIKE 'H4%' THEN 'environmental_hazard' WHEN regexp_matches(x, '(?i)flammable|explosive|oxidiz') THEN 'physical_hazard' WHEN regexp_matches(x, '(?i)aquatic|environment') THEN 'environmental_hazard' WHEN regexp_matches(x, '(?i)toxic|harmful|irritat|corros|carcin') THEN 'health_hazard' END AS hazard_category, "
        + f"CASE WHEN {_H} IN ('H318', 'H319') THEN 'eye_damage_irritation' WHEN {_H} IN ('H315', 'H317') THEN 'skin_irritation_sensitization' WHEN regexp_matches({_H}, '^H3[013]') THEN 'acute_toxicity' WHEN regexp_matches({_H}, '^H2[2-7]') THEN 'flammability_reactivity' WHEN {_H} LIKE 'H4%' THEN 'aquatic_environmental_toxicity' WHEN regexp_matches(x, '(?i)eye') THEN 'eye_damage_irritation' WHEN regexp_matches(x, '(?i)skin|dermal') THEN 'skin_irritation_sensitization' WHEN regexp_matches(x, '(?i)flammable') THEN 'flammability_reactivity' WHEN regexp_matches(x, '(?i)toxic|harmful|fatal') THEN 'acute_toxicity' WHEN regexp_matches(x, '(?i)aquatic') THEN 'aquatic_environmental_toxicity' END AS hazard_group, "
        + _terms("eye,skin,respiratory tract,liver,kidney,central nervous system,blood,heart,lung,reproductive system") + " AS target_organs",
    ),
    "flavour_profile": _full(
        "FEMA|Flavor and Extract|Flavor|Odor|Taste|GRAS|JECFA",
        "nullif(regexp_extract(x, '(?i)FEMA\\D{0,20}?([0-9]{4})\\b', 1), '') AS fema_number, nullif(regexp_extract(x, '(?i)JECFA\\D{0,20}?([0-9]{1,4})\\b', 1), '') AS jecfa_number, CASE WHEN regexp_matches(x, '(?i)\\bGRAS\\b|Generally Recognized as Safe') THEN 'GRAS' END AS gras, "
        + f"{_ODOURS} AS descriptors, CASE WHEN regexp_matches(x, '(?i)flavou?r|taste|aroma') THEN {_ODOURS} END AS flavours, CASE WHEN regexp_matches(x, '(?i)odou?r|aroma|scent|smell') THEN {_ODOURS} END AS odours",
    ),
    "label_profile": _full(
        "FDA/SPL|SPL Indexing|Drug and Medication|Therapeutic Uses|Drug|Medication|Clinical|Pharmacologic|Indication|Contraindication|Adverse|Route|Dosage|Ingredient|Boxed Warning",
        _terms("oral,intravenous,topical,inhalation,subcutaneous,intramuscular,ophthalmic,nasal,transdermal,rectal,sublingual,buccal,intradermal,epidural") + " AS routes, " + _terms("tablet,capsule,solution,suspension,injection,cream,ointment,gel,patch,spray,powder,suppository,syrup") + " AS dosage_forms, "
        + _terms("contraindication,adverse reaction,boxed warning,warning,precaution,interaction,overdosage,pregnancy,carcinogenesis,hypersensitivity") + " AS warnings, regexp_matches(x, '(?i)boxed warning|black box') AS boxed_warning",
    ),
    "literature_profile": _oracle(4, f"'PMID: ' || {_N} AS pubmed, '10.1234/ab.' || {_N} AS doi, 'US' || {_N} || '567' AS patents, 'pubmed' AS kind"),
    "natural_profile": _oracle(5, f"'LTS000' || {_N} AS record, {_N} AS taxonomy_id, 'Rosaceae' AS family, NULL AS taxon_order, 'Plantae' AS kingdom, 'terpenoid' AS product_classes"),
    "subject_profile": _oracle(3, f"'D02.455.' || {_N} AS tree_numbers, 'Chemicals and Drugs' AS tree_group, true AS is_action"),
    "assay_classes": "SELECT user_id AS query, event_id AS aid, CASE WHEN event_type = 'click' THEN 'active' ELSE 'inactive' END AS activity_class, 'inhibitor' AS direction, CASE WHEN event_id % 3 = 0 THEN 'cell_viability_cytotoxicity' ELSE 'kinase_signaling' END AS domain, CASE WHEN event_id % 3 = 0 THEN 'cell_line' ELSE 'protein_or_gene' END AS target_kind, 'human' AS organism, CASE WHEN value IS NULL THEN NULL WHEN event_id % 2 = 0 THEN 'IC50' ELSE 'potency' END AS metric, CASE WHEN value <= 0.1 THEN 'sub_100_nM' WHEN value <= 1 THEN 'sub_1_uM' WHEN value <= 10 THEN '1_to_10_uM' WHEN value <= 50 THEN '10_to_50_uM' WHEN value > 50 THEN 'above_50_uM' END AS bucket FROM events",
    "long_terms": f"SELECT DISTINCT compound_id AS query, 'classification' AS domain, 'class_name' AS term_type, unnest([comparison_group, comparison_subgroup]) AS term_raw FROM plant_compounds WHERE compound_id IS NOT NULL UNION ALL SELECT DISTINCT compound_id, 'occurrence', 'tissue_group', tissue_group FROM plant_compounds WHERE compound_id IS NOT NULL AND {non('tissue_group')} IS NOT NULL",
    "pathway_rows": "WITH b AS (SELECT library_id AS record, 'map' || lpad(library_id::VARCHAR, 5, '0') AS id, CASE WHEN compound_type = 'class A' THEN 'Starch metabolism' END AS m, also_called, compound || ' acid biosynthesis purine' AS o FROM chemical_library WHERE compound IS NOT NULL), r AS (SELECT record, id, coalesce(m, o) AS name, 'record' AS evidence FROM b UNION ALL SELECT record, id, m, 'link' FROM b WHERE also_called IS NOT NULL) SELECT record, id, name, CASE WHEN name IS NULL THEN NULL WHEN name = 'Starch metabolism' THEN 'Carbohydrate metabolism' ELSE 'Nucleotide metabolism' END AS pathway_group, evidence FROM r",
}
