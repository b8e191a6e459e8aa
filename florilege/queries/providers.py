"""Queries of provider indexes, annotation, text extraction, audits, batches and olfaction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions import extract, rules
from florilege.functions.rules import formula_mass
from florilege.functions.text import GREEK, label, words_key
from florilege.operators import enrichment as N
from florilege.operators import olfaction as O
from florilege.operators import providers as P
from florilege.operators import quality as Q
from florilege.sources import records as R
from florilege.session import table

RANK_SOURCES = ["PHYDOREX", "HERBORUM", "CHEMAREA"]


def _index(spark, d):
    rows = table(spark, d, "plant_compounds")
    records = rows.select(F.col("source_record_id").alias("record_id"), "species", "compound_id", F.upper(F.trim("source_database")).alias("source"))
    compounds = rows.select("compound_id", F.col("compound_name_clean").alias("name"), "inchikey")
    taxa = table(spark, d, "plant_metadata").select(words_key(F.col("species")).alias("species_key"), "genus", "family")
    return P.build_index(records, compounds, taxa)


def _plants(spark, d):
    return table(spark, d, "plant_metadata").select(F.col("metadata_id").alias("plant_id"), "species", "genus", "family")


def provider_index(spark, d):
    return _index(spark, d)


def index_lookup(spark, d):
    return P.query_index(_plants(spark, d), _index(spark, d), ("species", "genus", "family"), 10)


def index_occurrences(spark, d):
    return P.occurrence_rows(P.query_index(_plants(spark, d), _index(spark, d), ("species", "genus")))


def query_accounting(spark, d):
    plants = _plants(spark, d)
    return P.query_accounting(plants, P.query_index(plants, _index(spark, d), ("species", "genus")), RANK_SOURCES)


def taxon_names(spark, d):
    return table(spark, d, "plant_list").select("list_id", P.taxon_core_name(F.col("species")).alias("core_name"), P.name_status(F.col("species")).alias("status"))


def species_aliases(spark, d):
    return P.species_aliases(table(spark, d, "plant_metadata"))


def bind_unique(spark, d):
    a = table(spark, d, "plant_metadata").select(words_key(F.col("species")).alias("k"), F.lower("genus").alias("genus"))
    b = table(spark, d, "plant_list").select(words_key(F.col("species")).alias("k"), "list_id")
    return P.bind_unique([a.filter("genus is not null"), b], ["k"])


def coalesced_queries(spark, d):
    rows = table(spark, d, "plant_metadata").select(F.col("metadata_id").alias("query_id"), words_key(F.col("species")).alias("k"), "genus", "family")
    return P.coalesce_queries(rows, "k", ["genus", "family"])


def deduped_profile(spark, d):
    rows = table(spark, d, "plant_compounds").withColumn("is_comparable", F.col("comparable_for_matrix") == "Yes")
    return N.dedupe_by_key(rows, ["compound_id", "inchikey"], "occurrence_id", ["plant_part_group", "method_group"], ["is_comparable"], ["smiles", "curation_flag"])


def name_matches(spark, d):
    """Every typed name with the library entries that it is related to; entries of a class come before the others."""
    lib = table(spark, d, "chemical_library").withColumn("names", F.concat_ws(";", "compound", "also_called"))
    typed = table(spark, d, "standard_data").filter("compound_name is not null").select(F.lower("compound_name").alias("query")).distinct()
    return N.match_all(typed, "query", lib, "library_id", "names", 3, F.when(F.col("compound_type").startswith("class"), 0).otherwise(1))


def _assays(spark, d):
    outcome = F.when(F.col("event_type") == "click", "active").when(F.col("event_type") == "error", "inactive").otherwise("inconclusive")
    unit = F.when(F.col("event_type") == "view", "nM").otherwise("µM")
    return table(spark, d, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("assay"), outcome.alias("outcome"), rules.activity_class(outcome, F.lit(None)).alias("activity_class"), F.when(F.col("value") > 5, F.col("value")).alias("value"), unit.alias("unit"), F.when(F.col("event_type") != "signup", F.col("event_type")).alias("target"))


def assay_selection(spark, d):
    return N.select_assays(_assays(spark, d), "query", "assay", 5)


def bioactivity_summary(spark, d):
    out = N.bioactivity_summary(_assays(spark, d), "query")
    return out.withColumn("median_potency_um", F.round("median_potency_um", 6))


def target_summary(spark, d):
    return N.targets_summary(_assays(spark, d), "query")


def potency_buckets(spark, d):
    return _assays(spark, d).select("assay", rules.potency_bucket(F.col("value"), F.col("unit")).alias("bucket"))


def occurrence_summary(spark, d):
    taxa = table(spark, d, "plant_metadata").select(words_key(F.col("species")).alias("k"), "genus", "family").groupBy("k").agg(F.min("genus").alias("genus"), F.min("family").alias("family"))
    rows = table(spark, d, "plant_compounds").filter("compound_id is not null").select("compound_id", words_key(F.col("species")).alias("k")).join(F.broadcast(taxa), "k", "left")  # fixed species file
    return N.occurrence_summary(rows.select("compound_id", F.col("k").alias("organism"), F.lit("Plantae").alias("kingdom"), "family", "genus"), "compound_id")


def class_levels(spark, d):
    return N.class_levels(table(spark, d, "plant_compounds"), "compound_id", ["comparison_scope", "comparison_group", "comparison_subgroup"])


def derived_groups(spark, d):
    rows = table(spark, d, "plant_compounds").filter("compound_id is not null")
    return N.derived_groups(rows, "compound_id", formula_mass(F.col("molecular_formula")))


def library_flags(spark, d):
    pairs = table(spark, d, "plant_compound_pair_tanimoto").filter("tanimoto is not null")
    return N.library_flags(pairs.select(F.col("compound_id_a").alias("compound"), F.col("species_b").alias("library_group"), F.col("compound_id_b").alias("library_compound"), F.col("tanimoto").alias("similarity")))


def text_identifiers(spark, d):
    """Identifiers in what stands in the columns of the records."""
    text = F.concat_ws(" ", "compound_name", "inchikey", "citation_or_url", "source_record_id", F.concat(F.lit("CHEBI: "), F.col("cid").cast("string")), F.concat(F.lit("PMID "), F.col("occurrence_id").cast("string")))
    return extract.extract_identifiers(table(spark, d, "plant_compounds").select("occurrence_id", text.alias("t")), "occurrence_id", "t")


def text_measurements(spark, d):
    """The first figure of every sentence of the documents with its unit."""
    sentences = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", r"[.!?][ \t\n\x0B\f\r]+")).alias("sentence_no", "t"))
    return sentences.select("doc_id", "sentence_no", rules.measurement_value(F.col("t")).alias("value"), rules.measurement_unit(F.col("t")).alias("unit"), rules.value_relation(F.col("t")).alias("relation")).filter("value is not null")


def document_fields(spark, d):
    """The named fields of provider records among the documents."""
    return R.key_values(table(spark, d, "documents"), "doc_id", "text")


def toxicity_figures(spark, d):
    text = F.concat(F.lit("LD50 oral rat "), F.col("base_peak_mz").cast("string"), F.lit(" mg/kg; EC50 = "), F.col("component_area").cast("int").cast("string"), F.lit(" mg/L"))
    return extract.toxicity_figures(table(spark, d, "standard_data").select("peak_id", text.alias("t")), "peak_id", "t")


def measurements_standard(spark, d):
    """Units, ranges, relations and bins of measurement texts made of peaks."""
    units = F.element_at(F.array(*[F.lit(u) for u in ("deg F", "K", "°C", "g/cm3", "kg m-3", "g/L", "torr", "kPa", "ug/kg")]), (F.col("peak_id") % 9 + 1).cast("int"))
    props = F.element_at(F.array(*[F.lit(p) for p in ("Boiling Point", "melting point", "Flash Point", "Density", "density", "Water solubility", "Vapour pressure", "vapor pressure", "ld50")]), (F.col("peak_id") % 9 + 1).cast("int"))
    text = F.concat(F.lit("about "), F.col("base_peak_mz").cast("int").cast("string"), F.when(F.col("peak_id") % 2 == 0, F.lit(" to 900")).otherwise(""))
    out = rules.standardize_measurements(table(spark, d, "standard_data").select("peak_id", "base_peak_mz"), props, F.col("base_peak_mz"), units, text)
    return out.drop("base_peak_mz").withColumn("standard_value", F.round("standard_value", 6))


def hazard_classes(spark, d):
    code = F.concat(F.lit("H"), (F.lit(200) + F.col("peak_id") % 240).cast("string"))
    return table(spark, d, "standard_data").select("peak_id", rules.hazard_category(code, F.col("compound_name")).alias("category"), rules.hazard_group(code, F.col("compound_name")).alias("hazard_group"))


def activity_texts(spark, d):
    doc = table(spark, d, "documents").filter("text is not null")
    return doc.select("doc_id", rules.activity_direction(F.col("text")).alias("direction"), rules.bioactivity_domain(F.col("text"), F.lit(None), F.lit(None)).alias("domain"), rules.found_terms(F.col("text"), rules.TARGET_ORGANS).alias("organs"))


def name_resolution(spark, d):
    known = table(spark, d, "plant_compounds").select(F.col("compound_name").alias("known_name"), label(F.col("compound_id")).alias("compound_id"))
    return extract.resolve_names(table(spark, d, "standard_data").filter("compound_name is not null"), "compound_name", known)


def table_issues(spark, d):
    return Q.table_issues(table(spark, d, "plant_compounds"), Q.OCCURRENCE_RULES)


def table_quality(spark, d):
    return Q.table_quality(table(spark, d, "plant_compounds"), Q.OCCURRENCE_RULES)


def duplicate_rows(spark, d):
    return Q.duplicate_rows(table(spark, d, "plant_compounds"), ["species", "compound_id", "source_record_id"])


def source_diagnostics(spark, d):
    return Q.source_diagnostics(table(spark, d, "plant_compounds"), "source_database", "species")


def identity_audit(spark, d):
    return Q.identity_audit(table(spark, d, "plant_compounds"))


def data_dictionary(spark, d):
    return Q.data_dictionary(spark, "plant_compounds", Q.OCCURRENCE_RULES)


def combined_batches(spark, d):
    rows = table(spark, d, "plant_compounds")
    parts = [(s, rows.filter(F.upper(F.trim("source_database")) == s).select("occurrence_id", *(["smiles"] if i % 2 else ["inchikey"]))) for i, s in enumerate(RANK_SOURCES)]
    return Q.combine_batches(parts)


def batch_status(spark, d):
    return Q.batch_status(table(spark, d, "plant_compounds").filter("compound_id is not null"), "plant_part_group", "compound_id", "smiles", 0.97)


def table_signature(spark, d):
    return Q.table_signature(table(spark, d, "plant_compounds"))


def relative_abundance(spark, d):
    rows = table(spark, d, "standard_data").filter("compound_name is not null").select(F.split_part("file_name", F.lit("_"), F.lit(1)).alias("treatment"), F.col("compound_name").alias("compound"), F.col("component_area").alias("abundance"))
    out = O.relative_abundance(rows, 0.002)
    return out.select("treatment", "compound", F.round("abundance", 4).alias("abundance"), F.round("relative_abundance", 8).alias("relative_abundance"))


def olfaction_long(spark, d):
    peaks = table(spark, d, "standard_data").select("peak_id", *[F.when(F.split_part("file_name", F.lit("_"), F.lit(1)) == k, F.struct("compound_name", "component_area")).alias(k) for k in ("Mix", "Extract")])
    identity = peaks.select("peak_id", F.col("Mix.compound_name").alias("Mix"), F.col("Extract.compound_name").alias("Extract"))
    quantity = peaks.select("peak_id", F.col("Mix.component_area").alias("Mix"), F.col("Extract.component_area").alias("Extract"))
    return O.long_profile(identity, quantity, "peak_id", ["Mix", "Extract"])


def flat_records(spark, d):
    """Tagged flat records written out of the library and parsed back."""
    lib = table(spark, d, "chemical_library")
    text = F.concat(F.lit("ENTRY       C"), F.lpad(F.col("library_id").cast("string"), 5, "0"), F.lit("\nNAME        "), "compound", F.coalesce(F.concat(F.lit(";\n            "), F.regexp_replace("also_called", "; ", ";\n            ")), F.lit("")), F.lit("\nCLASS       "), F.coalesce("compound_type", F.lit("none")), F.lit("\n///"))
    return R.flat_record_fields(lib.select(F.col("library_id").alias("record_id"), text.alias("body")), "record_id", "body")


def json_values(spark, d):
    return R.json_scalars(table(spark, d, "events"), "event_id", "props")


QUERIES = {
    f.__name__: f
    for f in (
        provider_index, index_lookup, index_occurrences, query_accounting, taxon_names, species_aliases, bind_unique, coalesced_queries, deduped_profile, name_matches, assay_selection, bioactivity_summary,
        target_summary, potency_buckets, occurrence_summary, class_levels, derived_groups, library_flags, text_identifiers, text_measurements, document_fields, toxicity_figures, measurements_standard, hazard_classes, activity_texts,
        name_resolution, table_issues, table_quality, duplicate_rows, source_diagnostics, identity_audit, data_dictionary, combined_batches, batch_status, table_signature, relative_abundance, olfaction_long,
        flat_records, json_values,
    )
}

from florilege.queries.evidence import non  # noqa: E402
from florilege.queries.gcms import _MASS  # noqa: E402
from florilege.queries.problems import words_sql  # noqa: E402

_W = words_sql("species")
_IX = f"""WITH co AS (SELECT compound_id, min({non("compound_name_clean")}) AS name, min({non("inchikey")}) AS inchikey FROM plant_compounds WHERE compound_id IS NOT NULL GROUP BY 1),
tx AS (SELECT {_W} AS species_key, min({non("genus")}) AS genus, min({non("family")}) AS family FROM plant_metadata WHERE {_W} <> '' GROUP BY 1),
j AS (SELECT source_record_id AS record_id, p.species_key, p.compound_id, co.name, co.inchikey, upper(trim(source_database)) AS source, coalesce(lower(genus), split_part(p.species_key, ' ', 1)) AS g, lower(family) AS f
  FROM (SELECT *, {_W} AS species_key FROM plant_compounds WHERE compound_id IS NOT NULL AND {_W} <> '') p LEFT JOIN co USING (compound_id) LEFT JOIN tx USING (species_key)),
ix AS (SELECT DISTINCT ON (key_type, key, record_id, compound_id, source) * FROM (SELECT 'species' AS key_type, species_key AS key, record_id, species_key, compound_id, name, inchikey, source FROM j UNION ALL SELECT 'genus', g, record_id, species_key, compound_id, name, inchikey, source FROM j
  UNION ALL SELECT 'family', f, record_id, species_key, compound_id, name, inchikey, source FROM j) WHERE key IS NOT NULL)"""


def _lookup(ranks: tuple[str, ...], limit: int | None) -> str:
    key = {"species": "own", "genus": f"coalesce(lower({non('genus')}), split_part(own, ' ', 1))", "family": f"lower({non('family')})"}
    asked = " UNION ALL ".join(f"SELECT metadata_id AS plant_id, own, '{r}' AS key_type, {key[r]} AS key, {('species', 'genus', 'family').index(r)} AS o FROM pl" for r in ranks)
    cut = f" QUALIFY row_number() OVER (PARTITION BY plant_id ORDER BY o, name, record_id, compound_id, species_key, source) <= {limit}" if limit else ""
    return f""", pl AS (SELECT *, {_W} AS own FROM plant_metadata), asked AS ({asked}),
mt AS (SELECT plant_id, record_id, compound_id, species_key, source, min(o) AS o, min(name) AS name FROM asked JOIN ix USING (key_type, key) WHERE key <> '' AND (key_type = 'species' OR species_key <> own) GROUP BY ALL),
lk AS (SELECT plant_id, ['species', 'genus', 'family'][o + 1] AS matched_rank, record_id, compound_id, species_key, name, source FROM mt{cut})"""


_EV = "ev AS (SELECT user_id AS query, event_id AS assay, CASE event_type WHEN 'click' THEN 'active' WHEN 'error' THEN 'inactive' ELSE 'inconclusive' END AS ac, CASE WHEN value > 5 THEN value END AS value, event_type = 'view' AS nm, CASE WHEN event_type <> 'signup' THEN event_type END AS target FROM events)"
_OUT = ", ".join(f"count(*) FILTER (ac = '{c}') AS n_{c}" for c in ("active", "inactive", "inconclusive"))
_FIRST = "array_to_string(list_distinct(list({0} ORDER BY occurrence_id) FILTER ({0} IS NOT NULL)), '; ')"


def _first_seen(c: str) -> str:
    """Distinct values in first-seen order: the minimum id of each value orders them."""
    return f"(SELECT k1, k2, string_agg(v, '; ' ORDER BY o) AS {c} FROM (SELECT {_K1} AS k1, {_K2} AS k2, {non(c)} AS v, min(occurrence_id) AS o FROM plant_compounds WHERE {non(c)} IS NOT NULL GROUP BY ALL) GROUP BY 1, 2)"


_K1, _K2 = f"coalesce({non('compound_id')}, CASE WHEN compound_id IS NULL THEN '<NA>' ELSE '' END)", f"coalesce({non('inchikey')}, CASE WHEN inchikey IS NULL THEN '<NA>' ELSE '' END)"
_MATCH = "CASE WHEN list_contains(p, query) THEN 0 WHEN len(list_filter(p, lambda x: starts_with(x, query))) > 0 THEN 1 WHEN len(list_filter(p, lambda x: contains(x, query))) > 0 THEN 2 ELSE 3 END"
_IDS = {
    "DOI": "10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+\\b",
}
_HAZ = "200 + peak_id % 240"


def _case(column: str, rules_: tuple) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{v}'" for p, v in rules_) + " END"


_ORGANS = "concat_ws('; ', " + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{o}\\b') THEN '{o}' END" for o in rules.TARGET_ORGANS) + ")"
_DOMAIN = "CASE WHEN " + non("text") + " IS NOT NULL THEN coalesce(" + _case("text", rules.DOMAIN_RULES[:5]) + ", CASE WHEN regexp_matches(text, '(?i)inflamm|cox|prostaglandin') THEN 'inflammation' ELSE 'general_bioassay' END) END"
_ALLOWED = {"confidence": ("high", "medium", "low"), "comparable_for_matrix": ("Yes", "No"), "matched_rank": ("species", "genus", "family")}
_REQUIRED = ("occurrence_id", "species", "compound_name", "compound_id", "source_database")
_ISSUES = [f"SELECT '{c}' AS column_name, 'blank_required' AS issue, count(*) FILTER ({non(c + '::VARCHAR')} IS NULL) AS n_rows FROM plant_compounds" for c in _REQUIRED] + [
    f"SELECT '{c}', 'bad_value', count(*) FILTER ({non(c)} NOT IN {v}) FROM plant_compounds" for c, v in _ALLOWED.items()
]
_KNOWN = "coalesce(lower(trim(regexp_replace({0}::VARCHAR, '[\\s\\pZ]+', ' ', 'g'))) NOT IN ('', 'unknown', 'unspecified', 'not_reported', 'not reported', 'na', 'none'), false)"
_ISSUE = f"CASE WHEN {_KNOWN.format('inchikey')} OR {_KNOWN.format('cid')} THEN 'resolved' WHEN {_KNOWN.format('smiles')} THEN 'structure_only' WHEN {_KNOWN.format('compound_id')} THEN 'identifier_only' ELSE 'unresolved' END"
_RISK = (
    ("ambiguity", "issue <> 'resolved' OR regexp_matches(t, 'ambiguous|multiple|mixture|isomer')"), ("salt_hydrate", "regexp_matches(t, 'salt|hydrate|hydrochloride|sodium|potassium')"),
    ("stereochemistry_unspecified", _KNOWN.format("smiles") + " AND NOT coalesce(regexp_matches(smiles, '@|/|\\\\'), false) AND regexp_matches(t, 'stereo|isomer|alpha|beta|gamma|delta')"),
    ("mixture_common_name", "regexp_matches(t, 'mixture|extract|fraction|isomers|derivatives')"), ("synonym_only_match", "contains(t, 'synonym')"), ("alias_derived_match", "regexp_matches(t, 'alias|transliter')"), ("multiple_candidate", "regexp_matches(t, 'multiple|ambiguous')"),
)
_RISKS = "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RISK) + ")"
_METHOD = f"CASE WHEN {non('inchikey')} IS NOT NULL THEN 'inchikey' WHEN cid IS NOT NULL THEN 'cid' WHEN {non('smiles')} IS NOT NULL THEN 'smiles' ELSE 'name_only' END"

_CLEANED = "SELECT *, regexp_replace(replace(trim(regexp_replace(regexp_replace(species, '[_''\"“”\\[\\]()<>*!?;,]+', ' ', 'g'), '[\\s\\pZ]+', ' ', 'g')), '×', ' x '), '\\s+', ' ', 'g') AS s FROM {0}"
_GENUS = "regexp_extract(s, '^([A-Za-z]+(?:-[a-z]+)?)', 1)"
_REST, _INFRA = "regexp_extract(s, '(?i)^[A-Za-z-]+ (?:x )?([a-z][a-z-]+)', 1)", "lower(regexp_extract(s, '(?i)\\b((?:subsp|ssp|var|f)\\.? [a-z-]+)', 1))"
_CORE = f"CASE WHEN {_GENUS} <> '' THEN upper({_GENUS}[1]) || lower({_GENUS}[2:]) || CASE WHEN regexp_matches(s, '(?i)^[A-Za-z-]+ x ') THEN ' x' ELSE '' END || CASE WHEN {_REST} <> '' THEN ' ' || lower({_REST}) ELSE '' END || CASE WHEN {_INFRA} <> '' THEN ' ' || {_INFRA} ELSE '' END END"


def _greek(c: str) -> str:
    for letter, name in GREEK.items():
        c = f"replace({c}, '{letter}', '{name}')"
    return c


ORACLES = {
    "index_lookup": _IX + _lookup(("species", "genus", "family"), 10) + " SELECT * FROM lk",
    "provider_index": _IX + " SELECT * FROM ix",
    "index_occurrences": _IX + _lookup(("species", "genus"), None) + " SELECT plant_id, record_id, compound_id, matched_rank, CASE matched_rank WHEN 'species' THEN 'high' ELSE 'medium' END AS confidence, CASE matched_rank WHEN 'species' THEN 'direct_species_database' ELSE matched_rank || '_database_fallback' END AS evidence_tier FROM lk",
    "query_accounting": _IX + _lookup(("species", "genus"), None) + f", c AS (SELECT plant_id, source, count(*) FILTER (matched_rank = 'species') AS n_direct, count(*) FILTER (matched_rank <> 'species') AS n_fallback FROM lk GROUP BY 1, 2) SELECT plant_id, source, coalesce(n_direct, 0) AS n_direct, coalesce(n_fallback, 0) AS n_fallback, CASE WHEN n_direct > 0 THEN 'records' WHEN n_fallback > 0 THEN 'fallback_only' ELSE 'no_records' END AS status FROM (SELECT DISTINCT metadata_id AS plant_id, unnest({RANK_SOURCES}) AS source FROM plant_metadata) LEFT JOIN c USING (plant_id, source)",
    "bind_unique": f"WITH a AS (SELECT {_W} AS k, min(lower(genus)) AS genus FROM plant_metadata WHERE genus IS NOT NULL GROUP BY 1), b AS (SELECT {_W} AS k, min(list_id) AS list_id FROM plant_list GROUP BY 1) SELECT k, genus, NULL::BIGINT AS list_id FROM a UNION ALL SELECT k, NULL, list_id FROM b WHERE k NOT IN (SELECT k FROM a)",
    "coalesced_queries": f"SELECT {_W} AS k, min(metadata_id) AS query_id, arg_min({non('genus')}, metadata_id) AS genus, arg_min({non('family')}, metadata_id) AS family, count(*) AS n_queries FROM plant_metadata GROUP BY 1",
    "deduped_profile": f"SELECT b.k1 AS compound_id, b.k2 AS inchikey, n_rows, plant_part_group, method_group, is_comparable, smiles, curation_flag FROM (SELECT {_K1} AS k1, {_K2} AS k2, count(*) AS n_rows, bool_or(coalesce(comparable_for_matrix = 'Yes', false)) AS is_comparable, arg_min({non('smiles')}, occurrence_id) AS smiles, arg_min({non('curation_flag')}, occurrence_id) AS curation_flag FROM plant_compounds GROUP BY 1, 2) b LEFT JOIN {_first_seen('plant_part_group')} USING (k1, k2) LEFT JOIN {_first_seen('method_group')} USING (k1, k2)",
    "name_matches": f"""WITH l AS (SELECT library_id, CASE WHEN starts_with(compound_type, 'class') THEN 0 ELSE 1 END AS r, list_filter(list_transform(string_split(concat_ws(';', compound, also_called), ';'), lambda x: lower(trim(x))), lambda x: x <> '') AS p FROM chemical_library),
q AS (SELECT DISTINCT lower(compound_name) AS raw, trim(regexp_replace(lower(compound_name), '[\\s\\pZ]+', ' ', 'g')) AS query FROM standard_data WHERE compound_name IS NOT NULL),
qw AS (SELECT raw, query, list_distinct(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{Nd}}]+'), lambda w: len(w) >= 3)) AS w FROM q WHERE query <> ''),
lw AS (SELECT library_id, r, p, list_distinct(regexp_extract_all(array_to_string(p, ' '), '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM l),
o AS (SELECT x, count(DISTINCT library_id) AS n FROM (SELECT library_id, unnest(w) AS x FROM lw) GROUP BY x),
rw AS (SELECT raw, arg_min(x, ROW(n, x)) AS x FROM (SELECT raw, unnest(w) AS x FROM qw) JOIN o USING (x) GROUP BY raw),
s AS (SELECT raw, library_id, r, {_MATCH} AS score FROM qw LEFT JOIN rw USING (raw) CROSS JOIN lw WHERE len(list_filter(p, lambda x: contains(x, query))) > 0 OR list_contains(lw.w, rw.x))
SELECT raw AS query, library_id, score, row_number() OVER (PARTITION BY raw ORDER BY score, r, library_id) AS match_rank FROM s QUALIFY match_rank <= 3""",
    "assay_selection": f"WITH {_EV}, o AS (SELECT query, assay, min(CASE WHEN ac = 'active' THEN 1 WHEN value IS NOT NULL THEN 2 WHEN target IS NOT NULL THEN 3 ELSE 5 END) AS priority FROM ev GROUP BY 1, 2) SELECT query, assay, priority, row_number() OVER (PARTITION BY query ORDER BY priority, assay) AS place FROM o QUALIFY place <= 5",
    "bioactivity_summary": f"WITH {_EV}, v AS (SELECT *, CASE WHEN NOT nm THEN value END AS um FROM ev) SELECT query, count(*) AS n_assays, {_OUT}, count(DISTINCT target) AS n_targets, count(DISTINCT CASE WHEN ac = 'active' THEN target END) AS n_active_targets, min(um) AS min_potency_um, round(quantile_cont(um, 0.5), 6) AS median_potency_um, count(*) FILTER (um <= 10) AS n_potent FROM v GROUP BY query",
    "target_summary": f"WITH {_EV} SELECT query, target, count(DISTINCT assay) AS n_assays, {_OUT} FROM ev GROUP BY query, target",
    "potency_buckets": f"WITH {_EV} SELECT assay, CASE WHEN value IS NULL THEN NULL WHEN nm THEN 'numeric_activity_value' WHEN value <= 0.1 THEN 'sub_100_nM' WHEN value <= 1 THEN 'sub_1_uM' WHEN value <= 10 THEN '1_to_10_uM' WHEN value <= 50 THEN '10_to_50_uM' ELSE 'above_50_uM' END AS bucket FROM ev",
    "occurrence_summary": f"WITH t AS (SELECT {_W} AS k, min(genus) AS genus, min(family) AS family FROM plant_metadata GROUP BY 1), s AS (SELECT compound_id, count(*) AS n_occurrences, count(DISTINCT nullif(k, '')) AS n_organisms, 1::BIGINT AS n_kingdoms, count(DISTINCT {non('family')}) AS n_families, count(DISTINCT {non('genus')}) AS n_genera, nullif(string_agg(DISTINCT {non('family')}, '; ' ORDER BY {non('family')}), '') AS families, true AS in_plants FROM (SELECT compound_id, {_W} AS k FROM plant_compounds WHERE compound_id IS NOT NULL) LEFT JOIN t USING (k) GROUP BY 1) SELECT *, CASE WHEN n_organisms < 1 THEN 'none' WHEN n_families > 1 THEN 'multi_family' WHEN n_genera > 1 THEN 'multi_genus' WHEN n_organisms > 1 THEN 'multi_species_same_genus' ELSE 'single_organism' END AS breadth FROM s",
    "class_levels": "SELECT compound_id, " + ", ".join(f"string_agg(DISTINCT {non(c)}, '; ' ORDER BY {non(c)}) AS {c}" for c in ("comparison_scope", "comparison_group", "comparison_subgroup")) + " FROM plant_compounds GROUP BY 1",
    "derived_groups": f"SELECT *, CASE WHEN mass < 150 THEN 'small_<150_Da' WHEN mass < 350 THEN 'medium_150_350_Da' WHEN mass < 750 THEN 'large_350_750_Da' WHEN mass >= 750 THEN 'very_large_>=750_Da' END AS mw_bin FROM (SELECT compound_id, count(*) AS n_records, count(DISTINCT {non('source_database')}) AS n_sources, count(DISTINCT {non('species')}) AS n_species, min({_MASS}) AS mass, bool_or(coalesce(regexp_matches(molecular_formula, '(N)([0-9]|$)'), false)) AS nitrogenous, bool_or(coalesce(regexp_matches(molecular_formula, '(O)([0-9]|$)'), false)) AS oxygenated, bool_or(coalesce(contains(lower(citation_or_url), '/doc/'), false)) AS has_literature, string_agg(DISTINCT {non('plant_part_group')}, '; ' ORDER BY {non('plant_part_group')}) AS plant_parts FROM plant_compounds WHERE compound_id IS NOT NULL GROUP BY 1)",
    "library_flags": "SELECT compound_id_a AS compound, species_b AS library_group, max(tanimoto) AS best_similarity, CASE WHEN max(tanimoto) > 0.95 THEN 'Yes' WHEN bool_or(tanimoto > 0.85 AND tanimoto < 0.95) THEN '~' ELSE 'No' END AS flag, CASE WHEN max(tanimoto) > 0.95 THEN arg_max(compound_id_b, ROW(tanimoto, compound_id_b)) END AS best_match FROM plant_compound_pair_tanimoto WHERE tanimoto IS NOT NULL GROUP BY 1, 2",
    "toxicity_figures": "SELECT peak_id, 'LD50' AS metric, base_peak_mz AS value, 'mg/kg' AS unit, 1::BIGINT AS n FROM standard_data WHERE base_peak_mz IS NOT NULL AND component_area IS NOT NULL UNION ALL SELECT peak_id, 'EC50', trunc(component_area)::DOUBLE, 'mg/L', 1 FROM standard_data WHERE base_peak_mz IS NOT NULL AND component_area IS NOT NULL",
    "hazard_classes": f"SELECT peak_id, coalesce(CASE WHEN {_HAZ} < 300 THEN 'physical_hazard' WHEN {_HAZ} < 400 THEN 'health_hazard' ELSE 'environmental_hazard' END, {_case('compound_name', rules.HAZARD_TEXT_RULES)}) AS category, coalesce(CASE WHEN {_HAZ} IN (318, 319) THEN 'eye_damage_irritation' WHEN {_HAZ} IN (315, 317) THEN 'skin_irritation_sensitization' WHEN ({_HAZ}) // 10 IN (30, 31, 33) THEN 'acute_toxicity' WHEN ({_HAZ}) // 10 BETWEEN 22 AND 27 THEN 'flammability_reactivity' WHEN {_HAZ} >= 400 THEN 'aquatic_environmental_toxicity' END, {_case('compound_name', rules.HAZARD_GROUP_TEXT_RULES)}) AS hazard_group FROM standard_data",
    "activity_texts": f"SELECT doc_id, {_case('text', rules.DIRECTION_RULES)} AS direction, {_DOMAIN} AS domain, nullif({_ORGANS}, '') AS organs FROM documents WHERE text IS NOT NULL",
    "table_issues": "SELECT * FROM (" + " UNION ALL ".join(_ISSUES) + ") WHERE n_rows > 0",
    "table_quality": "SELECT n AS n_rows, 27 AS n_columns, round(f / (n * 5), 3) AS completeness, CASE WHEN n = 0 THEN 'empty' WHEN f / (n * 5) < 0.9 THEN 'incomplete' ELSE 'ok' END AS status FROM (SELECT count(*) AS n, " + " + ".join(f"count({non(c + '::VARCHAR')})" for c in _REQUIRED) + " AS f FROM plant_compounds)",
    "duplicate_rows": f"SELECT count(*) AS n_keys, coalesce(sum(n - 1), 0)::BIGINT AS n_duplicates FROM (SELECT species, compound_id, source_record_id, count(*) AS n FROM plant_compounds WHERE {non('species')} IS NOT NULL AND {non('compound_id')} IS NOT NULL AND {non('source_record_id')} IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1)",
    "source_diagnostics": f"SELECT *, coalesce({_case('source', Q.SOURCE_GROUPS)}, 'other') AS source_group FROM (SELECT species AS query, upper(trim(source_database)) AS source, count(*) AS n_rows, count({non('compound_id')}) AS n_identified FROM plant_compounds GROUP BY 1, 2)",
    "identity_audit": f"WITH i AS (SELECT *, {_ISSUE} AS issue, lower(coalesce({non('compound_name')}, '') || ' ' || coalesce({non('curation_flag')}, '')) AS t FROM plant_compounds) SELECT occurrence_id, {_METHOD} AS method, issue, {_RISKS} AS risks, CASE WHEN {_METHOD} IN ('inchikey', 'cid') AND {_RISKS} = '' THEN 'high' WHEN {_METHOD} <> 'name_only' THEN 'medium' ELSE 'low' END AS identity_confidence FROM i",
    "taxon_names": f"WITH c AS (SELECT list_id, species, {_CORE} AS core_name FROM ({_CLEANED.format('plant_list')})) SELECT list_id, core_name, CASE WHEN {non('species')} IS NULL OR core_name IS NULL THEN 'blank' WHEN NOT contains(core_name, ' ') OR regexp_matches(lower({non('species')}), '\\bspp?\\.?$') THEN 'name_needs_review' ELSE 'parsed_species' END AS status FROM c",
    "species_aliases": f"WITH k AS (SELECT {_W} AS species_key, unnest(['accepted_name', 'typed_name', 'core_name']) AS alias_type, unnest([1, 2, 3]) AS o, unnest([{non('accepted_species_name')}, {non('species')}, {_CORE}]) AS alias FROM ({_CLEANED.format('plant_metadata')})) SELECT species_key, alias, arg_min(alias_type, o) AS alias_type FROM k WHERE species_key <> '' AND alias IS NOT NULL GROUP BY 1, 2",
    "data_dictionary": "SELECT 'plant_compounds' AS table_name, * FROM (VALUES ('occurrence_id', 'integer', true, ''), ('species', 'character', true, ''), ('compound_name', 'character', true, ''), ('compound_id', 'character', true, ''), ('source_database', 'character', true, ''), ('cid', 'integer', false, ''), ('confidence', 'character', false, 'high; medium; low'), ('comparable_for_matrix', 'character', false, 'Yes; No'), ('matched_rank', 'character', false, 'species; genus; family')) v(column_name, kind, required, allowed)",
    "name_resolution": f"""WITH kn AS (SELECT lower(compound_name) AS alias, min(nullif(lower(trim(compound_id)), '')) AS id FROM plant_compounds WHERE compound_name IS NOT NULL AND trim(compound_id) <> '' GROUP BY 1),
q AS (SELECT DISTINCT compound_name, {non("compound_name")} AS s FROM standard_data WHERE compound_name IS NOT NULL),
f AS (SELECT compound_name, list_filter([s, trim(regexp_replace(regexp_replace(compound_name, '[^A-Za-z0-9]+', ' ', 'g'), ' +', ' ', 'g')), {_greek("replace(s, '±', '+-')")}, trim(regexp_replace(regexp_replace(compound_name, '[<>]', '', 'g'), '[\\s\\pZ]+', ' ', 'g'))], lambda x: x IS NOT NULL AND x <> '') AS l FROM q),
g AS (SELECT compound_name, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM f),
p AS (SELECT compound_name, lower(unnest(l)) AS alias, generate_subscripts(l, 1) - 1 AS place FROM g),
b AS (SELECT compound_name, min(ROW(place, id)) AS b FROM p JOIN kn USING (alias) GROUP BY 1)
SELECT compound_name, b[2] AS compound_id, CASE WHEN b IS NULL THEN 'not_found' WHEN b[1] = 0 THEN 'name' ELSE 'alias_' || b[1] END AS match_status FROM q LEFT JOIN b USING (compound_name)""",
    "combined_batches": " UNION ALL ".join(f"SELECT occurrence_id, {'NULL AS inchikey, smiles' if i % 2 else 'inchikey, NULL AS smiles'}, '{s}' AS batch_name, {i + 1} AS batch_index FROM plant_compounds WHERE upper(trim(source_database)) = '{s}'" for i, s in enumerate(RANK_SOURCES)),
    "batch_status": f"SELECT *, CASE WHEN ratio < 0.97 THEN 'incomplete' ELSE 'ok' END AS status FROM (SELECT plant_part_group, count(DISTINCT compound_id) AS n_queries, count(DISTINCT CASE WHEN {non('smiles')} IS NOT NULL THEN compound_id END) AS n_with_property, round(count(DISTINCT CASE WHEN {non('smiles')} IS NOT NULL THEN compound_id END) / count(DISTINCT compound_id), 4) AS ratio FROM plant_compounds WHERE compound_id IS NOT NULL GROUP BY 1)",
    "relative_abundance": "WITH s AS (SELECT split_part(file_name, '_', 1) AS treatment, compound_name AS compound, sum(component_area) AS abundance FROM standard_data WHERE compound_name IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, abundance / sum(abundance) OVER (PARTITION BY treatment) AS share FROM s), l AS (SELECT * FROM k WHERE share >= 0.002) SELECT treatment, compound, round(abundance, 4) AS abundance, round(abundance / sum(abundance) OVER (PARTITION BY treatment), 8) AS relative_abundance FROM l",
    "olfaction_long": f"SELECT split_part(file_name, '_', 1) AS treatment, peak_id, {non('compound_name')} AS compound, component_area AS abundance FROM standard_data WHERE split_part(file_name, '_', 1) IN ('Mix', 'Extract') AND {non('compound_name')} IS NOT NULL AND component_area IS NOT NULL",
    "flat_records": "WITH n AS (SELECT library_id AS record_id, unnest(list_concat([compound], string_split(coalesce(also_called, ''), ';'))) AS v, generate_subscripts(list_concat([compound], string_split(coalesce(also_called, ''), ';')), 1) AS p FROM chemical_library) SELECT library_id AS record_id, 'ENTRY' AS field, 1 AS place, 'C' || lpad(library_id::VARCHAR, 5, '0') AS value FROM chemical_library UNION ALL SELECT record_id, 'NAME', p, trim(v) FROM n WHERE trim(v) <> '' UNION ALL SELECT library_id, 'CLASS', 1, coalesce(compound_type, 'none') FROM chemical_library",
    "text_identifiers": """WITH t AS (SELECT occurrence_id, concat_ws(' ', compound_name, inchikey, citation_or_url, source_record_id, 'CHEBI: ' || cid, 'PMID ' || occurrence_id) AS x FROM plant_compounds),
i AS (SELECT occurrence_id, 'CAS' AS identifier_type, unnest(regexp_extract_all(x, '\\b[0-9]{2,7}-[0-9]{2}-[0-9]\\b')) AS identifier FROM t UNION ALL SELECT occurrence_id, 'KEGG', unnest(regexp_extract_all(x, '\\b[CDGMR]\\d{5}\\b')) FROM t
UNION ALL SELECT occurrence_id, 'EC', unnest(regexp_extract_all(x, '\\b[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9A-Za-z-]+\\b')) FROM t UNION ALL SELECT occurrence_id, 'ChEBI', 'CHEBI:' || unnest(regexp_extract_all(x, '\\b(?:CHEBI|ChEBI):\\s*(\\d+)\\b', 1)) FROM t
UNION ALL SELECT occurrence_id, 'PubMed', 'PMID:' || unnest(regexp_extract_all(x, '\\b(?:PMID|PubMed):?\\s*(\\d+)\\b', 1)) FROM t UNION ALL SELECT occurrence_id, 'DOI', unnest(regexp_extract_all(x, '\\b10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+\\b')) FROM t
UNION ALL SELECT occurrence_id, 'UNII', unnest(regexp_extract_all(x, '\\b[A-Z0-9]{10}\\b')) FROM t UNION ALL SELECT occurrence_id, 'GHS', unnest(regexp_extract_all(x, '\\bH[0-9]{3}[A-Za-z]?\\b|\\bP[0-9]{3}[A-Za-z]?\\b')) FROM t)
SELECT DISTINCT * FROM i""",
    "text_measurements": """WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '[.!?][ \\t\\n\\x0B\\f\\r]+', chr(1), 'g'), chr(1)) AS ss FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, (generate_subscripts(ss, 1) - 1)::INT AS sentence_no, unnest(ss) AS t FROM s),
m AS (SELECT *, trim(regexp_replace(t, '[\\s\\pZ]+', ' ', 'g')) AS q FROM e), v AS (SELECT *, TRY_CAST(nullif(regexp_extract(q, '[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?'), '') AS DOUBLE) AS value, nullif(trim(regexp_extract(q, '[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?\\s*([^,;|()]*)', 1)), '') AS unit FROM m)
SELECT doc_id, sentence_no, value, unit, CASE WHEN regexp_matches(t, '(?i)[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?\\s*(?:-|to)\\s*[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?') THEN 'range' WHEN regexp_matches(t, '<=|≤') THEN 'less_or_equal' WHEN regexp_matches(t, '>=|≥') THEN 'greater_or_equal' WHEN contains(t, '<') THEN 'less_than' WHEN contains(t, '>') THEN 'greater_than' WHEN regexp_matches(lower(t), '~|approx|about|ca\\.') THEN 'approximate' ELSE 'equal' END AS relation FROM v WHERE value IS NOT NULL""",
    "measurements_standard": """WITH c(k, property, unit, f, o, standard_unit, kind) AS (VALUES (0, 'boiling_point', 'F', 0.0::DOUBLE, 0.0::DOUBLE, 'C', 'temperature'), (1, 'melting_point', 'K', 1, -273.15, 'C', 'temperature'), (2, 'flash_point', 'C', 1, 0, 'C', 'temperature'), (3, 'density', 'g/mL', 1, 0, 'g/mL', 'density'),
  (4, 'density', 'kg/m3', 0.001, 0, 'g/mL', 'density'), (5, 'solubility', 'g/L', 1000, 0, 'mg/L', 'solubility'), (6, 'vapor_pressure', 'mmHg', 133.322, 0, 'Pa', 'vapor_pressure'), (7, 'vapor_pressure', 'kPa', 1000, 0, 'Pa', 'vapor_pressure'), (8, 'ld50', 'ug/kg', 0.001, 0, 'mg/kg', 'toxicity')),
v AS (SELECT peak_id, c.*, base_peak_mz AS m, CASE WHEN k = 0 THEN round((base_peak_mz - 32) * 5 / 9, 4) WHEN k = 1 THEN round(base_peak_mz - 273.15, 4) ELSE base_peak_mz * f END AS x FROM standard_data JOIN c ON k = peak_id % 9)
SELECT peak_id, property, unit, round(x, 6) AS standard_value, standard_unit, kind, CASE property
  WHEN 'boiling_point' THEN CASE WHEN x < 100 THEN 'highly_volatile_boiling_point_lt_100_C' WHEN x < 200 THEN 'volatile_boiling_point_100_200_C' WHEN x < 300 THEN 'semi_volatile_boiling_point_200_300_C' ELSE 'low_volatility_boiling_point_ge_300_C' END
  WHEN 'melting_point' THEN CASE WHEN x < 25 THEN 'liquid_or_low_melting_lt_25_C' WHEN x < 100 THEN 'low_melting_25_100_C' WHEN x < 200 THEN 'moderate_melting_100_200_C' ELSE 'high_melting_ge_200_C' END
  WHEN 'flash_point' THEN CASE WHEN x < 23 THEN 'highly_flammable_flash_point_lt_23_C' WHEN x < 60 THEN 'flammable_flash_point_23_60_C' WHEN x < 93 THEN 'combustible_flash_point_60_93_C' ELSE 'higher_flash_point_ge_93_C' END
  WHEN 'density' THEN CASE WHEN x < 0.8 THEN 'low_density_lt_0_8_g_mL' WHEN x <= 1.2 THEN 'water_like_density_0_8_1_2_g_mL' ELSE 'high_density_gt_1_2_g_mL' END
  WHEN 'solubility' THEN CASE WHEN x < 10 THEN 'low_solubility_lt_10_mg_L' WHEN x < 1000 THEN 'moderate_solubility_10_1000_mg_L' ELSE 'high_solubility_ge_1000_mg_L' END
  WHEN 'vapor_pressure' THEN CASE WHEN x < 1 THEN 'low_vapor_pressure_lt_1_Pa' WHEN x < 1000 THEN 'moderate_vapor_pressure_1_1000_Pa' ELSE 'high_vapor_pressure_ge_1000_Pa' END
  WHEN 'ld50' THEN CASE WHEN x <= 50 THEN 'very_high_acute_toxicity_le_50_mg_kg' WHEN x <= 300 THEN 'high_acute_toxicity_50_300_mg_kg' WHEN x <= 2000 THEN 'moderate_acute_toxicity_300_2000_mg_kg' ELSE 'lower_acute_toxicity_gt_2000_mg_kg' END END AS bin,
  CASE WHEN peak_id % 2 = 0 THEN 'range' ELSE 'approximate' END AS relation, CASE WHEN peak_id % 2 = 0 THEN least(trunc(m), 900.0) END AS low, CASE WHEN peak_id % 2 = 0 THEN greatest(trunc(m), 900.0) END AS high FROM v""",
    "json_values": "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
}
