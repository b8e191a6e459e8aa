"""Normalized tables, record tables, identity review, context and grouping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions.rules import formula_mass, pathway_group
from florilege.operators import annotations as A
from florilege.operators import context as C
from florilege.operators import normalized as Z
from florilege.operators import providers as P
from florilege.operators import quality as Q
from florilege.operators import record_tables as K
from florilege.operators import similarity as S
from florilege.operators import traits as T
from florilege.session import stage, table
from florilege.sources import records as R


def _rows(spark, d):
    return table(spark, d, "plant_compounds").filter("compound_id is not null").withColumnRenamed("compound_id", "query")


def chemical_classes(spark, d):
    """Groups as reactive groups, subgroups as product classes, and scope, group and subgroup as class paths."""
    rows = _rows(spark, d)
    reactive = rows.select("query", "cid", F.col("comparison_group").alias("value"))
    natural = rows.select("query", "cid", F.col("source_record_id").alias("record"), F.col("comparison_subgroup").alias("product_classes"))
    paths = rows.select("query", "cid", F.col("occurrence_id").alias("hnid"), F.concat_ws(" > ", "comparison_scope", "comparison_group", "comparison_subgroup").alias("path"))
    return Z.chemical_classes(reactive=reactive, natural=natural, paths=paths)


def chemical_uses(spark, d):
    rows = _rows(spark, d)
    return Z.chemical_uses(flavours=rows.select("query", "cid", F.col("comparison_subgroup").alias("descriptors")), subjects=rows.select("query", "cid", F.concat_ws("; ", "comparison_group", "method_group").alias("actions")))


def chemical_bioassays(spark, d):
    """Events as assay rows, nations as the descriptions of the assays."""
    events = table(spark, d, "events")
    none = F.lit(None).cast("string")
    rows = events.select(
        F.col("user_id").alias("query"), none.alias("cid"), (F.col("event_id") % 40).alias("aid"), F.col("event_type").alias("assay_name"), F.when(F.col("event_type") == "click", "Active").when(F.col("event_type") == "view", "Inconclusive").alias("outcome"),
        F.lit("Potency").alias("activity_name"), F.col("value").cast("string").alias("value"), F.lit("uM").alias("unit"), F.when(F.col("event_type") == "signup", "P12345").alias("accession"), none.alias("gene"),
    )
    nations = table(spark, d, "nation")
    details = nations.select(F.col("n_nationkey").cast("bigint").alias("aid"), F.col("n_name").alias("targets"), F.lit("Q1").alias("accessions"), none.alias("genes"), F.lit("human").alias("organisms"), none.alias("common_names"), F.lit("IC50; Ki").alias("endpoints"), F.lit(2).alias("n_endpoints"))
    return Z.chemical_bioassays(rows, details)


def _taxonomy(spark, d):
    rows = _rows(spark, d)
    return Z.chemical_taxonomy(rows.select("query", "cid", F.col("species").alias("organism"), F.col("comparison_group").alias("product_classes"), F.upper(F.trim("source_database")).alias("source")))


def chemical_taxonomy(spark, d):
    return _taxonomy(spark, d)


def chemical_occurrences(spark, d):
    return Z.chemical_occurrences(_taxonomy(spark, d))


def chemical_hazards(spark, d):
    """Hazards that the annotations of compounds and the documents' texts name."""
    from florilege.queries.annotations import _annotations

    docs = table(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("query"), F.lit(None).cast("bigint").alias("cid"), "text")
    notes = _annotations(spark, d).select("query", "cid", F.concat_ws(" ", "heading", "value").alias("text"))
    return Z.chemical_hazards(notes.unionByName(docs))


def derived_profile(spark, d):
    """The 73 columns of every compound, out of its records, annotations and the assays that carry its number."""
    rows = _rows(spark, d)
    assays = chemical_bioassays(spark, d).withColumn("query", F.concat(F.lit("cid_"), (F.col("query") + 700000).cast("string"))).withColumn("bioactivity_domain", F.when(F.col("assay_name") == "click", "kinase_signaling"))
    mass = formula_mass(F.col("molecular_formula"))
    tables = {
        "properties": rows.select("query", "cid", "molecular_formula", mass.alias("molecular_weight"), mass.alias("exact_mass"), (mass / 5).alias("tpsa")), "coverage": rows.groupBy("query", F.upper(F.trim("source_database")).alias("source")).agg(F.count(F.lit(1)).alias("n_records")),
        "classes": chemical_classes(spark, d), "occurrences": chemical_occurrences(spark, d), "bioassays": assays, "uses": chemical_uses(spark, d), "hazards": chemical_hazards(spark, d),
        "pathways": rows.select("query", pathway_group(F.regexp_replace("comparison_subgroup", "_", " ")).alias("pathway_group")).distinct(), "literature": rows.filter("citation_or_url like '%/doc/%'").select("query"),
    }
    return Z.derived_profile(rows, {name: stage(df, name) for name, df in tables.items()})


def normalized_traits(spark, d):
    """Traits of seven tables."""
    rows = _rows(spark, d)
    taxonomy = stage(_taxonomy(spark, d), "taxonomy")
    tables = {
        "classes": chemical_classes(spark, d), "uses": chemical_uses(spark, d), "taxonomy": taxonomy, "occurrences": Z.chemical_occurrences(taxonomy),
        "measurements": rows.select("query", "cid", F.lit("exact_mass").alias("property"), formula_mass(F.col("molecular_formula")).alias("value"), F.lit("high").alias("confidence"), F.lit("formula").alias("extraction_rule")),
        "terms": A.terms([(rows.select("query", "comparison_subgroup"), "classification", ["comparison_subgroup"])]), "hazards": chemical_hazards(spark, d),
    }
    return T.dedupe_traits(T.build_traits(stage(Z.all_traits({name: stage(df, name) for name, df in tables.items()}), "trait-rows")))


def _records(spark, d):
    """Flat records written out of the library: (record, field, value), links and metadata."""
    lib = table(spark, d, "chemical_library").filter("compound is not null")
    n = F.lpad(F.col("library_id").cast("string"), 5, "0")
    line = lambda tag, *text: F.concat(F.rpad(F.lit(tag), 12, " "), *text, F.lit("\n"))
    i = F.col("library_id").cast("string")
    body = F.concat(
        line("ENTRY", F.lit("C"), n), line("REACTION", F.lit("R"), n, F.lit(" R9"), F.substring(n, 2, 4)), line("ENZYME", F.lit("1.1.1."), i, F.lit("  2.3.1.-")), line("MODULE", F.lit("M"), n, F.lit("  "), F.col("compound"), F.lit(" synthesis")),
        line("DBLINKS", F.lit("CAS: 50-"), F.substring(n, 4, 2), F.lit("-1")), line("", F.lit("PubChem: "), i, F.lit(" "), n), line("BRITE", F.coalesce("compound_type", F.lit("none")), F.lit(" [BR:08001]")), F.lit("///"),
    )
    records = R.flat_record_fields(lib.select(F.col("library_id").alias("record"), body.alias("body")), "record", "body")
    ident = F.concat(F.lit("R"), n)
    links = lib.filter("also_called is not null").select(F.col("library_id").alias("record"), F.lit("reaction").alias("target_db"), F.concat(F.lit("R8"), F.substring(n, 2, 4)).alias("target_id"))
    metadata = lib.filter("compound_type = 'class A'").select(F.lit("reaction").alias("db"), ident.alias("id"), F.concat("compound", F.lit(" reaction")).alias("name"), F.lit("water + 2 sugar <=> acid").alias("definition"), F.concat(F.lit("C"), n, F.lit(" + 2 C00001 <=> C90001")).alias("equation"))
    return stage(records, "records"), links, metadata


def record_identifiers(spark, d):
    return K.identifiers(_records(spark, d)[0])


def record_reactions(spark, d):
    return K.reactions(*_records(spark, d))


def record_enzymes(spark, d):
    return K.enzymes(*_records(spark, d))


def record_modules(spark, d):
    return K.modules(*_records(spark, d))


def record_classifications(spark, d):
    records, links, metadata = _records(spark, d)
    pathways = records.filter("field = 'MODULE'").select("record", F.lit("Secondary metabolism").alias("pathway_group"), F.col("value").alias("name"))
    return K.classifications(pathways, K.enzymes(records, links, metadata), records)


def record_participants(spark, d):
    return K.participants(K.reactions(*_records(spark, d)))


def _matches(spark, d):
    from florilege.queries.providers import name_matches

    kind = F.when(F.col("compound_type") == "class A", "compound").when(F.col("compound_type") == "class B", "drug").otherwise("other")
    lib = table(spark, d, "chemical_library").select("library_id", kind.alias("database"))
    return name_matches(spark, d).join(lib, "library_id").select("query", F.col("library_id").alias("entry_id"), "database", "score")


def search_candidates(spark, d):
    return K.search_candidates(_matches(spark, d), 2)


def entry_queries(spark, d):
    ids = table(spark, d, "chemical_library").select(F.col("library_id").alias("entry_id"))
    return K.entry_queries(ids, K.search_candidates(_matches(spark, d), 2).filter("match_rank is not null"), F.lit("(none)"))


def identity_review(spark, d):
    return Q.identity_review_table(table(spark, d, "plant_compounds"), True, 2).drop("decision", "reviewed_inchikey", "reviewer")


def identity_review_applied(spark, d):
    """Reviews made of checked records: each accepts the InChIKey it has."""
    rows = table(spark, d, "plant_compounds")
    review = rows.filter("curation_flag in ('checked', 'needs_review')").select("compound_name_clean", F.when(F.col("curation_flag") == "checked", "accept").otherwise("reject").alias("decision"), F.col("inchikey").alias("reviewed_inchikey"))
    return Q.apply_identity_review(rows, review).select("occurrence_id", "inchikey", "identity_decision")


def identity_audit_summary(spark, d):
    return Q.identity_audit_summary(Q.identity_audit(table(spark, d, "plant_compounds")))


def manifest_checks(spark, d):
    """Providers as stages of a run."""
    rows = table(spark, d, "provider_sources")
    return Q.manifest_checks(rows.select(F.col("source_database").alias("stage"), F.when(F.col("trust_rank") == 1, "complete").when(F.col("trust_rank") == 2, "odd").otherwise("partial").alias("status"), F.when(F.col("trust_rank") > 3, F.lit("x")).alias("path"), F.col("trust_rank").cast("bigint").alias("n_rows")))


def provider_diagnostics(spark, d):
    rows = table(spark, d, "plant_compounds").groupBy("source_database", "species").agg(F.count(F.col("inchikey")).alias("records"), F.max("curation_flag").alias("note"))
    return Q.standard_diagnostics(rows)


def _context_evidence(spark, d):
    rows = table(spark, d, "plant_compounds")
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("plant_part", "plant_part_group"), ("tissue", "tissue_group"), ("method", "method_group"))])).alias("p")
    return rows.select("species", F.col("compound_name").alias("compound"), F.col("source_record_id").alias("record"), "confidence", F.when(F.col("curation_flag") == "needs_review", "Yes").otherwise("No").alias("review"), F.col("curation_flag").alias("text"), F.col("matched_rank").alias("rule"), parts).select("species", "compound", "record", "p.kind", "p.value", "confidence", "review", "text", "rule")


def merged_context(spark, d):
    return C.merge_context(_context_evidence(spark, d))


def applied_context(spark, d):
    rows = table(spark, d, "plant_compounds").select("occurrence_id", "species", F.col("compound_name").alias("compound"), F.col("source_record_id").alias("record"), F.col("plant_part_group").alias("plant_part"), F.col("tissue_group").alias("tissue"), F.lit(None).cast("string").alias("method"))
    return C.apply_context(rows, stage(C.merge_context(_context_evidence(spark, d)), "context"))


def collapsed_membership(spark, d):
    return S.collapse_membership(table(spark, d, "plant_compounds"), "species")


def group_compound_pairs(spark, d):
    pairs = table(spark, d, "plant_compound_pair_tanimoto").filter("tanimoto >= 0.5").groupBy(F.least("compound_id_a", "compound_id_b").alias("a"), F.greatest("compound_id_a", "compound_id_b").alias("b")).agg(F.max("tanimoto").alias("tanimoto")).filter("a < b")
    return S.group_compound_pairs(pairs, table(spark, d, "plant_compounds").filter("compound_id is not null"), "plant_part_group")


def preparation_checks(spark, d):
    return S.preparation_checks(C.prepare_similarity_input(table(spark, d, "plant_compounds"), "species", ("reported", "inferred")), "species")


def provider_availability(spark, d):
    from florilege.queries.providers import _index

    return P.provider_availability(_index(spark, d), ["PHYDOREX", "HERBORUM", "NOWHERE"])


def provider_gate(spark, d):
    from florilege.queries.providers import query_accounting

    accounts = query_accounting(spark, d).withColumn("status", F.when(F.col("status") == "no_records", "failed").otherwise(F.col("status")))
    return P.provider_gate(accounts, table(spark, d, "plant_metadata").count(), 0.5)


def remapped_queries(spark, d):
    queries = table(spark, d, "plant_list").select(F.col("list_id").alias("query_id"), "species", F.lit(None).cast("string").alias("plant_name"))
    names = table(spark, d, "plant_metadata").select((F.col("metadata_id") + 100000).alias("query_id"), F.lit(None).cast("string").alias("species"), F.col("genus").alias("plant_name"))
    rows = table(spark, d, "plant_metadata").select("metadata_id", "species", F.col("genus").alias("plant_name"))
    return P.remap_queries(rows, queries.unionByName(names)).select("metadata_id", "query_id")


def scope_rollup(spark, d):
    return Q.grouped_counts(table(spark, d, "plant_compounds"), ["comparison_scope", "comparison_group"], "rollup")


def scope_cube(spark, d):
    return Q.grouped_counts(table(spark, d, "plant_compounds"), ["comparison_scope", "matched_rank"], "cube")


def monthly_records(spark, d):
    return Q.monthly_counts(table(spark, d, "plant_compounds"), "retrieved_at", "loaded_at")


def event_windows(spark, d):
    """Events per hour and kind, as the stream counts them."""
    from florilege.streaming.incremental import windowed_counts

    counts = windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


def sql_functions(spark, d):
    """The value rules as SQL functions, over the occurrence records."""
    from florilege.functions.sql import register

    register(spark)
    table(spark, d, "plant_compounds").createOrReplaceTempView("fl_occurrences")
    return spark.sql("SELECT fl_words_key(species) AS species_key, fl_slug(comparison_group) AS group_slug, count(*) AS n_rows, count_if(fl_known(tissue_group)) AS n_tissue, max(fl_confidence_rank(confidence)) AS best FROM fl_occurrences GROUP BY 1, 2")


def sql_terms(spark, d):
    """The other names of library entries, by the table function."""
    from florilege.functions.sql import register

    register(spark)
    table(spark, d, "chemical_library").createOrReplaceTempView("fl_library")
    return spark.sql("SELECT library_id, t.term FROM fl_library, LATERAL fl_terms(also_called) t")


QUERIES = {
    f.__name__: f
    for f in (
        chemical_classes, chemical_uses, chemical_bioassays, chemical_taxonomy, chemical_occurrences, chemical_hazards, derived_profile, normalized_traits, record_identifiers, record_reactions, record_enzymes, record_modules, record_classifications, record_participants,
        search_candidates, entry_queries, identity_review, identity_review_applied, identity_audit_summary, manifest_checks, provider_diagnostics, merged_context, applied_context, collapsed_membership, group_compound_pairs, preparation_checks,
        provider_availability, provider_gate, remapped_queries, scope_rollup, scope_cube, monthly_records, event_windows, sql_functions, sql_terms,
    )
}

from florilege.functions import rules  # noqa: E402
from florilege.queries.annotations import _ALL, _terms  # noqa: E402
from florilege.queries.context import ORACLES as _CONTEXT  # noqa: E402
from florilege.queries.context import _clean as _name_key  # noqa: E402
from florilege.queries.evidence import known, non  # noqa: E402
from florilege.queries.problems import words_sql  # noqa: E402
from florilege.queries.providers import ORACLES as _PROVIDERS  # noqa: E402
from florilege.queries.providers import _IX, _case  # noqa: E402
from florilege.queries.traits import _RULES, _clean, _ordered_sql  # noqa: E402

_BEST = "CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS confidence"


def _joined(c: str) -> str:
    return f"nullif(string_agg(DISTINCT nullif({c}, ''), '; ' ORDER BY nullif({c}, '')), '') AS {c}"


def _hit(c: str) -> str:
    return "CASE WHEN " + " OR ".join(f"regexp_matches({c}, '(?i){r[0]}')" for r in _RULES) + " THEN 'high' ELSE 'medium' END"


_OF = "FROM plant_compounds WHERE compound_id IS NOT NULL"
_CLASSES = f"""WITH a AS (SELECT compound_id AS query, cid, 'PubChem/reactives' AS class_system, 'reactive_group' AS class_type, NULL AS class_id, {non("comparison_group")} AS class_name, {_clean("comparison_group")} AS class_group, 'reactives' AS source_table, 'legacy_reactive_group' AS extraction_rule, 'medium' AS confidence, {non("comparison_group")} AS evidence_text {_OF} AND {non("comparison_group")} IS NOT NULL AND comparison_group NOT IN ('None', 'NA')
UNION ALL SELECT compound_id, cid, 'LOTUS', 'natural_product_class', {non("source_record_id")}, t, {_ordered_sql("t", _RULES, 2)}, 'LOTUSProfile', 'natural_product_class_terms', {_hit("t")}, t FROM (SELECT *, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(comparison_subgroup, '\\s*[;|]\\s*'), lambda x: trim(x)), lambda x: x <> ''))) AS t {_OF})
UNION ALL SELECT compound_id, cid, 'LOTUS', CASE WHEN k = 1 THEN 'natural_product_superclass' WHEN k = len(l) THEN 'natural_product_subclass' ELSE 'natural_product_class' END, CASE WHEN k = len(l) THEN occurrence_id::VARCHAR END, l[k], {_clean("l[1]")}, 'PubChemClassificationProfile', 'lotus_chemical_tree', 'high', array_to_string(l, ' > ')
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM (SELECT *, list_filter([comparison_scope, comparison_group, comparison_subgroup], lambda x: x IS NOT NULL) AS l {_OF})))
"""
_USES = f"""WITH a AS (SELECT compound_id AS query, cid, 'sensory' AS use_domain, 'descriptor' AS use_type, trim(comparison_subgroup) AS t, 'FEMAProfile' AS source_table, 'fema_discrete_terms' AS extraction_rule {_OF} AND trim(comparison_subgroup) <> ''
UNION ALL SELECT compound_id, cid, 'biomedical', 'pharmacologic_action', t, 'MeSHProfile', 'mesh_action_terms' FROM (SELECT *, unnest(list_distinct(list_filter([trim(comparison_group), trim(method_group)], lambda x: x <> ''))) AS t {_OF})),
b AS (SELECT query, cid, use_domain, use_type, t AS use_term, {_ordered_sql("t", _RULES, 2)} AS use_group, source_table, extraction_rule, {_hit("t")} AS confidence FROM a)
"""
_NO = "(?i)\\b(natural products?|compound|record|unknown|metabolite|synthetic)\\b"
_TAXA = f"""WITH a AS (SELECT compound_id AS query, cid, CASE WHEN NOT regexp_matches({non("species")}, '{_NO}') THEN {non("species")} END AS organism, {non("comparison_group")} AS natural_product_class, nullif(upper(trim(source_database)), '') AS source {_OF}),
b AS (SELECT *, nullif(regexp_extract(organism, '^([A-Z][a-z-]+) [a-z]', 1), '') AS genus, nullif(regexp_extract(organism, '^([A-Z][a-z-]+ [a-z][a-z-]+)', 1), '') AS species FROM a WHERE organism IS NOT NULL),
c AS (SELECT *, {_case("concat_ws('; ', genus, species, organism)", rules.KINGDOM_RULES)} AS kingdom FROM b),
t AS (SELECT query, cid, NULL::VARCHAR AS taxonomy_id, NULL::VARCHAR AS "domain", kingdom, NULL::VARCHAR AS phylum, NULL::VARCHAR AS "class", NULL::VARCHAR AS "order", NULL::VARCHAR AS family, genus, species, organism, coalesce(lower(kingdom), 'unclassified') AS taxonomy_group,
  CASE WHEN genus IS NOT NULL OR species IS NOT NULL OR kingdom IS NOT NULL OR natural_product_class IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence, natural_product_class, source FROM c),
tx AS (SELECT query, cid, taxonomy_id, "domain", kingdom, phylum, "class", "order", family, genus, species, organism, taxonomy_group, confidence, {_joined("natural_product_class")}, {_joined("source")}, 'lotus_taxonomy_regex' AS extraction_rule, NULL::VARCHAR AS common_name, count(*) AS n_rows FROM t GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)
"""
_TOXIC = "(?i)\\b(LD50|LC50|NOAEL|LOAEL|EC50|IC50)\\b[^0-9]{{0,50}}?([-+]?\\d*\\.?\\d+)\\s*([A-Za-z/%.]+)".replace("{{", "{").replace("}}", "}")
_HAZARDS = _ALL + f""", z AS (SELECT query, cid, x FROM an UNION ALL SELECT 'doc ' || doc_id, NULL, text FROM documents WHERE text IS NOT NULL),
h AS (SELECT query, cid, x, unnest(CASE WHEN len(regexp_extract_all(upper(x), '\\bH[0-9]{{3}}[A-Z]?\\b')) > 0 THEN list_distinct(regexp_extract_all(upper(x), '\\bH[0-9]{{3}}[A-Z]?\\b')) ELSE [NULL] END) AS hazard_code, NULL AS toxicity_metric, NULL::DOUBLE AS toxicity_value, NULL AS toxicity_unit FROM z
UNION ALL SELECT query, cid, x, NULL, upper(f[1]), TRY_CAST(f[2] AS DOUBLE), f[3] FROM (SELECT query, cid, x, unnest(list_zip(regexp_extract_all(x, '{_TOXIC}', 1), regexp_extract_all(x, '{_TOXIC}', 2), regexp_extract_all(x, '{_TOXIC}', 3))) AS f FROM z)),
g AS (SELECT query, cid, hazard_code, CASE WHEN hazard_code LIKE 'H2%' THEN 'physical_hazard' WHEN hazard_code LIKE 'H3%' THEN 'health_hazard' WHEN hazard_code LIKE 'H4%' THEN 'environmental_hazard' WHEN regexp_matches(x, '(?i)flammable|explosive|oxidiz') THEN 'physical_hazard' WHEN regexp_matches(x, '(?i)aquatic|environment') THEN 'environmental_hazard' WHEN regexp_matches(x, '(?i)toxic|harmful|irritat|corros|carcin') THEN 'health_hazard' END AS hazard_category,
  CASE WHEN hazard_code IN ('H318', 'H319') THEN 'eye_damage_irritation' WHEN hazard_code IN ('H315', 'H317') THEN 'skin_irritation_sensitization' WHEN regexp_matches(hazard_code, '^H3[013]') THEN 'acute_toxicity' WHEN regexp_matches(hazard_code, '^H2[2-7]') THEN 'flammability_reactivity' WHEN hazard_code LIKE 'H4%' THEN 'aquatic_environmental_toxicity' WHEN regexp_matches(x, '(?i)eye') THEN 'eye_damage_irritation' WHEN regexp_matches(x, '(?i)skin|dermal') THEN 'skin_irritation_sensitization' WHEN regexp_matches(x, '(?i)flammable') THEN 'flammability_reactivity' WHEN regexp_matches(x, '(?i)toxic|harmful|fatal') THEN 'acute_toxicity' WHEN regexp_matches(x, '(?i)aquatic') THEN 'aquatic_environmental_toxicity' END AS hazard_group,
  CASE WHEN regexp_matches(x, '(?i)\\bdanger\\b') THEN 'Danger' WHEN regexp_matches(x, '(?i)\\bwarning\\b') THEN 'Warning' END AS signal_word, CASE WHEN regexp_matches(x, '(?i)oral|swallow|ingest') THEN 'oral' WHEN regexp_matches(x, '(?i)skin|dermal') THEN 'dermal' WHEN regexp_matches(x, '(?i)inhal') THEN 'inhalation' WHEN regexp_matches(x, '(?i)eye|ocular') THEN 'ocular' END AS exposure_route,
  {_terms("eye,skin,respiratory tract,liver,kidney,central nervous system,blood,heart,lung,reproductive system")} AS target_organ, toxicity_metric, toxicity_value, toxicity_unit, {_terms("rat,mouse,rabbit,human,fish,daphnia,dog")} AS toxicity_species, CASE WHEN hazard_code IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence, trim(regexp_replace(x, '[\\s\\pZ]+', ' ', 'g')) AS e FROM h)
SELECT * EXCLUDE (e), 'ghs_and_toxicity_regex' AS extraction_rule, min(e) AS evidence_text, count(*) AS n_rows FROM g WHERE hazard_code IS NOT NULL OR toxicity_metric IS NOT NULL OR hazard_category IS NOT NULL GROUP BY ALL"""
_LIB = "WITH l AS (SELECT *, lpad(library_id::VARCHAR, 5, '0') AS n, library_id::VARCHAR AS i FROM chemical_library WHERE compound IS NOT NULL)"
_SQUISHED = "trim(regexp_replace({0}, '[\\s\\pZ]+', ' ', 'g'))"
_FOUND = f"""WITH nm AS ({_PROVIDERS["name_matches"]}), m AS (SELECT query, nm.library_id AS entry_id, CASE compound_type WHEN 'class A' THEN 'compound' WHEN 'class B' THEN 'drug' ELSE 'other' END AS "database", score FROM nm JOIN chemical_library USING (library_id)),
ac AS (SELECT query, entry_id, "database", row_number() OVER (PARTITION BY query ORDER BY CASE "database" WHEN 'compound' THEN 0 WHEN 'drug' THEN 1 ELSE 2 END, entry_id) AS match_rank FROM m WHERE score = 0 QUALIFY match_rank <= 2)
"""
_CTX = f"""WITH e AS (SELECT {words_sql("species")} AS species_key, {_name_key("compound_name")} AS compound_key, {non("source_record_id")} AS record, kind, value, confidence, curation_flag, matched_rank FROM (SELECT *, unnest(['plant_part', 'tissue', 'method']) AS kind, unnest([plant_part_group, tissue_group, method_group]) AS value FROM plant_compounds) WHERE {known("value")}),
mc AS (SELECT species_key, compound_key, record, kind, value, CASE max(CASE lower(trim(confidence)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS confidence, CASE WHEN bool_and(coalesce(curation_flag = 'needs_review', false)) THEN 'Yes' ELSE 'No' END AS review,
  nullif(string_agg(DISTINCT {non("curation_flag")}, '; ' ORDER BY {non("curation_flag")}), '') AS texts, nullif(string_agg(DISTINCT {non("matched_rank")}, '; ' ORDER BY {non("matched_rank")}), '') AS rules, count(*) AS n_rows FROM e GROUP BY 1, 2, 3, 4, 5)
"""
_RANK = "ROW(CASE confidence WHEN 'high' THEN -3 WHEN 'medium' THEN -2 WHEN 'low' THEN -1 ELSE 0 END, value)"
_PICKS = ", ".join(f"arg_min(value, {_RANK}) FILTER (kind = '{k}') AS {k}" for k in ("plant_part", "tissue", "method"))
_FILL = ", ".join(f"CASE WHEN {known('p.' + c)} THEN p.{c} ELSE coalesce(x.{k}, y.{k}, p.{c}) END AS {k}" for k, c in (("plant_part", "plant_part_group"), ("tissue", "tissue_group"))) + ", coalesce(x.method, y.method) AS method"


def _checks(*rows: tuple[str, str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", ({v})::BIGINT AS value, '{k}' AS kind FROM q" for n, v, k in rows)
    return f"SELECT \"check\", value, CASE WHEN value > 0 OR kind = 'info' THEN kind ELSE 'pass' END AS status FROM ({parts})"


ORACLES = {
    "chemical_classes": _CLASSES + f"SELECT query, cid, class_system, class_type, class_id, class_name, class_group, {_joined('source_table')}, {_joined('extraction_rule')}, min(evidence_text) AS evidence_text, {_BEST}, count(*) AS n_rows FROM a GROUP BY 1, 2, 3, 4, 5, 6, 7",
    "chemical_uses": _USES + f"SELECT query, cid, use_domain, use_type, use_term, use_group, {_joined('source_table')}, {_joined('extraction_rule')}, {_BEST}, count(*) AS n_rows FROM b GROUP BY 1, 2, 3, 4, 5, 6",
    "chemical_bioassays": "WITH e AS (SELECT user_id AS query, NULL AS cid, event_id % 40 AS aid, event_type AS assay_name, CASE event_type WHEN 'click' THEN 'Active' WHEN 'view' THEN 'Inconclusive' END AS outcome, 'Potency' AS activity_name, value, 'uM' AS unit, CASE WHEN event_type = 'signup' THEN 'P12345' END AS accession FROM events) SELECT DISTINCT query, cid, aid, assay_name, outcome, CASE outcome WHEN 'Active' THEN 'active' WHEN 'Inconclusive' THEN 'inconclusive' ELSE 'unspecified' END AS activity_class, activity_name, value, unit, coalesce(accession, CASE WHEN n_nationkey IS NOT NULL THEN 'Q1' END) AS accession, NULL AS gene, coalesce(n_name, accession) AS target_name, CASE WHEN n_nationkey IS NOT NULL THEN 'human' END AS target_organism, NULL AS target_common_name, CASE WHEN n_nationkey IS NOT NULL THEN 'IC50; Ki' END AS endpoint_names, CASE WHEN n_nationkey IS NOT NULL THEN 2 ELSE 0 END AS n_endpoints, CASE WHEN n_nationkey IS NOT NULL THEN 'pubchem_assay_summary; pubchem_assay_detail' ELSE 'pubchem_assay_summary' END AS extraction_rule, CASE WHEN outcome IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence FROM e LEFT JOIN nation ON n_nationkey = aid",
    "chemical_taxonomy": _TAXA + "SELECT * FROM tx",
    "chemical_occurrences": _TAXA + f"SELECT query, cid, taxonomy_id, organism, kingdom, family, genus, species, 'species_occurrence' AS occurrence_type, {_joined('natural_product_class')}, {_joined('source')}, 'lotus_taxonomy_regex' AS extraction_rule, NULL::VARCHAR AS common_name, {_BEST}, count(*) AS n_rows FROM tx GROUP BY 1, 2, 3, 4, 5, 6, 7, 8",
    "chemical_hazards": _HAZARDS,
    "record_identifiers": _LIB + " SELECT library_id AS record, 'CAS' AS identifier_type, '50-' || n[4:5] || '-1' AS identifier, 'DBLINKS' AS field FROM l UNION SELECT library_id, 'PubChem', unnest([i, n]), 'DBLINKS' FROM l UNION SELECT library_id, 'KEGG', 'C' || n, 'ENTRY' FROM l UNION SELECT library_id, 'KEGG', unnest(['R' || n, 'R9' || n[2:5]]), 'REACTION' FROM l UNION SELECT library_id, 'EC', '1.1.1.' || i, 'ENZYME' FROM l UNION SELECT library_id, 'KEGG', 'M' || n, 'MODULE' FROM l",
    "record_reactions": _LIB + " SELECT library_id AS record, 'R' || n AS reaction_id, CASE WHEN compound_type = 'class A' THEN compound || ' reaction' END AS name, CASE WHEN compound_type = 'class A' THEN 'water + 2 sugar <=> acid' END AS definition, CASE WHEN compound_type = 'class A' THEN 'C' || n || ' + 2 C00001 <=> C90001' END AS equation, 'record' AS evidence FROM l UNION ALL SELECT library_id, 'R9' || n[2:5], NULL, NULL, NULL, 'record' FROM l UNION ALL SELECT library_id, 'R8' || n[2:5], NULL, NULL, NULL, 'link' FROM l WHERE also_called IS NOT NULL",
    "record_enzymes": _LIB + " SELECT library_id AS record, '1.1.1.' || i AS ec_number, NULL AS name, 'Oxidoreductases' AS enzyme_class, 'record' AS evidence FROM l",
    "record_modules": _LIB + f" SELECT library_id AS record, 'M' || n AS module_id, {_SQUISHED.format('compound')} || ' synthesis' AS name, NULL AS definition, 'record' AS evidence FROM l",
    "record_classifications": _LIB + f" SELECT library_id AS record, 'KEGG pathway group' AS classification_type, 'Secondary metabolism' AS classification, 'M' || n || ' ' || {_SQUISHED.format('compound')} || ' synthesis' AS evidence FROM l UNION ALL SELECT library_id, 'EC enzyme class', 'Oxidoreductases', '1.1.1.' || i FROM l UNION ALL SELECT library_id, 'KEGG BRITE', coalesce(compound_type, 'none') || ' [BR:08001]', 'BRITE' FROM l",
    "record_participants": _LIB + " SELECT library_id AS record, 'R' || n AS reaction_id, unnest(['substrate', 'substrate', 'product']) AS side, unnest([0, 1, 0]) AS place, unnest(['C' || n, 'C00001', 'C90001']) AS participant_id, unnest(['water', 'sugar', 'acid']) AS participant_name FROM l WHERE compound_type = 'class A'",
    "search_candidates": _FOUND + "SELECT m.query, m.entry_id, m.\"database\", score, CASE WHEN score = 0 THEN 'Yes' ELSE 'No' END AS accepted, CASE WHEN score <> 0 THEN 'broad_name_match_not_exact' END AS rejection, match_rank FROM m LEFT JOIN ac USING (query, entry_id, \"database\")",
    "entry_queries": _FOUND + "SELECT library_id AS entry_id, coalesce(q, '(none)') AS query FROM chemical_library LEFT JOIN (SELECT entry_id, arg_min(query, ROW(match_rank, query)) AS q FROM ac GROUP BY 1) ON entry_id = library_id",
    "identity_review": f"WITH r AS (SELECT compound_name_clean, min(CASE WHEN {known('inchikey')} OR {known('cid')} THEN 1 WHEN {known('smiles')} THEN 2 WHEN {known('compound_id')} THEN 3 ELSE 4 END) AS r, count(DISTINCT {non('inchikey')}) AS n_structures, count(DISTINCT {non('compound_id')}) AS n_ids, count(*) AS n_records, count(DISTINCT {non('species')}) AS n_species FROM plant_compounds WHERE {known('compound_name_clean')} GROUP BY 1) SELECT * EXCLUDE (r), CASE WHEN n_structures > 1 THEN 'ambiguous' ELSE ['resolved', 'structure_only', 'identifier_only', 'unresolved'][r] END AS issue FROM r WHERE n_species >= 2",
    "identity_review_applied": f"WITH v AS (SELECT compound_name_clean, CASE WHEN curation_flag = 'checked' AND {non('inchikey')} IS NOT NULL THEN 'accepted' ELSE 'rejected' END AS d, CASE WHEN curation_flag = 'checked' THEN upper({non('inchikey')}) END AS k FROM plant_compounds WHERE curation_flag IN ('checked', 'needs_review') AND {known('compound_name_clean')}), g AS (SELECT compound_name_clean, count(DISTINCT d) AS n, count(DISTINCT k) AS m, min(d) AS d, min(k) AS k FROM v GROUP BY 1) SELECT occurrence_id, coalesce(CASE WHEN n = 1 AND m = 1 THEN k END, inchikey) AS inchikey, CASE WHEN n > 1 OR m > 1 THEN 'conflicting' ELSE coalesce(d, 'not_reviewed') END AS identity_decision FROM plant_compounds LEFT JOIN g USING (compound_name_clean)",
    "identity_audit_summary": f"WITH q AS (SELECT count(*) AS n, count(*) - count(DISTINCT occurrence_id) AS dup, count(*) FILTER (issue = 'unresolved') AS u, count(*) FILTER (risks <> '') AS w FROM ({_PROVIDERS['identity_audit']})) " + _checks(("records", "n", "info"), ("repeated_identifiers", "dup", "fail"), ("unresolved", "u", "warn"), ("with_risks", "w", "warn"), ("invalid_confidence", "0", "fail")),
    "manifest_checks": "WITH q AS (SELECT count(*) AS n, count(source_database) - count(DISTINCT source_database) AS dup, count(*) FILTER (coalesce(trim(source_database), '') = '') AS b, count(*) FILTER (trust_rank = 2) AS odd, count(*) FILTER (trust_rank = 1) AS p, count(*) FILTER (trust_rank < 0) AS neg FROM provider_sources) " + _checks(("stages", "n", "info"), ("repeated_stages", "dup", "fail"), ("blank_stages", "b", "fail"), ("unknown_statuses", "odd", "fail"), ("complete_without_path", "p", "fail"), ("negative_rows", "neg", "fail")),
    "provider_diagnostics": f"WITH g AS (SELECT source_database, species, count(inchikey) AS n_records, {non('max(curation_flag)')} AS message FROM plant_compounds GROUP BY 1, 2) SELECT lower({non('source_database')}) AS provider, {non('species')} AS query, CASE WHEN n_records > 0 THEN 'complete' WHEN message IS NOT NULL THEN 'failed' ELSE 'no_records' END AS status, n_records, message FROM g",
    "merged_context": _CTX + "SELECT * FROM mc",
    "applied_context": _CTX + f""", us AS (SELECT * FROM mc WHERE review = 'No'), x AS (SELECT species_key, compound_key, record, {_PICKS} FROM us WHERE record IS NOT NULL GROUP BY 1, 2, 3), y AS (SELECT species_key, compound_key, {_PICKS} FROM us GROUP BY 1, 2),
p AS (SELECT occurrence_id, plant_part_group, tissue_group, {words_sql("species")} AS sk, {_name_key("compound_name")} AS ck, {non("source_record_id")} AS rc FROM plant_compounds)
SELECT occurrence_id, {_FILL} FROM p LEFT JOIN x ON x.species_key = sk AND x.compound_key = ck AND x.record = rc LEFT JOIN y ON y.species_key = sk AND y.compound_key = ck""",
    "collapsed_membership": f"WITH n AS (SELECT species, compound_id, {non('compound_name_clean')} AS name, count(*) AS n FROM plant_compounds WHERE {non('species')} IS NOT NULL AND {non('compound_id')} IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY species, compound_id ORDER BY name IS NULL, length(name), name) AS place FROM n) SELECT species, compound_id, sum(n)::BIGINT AS n_rows, count(name) AS n_names, string_agg(name, '; ' ORDER BY place) FILTER (place <= 10 AND name IS NOT NULL) AS names FROM r GROUP BY 1, 2",
    "group_compound_pairs": "WITH p AS (SELECT least(compound_id_a, compound_id_b) AS a, greatest(compound_id_a, compound_id_b) AS b, max(tanimoto) AS tanimoto FROM plant_compound_pair_tanimoto WHERE tanimoto >= 0.5 GROUP BY 1, 2), m AS (SELECT DISTINCT compound_id, plant_part_group AS g FROM plant_compounds WHERE compound_id IS NOT NULL AND plant_part_group IS NOT NULL), j AS (SELECT a, b, tanimoto, x.g AS ga, y.g AS gb FROM p JOIN m x ON x.compound_id = a JOIN m y ON y.compound_id = b WHERE a < b AND x.g <> y.g) SELECT least(ga, gb) AS group_1, CASE WHEN ga < gb THEN a ELSE b END AS compound_1, greatest(ga, gb) AS group_2, CASE WHEN ga < gb THEN b ELSE a END AS compound_2, tanimoto FROM j",
    "preparation_checks": f"WITH q AS (SELECT count(*) AS n, count(*) FILTER (eligible) AS e, count(*) FILTER (eligible AND structure_id IS NULL) AS s, count(*) FILTER (eligible AND {non('species')} IS NULL) AS g, count(*) FILTER (NOT eligible AND exclusion_reason IS NULL) AS x, count(*) FILTER (eligible AND exclusion_reason IS NOT NULL) AS y FROM ({_CONTEXT['similarity_input']})) " + _checks(("rows", "n", "info"), ("eligible_rows", "e", "info"), ("eligible_without_structure", "s", "fail"), ("eligible_without_group", "g", "fail"), ("excluded_without_reason", "x", "fail"), ("eligible_with_reason", "y", "fail"), ("excluded_rows", "n - e", "warn")),
    "provider_availability": _IX + " SELECT s AS source, count(record_id IS NOT NULL OR source IS NOT NULL) FILTER (key IS NOT NULL) AS n_records, count(DISTINCT species_key) AS n_species, CASE WHEN count(key) > 0 THEN 'ready' ELSE 'empty' END AS status FROM (SELECT unnest(['phydorex', 'herborum', 'nowhere']) AS s) LEFT JOIN (SELECT * FROM ix WHERE key_type = 'species') i ON lower(i.source) = s GROUP BY s",
    "provider_gate": f"WITH ac AS ({_PROVIDERS['query_accounting']}) SELECT source, count(DISTINCT CASE WHEN status <> 'no_records' THEN plant_id END) AS n_plants, round(count(DISTINCT CASE WHEN status <> 'no_records' THEN plant_id END) / (SELECT count(*) FROM plant_metadata), 4) AS share, CASE WHEN round(count(DISTINCT CASE WHEN status <> 'no_records' THEN plant_id END) / (SELECT count(*) FROM plant_metadata), 4) >= 0.5 THEN 'pass' ELSE 'fail' END AS gate FROM ac GROUP BY source",
    "remapped_queries": f"WITH a AS (SELECT {words_sql('species')} AS k, min(list_id) AS q FROM plant_list WHERE {words_sql('species')} <> '' GROUP BY 1), b AS (SELECT {words_sql('genus')} AS k, min(metadata_id) + 100000 AS q FROM plant_metadata WHERE {words_sql('genus')} <> '' GROUP BY 1) SELECT metadata_id, coalesce(a.q, b.q) AS query_id FROM plant_metadata m LEFT JOIN a ON a.k = {words_sql('m.species')} LEFT JOIN b ON b.k = {words_sql('m.genus')}",
    "scope_rollup": f"SELECT comparison_scope, comparison_group, count(*) AS n_rows, count(DISTINCT {non('compound_id')}) AS n_compounds, grouping(comparison_scope) + grouping(comparison_group) AS level FROM plant_compounds GROUP BY ROLLUP (comparison_scope, comparison_group)",
    "scope_cube": f"SELECT comparison_scope, matched_rank, count(*) AS n_rows, count(DISTINCT {non('compound_id')}) AS n_compounds, grouping(comparison_scope) + grouping(matched_rank) AS level FROM plant_compounds GROUP BY CUBE (comparison_scope, matched_rank)",
    "monthly_records": "SELECT strftime(retrieved_at, '%Y-%m') AS month, count(*) AS n_rows, round(avg(date_diff('day', retrieved_at::DATE, loaded_at::DATE)), 3) AS mean_days, count(*) FILTER (dayofweek(retrieved_at) IN (0, 6)) AS n_weekend, quarter(max(retrieved_at)) AS quarter FROM plant_compounds GROUP BY 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sql_functions": f"SELECT {words_sql('species')} AS species_key, regexp_replace(regexp_replace(comparison_group, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS group_slug, count(*) AS n_rows, count(*) FILTER ({known('tissue_group')}) AS n_tissue, max(CASE lower(trim(confidence)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS best FROM plant_compounds GROUP BY 1, 2",
    "sql_terms": "SELECT DISTINCT library_id, trim(t) AS term FROM (SELECT library_id, unnest(string_split(also_called, ';')) AS t FROM chemical_library) WHERE trim(t) <> ''",
}
