"""Trait queries: the occurrence records give each compound id its traits."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions import rules
from florilege.functions.rules import formula_mass
from florilege.functions.text import label
from florilege.operators import traits as T
from florilege.session import stage, table

FIELDS = {"comparison_group": ("chemical_class", "natural_product_class"), "comparison_subgroup": ("chemical_class", "natural_product_subclass"), "occurrence_status": ("occurrence", "occurrence_type"), "method_group": ("bioactivity", "assay_type")}
KEYS = ["chemical_class__natural_product_class__alkaloid", "chemical_class__natural_product_class__carbohydrate"]
#: Columns of the wide displays.
MATRIX_KEYS = 30


def _rows(spark, d):
    base = table(spark, d, "plant_compounds").select(label(F.col("compound_id")).alias("query"), "cid", "source_database", "confidence", "source_record_id", "molecular_formula", *FIELDS).filter("query is not null")
    base = rules.hold(base, mass=formula_mass(F.col("molecular_formula")))
    group, value = T.property_trait(F.lit("exact_mass"), F.col("mass"))
    parts = [F.struct(F.lit(t).alias("trait_type"), F.lit(g).alias("trait_group"), F.col(c).alias("trait_value")) for c, (t, g) in FIELDS.items()]
    parts.append(F.struct(F.when(group.isNotNull(), "property").alias("trait_type"), group.alias("trait_group"), value.alias("trait_value")))
    rows = base.select("query", "cid", F.col("source_database").alias("source"), "confidence", F.col("source_record_id").alias("evidence_id"), F.lit("source record id").alias("extraction_rule"), F.explode(F.array(*parts)).alias("t"))
    return rows.select("query", "cid", "t.*", "source", "confidence", "evidence_id", "extraction_rule").filter("trait_type is not null")


def _traits(spark, d):
    """Written once, as most queries read them several times."""
    return stage(T.dedupe_traits(T.build_traits(_rows(spark, d))), "traits")


def traits_deduped(spark, d):
    return T.dedupe_traits(T.build_traits(_rows(spark, d)))


def trait_evidence_links(spark, d):
    return T.evidence_links(T.build_traits(_rows(spark, d)))


def trait_keys(spark, d):
    return T.rank_keys(T.matrix_source(_traits(spark, d), "ecology", "low"))


def _matrix(source, traits, mode="binary", key="matrix_key"):
    """The MATRIX_KEYS most widespread keys as columns; their list, of fixed length, comes to the driver."""
    keys = [r[key] for r in T.rank_keys(source, MATRIX_KEYS, key).collect()]
    return T.trait_matrix(source, traits, keys, mode, key)


def trait_matrix(spark, d):
    traits = _traits(spark, d)
    return _matrix(T.matrix_source(traits, "ecology"), traits)


def trait_matrix_confidence(spark, d):
    traits = _traits(spark, d)
    return _matrix(T.matrix_source(traits, "full", "medium"), traits, "confidence")


def trait_ontology(spark, d):
    return T.trait_ontology(_traits(spark, d), "low")


def ontology_matrix(spark, d):
    traits = _traits(spark, d)
    return _matrix(stage(T.trait_ontology(traits), "ontology"), traits, "count", "ontology_key")


def trait_evidence(spark, d):
    """Audit rows with every source record, of the traits of two classes."""
    built = stage(T.build_traits(_rows(spark, d)), "traits-built")
    return T.trait_evidence(T.dedupe_traits(built), KEYS, "high", T.evidence_links(built))


def trait_summary_by_type(spark, d):
    return T.trait_summary(_traits(spark, d), "type")


def trait_summary_by_compound(spark, d):
    return T.trait_summary(_traits(spark, d), "compound", "medium", 3)


def trait_summary_by_source(spark, d):
    return T.trait_summary(_traits(spark, d), "source", 0, 5)


def trait_report(spark, d):
    traits = _traits(spark, d)
    ontology = stage(T.trait_ontology(traits), "ontology")
    return T.trait_report(traits, ontology, 8, T.nearest_neighbours(ontology, "ontology_key", 3))


def trait_similarity(spark, d):
    """Pairs of at least half of their keys in common."""
    return T.trait_similarity(T.matrix_source(_traits(spark, d), "full"))


def trait_overlaps(spark, d):
    """All pairs with any key in common."""
    return T.trait_similarity(T.matrix_source(_traits(spark, d), "full"), least=0.0)


def trait_classes(spark, d):
    return T.trait_classes(T.matrix_source(_traits(spark, d), "full"))


def trait_neighbours(spark, d):
    return T.nearest_neighbours(T.matrix_source(_traits(spark, d), "full"), k=3)


def term_lookup(spark, d):
    term, group, confidence = T.term_lookup(F.col("comparison_subgroup"))
    return table(spark, d, "plant_compounds").select("occurrence_id", term.alias("term"), group.alias("term_group"), confidence.alias("term_confidence"))


def compound_bins(spark, d):
    """Mass, volatility and element rules per record; its provider count stands for the sources."""
    rows = rules.hold(table(spark, d, "plant_compounds"), mass=formula_mass(F.col("molecular_formula")))
    none = F.lit(0)
    score = rules.compound_confidence(F.col("cid"), F.col("molecular_formula"), F.col("mass"), F.col("mass"), F.lit(1), none, none, none, F.lit(False), F.col("method_group") == "NMR")
    return rows.select(
        "occurrence_id", rules.mw_bin(F.col("mass")).alias("mw_bin"), rules.volatility_proxy(F.col("mass"), F.col("mass") / 5, F.lit(None)).alias("volatility"),
        rules.formula_has(F.col("molecular_formula"), "N").alias("has_n"), rules.formula_has(F.col("molecular_formula"), "O").alias("has_o"), score.alias("score"),
    )


def measurement_summary(spark, d):
    """Retention times and areas of peaks as measurements of compounds."""
    peaks = table(spark, d, "standard_data").filter("compound_name is not null")
    confidence = F.when(F.col("match_factor") >= 90, "high").when(F.col("match_factor") >= 70, "medium").otherwise("low")
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("standard_value")) for p in ("component_rt", "base_peak_area")])).alias("m")
    rows = peaks.select(F.col("compound_name").alias("query"), confidence.alias("confidence"), F.col("file_name").alias("source"), parts).select("query", "confidence", "source", "m.*")
    rows = rows.withColumn("bin", F.when(F.col("property") == "component_rt", F.when(F.col("standard_value") < 10, "early").otherwise("late")))
    return T.measurement_summary(rows).withColumn("median_value", F.round("median_value", 6))


QUERIES = {
    f.__name__: f
    for f in (
        traits_deduped, trait_evidence_links, trait_keys, trait_matrix, trait_matrix_confidence, trait_ontology, ontology_matrix, trait_evidence, trait_summary_by_type, trait_summary_by_compound, trait_summary_by_source, trait_report,
        trait_similarity, trait_overlaps, trait_classes, trait_neighbours, term_lookup, compound_bins, measurement_summary,
    )
}

from florilege.queries.gcms import _MASS  # noqa: E402


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace({x}, '[\\s\\pZ]+', ' ', 'g'))), '_+', ' ', 'g'), '[^a-z0-9+./ -]+', ' ', 'g'), '[\\s\\pZ]+', ' ', 'g'))"


def _piece(x: str) -> str:
    return f"regexp_replace(regexp_replace({_clean(x)}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


_COMMON = "lower(trim(compound_id)) AS query, cid, source_database AS source, confidence, source_record_id AS evidence_id"
_UNION = " UNION ALL ".join(f"SELECT {_COMMON}, '{t}' AS trait_type, '{g}' AS trait_group, {c} AS trait_value FROM plant_compounds WHERE trim(compound_id) <> ''" for c, (t, g) in FIELDS.items())
_UNION += f""" UNION ALL SELECT {_COMMON}, 'property', 'molecular_size_bin', CASE WHEN m < 200 THEN 'small_molecule_lt_200_Da' WHEN m <= 500 THEN 'drug_like_size_200_500_Da' ELSE 'large_molecule_gt_500_Da' END
FROM (SELECT *, {_MASS} AS m FROM plant_compounds WHERE trim(compound_id) <> '') WHERE m IS NOT NULL"""
_RANK = "CASE lower(trim(confidence)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_WORD = "CASE {0} WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END"
_TRAITS = f"""WITH raw AS ({_UNION}),
b AS (SELECT *, {_clean("trait_value")} AS trait_value_clean, trim(regexp_replace(source, '[\\s\\pZ]+', ' ', 'g')) AS source_database,
  round(least(CASE coalesce(nullif(lower(trim(confidence)), ''), 'medium') WHEN 'high' THEN 0.9::DOUBLE WHEN 'medium' THEN 0.65 WHEN 'low' THEN 0.35 ELSE 0.5 END
    + CASE WHEN trim(evidence_id) <> '' THEN 0.05 ELSE 0 END + 0.02, 1.0), 2) AS confidence_score, {_RANK} AS r FROM raw WHERE {_clean("trait_value")} <> ''),
tr AS (SELECT query, cid, trait_type, trait_group, trait_value_clean, nullif(string_agg(DISTINCT nullif(source_database, ''), '; ' ORDER BY nullif(source_database, '')), '') AS source_database,
  'source record id' AS extraction_rule, min(nullif(trim(regexp_replace(trait_value, '[\\s\\pZ]+', ' ', 'g')), '')) AS trait_value, min(nullif(trim(regexp_replace(evidence_id, '[\\s\\pZ]+', ' ', 'g')), '')) AS evidence_id,
  {_WORD.format("max(r)")} AS confidence, max(confidence_score) AS confidence_score, true AS matrix_eligible, count(*) AS n_rows,
  {_piece("trait_type")} || '__' || {_piece("trait_group")} || '__' || {_piece("trait_value_clean")} AS matrix_key FROM b GROUP BY query, cid, trait_type, trait_group, trait_value_clean)
"""
_ECOLOGY = "(trait_type IN ('taxonomy', 'occurrence') OR (trait_type = 'chemical_class' AND trait_group IN ('natural_product_superclass', 'natural_product_class', 'natural_product_subclass')))"
_FOUND = "CASE WHEN trait_type = 'occurrence' THEN nullif(regexp_extract(evidence_id, '\\b[0-9]{1,12}\\b'), '') WHEN trait_group = 'assay_type' AND regexp_matches(evidence_id, '\\b[0-9]{1,12}\\b') THEN 'AID:' || regexp_extract(evidence_id, '\\b[0-9]{1,12}\\b') END"
_ONTO = f""", onto AS (SELECT query, cid, ontology_domain, ontology_group, trait_value_clean AS ontology_term, max(confidence_score) AS confidence_score, max(confidence_rank) AS cr, any_value(source_database) AS source_database, min(found) AS ontology_id, CASE WHEN min(found) IS NOT NULL THEN 'NCBI Taxonomy' END AS ontology_id_source,
  'https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=' || min(found) AS ontology_id_url FROM (
  SELECT *, {_FOUND} AS found, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS confidence_rank,
  CASE WHEN trait_type = 'property' THEN 'physicochemical' WHEN trait_type IN ('chemical_class', 'occurrence') THEN 'ecology' END AS ontology_domain,
  CASE trait_group WHEN 'molecular_size_bin' THEN 'molecular_size' ELSE trait_group END AS ontology_group FROM tr) WHERE ontology_domain IS NOT NULL GROUP BY query, cid, ontology_domain, ontology_group, trait_value_clean)
"""


def _pivot(source: str, key: str, value: str) -> str:
    """The most widespread keys of a source as columns, all compounds as rows."""
    return f""", src AS ({source}), top AS (SELECT k, count(DISTINCT query || '|' || coalesce(cid::VARCHAR, '')) AS p, round(sum(round(confidence_score * 100)::BIGINT) / count(confidence_score) / 100, 6) AS m FROM (SELECT *, {key} AS k FROM src) GROUP BY k ORDER BY p DESC, m DESC, k LIMIT {MATRIX_KEYS}),
cells AS (SELECT b.query, b.cid, t.k, coalesce({value}, 0)::DOUBLE AS v FROM (SELECT DISTINCT query, cid FROM tr) b CROSS JOIN top t LEFT JOIN (SELECT *, {key} AS k FROM src) s ON s.query = b.query AND s.cid IS NOT DISTINCT FROM b.cid AND s.k = t.k GROUP BY b.query, b.cid, t.k)
SELECT * FROM (PIVOT cells ON k USING first(v) GROUP BY query, cid)"""


def _top(keys: str, n: int, where: str = "true") -> str:
    return f"(SELECT {keys}, string_agg(trait_value_clean, '; ' ORDER BY place) AS top_values FROM (SELECT {keys}, trait_value_clean, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, trait_value_clean) AS place FROM tr WHERE {where} GROUP BY {keys}, trait_value_clean) WHERE place <= {n} GROUP BY {keys})"


_COUNTS = "count(*) AS n_rows, count(DISTINCT trait_type || ':' || trait_group || ':' || trait_value_clean) AS n_traits, count(DISTINCT matrix_key) AS n_keys, count(*) FILTER (confidence_score >= 0.9) AS n_high, round(sum(round(confidence_score * 100)::BIGINT) / count(confidence_score) / 100, 6) AS mean_score"
_OKEY = f"ontology_domain || '__' || ontology_group || '__' || {_piece('ontology_term')}"
_DOMAINS = ("physicochemical", "ecology", "bioactivity", "metabolism", "safety", "sensory", "biomedical")
_PAIRS = """, sets AS (SELECT query, list_sort(list(DISTINCT matrix_key)) AS ks FROM tr GROUP BY query),
rp AS (SELECT ks, min(query) AS rep, count(*) AS n FROM sets GROUP BY ks),
rk AS (SELECT rep, unnest(ks) AS k FROM rp),
pr AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n_shared FROM rk a JOIN rk b ON a.k = b.k AND a.rep < b.rep GROUP BY a.rep, b.rep),
pk AS (SELECT a, b, x.n AS n_a, y.n AS n_b, n_shared, len(x.ks) + len(y.ks) - n_shared AS n_union, x.ks AS ka, y.ks AS kb FROM pr JOIN rp x ON x.rep = a JOIN rp y ON y.rep = b),
sm AS (SELECT a, b, n_a, n_b, n_shared, n_union, len(ka) - n_shared AS n_only_a, len(kb) - n_shared AS n_only_b, round(n_shared / n_union, 4) AS jaccard, round(n_shared / least(len(ka), len(kb)), 4) AS overlap,
  nullif(array_to_string(list_filter(ka, lambda x: list_contains(kb, x))[1:12], '; '), '') AS shared_keys, nullif(array_to_string(list_filter(ka, lambda x: NOT list_contains(kb, x))[1:12], '; '), '') AS only_a_keys, nullif(array_to_string(list_filter(kb, lambda x: NOT list_contains(ka, x))[1:12], '; '), '') AS only_b_keys FROM pk)
"""
_NEAR = """, mm AS (SELECT query, rep, row_number() OVER (PARTITION BY rep ORDER BY query) AS no FROM sets JOIN rp USING (ks)),
bt AS (SELECT a, b, n_shared, n_union FROM pk UNION ALL SELECT b, a, n_shared, n_union FROM pk),
ca AS (SELECT rep, query AS neighbour, 1.0::DOUBLE AS j, 9999 AS s FROM mm WHERE no <= 4 UNION ALL SELECT a, query, n_shared / n_union, n_shared FROM (SELECT * FROM bt QUALIFY row_number() OVER (PARTITION BY a ORDER BY n_shared / n_union DESC, n_shared DESC, b) <= 3) JOIN mm ON mm.rep = b AND no <= 3),
nn AS (SELECT mm.query, neighbour, row_number() OVER (PARTITION BY mm.query ORDER BY j DESC, s DESC, neighbour) AS place, round(j, 4) AS jaccard FROM mm JOIN ca USING (rep) WHERE neighbour <> mm.query QUALIFY place <= 3)
"""


def _ordered_sql(column: str, rules_: tuple, place: int) -> str:
    """The first dictionary pattern found, written as a CASE."""
    whens = " ".join(f"WHEN regexp_matches({column}, '(?i){r[0]}') THEN '{r[place]}'" for r in rules_)
    return f"CASE {whens} ELSE {_clean(column)} END"


_RULES = (("anti[- ]?inflammatory|non[- ]?steroidal", "anti-inflammatory", "anti-inflammatory"), (r"cyclooxygenase|\bcox\b", "cyclooxygenase inhibitor", "enzyme inhibitor"), *T.TERMS)
_HIT = " OR ".join(f"regexp_matches(comparison_subgroup, '(?i){r[0]}')" for r in _RULES)

_NO_ID = "nullif(trim(regexp_replace(evidence_id, '[\\s\\pZ]+', ' ', 'g')), '')"


def _first_of(value: str, n: int) -> str:
    return f"nullif(array_to_string(list_sort(list(DISTINCT {value}) FILTER ({value} IS NOT NULL))[1:{n}], '; '), '')"


ORACLES = {
    "traits_deduped": _TRAITS + "SELECT * FROM tr",
    "trait_keys": _TRAITS + f"SELECT matrix_key, count(DISTINCT query || '|' || coalesce(cid::VARCHAR, '')) AS prevalence, round(sum(round(confidence_score * 100)::BIGINT) / count(confidence_score) / 100, 6) AS mean_confidence FROM tr WHERE confidence_score >= 0.35 AND {_ECOLOGY} GROUP BY matrix_key",
    "trait_matrix": _TRAITS + _pivot(f"SELECT * FROM tr WHERE {_ECOLOGY}", "matrix_key", "max(CASE WHEN s.query IS NOT NULL THEN 1 END)"),
    "trait_matrix_confidence": _TRAITS + _pivot("SELECT * FROM tr WHERE confidence_score >= 0.65", "matrix_key", "max(s.confidence_score)"),
    "trait_ontology": _TRAITS + _ONTO + f"SELECT query, cid, ontology_domain, ontology_group, ontology_term, confidence_score, {_WORD.format('cr')} AS confidence, source_database, ontology_id, ontology_id_source, ontology_id_url, {_OKEY} AS ontology_key FROM onto WHERE confidence_score >= 0.35",
    "ontology_matrix": _TRAITS + _ONTO + _pivot("SELECT * FROM onto", _OKEY, "count(s.query)"),
    "trait_evidence": _TRAITS + f", u AS (SELECT DISTINCT {', '.join(T.TRAIT_KEY)}, {_NO_ID} AS evidence_id FROM b WHERE {_NO_ID} IS NOT NULL) SELECT w.query, w.cid, w.trait_type, w.trait_group, w.trait_value_clean, matrix_key, source_database, confidence, confidence_score, u.evidence_id FROM tr w LEFT JOIN u ON " + " AND ".join(f"w.{k} IS NOT DISTINCT FROM u.{k}" for k in T.TRAIT_KEY) + f" WHERE confidence_score >= 0.9 AND matrix_key IN ('{KEYS[0]}', '{KEYS[1]}')",
    "trait_evidence_links": _TRAITS + f"SELECT DISTINCT {', '.join(T.TRAIT_KEY)}, {_NO_ID} AS evidence_id FROM b WHERE {_NO_ID} IS NOT NULL",
    "trait_summary_by_type": _TRAITS + f"SELECT * FROM (SELECT trait_type, trait_group, {_COUNTS} FROM tr GROUP BY ALL) JOIN {_top('trait_type, trait_group', 8)} USING (trait_type, trait_group)",
    "trait_summary_by_compound": _TRAITS + f"SELECT t.*, u.top_values FROM (SELECT query, cid, {_COUNTS} FROM tr WHERE confidence_score >= 0.65 GROUP BY ALL) t JOIN {_top('query, cid', 3, 'confidence_score >= 0.65')} u ON t.query = u.query AND t.cid IS NOT DISTINCT FROM u.cid",
    "trait_summary_by_source": _TRAITS + f"SELECT * FROM (SELECT source_database, {_COUNTS} FROM tr GROUP BY ALL) JOIN {_top('source_database', 5)} USING (source_database)",
    "trait_report": _TRAITS + _ONTO + _PAIRS.replace("matrix_key", _OKEY).replace("FROM tr", "FROM onto") + _NEAR + f""", c AS (SELECT query, count(*) AS n_traits FROM tr GROUP BY query),
t AS (SELECT query, count(DISTINCT {_OKEY}) AS n_terms, count(DISTINCT ontology_domain) AS n_domains, count(*) AS n_evidence, count(*) FILTER (confidence_score >= 0.9) AS n_high, round(sum(round(confidence_score * 100)::BIGINT) / count(confidence_score) / 100, 6) AS mean_score,
  {_first_of("ontology_domain", 100)} AS domains, {", ".join(_first_of(f"CASE WHEN ontology_domain = '{x}' THEN ontology_group || '=' || ontology_term END", 8) + f" AS {x}_terms" for x in T.REPORT_DOMAINS)},
  {_first_of("ontology_id_source || ':' || ontology_id", 8)} AS identifiers, {_first_of("ontology_id_url", 8)} AS pages FROM onto GROUP BY query),
n AS (SELECT query, string_agg(neighbour || ' (' || printf('%.4f', jaccard) || ')', '; ' ORDER BY place) AS nearest, max(jaccard) AS nearest_jaccard FROM nn GROUP BY query)
SELECT * FROM c LEFT JOIN t USING (query) LEFT JOIN n USING (query)""",
    "trait_similarity": _TRAITS + _PAIRS + "SELECT * FROM sm WHERE n_shared / n_union >= 0.5 - 1e-9",
    "trait_overlaps": _TRAITS + _PAIRS + "SELECT * FROM sm",
    "trait_classes": _TRAITS + _PAIRS + "SELECT query, rep AS representative, n AS class_size FROM sets JOIN rp USING (ks)",
    "trait_neighbours": _TRAITS + _PAIRS + _NEAR + "SELECT * FROM nn",
    "term_lookup": f"SELECT occurrence_id, CASE WHEN trim(comparison_subgroup) <> '' THEN {_ordered_sql('comparison_subgroup', _RULES, 1)} END AS term, CASE WHEN trim(comparison_subgroup) <> '' THEN {_ordered_sql('comparison_subgroup', _RULES, 2)} END AS term_group, CASE WHEN coalesce(trim(comparison_subgroup), '') = '' THEN 'low' WHEN {_HIT} THEN 'high' ELSE 'medium' END AS term_confidence FROM plant_compounds",
    "compound_bins": f"""SELECT occurrence_id, CASE WHEN m < 150 THEN 'small_<150_Da' WHEN m < 350 THEN 'medium_150_350_Da' WHEN m < 750 THEN 'large_350_750_Da' WHEN m >= 750 THEN 'very_large_>=750_Da' END AS mw_bin,
  CASE WHEN m < 200 AND m / 5 < 60 THEN 'more_volatile_proxy' WHEN m < 350 AND m / 5 < 90 THEN 'moderate_volatile_proxy' WHEN m IS NOT NULL THEN 'less_volatile_proxy' END AS volatility,
  coalesce(regexp_matches(molecular_formula, '(N)([0-9]|$)'), false) AS has_n, coalesce(regexp_matches(molecular_formula, '(O)([0-9]|$)'), false) AS has_o,
  round(CASE WHEN cid IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN trim(molecular_formula) <> '' THEN 0.1 ELSE 0 END + CASE WHEN m IS NOT NULL THEN 0.2 ELSE 0 END + 0.05 + CASE WHEN method_group = 'NMR' THEN 0.05 ELSE 0 END, 2) AS score
  FROM (SELECT *, {_MASS} AS m FROM plant_compounds)""",
    "measurement_summary": """WITH m AS (SELECT compound_name AS query, CASE WHEN match_factor >= 90 THEN 3 WHEN match_factor >= 70 THEN 2 ELSE 1 END AS c, file_name AS source, 'component_rt' AS property, component_rt AS v FROM standard_data WHERE compound_name IS NOT NULL
  UNION ALL SELECT compound_name, CASE WHEN match_factor >= 90 THEN 3 WHEN match_factor >= 70 THEN 2 ELSE 1 END, file_name, 'base_peak_area', base_peak_area FROM standard_data WHERE compound_name IS NOT NULL)
SELECT query, property, count(*) AS n, min(v) AS min_value, round(quantile_cont(v, 0.5), 6) AS median_value, max(v) AS max_value, first(v ORDER BY v IS NULL, -c, source, v) AS best_value, CASE WHEN property = 'component_rt' THEN nullif(string_agg(DISTINCT CASE WHEN v < 10 THEN 'early' ELSE 'late' END, '; ' ORDER BY CASE WHEN v < 10 THEN 'early' ELSE 'late' END), '') END AS bins, count(DISTINCT nullif(trim(source), '')) AS n_sources,
  CASE max(c) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM m GROUP BY query, property""",
}
