"""Similarity queries: sign bits of embeddings as fingerprints, and the table of compound pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.operators import similarity as S
from florilege.session import table

THRESHOLD = 0.5


def _fingerprints(spark, d):
    bits = F.transform("embedding", lambda x: x > 0)
    return table(spark, d, "embeddings").select("vec_id", "label", S.pack_bits(bits).alias("words"))


def fingerprint_counts(spark, d):
    return _fingerprints(spark, d).select("vec_id", S.popcount(F.col("words")).alias("n_bits"))


def fingerprint_classes(spark, d):
    return S.fingerprint_classes(_fingerprints(spark, d), "vec_id", "words")


def tanimoto_pairs(spark, d):
    return S.similar_pairs(_fingerprints(spark, d), "vec_id", "words", THRESHOLD)


def tanimoto_nearest(spark, d):
    fps = _fingerprints(spark, d)
    return S.nearest_fingerprints(fps.filter("vec_id % 20 = 0"), fps, "vec_id", "words", 5)


def _membership(spark, d):
    return S.comparable_membership(table(spark, d, "plant_compounds"))


def comparable_membership(spark, d):
    return _membership(spark, d)


def comparable_scope_pairs(spark, d):
    return S.comparable_pair_summary(table(spark, d, "plant_compound_pair_tanimoto"), _membership(spark, d), "comparison_scope")


def comparable_group_pairs(spark, d):
    return S.comparable_pair_summary(table(spark, d, "plant_compound_pair_tanimoto"), _membership(spark, d), "comparison_group", (0.25, 0.75))


def species_pair_summary(spark, d):
    return S.species_pair_summary(table(spark, d, "plant_compound_pair_tanimoto"))


def unique_pairs(spark, d):
    return S.unique_pairs(table(spark, d, "plant_compound_pair_tanimoto"))


def top_pair_labels(spark, d):
    return S.top_pair_labels(table(spark, d, "plant_compound_pair_tanimoto"))


def group_membership(spark, d):
    return S.group_membership(table(spark, d, "plant_compounds"), "species")


def name_structure_conflicts(spark, d):
    return S.name_structure_conflicts(table(spark, d, "plant_compounds"))


def identity_conflicts(spark, d):
    return S.identity_conflicts(table(spark, d, "plant_compounds"))


def group_pair_count(spark, d):
    return S.group_pair_count(_membership(spark, d), "species")


def balanced_sample(spark, d):
    return S.balanced_sample(_membership(spark, d), "species", "compound_id", 25)


def pair_output_estimate(spark, d):
    return S.pair_output_estimate(_membership(spark, d), "compound_id")


QUERIES = {
    f.__name__: f
    for f in (
        fingerprint_counts, fingerprint_classes, tanimoto_pairs, tanimoto_nearest, comparable_membership, comparable_scope_pairs, comparable_group_pairs, species_pair_summary, unique_pairs,
        top_pair_labels, group_membership, name_structure_conflicts, identity_conflicts, group_pair_count, balanced_sample, pair_output_estimate,
    )
}

_F = "WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS bits, list_sum(list_transform(embedding, lambda x: (x > 0)::INT)) AS pop FROM embeddings)"
_SHARED = "list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: z[1] * z[2]))"
_MEMBER = "mem AS (SELECT species, compound_id, arg_min(comparison_scope, occurrence_id) AS comparison_scope, arg_min(comparison_group, occurrence_id) AS comparison_group FROM plant_compounds WHERE lower(trim(comparable_for_matrix)) IN ('yes', 'true', '1') AND lower(trim(comparison_scope)) NOT IN ('', 'unknown', 'unspecified', 'not_reported', 'not reported', 'na', 'none') AND species IS NOT NULL AND compound_id IS NOT NULL GROUP BY species, compound_id)"
_TIER = "CASE WHEN count(*) >= 10000 THEN 'high' WHEN count(*) >= 1000 THEN 'moderate' WHEN count(*) >= 100 THEN 'low' ELSE 'very_low' END AS support_tier"
_NON = "nullif(trim(regexp_replace({0}, '[\\s\\pZ]+', ' ', 'g')), '')"


def _stats(thresholds) -> str:
    return "count(*) AS n_pairs, round(avg(tanimoto), 6) AS mean_tanimoto, round(quantile_cont(tanimoto, 0.5), 6) AS median_tanimoto, round(quantile_cont(tanimoto, 0.95), 6) AS p95_tanimoto, max(tanimoto) AS max_tanimoto, " + ", ".join(f"count(*) FILTER (tanimoto >= {t}) AS n_ge_{str(t).replace('.', '_')}" for t in thresholds) + ", " + _TIER


def _comparable(field: str, thresholds) -> str:
    return f"WITH {_MEMBER} SELECT least(p.species_a, p.species_b) AS species_1, greatest(p.species_a, p.species_b) AS species_2, a.{field} AS comparison_value, {_stats(thresholds)} FROM plant_compound_pair_tanimoto p JOIN mem a ON a.species = species_a AND a.compound_id = compound_id_a JOIN mem b ON b.species = species_b AND b.compound_id = compound_id_b WHERE a.{field} = b.{field} AND tanimoto IS NOT NULL GROUP BY 1, 2, 3"


_KEY = "coalesce(trim(regexp_replace({0}, '[\\s\\pZ]+', ' ', 'g')), '<NA>')"
_A = _KEY.format("species_a") + " || '|' || " + _KEY.format("compound_id_a")
_B = _KEY.format("species_b") + " || '|' || " + _KEY.format("compound_id_b")
_SCOPE = _NON.format("comparison_scope")

ORACLES = {
    "fingerprint_counts": _F + " SELECT vec_id, pop AS n_bits FROM f",
    "fingerprint_classes": _F + " SELECT vec_id, min(vec_id) OVER (PARTITION BY bits) AS representative, count(*) OVER (PARTITION BY bits) AS class_size FROM f",
    "tanimoto_pairs": _F + f", r AS (SELECT bits, min(vec_id) AS id, count(*) AS n, any_value(pop) AS pop FROM f GROUP BY bits) SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, round({_SHARED} / (a.pop + b.pop - {_SHARED}), 6) AS tanimoto FROM r a JOIN r b ON a.id < b.id WHERE round({_SHARED} / (a.pop + b.pop - {_SHARED}), 6) >= {THRESHOLD}",
    "tanimoto_nearest": _F + f" SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS row_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_SHARED} / (a.pop + b.pop - {_SHARED}), 6) DESC NULLS LAST, b.vec_id) AS place, round({_SHARED} / (a.pop + b.pop - {_SHARED}), 6) AS tanimoto FROM f a JOIN f b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE place <= 5",
    "comparable_membership": f"WITH {_MEMBER} SELECT * FROM mem",
    "comparable_scope_pairs": _comparable("comparison_scope", (0.5, 0.7, 0.85, 0.95)),
    "comparable_group_pairs": _comparable("comparison_group", (0.25, 0.75)),
    "species_pair_summary": f"SELECT least(species_a, species_b) AS species_1, greatest(species_a, species_b) AS species_2, {_stats((0.5, 0.7, 0.85, 0.95))} FROM plant_compound_pair_tanimoto WHERE tanimoto IS NOT NULL GROUP BY 1, 2",
    "unique_pairs": f"SELECT least({_A}, {_B}) AS side_1, greatest({_A}, {_B}) AS side_2, min(pair_id) AS pair_id, first(tanimoto ORDER BY pair_id) AS tanimoto, count(*) AS n_rows FROM plant_compound_pair_tanimoto GROUP BY 1, 2",
    "top_pair_labels": "SELECT species_1, species_2, string_agg(txt, '; ' ORDER BY place) AS top_pairs FROM (SELECT least(species_a, species_b) AS species_1, greatest(species_a, species_b) AS species_2, compound_name_a || ' | ' || compound_name_b || '=' || format('{:.3f}', round(tanimoto + 1e-9, 3)) AS txt, row_number() OVER (PARTITION BY least(species_a, species_b), greatest(species_a, species_b) ORDER BY tanimoto DESC, pair_id) AS place FROM plant_compound_pair_tanimoto WHERE tanimoto IS NOT NULL) WHERE place <= 3 GROUP BY 1, 2",
    "group_membership": f"""WITH u AS (SELECT * FROM plant_compounds WHERE {_NON.format("species")} IS NOT NULL AND {_NON.format("compound_id")} IS NOT NULL),
s AS (SELECT species, compound_id, count(*) AS n_rows, CASE WHEN count(DISTINCT {_NON.format("inchikey")}) = 1 THEN max({_NON.format("inchikey")}) END AS inchikey, CASE WHEN count(DISTINCT {_NON.format("smiles")}) = 1 THEN max({_NON.format("smiles")}) END AS smiles,
  CASE WHEN count(DISTINCT {_SCOPE}) > 1 THEN 'mixed' ELSE coalesce(max({_SCOPE}), 'unknown') END AS comparison_scope, nullif(string_agg(DISTINCT {_NON.format("source_database")}, '; ' ORDER BY {_NON.format("source_database")}), '') AS sources FROM u GROUP BY 1, 2),
m AS (SELECT species, compound_id, compound_name_clean AS modal_name FROM (SELECT species, compound_id, compound_name_clean, count(*) AS n FROM u WHERE compound_name_clean IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY species, compound_id ORDER BY n DESC, compound_name_clean) = 1)
SELECT s.*, modal_name FROM s LEFT JOIN m USING (species, compound_id)""",
    "name_structure_conflicts": f"SELECT compound_name_clean, count(DISTINCT {_NON.format('inchikey')}) AS n_structures, count(*) AS n_rows FROM plant_compounds WHERE {_NON.format('compound_name_clean')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_NON.format('inchikey')}) > 1",
    "identity_conflicts": f"SELECT compound_id, count(DISTINCT cid) AS n_cids, count(DISTINCT {_NON.format('inchikey')}) AS n_inchikeys FROM plant_compounds WHERE {_NON.format('compound_id')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cid) > 1 OR count(DISTINCT {_NON.format('inchikey')}) > 1",
    "group_pair_count": f"WITH {_MEMBER}, s AS (SELECT species, count(*) AS n FROM mem GROUP BY 1) SELECT sum(n)::BIGINT AS n_members, (sum(n) * (sum(n) - 1) / 2)::BIGINT AS n_pairs, (sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1) / 2))::BIGINT AS n_group_pairs FROM s",
    "balanced_sample": f"WITH {_MEMBER}, r AS (SELECT species, compound_id, row_number() OVER (PARTITION BY species ORDER BY compound_id) AS turn FROM mem), f AS (SELECT compound_id, arg_min(turn, ROW(turn, species)) AS turn, arg_min(species, ROW(turn, species)) AS species FROM r GROUP BY 1) SELECT compound_id, turn, species FROM f ORDER BY turn, species, compound_id LIMIT 25",
    "pair_output_estimate": f"WITH {_MEMBER}, n AS (SELECT count(DISTINCT compound_id) AS n FROM mem) SELECT n AS n_compounds, (n * (n - 1) // 2)::BIGINT AS n_pairs, round((n * (n - 1) // 2) * 220 / 1e9, 6) AS compound_gb, round((n * (n - 1) // 2) * 260 / 1e9, 6) AS plant_gb, CASE WHEN n * (n - 1) // 2 <= 1000000 THEN 'in_memory' ELSE 'stream' END AS advice FROM n",
}
