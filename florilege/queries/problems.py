"""Queries of the general problems: hot keys, orphan references, lines that do not parse."""

from __future__ import annotations

from florilege.operators.orphans import open_plant_references, orphan_counts, orphan_snapshots, plant_orphans
from florilege.operators.tree_aggregate import TIERS, species_compounds, species_profile
from florilege.session import stage, table
from florilege.sources.peak_lines import broken_lines, loaded_peaks, rejected_lines

WORDS_SQL = "array_to_string(list_sort(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{Nd}}]+')), ' ')"


def words_sql(column: str) -> str:
    return WORDS_SQL.format(column)


def p1_species_compounds(spark, d):
    return species_compounds(table(spark, d, "plant_compounds"))


def p1_species_profile(spark, d):
    return species_profile(table(spark, d, "plant_compounds"))


def _p3_tables(spark, d):
    return tuple(table(spark, d, t) for t in ("plant_compounds", "plant_metadata", "plant_compound_pair_tanimoto", "plant_list"))


def p3_found(spark, d):
    return plant_orphans(*_p3_tables(spark, d))


def p3_counts(spark, d):
    orphans = stage(p3_found(spark, d), "p3-found")
    return orphan_counts(orphans, *_p3_tables(spark, d)[:3])


def p3_snapshots(spark, d):
    return orphan_snapshots(*_p3_tables(spark, d))


def p3_open(spark, d):
    """References that are orphans after all events, those that deletions have reopened included."""
    return open_plant_references(*_p3_tables(spark, d))


def p4_found(spark, d):
    return broken_lines(table(spark, d, "standard_data_raw"))


def p4_loaded(spark, d):
    return loaded_peaks(table(spark, d, "standard_data_raw"))


def p4_rejected(spark, d):
    return rejected_lines(table(spark, d, "standard_data_raw"))


_TIER = "coalesce(lower(trim(evidence_tier)), '')"
_P1_ROWS = f"""
WITH r AS (SELECT {words_sql("species")} AS species_key, {words_sql("compound_name")} AS compound_key, {_TIER} AS tier, retrieved_at FROM plant_compounds)
"""
_P1_STATES = f"""count(*) AS n_rows,
  {", ".join(f"count(*) FILTER (tier = '{t}') AS n_tier_{i + 1}" for i, t in enumerate(TIERS))},
  count(*) FILTER (tier NOT IN ({", ".join(f"'{t}'" for t in TIERS)})) AS n_tier_other,
  min(retrieved_at) AS first_retrieved_at, max(retrieved_at) AS last_retrieved_at"""

_P3_SQL = f"""
WITH ma AS (SELECT {words_sql("species")} AS k, valid_from AS b, withdrawn_at AS e FROM plant_metadata),
ra AS (SELECT occurrence_id AS row_id, {words_sql("species")} AS k, retrieved_at AS t FROM plant_compounds),
mb AS (SELECT lower(trim(compound_id)) AS k, retrieved_at AS b, withdrawn_at AS e FROM plant_compounds WHERE trim(compound_id) <> ''),
rb AS (SELECT pair_id AS row_id, lower(trim(compound_id_a)) AS k, computed_at AS t FROM plant_compound_pair_tanimoto WHERE trim(compound_id_a) <> ''),
la AS (SELECT ra.row_id, count(ma.k) AS n, coalesce(bool_or(b <= t AND (e IS NULL OR e > t)), false) AS there, coalesce(bool_or(b <= t), false) AS begun
  FROM ra LEFT JOIN ma USING (k) WHERE ra.k <> '' GROUP BY ra.row_id),
lb AS (SELECT rb.row_id, count(mb.k) AS n, coalesce(bool_or(b <= t AND (e IS NULL OR e > t)), false) AS there, coalesce(bool_or(b <= t), false) AS begun
  FROM rb LEFT JOIN mb USING (k) GROUP BY rb.row_id),
found AS (
SELECT 'plant_compounds' AS ref_table, row_id, CASE WHEN n = 0 THEN 'missing' WHEN begun THEN 'deleted' ELSE 'late' END AS reason FROM la WHERE NOT there
UNION ALL SELECT 'plant_compound_pair_tanimoto', row_id, CASE WHEN n = 0 THEN 'missing' WHEN begun THEN 'deleted' ELSE 'late' END FROM lb WHERE NOT there
UNION ALL SELECT 'plant_metadata', metadata_id, 'missing' FROM plant_metadata
  WHERE {words_sql("species")} <> '' AND {words_sql("species")} NOT IN (SELECT {words_sql("species")} FROM plant_list))
"""

_P3_EVENTS = f"""
WITH refs AS (SELECT 'a' AS r, 'plant_compounds' AS ref_table, occurrence_id AS row_id, {words_sql("species")} AS k, retrieved_at AS t FROM plant_compounds
UNION ALL SELECT 'b', 'plant_compound_pair_tanimoto', pair_id, lower(trim(compound_id_a)), computed_at FROM plant_compound_pair_tanimoto
UNION ALL SELECT 'c', 'plant_metadata', metadata_id, {words_sql("species")}, valid_from FROM plant_metadata),
rf AS (SELECT * REPLACE (coalesce(t, TIMESTAMP '0001-01-01') AS t) FROM refs WHERE k <> ''),
pa AS (SELECT r, k, b, e, n AND (e IS NULL OR e > b) AS held FROM (SELECT r, k, coalesce(b, TIMESTAMP '9999-01-01') AS b, e, b IS NOT NULL AS n FROM (
  SELECT 'a' AS r, {words_sql("species")} AS k, valid_from AS b, withdrawn_at AS e FROM plant_metadata
  UNION ALL SELECT 'b', lower(trim(compound_id)), retrieved_at, withdrawn_at FROM plant_compounds
  UNION ALL SELECT 'c', {words_sql("species")}, TIMESTAMP '0001-01-01', NULL FROM plant_list) WHERE k <> '')),
ks AS (SELECT r, k FROM rf UNION SELECT r, k FROM pa),
kp AS (SELECT r, k, count(*) AS n, count(*) FILTER (held AND e IS NULL) AS still FROM pa GROUP BY r, k)
"""
_P3_PERIODS = """, tt AS (SELECT r, k, t FROM rf UNION ALL SELECT r, k, b FROM pa UNION ALL SELECT r, k, e FROM pa WHERE held AND e IS NOT NULL),
pe AS (SELECT r, k, t, (year(t) * 12 + month(t) - 1) // 24 AS p FROM tt), ps AS (SELECT DISTINCT p FROM pe),
dl AS (SELECT r, k, p, sum(a) AS a, sum(g) AS g, sum(n) AS n FROM (
  SELECT r, k, (year(b) * 12 + month(b) - 1) // 24 AS p, held::INT AS a, 1 AS g, 0 AS n FROM pa
  UNION ALL SELECT r, k, (year(e) * 12 + month(e) - 1) // 24, -1, 0, 0 FROM pa WHERE held AND e IS NOT NULL
  UNION ALL SELECT r, k, (year(t) * 12 + month(t) - 1) // 24, 0, 0, 1 FROM rf) GROUP BY r, k, p),
st AS (SELECT ps.p, dl.r, dl.k, sum(a) AS a, sum(g) AS g, sum(n) AS n FROM ps JOIN dl ON dl.p <= ps.p GROUP BY ALL)
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
_NUM = "regexp_full_match({0}, '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?')"


def _bad(i: int, most: str = "", empty: bool = False) -> str:
    v = f"v[{i}]"
    value = f"CAST(ltrim({v}, '+') AS DOUBLE)"
    inside = f"{value} > 0" + (f" AND {value} <= {most}" if most else "")
    test = f"NOT (CASE WHEN {_NUM.format(v)} THEN {inside} ELSE false END)"
    return f"({v} <> '' AND {test})" if empty else f"({test})"


_P4_CTE = f"""
WITH q AS (SELECT line_id, coalesce(raw_line, '') AS l FROM standard_data_raw),
f AS (SELECT line_id, l, regexp_full_match(l, '([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*', 's') AS fits,
  regexp_extract_all(l || ',', '("(?:[^"]|"")*"|[^",]*),', 1) AS fields FROM q),
g AS (SELECT line_id, fits, len(fields) AS n, list_transform(fields, lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END, {_BLANKS})) AS v FROM f),
r AS (SELECT line_id, v, CASE WHEN NOT fits THEN 'quoting' WHEN n <> 8 THEN 'column_count'
  WHEN {_bad(1, "120")} OR {_bad(2)} OR {_bad(3, empty=True)} OR {_bad(4)} OR v[5] = '' OR {_bad(6, "100")} OR v[8] = '' THEN 'invalid_value' END AS reason FROM g)
"""
_P4_NUMBER = "CAST(ltrim(nullif(v[{0}], ''), '+') AS DOUBLE) AS {1}"

QUERIES = {
    "p1_species_compounds": p1_species_compounds,
    "p1_species_profile": p1_species_profile,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p3_snapshots": p3_snapshots,
    "p3_open": p3_open,
    "p4_found": p4_found,
    "p4_loaded": p4_loaded,
    "p4_rejected": p4_rejected,
}

ORACLES = {
    "p1_species_compounds": _P1_ROWS + f"SELECT species_key, compound_key, {_P1_STATES} FROM r GROUP BY species_key, compound_key",
    "p1_species_profile": _P1_ROWS + f"SELECT species_key, count(DISTINCT nullif(compound_key, '')) AS n_compounds, {_P1_STATES} FROM r GROUP BY species_key",
    "p3_found": _P3_SQL + "SELECT * FROM found",
    "p3_counts": _P3_SQL
    + """, times AS (SELECT 'plant_compounds' AS ref_table, occurrence_id AS row_id, retrieved_at AS at_time FROM plant_compounds
UNION ALL SELECT 'plant_compound_pair_tanimoto', pair_id, computed_at FROM plant_compound_pair_tanimoto
UNION ALL SELECT 'plant_metadata', metadata_id, valid_from FROM plant_metadata)
SELECT ref_table, strftime(at_time, '%Y-%m') AS month, reason, count(*) AS n_orphans FROM found JOIN times USING (ref_table, row_id) GROUP BY ALL""",
    "p3_snapshots": _P3_EVENTS + _P3_PERIODS + """SELECT p::INT AS period, r AS relation, count(*) FILTER (a > 0) AS keys_on_file, count(*) FILTER (a <= 0 AND g > 0) AS keys_gone,
  coalesce(sum(n) FILTER (a <= 0 AND g = 0), 0)::BIGINT AS refs_waiting, coalesce(sum(n) FILTER (a <= 0 AND g > 0), 0)::BIGINT AS refs_gone FROM st GROUP BY p, r""",
    "p3_open": _P3_EVENTS + "SELECT ref_table, row_id, CASE WHEN n IS NULL THEN 'waiting' ELSE 'gone' END AS status FROM rf LEFT JOIN kp USING (r, k) WHERE coalesce(still, 0) = 0",
    "p4_found": _P4_CTE + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p4_loaded": _P4_CTE
    + "SELECT line_id, "
    + ", ".join(
        _P4_NUMBER.format(i + 1, c) if i in (0, 1, 2, 3, 5) else f"nullif(v[{i + 1}], '') AS {c}"
        for i, c in enumerate(("component_rt", "base_peak_mz", "base_peak_area", "component_area", "compound_name", "match_factor", "sample_name", "file_name"))
    )
    + " FROM r WHERE reason IS NULL",
}
