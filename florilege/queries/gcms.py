"""Queries over loaded GC-MS peaks (standard_data) and the compound library."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions.rules import formula_mass
from florilege.operators import gcms
from florilege.session import stage, table

KINDS = ["Blank", "Cal", "Extract", "Mix", "Std"]
STANDARD = "pircevanal"


def _info(spark, d):
    """Exact masses of names from the formulas of the occurrence records."""
    return table(spark, d, "plant_compounds").select("compound_name", formula_mass(F.col("molecular_formula")).alias("mass")).filter("compound_name is not null and mass is not null").groupBy("compound_name").agg(F.min("mass").alias("mass"))


def _peaks(spark, d, info):
    """Peaks with masses; a file is a sample, m/z stands for the two nearest whole numbers."""
    mz = F.floor("base_peak_mz").cast("int")
    peaks = table(spark, d, "standard_data").filter("compound_name is not null").withColumn("mz", F.array(mz, mz + 1)).withColumn("file_name", F.trim("file_name"))
    return gcms.spread_peaks(peaks, info)


def _targets(spark, d, peaks, info):
    library = table(spark, d, "chemical_library")
    names = F.filter(F.transform(F.concat(F.array("compound"), F.split(F.coalesce("also_called", F.lit("")), ";")), lambda x: F.trim(x)), lambda x: x != "")
    mine = library.select(F.col("compound").alias("compound_name")).distinct()
    spectra = peaks.select("compound_name", F.explode("mz").alias("m")).join(mine, "compound_name", "left_semi").distinct().groupBy("compound_name").agg(F.collect_set("m").alias("mz"))  # one array per library name of whole m/z
    return (
        library.filter("compound is not null")
        .select("compound", names.alias("names"))
        .join(info.withColumnRenamed("compound_name", "compound"), "compound", "left")
        .join(spectra.withColumnRenamed("compound_name", "compound"), "compound", "left")
        .withColumn("mz", F.coalesce("mz", F.array().cast("array<int>")))
    )


def gcms_duplicate_keys(spark, d):
    return gcms.duplicate_peaks(table(spark, d, "standard_data"))


def gcms_spread(spark, d):
    return gcms.spread_peaks(table(spark, d, "standard_data").filter("compound_name is not null"), _info(spark, d)).select("peak_id", "compound_name", "component_rt", "component_area", "match_factor", "file_name", "mass")


def gcms_peak_matrix(spark, d):
    peaks = table(spark, d, "standard_data").withColumn("kind", F.split_part("file_name", F.lit("_"), F.lit(1)))
    wide = gcms.peak_matrix(peaks, "compound_name", "kind", KINDS, F.count(F.lit(1)).cast("double"))
    return wide.select("compound_name", *[F.col(k).cast("bigint").alias("n_" + k.lower()) for k in KINDS])


def gcms_retention_fit(spark, d):
    fit = gcms.fit_retention(gcms.spread_peaks(table(spark, d, "standard_data").filter("compound_name is not null"), _info(spark, d)))
    return fit.select("n_peaks", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"))


def _areas(spark, d):
    info = stage(_info(spark, d), "gcms-masses")
    peaks = _peaks(spark, d, info)
    return gcms.extract_targets(peaks, _targets(spark, d, peaks, info))


def gcms_extract(spark, d):
    """Targets in every file."""
    return _areas(spark, d).select("compound", "mass", "file_name", F.round("area", 4).alias("area"), F.round("mean_rt", 6).alias("mean_rt"), "best_match", "n_peaks")


def gcms_internal_standard(spark, d):
    """Amounts in every file, against the standard in the same file."""
    out = gcms.internal_standard(stage(_areas(spark, d), "gcms-areas"), STANDARD)
    return out.select("compound", "file_name", F.round("area", 4).alias("area"), F.round("amount", 4).alias("amount"))


def gcms_standard_problems(spark, d):
    areas = table(spark, d, "standard_data").groupBy(F.col("compound_name").alias("compound"), "file_name").agg(F.sum("component_area").alias("area"))
    return gcms.standard_problems(areas, STANDARD)


def _calibration(spark, d):
    peaks = table(spark, d, "standard_data").filter("file_name like 'Cal%'")
    return peaks.select((F.col("match_factor") / 10).alias("quantity"), "component_area")


def gcms_calibration(spark, d):
    models = gcms.calibration_models(_calibration(spark, d))
    return models.select("model", "n", *[F.round(c, 4).alias(c) for c in ("slope", "intercept")], F.round("adjusted_r2", 8).alias("adjusted_r2"))


def gcms_external_standard(spark, d):
    """Amounts of any size, to ten significant digits."""
    areas = table(spark, d, "standard_data").filter("compound_name is not null").groupBy(F.col("compound_name").alias("compound"), "file_name").agg(F.max("component_area").alias("area"))
    out = gcms.external_standard(areas, _calibration(spark, d))
    return out.withColumn("amount", F.when(F.col("amount").isNotNull(), F.format_string("%.9e", "amount").cast("double")))


def library_lists(spark, d):
    return gcms.library_lists(table(spark, d, "chemical_library"), "compound_type", "compound")


def library_long(spark, d):
    """Long again from a wide library that is made of the list first."""
    types = [f"class {x}" for x in "ABCDE"]
    wide = table(spark, d, "chemical_library").select(*[F.when(F.col("compound_type") == t, F.col("compound")).alias(t) for t in types])
    return gcms.library_long(wide)


def _sets(spark, d):
    return gcms.database_sets(table(spark, d, "plant_compounds"), "compound_name_clean", "source_database")


def database_sets(spark, d):
    return _sets(spark, d)


def subset_union(spark, d):
    return gcms.subset_union(_sets(spark, d))


def subset_intersection(spark, d):
    return gcms.subset_intersection(_sets(spark, d), ["PHYDOREX", "HERBORUM", "CHEMAREA"])


def subset_numeric(spark, d):
    rows = table(spark, d, "plant_compounds").select("occurrence_id", formula_mass(F.col("molecular_formula")).alias("mass"))
    return gcms.subset_numeric(rows, "mass", "between", 150, 350)


def subset_flag(spark, d):
    return gcms.subset_flag(table(spark, d, "plant_compounds"), "comparable_for_matrix").select("occurrence_id", "comparable_for_matrix")


def compound_masses(spark, d):
    return _info(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        gcms_duplicate_keys, gcms_spread, gcms_peak_matrix, gcms_retention_fit, gcms_extract, gcms_internal_standard, gcms_standard_problems, gcms_calibration, gcms_external_standard,
        library_lists, library_long, database_sets, subset_union, subset_intersection, subset_numeric, subset_flag, compound_masses,
    )
}

_MASS = """CASE WHEN regexp_full_match(molecular_formula, '([A-Z][a-z]?[0-9]*)+') THEN round(list_sum(list_transform(regexp_extract_all(molecular_formula, '[A-Z][a-z]?[0-9]*'),
  lambda p: MAP {'C': 12.0::DOUBLE, 'H': 1.00782503207, 'N': 14.0030740048, 'O': 15.99491461956, 'S': 31.972071, 'P': 30.97376163, 'Cl': 34.96885268, 'F': 18.99840322, 'Br': 78.9183371}[regexp_extract(p, '^([A-Z][a-z]?)', 1)]
  * coalesce(TRY_CAST(nullif(regexp_extract(p, '([0-9]+)$', 1), '') AS DOUBLE), 1.0))), 6) END"""
_INFO = f"info AS (SELECT compound_name, min({_MASS}) AS mass FROM plant_compounds WHERE compound_name IS NOT NULL GROUP BY compound_name HAVING min({_MASS}) IS NOT NULL)"
_SPREAD = "peaks AS (SELECT s.*, coalesce(i.mass, 999.99) AS mass FROM standard_data s LEFT JOIN info i USING (compound_name) WHERE compound_name IS NOT NULL)"
_FIT = """fit AS (SELECT count(*) AS n_peaks, regr_slope(component_rt, mass) AS slope, regr_intercept(component_rt, mass) AS intercept FROM peaks
  WHERE match_factor > (SELECT max(match_factor) FROM peaks) - 25 AND mass NOT IN (58.041864811, 999.99))"""
_EXTRACT = f"""WITH {_INFO}, {_SPREAD}, {_FIT},
slim AS (SELECT peak_id, component_rt, component_area, match_factor, trim(file_name) AS file_name, compound_name, [floor(base_peak_mz)::INT, floor(base_peak_mz)::INT + 1] AS mz FROM peaks),
spectra AS (SELECT compound_name, list(DISTINCT m) AS mz FROM (SELECT compound_name, unnest(mz) AS m FROM slim) GROUP BY compound_name),
tg AS (SELECT l.compound, coalesce(i.mass, 999.999) AS target_mass, coalesce(s.mz, []) AS mz,
  list_filter(list_transform(list_concat([l.compound], string_split(coalesce(also_called, ''), ';')), lambda x: trim(x)), lambda x: x <> '') AS names
  FROM chemical_library l LEFT JOIN info i ON i.compound_name = l.compound LEFT JOIN spectra s ON s.compound_name = l.compound WHERE l.compound IS NOT NULL),
od AS (SELECT *, row_number() OVER w AS place, coalesce(lead(p) OVER w, p) AS limit_rt FROM (SELECT tg.*, target_mass * slope + intercept AS p FROM tg, fit) WINDOW w AS (ORDER BY target_mass, compound)),
ex AS (SELECT DISTINCT o.compound, target_mass, peak_id, component_rt, component_area, match_factor, file_name FROM slim JOIN (SELECT DISTINCT compound, target_mass, unnest(names) AS n FROM od) o ON n = compound_name),
rest AS (SELECT * FROM slim WHERE peak_id NOT IN (SELECT peak_id FROM ex)),
sh AS (SELECT o.compound, target_mass, place, r.peak_id, any_value(component_rt) AS component_rt, any_value(component_area) AS component_area, any_value(match_factor) AS match_factor, any_value(file_name) AS file_name
  FROM (SELECT *, unnest(mz) AS m FROM rest) r JOIN (SELECT compound, target_mass, place, limit_rt, unnest(list_distinct(mz)) AS m FROM od) o ON r.m = o.m AND component_rt <= limit_rt GROUP BY ALL HAVING count(*) >= 2),
nr AS (SELECT * FROM (SELECT *, max(component_rt) OVER (PARTITION BY compound) AS best FROM sh) WHERE abs(component_rt - best) <= 0.15),
cl AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY peak_id ORDER BY place) = 1),
wx AS (SELECT compound, file_name FROM ex GROUP BY ALL HAVING sum(component_area) > 0),
te AS (SELECT compound, target_mass, peak_id, component_rt, component_area, match_factor, file_name FROM cl WHERE (compound, file_name) NOT IN (SELECT (compound, file_name) FROM wx)),
ar AS (SELECT compound, target_mass AS mass, file_name, sum(component_area) AS area, avg(component_rt) FILTER (component_rt > 0) AS mean_rt, max(match_factor) AS best_match, count(*) AS n_peaks
  FROM (SELECT * FROM ex UNION ALL SELECT * FROM te) GROUP BY ALL HAVING target_mass <> 999.999 AND avg(component_rt) FILTER (component_rt > 0) IS NOT NULL)
"""
_USABLE = "trim(compound_name_clean) <> '' AND trim(compound_name_clean) NOT IN ('None', 'NA') AND trim(source_database) <> '' AND trim(source_database) NOT IN ('None', 'NA')"
_CAL = "cal AS (SELECT match_factor / 10 AS q, component_area AS a FROM standard_data WHERE file_name LIKE 'Cal%' AND match_factor IS NOT NULL AND component_area IS NOT NULL)"


def _model(name: str, x: str) -> str:
    return f"SELECT '{name}' AS model, count(*) AS n, regr_slope(a, {x}) AS slope, regr_intercept(a, {x}) AS intercept, 1 - (1 - regr_r2(a, {x})) * (count(*) - 1) / (count(*) - 2) AS adjusted_r2 FROM cal"


_MODELS = f"WITH {_CAL}, models AS ({_model('log', 'ln(q)')} UNION ALL {_model('exponent', 'exp(q)')} UNION ALL {_model('linear', 'q')})"

ORACLES = {
    "gcms_duplicate_keys": "SELECT component_rt, component_area, base_peak_mz, count(*) AS n_peaks FROM standard_data GROUP BY ALL HAVING count(*) > 1",
    "gcms_spread": f"WITH {_INFO}, {_SPREAD} SELECT peak_id, compound_name, component_rt, component_area, match_factor, file_name, mass FROM peaks",
    "gcms_peak_matrix": "SELECT compound_name, " + ", ".join(f"count(*) FILTER (split_part(file_name, '_', 1) = '{k}') AS n_{k.lower()}" for k in KINDS) + " FROM standard_data GROUP BY compound_name",
    "gcms_retention_fit": f"WITH {_INFO}, {_SPREAD}, {_FIT} SELECT n_peaks, round(slope, 8) AS slope, round(intercept, 6) AS intercept FROM fit",
    "gcms_extract": _EXTRACT + "SELECT compound, mass, file_name, round(area, 4) AS area, round(mean_rt, 6) AS mean_rt, best_match, n_peaks FROM ar",
    "gcms_internal_standard": _EXTRACT
    + f"SELECT a.compound, file_name, round(a.area, 4) AS area, round(a.area / CASE WHEN s.area > 0 THEN s.area END * 190.5, 4) AS amount FROM ar a LEFT JOIN (SELECT file_name, sum(area) AS area FROM ar WHERE compound = '{STANDARD}' GROUP BY 1) s USING (file_name) WHERE a.compound <> '{STANDARD}'",
    "gcms_standard_problems": f"SELECT file_name, CASE WHEN a IS NULL THEN 'missing' ELSE 'zero' END AS problem FROM (SELECT file_name, sum(component_area) FILTER (compound_name = '{STANDARD}') AS a FROM standard_data GROUP BY 1) WHERE a IS NULL OR a = 0",
    "gcms_calibration": _MODELS + "SELECT model, n, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(adjusted_r2, 8) AS adjusted_r2 FROM models",
    "gcms_external_standard": _MODELS
    + """, best AS (SELECT * FROM models ORDER BY adjusted_r2 DESC NULLS LAST, model LIMIT 1),
ar AS (SELECT compound_name AS compound, file_name, max(component_area) AS area FROM standard_data WHERE compound_name IS NOT NULL GROUP BY ALL),
z AS (SELECT ar.*, model, (area - intercept) / slope AS z FROM ar, best),
v AS (SELECT *, CASE WHEN area <> 0 THEN CASE model WHEN 'log' THEN exp(z) WHEN 'exponent' THEN CASE WHEN z > 0 THEN ln(z) END ELSE z END END AS amount FROM z)
SELECT compound, file_name, area, model, printf('%.9e', amount)::DOUBLE AS amount FROM v""",
    "library_lists": "SELECT compound_type, string_agg(compound, '; ' ORDER BY compound) AS compounds, count(*) AS n_compounds FROM (SELECT DISTINCT trim(compound_type) AS compound_type, trim(compound) AS compound FROM chemical_library WHERE trim(compound_type) <> '' AND trim(compound) <> '') GROUP BY compound_type",
    "library_long": "SELECT compound_type, compound FROM chemical_library WHERE compound_type IN ('class A', 'class B', 'class C', 'class D', 'class E') AND trim(compound) <> ''",
    "database_sets": f"SELECT DISTINCT source_database AS database, compound_name_clean AS compound FROM plant_compounds WHERE {_USABLE}",
    "subset_union": f"SELECT DISTINCT compound_name_clean AS compound FROM plant_compounds WHERE {_USABLE}",
    "subset_intersection": " INTERSECT ".join(f"SELECT compound_name_clean AS compound FROM plant_compounds WHERE source_database = '{s}' AND {_USABLE}" for s in ("PHYDOREX", "HERBORUM", "CHEMAREA")),
    "subset_numeric": f"SELECT occurrence_id, mass FROM (SELECT occurrence_id, {_MASS} AS mass FROM plant_compounds) WHERE mass > 150 AND mass < 350",
    "subset_flag": "SELECT occurrence_id, comparable_for_matrix FROM plant_compounds WHERE comparable_for_matrix <> 'No'",
    "compound_masses": f"WITH {_INFO} SELECT * FROM info",
}
