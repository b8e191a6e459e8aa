"""GC-MS peaks: validation, spreading, target extraction and standardisation.

Peaks stay long (one row per peak); wide tables are made only for display.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.rules import hold
from florilege.functions.text import non_empty, squish
from florilege.session import stage

REQUIRED = ("component_rt", "component_area", "base_peak_mz", "file_name", "compound_name", "match_factor")
#: Exact masses that stand for "not resolved" and take no part in the fit.
NO_MASS = (58.041864811, 999.99)
#: Confident peaks lie at most this far below the best match factor; tentative peaks lie this near the best retention time.
MATCH_BAND, RT_BAND = 25.0, 0.15
#: Targets, and m/z values and names of all of them, that may be broadcast (about 50 MB); more meet the peaks by a shuffle join.
MAX_BROADCAST_TARGETS, MAX_BROADCAST_VALUES = 5_000, 1_000_000
#: Fixed value: the mass that targets without one are ordered by.
LAST_MASS = 999.999


def missing_columns(peaks: DataFrame) -> list[str]:
    """Required columns that a peak table lacks."""
    have = {c.lower() for c in peaks.columns}
    return [c for c in REQUIRED if c not in have]


def duplicate_peaks(peaks: DataFrame) -> DataFrame:
    """Keys (RT, area, m/z) that several peaks share; nulls group together."""
    return peaks.groupBy("component_rt", "component_area", "base_peak_mz").agg(F.count(F.lit(1)).alias("n_peaks")).filter("n_peaks > 1")


def spread_peaks(peaks: DataFrame, compound_info: DataFrame) -> DataFrame:
    """Peaks with the exact mass and the code "RT | mass" of their tentative compound.

    ``compound_info`` (compound_name, mass) is reduced to one row per name; unknown names get mass 999.99.
    """
    info = compound_info.groupBy("compound_name").agg(F.min("mass").alias("mass"))
    joined = peaks.join(info, "compound_name", "left").withColumn("mass", F.coalesce("mass", F.lit(NO_MASS[1])))
    return joined.withColumn("peak_code", F.concat_ws(" | ", F.format_string("%.4f", "component_rt"), F.format_string("%.4f", "mass")))


def peak_matrix(peaks: DataFrame, row: str, column: str, columns: list[str], value: Column) -> DataFrame:
    """Wide display: one row per ``row``, one column per listed value of ``column``; 0 where nothing was measured."""
    wide = peaks.groupBy(row).pivot(column, columns).agg(value)
    return wide.na.fill(0.0, columns)


def fit_retention(peaks: DataFrame) -> DataFrame:
    """One row: slope and intercept of RT over exact mass, over confident peaks of known mass."""
    best = peaks.agg(F.max("match_factor")).first()[0]
    used = peaks.filter((F.col("match_factor") > (best - MATCH_BAND if best is not None else 0.0)) & ~F.col("mass").isin(*NO_MASS))
    return used.agg(
        F.count(F.lit(1)).alias("n_peaks"),
        F.regr_slope(F.col("component_rt"), F.col("mass")).alias("slope"),
        F.regr_intercept(F.col("component_rt"), F.col("mass")).alias("intercept"),
    )


def extract_targets(peaks: DataFrame, targets: DataFrame, *, decontaminate: bool = True) -> DataFrame:
    """Target compounds per sample: compound, mass, sample, area, mean RT, best match.

    ``peaks``: peak_id, component_rt, component_area, match_factor, file_name, compound_name, mass, mz (array).
    ``targets``: compound, mass (null: unknown), names (array), mz (array); one row per compound.

    A peak belongs to a target exactly if its name is one of the target's names. Targets in order of
    mass have a predicted RT; a peak at or before the predicted RT of the next target that shares at
    least two m/z values is tentative, unless some target has it exactly. Tentative peaks count only
    in samples without an exact area, within RT_BAND of the best tentative RT, and each goes to the
    lightest target that takes it. Targets without mass come last and are dropped when decontaminating.

    Peaks are written once, narrow. The targets are broadcast with their m/z values, so a tentative peak
    finds its target inside its row: first the best RT of every target, combined before the shuffle, then
    the claims. The sums per compound and sample are the only shuffle of peaks.
    """
    slim = stage(peaks.select("peak_id", "component_rt", "component_area", "match_factor", "file_name", "compound_name", "mz", "mass"), "gcms-peaks")
    wanted = stage(targets.select("compound", F.coalesce("mass", F.lit(LAST_MASS)).alias("target_mass"), "names", F.array_distinct("mz").alias("target_mz")), "gcms-targets")
    fit = fit_retention(slim).first()
    order = Window.orderBy("target_mass", "compound")  # one row per target
    predicted = F.col("target_mass") * F.lit(fit["slope"]).cast("double") + F.lit(fit["intercept"]).cast("double")
    ordered = stage(wanted.withColumn("predicted_rt", predicted).withColumn("limit_rt", F.coalesce(F.lead("predicted_rt").over(order), F.col("predicted_rt"))).withColumn("place", F.row_number().over(order)), "gcms-ordered")
    size = ordered.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("target_mz") + F.size("names")), F.lit(0)).alias("v")).first()
    small = size["n"] <= MAX_BROADCAST_TARGETS and size["v"] <= MAX_BROADCAST_VALUES
    names = ordered.select("place", F.explode("names").alias("compound_name")).groupBy("compound_name").agg(F.sort_array(F.collect_set("place")).alias("places"))  # the targets of one name
    known = slim.join(F.broadcast(names) if small else names, "compound_name", "left")
    fields = ["component_rt", "component_area", "match_factor", "file_name"]
    exact = known.filter("places is not null").select(F.explode("places").alias("place"), *fields, F.lit(True).alias("exact"))
    rest = known.filter("places is null").select("peak_id", *fields, "mz")
    claim = _claims(rest, ordered) if small else _claims_by_join(rest, ordered)
    both = exact.unionByName(claim.select("place", *fields, F.lit(False).alias("exact")))

    def measures(rows: Column, tag: str) -> list[Column]:
        in_ = lambda c: F.when(rows, c)
        rt = F.col("component_rt")
        return [F.sum(in_(F.col("component_area"))).alias("area_" + tag), F.avg(in_(F.when(rt > 0, rt))).alias("rt_" + tag), F.max(in_(F.col("match_factor"))).alias("match_" + tag), F.count_if(rows).alias("n_" + tag)]

    sums = both.groupBy("place", "file_name").agg(*measures(F.col("exact"), "exact"), *measures(F.lit(True), "all"))
    pick = lambda c: F.when(F.col("area_exact") > 0, F.col(c + "_exact")).otherwise(F.col(c + "_all"))
    titles = ordered.select("place", "compound", F.col("target_mass").alias("mass"))
    out = sums.join(F.broadcast(titles) if small else titles, "place")
    out = out.select("compound", "mass", "file_name", pick("area").alias("area"), pick("rt").alias("mean_rt"), pick("match").alias("best_match"), pick("n").alias("n_peaks"))
    return out.filter((F.col("mass") != LAST_MASS) & F.col("mean_rt").isNotNull()) if decontaminate else out


def _claims(rest: DataFrame, ordered: DataFrame) -> DataFrame:
    """Tentative peaks with the place of the target that takes them; a few targets, found inside each row."""
    spark = rest.sparkSession
    limits, at_mz = {}, {}
    for r in ordered.select("place", "limit_rt", "target_mz").collect():  # bounded by MAX_BROADCAST_TARGETS and MAX_BROADCAST_VALUES
        limits[r["place"]] = r["limit_rt"]
        for m in r["target_mz"]:
            at_mz.setdefault(m, []).append(r["place"])
    if not at_mz:
        return rest.limit(0).withColumn("place", F.lit(0))
    mz_type = dict(ordered.dtypes)["target_mz"].removeprefix("array<").removesuffix(">")

    def attach(df: DataFrame, row: tuple, schema: str) -> DataFrame:
        return df.withColumn("__fl_one", F.lit(0)).join(F.broadcast(spark.createDataFrame([(0, *row)], "__fl_one int, " + schema)), "__fl_one").drop("__fl_one")

    places = F.array_sort(F.flatten(F.transform(F.array_distinct("mz"), lambda m: F.coalesce(F.try_element_at("at_mz", m), F.array().cast("array<int>")))))
    twice = F.filter(F.col("p"), lambda x, i: (i > 0) & (F.get(F.col("p"), i - 1) == x) & F.coalesce(F.get(F.col("limits"), x - 1) >= F.col("component_rt"), F.lit(False)))
    tables = (at_mz, [limits[k] for k in range(1, len(limits) + 1)])
    met = attach(rest, tables, f"at_mz map<{mz_type}, array<int>>, limits array<double>")
    at = lambda k: F.try_element_at("at_mz", F.get("mz", k))
    pair = F.array_sort(F.array_intersect(at(0), at(1)))  # two different m/z values are the common case, and cheaper than the count below
    of_two = (F.size("mz") == 2) & (F.get("mz", 0) != F.get("mz", 1))
    in_time = lambda x: F.coalesce(F.get(F.col("limits"), x - 1) >= F.col("component_rt"), F.lit(False))
    met = hold(met, p=F.when(of_two, F.coalesce(pair, F.array().cast("array<int>"))).otherwise(places))  # computed once a row: inlined into the filter it would be computed for every element
    met = stage(met.withColumn("p", F.when(of_two, F.filter("p", in_time)).otherwise(F.array_distinct(twice))).filter(F.size("p") > 0).drop("at_mz", "limits"), "gcms-met")
    best = {r["place"]: r["rt"] for r in met.select(F.explode("p").alias("place"), "component_rt").groupBy("place").agg(F.max("component_rt").alias("rt")).collect()}  # one row per target
    near = lambda x: F.abs(F.col("component_rt") - F.get(F.col("best"), x - 1)) <= RT_BAND
    taken = attach(met, ([best.get(k) for k in range(1, len(limits) + 1)],), "best array<double>")
    return taken.withColumn("place", F.get(F.filter("p", near), 0)).filter("place is not null").drop("p", "best", "mz")


def _claims_by_join(rest: DataFrame, ordered: DataFrame) -> DataFrame:
    """The same for any number of targets: m/z values meet in a shuffle join."""
    theirs = ordered.select("place", "limit_rt", F.explode("target_mz").alias("one_mz"))
    shared = (
        rest.select("*", F.explode(F.array_distinct("mz")).alias("one_mz"))
        .join(theirs, "one_mz")
        .filter("component_rt <= limit_rt")
        .groupBy("place", "peak_id")
        .agg(F.count(F.lit(1)).alias("n_shared"), *[F.any_value(c).alias(c) for c in ("component_rt", "component_area", "match_factor", "file_name")])
        .filter("n_shared >= 2")
    )
    shared = stage(shared, "gcms-shared")
    best = shared.groupBy("place").agg(F.max("component_rt").alias("best_rt"))
    near = shared.join(F.broadcast(best) if best.count() <= MAX_BROADCAST_TARGETS else best, "place").filter(F.abs(F.col("component_rt") - F.col("best_rt")) <= RT_BAND)
    return near.withColumn("turn", F.row_number().over(Window.partitionBy("peak_id").orderBy("place"))).filter("turn = 1").drop("turn", "best_rt", "n_shared")


def internal_standard(areas: DataFrame, standard: str, *, is_ng: float = 190.5, is_ul: float = 1.0, collect_time: float = 1.0, sample_amount: float = 1.0) -> DataFrame:
    """((area / standard's area in the sample) * ng) / uL / time / amount per compound and sample.

    ``areas``: compound, file_name, area. The standard's own rows are left out; a sample without an
    area of the standard (or with 0) gives null, and standard_problems names it.
    """
    own = areas.filter(F.col("compound") == standard).groupBy("file_name").agg(F.sum("area").alias("is_area"))
    ratio = F.col("area") / F.when(F.col("is_area") > 0, F.col("is_area"))
    value = ratio * is_ng / is_ul / collect_time / sample_amount
    return areas.filter(F.col("compound") != standard).join(own, "file_name", "left").select("compound", "file_name", "area", value.alias("amount"))


def standard_problems(areas: DataFrame, standard: str) -> DataFrame:
    """Samples in which the internal standard is missing or has no area."""
    own = areas.filter(F.col("compound") == standard).groupBy("file_name").agg(F.sum("area").alias("is_area"))
    return areas.select("file_name").distinct().join(own, "file_name", "left").filter("is_area is null or is_area = 0").select("file_name", F.when(F.col("is_area").isNull(), "missing").otherwise("zero").alias("problem"))


def calibration_models(calibration: DataFrame) -> DataFrame:
    """Three fits of area over ln(ng), exp(ng) and ng: model, n, slope, intercept, adjusted R2."""
    x = {"log": F.ln("quantity"), "exponent": F.exp("quantity"), "linear": F.col("quantity")}
    y = F.col("component_area")
    row = calibration.filter("quantity is not null and component_area is not null").agg(
        F.count(F.lit(1)).alias("n"), *[f(y, c).alias(f"{name}_{m}") for m, c in x.items() for name, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))]
    )
    models = F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(f"{k}_{m}").alias(k) for k in ("slope", "intercept", "r2")]) for m in x])
    flat = row.select("n", F.explode(models).alias("m")).select("n", "m.*")
    return flat.withColumn("adjusted_r2", 1 - F.try_divide((1 - F.col("r2")) * (F.col("n") - 1), F.col("n") - 2))


def external_standard(areas: DataFrame, calibration: DataFrame) -> DataFrame:
    """Areas turned into ng by the inverse of the best of the three fits; 0 and null areas stay null."""
    best = calibration_models(calibration).orderBy(F.col("adjusted_r2").desc_nulls_last(), "model").first()  # of three
    z = F.try_divide(F.col("area") - F.lit(best["intercept"]).cast("double"), F.lit(best["slope"]).cast("double"))
    amount = {"log": F.exp(z), "exponent": F.when(z > 0, F.ln(z)), "linear": z}[best["model"]]
    return areas.select("compound", "file_name", "area", F.lit(best["model"]).alias("model"), F.when(F.col("area") != 0, amount).alias("amount"))


def library_lists(library: DataFrame, kind: str, compound: str) -> DataFrame:
    """One row per type: its compounds, sorted and joined, and how many there are; blank types and compounds are left out."""
    rows = library.select(non_empty(F.col(kind)).alias("compound_type"), non_empty(F.col(compound)).alias("compound")).filter("compound_type is not null and compound is not null")
    return rows.groupBy("compound_type").agg(F.array_join(F.array_sort(F.collect_set("compound")), "; ").alias("compounds"), F.countDistinct("compound").alias("n_compounds"))


def library_long(wide: DataFrame) -> DataFrame:
    """Wide library (one column per type) to long (compound_type, compound) without blanks."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("compound_type"), non_empty(F.col(f"`{c}`")).alias("compound")) for c in wide.columns]))
    return wide.select(pairs.alias("p")).select("p.*").filter("compound is not null")


def database_sets(records: DataFrame, compound: str, database: str) -> DataFrame:
    """Distinct (database, compound) of usable records; "None", "NA" and blanks are not."""
    usable = lambda c: non_empty(c).isNotNull() & ~squish(c).isin("None", "NA")
    return records.filter(usable(F.col(compound)) & usable(F.col(database))).select(F.col(database).alias("database"), F.col(compound).alias("compound")).distinct()


def subset_union(sets: DataFrame, databases: list[str] | None = None) -> DataFrame:
    """Compounds that at least one of the databases has."""
    return (sets if databases is None else sets.filter(F.col("database").isin(*databases))).select("compound").distinct()


def subset_intersection(sets: DataFrame, databases: list[str]) -> DataFrame:
    """Compounds that all of the databases have: one aggregation instead of a chain of joins."""
    wanted = sorted(set(databases))
    return sets.filter(F.col("database").isin(*wanted)).groupBy("compound").agg(F.countDistinct("database").alias("n")).filter(F.col("n") == len(wanted)).select("compound")


def subset_numeric(table: DataFrame, column: str, relation: str, low: float, high: float | None = None) -> DataFrame:
    """Rows whose number is equal to, greater than, less than or (both ends excluded) between; texts that are no numbers never are."""
    v = F.trim(F.col(column).cast("string")).try_cast("double")
    conditions = {"equals": v == low, "greater than": v > low, "less than": v < low, "between": (v > low) & (v < high) if high is not None else F.lit(False)}
    if relation not in conditions:
        raise ValueError(f"relation is one of {sorted(conditions)}")
    return table.filter(conditions[relation])


def subset_flag(table: DataFrame, column: str) -> DataFrame:
    """Rows whose library flag is not "No"."""
    return table.filter(F.col(column).isNotNull() & (F.col(column) != "No"))
