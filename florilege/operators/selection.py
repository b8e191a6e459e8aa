"""Choosing and mapping: coverage-first selection, spaced picks, identity maps, merged accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import label, non_empty
from florilege.session import stage


def compound_priorities(rows: DataFrame) -> DataFrame:
    """Per compound: direct records, species, sources and records."""
    direct = F.coalesce(label(F.col("evidence_tier")).contains("direct"), F.lit(False))
    return rows.filter(non_empty(F.col("compound_id")).isNotNull()).groupBy("compound_id").agg(
        F.count_if(direct).alias("n_direct"), F.countDistinct(non_empty(F.col("species"))).alias("n_species"), F.countDistinct(label(F.col("source_database"))).alias("n_sources"), F.count(F.lit(1)).alias("n_records")
    )


def coverage_first(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """``limit`` compounds: first the best of every group, then the best of the rest.

    The order is direct records, species, sources, records (all descending), then the id, so it is
    total. The best of a group is a mergeable minimum; no group is ranked in one task.
    """
    priority = compound_priorities(rows)
    order = F.struct(-F.col("n_direct"), -F.col("n_species"), -F.col("n_sources"), -F.col("n_records"), F.col("compound_id"))
    members = rows.filter(non_empty(F.col(group)).isNotNull()).select(group, "compound_id").distinct().join(priority, "compound_id")
    covering = members.groupBy(group).agg(F.min_by("compound_id", order).alias("compound_id")).select("compound_id").distinct().withColumn("covers", F.lit(True))
    ranked = priority.join(covering, "compound_id", "left").withColumn("covers", F.coalesce("covers", F.lit(False)))
    return ranked.orderBy(F.desc("covers"), F.desc("n_direct"), F.desc("n_species"), F.desc("n_sources"), F.desc("n_records"), "compound_id").limit(limit)


def spaced_pick(df: DataFrame, stratum: str, order: str, per_stratum: int) -> DataFrame:
    """Evenly spaced rows of every stratum in order, at most ``per_stratum`` of each; no chance involved.

    Rows of the same stratum and order are taken or left out together, and count once. Places are counted
    over slices of the ordered table, so no task numbers a whole stratum: a slice's first place is the sum of
    the slices before it. A null stratum is one of its own.
    """
    points = df.groupBy(stratum, order).agg(F.count(F.lit(1)).alias("__fl_rows")).repartitionByRange(F.col(stratum), F.col(order)).withColumn("__fl_slice", F.spark_partition_id())
    points = stage(points, "spaced-points")
    sums = points.groupBy(stratum, "__fl_slice").agg(F.count(F.lit(1)).alias("__fl_s"))
    w = Window.partitionBy(stratum)
    starts = sums.withColumn("__fl_n", F.sum("__fl_s").over(w)).withColumn("__fl_start", F.coalesce(F.sum("__fl_s").over(w.orderBy("__fl_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    a, b = points.alias("a"), starts.alias("b")
    joined = a.join(b, F.col(f"a.{stratum}").eqNullSafe(F.col(f"b.{stratum}")) & (F.col("a.__fl_slice") == F.col("b.__fl_slice"))).select("a.*", "b.__fl_n", "b.__fl_start")
    place = F.col("__fl_start") + F.row_number().over(Window.partitionBy(stratum, "__fl_slice").orderBy(order)) - 1
    numbered = joined.withColumn("__fl_place", place)
    step = lambda c: F.floor(c * F.lit(per_stratum) / F.col("__fl_n"))
    taken = numbered.filter((F.col("__fl_place") == 0) | (step(F.col("__fl_place")) != step(F.col("__fl_place") - 1))).select(F.col(stratum).alias("__fl_stratum"), F.col(order).alias("__fl_order"))
    return df.join(taken, F.col(stratum).eqNullSafe(F.col("__fl_stratum")) & F.col(order).eqNullSafe(F.col("__fl_order"))).drop("__fl_stratum", "__fl_order")


def selector(cid: Column, inchikey: Column, name: Column) -> Column:
    """What a compound is looked up by: CID, else InChIKey, else name."""
    return F.coalesce(F.concat(F.lit("cid:"), cid.cast("string")), F.concat(F.lit("inchikey:"), F.upper(non_empty(inchikey))), F.concat(F.lit("name:"), label(name)))


def query_map(rows: DataFrame) -> DataFrame:
    """(name, selector, n_rows, eligible): names of several selectors are not eligible."""
    keyed = rows.select(label(F.col("compound_name")).alias("name"), selector(F.col("cid"), F.col("inchikey"), F.col("compound_name")).alias("selector")).filter("name is not null")
    counts = keyed.groupBy("name", "selector").agg(F.count(F.lit(1)).alias("n_rows"))
    several = counts.groupBy("name").agg(F.count(F.lit(1)).alias("n_selectors"))
    return counts.join(several, "name").select("name", "selector", "n_rows", (F.col("n_selectors") == 1).alias("eligible"))


def record_identity(rows: DataFrame, identities: DataFrame) -> DataFrame:
    """Rows with the identity of their source record: exact, any_source, conflict or none.

    ``identities``: source_database (null: any), record_id, inchikey. Several keys of one record are a conflict.
    """
    grouped = identities.filter("record_id is not null").groupBy(label(F.col("source_database")).alias("__fl_db"), F.col("record_id").alias("source_record_id")).agg(F.countDistinct("inchikey").alias("k"), F.min("inchikey").alias("v"))
    exact = grouped.filter("__fl_db is not null").select("__fl_db", "source_record_id", F.col("k").alias("k1"), F.col("v").alias("v1"))
    loose = grouped.filter("__fl_db is null").select("source_record_id", F.col("k").alias("k2"), F.col("v").alias("v2"))
    out = rows.select("occurrence_id", label(F.col("source_database")).alias("__fl_db"), "source_record_id").join(exact, ["__fl_db", "source_record_id"], "left").join(loose, "source_record_id", "left")
    status = F.when(F.coalesce("k1", "k2") > 1, "conflict").when(F.col("k1").isNotNull(), "exact").when(F.col("k2").isNotNull(), "any_source").otherwise("none")
    return out.select("occurrence_id", status.alias("identity_status"), F.when(status.isin("exact", "any_source"), F.coalesce("v1", "v2")).alias("identity"))


def merge_accounts(accounts: list[DataFrame]) -> DataFrame:
    """One row per (plant_id, source): records before fallbacks before none, then the later account."""
    out = None
    for i, part in enumerate(accounts):
        part = part.select("plant_id", "source", "status", "n_direct", "n_fallback", F.lit(i).alias("__fl_part"))
        out = part if out is None else out.unionByName(part)
    rank = F.when(F.col("status") == "records", 0).when(F.col("status") == "fallback_only", 1).otherwise(2)
    best = out.groupBy("plant_id", "source").agg(F.min_by(F.struct("status", "n_direct", "n_fallback"), F.struct(rank, -F.col("__fl_part"))).alias("b"))
    return best.select("plant_id", "source", "b.*")


def presence_report(species_list: DataFrame, matches: DataFrame, source: str) -> DataFrame:
    """Plants without a record of one source."""
    return species_list.join(matches.filter(F.col("source") == source).select("plant_id").distinct(), "plant_id", "left_anti")
