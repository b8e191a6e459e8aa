"""Relative abundances of compounds per treatment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import non_empty


def long_profile(identity: DataFrame, quantity: DataFrame, row: str, treatments: list[str]) -> DataFrame:
    """Wide identities and abundances, aligned by row number and treatment column, as (treatment, row, compound, abundance).

    Rows without identity or abundance are left out; a negative abundance raises when it is read.
    """
    i = identity.select(row, F.explode(F.array(*[F.struct(F.lit(squish_name(t)).alias("treatment"), F.col(f"`{t}`").cast("string").alias("compound")) for t in treatments])).alias("x"))
    q = quantity.select(row, F.explode(F.array(*[F.struct(F.lit(squish_name(t)).alias("treatment"), F.col(f"`{t}`").cast("string").try_cast("double").alias("abundance")) for t in treatments])).alias("x"))
    joined = i.select(row, "x.treatment", non_empty(F.col("x.compound")).alias("compound")).join(q.select(row, "x.treatment", "x.abundance"), [row, "treatment"])
    checked = F.when(F.col("abundance") < 0, F.raise_error(F.lit("negative abundance"))).otherwise(F.col("abundance"))
    return joined.filter("compound is not null and abundance is not null").select("treatment", row, "compound", checked.cast("double").alias("abundance"))


def squish_name(name: str) -> str:
    return " ".join(name.split())


def relative_abundance(rows: DataFrame, least: float = 0.0) -> DataFrame:
    """Share of each compound in its treatment; shares under ``least`` are dropped and the rest scaled up to 1 again.

    Treatments without abundance are left out. Totals are window sums over already aggregated rows.
    """
    total = Window.partitionBy("treatment")
    sums = rows.groupBy("treatment", "compound").agg(F.sum("abundance").alias("abundance"))
    shares = sums.withColumn("total", F.sum("abundance").over(total)).filter("total > 0").withColumn("share", F.col("abundance") / F.col("total")).filter(F.col("share") >= least)
    return shares.withColumn("relative_abundance", F.col("abundance") / F.sum("abundance").over(total)).select("treatment", "compound", "abundance", "relative_abundance")


def align_treatments(identity: list[str], quantity: list[str], aliases: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """(treatment, identity column, quantity column) of two wide tables, by squished name, case ignored, after aliases of quantity columns.

    Treatments that only one of the tables has, or that a table has twice, raise with their names.
    """
    renamed = {squish_name(k).lower(): squish_name(v) for k, v in (aliases or {}).items()}
    name = lambda c: renamed.get(squish_name(c).lower(), squish_name(c))
    mine, theirs = [(squish_name(c), c) for c in identity], [(name(c), c) for c in quantity]
    for side in (mine, theirs):
        names = [n.lower() for n, _ in side]
        if len(set(names)) < len(names):
            raise ValueError(f"treatments come twice: {sorted({n for n in names if names.count(n) > 1})}")
    left, right = {n.lower(): (n, c) for n, c in mine}, {n.lower(): c for n, c in theirs}
    if set(left) != set(right):
        raise ValueError(f"treatments without a counterpart: {sorted(set(left) ^ set(right))}")
    return [(n, c, right[k]) for k, (n, c) in left.items()]
