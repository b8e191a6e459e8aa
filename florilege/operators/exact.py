"""Exact statistics and collapses of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import non_empty


def exact_percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Keys and exact percentiles (linear interpolation, as percentile gives them) of a number per group; nulls do not count.

    Equal values are counted before the shuffle. The counts of a group are cut into value ranges, whose
    sums say in which range a rank lies, so no task ranks a whole group: only the ranges that hold a
    wanted rank are sorted.
    """
    v = F.col(value).cast("double")
    counts = df.filter(v.isNotNull()).groupBy(*keys, v.alias("__fl_v")).agg(F.count(F.lit(1)).alias("__fl_n"))
    bucket = _range_of(F.col("__fl_v"))
    ranges = counts.groupBy(*keys, bucket.alias("__fl_b")).agg(F.sum("__fl_n").alias("__fl_s"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__fl_s").over(group.orderBy("__fl_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumns({"__fl_before": before, "__fl_all": F.sum("__fl_s").over(group)})
    ranks = [(name, side, F.lit(p) * (F.col("__fl_all") - 1)) for name, p in wanted.items() for side in ("low", "high")]
    rank = lambda side, at: F.floor(at) if side == "low" else F.ceil(at)
    holds = F.lit(False)
    for _, side, at in ranks:
        holds = holds | ((F.col("__fl_before") <= rank(side, at)) & (rank(side, at) < F.col("__fl_before") + F.col("__fl_s")))
    needed = placed.filter(holds)
    joined = _null_safe(counts.withColumn("__fl_b", bucket), needed, [*keys, "__fl_b"], ["__fl_before", "__fl_all"])
    inside = Window.partitionBy(*keys, "__fl_b").orderBy("__fl_v").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__fl_before") + F.coalesce(F.sum("__fl_n").over(inside), F.lit(0))
    run = joined.withColumn("__fl_start", start)
    inside_run = lambda side, at: (F.col("__fl_start") <= rank(side, at)) & (rank(side, at) < F.col("__fl_start") + F.col("__fl_n"))
    found = run.groupBy(*keys, "__fl_all").agg(*[F.max(F.when(inside_run(side, at), F.col("__fl_v"))).alias(f"__fl_{side}_{name}") for name, side, at in ranks])
    out = []
    for name, p in wanted.items():
        at, low, high = F.lit(p) * (F.col("__fl_all") - 1), F.col(f"__fl_low_{name}"), F.col(f"__fl_high_{name}")
        out.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    return found.select(*keys, *out)


def _range_of(v: Column) -> Column:
    """A whole number that rises with the number: sign, exponent and the first digits of it, about 64 ranges per doubling."""
    size = F.log2(F.abs(v)) * 64
    place = F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * (F.floor(F.greatest(F.least(size, F.lit(70_000.0)), F.lit(-70_000.0))) + 80_000))
    return place.cast("int")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """Inner join in which null keys are equal; takes some columns of the right side."""
    a, b = left.alias("a"), right.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select("a.*", *[F.col(f"b.{c}") for c in take])


def collapse_first_seen(df: DataFrame, keys: list[str], columns: list[str], order: str, sep: str = "; ") -> DataFrame:
    """Keys and, per column, the distinct non-empty values in the order of their first appearance, joined; null without values.

    Rows are reduced to one per key, column and value before anything is gathered, so a key of any number
    of rows brings only its distinct values to a task.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), non_empty(F.col(c)).alias("v")) for i, c in enumerate(columns)])).alias("__fl_p")
    once = df.select(*keys, F.col(order).alias("__fl_o"), pairs).filter("__fl_p.v is not null").groupBy(*keys, F.col("__fl_p.c").alias("__fl_c"), F.col("__fl_p.v").alias("__fl_v")).agg(F.min("__fl_o").alias("__fl_o"))

    def joined(i: int, name: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("__fl_c") == i, F.struct(F.col("__fl_o").alias("o"), F.col("__fl_v").alias("v")))))
        text = F.array_join(F.transform(found, lambda x: x["v"]), sep)
        return F.when(text != "", text).alias(name)

    return once.groupBy(*keys).agg(*[joined(i, c) for i, c in enumerate(columns)])
