"""Records that differ only in formatting: one record per group of copies, with the number of copies.

The canonical form of a record (sorted words of the worded columns, the other columns as they are)
is hashed to 128 bits. Partial counts per canonical key show exactly which keys are hot. Rows of hot
keys are salted and aggregated in two levels; all other keys go through one shuffle. The
representative of a group is its smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import words_key
from florilege.operators.skew import hot_threshold, salt
from florilege.session import stage

#: Salted parts of a hot key.
SALTS = 64
_KEY = ["__fl_k1", "__fl_k2"]
_ROW = "__fl_row"
#: Columns of plant_compounds that do not tell records apart.
COMPOUND_IGNORED = ("occurrence_id", "compound_name_clean", "retrieved_at", "loaded_at", "withdrawn_at")
COMPOUND_WORDED = ("species", "compound_name")


def canonical_keys(df: DataFrame, row_id: str, worded: tuple[str, ...], ignored: tuple[str, ...], keep: bool = False) -> DataFrame:
    """The identifier and the 128-bit canonical key of each row, with ``keep`` after all its columns; null equals null, and '' differs from null except in worded columns."""
    parts: list[Column] = [words_key(F.col(c)) for c in worded]
    others = [F.col(f"`{c}`") for c in df.columns if c not in worded and c not in ignored and c != row_id]
    nulls = F.lit(0).cast("long")
    for i, c in enumerate(others):  # which of them are null, as the hash passes over nulls
        nulls = nulls.bitwiseXOR(F.when(c.isNull(), F.xxhash64(F.lit(i))).otherwise(F.lit(0)).cast("long"))
    forward, backward = [nulls, *parts, *others], [F.lit(1), *others[::-1], *parts[::-1], nulls]
    kept = [F.col(f"`{c}`") for c in df.columns] if keep else []
    return df.select(*kept, F.col(row_id).cast("bigint").alias(_ROW), F.xxhash64(*forward).alias(_KEY[0]), F.xxhash64(*backward).alias(_KEY[1]))


def hot_groups(keyed: DataFrame) -> DataFrame:
    """(key, first_id, n_copies) of the hot keys, for broadcasting: at most HOT_SHARE rows.

    ``n_copies`` counts all rows of a group, the first included. Hot keys are found by exact counts
    combined before the shuffle; their rows are salted and aggregated in two levels.
    """
    counts = keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    near = F.broadcast(stage(counts.filter(F.col("n") >= hot_threshold(keyed.count())).select(*_KEY), "copies-hot"))
    salted = keyed.join(near, _KEY, "left_semi").groupBy(*_KEY, salt(F.col(_ROW), SALTS).alias("__fl_salt"))
    level1 = salted.agg(F.min(_ROW).alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return stage(level1.groupBy(*_KEY).agg(F.min("first_id").alias("__fl_first"), F.sum("n_copies").alias("__fl_copies")), "copies-hot-groups")


def _with_groups(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with the first identifier and the size of their group: one shuffle by key, none for rows of hot keys."""
    near, group = F.broadcast(hot), Window.partitionBy(*_KEY)
    cold = rows.join(near.select(*_KEY), _KEY, "left_anti").withColumns({"__fl_first": F.min(_ROW).over(group), "__fl_copies": F.count(F.lit(1)).over(group)})
    return cold.unionByName(rows.join(near, _KEY))


def collapse_copies(df: DataFrame, row_id: str, worded: tuple[str, ...], ignored: tuple[str, ...]) -> DataFrame:
    """One record per group of copies, whole, with ``n_copies``.

    The record is the one of the smallest identifier. Rows whose identifier repeats count as copies,
    too, and the record then appears once per row of that identifier. An empty table gives no rows.
    Whole rows are shuffled once, by canonical key; the groups of hot keys are broadcast to their rows.
    """
    hot = hot_groups(canonical_keys(df, row_id, worded, ignored))
    rows = _with_groups(canonical_keys(df, row_id, worded, ignored, keep=True), hot)
    return rows.filter(F.col(_ROW) == F.col("__fl_first")).select(*[F.col(f"`{c}`") for c in df.columns], F.col("__fl_copies").alias("n_copies"))


def copy_links(df: DataFrame, row_id: str, worded: tuple[str, ...], ignored: tuple[str, ...]) -> DataFrame:
    """(first_id, copy_id): each copy except the first with the smallest identifier of its group."""
    keyed = stage(canonical_keys(df, row_id, worded, ignored), "copies-keys")
    rows = _with_groups(keyed, hot_groups(keyed))
    return rows.filter(F.col(_ROW) != F.col("__fl_first")).select(F.col("__fl_first").alias("first_id"), F.col(_ROW).alias("copy_id"))
