"""Multi-level tree aggregation: results per key although a few keys hold most rows.

Input chunks of a fixed number of rows are combined where they are read (Spark's map-side hash
aggregation on key and tree node), before anything is shuffled; the states then merge in rounds of
``fan_in``, so that no reducer ever receives more than ``fan_in`` states of a hot key, and the number
of rounds is the logarithm of the number of chunks. Keys with few states leave the tree after the
first round. All states are built-in sum, min and max aggregates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import label, words_key
from florilege.operators.skew import HOT_SHARE
from florilege.session import stage

CHUNK_ROWS = 65_536
FAN_IN = 16
_NODE = "__fl_node"
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}

#: Evidence tiers, best first; anything else is tallied as other.
TIERS = ("direct_species_database", "direct_species_literature", "direct_species_pubtator_candidate", "genus_database_fallback")


@dataclass(frozen=True)
class State:
    """A mergeable per-key state: its column, its value for one row, and how two states merge."""

    name: str
    value: Column
    merge: str = "sum"


def chunk_nodes(df: DataFrame, rows: int, chunk_rows: int) -> tuple[DataFrame, int]:
    """Number the input chunks: rows of one partition in runs of ``chunk_rows``; returns about how many there are.

    Only the number of rounds depends on that count: the last aggregation is by key alone.
    """
    parts = max(1, df.rdd.getNumPartitions())
    per_part = max(1, 2 * math.ceil(rows / (parts * chunk_rows)))
    place = F.monotonically_increasing_id()
    part, row = F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1))
    chunk = F.least(F.floor(row / F.lit(chunk_rows)), F.lit(per_part - 1))
    return df.withColumn(_NODE, part * F.lit(per_part) + chunk), parts * per_part


def _merge(df: DataFrame, by: list[str], states: list[State]) -> DataFrame:
    return df.groupBy(*by).agg(*[_MERGE[s.merge](F.col(s.name)).alias(s.name) for s in states])


def _rounds(df: DataFrame, keys: list[str], states: list[State], nodes: int, fan_in: int) -> DataFrame:
    """Rounds of ``fan_in`` until a key has at most that many states; the last one is by key alone."""
    while nodes > fan_in:
        df = _merge(df.withColumn(_NODE, F.floor(F.col(_NODE) / F.lit(fan_in)).cast("long")), [*keys, _NODE], states)
        nodes = math.ceil(nodes / fan_in)
    return _merge(df, keys, states)


def merge_rounds(df: DataFrame, keys: list[str], states: list[State], nodes: int, fan_in: int) -> DataFrame:
    """Fan-in rounds over states in columns named as the states, of about ``nodes`` nodes.

    The first round runs for all keys. If more are needed, its states are written once; keys with at
    most ``fan_in`` states, or too few to count as hot, then merge in one aggregation by key, and only
    the hot keys (at most HOT_SHARE, so their list may be broadcast) go through the other rounds.
    """
    if nodes <= fan_in:
        return _merge(df, keys, states)
    first = _merge(df.withColumn(_NODE, F.floor(F.col(_NODE) / F.lit(fan_in)).cast("long")), [*keys, _NODE], states)
    nodes = math.ceil(nodes / fan_in)
    if nodes <= fan_in:
        return _merge(first, keys, states)
    first = stage(first, "tree-states")
    least = max(fan_in, first.count() // HOT_SHARE)
    hot = F.broadcast(stage(first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select(*[F.col(k).alias("__fl_hot_" + k) for k in keys]), "tree-hot"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("__fl_hot_" + k))
    cold = _merge(first.join(hot, same, "left_anti"), keys, states)
    return cold.unionByName(_rounds(first.join(hot, same, "left_semi"), keys, states, nodes, fan_in))


def tree_aggregate(df: DataFrame, keys: dict[str, Column], states: list[State], *, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per key with the merged states.

    Null keys form a group of their own; an empty table gives no rows; input columns do not
    clash with results, as only keys and states are kept.
    """
    rows = df.count()
    numbered, nodes = chunk_nodes(df.select(*[c.alias(k) for k, c in keys.items()], *[s.value.alias(s.name) for s in states]), rows, chunk_rows)
    return merge_rounds(numbered, list(keys), states, nodes, fan_in)


def _species_states() -> list[State]:
    tier = F.coalesce(label(F.col("evidence_tier")), F.lit(""))
    one = lambda cond: cond.cast("long")
    tallies = [State(f"n_tier_{i + 1}", one(tier == t)) for i, t in enumerate(TIERS)] + [State("n_tier_other", one(~tier.isin(*TIERS)))]
    times = [State("first_retrieved_at", F.col("retrieved_at"), "min"), State("last_retrieved_at", F.col("retrieved_at"), "max")]
    return [State("n_rows", F.lit(1).cast("long")), *tallies, *times]


def species_compounds(compounds: DataFrame, *, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Per species and compound (same words each): rows, tier tallies, first and last retrieval."""
    keys = {"species_key": words_key(F.col("species")), "compound_key": words_key(F.col("compound_name"))}
    return tree_aggregate(compounds, keys, _species_states(), chunk_rows=chunk_rows, fan_in=fan_in)


def species_profile(compounds: DataFrame, *, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Per species (same words): rows, distinct compounds, tier tallies, first and last retrieval.

    Distinct compounds are exact: a first tree gives one state per species and compound, a second
    tree over compound buckets adds those up, so a species that holds a third of all rows is never
    one task's work. Rows whose species has no words form the group ''; compounds without words do
    not count as compounds.
    """
    states = _species_states()
    pairs = species_compounds(compounds, chunk_rows=chunk_rows, fan_in=fan_in)
    buckets = max(1, math.ceil(compounds.count() / chunk_rows))
    pairs = pairs.withColumn("n_compounds", (F.col("compound_key") != "").cast("long")).withColumn(_NODE, F.pmod(F.xxhash64("compound_key"), F.lit(buckets)))
    return merge_rounds(pairs.drop("compound_key"), ["species_key"], [State("n_compounds", F.lit(0)), *states], buckets, fan_in)
