"""Orphan references, kept as keyed pending-orphan state that moves forward step by step.

All events of one key at one instant are a point: the parents that arrive and leave then and the
number of references that are made. State after each step:

* ``index``: per key, how many parents are on file, how many have begun, and how many references were made;
* ``pending``: points with references whose key has had no parent yet.

A step brings references, arriving parents and deletions. References probe the index as it stands
at their own time; those without a parent on file are orphans, at once ``deleted`` if a parent had
begun, else pending. Arriving parents resolve pending references (``late``). Deletions lower the
index: later references of the key are orphans again, and those made before are reopened, which
``open_references`` and the snapshots show. What is pending at the end is ``missing``.

Points are range-partitioned by step, key and time, and the partition a point falls in is its slot:
slot sums give each slot's starting state, and a running sum inside the slot gives the state at each
point. So no task holds all events of a key, whatever their times: equal times are one point.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.functions.text import label, words_key
from florilege.operators.skew import HOT_LEAST, hot_threshold, split_join
from florilege.session import stage, unstage

#: Months of a period; a step of the state covers one period, or several neighbouring ones.
PERIOD_MONTHS = 24
#: Steps that a history is played in at most; with more periods than that, neighbouring ones of few events are one step.
MAX_STEPS = 48
_BEFORE, _AFTER = "0001-01-01 00:00:00", "9999-01-01 00:00:00"


@dataclass(frozen=True)
class OrphanState:
    """``index``: ref_key, active, begun, refs. ``pending``: ref_key, at, n_refs."""

    index: DataFrame
    pending: DataFrame


INDEX_SCHEMA = "ref_key string, active bigint, begun bigint, refs bigint"
PENDING_SCHEMA = "ref_key string, at timestamp_ntz, n_refs bigint"


def empty_state(spark: SparkSession) -> OrphanState:
    return OrphanState(spark.createDataFrame([], INDEX_SCHEMA), spark.createDataFrame([], PENDING_SCHEMA))


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def reference_events(refs: DataFrame, key: Column, row_id: Column, at: Column) -> DataFrame:
    """References with a key; a null time stands before all others."""
    return refs.select(
        key.alias("ref_key"), F.coalesce(at.cast("timestamp_ntz"), _ts(_BEFORE)).alias("at"), row_id.cast("bigint").alias("row_id"), F.lit(0).alias("d_active"), F.lit(0).alias("d_begun")
    ).filter("ref_key is not null")


def parent_events(parents: DataFrame, key: Column, begin: Column, end: Column) -> DataFrame:
    """Arrivals and deletions of parents.

    A parent is on file from ``begin`` (included) to ``end`` (excluded, null: still). One without a
    begin exists but is never on file; one that ends before it begins begins without being on file.
    """
    base = parents.select(key.alias("ref_key"), begin.cast("timestamp_ntz").alias("b"), end.cast("timestamp_ntz").alias("e")).filter("ref_key is not null")
    real = F.col("b").isNotNull() & (F.col("e").isNull() | (F.col("e") > F.col("b")))
    none = F.lit(None).cast("bigint")
    arrive = base.select("ref_key", F.coalesce("b", _ts(_AFTER)).alias("at"), none.alias("row_id"), real.cast("int").alias("d_active"), F.lit(1).alias("d_begun"))
    delete = base.filter(real & F.col("e").isNotNull()).select("ref_key", F.col("e").alias("at"), none.alias("row_id"), F.lit(-1).alias("d_active"), F.lit(0).alias("d_begun"))
    return arrive.unionByName(delete)


def _months(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def event_points(events: DataFrame) -> DataFrame:
    """Events (see reference_events and parent_events) as points: ref_key, at, d_active, d_begun, n_refs."""
    return events.groupBy("ref_key", "at").agg(F.sum("d_active").alias("d_active"), F.sum("d_begun").alias("d_begun"), F.count("row_id").alias("n_refs"))


def slotted(points: DataFrame, name: str, step: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Points written in the order of step, key and time, with their partition as slot."""
    ranged = points.repartitionByRange(*step, "ref_key", "at").withColumn("slot", F.spark_partition_id())
    return stage(ranged, name, list(step) or None)


def advance(state: OrphanState, points: DataFrame) -> tuple[OrphanState, DataFrame]:
    """One step: the slotted points of a period onto the state.

    Returns the new state and what is settled in this step (ref_key, at, n_refs, reason). At equal
    times parents arrive and leave before references probe.
    """
    sums = points.groupBy("ref_key", "slot").agg(F.sum("d_active").alias("a"), F.sum("d_begun").alias("b"), F.sum("n_refs").alias("refs"))
    earlier = Window.partitionBy("ref_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.join(state.index.select("ref_key", "active", "begun").hint("merge"), "ref_key", "left")
        .select(
            "ref_key",
            "slot",
            "refs",
            (F.coalesce("active", F.lit(0)) + F.coalesce(F.sum("a").over(earlier), F.lit(0))).alias("d_active"),
            (F.coalesce("begun", F.lit(0)) + F.coalesce(F.sum("b").over(earlier), F.lit(0))).alias("d_begun"),
        )
        .filter("refs > 0")
        .select("ref_key", "slot", F.lit(None).cast("timestamp_ntz").alias("at"), "d_active", "d_begun", F.lit(0).cast("bigint").alias("n_refs"))
    )
    moves = points.select("ref_key", "slot", "at", "d_active", "d_begun", "n_refs")
    so_far = Window.partitionBy("ref_key", "slot").orderBy(F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)  # the starting state comes first
    probed = (
        starts.unionByName(moves)
        .select("ref_key", "at", "n_refs", F.sum("d_active").over(so_far).alias("active"), F.sum("d_begun").over(so_far).alias("begun"))
        .filter("n_refs > 0 and active <= 0")
    )
    orphans = stage(probed.select("ref_key", "at", "n_refs", (F.col("begun") > 0).alias("had_parent")), "orphans-probed")

    moved = sums.select("ref_key", F.col("a").alias("active"), F.col("b").alias("begun"), "refs")
    index = stage(state.index.unionByName(moved).groupBy("ref_key").agg(*[F.sum(c).alias(c) for c in ("active", "begun", "refs")]), "orphans-index")
    waiting = state.pending.unionByName(orphans.filter("not had_parent").select("ref_key", "at", "n_refs"))
    begun = index.filter("begun > 0").select("ref_key", "begun")
    rows = waiting.count()
    if rows < HOT_LEAST:  # no key can be hot
        looked = waiting.join(begun.hint("merge"), "ref_key", "left")
    else:
        hot = waiting.groupBy("ref_key").count().filter(F.col("count") >= hot_threshold(rows)).select("ref_key")
        looked = split_join(waiting, begun, ["ref_key"], hot, "left")
    looked = stage(looked, "orphans-waiting")
    settled = (
        orphans.filter("had_parent")
        .select("ref_key", "at", "n_refs", F.lit("deleted").alias("reason"))
        .unionByName(looked.filter("begun is not null").select("ref_key", "at", "n_refs", F.lit("late").alias("reason")))
    )
    return OrphanState(index, looked.filter("begun is null").select("ref_key", "at", "n_refs")), settled


def step_ends(counts: dict[int, int], most: int = MAX_STEPS) -> list[int]:
    """The last period of each step: every period is a step, or neighbours are joined until there are at most ``most`` steps of like size."""
    periods = sorted(counts)
    if len(periods) <= most:
        return periods
    share, ends, filled = sum(counts.values()) / most, [], 0
    for k, period in enumerate(periods):
        filled += counts[period]
        if filled >= share * (len(ends) + 1) or k == len(periods) - 1:
            ends.append(period)
    return ends


def play_history(refs: DataFrame, parents: DataFrame, *, period_months: int = PERIOD_MONTHS, on_step=None) -> tuple[OrphanState, DataFrame]:
    """The state after all events and what was settled on the way; ``on_step(period, state)`` sees each state (read it at once)."""
    points = event_points(refs.unionByName(parents)).withColumn("period", F.floor(_months(F.col("at")) / period_months).cast("int"))
    points = stage(points, "orphans-points")
    counts = {r["period"]: r["count"] for r in points.groupBy("period").count().collect()}  # one row per period of the calendar
    ends = step_ends(counts)
    step = F.array_min(F.filter(F.array(*[F.lit(e) for e in ends]), lambda x: x >= F.col("period"))) if ends else F.lit(0)
    ordered = slotted(points.withColumn("step", step).drop("period"), "orphans-slots", ["step"])
    unstage(points)
    state, found = empty_state(refs.sparkSession), []
    for end in ends:
        before = state
        state, settled = advance(state, ordered.filter(F.col("step") == end).drop("step"))
        unstage(before.index)
        found.append(settled)
        if on_step:
            on_step(end, state)
    unstage(ordered)
    out = state.pending.select("ref_key", "at", "n_refs", F.lit("missing").alias("reason"))
    for settled in found:
        out = out.unionByName(settled)
    return state, out


def find_orphans(refs: DataFrame, parents: DataFrame, *, period_months: int = PERIOD_MONTHS) -> DataFrame:
    """All orphans: ref_key, row_id and reason (missing, deleted or late).

    ``refs`` and ``parents`` come from reference_events and parent_events. The history is played
    through the state in steps of ``period_months``. Repeated rows are separate references; empty
    tables give no orphans, or all as missing.
    """
    refs = stage(refs, "orphans-refs")
    _, settled = play_history(refs, parents, period_months=period_months)
    rows = refs.select("ref_key", "at", "row_id")
    size = settled.agg(F.max("n_refs").alias("most"), F.sum("n_refs").alias("all")).first()
    if (size["most"] or 0) < HOT_LEAST:  # no point can be hot
        return rows.join(settled, ["ref_key", "at"]).select("ref_key", "row_id", "reason")
    hot = settled.filter(F.col("n_refs") >= hot_threshold(size["all"])).select("ref_key", "at")
    return split_join(rows, settled, ["ref_key", "at"], hot).select("ref_key", "row_id", "reason")


def open_references(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References that are orphans as the index stands: ref_key, row_id, status.

    ``waiting``: no parent has begun; ``gone``: all parents are gone, also for references that had a
    parent when they were made or were resolved later, which a deletion has reopened.
    """
    closed = index.filter("active <= 0").select("ref_key", F.when(F.col("begun") > 0, "gone").otherwise("waiting").alias("status"), "refs")
    rows = index.agg(F.sum("refs")).first()[0] or 0
    hot = closed.filter(F.col("refs") >= hot_threshold(rows)).select("ref_key")
    return split_join(refs.select("ref_key", "row_id"), closed.drop("refs"), ["ref_key"], hot).select("ref_key", "row_id", "status")


def words_or_null(c: Column) -> Column:
    k = words_key(c)
    return F.when(k != "", k)


#: The reference relations of the plant tables; the letter before a key tells them apart in one state.
RELATIONS = {"a": "plant_compounds", "b": "plant_compound_pair_tanimoto", "c": "plant_metadata"}


def plant_events(compounds: DataFrame, metadata: DataFrame, pairs: DataFrame, species_list: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and parents of the three relations: species on file, compounds on file, species on the list."""

    def key(relation: str, value: Column) -> Column:
        return F.concat(F.lit(relation + ":"), value)

    species, known, wanted = words_or_null(F.col("species")), label(F.col("compound_id")), label(F.col("compound_id_a"))
    refs = (
        reference_events(compounds, key("a", species), F.col("occurrence_id"), F.col("retrieved_at"))
        .unionByName(reference_events(pairs, key("b", wanted), F.col("pair_id"), F.col("computed_at")))
        .unionByName(reference_events(metadata, key("c", species), F.col("metadata_id"), F.col("valid_from")))
    )
    parents = (
        parent_events(metadata, key("a", species), F.col("valid_from"), F.col("withdrawn_at"))
        .unionByName(parent_events(compounds, key("b", known), F.col("retrieved_at"), F.col("withdrawn_at")))
        .unionByName(parent_events(species_list, key("c", species), _ts(_BEFORE), F.lit(None)))
    )
    return refs, parents


def plant_orphans(compounds: DataFrame, metadata: DataFrame, pairs: DataFrame, species_list: DataFrame, *, period_months: int = PERIOD_MONTHS) -> DataFrame:
    """Orphans of the three relations: ref_table, row_id, reason.

    A species without words and a blank compound id refer to nothing and are no orphans.
    """
    found = find_orphans(*plant_events(compounds, metadata, pairs, species_list), period_months=period_months)
    return found.select(_table_name().alias("ref_table"), "row_id", "reason")


def _table_name() -> Column:
    name = F.lit(None).cast("string")
    for letter, title in RELATIONS.items():
        name = F.when(F.substring("ref_key", 1, 1) == letter, title).otherwise(name)
    return name


def open_plant_references(compounds: DataFrame, metadata: DataFrame, pairs: DataFrame, species_list: DataFrame, *, period_months: int = PERIOD_MONTHS) -> DataFrame:
    """References of the three relations that are orphans after all events: ref_table, row_id, status (see open_references)."""
    refs, parents = plant_events(compounds, metadata, pairs, species_list)
    refs = stage(refs, "orphans-refs")
    state, _ = play_history(refs, parents, period_months=period_months)
    return open_references(refs, state.index).select(_table_name().alias("ref_table"), "row_id", "status")


SNAPSHOT_SCHEMA = "period int, relation string, keys_on_file bigint, keys_gone bigint, refs_waiting bigint, refs_gone bigint"


def orphan_snapshots(compounds: DataFrame, metadata: DataFrame, pairs: DataFrame, species_list: DataFrame, *, period_months: int = PERIOD_MONTHS) -> DataFrame:
    """After each step: per relation, keys on file, keys whose parents are all gone, and the references that wait for a parent or have lost theirs.

    A step is named by its last period; there is a row per relation that has had any event.
    """
    shots: list[tuple] = []

    def keep(period: int, state: OrphanState) -> None:
        there, gone, new = F.col("active") > 0, (F.col("active") <= 0) & (F.col("begun") > 0), (F.col("active") <= 0) & (F.col("begun") <= 0)
        refs = lambda which: F.sum(F.when(which, F.col("refs")).otherwise(0))
        rows = state.index.groupBy(F.substring("ref_key", 1, 1).alias("relation")).agg(F.count_if(there), F.count_if(gone), refs(new), refs(gone)).collect()
        shots.extend((period, *r) for r in rows)  # one row per relation

    play_history(*plant_events(compounds, metadata, pairs, species_list), period_months=period_months, on_step=keep)
    return compounds.sparkSession.createDataFrame(shots, SNAPSHOT_SCHEMA)


def orphan_counts(orphans: DataFrame, compounds: DataFrame, metadata: DataFrame, pairs: DataFrame) -> DataFrame:
    """Orphans per table, month of the reference and reason; the month is null where the time is."""
    times = (
        compounds.select(F.lit("plant_compounds").alias("ref_table"), F.col("occurrence_id").alias("row_id"), F.col("retrieved_at").alias("at"))
        .unionByName(pairs.select(F.lit("plant_compound_pair_tanimoto").alias("ref_table"), F.col("pair_id").alias("row_id"), F.col("computed_at").alias("at")))
        .unionByName(metadata.select(F.lit("plant_metadata").alias("ref_table"), F.col("metadata_id").alias("row_id"), F.col("valid_from").alias("at")))
    )
    month = F.date_format("at", "yyyy-MM")
    return orphans.join(times, ["ref_table", "row_id"]).groupBy("ref_table", month.alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
