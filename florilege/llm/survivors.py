"""The best representative of each group of records that state the same finding.

Rows are ranked by window ordering: completeness and trust labels first, then recency, then the
smallest identifier, so the order is total. Spark cuts each map task's part of a group to its top
row before the shuffle (the group limit of a row_number filter), so no task receives a whole hot
group; counts and first identifiers are combined before the shuffle as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import has_words, label, non_empty, words_key
from florilege.session import stage

#: Evidence tiers and confidences, best first; anything else or none ranks last.
TIER_ORDER = ("direct_species_database", "direct_species_literature", "direct_species_pubtator_candidate", "genus_database_fallback")
CONFIDENCE_ORDER = ("high", "medium", "low")
_LAST = 2_147_483_647
_KEY = ["__fl_species", "__fl_inchikey", "__fl_citation"]


def place_in(c: Column, order: tuple[str, ...]) -> Column:
    """The place of a label in an order, from 1; labels outside it and missing ones come after all."""
    places = F.create_map(*[F.lit(x) for i, name in enumerate(order) for x in (name, i + 1)])
    return F.coalesce(places[label(c)], F.lit(len(order) + 1))


def ranked_findings(compounds: DataFrame, providers: DataFrame) -> DataFrame:
    """Rows that state a finding (species words, inchikey and citation present) with their ranks.

    The provider table is fixed and of a few rows (one per provider); it is joined by provider label.
    """
    trust = providers.select(label(F.col("source_database")).alias("__fl_provider"), F.col("trust_rank").alias("__fl_trust")).filter("__fl_provider is not null")
    trust = trust.groupBy("__fl_provider").agg(F.min("__fl_trust").alias("__fl_trust"))
    stated = has_words(F.col("species")) & F.col("inchikey").rlike(r"[^\s\pZ]") & F.col("citation_or_url").rlike(r"[^\s\pZ]")
    rows = compounds.filter(stated).select(
        words_key(F.col("species")).alias(_KEY[0]),
        F.col("inchikey").alias(_KEY[1]),
        F.col("citation_or_url").alias(_KEY[2]),
        F.col("occurrence_id").cast("bigint").alias("row_id"),
        place_in(F.col("evidence_tier"), TIER_ORDER).alias("tier_rank"),
        place_in(F.col("confidence"), CONFIDENCE_ORDER).alias("confidence_rank"),
        label(F.col("source_database")).alias("__fl_provider"),
        F.when(non_empty(F.col("compound_id")).isNotNull(), 0).otherwise(1).alias("id_rank"),
        F.col("retrieved_at"),
        *[F.col(c).alias("value_" + c) for c in ("compound_id", "evidence_tier", "confidence", "source_database")],
    )
    return rows.join(trust, "__fl_provider", "left").withColumn("trust_rank", F.coalesce("__fl_trust", F.lit(_LAST))).drop("__fl_trust")


def _hash_keys(ranked: DataFrame) -> DataFrame:
    """128-bit group keys in place of the texts, which keeps the shuffles narrow."""
    return ranked.select(
        F.xxhash64(*_KEY).alias("__fl_k1"),
        F.xxhash64(F.lit(1), *_KEY[::-1]).alias("__fl_k2"),
        "row_id",
        (F.col("tier_rank") * 100 + F.col("confidence_rank")).alias("label_rank"),
        "trust_rank",
        "id_rank",
        "retrieved_at",
    )


def best_of_findings(compounds: DataFrame, providers: DataFrame) -> DataFrame:
    """(first_id, keep_id) of each finding of two or more rows.

    Order: tier, confidence, trust (unknown providers last), compound_id present, latest retrieval
    (none last), smallest identifier. Empty tables give no rows.
    """
    keys = ["__fl_k1", "__fl_k2"]
    rows = stage(_hash_keys(ranked_findings(compounds, providers)), "findings-ranked")  # narrow, and read by both branches
    groups = rows.groupBy(*keys).agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    order = Window.partitionBy(*keys).orderBy("label_rank", "trust_rank", "id_rank", F.col("retrieved_at").desc_nulls_last(), "row_id")
    kept = rows.withColumn("place", F.row_number().over(order)).filter("place = 1").select(*keys, F.col("row_id").alias("keep_id"))
    return groups.join(kept, keys).select("first_id", "keep_id")


def golden_records(compounds: DataFrame, providers: DataFrame) -> DataFrame:
    """One built record per finding: each field takes the best present value of the group by its own rank.

    ``compound_id`` comes from the most trusted row that has one, ``evidence_tier`` and ``confidence``
    from the best label, ``source_database`` from the most trusted known provider; ties go to the
    latest and then the smallest row. A field that no row has is null. Merging is by mergeable
    minimums, so groups of any size combine before the shuffle.
    """
    ranked = ranked_findings(compounds, providers)
    late = -F.coalesce(F.unix_micros(F.col("retrieved_at").cast("timestamp")), F.lit(-(2**62)).cast("long"))

    def pick(field: str, *ranks: str) -> Column:
        value = F.trim(F.col("value_" + field))
        entry = F.struct(*[F.col(r) for r in ranks], late.alias("late"), F.col("row_id"), value.alias("v"))
        return F.min(F.when(F.coalesce(value != "", F.lit(False)), entry))["v"].alias(field)

    return (
        ranked.groupBy(*_KEY)
        .agg(
            F.min("row_id").alias("first_id"),
            F.count(F.lit(1)).alias("n_rows"),
            pick("compound_id", "trust_rank", "tier_rank", "confidence_rank"),
            pick("evidence_tier", "tier_rank", "trust_rank"),
            pick("confidence", "confidence_rank", "tier_rank", "trust_rank"),
            pick("source_database", "trust_rank", "tier_rank"),
        )
        .select("first_id", "n_rows", F.lower("compound_id").alias("compound_id"), F.lower("evidence_tier").alias("evidence_tier"), F.lower("confidence").alias("confidence"), F.upper("source_database").alias("source_database"))
    )
