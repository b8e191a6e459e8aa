"""Structural similarity over packed fingerprints, and summaries of compound pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import collapse_sorted, is_yes, key_value, known, non_empty
from florilege.operators.exact import exact_percentiles
from florilege.operators.skew import hot_threshold, salt
from florilege.session import stage

#: Queries of one broadcast block of a search.
QUERY_BLOCK = 2_000
_WORD_BITS = 63  # a word stays a non-negative long


def pack_bits(bits: Column) -> Column:
    """An array of booleans as an array of longs of 63 bits each."""
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(bits) / F.lit(_WORD_BITS)).cast("int") - 1, F.lit(0)))
    one = lambda w: F.aggregate(F.slice(bits, w * _WORD_BITS + 1, F.lit(_WORD_BITS)), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x.cast("long")))
    return F.transform(words, one)


def unpack_base64(text: Column, skip_bytes: int = 4, byte_count: int = 111) -> Column:
    """A base64 fingerprint (length prefix of 4 bytes, 881 bits) as longs of 7 bytes each; null if it is too short."""
    raw = F.hex(F.unbase64(text))
    words = F.sequence(F.lit(0), F.lit(math.ceil(byte_count / 7) - 1))
    take = lambda w: F.conv(F.rpad(F.substring(raw, 2 * skip_bytes + 1 + w * 14, F.lit(14)), 14, "0"), 16, 10).try_cast("long")
    return F.when(F.length(raw) >= 2 * (skip_bytes + byte_count), F.transform(words, take))


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def shared_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, x: acc + x)


def tanimoto(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """Shared over united bits, to 6 places; null when both are empty."""
    s = shared_bits(a, b)
    union = n_a + n_b - s
    return F.when(union > 0, F.round(s / union, 6))


def fingerprint_classes(fps: DataFrame, row_id: str, words: str) -> DataFrame:
    """(row_id, representative, class_size): rows of the same fingerprint; the representative is the smallest id."""
    reps = fps.groupBy(words).agg(F.min(row_id).alias("representative"), F.count(F.lit(1)).alias("class_size"))
    return fps.join(reps, words).select(row_id, "representative", "class_size")


#: Bits are joined within bands of popcount: a band holds the counts that differ by at most this factor.
BAND_FACTOR = 1.1
#: Parts into which the fingerprints that sent the same bit in the same band are cut.
BIT_SALTS = 16


def similar_pairs(fps: DataFrame, row_id: str, words: str, threshold: float) -> DataFrame:
    """Pairs of class representatives with Tanimoto of at least the threshold: a, b, n_a, n_b (class sizes), tanimoto.

    Exact and without comparing all pairs: each fingerprint sends only its rarest bits, as many as a
    partner above the threshold must share one of, to the join, in the band of its popcount; a band meets
    itself and the bands above it that the threshold allows. Fingerprints of a hot bit are salted on one
    side and sent to all salts on the other. Identical fingerprints are one class, see fingerprint_classes.
    """
    reps = stage(fps.groupBy(words).agg(F.min(row_id).alias("id"), F.count(F.lit(1)).alias("n")).withColumn("pop", popcount(F.col(words))).filter("pop > 0"), "similar-classes")
    places = F.expr(f"flatten(transform(`{words}`, (w, i) -> filter(transform(sequence(0, {_WORD_BITS - 1}), k -> CASE WHEN (shiftright(w, k) & 1) = 1 THEN i * {_WORD_BITS} + k END), x -> x IS NOT NULL)))")
    bits = reps.select("id", "pop", F.explode(places).alias("bit"))
    often = bits.groupBy("bit").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("id").orderBy("often", "bit")
    prefix = F.col("pop") - F.ceil(F.lit(threshold) * F.col("pop") - 1e-9) + 1
    band = lambda pop: F.floor(F.log(pop) / math.log(BAND_FACTOR)).cast("int")
    sent = stage(bits.join(often, "bit").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= prefix).select("id", "pop", "bit", band(F.col("pop")).alias("band")), "similar-bits")
    above = math.ceil(math.log(1 / max(threshold, 1e-3)) / math.log(BAND_FACTOR)) + 1
    hot = F.broadcast(sent.groupBy("bit", "band").count().filter(F.col("count") >= hot_threshold(sent.count())).select("bit", "band", F.lit(True).alias("is_hot")))
    small = sent.withColumn("band", F.explode(F.sequence("band", F.col("band") + above))).join(hot, ["bit", "band"], "left")
    small = small.withColumn("salt", F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(BIT_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    large = sent.join(hot, ["bit", "band"], "left").withColumn("salt", F.when(F.col("is_hot"), salt(F.col("id"), BIT_SALTS)).otherwise(0))
    a, b = small.alias("a"), large.alias("b")
    order_ = (F.col("a.pop") < F.col("b.pop")) | ((F.col("a.pop") == F.col("b.pop")) & (F.col("a.id") < F.col("b.id")))
    near = (F.col("a.bit") == F.col("b.bit")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.salt") == F.col("b.salt")) & order_ & (F.col("a.pop") >= F.col("b.pop") * threshold - 1e-9)
    met = a.join(b, near).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    side = lambda s: reps.select(F.col("id").alias(s), F.col("n").alias("n_" + s), F.col("pop").alias("p" + s), F.col(words).alias("w" + s))
    scored = met.join(side("a"), "a").join(side("b"), "b").withColumn("tanimoto", tanimoto(F.col("wa"), F.col("wb"), F.col("pa"), F.col("pb")))
    return scored.filter(F.col("tanimoto") >= threshold).select("a", "b", "n_a", "n_b", "tanimoto")


def nearest_fingerprints(queries: DataFrame, fps: DataFrame, row_id: str, words: str, k: int) -> DataFrame:
    """The k most similar rows of every query (itself left out): query_id, row_id, place, tanimoto.

    The stated query set meets all rows in broadcast blocks of at most QUERY_BLOCK queries; each map
    task keeps its own best k of a query before the shuffle (the group limit of row_number).
    """
    n = queries.count()
    blocks = max(1, math.ceil(n / QUERY_BLOCK))
    q = queries.select(F.col(row_id).alias("query_id"), F.col(words).alias("q_words"), popcount(F.col(words)).alias("q_pop"))
    rows = fps.select(F.col(row_id).alias("row_id"), F.col(words).alias("r_words"), popcount(F.col(words)).alias("r_pop"))
    out = None
    for block in range(blocks):
        mine = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        met = rows.join(F.broadcast(mine), F.col("row_id") != F.col("query_id")).withColumn("tanimoto", tanimoto(F.col("q_words"), F.col("r_words"), F.col("q_pop"), F.col("r_pop")))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("tanimoto"), "row_id"))
        best = met.select("query_id", "row_id", "tanimoto").withColumn("place", place).filter(F.col("place") <= k)
        out = best if out is None else out.unionByName(best)
    return out.select("query_id", "row_id", "place", "tanimoto")


# --- summaries of given pairs --------------------------------------------------------------------


def support_tier(n: Column) -> Column:
    return F.when(n >= 10000, "high").when(n >= 1000, "moderate").when(n >= 100, "low").otherwise("very_low")


def comparable_membership(rows: DataFrame, include_unknown: bool = False) -> DataFrame:
    """One row per (species, compound): the comparable, known classification of the smallest record."""
    keep = rows if include_unknown else rows.filter(is_yes(F.col("comparable_for_matrix")) & known(F.col("comparison_scope")))
    keep = keep.filter("species is not null and compound_id is not null")
    return keep.groupBy("species", "compound_id").agg(*[F.min_by(c, "occurrence_id").alias(c) for c in ("comparison_scope", "comparison_group")])


def comparable_pair_summary(pairs: DataFrame, membership: DataFrame, field: str, thresholds: tuple[float, ...] = (0.5, 0.7, 0.85, 0.95)) -> DataFrame:
    """Per unordered species pair and shared classification: pairs, mean, exact median and p95, maximum, counts above thresholds.

    Only pairs whose both compounds have the same known value of ``field`` count; null similarities do not.
    """
    side = lambda s: membership.select(F.col("species").alias(f"species_{s}"), F.col("compound_id").alias(f"compound_id_{s}"), F.col(field).alias(f"value_{s}"))
    met = pairs.join(side("a"), ["species_a", "compound_id_a"]).join(side("b"), ["species_b", "compound_id_b"]).filter(known(F.col("value_a")) & (F.col("value_a") == F.col("value_b")) & F.col("tanimoto").isNotNull())
    return _pair_statistics(met.withColumn("comparison_value", F.col("value_a")), ["comparison_value"], thresholds)


def species_pair_summary(pairs: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.7, 0.85, 0.95)) -> DataFrame:
    """The same over all compound pairs of two species."""
    return _pair_statistics(pairs.filter("tanimoto is not null"), [], thresholds)


def _pair_statistics(pairs: DataFrame, keys: list[str], thresholds: tuple[float, ...]) -> DataFrame:
    t = F.col("tanimoto")
    keyed = pairs.select(F.least("species_a", "species_b").alias("species_1"), F.greatest("species_a", "species_b").alias("species_2"), *keys, "tanimoto")
    group = ["species_1", "species_2", *keys]
    out = keyed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(t), 6).alias("mean_tanimoto"), F.max(t).alias("max_tanimoto"), *[F.count_if(t >= x).alias("n_ge_" + str(x).replace(".", "_")) for x in thresholds]
    )
    ranked = exact_percentiles(keyed, group, "tanimoto", {"median_tanimoto": 0.5, "p95_tanimoto": 0.95})
    a, b = out.alias("a"), ranked.alias("b")
    same = F.lit(True)
    for k in group:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, same).select("a.*", *[F.round(f"b.{c}", 6).alias(c) for c in ("median_tanimoto", "p95_tanimoto")])
    return both.withColumn("support_tier", support_tier(F.col("n_pairs")))


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """One row per unordered (species, compound) pair: the row with the smallest pair_id."""
    a, b = F.concat_ws("|", key_value(F.col("species_a")), key_value(F.col("compound_id_a"))), F.concat_ws("|", key_value(F.col("species_b")), key_value(F.col("compound_id_b")))
    return pairs.groupBy(F.least(a, b).alias("side_1"), F.greatest(a, b).alias("side_2")).agg(F.min("pair_id").alias("pair_id"), F.min_by("tanimoto", "pair_id").alias("tanimoto"), F.count(F.lit(1)).alias("n_rows"))


def top_pair_labels(pairs: DataFrame, top_n: int = 3) -> DataFrame:
    """Per species pair the most similar compound pairs as "a | b=0.xxx", joined."""
    named = pairs.filter("tanimoto is not null").select(
        F.least("species_a", "species_b").alias("species_1"), F.greatest("species_a", "species_b").alias("species_2"), "tanimoto", "pair_id",
        F.concat(F.col("compound_name_a"), F.lit(" | "), F.col("compound_name_b"), F.lit("="), F.format_string("%.3f", "tanimoto")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("species_1", "species_2").orderBy(F.desc("tanimoto"), "pair_id"))
    top = named.withColumn("place", place).filter(F.col("place") <= top_n)
    return top.groupBy("species_1", "species_2").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "; ").alias("top_pairs"))


def group_membership(rows: DataFrame, group: str) -> DataFrame:
    """Per (group, compound): rows, modal name (ties alphabetical), single-or-null attributes, collapsed sources."""
    single = lambda c: F.when(F.countDistinct(non_empty(F.col(c))) == 1, F.max(non_empty(F.col(c))))
    usable = rows.filter(non_empty(F.col(group)).isNotNull() & non_empty(F.col("compound_id")).isNotNull())
    names = usable.groupBy(group, "compound_id", "compound_name_clean").agg(F.count(F.lit(1)).alias("n")).filter("compound_name_clean is not null")
    modal = names.groupBy(group, "compound_id").agg(F.min_by("compound_name_clean", F.struct(-F.col("n"), "compound_name_clean")).alias("modal_name"))
    stats = usable.groupBy(group, "compound_id").agg(
        F.count(F.lit(1)).alias("n_rows"), single("inchikey").alias("inchikey"), single("smiles").alias("smiles"),
        F.when(F.countDistinct(non_empty(F.col("comparison_scope"))) > 1, "mixed").otherwise(F.coalesce(F.max(non_empty(F.col("comparison_scope"))), F.lit("unknown"))).alias("comparison_scope"),
        collapse_sorted(F.col("source_database")).alias("sources"),
    )
    return stats.join(modal, [group, "compound_id"], "left")


def name_structure_conflicts(rows: DataFrame) -> DataFrame:
    """Names that stand for more than one structure: name, number of structures, number of rows."""
    usable = rows.filter(non_empty(F.col("compound_name_clean")).isNotNull())
    return usable.groupBy("compound_name_clean").agg(F.countDistinct(non_empty(F.col("inchikey"))).alias("n_structures"), F.count(F.lit(1)).alias("n_rows")).filter("n_structures > 1")


def identity_conflicts(rows: DataFrame) -> DataFrame:
    """Compound ids with more than one CID or InChIKey."""
    return rows.filter(non_empty(F.col("compound_id")).isNotNull()).groupBy("compound_id").agg(F.countDistinct("cid").alias("n_cids"), F.countDistinct(non_empty(F.col("inchikey"))).alias("n_inchikeys")).filter("n_cids > 1 or n_inchikeys > 1")


def group_pair_count(membership: DataFrame, group: str) -> DataFrame:
    """One row: compound pairs across groups, C(n, 2) less the pairs inside groups."""
    sizes = membership.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    n, inside = F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return sizes.agg(n.alias("n_members"), (n * (n - 1) / 2).cast("bigint").alias("n_pairs"), (n * (n - 1) / 2 - inside).cast("bigint").alias("n_group_pairs"))


def balanced_sample(membership: DataFrame, group: str, compound: str, n: int) -> DataFrame:
    """n compounds by turns over the groups: each group's compounds in order, one per turn, repeats skipped.

    No turn above n can be among the first n compounds, so Spark keeps the first n of a group within each task.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(compound))
    ranked = membership.select(group, compound).distinct().withColumn("turn", turn).filter(F.col("turn") <= n)
    first = ranked.groupBy(compound).agg(F.min(F.struct("turn", group)).alias("at"))
    return first.orderBy("at", compound).limit(n).select(compound, F.col("at.turn").alias("turn"), F.col(f"at.{group}").alias(group))


def pair_output_estimate(membership: DataFrame, compound: str) -> DataFrame:
    """One row: distinct compounds, pair rows, GB at 220 and 260 bytes a row, and whether pairs fit in memory."""
    n = F.countDistinct(compound)
    pairs = (n * (n - 1) / 2).cast("bigint")
    return membership.agg(n.alias("n_compounds"), pairs.alias("n_pairs"), F.round(pairs * 220 / 1e9, 6).alias("compound_gb"), F.round(pairs * 260 / 1e9, 6).alias("plant_gb"), F.when(pairs <= 1_000_000, "in_memory").otherwise("stream").alias("advice"))


def collapse_membership(membership: DataFrame, group: str, names: str = "compound_name_clean") -> DataFrame:
    """One row per (group, compound): rows and how many names, the names of fewest letters first, at most ten of them as text."""
    named = membership.filter(non_empty(F.col(group)).isNotNull() & non_empty(F.col("compound_id")).isNotNull()).groupBy(group, "compound_id", non_empty(F.col(names)).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "compound_id").orderBy(F.col("name").isNull(), F.length("name"), "name"))
    totals = named.groupBy(group, "compound_id").agg(F.sum("n").alias("n_rows"), F.count("name").alias("n_names"))
    listed = named.withColumn("place", place).filter("place <= 10 and name is not null").groupBy(group, "compound_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), "; ").alias("names"))
    return totals.join(listed, [group, "compound_id"], "left")


def group_compound_pairs(pairs: DataFrame, membership: DataFrame, group: str) -> DataFrame:
    """Similar compounds across groups: (group_1, compound_1, group_2, compound_2, tanimoto) of given compound pairs (a, b, tanimoto).

    A row for every two different groups that hold the two compounds, the smaller group first; a compound that two groups share
    is no pair of itself.
    """
    side = lambda s: membership.select(F.col("compound_id").alias(s), F.col(group).alias("g" + s)).filter(f"g{s} is not null").distinct()
    met = pairs.select("a", "b", "tanimoto").join(side("a"), "a").join(side("b"), "b").filter("ga <> gb")
    first = F.col("ga") < F.col("gb")
    return met.select(F.least("ga", "gb").alias("group_1"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("compound_1"), F.greatest("ga", "gb").alias("group_2"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("compound_2"), "tanimoto")


def preparation_checks(prepared: DataFrame, level: str) -> DataFrame:
    """(check, value, status) of prepared similarity input (see context.prepare_similarity_input)."""
    from florilege.operators.quality import checks

    eligible = F.col("eligible")
    row = prepared.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(eligible).alias("eligible_rows"), F.count_if(eligible & F.col("structure_id").isNull()).alias("eligible_without_structure"), F.count_if(eligible & non_empty(F.col(level)).isNull()).alias("eligible_without_group"),
        F.count_if(~eligible & F.col("exclusion_reason").isNull()).alias("excluded_without_reason"), F.count_if(eligible & F.col("exclusion_reason").isNotNull()).alias("eligible_with_reason"), F.count_if(~eligible).alias("excluded_rows"),
    )
    return checks(row, {"rows": "info", "eligible_rows": "info", "eligible_without_structure": "fail", "eligible_without_group": "fail", "excluded_without_reason": "fail", "eligible_with_reason": "fail", "excluded_rows": "warn"})
