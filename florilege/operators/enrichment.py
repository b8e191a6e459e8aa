"""Annotation and enrichment: key dedupe with collapsing, matches, summaries per compound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.rules import is_micromolar, number, taxonomic_breadth
from florilege.functions.text import collapse_sorted, key_value, non_empty, squish
from florilege.operators.exact import collapse_first_seen, exact_percentiles
from florilege.session import stage

def dedupe_by_key(table: DataFrame, keys: list[str], order: str, collapse: list[str] = (), flags: list[str] = (), fill: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """One row per key: texts collapsed in first-seen order, flags or-ed, blanks filled with the first value present.

    Missing key parts are values of their own ("<NA>"). A key of any number of rows brings only its distinct texts to a task.
    """
    keyed = table.select(*[key_value(F.col(k)).alias("__fl_" + k) for k in keys], order, *[c for c in dict.fromkeys([*collapse, *flags, *fill]) if c != order])
    named = ["__fl_" + k for k in keys]
    aggs = [F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in flags]
    aggs += [F.min_by(non_empty(F.col(c)), F.when(non_empty(F.col(c)).isNotNull(), F.col(order))).alias(c) for c in fill]
    out = keyed.groupBy(*named).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    if collapse:
        out = out.join(collapse_first_seen(keyed, named, list(collapse), order), named, "left")  # keys are never null
    return out.select(*[F.col("__fl_" + k).alias(k) for k in keys], "n_rows", *collapse, *flags, *fill)


def name_parts(names: Column) -> Column:
    """The names in a text that are separated by ";", in lower case."""
    return F.filter(F.transform(F.split(F.coalesce(names, F.lit("")), ";"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def parts_score(q: Column, parts: Column) -> Column:
    """match_score of a lower-cased, squished query and the parts of the names."""
    return (
        F.when(F.size(parts) == 0, 4)
        .when(F.exists(parts, lambda x: x == q), 0)
        .when(F.exists(parts, lambda x: F.startswith(x, q)), 1)
        .when(F.exists(parts, lambda x: F.contains(x, q)), 2)
        .otherwise(3)
    )


def match_score(query: Column, names: Column) -> Column:
    """0 exact, 1 prefix, 2 contained, 3 other, 4 without names; names are separated by ";"."""
    return parts_score(F.lower(squish(query)), name_parts(names))


#: Letters of the pieces by which names are found that contain a query.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: F.substring(text, k, F.lit(n))))


def match_all(queries: DataFrame, query: str, library: DataFrame, key: str, names: str, limit: int, rank: Column | None = None) -> DataFrame:
    """The best ``limit`` library rows of every query by score, then ``rank``, then key: exact, prefix, contained, or with its rarest known word.

    Nothing is compared with everything: a name that contains a query contains each of its pieces of GRAM
    letters (or the query itself if it is shorter), so each query is joined by the one of its pieces that
    the fewest library rows have. Other rows (score 3) are those that have the query's rarest word that any
    row has. Queries that no library row is related to have no matches.
    """
    lib = stage(library.select(F.col(key).alias("__fl_key"), name_parts(F.col(names)).alias("__fl_parts"), (F.lit(0) if rank is None else rank).alias("__fl_rank")), "match-library")
    asked = stage(queries.select(query).distinct().withColumn("__fl_q", F.lower(squish(F.col(query)))).filter("__fl_q <> ''"), "match-queries")
    part = lib.select("__fl_key", F.explode("__fl_parts").alias("part"))
    pieces = F.flatten(F.array(*[_grams(F.col("part"), n) for n in range(1, GRAM + 1)]))
    theirs = part.select("__fl_key", F.explode(pieces).alias("gram")).distinct()
    often = theirs.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    mine = asked.select("__fl_q", F.explode(F.when(F.length("__fl_q") < GRAM, F.array("__fl_q")).otherwise(_grams(F.col("__fl_q"), GRAM))).alias("gram")).distinct()
    rarest = mine.join(often, "gram", "left").groupBy("__fl_q").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("o"), "gram")).alias("g")).filter("g.o > 0").select("__fl_q", F.col("g.gram").alias("gram"))
    by_gram = rarest.join(theirs, "gram").select("__fl_q", "__fl_key")
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{Nd}]+"), lambda w: F.length(w) >= GRAM))
    theirs = part.select("__fl_key", F.explode(words(F.col("part"))).alias("word")).distinct()
    often = theirs.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    rare = asked.select("__fl_q", F.explode(words(F.col("__fl_q"))).alias("word")).join(often, "word").groupBy("__fl_q").agg(F.min(F.struct("often", "word")).alias("w")).select("__fl_q", F.col("w.word").alias("word"))
    by_word = rare.join(theirs, "word").select("__fl_q", "__fl_key")
    q = F.col("__fl_q")
    contained = by_gram.join(lib, "__fl_key").filter(F.exists("__fl_parts", lambda x: F.contains(x, q))).select("__fl_q", "__fl_key")
    met = contained.unionByName(by_word).distinct().join(lib, "__fl_key")
    scored = met.select("__fl_q", F.col("__fl_key").alias(key), "__fl_rank", parts_score(q, F.col("__fl_parts")).alias("score"))
    best = best_matches(scored, "__fl_q", ["__fl_rank", key], limit)
    return asked.join(best, "__fl_q").select(query, key, "score", "match_rank")


def best_matches(matches: DataFrame, query: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` matches of each query by score and then ``order``, with their place."""
    place = F.row_number().over(Window.partitionBy(query).orderBy("score", *order))
    return matches.withColumn("match_rank", place).filter(F.col("match_rank") <= limit)


def assay_priority(outcome: Column, value: Column, target: Column) -> Column:
    """1 active, 2 with a value, 3 with a target, 5 otherwise."""
    return F.when(F.lower(squish(outcome)) == "active", 1).when(value.isNotNull(), 2).when(non_empty(target).isNotNull(), 3).otherwise(5)


def select_assays(assays: DataFrame, query: str, assay: str, limit: int) -> DataFrame:
    """The first assays of each query by their best priority, then id; each assay once."""
    once = assays.groupBy(query, assay).agg(F.min(assay_priority(F.col("outcome"), F.col("value"), F.col("target"))).alias("priority"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("priority", assay))
    return once.withColumn("place", place).filter(F.col("place") <= limit)


def occurrence_summary(rows: DataFrame, query: str) -> DataFrame:
    """Per query: occurrences, organisms, kingdoms, families, genera, what was observed, and breadth."""
    n = lambda c: F.countDistinct(non_empty(F.col(c)))
    out = rows.groupBy(query).agg(
        F.count(F.lit(1)).alias("n_occurrences"), n("organism").alias("n_organisms"), n("kingdom").alias("n_kingdoms"), n("family").alias("n_families"), n("genus").alias("n_genera"),
        collapse_sorted(F.col("family")).alias("families"), F.bool_or(F.coalesce(F.col("kingdom").isin("Plantae", "Viridiplantae"), F.lit(False))).alias("in_plants"),
    )
    return out.withColumn("breadth", taxonomic_breadth(F.col("n_kingdoms"), F.col("n_families"), F.col("n_genera"), F.col("n_organisms")))


def bioactivity_summary(rows: DataFrame, query: str) -> DataFrame:
    """Per query: assays by outcome, targets, and potencies in uM (minimum, exact median, potent ones).

    ``rows``: activity_class, target, value, unit.
    """
    keyed = rows.withColumn("__fl_um", F.when(is_micromolar(F.col("unit")), number(F.col("value"))))
    v = F.col("__fl_um")
    out = keyed.groupBy(query).agg(
        F.count(F.lit(1)).alias("n_assays"), *[F.count_if(F.col("activity_class") == c).alias("n_" + c) for c in ("active", "inactive", "inconclusive")],
        F.countDistinct(non_empty(F.col("target"))).alias("n_targets"), F.countDistinct(F.when(F.col("activity_class") == "active", non_empty(F.col("target")))).alias("n_active_targets"),
        F.min(v).alias("min_potency_um"), F.count_if(v <= 10).alias("n_potent"),
    )
    medians = exact_percentiles(keyed, [query], "__fl_um", {"median_potency_um": 0.5})
    a, b = out.alias("a"), medians.alias("b")
    return a.join(b, F.col(f"a.{query}").eqNullSafe(F.col(f"b.{query}")), "left").select("a.*", "b.median_potency_um")


def targets_summary(rows: DataFrame, query: str) -> DataFrame:
    """Per query and target: distinct assays and outcomes."""
    return rows.groupBy(query, "target").agg(F.countDistinct("assay").alias("n_assays"), *[F.count_if(F.col("activity_class") == c).alias("n_" + c) for c in ("active", "inactive", "inconclusive")])


def class_levels(rows: DataFrame, query: str, levels: list[str]) -> DataFrame:
    """Per query, the distinct names of each class level, sorted and joined."""
    return rows.groupBy(query).agg(*[collapse_sorted(F.col(c)).alias(c) for c in levels])


def derived_groups(rows: DataFrame, query: str, mass: Column) -> DataFrame:
    """One row per compound: flags, counts and bins gathered in one aggregation instead of a chain of joins."""
    from florilege.functions.rules import formula_has, mw_bin

    out = rows.groupBy(query).agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct(non_empty(F.col("source_database"))).alias("n_sources"), F.countDistinct(non_empty(F.col("species"))).alias("n_species"),
        F.min(mass).alias("mass"), F.bool_or(formula_has(F.col("molecular_formula"), "N")).alias("nitrogenous"), F.bool_or(formula_has(F.col("molecular_formula"), "O")).alias("oxygenated"),
        F.bool_or(F.coalesce(F.lower("citation_or_url").contains("/doc/"), F.lit(False))).alias("has_literature"), collapse_sorted(F.col("plant_part_group")).alias("plant_parts"),
    )
    return out.withColumn("mw_bin", mw_bin(F.col("mass")))


def library_flags(similarity: DataFrame) -> DataFrame:
    """Per compound and library group: Yes above 0.95, ~ between 0.85 and 0.95 (both excluded), No otherwise; best match only for Yes.

    ``similarity``: compound, library_group, library_compound, similarity.
    """
    best = F.max("similarity")
    middle = F.bool_or((F.col("similarity") > 0.85) & (F.col("similarity") < 0.95))
    out = similarity.groupBy("compound", "library_group").agg(best.alias("best_similarity"), F.max_by("library_compound", F.struct("similarity", "library_compound")).alias("m"), middle.alias("near"))
    return out.select("compound", "library_group", "best_similarity", F.when(F.col("best_similarity") > 0.95, "Yes").when(F.col("near"), "~").otherwise("No").alias("flag"), F.when(F.col("best_similarity") > 0.95, F.col("m")).alias("best_match"))
