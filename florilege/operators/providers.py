"""Provider indexes: star joins of provider tables, lookup by species with fallback ranks, accounting, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import non_empty, squish, words_key

#: Ranks of index keys, best first.
RANKS = ("species", "genus", "family")


def taxon_core_name(c: Column) -> Column:
    """Genus and epithet with hybrid sign and infraspecific rank; authors and years dropped; null without a genus."""
    s = squish(F.regexp_replace(c, r"""[_'"“”\[\]()<>*!?;,]+""", " "))
    s = F.regexp_replace(F.regexp_replace(s, "×", " x "), r"\s+", " ")
    genus = F.initcap(F.regexp_extract(s, r"^([A-Za-z]+(?:-[a-z]+)?)", 1))
    hybrid = F.when(s.rlike(r"(?i)^[A-Za-z-]+ x "), " x")
    rest = F.regexp_extract(s, r"(?i)^[A-Za-z-]+ (?:x )?([a-z][a-z-]+)", 1)
    rank = F.lower(F.regexp_extract(s, r"(?i)\b((?:subsp|ssp|var|f)\.? [a-z-]+)", 1))
    core = F.concat(genus, F.coalesce(hybrid, F.lit("")), F.when(rest != "", F.concat(F.lit(" "), F.lower(rest))).otherwise(""), F.when(rank != "", F.concat(F.lit(" "), rank)).otherwise(""))
    return F.when(genus != "", core)


def name_status(c: Column) -> Column:
    """parsed_species, name_needs_review (genus alone, "sp.") or blank."""
    core = taxon_core_name(c)
    return F.when(non_empty(c).isNull() | core.isNull(), "blank").when(~core.contains(" ") | F.lower(squish(c)).rlike(r"\bspp?\.?$"), "name_needs_review").otherwise("parsed_species")


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep-first: one row per key, the one with the smallest ``order``. All columns stay."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("__fl_row")).select(*keys, "__fl_row.*")


def build_index(records: DataFrame, compounds: DataFrame, taxa: DataFrame) -> DataFrame:
    """Index rows (key_type, key, record...) of provider records, one per rank the taxon has.

    ``records``: record_id, species, compound_id, source. ``compounds``: compound_id, name, inchikey.
    ``taxa``: species_key, genus, family. Both lookups are reduced to one row per key first; rows
    without species or compound are unusable. Rows that repeat in (key, record, compound, source) come once.
    """
    comp = compounds.filter("compound_id is not null").groupBy("compound_id").agg(F.min(non_empty(F.col("name"))).alias("name"), F.min(non_empty(F.col("inchikey"))).alias("inchikey"))
    tax = taxa.filter("species_key <> ''").groupBy("species_key").agg(F.min(non_empty(F.col("genus"))).alias("genus"), F.min(non_empty(F.col("family"))).alias("family"))
    joined = records.withColumn("species_key", words_key(F.col("species"))).filter("species_key <> '' and compound_id is not null").join(comp, "compound_id", "left").join(tax, "species_key", "left")
    genus = F.coalesce(F.lower("genus"), F.split_part("species_key", F.lit(" "), F.lit(1)))
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("key_type"), k.alias("key")) for t, k in (("species", F.col("species_key")), ("genus", genus), ("family", F.lower("family")))]))
    rows = joined.select(keys.alias("k"), "record_id", "species_key", "compound_id", "name", "inchikey", "source").filter("k.key is not null")
    return rows.select("k.key_type", "k.key", "record_id", "species_key", "compound_id", "name", "inchikey", "source").dropDuplicates(["key_type", "key", "record_id", "compound_id", "source"])


#: Files that the rows of one key prefix are spread over; a lookup of a key reads one of them in each folder that it asks for.
INDEX_PARTS = 16


def write_index(index: DataFrame, path: str, prefix_length: int = 2, parts: int = INDEX_PARTS) -> None:
    """Parquet by key type and key prefix, so that a lookup of some keys reads only their folders; a prefix is spread over ``parts`` tasks by record."""
    keyed = index.withColumn("prefix", F.substring("key", 1, prefix_length)).withColumn("__fl_part", F.pmod(F.xxhash64("record_id", "compound_id"), F.lit(parts)))
    keyed.repartition("key_type", "prefix", "__fl_part").drop("__fl_part").sortWithinPartitions("key").write.mode("overwrite").partitionBy("key_type", "prefix").parquet(path)


def query_index(plants: DataFrame, index: DataFrame, fallback: tuple[str, ...] = ("species", "genus"), max_records: int | None = None) -> DataFrame:
    """Index rows of each plant by its species, then its fallback ranks: plant_id, matched_rank, record...

    Fallback rows of the plant's own species are left out; a record found by several ranks counts by
    the best; at most ``max_records`` per plant, best rank, then name, then record. With a limit, each
    key of the index is first cut to the records that can be among the first of any plant, so a hot genus
    does not meet its plants whole.
    ``plants``: plant_id, species, genus, family.
    """
    wanted = {"species": words_key(F.col("species")), "genus": F.coalesce(F.lower(non_empty(F.col("genus"))), F.split_part(words_key(F.col("species")), F.lit(" "), F.lit(1))), "family": F.lower(non_empty(F.col("family")))}
    keys = F.explode(F.array(*[F.struct(F.lit(r).alias("key_type"), wanted[r].alias("key"), F.lit(RANKS.index(r)).alias("rank_order")) for r in fallback]))
    asked = plants.select("plant_id", words_key(F.col("species")).alias("own"), keys.alias("k")).select("plant_id", "own", "k.*").filter("key <> ''")
    if max_records is not None:
        index = _first_records(index, max_records)
    met = asked.join(index, ["key_type", "key"]).filter((F.col("key_type") == "species") | (F.col("species_key") != F.col("own")))
    best = met.groupBy("plant_id", "record_id", "compound_id", "species_key", "source").agg(F.min("rank_order").alias("rank_order"), F.min("name").alias("name"))
    if max_records is not None:
        order = Window.partitionBy("plant_id").orderBy("rank_order", "name", "record_id", "compound_id", "species_key", "source")
        best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_records).drop("place")
    matched = F.element_at(F.array(*[F.lit(r) for r in RANKS]), F.col("rank_order") + 1)
    return best.select("plant_id", matched.alias("matched_rank"), "record_id", "compound_id", "species_key", "name", "source")


def _first_records(index: DataFrame, most: int) -> DataFrame:
    """Of each key the rows that some plant may be given: the first 2 * ``most`` of each species, and of those the first 4 * ``most``.

    Of a key a plant looks at no more than its first 2 * ``most`` rows of other species: ``most`` that it
    takes, and fewer than that which a better rank has given already. No species has more of those than is
    kept, and where a key is cut, its own species has taken at most half of what is left.
    """
    same = ["key_type", "key", "record_id", "compound_id", "species_key", "source"]
    rows = index.groupBy(*same).agg(F.min("name").alias("name"))
    order = ["name", "record_id", "compound_id", "species_key", "source"]
    within = F.row_number().over(Window.partitionBy("key_type", "key", "species_key").orderBy(*order))
    few = rows.withColumn("w", within).filter(F.col("w") <= 2 * most)  # no species gives more than that
    firsts = F.row_number().over(Window.partitionBy("key_type", "key").orderBy(*order))
    return few.withColumn("f", firsts).filter(F.col("f") <= 4 * most).drop("w", "f")


def occurrence_rows(matches: DataFrame) -> DataFrame:
    """Matches as occurrences: species matches are direct and of high confidence, others fallbacks of medium."""
    direct = F.col("matched_rank") == "species"
    return matches.select("plant_id", "record_id", "compound_id", "matched_rank", F.when(direct, "high").otherwise("medium").alias("confidence"), F.when(direct, "direct_species_database").otherwise(F.concat("matched_rank", F.lit("_database_fallback"))).alias("evidence_tier"))


def query_accounting(plants: DataFrame, matches: DataFrame, sources: list[str]) -> DataFrame:
    """Per plant and source: direct and fallback records, and whether there are any."""
    counts = matches.groupBy("plant_id", "source").agg(F.count_if(F.col("matched_rank") == "species").alias("n_direct"), F.count_if(F.col("matched_rank") != "species").alias("n_fallback"))
    grid = plants.select("plant_id").distinct().select("plant_id", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    out = grid.join(counts, ["plant_id", "source"], "left").na.fill(0, ["n_direct", "n_fallback"])
    return out.withColumn("status", F.when(F.col("n_direct") > 0, "records").when(F.col("n_fallback") > 0, "fallback_only").otherwise("no_records"))


def species_aliases(taxa: DataFrame) -> DataFrame:
    """(species_key, alias, alias_type): other names on file of each species, each once, in the order of types."""
    kinds = F.array(F.struct(F.lit(0).alias("o"), F.lit("accepted_name").alias("alias_type"), F.col("accepted_species_name").alias("alias")), F.struct(F.lit(1).alias("o"), F.lit("typed_name").alias("alias_type"), F.col("species").alias("alias")), F.struct(F.lit(2).alias("o"), F.lit("core_name").alias("alias_type"), taxon_core_name(F.col("species")).alias("alias")))
    rows = taxa.select(words_key(F.col("species")).alias("species_key"), F.explode(kinds).alias("k")).select("species_key", "k.o", "k.alias_type", non_empty(F.col("k.alias")).alias("alias")).filter("species_key <> '' and alias is not null")
    return rows.groupBy("species_key", "alias").agg(F.min_by("alias_type", "o").alias("alias_type"))


def bind_unique(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by name (missing columns null); of rows with the same key the one of the earliest part stays, then the smallest row."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("__fl_part", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    others = [c for c in out.columns if c not in keys and c != "__fl_part"]
    best = out.groupBy(*keys).agg(F.min(F.struct("__fl_part", *others)).alias("__fl_row"))
    return best.select(*keys, *[F.col(f"__fl_row.{c}").alias(c) for c in others])


def coalesce_queries(queries: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Duplicate queries of one key merged: the first value present of each field, by query_id."""
    return queries.groupBy(key).agg(F.min("query_id").alias("query_id"), *[F.min_by(non_empty(F.col(f)), F.when(non_empty(F.col(f)).isNotNull(), F.col("query_id"))).alias(f) for f in fields], F.count(F.lit(1)).alias("n_queries"))


def provider_availability(index: DataFrame, sources: list[str]) -> DataFrame:
    """(source, n_records, n_species, status) of each asked source in an index: ready or empty."""
    counts = index.filter("key_type = 'species'").groupBy(F.lower("source").alias("source")).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("species_key").alias("n_species"))
    asked = index.sparkSession.createDataFrame([(s.lower(),) for s in sources], "source string")
    out = asked.join(counts, "source", "left").na.fill(0, ["n_records", "n_species"])
    return out.withColumn("status", F.when(F.col("n_records") > 0, "ready").otherwise("empty"))


def provider_gate(accounts: DataFrame, n_species: int, least: float = 0.9) -> DataFrame:
    """(source, n_plants, share, gate) of an accounting: a source passes if enough of the plants have an account that is not failed."""
    done = F.countDistinct(F.when(F.col("status") != "failed", F.col("plant_id")))
    share = F.round(F.col("n_plants") / F.lit(max(1, n_species)), 4)
    return accounts.groupBy("source").agg(done.alias("n_plants")).withColumn("share", share).withColumn("gate", F.when(share >= least, "pass").otherwise("fail"))


def remap_queries(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (species, plant_name, ...) with the query id of their species, else of their plant name; null where neither is asked.

    ``queries``: query_id, species, plant_name; of several queries of one name the smallest id counts.
    """
    by = lambda c, name: queries.filter(words_key(F.col(c)) != "").groupBy(words_key(F.col(c)).alias("__fl_" + name)).agg(F.min("query_id").alias("__fl_id_" + name))
    keyed = rows.withColumns({"__fl_s": words_key(F.col("species")), "__fl_p": words_key(F.col("plant_name"))})
    out = keyed.join(by("species", "s"), "__fl_s", "left").join(by("plant_name", "p"), "__fl_p", "left")
    return out.withColumn("query_id", F.coalesce("__fl_id_s", "__fl_id_p")).drop("__fl_s", "__fl_p", "__fl_id_s", "__fl_id_p")
