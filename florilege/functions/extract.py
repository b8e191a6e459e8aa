"""Values pulled out of free text: identifiers, toxicity figures, reactions, taxonomic ranks, name aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import non_empty, spell_greek, squish

#: Identifier types and their patterns.
IDENTIFIER_PATTERNS = {
    "CAS": r"\b[0-9]{2,7}-[0-9]{2}-[0-9]\b",
    "KEGG": r"\b[CDGMR]\d{5}\b",
    "EC": r"\b[0-9]+\.[0-9]+\.[0-9]+\.[0-9A-Za-z-]+\b",
    "ChEBI": r"\b(?:CHEBI|ChEBI):\s*\d+\b",
    "PubMed": r"\bPMID:?\s*\d+\b|\bPubMed:?\s*\d+\b",
    "DOI": r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b",
    "UNII": r"\b[A-Z0-9]{10}\b",
    "GHS": r"\bH[0-9]{3}[A-Za-z]?\b|\bP[0-9]{3}[A-Za-z]?\b",
}
TOXICITY = r"(?i)\b(LD50|LC50|NOAEL|LOAEL|EC50|IC50)\b[^0-9]{0,50}?([-+]?\d*\.?\d+)\s*([A-Za-z/%.]+)"
#: Rank -> suffix of a taxon name of that rank.
RANK_SUFFIXES = {"family": "[A-Z][a-z]+(?:aceae|idae)", "order": "[A-Z][a-z]+ales", "class": "[A-Z][a-z]+(?:opsida|mycetes)", "phylum": "[A-Z][a-z]+(?:phyta|mycota)"}


def all_matches(text: Column, pattern: str) -> Column:
    """Distinct matches in order of appearance; empty for null."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1))


def extract_identifiers(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, identifier_type, identifier): each identifier of a text once, with uniform prefixes.

    One pass over the text builds one array of (type, values), which is exploded. Null and empty texts have none.
    """
    found = F.array(*[F.struct(F.lit(kind).alias("identifier_type"), all_matches(F.col(text), p).alias("ids")) for kind, p in IDENTIFIER_PATTERNS.items()])
    kinds = df.select(F.col(row_id), F.explode(F.filter(found, lambda x: F.size(x["ids"]) > 0)).alias("k"))
    value = F.regexp_replace(F.regexp_replace(F.col("identifier"), r"^(?:CHEBI|ChEBI):\s*", "CHEBI:"), r"^(?:PMID|PubMed):?\s*", "PMID:")
    return kinds.select(row_id, "k.identifier_type", F.explode("k.ids").alias("identifier")).select(row_id, "identifier_type", value.alias("identifier")).distinct()


def toxicity_figures(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, metric, value, unit, n) of figures such as "LD50 oral 1200 mg/kg"; repeated figures are counted."""
    parts = [F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOXICITY), i) for i in (1, 2, 3)]
    rows = df.select(row_id, F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("m", "v", "u"), strict=True)])).alias("t"))
    return rows.select(row_id, F.upper("t.m").alias("metric"), F.col("t.v").try_cast("double").alias("value"), F.col("t.u").alias("unit")).groupBy(row_id, "metric", "value", "unit").agg(F.count(F.lit(1)).alias("n"))


def reaction_participants(df: DataFrame, row_id: str, equation: str, definition: str | None = None) -> DataFrame:
    """(row_id, side, place, participant_id, participant_name) of equations such as "C00031 + 2 C00002 <=> C00103"."""
    arrow = r"\s*(?:<=>|=>|<=|->|=)\s*"

    def sides(name: str | None) -> Column:
        return F.split(F.coalesce(F.col(name), F.lit("")) if name else F.lit(""), arrow, 2)

    both = df.filter(F.size(sides(equation)) == 2).select(row_id, sides(equation).alias("e"), sides(definition).alias("d"))
    side = both.select(row_id, F.posexplode("e").alias("s", "part"), "d")
    pieces = side.select(row_id, "s", F.posexplode(F.split("part", r"\s+\+\s+")).alias("place", "piece"), F.split(F.get("d", F.col("s")), r"\s+\+\s+").alias("names"))
    ids = pieces.select(row_id, "s", "place", F.explode(all_matches(F.col("piece"), r"\b[CDG]\d{5}\b")).alias("participant_id"), non_empty(F.regexp_replace(F.try_element_at("names", F.col("place") + 1), r"^\d+\s+", "")).alias("participant_name"))
    return ids.select(row_id, F.when(F.col("s") == 0, "substrate").otherwise("product").alias("side"), "place", "participant_id", "participant_name")


def taxon_rank(text: Column, rank: str) -> Column:
    """A rank by its label ("family: X"), else by the suffix of names of that rank."""
    labelled = non_empty(F.regexp_extract(text, rf"(?i)\b{rank}\s*[:=]\s*([A-Za-z-]+)", 1))
    if rank not in RANK_SUFFIXES:
        return labelled
    return F.coalesce(labelled, non_empty(F.regexp_extract(text, rf"\b({RANK_SUFFIXES[rank]})\b", 1)))


def lineage_ranks(lineage: Column, family: Column) -> tuple[Column, Column]:
    """(order, genus) of a lineage array by their place before and after the family."""
    at = F.array_position(lineage, family).cast("int")
    order = F.when(at > 1, F.try_element_at(lineage, at - 1))
    genus = F.when(at >= 1, F.try_element_at(lineage, at + 1))
    return order, genus


def genus_of(species: Column) -> Column:
    return F.nullif(F.regexp_extract(squish(species), r"^([A-Z][a-z-]+)", 1), F.lit(""))


def name_aliases(name: Column) -> Column:
    """Forms of a compound name to look up, in order: as typed, without signs, Greek spelled, without angle brackets."""
    forms = [squish(name), squish(F.regexp_replace(name, r"[^A-Za-z0-9]+", " ")), spell_greek(F.replace(squish(name), F.lit("±"), F.lit("+-"))), squish(F.regexp_replace(name, "[<>]", ""))]
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != "")))


def resolve_names(names: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """(name, compound_id, match_status): the first alias that a table (known_name, compound_id) knows.

    Known names are reduced to one id each (the smallest) before the join. Names without a match
    come out with a null id.
    """
    dim = known.filter("known_name is not null and compound_id is not null").groupBy(F.lower("known_name").alias("alias")).agg(F.min("compound_id").alias("compound_id"))
    tried = names.select(name).distinct().select(name, F.posexplode_outer(name_aliases(F.col(name))).alias("place", "alias")).withColumn("alias", F.lower("alias"))
    best = tried.join(dim, "alias", "left").groupBy(name).agg(F.min(F.when(F.col("compound_id").isNotNull(), F.struct("place", "compound_id"))).alias("b"))
    status = F.when(F.col("b").isNull(), "not_found").when(F.col("b.place") == 0, "name").otherwise(F.concat(F.lit("alias_"), F.col("b.place").cast("string")))
    return best.select(name, F.col("b.compound_id").alias("compound_id"), status.alias("match_status"))
