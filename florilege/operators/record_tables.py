"""Tables out of tagged flat records, their links and the metadata of what they link to.

``records``: record, field, value (see flat_record_fields). ``links``: record, target_db, target_id.
``metadata``: db, id, name, definition, equation; the first row of an id by name counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import rules
from florilege.functions.extract import all_matches, extract_identifiers, reaction_participants
from florilege.functions.text import non_empty

#: What identifiers of each kind look like.
REACTION_ID, MODULE_ID, EC_NUMBER = r"\bR\d{5}\b", r"\bM\d{5}\b", r"\b[0-9]+\.[0-9]+\.[0-9]+\.[0-9A-Za-z-]+\b"


def metadata_lookup(metadata: DataFrame, db: str) -> DataFrame:
    """One row per id of a database: id, name, definition, equation."""
    rows = metadata.filter((F.col("db") == db) & F.col("id").isNotNull())
    return rows.groupBy("id").agg(F.min(F.struct(F.col("name").isNull().alias("n"), "name", "definition", "equation")).alias("m")).select("id", "m.name", "m.definition", "m.equation")


def link_targets(links: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct link targets whose metadata is to be read, in the order of database and id; the first ``limit``."""
    out = links.filter("target_id is not null").select("target_db", "target_id").distinct().orderBy("target_db", "target_id")
    return out if limit is None else out.limit(limit)


def _entries(records: DataFrame, links: DataFrame, field: str, db: str, pattern: str) -> DataFrame:
    """(record, id, own_text, evidence): ids in a field of the records and ids that they link to; a field without any id has a null one."""
    mine = records.filter(F.col("field") == field).select("record", F.explode_outer(F.when(F.size(all_matches(F.col("value"), pattern)) > 0, all_matches(F.col("value"), pattern))).alias("id"), F.col("value").alias("own_text"), F.lit("record").alias("evidence"))
    linked = links.filter(F.col("target_db") == db).select("record", F.col("target_id").alias("id"), F.lit(None).cast("string").alias("own_text"), F.lit("link").alias("evidence"))
    return mine.unionByName(linked)


def identifiers(records: DataFrame) -> DataFrame:
    """(record, identifier_type, identifier, field): lines "Name: id id" of DBLINKS, and identifiers in any field."""
    links = records.filter("field = 'DBLINKS'").select("record", non_empty(F.substring_index("value", ":", 1)).alias("identifier_type"), F.explode(F.split(F.expr("substring(value, length(substring_index(value, ':', 1)) + 2)"), r"[,;\s]+")).alias("identifier"), "field").filter("identifier <> '' and identifier_type is not null")
    numbered = records.withColumn("__fl_row", F.struct("record", "field"))
    found = extract_identifiers(numbered, "__fl_row", "value").select("__fl_row.record", "identifier_type", "identifier", "__fl_row.field")
    return links.unionByName(found).distinct()


def reactions(records: DataFrame, links: DataFrame, metadata: DataFrame) -> DataFrame:
    """(record, reaction_id, name, definition, equation, evidence)."""
    out = _entries(records, links, "REACTION", "reaction", REACTION_ID).join(metadata_lookup(metadata, "reaction"), "id", "left")
    return out.select("record", F.col("id").alias("reaction_id"), "name", "definition", "equation", "evidence").distinct()


def enzymes(records: DataFrame, links: DataFrame, metadata: DataFrame) -> DataFrame:
    """(record, ec_number, name, enzyme_class, evidence)."""
    out = _entries(records, links, "ENZYME", "enzyme", EC_NUMBER).join(metadata_lookup(metadata, "enzyme"), "id", "left")
    return out.select("record", F.col("id").alias("ec_number"), "name", rules.enzyme_class(F.col("id")).alias("enzyme_class"), "evidence").distinct()


def modules(records: DataFrame, links: DataFrame, metadata: DataFrame) -> DataFrame:
    """(record, module_id, name, definition, evidence); the record's own text without the id names what has no metadata."""
    out = _entries(records, links, "MODULE", "module", MODULE_ID).join(metadata_lookup(metadata, "module"), "id", "left")
    own = non_empty(F.when(F.col("id").isNull(), F.col("own_text")).otherwise(F.replace("own_text", "id", F.lit(""))))
    return out.select("record", F.col("id").alias("module_id"), F.coalesce(non_empty(F.col("name")), own).alias("name"), "definition", "evidence").distinct()


def classifications(pathways: DataFrame, enzyme_rows: DataFrame, records: DataFrame) -> DataFrame:
    """(record, classification_type, classification, evidence): groups of pathways, classes of enzymes and BRITE lines."""
    a = pathways.filter(non_empty(F.col("pathway_group")).isNotNull()).select("record", F.lit("KEGG pathway group").alias("classification_type"), F.col("pathway_group").alias("classification"), F.col("name").alias("evidence"))
    b = enzyme_rows.filter(non_empty(F.col("enzyme_class")).isNotNull()).select("record", F.lit("EC enzyme class").alias("classification_type"), F.col("enzyme_class").alias("classification"), F.col("ec_number").alias("evidence"))
    c = records.filter("field = 'BRITE'").select("record", F.lit("KEGG BRITE").alias("classification_type"), F.col("value").alias("classification"), F.col("field").alias("evidence"))
    return a.unionByName(b).unionByName(c).distinct()


def participants(reaction_rows: DataFrame) -> DataFrame:
    """(record, reaction_id, side, place, participant_id, participant_name) of the equations of reactions."""
    keyed = reaction_rows.select(F.struct("record", "reaction_id").alias("__fl_r"), "equation", "definition")
    return reaction_participants(keyed, "__fl_r", "equation", "definition").select("__fl_r.record", "__fl_r.reaction_id", "side", "place", "participant_id", "participant_name").distinct()


def search_candidates(matches: DataFrame, limit: int) -> DataFrame:
    """Candidates of name searches (query, entry_id, database, score) with accepted, rejection and match_rank.

    Exact names are accepted, all others stay for the audit. The first ``limit`` accepted ones of a query,
    compounds before drugs, then by entry, have a rank.
    """
    rank = F.when(F.col("database") == "compound", 0).when(F.col("database") == "drug", 1).otherwise(2)
    once = matches.groupBy("query", "entry_id", "database").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(rank, "entry_id"))
    accepted = once.filter("score = 0").withColumn("match_rank", place).filter(F.col("match_rank") <= limit).select("query", "entry_id", "database", "match_rank")
    out = once.join(accepted, ["query", "entry_id", "database"], "left")
    return out.select("query", "entry_id", "database", "score", F.when(F.col("score") == 0, "Yes").otherwise("No").alias("accepted"), F.when(F.col("score") != 0, "broad_name_match_not_exact").alias("rejection"), "match_rank")


def entry_queries(ids: DataFrame, matches: DataFrame, fallback: Column) -> DataFrame:
    """(entry_id, query): the best ranked query that an entry was found by, else the fallback."""
    best = matches.filter("query is not null").groupBy("entry_id").agg(F.min(F.struct("match_rank", "query")).alias("b"))
    return ids.select("entry_id").distinct().join(best, "entry_id", "left").select("entry_id", F.coalesce("b.query", fallback).alias("query"))


def record_profile(records: DataFrame, links: DataFrame, metadata: DataFrame, pathways: DataFrame) -> dict[str, DataFrame]:
    """All tables of records, by name."""
    enzyme_rows, reaction_rows = enzymes(records, links, metadata), reactions(records, links, metadata)
    return {
        "identifiers": identifiers(records), "pathways": pathways, "reactions": reaction_rows, "enzymes": enzyme_rows, "modules": modules(records, links, metadata),
        "classifications": classifications(pathways, enzyme_rows, records), "participants": participants(reaction_rows),
    }
