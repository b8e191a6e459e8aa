"""Table audits against declared schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions.rules import ordered
from florilege.functions.text import known, non_empty, squish

#: Kinds of columns by the first name pattern found.
TYPE_RULES = (("Count$|CID$|AID$|_id$|^n_", "integer"), ("Score$|Similarity$|Mass$|Value$|_rt$|_area$", "numeric"), ("^is_|^has_|Present$|Eligible$", "logical"))
#: Source groups by the first name pattern found.
SOURCE_GROUPS = (("literature", "literature"), ("candidate", "text_mining"), ("desk", "manual"), ("phydorex|herborum|chemarea", "database"))


@dataclass(frozen=True)
class ColumnRule:
    """A declared column."""

    name: str
    kind: str = "character"
    required: bool = False
    allowed: tuple[str, ...] = ()


#: The declared occurrence table.
OCCURRENCE_RULES = (
    ColumnRule("occurrence_id", "integer", True),
    ColumnRule("species", required=True),
    ColumnRule("compound_name", required=True),
    ColumnRule("compound_id", required=True),
    ColumnRule("source_database", required=True),
    ColumnRule("cid", "integer"),
    ColumnRule("confidence", allowed=("high", "medium", "low")),
    ColumnRule("comparable_for_matrix", allowed=("Yes", "No")),
    ColumnRule("matched_rank", allowed=("species", "genus", "family")),
)


def column_kind(name: Column) -> Column:
    return ordered(name, TYPE_RULES, F.lit("character"))


def data_dictionary(spark: SparkSession, table: str, rules: tuple[ColumnRule, ...]) -> DataFrame:
    """The declared columns of a table as rows."""
    return spark.createDataFrame([(table, r.name, r.kind, r.required, "; ".join(r.allowed)) for r in rules], "table_name string, column_name string, kind string, required boolean, allowed string")


def _bad_value(r: ColumnRule) -> Column:
    c = non_empty(F.col(r.name).cast("string"))
    wrong = F.lit(False)
    if r.kind in ("integer", "numeric"):
        wrong = c.try_cast("double").isNull()
    if r.allowed:
        wrong = wrong | ~c.isin(*r.allowed)
    return c.isNotNull() & F.coalesce(wrong, F.lit(True))


def table_issues(df: DataFrame, rules: tuple[ColumnRule, ...]) -> DataFrame:
    """(column_name, issue, n_rows): missing columns, blanks in required columns, wrong types or values.

    One aggregation over the table whatever the number of rules; missing columns need no scan.
    """
    spark = df.sparkSession
    have = [r for r in rules if r.name in df.columns]
    missing = spark.createDataFrame([(r.name, "missing_column", 0) for r in rules if r.name not in df.columns], "column_name string, issue string, n_rows bigint")
    counts = [F.struct(F.lit(r.name).alias("column_name"), F.lit("blank_required").alias("issue"), F.count_if(non_empty(F.col(r.name).cast("string")).isNull()).alias("n_rows")) for r in have if r.required]
    counts += [F.struct(F.lit(r.name).alias("column_name"), F.lit("bad_value").alias("issue"), F.count_if(_bad_value(r)).alias("n_rows")) for r in have]
    if not counts:
        return missing
    row = df.agg(F.array(*counts).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*").filter("n_rows > 0").unionByName(missing)


def table_quality(df: DataFrame, rules: tuple[ColumnRule, ...]) -> DataFrame:
    """One row: rows, share of non-blank required cells (3 places), and whether the table is empty, incomplete or ok."""
    required = [r.name for r in rules if r.required and r.name in df.columns]
    filled = sum((F.when(non_empty(F.col(c).cast("string")).isNotNull(), 1).otherwise(0) for c in required), F.lit(0))
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(filled).alias("filled"))
    share = F.round(F.col("filled") / (F.col("n_rows") * max(1, len(required))), 3)
    return out.select("n_rows", F.lit(len(df.columns)).alias("n_columns"), share.alias("completeness"), F.when(F.col("n_rows") == 0, "empty").when(share < 0.9, "incomplete").otherwise("ok").alias("status"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys that repeat and rows beyond the first of each; rows with a blank key part are left out."""
    usable = df
    for k in keys:
        usable = usable.filter(non_empty(F.col(k).cast("string")).isNotNull())
    counts = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counts.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def source_diagnostics(df: DataFrame, source: str, query: str | None = None) -> DataFrame:
    """Per source, or per query and source (case and outer spaces ignored): its group by name, rows, and rows with an identifier."""
    name = F.upper(F.trim(F.col(source)))
    by = [F.col(query).alias("query")] if query else []
    counts = df.groupBy(*by, name.alias("source")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(non_empty(F.col("compound_id")).isNotNull()).alias("n_identified"))
    return counts.withColumn("source_group", ordered(F.col("source"), SOURCE_GROUPS, F.lit("other")))


def identity_risks(name: Column, notes: Column, smiles: Column, issue: Column) -> dict[str, Column]:
    """The nine risks of a compound's identity by its name and notes, its structure and the kind of issue on file (``resolved``: none)."""
    text = F.lower(F.concat_ws(" ", F.coalesce(non_empty(name), F.lit("")), F.coalesce(non_empty(notes), F.lit(""))))
    kind = F.lower(F.coalesce(non_empty(issue), F.lit("")))
    found = lambda c, pattern: F.coalesce(c.rlike(pattern), F.lit(False))
    # The patterns of the risks.
    return {
        "ambiguity": (kind != "resolved") | found(text, "ambiguous|multiple|mixture|isomer"),
        "salt_hydrate": found(text, "salt|hydrate|hydrochloride|sodium|potassium"),
        "stereochemistry_unspecified": known(smiles) & ~found(smiles, r"@|/|\\") & found(text, "stereo|isomer|alpha|beta|gamma|delta"),
        "mixture_common_name": found(text, "mixture|extract|fraction|isomers|derivatives") | found(kind, "mixture|isomer"),
        "class_like_name": found(kind, "class|family|broad_class"),
        "plant_source_name": found(kind, "source|product|material"),
        "synonym_only_match": found(text, "synonym"),
        "alias_derived_match": found(text, "alias|transliter"),
        "multiple_candidate": found(text, "multiple|ambiguous") | found(kind, "ambiguous"),
    }


def identity_issue(inchikey: Column, cid: Column, smiles: Column, compound_id: Column) -> Column:
    """resolved, structure_only, identifier_only or unresolved."""
    return F.when(known(inchikey) | known(cid.cast("string")), "resolved").when(known(smiles), "structure_only").when(known(compound_id), "identifier_only").otherwise("unresolved")


def identity_audit(df: DataFrame) -> DataFrame:
    """Per record: how its compound is identified, the issue, and which of nine risks its name carries."""
    method = F.when(non_empty(F.col("inchikey")).isNotNull(), "inchikey").when(F.col("cid").isNotNull(), "cid").when(non_empty(F.col("smiles")).isNotNull(), "smiles").otherwise("name_only")
    issue = identity_issue(F.col("inchikey"), F.col("cid"), F.col("smiles"), F.col("compound_id"))
    notes = F.col("curation_flag") if "curation_flag" in df.columns else F.lit(None).cast("string")
    risks = F.concat_ws("; ", *[F.when(c, F.lit(n)) for n, c in identity_risks(F.col("compound_name"), notes, F.col("smiles"), issue).items()])
    return df.select("occurrence_id", method.alias("method"), issue.alias("issue"), risks.alias("risks"), F.when(method.isin("inchikey", "cid") & (risks == ""), "high").when(method != "name_only", "medium").otherwise("low").alias("identity_confidence"))


def identity_review_table(df: DataFrame, include_resolved: bool = False, least: int = 1) -> DataFrame:
    """Per clean name: its issue (the best of its records), structures, ids, records and species, and the decision to be filled in; names of fewer than ``least`` species are left out."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("resolved", "structure_only", "identifier_only", "unresolved")]), identity_issue(F.col("inchikey"), F.col("cid"), F.col("smiles"), F.col("compound_id")))
    out = df.filter(known(F.col("compound_name_clean"))).groupBy("compound_name_clean").agg(
        F.min(rank).alias("r"), F.countDistinct(non_empty(F.col("inchikey"))).alias("n_structures"), F.countDistinct(non_empty(F.col("compound_id"))).alias("n_ids"), F.count(F.lit(1)).alias("n_records"), F.countDistinct(non_empty(F.col("species"))).alias("n_species")
    )
    issue = F.when(F.col("n_structures") > 1, "ambiguous").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("resolved", "structure_only", "identifier_only", "unresolved")]), F.col("r").cast("int")))
    out = out.withColumn("issue", issue).filter(F.col("n_species") >= least).drop("r")
    none = F.lit(None).cast("string")
    return (out if include_resolved else out.filter("issue <> 'resolved'")).withColumns({"decision": none, "reviewed_inchikey": none, "reviewer": none})


def apply_identity_review(df: DataFrame, review: DataFrame) -> DataFrame:
    """Rows with the reviewed identity of their clean name: identity_decision, and the InChIKey that an accepted decision gives.

    ``review``: compound_name_clean, decision, reviewed_inchikey. Accepted are accept, accepted and resolved with
    an identity; names that are decided in several ways, or with several identities, count as conflicting and change nothing.
    """
    word = F.lower(squish(F.col("decision")))
    accepted = F.coalesce(word.isin("accept", "accepted", "resolved"), F.lit(False)) & non_empty(F.col("reviewed_inchikey")).isNotNull()
    kinds = review.filter(known(F.col("compound_name_clean")) & known(F.col("decision"))).select("compound_name_clean", F.when(accepted, "accepted").otherwise("rejected").alias("d"), F.when(accepted, F.upper(non_empty(F.col("reviewed_inchikey")))).alias("k"))
    by_name = kinds.groupBy("compound_name_clean").agg(F.countDistinct("d").alias("n"), F.countDistinct("k").alias("m"), F.min("d").alias("d"), F.min("k").alias("k"))
    by_name = by_name.select("compound_name_clean", F.when((F.col("n") > 1) | (F.col("m") > 1), "conflicting").otherwise(F.col("d")).alias("__fl_d"), F.when((F.col("n") == 1) & (F.col("m") == 1), F.col("k")).alias("__fl_k"))
    out = df.join(by_name, "compound_name_clean", "left")
    return out.withColumn("inchikey", F.coalesce("__fl_k", "inchikey")).withColumn("identity_decision", F.coalesce("__fl_d", F.lit("not_reviewed"))).drop("__fl_d", "__fl_k")


def identity_audit_summary(audit: DataFrame) -> DataFrame:
    """(check, value, status) of an identity audit: records, duplicates of identifiers, unresolved and risky records; warn where there are any."""
    n = F.count(F.lit(1))
    row = audit.agg(
        n.alias("records"), (n - F.countDistinct("occurrence_id")).alias("repeated_identifiers"), F.count_if(F.col("issue") == "unresolved").alias("unresolved"), F.count_if(F.col("risks") != "").alias("with_risks"),
        F.count_if(~F.col("identity_confidence").isin("high", "medium", "low") | F.col("identity_confidence").isNull()).alias("invalid_confidence"),
    )
    return checks(row, {"records": "info", "repeated_identifiers": "fail", "unresolved": "warn", "with_risks": "warn", "invalid_confidence": "fail"})


def checks(row: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(check, value, status): the counts of one row as checks; a count above 0 has the status of its kind, else pass."""
    parts = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("value"), F.lit(k).alias("kind")) for c, k in kinds.items()])
    out = row.select(F.explode(parts).alias("x")).select("x.*")
    return out.select("check", "value", F.when((F.col("value") > 0) | (F.col("kind") == "info"), F.col("kind")).otherwise("pass").alias("status"))


#: Statuses of runs and of provider calls.
RUN_STATUSES = ("planned", "running", "complete", "partial", "failed", "skipped")


def manifest_checks(manifest: DataFrame) -> DataFrame:
    """(check, value, status) of a run manifest (stage, status, path, n_rows): repeated and blank stages, unknown statuses, complete stages without a path, negative counts."""
    status = F.lower(squish(F.col("status")))
    row = manifest.agg(
        F.count(F.lit(1)).alias("stages"), (F.count("stage") - F.countDistinct("stage")).alias("repeated_stages"), F.count_if(non_empty(F.col("stage")).isNull()).alias("blank_stages"),
        F.count_if(~F.coalesce(status.isin(*RUN_STATUSES), F.lit(False))).alias("unknown_statuses"), F.count_if((status == "complete") & non_empty(F.col("path")).isNull()).alias("complete_without_path"), F.count_if(F.col("n_rows") < 0).alias("negative_rows"),
    )
    return checks(row, {"stages": "info", "repeated_stages": "fail", "blank_stages": "fail", "unknown_statuses": "fail", "complete_without_path": "fail", "negative_rows": "fail"})


#: Columns of provider diagnostics and the names that they go by.
DIAGNOSTICS = {"provider": ["provider", "source", "source_database"], "query": ["query", "species", "plant"], "status": ["status", "state"], "n_records": ["n_records", "records", "rows"], "message": ["message", "error", "note"]}


def standard_diagnostics(df: DataFrame) -> DataFrame:
    """Diagnostics of any layout as provider, query, status, n_records, message; a missing status follows from the records and the message."""
    have = {c.lower(): c for c in df.columns}
    pick = {n: next((F.col(f"`{have[x]}`").cast("string") for x in names if x in have), F.lit(None).cast("string")) for n, names in DIAGNOSTICS.items()}
    out = df.select(F.lower(non_empty(pick["provider"])).alias("provider"), non_empty(pick["query"]).alias("query"), F.lower(non_empty(pick["status"])).alias("given"), F.coalesce(pick["n_records"].try_cast("bigint"), F.lit(0)).alias("n_records"), non_empty(pick["message"]).alias("message"))
    status = F.coalesce("given", F.when(F.col("n_records") > 0, "complete").when(F.col("message").isNotNull(), "failed").otherwise("no_records"))
    return out.select("provider", "query", status.alias("status"), "n_records", "message")


def combine_batches(batches: list[tuple[str, DataFrame]]) -> DataFrame:
    """Tables of several batches under each other, missing columns null, with the batch name and number."""
    out = None
    for i, (name, df) in enumerate(batches):
        part = df.withColumn("batch_name", F.lit(name)).withColumn("batch_index", F.lit(i + 1))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def batch_status(rows: DataFrame, batch: str, query: str, property_column: str, least: float = 0.9) -> DataFrame:
    """Per batch: queries, those with the property, their ratio (4 places) and ok or incomplete."""
    with_property = F.countDistinct(F.when(non_empty(F.col(property_column).cast("string")).isNotNull(), F.col(query)))
    out = rows.groupBy(batch).agg(F.countDistinct(query).alias("n_queries"), with_property.alias("n_with_property"))
    ratio = F.round(F.col("n_with_property") / F.col("n_queries"), 4)
    return out.withColumn("ratio", ratio).withColumn("status", F.when(ratio < least, "incomplete").otherwise("ok"))


def table_signature(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free signature of the content, for checkpoints: a sum, in which repeated rows do not cancel out."""
    h = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias("signature"))


def grouped_counts(df: DataFrame, keys: list[str], mode: str = "rollup") -> DataFrame:
    """Rows and distinct compounds for grouping sets of the keys (rollup or cube); ``level`` says how many keys a row is summed over."""
    grouped = {"rollup": df.rollup, "cube": df.cube}[mode](*keys)
    out = grouped.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(non_empty(F.col("compound_id"))).alias("n_compounds"), F.grouping_id().alias("__fl_g"))
    return out.withColumn("level", F.bit_count("__fl_g")).drop("__fl_g")


def monthly_counts(df: DataFrame, at: str, until: str) -> DataFrame:
    """Per month of a time: rows, the days from the time to a second one (mean, rounded to 3 places), and rows on weekends."""
    days = F.datediff(F.col(until).cast("date"), F.col(at).cast("date"))
    weekend = F.dayofweek(F.col(at).cast("date")).isin(1, 7)
    return df.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(days), 3).alias("mean_days"), F.count_if(weekend).alias("n_weekend"), F.quarter(F.max(at)).alias("quarter"))
