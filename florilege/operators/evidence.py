"""Species evidence: grades, review decisions, filters, overrides, feature matrices and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.functions.rules import confidence_rank
from florilege.functions.text import collapse_sorted, feature_key, known, non_empty, squish, truthy, yes_no

#: Grades with their ranks.
GRADES = {
    "direct_species_database_record": 1, "direct_species_literature_supported_record": 2, "source_backed_genus_family_fallback": 3,
    "pubtator_pubmed_candidate_only": 4, "unresolved_or_review_required": 5, "excluded_by_review": 99,
}
_EXCLUDE = ("exclude", "excluded", "remove", "do_not_use", "reject")
_TO_DATABASE = ("promote_direct_species_database", "direct_species_database", "confirmed_direct_database")
_TO_LITERATURE = ("promote_direct_species_literature", "direct_species_literature", "confirmed_literature")


#: What each grade means.
GRADE_LABELS = {
    "direct_species_database_record": "Direct species database record", "direct_species_literature_supported_record": "Direct species literature-supported record",
    "source_backed_genus_family_fallback": "Source-backed genus or family fallback", "pubtator_pubmed_candidate_only": "PubTator or PubMed candidate only",
    "unresolved_or_review_required": "Unresolved or review-required", "excluded_by_review": "Excluded by review",
}


def grade_dictionary(spark: SparkSession) -> DataFrame:
    """The grades with rank, label, and whether a grade is direct evidence and backed by a source."""
    rows = [(g, r, GRADE_LABELS[g], "Yes" if r <= 2 else "No", "Yes" if r <= 3 else "No") for g, r in GRADES.items()]
    return spark.createDataFrame(rows, "evidence_grade string, evidence_grade_rank int, label string, is_direct string, source_backed string")


def with_decisions(occurrences: DataFrame, review: DataFrame | None) -> DataFrame:
    """Add ``decision``: a review of the row's id, else of (species, clean name, source, record), else not_reviewed.

    ``review``: occurrence_id, species, compound_name_clean, source_database, source_record_id, decision.
    Several reviews of one key are reduced to the alphabetically last.
    """
    if review is None:
        return occurrences.withColumn("decision", F.lit("not_reviewed"))
    by_id = review.filter("occurrence_id is not null and decision is not null").groupBy("occurrence_id").agg(F.max("decision").alias("d_id"))
    key = ["species", "compound_name_clean", "source_database", "source_record_id"]
    by_key = review.filter("occurrence_id is null and decision is not null").groupBy(*key).agg(F.max("decision").alias("d_key"))
    joined = occurrences.join(by_id, "occurrence_id", "left").join(by_key, key, "left")
    return joined.withColumn("decision", F.coalesce(non_empty(F.col("d_key")), non_empty(F.col("d_id")), F.lit("not_reviewed"))).drop("d_id", "d_key")


def grade(columns: list[str]) -> Column:
    """The evidence grade of a row by the first rule that holds; ``columns`` are those of the rows, of which evidence_url, pmid and doi may be absent."""
    there = lambda c: known(F.col(c)) if c in columns else F.lit(False)
    low = lambda c: F.lower(F.coalesce(squish(F.col(c)), F.lit("")))
    decision, tier, source, rank, status = low("decision"), low("evidence_tier"), low("source_database"), low("matched_rank"), low("occurrence_status")
    has_compound = known(F.col("compound_name")) | known(F.col("compound_name_clean")) | known(F.col("compound_id"))
    has_record = known(F.col("source_record_id")) | there("evidence_url") | there("pmid") | there("doi")
    cited = source.rlike("pubmed|literature") | there("pmid") | there("doi")
    species = rank == "species"
    return (
        F.when(decision.isin(*_EXCLUDE), "excluded_by_review")
        .when(decision.isin(*_TO_DATABASE), "direct_species_database_record")
        .when(decision.isin(*_TO_LITERATURE), "direct_species_literature_supported_record")
        .when(~has_compound | tier.contains("unresolved") | status.contains("unresolved"), "unresolved_or_review_required")
        .when(tier.contains("direct_species_database") | (species & ~source.rlike("pubmed|pubtator|literature|candidate") & has_record), "direct_species_database_record")
        .when(tier.contains("direct_species_literature") | (species & cited & ~tier.rlike("candidate|pubtator")), "direct_species_literature_supported_record")
        .when(tier.rlike("genus|family|fallback") | rank.isin("genus", "family"), "source_backed_genus_family_fallback")
        .when(tier.rlike("pubtator|candidate|co.?mention") | source.contains("pubtator") | (source.contains("pubmed") & ~tier.contains("direct")), "pubtator_pubmed_candidate_only")
        .otherwise("unresolved_or_review_required")
    )


def grade_evidence(occurrences: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """One row per occurrence: grade, rank, flags and the filter key."""
    decided = with_decisions(occurrences, review)
    graded = decided.withColumn("evidence_grade", grade(decided.columns))
    structure = known(F.col("smiles")) | known(F.col("inchikey")) | known(F.col("cid"))
    backed = ~F.col("evidence_grade").isin("pubtator_pubmed_candidate_only", "unresolved_or_review_required", "excluded_by_review")
    weak = F.col("evidence_grade").isin("pubtator_pubmed_candidate_only", "unresolved_or_review_required", "source_backed_genus_family_fallback")
    review_required = weak | F.coalesce(F.lower("curation_flag").contains("review"), F.lit(False))
    comparable = truthy(F.col("comparable_for_matrix")) & ~F.lower(F.coalesce(squish(F.col("comparison_scope")), F.lit(""))).isin("", "unknown")
    ranks = F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])
    return graded.select(
        "occurrence_id", "species", "compound_id", "evidence_grade", ranks[F.col("evidence_grade")].alias("evidence_grade_rank"), yes_no(backed).alias("source_backed"),
        yes_no(structure).alias("structure_resolved"), yes_no(comparable).alias("comparable_for_analysis"), yes_no(review_required).alias("review_required"), "decision",
        F.concat_ws("__", "evidence_grade", F.when(structure, "structure_resolved").otherwise("structure_unresolved"), F.when(comparable, "comparable").otherwise("not_comparable")).alias("analysis_filter_key"),
    )


def filter_direct(graded: DataFrame, require_structure: bool = True) -> DataFrame:
    keep = (F.col("evidence_grade_rank") <= 2) & (F.col("review_required") == "No")
    return graded.filter(keep & (F.col("structure_resolved") == "Yes") if require_structure else keep)


def filter_comparable(graded: DataFrame, require_direct: bool = True) -> DataFrame:
    base = filter_direct(graded) if require_direct else graded
    return base.filter("comparable_for_analysis = 'Yes'")


def filter_review_required(graded: DataFrame) -> DataFrame:
    return graded.filter("review_required = 'Yes'")


def grade_summary(graded: DataFrame) -> DataFrame:
    return graded.groupBy("evidence_grade", "evidence_grade_rank").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(non_empty(F.col("species"))).alias("n_species"), F.countDistinct(non_empty(F.col("compound_id"))).alias("n_compounds"), F.count_if(F.col("structure_resolved") == "Yes").alias("n_structure")
    )


def review_reasons(occurrences: DataFrame) -> DataFrame:
    """Rows that need a look, with all reasons."""
    reasons = {
        "no_structure": ~(known(F.col("smiles")) | known(F.col("inchikey"))),
        "no_compound_id": ~known(F.col("compound_id")),
        "no_citation": ~known(F.col("citation_or_url")),
        "low_confidence": confidence_rank(F.col("confidence")) <= 1,
        "weak_tier": F.coalesce(F.lower("evidence_tier").rlike("candidate|fallback|unresolved"), F.lit(True)),
        "flagged": F.coalesce(F.lower("curation_flag").contains("review"), F.lit(False)),
    }
    text = F.concat_ws("; ", *[F.when(c, F.lit(name)) for name, c in reasons.items()])
    return occurrences.select("occurrence_id", text.alias("reasons")).filter("reasons <> ''")


def standardize_metadata(metadata: DataFrame) -> DataFrame:
    """Names squished, genus filled from the species, and what is known of the family."""
    s = squish(F.regexp_replace(F.col("species"), r"""[_'"“”\[\]();.,!?<>*/]+""", " "))
    genus = F.coalesce(non_empty(F.col("genus")), F.nullif(F.regexp_extract(F.initcap(s), r"^([A-Z][a-z-]+)", 1), F.lit("")))
    return metadata.select("metadata_id", s.alias("species"), F.coalesce(non_empty(F.col("accepted_species_name")), s).alias("accepted_species_name"), genus.alias("genus"), non_empty(F.col("family")).alias("family"), F.when(non_empty(F.col("family")).isNotNull(), "supplied").otherwise("missing").alias("family_status"))


def apply_overrides(rows: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """Fields replaced by an override of the compound id, else of the clean name; blanks in overrides change nothing.

    ``overrides``: compound_id, compound_name_clean and the fields. Keys are reduced to one row each.
    """
    by_id = overrides.filter("compound_id is not null").groupBy("compound_id").agg(*[F.max(non_empty(F.col(f))).alias("i_" + f) for f in fields])
    by_name = overrides.filter("compound_id is null and compound_name_clean is not null").groupBy("compound_name_clean").agg(*[F.max(non_empty(F.col(f))).alias("n_" + f) for f in fields])
    out = rows.join(by_id, "compound_id", "left").join(by_name, "compound_name_clean", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce("i_" + f, "n_" + f, f))
    return out.drop(*["i_" + f for f in fields], *["n_" + f for f in fields])


def invalid_overrides(overrides: DataFrame, allowed: DataFrame, fields: list[str]) -> DataFrame:
    """Overrides whose combination of fields no dictionary row allows."""
    return overrides.join(allowed.select(*fields).distinct(), fields, "left_anti")


def feature_long(rows: DataFrame, field: str, mode: str = "count") -> DataFrame:
    """(species, feature, value) of known values: distinct compounds, presence, share of the species' compounds, or summed best confidence weights."""
    usable = rows.filter(known(F.col("species")) & known(F.col(field))).select("species", non_empty(F.col("compound_id")).alias("compound_id"), feature_key(field, F.col(field)).alias("feature"), confidence_rank(F.col("confidence")).alias("c"))
    if mode == "confidence":
        weight = F.when(F.col("c") == 3, 0.9).when(F.col("c") == 2, 0.65).when(F.col("c") == 1, 0.35).otherwise(0.0)
        best = usable.filter("compound_id is not null").groupBy("species", "feature", "compound_id").agg(F.max(weight).alias("w"))
        return best.groupBy("species", "feature").agg(F.round(F.sum("w"), 6).alias("value"))
    counts = usable.groupBy("species", "feature").agg(F.countDistinct("compound_id").cast("double").alias("value"))
    if mode == "binary":
        return counts.withColumn("value", (F.col("value") > 0).cast("double"))
    if mode == "fraction":
        total = usable.groupBy("species").agg(F.greatest(F.countDistinct("compound_id"), F.lit(1)).alias("total"))
        return counts.join(total, "species").select("species", "feature", F.round(F.col("value") / F.col("total"), 6).alias("value"))
    return counts


def feature_matrix(long: DataFrame, universe: DataFrame, features: list[str]) -> DataFrame:
    """Wide features over a species universe: every species of it has a row, 0 where it has nothing."""
    wide = long.groupBy("species").pivot("feature", features).agg(F.max("value"))
    out = universe.select("species").distinct().join(wide, "species", "left").na.fill(0.0, features)
    return out.withColumn("species_id", feature_key("species", F.col("species")))


def species_metadata(graded: DataFrame, occurrences: DataFrame, universe: DataFrame) -> DataFrame:
    """Sixteen counts per species of a universe, also for species without records."""
    id_ = non_empty(F.col("compound_id"))
    distinct = lambda c: F.countDistinct(non_empty(F.col(c)))
    part, tissue = known(F.col("plant_part_group")), known(F.col("tissue_group"))
    counts = occurrences.groupBy("species").agg(
        F.count(F.lit(1)).alias("n_occurrences"), F.countDistinct(id_).alias("n_compounds"), F.countDistinct(F.when(truthy(F.col("comparable_for_matrix")), id_)).alias("n_comparable"),
        F.countDistinct(F.when(known(F.col("smiles")) | known(F.col("inchikey")), id_)).alias("n_with_structure"), distinct("source_database").alias("n_sources"), F.countDistinct(F.when(known(F.col("comparison_scope")), F.col("comparison_scope"))).alias("n_scopes"),
        F.countDistinct(F.when(known(F.col("comparison_group")), F.col("comparison_group"))).alias("n_groups"), F.count_if(part).alias("n_with_part"), F.count_if(tissue).alias("n_with_tissue"), F.count_if(known(F.col("method_group"))).alias("n_with_method"),
        F.count_if(part | tissue).alias("n_with_context"),
    )
    grades = graded.groupBy("species").agg(*[F.count_if(F.col("evidence_grade_rank") == r).alias(f"n_grade_{r}") for r in (1, 2, 3, 4, 5)])
    out = universe.select("species").distinct().join(counts, "species", "left").join(grades, "species", "left")
    numbers = [c for c in out.columns if c.startswith("n_")]
    return out.na.fill(0, numbers).withColumn("record_status", F.when(F.col("n_occurrences") > 0, "records_present").otherwise("no_records_in_membership"))


def dominant(rows: DataFrame, key: str, field: str) -> DataFrame:
    """Most frequent known value of a field per key; ties go to the alphabetically first."""
    counts = rows.filter(known(F.col(field))).groupBy(key, F.col(field).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("dominant_" + field))


def mode_or_mixed(rows: DataFrame, key: str, field: str) -> DataFrame:
    """Most frequent non-empty value per key, "mixed" on ties."""
    counts = rows.filter(non_empty(F.col(field)).isNotNull()).groupBy(key, non_empty(F.col(field)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(key)
    top = counts.withColumn("most", F.max("n").over(best)).filter("n = most")
    return top.groupBy(key).agg(F.when(F.count(F.lit(1)) > 1, "mixed").otherwise(F.max("v")).alias("mode_" + field))


def quality_tier(compounds: Column, fingerprinted: Column, records: Column) -> Column:
    share = F.when(compounds > 0, fingerprinted / compounds).otherwise(0.0)
    return (
        F.when(compounds < 1, "no_species_level_public_profile")
        .when((compounds >= 50) & (share >= 0.8) & (records >= 50), "robust_public_species_profile")
        .when((compounds >= 10) & (share >= 0.5), "moderate_public_species_profile")
        .otherwise("limited_public_species_profile")
    )


#: Methods that say only where a record comes from.
RECORD_METHODS = ("database_record", "literature_curation")


def species_summary(rows: DataFrame) -> DataFrame:
    """Thirty measures per species: compounds and structures, records, evidence, classes, sources, shares of known context, dominant values, quality tier."""
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    id_ = non_empty(F.col("compound_id"))
    many = lambda c: F.countDistinct(F.when(known(F.col(c)), F.col(c)))
    direct = F.coalesce(F.lower(squish(F.col("evidence_tier"))).contains("direct_species"), F.lit(False)) & ~F.coalesce(F.lower("evidence_tier").contains("candidate"), F.lit(False))
    method_known = known(F.col("method_group")) & ~F.lower("method_group").isin(*RECORD_METHODS)
    part, tissue = known(F.col("plant_part_group")), known(F.col("tissue_group"))
    structure = known(F.col("smiles")) | known(F.col("inchikey"))
    weight = F.when(confidence_rank(F.col("confidence")) == 3, 90).when(confidence_rank(F.col("confidence")) == 2, 65).when(confidence_rank(F.col("confidence")) == 1, 35)
    stats = rows.filter(non_empty(F.col("species")).isNotNull()).groupBy("species").agg(
        F.countDistinct(id_).alias("n_compounds"),
        F.countDistinct(F.when(known(F.col("smiles")), id_)).alias("n_with_structure"),
        F.countDistinct(F.when(known(F.col("inchikey")), F.col("inchikey"))).alias("n_inchikeys"),
        F.countDistinct("cid").alias("n_cids"),
        F.countDistinct(non_empty(F.col("compound_name_clean"))).alias("n_names"),
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct(non_empty(F.col("source_record_id"))).alias("n_source_records"),
        F.countDistinct(non_empty(F.col("citation_or_url"))).alias("n_citations"),
        F.countDistinct(non_empty(F.col("source_database"))).alias("n_sources"),
        F.countDistinct(F.when(truthy(F.col("comparable_for_matrix")), id_)).alias("n_comparable"),
        F.count_if(direct).alias("n_direct_records"),
        F.countDistinct(F.when(direct, id_)).alias("n_direct_compounds"),
        F.count_if(F.lower(squish(F.col("matched_rank"))) == "genus").alias("n_genus_records"),
        F.count_if(F.coalesce(F.lower("curation_flag").contains("review"), F.lit(False))).alias("n_review_records"),
        many("comparison_scope").alias("n_scopes"), many("comparison_group").alias("n_groups"), many("comparison_subgroup").alias("n_subgroups"), many("plant_part_group").alias("n_parts"), many("method_group").alias("n_methods"),
        F.round(F.sum(weight) / F.count(weight) / 100, 4).alias("mean_confidence"),
        share(structure).alias("structure_known"), share(part).alias("part_known"), share(tissue).alias("tissue_known"), share(F.coalesce(method_known, F.lit(False))).alias("method_known"), share(part | tissue).alias("context_known"),
    )
    out = stats
    for field in ("comparison_scope", "comparison_group", "plant_part_group", "source_database"):
        out = out.join(dominant(rows, "species", field), "species", "left")
    return out.withColumn("quality_tier", quality_tier(F.col("n_compounds"), F.col("n_with_structure"), F.col("n_records")))


def source_coverage(rows: DataFrame, query: str, source: str, sources: list[str]) -> DataFrame:
    """Per query and listed source: records and presence, zero where there are none.

    The grid of queries and sources is an explode of the fixed source list, not a join.
    """
    counts = rows.filter(F.col(query).isNotNull()).groupBy(F.col(query).alias("query"), F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.filter(F.col(query).isNotNull()).select(F.col(query).alias("query")).distinct().select("query", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    return grid.join(counts, ["query", "source"], "left").select("query", "source", F.coalesce("n", F.lit(0)).alias("n_records"), yes_no(F.col("n") > 0).alias("present"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    covered = F.countDistinct(F.when(F.col("n_records") > 0, F.col("query")))
    return coverage.groupBy("source").agg(covered.alias("n_covered"), F.countDistinct("query").alias("n_queries"), F.sum("n_records").alias("n_records"), F.round(covered / F.countDistinct("query"), 4).alias("coverage"))


def missing_species(species_list: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """Listed species without any record, compared by their words."""
    have = rows.select(key.alias("k")).distinct()
    return species_list.withColumn("k", key).join(have, "k", "left_anti").drop("k")


def enrich_membership(rows: DataFrame, resolved: DataFrame, fields: list[str]) -> DataFrame:
    """Blank fields of rows filled from a lookup by compound id; the lookup is reduced to one row per id first."""
    dim = resolved.filter("compound_id is not null").groupBy("compound_id").agg(*[F.max(non_empty(F.col(f).cast("string"))).alias("r_" + f) for f in fields])
    out = rows.join(dim, "compound_id", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(non_empty(F.col(f).cast("string")), "r_" + f))
    return out.drop(*["r_" + f for f in fields])


def grade_sources(graded: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Per species, the sources of its direct evidence."""
    direct = filter_direct(graded, require_structure=False).select("occurrence_id")
    return occurrences.join(direct, "occurrence_id", "left_semi").groupBy("species").agg(collapse_sorted(F.upper(F.trim("source_database"))).alias("sources"), F.count(F.lit(1)).alias("n_records"))
