"""Plant-chemistry intake: context classifiers, comparability, filters, matrices by level, preparation of similarity input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions.rules import best_confidence, confidence_rank, ordered
from florilege.functions.text import collapse_sorted, feature_key, known, label, non_empty, spell_greek, squish, truthy, words_key, yes_no

#: Plant parts by the first pattern found.
PART_RULES = (
    ("exudate|rhizosphere", "exudate_rhizosphere"), ("root|rhizome|tuber|bulb", "root_belowground"), ("leaf|leaves|foliar|foliage|needle", "leaf"), ("whole[ _]plant|seedling|callus", "whole_plant"),
    ("stem|shoot|twig|branch", "stem_shoot"), ("bark|wood", "bark_wood"), ("flower|petal|pollen|inflorescence", "flower"), ("fruit|seed|peel|berry", "fruit_seed"), ("aerial", "aerial"),
    ("vascular|xylem|phloem", "vascular"), ("secretory|gland|trichome|resin", "secretory"), ("epiderm|cuticle", "epidermal"), ("endophyt|microb", "microbial"), ("essential oil|extract", "extract_unspecified"),
)
#: Analytical methods by the first pattern found.
METHOD_RULES = (
    (r"gc[-_ ]?ms|gas chromatography[- ]mass", "gc_ms"), (r"lc[-_ ]?ms|liquid chromatography[- ]mass", "lc_ms"), ("hplc|uplc|uhplc", "hplc"), (r"\bnmr\b|nuclear magnetic", "nmr"), ("mass spectrom", "mass_spectrometry"),
    ("chromatograph|tlc|gc-fid", "chromatography"), ("spectroscop|infrared|raman", "spectroscopy"), ("literature", "literature_curation"), ("record|database|provider", "database_record"),
)
#: Families of compounds by class text or name, in order of priority of the first pattern found.
FAMILY_RULES = (
    ("carbohydrate|sugar|glucose|fructose|sucrose|polyol", "carbohydrate"), ("fatty.?acid|lipid|linole|sterol", "fatty_acid_lipid"), ("amino.?acid", "amino_acid"), ("hormone|abscisic|auxin|gibberell|jasmon", "plant_hormone_signal"),
    ("flavon", "flavonoid"), ("phenol|phenylprop|lignan|salic|coumar", "phenolic_phenylpropanoid"), ("glucosinolate", "glucosinolate"), ("saponin", "saponin"), ("terpen|limonene|pinene", "terpenoid"),
    ("alkaloid|caffeine|purine|tropane", "alkaloid_nitrogenous"), ("allii|organosulfur|thiol", "organosulfur"), ("polyketide", "polyketide"), ("organic.?acid", "organic_acid"), ("green.?leaf|volatile|aldehyde|ester", "volatile"),
)
PRIMARY = ("carbohydrate", "amino_acid", "organic_acid", "nucleoside_nucleotide")
SPECIALIZED = ("terpenoid", "phenolic_phenylpropanoid", "flavonoid", "alkaloid_nitrogenous", "organosulfur", "glucosinolate", "benzoxazinoid", "cyanogenic_glycoside", "saponin", "steroid_triterpenoid", "polyketide")
#: Weights of the candidate score.
SCORE_WEIGHTS = {"direct_species": 0.25, "resolved_compounds": 0.2, "source_coverage": 0.2, "literature": 0.15, "traits": 0.2}


def plant_part(text: Column, supplied: Column | None = None) -> Column:
    """The part that a text names; a supplied value wins; null and blank are unknown, all else other."""
    by_text = F.when(non_empty(text).isNull(), "unknown").otherwise(ordered(text, PART_RULES, F.lit("other")))
    return by_text if supplied is None else F.coalesce(F.when(known(supplied), squish(supplied)), by_text)


def method(text: Column, supplied: Column | None = None) -> Column:
    by_text = F.when(non_empty(text).isNull(), "unknown").otherwise(ordered(text, METHOD_RULES, F.lit("other")))
    return by_text if supplied is None else F.coalesce(F.when(known(supplied), squish(supplied)), by_text)


def clean_compound(name: Column) -> Column:
    """Key of a compound name that keeps Greek letters and signs of rotation: alpha_carotene, plus_limonene."""
    s = spell_greek(F.lower(squish(name)))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\(\+\)", "plus "), r"^\(-\)", "minus "), r"[^a-z0-9]+", "_")
    return F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit(""))


def comparability(subgroup: Column, group: Column, name: Column, is_volatile: Column) -> tuple[Column, Column, Column]:
    """(scope, group, comparable): the family by the source's classes first, then by the name; unknown ones are not comparable."""
    family = F.coalesce(ordered(subgroup, FAMILY_RULES), ordered(group, FAMILY_RULES), ordered(name, FAMILY_RULES))
    special = family.isin(*SPECIALIZED)
    vol = F.coalesce(is_volatile, F.lit(False))
    scope = (
        F.when(family.isin(*PRIMARY), "primary_metabolites")
        .when(family == "fatty_acid_lipid", "lipids_fatty_acids")
        .when(family == "plant_hormone_signal", "plant_hormone_signaling")
        .when((special & vol) | (family == "volatile"), "volatile_specialized_metabolites")
        .when(special, "specialized_metabolites")
        .otherwise("unknown")
    )
    out_group = F.when(scope == "unknown", "unknown").when(special & vol, F.concat(F.lit("volatile_"), family)).otherwise(family)
    return scope, out_group, yes_no(scope != "unknown")


def comparison_dictionary(spark: SparkSession) -> DataFrame:
    """Allowed combinations of scope, group, family, domain and behaviour."""
    rows = [("primary_metabolites", f, f, "primary_metabolism", "nonvolatile_or_unspecified", "Yes") for f in PRIMARY]
    rows += [("specialized_metabolites", f, f, "specialized_metabolism", "nonvolatile_or_unspecified", "Yes") for f in SPECIALIZED]
    rows += [("volatile_specialized_metabolites", "volatile_" + f, f, "specialized_metabolism", "volatile_semivolatile", "Yes") for f in SPECIALIZED]
    rows += [("lipids_fatty_acids", "fatty_acid_lipid", "fatty_acid_lipid", "lipid_metabolism", "nonvolatile_or_unspecified", "Yes"), ("plant_hormone_signaling", "plant_hormone_signal", "plant_hormone_signal", "plant_hormone_signaling", "nonvolatile_or_unspecified", "Yes")]
    rows += [("broad_or_uncertain", "broad_or_uncertain", "broad_or_uncertain", "broad_or_uncertain", "nonvolatile_or_unspecified", "No"), ("xenobiotic_or_contaminant", "unknown", "unknown", "xenobiotic_or_contaminant", "unknown", "No"), ("unknown", "unknown", "unknown", "unknown", "unknown", "No")]
    return spark.createDataFrame(rows, "comparison_scope string, comparison_group string, biosynthetic_family string, metabolism_domain string, chemical_behavior string, comparable_for_matrix string")


def standardize_intake(rows: DataFrame) -> DataFrame:
    """Curated rows as occurrences; duplicates of one evidence key become one row with their contexts merged.

    Key: species words, clean compound, source, record. ``rows``: species, compound_name,
    source_database, source_record_id, evidence_tier, plant_part, method.
    """
    tier = label(F.col("evidence_tier"))
    curated = F.coalesce(tier.rlike("manual|curated"), F.lit(False))
    keyed = rows.withColumn("species_key", words_key(F.col("species"))).withColumn("compound_key", clean_compound(F.col("compound_name"))).withColumn("source", F.upper(squish(F.col("source_database"))))
    part, how = plant_part(F.col("plant_part")), method(F.col("method"))
    out = keyed.groupBy("species_key", "compound_key", "source", "source_record_id").agg(
        F.count(F.lit(1)).alias("n_rows"), collapse_sorted(F.when(part != "unknown", part)).alias("plant_parts"), collapse_sorted(F.when(how != "unknown", how)).alias("methods"), F.bool_or(curated).alias("curated"),
        F.bool_or(F.coalesce(tier.contains("direct"), F.lit(False))).alias("direct"), F.bool_or(F.coalesce(tier.contains("candidate"), F.lit(False))).alias("candidate"), best_confidence(F.col("confidence")).alias("confidence"),
    )
    status = F.when(F.col("curated"), "curated_reported").when(F.col("direct") & ~F.col("candidate"), "direct_reported").when(F.col("candidate"), "candidate").otherwise("taxon_fallback")
    out = out.withColumn("occurrence_status", status).withColumn("analysis_ready", yes_no(status.isin("curated_reported", "direct_reported") & (F.col("species_key") != "") & F.col("compound_key").isNotNull()))
    score = 0.4 * status.isin("curated_reported", "direct_reported").cast("int") + 0.2 * F.col("plant_parts").isNotNull().cast("int") + 0.2 * F.col("methods").isNotNull().cast("int") + 0.2 * (confidence_rank(F.coalesce("confidence", F.lit(""))) >= 2).cast("int")
    return out.withColumn("quality_score", F.round(score, 2)).drop("curated", "direct", "candidate")


def filter_evidence(occurrences: DataFrame, statuses: tuple[str, ...] = ("direct_reported", "curated_reported"), ready: bool = True, min_confidence: str = "low") -> DataFrame:
    least = {"low": 1, "medium": 2, "high": 3}.get(min_confidence, 0)
    keep = F.col("occurrence_status").isin(*statuses) & (confidence_rank(F.col("confidence")) >= least)
    return occurrences.filter(keep & (F.col("analysis_ready") == "Yes") if ready else keep)


def text_context(documents: DataFrame, row_id: str, text: str, species: str) -> DataFrame:
    """(row_id, sentence_no, kind, value) of plant parts and methods in sentences that name the species.

    A sentence ends with . ! or ? before white space; the species must stand in it as typed (case ignored).
    """
    sentences = documents.filter(F.col(text).isNotNull() & non_empty(F.col(species)).isNotNull()).select(row_id, F.lower(squish(F.col(species))).alias("__fl_species"), F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+")).alias("sentence_no", "sentence"))
    named = sentences.filter(F.contains(F.lower("sentence"), F.col("__fl_species")))
    kinds = F.explode(F.array(F.struct(F.lit("plant_part").alias("kind"), ordered(F.col("sentence"), PART_RULES).alias("value")), F.struct(F.lit("method").alias("kind"), ordered(F.col("sentence"), METHOD_RULES).alias("value"))))
    return named.select(row_id, "sentence_no", kinds.alias("k")).select(row_id, "sentence_no", "k.*").filter("value is not null")


CONTEXT_FIELDS = ("plant_part", "tissue", "method")


def merge_context(evidence: DataFrame) -> DataFrame:
    """Context evidence of one key and value as one row: best confidence, review only if all say so, texts and rules collapsed.

    ``evidence``: species, compound, record, kind (plant_part, tissue or method), value, confidence, review (Yes or No), text, rule. Few texts state
    one value of one record.
    """
    key = ["species_key", "compound_key", "record", "kind", "value"]
    rows = evidence.withColumn("species_key", words_key(F.col("species"))).withColumn("compound_key", clean_compound(F.col("compound"))).withColumn("record", non_empty(F.col("record"))).filter(known(F.col("value")))
    return rows.groupBy(*key).agg(
        best_confidence(F.col("confidence")).alias("confidence"), F.when(F.bool_and(F.lower("review") == "yes"), "Yes").otherwise("No").alias("review"), collapse_sorted(F.col("text")).alias("texts"), collapse_sorted(F.col("rule")).alias("rules"), F.count(F.lit(1)).alias("n_rows")
    )


def apply_context(rows: DataFrame, context: DataFrame) -> DataFrame:
    """Occurrence rows with unknown plant_part, tissue and method filled from merged context.

    Evidence of the row's own record beats evidence of its species and compound; among those the best
    confidence wins, then the smallest value. Known values are never overwritten. ``rows``: occurrence_id, species, compound,
    record and the three fields.
    """
    rank = F.struct(-confidence_rank(F.coalesce("confidence", F.lit(""))), F.col("value"))
    pick = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, rank))
    usable = context.filter("review = 'No'")
    exact = usable.filter("record is not null").groupBy("species_key", "compound_key", F.col("record").alias("__fl_record")).agg(*[pick(k).alias("e_" + k) for k in CONTEXT_FIELDS])
    loose = usable.groupBy("species_key", "compound_key").agg(*[pick(k).alias("l_" + k) for k in CONTEXT_FIELDS])
    keyed = rows.withColumns({"species_key": words_key(F.col("species")), "compound_key": clean_compound(F.col("compound")), "__fl_record": non_empty(F.col("record"))})
    out = keyed.join(exact, ["species_key", "compound_key", "__fl_record"], "left").join(loose, ["species_key", "compound_key"], "left")
    filled = [F.when(known(F.col(k)), F.col(k)).otherwise(F.coalesce("e_" + k, "l_" + k, F.col(k))).alias(k) for k in CONTEXT_FIELDS]
    return out.select("occurrence_id", *filled)


def context_audit(rows: DataFrame, provider: str) -> DataFrame:
    """Per provider: rows and how many have plant part, tissue and method."""
    return rows.groupBy(F.upper(F.trim(provider)).alias("provider")).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(known(F.col(c))).alias("n_" + c) for c in ("plant_part_group", "tissue_group", "method_group")])


def level_features(rows: DataFrame, level: str, features: list[str], mode: str = "count") -> DataFrame:
    """(level value, feature, value) over several feature columns at once: distinct compounds, presence or best confidence."""
    pairs = F.explode(F.array(*[F.when(known(F.col(f)), feature_key(f, F.col(f))) for f in features])).alias("feature")
    usable = rows.filter(known(F.col(level)) & non_empty(F.col("compound_id")).isNotNull()).select(F.col(level), "compound_id", confidence_rank(F.col("confidence")).alias("c"), pairs).filter("feature is not null")
    value = {"count": F.countDistinct("compound_id").cast("double"), "binary": F.lit(1.0), "confidence": F.round(F.max(F.when(F.col("c") == 3, 0.9).when(F.col("c") == 2, 0.65).when(F.col("c") == 1, 0.35).otherwise(0.0)), 2)}[mode]
    return usable.groupBy(level, "feature").agg((F.max(value) if mode == "binary" else value).alias("value"))


def comparable_features(rows: DataFrame, level: str, scope: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """(level value, feature, value): distinct compounds per comparison group of one scope, for some plant parts only if given."""
    keep = truthy(F.col("comparable_for_matrix")) & (F.col("comparison_scope") == scope) & known(F.col("comparison_group")) & known(F.col(level))
    usable = rows.filter(keep & F.col("plant_part_group").isin(*parts) if parts else keep)
    feature = F.concat_ws("__", F.lit("comparison_group"), F.lit(scope), F.lower(F.regexp_replace("comparison_group", "[^A-Za-z0-9]+", "_")))
    return usable.groupBy(level, feature.alias("feature")).agg(F.countDistinct("compound_id").cast("double").alias("value"))


def prepare_similarity_input(rows: DataFrame, level: str, statuses: tuple[str, ...], min_confidence: str = "medium") -> DataFrame:
    """Each row with its structure id (InChIKey, else CID), whether it may enter similarity, and all reasons why not."""
    key = F.upper(F.trim("inchikey"))
    valid = F.coalesce(key.rlike("^[A-Z]{14}-[A-Z]{10}-[A-Z]$"), F.lit(False))
    structure = F.when(valid, F.regexp_replace(key, "[^A-Za-z0-9]+", "_")).when(F.col("cid") > 0, F.concat(F.lit("cid_"), F.col("cid").cast("string")))
    least = {"low": 1, "medium": 2, "high": 3}.get(min_confidence, 0)
    reasons = F.concat_ws(
        "; ",
        F.when(~F.coalesce(F.lower(squish(F.col("occurrence_status"))).isin(*statuses), F.lit(False)), F.lit("occurrence_status_not_allowed")),
        F.when(confidence_rank(F.coalesce("confidence", F.lit(""))) < least, F.lit("below_minimum_confidence")),
        F.when(non_empty(F.col(level)).isNull(), F.lit("missing_group_value")),
        F.when(structure.isNull(), F.lit("missing_valid_inchikey_or_cid")),
        F.when(F.coalesce(F.lower("curation_flag").contains("review"), F.lit(False)), F.lit("identity_review_required")),
    )
    return rows.select("occurrence_id", level, structure.alias("structure_id"), (reasons == "").alias("eligible"), F.when(reasons != "", reasons).alias("exclusion_reason"))


def candidate_scores(summary: DataFrame) -> DataFrame:
    """Weighted score of species from shares in 0..1 named as SCORE_WEIGHTS; missing shares count 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    return summary.withColumn("score", F.round(total, 4))


def join_metadata(metadata: DataFrame, rows: DataFrame, level: str) -> DataFrame:
    """Metadata with the records' counts at a level; every metadata row stays."""
    counts = rows.filter(non_empty(F.col(level)).isNotNull()).groupBy(words_key(F.col(level)).alias("__fl_key")).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(non_empty(F.col("compound_id"))).alias("n_compounds"))
    return metadata.withColumn("__fl_key", words_key(F.col(level))).join(counts, "__fl_key", "left").drop("__fl_key").na.fill(0, ["n_records", "n_compounds"])


#: Least shares of the quality report.
QA_MINIMA = {"species_with_records": 0.5, "analysis_ready": 0.25, "context": 0.25, "resolved": 0.5}


def qa_report(species_list: DataFrame, rows: DataFrame) -> DataFrame:
    """(check, value, least, status): listed species with records, ready, with context, and rows with a structure."""
    key = words_key(F.col("species"))
    usable = rows.withColumn("__fl_key", key)
    ready = known(F.col("compound_id")) & (F.lower("matched_rank") == "species")
    per = usable.groupBy("__fl_key").agg(F.bool_or(F.coalesce(ready, F.lit(False))).alias("ready"), F.bool_or(known(F.col("plant_part_group"))).alias("ctx"))
    met = species_list.select(key.alias("__fl_key")).distinct().join(per, "__fl_key", "left")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 4)
    a = met.agg(share(F.col("ready").isNotNull()).alias("species_with_records"), share(F.col("ready")).alias("analysis_ready"), share(F.col("ctx")).alias("context"))
    b = rows.agg(share(known(F.col("inchikey")) | known(F.col("cid"))).alias("resolved"))
    parts = [a.select(F.lit(n).alias("check"), F.col(n).alias("value"), F.lit(QA_MINIMA[n]).alias("least")) for n in ("species_with_records", "analysis_ready", "context")]
    parts.append(b.select(F.lit("resolved").alias("check"), F.col("resolved").alias("value"), F.lit(QA_MINIMA["resolved"]).alias("least")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("status", F.when(F.col("value") >= F.col("least"), "pass").otherwise("warn"))


def explode_taxa(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per taxon of a field such as "Salix nigra | Salix alba"; blanks give none."""
    return df.withColumn(name, F.explode(F.split(F.coalesce(F.col(column), F.lit("")), r"[|;]"))).withColumn(name, non_empty(F.col(name))).filter(F.col(name).isNotNull())
