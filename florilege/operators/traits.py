"""Traits: typed, keyed, deduplicated facts about compounds; matrices, ontology, evidence, summaries, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.rules import best_confidence, clean_label, confidence_threshold, hazard_group, hold, number, ordered
from florilege.functions.text import collapse_sorted, key_value, non_empty, squish
from florilege.operators.exact import exact_percentiles
from florilege.operators.skew import hot_threshold, split_join
from florilege.session import stage

TRAIT_KEY = ["query", "cid", "trait_type", "trait_group", "trait_value_clean"]
#: Sources that raise a trait's confidence score.
TRUSTED_SOURCES = ("PubChem", "PubChem BioAssay", "KEGG", "LOTUS", "FEMA", "FDA/SPL", "MeSH")
#: Source names by the first pattern found.
SOURCE_RULES = (
    ("KEGG", "KEGG"), ("LOTUS|natural products", "LOTUS"), ("FEMA|Flavor and Extract", "FEMA"), ("FDA|SPL", "FDA/SPL"), ("MeSH|Medical Subject", "MeSH"), ("BioAssay", "PubChem BioAssay"),
    ("PubChem|ChemicalHazards|ChemicalMeasurements|reactives", "PubChem"),
)
#: The term dictionary as pattern, term, group; the first pattern found wins.
TERMS = (
    ("citrus|lemon|orange|lime", "citrus", "citrus"), ("sweet|honey|sugary", "sweet", "sweet"), ("floral|rose|jasmine", "floral", "floral"), ("green|fresh|leafy|grassy", "green/fresh", "green/fresh"),
    ("herbal|mint|menthol", "herbal/mint", "herbal/mint"), ("pine|woody|wood", "woody/pine", "woody/pine"), ("earthy|soil|mushroom", "earthy", "earthy"), ("fruity|berry|apple|banana", "fruity", "fruity"),
    ("fatty|waxy|oily", "fatty/waxy", "fatty/waxy"), ("spicy|pepper|clove", "spicy", "spicy"), ("smoky|smoke|burnt", "smoky", "smoky"), ("nutty|almond", "nutty", "nutty"),
    ("vanilla|vanillin", "vanilla", "vanilla"), ("phenolic|phenol", "phenolic", "phenolic"), ("sulfur|sulphur|sulfurous|alliaceous|garlic|onion", "sulfurous", "sulfurous"), ("camphor", "camphor", "camphoraceous"),
    ("alkaloid", "alkaloid", "alkaloid"), ("monoterpene", "monoterpene", "terpenoid"), ("sesquiterpene", "sesquiterpene", "terpenoid"), ("diterpene", "diterpene", "terpenoid"),
    ("triterpene", "triterpene", "terpenoid"), ("terpenoid|terpene", "terpenoid", "terpenoid"), ("flavonoid", "flavonoid", "phenolic"), ("phenylpropanoid", "phenylpropanoid", "phenylpropanoid"),
    ("polyketide", "polyketide", "polyketide"), ("peptide", "peptide", "peptide"), ("lipid|fatty acid", "lipid", "lipid"), ("steroid", "steroid", "steroid"), ("saponin", "saponin", "saponin"),
    ("coumarin", "coumarin", "coumarin"), ("lignan", "lignan", "lignan"), ("tannin", "tannin", "tannin"), ("anti[- ]?inflammatory|non[- ]?steroidal", "anti-inflammatory", "anti-inflammatory"),
    ("cyclooxygenase|cox", "cyclooxygenase inhibitor", "enzyme inhibitor"), ("analgesic|pain", "analgesic", "analgesic"), ("antipyretic|fever", "antipyretic", "antipyretic"),
    ("antimicrobial|antibacterial|antifungal", "antimicrobial", "antimicrobial"), ("antioxidant", "antioxidant", "antioxidant"), ("inhibitor", "inhibitor", "bioactivity"), ("agonist", "agonist", "bioactivity"),
    ("antagonist", "antagonist", "bioactivity"), ("oral|by mouth|per os", "oral", "enteral route"), (r"intravenous|\biv\b|i\.v\.", "intravenous", "parenteral route"),
    ("topical|dermal|cutaneous", "topical", "topical route"), ("inhalation|inhaled", "inhalation", "respiratory route"), ("subcutaneous", "subcutaneous", "parenteral route"),
    ("intramuscular", "intramuscular", "parenteral route"), ("tablet", "tablet", "solid dosage form"), ("capsule", "capsule", "solid dosage form"), ("solution", "solution", "liquid dosage form"),
    ("suspension", "suspension", "liquid dosage form"), ("injection", "injection", "parenteral dosage form"), ("cream|ointment|gel", "semisolid topical", "topical dosage form"),
    ("patch|transdermal", "transdermal patch", "transdermal dosage form"), ("flammable|combustible", "flammable", "physical hazard"), ("irritat|eye damage|eye irritation", "irritant", "health hazard"),
    ("corrosive|corrosion", "corrosive", "health hazard"), ("toxic|toxicity|fatal|harmful", "toxic", "health hazard"), ("carcinogen|carcinogenic", "carcinogen", "health hazard"),
    ("aquatic|environmental", "aquatic toxicity", "environmental hazard"),
)
#: Ontology domain and group of "type:group" keys of traits.
ONTOLOGY = {
    "property:molecular_size_bin": ("physicochemical", "molecular_size"), "property:xlogp_bin": ("physicochemical", "lipophilicity"), "property:tpsa_bin": ("physicochemical", "polarity"),
    "property:rotatable_bond_bin": ("physicochemical", "flexibility"), "property:hbond_donor_bin": ("physicochemical", "hbond_donor_capacity"), "property:hbond_acceptor_bin": ("physicochemical", "hbond_acceptor_capacity"),
    "hazard:hazard_code": ("safety", "ghs_hazard_code"), "hazard:hazard_category": ("safety", "hazard_category"), "hazard:hazard_group": ("safety", "hazard_endpoint"), "hazard:signal_word": ("safety", "signal_word"),
    "hazard:exposure_route": ("exposure", "exposure_route"), "hazard:target_organ": ("safety", "affected_organ"), "hazard:toxicity_metric": ("safety", "toxicity_metric"), "hazard:toxicity_species": ("safety", "toxicity_species"),
    "use:descriptor": ("sensory", "sensory_descriptor"), "use:flavor": ("sensory", "flavor"), "use:odor": ("sensory", "odor"), "use:pharmacologic_class": ("biomedical", "pharmacologic_class"),
    "use:administration_route": ("biomedical", "administration_route"), "use:dosage_form": ("biomedical", "dosage_form"), "use:warning": ("safety", "label_warning"), "use:use_group": ("use", "use_group"),
    "chemical_class:reactive_group": ("reactivity", "reactive_group"), "chemical_class:natural_product_superclass": ("ecology", "natural_product_superclass"),
    "chemical_class:natural_product_class": ("ecology", "natural_product_class"), "chemical_class:natural_product_subclass": ("ecology", "natural_product_subclass"),
    "chemical_class:pathway_group": ("metabolism", "pathway_group"), "chemical_class:enzyme_class": ("metabolism", "enzyme_class"), "chemical_class:mesh_tree_category": ("biomedical", "mesh_tree_category"),
    "bioactivity:activity_class": ("bioactivity", "assay_outcome"), "bioactivity:activity_direction": ("bioactivity", "activity_direction"), "bioactivity:bioactivity_domain": ("bioactivity", "assay_domain"),
    "target:target_name": ("bioactivity", "target_name"), "target:target_type": ("bioactivity", "target_type"), "target:target_organism": ("bioactivity", "target_organism"),
    "potency:potency_metric": ("bioactivity", "potency_metric"), "potency:potency_bucket": ("bioactivity", "potency_bucket"), "pathway:pathway_group": ("metabolism", "pathway_group"),
    "pathway:pathway_name": ("metabolism", "pathway_name"), "pathway:enzyme_class": ("metabolism", "enzyme_class"), "pathway:ec_number": ("metabolism", "ec_number"), "pathway:role_type": ("metabolism", "pathway_role"),
    "reaction:participant_role": ("metabolism", "reaction_participant_role"), "reaction:participant_side": ("metabolism", "reaction_participant_side"), "reaction:participant_id": ("metabolism", "reaction_participant_id"),
}
#: Ranks that taxonomy and occurrence traits carry.
TAXONOMY_RANKS = ("domain", "kingdom", "phylum", "class", "order", "family", "genus", "species", "organism", "common_name", "taxonomy_group", "natural_product_class")
OCCURRENCE_RANKS = ("kingdom", "family", "genus", "species", "organism", "natural_product_class")
#: What each matrix profile takes: trait types, then single keys.
PROFILES = {
    "bioactivity": (("bioactivity", "target", "potency"), ()),
    "safety": (("hazard",), ("use:warning", "use:administration_route", "property:xlogp_bin", "property:tpsa_bin")),
    "ecology": (("taxonomy", "occurrence"), ("chemical_class:natural_product_superclass", "chemical_class:natural_product_class", "chemical_class:natural_product_subclass")),
    "kegg": (("pathway", "reaction"), ("chemical_class:pathway_group", "chemical_class:enzyme_class")),
    "sensory": ((), ("use:descriptor", "use:flavor", "use:odor", "use:regulatory_status", "use:use_group")),
    "biomedical": (("bioactivity", "target", "potency"), ("use:active_ingredient", "use:pharmacologic_class", "use:pharmacologic_action", "use:administration_route", "use:dosage_form", "use:use_group", "chemical_class:mesh_tree_category", "property:molecular_size_bin", "property:xlogp_bin", "property:tpsa_bin")),
    "core": ((), (
        "property:molecular_size_bin", "property:xlogp_bin", "property:tpsa_bin", "property:rotatable_bond_bin", "property:hbond_donor_bin", "property:hbond_acceptor_bin",
        "hazard:hazard_code", "hazard:hazard_category", "hazard:hazard_group", "hazard:signal_word", "hazard:exposure_route", "hazard:target_organ", "hazard:toxicity_metric", "hazard:toxicity_species",
        "use:descriptor", "use:flavor", "use:odor", "use:regulatory_status", "use:pharmacologic_class", "use:pharmacologic_action", "use:administration_route", "use:dosage_form", "use:warning", "use:use_group",
        "chemical_class:reactive_group", "chemical_class:natural_product_superclass", "chemical_class:natural_product_class", "chemical_class:natural_product_subclass", "chemical_class:pathway_group", "chemical_class:enzyme_class", "chemical_class:mesh_tree_category",
        "taxonomy:kingdom", "taxonomy:family", "taxonomy:taxonomy_group", "taxonomy:natural_product_class", "occurrence:occurrence_type", "occurrence:kingdom", "occurrence:family", "occurrence:natural_product_class",
        "pathway:pathway_group", "pathway:enzyme_class", "pathway:role_type", "reaction:participant_role", "reaction:participant_side",
        "bioactivity:activity_class", "bioactivity:activity_direction", "bioactivity:bioactivity_domain", "bioactivity:endpoint_metric", "target:target_type", "target:target_organism", "target:target_group", "target:endpoint_metric",
        "potency:potency_metric", "potency:potency_bucket",
    )),
}


#: Rules that come before the term dictionary.
SPECIAL_TERMS = (("anti[- ]?inflammatory|non[- ]?steroidal", "anti-inflammatory", "anti-inflammatory"), (r"cyclooxygenase|\bcox\b", "cyclooxygenase inhibitor", "enzyme inhibitor"))


def term_lookup(term: Column) -> tuple[Column, Column, Column]:
    """(term, group, confidence) of a free term: hazard codes with their hazard group, two special rules, the dictionary, else its clean label."""
    rules = (*SPECIAL_TERMS, *TERMS)
    term = squish(term)
    label_ = clean_label(term)
    is_code = term.rlike("(?i)^H[0-9]{3}[A-Za-z]?$")
    by_dictionary = ordered(term, [(p, t) for p, t, _ in rules])
    clean = F.when(is_code, F.lower(term)).otherwise(F.coalesce(by_dictionary, label_))
    code_group = F.coalesce(hazard_group(F.upper(term), F.upper(term)), F.lit("hazard_code"))
    group = F.when(is_code, code_group).otherwise(F.coalesce(ordered(term, [(p, g) for p, _, g in rules]), label_))
    confidence = F.when(non_empty(term).isNull(), "low").when(is_code | by_dictionary.isNotNull(), "high").otherwise("medium")
    return F.when(non_empty(term).isNotNull(), clean), F.when(non_empty(term).isNotNull(), group), confidence


def key_piece(c: Column) -> Column:
    piece = F.regexp_replace(F.regexp_replace(clean_label(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(non_empty(c).isNotNull(), F.when(piece == "", "unknown").otherwise(piece))


def matrix_key(*cs: Column) -> Column:
    return F.concat_ws("__", *[F.coalesce(key_piece(c), F.lit("NA")) for c in cs])


def confidence_score(confidence: Column, source: Column, evidence_id: Column, rule: Column) -> Column:
    word = F.lower(F.coalesce(non_empty(confidence), F.lit("medium")))
    base = F.when(word == "high", 0.90).when(word == "medium", 0.65).when(word == "low", 0.35).otherwise(0.50)
    known_rule = F.coalesce(F.lower(rule).rlike("id|kegg|pubchem|lotus|mesh|ghs|assay|equation|property"), F.lit(False))
    extra = F.when(F.coalesce(source.isin(*TRUSTED_SOURCES), F.lit(False)), 0.03).otherwise(0.0) + F.when(non_empty(evidence_id).isNotNull(), 0.05).otherwise(0.0) + F.when(known_rule, 0.02).otherwise(0.0)
    return F.round(F.least(base + extra, F.lit(1.0)), 2)


def source_database(source_table: Column, source: Column) -> Column:
    return ordered(F.concat_ws(" ", non_empty(source_table), non_empty(source)), SOURCE_RULES, F.coalesce(non_empty(source), non_empty(source_table), F.lit("unknown")))


def is_descriptive(value: Column) -> Column:
    """Whether a squished value is a sentence rather than a label; such values take no place in matrices."""
    v = value
    words = F.length(v) - F.length(F.replace(v, F.lit(" "), F.lit(""))) + 1
    return F.when(F.length(v) <= 12, v == "").otherwise(_is_sentence(v, words))  # seven words do not fit in twelve letters


def _is_sentence(v: Column, words: Column) -> Column:
    # The lengths, numbers of words and patterns that mark a sentence.
    return (
        F.coalesce(v == "", F.lit(True))
        | (F.length(v) > 140)
        | ((words > 6) & v.rlike(r"\.$"))
        | ((words > 7) & v.rlike(r"(?i)^drugs?\s+that|^compounds?\s+or\s+agents|agents?\s+that|used\s+to|\bconvert\b"))
        | ((words > 14) & v.rlike(r"(?i)\b(that|which|their|they|during|following|addition|accounts|used to|acts? by|leading to)\b"))
        | ((F.length(v) > 90) & v.rlike("[.;]"))
    )


#: Numeric properties -> group and bins as (upper limit, included, name).
_INF = float("inf")
PROPERTY_BINS = {
    "xlogp_bin": (("xlogp", "logp"), ((0, False, "hydrophilic_XLogP_lt_0"), (3, True, "balanced_XLogP_0_3"), (5, True, "lipophilic_XLogP_3_5"), (_INF, True, "high_XLogP_gt_5"))),
    "tpsa_bin": (("tpsa", "topological_polar_surface_area"), ((40, False, "low_TPSA_lt_40"), (90, True, "moderate_TPSA_40_90"), (_INF, True, "high_TPSA_gt_90"))),
    "molecular_size_bin": (("molecularweight", "molecular_weight", "exactmass", "exact_mass", "monoisotopicmass", "monoisotopic_mass"), ((200, False, "small_molecule_lt_200_Da"), (500, True, "drug_like_size_200_500_Da"), (_INF, True, "large_molecule_gt_500_Da"))),
    "rotatable_bond_bin": (("rotatablebondcount",), ((3, True, "low_rotatable_bonds_0_3"), (10, True, "moderate_rotatable_bonds_4_10"), (_INF, True, "high_rotatable_bonds_gt_10"))),
    "hbond_donor_bin": (("hbonddonorcount",), ((0, True, "no_hbond_donors"), (2, True, "low_hbond_donors_1_2"), (_INF, True, "high_hbond_donors_gt_2"))),
    "hbond_acceptor_bin": (("hbondacceptorcount",), ((4, True, "low_hbond_acceptors_0_4"), (10, True, "moderate_hbond_acceptors_5_10"), (_INF, True, "high_hbond_acceptors_gt_10"))),
}


def property_trait(prop: Column, value: Column) -> tuple[Column, Column]:
    """(trait group, trait value) of a numeric property; null for other properties and missing values."""
    piece = key_piece(prop)
    group, trait = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (properties, bins) in PROPERTY_BINS.items():
        bin_name = F.lit(None).cast("string")
        for limit, included, text in reversed(bins):
            bin_name = F.when((value <= limit) if included else (value < limit), text).otherwise(bin_name)
        mine = piece.isin(*properties) & value.isNotNull()
        group, trait = F.when(mine, name).otherwise(group), F.when(mine, bin_name).otherwise(trait)
    return group, trait


def build_traits(rows: DataFrame) -> DataFrame:
    """Complete trait rows from query, cid, trait_type, trait_group, trait_value, source, confidence, evidence_id, extraction_rule.

    The rules run in steps that each compute their columns once: one large expression would become a
    method too long for the JVM to compile.
    """
    step = hold(rows, __fl_value=squish(F.col("trait_value")), __fl_source=non_empty(F.col("source")))
    step = hold(step, __fl_clean=clean_label(F.col("__fl_value")), source_database=ordered(F.col("__fl_source"), SOURCE_RULES, F.coalesce("__fl_source", F.lit("unknown"))))
    step = step.filter("__fl_clean <> ''")
    step = hold(step, confidence_score=confidence_score(F.col("confidence"), F.col("source_database"), F.col("evidence_id"), F.col("extraction_rule")))
    never = F.coalesce(F.col("never_eligible"), F.lit(False)) if "never_eligible" in rows.columns else F.lit(False)
    step = hold(step, matrix_eligible=~is_descriptive(F.col("__fl_value")) & ~never)
    return step.withColumnRenamed("__fl_clean", "trait_value_clean").drop("__fl_value", "__fl_source")


def dedupe_traits(traits: DataFrame) -> DataFrame:
    """One row per (query, cid, type, group, clean value): sources, source tables and rules collapsed, the smallest value and evidence id, best confidence and score, matrix key.

    A trait may rest on any number of records, so their ids are counted (n_rows), not gathered; evidence_links has them all.
    """
    few = [c for c in ("source_table", "extraction_rule") if c in traits.columns]
    out = traits.groupBy(*TRAIT_KEY).agg(
        collapse_sorted(F.col("source_database")).alias("source_database"),
        *[collapse_sorted(F.col(c)).alias(c) for c in few],
        F.min(non_empty(F.col("trait_value"))).alias("trait_value"),
        F.min(non_empty(F.col("evidence_id"))).alias("evidence_id"),
        best_confidence(F.col("confidence")).alias("confidence"),
        F.max("confidence_score").alias("confidence_score"),
        F.bool_or("matrix_eligible").alias("matrix_eligible"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    key = F.when(F.col("matrix_eligible"), matrix_key(F.col("trait_type"), F.col("trait_group"), F.col("trait_value_clean")))
    return out.withColumn("matrix_key", key)


def evidence_links(traits: DataFrame) -> DataFrame:
    """Every distinct evidence id of every trait, one row each: the trait key and evidence_id.

    ``traits`` is the table that dedupe_traits takes. The rows are long, so a hot trait has no large row.
    """
    return traits.select(*TRAIT_KEY, non_empty(F.col("evidence_id")).alias("evidence_id")).filter("evidence_id is not null").distinct()


def mean_cents(c: Column) -> Column:
    """Aggregate: the mean of scores of two decimals, summed as whole cents, so that it does not depend on their order."""
    return F.round(F.sum(F.round(c * 100).cast("long")) / F.count(c) / 100, 6)


def in_profile(profile: str) -> Column:
    if profile == "full":
        return F.lit(True)
    types, keys = PROFILES[profile]
    out = F.concat_ws(":", "trait_type", "trait_group").isin(*keys) if keys else F.lit(False)
    return out | F.col("trait_type").isin(*types) if types else out


def matrix_source(traits: DataFrame, profile: str = "core", min_confidence: str | float = 0) -> DataFrame:
    """Traits that enter a matrix of a profile with at least a confidence."""
    return traits.filter(F.col("matrix_key").isNotNull() & (F.coalesce("confidence_score", F.lit(0.0)) >= confidence_threshold(min_confidence)) & in_profile(profile))


def rank_keys(source: DataFrame, max_traits: int | None = None, key: str = "matrix_key") -> DataFrame:
    """Matrix keys by how many compounds have them, then mean confidence, then name; the first ``max_traits``."""
    ranked = source.groupBy(key).agg(F.countDistinct(key_value(F.col("query")), key_value(F.col("cid"))).alias("prevalence"), mean_cents(F.col("confidence_score")).alias("mean_confidence"))
    ranked = ranked.orderBy(F.desc("prevalence"), F.desc("mean_confidence"), key)
    return ranked if max_traits is None else ranked.limit(max_traits)


def trait_matrix(source: DataFrame, compounds: DataFrame, keys: list[str], mode: str = "binary", key: str = "matrix_key") -> DataFrame:
    """compound x key: binary, count or highest confidence; every compound has a row, 0 where it lacks a key.

    ``keys`` is the ordered list of columns (see rank_keys); with it Spark needs no pass to find them.
    """
    values = {"binary": F.lit(1.0), "count": F.count(F.lit(1)).cast("double"), "confidence": F.max("confidence_score")}
    value = F.max(values[mode]) if mode == "binary" else values[mode]
    wide = source.groupBy("query", "cid").pivot(key, keys).agg(value)
    base = compounds.select("query", "cid").distinct()
    joined = base.alias("b").join(wide.alias("w"), F.col("b.query").eqNullSafe(F.col("w.query")) & F.col("b.cid").eqNullSafe(F.col("w.cid")), "left")
    return joined.select("b.query", "b.cid", *[F.coalesce(F.col(f"w.`{k}`"), F.lit(0.0)).alias(k) for k in keys])


def trait_ontology(traits: DataFrame, min_confidence: str | float = 0, include_unmapped: bool = False) -> DataFrame:
    """Traits with ontology domain, group, term, key and the identifiers that their evidence names; one row per compound and term."""
    pair = F.concat_ws(":", key_piece(F.col("trait_type")), key_piece(F.col("trait_group")))
    maps = [F.create_map(*[F.lit(x) for k, v in ONTOLOGY.items() for x in (k, v[i])]) for i in (0, 1)]
    ranked = ((F.col("trait_type") == "taxonomy") & F.col("trait_group").isin(*TAXONOMY_RANKS)) | ((F.col("trait_type") == "occurrence") & F.col("trait_group").isin(*OCCURRENCE_RANKS))
    group = F.coalesce(maps[1][pair], F.when(ranked, F.concat(F.lit("taxonomic_"), "trait_group")), F.when(pair == "occurrence:occurrence_type", "occurrence_type"))
    domain = F.coalesce(maps[0][pair], F.when(ranked | (pair == "occurrence:occurrence_type"), "ecology"))
    mapped = traits.filter(F.coalesce("confidence_score", F.lit(0.0)) >= confidence_threshold(min_confidence)).withColumn("ontology_domain", domain).withColumn("ontology_group", group)
    if include_unmapped:
        mapped = mapped.withColumn("ontology_domain", F.coalesce("ontology_domain", F.lit("unmapped"))).withColumn("ontology_group", F.coalesce("ontology_group", "trait_group"))
    else:
        mapped = mapped.filter("ontology_domain is not null")
    value = F.col("trait_value") if "trait_value" in traits.columns else F.col("trait_value_clean")
    ident, source, url = ontology_identifier(F.col("trait_type"), F.col("trait_group"), value, F.col("evidence_id"), F.col("ontology_group"))
    found = F.min(F.when(ident.isNotNull(), F.struct(ident.alias("i"), source.alias("s"), url.alias("u"))))
    out = mapped.groupBy("query", "cid", "ontology_domain", "ontology_group", F.col("trait_value_clean").alias("ontology_term")).agg(
        F.max("confidence_score").alias("confidence_score"), best_confidence(F.col("confidence")).alias("confidence"), collapse_sorted(F.col("source_database")).alias("source_database"), found.alias("f")
    )
    out = out.withColumn("ontology_key", matrix_key(F.col("ontology_domain"), F.col("ontology_group"), F.col("ontology_term")))
    return out.select(*[c for c in out.columns if c != "f"], F.col("f.i").alias("ontology_id"), F.col("f.s").alias("ontology_id_source"), F.col("f.u").alias("ontology_id_url"))


#: Pages of identifiers, by their source.
IDENTIFIER_PAGES = {
    "NCBI Taxonomy": "https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=",
    "EC": "https://www.kegg.jp/entry/",
    "KEGG PATHWAY": "https://www.kegg.jp/entry/",
    "KEGG REACTION": "https://www.kegg.jp/entry/",
    "KEGG COMPOUND": "https://www.kegg.jp/entry/",
    "NCBI Gene": "https://www.ncbi.nlm.nih.gov/gene/",
    "PubChem BioAssay": "https://pubchem.ncbi.nlm.nih.gov/bioassay/",
}


def ontology_identifier(trait_type: Column, trait_group: Column, value: Column, evidence_id: Column, ontology_group: Column) -> tuple[Column, Column, Column]:
    """(identifier, its source, its page) that a trait or its evidence names, by the trait's type and group; the first rule that holds."""
    text = F.concat_ws("; ", non_empty(evidence_id), non_empty(value))

    def first(where: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(F.coalesce(where, F.lit("")), f"({pattern})", 1), F.lit(""))

    number_ = r"\b[0-9]{1,12}\b"
    chemical, assayed = trait_type.isin("pathway", "reaction", "chemical_class"), trait_type.isin("bioactivity", "target", "potency")
    rules = (
        (ontology_group == "ghs_hazard_code", F.upper(first(text, r"(?i)\bH[0-9]{3}[A-Za-z]?\b")), "GHS"),
        (trait_group == "mesh_tree_category", first(text, r"\b[A-Z][0-9]{2}(?:\.[0-9]+)+\b"), "MeSH tree number"),
        (trait_type.isin("taxonomy", "occurrence"), first(evidence_id, number_), "NCBI Taxonomy"),
        (chemical & trait_group.isin("ec_number", "enzyme_class"), F.concat(F.lit("ec:"), first(text, r"\b[0-9]+(?:\.[0-9-]+){3}\b")), "EC"),
        (chemical & trait_group.isin("pathway_group", "pathway_name"), first(text, r"\b(?:map|ko)[0-9]{5}\b"), "KEGG PATHWAY"),
        (chemical & trait_group.isin("reaction_name", "participant_role", "participant_side"), first(text, r"\bR[0-9]{5}\b"), "KEGG REACTION"),
        (chemical & (trait_group == "participant_id"), first(F.upper(value), r"\bC[0-9]{5}\b"), "KEGG COMPOUND"),
        (assayed & (trait_group == "target_gene"), first(value, number_), "NCBI Gene"),
        (assayed & (trait_group == "target_taxonomy"), first(value, number_), "NCBI Taxonomy"),
        (assayed & (trait_group == "target_accession"), non_empty(value), "PubChem BioAssay target accession"),
        (trait_type.isin("bioactivity", "potency") & trait_group.isin("activity_class", "activity_direction", "bioactivity_domain", "assay_type", "endpoint_metric", "potency_metric", "potency_bucket"), F.concat(F.lit("AID:"), first(evidence_id, number_)), "PubChem BioAssay"),
    )
    ident, source = F.lit(None).cast("string"), F.lit(None).cast("string")
    for holds, found, name in reversed(rules):
        hit = F.coalesce(holds, F.lit(False)) & found.isNotNull()
        ident, source = F.when(hit, found).otherwise(ident), F.when(hit, name).otherwise(source)
    pages = F.create_map(*[F.lit(x) for kv in IDENTIFIER_PAGES.items() for x in kv])
    return ident, source, F.concat(pages[source], F.regexp_replace(ident, "^AID:", ""))


def trait_evidence(traits: DataFrame, keys: list[str] | None = None, min_confidence: str | float = 0, links: DataFrame | None = None) -> DataFrame:
    """Audit rows of traits, for all or for some matrix keys; with ``links`` (see evidence_links) a row for each evidence id of a trait."""
    rows = traits.filter(F.coalesce("confidence_score", F.lit(0.0)) >= confidence_threshold(min_confidence))
    if keys is not None:
        rows = rows.filter(F.col("matrix_key").isin(*keys))
    if links is not None:
        t, u = rows.drop("evidence_id").alias("t"), links.alias("u")
        same = F.lit(True)
        for k in TRAIT_KEY:
            same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}"))
        rows = t.join(u, same, "left").select("t.*", "u.evidence_id")
    return rows.select("query", "cid", "trait_type", "trait_group", "trait_value_clean", "matrix_key", "source_database", "evidence_id", "confidence", "confidence_score")


def trait_summary(traits: DataFrame, by: str = "type", min_confidence: str | float = 0, top_n: int = 8) -> DataFrame:
    """Per trait type, source or compound: counts, mean score and the most frequent values (ties by name)."""
    keys = {"type": ["trait_type", "trait_group"], "source": ["source_database"], "compound": ["query", "cid"]}[by]
    rows = traits.filter(F.coalesce("confidence_score", F.lit(0.0)) >= confidence_threshold(min_confidence))
    value = F.concat_ws(":", "trait_type", "trait_group", "trait_value_clean")
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(value).alias("n_traits"), F.countDistinct("matrix_key").alias("n_keys"), F.count_if(F.col("confidence_score") >= 0.9).alias("n_high"), mean_cents(F.col("confidence_score")).alias("mean_score")
    )
    counted = rows.groupBy(*keys, "trait_value_clean").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "trait_value_clean"))
    top = counted.withColumn("place", place).filter(F.col("place") <= top_n).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "trait_value_clean"))), lambda x: x["trait_value_clean"]), "; ").alias("top_values"))
    t, u = totals.alias("t"), top.alias("u")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}"))
    return t.join(u, same, "left").select("t.*", "u.top_values")


def trait_sets(source: DataFrame, key: str = "matrix_key") -> DataFrame:
    """(representative, class_size, keys, ids) of every class of compounds with the same keys, written once; the keys are sorted, the ids are their 64-bit hashes."""
    sets = source.groupBy("query").agg(F.array_sort(F.collect_set(key)).alias("keys"))  # one compound's keys, bounded by the number of keys
    classes = sets.groupBy("keys").agg(F.min("query").alias("representative"), F.count(F.lit(1)).alias("class_size"))
    return stage(classes.withColumn("ids", F.transform("keys", lambda k: F.xxhash64(k))), "trait-sets")


def trait_classes(source: DataFrame, key: str = "matrix_key") -> DataFrame:
    """(query, representative, class_size): compounds with the same set of keys. The set of one compound is bounded by the number of keys."""
    sets = source.groupBy("query").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(key)), "\x1f"), 256).alias("fingerprint"))
    reps = sets.groupBy("fingerprint").agg(F.min("query").alias("representative"), F.count(F.lit(1)).alias("class_size"))
    return sets.join(reps, "fingerprint").select("query", "representative", "class_size")


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """The rarest keys of every set, as many as a partner with at least that Jaccard must share one of: representative, n_keys, id."""
    keys = sets.select("representative", F.size("ids").alias("n_keys"), F.explode("ids").alias("id"))
    often = keys.groupBy("id").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("representative").orderBy("often", "id"))
    most = F.col("n_keys") - F.ceil(F.lit(least) * F.col("n_keys") - 1e-9) + 1
    return stage(keys.join(often, "id").withColumn("place", place).filter(F.col("place") <= most).select("representative", "n_keys", "id"), "trait-prefixes")


def _similar(sets: DataFrame, least: float, asked: DataFrame | None = None) -> DataFrame:
    """Pairs of sets with at least that Jaccard (0: with any key in common): a, b, class and set sizes, shared and united keys; with ``asked`` (representative) all partners of those, else a < b."""
    sent = _prefixes(sets, least)
    left = sent if asked is None else sent.join(asked, "representative", "left_semi")
    a, b = left.alias("a"), sent.alias("b")
    other = F.col("a.representative") < F.col("b.representative") if asked is None else F.col("a.representative") != F.col("b.representative")
    sizes = (F.col("a.n_keys") >= F.col("b.n_keys") * least - 1e-9) & (F.col("b.n_keys") >= F.col("a.n_keys") * least - 1e-9)
    met = a.join(b, (F.col("a.id") == F.col("b.id")) & other & sizes).select(F.col("a.representative").alias("a"), F.col("b.representative").alias("b")).distinct()
    side = lambda s: sets.select(F.col("representative").alias(s), F.col("class_size").alias("n_" + s), F.col("ids").alias("ids_" + s))
    counted = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", F.size("ids_a").alias("size_a"), F.size("ids_b").alias("size_b"), F.size(F.array_intersect("ids_a", "ids_b")).alias("n_shared"))
    return counted.withColumn("n_union", F.col("size_a") + F.col("size_b") - F.col("n_shared")).filter(F.col("n_shared") >= F.lit(least) * F.col("n_union") - 1e-9)


def trait_similarity(source: DataFrame, key: str = "matrix_key", least: float = 0.5, top_n: int = 12) -> DataFrame:
    """Pairs of compounds with at least that Jaccard: counts of shared, united and one-sided keys, Jaccard, overlap coefficient, and the first ``top_n`` keys of each kind.

    Compounds with exactly the same key set form one class and are compared once: a row is a pair of
    class representatives (smallest query), with ``n_a`` and ``n_b`` members; trait_classes gives the
    membership. Only the rarest keys of each set are joined, so what is written grows with the pairs that
    are similar. With ``least`` 0 all pairs with a key in common come out; pairs without any have Jaccard 0.
    """
    sets = trait_sets(source, key)
    side = lambda s: sets.select(F.col("representative").alias(s), F.col("keys").alias("keys_" + s))
    both = _similar(sets, least).join(side("a"), "a").join(side("b"), "b")
    shared, only_a, only_b = F.array_intersect("keys_a", "keys_b"), F.array_except("keys_a", "keys_b"), F.array_except("keys_b", "keys_a")
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, top_n), "; "))
    return both.select(
        "a", "b", "n_a", "n_b", "n_shared", "n_union", (F.col("size_a") - F.col("n_shared")).alias("n_only_a"), (F.col("size_b") - F.col("n_shared")).alias("n_only_b"), F.round(F.col("n_shared") / F.col("n_union"), 4).alias("jaccard"),
        F.round(F.col("n_shared") / F.least("size_a", "size_b"), 4).alias("overlap"), listed(shared).alias("shared_keys"), listed(only_a).alias("only_a_keys"), listed(only_b).alias("only_b_keys"),
    )


#: Jaccards at which neighbours are looked for one after the other; who has enough of them is not looked for again.
NEIGHBOUR_STEPS = (0.8, 0.5, 0.0)


def nearest_neighbours(source: DataFrame, key: str = "matrix_key", k: int = 3) -> DataFrame:
    """(query, neighbour, place, jaccard): the k nearest of every compound by Jaccard, then shared keys, then name.

    Compounds of the same key set are each other's nearest. Classes are searched, then members: a class is
    done as soon as it has k neighbours of at least the Jaccard of a step, so common keys are joined only
    for the few that have none nearer. A compound that shares no key with others has only its class.
    """
    sets = trait_sets(source, key)
    members = stage(trait_classes(source, key).drop("class_size"), "trait-members")
    first = Window.partitionBy("representative").orderBy("query")
    named = stage(members.withColumn("no", F.row_number().over(first)).filter(F.col("no") <= k + 1), "trait-first-members")
    asked = stage(sets.filter(F.col("class_size") <= k).select("representative", (F.col("class_size") - 1).alias("have")), "trait-asked")
    found = None
    for least in NEIGHBOUR_STEPS:
        near = _similar(sets, least, asked.select("representative"))
        best = Window.partitionBy("a").orderBy((F.col("n_shared") / F.col("n_union")).desc(), F.desc("n_shared"), "b")
        near = stage(near.select("a", "b", "n_b", "n_shared", "n_union").withColumn("no", F.row_number().over(best)).filter(F.col("no") <= k), "trait-near")
        got = near.groupBy("a").agg(F.sum("n_b").alias("got"))
        state = stage(asked.join(got, F.col("a") == F.col("representative"), "left").select("representative", "have", (F.col("have") + F.coalesce("got", F.lit(0)) >= k).alias("done")), "trait-state")
        done = state.filter("done") if least > 0 else state
        mine = near.join(done.select(F.col("representative").alias("a")), "a", "left_semi")
        found = mine if found is None else found.unionByName(mine)
        asked = state.filter("not done").select("representative", "have")
    entry = lambda jaccard, shared: F.struct((-jaccard).alias("j"), (-shared).alias("s"), F.col("query").alias("n"))
    own = named.join(sets, "representative").select("representative", entry(F.lit(1.0), F.size("keys")).alias("e"))
    others = found.join(named.withColumnRenamed("representative", "b").filter(F.col("no") <= k).drop("no"), "b").select(F.col("a").alias("representative"), entry(F.col("n_shared") / F.col("n_union"), F.col("n_shared")).alias("e"))
    lists = stage(own.unionByName(others).groupBy("representative").agg(F.array_sort(F.collect_list("e")).alias("list")), "trait-lists")  # at most k + 1 + k * k entries
    rows = members.count()
    hot = sets.filter(F.col("class_size") >= hot_threshold(rows)).select("representative")
    joined = split_join(members, lists, ["representative"], hot)
    mine = F.slice(F.filter("list", lambda x: x["n"] != F.col("query")), 1, k)
    return joined.select("query", F.posexplode(mine).alias("at", "x")).select("query", F.col("x.n").alias("neighbour"), (F.col("at") + 1).alias("place"), F.round(-F.col("x.j"), 4).alias("jaccard"))


#: Domains whose terms a report lists.
REPORT_DOMAINS = ("safety", "physicochemical", "exposure", "metabolism", "ecology", "bioactivity", "sensory", "biomedical", "regulatory", "reactivity")


def top_values(value: Column, n: int) -> Column:
    """Aggregate: the first n of the distinct values in order, joined; null without any."""
    found = F.array_sort(F.collect_set(value))
    return F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, n), "; "))


def trait_report(traits: DataFrame, ontology: DataFrame, top_n: int = 8, neighbours: DataFrame | None = None) -> DataFrame:
    """One row per compound: traits, terms, domains, sources, mean score, the first ``top_n`` terms per domain as "group=term", identifiers, pages and nearest compounds.

    ``ontology`` is that of trait_ontology. ``neighbours`` is that of nearest_neighbours; without it the two columns are null.
    """
    counts = traits.groupBy("query").agg(F.count(F.lit(1)).alias("n_traits"))
    term = F.concat_ws("=", "ontology_group", "ontology_term")
    terms = ontology.groupBy("query").agg(
        F.countDistinct("ontology_key").alias("n_terms"), F.countDistinct("ontology_domain").alias("n_domains"), F.count(F.lit(1)).alias("n_evidence"), F.count_if(F.col("confidence_score") >= 0.9).alias("n_high"),
        mean_cents(F.col("confidence_score")).alias("mean_score"), top_values(F.col("ontology_domain"), 100).alias("domains"), *[top_values(F.when(F.col("ontology_domain") == d, term), top_n).alias(d + "_terms") for d in REPORT_DOMAINS],
        top_values(F.when(F.col("ontology_id").isNotNull(), F.concat_ws(":", "ontology_id_source", "ontology_id")), top_n).alias("identifiers"), top_values(F.col("ontology_id_url"), top_n).alias("pages"),
    )
    out = counts.join(terms, "query", "left")
    none = F.lit(None)
    if neighbours is None:
        return out.withColumns({"nearest": none.cast("string"), "nearest_jaccard": none.cast("double")})
    text = F.concat(F.col("neighbour"), F.lit(" ("), F.format_string("%.4f", "jaccard"), F.lit(")"))
    near = neighbours.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]), "; ").alias("nearest"), F.max("jaccard").alias("nearest_jaccard"))
    return out.join(near, "query", "left")


def measurement_summary(measurements: DataFrame) -> DataFrame:
    """Per query and property: number, minimum, exact median and maximum of the standard values, the best row's value, and the bins and sources collapsed.

    The best row has a value, then the best confidence, then the smallest source. Percentiles are exact.
    ``bin`` may be absent.
    """
    keys = ["query", "property"]
    v = number(F.col("standard_value"))
    rows = measurements.withColumn("__fl_v", v)
    rank = F.struct(F.col("__fl_v").isNull(), -F.when(F.lower("confidence") == "high", 3).when(F.lower("confidence") == "medium", 2).when(F.lower("confidence") == "low", 1).otherwise(0), F.col("source"), F.col("__fl_v"))
    bins = F.col("bin") if "bin" in measurements.columns else F.lit(None).cast("string")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("__fl_v").alias("min_value"), F.max("__fl_v").alias("max_value"), F.min_by("__fl_v", rank).alias("best_value"), best_confidence(F.col("confidence")).alias("confidence"),
        collapse_sorted(bins).alias("bins"), F.countDistinct(non_empty(F.col("source"))).alias("n_sources"),
    )
    medians = exact_percentiles(rows, keys, "__fl_v", {"median_value": 0.5})
    t, u = out.alias("t"), medians.alias("u")
    return t.join(u, F.col("t.query").eqNullSafe(F.col("u.query")) & F.col("t.property").eqNullSafe(F.col("u.property")), "left").select("t.*", "u.median_value")
