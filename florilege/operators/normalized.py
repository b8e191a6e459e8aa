"""Normalized tables of compounds (classes, hazards, uses, assays, taxonomy, occurrences) and the traits of all of them.

Every table is a union of narrow projections and one aggregation by its key; sources, rules and
tables are collapsed, of longer texts the smallest stays. A source that is None is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions import rules
from florilege.functions.extract import TOXICITY, all_matches
from florilege.functions.text import collapse_sorted, first_non_empty, non_empty
from florilege.operators.traits import source_database, term_lookup

#: Texts that are no class.
NO_CLASS = ("None", "NA")


def _null() -> Column:
    return F.lit(None).cast("string")


def unite(parts: list[DataFrame], keys: list[str], collapse: list[str] = (), smallest: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Union by name and one row per key (nulls are equal): few-valued columns collapsed, of others the smallest value, the best confidence."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    confidence = [rules.best_confidence(F.col("confidence")).alias("confidence")] if "confidence" in out.columns and "confidence" not in keys else []
    return out.groupBy(*keys).agg(*[collapse_sorted(F.col(c)).alias(c) for c in collapse], *[F.min(non_empty(F.col(c).cast("string"))).alias(c) for c in smallest], *confidence, F.count(F.lit(1)).alias("n_rows"))


def split_terms(c: Column) -> Column:
    """The terms of a text that are separated by ; or |, squished, each once; none for null."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s*[;|]\s*"), lambda x: F.trim(F.regexp_replace(x, r"[\s\pZ]+", " "))), lambda x: x != ""))


def looked_up(df: DataFrame, term: str) -> DataFrame:
    """Rows with the dictionary's group and confidence of a term, each computed once in a step of its own: one expression of all would not compile."""
    _, group, confidence = term_lookup(F.col(term))
    return rules.hold(rules.hold(df, __fl_group=group), __fl_confidence=confidence)


CLASS_KEY = ["query", "cid", "class_system", "class_type", "class_id", "class_name", "class_group"]


def chemical_classes(*, reactive: DataFrame | None = None, natural: DataFrame | None = None, paths: DataFrame | None = None, subjects: DataFrame | None = None, pathways: DataFrame | None = None, enzymes: DataFrame | None = None) -> DataFrame:
    """Class assignments of up to six sources.

    ``reactive``: query, cid, value. ``natural``: query, cid, record, product_classes. ``paths``: query, cid, hnid, path (" > "
    between levels, superclass first). ``subjects``: query, cid, tree_numbers, label. ``pathways``: query, cid, id, name,
    pathway_group. ``enzymes``: query, cid, ec_number, name, enzyme_class.
    """

    def rows(df: DataFrame, system: str, kind: Column, ident: Column, name: Column, group: Column, table: str, rule: str, confidence: Column, text: Column) -> DataFrame:
        return df.select(
            "query", "cid", F.lit(system).alias("class_system"), kind.alias("class_type"), non_empty(ident).alias("class_id"), non_empty(name).alias("class_name"), group.alias("class_group"), F.lit(table).alias("source_table"),
            F.lit(rule).alias("extraction_rule"), confidence.alias("confidence"), text.alias("evidence_text"),
        )

    high, medium, parts = F.lit("high"), F.lit("medium"), []
    if reactive is not None:
        df = reactive.filter(non_empty(F.col("value")).isNotNull() & ~F.col("value").isin(*NO_CLASS))
        parts.append(rows(df, "PubChem/reactives", F.lit("reactive_group"), _null(), F.col("value"), rules.clean_label(F.col("value")), "reactives", "legacy_reactive_group", medium, F.col("value")))
    if natural is not None:
        df = natural.select("query", "cid", "record", F.explode(split_terms(F.col("product_classes"))).alias("term"))
        df = looked_up(df, "term")
        parts.append(rows(df, "LOTUS", F.lit("natural_product_class"), F.col("record"), F.col("term"), F.col("__fl_group"), "LOTUSProfile", "natural_product_class_terms", F.col("__fl_confidence"), F.col("term")))
    if paths is not None:
        levels = F.filter(F.split("path", r"\s*>\s*"), lambda x: F.trim(x) != "")
        df = paths.withColumn("levels", levels).filter(F.size("levels") > 0).select("*", F.size("levels").alias("n"), F.posexplode("levels").alias("level", "term"))
        kind = F.when(F.col("level") == 0, "natural_product_superclass").when(F.col("level") == F.col("n") - 1, "natural_product_subclass").otherwise("natural_product_class")
        parts.append(rows(df, "LOTUS", kind, F.when(F.col("level") == F.col("n") - 1, F.col("hnid").cast("string")), F.col("term"), rules.clean_label(F.get("levels", 0)), "PubChemClassificationProfile", "lotus_chemical_tree", high, F.col("path")))
    if subjects is not None:
        df = subjects.select("query", "cid", "label", F.explode_outer(F.when(F.size(split_terms(F.col("tree_numbers"))) > 0, split_terms(F.col("tree_numbers")))).alias("tree"))
        parts.append(rows(df, "MeSH", F.lit("mesh_tree_category"), F.col("tree"), F.col("label"), rules.tree_group(F.col("tree")), "MeSHProfile", "mesh_tree_number", F.when(F.col("tree").isNull(), medium).otherwise(high), F.col("label")))
    if pathways is not None:
        df = pathways.filter(non_empty(F.col("pathway_group")).isNotNull())
        parts.append(rows(df, "KEGG", F.lit("pathway_group"), F.col("id"), F.col("name"), F.col("pathway_group"), "KEGGPathways", "kegg_pathway_group", high, F.col("name")))
    if enzymes is not None:
        df = enzymes.filter(non_empty(F.col("enzyme_class")).isNotNull())
        parts.append(rows(df, "KEGG", F.lit("enzyme_class"), F.col("ec_number"), F.col("name"), F.col("enzyme_class"), "KEGGEnzymes", "kegg_enzyme_class", high, F.col("name")))
    return unite(parts, CLASS_KEY, ["source_table", "extraction_rule"], ["evidence_text"])


USE_KEY = ["query", "cid", "use_domain", "use_type", "use_term", "use_group"]


def chemical_uses(*, flavours: DataFrame | None = None, labels: DataFrame | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """Use terms of flavour, label and subject profiles, each looked up in the term dictionary.

    ``flavours``: query, cid, descriptors, flavours, odours, gras. ``labels``: query, cid, ingredients, classes, routes, dosage_forms,
    warnings. ``subjects``: query, cid, actions. All texts may hold several terms; absent columns are left out.
    """
    parts = []

    def add(df: DataFrame | None, columns: dict[str, tuple[str, str]], table: str, rule: str) -> None:
        if df is None:
            return
        there = [F.struct(F.lit(d).alias("use_domain"), F.lit(t).alias("use_type"), split_terms(F.col(c)).alias("terms")) for c, (d, t) in columns.items() if c in df.columns]
        long = df.select("query", "cid", F.explode(F.array(*there)).alias("u")).select("query", "cid", "u.use_domain", "u.use_type", F.explode("u.terms").alias("use_term"))
        long = looked_up(long, "use_term")
        group = F.when(F.col("use_type") == "regulatory_status", "flavor_regulatory").otherwise(F.col("__fl_group"))
        parts.append(long.select("query", "cid", "use_domain", "use_type", "use_term", group.alias("use_group"), F.col("__fl_confidence").alias("confidence"), F.lit(table).alias("source_table"), F.lit(rule).alias("extraction_rule")))

    add(flavours, {"descriptors": ("sensory", "descriptor"), "flavours": ("sensory", "flavor"), "odours": ("sensory", "odor"), "gras": ("regulatory", "regulatory_status")}, "FEMAProfile", "fema_discrete_terms")
    add(labels, {"ingredients": ("biomedical", "active_ingredient"), "classes": ("biomedical", "pharmacologic_class"), "routes": ("biomedical", "administration_route"), "dosage_forms": ("biomedical", "dosage_form"), "warnings": ("safety", "warning")}, "FDA_SPL_Profile", "fda_spl_discrete_terms")
    add(subjects, {"actions": ("biomedical", "pharmacologic_action")}, "MeSHProfile", "mesh_action_terms")
    return unite(parts, USE_KEY, ["source_table", "extraction_rule"])


#: Routes of exposure by the first pattern found.
EXPOSURE_RULES = (("oral|swallow|ingest", "oral"), ("skin|dermal", "dermal"), ("inhal", "inhalation"), ("eye|ocular", "ocular"))


def chemical_hazards(texts: DataFrame) -> DataFrame:
    """Hazards that texts (query, cid, text) name: one row per hazard code or figure of toxicity, with category, group, signal word, route, organs and species.

    A text with neither still has a row if it names a hazard category.
    """
    t = F.col("text")
    codes = all_matches(F.upper(t), r"\bH[0-9]{3}[A-Z]?\b")
    figures = F.arrays_zip(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(TOXICITY), i).alias(n) for i, n in ((1, "m"), (2, "v"), (3, "u"))])
    none = F.array(F.lit(None).cast("string"))
    by_code = texts.select("query", "cid", "text", F.explode(F.when(F.size(codes) > 0, codes).otherwise(none)).alias("hazard_code"), F.lit(None).cast("struct<m:string,v:string,u:string>").alias("f"))
    by_figure = texts.select("query", "cid", "text", _null().alias("hazard_code"), F.explode(figures).alias("f"))
    signal = F.when(t.rlike(r"(?i)\bdanger\b"), "Danger").when(t.rlike(r"(?i)\bwarning\b"), "Warning")
    step = rules.hold(by_code.unionByName(by_figure), hazard_category=rules.hazard_category(F.col("hazard_code"), t), hazard_group=rules.hazard_group(F.col("hazard_code"), t), signal_word=signal, exposure_route=rules.ordered(t, EXPOSURE_RULES))
    step = rules.hold(step, target_organ=rules.found_terms(t, rules.TARGET_ORGANS))
    step = rules.hold(step, toxicity_species=rules.found_terms(t, rules.TEST_SPECIES))
    out = step.select(
        "query", "cid", "hazard_code", "hazard_category", "hazard_group", "signal_word", "exposure_route", "target_organ", F.upper("f.m").alias("toxicity_metric"), F.col("f.v").try_cast("double").alias("toxicity_value"), F.col("f.u").alias("toxicity_unit"),
        "toxicity_species", F.when(F.col("hazard_code").isNotNull(), "high").otherwise("medium").alias("confidence"), t.alias("evidence_text"),
    )
    named = out.filter("hazard_code is not null or toxicity_metric is not null or hazard_category is not null")
    keys = ["query", "cid", "hazard_code", "hazard_category", "hazard_group", "signal_word", "exposure_route", "target_organ", "toxicity_metric", "toxicity_value", "toxicity_unit", "toxicity_species", "confidence"]
    return unite([named.withColumn("extraction_rule", F.lit("ghs_and_toxicity_regex"))], keys, ["extraction_rule"], ["evidence_text"])


def chemical_bioassays(activities: DataFrame, details: DataFrame) -> DataFrame:
    """Assay rows with what the assay's description adds; each key once.

    ``activities``: query, cid, aid, assay_name, outcome, activity_name, value, unit, accession, gene. ``details`` (see assay_details): aid, targets,
    accessions, genes, organisms, common_names, endpoints, n_endpoints; reduced to one row per aid.
    """
    names = ("targets", "accessions", "genes", "organisms", "common_names", "endpoints", "n_endpoints")
    dim = details.filter("aid is not null").groupBy("aid").agg(F.min(F.struct(*names)).alias("d")).select("aid", *[F.col(f"d.{c}").alias("d_" + c) for c in names])
    rows = activities.join(dim, "aid", "left")
    outcome = non_empty(F.col("outcome"))
    out = rows.select(
        "query", "cid", "aid", "assay_name", outcome.alias("outcome"), rules.activity_class(outcome, _null()).alias("activity_class"), "activity_name", rules.number(F.col("value")).alias("value"), "unit",
        first_non_empty(F.col("accession"), F.col("d_accessions")).alias("accession"), first_non_empty(F.col("gene"), F.col("d_genes")).alias("gene"), first_non_empty(F.col("d_targets"), F.col("accession"), F.col("gene")).alias("target_name"),
        F.col("d_organisms").alias("target_organism"), F.col("d_common_names").alias("target_common_name"), F.col("d_endpoints").alias("endpoint_names"), F.coalesce("d_n_endpoints", F.lit(0)).alias("n_endpoints"),
        F.when(F.col("d_targets").isNotNull() | F.col("d_endpoints").isNotNull(), "pubchem_assay_summary; pubchem_assay_detail").otherwise("pubchem_assay_summary").alias("extraction_rule"),
        F.when(F.col("aid").isNotNull() & outcome.isNotNull(), "high").otherwise("medium").alias("confidence"),
    )
    usable = out.filter("aid is not null or assay_name is not null or outcome is not null")
    return usable.dropDuplicates(["query", "cid", "aid", "accession", "gene", "outcome", "activity_name", "value", "assay_name"])


#: Words that are no organisms.
NO_ORGANISM = r"(?i)\b(natural products?|compound|record|unknown|metabolite|synthetic)\b"
RANKS = ("domain", "kingdom", "phylum", "class", "order", "family", "genus", "species")


def chemical_taxonomy(rows: DataFrame) -> DataFrame:
    """Taxa that compounds come from: one row per compound and taxon with ranks, group and confidence.

    ``rows``: query, cid, taxonomy_id, organism, the ranks that are known (absent ones are null), common_name, product_classes, source.
    Rows that name no organism, or one of the words for something else, are left out; genus and species come from the organism's
    name where it has two words.
    """
    there = lambda c: non_empty(F.col(c)) if c in rows.columns else _null()
    named = rules.hold(rows, __fl_organism=F.when(~F.coalesce(there("organism").rlike(NO_ORGANISM), F.lit(False)), there("organism")))
    organism = F.col("__fl_organism")
    genus = F.nullif(F.regexp_extract(organism, r"^([A-Z][a-z-]+) [a-z]", 1), F.lit(""))
    species = F.nullif(F.regexp_extract(organism, r"^([A-Z][a-z-]+ [a-z][a-z-]+)", 1), F.lit(""))
    ranked = {r: there(r) for r in RANKS} | {"genus": F.coalesce(genus, there("genus")), "species": F.coalesce(species, there("species"))}
    named = rules.hold(named.select("query", "cid", organism, there("taxonomy_id").alias("taxonomy_id"), there("common_name").alias("common_name"), there("product_classes").alias("natural_product_class"), there("source").alias("source"), *[c.alias("__fl_" + r) for r, c in ranked.items()]), __fl_text=F.concat_ws("; ", *["__fl_" + r for r in RANKS], organism))
    kingdom = F.coalesce(F.col("__fl_kingdom"), rules.ordered(F.col("__fl_text"), rules.KINGDOM_RULES))
    flat = rules.hold(named, kingdom=kingdom).select("query", "cid", "taxonomy_id", organism.alias("organism"), *[F.col("kingdom") if r == "kingdom" else F.col("__fl_" + r).alias(r) for r in RANKS], "common_name", "natural_product_class", "source")
    known_rank = F.coalesce(*[F.col(r) for r in RANKS])
    flat = flat.filter("organism is not null or genus is not null or family is not null or taxonomy_id is not null")
    confidence = F.when(F.col("taxonomy_id").isNotNull() & F.col("organism").isNotNull() & known_rank.isNotNull(), "high").when(known_rank.isNotNull() | F.col("natural_product_class").isNotNull(), "medium").otherwise("low")
    group = F.coalesce(F.lower("kingdom"), F.lit("unclassified"))
    keyed = flat.withColumns({"taxonomy_group": group, "confidence": confidence, "extraction_rule": F.lit("lotus_taxonomy_regex")})
    return unite([keyed], ["query", "cid", "taxonomy_id", *RANKS, "organism", "taxonomy_group", "confidence"], ["natural_product_class", "source", "extraction_rule"], ["common_name"])


def chemical_occurrences(taxonomy: DataFrame) -> DataFrame:
    """One row per compound and organism: what chemical_taxonomy has of it, and whether it occurs in a species, a genus or a wider group."""
    kind = F.when(F.col("species").isNotNull() | F.col("organism").isNotNull(), "species_occurrence").when(F.col("genus").isNotNull(), "genus_occurrence").otherwise("taxon_occurrence")
    rows = taxonomy.withColumn("occurrence_type", kind)
    return unite([rows], ["query", "cid", "taxonomy_id", "organism", "kingdom", "family", "genus", "species", "occurrence_type"], ["natural_product_class", "source", "extraction_rule"], ["common_name"])


#: The traits that each table gives: type of the trait, then group of the trait and the column that holds its value.
TRAIT_COLUMNS = {
    "hazards": ("hazard", ("hazard_code", "hazard_category", "hazard_group", "signal_word", "exposure_route", "target_organ", "toxicity_metric", "toxicity_species")),
    "bioactivities": ("bioactivity", ("activity_class", "activity_direction", "bioactivity_domain", "assay_type", "endpoint_metric")),
    "targets": ("target", ("target_name", "target_type", "target_accession", "target_gene", "target_taxonomy", "target_organism", "target_common_name", "target_group", "endpoint_metric")),
    "potencies": ("potency", ("potency_metric", "potency_bucket", "target_name")),
    "taxonomy": ("taxonomy", ("domain", "kingdom", "phylum", "class", "order", "family", "genus", "species", "organism", "common_name", "taxonomy_group", "natural_product_class")),
    "occurrences": ("occurrence", ("occurrence_type", "kingdom", "family", "genus", "species", "organism", "natural_product_class")),
    "pathway_roles": ("pathway", ("pathway_group", "pathway_name", "reaction_name", "enzyme_class", "ec_number", "role_type")),
    "participants": ("reaction", ("participant_role", "participant_side", "participant_id", "participant_name")),
}
#: The source of tables that name none, the columns of their evidence, and groups that never enter matrices.
TABLE_SOURCE = {"hazards": "PubChem", "bioactivities": "PubChem BioAssay", "targets": "PubChem BioAssay", "potencies": "PubChem BioAssay", "pathway_roles": "KEGG", "participants": "KEGG", "occurrences": "LOTUS", "taxonomy": "LOTUS"}
EVIDENCE_COLUMNS = {
    "classes": ("class_id",), "hazards": ("hazard_code",), "bioactivities": ("aid",), "targets": ("target_gene", "target_accession", "target_taxonomy"), "potencies": ("aid",), "taxonomy": ("taxonomy_id",), "occurrences": ("taxonomy_id",),
    "pathway_roles": ("pathway_id", "reaction_id", "ec_number", "record"), "participants": ("reaction_id", "participant_id", "record"), "measurements": ("property",),
}
SPLIT_GROUPS = ("hazard_code", "hazard_category", "hazard_group", "signal_word", "exposure_route", "target_organ", "toxicity_metric", "toxicity_species", "natural_product_class", "activity_class", "activity_direction", "bioactivity_domain", "assay_type", "endpoint_metric")


def all_traits(tables: dict[str, DataFrame]) -> DataFrame:
    """Trait rows of up to twelve tables, as build_traits takes them: classes, measurements, uses, terms, and those of TRAIT_COLUMNS.

    Absent tables and columns give nothing. Texts of several terms are split where the group allows. Terms of the vocabulary and names
    of participants never enter matrices; they have ``never_eligible``.
    """
    from florilege.operators.traits import property_trait

    parts = []
    for name, df in tables.items():
        have = lambda c, df=df: F.col(f"`{c}`").cast("string") if c in df.columns else _null()
        if name in TRAIT_COLUMNS:
            kind, groups = TRAIT_COLUMNS[name]
            pairs = [F.struct(F.lit(kind).alias("trait_type"), F.lit(g).alias("trait_group"), (split_terms(have(g)) if g in SPLIT_GROUPS else F.array(have(g))).alias("vs"), F.lit(g == "participant_name").alias("never_eligible")) for g in groups if g in df.columns]
        elif name == "classes":
            pairs = [F.struct(F.lit("chemical_class").alias("trait_type"), have("class_type").alias("trait_group"), F.array(first_non_empty(have("class_name"), have("class_group"))).alias("vs"), F.lit(False).alias("never_eligible"))]
        elif name == "uses":
            pairs = [F.struct(F.lit("use").alias("trait_type"), g.alias("trait_group"), F.array(have(c)).alias("vs"), F.lit(False).alias("never_eligible")) for g, c in ((have("use_type"), "use_term"), (F.lit("use_group"), "use_group"))]
        elif name == "measurements":
            group, binned = property_trait(have("property"), rules.number(have("value")))
            df = rules.hold(rules.hold(df, __fl_group=group), __fl_bin=binned)
            pairs = [F.struct(F.when(F.col("__fl_group").isNotNull(), "property").alias("trait_type"), F.col("__fl_group").alias("trait_group"), F.array("__fl_bin").alias("vs"), F.lit(False).alias("never_eligible"))]
        elif name == "terms":
            pairs = [F.struct(F.lit("vocabulary").alias("trait_type"), have("term_type").alias("trait_group"), F.array(have("term")).alias("vs"), F.lit(True).alias("never_eligible"))]
        else:
            raise ValueError(f"no traits are known of a table {name!r}")
        source = F.lit(TABLE_SOURCE[name]) if name in TABLE_SOURCE else F.lit("PubChem") if name == "measurements" else source_database(have("source_table"), have("class_system") if name == "classes" else have("source"))
        evidence = first_non_empty(*[have(c) for c in EVIDENCE_COLUMNS.get(name, ())]) if EVIDENCE_COLUMNS.get(name) else _null()
        rule = F.concat_ws("; ", have("extraction_rule"), F.lit("property_bin")) if name == "measurements" else have("extraction_rule")
        rows = df.select("query", have("cid").try_cast("bigint").alias("cid"), source.alias("source"), F.lit(name).alias("source_table"), have("confidence").alias("confidence"), evidence.alias("evidence_id"), rule.alias("extraction_rule"), F.explode(F.array(*pairs)).alias("t"))
        parts.append(rows.select("query", "cid", "t.trait_type", "t.trait_group", F.explode("t.vs").alias("trait_value"), "t.never_eligible", "source", "source_table", "confidence", "evidence_id", "extraction_rule").filter("trait_type is not null and trait_group is not null and trait_value is not null"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Columns of the numeric properties of a compound.
PROPERTY_COLUMNS = ("molecular_weight", "exact_mass", "xlogp", "tpsa", "h_bond_donor_count", "h_bond_acceptor_count", "rotatable_bond_count", "heavy_atom_count")


def derived_profile(compounds: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row of 73 columns per compound: properties, flags, counts, dominant values, bins, contexts and scores.

    ``compounds``: query. ``tables``, each optional and of one query or many: properties (query, cid, molecular_formula, PROPERTY_COLUMNS),
    coverage (query, source, n_records), classes, occurrences, bioassays with bioactivity_domain and target_type, uses, hazards (as made
    above), pathways (query, pathway_group), reactions (query), enzymes (query, enzyme_class), literature (query). Every table is
    reduced to a row per compound before it is joined; a compound that a table lacks has counts of 0 and no flags.
    """
    from florilege.operators.evidence import dominant
    from florilege.operators.exact import exact_percentiles

    out = compounds.select("query").distinct()
    text, number_ = (lambda c: collapse_sorted(F.col(c))), (lambda c: F.countDistinct(non_empty(F.col(c))))
    spark = compounds.sparkSession

    def add(name: str, schema: str, build) -> None:
        nonlocal out
        df = tables.get(name)
        if df is None:
            df = spark.createDataFrame([], schema)
        lacking = [c.split(" ")[0] for c in schema.split(", ") if c.split(" ")[0] not in df.columns]
        kinds = dict(c.split(" ") for c in schema.split(", "))
        out = out.join(build(df.withColumns({c: F.lit(None).cast(kinds[c]) for c in lacking})), "query", "left")

    def properties(df: DataFrame) -> DataFrame:
        return df.groupBy("query").agg(F.min("cid").alias("cid"), F.min(non_empty(F.col("molecular_formula"))).alias("molecular_formula"), *[F.min(c).alias(c) for c in PROPERTY_COLUMNS])

    def coverage(df: DataFrame) -> DataFrame:
        has = lambda name: F.bool_or((F.col("source") == name) & (F.col("n_records") > 0))
        return df.groupBy("query").agg(F.countDistinct(F.when(F.col("n_records") > 0, F.col("source"))).alias("source_count"), has("LOTUS").alias("in_lotus"), has("FEMA").alias("in_fema"), has("FDA_SPL").alias("in_fda"), has("PubChemBioactivity").alias("in_assays"), has("PubChemSafety").alias("in_safety"))

    def classes(df: DataFrame) -> DataFrame:
        level = lambda kind: collapse_sorted(F.when(F.col("class_type") == kind, F.col("class_name")))
        return df.groupBy("query").agg(*[level(f"natural_product_{k}").alias(f"natural_product_{n}") for k, n in (("superclass", "superclasses"), ("class", "classes"), ("subclass", "subclasses"))], F.bool_or(F.col("class_system") == "LOTUS").alias("lotus_class"))

    def occurrences(df: DataFrame) -> DataFrame:
        observed = lambda *names: F.bool_or(F.coalesce(F.lower("kingdom").isin(*names), F.lit(False)))
        sums = df.groupBy("query").agg(
            F.count(F.lit(1)).alias("occurrence_count"), number_("organism").alias("organism_count"), number_("kingdom").alias("kingdom_count"), number_("family").alias("family_count"), number_("genus").alias("genus_count"),
            text("kingdom").alias("kingdoms_observed"), text("family").alias("families_observed"), text("genus").alias("genera_observed"), observed("plantae", "viridiplantae").alias("is_plant_occurring"), observed("fungi").alias("is_fungal_occurring"), observed("bacteria").alias("is_bacterial_occurring"),
        )
        return sums.join(dominant(df, "query", "kingdom"), "query", "left").join(dominant(df, "query", "family"), "query", "left")

    def assays(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("um", F.when(rules.is_micromolar(F.col("unit")), rules.number(F.col("value"))))
        of = lambda c: F.count_if(F.col("activity_class") == c)
        active = F.col("activity_class") == "active"
        sums = keyed.groupBy("query").agg(
            F.countDistinct("aid").alias("bioassay_count"), of("active").alias("active_assay_count"), of("inactive").alias("inactive_assay_count"), of("inconclusive").alias("inconclusive_assay_count"), number_("target_name").alias("target_count"),
            F.countDistinct(F.when(active, non_empty(F.col("target_name")))).alias("active_target_count"), F.count_if(F.col("n_endpoints") > 0).alias("assay_detail_count"),
            *[F.countDistinct(F.when(F.col("target_type") == k, F.col("target_name"))).alias(n) for k, n in (("protein_or_gene", "protein_target_count"), ("cell_line", "cell_line_target_count"))],
            F.countDistinct(F.when(F.lower("target_organism").isin("human", "homo sapiens"), F.col("target_name"))).alias("human_target_count"), text("target_organism").alias("target_organisms"), text("bioactivity_domain").alias("bioactivity_domains"),
            collapse_sorted(F.when(active, F.col("bioactivity_domain"))).alias("active_bioactivity_domains"), F.min("um").alias("min_potency_um"), F.count_if(F.col("um") <= 10).alias("potent_activity_count"),
        )
        return sums.join(exact_percentiles(keyed, ["query"], "um", {"median_potency_um": 0.5}), "query", "left")

    def uses(df: DataFrame) -> DataFrame:
        of = lambda domain: collapse_sorted(F.when(F.col("use_domain") == domain, F.col("use_term")))
        return df.groupBy("query").agg(F.bool_or(F.col("use_domain").isin("sensory", "regulatory")).alias("used_flavor"), F.bool_or(F.col("source_table").contains("FDA_SPL")).alias("used_label"), of("sensory").alias("sensory_context"), of("biomedical").alias("biomedical_context"))

    add("properties", "query string, cid bigint, molecular_formula string, " + ", ".join(f"{c} double" for c in PROPERTY_COLUMNS), properties)
    add("coverage", "query string, source string, n_records bigint", coverage)
    add("classes", "query string, class_system string, class_type string, class_name string", classes)
    add("occurrences", "query string, organism string, kingdom string, family string, genus string", occurrences)
    add("bioassays", "query string, aid bigint, activity_class string, target_name string, target_type string, target_organism string, bioactivity_domain string, value double, unit string, n_endpoints int", assays)
    add("uses", "query string, use_domain string, use_term string, source_table string", uses)
    add("hazards", "query string, hazard_group string", lambda df: df.groupBy("query").agg(F.count(F.lit(1)).alias("n_hazards"), text("hazard_group").alias("safety_context")))
    add("pathways", "query string, pathway_group string", lambda df: df.groupBy("query").agg(F.count(F.lit(1)).alias("pathway_count"), text("pathway_group").alias("metabolic_context")))
    add("reactions", "query string, x string", lambda df: df.groupBy("query").agg(F.count(F.lit(1)).alias("reaction_count")))
    add("enzymes", "query string, enzyme_class string", lambda df: df.groupBy("query").agg(F.count(F.lit(1)).alias("enzyme_count")))
    add("literature", "query string, x string", lambda df: df.groupBy("query").agg((F.count(F.lit(1)) > 0).alias("cited")))

    n = lambda c: F.coalesce(c, F.lit(0))
    yes = lambda *cs: F.coalesce(*[F.when(F.col(c), F.lit(True)) for c in cs], F.lit(False))
    mw, tpsa, xlogp = F.col("molecular_weight"), F.col("tpsa"), F.col("xlogp")
    volatility = rules.volatility_proxy(mw, tpsa, F.col("h_bond_donor_count"))
    breadth = rules.taxonomic_breadth(n("kingdom_count"), n("family_count"), n("genus_count"), n("organism_count"))
    assayed, hazardous = yes("in_assays") | (n("bioassay_count") > 0), yes("in_safety") | (n("n_hazards") > 0)
    score = rules.compound_confidence(F.col("cid"), F.col("molecular_formula"), mw, F.col("exact_mass"), n("source_count"), n("pathway_count"), n("reaction_count"), n("enzyme_count"), hazardous, assayed)
    joined = lambda *cs: F.nullif(F.concat_ws("; ", *cs), F.lit(""))
    formula = F.col("molecular_formula")
    flags = {"oxygenated": "O", "nitrogenous": "N", "sulfur_containing": "S", "halogenated": "F|Cl|Br|I"}
    return out.select(
        "query", "cid", "molecular_formula", *PROPERTY_COLUMNS, (yes("in_lotus", "lotus_class")).alias("is_natural_product"), "natural_product_superclasses", "natural_product_classes", "natural_product_subclasses",
        *[n(c).alias(c) for c in ("occurrence_count", "organism_count", "kingdom_count", "family_count", "genus_count")], "kingdoms_observed", "families_observed", "genera_observed", "dominant_kingdom", "dominant_family", breadth.alias("taxonomic_breadth"),
        *[yes(c).alias(c) for c in ("is_plant_occurring", "is_fungal_occurring", "is_bacterial_occurring")], yes("in_fema", "used_flavor").alias("is_flavor_ingredient"), yes("in_fda", "used_label", "in_assays").alias("is_drug_or_label_ingredient"),
        (n("pathway_count") > 0).alias("has_kegg_pathway"), assayed.alias("has_bioactivity"), (n("active_assay_count") > 0).alias("has_active_bioactivity"), hazardous.alias("has_safety_hazard"), yes("cited").alias("has_literature"),
        *[n(c).alias(c) for c in ("bioassay_count", "active_assay_count", "inactive_assay_count", "inconclusive_assay_count", "target_count", "active_target_count", "assay_detail_count", "protein_target_count", "cell_line_target_count", "human_target_count")],
        "target_organisms", "bioactivity_domains", "active_bioactivity_domains", "min_potency_um", "median_potency_um", *[n(c).alias(c) for c in ("potent_activity_count", "pathway_count", "reaction_count", "enzyme_count", "source_count")],
        rules.mw_bin(mw).alias("molecular_size_bin"), rules.polarity_bin(tpsa).alias("polarity_bin"), rules.lipophilicity_bin(xlogp).alias("lipophilicity_bin"), volatility.alias("volatility_proxy"), *[rules.formula_has(formula, e).alias(c) for c, e in flags.items()],
        "metabolic_context", "biomedical_context", joined("natural_product_superclasses", "natural_product_classes", "natural_product_subclasses", "dominant_kingdom", "families_observed", breadth).alias("ecological_context"), "sensory_context", "safety_context",
        joined(volatility, rules.polarity_bin(tpsa), rules.lipophilicity_bin(xlogp)).alias("analytical_context"), joined("bioactivity_domains", "target_organisms").alias("bioactivity_context"), score.alias("confidence_score"), score.alias("evidence_score"),
    )
