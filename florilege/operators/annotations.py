"""Profiles from annotation rows (query, cid, heading, name, value, source), and the normalized tables made of them.

Every profile is one pass: a filter on the annotation's text, expressions, and one aggregation by key
with the sources collapsed. Null and blank values give no profile rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions import rules
from florilege.functions.extract import RANK_SUFFIXES, all_matches, taxon_rank
from florilege.functions.text import collapse_sorted, non_empty
from florilege.operators.traits import term_lookup

#: Which annotations belong to which profile.
SAFETY = r"(?i)Safety|Hazard|GHS|Toxicity|Toxicological|Fire|Exposure|Handling|Warning|Danger|H[0-9]{3}|P[0-9]{3}"
FLAVOUR = r"(?i)FEMA|Flavor and Extract|Flavor|Odor|Taste|GRAS|JECFA"
LABEL = r"(?i)FDA/SPL|SPL Indexing|Drug and Medication|Therapeutic Uses|Drug|Medication|Clinical|Pharmacologic|Indication|Contraindication|Adverse|Route|Dosage|Ingredient|Boxed Warning"
SUBJECT = r"(?i)MeSH|Medical Subject Headings|Pharmacologic Action|Descriptor|Tree Number"
LITERATURE = r"(?i)Literature|PubMed|PMID|DOI|Patent|Reference|Citation"
NATURAL = r"(?i)LOTUS|natural product|taxonomy|organism"


def _text() -> Column:
    return F.concat_ws(" ", "heading", "name", "value")


def _joined(pattern: str) -> Column:
    found = F.array_join(F.array_sort(all_matches(_text(), pattern)), "; ")
    return F.when(found != "", found)


def _profile(rows: DataFrame, belongs: str, **columns: Column) -> DataFrame:
    mine = rows.filter(non_empty(F.col("value")).isNotNull() & _text().rlike(belongs))
    out = mine.select("query", "cid", *[c.alias(n) for n, c in columns.items()], F.col("source").alias("__fl_source"))
    return out.groupBy("query", "cid", *columns).agg(F.count(F.lit(1)).alias("n_rows"), collapse_sorted(F.col("__fl_source")).alias("sources"))


def signal_word(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)\bdanger\b"), "Danger").when(text.rlike(r"(?i)\bwarning\b"), "Warning")


def safety_profile(rows: DataFrame) -> DataFrame:
    """Hazard and precaution codes, signal word, and the category and group of the first hazard code."""
    first = F.nullif(F.regexp_extract(_text(), r"\b(H[0-9]{3}[A-Za-z]?)\b", 1), F.lit(""))
    return _profile(
        rows, SAFETY, hazard_codes=_joined(r"\bH[0-9]{3}[A-Za-z]?\b"), precaution_codes=_joined(r"\bP[0-9]{3}[A-Za-z]?\b"), signal_word=signal_word(_text()),
        hazard_category=rules.hazard_category(first, _text()), hazard_group=rules.hazard_group(first, _text()), target_organs=rules.found_terms(_text(), rules.TARGET_ORGANS),
    )


def flavour_profile(rows: DataFrame) -> DataFrame:
    """FEMA and JECFA numbers, GRAS, descriptors, and the same as flavour or odour terms where the text speaks of those."""
    terms = rules.found_terms(_text(), rules.DESCRIPTOR_TERMS)
    return _profile(
        rows, FLAVOUR, fema_number=F.nullif(F.regexp_extract(_text(), r"(?i)FEMA\D{0,20}?([0-9]{4})\b", 1), F.lit("")), jecfa_number=F.nullif(F.regexp_extract(_text(), r"(?i)JECFA\D{0,20}?([0-9]{1,4})\b", 1), F.lit("")),
        gras=F.when(_text().rlike(r"(?i)\bGRAS\b|Generally Recognized as Safe"), "GRAS"), descriptors=terms, flavours=F.when(_text().rlike("(?i)flavou?r|taste|aroma"), terms), odours=F.when(_text().rlike("(?i)odou?r|aroma|scent|smell"), terms),
    )


def label_profile(rows: DataFrame) -> DataFrame:
    """Routes, dosage forms, warning terms and boxed warnings of medicine labels."""
    return _profile(
        rows, LABEL, routes=rules.found_terms(_text(), rules.ROUTE_TERMS), dosage_forms=rules.found_terms(_text(), rules.DOSAGE_TERMS), warnings=rules.found_terms(_text(), rules.WARNING_TERMS), boxed_warning=_text().rlike("(?i)boxed warning|black box")
    )


def subject_profile(rows: DataFrame) -> DataFrame:
    """Tree numbers with the group of the first, and whether the text names an action."""
    first = F.nullif(F.regexp_extract(_text(), r"\b([A-Z][0-9]{2}(?:\.[0-9]+)+)\b", 1), F.lit(""))
    return _profile(rows, SUBJECT, tree_numbers=_joined(r"\b[A-Z][0-9]{2}(?:\.[0-9]+)+\b"), tree_group=rules.tree_group(first), is_action=_text().rlike("(?i)pharmacologic action|therapeutic|drug"))


def literature_profile(rows: DataFrame) -> DataFrame:
    """PubMed ids, DOIs and patents, and the kind of reference by the first of them present."""
    pmid, doi, patent = _joined(r"(?:PMID|PubMed):?\s*\d+"), _joined(r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"), _joined(r"\b(?:US|EP|WO|JP|CN)[0-9A-Z-]{5,}\b")
    return _profile(rows, LITERATURE, pubmed=pmid, doi=doi, patents=patent, kind=F.when(pmid.isNotNull(), "pubmed").when(doi.isNotNull(), "doi").when(patent.isNotNull(), "patent").otherwise("text"))


def natural_profile(rows: DataFrame) -> DataFrame:
    """Natural-product record, taxonomy id, ranks by label or name suffix, kingdom, and product classes."""
    ranks = {r: taxon_rank(_text(), r) for r in RANK_SUFFIXES}
    return _profile(
        rows, NATURAL, record=F.nullif(F.regexp_extract(_text(), r"\b(LTS[0-9]{7})\b", 1), F.lit("")), taxonomy_id=F.nullif(F.regexp_extract(_text(), r"(?i)taxonomy(?: id)?\D{0,5}([0-9]+)", 1), F.lit("")),
        family=ranks["family"], taxon_order=ranks["order"], kingdom=rules.ordered(_text(), rules.KINGDOM_RULES), product_classes=rules.found_terms(_text(), rules.NP_CLASS_TERMS),
    )


def bioactivities(assays: DataFrame) -> DataFrame:
    """Assay rows with class, direction, domain, target kind, organism, potency metric and bucket.

    ``assays``: query, aid, assay_name, activity_name, outcome, target_name, accession, gene, value, unit.
    """
    text = F.concat_ws("; ", "assay_name", "activity_name", "outcome", "target_name")
    has_target = non_empty(F.col("accession")).isNotNull() | non_empty(F.col("gene")).isNotNull()
    kind = F.when(text.rlike("(?i)cell line|nci-|hek|cho|hela|tumou?r|cancer"), "cell_line").when(has_target | text.rlike("(?i)receptor|enzyme|kinase|transporter|channel"), "protein_or_gene").otherwise("assay_target")
    value = rules.number(F.col("value"))
    return assays.select(
        "query", "aid", rules.activity_class(F.col("outcome"), F.lit(None)).alias("activity_class"), rules.activity_direction(text).alias("direction"), rules.bioactivity_domain(text, F.col("accession"), F.col("gene")).alias("domain"),
        kind.alias("target_kind"), rules.ordered(text, rules.ORGANISM_RULES).alias("organism"), F.when(value.isNotNull(), rules.potency_metric(F.col("activity_name"), F.col("assay_name"))).alias("metric"), rules.potency_bucket(value, F.col("unit")).alias("bucket"),
    )


def terms(tables: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """Long terms of several tables: (table with query, domain, columns); texts with several terms are split at ; and |."""
    out = None
    for df, domain, columns in tables:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("term_type"), F.col(c).cast("string").alias("raw")) for c in columns])).alias("p")
        part = df.select("query", F.lit(domain).alias("domain"), pairs).select("query", "domain", "p.term_type", F.explode(F.split("p.raw", r"\s*[;|]\s*")).alias("term_raw")).filter(non_empty(F.col("term_raw")).isNotNull())
        out = part if out is None else out.unionByName(part)
    clean, group, confidence = term_lookup(F.col("term_raw"))
    out = rules.hold(rules.hold(rules.hold(out.distinct(), term=clean), term_group=group), confidence=confidence)  # one after the other, as all in one would be too long to compile
    return out.select("query", "domain", "term_type", "term_raw", "term", "term_group", "confidence")


def pathway_rows(records: DataFrame, links: DataFrame, metadata: DataFrame) -> DataFrame:
    """Pathways of records from their own field and from links; a name in the metadata wins.

    ``records``: record, field, value (see flat_record_fields). ``links``: record, target_db, target_id.
    ``metadata``: id, name; reduced to one row per id.
    """
    ident = F.nullif(F.regexp_extract("value", r"\b((?:map|[a-z]{2,4})\d{5})\b", 1), F.lit(""))
    own = records.filter("field = 'PATHWAY'").select("record", ident.alias("id"), non_empty(F.regexp_replace("value", r"\b(?:map|[a-z]{2,4})\d{5}\b", "")).alias("own_name"), F.lit("record").alias("evidence"))
    linked = links.filter("target_db = 'pathway'").select("record", F.col("target_id").alias("id"), F.lit(None).cast("string").alias("own_name"), F.lit("link").alias("evidence"))
    names = metadata.filter("id is not null").groupBy("id").agg(F.min(non_empty(F.col("name"))).alias("meta_name"))
    out = own.unionByName(linked).join(names, "id", "left").withColumn("name", F.coalesce("meta_name", "own_name"))
    return out.select("record", "id", "name", rules.pathway_group(F.col("name")).alias("pathway_group"), "evidence").distinct()
