"""Deterministic column rules: ordered classifiers, bins, scores, units and measurements.

All of them are Catalyst expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import non_empty, squish


def ordered(text: Column, rules: Iterable[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The value of the first rule whose pattern is found in the text (case ignored); null text gives ``otherwise``."""
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for pattern, value in reversed(list(rules)):
        out = F.when(text.rlike("(?i)" + pattern), F.lit(value)).otherwise(out)
    return out


def number(c: Column) -> Column:
    """A number, or null where the text is none."""
    return F.trim(c.cast("string")).try_cast("double")


def binned(value: Column, limits: list[tuple[float, str]], last: str, closed: bool = False) -> Column:
    """The first bin whose limit the value is below (``closed``: not above); null stays null."""
    out = F.lit(last)
    for limit, name in reversed(limits):
        out = F.when((value <= limit) if closed else (value < limit), name).otherwise(out)
    return F.when(value.isNotNull(), out)


# --- compound level bins -------------------------------------------------------------------------


def mw_bin(mw: Column) -> Column:
    return binned(mw, [(150, "small_<150_Da"), (350, "medium_150_350_Da"), (750, "large_350_750_Da")], "very_large_>=750_Da")


def polarity_bin(tpsa: Column) -> Column:
    return binned(tpsa, [(40, "low_TPSA_<40"), (90, "moderate_TPSA_40_90")], "high_TPSA_>=90")


def lipophilicity_bin(xlogp: Column) -> Column:
    return binned(xlogp, [(0, "hydrophilic_XLogP_<0"), (3, "balanced_XLogP_0_3"), (5, "lipophilic_XLogP_3_5")], "highly_lipophilic_XLogP_>=5")


def volatility_proxy(mw: Column, tpsa: Column, hbd: Column) -> Column:
    light = (mw < 200) & (tpsa < 60) & (hbd.isNull() | (hbd <= 1))
    value = F.when(light, "more_volatile_proxy").when((mw < 350) & (tpsa < 90), "moderate_volatile_proxy").otherwise("less_volatile_proxy")
    return F.when(mw.isNotNull() & tpsa.isNotNull(), value)


def formula_has(formula: Column, symbol: str) -> Column:
    """Whether an element stands in a formula with a count or at its end.

    A single atom followed by another element is not seen, as documented for this rule.
    """
    return F.coalesce(formula.rlike(f"({symbol})([0-9]|$)"), F.lit(False))


#: Monoisotopic masses.
ATOM_MASSES = {"C": 12.0, "H": 1.00782503207, "N": 14.0030740048, "O": 15.99491461956, "S": 31.972071, "P": 30.97376163, "Cl": 34.96885268, "F": 18.99840322, "Br": 78.9183371}


def formula_mass(formula: Column) -> Column:
    """Exact mass of a plain formula such as C11H16O9; null without a formula or with unknown elements."""
    pieces = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?[0-9]*)"), 1)
    masses = F.create_map(*[x for k, v in ATOM_MASSES.items() for x in (F.lit(k), F.lit(v))])
    count = lambda p: F.coalesce(F.regexp_extract(p, "([0-9]+)$", 1).try_cast("double"), F.lit(1.0))
    total = F.aggregate(pieces, F.lit(0.0), lambda acc, p: acc + masses[F.regexp_extract(p, "^([A-Z][a-z]?)", 1)] * count(p))
    return F.when(formula.rlike("^([A-Z][a-z]?[0-9]*)+$"), F.round(total, 6))


def taxonomic_breadth(kingdoms: Column, families: Column, genera: Column, organisms: Column) -> Column:
    return (
        F.when(organisms < 1, "none")
        .when(kingdoms > 1, "multi_kingdom")
        .when(families > 1, "multi_family")
        .when(genera > 1, "multi_genus")
        .when(organisms > 1, "multi_species_same_genus")
        .otherwise("single_organism")
    )


def compound_confidence(cid: Column, formula: Column, mw: Column, mass: Column, sources: Column, pathways: Column, reactions: Column, enzymes: Column, safety: Column, activity: Column) -> Column:
    """Additive confidence of a compound profile, at most 1."""

    def part(cond: Column, weight: float) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))

    score = part(cid.isNotNull(), 0.25) + part(non_empty(formula).isNotNull(), 0.1) + part(mw.isNotNull(), 0.1) + part(mass.isNotNull(), 0.1)
    score = score + F.least(F.coalesce(sources, F.lit(0)), F.lit(5)) * 0.05
    score = score + part(pathways > 0, 0.1) + part(reactions > 0, 0.05) + part(enzymes > 0, 0.05) + part(safety, 0.05) + part(activity, 0.05)
    return F.round(F.least(score, F.lit(1.0)), 2)


CONFIDENCE_LEVELS = ("high", "medium", "low")


def confidence_rank(c: Column) -> Column:
    """3 high, 2 medium, 1 low, 0 anything else."""
    v = F.lower(squish(c))
    return F.when(v == "high", 3).when(v == "medium", 2).when(v == "low", 1).otherwise(0)


def best_confidence(c: Column) -> Column:
    """Aggregate: the best confidence word of a group, null without one."""
    r = F.max(confidence_rank(c))
    return F.when(r == 3, "high").when(r == 2, "medium").when(r == 1, "low")


def confidence_threshold(level: str | float | None) -> float:
    """A threshold from a word or a number, within 0..1."""
    words = {"high": 0.90, "medium": 0.65, "low": 0.35}
    if isinstance(level, str) and level.strip().lower() in words:
        return words[level.strip().lower()]
    try:
        return max(0.0, min(float(level), 1.0))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.0


# --- measurements --------------------------------------------------------------------------------

_NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
#: Property names by the first pattern found.
PROPERTY_RULES = (
    ("molecularweight|molecular weight", "molecular_weight"), ("exactmass|exact mass", "exact_mass"), ("monoisotopic", "monoisotopic_mass"), ("xlogp|logp|log kow|logkow", "logp"),
    ("tpsa|polar surface", "tpsa"), ("complexity", "complexity"), ("charge", "charge"), ("hbonddonor|hydrogen bond donor", "h_bond_donor_count"),
    ("hbondacceptor|hydrogen bond acceptor", "h_bond_acceptor_count"), ("rotatable", "rotatable_bond_count"), ("heavyatom|heavy atom", "heavy_atom_count"), ("boiling", "boiling_point"),
    ("melting", "melting_point"), ("flash", "flash_point"), ("vapor|vapour", "vapor_pressure"), ("density", "density"), ("solubility", "solubility"), (r"\bpka\b", "pka"), ("henry", "henrys_law_constant"),
)
#: Unit spellings.
UNIT_SPELLINGS = {
    "C": ("c", "deg c", "degree c", "degrees c", "celsius"), "F": ("f", "deg f", "fahrenheit"), "K": ("k", "kelvin"), "Da": ("da", "g/mol", "amu"),
    "A^2": ("a^2", "angstrom^2", "angstrom2", "å^2"), "g/mL": ("g/ml", "g cm-3", "g/cm3", "g/cc"), "kg/m3": ("kg/m3", "kg m-3"), "mg/L": ("mg/l", "mg/liter", "mg/litre"),
    "g/L": ("g/l", "g/liter", "g/litre"), "mg/mL": ("mg/ml",), "ug/mL": ("ug/ml", "µg/ml", "mcg/ml"), "mg/kg": ("mg/kg", "mg kg-1"), "ug/kg": ("ug/kg", "µg/kg", "mcg/kg"),
    "g/kg": ("g/kg",), "Pa": ("pa",), "kPa": ("kpa",), "mmHg": ("mmhg", "torr"), "atm": ("atm",), "count": ("count",),
}
#: Property -> class.
CLASS_OF = {
    "mass": ("molecular_weight", "exact_mass", "monoisotopic_mass"), "temperature": ("boiling_point", "melting_point", "flash_point"), "density": ("density",),
    "solubility": ("solubility",), "vapor_pressure": ("vapor_pressure",), "descriptor": ("logp", "pka", "tpsa", "complexity", "charge"), "toxicity": ("ld50", "lc50", "ec50", "ic50"),
}
#: Class -> standard unit and the factors (or offsets, for temperatures) of other units.
CONVERSIONS = {
    "density": ("g/mL", {"kg/m3": 0.001}),
    "solubility": ("mg/L", {"g/L": 1000.0, "mg/mL": 1000.0}),
    "vapor_pressure": ("Pa", {"kPa": 1000.0, "mmHg": 133.322, "atm": 101325.0}),
    "toxicity": ("mg/kg", {"ug/kg": 0.001, "g/kg": 1000.0}),
}


def clean_label(c: Column) -> Column:
    """Lower case, underscores to spaces, other signs than letters, digits and + . / - to spaces, squished."""
    s = F.regexp_replace(F.lower(squish(c)), "_+", " ")
    return squish(F.regexp_replace(s, r"[^a-z0-9+./ -]+", " "))


def property_name(c: Column) -> Column:
    return F.when(non_empty(c).isNotNull(), ordered(c, PROPERTY_RULES, clean_label(c)))


def unit_name(c: Column) -> Column:
    """The standard spelling of a unit; unknown units stay as they are, without degree signs."""
    cleaned = squish(F.replace(c, F.lit("°"), F.lit("")))
    named = lookup(F.lower(cleaned), {x: name for name, spellings in UNIT_SPELLINGS.items() for x in spellings})
    return F.when(cleaned != "", F.coalesce(named, cleaned))


def measurement_value(c: Column) -> Column:
    """The first number of a text."""
    return F.nullif(F.regexp_extract(squish(c), f"({_NUMBER})", 1), F.lit("")).try_cast("double")


def measurement_unit(c: Column) -> Column:
    """What follows the first number, up to a separator or bracket."""
    return non_empty(F.regexp_extract(squish(c), rf"{_NUMBER}\s*([^,;|()]*)", 1))


def range_bounds(c: Column) -> tuple[Column, Column]:
    """The lower and the upper number of a text such as "3 - 7" or "3 to 7"."""
    pattern = rf"(?i)({_NUMBER})\s*(?:-|to)\s*({_NUMBER})"
    a, b = (F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("double") for i in (1, 2))
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


def value_relation(c: Column) -> Column:
    low, _ = range_bounds(c)
    return (
        F.when(c.isNull() | (squish(c) == ""), "equal")
        .when(low.isNotNull(), "range")
        .when(c.rlike("<=|≤"), "less_or_equal")
        .when(c.rlike(">=|≥"), "greater_or_equal")
        .when(c.contains("<"), "less_than")
        .when(c.contains(">"), "greater_than")
        .when(F.lower(c).rlike(r"~|approx|about|ca\."), "approximate")
        .otherwise("equal")
    )


def measurement_class(prop: Column) -> Column:
    named = lookup(prop, {p: kind for kind, members in CLASS_OF.items() for p in members})
    return F.coalesce(named, F.when(prop.rlike("count$"), "count").otherwise("measurement"))


def standard_value(prop: Column, value: Column, unit: Column) -> Column:
    """The value in the standard unit of its class."""
    kind = measurement_class(prop)
    factors = F.create_map(*[F.lit(x) for k, (_, units) in CONVERSIONS.items() for u, factor in units.items() for x in (f"{k}|{u}", factor)])
    scaled = value * F.coalesce(factors[F.concat_ws("|", kind, unit)], F.lit(1.0))
    degrees = F.when(unit == "F", F.round((value - 32) * 5 / 9, 4)).when(unit == "K", F.round(value - 273.15, 4)).otherwise(value)
    return F.when(kind == "temperature", degrees).otherwise(scaled)


def standard_unit(prop: Column, value: Column, unit: Column) -> Column:
    units = {k: u for k, (u, _) in CONVERSIONS.items()} | {"temperature": "C", "mass": "Da"}
    special = F.when(prop == "tpsa", "A^2").when(prop.rlike("count$|charge"), "count")
    return F.when(value.isNotNull(), F.coalesce(special, lookup(measurement_class(prop), units), unit))


#: Property -> (limits with bins, last bin, whether limits are included).
BEHAVIOR_BINS = {
    "boiling_point": ([(100, "highly_volatile_boiling_point_lt_100_C"), (200, "volatile_boiling_point_100_200_C"), (300, "semi_volatile_boiling_point_200_300_C")], "low_volatility_boiling_point_ge_300_C"),
    "melting_point": ([(25, "liquid_or_low_melting_lt_25_C"), (100, "low_melting_25_100_C"), (200, "moderate_melting_100_200_C")], "high_melting_ge_200_C"),
    "flash_point": ([(23, "highly_flammable_flash_point_lt_23_C"), (60, "flammable_flash_point_23_60_C"), (93, "combustible_flash_point_60_93_C")], "higher_flash_point_ge_93_C"),
    "solubility": ([(10, "low_solubility_lt_10_mg_L"), (1000, "moderate_solubility_10_1000_mg_L")], "high_solubility_ge_1000_mg_L"),
    "vapor_pressure": ([(1, "low_vapor_pressure_lt_1_Pa"), (1000, "moderate_vapor_pressure_1_1000_Pa")], "high_vapor_pressure_ge_1000_Pa"),
}


def behavior_bin(prop: Column, value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (limits, last) in BEHAVIOR_BINS.items():
        out = F.when(prop == name, binned(value, limits, last)).otherwise(out)
    size = F.when(value < 200, "small_molecule_lt_200_Da").when(value <= 500, "drug_like_size_200_500_Da").otherwise("large_molecule_gt_500_Da")
    dense = F.when(value < 0.8, "low_density_lt_0_8_g_mL").when(value <= 1.2, "water_like_density_0_8_1_2_g_mL").otherwise("high_density_gt_1_2_g_mL")
    acute = binned(value, [(50, "very_high_acute_toxicity_le_50_mg_kg"), (300, "high_acute_toxicity_50_300_mg_kg"), (2000, "moderate_acute_toxicity_300_2000_mg_kg")], "lower_acute_toxicity_gt_2000_mg_kg", True)
    lipo = F.when(value < 0, "hydrophilic_logp_lt_0").when(value <= 3, "balanced_logp_0_3").when(value <= 5, "lipophilic_logp_3_5").otherwise("highly_lipophilic_logp_gt_5")
    out = F.when(prop.isin(*CLASS_OF["mass"]), size).when(prop == "density", dense).when(prop == "ld50", acute).when(prop == "logp", lipo).otherwise(out)
    return F.when(value.isNotNull(), out)


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once: the one-element explode keeps Catalyst from inlining them everywhere they are used."""
    parts = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(parts)).alias("__fl_held")).select(*[f"`{c}`" for c in df.columns], *[F.col(f"__fl_held.{n}").alias(n) for n in columns])


def standardize_measurements(df: DataFrame, prop: Column, value: Column, unit: Column, text: Column) -> DataFrame:
    """Add property, unit, standard_value, standard_unit, kind, bin, relation, low and high of a measurement and its text."""
    out = hold(df, property=property_name(prop), unit=unit_name(unit), __fl_value=value, __fl_text=text)
    p, u, v = F.col("property"), F.col("unit"), F.col("__fl_value")
    low, high = range_bounds(F.col("__fl_text"))
    out = hold(out, kind=measurement_class(p), low=low, high=high)
    out = hold(out, standard_value=standard_value(p, v, u), standard_unit=standard_unit(p, v, u), relation=value_relation(F.col("__fl_text")))
    return out.withColumn("bin", behavior_bin(p, F.col("standard_value"))).drop("__fl_value", "__fl_text")


# --- annotation classifiers ----------------------------------------------------------------------

#: Pathway groups, the first pattern found wins.
PATHWAY_RULES = (
    ("glycolysis|gluconeogenesis|pentose|starch|sucrose|galactose|fructose|mannose|carbohydrate", "Carbohydrate metabolism"),
    ("lipid|fatty acid|arachidonic|glycerolipid|glycerophospholipid|sphingolipid|steroid|bile", "Lipid metabolism"),
    ("amino acid|alanine|aspartate|glutamate|lysine|tryptophan|tyrosine|phenylalanine|histidine|arginine|proline|glycine|serine|threonine|cysteine|methionine|valine|leucine|isoleucine", "Amino acid metabolism"),
    ("carbon fixation|methane|nitrogen|sulfur|oxidative phosphorylation", "Energy metabolism"),
    ("purine|pyrimidine|nucleotide", "Nucleotide metabolism"),
    ("cofactor|vitamin|porphyrin|folate|nicotinate|riboflavin|biotin|lipoic", "Cofactor and vitamin metabolism"),
    ("secondary metabolite|terpenoid|polyketide|phenylpropanoid|flavonoid|alkaloid", "Secondary metabolism"),
    ("xenobiotic|drug|cytochrome p450|dioxin|chloro|toluene|benzoate|polycyclic|ddt", "Xenobiotic metabolism"),
    ("signaling|hormone|neuroactive|synapse|inflammation", "Signaling and regulation"),
)
#: Terms looked for in label and flavour texts.
DESCRIPTOR_TERMS = (
    "citrus", "lemon", "orange", "lime", "floral", "rose", "green", "herbal", "mint", "pine", "woody", "earthy", "fruity", "berry", "apple", "banana", "sweet", "bitter", "sour", "fatty", "waxy", "spicy", "pepper", "smoky", "nutty", "almond", "vanilla", "phenolic", "sulfurous", "alliaceous", "camphor", "terpene", "fresh",
)
ROUTE_TERMS = (
    "oral", "intravenous", "topical", "inhalation", "subcutaneous", "intramuscular", "ophthalmic", "nasal", "transdermal", "rectal", "sublingual", "buccal", "intradermal", "epidural",
)
DOSAGE_TERMS = (
    "tablet", "capsule", "solution", "suspension", "injection", "cream", "ointment", "gel", "patch", "spray", "powder", "suppository", "syrup",
)
NP_CLASS_TERMS = (
    "alkaloid", "terpenoid", "terpene", "monoterpene", "sesquiterpene", "diterpene", "triterpene", "flavonoid", "phenylpropanoid", "polyketide", "peptide", "lipid", "steroid", "saponin", "coumarin", "lignan", "tannin",
)
WARNING_TERMS = ("contraindication", "adverse reaction", "boxed warning", "warning", "precaution", "interaction", "overdosage", "pregnancy", "carcinogenesis", "hypersensitivity")
#: Activity directions and domains, the first pattern found wins.
DIRECTION_RULES = (
    ("antagonist|inhibit|blocker|blockade", "inhibitor"), ("agonist", "agonist"), ("activator|activation|stimulat", "activator"), ("binding|binds?", "binding"),
    ("cytotoxic|toxicity|dead cells|viability|growth inhibition", "cell_viability"), ("substrate", "substrate"),
)
DOMAIN_RULES = (
    ("tumou?r|cancer|cell line|cytotoxic|viability|growth inhibition|nci-", "cell_viability_cytotoxicity"), ("antimicrobial|antibacterial|antifungal|parasite|malaria", "antimicrobial_parasitic"),
    ("kinase|jnk|mapk|phosphatase", "kinase_signaling"), ("receptor|agonist|antagonist|channel|transporter", "receptor_transporter"),
    ("enzyme|hydrolase|dehydrogenase|protease|oxidase|inhibitor", "enzyme_protein_target"), ("inflamm|cox|prostaglandin", "inflammation"),
)
HAZARD_TEXT_RULES = (("flammable|explosive|oxidiz", "physical_hazard"), ("aquatic|environment", "environmental_hazard"), ("toxic|harmful|irritat|corros|carcin", "health_hazard"))
HAZARD_GROUP_TEXT_RULES = (
    ("eye", "eye_damage_irritation"), ("skin|dermal", "skin_irritation_sensitization"), ("flammable", "flammability_reactivity"), ("toxic|harmful|fatal", "acute_toxicity"), ("aquatic", "aquatic_environmental_toxicity"),
)
KINGDOM_RULES = (("plantae|plant", "Plantae"), ("fungi|fungus", "Fungi"), ("bacteria|bacterium", "Bacteria"), ("animalia|animal", "Animalia"), ("archaea", "Archaea"))
ORGANISM_RULES = ((r"\bhuman\b|\bhek\b|\bhela\b|\bnci-", "human"), (r"\bmouse\b|\bmurine\b", "mouse"), (r"\brat\b", "rat"), ("bacteria|bacterial|escherichia|staphylococcus", "bacteria"))
TARGET_ORGANS = ("eye", "skin", "respiratory tract", "liver", "kidney", "central nervous system", "blood", "heart", "lung", "reproductive system")
TEST_SPECIES = ("rat", "mouse", "rabbit", "human", "fish", "daphnia", "dog")
#: Enzyme classes by the first digit of an EC number.
EC_CLASSES = {"1": "Oxidoreductases", "2": "Transferases", "3": "Hydrolases", "4": "Lyases", "5": "Isomerases", "6": "Ligases", "7": "Translocases"}
#: Groups of descriptor trees by their first letter.
TREE_GROUPS = {
    "A": "Anatomy", "B": "Organisms", "C": "Diseases", "D": "Chemicals and Drugs", "E": "Analytical Diagnostic and Therapeutic Techniques", "F": "Psychiatry and Psychology",
    "G": "Phenomena and Processes", "H": "Disciplines and Occupations", "I": "Anthropology Education Sociology and Social Phenomena", "J": "Technology Industry and Agriculture",
    "K": "Humanities", "L": "Information Science", "M": "Named Groups", "N": "Health Care", "V": "Publication Characteristics", "Z": "Geographicals",
}


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def hazard_category(code: Column, text: Column) -> Column:
    by_code = F.when(code.rlike("^H2"), "physical_hazard").when(code.rlike("^H3"), "health_hazard").when(code.rlike("^H4"), "environmental_hazard")
    return F.coalesce(by_code, ordered(text, HAZARD_TEXT_RULES))


def hazard_group(code: Column, text: Column) -> Column:
    by_code = (
        F.when(code.isin("H318", "H319"), "eye_damage_irritation")
        .when(code.isin("H315", "H317"), "skin_irritation_sensitization")
        .when(code.rlike("^H3[013]"), "acute_toxicity")
        .when(code.rlike("^H2[2-7]"), "flammability_reactivity")
        .when(code.rlike("^H4"), "aquatic_environmental_toxicity")
    )
    return F.coalesce(by_code, ordered(text, HAZARD_GROUP_TEXT_RULES))


def found_terms(text: Column, terms: Iterable[str]) -> Column:
    """Terms that stand in the text as whole words, in the order of the list, joined; null without any."""
    hits = F.filter(F.array(*[F.when(text.rlike(rf"(?i)\b{t}\b"), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return F.when(F.size(hits) > 0, F.array_join(hits, "; "))


def pathway_group(name: Column) -> Column:
    return F.when(non_empty(name).isNotNull(), ordered(name, PATHWAY_RULES, F.lit("Other KEGG pathway")))


def enzyme_class(ec: Column) -> Column:
    return lookup(F.regexp_extract(ec, r"^([0-9]+)\.", 1), EC_CLASSES)


def tree_group(tree_number: Column) -> Column:
    return lookup(F.upper(F.substring(F.trim(tree_number), 1, 1)), TREE_GROUPS)


def activity_class(outcome: Column, supplied: Column) -> Column:
    o, given = F.lower(squish(outcome)), non_empty(supplied)
    by_outcome = (
        F.when(o.isNull() | (o == ""), "unspecified").when(o.contains("inactive"), "inactive").when(o.contains("active"), "active").when(o.rlike("inconclusive|unspecified|not tested|probe"), "inconclusive").otherwise(clean_label(o))
    )
    return F.when(given.isNotNull() & (given != "unspecified"), given).otherwise(by_outcome)


def activity_direction(text: Column) -> Column:
    return ordered(text, DIRECTION_RULES)


def bioactivity_domain(text: Column, accession: Column, gene: Column) -> Column:
    has_target = non_empty(accession).isNotNull() | non_empty(gene).isNotNull()
    rest = F.when(has_target, "enzyme_protein_target").when(text.rlike("(?i)inflamm|cox|prostaglandin"), "inflammation").otherwise("general_bioassay")
    return F.when(non_empty(text).isNotNull() | has_target, ordered(text, DOMAIN_RULES[:5], rest))


def is_micromolar(unit: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(squish(unit)), "[µμ]", "u").isin("um", "u m", "u-m", "micromolar", "micromol/l"), F.lit(False))


def potency_bucket(value: Column, unit: Column) -> Column:
    um = binned(value, [(0.1, "sub_100_nM"), (1, "sub_1_uM"), (10, "1_to_10_uM"), (50, "10_to_50_uM")], "above_50_uM", True)
    return F.when(value.isNotNull(), F.when(is_micromolar(unit), um).otherwise("numeric_activity_value"))


def potency_metric(activity: Column, assay: Column) -> Column:
    text = F.concat_ws("; ", activity, assay)
    named = F.upper(F.regexp_extract(text, r"\b(IC50|EC50|AC50|GI50|LC50|Ki|Kd)\b", 1))
    return F.when(named != "", named).when(text.rlike("(?i)potency"), "potency").otherwise(non_empty(clean_label(activity)))
