"""Column functions for the value rules that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no value" (besides null and blank).
MISSING_WORDS = ("unknown", "unspecified", "not_reported", "not reported", "na", "none")
#: Texts that count as true.
TRUTHY_WORDS = ("true", "t", "yes", "y", "1", "present", "high", "medium")
#: The narrower list of true texts that pair tables accept.
YES_WORDS = ("yes", "true", "1")
#: Greek letters and their spelled names.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi",
    "ρ": "rho", "σ": "sigma", "ς": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}

#: The white space of Unicode.
SPACES = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_PATTERN = r"[^\p{L}\p{Nd}]+"


def squish(c: Column) -> Column:
    """White space collapsed to single spaces, outer white space removed."""
    return F.trim(F.regexp_replace(c, r"[\s\pZ]+", " "))


def non_empty(c: Column) -> Column:
    """The squished value, null when nothing is left."""
    s = squish(c.cast("string"))
    return F.when(s != "", s)


def known(c: Column) -> Column:
    """True where a value is neither blank nor one of the missing words."""
    s = F.lower(squish(c.cast("string")))
    return F.coalesce((s != "") & ~s.isin(*MISSING_WORDS), F.lit(False))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(squish(c.cast("string"))).isin(*TRUTHY_WORDS), F.lit(False))


def is_yes(c: Column) -> Column:
    return F.coalesce(F.lower(squish(c.cast("string"))).isin(*YES_WORDS), F.lit(False))


def yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit("Yes")).otherwise(F.lit("No"))


def first_non_empty(*cs: Column) -> Column:
    return F.coalesce(*[non_empty(c) for c in cs])


def key_value(c: Column) -> Column:
    """A key part in which a missing value is a value of its own."""
    return F.coalesce(squish(c.cast("string")), F.lit("<NA>"))


def label(c: Column) -> Column:
    """A label compared without case and outer spaces; null when blank."""
    s = F.lower(F.btrim(c, F.lit(SPACES)))
    return F.when(s != "", s)


def word_list(c: Column) -> Column:
    """The longest runs of letters and digits, lower-cased; an empty array for null and blank."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), WORD_PATTERN, " ")), " ")
    return F.filter(parts, lambda w: w != "")


def words_key(c: Column) -> Column:
    """The words in sorted order, joined: equal exactly where two values have the same words; '' without words."""
    return F.array_join(F.array_sort(word_list(c)), " ")


def has_words(c: Column) -> Column:
    """Whether a value has any word; cheaper than its key, for filters that are pushed below the key's projection."""
    return F.coalesce(c.rlike(r"[\p{L}\p{Nd}]"), F.lit(False))


def slug(c: Column) -> Column:
    """Letters and digits kept, every other run one underscore, outer underscores removed."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")


def feature_key(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + "__"), F.lower(slug(c)))


def collapse_sorted(c: Column, sep: str = "; ") -> Column:
    """Aggregate: distinct non-empty values in sorted order, joined; null without values."""
    joined = F.array_join(F.array_sort(F.collect_set(non_empty(c))), sep)
    return F.when(joined != "", joined)


def count_distinct_non_empty(c: Column) -> Column:
    return F.countDistinct(non_empty(c))


def spell_greek(c: Column) -> Column:
    """Greek letters of a lower-cased text written as their names."""
    for letter, name in GREEK.items():
        c = F.replace(c, F.lit(letter), F.lit(name))
    return c
