"""Scalar functions as columns: units, activity labels, categories, vectors, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Molar factors of unit texts after normalization (fixed values).
MOLAR = {
    "m": 1.0, "mol/l": 1.0, "molar": 1.0, "mm": 1e-3, "millimolar": 1e-3, "um": 1e-6, "micromolar": 1e-6,
    "nm": 1e-9, "nanomolar": 1e-9, "pm": 1e-12, "picomolar": 1e-12,
}
#: Factors to nanomolar, in the order in which parts of a unit's text are tried (fixed values).
NANOMOLAR = {
    "nm": 1.0, "nanomolar": 1.0, "um": 1e3, "\u03bcm": 1e3, "micromolar": 1e3, "mm": 1e6, "millimolar": 1e6,
    "m": 1e9, "molar": 1e9, "pm": 1e-3, "picomolar": 1e-3,
}
#: Texts that mean active and inactive, and parts that do (fixed values).
ACTIVE = ("active", "act", "positive", "pos", "hit", "yes", "true", "1")
INACTIVE = ("inactive", "inact", "negative", "neg", "no", "false", "0", "non-active", "not active", "inconclusive")
INACTIVE_PARTS, ACTIVE_PARTS = ("inactive", "not active", "inconclusive"), ("active", "hit")


def no_nan(c: Column) -> Column:
    """NaN becomes null: there is one kind of missing value."""
    return F.when(F.isnan(c), None).otherwise(c)


def normalize_unit(c: Column) -> Column:
    """Lower case without blanks; both micro signs become u; empty becomes null."""
    text = F.lower(F.regexp_replace(F.trim(c), "\\s+", ""))
    return F.nullif(F.translate(text, "µμ", "uu"), F.lit(""))


def molar_factor(unit: Column) -> Column:
    """Factor of an exactly known unit; unknown units are null."""
    u, out = normalize_unit(unit), None
    for name, factor in MOLAR.items():
        out = F.when(u == name, factor) if out is None else out.when(u == name, factor)
    return out


def p_scale(value: Column, unit: Column) -> Column:
    """-log10 of a molar concentration; values of zero or less and unknown units are null."""
    molar = value.cast("double") * molar_factor(unit)
    return F.when(molar > 0, -F.log10(molar))


def to_nanomolar(value: Column, unit: Column) -> Column:
    """A concentration in nM: by the exact unit, else by the first known unit that holds the text or is held by it.

    The second rule takes any unit with an m in it for one of concentration; callers that
    want known units only use p_scale.
    """
    u = F.lower(F.trim(unit))
    out = None
    for name, factor in NANOMOLAR.items():
        out = F.when(u == name, factor) if out is None else out.when(u == name, factor)
    for name, factor in NANOMOLAR.items():
        out = out.when((u != "") & (u.contains(name) | F.lit(name).contains(u)), factor)
    return value.cast("double") * out


def parse_label(c: Column) -> Column:
    """'active', 'inactive' or null: exact texts first, then parts."""
    t = F.lower(F.trim(c.cast("string")))
    part = lambda parts: F.greatest(*[t.contains(p) for p in parts])
    return F.when(t.isin(*INACTIVE), "inactive").when(t.isin(*ACTIVE), "active").when(part(INACTIVE_PARTS), "inactive").when(part(ACTIVE_PARTS), "active")


def parse_comment(c: Column) -> Column:
    """'inactive' for a comment that holds no, inconclusive or inactive anywhere (also within words, as in unknown), else 'active'; null for null."""
    t = F.lower(c)
    return F.when(t.contains("no") | t.contains("inconclusive") | t.contains("inactive"), "inactive").when(c.isNotNull(), "active")


def normalize_category(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def number(c: Column) -> Column:
    """A text as a double; what is no number, NaN and infinities are null."""
    x = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def tanimoto(a: Column, b: Column) -> Column:
    """On vectors: dot / (aa + bb - dot); null if both are zero."""
    c = dot(a, b)
    return F.try_divide(c, dot(a, a) + dot(b, b) - c)


def dice(a: Column, b: Column) -> Column:
    return F.try_divide(2 * dot(a, b), dot(a, a) + dot(b, b))


def tversky(a: Column, b: Column, alpha: float = 0.5, beta: float = 0.5) -> Column:
    c = dot(a, b)
    return F.try_divide(c, c + alpha * (dot(a, a) - c) + beta * (dot(b, b) - c))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def tokens(c: Column) -> Column:
    """Search tokens of a text."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_:+.-]+)"), 1)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def rating(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.8, "good").when(score >= 0.7, "acceptable").otherwise("poor")


def keyword_pattern(keyword: str) -> str:
    """A keyword as an expression that allows a hyphen or blank where it holds one or a digit follows a letter.

    Up to three parts may also stand together; more need the separator. A keyword of one
    part is itself.
    """
    import re

    parts = [p for word in re.split(r"[-\s]+", keyword.strip()) for p in re.split(r"(?<=[A-Za-z])(?=[0-9])", word) if p]
    return ("[- ]?" if len(parts) <= 3 else "[- ]").join(re.escape(p) for p in parts)
