"""Peptide sequences, design candidates, and paths and clouds in latent spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import dot

#: Letters of amino acids that models know (fixed values).
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTUVYWZ"
LONGEST = 25


def residues(c: Column) -> Column:
    """The residues of a sequence text as upper-case tokens: header lines (>) are left out, commas and hyphens part; one run of letters is split. Null for no token."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith(">"))
    text = F.upper(F.regexp_replace(F.array_join(lines, " "), "[,-]", " "))
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    whole = F.when((F.size(tokens) == 1) & (F.length(F.element_at(tokens, 1)) > 1), F.split(F.element_at(tokens, 1), "")).otherwise(tokens)
    return F.when(F.size(tokens) > 0, F.filter(whole, lambda t: t != ""))


def normalized(c: Column) -> Column:
    """Residues joined by blanks; null for none."""
    return F.array_join(residues(c), " ")


def sequence_error(c: Column, longest: int = LONGEST) -> Column:
    """Why a sequence is no valid peptide, or null."""
    r = residues(c)
    unknown = F.array_sort(F.array_distinct(F.filter(r, lambda t: ~t.isin(*AMINO_ACIDS))))
    return (
        F.when(r.isNull(), "Peptide sequence must be a non-empty string.").when(F.size(unknown) > 0, F.concat(F.lit("Unsupported amino acid token(s): "), F.array_join(unknown, ", "), F.lit(".")))
        .when(F.size(r) > longest, F.format_string(f"Peptide sequence length %d exceeds max length {longest}.", F.size(r)))
    )


def properties(c: Column) -> Column:
    """A struct of length and composition (residue -> count) of a sequence."""
    r = residues(c)
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(r)), lambda t: F.struct(t, F.size(F.filter(r, lambda x: x == t)))))
    return F.struct(F.size(r).alias("length"), counts.alias("composition"))


def position_similarity(a: Column, b: Column) -> Column:
    """Equal residues at equal places over the longer length, to four decimals; null without residues."""
    x, y = residues(a), residues(b)
    same = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.coalesce(p["x"] == p["y"], F.lit(False))))
    return F.round(same / F.greatest(F.size(x), F.size(y)), 4)


def valid_unique(df: DataFrame, column: str, order: str, check=None) -> DataFrame:
    """Trimmed texts that are not empty and pass the check (a function of a column), each once, with their first place."""
    c = F.trim(column)
    rows = df.select(c.alias(column), F.col(order)).where(F.col(column).isNotNull() & (F.col(column) != ""))
    rows = rows.where(check(F.col(column))) if check else rows
    return rows.groupBy(column).agg(F.min(order).alias(order))


def distinct_candidates(df: DataFrame, key: str, valid: str, order: str) -> DataFrame:
    """Valid candidates once for each key, the first by order; those not valid or without a key all stay."""
    ok = F.coalesce(F.col(valid), F.lit(False)) & F.col(key).isNotNull()
    rest = [c for c in df.columns if c != key]
    first = df.where(ok).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])
    return first.unionByName(df.where(~ok))


def rank_candidates(df: DataFrame, valid: str, score: Column, order: str, limit: int | None = None) -> DataFrame:
    """Valid ones first, then by score (missing counts -1), ties by order."""
    out = df.withColumn("ranking_score", score).orderBy(F.desc(F.coalesce(F.col(valid), F.lit(False))), F.desc(F.coalesce("ranking_score", F.lit(-1.0))), F.asc(order))
    return out.limit(limit) if limit else out


def peptide_score(sequence: str, seed: str | None, score: str, prefer_shorter: bool = False) -> Column:
    """Similarity to a seed; without one the given score, and then, if shorter ones are preferred, one over the length."""
    own = F.col(score).cast("double")
    out = F.coalesce(position_similarity(F.col(sequence), F.lit(seed)), own) if seed else own
    return F.coalesce(out, 1 / F.size(residues(F.col(sequence)))) if prefer_shorter else out


def interpolate(a: Column, b: Column, steps: int, method: str = "linear") -> Column:
    """An array of steps + 2 vectors from a to b: linear, slerp (linear for nearly parallel ones) or tanh weights."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    mix = lambda u, v: F.zip_with(a, b, lambda x, y: u * x + v * y)
    omega = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))))

    def at(w: float) -> Column:
        if method == "linear":
            return mix(F.lit(1 - w), F.lit(w))
        if method == "tanh":
            t = (F.tanh(F.lit(w * 4 - 2)) + 1) / 2
            return mix(1 - t, t)
        if method == "slerp":
            bent = mix(F.sin((1 - w) * omega) / F.sin(omega), F.sin(w * omega) / F.sin(omega))
            return F.when(F.abs(omega) < 1e-6, mix(F.lit(1 - w), F.lit(w))).otherwise(bent)
        raise ValueError(f"unknown method {method!r}")

    return F.array(a, *[at(k / (steps + 1)) for k in range(1, steps + 1)], b)


def cloud(df: DataFrame, id_col: str, vector: str, n: int, scale: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, step, v): the vector itself as step 0 and n more with normal noise, the same for a seed however df is partitioned.

    The noise is that of Box and Muller on hashes of seed, id, step and place.
    """
    rows = df.select(id_col, F.col(vector).cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step"))

    def uniform(salt: int, i: Column) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(id_col), F.col("step"), i), F.lit(1 << 53)) + 0.5) / float(1 << 53)

    noisy = F.transform("v", lambda x, i: x + F.when(F.col("step") > 0, scale * F.sqrt(-2 * F.ln(uniform(1, i))) * F.cos(2 * F.pi() * uniform(2, i))).otherwise(0.0))
    return rows.select(id_col, "step", noisy.alias("v"))


def reconstruction(df: DataFrame, original: str, restored: str) -> DataFrame:
    """One row: rows, how many were restored exactly, and their share; a missing text is not restored."""
    hit = F.coalesce(F.col(original) == F.col(restored), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_restored"), F.avg(hit.cast("double")).alias("accuracy"))


def text_statistics(df: DataFrame, column: str, check=None) -> DataFrame:
    """One row over texts: how many, empty, valid, distinct, and the least, mean and greatest length of the valid ones."""
    c = F.trim(column)
    empty = c.isNull() | (c == "")
    ok = ~empty & (check(c) if check else F.lit(True))
    n = F.when(ok, F.length(c))
    return df.agg(F.count("*").alias("n"), F.count_if(empty).alias("n_empty"), F.count_if(ok).alias("n_valid"), F.count_distinct(F.when(ok, c)).alias("n_unique"), F.min(n).alias("shortest"), F.avg(n).alias("mean_length"), F.max(n).alias("longest"))
