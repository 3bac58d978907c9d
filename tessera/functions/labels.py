"""Class labels: their order, codes and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of negative and positive labels (fixed values).
NEGATIVE = ("0", "false", "f", "no", "n", "inactive", "negative", "neg", "control")
POSITIVE = ("1", "true", "t", "yes", "y", "active", "positive", "pos")


def sort_labels(labels: list) -> list:
    """Two labels of known polarity with the negative one first; others by kind and then by text."""
    own = [x for x in dict.fromkeys(x.strip() if isinstance(x, str) else x for x in labels) if x not in (None, "")]
    side = {x: 0 if str(x).lower() in NEGATIVE else 1 if str(x).lower() in POSITIVE else None for x in own}
    if len(own) == 2 and set(side.values()) == {0, 1}:
        return sorted(own, key=side.get)
    return sorted(own, key=lambda x: (str(type(x)), str(x)))


def class_labels(df: DataFrame, column: str) -> list:
    """The labels of a column in their order; a label set is small."""
    c = F.nullif(F.trim(column), F.lit("")) if df.schema[column].dataType.simpleString() == "string" else F.col(column)
    return sort_labels([r[0] for r in df.select(c).distinct().collect()])


def encode(c: Column, labels: list) -> Column:
    """The place of a label from 0, null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(labels) for x in (str(v), k)]), F.trim(c.cast("string"))) if labels else F.lit(None).cast("int")


def decode(c: Column, labels: list) -> Column:
    """The label at a place, null outside."""
    k = c.cast("int")
    return F.when((k >= 0) & (k < len(labels)), F.element_at(F.array(*[F.lit(x) for x in labels]), F.greatest(k, F.lit(0)) + 1))


def prediction_frame(df: DataFrame, code: str, probabilities: str, labels: list) -> DataFrame:
    """df with label, code and the probability of each class, from codes and an array of probabilities."""
    return df.withColumns({"label": decode(F.col(code), labels), "code": F.col(code).cast("int"), **{f"probability_{x}": F.get(probabilities, F.lit(k)) for k, x in enumerate(labels)}})


def decide(c: Column) -> tuple[Column, Column]:
    """(0 or 1 at one half, the probability within 0 and 1); null for null and for texts that are no numbers."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("string").try_cast("double")))
    p = F.when(c.isNotNull() & c.cast("string").try_cast("double").isNotNull(), p)
    return (p >= 0.5).cast("int"), p


def parse_probabilities(c: Column, n: int | None = None) -> Column:
    """A JSON list of probabilities as an array; null if it is none, holds what is no finite number, or has another length than n."""
    a = F.from_json(c, "array<double>")
    ok = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok & ((F.size(a) == n) if n else F.lit(True)), a)


def json_safe(df: DataFrame) -> Column:
    """A row as JSON in which NaN and infinities are null."""
    fix = lambda f: F.when(~F.isnan(F.col(f"`{f.name}`")) & (F.abs(F.col(f"`{f.name}`")) < float("inf")), F.col(f"`{f.name}`")) if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`")
    return F.to_json(F.struct(*[fix(f).alias(f.name) for f in df.schema]), {"ignoreNullFields": "false"})


def parse_vector(c: Column, size: int | None = None) -> Column:
    """A vector written as a JSON list; null if it holds what is no finite number or has another size."""
    return parse_probabilities(c, size)
