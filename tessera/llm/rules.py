"""Quality rules: word statistics, and a decision list learned from labelled ones.

Everything over the corpus is DataFrame expressions. Learning looks at the statistics
of a bounded sample of labelled documents on the driver and emits an ordered CASE
expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_CLASS, SEPARATORS

#: Characters that count as symbols (fixed values).
SYMBOLS = "[#*$%&|<>]"
#: Labelled documents that learning takes at most, those whose hash of doc_id is least.
MAX_TRAIN = 20_000

#: What rules may test, from the statistics.
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "capital_rate", "mark_rate", "distinct_rate")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of FEATURES.

    Null, empty and wordless texts have zeros. The text itself is not kept.
    n_repeat_words: windows are compared by a 64-bit hash first; only where two agree
    are the windows themselves sorted, and those decide.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    other = [F.col(c) for c in docs.columns if c != text_col]
    df = docs.select(*other, text.alias("_text"))
    trimmed = F.btrim("_text", F.lit(SEPARATORS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SEPARATOR_CLASS}+"))
    df = df.withColumn("_w", words).withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("_chars", F.array_join("_w", "")).withColumn("word_chars", F.length("_chars").cast("long"))
    df = df.withColumn("n_symbols", (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    df = df.withColumn("_lines", lines).withColumn("_n_lines", F.size("_lines"))
    df = df.withColumn("n_dup_lines", (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # three hashes of single words make a window's: the words are hashed once each
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    last = F.col("n_words").cast("int") - 3
    windows = F.zip_with(
        F.zip_with(F.col("_h"), F.slice("_h", F.lit(2), F.greatest(F.size("_h") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)),
        F.slice("_h", F.lit(3), F.greatest(F.size("_h") - 2, F.lit(0))),
        lambda a, b: F.xxhash64(a, b),
    )
    df = df.withColumn("_k", F.when(last >= 0, F.slice(windows, F.lit(1), last + 1)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_clash", F.size(F.array_distinct("_k")) < F.size("_k"))
    # where windows clash: every window with its place, sorted, then those that equal a neighbour
    placed = F.array_sort(F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.struct(F.array_join(F.slice("_w", i, 3), " ").alias("g"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(F.col("_clash") & (last >= 0), placed)).drop("_h", "_k")
    g = F.col("_placed.g")
    same = F.zip_with(F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), g, lambda a, b: F.coalesce(a == b, F.lit(False)))
    df = df.withColumn("_same", F.when(F.col("_placed").isNotNull(), same))
    before = F.concat(F.array(F.lit(False)), F.slice("_same", F.lit(1), F.greatest(F.size("_placed") - 1, F.lit(0))))
    twice = F.zip_with(F.zip_with(F.col("_placed.i"), before, lambda i, b: F.struct(i.alias("i"), b.alias("b"))), F.col("_same"), lambda x, a: F.when(x["b"] | F.coalesce(a, F.lit(False)), x["i"]))
    covered = F.array_distinct(F.flatten(F.transform(F.filter(twice, lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2))))
    df = df.withColumn("n_repeat_words", F.when(F.col("_placed").isNotNull(), F.size(covered)).otherwise(0).cast("long"))
    per = lambda a, b: F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0)
    df = df.withColumn("_plain", F.length(F.regexp_replace("_chars", "[A-ZÀ-ÖØ-Þ]", ""))).withColumn("_marks", F.length(F.regexp_replace("_chars", "[!?]", "")))
    df = df.withColumns({
        "mean_word": per(F.col("word_chars"), "n_words"), "symbol_rate": per(F.col("n_symbols"), "n_words"), "dup_line_rate": per(F.col("n_dup_lines"), "_n_lines"),
        "repeat_rate": per(F.col("n_repeat_words"), "n_words"), "capital_rate": per(F.col("word_chars") - F.col("_plain"), "word_chars"),
        "mark_rate": per(F.col("word_chars") - F.col("_marks"), "n_words"), "distinct_rate": per(F.size(F.array_distinct("_w")), "n_words"),
    })
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Test, ...]


def _fires(rule: Rule, rows: list[dict]) -> list[dict]:
    for test in rule:
        rows = [r for r in rows if test.holds(r)]
    return rows


def _cuts(rows: list[dict], feature: str, most: int) -> list[float]:
    """Thresholds between the values if there are few, else `most` quantiles of them."""
    values = sorted({r[feature] for r in rows})
    if len(values) <= most:
        return [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    every = sorted(r[feature] for r in rows)
    return sorted({every[len(every) * k // (most + 1)] for k in range(1, most + 1)})


def _grow(rows: list[dict], longest: int, cuts: int) -> Rule:
    """Add the test of the greatest FOIL gain until the rule covers no clean document, nothing is gained, or it has `longest` tests."""
    rule: Rule = ()
    while len(rule) < longest:
        p0 = sum(r["low"] for r in rows)
        if p0 == 0 or p0 == len(rows):
            break
        base, best = math.log2(p0 / len(rows)), (1e-9, None)
        for feature in FEATURES:
            for cut in _cuts(rows, feature, cuts):
                for above in (True, False):
                    covered = [r["low"] for r in rows if (r[feature] > cut) == above]
                    p = sum(covered)
                    if p:
                        gain = p * (math.log2(p / len(covered)) - base)
                        if gain > best[0]:
                            best = (gain, Test(feature, above, float(cut)))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        rows = _fires((best[1],), rows)
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """The beginning of the rule that does best on rows it was not grown on: covered low less clean, over covered."""
    def worth(r: Rule) -> tuple[float, int]:
        covered = _fires(r, rows)
        p = sum(x["low"] for x in covered)
        return ((2 * p - len(covered)) / len(covered) if covered else -1.0, p)

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(rows: list[dict], precision: float = 0.97, most: int = 12, longest: int = 4, cuts: int = 24) -> list[Rule]:
    """An ordered list of rules for low quality (rows: FEATURES, low 0 or 1, fold), by sequential covering.

    The model has `most` rules at most, each of `longest` tests at most, whose thresholds
    are among `cuts` quantiles of a feature: these bound what a reader has to understand,
    and no row is left out of learning or judging for them.

    Folds 0 and 1 grow, fold 2 prunes. A rule stays if at least `precision` of what it
    covers among all remaining rows, and among the pruning ones if it covers any, is
    low; the first that fails ends the list. Without both classes the list is empty.
    """
    rules: list[Rule] = []
    while len(rules) < most and 0 < sum(r["low"] for r in rows) < len(rows):
        rule = _prune(_grow([r for r in rows if r["fold"] < 2], longest, cuts), [r for r in rows if r["fold"] == 2])
        covered = _fires(rule, rows) if rule else []
        held = [r for r in covered if r["fold"] == 2]
        if len(covered) < 5 or any(sum(r["low"] for r in c) < precision * len(c) for c in (covered, held) if c):
            break
        rules.append(rule)
        gone = {id(r) for r in covered}
        rows = [r for r in rows if id(r) not in gone]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """CASE WHEN first rule THEN false WHEN second ... ELSE true."""
    out = None
    for rule in rules:
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **options) -> list[Rule]:
    """Rules from labels (doc_id, quality 0 or 1): at most max_train labelled documents; options as learn() has them.

    A document labelled twice is low if any label says so; one that stands in docs twice
    is learned once, by its least text.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg((1 - F.min("quality")).alias("low"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select(F.col("doc_id").alias("labelled"), "low")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).groupBy("doc_id", "low").agg(F.min("text").alias("text"))
    rows = with_statistics(rows).select("doc_id", "low", *FEATURES, (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3).alias("fold"))
    return learn(sorted((r.asDict() for r in rows.collect()), key=lambda r: r["doc_id"]), **options)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    out = with_statistics(docs).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), False).otherwise(verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
