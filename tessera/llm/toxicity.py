"""Toxicity: boosted trees over dense features of whole texts, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, small, trim
from .gbt import Trees, fit, isotonic

#: Insults and slurs against a person in the languages that we expect (fixed values).
LEXICON = (
    # English
    "asshole bastard bitch clown coward creep cretin crap cunt damn dick disgusting dumb dumbass fool freak fuck fucking garbage hate hideous "
    "idiot idiotic imbecile jerk kill liar loser lunatic maggot moron moronic pathetic pig prick psycho retard scum scumbag shit sick slut "
    "stupid suck trash twat ugly vermin whore worthless wretch "
    # German
    "abschaum arschloch blöd dreck dumm dummkopf fotze hurensohn idioten lügner mistkerl schlampe schwein trottel verlierer versager wichser "
    # French
    "abruti bâtard connard connasse crétin débile enculé imbécile merde minable ordure perdant pute salaud salope stupide "
    # Spanish
    "basura cabrón escoria estúpido gilipollas hijoputa idiota imbécil inútil mierda pendejo perdedor puta tonto "
).split()
#: Words for the person spoken to (fixed values).
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton vous votre tú tu usted ustedes vosotros".split()
#: Letters that digits and signs stand for (fixed values).
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

#: Labelled rows that training takes at most, those whose hash of doc_id is least.
MAX_TRAIN = 20_000
#: Folds of the cross-fits that calibrate.
FOLDS = 3
NEAR = 4

FEATURES = (
    "lexicon_words", "lexicon_density", "lexicon_kinds", "strong_words", "strong_density", "strong_kinds", "weak_words", "weak_density",
    "near_second_person", "second_person_density", "capital_rate", "shouted_rate", "exclamations", "questions",
    "punctuation_rate", "disguised_words", "masked_words", "stretched_words", "n_words",
)
LEXICAL, YOU, SHOUTED, DISGUISED, MASKED, STRETCHED, STRONG, WEAK = (1 << k for k in range(8))
#: Lengths of the word beginnings that may become marks beside whole words.
STEMS = (4, 5, 6)
#: Distinct words that a worker remembers; then it starts anew.
CACHE = 300_000

_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)
_STRETCH = re.compile(r"(\w)\1\1")


def stems(word: str):
    """A word's whole form and its beginnings (marked by a star)."""
    yield word
    for k in STEMS:
        if len(word) > k:
            yield word[:k] + "*"


class Featurizer(dict):
    """Word as written -> its classes, as bits; calling it gives the dense features of a text.

    Further pairs of mark lists may follow the first; every() gives the features by each
    of them for the cost of little more than one. Set k has the bits STRONG and WEAK, 2 k places higher.
    """

    def __init__(self, strong: list[str], weak: list[str], *more: tuple[list[str], list[str]]):
        super().__init__()
        self.lexicon, self.you = frozenset(LEXICON), frozenset(SECOND_PERSON)
        self.marks = [(frozenset(s), frozenset(w)) for s, w in ((strong, weak), *more)]

    def __missing__(self, word: str) -> int:
        found = _CORE.search(word)
        core = found[0] if found else ""
        low, bits = core.lower(), 0
        if low:
            own = [*stems(low)] if low.isalpha() else [low]
            bits |= LEXICAL * (low in self.lexicon) | YOU * (low in self.you)
            for k, (strong, weak) in enumerate(self.marks):
                bits |= (STRONG * any(x in strong for x in own) | WEAK * any(x in weak for x in own)) << 2 * k
            bits |= SHOUTED * (len(core) > 2 and core.isupper())
            squeezed = _STRETCH.sub(r"\1", low)
            plain = re.sub(r"[^\w]|_", "", low.translate(DISGUISE))
            bits |= STRETCHED * (squeezed != low)
            bits |= DISGUISED * (low not in self.lexicon and (squeezed in self.lexicon or plain in self.lexicon))
        bits |= MASKED * ("*" in word.strip("*"))
        self[word] = bits
        return bits

    def __call__(self, text: str | None) -> list[float]:
        """The features by the first pair of mark lists. Empty, wordless and null texts give zeros."""
        return self.every(text)[0]

    def every(self, text: str | None) -> list[list[float]]:
        words = (text or "").split()
        if not words:
            return [[0.0] * len(FEATURES) for _ in self.marks]
        if len(self) > CACHE:
            self.clear()
        n, size = len(words), len(text)
        bits = np.fromiter(map(self.__getitem__, words), np.uint32, n)
        at = lambda k: np.flatnonzero(bits & k)
        kinds = lambda places: len({words[i].lower() for i in places.tolist()})
        lexical, you = at(LEXICAL), at(YOU)
        shouted, disguised, masked, stretched = (len(at(k)) for k in (SHOUTED, DISGUISED, MASKED, STRETCHED))
        b = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        capitals, signs = int(b[65:91].sum()), int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
        out = []
        for k in range(len(self.marks)):
            strong, weak, near = at(STRONG << 2 * k), len(at(WEAK << 2 * k)), 0
            if len(you):
                bad = at(LEXICAL | DISGUISED | STRONG << 2 * k)
                first = np.searchsorted(you, bad - NEAR)
                near = int(np.count_nonzero((first < len(you)) & (you[np.minimum(first, len(you) - 1)] <= bad + NEAR)))
            out.append([
                len(lexical), len(lexical) / n, kinds(lexical), len(strong), len(strong) / n, kinds(strong), weak, weak / n,
                near, len(you) / n, capitals / size, shouted / n, int(b[33]) / n, int(b[63]) / n,
                signs / size, disguised, masked / n, stretched / n, n,
            ])
        return out


class Model:
    def __init__(self, marks: tuple[list[str], list[str]], trees: Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.marks, self.trees, self.knots = marks, trees, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the rows of docs that labels (doc_id, toxic) marks 0 or 1; labels of other folds are to be left out before.

    At most max_train labelled rows are learned from, the first by a hash of doc_id. A document
    labelled twice counts as toxic if any label says so; one that stands in docs twice
    is learned once, by its least text. The sample chooses the marking words and grows
    the trees. For the calibration that is done anew without each of FOLDS folds, marks
    included, and gives margins on rows that nothing was learned from; equal texts share
    a fold. Null and empty texts are learned like any other. Without any label every
    score is 0.
    """
    labelled = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).withColumnRenamed("doc_id", "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "y", "text")
    # words are counted and features made where the rows are: no text comes to the driver
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int")
    sample = materialize(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).withColumn("fold", fold), "sample")
    marks = marking_words(sample)
    got = _features(sample, marks, "doc_id", "y", "fold").select("y", "x", "doc_id", "fold").collect()
    got.sort(key=lambda r: r.doc_id)
    if not got:
        forget(sample)
        return Model(([], []), Trees(1, -50.0), (np.array([0.0]), np.array([0.0])))
    y, at = np.array([r.y for r in got], float), np.array([r.fold for r in got])
    margin = np.zeros(len(y))
    for k in np.unique(at).tolist():
        x = np.array([r.x[1 + k] for r in got])
        margin[at == k] = fit(x[at != k], y[at != k]).margin(x[at == k]) if (at != k).any() else 0.0
    forget(sample)
    return Model(marks[0], fit(np.array([r.x[0] for r in got]), y), isotonic(margin, y))


def _count_stems(batches):
    for b in small(batches, 1024):
        counts = [(Counter(), Counter()) for _ in range(FOLDS)]
        for y, fold, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            own = set()
            for w in set((text or "").split()):
                if (m := _CORE.search(w)) and m[0].isalpha():
                    own.update(stems(m[0].lower()))
            counts[fold][0 if y else 1].update(own)
        for fold, (inside, outside) in enumerate(counts):
            both = sorted(inside.keys() | outside.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(both, pa.string()), pa.array([fold] * len(both), pa.int32()), pa.array([inside[w] for w in both], pa.int64()), pa.array([outside[w] for w in both], pa.int64())], names=["w", "fold", "inside", "outside"]
            )


def marking_words(sample: DataFrame) -> list[tuple[list[str], list[str]]]:
    """(strong, weak) marks of label 1 among words and word beginnings of the sample (y, fold, text), copies counted once:
    first by all rows, then without each fold.

    A strong mark is hardly ever elsewhere, a weak one several times likelier in label 1;
    either stands in enough documents that chance would not put it there, so there are
    as many as the labelled sample bears out.
    """
    texts = sample.dropDuplicates(["y", "text"]).select("y", "fold", "text")
    n = {(r.y, r.fold): r["count"] for r in texts.groupBy("y", "fold").count().collect()}
    counts = texts.mapInArrow(_count_stems, "w string, fold int, inside long, outside long").groupBy("w").agg(
        *[F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(-1, FOLDS) for c in ("inside", "outside")]
    )
    ways = []
    for k in range(-1, FOLDS):
        n1, n0 = (sum(c for (y, fold), c in n.items() if y == side and fold != k) for side in (1, 0))
        inside, outside = F.col(f"inside{k}"), F.col(f"outside{k}")
        odds = F.log((inside + 0.5) / (n1 + 1)) - F.log((outside + 0.5) / (n0 + 1))
        strong = outside <= 0.05 * inside
        ways.append(F.when((inside >= max(8.0, 0.01 * n1)) & (odds > 1.5) & (strong | (inside >= 20)), F.when(strong, "s").otherwise("w")).otherwise("-"))
    found = counts.select("w", F.concat(*ways).alias("way")).where(F.translate("way", "-", "") != "").collect()
    pick = lambda k, mark: sorted(r.w for r in found if r.way[k] == mark)
    return [(pick(k, "s"), pick(k, "w")) for k in range(FOLDS + 1)]


def _features(docs: DataFrame, marks: list[tuple[list[str], list[str]]], *keep: str) -> DataFrame:
    """The columns to keep, and x: the features by each pair of mark lists."""

    def run(batches):
        make = Featurizer(*marks[0], *marks[1:])
        for b in small(batches):
            x = [make.every(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(x, pa.list_(pa.list_(pa.float64())))], names=[*keep, "x"])
        make.clear()
        trim()

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kinds}, x array<array<double>>")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text), repeated rows and null ids included. Null, empty and wordless texts score as texts without any feature."""

    def run(batches):
        make = Featurizer(*model.marks)
        for b in small(batches):
            x = np.array([make(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])
        make.clear()
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id):
    """Whether the crc32 of the id as text is divisible by five; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents; null and empty texts have a score too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    out = scores(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def below(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below limit; null and empty texts are scored like any other."""

    text = docs.columns.index("text")

    def run(batches):
        make = Featurizer(*model.marks)
        for b in small(batches):
            x = np.array([make(t) for t in b.column(text).to_pylist()], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) < limit))
        make.clear()
        trim()

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
