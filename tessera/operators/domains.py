"""Domains of applicability: support among neighbours, isolation forests, and their combination with bounding boxes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import similarity
from tessera.operators.frame import quantiles
from tessera.operators.schema import schema_hash

#: Neighbours and percentile of the support threshold (fixed values).
NEIGHBOURS, PERCENTILE = 5, 5.0
#: Trees of a forest and rows of each (fixed values of the method's authors).
TREES, SAMPLE = 100, 256


def valid(vector: str):
    """Whether a vector has no missing or non-finite component."""
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def support_threshold(train: DataFrame, id_col: str, vector: str, k: int = NEIGHBOURS, percentile: float = PERCENTILE, measure: str = "tanimoto") -> DataFrame:
    """One row: the percentile of the supports of the training rows among one another, each without itself."""
    near = similarity.neighbours(train.where(valid(vector)), id_col, vector, k, measure=measure)
    return quantiles(similarity.support(near, measure == "euclidean"), "support", {"threshold": percentile / 100}).select("threshold", F.col("n").alias("n_train"))


def score_support(df: DataFrame, train: DataFrame, id_col: str, vector: str, k: int = NEIGHBOURS, percentile: float = PERCENTILE, measure: str = "tanimoto") -> DataFrame:
    """(id, support, nearest, threshold, status) of every row: in domain if its mean similarity to the k nearest training rows reaches the threshold.

    Rows that are training rows themselves (by id) do not count as their own neighbours.
    """
    train = train.where(valid(vector))
    near = similarity.neighbours(train, id_col, vector, k, queries=df.where(valid(vector)), measure=measure)
    own = similarity.support(near, measure == "euclidean")
    out = df.select(id_col, valid(vector).alias("_ok")).join(own, F.col(id_col) == F.col("i"), "left").join(F.broadcast(support_threshold(train, id_col, vector, k, percentile, measure)))
    status = F.when(~F.col("_ok"), "invalid_features").when(F.col("support") >= F.col("threshold"), "in_domain").otherwise("out_of_domain")
    return out.select(id_col, "support", "nearest", "threshold", status.alias("status"))


def _path(n: float) -> float:
    """The mean path of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


class Forest:
    """An isolation forest: trees as arrays. decision is positive inside and negative outside, with the offset of one half."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = min(SAMPLE, len(x))
        depth = math.ceil(math.log2(max(2, self.size)))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], depth, rng) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, depth: int, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, length = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            at = len(feature)
            for column in (feature, cut, left, right, length):
                column.append(0)
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if level >= depth or len(rows) <= 1 or not len(open_):
                feature[at], length[at] = -1, level + _path(len(rows))
                return at
            f = int(rng.choice(open_))
            feature[at], cut[at] = f, rng.uniform(low[f], high[f])
            below = rows[:, f] < cut[at]
            left[at], right[at] = node(rows[below], level + 1), node(rows[~below], level + 1)
            return at

        node(x, 0)
        return np.array(feature), np.array(cut, float), np.array(left), np.array(right), np.array(length, float)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Minus the anomaly score of each row: -1 (alone) to 0."""
        total = np.zeros(len(x))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] < cut[node], left[node], right[node])
            total += length[at]
        return -(2.0 ** (-total / len(self.trees) / max(_path(self.size), 1e-9)))

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.score(x) + 0.5


def fit_forest(df: DataFrame, id_col: str, vector: str, trees: int = TREES, seed: int = 0) -> Forest:
    """A forest on the valid rows of df. A tree looks at SAMPLE rows, so TREES * SAMPLE rows at most, the first by a seeded hash, come to the driver: that bounds the sample of the model, not what is scored."""
    rows = df.where(valid(vector)).orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(trees * SAMPLE).select(vector).collect()
    if not rows:
        raise ValueError("no valid rows to fit a forest on")
    return Forest(np.array([r[0] for r in rows], float), trees, seed)


def score_forest(df: DataFrame, id_col: str, vector: str, forest: Forest) -> DataFrame:
    """(id, score, decision, status) of every row; a decision below 0 is out of domain."""
    own = df.sparkSession.sparkContext.broadcast(forest)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            column = b.column(1)
            ok = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
            score = np.full(b.num_rows, np.nan)
            if len(ok):
                score[ok] = own.value.score(np.array(column.take(pa.array(ok)).to_pylist(), float))
            found = pa.array(score, pa.float64(), mask=np.isnan(score))
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=[id_col, "score"])

    out = df.select(id_col, F.col(vector).cast("array<double>").alias("v"), valid(vector).alias("ok")).mapInArrow(run, f"`{id_col}` {kind}, score double")
    decision = F.col("score") + 0.5
    status = F.when(F.col("score").isNull(), "invalid_features").when(decision < 0, "out_of_domain").otherwise("in_domain")
    return out.select(id_col, "score", decision.alias("decision"), status.alias("status"))


class Domain:
    """All methods fitted on the same training rows, with the names of their features."""

    METHODS = ("bounding_box", "isolation_forest", "similarity_matrix")

    def __init__(self, train: DataFrame, id_col: str, vector: str, names: list[str], methods: tuple[str, ...] = METHODS, measure: str = "tanimoto", seed: int = 0):
        self.train, self.id, self.vector, self.names, self.methods, self.measure = train, id_col, vector, list(names), tuple(methods), measure
        self.hash = schema_hash(self.names)
        self.box = similarity.fit_box(train, vector) if "bounding_box" in methods else None
        self.forest = fit_forest(train, id_col, vector, seed=seed) if "isolation_forest" in methods else None

    def score(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """(id, status, methods_out, and each method's status and measure) of every row of df.

        Other feature names than those fitted on are a schema mismatch for all rows. Of the
        methods' statuses the gravest counts: mismatch, invalid, out, in.
        """
        if names is not None and schema_hash(list(names)) != self.hash:
            return df.select(self.id, F.lit("schema_mismatch").alias("status"), F.lit("").alias("methods_out"))
        out, statuses = df.select(self.id), {}
        if self.box is not None:
            s = similarity.score_box(df, self.id, self.vector, self.box, self.names)
            s = s.select(F.col(self.id).alias("_b"), F.col("status").alias("bounding_box_status"), "violations", "violating", F.col("worst").alias("max_excess"))
            out, statuses["bounding_box"] = out.join(s, F.col(self.id) == F.col("_b"), "left").drop("_b"), "bounding_box_status"
        if self.forest is not None:
            s = score_forest(df, self.id, self.vector, self.forest).select(F.col(self.id).alias("_f"), F.col("status").alias("isolation_forest_status"), F.col("score").alias("isolation_forest_score"))
            out, statuses["isolation_forest"] = out.join(s, F.col(self.id) == F.col("_f"), "left").drop("_f"), "isolation_forest_status"
        if "similarity_matrix" in self.methods:
            s = score_support(df, self.train, self.id, self.vector, measure=self.measure).select(F.col(self.id).alias("_s"), F.col("status").alias("similarity_status"), "support", "nearest", "threshold")
            out, statuses["similarity_matrix"] = out.join(s, F.col(self.id) == F.col("_s"), "left").drop("_s"), "similarity_status"
        known = {m: F.coalesce(F.col(c), F.lit("invalid_features")) for m, c in statuses.items()}
        gone = F.concat_ws(";", *[F.when(c == "out_of_domain", m) for m, c in known.items()])
        return out.withColumns({"status": similarity.combine_status(*known.values()), "methods_out": gone})
