"""Fit and transform operators on pyspark.ml: standardization, PCA, clusters, gradient-boosted trees."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by population deviation; columns without spread become null."""
    moments = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.join(F.broadcast(moments))
    return out.withColumns({f"{c}_z": F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}).drop(*moments.columns)


def pca(df: DataFrame, vector: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(df with `projected`, explained shares)."""
    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(data)
    return model.transform(data).withColumn("projected", vector_to_array("_p")).drop("_v", "_p"), [float(x) for x in model.explainedVariance]


def clusters(df: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(data).transform(data).drop("_v")


class Boosted:
    """Gradient-boosted trees with fit and predict apart: a regressor, a classifier of two classes, or for more classes a forest of trees.

    Categories are coded by the order in which training first shows them; unseen ones are -1.
    """

    def __init__(self, features: list[str], target: str, task: str = "regression", categories: list[str] | None = None, seed: int = 0, rounds: int = 10, depth: int = 4):
        self.features, self.target, self.task, self.categories, self.seed, self.rounds, self.depth = list(features), target, task, list(categories or []), seed, rounds, depth

    def _vectors(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.categories:
            out = out.withColumn(f"_c_{c}", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in self.codes[c].items() for x in (k, v)]), F.trim(F.col(c).cast("string"))), F.lit(-1)) if self.codes[c] else F.lit(-1))
        names = [f"_c_{c}" if c in self.categories else c for c in self.features]
        return VectorAssembler(inputCols=names, outputCol="_v", handleInvalid="keep").transform(out.withColumns({c: F.col(c).cast("double") for c in names}))

    def fit(self, df: DataFrame, order: str | None = None) -> "Boosted":
        rows = df.where(F.col(self.target).isNotNull())
        #: codes of each category, in the order of first sight; categories are few
        self.codes = {}
        for c in self.categories:
            seen = rows.where(F.trim(F.col(c).cast("string")) != "").groupBy(F.trim(F.col(c).cast("string")).alias("v")).agg(F.min(order or c).alias("o")).orderBy("o", "v").collect()
            self.codes[c] = {r.v: k for k, r in enumerate(seen)}
        if self.task == "regression":
            self.labels = None
            self.model = GBTRegressor(featuresCol="_v", labelCol="_y", predictionCol="_p", maxIter=self.rounds, maxDepth=self.depth, seed=self.seed).fit(self._vectors(rows).withColumn("_y", F.col(self.target).cast("double")))
            return self
        from tessera.functions.labels import sort_labels

        self.labels = sort_labels([r[0] for r in rows.select(F.col(self.target)).distinct().collect()])
        if len(self.labels) < 2:
            raise ValueError("two classes are needed")
        code = F.create_map(*[F.lit(x) for k, v in enumerate(self.labels) for x in (v, float(k))])
        data = self._vectors(rows).withColumn("_y", F.element_at(code, F.col(self.target)))
        kind = GBTClassifier(maxIter=self.rounds, maxDepth=self.depth, seed=self.seed) if len(self.labels) == 2 else RandomForestClassifier(numTrees=5 * self.rounds, maxDepth=2 * self.depth, seed=self.seed)
        self.model = kind.setFeaturesCol("_v").setLabelCol("_y").setPredictionCol("_p").setProbabilityCol("_s").fit(data)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction; for classes with prediction_code and the probability of each class."""
        out = self.model.transform(self._vectors(df))
        drop = ["_v", "_p", "_s", "rawPrediction", *[f"_c_{c}" for c in self.categories]]
        if self.task == "regression":
            return out.withColumn("prediction", F.col("_p")).drop(*drop)
        shares = vector_to_array("_s")
        return out.withColumns({
            "prediction_code": F.col("_p").cast("int"), "prediction": F.element_at(F.array(*[F.lit(x) for x in self.labels]), F.col("_p").cast("int") + 1),
            **{f"probability_{x}": shares[k] for k, x in enumerate(self.labels)},
        }).drop(*drop)


def boosted(df: DataFrame, features: list[str], target: str, seed: int = 0, rounds: int = 10) -> DataFrame:
    """df with the prediction of trees fitted on it."""
    return Boosted(features, target, seed=seed, rounds=rounds).fit(df).predict(df)


def several_targets(df: DataFrame, features: list[str], targets: list[str], seed: int = 0) -> DataFrame:
    """A model for each target, each on the rows that have it; predictions as prediction_<target>."""
    out = df
    for t in targets:
        out = Boosted(features, t, seed=seed).fit(df).predict(out).withColumnRenamed("prediction", f"prediction_{t}")
    return out


def study(df: DataFrame, features: list[str], target: str, trials: list[dict], folds: str, seed: int = 0) -> list[dict]:
    """Trials of parameters (rounds, depth) with their mean rmse over the folds of a column, best first; a trial that fails has None."""
    out = []
    for k, params in enumerate(trials):
        errors = []
        for r in df.select(folds).distinct().orderBy(folds).collect():
            held = F.col(folds).eqNullSafe(F.lit(r[0]))
            model = Boosted(features, target, seed=seed, **params).fit(df.where(~held))
            errors.append(model.predict(df.where(held)).agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col("prediction"), 2)))).first()[0])
        known = [e for e in errors if e is not None and e == e]
        out.append({"trial": k, "parameters": params, "rmse": sum(known) / len(known) if len(known) == len(errors) and known else None})
    return sorted(out, key=lambda t: (t["rmse"] is None, t["rmse"] or 0.0, t["trial"]))


def refit_without(df: DataFrame, selected: DataFrame, key: str, features: list[str], target: str, seed: int = 0) -> Boosted:
    """A model on the rows that were not selected as outliers."""
    from tessera.operators.outliers import remaining

    return Boosted(features, target, seed=seed).fit(remaining(df, selected, key))


def external(model: Boosted, df: DataFrame, domain=None, vector: str | None = None, id_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics) on other data; with a domain also status by row and metrics by status."""
    from tessera.operators import metrics

    out = model.predict(df)
    if domain is not None:
        out = out.join(domain.score(df).select(F.col(id_col).alias("_i"), F.col("status").alias("ad_status")), F.col(id_col) == F.col("_i"), "left").drop("_i")
        return out, metrics.by_status(out, "ad_status", model.target, "prediction")
    how = metrics.regression if model.task == "regression" else metrics.classification
    return out, how(out, model.target, "prediction")


def campaign(df: DataFrame, candidates: dict[str, dict], target: str, split: str = "split", seed: int = 0) -> list[dict]:
    """For each candidate (features and parameters) the r2 and rmse on test rows of a model fitted on train rows, ranked: best r2 first, missing last."""
    import time

    from tessera.operators import metrics

    out = []
    for name, c in candidates.items():
        began = time.time()
        model = Boosted(c["features"], target, seed=seed, **c.get("parameters", {})).fit(df.where(F.col(split) == "train"))
        took = time.time() - began
        r = metrics.regression(model.predict(df.where(F.col(split) == "test")), target, "prediction").first()
        out.append({"candidate_id": name, "r2": r.r2 if r else None, "rmse": r.rmse if r else None, "train_time_s": took})
    return sorted(out, key=lambda x: (x["r2"] is None, -(x["r2"] or 0.0), x["train_time_s"]))
