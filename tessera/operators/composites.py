"""Operators that are made of others: retrieval, cleaning, curation, cliffs, landscapes, prediction and ensembles, each one lazy plan but where a step has to be written."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import molecules
from tessera.functions.registry import BACKENDS, REPRESENTATIONS
from tessera.functions.scalars import number, parse_comment, tanimoto
from tessera.operators import activity, curation, ensemble, evaluation, frame, maps, metrics, schema, sequences, session, similarity, splits, structures
from tessera.plans.storage import materialize

for _name, (_kernel, _kind) in molecules.KERNELS.items():
    structures.register(_name, _kernel, _kind)
for _name in ("circular", "circular_counts", "descriptors"):
    REPRESENTATIONS.register(_name, _name)


def retrieve_compounds(assays: DataFrame, targets: DataFrame, activities: DataFrame, keywords: list[str], organism: str | None = None, kinds: list[str] | None = None, mechanism: str | None = None, record: str = "activity_id") -> DataFrame:
    """Activities of the assays that any keyword finds, each record once with the sorted keywords that found it."""
    from tessera.sources import readers

    found = None
    for k in keywords:
        own = readers.retrieve(assays, targets, k, organism)
        own = own.where(F.lower("description").contains(mechanism.lower())) if mechanism else own
        rows = readers.activities_of(activities, own, kinds).withColumn("_keyword", F.lit(k))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    names = found.groupBy(F.col(record).alias("_r")).agg(F.array_join(F.array_sort(F.collect_set("_keyword")), "|").alias("query_keywords"))
    one = frame.stable_first(found, [record], sorted(c for c in found.columns if c != record))
    return one.drop("_keyword").join(names, F.col(record) == F.col("_r")).drop("_r")


def standardized(df: DataFrame, column: str, name: str = "smiles", kernel: str = "standardize") -> DataFrame:
    """df with the standardized structure and the error of those that have none."""
    return df.withColumn("_s", structures.apply(kernel, F.col(column))).withColumns({name: F.col("_s.value"), f"{name}_error": F.col("_s.error")}).drop("_s")


def clean(df: DataFrame, order: str, metadata: list[str] | None = None, kernel: str = "standardize") -> tuple[DataFrame, DataFrame]:
    """(compounds, summary): rows with a structure merged by its standard form, with activity statistics or labels and unions of metadata; and counters."""
    mapping = schema.infer(df)
    raw = mapping.smiles_column
    if raw is None:
        raise ValueError("no structure column")
    own = df.withColumnRenamed(raw, "_raw") if raw == "smiles" else df.withColumn("_raw", F.col(raw))
    if mapping.activity_kind:
        own = own.withColumn("_activity", schema.activity(mapping))
    own = materialize(standardized(own, "_raw", "_std", kernel), "standardized")
    summary = curation.standardization_summary(own, "_raw", "_std")
    rows = own.where("_std is not null")
    if mapping.activity_kind == "classification":
        out = curation.merge_labels(rows, "_std", "_activity")
    elif mapping.activity_kind:
        out = curation.merge_compounds(rows, "_std", "_activity", [], order)
    else:
        out = rows.groupBy("_std").agg(F.count("*").alias("source_row_count"))
    for c in metadata or []:
        tokens = curation.distinct_tokens(rows, ["_std"], c, order, curation.plural(c)).withColumnRenamed("_std", "_k")
        out = out.join(tokens, F.col("_std") == F.col("_k"), "left").drop("_k")
    return out.withColumnRenamed("_std", "smiles"), summary


def curate(df: DataFrame, task: str, smiles: str, target: str, order: str, conflict: float = 0.5, kernel: str = "standardize") -> tuple[DataFrame, DataFrame]:
    """(rows, report): valid structures with a target, duplicates resolved (means of regression targets that agree, or equal labels); and how many rows were there, failed, had no target, and are left."""
    own = df.withColumn("_raw", F.col(smiles)).drop(smiles)
    own = standardized(own, "_raw", smiles, kernel).drop("_raw")
    value = number(F.col(target).cast("string")) if task == "regression" else F.nullif(F.trim(F.col(target).cast("string")), F.lit(""))
    own = materialize(own.withColumn(target, value), "curated")
    ok = own.where(F.col(smiles).isNotNull() & F.col(target).isNotNull()).drop(f"{smiles}_error")
    resolve = curation.resolve_regression_duplicates(ok, [smiles], [target], conflict, [order]) if task == "regression" else curation.resolve_label_duplicates(ok, [smiles], target, [order])
    out = materialize(resolve, "resolved")
    failed = F.count_if(F.col(smiles).isNull())
    report = own.agg(F.count("*").alias("n_rows"), failed.alias("n_failed"), F.count_if(F.col(smiles).isNotNull() & F.col(target).isNull()).alias("n_without_target"), F.count_distinct(F.when(F.col(target).isNotNull(), F.col(smiles))).alias("n_identities"))
    left = out.agg(F.count("*").alias("n_curated"), F.coalesce(F.sum(F.when(F.col("n_rows") > 1, 1).otherwise(0)), F.lit(0)).alias("n_merged"))
    return out, report.join(F.broadcast(left)).withColumn("n_conflicts", F.col("n_identities") - F.col("n_curated"))


def fingerprints(df: DataFrame, smiles: str, name: str = "vector", representation: str = "circular", folder: str | None = None) -> DataFrame:
    """df with the vector of a registered representation, null for structures that have none; with a folder, kept there by a hash of representation and frame and read again."""
    kernel = REPRESENTATIONS.get(representation)
    out = df.withColumn(name, structures.apply(kernel, F.col(smiles))["value"])
    if folder is None:
        return out
    key = frame.fingerprint(df.select(smiles)).first().fingerprint
    path = f"{folder.rstrip('/')}/{representation}-{key}-{hashlib.sha256(json.dumps(sorted(df.columns)).encode()).hexdigest()[:8]}"
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cliff_context(df: DataFrame, id_col: str, vector: str, target: str, threshold: float = 0.7, k: int = 5, flag: float = 0.5, index: str = "sali", loops: int = 3, measure: str = "min_max") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(rows with index, tier, reasons and justification; variants without the tiers that are removed loop by loop)."""
    found = similarity.cliff_index(index)(df, id_col, vector, target, threshold, k=k, flag=flag, measure=measure)
    own = similarity.reasons(similarity.tiers(found, "norm", "flagged", id_col)).withColumnRenamed(id_col, "_id")
    out = materialize(df.join(own, F.col(id_col) == F.col("_id")).drop("_id"), "cliffs")
    return out, splits.feedback_variants(out, "tier", loops)


def landscapes(df: DataFrame, id_col: str, responsibilities: DataFrame, threshold: float = 0.0, target: str | None = None, molecule: str | None = None) -> dict[str, DataFrame]:
    """The regression and class landscapes that a dataset bears out: activity by its mapping; classes from raw measurements where there are any, filled up from comments, else from labels."""
    mapping, out = schema.infer(df), {}
    if mapping.activity_kind == "regression":
        out["regression"] = maps.regression_landscape(responsibilities, schema.with_activity(df, mapping, "_a"), id_col, "_a", threshold)
    labelled = None
    if {"standard_type", "standard_value", "standard_units"} <= set(df.columns):
        labelled = activity.classify(df, molecule or id_col, target).withColumnRenamed("label", "_l")
        if "activity_comment" in df.columns:
            labelled = labelled.withColumn("_l", F.coalesce("_l", parse_comment(F.col("activity_comment"))))
    elif mapping.activity_kind == "classification":
        labelled = schema.with_activity(df, mapping, "_l")
    if labelled is not None and labelled.where("_l is not null").select("_l").distinct().count() > 1:
        out["classification"] = maps.class_landscape(responsibilities, labelled, id_col, "_l", ["active", "inactive"])
    if not out:
        raise ValueError("no activity to lay out: a p-scale, potencies with units, labels or raw measurements are needed")
    return out


def load_map(df: DataFrame, id_col: str, vector: str, model: maps.Map, k: int = 10) -> dict[str, DataFrame]:
    """A dataset on a map: points, responsibilities, density and how well neighbours are preserved."""
    points, r = maps.project(df, id_col, vector, model)
    return {"points": points, "responsibilities": r, "density": maps.density(r), "preservation": maps.preservation(df, points, id_col, vector, k)}


def predict_rows(df: DataFrame, model, order: list[str], backend: str = "trees") -> DataFrame:
    """df with the new columns of a model's prediction."""
    out = BACKENDS.get(backend).predict(model, df)
    return out.select(*df.columns, *[c for c in out.columns if c not in df.columns])


def predict_structures(spark, smiles: list[str], model, representation: str = "descriptors", backend: str = "trees") -> DataFrame:
    """Predictions for a list of structures, with their place; structures without descriptors have none."""
    rows = spark.createDataFrame(list(enumerate(smiles)), "position int, smiles string")
    found = rows.withColumn("_d", structures.apply(REPRESENTATIONS.get(representation), F.col("smiles"))["value"])
    flat = found.select("position", "smiles", "_d.*") if representation == "descriptors" else found
    ok = flat.where(F.col("weight").isNotNull()) if representation == "descriptors" else flat.where("_d is not null")
    said = BACKENDS.get(backend).predict(model, ok).select(F.col("position").alias("_p"), "prediction")
    return rows.join(said, F.col("position") == F.col("_p"), "left").drop("_p")


def ensemble_predict(df: DataFrame, models: dict, id_col: str, task: str = "regression", backend: str = "trees") -> DataFrame:
    """Each row with its components' predictions and what they come to: median, mean, deviation and range, or the vote and its share."""
    out = df
    for name, m in models.items():
        out = BACKENDS.get(backend).predict(m, out).withColumnRenamed("prediction", f"component_{name}")
        out = out.drop(*[c for c in out.columns if c == "prediction_code" or c.startswith("probability_")])
    names = [f"component_{n}" for n in models]
    own = ensemble.regression(out, id_col, names) if task == "regression" else ensemble.vote(out, id_col, names)
    return out.join(own.withColumnRenamed(id_col, "_i"), F.col(id_col) == F.col("_i"), "left").drop("_i")


def evaluate_ensemble(df: DataFrame, models: dict, id_col: str, target: str) -> DataFrame:
    """Metrics of each component and of the ensemble's median."""
    out = ensemble_predict(df, models, id_col)
    names = [f"component_{n}" for n in models]
    return evaluation.component_metrics(out.withColumnRenamed("median", "ensemble"), target, [*names, "ensemble"])


def scaffold_counts(df: DataFrame, smiles: str, limit: int = 50) -> DataFrame:
    """The commonest scaffolds with how many rows have them; ties by key."""
    keys = df.select(structures.apply("scaffold", F.col(smiles))["value"].alias("scaffold")).where("scaffold is not null")
    return keys.groupBy("scaffold").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc("scaffold")).limit(limit)


def scaffold_split(df: DataFrame, smiles: str, sizes: dict[str, float]) -> DataFrame:
    """Whole scaffolds dealt to splits; rows without one are one group."""
    keyed = df.withColumn("scaffold", F.coalesce(structures.apply("scaffold", F.col(smiles))["value"], F.lit("NO_SCAFFOLD")))
    return splits.group_split(materialize(keyed, "scaffolds"), "scaffold", sizes)


def valid_unique_structures(df: DataFrame, column: str, order: str) -> DataFrame:
    """Valid structures once each, with their first place."""
    return sequences.valid_unique(df, column, order, lambda c: structures.apply("valid", c)["value"])


def seed_similarity(df: DataFrame, smiles: str, seed: str, radius: int = 2) -> DataFrame:
    """df with the similarity of each structure to a seed, to four decimals; null for those that have none."""
    own = F.array(*[F.lit(x) for x in molecules.circular(seed, radius)])
    vector = structures.apply("circular", F.col(smiles))["value"]
    return df.withColumn("_v", vector).withColumn("seed_similarity", F.round(tanimoto(F.col("_v"), own), 4)).drop("_v")


def candidates_from(spark, engine, seed: str | None, n: int, set_id: str) -> DataFrame:
    """An engine's proposals checked, without repeats, ranked and registered: the rejected ones with their reason."""
    rows = [(k, str(c.get("smiles") or ""), c.get("score"), c.get("rationale")) for k, c in enumerate(engine.propose(seed, n))]
    df = spark.createDataFrame(rows, "position int, original string, score double, rationale string")
    checked = standardized(df, "original", "smiles", "largest_fragment").withColumn("valid", F.col("smiles").isNotNull())
    one = materialize(sequences.distinct_candidates(checked, "smiles", "valid", "position"), "candidates")
    return session.register_candidates(one, "smiles", "valid", "position", set_id).withColumn("engine", F.lit(engine.name))


def truth_by_split(df: DataFrame, split: str, y: str, p: str) -> DataFrame:
    """Regression metrics of one run by split."""
    return metrics.regression(df, y, p, [split])
