"""Row splits: exact counts, groups kept whole, repeated folds, and their checks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import materialize


def normalize_sizes(sizes: list[float]) -> dict[str, float]:
    """train, val and test (or train and test) from two or three parts, scaled to one; a validation part of zero is left out."""
    if len(sizes) not in (2, 3) or sum(sizes) <= 0:
        raise ValueError("sizes are [train, test] or [train, val, test] with a positive sum")
    parts = [float(x) / sum(sizes) for x in sizes]
    if parts[0] <= 0 or parts[-1] <= 0 or min(parts) < 0:
        raise ValueError("train and test are positive, and no part is negative")
    if len(parts) == 2 or parts[1] == 0:
        return {"train": parts[0], "test": parts[-1]}
    return dict(zip(("train", "val", "test"), parts, strict=True))


def target_counts(n: int, sizes: dict[str, float]) -> dict[str, int]:
    """Half-even rounding for all but the first split, which gets the rest. None may be empty of several rows."""
    names = list(sizes)
    out = {k: round(n * sizes[k]) for k in names[1:]}
    return {names[0]: n - sum(out.values())} | out


def exact_split(df: DataFrame, key: list[str], sizes: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds `split` with exact counts: rows in the order of a seeded hash.

    The cut points are values of the hash at two ranks; they are found by an ordered
    limit on hashes of bounded width, then applied by comparison, so that rows are not
    gathered for a global number.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    marked = df.withColumn("_h", F.struct(h.alias("h"), *[F.col(k) for k in key]))
    counts = target_counts(df.count(), sizes)
    from tessera.operators.frame import with_row_id

    numbered = with_row_id(marked, ["_h"], "_n")
    at, out = 0, None
    for name, n in counts.items():
        at += n
        out = F.when(F.col("_n") < at, name) if out is None else out.when(F.col("_n") < at, name)
    return numbered.withColumn("split", out).drop("_h", "_n")


def folds(df: DataFrame, key: list[str], k: int, repeats: int = 1, seed: int = 0) -> DataFrame:
    """Adds repeat and fold: in each repeat rows are dealt to k folds whose sizes differ by one at most."""
    from tessera.operators.frame import with_row_id

    out = None
    for r in range(repeats):
        h = F.struct(F.xxhash64(F.lit(seed), F.lit(r), *[F.col(c) for c in key]).alias("h"), *[F.col(c) for c in key])
        one = with_row_id(df.withColumn("_h", h), ["_h"], "_n").withColumn("repeat", F.lit(r)).withColumn("fold", F.pmod("_n", F.lit(k)).cast("int")).drop("_h", "_n")
        out = one if out is None else out.unionByName(one)
    return out


def dealt(sizes: list[tuple[int, int]], want: dict[str, int]) -> list[list[int]]:
    """For (size, number of groups) from the largest size: how many groups of that size each split gets.

    As if each group went to the split that is furthest below its share without passing
    it, else to the one it passes least. Groups of a size are dealt in bulk up to a common
    level of all splits, and only the few that remain one by one.
    """
    names, have, out = list(want), dict.fromkeys(want, 0), []
    for n, count in sizes:
        room = {s: max(0, want[s] - have[s]) // n for s in names}

        def upto(level):
            return {s: min(room[s], max(0, math.ceil((level * want[s] - have[s]) / n))) for s in names}  # noqa: B023

        low, high = 0.0, 1.0
        for _ in range(60):
            level = (low + high) / 2
            low, high = (level, high) if sum(upto(level).values()) <= count else (low, level)
        got = upto(low)
        for s in names:
            have[s] += got[s] * n
        for _ in range(count - sum(got.values())):
            best = min(names, key=lambda s: (max(0, have[s] + n - want[s]) * 10_000 + have[s] / max(1, want[s]), names.index(s)))  # noqa: B023
            got[best] += 1
            have[best] += n
        out.append([got[s] for s in names])
    return out


def group_split(df: DataFrame, group: str, sizes: dict[str, float]) -> DataFrame:
    """Adds `split`, whole groups at a time: by size from the largest, each to the split that is furthest below its share.

    Only the counts of groups by size come to the driver (sizes, not groups); the groups of
    a size take their split by rank, and the assignment is written and joined by shuffle.
    """
    from tessera.operators.frame import with_row_id

    groups = materialize(df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_c")), "groups")
    rows = groups.groupBy("_c").agg(F.count("*").alias("k")).orderBy(F.desc("_c")).collect()
    shares = dealt([(r[0], r[1]) for r in rows], target_counts(sum(r[0] * r[1] for r in rows), sizes))
    cuts, at = [], 0
    for r, share in zip(rows, shares, strict=True):
        cuts.append((r[0], [at + sum(share[: k + 1]) for k in range(len(share))]))
        at += r[1]
    cuts = df.sparkSession.createDataFrame(cuts, "_s long, _cuts array<long>")
    ranked = with_row_id(groups.withColumn("_o", -F.col("_c")), ["_o", "_g"], "_n").join(F.broadcast(cuts), F.col("_c") == F.col("_s"))
    split = None
    for k, name in enumerate(sizes):
        below = F.col("_n") < F.col("_cuts")[k]
        split = F.when(below, name) if split is None else split.when(below, name)
    chosen = materialize(ranked.select("_g", "_c", split.alias("split")), "chosen")
    # a split that got no group takes the smallest group of the largest split
    got = {r[0]: r[1] for r in chosen.groupBy("split").agg(F.sum("_c")).collect()}
    for name in [s for s in sizes if s not in got and len(got)]:
        donor = max(got, key=got.get)
        least = chosen.where(F.col("split") == donor).agg(F.min(F.struct("_c", "_g")).alias("m"), F.count("*").alias("k")).first()
        if least.k < 2:
            raise ValueError(f"there are too few groups for {list(sizes)}")
        chosen = chosen.withColumn("split", F.when(F.col("_g").eqNullSafe(F.lit(least.m["_g"])), name).otherwise(F.col("split")))
        got[donor], got[name] = got[donor] - least.m["_c"], least.m["_c"]
    return df.join(chosen, F.col(group).eqNullSafe(F.col("_g"))).drop("_g", "_c")


def check_split(df: DataFrame, key: list[str], split: str) -> DataFrame:
    """Counts by split, with how many keys stand in more than one."""
    per_key = df.groupBy(*key).agg(F.min(split).alias("a"), F.max(split).alias("b"))
    shared = per_key.where("a <> b").agg(F.count("*").alias("shared_keys"))
    return df.groupBy(split).agg(F.count("*").alias("n")).crossJoin(shared)


def kfold_by_order(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Folds by position in a given order (no randomness)."""
    from tessera.operators.frame import with_row_id

    return with_row_id(df, order, "_n").withColumn("fold", F.pmod("_n", F.lit(k)).cast("int")).drop("_n")



def outer_folds(df: DataFrame, key: list[str], k: int, repeats: int = 1, seed: int = 0, outer: float = 0.0) -> DataFrame:
    """repeat, fold and split (train, val or test) of every row for every fold: a fixed outer test shared by all, the others dealt to folds.

    One row for each row, repeat and fold, so that a run is a filter.
    """
    from tessera.operators.frame import with_row_id

    n = df.count()
    n_test = round(n * outer)
    if n - n_test < k or k < 2 or repeats < 1 or (outer and not 0 < n_test < n):
        raise ValueError("too few rows for the folds and the outer test")
    h = F.struct(F.xxhash64(F.lit(seed), F.lit("outer"), *[F.col(c) for c in key]).alias("h"), *[F.col(c) for c in key])
    placed = materialize(with_row_id(df.withColumn("_h", h), ["_h"], "_n").drop("_h"), "outer")
    test, rest = placed.where(F.col("_n") < n_test).drop("_n"), placed.where(F.col("_n") >= n_test).drop("_n")
    own = folds(rest, key, k, repeats, seed).withColumnRenamed("fold", "_own")
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    inner = own.withColumn("fold", every).withColumn("split", F.when(F.col("fold") == F.col("_own"), "val").otherwise("train")).drop("_own")
    runs = test.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("fold", every).withColumn("split", F.lit("test"))
    return inner.unionByName(runs)


def final_split(df: DataFrame, key: str, train: DataFrame | None = None, test: DataFrame | None = None) -> DataFrame:
    """Rows of the last fit: test by key if given, train by key or all others. Overlapping keys, keys without rows and an empty train are errors."""
    marked = df
    for name, part in (("_train", train), ("_test", test)):
        own = part.select(F.col(key).alias("_k"), F.lit(True).alias(name)).distinct() if part is not None else None
        if own is not None and not own.join(df, F.col("_k") == F.col(key), "left_anti").isEmpty():
            raise ValueError("a key does not belong to the rows")
        marked = marked.join(own, F.col(key) == F.col("_k"), "left").drop("_k") if own is not None else marked.withColumn(name, F.lit(None).cast("boolean"))
    if not marked.where("_train and _test").isEmpty():
        raise ValueError("train and test overlap")
    split = F.when(F.col("_test"), "test").when(F.col("_train") if train is not None else F.lit(True), "train")
    out = marked.withColumn("split", split).drop("_train", "_test").where("split is not null")
    if out.where("split = 'train'").isEmpty():
        raise ValueError("no row is left to train on")
    return out


def split_hash(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """One row: 16 hex digits that depend on which keys are in which split alone, not on their order; sums of hashes, so no list of keys is built."""
    h = F.xxhash64(F.col(split), F.col(key))
    parts = df.groupBy(split).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", split, "n", "s", "x"))), ",")
    return parts.agg(F.substring(F.sha2(text, 256), 1, 16).alias("split_hash"))


#: Range of seeds (fixed values).
LEAST_SEED, MOST_SEED = 1, 2_147_483_647


def replay_seeds(count: int, base: int) -> list[int]:
    """base and further distinct seeds that follow from it."""
    import random

    rng, out = random.Random(base), [base]
    while len(out) < count:
        seed = rng.randint(LEAST_SEED, MOST_SEED)
        if seed not in out:
            out.append(seed)
    return out


def seed_policy(templates: list[dict], base: int | None = None, policy: dict | None = None) -> dict:
    """Seeds of all split runs and of the model: those of a given policy, or from a base seed, which is drawn if there is none."""
    import secrets

    if policy and policy.get("split_runs"):
        return {"mode": "user_provided_or_replay", **policy}
    if not templates:
        raise ValueError("there is no split run")
    mode = "generated_per_run" if base is None else "user_provided_or_replay"
    base = base if base is not None else secrets.randbelow(MOST_SEED) + 1
    seeds = replay_seeds(len(templates) + 1, base)
    runs = [{**t, "seed": s, "label": t.get("label") or (f"random_seed_{s}" if t.get("split_type") == "random" else t.get("split_type", "split"))} for t, s in zip(templates, seeds, strict=False)]
    return {"mode": mode, "base_seed": base, "split_runs": runs, "model_seed": seeds[-1]}


#: How a family of splits is dealt, and what may be said of each kind of strategy (fixed values).
FAMILIES = {"random": "random", "scaffold": "scaffold_balanced", "cluster": "kmeans"}
FIELDS = {
    "holdout": {"type", "split_family", "split_sizes", "seed"}, "repeated_holdout": {"type", "split_family", "split_sizes", "seed", "n_repeats"},
    "cross_validation": {"type", "split_family", "n_folds", "n_repeats", "outer_test_size", "seed", "final_refit"}, "full_train": {"type", "seed"},
}
DEFAULT_SIZES = [0.8, 0.1, 0.1]


def strategy(asked: dict, base_seed: int | None = None) -> dict:
    """The split runs of a validation strategy, with labels, seeds and sizes; the first is the primary one. Unknown kinds, fields and families are errors."""
    kind = str(asked.get("type") or "").strip().lower()
    if kind not in FIELDS:
        raise ValueError(f"unknown strategy {kind!r}. Expected one of {sorted(FIELDS)}")
    if extra := sorted(set(asked) - FIELDS[kind]):
        raise ValueError(f"fields that {kind} does not have: {extra}")
    family = str(asked.get("split_family") or "random").strip().lower()
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}. Expected one of {sorted(FAMILIES)}")
    repeats = int(asked.get("n_repeats") or (3 if kind == "repeated_holdout" else 1))
    folds_ = int(asked.get("n_folds") or 5)
    if (kind == "repeated_holdout" and repeats < 2) or repeats < 1 or folds_ < 2:
        raise ValueError("too few repeats or folds")
    if kind == "cross_validation" and family != "random":
        raise ValueError("folds are of the random family alone")
    sizes = None
    if kind.endswith("holdout"):
        given = [float(x) for x in asked.get("split_sizes") or DEFAULT_SIZES]
        if abs(sum(given) - 1) > 1e-6:
            raise ValueError("sizes sum to one")
        sizes = list(normalize_sizes(given).values())
    labels = {
        "full_train": ["full_train"], "holdout": [f"{family}_holdout"], "repeated_holdout": [f"{family}_repeat_{k + 1}" for k in range(repeats)],
        "cross_validation": [f"cv_repeat_{r + 1}_fold_{f + 1}" for r in range(repeats) for f in range(folds_)],
    }[kind]
    how = {"full_train": "final_refit", "cross_validation": "cross_validation"}.get(kind, FAMILIES[family])
    runs = [{"label": x, "split_type": how, "split_family": "full_train" if kind == "full_train" else family, "primary": k == 0, "sizes": [1.0] if kind == "full_train" else sizes} for k, x in enumerate(labels)]
    policy = seed_policy(runs, asked.get("seed") or base_seed)
    return {"type": kind, "outer_test_size": float(asked.get("outer_test_size") or 0), "final_refit": kind == "full_train" or (kind == "cross_validation" and asked.get("final_refit", True)), **policy}


def cluster_count(n: int) -> int:
    """The number of clusters of n rows: the root of half of them, from 3 to 20."""
    return max(3, min(20, int(math.sqrt(n / 2))))


def cluster_keys(df: DataFrame, vector: str, seed: int = 0) -> DataFrame:
    """Adds cluster: of standardized vectors, as many as cluster_count says."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    scaled = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(data).transform(data)
    return KMeans(k=cluster_count(df.count()), seed=seed, featuresCol="_z", predictionCol="cluster").fit(scaled).transform(scaled).drop("_v", "_z")


def feedback_variants(df: DataFrame, tier: str, loops: int = 3, least: int = 10) -> dict[str, DataFrame]:
    """The rows without high tiers, then also without medium, then without low ones; a variant of fewer than `least` rows ends the list."""
    if not 0 <= loops <= 3:
        raise ValueError("there are three loops at most")
    out = {"baseline": df}
    gone: list[str] = []
    for name in ("high", "medium", "low")[:loops]:
        gone.append(name)
        rows = df.where(~F.coalesce(F.col(tier), F.lit("none")).isin(*gone))
        if rows.count() < least:
            break
        out["without_" + "_".join(gone)] = rows
    return out


def fold_variants(df: DataFrame, repeat: str, fold: str, y: str, p: str, order: list[str], fraction: float = 0.25, flags: list[str] | None = None) -> DataFrame:
    """Rows selected as outliers within each repeat and fold: the worst ceil(fraction * eligible) of each, by rank within it."""
    from pyspark.sql.window import Window

    from tessera.operators.outliers import with_fold_rmse

    run = F.concat_ws("/", repeat, fold)
    rows = with_fold_rmse(df.withColumn("_run", run), "_run", y, p)
    flagged = F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in flags], F.lit(False)) if flags else F.lit(True)
    rows = rows.where((F.col("abs_error") > 2 * F.col("fold_rmse")) & flagged)
    w = Window.partitionBy("_run")
    ranked = rows.withColumns({"ape_rank": F.row_number().over(w.orderBy(F.desc("ape"), *order)), "_k": F.count("*").over(w)})
    return ranked.where(F.col("ape_rank") <= F.ceil(F.col("_k") * fraction - 1e-9)).drop("_run", "_k")


def validation_rows(predictions: DataFrame, rows: DataFrame, order: list[str], rows_order: list[str], target: str, fold: str, repeat: int | None = None) -> DataFrame:
    """(source_row_index, y_true, y_pred, fold_label, repeat_index): predictions beside the rows they are of, by position; other lengths are refused."""
    from tessera.operators.align import attach

    out = attach(rows.select("source_row_index", F.col(target).cast("double").alias("y_true"), *[c for c in rows_order if c != "source_row_index"]), predictions.withColumnRenamed(target, "y_pred"), rows_order, order, ["y_pred"])
    return out.select("source_row_index", "y_true", F.col("y_pred").cast("double").alias("y_pred"), F.lit(fold).alias("fold_label"), F.lit(repeat).cast("int").alias("repeat_index"))


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder a split, so that a run reads what it needs."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def candidates(spark, backends: dict[str, list[str]], variants: dict[str, list[str]] | None = None) -> DataFrame:
    """(candidate_id, backend, representation, variant): every backend with each of its representations and variants; tables of a few rows."""
    rows = [(f"{b}_{r}" + (f"_{v}" if v else ""), b, r, v) for b, rs in backends.items() for r in rs for v in (variants or {}).get(b) or [None]]
    return spark.createDataFrame(rows, "candidate_id string, backend string, representation string, variant string")
