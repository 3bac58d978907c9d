"""Generative topographic maps: fitting by expectation and maximization over the rows, projection, and landscapes weighted by responsibilities.

Only sums over rows (nodes x dimensions) come to the driver in each round, so a fit costs
one pass a round at any number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import landscape, similarity
from tessera.operators.frame import with_row_id


def grid(n_samples: int, mode: str = "extended") -> dict[str, list]:
    """Parameters to try, scaled to the number of rows: nodes and basis functions a side, width of the functions, regularization."""
    k = round(math.sqrt(5 * math.sqrt(n_samples)) + 2)
    m = max(3, round(0.3 * k))
    if mode == "heuristic":
        return {"nodes": [k], "basis_functions": [m], "width": [0.5, 1, 2], "regularization": [1, 10, 100]}
    if mode == "extended":
        return {"nodes": sorted({max(8, k - 5), max(8, k), k + 5}), "basis_functions": sorted({max(3, m - 5), m, m + 5}), "width": [0.5, 1, 2, 5], "regularization": [0.1, 1, 10, 100]}
    raise ValueError(f"unknown mode {mode!r}")


def _square(side: int) -> np.ndarray:
    line = np.linspace(-1, 1, side) if side > 1 else np.zeros(1)
    return np.array([(x, y) for x in line for y in line])


class Map:
    """A fitted map: node centres in the data's space and the precision of the noise."""

    def __init__(self, side: int, centres: np.ndarray, beta: float, mean: np.ndarray, scale: np.ndarray):
        self.side, self.centres, self.beta, self.mean, self.scale = side, centres, beta, mean, scale

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(responsibility of every node, squared distances, log likelihood) of standardized rows."""
        d = np.maximum((x * x).sum(1)[:, None] + (self.centres * self.centres).sum(1)[None, :] - 2 * x @ self.centres.T, 0)
        a = -0.5 * self.beta * d
        top = a.max(1, keepdims=True)
        e = np.exp(a - top)
        total = e.sum(1, keepdims=True)
        return e / total, d, (top + np.log(total))[:, 0] + 0.5 * x.shape[1] * math.log(self.beta / (2 * math.pi)) - math.log(len(self.centres))

    def standard(self, column) -> np.ndarray:
        return (similarity._block(column) - self.mean) / self.scale


def fit(df: DataFrame, vector: str, side: int = 10, basis: int = 3, width: float = 1.0, regularization: float = 1.0, rounds: int = 20, tolerance: float = 1e-4) -> Map:
    """A map of side x side nodes on the valid vectors of df, from their first two principal directions on."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    n, mean, cov = _moments(rows)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    nodes, centres = _square(side), _square(basis)
    sigma = width * (2 / max(1, basis - 1))
    phi = np.exp(-((nodes[:, None] - centres[None]) ** 2).sum(-1) / (2 * sigma * sigma))
    phi = np.hstack([phi, np.ones((len(nodes), 1))])
    start = nodes @ (vectors[:, ::-1][:, :2] * np.sqrt(np.maximum(values[::-1][:2], 1e-12))).T
    weight = np.linalg.lstsq(phi, start, rcond=None)[0]
    spread = float(np.maximum(values[::-1][2] if len(values) > 2 else 1e-2, 1e-3))
    model, before = Map(side, phi @ weight, 1 / spread, mean, scale), -np.inf
    for _ in range(rounds):
        g, rx, rd, ll = _sums(rows, model)
        left = phi.T @ (g[:, None] * phi) + regularization / model.beta * np.eye(phi.shape[1])
        weight = np.linalg.solve(left, phi.T @ rx)
        new = phi @ weight
        # the squared distances to the new centres, from the old ones' sums
        square = rd + 2 * ((model.centres - new) * rx).sum() + (g * ((new * new).sum(1) - (model.centres * model.centres).sum(1))).sum()
        model = Map(side, new, n * len(mean) / max(square, 1e-9), mean, scale)
        if abs(ll - before) <= tolerance * max(1.0, abs(ll)):
            break
        before = ll
    return model


def _moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    def run(batches):
        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = similarity._block(b.column(0))
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], names=["n", "s", "ss"])

    found = rows.mapInArrow(run, "n long, s array<double>, ss array<double>").collect()  # one row a task, of the size of the covariance
    if not found:
        raise ValueError("no vectors to fit a map on")
    n, s = sum(r.n for r in found), np.sum([r.s for r in found], axis=0)
    mean = s / n
    return n, mean, np.sum([r.ss for r in found], axis=0).reshape(len(s), -1) / n - np.outer(mean, mean)


def _sums(rows: DataFrame, model: Map) -> tuple[np.ndarray, np.ndarray, float, float]:
    own = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = own.value
        g, rx, rd, ll = np.zeros(len(m.centres)), np.zeros(m.centres.shape), 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = m.standard(b.column(0))
                r, d, one = m.responsibilities(x)
                g, rx, rd, ll = g + r.sum(0), rx + r.T @ x, rd + float((r * d).sum()), ll + float(one.sum())
        yield pa.RecordBatch.from_arrays([pa.array([g.tolist()]), pa.array([rx.ravel().tolist()]), pa.array([rd]), pa.array([ll])], names=["g", "rx", "rd", "ll"])

    found = rows.mapInArrow(run, "g array<double>, rx array<double>, rd double, ll double").collect()  # one row a task, of the size of the map
    return np.sum([r.g for r in found], axis=0), np.sum([r.rx for r in found], axis=0).reshape(model.centres.shape), sum(r.rd for r in found), sum(r.ll for r in found)


def project(df: DataFrame, id_col: str, vector: str, model: Map, least: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(points, responsibilities): id with its mean place x, y (0 to side - 1), best node and log likelihood; and (id, node, r) for nodes with at least `least`."""
    own = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        m = own.value
        xy = np.array([(i, j) for i in range(m.side) for j in range(m.side)], float)
        for b in batches:
            if not b.num_rows:
                continue
            r, _, ll = m.responsibilities(m.standard(b.column(1)))
            place = r @ xy
            nodes = [np.flatnonzero(x >= least) for x in r]
            pairs = [[{"node": int(k), "r": float(x[k])} for k in at] for x, at in zip(r, nodes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place[:, 0]), pa.array(place[:, 1]), pa.array(r.argmax(1).astype(np.int32)), pa.array(ll), pa.array(pairs, pa.list_(pa.struct([("node", pa.int32()), ("r", pa.float64())])))], names=[id_col, "x", "y", "node", "log_likelihood", "pairs"])

    from tessera.plans.storage import materialize

    out = materialize(rows.mapInArrow(run, f"`{id_col}` {kind}, x double, y double, node int, log_likelihood double, pairs array<struct<node:int,r:double>>"), "projected")
    return out.drop("pairs"), out.select(id_col, F.explode("pairs").alias("p")).select(id_col, "p.node", "p.r")


def density(responsibilities: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(node, density, filtered_density): mass by node; filtered below threshold times the greatest (null)."""
    d = responsibilities.groupBy("node").agg(F.sum("r").alias("density"))
    top = d.agg(F.max("density").alias("_top"))
    return d.join(F.broadcast(top)).select("node", "density", F.when(F.col("density") >= threshold * F.col("_top"), F.col("density")).alias("filtered_density"))


def regression_landscape(responsibilities: DataFrame, activity: DataFrame, id_col: str, value: str, threshold: float = 0.0) -> DataFrame:
    """(node, density, mean_activity, filtered_reg_density): activity weighted by responsibilities over rows that have one."""
    rows = responsibilities.join(activity.where(F.col(value).isNotNull()).select(id_col, F.col(value).cast("double").alias("_a")), id_col)
    out = rows.groupBy("node").agg(F.sum("r").alias("density"), (F.sum(F.col("r") * F.col("_a")) / F.sum("r")).alias("mean_activity"))
    top = out.agg(F.max("density").alias("_top"))
    return out.join(F.broadcast(top)).withColumn("filtered_reg_density", F.when(F.col("density") >= threshold * F.col("_top"), F.col("mean_activity"))).drop("_top")


def class_landscape(responsibilities: DataFrame, labels: DataFrame, id_col: str, label: str, classes: list[str]) -> DataFrame:
    """(node, density, <class>_density and <class>_prob by class); probabilities are weighted by the classes' sizes, so that each class weighs the same."""
    rows = responsibilities.join(labels.where(F.col(label).isin(*classes)).select(id_col, F.col(label).alias("_l")), id_col)
    out = rows.groupBy("node").agg(F.sum("r").alias("density"), *[F.coalesce(F.sum(F.when(F.col("_l") == c, F.col("r"))), F.lit(0.0)).alias(f"{c}_density") for c in classes])
    total = sum((F.col(f"{c}_density") for c in classes[1:]), F.col(f"{classes[0]}_density"))
    return out.withColumns({f"{c}_prob": F.try_divide(F.col(f"{c}_density"), total) for c in classes})


def landscapes_by_group(responsibilities: DataFrame, labels: DataFrame, id_col: str, groups: list[str]) -> DataFrame:
    """Class landscapes of several 0/1 columns in one pass: (group, node, density, active_density, active_prob)."""
    long = labels.select(id_col, *[F.col(g).cast("int").alias(g) for g in groups]).unpivot([id_col], groups, "group", "active").where("active is not null")
    out = responsibilities.join(long, id_col).groupBy("group", "node").agg(F.sum("r").alias("density"), F.sum(F.col("r") * F.col("active")).alias("active_density"))
    return out.withColumn("active_prob", F.col("active_density") / F.col("density"))


def entropy(responsibilities: DataFrame, side: int) -> DataFrame:
    """Shannon entropy of the map's density over the logarithm of all nodes: what a search for parameters makes greatest."""
    return landscape.entropy(density(responsibilities), side * side)


def ruggedness(landscape_: DataFrame, value: str, side: int) -> DataFrame:
    return landscape.ruggedness(landscape_.select(F.floor(F.col("node") / side).cast("int").alias("gx"), (F.col("node") % side).cast("int").alias("gy"), value), value, side)


def optimize(df: DataFrame, id_col: str, vector: str, mode: str = "heuristic", most: int | None = None) -> tuple[Map, list[dict]]:
    """The map of greatest entropy among the parameters of grid(), with all trials; each is a fit over all rows."""
    params = grid(df.count(), mode)
    tried, best = [], None
    for nodes in params["nodes"]:
        for basis in params["basis_functions"]:
            for width in params["width"]:
                for reg in params["regularization"]:
                    if most is not None and len(tried) >= most:
                        return best[1], tried
                    model = fit(df, vector, nodes, basis, width, reg)
                    e = entropy(project(df, id_col, vector, model)[1], nodes).first().entropy
                    tried.append({"nodes": nodes, "basis_functions": basis, "width": width, "regularization": reg, "entropy": e})
                    if best is None or e > best[0]:
                        best = (e, model)
    return best[1], tried


def preservation(df: DataFrame, points: DataFrame, id_col: str, vector: str, k: int = 10) -> DataFrame:
    """(i, kept): how many of a row's k nearest by vector are among its k nearest on the map; k is below the number of rows."""
    k = min(k, max(1, df.count() - 1))
    high = similarity.neighbours(df, id_col, vector, k, measure="euclidean")
    low = similarity.neighbours(points.select(id_col, F.array("x", "y").alias("v")), id_col, "v", k, measure="euclidean")
    return similarity.preserved(high, low)


def node_tables(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lookups of a table of x, y and nodes: by place and by node, each once."""
    one = df.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "nodes").distinct()
    return one.select("x", "y", "nodes"), one.select("nodes", "x", "y")


def node_at(table: DataFrame, x: int, y: int) -> str:
    """The node at a place; an error with some places there are."""
    if not isinstance(x, int) or not isinstance(y, int):
        raise ValueError("places are whole numbers")
    found = table.where((F.col("x") == x) & (F.col("y") == y)).agg(F.min("nodes").alias("n")).first().n
    if found is None:
        raise ValueError(f"no node at ({x}, {y}); there are {[tuple(r) for r in table.select('x', 'y').distinct().orderBy('x', 'y').limit(10).collect()]}")
    return str(int(found))


def density_at(table: DataFrame, node: int, column: str = "density") -> float | None:
    return (lambda r: None if r is None else r[0])(table.where(F.col("nodes") == node).agg(F.max(column)).first())


def sample_nodes(members: DataFrame, nodes: DataFrame, key: str, n: int | None = None, seed: int = 0, node: str = "node_index") -> DataFrame:
    """Rows of the nodes (a frame with column nodes), all or n of each node by a seeded hash."""
    rows = members.join(nodes.select(F.col("nodes").alias("_n")).distinct(), F.col(node) == F.col("_n"), "left_semi")
    if n is None:
        return rows
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(node).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def sample_places(members: DataFrame, table: DataFrame, places: list, key: str, n: int | None = None, seed: int = 0, allow_missing: bool = False) -> DataFrame:
    """Rows at places ((x, y) pairs or dicts, rounded); places without a node are an error unless allowed."""
    spark = members.sparkSession
    wanted = [(round(float(p["x"])), round(float(p["y"]))) if isinstance(p, dict) else (round(float(p[0])), round(float(p[1]))) for p in places]
    asked = spark.createDataFrame(wanted, "x int, y int").distinct()
    by_place, _ = node_tables(table)
    missing = [tuple(r) for r in asked.join(by_place, ["x", "y"], "left_anti").limit(10).collect()]
    if missing and not allow_missing:
        raise ValueError(f"no nodes at {missing}")
    return sample_nodes(members, by_place.join(F.broadcast(asked), ["x", "y"], "left_semi"), key, n, seed)


def with_places(members: DataFrame, table: DataFrame, node: str = "node_index") -> DataFrame:
    """Rows with the x and y of their node, nulls for unknown ones."""
    _, by_node = node_tables(table)
    return members.drop("x", "y").join(by_node.withColumnRenamed("nodes", "_n"), F.col(node) == F.col("_n"), "left").drop("_n")


def dense_nodes(table: DataFrame, n: int = 5, least: float | None = None, filtered: bool = True) -> DataFrame:
    """The densest nodes by filtered_density (density where there is none of it), ties by node."""
    column = "filtered_density" if filtered and "filtered_density" in table.columns else "density"
    rows = table if least is None else table.where(F.col(column) >= least)
    return rows.orderBy(F.desc_nulls_last(column), F.asc("nodes")).limit(n).select("nodes", column)


def metric_column(table: DataFrame) -> str:
    """The metric of a landscape: its regression density, the probability of active, the first probability, or the first number."""
    names = table.columns
    if "filtered_reg_density" in names:
        return "filtered_reg_density"
    probabilities = [c for c in names if c.endswith("_prob")]
    if probabilities:
        return "active_prob" if "active_prob" in probabilities else probabilities[0]
    from tessera.operators.frame import numeric_columns

    rest = [c for c in numeric_columns(table) if c not in ("nodes", "x", "y")]
    if not rest:
        raise ValueError(f"no metric among {names}")
    return rest[0]


def landscape_nodes(table: DataFrame, metric: str | None = None, n: int = 5, least: float | None = None, ascending: bool = False) -> DataFrame:
    """The best nodes of a landscape by a metric, found if not named; ties by node."""
    metric = metric or metric_column(table)
    if metric not in table.columns:
        raise ValueError(f"no metric {metric!r}; there are {[c for c in table.columns if c != 'nodes']}")
    rows = table if least is None else table.where(F.col(metric) >= least)
    return rows.orderBy(F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric), F.asc("nodes")).limit(n).select("nodes", metric)


def top_rows(members: DataFrame, value: str, key: str, n: int = 10, least: float | None = None, ascending: bool = False) -> DataFrame:
    """Rows with the best values; texts that are no numbers are left out; ties by key."""
    rows = members.withColumn("_v", F.col(value).cast("string").try_cast("double")).where("_v is not null and not isnan(_v)")
    rows = rows if least is None else rows.where(F.col("_v") >= least)
    return rows.orderBy(F.asc("_v") if ascending else F.desc("_v"), F.asc(key)).limit(n).drop("_v")


def landscape_table(df: DataFrame) -> tuple[DataFrame, str]:
    """A landscape read from a file, checked: nodes and a regression or class metric; its kind."""
    names = set(df.columns)
    if "nodes" not in names:
        raise ValueError("a landscape has a column nodes")
    if "filtered_reg_density" in names:
        return df, "regression"
    if any(c.endswith("_prob") for c in names):
        return df, "classification"
    raise ValueError("a landscape has filtered_reg_density or columns that end in _prob")


def merged_source(points: DataFrame, rows: DataFrame, points_order: list[str], rows_order: list[str]) -> DataFrame:
    """Points and rows side by side by position."""
    a, b = with_row_id(points, points_order, "_a"), with_row_id(rows, rows_order, "_b")
    return a.join(b.select("_b", *[c for c in rows.columns if c not in points.columns]), F.col("_a") == F.col("_b")).drop("_a", "_b")
