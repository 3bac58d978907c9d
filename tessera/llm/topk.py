"""Exact top-k search by inner product in three phases with a uniform threshold.

A score is the sum of partial scores over m slices of the dimensions. In each block of
candidates: (1) every slice gathers its k best partial scores for each query, and their
whole scores are formed; the k-th best of all gathered is a score that the k best reach
for certain. (2) That cutoff is broadcast: a candidate that reaches it has at least one
slice whose partial score is the m-th part of it or more, so those entries suffice.
(3) The remaining slices of those entries are resolved, and the exact best kept.

Queries are taken in blocks of a fixed number, and one block and its cutoffs are all
that is broadcast. Scores of vectors with very large components, which doubles would
round, are formed in whole numbers of any size instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, materialize

#: Queries that are broadcast together (16 MB at 64 dimensions), and those of them that are scored together.
QUERIES = 1 << 15
TILE = 2048
#: Candidates that are scored together.
BLOCK = 2048
SLICES = 4


#: Doubles are whole numbers from here on, and sums of products below it are exact.
EXACT = 2.0**53
#: The ends of a score.
LEAST, MOST = -(2**63), 2**63 - 1


def quantized(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, as whole doubles. Vectors that are null, or hold null or non-finite components, and null ids, take no part."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = lambda y: F.when(F.abs(y) >= EXACT, y).otherwise(F.floor(y).cast("double"))
    return df.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: whole(c.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix padded with zeros, lengths) of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out, size


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row; of equal scores the earlier column. -inf never."""
    n = score.shape[1]
    if n <= k:
        row, column = np.nonzero(np.isfinite(score))
        return row, column
    kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    over = score > kth
    tie = (score == kth) & np.isfinite(score)
    room = k - over.sum(axis=1, keepdims=True)
    tie &= np.cumsum(tie, axis=1) <= room
    return np.nonzero(over | tie)


class _Tile:
    """Some queries: their ids, vectors and the norms of their slices."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, size: np.ndarray, cut: np.ndarray | None):
        self.ids, self.q, self.size, self.cut = ids, q, size, cut
        self.edges = np.linspace(0, q.shape[1], SLICES + 1).astype(int)
        self.norms = self.slice_norms(q)
        self.top = np.abs(q).max(axis=1, initial=0.0)

    def slice_norms(self, m: np.ndarray) -> np.ndarray:
        """Of each row and slice, a little more than the norm."""
        with np.errstate(over="ignore"):
            return np.stack([np.sqrt((m[:, a:b] ** 2).sum(axis=1)) for a, b in zip(self.edges, self.edges[1:], strict=False)], axis=1) * (1 + 1e-9)

    def part(self, c: np.ndarray, j: int, rows=slice(None)) -> np.ndarray:
        a, b = self.edges[j], self.edges[j + 1]
        return self.q[rows, a:b] @ c[:, a:b].T

    def whole(self, c: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for s in range(0, len(row), 1 << 18):
            out[s : s + (1 << 18)] = np.einsum("ij,ij->i", self.q[row[s : s + (1 << 18)]], c[column[s : s + (1 << 18)]])
        return out


def _tiles(ids: np.ndarray, q: np.ndarray, size: np.ndarray, cut: np.ndarray | None = None) -> list[_Tile]:
    return [_Tile(ids[s : s + TILE], q[s : s + TILE], size[s : s + TILE], None if cut is None else cut[s : s + TILE]) for s in range(0, len(ids), TILE)]


def _blocks(batches, dim: int):
    """(ids, matrix, lengths) of candidates in the order of their ids, padded or cut to dim (longer ones are barred by their length)."""
    for batch in batches:
        for s in range(0, batch.num_rows, BLOCK):
            part = batch.slice(s, BLOCK)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            m, size = _matrix(part.column(1))
            c = np.zeros((len(ids), dim))
            c[:, : min(dim, m.shape[1])] = m[:, :dim]
            yield ids[order], c[order], size[order]


_ROWS = "query_id long, vec_id long, score long"


def _emit(q, v, s):
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(np.asarray(s).astype(np.int64))], names=["query_id", "vec_id", "score"])


def _large(tile: _Tile, ids: np.ndarray, c: np.ndarray, barred: np.ndarray, k: int):
    """The pairs whose score a double may round, and their k best for each query by whole numbers of any size; a score beyond a long is its end."""
    most = np.abs(c).max(initial=0.0)
    if tile.top.max(initial=0.0) * most * max(1, c.shape[1]) < EXACT:
        return np.zeros(barred.shape, bool), []
    with np.errstate(over="ignore"):
        rounded = tile.top[:, None] * np.abs(c).max(axis=1, initial=0.0)[None, :] * max(1, c.shape[1]) >= EXACT
    rounded &= ~barred
    found = []
    for r in np.flatnonzero(rounded.any(axis=1)):
        at = np.flatnonzero(rounded[r])
        own = [int(x) for x in tile.q[r]]
        score = [min(MOST, max(LEAST, sum(a * int(b) for a, b in zip(own, row, strict=True)))) for row in c[at].tolist()]
        for i in sorted(range(len(at)), key=lambda i: (-score[i], i))[:k]:
            found.append((tile.ids[r], ids[at[i]], score[i]))
    return rounded, found


def _search(tiles, k: int):
    """With cutoffs (phases 2 and 3): entries of any slice that reach their part of the cutoff, resolved exactly. Without (phase 1):
    each slice's k best entries. Either way the k best whole scores of each block by query."""

    def run(batches):
        own = tiles.value
        dim = max(t.q.shape[1] for t in own)
        for ids, c, size in _blocks(batches, dim):
            for t in own:
                barred = (t.ids[:, None] == ids[None, :]) | (t.size[:, None] != size[None, :])
                large, found = _large(t, ids, c, barred, k)
                barred |= large
                if found:
                    yield _emit(*zip(*found, strict=True))
                if barred.all():
                    continue
                norms = t.slice_norms(c).max(axis=0)
                seen = np.zeros(barred.shape, bool)
                with np.errstate(invalid="ignore", over="ignore"):
                    for j in range(SLICES):
                        if t.cut is None:
                            part = t.part(c, j)
                            part[barred] = -np.inf
                            seen[_best(part, k)] = True
                        else:
                            # a slice whose norms cannot reach its part of the cutoff is not multiplied
                            rows = np.flatnonzero(~(t.norms[:, j] * norms[j] < t.cut / SLICES))
                            if len(rows):
                                seen[rows] |= t.part(c, j, rows) >= t.cut[rows, None] / SLICES
                row, column = np.nonzero(seen & ~barred)
                score = np.full(barred.shape, -np.inf)
                score[row, column] = t.whole(c, row, column)
                if t.cut is not None:
                    score[score < t.cut[:, None]] = -np.inf
                row, column = _best(score, k)
                yield _emit(t.ids[row], ids[column], score[row, column])

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """rank 1 to k within each query, by score and then the smaller id.

    Each task has sent k entries a block, so a query's rows grow with the blocks alone;
    they are cut to k within parts of each query before they meet.
    """
    part = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    order = [F.desc("score"), F.asc("vec_id")]
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors and queries, both (vec_id, v) of whole numbers as doubles.

    Candidates of a query are all rows of its length but those that share its id. Ties
    go to the smaller id. Rows are not told apart by id: a repeated candidate counts as
    often as it stands there, and rows of a repeated query share one list of k, as in a
    join of the two tables. A score that does not fit a long is the nearest that does.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors, "vectors")
    asked = materialize(queries, "queries")
    n_blocks = -(-asked.count() // QUERIES)
    done = None
    for b in range(n_blocks):
        # a block is one hash class: about QUERIES queries, however many there are in all
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        ids = rows.column(0).to_numpy()
        q, size = _matrix(rows.column(1))
        tiles = spark.sparkContext.broadcast(_tiles(ids, q, size))
        gathered = _ranked(vectors.mapInArrow(_search(tiles, k), _ROWS), k)
        least = {r.query_id: r.score for r in gathered.where(F.col("rank") == k).select("query_id", "score").collect()}
        tiles = spark.sparkContext.broadcast(_tiles(ids, q, size, np.array([least.get(i, -np.inf) for i in ids.tolist()], float)))
        found = _ranked(vectors.mapInArrow(_search(tiles, k), _ROWS), k)
        found = materialize(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found")
        done = found if done is None else done.unionByName(found)
    for read in (vectors, asked):
        forget(read)
    return done if done is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op4_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP4_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
