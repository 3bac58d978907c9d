"""Best-fit packing of documents into fixed sequences, after Martello and Toth's dominance reduction.

Only lengths matter to a packing, and there are at most `capacity` of them, so the
instance is a table of counts that any corpus fits into. On it the reduction fixes
sequences that dominate every alternative, and best-fit decreasing packs what remains,
many equal sequences at a time. The plan says which ranks of each length go where;
every piece finds its place from its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small
from .tokens import encoder, rest

#: Counts by task and length are broadcast up to this many (about 8 MB), joined by a shuffle beyond.
BROADCAST_ROWS = 1 << 18

Pattern = tuple[tuple[int, int], ...]  # (length, how many), in order


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sequences that some best packing holds, and the counts that remain.

    For each item from the longest on, with `gap` left beside it: if nothing fits, it stands alone;
    if a single item fills the gap, or only one more item can fit, or at most two can
    and the longest single one is no shorter than any two together, then that item
    dominates all other contents (Martello and Toth's criterion for sets of up to
    three). Items for which none holds are left to best-fit.
    """
    left, fixed = {k: n for k, n in counts.items() if n > 0}, []
    lengths = sorted(left)
    size = capacity + 1

    def drop(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            lengths.pop(bisect_left(lengths, size))

    def smallest(k: int, without: int) -> list[int]:
        out = []
        for s in lengths:
            out += [s] * min(k - len(out), left[s] - (s == without))
            if len(out) == k:
                break
        return out

    while True:
        # the next shorter item, or the same again; longer ones that were passed over remain possible partners
        at = bisect_left(lengths, size) - (size not in left)
        if at < 0 or not lengths:
            return fixed, left
        size = lengths[at]
        gap = capacity - size
        three = smallest(3, size)
        if not three or three[0] > gap:
            fixed.append((((size, 1),), left[size]))
            drop(size, left[size])
            continue
        at = bisect_left(lengths, gap + 1) - 1
        if lengths[at] == size and left[size] == 1:
            at -= 1
        best = lengths[at]
        one = best == gap or len(three) < 2 or three[0] + three[1] > gap
        if not one and (len(three) < 3 or sum(three) > gap):
            one = best >= _best_pair(lengths, left, size, gap)
        if one:
            # a full sequence, or a lone partner, stays right until one of the two runs out; otherwise few are left for another look
            sure = best == gap or len(three) < 2 or three[0] + three[1] > gap
            if best == size:
                n = left[size] // 2 if sure else max(1, left[size] // 2 - 3)
                fixed.append((((size, 2),), n))
                drop(size, 2 * n)
            else:
                n = min(left[size], left[best])
                n = n if sure else max(1, n - 3)
                fixed.append((((size, 1), (best, 1)), n))
                drop(size, n)
                drop(best, n)
        else:
            size -= 1


def _best_pair(lengths: list[int], left: dict[int, int], size: int, gap: int) -> int:
    """The largest sum of two items that fits the gap."""
    best, i, j = 0, 0, bisect_left(lengths, gap + 1) - 1
    while i <= j:
        pair = lengths[i] + lengths[j]
        enough = i != j or left[lengths[i]] - (lengths[i] == size) >= 2
        if pair <= gap:
            if enough:
                best = max(best, pair)
            i += 1
        else:
            j -= 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a table of counts: sequences with equal contents are one group.

    A group takes as many items of a length as fit before the next group is looked at,
    as single items would. Each length splits at most one group, so there are no more
    than two groups for each length.
    """
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rests: list[int] = []

    def put(rest: int, pattern: Pattern, n: int) -> None:
        if rest not in open_:
            open_[rest] = []
            insort(rests, rest)
        open_[rest].append((pattern, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rests, size)
            if at < len(rests):
                rest = rests[at]
                pattern, many = open_[rest].pop()
                if not open_[rest]:
                    del open_[rest]
                    rests.pop(at)
            else:
                rest, pattern, many = capacity, (), n
            each = rest // size
            full = min(many, n // each)
            if full:
                put(rest - each * size, (*pattern, (size, each)), full)
                n -= full * each
            some = min(n, each - 1) if full < many else 0
            if some and full < many:
                put(rest - some * size, (*pattern, (size, some)), 1)
                n -= some
            over = many - full - bool(some)
            if over and pattern:
                put(rest, pattern, over)
            # a sequence not opened needs no place
    return [g for groups in open_.values() for g in groups]


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (from rank, each, first sequence, offset): rank r of the row's run goes to
    sequence first + (r - from) // each, at offset + (r - from) % each * length."""
    fixed, rest = reduce_dominated(counts, capacity)
    taken, rows, sequence = dict.fromkeys(counts, 0), {k: [] for k in counts}, 0
    for pattern, many in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for size, each in pattern:
            rows[size].append((taken[size], each, sequence, offset))
            taken[size] += each * many
            offset += each * size
        sequence += many
    if taken != counts:
        raise AssertionError("every piece needs one place")
    return {k: np.array(v, np.int64).reshape(-1, 4) for k, v in rows.items() if v}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        enc, pid, ranks = encoder(path), TaskContext.get().partitionId(), {}
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "rank"]
        for batch in small(batches):
            out = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = enc.encode(text)
                ids = np.empty(len(raw) // enc.dtype.itemsize + 1, "<u4")
                ids[:-1] = np.frombuffer(raw, enc.dtype)
                ids[-1] = end_id
                data = memoryview(ids.tobytes())
                for k, s in enumerate(range(0, len(ids), capacity)):
                    n = min(capacity, len(ids) - s)
                    rank = ranks.get(n, 0)
                    ranks[n] = rank + 1
                    for column, x in zip(out, (doc, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)]), pid, rank), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)
        rest(enc)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a place for every piece of every row of docs.

    Only documents of more than capacity ids are cut, into whole sequences and a rest.
    Null and empty texts are one id long. Repeated rows are packed as often as they
    occur; a null id stays null.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(
        source.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, rank long"), "pieces"
    )
    by_task = materialize(pieces.groupBy("pid", "length").agg(F.count("*").alias("n")), "lengths")
    # at most one row for each length up to the capacity
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select(F.col("pid").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = materialize(base, "bases")
    if base.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    ranked = pieces.join(base, (pieces.pid == base.p) & (pieces.length == base.l)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank")
    )

    def place(batches):
        table = places.value
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(length[order])) + 1, [len(order)]]) if len(order) else []
            for s, t in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[s:t]
                rows = table[int(length[at[0]])]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + k // row[:, 1]
                offset[at] = row[:, 3] + k % row[:, 1] * length[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer(name: str) -> str:
    """The place of one of the public vocabulary files."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, default_tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)
