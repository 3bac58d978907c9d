"""Exact substring deduplication by fixed-block anchors.

A repeat of `window` words covers at least one whole block of a grid of half that
length laid over any document, so it is enough to index the non-overlapping blocks of
every document and to probe them with every rolling window of a block's length.

1. probe: hashes of all rolling windows meet the index in buckets of the hash. A batch
   of documents sends each hash once, with a mark if it is a block's; what repeats
   within the batch is known to repeat without being sent again.
2. extend: a hit grows to each window of full length around it whose own blocks are all
   hits; those windows are hashed to 96 bits and meet in buckets again. The first
   occurrence of each (smallest doc_id, then start) stays, all others are repeats;
   runs of them are the maximal exact repeats.
3. cut: words that a repeat covers are removed.

No pair of occurrences is ever listed: a passage shared by a third of all documents
costs one entry for each batch. Hash prefixes in step 1 only let too much through;
step 2 decides.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, forget, keyed, materialize, mix64, partitions, slices, small
from .wordhash import Words, get_varints, put_varints, rest

#: Bytes of text that are hashed together.
BATCH = 1 << 20
#: Bytes of text for each bucket of hashes and each shard of documents: these grow in number, not in size.
BUCKET = 4 << 20

_OUT = "kind int, key long, a binary, b binary"


def _texts(batches):
    """(doc ids, encoded texts, rows) in runs of about BATCH bytes."""
    for batch in small(batches, 2048):
        ids = batch.column(0).to_pylist()
        data = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        for s, t in slices([len(x) for x in data], BATCH):
            yield np.array(ids[s:t], np.int64), data[s:t], batch.slice(s, t - s)
    rest()


def _rows(kind, key, a, b):
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["kind", "key", "a", "b"])


def _kept(words: Words, t: int, drop: np.ndarray | None = None) -> tuple[int, bytes]:
    """How many words of text t are dropped, and the others joined by one space."""
    lo, hi = words.first[t], words.first[t + 1]
    start, end = words.start[lo:hi], words.end[lo:hi]
    if drop is None or not drop.any():
        if hi - lo and (start[1:] - end[:-1] == 1).all():  # single separators need no joining
            raw = words.data[start[0] : end[-1]]
            return 0, raw if not any(c in raw for c in b"\t\n\x0b\x0c\r") else raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     "))
        return 0, b" ".join(words.data[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True))
    keep = ~drop
    return int(drop.sum()), b" ".join(words.data[s:e] for s, e in zip(start[keep].tolist(), end[keep].tolist(), strict=True))


def _bucket_payloads(bucket: np.ndarray, n_buckets: int, *columns):
    """For each bucket that has entries: its number and the columns' entries, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    sorted_ = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), [c[cuts[b] : cuts[b + 1]] for c in sorted_]


def _probe(block: int, n_buckets: int):
    """Rows: (0, bucket, entries, head) to probe; (1, batch, table, local hits); the key is a bucket or a batch."""

    def run(batches):
        batch_id = TaskContext.get().partitionId() << 24
        for ids, data, _ in _texts(batches):
            batch_id += 1
            words = Words(data)
            at = words.within(block)
            # documents shorter than a full window have no repeat
            at = at[words.n[words.text[at]] >= 2 * block]
            if not len(at):
                continue
            h = words.windows(block, words.hashes())[at]
            is_block = (at - words.first[words.text[at]]) % block == 0
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            group = np.cumsum(new) - 1
            count = np.bincount(group)
            any_block = np.zeros(len(count), bool)
            np.logical_or.at(any_block, group[is_block[order]], True)
            single = np.zeros(len(at), bool)
            single[order] = count[group] == 1
            local = at[~single]
            yield _rows([1], [batch_id], [np.concatenate([[len(ids)], ids, words.first]).astype("<i8").tobytes()], [put_varints(np.diff(local, prepend=0))])
            # one entry a hash: its first place in the batch, a block mark, and a mark if it repeats here
            place = order[new]
            back = np.argsort(place)
            place, block_mark, many = place[back], any_block[back], count[back] > 1
            key = h[place]
            bucket = ((key >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
            # marks travel in the two low bits of the distance from the entry before
            gap_of = at[place].astype(np.int64)
            out = []
            for b, (k, p, m, c) in _bucket_payloads(bucket.astype(np.int64), n_buckets, low, gap_of, block_mark, many):
                gap = np.diff(p, prepend=0) * 4 + m * 2 + c
                out.append((b, struct.pack("<qi", batch_id, len(k)) + k.tobytes(), put_varints(gap)))
            for i in range(0, len(out), 512):
                part = out[i : i + 512]
                yield _rows([0] * len(part), [b for b, _, _ in part], [x for _, x, _ in part], [y for _, _, y in part])

    return run


def _meet(table: pa.Table) -> pa.Table:
    """A bucket's entries: those whose hash some batch holds as a block and that occur twice go back to their batch."""
    batch, size, keys, gaps = [], [], [], []
    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        i, n = struct.unpack_from("<qi", a)
        batch.append(i)
        size.append(n)
        keys.append(np.frombuffer(a, "<u4", n, 12))
        gaps.append(get_varints(b))
    key, gap = np.concatenate(keys), np.concatenate(gaps)
    owner = np.repeat(np.arange(len(batch)), size)
    order = np.argsort(key, kind="stable")
    s = key[order]
    group = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])) - 1
    count = np.bincount(group)
    marks = np.zeros(len(count), bool)
    marks[group[(gap[order] & 2) > 0]] = True
    hit = np.zeros(len(key), bool)
    # repeats within one batch are known there already
    hit[order] = marks[group] & (count[group] > 1)
    hit &= (gap & 1) == 0
    total = np.cumsum(gap >> 2)
    before = np.concatenate([[0], np.cumsum(size)[:-1]])
    base = np.repeat(np.where(before > 0, total[before - 1], 0), size)
    place = (total - base)[hit]
    cuts = np.searchsorted(owner[hit], np.arange(len(batch) + 1))
    out = [(batch[i], place[cuts[i] : cuts[i + 1]]) for i in range(len(batch)) if cuts[i] < cuts[i + 1]]
    return pa.table({"batch": pa.array([i for i, _ in out], pa.int64()), "table": pa.array([None] * len(out), pa.binary()), "places": pa.array([put_varints(np.diff(p, prepend=0)) for _, p in out], pa.binary())})


def _bring_home(table: pa.Table) -> pa.Table:
    """All hits of a batch, by document: the places within it."""
    head = next((x for x in table.column("table").to_pylist() if x is not None), None)
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "places": pa.array([], pa.binary())})
    if head is None:
        return empty
    raw = np.frombuffer(head, "<i8")
    n = int(raw[0])
    ids, first = raw[1 : n + 1], raw[n + 1 :]
    parts = [np.cumsum(get_varints(p)) for p in table.column("places").to_pylist() if p]
    if not parts:
        return empty
    place = np.unique(np.concatenate(parts))
    cuts = np.searchsorted(place, first)
    has = np.flatnonzero(np.diff(cuts))
    return pa.table({"doc_id": pa.array(ids[has]), "places": pa.array([put_varints(np.diff(place[cuts[t] : cuts[t + 1]] - first[t], prepend=0)) for t in has], pa.binary())})


def _candidates(words: Words, hits: list[bytes | None], block: int) -> np.ndarray:
    """Starts of full windows all of whose own blocks are hits."""
    window = 2 * block
    hit = np.zeros(len(words.text) + 1, bool)
    for t, p in enumerate(hits):
        if p:
            hit[words.first[t] + np.cumsum(get_varints(p))] = True
    local = np.arange(len(words.text)) - words.first[words.text]
    miss = np.concatenate([[0], np.cumsum((local % block == 0) & ~hit[:-1])])
    at = words.within(window)
    return at[miss[at + block + 1] - miss[at] == 0]


def _put_places(doc: np.ndarray, start: np.ndarray) -> bytes:
    """(document, start) pairs; those of a document stand together."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
    return struct.pack("<ii", len(doc), len(edge) - 1) + doc[edge[:-1]].astype("<i8").tobytes() + np.diff(edge).astype("<i4").tobytes() + put_varints(start)


def _get_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    _, m = struct.unpack_from("<ii", data)
    return np.repeat(np.frombuffer(data, "<i8", m, 8), np.frombuffer(data, "<i4", m, 8 + 8 * m)), get_varints(data[8 + 12 * m :])


def _by_shard(doc: np.ndarray, start: np.ndarray, n_shards: int) -> list[tuple[int, bytes]]:
    """The pairs by a hash of the document."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    shard = (mix64(doc) % np.uint64(n_shards)).astype(np.int64)
    return [(k, _put_places(d, s)) for k, (d, s) in _bucket_payloads(shard, n_shards, doc, start)]


def _by_document(table: pa.Table) -> pa.Table:
    """A shard's pairs, one row for each document: its starts, in order and once each."""
    doc, start = (np.concatenate(v) for v in zip(*map(_get_places, table.column("places").to_pylist()), strict=True))
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])])
    doc, start = doc[new], start[new]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
    return pa.table({"doc_id": pa.array(doc[cuts[:-1]], pa.int64()), "places": pa.array([put_varints(np.diff(start[i:j], prepend=0)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _extend(block: int, n_buckets: int, n_shards: int):
    """Rows: (0, bucket, entries, places) to meet; (1, shard, null, repeats found within the batch)."""
    window = 2 * block

    def run(batches):
        for ids, data, rows in _texts(batches):
            words = Words(data)
            at = _candidates(words, rows.column(2).to_pylist(), block)
            if not len(at):
                continue
            k0 = words.windows(window, words.hashes(0), 0)[at]
            k1 = words.windows(window, words.hashes(1), 1)[at] & np.uint64(0xFFFFFFFF)
            doc = ids[words.text[at]]
            start = at - words.first[words.text[at]]
            order = np.lexsort((start, doc, k1, k0))
            new = np.concatenate([[True], (k0[order][1:] != k0[order][:-1]) | (k1[order][1:] != k1[order][:-1])])
            later = np.sort(order[~new])
            found = _by_shard(doc[later], start[later], n_shards)
            if found:
                yield _rows([1] * len(found), [k for k, _ in found], [None] * len(found), [x for _, x in found])
            mine = np.sort(order[new])
            mine = mine[np.lexsort((start[mine], doc[mine]))]
            bucket = (((k0[mine] >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
            out = []
            for b, (x, y, d, s) in _bucket_payloads(bucket, n_buckets, k0[mine], k1[mine], doc[mine], start[mine]):
                out.append((b, x.astype("<u8").tobytes() + y.astype("<u4").tobytes(), _put_places(d, s)))
            for i in range(0, len(out), 512):
                part = out[i : i + 512]
                yield _rows([0] * len(part), [b for b, _, _ in part], [x for _, x, _ in part], [y for _, _, y in part])

    return run


def _first_stays(table: pa.Table, n_shards: int) -> pa.Table:
    """All but the first occurrence of each window of a bucket, by shards of the documents."""
    x, y, doc, start = [], [], [], []
    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        d, s = _get_places(b)
        x.append(np.frombuffer(a, "<u8", len(d)))
        y.append(np.frombuffer(a, "<u4", len(d), 8 * len(d)))
        doc.append(d)
        start.append(s)
    x, y, doc, start = (np.concatenate(v) for v in (x, y, doc, start))
    order = np.lexsort((start, doc, y, x))
    old = np.concatenate([[False], (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])])
    out = _by_shard(doc[order[old]], start[order[old]], n_shards)
    return pa.table({"shard": pa.array([k for k, _ in out], pa.int64()), "places": pa.array([p for _, p in out], pa.binary())})


def repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, text, places): documents of docs (doc_id unique, text) that hold repeats, with the starts of repeated windows.

    places holds the differences of the window starts as varints.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    block, spark = window // 2, docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n_shards = max(64, partitions(spark), size // (2 * BUCKET))
    n_buckets = 2 * n_shards

    def meet(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() == 1:
            return pa.table({"batch": t.column("key"), "table": t.column("a"), "places": t.column("b")})
        return _meet(t)

    def first_stays(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() == 1:
            return pa.table({"shard": t.column("key"), "places": t.column("b")})
        return _first_stays(t, n_shards)

    probes = docs.mapInArrow(_probe(block, n_buckets), _OUT)
    met = probes.groupBy("kind", "key").applyInArrow(meet, "batch long, table binary, places binary")
    hits = materialize(met.groupBy("batch").applyInArrow(_bring_home, "doc_id long, places binary"), "anchors")
    some = docs.join(few(hits.select("doc_id")), "doc_id", "left_semi")
    some = materialize(some.join(hits, "doc_id"), "anchored")
    forget(hits)
    entries = some.select("doc_id", "text", "places").mapInArrow(_extend(block, n_buckets, n_shards), _OUT)
    later = entries.groupBy("kind", "key").applyInArrow(first_stays, "shard long, places binary")
    later = materialize(later.groupBy("shard").applyInArrow(_by_document, "doc_id long, places binary"), "repeats")
    return some.drop("places").join(later, "doc_id")


def _cut(window: int):
    def run(batches):
        for ids, data, rows in _texts(batches):
            words = Words(data)
            counts, removed, kept = [], [], []
            for t, places in enumerate(rows.column(2).to_pylist()):
                n = int(words.n[t])
                drop = None
                if places:
                    step = np.zeros(n + 1, np.int64)
                    at = np.cumsum(get_varints(places))
                    step[at] += 1
                    step[at + window] -= 1
                    drop = np.cumsum(step)[:-1] > 0
                r, k = _kept(words, t, drop)
                counts.append(n)
                removed.append(r)
                kept.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_removed, kept) for the documents that lose words; kept holds the other words, one space apart.

    Documents not returned keep their text as it is. Ids must be unique (common.keyed
    makes them so); rows without one take no part. Null and empty texts have no words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    return repeats(rows, window).select("doc_id", "text", "places").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("doc_id", id_col)


def _digests(batches):
    for ids, data, rows in _texts(batches):
        words = Words(data)
        sha = [hashlib.sha256(_kept(words, t)[1]).hexdigest() for t in range(len(ids))]
        yield pa.RecordBatch.from_arrays([pa.array(ids), rows.column(2), pa.array(words.n, pa.int64()), pa.array(sha)], names=["row_key", "doc_id", "n_words", "sha"])


def op5_substring(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents. Rows of a repeated doc_id are documents of their own, in the order of a
    hash of their texts; rows without a doc_id have no place in the order of documents and are left out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    docs = keyed(docs, "row_key")
    cut = remove_repeats(docs, 20, "row_key").select(F.col("row_key").alias("k"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("cut_sha"))
    cut = materialize(cut, "cut")
    whole = docs.select("row_key", "text", "doc_id").mapInArrow(_digests, "row_key long, doc_id long, n_words long, sha string")
    out = whole.join(cut, F.col("row_key") == F.col("k"), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))


OP5_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, s, md5(array_to_string(ws[s : s + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)
), r AS (SELECT doc_id, s FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""
