"""A content-addressed store of token ids.

Layout, below one folder:

- data/kind=0: unique chunks. `hash` is the BLAKE2b-128 of `payload`, the ids of a chunk as
  little-endian unsigned integers of 2 bytes (vocabularies up to 65 536) or 4.
- data/kind=1: staged recipes, without order.
- manifest: one row a document in ascending doc_id order, `start` ids after the first:
  `recipe` holds the hashes of its chunks and `sizes` their numbers of ids; `root` is
  the Merkle root over the hashes, and `width` the bytes of an id.

A rolling hash over the last WINDOW ids cuts a document's stream, so that the same
passage is cut alike wherever it stands. A chunk that many documents share is stored
once.
"""

from __future__ import annotations

import gc
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, materialize, mix64, shared_dir, slices, small
from .packing import default_tokenizer
from .tokens import encoder, rest
from .wordhash import _WORDS

WINDOW = 16
#: A cut where the low bits of the rolling hash are zero: every 512 ids on average.
MASK = np.uint64(511)
SHORTEST, LONGEST = 128, 4096
HASH = 16
#: Ids whose rolling hashes are computed at a time.
BLOCK = 1 << 15
_ROWS = "kind int, hash binary, row long, doc_id long, n_tokens long, payload binary, sizes binary"


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=HASH).digest()


def merkle_root(hashes: list[bytes]) -> bytes:
    """The root over the chunk hashes; a level's odd last node moves up alone. No chunk: the hash of nothing."""
    level = [_digest(b"\0" + h) for h in hashes] or [_digest(b"")]
    while len(level) > 1:
        pairs = [_digest(b"\1" + a + b) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


#: mix64 of every id of two bytes, plus one.
_MIXED = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def _marks(ids: np.ndarray) -> np.ndarray:
    """Where the low bits of the rolling hash over the last WINDOW ids are zero; in blocks that stay in the processor's cache."""
    up, down = _WORDS[0].get(BLOCK + WINDOW)
    value, total, spare = np.empty(BLOCK + WINDOW, np.uint64), np.zeros(BLOCK + WINDOW + 1, np.uint64), np.empty(BLOCK, np.uint64)
    out = [np.zeros(0, np.int64)]
    for s in range(0, len(ids) - WINDOW + 1, BLOCK):
        part = ids[s : s + BLOCK + WINDOW - 1]
        n = len(part)
        m = n - WINDOW + 1
        x, h, y = value[:n], value[:m], spare[:m]
        x[:] = _MIXED[part] if ids.dtype.itemsize == 2 else mix64(part.astype(np.uint64) + np.uint64(1))
        x *= up[:n]
        np.cumsum(x, out=total[1 : n + 1])
        np.subtract(total[WINDOW : n + 1], total[:m], out=h)
        h *= down[:m]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # mix64 in place
            np.right_shift(h, np.uint64(shift), out=y)
            h ^= y
            h *= np.uint64(factor)
        h &= MASK
        out.append(np.flatnonzero(h == 0) + (s + WINDOW))
    return np.concatenate(out)


def cut_points(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For documents laid end to end (ends: where each stops), the ends of each one's chunks."""
    marks = _marks(ids)
    out, start = [], 0
    for end in ends.tolist():
        own = marks[np.searchsorted(marks, start + SHORTEST) : np.searchsorted(marks, end)].tolist()
        cuts, at = [], start
        for m in own:
            while m - at > LONGEST:
                at += LONGEST
                cuts.append(at)
            if m - at >= SHORTEST:
                cuts.append(m)
                at = m
        while end - at > LONGEST:
            at += LONGEST
            cuts.append(at)
        if end > at:
            cuts.append(end)
        out.append(np.array(cuts, np.int64))
        start = end
    return out


def _encode(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        tail = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        row = TaskContext.get().partitionId() << 33
        sent: set[bytes] = set()  # chunks of this task, at most 16 bytes for each
        gc.disable()  # nothing here makes cycles, and each collection walks the tables of words
        try:
            for batch in small(batches, 1024):
                docs = [None if x is None else int(x) for x in batch.column(0).to_pylist()]
                raws = [enc.encode(t) + tail for t in batch.column(1).to_pylist()]
                for s, t in slices([len(r) for r in raws], 4 << 20):
                    data = b"".join(raws[s:t])
                    ends = np.cumsum([len(r) for r in raws[s:t]]) // width
                    out = [[] for _ in range(7)]

                    def add(*x, out=out):
                        for column, v in zip(out, x, strict=True):
                            column.append(v)

                    start = 0
                    for doc, end, cuts in zip(docs[s:t], ends.tolist(), cut_points(np.frombuffer(data, enc.dtype), ends), strict=True):
                        hashes, at, row = [], start, row + 1
                        for c in cuts.tolist():
                            chunk = data[at * width : c * width]
                            h = _digest(chunk)
                            hashes.append(h)
                            if h not in sent:
                                sent.add(h)
                                add(0, h, 0, None, c - at, chunk, None)
                            at = c
                        sizes = np.diff(cuts, prepend=start).astype("<i4").tobytes()
                        add(1, merkle_root(hashes), row, doc, end - start, b"".join(hashes), sizes)
                        start = end
                    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["kind", "hash", "row", "doc_id", "n_tokens", "payload", "sizes"])
        finally:
            gc.enable()
        rest(enc)

    return run


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row of docs, append end_id, and write the store to path.

    Null and empty texts are the end id alone. Repeated rows have a recipe each; rows
    with a null id stand first in the manifest.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = source.mapInArrow(_encode(tokenizer, end_id), _ROWS)
    # a task sends a chunk once already: one sort, after the shuffle, finds those that several tasks sent
    unique = rows.repartition("kind", "hash", "row").groupBy("kind", "hash", "row").agg(*[F.first(c).alias(c) for c in ("doc_id", "n_tokens", "payload", "sizes")])
    unique.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")
    staged = spark.read.schema(_ROWS).parquet(f"{path}/data").where("kind = 1")
    ordered = staged.select("row", "doc_id", "n_tokens", "hash", "payload", "sizes").repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    local = materialize(ordered.mapInArrow(_local_start, "pid int, local long, doc_id long, n_tokens long, root binary, recipe binary, sizes binary"), "manifest")
    # one row for each file
    totals = local.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    width = F.lit(encoder(tokenizer).dtype.itemsize).alias("width")
    manifest = local.join(F.broadcast(totals), "pid").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "root", "recipe", "sizes", width)
    manifest.write.option("compression", "zstd").parquet(f"{path}/manifest")
    forget(local)


def _local_start(batches):
    pid, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("n_tokens").to_numpy(zero_copy_only=False)
        local = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([pid] * len(n), pa.int32()), pa.array(local), b.column("doc_id"), b.column("n_tokens"), b.column("hash"), b.column("payload"), b.column("sizes")],
            names=["pid", "local", "doc_id", "n_tokens", "root", "recipe", "sizes"],
        )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(hash, payload) of the unique chunks."""
    return spark.read.schema(_ROWS).parquet(f"{path}/data").where("kind = 0").select("hash", "payload")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, start long, n_tokens long, root binary, recipe binary, sizes binary, width int").parquet(f"{path}/manifest")


def _width(manifest: DataFrame) -> int:
    """The bytes of an id; an empty store has none."""
    found = [r.width for r in manifest.select("width").distinct().collect()]
    if len(found) > 1 or found not in ([], [2], [4]):
        raise ValueError(f"the manifest does not verify: ids of {found} bytes")
    return found[0] if found else 2


def _references(batches):
    """One row for each chunk of each document, after the manifest's root is checked."""
    for b in batches:
        doc, start, total, hashes, after, own = [], [], [], [], [], []
        for d, s, n, root, recipe, sizes in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            parts = [recipe[i : i + HASH] for i in range(0, len(recipe), HASH)]
            size = np.frombuffer(sizes, "<i4").astype(np.int64)
            if merkle_root(parts) != root or int(size.sum()) != n or len(size) != len(parts):
                raise ValueError(f"the manifest of document {d} does not verify")
            doc += [d] * len(parts)
            start += [s] * len(parts)
            total += [n] * len(parts)
            hashes += parts
            after += (n - np.cumsum(size)).tolist()
            own += size.tolist()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((doc, start, total, hashes, after, own), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ref", "after", "size"])


_REFERENCES = "doc_id long, start long, n_tokens long, ref binary, after long, size long"


def _check_chunks(width: int):
    def run(batches):
        for b in batches:
            crc, n = [], []
            for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if _digest(p) != h or len(p) % width:
                    raise ValueError(f"chunk {h.hex()} does not verify")
                crc.append(zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()))
                n.append(len(p) // width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["hash", "crc", "n_ids"])

    return run


class _Shift:
    """CRC-32 of a string followed by zero bytes, from the string's: linear over GF(2)."""

    def __init__(self):
        state = np.array([1 << i for i in range(32)], np.uint64)  # images of the single bits, moved by one byte
        for _ in range(8):
            state = (state >> np.uint64(1)) ^ np.where(state & np.uint64(1), np.uint64(0xEDB88320), np.uint64(0))
        self.powers = [state]

    @staticmethod
    def _apply(images: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for i in range(32):
            out ^= np.where((x >> np.uint64(i)) & np.uint64(1), images[i], np.uint64(0))
        return out

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """crc moved by n bytes, elementwise."""
        x, k = crc.astype(np.uint64), 0
        while (n >> k).any():
            if k == len(self.powers):
                self.powers.append(self._apply(self.powers[-1], self.powers[-1]))
            at = np.flatnonzero((n >> k) & 1)
            x[at] = self._apply(self.powers[k], x[at])
            k += 1
        return x


def _shifted(batches):
    shift = _Shift()
    for b in batches:
        crc = b.column("crc").to_numpy(zero_copy_only=False)
        after = b.column("after").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(shift(crc, 4 * after).astype(np.int64))], names=["doc_id", "start", "n_tokens", "part"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Every chunk is read once, checked against its name and given its CRC and number of
    ids; each recipe's sizes must be those of its chunks, and a document's CRC is
    composed of its chunks', so that no payload is sent anywhere. read_ids rebuilds the
    ids themselves.
    """
    manifest = read_manifest(spark, path)
    chunks = materialize(read_chunks(spark, path).mapInArrow(_check_chunks(_width(manifest)), "hash binary, crc long, n_ids long"), "crcs")
    refs = manifest.mapInArrow(_references, _REFERENCES)
    # a chunk that is missing or of another size breaks the job
    sound = F.when(F.col("n_ids") == F.col("size"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing or of another size than its recipe says")))
    found = refs.join(chunks, refs.ref == chunks.hash, "left").select("doc_id", "start", "n_tokens", "after", sound.alias("crc"))
    parts = found.mapInArrow(_shifted, "doc_id long, start long, n_tokens long, part long")
    return parts.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids, rebuilt from its recipe and checked against its number."""
    manifest = read_manifest(spark, path)
    width = _width(manifest)
    refs = manifest.mapInArrow(_references, _REFERENCES)
    joined = refs.join(read_chunks(spark, path), F.col("ref") == F.col("hash")).select("doc_id", "start", "n_tokens", "after", "payload")
    grouped = joined.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct((-F.col("after")).alias("k"), "payload"))).alias("parts"))

    def run(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in parts), f"<u{width}").astype(np.int64) for parts in b.column(3).to_pylist()]
            if any(len(x) != n for x, n in zip(ids, b.column(2).to_pylist(), strict=True)):
                raise ValueError("a document does not verify: its chunks hold another number of ids")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return grouped.mapInArrow(run, "doc_id long, start long, ids array<long>")


def op6_token_store(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = shared_dir(spark, "store")
    write_store(docs, default_tokenizer("byte_bpe_50k.json"), 2, path)
    return read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
