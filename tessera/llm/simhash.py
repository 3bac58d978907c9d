"""Near-duplicates by 64-bit SimHash, linked through vantage-point trees.

A fingerprint is cut into four bands of 16 bits. Two fingerprints that differ in at
most three bits agree in at least one band, so fingerprints meet in shards of equal
bands; this equality prunes most. Within a band the distance of the whole fingerprint from a fixed vantage point cuts a shard into
rings. A fingerprint whose distance is within the radius of its ring's upper boundary
is also sent as a visitor to the next ring, since its partners may lie beyond. Vantage
points are constants, so nothing is gathered to choose them. Inside a shard a
vantage-point tree over the fingerprints at hand finds the exact pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, forget, materialize, mix64, small
from .graph import connected_components

BITS = 64
BANDS = 4
#: Whole-distance rings of a shard.
RING = 8
#: A shard of this size or less is compared outright; a larger one is split by a vantage point.
LEAF = 1024
#: Shards of this size or less are searched together.
SMALL = 64
#: Words of a wide fingerprint that a shard compares: 128 bits part unrelated texts, and the sets themselves decide.
FILTER = 2


def _hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle of the text with A-Z in lower case; a shorter text is one shingle, a wordless one none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)), strict=False)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, seed) for g in grams], dtype="<u8")


def _majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 4096):
        total += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one text; see op2's contract. Null or wordless: 0."""
    return _majority(_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the unsigned fingerprint in a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            out = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(_distance(x[:, None], y[None, :]) <= radius)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances; fingerprints are single words, or structured with the words in the fields w0, w1 and so on."""
    if x.dtype.names is None:
        return np.bitwise_count(x ^ y)
    names = [k for k in x.dtype.names if k[0] == "w"]
    total = np.bitwise_count(x[names[0]] ^ y[names[0]]).astype(np.uint16)
    for k in names[1:]:
        total += np.bitwise_count(x[k] ^ y[k])
    return total


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of every link the smaller label until no link joins two labels."""
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low < high
        if not open_.any():
            return
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        i, j = i[open_], j[open_]


def _tree(fp: np.ndarray, label: np.ndarray, at: np.ndarray, radius: int, depth: int) -> None:
    """Link what is near within fp[at]: split by a vantage point, keep both sides' boundary in each."""
    if len(at) > LEAF and depth < 24:
        vantage = fp[at[int(mix64(np.array([depth * 7919 + len(at)], np.uint64))[0] % np.uint64(len(at)))]]
        d = _distance(fp[at], vantage).astype(np.int64)
        mu = int(np.median(d))
        # a partner across the boundary has a distance within radius of it: those go both ways
        inner, outer = at[d <= mu], at[d > mu - radius]
        if len(inner) <= 0.9 * len(at) and len(outer) <= 0.9 * len(at):
            _tree(fp, label, inner, radius, depth + 1)
            _tree(fp, label, outer, radius, depth + 1)
            return
    for s in range(0, len(at), LEAF):
        a = at[s : s + LEAF]
        for t in range(s, len(at), LEAF):
            b = at[t : t + LEAF]
            i, j = _near(fp[a], fp[b], radius)
            keep = i < j if s == t else slice(None)
            _merge(label, a[i[keep]], b[j[keep]])


def local_links(name: np.ndarray, fp: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints with names: links from each member of a local group to its first member."""
    label = np.arange(len(fp))
    _tree(fp, label, np.arange(len(fp)), radius, 0)
    far = np.flatnonzero(label != np.arange(len(fp)))
    return name[far], name[label[far]]


def _shards(radius: int):
    """fp -> (band, path, ring, home) rows."""
    vantage = np.uint64(0x9E3779B97F4A7C15)
    width = BITS // BANDS

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            d = np.bitwise_count(fp ^ vantage).astype(np.int64)
            ring = d // RING
            visit = np.flatnonzero(d + radius >= (ring + 1) * RING)
            at = np.concatenate([np.arange(len(fp)), visit])
            rings = np.concatenate([ring, ring[visit] + 1])
            for band in range(BANDS):
                path = (fp >> np.uint64(band * width)) & np.uint64((1 << width) - 1)
                key = (np.int64(band) << 32) | (path[at].astype(np.int64) << 8) | rings
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at].view(np.int64))], names=["shard", "fp"])

    return run


def _within_shards(read, find):
    """Links within each run of equal shards; read gives the names and the fingerprints of a batch, find(shard, names, fingerprints) the links."""

    def close(shard, names, fps):
        name, at = np.unique(np.concatenate(names), return_index=True)
        return find(int(shard), name, np.concatenate(fps)[at]) if len(name) > 1 else ()

    def run(batches):
        shard, names, fps = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            name, fp = read(batch)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            found = []
            for s, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if keys[s] != shard:
                    if names and (len(names) > 1 or len(names[0]) > 1):
                        found.append(close(shard, names, fps))
                    shard, names, fps = keys[s], [], []
                names.append(name[s:t])
                fps.append(fp[s:t])
            yield emit(found)
        if names:
            yield emit([close(shard, names, fps)])

    def emit(found):
        found = [x for x in found if len(x) and len(x[0])]
        a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) links that join every two fingerprints of `distinct` (column fp) that differ in radius bits or fewer.

    Within a shard only links to a group's first member are given, never all pairs.
    """
    if radius >= BANDS:
        raise ValueError("a radius below the number of bands is needed for exact search")

    placed = distinct.select("fp").mapInArrow(_shards(radius), "shard long, fp long")
    # a shard that holds one fingerprint has no pair: most are of that kind, and are merged by the sort
    def both(column):
        x = column.to_numpy(zero_copy_only=False)
        return x, x.view(np.uint64)

    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _within_shards(lambda b: both(b.column(1)), lambda _, name, fp: local_links(name, fp, radius)), "a long, b long"
    )


def _shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(_hashes(text, shingle, 42))


def wide_fingerprint(h: np.ndarray, words: int) -> bytes:
    """words 64-bit SimHashes of a set of hashes, each over its own mixing of them."""
    salt = mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.array([_majority(mix64(h ^ s).astype("<u8")) for s in salt], "<u8").tobytes()


def _set_name(h: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes(), 7)], np.uint64).view(np.int64)[0])


def radius_for(similarity: float, bits: int) -> int:
    """The distance that fingerprints of two sets of that Jaccard similarity exceed about once in a thousand: the mean and 3 deviations.

    Equally large sets are the worst case: others of that similarity have a greater cosine.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * p + 3 * np.sqrt(bits * p * (1 - p))))


def tables_for(similarity: float, n: int, recall: float = 0.99, load: int = 8) -> tuple[int, int]:
    """(bits of a table's key, number of tables) for n sets.

    A key has as many bits as leave `load` unrelated sets to a shard, 14 at least; there
    are as many tables as make it likely by `recall` that two sets of that similarity
    agree in one. Keys grow with the logarithm of n and tables with a power of about a
    quarter, so the work grows by far slower than the pairs.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    width = max(14, int(np.ceil(np.log2(max(n, 1) / load))))
    return width, int(np.ceil(np.log(1 - recall) / np.log1p(-((1 - p) ** width))))


def _fits(fp: np.ndarray, i, j, radius: int, similarity: float) -> np.ndarray:
    """Whether the members j are candidates of i: within radius, and of sizes that allow the similarity."""
    n, m = fp["n"][i].astype(np.float64), fp["n"][j].astype(np.float64)
    return (_distance(fp[j], fp[i]) <= radius) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)


def _pairs_of_small(shard: np.ndarray, fp: np.ndarray, radius: int, similarity: float):
    """Candidate pairs (i < j) within each run of equal shards, for many short runs at once."""
    for step in range(1, SMALL):
        i = np.flatnonzero(shard[step:] == shard[:-step])
        if not len(i):
            return
        i = i[_fits(fp, i, i + step, radius, similarity)]
        yield i, i + step


def _first_of_small(shard: np.ndarray, name: np.ndarray, fp: np.ndarray, radius: int, similarity: float, orders: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member with candidates in its run, the pair with the one that is first in the table's order."""
    found = list(_pairs_of_small(shard, fp, radius, similarity))
    i, j = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((mix64(name[j].view(np.uint64) + ((shard[j] >> width) % orders).astype(np.uint64)), i))
    i, j = i[order], j[order]
    first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
    return name[i[first]], name[j[first]]


def _stars(shard: int, name: np.ndarray, fp: np.ndarray, radius: int, similarity: float, orders: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members with leaders that are their candidates: as many as members at most.

    Members become leaders in the table's order, and each that is a candidate of a leader
    needs no other: a group of copies costs its size, not the pairs in it. A leader
    without followers is looked up among those of the leaders before it.
    """
    left = np.argsort(mix64(name.view(np.uint64) + np.uint64((shard >> width) % orders)))
    a, b, alone = [], [], []
    while len(left):
        lead, left = left[0], left[1:]
        near = _fits(fp, lead, left, radius, similarity)
        if near.any():
            a.append(left[near])
            b.append(np.full(int(near.sum()), lead))
        else:
            alone.append(lead)
        left = left[~near]
    followers = np.concatenate(a) if a else np.zeros(0, np.int64)
    for lead in alone if len(followers) else ():
        near = followers[_fits(fp, lead, followers, radius, similarity)][:1]
        a.append(np.full(len(near), lead))
        b.append(near)
    i, j = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
    return name[i], name[j]


def _across(shard: int, name: np.ndarray, fp: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(shard, name) of every member that has a candidate of another label in the shard: members, never pairs.

    Members of the commonest label meet the others alone, so that a large group that is
    linked already costs its size times the few that are not.
    """
    labels, at, count = np.unique(fp["label"], return_inverse=True, return_counts=True)
    has = np.zeros(len(name), bool)
    for x in np.flatnonzero(at != count.argmax()):
        near = np.flatnonzero(at != at[x])
        near = near[_fits(fp, x, near, radius, similarity)]
        has[near] = True
        has[x] |= len(near) > 0
    return np.full(has.sum(), shard), name[has]


def _across_small(shard: np.ndarray, name: np.ndarray, fp: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for many short runs of equal shards at once."""
    has = np.zeros(len(name), bool)
    for i, j in _pairs_of_small(shard, fp, radius, similarity):
        differ = fp["label"][i] != fp["label"][j]
        has[i[differ]] = has[j[differ]] = True
    return shard[has], name[has]


def _within_many(read, small_find, large_find):
    """Links within each run of equal shards, of rows sorted by shard: short runs together, long ones one by one."""

    def find(shard, name, fp):
        edge = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        size = np.repeat(np.diff(edge), np.diff(edge))
        short = size <= SMALL
        if short.any():
            yield small_find(shard[short], name[short], fp[short])
        for s, t in zip(edge[:-1], edge[1:], strict=True):
            if t - s > SMALL:
                yield large_find(int(shard[s]), name[s:t], fp[s:t])

    def emit(shard, name, fp):
        found = [x for x in find(shard, name, fp) if len(x[0])]
        a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            name, fp = read(batch)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), name, fp))
            if held[0][0][0] == held[-1][0][-1]:  # one shard so far
                continue
            shard, name, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(shard, shard[-1]))
            yield emit(shard[:last], name[:last], fp[:last])
            held = [(shard[last:], name[last:], fp[last:])]
        if held:
            yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _similar(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether two sets of hashes, sorted and as bytes, have that Jaccard similarity at least."""
    h, g = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    both = len(np.intersect1d(h, g, assume_unique=True))
    return both >= similarity * (len(h) + len(g) - both) - 1e-9


def _joined(name: np.ndarray, fp: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of that similarity that join the labels of a shard: every candidate pair is counted on its sets unless links join its ends already."""
    label, found = np.unique(fp["label"], return_inverse=True)[1], []
    common = np.bincount(label).argmax()
    for a in np.flatnonzero(label != common).tolist():
        others = np.flatnonzero(label != label[a])
        for b in others[_fits(fp, a, others, radius, similarity)].tolist():
            if label[a] != label[b] and _similar(fp["set"][a], fp["set"][b], similarity):
                found.append((a, b))
                label[label == label[b]] = label[a]
    at = np.array(found, np.int64).reshape(-1, 2)
    return name[at[:, 0]], name[at[:, 1]]


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, set) have that Jaccard similarity at least, counted exactly."""

    def run(batches):
        for batch in small(batches):
            keep = [_similar(x.as_buffer(), y.as_buffer(), similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(f"n{k}"), F.col("set").alias(f"set{k}")) for k in (0, 1))
    held = pairs.join(left, F.col("a") == F.col("n0")).select("a", "b", "set0").join(right, F.col("b") == F.col("n1"))
    return held.select("a", "b", "set0", "set1").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 8, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.99) -> DataFrame:
    """(id, component_id) by similarity of word shingles rather than by a few bits.

    At a similarity of 0.8 single 64-bit fingerprints differ in about ten bits, beyond
    any search by a few; so `words` fingerprints are laid side by side, and tables_for()
    says how many tables sample how many of their bits: a shard holds those equal in a
    table's bits. There are no vantage rings or trees over the corpus, as the radius is
    too wide for the triangle bound to prune. Within a shard leaders take what lies within
    radius_for(similarity) of them by FILTER of the fingerprints. Only candidates whose
    sets of shingles have a Jaccard similarity of `similarity` at least, counted on the
    sets themselves (64-bit hashes), are linked, in two rounds: first each member with its
    leader; then, for those that have candidates beyond their component, in the shards
    themselves, where every candidate pair that no links join yet is counted and only
    joining links are given. Pairs are never written.

    No pair below the similarity is linked. A pair at the similarity is found with a
    likelihood of `recall`, a closer one of more, equal texts always. component_id is
    the smallest id reachable. Null and empty texts are alike; rows with a null id have a
    null component. Repeated ids share their rows' components if texts are equal.
    """
    radius = radius_for(similarity, FILTER * BITS)
    shape = [(f"w{k}", "<u8") for k in range(FILTER)] + [("n", "<u4")]

    def mark(batches):
        for batch in small(batches):
            sets = [_shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            fps = [wide_fingerprint(h, words) + len(h).to_bytes(8, "little") for h in sets]
            names = pa.array([_set_name(h) for h in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(fps, pa.binary())], names=["doc_id", "node", "fp"])

    def hold(batches):
        for batch in small(batches):
            sets = [_shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_set_name(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "set"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = materialize(source.mapInArrow(mark, "doc_id long, node long, fp binary"), "wide")
    nodes = materialize(marks.where("doc_id is not null").groupBy("node", "fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    width, tables = tables_for(similarity, nodes.count(), recall)
    powers = 1 << np.arange(width, dtype=np.int64)
    rng = np.random.default_rng(words)
    chosen = [rng.choice(words * BITS, width, replace=False) for _ in range(tables)]

    def place(batches):
        for batch in small(batches, 4096):
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(raw[:, : words * 8], axis=1)
            own = np.ascontiguousarray(raw[:, : FILTER * 8]).view("<i8")
            n = np.ascontiguousarray(raw[:, words * 8 :]).view("<i8")[:, 0]
            columns = [batch.column(0), *(pa.array(own[:, k]) for k in range(FILTER)), pa.array(n.astype(np.int32)), *batch.columns[2:]]
            names = ["shard", "node", *(f"w{k}" for k in range(FILTER)), "n", *batch.schema.names[2:]]
            for table, at in enumerate(chosen):
                key = (np.int64(table) << width) + bits[:, at] @ powers
                yield pa.RecordBatch.from_arrays([pa.array(key), *columns], names=names)

    placed = "shard long, node long, " + ", ".join(f"w{k} long" for k in range(FILTER)) + ", n int"

    def read(batch):
        rest = [("label", "<i8"), ("set", "O")][: batch.num_columns - len(shape) - 2]
        out = np.empty(batch.num_rows, shape + rest)
        for k, (name, _) in enumerate(shape):
            x = batch.column(2 + k).to_numpy(zero_copy_only=False)
            out[name] = x.view("<u8") if name != "n" else x
        if rest:
            out["label"] = batch.column(2 + len(shape)).to_numpy(zero_copy_only=False)
        if len(rest) > 1:
            out["set"] = batch.column(3 + len(shape)).to_pylist()
        return batch.column(1).to_numpy(zero_copy_only=False), out

    def searched(rows: DataFrame, find) -> DataFrame:
        return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(find, "a long, b long")

    first = nodes.select("node", "fp").mapInArrow(place, placed)
    first = searched(first, _within_many(read, lambda s, name, fp: _first_of_small(s, name, fp, radius, similarity, 4, width), lambda s, name, fp: _stars(s, name, fp, radius, similarity, 4, width)))
    first = materialize(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    # every set with a candidate is in one of these pairs: the later round has no others
    some = first.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    active = materialize(nodes.join(some, F.col("node") == F.col("c"), "left_semi"), "active")
    wanted = few(active.select(F.col("first_id").alias("i")))
    sets = materialize(source.join(wanted, F.col("doc_id") == F.col("i"), "left_semi").select("text").mapInArrow(hold, "node long, set binary").dropDuplicates(["node"]), "sets")
    alike = materialize(_alike(first, sets, similarity), "alike")
    parts = connected_components(alike)
    known = active.join(parts.withColumnRenamed("node", "p"), F.col("node") == F.col("p"), "left").select("node", "fp", F.coalesce("component", "node").alias("label"))
    known = materialize(known, "known")
    apart = known.mapInArrow(place, f"{placed}, label long")
    apart = searched(apart, _within_many(read, lambda s, name, fp: _across_small(s, name, fp, radius, similarity), lambda s, name, fp: _across(s, name, fp, radius, similarity)))
    apart = materialize(apart.select(F.col("a").alias("shard"), F.col("b").alias("m")), "apart")
    flat = known.select(F.col("node").alias("k"), "label").join(materialize(known.select("node", "fp").mapInArrow(_filter_words(words), placed.removeprefix("shard long, ")), "filters"), F.col("k") == F.col("node"))
    held = apart.join(flat, F.col("m") == F.col("node")).drop("node", "k").join(sets, F.col("m") == F.col("node"))
    more = materialize(searched(held.select("shard", "node", *[name for name, _ in shape], "label", "set"), _within_shards(read, lambda _, name, fp: _joined(name, fp, radius, similarity))), "more")
    if not more.isEmpty():
        parts = connected_components(alike.unionByName(more))
    parts = materialize(parts.select(F.col("node").alias("p"), "component"), "parts")
    members = parts.join(nodes, F.col("p") == F.col("node"))
    roots = members.groupBy(F.col("component").alias("c")).agg(F.min("first_id").alias("root"))
    named = parts.join(roots, F.col("component") == F.col("c")).select("p", "root")
    named = nodes.join(named, F.col("node") == F.col("p"), "left").select(F.col("node").alias("f"), F.coalesce("root", "first_id").alias("component_id"))
    named = materialize(named, "classes")
    for old in (first, active, sets, alike, known, apart, more, parts):
        forget(old)
    return marks.join(named, F.col("node") == F.col("f"), "left").select(F.col("doc_id").alias(id_col), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _filter_words(words: int):
    """(node, fp) -> the words of the fingerprint that shards filter by, and the size of the set."""

    def run(batches):
        for batch in small(batches, 4096):
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, words * 8 + 8), np.uint8)
            own, n = np.ascontiguousarray(raw[:, : FILTER * 8]).view("<i8"), np.ascontiguousarray(raw[:, words * 8 :]).view("<i8")[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(own[:, k]) for k in range(FILTER)), pa.array(n.astype(np.int32))], names=["node", *(f"w{k}" for k in range(FILTER)), "n"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    Every row of docs is kept. Equal fingerprints are one node, so a large group of
    copies costs one. Empty and null texts share fingerprint zero and are linked like
    any other. Rows with a null id keep a null component.
    """
    marks = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    parts = materialize(connected_components(links(nodes, radius)).select(F.col("node").alias("fp"), "component"), "components")
    members = parts.join(nodes, "fp")
    roots = members.groupBy("component").agg(F.min("first_id").alias("root"))
    named = materialize(
        nodes.join(members.join(roots, "component").select("fp", "root"), "fp", "left").select(F.col("fp").alias("f"), F.coalesce("root", "first_id").alias("component_id")),
        "classes",
    )
    for read in (nodes, parts):
        forget(read)
    out = marks.join(named, marks.fp == named.f, "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs, shingle=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
