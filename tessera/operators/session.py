"""A session's objects: frames, sets of candidates and records, and references to them in words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CURRENT = ("that", "it", "current", "last", "previous", "latest")


def top_n(reference: str) -> int | None:
    """The n of a phrase with `top n`, if it is positive."""
    m = re.search(r"\btop\s+(\d+)\b", reference.lower())
    return int(m[1]) or None if m else None


class Session:
    """Nested state with dotted keys. Records are dicts on the driver; data are frames."""

    def __init__(self):
        self.state, self.objects, self.current = {}, {}, {}

    def register(self, kind: str, record: dict, set_current: bool = True) -> str:
        """A record under the next id of its kind, such as cmp_001, or under its own."""
        prefix = kind[:3]
        own = record.get("id") or f"{prefix}_{1 + sum(i.startswith(f'{prefix}_') for i in self.objects):03d}"
        self.objects[own] = {**record, "id": own, "kind": kind}
        if set_current:
            self.current[kind] = self.current[None] = own
        return own

    def put(self, key: str, value) -> None:
        at = self.state
        *path, last = key.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value

    def _walk(self, value, key: str):
        if isinstance(value, DataFrame) or (isinstance(value, str) and value.lower().endswith((".csv", ".parquet"))):
            yield key, value
        elif isinstance(value, dict):
            for k, v in value.items():
                yield from self._walk(v, f"{key}.{k}" if key else str(k))

    def loadable(self, limit: int = 100) -> list[tuple[str, str]]:
        """(dotted key, 'frame' or 'path') of all data in the state: frames first, then by key."""
        found = sorted((not isinstance(v, DataFrame), k) for k, v in self._walk(self.state, ""))
        return [(k, "path" if path else "frame") for path, k in found[:limit]]

    def get(self, spark, key: str) -> DataFrame:
        """The frame at a dotted key; of a container its first frame, else its first path, read."""
        at = self.state
        for p in key.split("."):
            if not isinstance(at, dict) or p not in at:
                raise KeyError(f"no session key {key!r}; data are at {[k for k, _ in self.loadable()]}")
            at = at[p]
        found = sorted(self._walk(at, key), key=lambda x: (not isinstance(x[1], DataFrame), x[0]))
        if not found:
            raise TypeError(f"session key {key!r} holds no data")
        if isinstance(found[0][1], DataFrame):
            return found[0][1]
        from tessera.sources import readers

        return readers.load(spark, found[0][1])

    def resolve(self, reference: str, kind: str | None = None) -> dict:
        """{'status': resolved, ambiguous or not_found, ...}: current words, an id, a number, then texts that are or hold the reference."""
        text = (reference or "").strip()
        low = text.lower()
        own = [r for r in self.objects.values() if kind in (None, r["kind"])]
        if low in ("", *CURRENT) or any(low.startswith(f"{w} ") for w in CURRENT):
            now = self.objects.get(self.current.get(kind))
            return {"status": "resolved", "object": now} if now else {"status": "not_found"}
        if text in self.objects and kind in (None, self.objects[text]["kind"]):
            return {"status": "resolved", "object": self.objects[text]}
        number = re.search(r"(?:^|#|\s)(\d+)$", low)
        if number and re.fullmatch(r"(?:\w+ )?#?\d+", low) and 1 <= int(number[1]) <= len(own):
            return {"status": "resolved", "object": own[int(number[1]) - 1]}
        hits = [r for r in own if any(low in str(r[k]).lower() for k in ("id", "label", "smiles", "original_smiles", "node_index") if r.get(k) is not None)]
        if len(hits) == 1:
            return {"status": "resolved", "object": hits[0]}
        return {"status": "ambiguous", "matches": hits[:10]} if hits else {"status": "not_found"}


def register_candidates(df: DataFrame, key: str, valid: str, order: str, set_id: str) -> DataFrame:
    """All candidates, also the rejected, with set, a number among the valid ones in order, and their state."""
    from tessera.operators.frame import with_row_id

    ok = F.coalesce(F.col(valid), F.lit(False))
    good = with_row_id(df.where(ok), [order], "_n").withColumns({"candidate_id": F.format_string("cmp_%03d", F.col("_n") + 1), "state": F.lit("registered")}).drop("_n")
    bad = df.where(~ok).withColumns({"candidate_id": F.lit(None).cast("string"), "state": F.lit("rejected")})
    return good.unionByName(bad).withColumn("set_id", F.lit(set_id))


def resolve_candidates(df: DataFrame, reference: str, rank: str, set_col: str = "set_id", order: str = "created") -> DataFrame:
    """The candidates that words mean: those of the newest set, or of the set whose id stands in the words; of `top n` the first n by rank."""
    low = reference.lower()
    named = df.where(F.lit(low).contains(F.lower(set_col)))
    newest = df.groupBy(set_col).agg(F.max(order).alias("_at")).orderBy(F.desc("_at"), F.desc(set_col)).limit(1).select(F.col(set_col).alias("_set"))
    rows = named if not named.isEmpty() else df.join(F.broadcast(newest), F.col(set_col) == F.col("_set"), "left_semi")
    rows, n = rows.where("state = 'registered'"), top_n(low)
    return rows.orderBy(F.asc_nulls_last(rank)).limit(n) if n else rows


def materialize_candidates(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """The candidates' columns written as a dataset, and read again."""
    df.select(*columns).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
