"""Secret scans: fixed patterns, and how many owners hold each value across the corpus.

DataFrame functions only. A pattern's matches come with their places: the text is split
at the matches, and the running sum of the lengths of gaps and matches, by a window over
one document's matches, gives each start in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few, materialize

#: (kind, gate, pattern, group of the value, least characters of that group). Kinds in the order that ties take.
BASE = (
    ("assign", r"(?i)pass(?:word|wd)|secret|token|api_?key", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24}", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: Long unbroken values without a known form. They count only where few owners hold them.
GENERIC = ("generic", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])", 0, 20)
#: Paths and rules: three slashes or a double dash, and every part between separators is a word or a number. Random keys have such parts only by chance.
SEPARATED = "/[^/]*/[^/]*/|--"
WORDS = "^[+/_-]*+(?:(?:[A-Z]?[a-z]*+[0-9]{0,4}+|[a-z]*+(?:[A-Z][a-z]++){0,4}+[0-9]{0,4}+|[A-Z]++[0-9]{0,4}+|[0-9]++)(?:[+/_-]++|$))*+$"
KINDS = (*[b[0] for b in BASE], GENERIC[0])
#: A value held by more owners, or by more repositories, than this is an example that went round.
FEW_OWNERS, FEW_REPOSITORIES = 2, 2


def _matches(text: Column, number: int, gate: str, pattern: str, group: int) -> Column:
    """The matches of one pattern: kind number, order, lengths of the gap before, of the match and of its value, and the value's hash."""
    rx = F.lit(pattern)
    whole = F.regexp_extract_all(text, rx, F.lit(0))
    value = F.regexp_extract_all(text, rx, F.lit(group)) if group else whole
    parts = F.arrays_zip(whole.alias("w"), value.alias("v"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("g"))
    found = F.transform(
        parts,
        lambda p, i: F.struct(
            F.lit(number).alias("kind"), i.alias("pos"), F.length(p["g"]).alias("gap"), F.length(p["w"]).alias("len"), F.length(p["v"]).alias("value_len"),
            # enough of a digest to tell values apart without keeping them
            F.substring(F.sha2(p["v"].cast("binary"), 256), 1, 32).alias("value"),
            (p["v"].rlike("[0-9]") & p["v"].rlike("[A-Za-z]") & ~(p["v"].rlike(SEPARATED) & p["v"].rlike(WORDS))).alias("mixed"),
        ),
    )
    return F.when(text.rlike(gate), found).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,value_len:int,value:string,mixed:boolean>>"))


def find_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), few_owners: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES) -> tuple[DataFrame, DataFrame]:
    """(rows, spans) of docs (doc_id, text, and the columns that name owner and repository).

    rows: one for each row of docs, with row_id, doc_id. spans: row_id, kind (its number
    in KINDS), start, end (code points, end exclusive), owners, repositories, live. A
    value is live-looking if few_owners owners and few_repositories repositories or fewer
    hold it anywhere in the corpus: one that a single owner has spread over many
    repositories is an example too. A null owner counts as one. Base kinds are always given; GENERIC ones only if they
    are live, hold digits and letters, are no paths (WORDS), and touch no base span.
    Null texts are empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = [*BASE, GENERIC]
    found = F.concat(*[_matches(text, k, gate, pattern, group) for k, (_, gate, pattern, group, _) in enumerate(every)])
    name = lambda *c: F.to_json(F.struct(*[F.col(x) for x in c]))
    scanned = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(name(owner)).alias("owner"), F.xxhash64(name(*repository)).alias("repository"), found.alias("found")
    )
    scanned = materialize(scanned, "scanned")
    each = scanned.where(F.size("found") > 0).select("row_id", "owner", "repository", F.explode("found").alias("f")).select("row_id", "owner", "repository", "f.*")
    order = Window.partitionBy("row_id", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    least = F.element_at(F.array(*[F.lit(x[4]) for x in every]), F.col("kind") + 1)
    each = each.where(F.col("value_len") >= least)
    # what a base span touches is no generic one: base spans that begin before its end and end after its start
    base = F.col("kind") < len(BASE)
    row = Window.partitionBy("row_id").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(row.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(row.rowsBetween(0, Window.unboundedFollowing))
    free = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    each = each.withColumn("free", free).where(base | (F.col("free") & F.col("mixed"))).select("row_id", "owner", "repository", "kind", "start", "end", "value")
    each = materialize(each, "candidates")
    held = each.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("value", "owner").agg(F.count("*").alias("n"))
    held = held.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories")).withColumnRenamed("value", "v")
    spans = each.join(materialize(held, "owners"), F.col("value") == F.col("v")).withColumn("live", (F.col("owners") <= few_owners) & (F.col("repositories") <= few_repositories))
    spans = spans.where((F.col("kind") < len(BASE)) | F.col("live")).select("row_id", "kind", F.col("start").cast("long"), F.col("end").cast("long"), "owners", "repositories", "live")
    return scanned.select("row_id", "doc_id"), spans


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: row_id, doc_id, found (spans in order), or an empty array."""
    rows, spans = find_secrets(docs, **options)
    lists = spans.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "owners", "repositories"))).alias("found")).withColumnRenamed("row_id", "r")
    out = rows.join(lists, F.col("row_id") == F.col("r"), "left")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,owners:bigint,repositories:bigint>>")
    return out.select("row_id", "doc_id", F.coalesce("found", empty).alias("found"))


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    found = F.col("found")
    n = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(found, lambda s: s["kind"] < len(BASE))
    return scan(docs).select(
        "doc_id", *[n(k).alias(f"n_{KINDS[k]}") for k in range(len(BASE))],
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(found).alias("spans"),
        F.size(F.filter(found, lambda s: s["live"])).cast("long").alias("n_live"),
    )


def masked(docs: DataFrame, mask: str = "[secret]", id_col: str = "doc_id", **options) -> DataFrame:
    """(id, new_text) of the documents that hold live-looking values, each such span replaced by mask.

    Overlapping spans become one mask. Ids must be unique (common.keyed makes them so);
    rows without one are left out.
    """
    owner, repository = options.get("owner", "source"), options.get("repository", ("source", "lang"))
    docs = docs.select(F.col(id_col).alias("doc_id"), "text", *dict.fromkeys((owner, *repository)))
    found = scan(docs, **options).select(F.col("doc_id").alias("i"), F.filter("found", lambda s: s["live"]).alias("found"))
    found = materialize(found.where((F.size("found") > 0) & F.col("i").isNotNull()), "live")
    some = docs.select("doc_id", "text").join(few(found.select("i")), F.col("doc_id") == F.col("i"), "left_semi").join(found, F.col("doc_id") == F.col("i"))
    text = F.col("text").cast("string")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        more = F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.struct(F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return some.select(F.col("doc_id").alias(id_col), done.alias("new_text"))


def _either(word: str) -> str:
    """A word's letters in either case, as classes: an expression's own rules of case reach beyond A-Z."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"""({_NAMES})["\\'\\']?\\x20*[:=]\\x20*["\\'\\']?([A-Za-z0-9+/_.=-]+)""".replace("\\'\\'", "''")
_SQL_KINDS = ((0, _ASSIGN, 2, 6), (1, "AKIA[A-Z0-9]+", 0, 20), (2, "[0-9a-f]+", 0, 24), (3, "[A-Za-z0-9+/_-]+", 0, 20))
_PART = "[A-Z]?[a-z]*[0-9]{0,4}|[a-z]*([A-Z][a-z]+){0,4}[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]+"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t, coalesce('v' || source, 'n') AS o, coalesce('v' || source, 'n') || chr(31) || coalesce('v' || lang, 'n') AS r FROM documents),
l AS ({" UNION ALL ".join(f"SELECT row_id, o, r, {k} AS kind, {least} AS least, regexp_extract_all(t, '{rx}') AS ms, regexp_extract_all(t, '{rx}', {group}) AS vs, string_split_regex(t, '{rx}') AS gs FROM d" for k, rx, group, least in _SQL_KINDS)}),
e AS (SELECT row_id, o, r, kind, least, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1 : len(ms)]) AS g FROM l WHERE len(ms) > 0),
f AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY row_id, kind ORDER BY i))::BIGINT AS e FROM e QUALIFY length(v) >= least),
s AS (SELECT row_id, o, r, kind, v, e - length(m) AS b, e FROM f),
x AS (SELECT * FROM s WHERE kind < 3 UNION ALL SELECT * FROM s WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
  AND NOT (regexp_matches(v, '/[^/]*/[^/]*/|--') AND len(list_filter(string_split_regex(v, '[+/_-]+'), lambda p: NOT regexp_full_match(p, '{_PART}'))) = 0)
  AND NOT EXISTS (SELECT 1 FROM s h WHERE h.kind < 3 AND h.row_id = s.row_id AND h.b < s.e AND h.e > s.b)),
q AS (SELECT v, count(DISTINCT o) <= {FEW_OWNERS} AND count(DISTINCT r) <= {FEW_REPOSITORIES} AS live FROM x GROUP BY v),
k AS (SELECT x.*, live, (['assign', 'access', 'hex', 'generic'])[kind + 1] || ':' || b || ':' || e AS w FROM x JOIN q USING (v) WHERE kind < 3 OR live),
a AS (SELECT row_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (live) AS n_live, string_agg(w, ',' ORDER BY b, kind) FILTER (kind < 3) AS base, string_agg(w, ',' ORDER BY b, kind) AS spans FROM k GROUP BY row_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN a USING (row_id)"""
