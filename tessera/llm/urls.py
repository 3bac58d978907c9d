"""URL filters: fixed rules first, then an empirical-Bayes reputation of hosts.

DataFrame functions only. Labelled page outcomes are counted by host; counts roll up to
registered domain and suffix. At each level a group's rate of bad pages has a Beta
prior centred on its parent's posterior mean without the group's own pages (else they
would count twice), whose strength comes from how much the
groups of that level differ (a moment estimate). A host is blocked when the lower
posterior bound of its rate, a quantile of the Beta distribution, exceeds a limit: few
labels never suffice. Every host of the pages is judged, those without labels by their
domain, suffix or the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path) of the fixed rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Second labels under which two-letter domains register names (fixed values): co.uk, com.tr or gov.br are suffixes.
REGISTRIES = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "nom", "or", "org")
LONG_SUFFIX = f"^(?:{'|'.join(REGISTRIES)})[.][a-z]{{2}}$"
LIMIT, SURE = 0.5, 1.6448536269514722
#: Bounds of the strength of a prior, in labelled pages.
WEAKEST, STRONGEST = 1.0, 1000.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for a url without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, or nulls; of two as long, the first given."""
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def domain_suffix(host: Column, long_suffix: str = LONG_SUFFIX) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; a port and what stands before an @ are left out. A single label is its own domain and suffix.

    long_suffix: an expression for the suffixes of two labels, such as an alternation of a public list.
    """
    name = F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    long_ = two.rlike(long_suffix)
    return F.when(long_, F.substring_index(name, ".", -3)).otherwise(two), F.when(long_, two).otherwise(F.substring_index(name, ".", -1))


def below(limit: float, alpha: Column, beta: Column) -> Column:
    """The normal deviate of the probability that a Beta variable is at most limit (Abramowitz and Stegun 26.5.21).

    The approximation is one expression at any size; with alpha + beta of one or more the
    probability is right to about one in a hundred.
    """
    w, v = F.cbrt(beta * limit), F.cbrt(alpha * (1 - limit))
    return 3 * (w * (1 - 1 / (9 * beta)) - v * (1 - 1 / (9 * alpha))) / F.sqrt(w * w / beta + v * v / alpha)


def _strength(groups: DataFrame, n: str, bad: str, mean: str) -> float:
    """The prior strength under which the spread of the groups' rates about their means is as seen: sum over groups of
    n (rate - mean)^2 against what the binomial alone would give."""
    q = F.col(mean) * (1 - F.col(mean))
    r = groups.where((F.col(n) > 1) & (q > 0)).agg(
        F.sum((F.col(bad) - F.col(n) * F.col(mean)) ** 2 / (F.col(n) * q)).alias("seen"), F.count("*").alias("k"), F.sum(F.col(n) - 1).alias("more")
    ).first()
    # E[seen] = k + more / (strength + 1)
    if not r.k or r.seen is None or r.seen <= r.k:
        return STRONGEST
    return float(min(STRONGEST, max(WEAKEST, r.more / (r.seen - r.k) - 1)))


def reputation(outcomes: DataFrame, limit: float = LIMIT, sure: float = SURE, long_suffix: str = LONG_SUFFIX) -> DataFrame:
    """outcomes: (host, n, bad) by host. Gives host, posterior alpha and beta, mean, below, and blocked.

    below is the deviate of the probability that the host's rate is at most limit; the
    host is blocked if it is under -sure, that is, if that quantile of the posterior
    exceeds limit. A host without labels (n = 0) has its domain's posterior as prior and nothing of its own; a
    domain without labels its suffix's, and a suffix without labels that of the whole.
    """
    domain, suffix = domain_suffix(F.col("host"), long_suffix)
    hosts = materialize(outcomes.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    add = lambda df, key: df.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(add(hosts, ("domain", "suffix")), "domains")
    suffixes = materialize(add(domains, ("suffix",)), "suffixes")
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, bad = float(whole.n or 0), float(whole.bad or 0)

    def level(groups: DataFrame) -> DataFrame:
        k = _strength(groups, "n", "bad", "prior")
        alpha, beta = F.col("prior") * k + F.col("bad"), (1 - F.col("prior")) * k + F.col("n") - F.col("bad")
        return groups.withColumns({"k": F.lit(k), "alpha": alpha, "beta": beta}).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))

    def under(groups: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        above = parents.select(F.col(key).alias("parent"), F.col("prior").alias("p"), F.col("k").alias("pk"), F.col("n").alias("pn"), F.col("bad").alias("pb"))
        prior = (F.col("p") * F.col("pk") + F.col("pb") - F.col("bad")) / (F.col("pk") + F.col("pn") - F.col("n"))
        return groups.join(above, F.col(key) == F.col("parent")).withColumn("prior", prior).drop("parent", "p", "pk", "pn", "pb")

    suffixes = materialize(level(suffixes.withColumn("prior", (bad - F.col("bad") + 0.5) / (n - F.col("n") + 1.0))), "suffix-posteriors")
    domains = materialize(level(under(domains, suffixes, "suffix")), "domain-posteriors")
    hosts = level(under(hosts, domains, "domain"))
    hosts = hosts.withColumn("below", below(limit, F.col("alpha"), F.col("beta")))
    return hosts.select("host", "n", "bad", "alpha", "beta", "mean", "below", (F.col("below") < -sure).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url).

    outcomes: (page_id, bad 0 or 1) of labelled pages; a page labelled twice is bad if
    any label says so; nulls are no labels. A rule decides where one fits; elsewhere the
    host's reputation, which for a host without labels is that of its domain or suffix.
    A repeated page_id is one row for each of its rows; its label counts for every one.
    """
    host, path = host_path(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = outcomes.where("page_id is not null and bad is not null").groupBy(F.col("page_id").alias("labelled")).agg(F.max("bad").cast("long").alias("bad"))
    counted = parsed.join(marks, F.col("page_id") == F.col("labelled"), "left").groupBy("host").agg(F.count("labelled").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = materialize(reputation(counted, **options).select(F.col("host").alias("known"), "blocked").where("blocked"), "reputation")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = parsed.join(known, F.col("host") == F.col("known"), "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def op3_url_reputation(spark, sf_dir: str) -> DataFrame:
    """A label of the document of the same number is the outcome of a page: bad if it is of low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when((F.col("quality") == 1) | (F.col("toxic") == 0), 0)
    return judge(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


_PARSED = """
WITH p AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
)"""


def _strength_sql(groups: str) -> str:
    return f"""(SELECT CASE WHEN count(*) = 0 OR sum((bad - n * prior) * (bad - n * prior) / (n * prior * (1 - prior))) <= count(*) THEN {STRONGEST}
      ELSE least({STRONGEST}, greatest({WEAKEST}, sum(n - 1) / (sum((bad - n * prior) * (bad - n * prior) / (n * prior * (1 - prior))) - count(*)) - 1)) END
      FROM {groups} WHERE n > 1 AND prior * (1 - prior) > 0)"""


def _level_sql(name: str, groups: str) -> str:
    return f"""{name} AS (SELECT *, alpha / (alpha + beta) AS mean FROM (SELECT g.*, k, prior * k + bad AS alpha, (1 - prior) * k + n - bad AS beta
      FROM {groups} g, (SELECT {_strength_sql(groups)} AS k)))"""


_RULE_SQL = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN %{s}%{h + p}%" for s, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
) + " END"


def _rule_sql(part: int) -> str:
    import re

    return re.sub("%([^%]*)%([^%]*)%", lambda m: f"'{m[part]}'", _RULE_SQL)


OP3_SQL = f"""{_PARSED}, l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 OR toxic = 0 THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING bad IS NOT NULL
), c AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM h LEFT JOIN l ON h.page_id = l.doc_id GROUP BY host
), s AS (
  SELECT *, string_split(regexp_replace(string_split(host, '@')[-1], ':[0-9]*$', ''), '.') AS part FROM c
), d AS (
  SELECT host, n, bad, regexp_matches(array_to_string(part[-2:], '.'), '{LONG_SUFFIX}') AS long_, array_to_string(part[-2:], '.') AS two, array_to_string(part[-3:], '.') AS three, part[-1] AS one FROM s
), hosts AS (
  SELECT host, n, bad, CASE WHEN long_ THEN three ELSE two END AS domain, CASE WHEN long_ THEN two ELSE one END AS suffix FROM d
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
g1 AS (SELECT *, ((SELECT sum(bad) FROM suffixes) - bad + 0.5::DOUBLE) / ((SELECT sum(n) FROM suffixes) - n + 1) AS prior FROM suffixes),
{_level_sql("p1", "g1")},
g2 AS (SELECT domains.*, (p1.prior * p1.k + p1.bad - domains.bad) / (p1.k + p1.n - domains.n) AS prior FROM domains JOIN p1 USING (suffix)),
{_level_sql("p2", "g2")},
g3 AS (SELECT hosts.*, (p2.prior * p2.k + p2.bad - hosts.bad) / (p2.k + p2.n - hosts.n) AS prior FROM hosts JOIN p2 USING (domain)),
{_level_sql("p3", "g3")},
w AS (SELECT host, alpha, beta, cbrt(beta * {LIMIT}) AS w, cbrt(alpha * (1 - {LIMIT})) AS v FROM p3),
r AS (SELECT host, 3 * (w * (1 - 1 / (9 * beta)) - v * (1 - 1 / (9 * alpha))) / sqrt(w * w / beta + v * v / alpha) < -{SURE} AS blocked FROM w)
SELECT page_id, host, path, {_rule_sql(2)} AS rule, coalesce({_rule_sql(1)}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN r USING (host)"""
