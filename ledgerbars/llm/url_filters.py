"""URL filters: host and path rules, then empirical-Bayes host reputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_back

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the production rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def reputation_sql(pages: str, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, bound: float = 0.5, z: float = 1.645) -> str:
    """The query in SQL, to hold the frames against. Longest rule first."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fits = [f"WHEN (host = {quote(h)} OR right(host, {len(h) + 1}) = {quote('.' + h)}) AND left(path, {len(p)}) = {quote(p)}" for _, h, p in order]
    rule = " ".join(f"{f} THEN {quote(h + p)}" for f, (_, h, p) in zip(fits, order, strict=True))
    said = " ".join(f"{f} THEN {quote(v)}" for f, (v, _, _) in zip(fits, order, strict=True))
    case = lambda c: f"CASE {c} END" if c else "CAST(NULL AS VARCHAR(9))"
    level = lambda name, key, child, up, mean: f"""
{name}_at AS (SELECT c.{key}, c.n, c.k, {mean} AS mu FROM {child} c{up}),
{name}_s AS (SELECT least(0.5, greatest(0.001, coalesce(sum((k - n * mu) * (k - n * mu) - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0), 0.5))) AS rho FROM {name}_at WHERE n > 0),
{name} AS (SELECT {key}, mu * (1 / (SELECT rho FROM {name}_s) - 1) + k AS a, (1 - mu) * (1 / (SELECT rho FROM {name}_s) - 1) + n - k AS b FROM {name}_at)"""  # noqa: E731
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract({url}, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract({url}, '://[^/?#]*([^?#]*)', 1) AS path FROM {pages}),
p AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM parts),
r AS (SELECT page_id, host, path, {case(rule)} AS rule, {case(said)} AS said FROM p),
hosts AS (SELECT host, regexp_extract(host, '([^.]*[.])?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix,
                 CAST(count(said) AS DOUBLE) AS n, CAST(sum(CASE WHEN said = 'block' THEN 1 ELSE 0 END) AS DOUBLE) AS k FROM r GROUP BY host),
domains AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix),
world AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mu FROM suffixes),
{level("s", "suffix", "suffixes", "", "(SELECT mu FROM world)")},
{level("d", "domain", "domains", " JOIN s u ON c.suffix = u.suffix", "u.a / (u.a + u.b)")},
{level("h", "host", "hosts", " JOIN d u ON c.domain = u.domain", "u.a / (u.a + u.b)")},
j AS (SELECT host, CASE WHEN a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {bound} THEN 'block' ELSE 'allow' END AS verdict FROM h)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.said, j.verdict) AS verdict FROM r JOIN j ON r.host = j.host
"""


def labelled(pages: DataFrame, url_col: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, said): the parts of each url, the longest rule that fits and its verdict."""
    url = pages[url_col].cast("string")
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    p = pages.select("page_id", F.translate(part(r"://([^/?#]*)"), UPPER, LOWER).alias("host"), part(r"://[^/?#]*([^?#]*)").alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, said = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(said)
    return p.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))


def shrunk(level: DataFrame, mu: Column) -> DataFrame:
    """Adds a and b, the beta posterior of each row of ``level`` (n outcomes, k bad) around its prior mean ``mu``.

    The prior's strength 1 / rho - 1 is estimated from the spread of the level's rows around their means, by moments;
    one row with two sums reaches the driver.
    """
    n, k, m = F.col("n"), F.col("k"), F.col("mu")
    level = cut(level.withColumn("mu", mu))
    spread, scale = level.filter("n > 0").agg(F.sum((k - n * m) * (k - n * m) - n * m * (1 - m)), F.sum(n * (n - 1) * m * (1 - m))).first()
    rho = min(0.5, max(0.001, spread / scale if scale else 0.5))
    return level.withColumns({"a": m * (1 / rho - 1) + k, "b": (1 - m) * (1 / rho - 1) + n - k})


def url_filter(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, bound: float = 0.5, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    The rule whose host and path are longest decides the pages it fits; those verdicts are the labelled
    outcomes (block is bad). For the others the host's record decides: bad outcomes are beta-binomial
    around the mean of the registered domain (the last two labels), whose record is shrunk towards its
    suffix (the last label), which is shrunk towards all pages. The prior strength of each level comes
    from the spread of its members by moments, 1 to 999 pages. A page is blocked if the posterior mean less
    ``z`` standard deviations is above ``bound``.

    Null urls and urls without ``://`` have an empty host and path. A port, a user name and a trailing dot are part of the
    host's last label, as the host is what the contract says; no list of public suffixes is used, so ``co.uk`` is a
    registered domain. Rows and ids may repeat or be null;
    an empty table gives no rows; without any labelled page the prior alone decides and allows. A host
    with a third of all pages is combined before its shuffle and split in the join back, and so is a domain or a suffix with
    a third of all hosts or domains.
    """
    pages_ = labelled(pages, url_col, rules)
    bad = F.sum(F.when(F.col("said") == "block", 1).otherwise(0))
    hosts = pages_.groupBy("host").agg(F.count("*").alias("rows"), F.count("said").cast("double").alias("n"), bad.cast("double").alias("k"))
    hosts = cut(hosts.withColumns({"domain": F.regexp_extract("host", r"([^.]*[.])?[^.]*$", 0), "suffix": F.regexp_extract("host", r"[^.]*$", 0)}))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("members")]
    domains = cut(hosts.groupBy("domain").agg(F.min("suffix").alias("suffix"), *sums))
    suffixes = domains.groupBy("suffix").agg(*sums)
    seen = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("rows").alias("rows"), F.count("*").alias("hosts")).first()
    mean = F.col("up_a") / (F.col("up_a") + F.col("up_b"))
    above = lambda level, key: level.select(key, F.col("a").alias("up_a"), F.col("b").alias("up_b"), "members")
    s = shrunk(suffixes, F.lit(((seen["k"] or 0.0) + 1) / ((seen["n"] or 0.0) + 2)))
    d = shrunk(join_back(domains, above(s, "suffix").withColumnRenamed("members", "size"), ["suffix"], ["domain"], "size", seen["hosts"]), mean)
    h = shrunk(join_back(hosts, above(d, "domain"), ["domain"], ["host"], "members", seen["hosts"]), mean)
    a, b = F.col("a"), F.col("b")
    sure = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > bound
    judged = h.select("host", "rows", F.when(sure, "block").otherwise("allow").alias("method"))
    out = join_back(pages_, judged, ["host"], ["page_id", "path"], "rows", seen["rows"] or 0)
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "method").alias("verdict"))
