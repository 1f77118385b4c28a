"""URL filters: rules by host and path, else the host's reputation by empirical Bayes.

Labelled page outcomes (bad or not) are counted by site, a host without user and port.  Rates are shrunk from the top: all
pages, then public suffix, registered domain and site, each a beta-binomial whose prior has its parent's posterior mean and a strength
estimated by moments from the spread of all nodes of that level (between one page and a thousand).  A site without outcomes
gets its domain's mean, and so on.  An IP address is a domain of its own under the suffix ``ip``.  A page is blocked where the lower
``LEVEL`` quantile of its site's posterior exceeds ``LIMIT``: the rate from which blocking costs less than letting in, at ``COST``
good pages lost for a bad one kept out.

Outcomes are reduced to a row per site, which is written once; the levels above are made from that, so a host with a third of
all pages costs one row.  Pages meet their site's row in one equi-join that Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: (verdict, host, path).  A rule fits its host and all subdomains of it, for paths that start with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Second-level labels that form a public suffix with a country's top level.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Good pages that are worth losing to keep a bad one out; the bad rate from which blocking pays.
COST = 1.5
LIMIT = 1 / (1 + COST)
#: Level of the posterior's lower quantile, and the normal deviate that is exceeded with that chance.
LEVEL, Z = 0.05, 1.6448536269514722
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def is_address(site: Column) -> Column:
    return site.rlike(ADDRESS)


#: An IP address, version 4 or in brackets.
ADDRESS = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*)$"


def suffix_of(site: Column) -> Column:
    """The last label, or the last two where they are like ``co.uk``; ``ip`` for addresses."""
    last, second = F.substring_index(site, ".", -1), F.substring_index(F.substring_index(site, ".", -2), ".", 1)
    two = (F.length(last) == 2) & second.isin(*SECOND_LEVEL) & (F.size(F.split(site, "\\.")) > 1)
    return F.when(is_address(site), F.lit("ip")).when(two, F.substring_index(site, ".", -2)).otherwise(last)


def domain_of(site: Column) -> Column:
    """The registered domain: the suffix and the label before it; an address as it is."""
    suffix = suffix_of(site)
    two = F.length(F.replace(suffix, F.lit("."), F.lit(""))) < F.length(suffix)
    return F.when(is_address(site), site).when(two, F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in rules]
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    pick = lambda value: F.coalesce(*(F.when(fits[i], F.lit(value(rules[i]))) for i in order)) if rules else F.lit(None).cast("string")
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def _strength(nodes: DataFrame) -> float:
    """Strength of the prior of a level's nodes (n, bad, prior), by moments.  One row reaches the driver."""
    seen = F.col("n") > 0
    rate, n, prior = F.col("bad") / F.col("n"), F.col("n").cast("double"), F.col("prior")
    r = nodes.agg(
        F.count(F.when(seen, 1)).alias("k"), F.sum(n).alias("total"), F.sum(n * n).alias("squares"),
        F.sum(F.when(seen, n * (rate - prior) * (rate - prior))).alias("s"), F.sum(F.when(seen, n * prior * (1 - prior))).alias("v"),
    ).first()
    rho = 0.1
    if r["k"] > 1 and r["v"] and (room := r["total"] - r["squares"] / r["total"] - (r["k"] - 1)) > 0:
        rho = (r["s"] / (r["v"] / r["total"]) - (r["k"] - 1)) / room
    return 1 / max(0.001, min(0.5, rho)) - 1


def beta_quantile(a: Column, b: Column) -> Column:
    """The lower quantile, at ``LEVEL``, of a beta distribution: Abramowitz and Stegun 26.5.22; a and b below 1 count as 1.

    Against the integral it is within 0.003 where a and b are 4 or more, and below it otherwise, by 0.06 at most: a site
    with next to no good outcomes is judged a little too mildly.
    """
    p, q = 2 * F.greatest(a, F.lit(1.0)) - 1, 2 * F.greatest(b, F.lit(1.0)) - 1
    h, lam = 2 / (1 / p + 1 / q), F.lit((Z * Z - 3) / 6)
    w = Z * F.sqrt(h + lam) / h - (1 / q - 1 / p) * (lam + 5 / 6 - 2 / (3 * h))
    return (p + 1) / ((p + 1) + (q + 1) * F.exp(2 * w))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(site, n_outcomes, bad_rate, bound) of every site of ``outcomes``: site, bad (1, 0, or null where there is no outcome)."""
    counted = outcomes.groupBy("site").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    sites = materialize(counted.withColumn("domain", domain_of(F.col("site"))).withColumn("suffix", suffix_of(F.col("site"))), "sites")
    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    whole = sites.agg(*sums).first()
    root = ((whole["bad"] or 0) + 0.5) / ((whole["n"] or 0) + 1)
    shrunk = lambda strength: (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength)

    suffixes = materialize(sites.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(root)), "suffixes")
    domains = sites.groupBy("domain", "suffix").agg(*sums)
    domains = materialize(domains.join(suffixes.select("suffix", shrunk(_strength(suffixes)).alias("prior")), "suffix"), "domains")
    nodes = materialize(sites.join(domains.select("domain", shrunk(_strength(domains)).alias("prior")), "domain"), "nodes")
    strength = _strength(nodes)
    mean, weight = shrunk(strength), F.col("n") + strength
    return nodes.select("site", F.col("n").cast("long").alias("n_outcomes"), mean.alias("bad_rate"), F.least(mean, beta_quantile(mean * weight, (1 - mean) * weight)).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, n_outcomes, bad_rate and bound of every row of ``pages``.

    ``outcomes``: (host, bad) of labelled pages; without it the pages that a rule decides are the labelled ones.
    Null urls and urls without ``://`` belong to the host ''.  Hosts that differ by user or port share a reputation; very
    long urls are read whole.  Repeated rows are judged each; an empty table gives no rows; other columns are left out.
    Rates are rounded to six places.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("site", site_of(F.col("host")))
    own = ruled.select("site", (F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)).alias("bad"))
    if outcomes is not None:
        own = ruled.select("site", F.lit(None).cast("int").alias("bad")).unionByName(outcomes.select(site_of(F.col("host")).alias("site"), F.col("bad").cast("int").alias("bad")))
    known = reputation(own)
    bad = F.round("bound", 6) > LIMIT
    return ruled.join(known, "site").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise("allow")).alias("verdict"),
        "n_outcomes", F.round("bad_rate", 6).alias("bad_rate"), F.round("bound", 6).alias("bound"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql_level(name: str, key: str, nodes: str, parents: str, parent: str) -> str:
    return f"""{name}_j AS (
  SELECT c.*, p.mean AS prior FROM {nodes} c JOIN {parents} p USING ({parent})
), {name}_s AS (
  SELECT count(*) FILTER (n > 0) AS k, sum(n)::DOUBLE AS total, sum(n::DOUBLE * n) FILTER (n > 0) AS squares,
         sum(n * (bad / n - prior) * (bad / n - prior)) FILTER (n > 0) AS s, sum(n * prior * (1 - prior)) FILTER (n > 0) AS v
  FROM {name}_j
), {name}_k AS (
  SELECT 1 / greatest(0.001::DOUBLE, least(0.5::DOUBLE, coalesce(CASE WHEN k > 1 AND v > 0 AND total - squares / total - (k - 1) > 0
         THEN (s / (v / total) - (k - 1)) / (total - squares / total - (k - 1)) END, 0.1::DOUBLE))) - 1 AS strength FROM {name}_s
), {name} AS (
  SELECT {key}, n, (bad + strength * prior) / (n + strength) AS mean, n + strength AS weight FROM {name}_j, {name}_k
)"""


def oracle() -> str:
    """DuckDB SQL for op8."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", v, h + p) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, {case(2)} AS rule, {case(1)} AS ruled, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM h
), counted AS (
  SELECT site, string_split(site, '.') AS labels, count(ruled)::DOUBLE AS n, (count(*) FILTER (ruled = 'block'))::DOUBLE AS bad,
         len(labels) > 1 AND length(labels[-1]) = 2 AND labels[-2] IN ('{"', '".join(SECOND_LEVEL)}') AS two,
         regexp_matches(site, '{ADDRESS}') AS address
  FROM r GROUP BY site
), hosts AS (
  SELECT site, n, bad, CASE WHEN address THEN 'ip' ELSE array_to_string(labels[-(CASE WHEN two THEN 2 ELSE 1 END):], '.') END AS suffix,
         CASE WHEN address THEN site ELSE array_to_string(labels[-(CASE WHEN two THEN 3 ELSE 2 END):], '.') END AS domain FROM counted
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix
), suffixes AS (
  SELECT suffix, 1 AS one, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), root AS (
  SELECT 1 AS one, (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS mean FROM hosts
), {_sql_level("by_suffix", "suffix", "suffixes", "root", "one")},
{_sql_level("by_domain", "domain", "domains", "by_suffix", "suffix")},
{_sql_level("by_site", "site", "hosts", "by_domain", "domain")},
pq AS (
  SELECT *, 2 * greatest(1::DOUBLE, mean * weight) - 1 AS p, 2 * greatest(1::DOUBLE, (1 - mean) * weight) - 1 AS q,
         2 / (1 / p + 1 / q) AS h, {(Z * Z - 3) / 6!r}::DOUBLE AS lam FROM by_site
), b AS (
  SELECT *, {Z!r}::DOUBLE * sqrt(h + lam) / h - (1 / q - 1 / p) * (lam + 5::DOUBLE / 6 - 2 / (3 * h)) AS w,
         least(mean, (p + 1) / ((p + 1) + (q + 1) * exp(2 * w))) AS low FROM pq
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN round(low, 6) > {LIMIT!r}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       n::BIGINT AS n_outcomes, round(mean, 6) AS bad_rate, round(low, 6) AS bound
FROM r JOIN b USING (site)
"""
