"""URL filter by rules and empirical-Bayes host reputation.

Page outcomes - labels, or where there are none the pages that a rule decides, a blocked one being bad and an allowed one good - are counted per host and rolled up to the registered domain, its public suffix
and the whole corpus. Each level has a beta prior around its parent's posterior mean. How strong it is, is fitted to the counts
themselves: the spread of a level's rates about their parents', beyond what binomial chance gives, is the
overdispersion of a beta-binomial (method of moments). Where hosts of a domain are alike the prior is strong and a host that has few labels
borrows from its domain, a domain from its suffix; where they differ it is weak. A host is blocked if its bad rate lies over the limit with the
wanted posterior probability, that is if the lower bound of its beta posterior does; the integral of the beta density is taken by Simpson's rule
over the logit of the rate.

Everything is built-in column functions; counts are pre-aggregated before each shuffle, and pages meet
hosts in a plain equi-join that adaptive execution may split if a host is hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumeset.llm.common import materialise

#: (verdict, host, path); fixed values
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Second-level labels under which names are registered (co.uk and the like).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0  # pseudo-observations that a parent level is worth
UNKNOWN_STRENGTH = 20.0  # where no parent has two labelled children, so that there is nothing to fit
SURE = 0.95  # posterior probability of a rate over the limit
MAX_BAD_RATE = 0.5
STEPS, SPAN = 128, 12.0  # of Simpson's rule on each side of the limit; standard deviations of the logit that it reaches
LEAST_SHAPE = 0.05  # of the beta posterior


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both are empty for a null url or one without ``://``."""
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def matching_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the page's or a parent of it and whose path starts the page's; null if none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def name_levels(df: DataFrame) -> DataFrame:
    """Add ``suffix`` and ``domain`` (registered domain) of ``host``. A port belongs to neither; an address in numbers is its own domain and suffix."""
    bare = F.regexp_replace("host", ":[0-9]*$", "")
    numbers = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    parts = F.when(numbers, F.array(bare)).otherwise(F.split(bare, r"\."))
    n = F.size(parts)
    at = lambda i: F.try_element_at(parts, F.lit(i))
    two = (n >= 3) & (F.length(at(-1)) == 2) & at(-2).isin(*SECOND_LEVEL)
    suffix = F.when(two, F.concat_ws(".", at(-2), at(-1))).otherwise(at(-1))
    domain = F.when(two, F.concat_ws(".", at(-3), at(-2), at(-1))).when(n >= 2, F.concat_ws(".", at(-2), at(-1))).otherwise(at(-1))
    return df.withColumn("suffix", suffix).withColumn("domain", domain)


def fitted_strength(children: DataFrame, name: str) -> DataFrame:
    """One row: the strength of the prior of children (n, b, and their parent's pn and pb), by moments."""
    n, b, pn, m = F.col("n"), F.col("b"), F.col("pn"), F.col("pb") / F.col("pn")
    chance = n * m * (1.0 - m) * (1.0 - n / pn)  # what binomial draws about the pooled rate give; none for an only child
    sums = children.where("n > 0").agg(F.sum((b - n * m) * (b - n * m)).alias("s"), F.sum(chance).alias("c"), F.sum(chance * (n - 1)).alias("m"))
    rho = F.least(F.greatest((F.col("s") - F.col("c")) / F.col("m"), F.lit(1.0 / (MOST_STRENGTH + 1.0))), F.lit(1.0 / (LEAST_STRENGTH + 1.0)))
    return sums.select(F.when(F.col("m") > 0, 1.0 / rho - 1.0).otherwise(UNKNOWN_STRENGTH).alias(name))


def share_over(a: Column, b: Column, limit: float) -> Column:
    """Probability of a rate over the limit under Beta(a, b), to about four digits; shapes under LEAST_SHAPE count as that."""
    a, b = F.greatest(a, F.lit(LEAST_SHAPE)), F.greatest(b, F.lit(LEAST_SHAPE))
    at, top, width = F.lit(math.log(limit / (1.0 - limit))), F.log(a / b), SPAN * F.sqrt(1.0 / a + 1.0 / b)
    height = a * top - (a + b) * F.log1p(F.exp(top))

    def side(start: Column, end: Column) -> Column:
        step = (end - start) / STEPS
        weight = lambda i: F.when(i.isin(0, STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        value = lambda u: F.exp(a * u - (a + b) * F.log1p(F.exp(u)) - height)
        points = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: weight(i) * value(start + step * i))
        return F.aggregate(points, F.lit(0.0), lambda x, y: x + y) * step

    low, high = top - width, top + width
    below, above = F.when(at > low, side(low, F.least(at, high))).otherwise(0.0), F.when(at < high, side(F.greatest(at, low), high)).otherwise(0.0)
    return above / (above + below)


def host_reputation(hosts: DataFrame, max_bad_rate: float = MAX_BAD_RATE) -> DataFrame:
    """Posterior of each host.

    hosts: host, labelled, bad (counts; one row per host). Returns host, labelled, bad, prior (mean of
    its domain), strength (of that prior), bad_rate (posterior mean) and over (probability that the rate is over the limit).
    """
    # the domain table is counted once from hosts, the suffix table from the domain table, and so on up
    counts = (F.sum("n").alias("n"), F.sum("b").alias("b"))
    named = name_levels(hosts).select("host", "domain", "suffix", F.col("labelled").alias("n"), F.col("bad").alias("b"))
    domains = materialise(named.groupBy("domain", "suffix").agg(*counts), "domains")
    suffixes = materialise(domains.groupBy("suffix").agg(*counts), "suffixes")
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pn"), F.coalesce(F.sum("b"), F.lit(0)).alias("pb"))

    def under(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        return children.join(parents.select(key, F.col("n").alias("pn"), F.col("b").alias("pb")), key)

    # the strengths and the whole are one row each
    strengths = (fitted_strength(under(named, domains, "domain"), "k1"), fitted_strength(under(domains, suffixes, "suffix"), "k2"), fitted_strength(suffixes.crossJoin(F.broadcast(whole)), "k3"))
    one = whole
    for k in strengths:
        one = one.crossJoin(F.broadcast(k))
    one = F.broadcast(materialise(one, "strengths"))
    root = (F.col("pb") + 1.0) / (F.col("pn") + 2.0)
    suffixes = suffixes.crossJoin(one).select("suffix", "k1", "k2", ((F.col("b") + F.col("k3") * root) / (F.col("n") + F.col("k3"))).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "k1", ((F.col("b") + F.col("k2") * F.col("suffix_rate")) / (F.col("n") + F.col("k2"))).alias("prior"))
    a, b = F.col("b") + F.col("k1") * F.col("prior"), F.col("n") - F.col("b") + F.col("k1") * (1.0 - F.col("prior"))
    return named.join(domains, "domain").select("host", F.col("n").alias("labelled"), F.col("b").alias("bad"), "prior", F.col("k1").alias("strength"), (a / (a + b)).alias("bad_rate"), share_over(a, b, max_bad_rate).alias("over"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, sure: float = SURE, max_bad_rate: float = MAX_BAD_RATE) -> DataFrame:
    """Judge every page's url: the longest fitting rule, else the reputation of its host.

    pages: page_id, url (other columns are ignored, so names cannot clash). outcomes: page_id, bad (0 or 1; the
    worst of repeated labels counts, nulls do not). A page without a host gets the verdict allow. Of rules that fit with one length the last by
    host and path holds. Repeated page rows are judged each, and each counts for its host; an empty table gives an empty result. Returns
    page_id, host, path, rule, verdict.
    """
    rule, verdict = matching_rule(rules)
    split = split_url(pages.select("page_id", "url")).select("page_id", "host", "path")
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = (
        split.select("page_id", "host").join(known, "page_id", "left").groupBy("host")
        .agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    seen = host_reputation(materialise(hosts, "hosts"), max_bad_rate).select("host", (F.col("over") >= float(sure)).alias("bad_host"))
    return (
        split.join(seen, "host", "left").withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("bad_host") & (F.col("host") != ""), "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict")
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes of pages from the label table: the id of a label names a page, and quality 0 or toxic 1 is a bad outcome."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def ruled_outcomes(pages: DataFrame, rules=RULES) -> DataFrame:
    """Outcomes of the pages that a rule decides: 1 where it blocks, 0 where it allows; the others have none."""
    _, verdict = matching_rule(rules)
    return split_url(pages.select("page_id", "url")).select("page_id", F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("bad"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page url; reads only page_id and url of ``pages``. What the rules decide tells how the pages of a host are that no rule fits."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, ruled_outcomes(pages))


#: Outcomes by rule and by label, in SQL
BY_RULE = "SELECT page_id, max(CASE f.verdict WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END) AS bad FROM fits WHERE page_id IS NOT NULL GROUP BY 1"
BY_LABEL = "SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY 1"


def oracle_sql(known: str = BY_RULE) -> str:
    """DuckDB SQL with the outcomes that ``known`` selects."""
    return SQL.replace("{known}", known)


SQL = """
WITH rest AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS r FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, host, path, (SELECT arg_max({'rule': rh || rp, 'verdict': verdict}, length(rh || rp)) FROM rules
    WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS f FROM split),
known AS ({known}),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS b, regexp_replace(host, ':[0-9]*$', '') AS bare,
         CASE WHEN regexp_full_match(bare, '[0-9]+([.][0-9]+){3}') THEN [bare] ELSE string_split(bare, '.') END AS p
  FROM split LEFT JOIN known USING (page_id) GROUP BY host),
named AS (
  SELECT *, len(p) >= 3 AND length(p[-1]) = 2 AND p[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'ne', 'net', 'or', 'org') AS two FROM hosts),
levels AS (
  SELECT host, n, b, CASE WHEN two THEN p[-2] || '.' || p[-1] ELSE p[-1] END AS suffix,
         CASE WHEN two THEN p[-3] || '.' || p[-2] || '.' || p[-1] WHEN len(p) >= 2 THEN p[-2] || '.' || p[-1] ELSE p[-1] END AS domain
  FROM named),
d AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b FROM levels GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM d GROUP BY ALL),
g AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(b), 0) AS b FROM s),
children AS (
  SELECT 1 AS k, c.n::DOUBLE AS n, c.b::DOUBLE AS b, p.n AS pn, p.b / p.n AS m FROM levels c JOIN d p USING (domain) WHERE c.n > 0
  UNION ALL SELECT 2, c.n, c.b, p.n, p.b / p.n FROM d c JOIN s p USING (suffix) WHERE c.n > 0
  UNION ALL SELECT 3, c.n, c.b, p.n, p.b / p.n FROM s c, g p WHERE c.n > 0),
moments AS (
  SELECT k, sum((b - n * m) * (b - n * m)) AS s, sum(n * m * (1 - m) * (1 - n / pn)) AS c, sum(n * m * (1 - m) * (1 - n / pn) * (n - 1)) AS m
  FROM children GROUP BY k),
fitted AS (
  SELECT v.k, CASE WHEN m > 0 THEN 1 / least(greatest((s - c) / m, 1.0::DOUBLE / 1001), 0.5::DOUBLE) - 1 ELSE 20 END::DOUBLE AS strength
  FROM (VALUES (1), (2), (3)) AS v(k) LEFT JOIN moments USING (k)),
ks AS (SELECT max(strength) FILTER (k = 1) AS k1, max(strength) FILTER (k = 2) AS k2, max(strength) FILTER (k = 3) AS k3 FROM fitted),
sr AS (SELECT suffix, (s.b + k3 * ((g.b + 1) / (g.n + 2))) / (s.n + k3) AS rate FROM s, g, ks),
dr AS (SELECT domain, (b + k2 * rate) / (n + k2) AS prior FROM d JOIN sr USING (suffix), ks),
shapes AS (SELECT host, greatest(b + k1 * prior, 0.05::DOUBLE) AS a, greatest(n - b + k1 * (1 - prior), 0.05::DOUBLE) AS z FROM levels JOIN dr USING (domain), ks),
ends AS (SELECT *, ln(a / z) AS top, 12 * sqrt(1 / a + 1 / z) AS w, a * ln(a / z) - (a + z) * ln(1 + a / z) AS height FROM shapes),
sides AS (
  SELECT host, CASE WHEN 0 > top - w THEN
      list_sum(list_transform(range(129), lambda i: (CASE WHEN i IN (0, 128) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * exp(a * (top - w + (least(0, top + w) - top + w) / 128 * i) - (a + z) * ln(1 + exp(top - w + (least(0, top + w) - top + w) / 128 * i)) - height)))
      * (least(0, top + w) - top + w) ELSE 0 END AS below,
    CASE WHEN 0 < top + w THEN
      list_sum(list_transform(range(129), lambda i: (CASE WHEN i IN (0, 128) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * exp(a * (greatest(0, top - w) + (top + w - greatest(0, top - w)) / 128 * i) - (a + z) * ln(1 + exp(greatest(0, top - w) + (top + w - greatest(0, top - w)) / 128 * i)) - height)))
      * (top + w - greatest(0, top - w)) ELSE 0 END AS above
  FROM ends),
seen AS (SELECT host, host <> '' AND above / (above + below) >= 0.95 AS bad_host FROM sides)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, CASE WHEN bad_host THEN 'block' ELSE 'allow' END) AS verdict
FROM fits JOIN seen USING (host)
"""

ORACLE_SQL = oracle_sql()
