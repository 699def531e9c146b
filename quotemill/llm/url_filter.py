"""URL filters by host-suffix and path-prefix expressions.

Every url is expanded into expressions: each suffix of its host's labels joined with each prefix of
its path that ends at a slash. Expressions and rules meet in an equi-join on the first 4 bytes of
their SHA-256; a meeting counts only if the full digests agree; of the rules left, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import let

#: The rules of the contract (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
#: Rules are broadcast up to this many (about 30 MB); beyond it, both sides are shuffled.
MAX_BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most_labels: int) -> Column:
    """Suffixes of whole labels, with at most `most_labels` labels: no rule has more."""
    parts = F.split(host, r"\.")
    size = F.size(parts)
    counts = F.sequence(F.lit(1), F.least(size, F.lit(most_labels)))
    return F.transform(counts, lambda n: F.array_join(F.slice(parts, size - n + 1, n), "."))


def path_prefixes(path: Column, longest: int) -> Column:
    """Prefixes that end at a slash, with at most `longest` characters: no rule's path has more."""
    head = F.substring(path, 1, longest)

    def cuts(p: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.length(p)), lambda i: p.substr(i, F.lit(1)) == "/")
        return F.transform(at, lambda i: p.substr(F.lit(1), i))

    return F.when(F.length(head) > 0, let(head, cuts)).otherwise(F.array().cast("array<string>"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of `pages`.

    A rule's path must end with a slash (else ValueError). A rule fits its host and all subdomains
    if the url's path starts with the rule's; the longest rule (host and path) wins, of equally long
    ones the longer host, then block before allow. A url that is null or has no `://` has an empty
    host and path, fits no rule and gets the default, as does an empty path. Repeated rows are judged
    each on their own. An empty table gives an empty result. Other columns are not read.
    """
    marked = rules.where("host is not null and path is not null and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    bounds = marked.agg(
        F.max(F.size(F.split("r_host", r"\."))), F.max(F.length("r_path")), F.count("*"), F.count_if(~F.col("r_path").endswith("/"))
    ).first()
    if bounds[3]:
        raise ValueError("a rule's path must end with a slash")
    labels, longest, count = bounds[0] or 1, bounds[1] or 1, bounds[2]
    text = F.concat("r_host", "r_path")
    order = [F.length(text), F.length("r_host"), F.col("r_verdict") == "block", text, F.col("r_verdict")]
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))  # the rules are a parameter
    ranked = marked.select("r_host", "r_path", "r_verdict", text.alias("rule"), place.alias("rank"))
    wanted = ranked.select("rank", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256).alias("r_digest"))
    wanted = wanted.withColumn("r_short", F.substring("r_digest", 1, 8))
    wanted = F.broadcast(wanted) if count <= MAX_BROADCAST_RULES else wanted
    urls = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("page_id"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    suffixes = urls.select("*", host_suffixes(F.col("host"), labels).alias("suffixes"), path_prefixes(F.col("path"), longest).alias("prefixes"))
    one = suffixes.select("row", "page_id", "host", "path", "prefixes", F.explode("suffixes").alias("suffix"))
    two = one.select("row", "page_id", "host", "path", "suffix", F.explode_outer("prefixes").alias("prefix"))
    digest = F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256)
    tried = two.select("row", "page_id", "host", "path", digest.alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    met = tried.join(wanted, tried["short"] == wanted["r_short"], "left")
    fits = F.when(F.col("digest") == F.col("r_digest"), F.col("rank"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("rank"))
    ranked = ranked.select("rank", "rule", "r_verdict")
    judged = best.join(F.broadcast(ranked) if count <= MAX_BROADCAST_RULES else ranked, "rank", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("r_verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM (SELECT page_id, url, coalesce(position('://' IN url), 0) AS p FROM pages)
),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
),
j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
