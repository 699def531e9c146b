"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domain, language and source. At each node the budget is split
among the children by weight; a child that cannot use its part (its documents, repeated for at most
`max_epochs`, hold too few tokens) is filled up and the rest goes to its siblings. Because every
node's capacity is that of its whole subtree, a shortage leaves a node for the node's own siblings
only when all of its children are full. Each leaf then reads its documents in seeded epochs: whole
passes, and of the last pass the token-prefix of a seeded order.

The tree is a table that Spark aggregates and splits with windows over siblings. The prefix of a
leaf is found from token sums per slice of the order (4096 slices, pre-aggregated); only the slice
in which the budget ends is ordered, so a leaf with a third of all rows gathers in no task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import durable, whole_row

WORD = r"[^\x20\x09-\x0D]+"
EXACT = "decimal(38,0)"
UNKNOWN = "unknown"
#: The table of leaves is broadcast up to this many rows (under 16 MB); beyond it, it is shuffled.
MAX_BROADCAST_LEAVES = 50_000


def source_domain(source: Column) -> Column:
    """The domain of a source: sources are numbered, the number picks one of four."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    names = F.array(*[F.lit(x) for x in ("web", "news", "reference", "forum")])
    return F.when(number == "", F.lit(UNKNOWN)).otherwise(F.get(names, F.pmod(F.try_to_number(number, F.lit("999999999")).cast("int"), F.lit(4))))


@dataclass(frozen=True)
class Mix:
    """Weights are whole numbers by name and level; a name that isn't listed weighs `default`."""

    budget_percent: int = 100
    max_epochs: int = 4
    seed: int = 7
    weights: Sequence[Mapping[str, int]] = field(
        default_factory=lambda: ({"web": 40, "news": 25, "reference": 25, "forum": 10}, {"en": 55, "de": 15, "fr": 15, "es": 15}, {})
    )
    default: int = 10


def _paths(source_col: str, lang_col: str) -> list[Column]:
    known = lambda c: F.coalesce(c, F.lit(UNKNOWN))
    return [known(source_domain(F.col(source_col))), known(F.col(lang_col)), known(F.col(source_col))]


LEVELS = ["__domain", "__language", "__source"]


def _weight(level: int, mix: Mix) -> Column:
    """The weight of the node named in the level's column."""
    out = F.lit(mix.default)
    for name, value in mix.weights[level].items():
        out = F.when(F.col(LEVELS[level]) == name, F.lit(int(value))).otherwise(out)
    return out.cast(EXACT)


def _split(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Give each of the siblings its part of `budget`: rows have budget, cap and weight; adds `part`."""
    family = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    order = family.orderBy((F.col("cap") / F.col("weight")).cast("double"), name)
    left = nodes.where("weight > 0")
    left = left.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast(EXACT))
    left = left.withColumn("after", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).cast(EXACT))
    full = F.col("cap") * F.col("after") <= F.col("weight") * (F.col("budget") - F.col("before"))
    left = left.withColumn("full", full)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)
    left = left.withColumn("rest", rest.cast(EXACT)).withColumn("open_weight", open_weight.cast(EXACT))
    part = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(rest * weight) div open_weight").cast(EXACT))
    return left.withColumn("part", part.cast(EXACT)).drop("before", "after", "full", "rest", "open_weight")


def leaf_budgets(rows: DataFrame, mix: Mix) -> DataFrame:
    """(domain, language, source, tokens, part): what each leaf may take. rows: LEVELS and __tokens."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("__tokens").cast(EXACT).alias("tokens")).where("tokens > 0")
    leaves = leaves.withColumn("cap", (F.col("tokens") * mix.max_epochs).cast(EXACT)).withColumn("weight", _weight(2, mix))
    leaves = leaves.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0).cast(EXACT))
    held = F.sum("cap").cast(EXACT).alias("cap")
    languages = leaves.groupBy(*LEVELS[:2]).agg(held, F.sum("tokens").cast(EXACT).alias("tokens")).withColumn("weight", _weight(1, mix))
    languages = languages.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0).cast(EXACT))
    domains = languages.groupBy(LEVELS[0]).agg(held, F.sum("tokens").cast(EXACT).alias("tokens")).withColumn("weight", _weight(0, mix))
    all_of = W.partitionBy(F.lit(0))
    budget = F.least(F.expr(f"(sum_tokens * {int(mix.budget_percent)}) div 100").cast(EXACT), F.col("sum_cap"))
    usable = F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)
    top = domains.withColumn("sum_tokens", F.sum("tokens").over(all_of).cast(EXACT)).withColumn("sum_cap", F.sum(usable).over(all_of).cast(EXACT))
    top = _split(top.withColumn("budget", budget.cast(EXACT)), [], LEVELS[0])
    below = top.select(LEVELS[0], F.col("part").alias("budget"))
    middle = _split(languages.join(below, LEVELS[:1]), LEVELS[:1], LEVELS[1])
    below = middle.select(*LEVELS[:2], F.col("part").alias("budget"))
    return _split(leaves.join(below, LEVELS[:2]), LEVELS[:2], LEVELS[2]).select(*LEVELS, "tokens", "part")


def _with_order(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds __key: the place of the row in the leaf's last, partly read epoch."""
    key = F.md5(F.concat_ws("|", F.lit(str(mix.seed)), F.col("__passes").cast("string"), F.coalesce(F.col("__id").cast("string"), F.lit(""))))
    return rows.withColumn("__key", key)


def _lookup(leaves: DataFrame) -> DataFrame:
    """A table with a row per leaf, to be broadcast if its row count, read here, is within the limit."""
    return F.broadcast(leaves) if leaves.limit(MAX_BROADCAST_LEAVES + 1).count() <= MAX_BROADCAST_LEAVES else leaves


def leaf_plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """(LEVELS, __passes, __rest, __end_slice, __cut): whole epochs of each leaf, and the last row of its token-prefix.

    rows: LEVELS, __tokens, __id, __text_hash.
    """
    parts = leaf_budgets(rows, mix).withColumn("__passes", F.expr("part div tokens").cast("long"))
    parts = durable(parts.select(*LEVELS, "__passes", (F.col("part") - F.col("__passes") * F.col("tokens")).cast("long").alias("__rest")))
    placed = _with_order(rows.where("__tokens > 0").join(_lookup(parts.where("__rest > 0")), LEVELS), mix).withColumn("slice", F.substring("__key", 1, 3))
    sums = placed.groupBy(*LEVELS, "__rest", "slice").agg(F.sum("__tokens").alias("held"))
    upto = W.partitionBy(*LEVELS).orderBy("slice")
    sums = sums.withColumn("upto", F.sum("held").over(upto))
    ends = durable(sums.where("upto > __rest and upto - held <= __rest").select(*LEVELS, "slice", (F.col("upto") - F.col("held")).alias("before")))
    place = F.struct("__key", "__id", "__text_hash")
    near = placed.join(_lookup(ends), [*LEVELS, "slice"])
    run = W.partitionBy(*LEVELS, "slice").orderBy("__key", "__id", "__text_hash")  # equal rows have an equal sum
    last = (
        near.withColumn("at", F.col("before") + F.sum("__tokens").over(run))
        .where("at <= __rest")
        .groupBy(*LEVELS)
        .agg(F.max(place).alias("__cut"))
    )
    ended = ends.select(*LEVELS, F.col("slice").alias("__end_slice"))
    return durable(parts.join(ended, LEVELS, "left").join(last, LEVELS, "left").select(*LEVELS, "__passes", "__rest", "__end_slice", "__cut"))


def choose(rows: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """Adds `__copies`: how often each row is read. rows: LEVELS, __tokens, __id, __text_hash and others."""
    joined = _with_order(rows.join(_lookup(plan), LEVELS), mix)
    before = F.coalesce(F.substring("__key", 1, 3) < F.col("__end_slice"), F.lit(False))
    inside = F.coalesce(F.struct("__key", "__id", "__text_hash") <= F.col("__cut"), F.lit(False))
    once = F.when((F.col("__tokens") > 0) & (F.col("__rest") > 0) & (before | inside), 1).otherwise(0)
    return joined.withColumn("__copies", F.when(F.col("__tokens") > 0, F.col("__passes") + once).otherwise(0).cast("long"))


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = [c.alias(n) for c, n in zip(_paths(source_col, lang_col), LEVELS, strict=True)]
    return [*paths, F.regexp_count(text, F.lit(WORD)).cast("long").alias("__tokens"), F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text_hash")]


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:  # noqa: B008
    """The chosen documents: doc_id, domain, language, source, tokens, copies.

    Null or unlisted names: a null name is 'unknown', an unlisted one weighs `default`; weight 0
    takes nothing. Documents without words (null or empty text) are never chosen. Documents are read
    whole: a leaf stays below its budget by less than one document, and the whole-number split loses
    fewer tokens than a node has children. Equal rows are chosen together. Rows with the same id are
    ordered by text. An empty table gives an empty result. Other columns aren't read.
    """
    slim = durable(docs.select(*_rows(docs, id_col, text_col, lang_col, source_col)))
    chosen = choose(slim, leaf_plan(slim, mix), mix).where("__copies > 0")
    names = ["domain", "language", "source"]
    levels = [F.col(c).alias(n) for c, n in zip(LEVELS, names, strict=True)]
    return chosen.select(F.col("__id").alias("doc_id"), *levels, F.col("__tokens").alias("tokens"), F.col("__copies").alias("copies"))


def take_mix(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The chosen rows of `docs` with all their columns, of any names, each as often as it is read."""
    own = _rows(docs, "doc_id", "text", "lang", "source")
    slim = durable(docs.select(*own))
    chosen = choose(docs.select(whole_row(docs).alias("__row"), *own), leaf_plan(slim, mix), mix).where("__copies > 0")
    return chosen.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")


def _fill_sql(src: str, parents: str, name: str) -> str:
    over = f"PARTITION BY {parents}" if parents else "PARTITION BY 0"
    return f"""
  SELECT * EXCLUDE (bef, aft, isfull), CASE WHEN isfull THEN cap ELSE ((budget - coalesce(sum(CASE WHEN isfull THEN cap END) OVER ({over}), 0)) * weight)
         // (sum(CASE WHEN NOT isfull THEN weight END) OVER ({over})) END AS part
  FROM (SELECT *, cap * aft <= weight * (budget - bef) AS isfull FROM (
    SELECT *, coalesce(sum(cap) OVER ({over} ORDER BY CAST(cap AS DOUBLE) / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
           sum(weight) OVER ({over} ORDER BY CAST(cap AS DOUBLE) / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft FROM {src}))"""


ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, text, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS language,
         CASE WHEN regexp_extract(coalesce(source, ''), '[0-9]{{1,9}}$') = '' THEN 'unknown'
              ELSE (['web', 'news', 'reference', 'forum'])[CAST(regexp_extract(source, '[0-9]{{1,9}}$') AS BIGINT) % 4 + 1] END AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM documents
),
leaf AS (SELECT domain, language, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) * 4 AS HUGEINT) AS cap, CAST(10 AS HUGEINT) AS weight
         FROM docs GROUP BY ALL HAVING sum(tokens) > 0),
lang AS (SELECT domain, language, CAST(sum(cap) AS HUGEINT) AS cap, CAST(sum(tokens) AS HUGEINT) AS tokens,
                CAST(CASE language WHEN 'en' THEN 55 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 15 ELSE 10 END AS HUGEINT) AS weight FROM leaf GROUP BY ALL),
dom AS (SELECT domain, CAST(sum(cap) AS HUGEINT) AS cap, CAST(sum(tokens) AS HUGEINT) AS tokens,
               CAST(CASE domain WHEN 'web' THEN 40 WHEN 'news' THEN 25 WHEN 'reference' THEN 25 WHEN 'forum' THEN 10 ELSE 10 END AS HUGEINT) AS weight FROM lang GROUP BY ALL),
dom_in AS (SELECT *, CAST(least(sum(tokens) OVER (), sum(cap) OVER ()) AS HUGEINT) AS budget FROM dom),
dom_out AS ({_fill_sql("dom_in", "", "domain")}),
lang_in AS (SELECT lang.*, CAST(dom_out.part AS HUGEINT) AS budget FROM lang JOIN dom_out USING (domain)),
lang_out AS ({_fill_sql("lang_in", "domain", "language")}),
leaf_in AS (SELECT leaf.*, CAST(lang_out.part AS HUGEINT) AS budget FROM leaf JOIN lang_out USING (domain, language)),
leaf_out AS ({_fill_sql("leaf_in", "domain, language", "source")}),
plan AS (SELECT domain, language, source, CAST(part // tokens AS BIGINT) AS passes, CAST(part % tokens AS BIGINT) AS rest FROM leaf_out),
run AS (
  SELECT docs.*, passes, rest, sum(tokens) OVER (PARTITION BY domain, language, source
         ORDER BY md5('7|' || passes || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, text) AS reached
  FROM docs JOIN plan USING (domain, language, source) WHERE tokens > 0
)
SELECT doc_id, domain, language, source, tokens, passes + CASE WHEN reached <= rest THEN 1 ELSE 0 END AS copies
FROM run WHERE passes + CASE WHEN reached <= rest THEN 1 ELSE 0 END > 0
"""
