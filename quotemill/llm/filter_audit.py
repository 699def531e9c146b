"""What each of several filters removes in every order in which they can be applied.

Documents are reduced to cells first: a mask of the filters that a document fails, with counts of all,
good and toxic documents. Each cell is then folded across an array of all orders with `aggregate` and
`transform`, which gives a weighted struct for every order and step; the structs of a part's cells are
merged by elementwise sums. Only counts pass through the folds, so their work doesn't grow with the texts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import join_spread, let, split_words

#: The filters in the order of their bits.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(text: Column) -> Column:
    """A mask of the filters A to D that a text fails; filter E needs the other texts."""
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))

    def mask(n: Column, distinct: Column) -> Column:
        failed = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals.cast("long") > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}
        bits = [F.when(c, bit(k)).otherwise(0) for k, c in failed.items()]
        return bits[0] + bits[1] + bits[2] + bits[3]

    return let(split_words(text), lambda w: mask(F.size(w).cast("long"), F.size(F.array_distinct(w)).cast("long")))


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by the set of filters that they fail.

    E: the text equals that of a smaller doc_id. Texts are equal if 128 bits of their hashes are. Copies
    are counted per text, part and label before they meet, so a text of very many copies is a few rows.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["source"], F.lit("")).alias("part"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        text_failures(text).alias("mask"),
    )
    marks = labels.where("doc_id is not null").groupBy(labels["doc_id"].cast("long").alias("doc_id"))
    marks = marks.agg(F.max(labels["quality"] == 1).alias("good"), F.max(labels["toxic"] == 1).alias("toxic"))
    rows = join_spread(rows, marks, ["doc_id"], "left")
    kind = ["h1", "h2", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    once = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    alike = once.groupBy("h1", "h2", "mask", "part", "good", "toxic").agg(
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    smallest = F.min("first").over(W.partitionBy("h1", "h2"))
    held = F.when(F.col("first") == smallest, F.col("n_first")).otherwise(0)
    split = alike.select("mask", "part", "good", "toxic", "n", (F.col("nameless") + held).alias("passing"))
    either = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    cells = split.select("part", "good", "toxic", F.inline(either))
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), when("good").alias("n_good"), when("toxic").alias("n_toxic"))


def fold_orders(cell: Column) -> Column:
    """For a cell (mask, n, n_good, n_toxic): an array of structs of COUNTS, one for each order and step."""

    def step(state: Column, own: Column) -> Column:
        """Apply the filter with the bit `own` to the cell."""
        fails, there = cell["mask"].bitwiseAND(own) != 0, ~state["gone"]
        weigh = lambda c, n="n": F.when(c, cell[n]).otherwise(F.lit(0).cast("long"))
        counts = {
            "kept": weigh(there & ~fails),
            "removed": weigh(there & fails),
            "redundant": weigh(state["gone"] & fails),
            "unique_fails": weigh(cell["mask"] == own),
            "good_lost": weigh(there & fails, "n_good"),
            "toxic_lost": weigh(there & fails, "n_toxic"),
        }
        done = F.concat(state["done"], F.array(F.struct(*[c.alias(k) for k, c in counts.items()])))
        return F.struct((state["gone"] | fails).alias("gone"), done.alias("done"))

    none = F.array().cast("array<struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>")
    start = F.struct(F.lit(False).alias("gone"), none.alias("done"))
    orders = F.lit([[bit(x) for x in order] for order in ORDERS])
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["done"])))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: COUNTS and the filter's removals summed over all orders.

    A null text is empty, a null source is the empty part. Rows that repeat are documents of their own;
    those with one id don't fail E for each other. A null id is smaller than none and carries no label; a label
    that repeats counts once, and either value holds if rows of one id differ. A document without a label is
    neither good nor toxic. Long texts are read whole. An empty table gives an empty result. Other
    columns aren't read.
    """
    cells = failure_cells(docs, labels)
    cell = F.struct("mask", "n", "n_good", "n_toxic")
    placed = cells.select("part", F.posexplode(fold_orders(cell)).alias("place", "c"))
    merged = placed.groupBy("part", "place").agg(*[F.sum(f"c.{c}").alias(c) for c in COUNTS])
    width = len(FILTERS)
    order = F.get(F.lit(ORDERS), F.floor(F.col("place") / width).cast("int"))
    rows = merged.select("part", order.alias("filter_order"), (F.col("place") % width + 1).cast("int").alias("step"), *COUNTS)
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    return rows.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", letter)))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
marks AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(docs.doc_id > min(docs.doc_id) OVER (PARTITION BY text), false) AS e
  FROM docs LEFT JOIN marks ON docs.doc_id = marks.doc_id
),
cells AS (
  SELECT part, [a, b, c, d, e] AS f, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM failed GROUP BY part, f
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT filter_order, s AS step, list_transform(range(1, s + 1), lambda i: ascii(filter_order[i]) - 64) AS applied FROM orders, range(1, 6) t(s)),
judged AS (
  SELECT part, filter_order, step, n, n_good, n_toxic, len(list_filter(f, lambda x: x)) AS n_failed, f[applied[step]] AS fails,
         len(list_filter(applied[:step - 1], lambda i: f[i])) > 0 AS gone
  FROM cells, steps
),
summed AS (
  SELECT part, filter_order, step,
         CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails AND n_failed = 1), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n_good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n_toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM summed
"""
