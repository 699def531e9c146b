"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over row numbers.

Every row gets a number 0..N-1: its place in its hash bucket plus the rows of the buckets before
(bucket sizes are pre-aggregated; one bucket is ordered at a time, never the whole table). A keyed
permutation of 0..N-1 moves the number, and shard and slot follow by arithmetic: the shard is the
remainder and the slot the quotient by the number of shards. So shard sizes differ by one at most,
slots have no gaps, and where a row goes can be computed from its number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import whole_row

SHARDS, SEED, ROUNDS = 8, 20240229, 6
#: Rows that a bucket holds on average, and the fewest buckets.
BUCKET_ROWS, MIN_BUCKETS = 50_000, 1024


def domain(n: int) -> tuple[int, int]:
    """Sides a, b of the permuted rectangle: the smallest near-square with a * b >= n."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(number: Column, a: int, b: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """A permutation of 0..a*b-1 as one Spark expression: rounds that alternate the two halves."""
    right = F.pmod(number, F.lit(b)).cast("long")
    left = ((number - right) / b).cast("long")  # an exact quotient
    for i in range(rounds):
        if i % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(i)), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(i)), F.lit(b)), F.lit(b))
    return left * b + right


def permute(number: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """A permutation of 0..n-1. A number that leaves the range walks on along its cycle.

    A walk meets no number outside the range twice, and a * b - n of them exist (fewer than a side),
    so the walk below always ends inside. One row in about sqrt(n) walks at all.
    """
    a, b = domain(n)
    first = feistel(number, a, b, seed, rounds)
    outside = a * b - n
    if not outside:
        return first

    def walk(start: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(outside))
        onward = F.aggregate(steps, start, lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, seed, rounds)))
        return F.when(start < n, start).otherwise(onward)

    return F.get(F.transform(F.array(first), walk), F.lit(0))


def number_rows(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`rows` with __number 0..N-1, fixed by the values in `keys`; equal rows may swap theirs."""
    buckets = max(MIN_BUCKETS, -(-total // BUCKET_ROWS))
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = dealt.groupBy("__bucket").agg(F.count("*").alias("n"))
    upto = W.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__offset"))
    inside = W.partitionBy("__bucket").orderBy(*keys)
    placed = dealt.withColumn("__place", F.row_number().over(inside).cast("long"))
    small = buckets <= 1 << 20  # 16 bytes each
    placed = placed.join(F.broadcast(offsets) if small else offsets, "__bucket")
    return placed.withColumn("__number", F.col("__offset") + F.col("__place") - 1).drop("__bucket", "__place", "__offset")


def shard_rows(rows: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """`rows` with `shard` 0..shards-1 and `slot` 0,1,2... at the end; columns with these names are replaced.

    The result depends on the values in `keys`, the number of rows and the seed, not on partitions.
    Nulls are values like any other. Rows with equal keys are interchangeable. An empty table gives an
    empty result. The row count is the only value that the driver reads.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    total = rows.count()
    named = [f"__key{i}" for i in range(len(keys))]
    packed = rows.select(whole_row(rows, ("shard", "slot")).alias("__row"), *[rows[f"`{k}`"].alias(n) for k, n in zip(keys, named, strict=True)])
    place = permute(F.col("__number"), max(total, 1), seed)
    moved = number_rows(packed, named, total).select("__row", place.alias("__moved"))
    return moved.select("__row.*", F.pmod("__moved", F.lit(shards)).cast("int").alias("shard"), F.expr(f"__moved div {int(shards)}").alias("slot"))


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of `docs`.

    The law is `rows`, so grown_shard is null. A null text has size 1 and the CRC-32 of no bytes.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = shard_rows(slim, ["doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of `docs`, of any names, with `shard` and `slot` at the end."""
    packed = docs.select(whole_row(docs, ("shard", "slot")).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    return shard_rows(packed, ["doc_id", "text_hash"], shards).select("row.*", "shard", "slot")
