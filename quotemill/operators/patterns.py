"""Breakout pattern: three calm rows in a row, then, gaps allowed, a jump within five minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Calm and jump limits in percent, the time limit in seconds.
CALM, BREAK, WITHIN_SECONDS = 0.5, 1.5, 300


def breakouts(
    ticks: DataFrame, change: str = "change_percent", calm: float = CALM, jump: float = BREAK, within_seconds: int = WITHIN_SECONDS, slot_seconds: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per match (overlapping ones kept): the calm rows' mean price and the breakout row.

    ticks: inst_id, ts, seq, last and the change in percent. The breakout is the first one after the
    third calm row; it must come less than `within_seconds` after the first. `carry` names columns of
    the breakout row that come along.

    Rows are dealt by instrument and time slot (`slot_seconds`, twelve times the limit unless given), so
    a busy instrument is spread over tasks. A match is no longer than the limit, so each slot also reads
    the rows of that time before it, and keeps the matches whose breakout is its own.
    """
    length = max(slot_seconds or 12 * within_seconds, within_seconds) * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.floor(micros / length).cast("long")
    late = micros - own * length >= length - within_seconds * 1_000_000
    dealt = ticks.where("ts is not null").withColumn("__own", own)
    dealt = dealt.withColumn("__slot", F.explode(F.when(late, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    run = W.partitionBy("inst_id", "__slot").orderBy("ts", "seq")
    back = W.partitionBy("inst_id", "__slot").orderBy(F.desc("ts"), F.desc("seq"))
    size = F.abs(F.col(change))
    quiet = F.coalesce(size < calm, F.lit(False))
    row = F.struct("ts", "seq", "last", F.col(change).alias("change"), F.col("__own").alias("own"), *carry)
    later = back.rowsBetween(W.unboundedPreceding, -1)
    seen = dealt.withColumns(
        {
            "__three": quiet & F.coalesce(F.lag(quiet, 1).over(run), F.lit(False)) & F.coalesce(F.lag(quiet, 2).over(run), F.lit(False)),
            "__start": F.lag("ts", 2).over(run),
            "__mean": F.avg("last").over(run.rowsBetween(-2, 0)),
        }
    ).withColumn("__next", F.last(F.when(size > jump, row), ignorenulls=True).over(later))
    spent = F.unix_micros(F.col("__next.ts").cast("timestamp")) - F.unix_micros(F.col("__start").cast("timestamp"))
    found = F.col("__three") & F.col("__next").isNotNull() & (spent < within_seconds * 1_000_000) & (F.col("__next.own") == F.col("__slot"))
    return seen.where(found).select(
        "inst_id",
        F.col("__start").alias("calm_start"),
        F.col("ts").alias("calm_end"),
        F.round(F.col("__mean").cast("double"), 8).alias("calm_price"),
        F.col("__next.ts").alias("break_ts"),
        F.col("__next.seq").alias("break_seq"),
        F.col("__next.last").alias("break_price"),
        F.col("__next.change").alias("break_change"),
        *[F.col(f"__next.{c}").alias(c) for c in carry],
    )
