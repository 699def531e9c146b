"""Where rows go: tables written once per batch, topics, and day partitions that age out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def as_json(rows: DataFrame, numbers_as_text: bool = False, column: str = "value") -> DataFrame:
    """Each row as one JSON text, decimals as numbers or as text."""
    fields = [F.col(n).cast("string").alias(n) if numbers_as_text and k.startswith("decimal") else F.col(n) for n, k in rows.dtypes]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(column))


def keyed_messages(rows: DataFrame, key: str, topic: str | None = None, prefix: str = "ticker") -> DataFrame:
    """(key, value, topic) for a topic sink; the topic is fixed or follows the row's market."""
    value = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    to = F.lit(topic) if topic else F.concat(F.lit(f"{prefix}-"), F.col("market"))
    return rows.select(F.col(key).cast("string").alias("key"), value.alias("value"), to.alias("topic"))


def to_topics(messages: DataFrame, servers: str, checkpoint: str) -> DataStreamWriter:
    writer = messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return writer.option("checkpointLocation", checkpoint)


def write_batch(path: str, partition: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to a folder of its own: a repeated batch replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        out = rows.write.mode("overwrite")
        (out.partitionBy(partition) if partition else out).parquet(f"{path}/batch_id={batch}")

    return write


def to_table(rows: DataFrame, path: str, checkpoint: str, every: str = "5 seconds", available_now: bool = False) -> StreamingQuery:
    """Append a stream to a table exactly once (file sink with a checkpoint)."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def split_by_risk(path: str, risky_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function with a second output for rows beyond their risk threshold."""
    main, side = write_batch(path), write_batch(risky_path)

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        main(rows, batch)
        side(rows.where("risk_score > risk_threshold"), batch)
        rows.unpersist()

    return write


def to_database(url: str, name: str, retries: int = 3, wait_seconds: float = 1.0, batch_column: str | None = None, **options: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends over JDBC and tries again when a write fails, waiting twice as long each time.

    A write that failed half-way is repeated whole. With `batch_column` each row carries its batch's
    number, so that a target keyed by that number and the row's id takes a repeated row once.
    """

    def write(rows: DataFrame, batch: int) -> None:
        out = rows.withColumn(batch_column, F.lit(batch).cast("bigint")) if batch_column else rows
        for attempt in range(retries):
            try:
                out.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode("append").save()
                return
            except Exception:
                if attempt == retries - 1:
                    raise
                time.sleep(wait_seconds * 2**attempt)

    return write


def retained(rows: DataFrame, as_of: str, days_back: int = 7, days_ahead: int = 3, column: str = "trade_date") -> DataFrame:
    """Rows of the day partitions within the horizon; others are pruned, not read."""
    day = F.to_date(F.lit(as_of))
    return rows.where(F.col(column).between(F.date_sub(day, days_back), F.date_add(day, days_ahead)))


def drop_old_days(spark: SparkSession, source: str, target: str, as_of: str, days_back: int = 7, days_ahead: int = 3, column: str = "trade_date") -> None:
    """Write the partitions within the horizon to a new table, in place of the old one."""
    retained(spark.read.parquet(source), as_of, days_back, days_ahead, column).write.mode("overwrite").partitionBy(column).parquet(target)
