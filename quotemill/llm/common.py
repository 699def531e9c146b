"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint, so that lost executors cost no recomputation.

    The folder is the one the cluster names in spark.checkpoint.dir. Where that is unset a
    temporary folder is used, but only on a local master: a cluster has to name a shared one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times in `body`, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns of `df` in one struct, so that none of them can clash with an operator's own."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns if c not in without])


def join_spread(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key, so that the rows of one busy key can be split.

    A table that was aggregated by the keys is already dealt by them, and Spark would then keep that
    dealing, in which a key's rows can't be parted. The further key makes it deal both sides for the
    join alone, which its skew handling can split.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(1 << 20))
    return rows.withColumn("__slot", slot).join(per_key.withColumn("__slot", slot), [*keys, "__slot"], how).drop("__slot")


def split_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; a null or empty text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup batches of sorted rows so that no run of equal keys is cut: (rows, run number per row)."""
    held: pa.Table | None = None

    def numbered(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        new = np.zeros(rows.num_rows, bool)
        for c in keys:
            k = rows.column(c).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        return rows, np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        run = numbered(rows)[1]
        cut = int(np.searchsorted(run, run[-1]))
        if cut:
            yield numbered(rows.slice(0, cut))
        held = rows.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield numbered(held)
