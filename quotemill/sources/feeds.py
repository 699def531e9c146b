"""Where rows come from: message topics, files, warehouse tables and lookup tables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The symbols to watch when the allow list is empty.
DEFAULT_SYMBOLS = ("BTC-USDT", "ETH-USDT", "SOL-USDT", "XRP-USDT", "DOGE-USDT")


def starting_offsets(mode: str | None, stream: bool = False) -> str:
    """earliest or latest; a committed position is the checkpoint's matter, so it starts at the default."""
    default = "earliest" if stream else "latest"
    known = {"earliest": "earliest", "earliest-offset": "earliest", "latest": "latest", "latest-offset": "latest"}
    return known.get((mode or "").lower(), default)


def topic(spark: SparkSession, servers: str, name: str, mode: str | None = None, streaming: bool = True, **options: str) -> DataFrame:
    """The values of a topic as strings (needs the Kafka package on the cluster)."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", servers).option("subscribe", name).options(**options)
    start = starting_offsets(mode, streaming) if streaming else "earliest"
    return reader.option("startingOffsets", start).load().select(F.col("value").cast("string").alias("value"), "timestamp")


def json_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Raw messages from text files, one per line."""
    return spark.readStream.text(path) if streaming else spark.read.text(path)


def warehouse(spark: SparkSession, path: str, fields: list[str] | None = None, streaming: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """A table's chosen columns; only those are read."""
    reader = spark.readStream if streaming else spark.read
    rows = (reader.schema(schema) if schema is not None else reader).parquet(path)
    return rows.select(*fields) if fields else rows


def allow_list(spark: SparkSession, path: str | None, default: tuple[str, ...] = DEFAULT_SYMBOLS) -> DataFrame:
    """The symbols in the table at `path`, or the defaults if there is no table or it is empty."""
    fallback = spark.createDataFrame([(s,) for s in default], "symbol string")
    if path is None:
        return fallback
    rows = spark.read.schema("symbol string").json(path).where("symbol is not null").distinct()
    return rows.unionByName(fallback.join(F.broadcast(rows.limit(1).select(F.lit(1).alias("x"))), how="left_anti"))


CONFIG = T.StructType(
    [
        T.StructField("config_id", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("indicator_type", T.StringType()),
        T.StructField("indicator_name", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("enabled", T.BooleanType()),
    ]
)
STRATEGY = "symbol string, risk_threshold double, volume_threshold double, price_threshold double, strategy_type string"


def lookup(spark: SparkSession, path: str, schema: T.StructType | str = CONFIG, column: str | None = None) -> DataFrame:
    """A lookup table kept as JSON lines; unreadable lines are left out."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")
    return parsed.where(f"{column or schema.fieldNames()[0]} is not null")


def parameterised(spark: SparkSession, text: str, values: Mapping[str, object]) -> DataFrame:
    """A query with `${name}` markers, each bound as a value; ValueError names those left over."""
    names = dict.fromkeys(re.findall(r"\$\{(\w+)\}", text))
    missing = [n for n in names if n not in values]
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    return spark.sql(re.sub(r"\$\{(\w+)\}", r":\1", text), args={n: values[n] for n in names})
