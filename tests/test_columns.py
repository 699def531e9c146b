from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.functions import columns as C

MESSAGES = [
    ('{"timestamp":"1773840422738"}', 1773840422738),
    ('{"timestamp":1773840422738}', 1773840422738),
    ('{"timestamp": 1773840422738, "x": 1}', 1773840422738),
    ("{'ts': '1773840422738'}", 1773840422738),
    ('{"ts":"1773840422738"}', 1773840422738),
    ("ts=1773840422738", 1773840422738),
    ("timestamp = 1773840422738;", 1773840422738),
    ("timestamp:1773840422738", 1773840422738),
    ("ts : 1773840422738", 1773840422738),
    ("ts=123", None),
    ("ts=17738404227381", None),
    ("no time here", None),
]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_times_in_messages(spark):
    rows = spark.createDataFrame(MESSAGES, "value string, want long").select("want", C.epoch_in_text(F.col("value")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_guarded_arithmetic(spark):
    lit = F.lit
    assert one(spark, C.ratio(lit(1.0), lit(3.0)), C.ratio(lit(1.0), lit(0.0)), C.ratio(lit(1.0), lit(-2.0)), C.ratio(lit(1.0), lit(8.0), 2, True)) == (0.333333, 0.0, 0.0, 12.5)
    assert [float(x) for x in one(spark, C.decimal_divide(lit(2), lit(3), 4), C.decimal_divide(lit(-1), lit(8), 2))] == [0.6667, -0.13]
    assert one(spark, C.decimal_divide(lit(2), lit(0), 4)) == (None,)
    assert one(spark, C.clamp(lit(120.0), 0.0, 100.0), C.clamp(lit(-1.0), 0.0, 100.0)) == (100.0, 0.0)


def test_lenient_accessors(spark):
    rows = spark.createDataFrame([(" 1.5 ",), ("x",), (None,), ("",)], "t string")
    got = rows.select(C.safe_decimal(F.col("t")).alias("d"), C.safe_millis(F.col("t"), F.lit(7)).alias("m")).collect()
    assert [None if r.d is None else float(r.d) for r in got] == [1.5, None, None, None]
    assert [r.m for r in got] == [7, 7, 7, 7]


def test_predicates_are_false_for_null(spark):
    null = F.lit(None)
    assert one(
        spark, C.valid_price(null.cast("double")), C.valid_time(null.cast("long"), F.lit(0)), C.not_blank(null.cast("string")), C.positive(null.cast("int")),
        C.in_range(null.cast("int"), 0, 1), C.valid_instrument(null.cast("string")), C.length_between(null.cast("string"), 0, 9),
    ) == (False,) * 7


def test_predicates(spark):
    ids = ["BTC-USDT", "BTC-USDT-SWAP", "BTC", "-USDT", "BTC-", ""]
    got = spark.createDataFrame([(i,) for i in ids], "i string").select(C.valid_instrument(F.col("i")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False, False]
    prices = [1e-8, 9e-9, 1e7, 1.1e7, 0.0, -1.0]
    got = spark.createDataFrame([(p,) for p in prices], "p double").select(C.valid_price(F.col("p")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, True, False, False, False]
    times = [0, 1, 1000, 3_601_000, 3_600_999]
    got = spark.createDataFrame([(t,) for t in times], "t long").select(C.valid_time(F.col("t"), F.lit(1000)).alias("ok")).collect()
    assert [r.ok for r in got] == [False, True, True, False, True]


def test_symbols(spark):
    ids = spark.createDataFrame([("BTC-USDT",), ("BTC-USDT-SWAP",), ("ETH-BTC",)], "i string")
    got = ids.select(C.base_symbol(F.col("i")), C.spot_symbol(F.col("i")), C.market_of(F.col("i"))).collect()
    assert [tuple(r) for r in got] == [("BTC", "BTC-USDT", "spot"), ("BTC", "BTC-USDT", "swap"), ("ETH-BTC", "ETH-BTC", "spot")]


def test_minutes_params_and_ids(spark):
    assert one(spark, C.minute_start(F.lit(119_999)), C.minute_start(F.lit(120_000)), C.minute_start(F.lit(360_001), 5)) == (60_000, 120_000, 300_000)
    made = F.create_map(F.lit("period"), F.lit("9"))
    assert one(spark, C.param(made, "period", "20"), C.param(made, "k", "2")) == ("9", "2")
    assert one(spark, C.json_number(F.lit('{"dif": 1.5}'), "$.dif"), C.json_number(F.lit("{"), "$.dif")) == (1.5, None)
    a, b = one(spark, C.signal_id(F.lit("x"), F.lit(1)), C.signal_id(F.lit("x"), F.lit(1)))
    assert a == b and len(a) == 64
