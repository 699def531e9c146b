from __future__ import annotations

import numpy as np
import pytest

from quotemill.functions import table_functions
from quotemill.operators import formulas as f
from quotemill.operators.indicators import close, compute, high, low
from tests.test_indicators import SCHEMA, T0, series, walk


def test_sql_equals_the_data_frame_form(spark):
    table_functions.register(spark)
    bars = spark.createDataFrame(walk(1, 80) + walk(2, 30), SCHEMA)
    bars.createOrReplaceTempView("some_bars")
    forms = {
        "'SMA', map('period', '7')": f.sma(close, 7), "'EMA', map('period', '9')": f.ema(close, 9), "'RSI'": f.rsi(close), "'ATR', map('period', '5')": f.atr(5),
        "'MACD', map('short_period', '3', 'long_period', '8')": f.macd(close, 3, 8), "'HIGHEST'": f.highest(high, 15), "'LOWEST', map('period', '4')": f.lowest(low, 4),
    }
    wanted = {f"x{i}": x for i, x in enumerate(forms.values())}
    want = compute(bars, wanted).cache()
    for i, call in enumerate(forms):
        got = spark.sql(f"SELECT * FROM indicator(TABLE(some_bars), {call})")
        for inst in ("s1", "s2"):
            assert np.allclose(series(got, "value", inst), series(want, f"x{i}", inst)), call


def test_nulls_and_errors(spark):
    table_functions.register(spark)
    rows = [("x", T0.replace(minute=i), p, p, p, p, 1.0) for i, p in enumerate([None, 4.0, None, 8.0])]
    spark.createDataFrame(rows, SCHEMA).createOrReplaceTempView("odd_bars")
    got = spark.sql("SELECT value FROM indicator(TABLE(odd_bars), 'SMA') ORDER BY bar_time").collect()
    assert [r.value for r in got] == [None, 4.0, 4.0, 6.0]
    assert spark.sql("SELECT * FROM indicator(TABLE(SELECT * FROM odd_bars WHERE false), 'SMA')").count() == 0
    for text, why in (("indicator(TABLE(odd_bars), 'NOTHING')", "unknown indicator"), ("indicator(TABLE(odd_bars), 'SMA', map('period', '0'))", "below 1"), ("indicator(TABLE(SELECT 1 AS a), 'SMA')", "lacks")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM {text}").collect()
