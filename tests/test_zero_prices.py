"""Prices of 0 in the events: what is divided by them comes out as the SQL states it."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from quotemill.plans import catalogue
from tests.sqlcheck import plain, views

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Prices with single zeros, zeros one after the other, and zeros at both ends of a window of 6 hours."""
    path = tmp_path_factory.mktemp("zeros")
    rows = []
    for k in range(400):
        price = 0.0 if k % 37 in (5, 6) or k % 53 == 20 or k in (72, 144, 220, 395) else 40.0 + (k * 7) % 11
        rows.append((k, START + timedelta(minutes=5 * k), k % 9, ("click", "view")[k % 400 > 210], price, f'{{"k":{k % 100}}}'))
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    frame.write.parquet(str(path / "events.parquet"))
    return path


@pytest.mark.parametrize("name", ["price_jumps", "stream_price_jumps", "market_monitor", "bi_monitor_anomalies", "bi_monitor_latest", "dwd_detail"])
def test_zero_prices_equal_sql(spark, folder, name):
    got, want = catalogue.QUERIES[name](spark, str(folder)), views(folder).sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = plain(got.columns, got.collect())
    assert rows and rows == plain(want.columns, want.fetchall())
