"""Jumps of prices that are null, not a number or -0.0, and of rows without a time or number: as the SQL states them."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from quotemill.plans import catalogue, market
from quotemill.streaming import jobs
from tests.sqlcheck import plain, views

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: What becomes of every seventh row: (position in the row, value).
ODD = {"null price": (4, None), "not a number": (4, float("nan")), "negative zero": (4, -0.0), "no time": (1, None), "no number": (0, None)}


def events(odd: str) -> list[tuple]:
    rows = []
    for k in range(300):
        row = [k, START + timedelta(minutes=20 * k), k % 9, ("click", "view")[k % 5 > 2], 100.0 + (k * 7) % 13, f'{{"k":{k % 100}}}']
        if odd == "no number":
            row[1] = START + timedelta(minutes=20 * (k - k % 7))  # shared with six rows that have one
        if k % 7 == 3:
            at, value = ODD[odd]
            row[at] = value
        rows.append(tuple(row))
    return rows


@pytest.mark.parametrize("odd", ODD)
@pytest.mark.parametrize("name", ["price_jumps", "stream_price_jumps"])
def test_odd_prices_equal_sql(spark, tmp_path, name, odd):
    spark.createDataFrame(events(odd), EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    got, want = catalogue.QUERIES[name](spark, str(tmp_path)), views(tmp_path).sql(catalogue.ORACLE_SQL[name])
    rows = plain(got.columns, got.collect())
    assert rows and rows == plain(want.columns, want.fetchall())


@pytest.mark.parametrize("odd", ["null price", "not a number", "negative zero"])
def test_batches_in_order_equal_sql(spark, tmp_path, odd):
    """A batch ends with an odd price in front of the next batch's first one."""
    rows, ticks = events(odd), "inst_id string, ts timestamp, seq long, last double"
    for k, (start, end) in enumerate(((0, 4), (4, 53), (53, 300))):
        part = [(r[3], r[1], r[0], r[4]) for r in rows[start:end]]
        spark.createDataFrame(part, ticks).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    source = spark.readStream.schema(ticks).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = jobs.stream_jumps(source, str(tmp_path / "jumps"), null_resets=True, nulls_last=True).where("is_anomaly").select("inst_id", "seq", "last")
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    want = views(tmp_path).sql(market.JUMPS)
    assert plain(out.columns, out.collect()) == plain(want.columns, want.fetchall())
