from __future__ import annotations

import importlib
import json
import sys
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quotemill.operators import bars, clean, monitor, patterns, presets
from quotemill.sources import feeds, sinks
from quotemill.streaming import jobs

T0 = datetime(2024, 1, 1)
TICKS = "inst_id string, ts timestamp, seq long, last double, volume_24h double, change_percent double"


def test_lookups(spark, tmp_path):
    path = str(tmp_path / "configs")
    lines = [json.dumps({"config_id": "c1", "symbol": "*", "indicator_name": "MA", "params": {"period": "9"}, "enabled": True}), "{broken", json.dumps({"symbol": "x"})]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    got = feeds.lookup(spark, path).collect()
    assert [(r.config_id, r.params["period"], r.enabled) for r in got] == [("c1", "9", True)]
    assert {r.symbol for r in feeds.allow_list(spark, None).collect()} == set(feeds.DEFAULT_SYMBOLS)
    empty, full = str(tmp_path / "empty"), str(tmp_path / "full")
    spark.createDataFrame([], "value string").write.text(empty)
    spark.createDataFrame([('{"symbol":"A"}',), ('{"symbol":"A"}',)], "value string").write.text(full)
    assert {r.symbol for r in feeds.allow_list(spark, empty).collect()} == set(feeds.DEFAULT_SYMBOLS)
    assert [r.symbol for r in feeds.allow_list(spark, full).collect()] == ["A"]


def test_parameters(spark):
    assert feeds.parameterised(spark, "SELECT ${a} + 1 AS x, ${b} AS y, ${a} AS z", {"a": 1, "b": "it's"}).first() == (2, "it's", 1)
    with pytest.raises(ValueError, match="no value for b"):
        feeds.parameterised(spark, "SELECT ${a}, ${b}", {"a": 1})
    assert [feeds.starting_offsets(m) for m in ("earliest", "LATEST", "committed", None)] == ["earliest", "latest", "latest", "latest"]
    assert feeds.starting_offsets("committed", stream=True) == "earliest"


def test_messages_and_retention(spark, tmp_path):
    rows = spark.sql("SELECT 'A' AS inst_id, 'spot' AS market, CAST(1.5 AS DECIMAL(10,2)) AS p, CAST(NULL AS STRING) AS n")
    assert sinks.as_json(rows).first().value == '{"inst_id":"A","market":"spot","p":1.50,"n":null}'
    assert '"p":"1.50"' in sinks.as_json(rows, numbers_as_text=True).first().value
    assert sinks.keyed_messages(rows, "inst_id").first().topic == "ticker-spot"
    days = spark.createDataFrame([(f"2024-01-{d:02d}", d) for d in range(1, 31)], "trade_date string, d int").withColumn("trade_date", F.to_date("trade_date"))
    days.write.partitionBy("trade_date").parquet(str(tmp_path / "days"))
    sinks.drop_old_days(spark, str(tmp_path / "days"), str(tmp_path / "kept"), "2024-01-15")
    assert sorted(r.d for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == list(range(8, 19))


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = sinks.split_by_risk(str(tmp_path / "all"), str(tmp_path / "risky"))
    rows = spark.createDataFrame([(1, 10.0, 50.0), (2, 60.0, 50.0)], "id int, risk_score double, risk_threshold double")
    for _ in range(2):
        write(rows, 0)
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2
    assert [r.id for r in spark.read.parquet(str(tmp_path / "risky")).collect()] == [2]


def test_a_failing_database_is_tried_again_with_longer_waits(spark, monkeypatch):
    waits = []
    monkeypatch.setattr(sinks, "time", SimpleNamespace(sleep=waits.append))
    with pytest.raises(Exception, match="(?i)driver"):
        sinks.to_database("jdbc:none:x", "t", retries=3, wait_seconds=0.5, batch_column="batch_id")(spark.range(2), 7)
    assert waits == [0.5, 1.0]


def test_relative_times(spark):
    rows = spark.createDataFrame([(1, T0), (2, T0 + timedelta(hours=2)), (3, None)], "id int, ts timestamp")
    assert [r.id for r in clean.since(rows, "ts", "1 HOUR").collect()] == [2]
    assert sorted(r.id for r in clean.since(rows, "ts", "2 HOURS").collect()) == [1, 2]
    assert clean.since(rows.where("false"), "ts", "1 HOUR").count() == 0
    assert [r.id for r in clean.since(rows, "ts", "1 HOUR", F.lit(T0)).collect()] == [1, 2]


def stream_of(spark, tmp_path, rows, files: int):
    for k in range(files):
        spark.createDataFrame(rows[k::files], TICKS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def rows_of(n: int) -> list[tuple]:
    return [("ab"[i % 2], T0 + timedelta(seconds=i * 3), i, 100.0 + (i * 17) % 23, 1.0, [0.1, 0.2, 0.3, 1.0, 2.0][(i // 2) % 5]) for i in range(n)]


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    rows = rows_of(200)
    frame = spark.createDataFrame(rows, TICKS)
    late = "1 hour"  # the files interleave, so that each batch is later than the one before
    end = max(r[1] for r in rows)
    got = jobs.run_to_end(jobs.stream_bars(stream_of(spark, tmp_path, rows + [("z", end + timedelta(hours=3), 999, 1.0, 1.0, 0.0)], 3), "1 minute", late), str(tmp_path / "bars"))
    want = bars.ohlc(frame, "1 minute")
    pick = lambda df: sorted(tuple(r) for r in df.where("inst_id <> 'z'").select("inst_id", "window_start", "open", "high", "low", "close", "tick_count").collect())
    assert pick(got) == pick(want)


def test_keyed_state_across_batches(spark, tmp_path):
    rows = rows_of(120)
    frame = spark.createDataFrame(rows, TICKS)
    for k in range(3):  # three batches, in order of time
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], TICKS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    source = lambda: spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = jobs.stream_jumps(source(), str(tmp_path / "jumps"))
    key = lambda df: sorted((r.inst_id, r.seq) for r in df.where("is_anomaly").collect())
    assert key(got) == key(monitor.flag_jumps(frame))
    found = jobs.stream_breakouts(source(), str(tmp_path / "breaks"))
    want = patterns.breakouts(frame)
    pick = lambda df: sorted((r.inst_id, r.calm_start, r.break_seq, round(r.calm_price, 6)) for r in df.collect())
    assert pick(found) == pick(want) and found.count() > 0


def test_a_late_price_is_held_against_the_carried_one(spark, tmp_path):
    """Batches in order of arrival: a null price is passed over, a late row meets the last price before its batch."""
    batches = [
        [("a", T0 + timedelta(minutes=5), 1, 100.0, 1.0, 0.0), ("b", T0, 2, None, 1.0, 0.0)],
        [("a", T0, 3, 50.0, 1.0, 0.0), ("a", T0 + timedelta(minutes=6), 4, None, 1.0, 0.0), ("b", T0, 5, 9.0, 1.0, 0.0)],
        [("a", T0 + timedelta(minutes=7), 6, 51.0, 1.0, 0.0), ("b", T0, 7, 10.0, 1.0, 0.0)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, TICKS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    source = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    jobs.stream_jumps(source, str(tmp_path / "jumps"))
    got = jobs.stream_jumps(source, str(tmp_path / "jumps"))  # started again with nothing new: the table stays as it is
    assert {r.seq: r.is_anomaly for r in got.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}


def test_a_stream_without_rows_gives_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], TICKS).write.parquet(str(tmp_path / "in"))
    got = jobs.stream_breakouts(spark.readStream.schema(TICKS).parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    assert got.count() == 0 and got.columns[0] == "inst_id"


def test_presets_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    bar = "inst_id string, bar_time timestamp, open double, high double, low double, close double, volume double"
    rows = [(k, T0 + timedelta(days=i), 10.0 + i % 7, 12.0 + i % 7, 9.0, 10.0 + (i * 5) % 11, 1.0 + i % 3) for i in range(40) for k in "ab"]
    for k in range(3):
        spark.createDataFrame(rows[k * 28 : k * 28 + 28], bar).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    source = spark.readStream.schema(bar).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = jobs.stream_presets(source, str(tmp_path / "out"), ["GOLDEN_CROSS", "BOLLINGER_BANDS"], history=30)
    want = presets.preset_signals(spark.createDataFrame(rows, bar), ["GOLDEN_CROSS", "BOLLINGER_BANDS"])
    pick = lambda df: sorted((r.inst_id, r.bar_time, r.preset, r.signal_type) for r in df.collect())
    assert pick(got) == pick(want)


def test_late_and_repeated_rows_of_a_stream(spark, tmp_path):
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    batches = [
        [("a", at(0), 1, 1.0, 1.0, 0.0), ("a", at(0), 1, 1.0, 1.0, 0.0), ("a", at(30), 2, 2.0, 1.0, 0.0)],
        [("a", at(31), 4, 3.0, 1.0, 0.0)],
        [("a", at(0), 3, 9.0, 1.0, 0.0), ("a", at(31), 4, 3.0, 1.0, 0.0)],  # seq 3 is late: Spark goes by the watermark of the batch before
        [("a", at(90), 5, 4.0, 1.0, 0.0)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, TICKS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    source = lambda: spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    done = jobs.run_to_end(jobs.stream_bars(source(), "1 minute", "5 seconds"), str(tmp_path / "bars"))
    assert sorted((r.window_start, r.tick_count, r.close) for r in done.collect()) == [(at(0), 2, 1.0), (at(30), 1, 2.0), (at(31), 2, 3.0)]
    once = jobs.run_to_end(jobs.stream_once(source(), ["inst_id", "seq"]), str(tmp_path / "once"))
    assert sorted(r.seq for r in once.collect()) == [1, 2, 4, 5]


def test_event_time_and_refreshed_lookups(spark, tmp_path):
    spark.createDataFrame([('{"ts":"1704067200000"}',), ('{"ts":"1704067260000"}',)], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    timed = jobs.with_event_time(spark.readStream.text(str(tmp_path / "in")))
    assert sorted(r.event_time for r in jobs.run_to_end(timed, str(tmp_path / "timed")).collect()) == [T0, T0 + timedelta(minutes=1)]
    reads = []

    def lookup(session):
        reads.append(1)
        return session.createDataFrame([("a", len(reads))], "inst_id string, version int")

    each = jobs.refreshing(lookup, lambda rows, table: rows.join(table, "inst_id"), sinks.write_batch(str(tmp_path / "joined")))
    rows = spark.createDataFrame(rows_of(4), TICKS)
    each(rows, 0), each(rows, 1)
    assert {(r.batch_id, r.version) for r in spark.read.parquet(str(tmp_path / "joined")).collect()} == {(0, 1), (1, 2)}


def test_the_rest_works_without_the_text_folders():
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith(("quotemill.llm", "corpus_pipeline"))]:
        del sys.modules[name]

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "quotemill.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    gone = Gone()
    sys.meta_path.insert(0, gone)
    try:
        importlib.reload(entry)
        names = entry.queries()
        assert "ohlc_hourly" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
        assert set(entry.oracle_sql()) <= set(names)
    finally:
        sys.meta_path.remove(gone)
    assert set(entry.oracle_sql()) <= set(entry.queries())
