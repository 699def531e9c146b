"""Tables that change in parts, bars in order of arrival and keyed state."""

from __future__ import annotations

import os
import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quotemill.operators import bars
from quotemill.sources import tables
from quotemill.streaming import jobs, state

T0 = datetime(2024, 1, 1)
TICKS = "inst_id string, ts timestamp, seq long, last double, volume_24h double"


def ticks(seed: int, n: int, late: float = 0.2) -> list[tuple]:
    """Ticks some seconds apart, some of them from minutes before."""
    rng, out = random.Random(seed), []
    for seq in range(n):
        at = T0 + timedelta(seconds=seq * 7 - (rng.randrange(300) if rng.random() < late else 0))
        out.append((rng.choice(["a", "a", "a", "b", None]), at, seq, float(rng.randrange(1, 200)), float(rng.randrange(9))))
    return out


def arrived(rows: list[tuple], history: int, length: int) -> list[tuple]:
    """Bars by arrival, one tick after the other."""
    open_bar, held, out = {}, {}, []
    for inst, at, seq, last, volume in sorted(rows, key=lambda r: r[2]):
        minute = at.replace(second=0, microsecond=0)
        bar = open_bar.get(inst)
        if bar is None or bar[0] != minute:
            if bar is not None:
                closes = held.setdefault(inst, [])
                closes.append(bar[4])
                seen, recent = closes[-history:], closes[-history:][-length:]
                out.append((inst, *bar, seq, len(seen), round(sum(recent) / len(recent), 9), max(seen), min(seen)))
            bar = [minute, last, last, last, last, volume, 0]
        open_bar[inst] = [minute, bar[1], max(bar[2], last), min(bar[3], last), last, volume, bar[6] + 1]
    return sorted(out, key=str)


COLUMNS = ["inst_id", "bar_time", "open", "high", "low", "close", "volume", "tick_count", "completed_by", "bars_held", "mean_close", "top_close", "bottom_close"]


def plain(df) -> list[tuple]:
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("slot_rows", [1, 10, 1 << 20])
def test_bars_by_arrival(spark, slot_rows):
    rows = ticks(1, 150)
    frame = spark.createDataFrame([*rows, ("a", None, 40, 1.0, 1.0)], TICKS)
    assert plain(bars.held_history(bars.arrival_bars(frame, slot_rows=slot_rows), 8, 3)) == arrived(rows, 8, 3)
    assert len(arrived(rows, 8, 3)) > 60 and bars.arrival_bars(frame.where("false")).count() == 0


def test_a_restarted_stream_goes_on_from_its_state(spark, tmp_path):
    """Three runs of one stream; what each adds depends on the state that the runs before left."""
    rows, feed, folder = ticks(2, 160, 0.1), str(tmp_path / "feed"), str(tmp_path / "out")
    found = None
    for at in (0, 50, 100):
        spark.createDataFrame(rows[at : at + (60 if at == 100 else 50)], TICKS).coalesce(1).write.mode("append").parquet(feed)
        stream = state.stream_arrival_bars(spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(feed), history=8, length=3)
        found = jobs.run_to_end(stream, folder)
    assert plain(found) == arrived(rows, 8, 3)


def test_a_silent_key_is_forgotten(spark, tmp_path):
    """Once the watermark has passed it by the idle time, a key begins anew: its open bar never comes out."""
    feed, folder = str(tmp_path / "feed"), str(tmp_path / "out")
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    parts = [[("a", at(0), 1, 1.0, 1.0), ("a", at(1), 2, 2.0, 1.0), ("b", at(1), 3, 5.0, 1.0)], [("b", at(600), 4, 6.0, 1.0)], [("b", at(601), 5, 7.0, 1.0)], [("a", at(602), 6, 3.0, 1.0), ("a", at(603), 7, 4.0, 1.0)]]
    for part in parts:
        spark.createDataFrame(part, TICKS).coalesce(1).write.mode("append").parquet(feed)
        stream = state.stream_arrival_bars(spark.readStream.schema(TICKS).parquet(feed), lateness="10 seconds", idle_seconds=3600)
        found = jobs.run_to_end(stream, folder)
    got = sorted((r.inst_id, r.close, r.bars_held) for r in found.collect())
    assert got == [("a", 1.0, 1), ("a", 3.0, 1), ("b", 5.0, 1), ("b", 6.0, 2)]


def days_of(rows: list[tuple]) -> list[tuple]:
    """The ticks over four days, with late ones of the day before."""
    return [(i, t + timedelta(hours=seq // 3 - (20 if seq % 17 == 0 else 0)), seq, last, v) for i, t, seq, last, v in rows]


def files(path) -> dict[str, float]:
    return {str(p.relative_to(path)): os.stat(p).st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_increments_merge_to_the_full_rollup(spark, tmp_path):
    rows, path = days_of(ticks(3, 260)), str(tmp_path / "states")
    frame = spark.createDataFrame(rows, TICKS).cache()
    plain_of = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    for batch, (a, b) in enumerate([(0, 90), (90, 200), (200, 260)]):
        before = files(path) if batch else {}
        part = frame.where(F.col("seq").between(a, b - 1))
        tables.merge_rollup(part, batch, path, "1 hour")
        after = files(path)
        touched = {f"day={r.d}" for r in part.select(F.to_date("ts").alias("d")).distinct().collect()}
        kept = {f: t for f, t in before.items() if f.split("/")[0] not in touched}
        assert kept.items() <= after.items() and (batch == 0 or kept)
        tables.merge_rollup(part, batch, path, "1 hour")  # again, as after a failure
        want = tables.finished(tables.merged_states(tables.partial_states(frame.where(F.col("seq") < b), "1 hour")))
        assert plain_of(tables.finished(tables.read_states(spark, path))) == plain_of(want)
    day = [r for r in rows if r[0] == "a" and r[1].date() == date(2024, 1, 2)]
    got = tables.finished(tables.coarser_states(tables.read_states(spark, path), "1 day")).where("inst_id = 'a' and date(window_start) = '2024-01-02'").first()
    prices = [r[3] for r in day]
    first, last = min(day, key=lambda r: (r[1], r[2]))[3], max(day, key=lambda r: (r[1], r[2]))[3]
    assert (got.open, got.high, got.low, got.close, got.tick_count) == (first, max(prices), min(prices), last, len(day))
    mean = sum(prices) / len(prices)
    assert abs(got.avg_price - mean) < 1e-9 and abs(got.sd_price - (sum((x - mean) ** 2 for x in prices) / len(prices)) ** 0.5) < 1e-6


def test_a_batch_that_reached_some_days_only_is_finished(spark, tmp_path):
    """A run that died after it had replaced one of its days: the repetition merges the others."""
    frame, path = spark.createDataFrame(days_of(ticks(4, 200)), TICKS).cache(), str(tmp_path / "states")
    tables.merge_rollup(frame.where("seq < 100"), 0, path, "1 hour")
    whole = frame.where("seq >= 100")
    one = whole.select(F.min(F.to_date("ts"))).first()[0]
    tables.merge_rollup(whole.where(F.to_date("ts") == F.lit(one)), 1, path, "1 hour")
    tables.merge_rollup(whole, 1, path, "1 hour")
    want = tables.merged_states(tables.partial_states(frame, "1 hour"))
    total = lambda df: {(r.inst_id, r.window_start): (r.n, r.open, r.close) for r in df.collect()}
    assert total(tables.read_states(spark, path)) == total(want)
    tables.merge_rollup(frame.where("false"), 2, path, "1 hour")


def test_old_days_leave_without_a_rewrite(spark, tmp_path):
    path = str(tmp_path / "days")
    days = [(date(2024, 1, 10) + timedelta(k), k) for k in range(20)] + [(None, 99)]
    spark.createDataFrame(days, "trade_date date, n int").write.partitionBy("trade_date").parquet(path)
    before = files(path)
    gone = tables.drop_days(spark, path, date(2024, 1, 20))
    assert gone == [f"trade_date=2024-01-{d:02d}" for d in (10, 11, 12, 24, 25, 26, 27, 28, 29)]
    after = files(path)
    assert after.items() <= before.items() and sorted(r.n for r in spark.read.parquet(path).collect()) == [*range(3, 14), 99]
    assert tables.drop_days(spark, path, date(2024, 1, 20)) == [] and tables.drop_days(spark, str(tmp_path / "none"), date(2024, 1, 20)) == []


def test_a_load_that_dies_half_way_leaves_each_row_once(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "loads"), spark.range(1000).select("id", F.lit("x" * 50).alias("text"))
    write = tables.load_labelled(path, "l", max_rows=300)
    broken = rows.withColumn("id", F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("no more")).cast("long")))
    with pytest.raises(Exception, match="no more"):
        write(broken, 0)
    write(rows.where("id < 10"), 1)
    assert tables.read_loads(spark, path, "id long, text string").count() == 10  # nothing of the broken one
    with monkeypatch.context() as m:  # staged, but not committed
        m.setattr(tables.Folder, "rename", lambda *_: False)
        with pytest.raises(OSError, match="committed"):
            write(rows, 0)
    assert tables.read_loads(spark, path, "id long, text string").count() == 10
    for _ in range(2):
        write(rows, 0)
    found = tables.read_loads(spark, path, "id long, text string")
    assert found.groupBy("label").count().where("label = 'l-0'").first()["count"] == 1000 and found.count() == 1010
    assert found.where("label = 'l-0'").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 300
    tables.load_labelled(path, "small", max_bytes=1000)(rows.where("id < 100"), 0)
    small = tables.read_loads(spark, path, "id long, text string").where("label = 'small-0'")
    assert small.count() == 100 and small.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 20


@pytest.mark.parametrize("idle", [None, 30])
def test_a_silent_side_does_not_hold_back_a_join(spark, tmp_path, idle):
    """The swap side says nothing after its first row. Spot rows without a partner come out only if the spot side's time counts for it."""
    at = lambda s: T0 + timedelta(seconds=s)
    spot, swap, folder = str(tmp_path / "spot"), str(tmp_path / "swap"), str(tmp_path / "out")
    write = lambda rows, path, name: spark.createDataFrame(rows, f"symbol string, {name}_ts timestamp, {name}_n int").coalesce(1).write.mode("append").parquet(path)
    write([("x", at(1), 1)], swap, "swap")
    found = None
    for rows in ([("x", at(0), 1), ("x", at(40), 2)], [("x", at(300), 3), ("y", at(301), 4)], [("x", at(600), 5)], [("x", at(601), 6)]):
        write(rows, spot, "spot")
        read = lambda path, name: spark.readStream.schema(f"symbol string, {name}_ts timestamp, {name}_n int").parquet(path)
        found = jobs.run_to_end(jobs.stream_pairs(read(spot, "spot"), read(swap, "swap"), how="leftOuter", idle_seconds=idle), folder)
    got = sorted((r.spot_n, r.swap_n) for r in found.collect())
    assert got == ([(1, 1)] if idle is None else [(1, 1), (2, None), (3, None), (4, None)])


def test_a_row_of_a_side_that_woke_up_is_met(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    spot, swap, folder = str(tmp_path / "spot"), str(tmp_path / "swap"), str(tmp_path / "out")
    write = lambda rows, path, name: spark.createDataFrame(rows, f"symbol string, {name}_ts timestamp, {name}_n int").coalesce(1).write.mode("append").parquet(path)
    write([("x", at(0), 1)], swap, "swap")
    steps = [([("x", at(100), 1)], []), ([("x", at(110), 2)], [("x", at(95), 2)]), ([("x", at(500), 3)], [])]
    for rows, others in steps:
        write(rows, spot, "spot")
        if others:
            write(others, swap, "swap")  # 15 seconds behind: within the idle time
        read = lambda path, name: spark.readStream.schema(f"symbol string, {name}_ts timestamp, {name}_n int").parquet(path)
        found = jobs.run_to_end(jobs.stream_pairs(read(spot, "spot"), read(swap, "swap"), idle_seconds=30), folder)
    assert [(r.spot_n, r.swap_n) for r in found.collect()] == [(1, 2)]
