"""Streams on Spark's state store: several batches, restarts, changed keys only, commits, late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_ordered import START, brute_breakouts, frame, series
from tests.test_streams import feed, good, message
from tideline.operators import indicators
from tideline.sources import ticks as tick_source
from tideline.streaming import run, stateful

ROWS = "id long, ts timestamp, ticker string, price double"


def stream(spark, source):
    return tick_source.good_ticks(tick_source.parsed(tick_source.message_files(spark, str(source), max_files=1)))


@pytest.fixture()
def source(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    return path


def test_breakouts_go_on_after_each_restart(spark, folder, source):
    rows = good(series(240))
    for step in range(6):
        feed(source, f"{step}.txt", [message(r) for r in rows[step * 40 : step * 40 + 40]])
        if step % 2:
            # Every second file waits for the next start, so a start finds one or two batches.
            found = stateful.breakouts(stream(spark, source), 90.0, 10)
            run.finish(run.to_files(found, f"{folder}/out", f"{folder}/checkpoint"))
    alerts = spark.read.schema(found.schema).parquet(f"{folder}/out").collect()
    assert {r.id: (r.ticker, r.history) for r in alerts} == brute_breakouts(rows, 90.0, 10)
    assert all(len(r.history) == len(r.history_ts) == r.history_len and r.history_ts[-1] == r.ts for r in alerts)


def test_crossings_do_not_depend_on_the_batches(spark, tmp_path):
    rows = [("a" if i % 3 else "b", START + dt.timedelta(minutes=60 * i), 100 + 40 * ((i * 7919) % 101) / 101) for i in range(150)]
    shape = "ticker string, window_start timestamp, close double"

    def crossings(cuts):
        root = tmp_path / f"cut{len(cuts)}"
        for low, high in zip([0, *cuts], [*cuts, len(rows)]):
            spark.createDataFrame(rows[low:high], shape).coalesce(1).write.mode("append").parquet(f"{root}/in")
            candles = spark.readStream.schema(shape).parquet(f"{root}/in")
            run.finish(run.to_files(stateful.indicator_crosses(candles, 5), f"{root}/out", f"{root}/checkpoint"))
        found = spark.read.schema("ticker string, window_start timestamp, indicator string, cross string").parquet(f"{root}/out")
        return sorted(map(tuple, found.collect()))

    whole = crossings([])
    assert whole and crossings([40, 41, 90]) == whole
    batch = spark.createDataFrame(rows, shape)
    direct = [("RSI_30", indicators.crosses(indicators.rsi(batch, 5), "prev_rsi", "rsi", 30.0)), ("RSI_70", indicators.crosses(indicators.rsi(batch, 5), "prev_rsi", "rsi", 70.0))]
    direct.append(("MACD", indicators.crosses(indicators.with_previous(indicators.macd(batch), "histogram"), "prev_histogram", "histogram", 0.0)))
    want = sorted((r.ticker, r.window_start, name, r.cross) for name, rows_ in direct for r in rows_.collect())
    assert whole == want


def test_latest_writes_changed_tickers_only(spark, folder, source):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    steps = [[(i, at(i), f"t{i}", 1.0) for i in range(20)], [(30, at(30), "t3", 7.0)], [(31, at(1), "t3", 8.0)], [(32, at(40), "new", 9.0)]]
    for step, rows in enumerate(steps):
        feed(source, f"{step}.txt", [message(r) for r in rows])
        newest = stateful.latest(stream(spark, source))
        run.finish(run.each_batch(newest, run.changes_handler(folder), f"{folder}/checkpoint").outputMode("update"))
        if step == 1:
            assert run.compact_changes(spark, folder, ["ticker"], newest.schema) == 1
    written = {b: spark.read.parquet(f"{folder}/changes/batch={b}").count() for b in range(4)}
    assert written == {0: 20, 1: 1, 2: 1, 3: 1}
    got = {r.ticker: r.id for r in run.latest_changes(spark, folder, ["ticker"], newest.schema).collect()}
    assert got == {f"t{i}": i for i in range(20)} | {"t3": 30, "new": 32}
    # After the base, the changes that went into it are not read.
    plan = run.latest_changes(spark, folder, ["ticker"], newest.schema)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "(batch#" in plan


def test_nothing_to_compact(spark, folder):
    from pyspark.sql.types import StructType

    shape = StructType.fromDDL("ticker string, id long")
    assert run.compact_changes(spark, folder, ["ticker"], shape) is None
    assert run.latest_changes(spark, folder, ["ticker"], shape).count() == 0


def test_a_batch_killed_between_sinks_is_not_seen(spark, folder, source):
    feed(source, "0.txt", [message((1, START, "a", 1.0))])
    broken = {1}

    def two_sinks(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/first/batch={batch_id}")
        if batch_id in broken:
            raise RuntimeError("killed between two sinks")
        batch.select("id").write.mode("overwrite").parquet(f"{folder}/second/batch={batch_id}")

    def start():
        return run.finish(run.each_batch(stream(spark, source), run.committed(two_sinks, folder), f"{folder}/checkpoint"))

    def ids(sink):
        return sorted(r.id for r in run.committed_rows(spark, folder, sink, stream(spark, source).schema).collect())

    start()
    feed(source, "1.txt", [message((2, START, "a", 2.0))])
    with pytest.raises(Exception, match="between two sinks"):
        start()
    assert spark.read.parquet(f"{folder}/first/batch=1").count() == 1
    assert ids("first") == ids("second") == [1]
    broken.clear()
    start()
    assert ids("first") == ids("second") == [1, 2]


def test_interval_context_by_brute_force_and_late_rows(spark, folder, source):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    rows = sorted(good(series(200, 8)), key=lambda r: (r[1], r[0]))
    end = rows[-1][1]
    steps = [rows[:70], rows[70:140], rows[140:], [(1000, end + dt.timedelta(days=9), "hot", 1.0)], [(1001, at(0), "hot", 1.0), (1002, end + dt.timedelta(days=10), "hot", 1.0)]]
    late = 0
    for step, part in enumerate(steps):
        feed(source, f"{step}.txt", [message(r) for r in part])
        ticks = stream(spark, source)
        alerts, headlines = ticks.filter(F.col("id") % 4 == 0), ticks.filter(F.col("id") % 4 > 0)
        # The marks of both streams move on only with rows of both.
        feed(source, f"{step}x.txt", [message((2000 + 4 * step, part[-1][1], "other", 1.0)), message((2001 + 4 * step, part[-1][1], "other", 1.0))])
        found = stateful.interval_context(alerts, headlines, ["ticker"], 7200, "1 minute", 3)
        query = run.finish(run.to_files(found, f"{folder}/out", f"{folder}/checkpoint"))
        late += run.dropped_late(query)
    got = sorted((r.alert.id, r["rank"], r.headline.id) for r in spark.read.schema(found.schema).parquet(f"{folder}/out").collect() if r.alert.ticker != "other")
    want = []
    for a in (r for r in rows if r[0] % 4 == 0):
        before = [s for s in rows if s[0] % 4 and s[2] == a[2] and a[1] - dt.timedelta(hours=2) <= s[1] <= a[1]]
        want += [(a[0], rank, s[0]) for rank, s in enumerate(sorted(before, key=lambda s: (s[1], s[0]), reverse=True)[:3], 1)]
    assert got == sorted(want) and len(got) > 50
    assert late >= 1


def test_interval_context_keeps_open_alerts_in_buckets(spark, folder, source):
    at = lambda seconds: START + dt.timedelta(seconds=seconds)
    # Ids 4, 8, ... are alerts, each with the headline a second before it.
    steps = [[(i, at(i), "hot", 1.0) for i in range(3, 403) if i % 4 in (0, 3)], *[[(i, at(86_400 + i), "other", 1.0) for i in (n, n + 1)] for n in (1000, 1004)]]
    queries = []
    for step, rows in enumerate(steps):
        feed(source, f"{step}.txt", [message(r) for r in rows])
        ticks = stream(spark, source)
        found = stateful.interval_context(ticks.filter(F.col("id") % 4 == 0), ticks.filter(F.col("id") % 4 > 0), ["ticker"], 2, "1 minute", 3, buckets=2)
        queries.append(run.finish(run.to_files(found, f"{folder}/out", f"{folder}/checkpoint")))
    query = queries[0]
    last = [s for s in query.recentProgress[0].stateOperators if s.operatorName.startswith("transformWithState")]
    # Before buckets, the 100 alerts took 100 lists and 100 timers, each some calls of its own.
    assert len(last) == 1 and last[0].customMetrics["numRegisteredTimers"] == 2
    got = sorted((r.alert.id, r["rank"], r.headline.id) for r in spark.read.schema(found.schema).parquet(f"{folder}/out").collect() if r.alert.ticker == "hot")
    assert got == [(i, 1, i - 1) for i in range(4, 403, 4)]


def test_batch_frames_have_the_same_shape(spark):
    from tideline.operators import breakout
    from tideline.operators.ordered import time_cell

    batch = breakout.breakout_history(frame(spark, good(series(50))), time_cell("ts", 3600), 90.0, 10)
    assert set(batch.columns) == {"ticker", "ts", "id", "price", "history_len", "history", "history_ts"}
