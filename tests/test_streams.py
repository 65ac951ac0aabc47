"""Streams fed in several steps, repeated batches, and parity with the batch operators."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tests.test_ordered import START, brute_breakouts, frame, series, usable
from tideline.operators import indicators
from tideline.operators.ordered import time_cell
from tideline.operators.sessions import activity_sessions
from tideline.plans import watchdog
from tideline.sinks import lake
from tideline.sources import ticks as tick_source
from tideline.streaming import candles, run, watch


def feed(path, name, lines):
    with open(f"{path}/{name}", "w") as file:
        file.write("\n".join(lines) + "\n")


def message(row):
    return json.dumps({"id": row[0], "ticker": row[2], "price": row[3], "timestamp": row[1].replace(tzinfo=dt.timezone.utc).timestamp()})


def good(rows):
    return [r for r in usable(rows) if r[2] is not None]


def test_watchdog_over_several_batches(spark, folder, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = good(series(240))
    schedules = spark.createDataFrame([(7, 70), (8, 80)], "schedule_id long, scope_id long")
    watched = spark.createDataFrame([("hot", 7), ("hot", 8), ("cold", 99)], "ticker string, schedule_id long")
    for step in range(3):
        feed(source, f"{step}.txt", [message(r) for r in rows[step * 80 : step * 80 + 80]] + ["{broken", '{"ticker":"x"}'])
        stream = tick_source.message_files(spark, str(source), max_files=1)
        run.finish(watchdog.watchdog(stream, schedules, watched, f"{folder}/out", time_cell("ts", 3600), 90.0, 10))
    alerts = spark.read.parquet(f"{folder}/out/alerts/batch=*").collect()
    want = brute_breakouts(rows, 90.0, 10)
    assert {r.id: (r.ticker, r.history) for r in alerts} == want
    assert spark.read.parquet(f"{folder}/out/dead_letters/batch=*").count() == 6
    fired = spark.read.parquet(f"{folder}/out/triggers/batch=*").collect()
    hot = [i for i, (key, _) in want.items() if key == "hot"]
    assert sorted((r.id, r.schedule_id, r.scope_id) for r in fired) == sorted((i, s, 10 * s) for i in hot for s in (7, 8))
    assert {r.run_name for r in fired} == {"dynamic_scope_70_sch_7", "dynamic_scope_80_sch_8"}
    assert {r.event_trigger_source for r in fired} == {"STREAMING_FAST_LANE_BREAKOUT_RESISTANCE"}


def test_a_repeated_batch_writes_the_same(spark, folder):
    rows = good(series(200))
    handle = watch.breakout_handler(folder, time_cell("ts", 3600), 90.0, 10)
    handle(frame(spark, rows[:100]), 0)
    for _ in range(2):
        handle(frame(spark, rows[100:]), 1)
    alerts = spark.read.parquet(f"{folder}/alerts/batch=*").collect()
    assert {r.id: (r.ticker, r.history) for r in alerts} == brute_breakouts(rows, 90.0, 10)
    assert len(alerts) == len({r.id for r in alerts})
    assert lake.latest_version(spark, f"{folder}/state") == 1


def test_late_ticks_come_after_earlier_batches(spark, folder):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    steps = [
        [(1, at(100), "a", 1.0), (2, at(101), "a", 2.0)],
        [(3, at(1), "a", 300.0)],
        [(4, at(2), "a", 4.0), (5, at(0), "a", 3.0)],
        [(6, at(200), "a", 400.0)],
    ]
    handle = watch.breakout_handler(folder, time_cell("ts", 3600), 90.0, 10)
    for number, rows in enumerate(steps):
        handle(frame(spark, rows), number)
    alerts = spark.read.parquet(f"{folder}/alerts/batch=*").collect()
    assert {r.id: r.history for r in alerts} == {3: [1.0, 2.0, 300.0], 6: [3.0, 4.0, 400.0]}


def test_a_late_alert_finds_its_headlines(spark, folder):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    steps = [
        [(1, at(1), "a", 1.0), (2, at(2), "a", 2.0)],
        [(3, at(30), "a", 3.0), (4, at(31), "a", 4.0), (5, at(32), "a", 5.0)],
        [(6, at(3), "a", 100.0)],
    ]
    handle = watch.context_handler(folder, ["ticker"], time_cell("ts", 3600), 2, F.col("price") >= 100, F.col("price") < 100)
    for number, rows in enumerate(steps):
        handle(frame(spark, rows), number)
    found = spark.read.parquet(f"{folder}/context/batch=*").orderBy("rank").collect()
    assert [(r.alert.id, r.headline.id) for r in found] == [(6, 2), (6, 1)]


def test_latest_state_over_batches(spark, folder):
    rows = good(series(120))
    handle = watch.latest_handler(folder)
    handle(frame(spark, rows[60:]), 0)
    handle(frame(spark, rows[:60]), 1)
    got = {r.ticker: r.id for r in lake.snapshot(spark, folder, 1).collect()}
    assert got == {key: max((r for r in rows if r[2] == key), key=lambda r: (r[1], r[0]))[0] for key in ("hot", "cold")}
    assert lake.latest_version(spark, f"{folder}/none") is None


def test_messages_without_ids_and_with_unusable_values(spark):
    lines = [
        '{"ticker":"a","price":1.5,"timestamp":10.0}', '{"ticker":"a","price":2.5,"timestamp":10.0}',
        '{"ticker":"a","price":2.5,"timestamp":10.0}', '{"ticker":"a","price":1,"timestamp":"NaN"}', '{"ticker":"a","price":1,"timestamp":1e300}',
        '{"ticker":"a","price":1e19,"timestamp":1}', '{"ticker":"a","price":"Infinity","timestamp":1}', '{"ticker":"a","price":"-Infinity","timestamp":1}',
        '{"ticker":"a","timestamp":1}', "{}", "", None, "[",
    ]
    rows = tick_source.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    good = tick_source.good_ticks(rows)
    ids = [r.id for r in good.collect()]
    assert len(ids) == 3 and len(set(ids)) == 2 and None not in ids
    assert tick_source.dead_letters(rows).count() == 10
    five = candles.candles.ohlcv(good, "5 minutes").first()
    assert {five.open, five.close} <= {1.5, 2.5} and (five.n, five.volume) == (3, 6.5)
    bare = good.withColumn("id", F.lit(None).cast("long"))
    assert candles.candles.ohlcv(bare, "5 minutes").first().open is not None
    assert candles.candles.ohlcv(bare.drop("id"), "5 minutes").first().close is not None


def test_late_and_duplicate_ticks(spark, folder, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    steps = [
        [(1, at(0), "a", 1.0), (1, at(0), "a", 1.0), (2, at(1), "a", 2.0)],
        [(3, at(60), "a", 3.0), (2, at(1), "a", 2.0)],
        [(4, at(2), "a", 9.0), (5, at(120), "a", 5.0)],
    ]
    ticks = lambda: tick_source.good_ticks(tick_source.parsed(tick_source.message_files(spark, str(source), 1)))
    for i, rows in enumerate(steps):
        feed(source, f"{i}.txt", [message(r) for r in rows])
        once = candles.without_duplicates(ticks(), "30 minutes").select("id", "price")
        run.finish(run.to_files(once, f"{folder}/once", f"{folder}/c1"))
        closed = candles.stream_ohlcv(ticks(), "5 minutes", "30 minutes")
        run.finish(run.to_files(closed, f"{folder}/closed", f"{folder}/c2"))
    kept = sorted(r.id for r in spark.read.parquet(f"{folder}/once").collect())
    assert kept == [1, 2, 3, 5], "the duplicate and the tick behind the watermark are dropped"
    bars = {r.window_start: r for r in spark.read.parquet(f"{folder}/closed").collect()}
    assert bars[at(0)].close == 2.0 and bars[at(60)].close == 3.0 and at(120) not in bars


def test_indicator_crossings_do_not_depend_on_the_batches(spark, tmp_path):
    rows = [("a" if i % 3 else "b", START + dt.timedelta(minutes=60 * i), 100 + 40 * ((i * 7919) % 101) / 101) for i in range(150)]
    shape = "ticker string, window_start timestamp, close double"

    def crossings(cuts):
        root = str(tmp_path / f"cut{len(cuts)}")
        handle = watch.indicator_handler(root, 5)
        for batch_id, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            handle(spark.createDataFrame(rows[low:high], shape), batch_id)
        found = spark.read.parquet(f"{root}/crosses/batch=*")
        return sorted(map(tuple, found.select("ticker", "window_start", "indicator", "cross").collect()))

    whole = crossings([])
    assert whole and crossings([40, 41, 90]) == whole
    direct = indicators.crosses(indicators.rsi(spark.createDataFrame(rows, shape), 5), "prev_rsi", "rsi", 70.0).count()
    assert direct == sum(1 for r in whole if r[2] == "RSI_70")


def test_sessions_in_a_stream_match_the_batch(spark, folder, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = good(series(150))
    feed(source, "0.txt", [message(r) for r in rows])
    ticks = tick_source.good_ticks(tick_source.parsed(tick_source.message_files(spark, str(source))))
    closed = candles.stream_sessions(ticks, "ticker", "1 hour", "1 minute")
    run.finish(run.to_files(closed, f"{folder}/out", f"{folder}/c"))
    got = {tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()}
    batch = activity_sessions(frame(spark, rows), ["ticker"], 3600, cell_seconds=5400)
    ended = batch.filter(F.col("last_ts") + F.expr("interval 61 minutes") < max(r[1] for r in rows))
    assert got == {tuple(r) for r in ended.collect()} and got


def test_archive_and_republish(spark, folder, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = good(series(60))
    feed(source, "0.txt", [message(r) for r in rows])
    ticks = tick_source.good_ticks(tick_source.parsed(tick_source.message_files(spark, str(source))))
    run.finish(candles.archive(ticks, f"{folder}/raw", f"{folder}/c"))
    assert {r.id for r in spark.read.parquet(f"{folder}/raw").collect()} == {r[0] for r in rows}


def test_context_over_batches(spark, folder):
    rows = good(series(200, 8))
    handle = watch.context_handler(folder, ["ticker"], time_cell("ts", 3600), 3, F.col("id") % 4 == 0, F.col("id") % 4 > 0)
    for batch_id, low in enumerate((0, 70, 140)):
        handle(frame(spark, rows[low : low + 70]), batch_id)
    got = {(r.alert.id, r["rank"]): r.headline.id for r in spark.read.parquet(f"{folder}/context/batch=*").collect()}
    want = {}
    for a in (r for r in rows if r[0] % 4 == 0):
        before = [s for s in rows if s[0] % 4 and s[2] == a[2] and s[1] <= a[1]]
        for rank, s in enumerate(sorted(before, key=lambda s: (s[1], s[0]), reverse=True)[:3], 1):
            want[(a[0], rank)] = s[0]
    # A headline at the alert's very time may arrive only with the next batch.
    late = [r for r in rows if r[1] in (rows[69][1], rows[139][1])]
    assert len(late) == 2 and got == want


def test_final_context_waits_for_the_horizon(spark, folder):
    """Headlines after their alert, a far-future time, an alert behind the horizon; any split gives the same."""
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    rows = [
        (1, at(1), "a", 1.0), (6, at(30), "a", 100.0), (2, at(20), "a", 2.0), (9, dt.datetime(9000, 1, 1), "a", 9.0), (3, at(29), "a", 3.0),
        (7, at(31), "a", 100.0), (4, at(50), "a", 4.0), (5, at(200), "a", 5.0),
    ]
    for number, splits in enumerate(([8], [2, 8], [1, 2, 3, 4, 5, 6, 7, 8])):
        root = f"{folder}/{number}"
        handle = watch.context_handler(root, ["ticker"], time_cell("ts", 3600), 2, F.col("price") >= 100, F.col("price") < 100)
        for batch_id, (low, high) in enumerate(zip([0, *splits], splits)):
            handle(frame(spark, rows[low:high]), batch_id)
        handle(frame(spark, [(8, at(40), "a", 100.0)]), len(splits))
        got = watch.final_context(spark, root, ["ticker"], time_cell("ts", 3600), 2).collect()
        assert sorted((r.alert.id, r["rank"], r.headline.id) for r in got) == [(6, 1, 3), (6, 2, 2), (7, 1, 3), (7, 2, 2)]
        assert [r.id for r in spark.read.parquet(f"{root}/late/batch=*").collect()] == [8]
