"""Alerts of any rule, runs by their own arguments, cut texts, per-row fallbacks, processed documents."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import arguments
from tideline.operators import indicators, processed
from tideline.operators.breakout import alert_payload
from tideline.operators.ordered import time_cell
from tideline.plans import clean_embed, deep_analysis

START = dt.datetime(2024, 1, 1)
CANDLE = "ticker string, window_start timestamp, open double, high double, low double, close double, n long"


def candle_rows(n=400, seed=2):
    rng, rows = random.Random(seed), []
    for i in range(n):
        o, c = rng.choice([10.0, 11.0, 12.0, 14.0]), rng.choice([9.0, 11.0, 12.0, 15.0])
        rows.append((rng.choice([None, "a", "a", "b"]), START + dt.timedelta(hours=i), o, max(o, c), min(o, c), c, rng.choice([1, 2, 9])))
    return rows


def test_rule_alerts_equal_the_single_rules(spark):
    candles = spark.createDataFrame(candle_rows(), CANDLE)
    got = {(r.ticker, r.window_start, r.event_type, r.value) for r in indicators.rule_alerts(candles, trailing=5).collect()}
    want = {(r.ticker, r.window_start, "VOLUME_SPIKE", float(r.n)) for r in indicators.volume_spike(candles, 5, 2.0).collect()}
    want |= {(r.ticker, r.window_start, r.break_type, r.close) for r in indicators.level_break(candles, 5).collect()}
    want |= {(r.ticker, r.window_start, r.pattern, r.close) for r in indicators.engulfing(candles).collect()}
    rsi = indicators.rsi(candles)
    want |= {(r.ticker, r.window_start, "RSI_UP", r.rsi) for r in indicators.crosses(rsi, "prev_rsi", "rsi", 30.0).filter("cross = 'UP'").collect()}
    want |= {(r.ticker, r.window_start, "RSI_DOWN", r.rsi) for r in indicators.crosses(rsi, "prev_rsi", "rsi", 70.0).filter("cross = 'DOWN'").collect()}
    assert got == want
    assert len({kind for _, _, kind, _ in got}) >= 5 and None in {t for t, *_ in got}


def test_rule_alerts_of_no_candles_and_of_one(spark):
    assert indicators.rule_alerts(spark.createDataFrame([], CANDLE)).count() == 0
    assert indicators.rule_alerts(spark.createDataFrame(candle_rows(1), CANDLE)).count() == 0


def test_payload_names_each_alerts_own_event(spark):
    alerts = spark.createDataFrame([("a", 1.0, START, "SUPPORT"), ("b", 2.0, START, "RSI_UP")], "ticker string, price double, ts timestamp, kind string")
    got = {r.ticker: (r.event_trigger_source, r.override_args.event_type) for r in alert_payload(alerts, F.col("kind")).collect()}
    assert got["a"][1] == "SUPPORT" and got["a"][0].endswith("SUPPORT") and got["b"][1] == "RSI_UP"


def requests_of(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, scope_id string, schedule_id string, task_id string, sent string")


def test_runs_follow_their_own_arguments(spark):
    heads = [(i, "x", START + dt.timedelta(minutes=i), "good" if i % 2 else "bad") for i in range(6)]
    headlines = spark.createDataFrame(heads, "id long, key string, ts timestamp, text string")
    late = START + dt.timedelta(hours=1)
    rows = [
        (1, "x", late, "s", "c", "t1", None), (2, "x", late, "s", "c", "t2", '{"k": "1"}'), (3, "x", late, "s", "c", "t3", '{"k": "0"}'),
        (4, "x", late, "s", "c", "t4", '{"k": "many"}'), (5, "x", late, "s", "c", "t5", '{"k": "1", "min_score": "2"}'),
        (6, "x", late, "s", "c", "t6", '{"k": "100", "output_path": "here"}'), (7, None, late, "s", "c", "t7", "not json"),
    ]
    found = deep_analysis.triggered(
        requests_of(spark, rows), arguments.argument_map(F.lit('{"k": "3"}')), arguments.argument_map(F.col("sent")),
        headlines, ["key"], time_cell("ts", 600), ["good"], ["bad"],
    )
    got = {r.id: r for r in found.collect()}
    assert {i: list(r.context) for i, r in got.items()} == {1: [5, 4, 3], 2: [5], 3: [], 4: [], 5: [5], 6: [5, 4, 3, 2, 1, 0], 7: []}
    assert got[2].sentiment == "Bullish" and got[5].sentiment == "Neutral" and got[6].sentiment == "Neutral"
    assert got[2].signal != got[5].signal
    assert got[6].arguments["output_path"] == "here" and got[1].arguments["output_path"].endswith("run=c/task=t1/")
    assert got[2].arguments["k"] == "1" and got[1].arguments["k"] == "3" and got[1].arguments["scope_id"] == "s"


def test_no_requests_give_no_runs(spark):
    headlines = spark.createDataFrame([], "id long, key string, ts timestamp, text string")
    empty = arguments.argument_map(F.lit("{}"))
    assert deep_analysis.triggered(requests_of(spark, []), empty, empty, headlines, ["key"], time_cell("ts", 600), ["a"], ["b"]).count() == 0


@pytest.mark.parametrize("size, overlap", [(4, 0), (4, 2), (100, 10)])
def test_cut_texts_cover_the_whole_text(spark, folder, size, overlap):
    texts = ["", "abc", "abcdefghijklm", "same", "same", None, "\U0001f600\n" * 9]
    raw = spark.createDataFrame([("t", x, "u", "d") for x in texts], "title string, content string, url string, published_date string")
    clean_embed.run(spark, raw, F.lit("in"), "in", "s", "c", f"{folder}/lake", f"{folder}/knowledge", dim=3, chunk_size=size, overlap=overlap)
    whole = {r.id: r.content for r in spark.read.parquet(f"{folder}/lake").collect()}
    rows = {(r.document_id, r.chunk): r for r in spark.read.parquet(f"{folder}/knowledge").collect()}
    assert set(whole.values()) == {x for x in texts if x is not None}
    for key, content in whole.items():
        parts = [rows[key, i].chunk_text for i in range(sum(1 for d, _ in rows if d == key))]
        assert parts[0] + "".join(p[overlap:] for p in parts[1:]) == content
        assert all(len(p) <= size for p in parts)
    assert all(r.embedding == [len(r.chunk_text) / 1000.0] * 3 for r in rows.values())
    assert len({r.id for r in rows.values()}) == len(rows)


def test_fallbacks_are_taken_row_by_row(spark):
    rows = [("t", "a", "d", "z", "u"), (None, "a", None, "z", None), (None, None, None, None, None)]
    raw = spark.createDataFrame([(*r, "text") for r in rows], "title string, ticker string, published_date string, timestamp string, url string, content string")
    got = clean_embed.harmonise(raw, F.lit("src")).collect()
    assert [(r.title, r.source_reference) for r in got] == [("t", "u"), ("a", "src"), ("Unknown Title", "src")]
    assert [r.published_date for r in got][:2] == ["d", "z"] and got[2].published_date is not None
    odd = spark.createDataFrame([(None, "no time")], "published_date timestamp, timestamp string")
    assert clean_embed.harmonise(odd, F.lit("src")).first().published_date is not None


def test_processed_documents_come_back_whole(spark, folder):
    candles = spark.createDataFrame(
        [("a", START, 1.0, 2.0, None), ("b", START, 3.0, 4.0, 55.5), (None, START, 5.0, 6.0, None)], "key string, window_start timestamp, open double, close double, rsi double"
    )
    figures = spark.createDataFrame([("a", 15.5, 0.8), ("b", None, None)], "key string, pe double, de double")
    task = F.concat(F.lit("t"), F.coalesce("key", F.lit("-")))
    made = processed.processed_documents(candles, figures, ["key"], F.lit("s"), task, F.col("key"))
    for _ in range(2):
        processed.save_processed(made, f"{folder}/p")
    processed.save_processed(made.filter("ticker = 'a'"), f"{folder}/p")
    got = {r.ticker: r.data_points for r in processed.read_processed(spark, f"{folder}/p").collect()}
    assert set(got) == {"a", "b", None} and got["a"].financial_ratios.PE == 15.5 and got["a"].rsi is None
    assert got["b"].rsi == 55.5 and got["b"].financial_ratios.DE is None and got[None].close == 6.0
