import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import arguments, blocks, ids, text


def one(spark, column, shape, *values):
    return spark.createDataFrame([tuple(values)], shape).select(column.alias("x")).first()["x"]


def test_placeholder_embedding(spark):
    frame = spark.createDataFrame([("",), (None,), ("abc",)], "content string").select(ids.placeholder_embedding(dim=4).alias("e"))
    assert [r.e for r in frame.collect()] == [[0.0] * 4, [0.0] * 4, [0.003] * 4]


def test_vector_text_is_json(spark):
    got = one(spark, ids.vector_text(ids.placeholder_embedding(dim=3)), "content string", "a" * 416)
    assert got == json.dumps([0.416] * 3)


AWKWARD = ["", "a", "a\n", "a\r\nb", "a\rb\n", "\n\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "a\x1fb\u00a0c\u3000d  e\t", " ", "é ü 漢字 😀"]


def test_line_and_word_counts_follow_python(spark):
    frame = spark.createDataFrame([(t,) for t in AWKWARD], "t string")
    for row in frame.select("t", text.line_count("t").alias("l"), text.word_count("t").alias("w")).collect():
        assert (row.l, row.w) == (len(row.t.splitlines()), len(row.t.split())), repr(row.t)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\r\x0b\x1c\x1f\x85\u2028\u00a0😀", max_size=30), min_size=1, max_size=40))
def test_counts_and_chunks_on_any_text(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", text.line_count("t").alias("l"), text.word_count("t").alias("w"), text.chunks("t", 5, 2).alias("c")).collect()
    for row in rows:
        assert (row.l, row.w) == (len(row.t.splitlines()), len(row.t.split()))
        whole = row.t
        starts = range(0, max(1, len(whole) - 2), 3) if whole else []
        assert row.c == [whole[s : s + 5] for s in starts]


def test_chunks_need_a_step():
    with pytest.raises(ValueError):
        text.chunks("t", 5, 5)


def test_clean_html(spark):
    html = '<p>A&amp;lt;B</p><script>var t="</p>";</script><STYLE>p{}</STYLE><!-- x\ny --> c&nbsp;d'
    assert one(spark, text.clean_html("h"), "h string", html) == "A&lt;B c d"


def test_dated_events(spark):
    got = one(spark, text.dated_events("t"), "t string", "On 2026-05-15: Dividend Payment. Later 2026-06-01 CEO leaves\nEnd")
    assert [(e.date, e.event) for e in got] == [("2026-05-15", "Dividend Payment"), ("2026-06-01", "CEO leaves")]


def test_canonical_json_equals_python(spark):
    value = {"b": [1, 2.5, None, True], "a": {"é": "ü\n", "c": 1e22}}
    got = one(spark, ids.canonical_json(F.col("j")), "j string", json.dumps(value))
    assert got == json.dumps(value, sort_keys=True, separators=(",", ":"))
    assert one(spark, ids.content_hash("j"), "j string", got) == hashlib.sha256(got.encode()).hexdigest()


def test_mime_types(spark):
    frame = spark.createDataFrame([(".JPG",), ("parquet",), ("exe",), (None,)], "e string")
    got = [r.m for r in frame.select(ids.mime_type(F.col("e")).alias("m")).collect()]
    assert got == ["image/jpeg", "application/parquet", ids.DEFAULT_MIME, ids.DEFAULT_MIME]


def test_uri_parts(spark):
    frame = spark.createDataFrame([("s3a://b/k/x.json",), ("s3a://b",), ("http://b/k",), (None,)], "u string")
    got = [tuple(r) for r in frame.select(ids.uri_bucket("u"), ids.uri_key("u")).collect()]
    assert got == [("b", "k/x.json"), ("b", ""), (None, None), (None, None)]
    with pytest.raises(Exception, match="Invalid file path"):
        frame.select(ids.uri_bucket("u", strict=True)).collect()


def test_video_id(spark):
    links = ["https://youtu.be/abcdefghijk?x=1", "https://www.youtube.com/watch?v=abcdefghijk&t=1", "https://x.com/embed/short", "nothing"]
    frame = spark.createDataFrame([(u,) for u in links], "u string")
    assert [r.v for r in frame.select(ids.video_id("u").alias("v")).collect()] == ["abcdefghijk", "abcdefghijk", None, None]


def test_names(spark):
    row = spark.range(1).select(
        ids.run_name(F.lit("5e7bd6de-dd94"), F.lit("ab57de40-8337")).alias("r"), ids.task_name(F.lit("ETL"), F.lit("29f4470f-8e8a")).alias("t")
    ).first()
    assert (row.r, row.t) == ("dynamic_scope_5e7bd6de_sch_ab57de40", "etl_29f4470f")


def test_effective_arguments_later_wins(spark):
    stored = arguments.argument_map(F.lit('{"ticker":"AAPL","scope_id":"given"}'))
    override = arguments.argument_map(F.lit('{"ticker":"XAU","extra":"1"}'))
    merged = arguments.effective_arguments(F.lit("s"), F.lit("c"), F.lit("t"), stored, override)
    got = spark.range(1).select(merged.alias("m")).first()["m"]
    assert got == {"scope_id": "given", "schedule_id": "c", "task_id": "t", "ticker": "XAU", "extra": "1"}


def test_parsed_object_defaults(spark):
    frame = spark.createDataFrame([('{"a":1}',), ("",), ("{",), (None,)], "t string")
    assert [r.x for r in frame.select(F.to_json(arguments.parsed_object("t")).alias("x")).collect()] == ['{"a":1}', "{}", "{}", "{}"]


def test_labels(spark):
    frame = spark.createDataFrame([("Bullish",), ("Bearish",), ("Neutral",), ("Odd",)], "l string")
    got = [tuple(r) for r in frame.select(blocks.signal(F.col("l")), blocks.color(F.col("l")), blocks.trend(F.col("l"))).collect()]
    assert got == [("STRONG BUY", "green", "up"), ("SELL", "red", "down"), ("HOLD", "gray", "none"), ("HOLD", "blue", "none")]
    edge = spark.createDataFrame([(150.0,), (149.99,)], "a double").select(blocks.price_label(F.col("a")).alias("x")).collect()
    assert [r.x for r in edge] == ["Bullish", "Bearish"]


def test_dashboard_json_drops_absent_fields(spark):
    data = F.array(F.struct(F.lit("N/A").alias("time"), F.lit(1.5).alias("price")))
    made = blocks.dashboard_blocks(F.lit("AAPL"), F.lit("Bullish"), data, F.lit("k"))
    metric, chart = json.loads(spark.range(1).select(F.to_json(made).alias("j")).first()["j"])
    assert set(metric) == {"id", "type", "colSpan", "label", "value", "color", "trend"}
    assert set(chart) == {"id", "type", "colSpan", "title", "subType", "config", "data"}
    assert metric["label"] == "AAPL Signal" and metric["id"].startswith("metric-1-") and len(metric["id"]) == 17
    assert chart["config"]["lines"][0] == {"dataKey": "price", "name": "Price (USD)", "color": "#10b981"}
    assert chart["data"] == [{"time": "N/A", "price": 1.5}]


def test_table_columns(spark):
    frame = spark.createDataFrame([('[{"b":1,"a":2}]',), ("[]",), (None,)], "d string")
    none = F.lit(None).cast("array<struct<key:string,label:string>>")
    got = [r.c for r in frame.select(blocks.table_columns(none, F.col("d")).alias("c")).collect()]
    assert [(c.key, c.label) for c in got[0]] == [("b", "B"), ("a", "A")] and got[1:] == [None, None]


def test_card_fallbacks(spark):
    shown = blocks.card(F.lit(None).cast("string"), F.lit("Bullish"), F.lit(0.895), F.lit(""), F.lit("content"))
    row = spark.range(1).select(shown.alias("c")).first()["c"]
    assert (row.ticker, row.text) == ("N/A", "content") and row.confidence in ("89%", "90%")


def test_output_path_unless_given(spark):
    maps = [F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("output_path"), F.lit("mine"))]
    row = spark.range(1).select(*[arguments.with_output_path(m, F.lit("r1"), F.lit("t1")).alias(f"m{i}") for i, m in enumerate(maps)]).first()
    assert row.m0 == {"a": "1", "output_path": "s3a://processed-data/task_outputs/run=r1/task=t1/"} and row.m1 == {"output_path": "mine"}
