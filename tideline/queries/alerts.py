"""Alerts of any rule, runs by their own arguments, cut texts and processed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import arguments
from tideline.operators import breakout, candles, indicators, metadata, processed
from tideline.operators.ordered import time_cell
from tideline.plans import clean_embed, deep_analysis
from tideline.queries.registry import query
from tideline.queries.tables import SCHEDULES_SQL, documents, schedules, table, ticks
from tideline.session import scratch_dir


def _candle_sql(key: str, width: str) -> str:
    return (
        f"SELECT {key}, time_bucket(INTERVAL '{width}', ts) AS window_start, arg_min(\"value\", (ts, event_id)) AS open, "
        'max("value") AS high, min("value") AS low, arg_max("value", (ts, event_id)) AS "close", count(*) AS n FROM events GROUP BY ALL'
    )


def _series_sql(key: str, width: str, trailing: int) -> str:
    """Candles with the RSI over 14 changes and the values of the ``trailing`` candles before."""
    return f"""WITH c AS ({_candle_sql(key, width)}),
        l AS (SELECT *, row_number() OVER w AS rn, "close" - lag("close") OVER w AS d, lag(open) OVER w AS po, lag("close") OVER w AS pc,
              avg(n) OVER t AS tm, max(high) OVER t AS resistance, min(low) OVER t AS support FROM c
              WINDOW w AS (PARTITION BY {key} ORDER BY window_start), t AS (PARTITION BY {key} ORDER BY window_start ROWS BETWEEN {trailing} PRECEDING AND 1 PRECEDING)),
        g AS (SELECT *, avg(greatest(d, 0.0)) OVER w AS gain, avg(greatest(-d, 0.0)) OVER w AS loss FROM l
              WINDOW w AS (PARTITION BY {key} ORDER BY window_start ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
        r AS (SELECT *, CASE WHEN rn > 14 THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + gain / loss) END END AS rsi FROM g)
        SELECT *, round(lag(rsi) OVER (PARTITION BY {key} ORDER BY window_start), 9) AS was, round(rsi, 9) AS now FROM r"""


def _rules_sql(key: str, width: str, trailing: int, factor: float) -> str:
    return f"""WITH s AS ({_series_sql(key, width, trailing)})
        SELECT {key}, window_start, 'VOLUME_SPIKE' AS event_type, "close" AS price, CAST(n AS DOUBLE) AS "value", tm AS level FROM s WHERE rn > {trailing} AND n >= {factor} * tm
        UNION ALL SELECT {key}, window_start, 'RESISTANCE', "close", "close", resistance FROM s WHERE rn > {trailing} AND "close" > resistance
        UNION ALL SELECT {key}, window_start, 'SUPPORT', "close", "close", support FROM s WHERE rn > {trailing} AND "close" < support
        UNION ALL SELECT {key}, window_start, 'RSI_UP', "close", rsi, 30.0 FROM s WHERE was <= 30 AND now > 30
        UNION ALL SELECT {key}, window_start, 'RSI_DOWN', "close", rsi, 70.0 FROM s WHERE was >= 70 AND now < 70
        UNION ALL SELECT {key}, window_start, 'BULLISH_ENGULFING', "close", "close", pc FROM s WHERE pc < po AND "close" > open AND open <= pc AND "close" >= po
        UNION ALL SELECT {key}, window_start, 'BEARISH_ENGULFING', "close", "close", pc FROM s WHERE pc > po AND "close" < open AND open >= pc AND "close" <= po"""


@query(
    "rule_alerts",
    f"""SELECT event_type_ AS ticker, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, price, round("value", 6) AS "value",
        round(level, 6) AS level FROM ({_rules_sql("event_type_", "5 minutes", 20, 1.5).replace("SELECT event_type_, time_bucket", "SELECT event_type AS event_type_, time_bucket")})""",
)
def rule_alerts(spark, sf_dir):
    found = indicators.rule_alerts(candles.ohlcv(ticks(spark, sf_dir), "5 minutes"), factor=1.5)
    return found.select(
        "ticker", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "price",
        F.round("value", 6).alias("value"), F.round("level", 6).alias("level"),
    )


@query(
    "rule_requests",
    f"""SELECT s.schedule_id, s.scope_id, 'user-' || a.user_id AS ticker, a.price AS trigger_price, a.event_type,
        'STREAMING_FAST_LANE_' || a.event_type AS trigger_source, strftime(a.window_start, '%Y-%m-%dT%H:%M:%S.%f') AS detected_at,
        'dynamic_scope_' || left(CAST(s.scope_id AS VARCHAR), 8) || '_sch_' || left(CAST(s.schedule_id AS VARCHAR), 8) AS run_name
        FROM ({_rules_sql("user_id", "1 day", 7, 2.0)}) a JOIN ({SCHEDULES_SQL}) s ON s.schedule_id = a.user_id""",
)
def rule_requests(spark, sf_dir):
    daily = candles.ohlcv(ticks(spark, sf_dir), "1 day", keys=["user_id"])
    alerts = indicators.rule_alerts(daily, trailing=7, keys=["user_id"]).withColumns(
        {"ticker": F.concat(F.lit("user-"), "user_id"), "ts": F.col("window_start")}
    )
    fired = breakout.alert_payload(alerts, F.col("event_type")).withColumnRenamed("user_id", "schedule_id")
    args = F.col("override_args")
    return metadata.trigger_runs(fired, schedules(spark, sf_dir)).select(
        "schedule_id", "scope_id", args["ticker"].alias("ticker"), args["trigger_price"].alias("trigger_price"),
        args["event_type"].alias("event_type"), F.col("event_trigger_source").alias("trigger_source"), args["detected_at"].alias("detected_at"), "run_name",
    )


@query(
    "triggered_analysis",
    r"""WITH a AS (SELECT *, CASE WHEN event_type = 'purchase' THEN user_id % 4 WHEN event_type = 'click' THEN 0 ELSE 3 END AS k,
              CASE WHEN event_type = 'view' THEN 0.3 ELSE 0.1 END AS min_score FROM events WHERE "value" >= 200),
        h AS (SELECT event_id, user_id, ts, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM events JOIN documents ON doc_id = event_id),
        s AS (SELECT event_id, user_id, ts, len(list_filter(t, lambda x: x IN ('the', 'les', 'los', 'der'))) AS p,
              len(list_filter(t, lambda x: x IN ('of', 'que', 'ing'))) AS n FROM h),
        c AS (SELECT a.event_id AS id, k, s.event_id AS hid, coalesce((p - n) / nullif(p + n, 0)::DOUBLE, 0) AS score,
              row_number() OVER (PARTITION BY a.event_id ORDER BY s.ts DESC, s.event_id DESC) AS rank FROM a JOIN s ON s.user_id = a.user_id AND s.ts <= a.ts),
        m AS (SELECT id, avg(score) AS score, string_agg(hid::VARCHAR, ',' ORDER BY rank) AS context FROM c WHERE rank <= k GROUP BY 1),
        j AS (SELECT event_id AS id, event_type, user_id, min_score, coalesce(score, 0) AS score, coalesce(context, '') AS context FROM a LEFT JOIN m ON m.id = a.event_id)
        SELECT id, round(score, 6) AS score, context, CASE WHEN abs(score) < min_score OR score = 0 THEN 'Neutral' WHEN score > 0 THEN 'Bullish' ELSE 'Bearish' END AS sentiment,
        CASE WHEN abs(score) < min_score OR score = 0 THEN 'HOLD' WHEN score > 0 THEN 'STRONG BUY' ELSE 'SELL' END AS signal,
        's3a://processed-data/task_outputs/run=' || event_type || '/task=' || id || '/' AS output_path FROM j""",
)
def triggered_analysis(spark, sf_dir):
    from tideline.queries.analysis import BAD, GOOD

    rows = ticks(spark, sf_dir)
    requests = rows.filter(breakout.is_breakout(200.0)).withColumns(
        {"scope_id": F.col("user_id"), "schedule_id": F.col("ticker"), "task_id": F.col("id")}
    )
    sent = (
        F.when(F.col("ticker") == "purchase", F.create_map(F.lit("k"), (F.col("user_id") % 4).cast("string")))
        .when(F.col("ticker") == "click", F.create_map(F.lit("k"), F.lit("many")))
        .when(F.col("ticker") == "view", F.create_map(F.lit("min_score"), F.lit("0.3")))
        .otherwise(arguments.argument_map(F.lit("{}")))
    )
    stored = arguments.argument_map(F.lit('{"k": "3", "min_score": "0.1"}'))
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    headlines = rows.select("id", "ts", "user_id").join(texts, "id")
    found = deep_analysis.triggered(requests, stored, sent, headlines, ["user_id"], time_cell("ts", 86_400), GOOD, BAD)
    return found.select(
        "id", F.round("score", 6).alias("score"), F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"),
        "sentiment", "signal", F.element_at("arguments", "output_path").alias("output_path"),
    )


@query(
    "knowledge_chunks",
    """WITH d AS (SELECT sha256(concat_ws(chr(31), 'scope-1', 'sch-1', source, text)) AS document_id, text, greatest(1, CAST(ceil((length(text) - 50) / 450.0) AS BIGINT)) AS n
              FROM documents WHERE text IS NOT NULL),
        c AS (SELECT document_id, unnest(range(n)) AS chunk, text FROM d),
        p AS (SELECT document_id, chunk, substring(text, chunk * 450 + 1, 500) AS piece FROM c)
        SELECT sha256(document_id || chr(31) || chunk) AS id, document_id, chunk, sha256(piece) AS digest, round(length(piece) / 1000.0::DOUBLE, 6) AS first_value, 8 AS dim FROM p""",
)
def knowledge_chunks(spark, sf_dir):
    root = scratch_dir(spark, "chunked")
    raw = documents(spark, sf_dir).select(F.concat_ws("-", "lang", "doc_id").alias("title"), F.col("text").alias("content"), F.col("source").alias("url"))
    clean_embed.run(
        spark, raw, F.lit("documents"), "documents", "scope-1", "sch-1", f"{root}/clean", f"{root}/knowledge", ["demo"], 8, chunk_size=500, overlap=50
    )
    stored = spark.read.parquet(f"{root}/knowledge")
    return stored.select(
        "id", "document_id", F.col("chunk").cast("long").alias("chunk"), F.sha2("chunk_text", 256).alias("digest"),
        F.round(F.element_at("embedding", 1), 6).alias("first_value"), F.size("embedding").alias("dim"),
    )


@query(
    "processed_documents",
    f"""WITH s AS ({_series_sql("user_id", "1 day", 7)}),
        f AS (SELECT o_custkey AS user_id, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / nullif(count(*), 0) AS pe,
              (count(*) FILTER (o_orderstatus = 'O'))::DOUBLE / nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS de FROM orders GROUP BY 1)
        SELECT CAST(user_id AS VARCHAR) AS scope_id, 'etl-' || (user_id % 7) AS task_id, 'user-' || user_id AS ticker, strftime(window_start, '%Y-%m-%d') AS day,
        open, "close", round(rsi, 6) AS rsi, pe, de FROM s LEFT JOIN f USING (user_id)""",
)
def processed_documents(spark, sf_dir):
    path = scratch_dir(spark, "processed")
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"),
        F.count(F.lit(1)).alias("earnings"), status("F").alias("book_value"), status("O").alias("debt"), status("P").alias("equity"),
    )
    daily = candles.ohlcv(ticks(spark, sf_dir), "1 day", keys=["user_id"])
    user = F.col("user_id")
    made = processed.processed_documents(
        indicators.rsi(daily, keys=["user_id"]), indicators.price_ratios(sums), ["user_id"], user,
        F.concat(F.lit("etl-"), user % 7), F.concat(F.lit("user-"), user),
    )
    processed.save_processed(made, path)
    points = F.col("data_points")
    return processed.read_processed(spark, path).select(
        "scope_id", "task_id", "ticker", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), points["open"].alias("open"),
        points["close"].alias("close"), F.round(points["rsi"], 6).alias("rsi"),
        points["financial_ratios"]["PE"].alias("pe"), points["financial_ratios"]["DE"].alias("de"),
    )
