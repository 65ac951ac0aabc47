"""Streaming jobs run to the end of the given data, and the lake's round trips."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import breakout, catalog, metadata
from tideline.operators import candles as candle_ops
from tideline.operators.ordered import micros, time_cell
from tideline.operators.sessions import activity_sessions
from tideline.plans import clean_embed, deep_analysis, stages, watchdog
from tideline.queries.lake import document_assets
from tideline.queries.prices import _candle_sql, shown
from tideline.queries.registry import REGISTERED, query
from tideline.queries.tables import STAGE_SQL, TASKS_SQL, documents, schedules, table, tasks, ticks, tools
from tideline.session import scratch_dir
from tideline.sinks import lake
from tideline.sources import files, records
from tideline.streaming import candles, run, stateful, watch


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of ticks."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return as_ticks(stream)


BATCHES = 5


def arriving_events(spark: SparkSession, sf_dir: str, batches: int = BATCHES) -> DataFrame:
    """The events as a stream of ``batches`` files in the order of their times, one per micro-batch.

    A stream takes files by their modification times, so these are set to follow one another.
    """
    root = f"{scratch_dir(spark, 'arrivals')}/events"
    events = table(spark, sf_dir, "events")
    events.repartitionByRange(batches, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(root)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = sorted((s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    start = int(time.time() * 1000) - 60_000
    for number, path in enumerate(paths):
        system.setTimes(path, start + 1000 * number, -1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(root)
    return as_ticks(stream)


def as_ticks(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("ticker"),
        F.col("value").alias("price"), "user_id",
    )


def message_stream(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """The same ticks as message bodies; with ``broken`` those of errors are cut off."""
    stamp = F.unix_micros("ts") / F.lit(1_000_000.0)
    body = F.to_json(F.struct("id", "ticker", "price", stamp.alias("timestamp")))
    if broken:
        body = F.when(F.col("ticker") == "error", F.substring(body, 1, 12)).otherwise(body)
    return event_stream(spark, sf_dir).select(body.alias("value"))


@query(
    "stream_ohlcv",
    f"""SELECT ticker, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, open, high, low, "close", volume, n FROM ({_candle_sql(5)})
        WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_ohlcv(spark, sf_dir):
    root = scratch_dir(spark, "ohlcv")
    closed = candles.stream_ohlcv(event_stream(spark, sf_dir), "5 minutes", "10 minutes")
    run.finish(run.to_files(closed, f"{root}/out", f"{root}/checkpoint"))
    return shown(spark.read.schema(closed.schema).parquet(f"{root}/out"), "open", "high", "low", "close", "volume", "n")


@query("stream_breakout", REGISTERED["breakout_history"].sql)
def stream_breakout(spark, sf_dir):
    # The price history is Spark's state, carried over several micro-batches.
    root = scratch_dir(spark, "breakout")
    found = stateful.breakouts(arriving_events(spark, sf_dir), 200.0)
    run.finish(run.to_files(found, f"{root}/out", f"{root}/checkpoint"))
    alerts = spark.read.schema(found.schema).parquet(f"{root}/out")
    return alerts.select(
        "ticker", "id", micros("ts").alias("ts_us"), "price", "history_len",
        F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"),
    )


def _types(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(text)


TRIGGER_COLUMNS = (
    "id bigint, schedule_id bigint, scope_id bigint, run_name string, event_trigger_source string, "
    "override_args struct<ticker:string,trigger_price:double,event_type:string,detected_at:string>"
)


@query(
    "watchdog_triggers",
    """WITH subs AS (SELECT event_type, max(user_id) AS schedule_id FROM events GROUP BY 1)
        SELECT event_id AS id, schedule_id, o_custkey AS scope_id, e.event_type AS ticker, "value" AS trigger_price,
        'STREAMING_FAST_LANE_BREAKOUT_RESISTANCE' AS trigger_source,
        'dynamic_scope_' || left(o_custkey::VARCHAR, 8) || '_sch_' || left(schedule_id::VARCHAR, 8) AS run_name
        FROM events e JOIN subs USING (event_type) JOIN orders ON o_orderkey = schedule_id
        WHERE "value" >= 200 AND e.event_type <> 'error'""",
)
def watchdog_triggers(spark, sf_dir):
    root = scratch_dir(spark, "watchdog")
    watched = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("ticker")).agg(F.max("user_id").alias("schedule_id"))
    job = watchdog.watchdog(
        message_stream(spark, sf_dir, broken=True), schedules(spark, sf_dir), watched, root, time_cell("ts", 3600), 200.0
    )
    run.finish(job)
    fired = run.committed_rows(spark, root, "triggers", _types(TRIGGER_COLUMNS))
    return fired.select(
        "id", "schedule_id", "scope_id", "override_args.ticker", "override_args.trigger_price",
        F.col("event_trigger_source").alias("trigger_source"), "run_name",
    )


@query(
    "stream_dead_letters",
    """SELECT 'dead' AS kind, 12 AS length, count(*) AS n, CAST(0 AS DOUBLE) AS total FROM events WHERE event_type = 'error'
        UNION ALL SELECT 'tick', 0, count(*), sum("value"::DECIMAL(18,2))::DOUBLE FROM events WHERE event_type <> 'error'""",
)
def stream_dead_letters(spark, sf_dir):
    root = scratch_dir(spark, "letters")
    run.finish(run.each_batch(message_stream(spark, sf_dir, broken=True), watch.split_handler(root), f"{root}/checkpoint"))
    dead = run.batches_written(spark, f"{root}/dead_letters", _types("value string"))
    good = run.batches_written(spark, f"{root}/ticks", _types("id bigint, ts timestamp, ticker string, price double"))
    return dead.groupBy(F.lit("dead").alias("kind"), F.length("value").alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("total")
    ).unionAll(
        good.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("total")).select(
            F.lit("tick"), F.lit(0), "n", "total"
        )
    )


def _odd_messages(spark, sf_dir: str) -> DataFrame:
    """Ticks as the messages of a source without ids; every seventh has no usable price or time."""
    stamp = F.unix_micros("ts") / F.lit(1_000_000.0)
    body = F.to_json(F.struct("ticker", "price", stamp.alias("timestamp")))
    poison = F.element_at(
        F.array(
            F.lit('{"ticker":"x","price":1.0,"timestamp":"NaN"}'), F.lit('{"ticker":"x","price":1.0,"timestamp":1e300}'),
            F.lit('{"ticker":"x","price":"Infinity","timestamp":1.0}'), F.lit('{"ticker":"x","price":1e19,"timestamp":1.0}'),
            F.lit('{"ticker":"x","price":null,"timestamp":1.0}'), F.lit("[1"),
        ),
        (F.col("id") % 6 + 1).cast("int"),
    )
    return event_stream(spark, sf_dir).select(F.when(F.col("id") % 7 == 0, poison).otherwise(body).alias("value"))


@query(
    "stream_odd_messages",
    f"""SELECT ticker, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, open, high, low, "close", volume, n FROM (
        {_candle_sql(5).replace("FROM events", "FROM (SELECT * FROM events WHERE event_id % 7 <> 0) events")})
        UNION ALL SELECT 'dead letters', '', 0, 0, 0, 0, 0, count(*) FROM events WHERE event_id % 7 = 0""",
)
def stream_odd_messages(spark, sf_dir):
    root = scratch_dir(spark, "odd")
    run.finish(run.each_batch(_odd_messages(spark, sf_dir), watch.split_handler(root), f"{root}/checkpoint"))
    dead = run.batches_written(spark, f"{root}/dead_letters", _types("value string"))
    good = run.batches_written(spark, f"{root}/ticks", _types("id bigint, ts timestamp, ticker string, price double"))
    five = shown(candle_ops.ohlcv(good, "5 minutes"), "open", "high", "low", "close", "volume", "n")
    zeros = [F.lit(0.0).alias(c) for c in ("open", "high", "low", "close", "volume")]
    return five.unionByName(
        dead.agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead letters").alias("ticker"), F.lit("").alias("window_start"), *zeros, "n")
    )


@query("stream_dedup", 'SELECT event_id AS id, event_type AS ticker, "value" AS price FROM events')
def stream_dedup(spark, sf_dir):
    # Every tick is delivered twice.
    root = scratch_dir(spark, "dedup")
    twice = event_stream(spark, sf_dir).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    once = candles.without_duplicates(twice, "10 minutes").select("id", "ticker", "price")
    run.finish(run.to_files(once, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.schema(once.schema).parquet(f"{root}/out")


@query(
    "stream_latest",
    """SELECT event_type AS ticker, max(event_id) AS id, arg_max("value", (ts, event_id)) AS price FROM events GROUP BY 1""",
)
def stream_latest(spark, sf_dir):
    # Each micro-batch writes the tickers it changed.
    root = scratch_dir(spark, "latest")
    newest = stateful.latest(arriving_events(spark, sf_dir))
    job = run.each_batch(newest, run.changes_handler(root), f"{root}/checkpoint").outputMode("update")
    run.finish(job)
    return run.latest_changes(spark, root, ["ticker"], newest.schema).select("ticker", "id", "price")


SESSIONS_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g),
        o AS (SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events, max(ts) AS last_ts FROM s GROUP BY user_id, session)"""


@query("sessions", f"{SESSIONS_SQL} SELECT user_id, first_us, last_us, events FROM o")
def sessions(spark, sf_dir):
    found = activity_sessions(ticks(spark, sf_dir), ["user_id"], 6 * 3600)
    return found.select("user_id", micros("first_ts").alias("first_us"), micros("last_ts").alias("last_us"), "events")


@query(
    "stream_sessions",
    f"""{SESSIONS_SQL} SELECT user_id, first_us, last_us, events FROM o
        WHERE last_ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_sessions(spark, sf_dir):
    root = scratch_dir(spark, "sessions")
    closed = candles.stream_sessions(event_stream(spark, sf_dir), "user_id", "6 hours", "10 minutes")
    run.finish(run.to_files(closed, f"{root}/out", f"{root}/checkpoint"))
    found = spark.read.schema(closed.schema).parquet(f"{root}/out")
    return found.select("user_id", micros("first_ts").alias("first_us"), micros("last_ts").alias("last_us"), "events")


CROSS_SQL = f"""WITH RECURSIVE c AS (SELECT ticker, window_start, "close", row_number() OVER w AS rn, "close" - lag("close") OVER w AS d
          FROM ({_candle_sql(60)}) WHERE window_start + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
          WINDOW w AS (PARTITION BY ticker ORDER BY window_start)),
        g AS (SELECT *, avg(greatest(d, 0.0)) OVER w AS gain, avg(greatest(-d, 0.0)) OVER w AS loss FROM c
          WINDOW w AS (PARTITION BY ticker ORDER BY window_start ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
        r AS (SELECT *, CASE WHEN rn > 14 THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + gain / loss) END END AS rsi FROM g),
        e AS (SELECT ticker, window_start, rn, "close" AS f, "close" AS s, CAST(0 AS DOUBLE) AS m FROM c WHERE rn = 1
          UNION ALL SELECT c.ticker, c.window_start, c.rn, e.f + (2.0/13)::DOUBLE * (c."close" - e.f), e.s + (2.0/27)::DOUBLE * (c."close" - e.s),
            e.m + (2.0/10)::DOUBLE * ((e.f + (2.0/13)::DOUBLE * (c."close" - e.f)) - (e.s + (2.0/27)::DOUBLE * (c."close" - e.s)) - e.m)
          FROM e JOIN c ON c.ticker = e.ticker AND c.rn = e.rn + 1),
        v AS (SELECT ticker, window_start, 'RSI_30' AS indicator, 30.0::DOUBLE AS lvl, rsi AS x, rn FROM r
          UNION ALL SELECT ticker, window_start, 'RSI_70', 70.0::DOUBLE, rsi, rn FROM r
          UNION ALL SELECT ticker, window_start, 'MACD', 0.0::DOUBLE, f - s - m, rn FROM e),
        p AS (SELECT *, lag(x) OVER (PARTITION BY ticker, indicator ORDER BY rn) AS px FROM v),
        z AS (SELECT *, CASE WHEN px <= lvl AND x > lvl THEN 'UP' WHEN px >= lvl AND x < lvl THEN 'DOWN' END AS "cross" FROM p)
        SELECT ticker, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, indicator, "cross" FROM z WHERE "cross" IS NOT NULL"""


@query("stream_indicators", CROSS_SQL)
def stream_indicators(spark, sf_dir):
    root = scratch_dir(spark, "indicators")
    closed = candles.stream_ohlcv(arriving_events(spark, sf_dir), "60 minutes", "10 minutes")
    crosses = stateful.indicator_crosses(closed)
    run.finish(run.to_files(crosses, f"{root}/out", f"{root}/checkpoint"))
    found = spark.read.schema(crosses.schema).parquet(f"{root}/out")
    return shown(found, "indicator", "cross")


@query(
    "stream_republish",
    f"""SELECT ticker, n, volume, "close" FROM ({_candle_sql(60)})
        WHERE window_start + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_republish(spark, sf_dir):
    # The second job reads what the first one sent on.
    root = scratch_dir(spark, "republish")
    closed = candles.stream_ohlcv(event_stream(spark, sf_dir), "60 minutes", "10 minutes")
    run.finish(candles.republish(closed, f"{root}/topic", f"{root}/checkpoint-1"))
    again = spark.readStream.format("text").load(f"{root}/topic")
    shape = _types("ticker string, n bigint, volume double, close double")
    read = again.select(F.from_json("value", shape).alias("c")).select("c.*")
    run.finish(run.to_files(read, f"{root}/out", f"{root}/checkpoint-2"))
    return spark.read.schema(shape).parquet(f"{root}/out")


@query(
    "stream_archive",
    """SELECT event_id AS id, epoch_us(ts) AS ts_us, "value" AS price, event_type AS ticker, strftime(ts, '%Y-%m-%d') AS dt FROM events
        WHERE event_type = 'purchase'""",
)
def stream_archive(spark, sf_dir):
    root = scratch_dir(spark, "archive")
    run.finish(candles.archive(event_stream(spark, sf_dir), f"{root}/raw", f"{root}/checkpoint"))
    stored = records.read_partitioned(spark, f"{root}/raw").filter(F.col("ticker") == "purchase")
    return stored.select("id", micros("ts").alias("ts_us"), "price", "ticker", F.date_format(F.col("dt").cast("timestamp"), "yyyy-MM-dd").alias("dt"))


@query(
    "stream_archive_all",
    """SELECT event_id AS id, epoch_us(ts) AS ts_us, "value" AS price, event_type AS ticker, strftime(ts, '%Y-%m-%d') AS dt FROM events""",
)
def stream_archive_all(spark, sf_dir):
    # Every partition that the archive wrote.
    root = scratch_dir(spark, "archive")
    run.finish(candles.archive(event_stream(spark, sf_dir), f"{root}/raw", f"{root}/checkpoint"))
    stored = records.read_partitioned(spark, f"{root}/raw")
    return stored.select("id", micros("ts").alias("ts_us"), "price", "ticker", F.date_format(F.col("dt").cast("timestamp"), "yyyy-MM-dd").alias("dt"))


@query(
    "lake_roundtrip",
    """SELECT doc_id, sha256(text) AS digest, lang, CASE WHEN lang = 'en' THEN -1 ELSE n_chars END AS n_chars FROM documents""",
)
def lake_roundtrip(spark, sf_dir):
    # JSON out, JSON in with ragged columns, Parquet out by scope, one scope replaced, read back.
    root = scratch_dir(spark, "lake")
    docs = table(spark, sf_dir, "documents")
    english = docs.filter(F.col("lang") == "en")
    english.select("doc_id", "text", "lang").write.json(f"{root}/raw/en")
    docs.filter(F.col("lang") != "en").select("doc_id", "text", "lang", "n_chars").write.json(f"{root}/raw/other")
    missing = records.or_empty(spark, lambda: records.read_json(spark, f"{root}/raw/none"), _types("doc_id bigint, text string"))
    raw = records.union_ragged(
        missing, records.read_json(spark, f"{root}/raw/en", _types("doc_id bigint, text string, lang string")),
        records.read_json(spark, f"{root}/raw/other", _types("doc_id bigint, text string, lang string, n_chars bigint")),
    )
    lake.write_partitions(raw.withColumn("scope", F.col("lang")), f"{root}/clean", ["scope"])
    # A second write of one scope must leave the others alone.
    again = records.read_json(spark, f"{root}/raw/en", _types("doc_id bigint, text string, lang string"))
    lake.write_partitions(again.withColumns({"n_chars": F.lit(None).cast("bigint"), "scope": F.lit("en")}), f"{root}/clean", ["scope"])
    stored = records.read_partitioned(spark, f"{root}/clean")
    return stored.select(
        "doc_id", F.sha2("text", 256).alias("digest"), "lang", F.coalesce("n_chars", F.lit(-1)).alias("n_chars")
    )


@query(
    "etl_run",
    """SELECT 'file_assets' AS kind, count(*) AS n, 'application/parquet' AS note FROM documents WHERE text IS NOT NULL
        UNION ALL SELECT 'knowledge', count(DISTINCT sha256(concat_ws(chr(31), 'scope-1', 'sch-1', source, text))), CAST(sum(length(text)) AS VARCHAR) FROM documents
        UNION ALL SELECT 'lake', count(DISTINCT sha256(concat_ws(chr(31), 'scope-1', 'sch-1', source, text))), CAST(sum(length(text)) AS VARCHAR) FROM documents""",
)
def etl_run(spark, sf_dir):
    root = scratch_dir(spark, "etl")
    raw = table(spark, sf_dir, "documents").select(
        F.concat_ws("-", "lang", "doc_id").alias("title"), F.col("text").alias("content"), F.col("source").alias("url")
    )
    asset = clean_embed.run(spark, raw, F.lit("documents"), "documents", "scope-1", "sch-1", f"{root}/clean", f"{root}/knowledge", ["demo"])
    rows = F.get_json_object("attributes", "$.row_count").cast("long")
    found = asset.select(F.lit("file_assets").alias("kind"), rows.alias("n"), F.col("mime_type").alias("note"))
    for kind, path, column in (("lake", "clean", "content"), ("knowledge", "knowledge", "chunk_text")):
        stored = records.read_partitioned(spark, f"{root}/{path}").filter((F.col("scope") == "scope-1") & (F.col("schedule") == "sch-1"))
        found = found.unionAll(
            stored.agg(F.count_distinct("id").alias("n"), F.sum(F.length(column)).cast("string").alias("note")).select(F.lit(kind), "n", "note")
        )
    return found


@query(
    "staged_insights",
    """WITH t AS (SELECT event_type AS scope, 'sch-' || (user_id % 7) AS schedule, event_id, CAST("value" AS DOUBLE) AS price FROM events),
        a AS (SELECT scope, schedule, sum(price::DECIMAL(18,2))::DOUBLE / count(*) AS m, count(*) AS points, sha256(string_agg(price::VARCHAR, ',' ORDER BY event_id)) AS series FROM t GROUP BY ALL)
        SELECT scope, schedule, scope AS ticker, CASE WHEN m >= 50 THEN 'Bullish' ELSE 'Bearish' END AS insight_type, points, series FROM a""",
)
def staged_insights(spark, sf_dir):
    root = scratch_dir(spark, "stages")
    raw = ticks(spark, sf_dir).select(
        "id", "ticker", "price", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit("1_RAW").alias("stage"), F.col("ticker").alias("scope"),
        F.concat(F.lit("sch-"), F.col("user_id") % 7).alias("schedule"), F.lit("search").alias("task"),
    )
    documents = stages.run(spark, raw, root, F.lit("2024-02-01").cast("timestamp"), 50.0)
    chart = F.element_at("blocks", 2)["data"]
    prices = F.array_join(F.transform(chart, lambda p: p["price"].cast("string")), ",")
    found = catalog.lineage_search(documents, "4_VISUALIZE")
    return found.select(
        "scope", "schedule", "ticker", "insight_type", F.size(chart).cast("long").alias("points"), F.sha2(prices, 256).alias("series")
    )


@query(
    "schedule_json",
    f"""SELECT schedule_id, row_number() OVER (PARTITION BY schedule_id ORDER BY execution_order, task_id) - 1 AS position, task_id, task_type, tool_url AS script_url FROM (
        SELECT t.*, 's3a://tool-scripts/' || lower(p_type) || '/' || p_partkey || '.py' AS tool_url FROM ({TASKS_SQL}) t
        JOIN orders ON o_orderkey = t.schedule_id AND o_orderpriority = '1-URGENT' LEFT JOIN part ON p_partkey = t.tool_id)""",
)
def schedule_json(spark, sf_dir):
    # The export is read back as text, as the scheduler would.
    root = scratch_dir(spark, "export")
    nested = metadata.nested_schedules(metadata.cron_tasks(schedules(spark, sf_dir), tasks(spark, sf_dir), tools(spark, sf_dir)))
    lake.export_schedules(nested, f"{root}/schedules")
    shape = _types("schedule_id bigint, part bigint, tasks array<struct<task_id:bigint,task_type:string,script_url:string>>")
    read = spark.read.text(f"{root}/schedules").select(F.from_json("value", shape).alias("s")).select("s.*")
    flat = read.select("schedule_id", F.posexplode("tasks").alias("position", "t"))
    return flat.select("schedule_id", F.col("position").cast("long").alias("position"), "t.*")


@query(
    "insight_search",
    """SELECT d.doc_id, source AS scope_id, CASE WHEN quality = 1 THEN 'Bullish' ELSE 'Bearish' END AS insight_type
        FROM labels l JOIN documents d USING (doc_id) WHERE (source IN ('src2', 'src5') AND lang = 'en') OR toxic = 1
        ORDER BY n_chars DESC, doc_id LIMIT 50""",
)
def insight_search(spark, sf_dir):
    # Insight documents are appended in two runs and searched by their lineage columns.
    root = scratch_dir(spark, "insights")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    made = table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", "n_chars", F.col("source").alias("scope_id"),
        F.when(F.col("quality") == 1, "Bullish").otherwise("Bearish").alias("insight_type"),
        F.array("source").alias("scope_ids"), F.array(F.concat(F.lit("sch-"), "lang")).alias("schedule_ids"),
        F.array(F.when(F.col("toxic") == 1, "toxic").otherwise("clean")).alias("tags"), F.lit("4_VISUALIZE").alias("stage"),
    )
    for label in ("Bullish", "Bearish"):
        lake.append_insights(made.filter(F.col("insight_type") == label), f"{root}/insights")
    found = catalog.lineage_search(
        spark.read.schema(made.schema).json(f"{root}/insights"), "4_VISUALIZE", ["src2", "src5"], ["sch-en"], ["toxic"],
        newest_by=[F.desc("n_chars"), F.asc("doc_id")], limit=50,
    )
    return found.select("doc_id", "scope_id", "insight_type")


@query(
    "record_store",
    """SELECT event_type AS scope, 'task-' || (user_id % 3) AS task, count(DISTINCT body) AS assets, sum(strlen(body))::BIGINT AS bytes FROM (
        SELECT DISTINCT event_type, user_id, '{"k":' || CAST(json_extract(props, '$.k') AS INTEGER) || ',"user":' || user_id || '}' AS body FROM events) GROUP BY ALL""",
)
def record_store(spark, sf_dir):
    # Arguments as content-addressed records, saved in two overlapping parts: equal bytes are one
    # asset, the second save keeps the first's, and the catalog finds all of them again.
    root = scratch_dir(spark, "records")
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.to_json(F.struct(F.col("user_id").alias("user"), k.alias("k")))
    rows = table(spark, sf_dir, "events").select(
        body.alias("body_json"), F.col("event_type").alias("scope"), F.lit("sch").alias("schedule"),
        F.concat(F.lit("task-"), F.col("user_id") % 3).alias("task"), "event_id",
    )
    assets = None
    for part in (F.col("event_id") % 3 < 2, F.col("event_id") % 3 > 0):
        saved = lake.save_records(
            rows.filter(part), "body_json", root, "1_RAW", "scope", "schedule", "task", [], F.lit("2024-01-01").cast("timestamp")
        )
        assets = saved if assets is None else assets.unionByName(saved)
    hits = catalog.search(assets, {"extension": "json"}, stage="1_RAW", schedule_id="sch")
    found = lake.read_records(spark, root, hits)
    # The asset id is the hash of the bytes that were read back.
    sound = F.count_if(F.col("asset_id") == F.sha2("body", 256))
    return found.groupBy("scope", "task").agg(sound.alias("assets"), F.sum(F.octet_length("body").cast("long")).alias("bytes"))


@query(
    "catalog_snapshots",
    f"""WITH a AS (SELECT sha256(text) AS asset_id, source, ({STAGE_SQL}) AS stage, lang FROM documents),
        f AS (SELECT asset_id, min(source) AS source, any_value(stage) AS stage, any_value(lang) AS lang, count(DISTINCT source) AS scopes FROM a GROUP BY 1)
        SELECT 1 AS version, stage, count(*) AS assets, sum(scopes)::BIGINT AS scopes FROM f GROUP BY stage
        UNION ALL SELECT 2, stage, count(*), sum(scopes)::BIGINT FROM f WHERE stage <> '1_RAW' GROUP BY stage""",
)
def catalog_snapshots(spark, sf_dir):
    # Version 1 is the merged catalog, version 2 the same without the first stage.
    root = f"{scratch_dir(spark, 'catalog')}/file_assets"
    assets = document_assets(spark, sf_dir)
    lake.publish_snapshot(catalog.upsert(assets.limit(0), assets), root, 1, ["stage"])
    merged = lake.snapshot(spark, root, 1)
    lake.publish_snapshot(catalog.delete(merged, catalog.delete_prefix("1_RAW")), root, 2, ["stage"])
    found = None
    for version in (1, lake.latest_version(spark, root)):
        counted = lake.snapshot(spark, root, version).groupBy("stage").agg(
            F.count(F.lit(1)).alias("assets"), F.sum(F.size("scope_ids")).alias("scopes")
        ).select(F.lit(version).alias("version"), "stage", "assets", "scopes")
        found = counted if found is None else found.unionAll(counted)
    return found


@query(
    "file_inspect",
    """SELECT 'csv' AS extension, event_type AS part, count(*) AS row_count, 5 AS column_count, 'text/csv' AS mime_type FROM events GROUP BY 2
        UNION ALL SELECT 'parquet', event_type, count(*), 5, 'application/parquet' FROM events GROUP BY 2
        UNION ALL SELECT 'txt', event_type, count(*), -1, 'text/plain' FROM events GROUP BY 2""",
)
def file_inspect(spark, sf_dir):
    # The events as CSV, Parquet and text files, then measured file by file.
    root = scratch_dir(spark, "files")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.option("header", True).partitionBy("event_type").csv(f"{root}/csv")
    events.write.partitionBy("event_type").parquet(f"{root}/parquet")
    events.select("event_type", F.col("props").alias("value")).write.partitionBy("event_type").text(f"{root}/text")
    seen = files.inspect_files(files.scan_files(spark, root, "part-*"))
    custom = lambda name: F.get_json_object("attributes", f"$.custom_metadata.{name}").cast("long")
    return seen.groupBy("extension", F.regexp_extract("file_path", "event_type=([^/]+)/", 1).alias("part"), "mime_type").agg(
        F.sum(F.coalesce(custom("row_count"), custom("line_count"))).alias("row_count"),
        F.max(F.coalesce(custom("column_count"), F.lit(-1))).alias("column_count"),
    )


@query("csv_roundtrip", 'SELECT event_id, epoch_us(ts) AS ts_us, event_type, "value", props FROM events')
def csv_roundtrip(spark, sf_dir):
    root = scratch_dir(spark, "csv")
    events = table(spark, sf_dir, "events").select(
        "event_id", micros("ts").alias("ts_us"), "event_type", "value", "props"
    )
    events.write.option("header", True).option("escape", '"').csv(f"{root}/events")
    return records.read_csv(spark, f"{root}/events", events.schema)


@query(
    "deep_analysis",
    r"""WITH a AS (SELECT * FROM events WHERE "value" >= 200),
        h AS (SELECT event_id, user_id, ts, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM events JOIN documents ON doc_id = event_id),
        s AS (SELECT event_id, user_id, ts, len(list_filter(t, lambda x: x IN ('the', 'les', 'los', 'der'))) AS p,
              len(list_filter(t, lambda x: x IN ('of', 'que', 'ing'))) AS n FROM h),
        c AS (SELECT a.event_id AS id, s.event_id AS hid, coalesce((p - n) / nullif(p + n, 0)::DOUBLE, 0) AS score,
              row_number() OVER (PARTITION BY a.event_id ORDER BY s.ts DESC, s.event_id DESC) AS rank FROM a JOIN s ON s.user_id = a.user_id AND s.ts <= a.ts),
        m AS (SELECT id, avg(score) AS score, string_agg(hid::VARCHAR, ',' ORDER BY rank) AS context FROM c WHERE rank <= 3 GROUP BY 1),
        j AS (SELECT event_id AS id, "value" AS price, coalesce(score, 0) AS score, coalesce(context, '') AS context FROM a LEFT JOIN m ON m.id = a.event_id)
        SELECT id, price, round(score, 6) AS score, context, CASE WHEN score > 0 THEN 'Bullish' WHEN score < 0 THEN 'Bearish' ELSE 'Neutral' END AS sentiment,
        CASE WHEN score > 0 THEN 'STRONG BUY' WHEN score < 0 THEN 'SELL' ELSE 'HOLD' END AS signal FROM j""",
)
def deep_analysis_query(spark, sf_dir):
    from tideline.queries.analysis import BAD, GOOD

    rows = ticks(spark, sf_dir)
    alerts = rows.filter(breakout.is_breakout(200.0))
    # A document is the headline of the event with its number.
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    headlines = rows.select("id", "ts", "user_id").join(texts, "id")
    found = deep_analysis.deep_analysis(alerts, headlines, ["user_id"], time_cell("ts", 86_400), 3, GOOD, BAD)
    return found.select(
        "id", "price", F.round("score", 6).alias("score"),
        F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"), "sentiment", "signal",
    )


@query("stream_context", REGISTERED["asof_context"].sql)
def stream_context(spark, sf_dir):
    root = scratch_dir(spark, "context")
    asked = (["user_id"], time_cell("ts", 86_400), 3)
    handler = watch.context_handler(root, *asked, breakout.is_breakout(200.0), F.col("ticker").isin("view", "signup"))
    run.finish(run.each_batch(event_stream(spark, sf_dir), handler, f"{root}/checkpoint"))
    found = watch.final_context(spark, root, *asked)
    return found.select(F.col("alert.id").alias("alert_id"), F.col("headline.id").alias("headline_id"), "rank")


@query(
    "stream_interval_context",
    """WITH a AS (SELECT * FROM events WHERE "value" >= 100 AND ts <= (SELECT max(ts) FROM events) - INTERVAL 6 DAY),
        p AS (SELECT a.event_id AS alert_id, h.event_id AS headline_id, a.ts AS alert_ts, h.ts AS headline_ts
          FROM a JOIN events h ON h.user_id = a.user_id AND h.event_type IN ('view', 'signup') AND h.ts <= a.ts AND h.ts >= a.ts - INTERVAL 2 DAY),
        r AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY headline_ts DESC, headline_id DESC) AS rank FROM p)
        SELECT alert_id, headline_id, rank FROM r WHERE rank <= 3""",
)
def stream_interval_context(spark, sf_dir):
    # Two streams with watermarks meet; the alerts shown are those old enough to be answered for certain.
    root = scratch_dir(spark, "interval")
    arriving = arriving_events(spark, sf_dir, 4)
    alerts, headlines = arriving.filter(breakout.is_breakout(100.0)), arriving.filter(F.col("ticker").isin("view", "signup"))
    found = stateful.interval_context(alerts, headlines, ["user_id"], 2 * 86_400, "10 minutes", 3)
    run.finish(run.to_files(found, f"{root}/out", f"{root}/checkpoint"))
    end = table(spark, sf_dir, "events").agg(F.max(micros("ts"))).first()[0] or 0
    closed = spark.read.schema(found.schema).parquet(f"{root}/out").filter(micros("alert.ts") <= end - 6 * 86_400_000_000)
    return closed.select(F.col("alert.id").alias("alert_id"), F.col("headline.id").alias("headline_id"), "rank")


@query(
    "alert_passages",
    """WITH a AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM events JOIN embeddings ON vec_id = event_id WHERE "value" >= 200),
        s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS sim FROM embeddings, a),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id) AS rank FROM s),
        p AS (SELECT query_id, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS passages FROM r WHERE rank <= 5 GROUP BY 1)
        SELECT event_id AS id, event_type AS ticker, coalesce(passages, '') AS passages FROM events LEFT JOIN p ON query_id = event_id WHERE "value" >= 200""",
)
def alert_passages(spark, sf_dir):
    # An alert's vector is the embedding with its number, where there is one.
    alerts = ticks(spark, sf_dir).filter(breakout.is_breakout(200.0))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = alerts.select("id").join(vectors, "id").withColumnRenamed("id", "query_id")
    found = deep_analysis.with_passages(spark, alerts, vectors, asked, 5)
    return found.select("id", "ticker", F.array_join(F.transform("passages", lambda x: x.cast("string")), ",").alias("passages"))


@query(
    "alert_reports",
    """WITH t AS (SELECT event_id AS id, ts, event_type AS ticker, "value" AS price FROM events),
        e AS (SELECT *, coalesce(sum(CASE WHEN price >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts, id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM t),
        h AS (SELECT *, row_number() OVER (PARTITION BY ticker, episode ORDER BY ts DESC, id DESC) AS back,
          max(price) OVER (PARTITION BY ticker, episode) AS top FROM e),
        k AS (SELECT * FROM h WHERE back <= 100 AND top >= 200)
        SELECT arg_max(id, (ts, id)) AS id, ticker || ' Signal' AS label, 'HOLD' AS signal, count(*) AS points,
        strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_time, arg_max(price, (ts, id)) AS last_price FROM k GROUP BY ticker, episode""",
)
def alert_reports(spark, sf_dir):
    alerts = breakout.breakout_history(ticks(spark, sf_dir), time_cell("ts", 3600), threshold=200.0)
    shown = deep_analysis.report(alerts.withColumn("sentiment", F.lit("Neutral")))
    metric, chart = F.element_at("blocks", 1), F.element_at("blocks", 2)["data"]
    return shown.select(
        "id", metric["label"].alias("label"), metric["value"].alias("signal"), F.size(chart).cast("long").alias("points"),
        F.substring(F.element_at(chart, 1)["time"], 1, 19).alias("first_time"), F.element_at(chart, -1)["price"].alias("last_price"),
    )


def _sql(name: str) -> str:
    return REGISTERED[name].sql


@query(
    "alert_documents",
    f"""SELECT id, d.price, d.score, d.context, d.sentiment, d.signal, p.passages, r.label, r.points, r.first_time, r.last_price
        FROM ({_sql("deep_analysis")}) d JOIN ({_sql("alert_passages")}) p USING (id) JOIN ({_sql("alert_reports")}) r USING (id)""",
)
def alert_documents(spark, sf_dir):
    # What one triggered run works out, as one document per alert.
    from tideline.queries.analysis import BAD, GOOD

    rows = ticks(spark, sf_dir)
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    headlines = rows.select("id", "ts", "user_id").join(texts, "id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = deep_analysis.run(
        spark, rows, headlines, vectors, ["user_id"], time_cell("ts", 86_400), time_cell("ts", 3600), 200.0, 3, 5, GOOD, BAD
    )
    metric, chart = F.element_at("blocks", 1), F.element_at("blocks", 2)["data"]
    listed = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)
    return found.select(
        "id", "price", F.round("score", 6).alias("score"), listed("context"), "sentiment", metric["value"].alias("signal"), listed("passages"),
        metric["label"].alias("label"), F.size(chart).cast("long").alias("points"),
        F.substring(F.element_at(chart, 1)["time"], 1, 19).alias("first_time"), F.element_at(chart, -1)["price"].alias("last_price"),
    )
