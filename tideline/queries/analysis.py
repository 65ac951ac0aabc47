"""Cleaning, labels, dashboards, summaries, passages and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import blocks, ids, text
from tideline.operators import asof, breakout, bursts, indicators, insights, scoring, similarity, summary
from tideline.operators.ordered import time_cell
from tideline.plans import clean_embed
from tideline.queries.registry import query
from tideline.queries.tables import documents, table, ticks
from tideline.sources.records import spread


@query(
    "clean_embed",
    """SELECT sha256(concat_ws(chr(31), source, 'sch-' || lang, source, text)) AS id, lang || '-' || doc_id AS title, source AS source_reference,
        length(text) AS chars, 1536 AS dim, round(length(text) / 1000.0::DOUBLE, 6) AS first_value, '2_ETL' AS stage,
        '{' || source || '}' AS scope_text FROM documents WHERE text IS NOT NULL""",
)
def clean_embed_query(spark, sf_dir):
    raw = documents(spark, sf_dir).select(
        F.concat_ws("-", "lang", "doc_id").alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("url"),
        F.col("source").alias("scope_id"),
        F.concat(F.lit("sch-"), "lang").alias("schedule_id"),
    )
    clean = clean_embed.clean(clean_embed.harmonise(raw, F.lit("documents")), F.col("scope_id"), F.col("schedule_id"))
    return clean.select(
        "id", "title", "source_reference", F.length("chunk_text").cast("long").alias("chars"),
        F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 1), 6).alias("first_value"), "stage",
        ids.array_text(F.col("scope_ids")).alias("scope_text"),
    )


@query(
    "harmonised_ticks",
    """SELECT event_id AS id, 'Data from events' AS content, event_type AS title, CAST(epoch_us(ts) AS VARCHAR) AS published_date,
        'events' AS source_reference FROM events""",
)
def harmonised_ticks(spark, sf_dir):
    raw = ticks(spark, sf_dir).select("id", "ticker", "price", F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"))
    frame = clean_embed.harmonise(raw, F.lit("events"))
    return frame.select("id", "content", "title", "published_date", "source_reference")


@query(
    "avg_price_label",
    """WITH a AS (SELECT event_type AS ticker, CAST(sum(CAST("value" AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS m, count(*) AS row_count FROM events GROUP BY 1)
        SELECT ticker, row_count, 'success' AS status, CASE WHEN m >= 50 THEN 'Bullish' ELSE 'Bearish' END AS sentiment, round(m, 2) AS average_price,
        'rule_based_average' AS logic_used, CASE WHEN m >= 50 THEN 'STRONG BUY' ELSE 'SELL' END AS signal,
        CASE WHEN m >= 50 THEN 'green' ELSE 'red' END AS color, CASE WHEN m >= 50 THEN 'up' ELSE 'down' END AS trend FROM a""",
)
def avg_price_label(spark, sf_dir):
    result = insights.analysis(insights.average_price(ticks(spark, sf_dir), ["ticker"]), 50.0)
    label = F.col("sentiment")
    return result.select("*", blocks.signal(label).alias("signal"), blocks.color(label).alias("color"), blocks.trend(label).alias("trend"))


def _documents(spark, sf_dir, rows_per_part):
    rows = ticks(spark, sf_dir)
    analyses = insights.analysis(insights.average_price(rows, ["ticker"]), 50.0)
    points = insights.chart_points(rows, F.col("ts").cast("string"), F.col("price"))
    series = insights.chart_series(points, ["ticker"], ["ts", "id"], time_cell("ts", 86_400), rows_per_part)
    return insights.dashboard_documents(series, analyses, ["ticker"])


@query(
    "dashboard_blocks",
    """WITH a AS (SELECT event_type AS ticker, CAST(sum(CAST("value" AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS m FROM events GROUP BY 1),
        r AS (SELECT event_type AS ticker, event_id, ts, "value" AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn FROM events),
        s AS (SELECT ticker, rn // 500 AS part, count(*) AS points, sha256(string_agg(price::VARCHAR, ',' ORDER BY rn)) AS series FROM r GROUP BY ALL)
        SELECT ticker, part, b.type AS type, CASE b.type WHEN 'metric' THEN 4 ELSE 12 END AS width,
        CASE b.type WHEN 'metric' THEN ticker || ' Signal' END AS label,
        CASE b.type WHEN 'metric' THEN CASE WHEN m >= 50 THEN 'STRONG BUY' ELSE 'SELL' END END AS signal,
        CASE b.type WHEN 'chart' THEN CASE WHEN m >= 50 THEN '#10b981' ELSE '#f43f5e' END ELSE CASE WHEN m >= 50 THEN 'green' ELSE 'red' END END AS color,
        CASE b.type WHEN 'chart' THEN points ELSE -1 END AS points, CASE b.type WHEN 'chart' THEN series END AS series
        FROM s JOIN a USING (ticker), (SELECT unnest(['metric', 'chart']) AS type) b""",
)
def dashboard_blocks(spark, sf_dir):
    shown = _documents(spark, sf_dir, 500).select("ticker", "part", F.explode(blocks.layout(F.col("blocks"))).alias("b"))
    prices = F.array_join(F.transform("b.data", lambda p: p["price"].cast("string")), ",")
    return shown.select(
        "ticker", "part", F.col("b.type").alias("type"), F.col("b.colSpan").alias("width"), F.col("b.label").alias("label"),
        F.col("b.value").alias("signal"),
        F.coalesce("b.color", F.element_at("b.config.lines", 1)["color"]).alias("color"),
        F.when(F.col("b.type") == "chart", F.size("b.data")).otherwise(-1).cast("long").alias("points"),
        F.when(F.col("b.type") == "chart", F.sha2(prices, 256)).alias("series"),
    )


@query(
    "block_layout",
    """SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'metric,markdown' ELSE 'metric,chart' END ELSE CASE WHEN toxic = 1 THEN 'markdown' ELSE 'chart' END END AS types,
        CASE WHEN quality = 1 THEN '4,' ELSE '' END || '12' AS widths FROM labels""",
)
def block_layout(spark, sf_dir):
    # Unknown types stand for low quality labels; widths are missing or out of range.
    def block(kind, width):
        return F.struct(kind.alias("type"), width.cast("int").alias("colSpan"))

    given = F.array(
        block(F.when(F.col("quality") == 1, "metric").otherwise("hologram"), F.lit(4)),
        block(F.when(F.col("toxic") == 1, "markdown").otherwise("chart"), F.when(F.col("toxic") == 1, 99)),
    )
    laid = blocks.layout(given)
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.array_join(F.transform(laid, lambda b: b["type"]), ",").alias("types"),
        F.array_join(F.transform(laid, lambda b: b["colSpan"].cast("string")), ",").alias("widths"),
    )


@query(
    "table_columns",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'doc_id=Document' ELSE 'doc_id=DOC_ID,quality=QUALITY,toxic=TOXIC' END AS shown FROM labels""",
)
def table_columns(spark, sf_dir):
    rows = F.to_json(F.array(F.struct("doc_id", "quality", "toxic")))
    named = F.array(F.struct(F.lit("doc_id").alias("key"), F.lit("Document").alias("label")))
    found = blocks.table_columns(F.when(F.col("toxic") == 1, named), rows)
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.array_join(F.transform(found, lambda c: F.concat_ws("=", c["key"], c["label"])), ",").alias("shown")
    )


@query(
    "insight_cards",
    """SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN d.source ELSE 'N/A' END AS ticker, CASE WHEN quality = 1 THEN 'Bullish' ELSE 'Bearish' END AS label,
        CASE WHEN toxic = 1 THEN '25%' ELSE '75%' END AS confidence, length(CASE WHEN quality = 1 THEN d.lang || ' summary' ELSE d.text END) AS chars
        FROM labels l JOIN documents d USING (doc_id)""",
)
def insight_cards(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    ticker = F.when(F.col("lang") == "en", F.col("source")).otherwise("")
    label = F.when(F.col("quality") == 1, "Bullish").otherwise("Bearish")
    confidence = F.when(F.col("toxic") == 1, 0.25).otherwise(0.75)
    short = F.when(F.col("quality") == 1, F.concat("lang", F.lit(" summary")))
    shown = joined.select("doc_id", blocks.card(ticker, label, confidence, short, F.col("text")).alias("card"))
    return shown.select(
        "doc_id", "card.ticker", "card.label", "card.confidence", F.length("card.text").cast("long").alias("chars")
    )


@query(
    "latest_insight",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
        SELECT conv_id AS schedule_id, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS block_count,
        CASE WHEN role = 'assistant' THEN sha256(text) ELSE '' END AS shown FROM n WHERE back = 1""",
)
def latest_insight(spark, sf_dir):
    # Only assistant turns carry blocks; when the newest turn has none, nothing is shown.
    made = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("schedule_id"), "turn",
        F.when(F.col("role") == "assistant", F.array(F.struct(F.lit("markdown").alias("type"), "text"))).alias("blocks"),
    )
    last = insights.newest_blocks(made, ["turn"])
    return last.select(
        "schedule_id", F.size("blocks").alias("block_count"),
        F.coalesce(F.sha2(F.try_element_at("blocks", F.lit(1))["text"], 256), F.lit("")).alias("shown"),
    )


@query(
    "ratios",
    """SELECT o_custkey AS scope_id, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / nullif(count(*), 0) AS pe,
        sum(o_totalprice::DECIMAL(18,2))::DOUBLE / nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS pbv,
        (count(*) FILTER (o_orderstatus = 'O'))::DOUBLE / nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS de FROM orders GROUP BY 1""",
)
def ratios(spark, sf_dir):
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("scope_id")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"),
        F.count(F.lit(1)).alias("earnings"), status("F").alias("book_value"),
        status("O").alias("debt"), status("P").alias("equity"),
    )
    return indicators.price_ratios(sums).select("scope_id", "pe", "pbv", "de")


@query(
    "summary",
    """SELECT coalesce(lang, '(all)') AS lang, coalesce(source, '(all)') AS source, count(*) AS documents, sum(n_chars)::BIGINT AS chars,
        round(avg(n_chars), 4) AS mean_chars, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS good
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)""",
)
def summary_query(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    measures = {
        "documents": F.count(F.lit(1)),
        "chars": F.sum("n_chars"),
        "mean_chars": F.round(F.avg("n_chars"), 4),
        "good": F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)),
    }
    totals = summary.summary(rows, ["lang", "source"], measures, totals=True)
    return totals.withColumns({c: F.coalesce(c, F.lit("(all)")) for c in ("lang", "source")})


@query(
    "audit_summary",
    """SELECT event_type AS task_type, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'VALIDATED' END AS status, count(*) AS runs,
        round(sum("value"::DECIMAL(18,2))::DOUBLE, 2) AS total_ms, max("value") AS longest_ms FROM events GROUP BY 1, 2""",
)
def audit_summary(spark, sf_dir):
    logs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("task_type"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("VALIDATED").alias("status"),
        F.col("value").alias("execution_time_ms"),
    )
    measures = {
        "runs": F.count(F.lit(1)),
        "total_ms": F.round(F.sum(F.col("execution_time_ms").cast("decimal(18,2)")).cast("double"), 2),
        "longest_ms": F.max("execution_time_ms"),
    }
    return summary.summary(logs, ["task_type", "status"], measures)


@query(
    "trending_terms",
    r"""WITH t AS (SELECT source AS day, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
        c AS (SELECT day, term, count(*) AS n FROM t WHERE length(term) >= 4 GROUP BY ALL)
        SELECT day, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 10""",
)
def trending_terms(spark, sf_dir):
    # Documents have no date; each source stands for one day's collection.
    return summary.trending_terms(documents(spark, sf_dir).withColumnRenamed("source", "day"), "day", "text", 10)


@query(
    "term_bursts",
    """WITH c AS (SELECT CAST(ts AS DATE) AS day, props AS term, count(*) AS n FROM events WHERE props IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
        t AS (SELECT day, sum(n) AS total FROM c GROUP BY day),
        w AS (SELECT d.day, d.total, sum(pow(0.8::DOUBLE, d.day - p.day - 1)) AS weights FROM t d JOIN t p ON p.day BETWEEN d.day - 14 AND d.day - 1 GROUP BY ALL),
        s AS (SELECT c.day, c.term, c.n, w.total, w.weights, coalesce(sum(pow(0.8::DOUBLE, c.day - p.day - 1) * p.n / pt.total), 0) AS weighed
            FROM c JOIN w USING (day) LEFT JOIN (c p JOIN t pt ON pt.day = p.day) ON p.term = c.term AND p.day BETWEEN c.day - 14 AND c.day - 1 GROUP BY ALL),
        e AS (SELECT day, term, n, greatest(weighed / weights * total, 0.5::DOUBLE) AS expected FROM s),
        r AS (SELECT *, round(n * ln(n / expected) - (n - expected), 6) AS score FROM e WHERE n > expected),
        k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, term) AS rank FROM r)
        SELECT strftime(day, '%Y-%m-%d') AS day, term, n, round(expected, 6) AS expected, score, rank FROM k WHERE rank <= 10""",
)
def term_bursts(spark, sf_dir):
    # The properties of an event play its term.
    counts = bursts.daily_counts(table(spark, sf_dir, "events"), F.col("ts"), F.array("props"))
    found = bursts.bursts(counts, 10)
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("expected", F.round("expected", 6))


@query(
    "chunks",
    """WITH d AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 50) / 450.0) AS BIGINT)) AS n FROM documents WHERE length(text) > 0),
        c AS (SELECT doc_id, text, unnest(range(n)) AS part FROM d)
        SELECT doc_id, part, length(substring(text, part * 450 + 1, 500)) AS chars, sha256(substring(text, part * 450 + 1, 500)) AS digest FROM c""",
)
def chunks(spark, sf_dir):
    pieces = documents(spark, sf_dir).select("doc_id", F.posexplode(text.chunks("text", 500, 50)).alias("part", "chunk"))
    return pieces.select(
        "doc_id", F.col("part").cast("long").alias("part"), F.length("chunk").cast("long").alias("chars"), F.sha2("chunk", 256).alias("digest")
    )


@query(
    "html_clean",
    r"""SELECT page_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
        '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""",
)
def html_clean(spark, sf_dir):
    cleaned = spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", text.clean_html("html").alias("t"))
    return cleaned.select("page_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


@query(
    "extract_events",
    """WITH e AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS date, 'order of status ' || o_orderstatus || ' booked' AS event FROM orders
        UNION ALL SELECT o_custkey, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d'), 'payment due' FROM orders)
        SELECT left(date, 7) AS month, event, count(*) AS n, count(DISTINCT o_custkey) AS scopes FROM e GROUP BY ALL""",
)
def extract_events(spark, sf_dir):
    due = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd")
    note = F.concat(
        F.lit("Customer file. "), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"),
        F.lit(": order of status "), "o_orderstatus", F.lit(" booked. Terms apply. "), due, F.lit(" payment due."),
    )
    found = table(spark, sf_dir, "orders").withColumn("note", note).select("o_custkey", F.explode(text.dated_events("note")).alias("e"))
    return found.groupBy(F.substring("e.date", 1, 7).alias("month"), "e.event").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("scopes")
    )


@query(
    "similar_topk",
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        m AS (SELECT label, pos, avg(e[pos]) AS x FROM v, (SELECT unnest(range(1, 65)) AS pos) GROUP BY ALL),
        q AS (SELECT label AS query_id, list(x ORDER BY pos) AS c FROM m GROUP BY 1),
        s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(e, c) AS sim FROM v, q),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
        SELECT query_id, id, rank, round(sim, 6) AS similarity FROM r WHERE rank <= 10""",
)
def similar_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    passages = vectors.select(F.col("vec_id").alias("id"), "embedding")
    found = similarity.similar_topk(spark, passages, similarity.centroids(vectors, "label"), 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "asof_context",
    """WITH a AS (SELECT * FROM events WHERE "value" >= 200), h AS (SELECT * FROM events WHERE event_type IN ('view', 'signup')),
        p AS (SELECT a.event_id AS alert_id, h.event_id AS headline_id, row_number() OVER (PARTITION BY a.event_id ORDER BY h.ts DESC, h.event_id DESC) AS rank
              FROM a JOIN h ON h.user_id = a.user_id AND h.ts <= a.ts)
        SELECT alert_id, headline_id, rank FROM p WHERE rank <= 3""",
)
def asof_context(spark, sf_dir):
    rows = ticks(spark, sf_dir)
    alerts = rows.filter(breakout.is_breakout(200.0))
    headlines = rows.filter(F.col("ticker").isin("view", "signup")).select("id", "ts", "user_id")
    found = asof.latest_before(alerts, headlines, ["user_id"], time_cell("ts", 86_400), 3)
    return found.select(F.col("alert.id").alias("alert_id"), F.col("headline.id").alias("headline_id"), "rank")


@query(
    "anomalies",
    """WITH s AS (SELECT event_type, avg("value") AS m, stddev_pop("value") AS d FROM events GROUP BY 1)
        SELECT event_id AS id, round((e."value" - m) / d, 4) AS z FROM events e JOIN s USING (event_type) WHERE abs((e."value" - m) / d) > 3""",
)
def anomalies(spark, sf_dir):
    return scoring.anomalies(ticks(spark, sf_dir), ["ticker"], "price").select("id", F.round("z", 4).alias("z"))


GOOD, BAD = ("the", "les", "los", "der"), ("of", "que", "ing")


@query(
    "lexicon_sentiment",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
        c AS (SELECT doc_id, len(list_filter(t, lambda x: x IN ('the', 'les', 'los', 'der'))) AS p, len(list_filter(t, lambda x: x IN ('of', 'que', 'ing'))) AS n FROM w)
        SELECT doc_id, coalesce(round((p - n) / nullif(p + n, 0)::DOUBLE, 6), 0) AS score,
        CASE WHEN p > n THEN 'Bullish' WHEN p < n THEN 'Bearish' ELSE 'Neutral' END AS label FROM c""",
)
def lexicon_sentiment(spark, sf_dir):
    scored = documents(spark, sf_dir).select("doc_id", scoring.lexicon_score("text", GOOD, BAD).alias("s"))
    return scored.select("doc_id", F.round("s", 6).alias("score"), scoring.lexicon_label(F.col("s")).alias("label"))


@query(
    "url_parts",
    """SELECT page_id, split_part(url, '/', 3) AS bucket, substring(url, length(split_part(url, '://', 1)) + 5 + length(split_part(url, '/', 3))) AS key FROM pages""",
)
def url_parts(spark, sf_dir):
    stored = table(spark, sf_dir, "pages").withColumn("uri", F.regexp_replace("url", "^https?://", "s3a://"))
    return stored.select("page_id", ids.uri_bucket("uri").alias("bucket"), ids.uri_key("uri").alias("key"))


@query(
    "video_id",
    """WITH v AS (SELECT page_id, left(md5(url), CASE WHEN url LIKE 'https%' THEN 11 ELSE 9 END) AS vid FROM pages)
        SELECT page_id, CASE WHEN length(vid) = 11 THEN vid END AS video FROM v""",
)
def video_id(spark, sf_dir):
    # Links are made from the page url; plain http pages get an id of a wrong length.
    length = F.when(F.col("url").startswith("https"), 11).otherwise(9)
    made = table(spark, sf_dir, "pages").withColumn(
        "link", F.concat(F.lit("https://www.youtube.com/watch?v="), F.substr(F.md5("url"), F.lit(1), length), F.lit("&t=10"))
    )
    return made.select("page_id", ids.video_id("link").alias("video"))


@query(
    "canonical_json",
    """SELECT event_id, sha256('{"id":' || event_id || ',"kind":"' || event_type || '","nested":{"k":' || CAST(json_extract(props, '$.k') AS INTEGER) || ',"user":' || user_id || '}}') AS asset_id FROM events""",
)
def canonical_json(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    written = F.to_json(
        F.struct(F.struct(F.col("user_id").alias("user"), k.alias("k")).alias("nested"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"))
    )
    stored = events.select("event_id", written.alias("written"))
    return stored.select("event_id", ids.content_hash(ids.canonical_json(F.col("written"))).alias("asset_id"))


@query(
    "user_scores",
    """SELECT doc_id, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS score FROM documents""",
)
def user_scores(spark, sf_dir):
    # The model is any function over batches of texts; this one counts blanks.
    return scoring.score_text(documents(spark, sf_dir), lambda texts: texts.str.count(" ").astype("float64"), "text").select(
        "doc_id", "score"
    )


@query(
    "series_model",
    """WITH d AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS day, "value" AS price, ts, event_id FROM events)
        SELECT ticker, strftime(day, '%Y-%m-%d') AS day, count(*) AS n, max(price) - min(price) AS spread, arg_max(price, (ts, event_id)) AS forecast FROM d GROUP BY ALL""",
)
def series_model(spark, sf_dir):
    # The model gets one ticker and day at a time; this one forecasts the last price.
    rows = ticks(spark, sf_dir).select("id", "ts", "ticker", "price")
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    modelled = scoring.apply_to_series(rows, _last_price, "ticker string, day string, n long, spread double, forecast double", ["ticker"], day)
    return modelled.select("ticker", "day", "n", "spread", "forecast")


def _last_price(pdf):
    pdf = pdf.sort_values(["ts", "id"])
    return pdf.iloc[[-1]][["ticker", "block"]].set_axis(["ticker", "day"], axis=1).assign(
        n=len(pdf), spread=pdf["price"].max() - pdf["price"].min(), forecast=pdf["price"].iloc[-1]
    )
