"""Models that the library fits itself: forecasts, a text classifier and a vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import candles, forecast, naive_bayes, vector_index
from tideline.queries.prices import _candle_sql
from tideline.queries.registry import query
from tideline.queries.tables import documents, table, ticks
from tideline.session import scratch_dir


@query(
    "price_forecast",
    f"""WITH c AS (SELECT ticker, "close" AS y, row_number() OVER w AS rn, lag("close") OVER w AS x1, lag("close", 2) OVER w AS x2,
            count(*) OVER (PARTITION BY ticker) AS n FROM ({_candle_sql(60)}) WINDOW w AS (PARTITION BY ticker ORDER BY window_start)),
        f AS (SELECT *, rn <= floor(n * 0.8) AS fitted FROM c),
        s AS (SELECT ticker, count(*) AS n_fitted, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22,
            covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM f WHERE fitted AND x2 IS NOT NULL GROUP BY ticker),
        b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
        m AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM b)
        SELECT ticker, any_value(n_fitted) AS n_fitted, round(any_value(b0), 6) AS intercept, round(any_value(b1), 6) AS weight_1, round(any_value(b2), 6) AS weight_2,
            count(*) FILTER (NOT fitted) AS n_tested, round(sqrt(avg((y - b0 - b1 * x1 - b2 * x2) ^ 2) FILTER (NOT fitted)), 6) AS model_error,
            round(sqrt(avg((y - x1) ^ 2) FILTER (NOT fitted)), 6) AS last_price_error,
            round(any_value(b0) + any_value(b1) * arg_max(y, rn) + any_value(b2) * arg_max(x1, rn), 6) AS next
        FROM f JOIN m USING (ticker) GROUP BY ticker""",
)
def price_forecast(spark, sf_dir):
    found = forecast.forecast(candles.ohlcv(ticks(spark, sf_dir), "60 minutes"), 2)
    return found.select(
        "ticker", "n_fitted", F.round("intercept", 6).alias("intercept"), F.round(F.get("weights", F.lit(0)), 6).alias("weight_1"),
        F.round(F.get("weights", F.lit(1)), 6).alias("weight_2"), "n_tested", F.round("model_error", 6).alias("model_error"),
        F.round("last_price_error", 6).alias("last_price_error"), F.round("next", 6).alias("next"),
    )


@query(
    "text_classifier",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
        l AS (SELECT doc_id, toxic FROM labels WHERE doc_id % 5 <> 0),
        c AS (SELECT term, count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0 FROM w JOIN l USING (doc_id) GROUP BY term),
        f AS (SELECT sum(n1) AS t1, sum(n0) AS t0, count(*) AS kinds FROM c),
        p AS (SELECT ln(count(*) FILTER (toxic = 1) / count(*) FILTER (toxic = 0)) AS prior FROM l JOIN documents USING (doc_id)),
        m AS (SELECT term, ln((n1 + 1) / (t1 + kinds)) - ln((n0 + 1) / (t0 + kinds)) AS weight FROM c, f),
        s AS (SELECT doc_id, sum(weight) AS total FROM w JOIN m USING (term) GROUP BY doc_id),
        r AS (SELECT doc_id, coalesce(total, 0) + prior AS score FROM documents LEFT JOIN s USING (doc_id), p)
        SELECT doc_id, round(score, 6) AS score, CASE WHEN score > 0 THEN 1 ELSE 0 END::INTEGER AS label FROM r""",
)
def text_classifier(spark, sf_dir):
    # Trained on four of five labelled documents, applied to all.
    docs = documents(spark, sf_dir).select("doc_id", "text")
    known = table(spark, sf_dir, "labels").filter(F.col("doc_id") % 5 != 0).select("doc_id", "toxic")
    model = naive_bayes.fit(docs.join(known, "doc_id"), "text", "toxic")
    found = naive_bayes.score(docs, model, "doc_id", "text")
    return found.select("doc_id", F.round("score", 6).alias("score"), "label")


@query(
    "similar_index",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS sim FROM v, v AS q WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
        SELECT query_id, id, rank, round(sim, 6) AS similarity FROM r WHERE rank <= 10""",
)
def similar_index(spark, sf_dir):
    # The index over all rows is written, then asked for the rows whose id is divisible by 20.
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    path = scratch_dir(spark, "index")
    n_lists = min(4096, max(1, round(rows.count() ** 0.5)))
    vector_index.write_index(rows, path, vector_index.train(rows, n_lists, rounds=4))
    queries = rows.filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "embedding")
    found = vector_index.search(spark, path, queries, 10, probes=max(1, n_lists // 8), exact=True)
    return found.withColumn("similarity", F.round("similarity", 6))
