"""The registered queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import ann, chat, clustering, decontamination, licenses, packing, periodic, quality, rules, simhash, toxicity, wavelet, word_bpe
from tideline.llm.common import table
from tideline.queries.registry import Build, Registered
from tideline.session import scratch_dir

REGISTERED: dict[str, Registered] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        REGISTERED[name] = Registered(name, build, sql)
        return build

    return keep


def conversations_and_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold what a template must escape."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return rows.unionByName(probe)


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, lag(role) OVER w AS before,
    length(replace(replace(replace(replace(text, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn'), '<next', '\lnext')) AS n_text,
    length(replace(replace(replace(replace(replace(role, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn'), '<next', '\lnext'), '>', '\g')) AS n_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + CASE WHEN role = before THEN 6 ELSE n_role + 16 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""


@query("op1_chat_format", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(conversations_and_probe(spark, sf_dir)))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_hilbert_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query("op5_simhash_components")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LICENSE_SQL = f"""
WITH templates AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(licenses.TEMPLATES))}) v(template, license, text)
), known AS (
  SELECT template, license, len(b) AS size, unnest(b) AS bigram FROM (
    SELECT template, license, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM (
      SELECT template, license, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
      FROM templates))
), lines AS (
  SELECT doc_id, row_number() OVER () AS unit, line FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
    UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10)))
), words AS (
  SELECT doc_id, unit, list_filter(string_split(regexp_replace(
    lower(line), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM lines
), made AS (
  SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM words WHERE len(w) > 1
), shared AS (
  SELECT doc_id, unit, template, license, 2.0 * count(*) / (n + size) AS dice
  FROM (SELECT doc_id, unit, len(b) AS n, unnest(b) AS bigram FROM made) JOIN known USING (bigram)
  GROUP BY doc_id, unit, template, license, n, size
), best AS (
  SELECT doc_id, unit, arg_max({{'license': license, 'dice': dice}}, {{'d': dice, 't': -template}}) AS s
  FROM shared WHERE dice >= {licenses.THRESHOLD} GROUP BY doc_id, unit
)
SELECT doc_id, s.license AS license, count(*)::BIGINT AS n_units, max(s.dice)::DOUBLE AS best_dice FROM best GROUP BY 1, 2
"""


@query("op6_license_scan", LICENSE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op6_license_passages")
def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_passages(table(spark, sf_dir, "documents"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_wavelet_tokens")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "shards")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.documents_of(wavelet.read_shards(spark, path))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_word_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_sql(table_name: str) -> str:
    return f"regexp_extract_all(translate(coalesce({table_name}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ITEM_WORD}')"


DECONTAMINATION_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_words_sql("documents")} AS w FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_words_sql("benchmark")} AS w FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item, n, unnest([array_to_string(w[i : i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS win
  FROM (SELECT item, w, least({decontamination.WINDOW}, len(w)) AS n FROM items WHERE len(w) > 0)
), found AS MATERIALIZED (
  SELECT r, s, n, win FROM (
    SELECT r, n, unnest(range(1, len(w) - n + 2)) AS s, unnest([array_to_string(w[i : i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS win
    FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
  ) SEMI JOIN windows USING (n, win)
), hit AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM found) GROUP BY r
), named AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM found JOIN windows USING (n, win)) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@query("op11_decontamination", DECONTAMINATION_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def _clustering_sql(rounds: int) -> str:
    """Every round as two tables: the vectors' clusters, then the centroids moved."""
    size, scale = clustering.SIZE, clustering.SCALE

    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT r, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS distance FROM (
    SELECT r, c, sum((x - m) * (x - m)) AS d FROM v JOIN c{i} USING (dim) GROUP BY r, c) GROUP BY r)"""

    steps = []
    for i in range(rounds):
        steps += [assigned(i), f"""c{i + 1} AS MATERIALIZED (
  SELECT c, dim, coalesce(f, m) AS m FROM c{i} LEFT JOIN (
    SELECT c, dim, floor(sum(x) / count(*))::BIGINT AS f FROM v JOIN a{i} USING (r) GROUP BY c, dim) USING (c, dim))"""]
    steps.append(assigned(rounds))
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {size}
), v AS MATERIALIZED (SELECT r, unnest(range({size})) AS dim, unnest(w) AS x FROM e
), c0 AS MATERIALIZED (SELECT c, unnest(range({size})) AS dim, unnest(w) AS m FROM (
  SELECT row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || coalesce(vec_id::VARCHAR, '')), w) - 1 AS c, w FROM e) WHERE c < {clustering.K}
), {", ".join(steps)}, digests AS (
  SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN digests USING (c)
"""


@query("op12_centroid_clusters", _clustering_sql(clustering.ROUNDS))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(periodic.with_repeats(table(spark, sf_dir, "documents")))
