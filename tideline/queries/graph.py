"""Schedules, tasks, tools and arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import arguments, ids
from tideline.operators import breakout, metadata
from tideline.queries.registry import query
from tideline.queries.tables import SCHEDULES_SQL, TASKS_SQL, TOOLS_SQL, schedules, table, tasks, ticks, tools


@query(
    "schedule_export",
    f"""SELECT s.schedule_id, s.scope_id, s.cron_expression AS cron, count(t.task_id) AS task_count, count(t.depends_on_task_id) AS dependent_count,
        coalesce(string_agg(t.task_id || ':' || t.task_type || ':' || coalesce(l.script_url, ''), ',' ORDER BY t.execution_order, t.task_id), '') AS task_list
        FROM ({SCHEDULES_SQL}) s LEFT JOIN ({TASKS_SQL}) t USING (schedule_id) LEFT JOIN ({TOOLS_SQL}) l USING (tool_id)
        WHERE execution_type = 'CRON' AND cron_expression IS NOT NULL GROUP BY ALL""",
)
def schedule_export(spark, sf_dir):
    joined = metadata.cron_tasks(
        schedules(spark, sf_dir), tasks(spark, sf_dir), tools(spark, sf_dir)
    )
    nested = metadata.nested_schedules(joined)
    label = lambda t: F.concat(
        t["task_id"].cast("string"), F.lit(":"), t["task_type"], F.lit(":"), F.coalesce(t["script_url"], F.lit(""))
    )
    return nested.select(
        "schedule_id", "scope_id", "cron",
        F.size("tasks").cast("long").alias("task_count"),
        F.size(F.filter("tasks", lambda t: t["depends_on_task_id"].isNotNull())).cast("long").alias("dependent_count"),
        F.array_join(F.transform("tasks", label), ",").alias("task_list"),
    )


@query(
    "task_edges",
    f"""WITH t AS ({TASKS_SQL}) SELECT c.schedule_id, c.depends_on_task_id AS source, c.task_id AS target
        FROM t c JOIN t p ON p.schedule_id = c.schedule_id AND p.task_id = c.depends_on_task_id""",
)
def task_edges(spark, sf_dir):
    return metadata.task_edges(tasks(spark, sf_dir)).select("schedule_id", "source", "target")


@query(
    "tool_compat",
    f"""WITH t AS ({TASKS_SQL}), l AS ({TOOLS_SQL}),
        p AS (SELECT DISTINCT a.tool_id AS source_tool_id, b.tool_id AS target_tool_id FROM t b JOIN t a
              ON a.schedule_id = b.schedule_id AND a.task_id = b.depends_on_task_id)
        SELECT source_tool_id, target_tool_id, s.file_type IS NOT DISTINCT FROM g.expected_file_type AS valid,
        CASE WHEN s.file_type IS DISTINCT FROM g.expected_file_type THEN 'File type mismatch: Output is ' || coalesce(s.file_type, 'None')
          || ' but Input expects ' || coalesce(g.expected_file_type, 'None') END AS reason
        FROM p JOIN l s ON s.tool_id = source_tool_id JOIN l g ON g.tool_id = target_tool_id""",
)
def tool_compat(spark, sf_dir):
    steps = tasks(spark, sf_dir).select("schedule_id", "task_id", "tool_id", "depends_on_task_id")
    sources = steps.select("schedule_id", F.col("task_id").alias("depends_on_task_id"), F.col("tool_id").alias("source_tool_id"))
    pairs = (
        steps.select("schedule_id", "depends_on_task_id", F.col("tool_id").alias("target_tool_id"))
        .join(sources, ["schedule_id", "depends_on_task_id"])
        .select("source_tool_id", "target_tool_id")
        .distinct()
    )
    checked = metadata.connection_valid(pairs, tools(spark, sf_dir))
    return checked.select("source_tool_id", "target_tool_id", "valid", "reason")


CASCADE_SQL = f"""WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
    bad AS (SELECT p_partkey FROM part WHERE p_type = 'PROMO'),
    s AS (SELECT * FROM ({SCHEDULES_SQL}) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE c_custkey = scope_id)),
    t AS (SELECT * FROM ({TASKS_SQL}) x WHERE EXISTS (SELECT 1 FROM s WHERE s.schedule_id = x.schedule_id)
          AND NOT EXISTS (SELECT 1 FROM bad WHERE p_partkey = x.tool_id))"""


@query(
    "cascade_delete",
    f"""{CASCADE_SQL} SELECT t.task_id, t.schedule_id, t.tool_id, coalesce(p.task_id, -1) AS depends_on_task_id
        FROM t LEFT JOIN t p ON p.task_id = t.depends_on_task_id""",
)
def cascade_delete(spark, sf_dir):
    left = _cascade(spark, sf_dir)
    parent = F.coalesce("depends_on_task_id", F.lit(-1)).alias("depends_on_task_id")
    return left["tasks"].select("task_id", "schedule_id", "tool_id", parent)


@query(
    "cascade_counts",
    f"""{CASCADE_SQL} SELECT 'scopes' AS entity, (SELECT count(*) FROM customer) - (SELECT count(*) FROM gone) AS n
        UNION ALL SELECT 'schedules', (SELECT count(*) FROM s) UNION ALL SELECT 'tasks', (SELECT count(*) FROM t)
        UNION ALL SELECT 'tools', (SELECT count(*) FROM part) - (SELECT count(*) FROM bad)""",
)
def cascade_counts(spark, sf_dir):
    counted = None
    for name, frame in _cascade(spark, sf_dir).items():
        row = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
        counted = row if counted is None else counted.unionAll(row)
    return counted


def _cascade(spark, sf_dir):
    scopes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope_id"), "c_mktsegment")
    parts = table(spark, sf_dir, "part")
    gone = scopes.filter(F.col("c_mktsegment") == "BUILDING").select("scope_id")
    bad = parts.filter(F.col("p_type") == "PROMO").select(F.col("p_partkey").alias("tool_id"))
    return metadata.cascade_delete(
        scopes, schedules(spark, sf_dir), tasks(spark, sf_dir), tools(spark, sf_dir), gone_scopes=gone, gone_tools=bad
    )


@query(
    "task_listing",
    f"""SELECT task_id, task_type, coalesce(tool_id, -1) AS tool_id, execution_order, coalesce(depends_on_task_id, -1) AS depends_on_task_id FROM ({TASKS_SQL})
        WHERE schedule_id = (SELECT max(schedule_id) FROM ({TASKS_SQL}))""",
)
def task_listing(spark, sf_dir):
    every = tasks(spark, sf_dir)
    wanted = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    shown = every.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("tool_id", "depends_on_task_id")})
    return metadata.listing(
        shown, ["task_id", "task_type", "tool_id", "execution_order", "depends_on_task_id"],
        [F.col("execution_order").asc_nulls_last(), "task_id"], F.col("schedule_id") == wanted,
    )


@query(
    "effective_args",
    """SELECT event_id AS task_id, 'k=' || CAST(json_extract(props, '$.k') AS INTEGER)::VARCHAR || ',schedule_id=' || event_type ||
        ',scope_id=' || user_id || ',task_id=' || event_id || ',ticker=' || event_type || ',trigger_price=' || "value" AS args FROM events""",
)
def effective_args(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stored = F.map_concat(arguments.argument_map("props"), F.create_map(F.lit("ticker"), F.lit("stored")))
    overrides = F.create_map(F.lit("ticker"), "event_type", F.lit("trigger_price"), F.col("value").cast("string"))
    merged = arguments.effective_arguments(F.col("user_id"), F.col("event_type"), F.col("event_id"), stored, overrides)
    return events.select(F.col("event_id").alias("task_id"), arguments.sorted_text(merged).alias("args"))


@query(
    "parsed_args",
    """SELECT event_id AS task_id, coalesce(CAST(TRY_CAST(CASE WHEN event_type = 'error' THEN left(props, 3) ELSE props END AS JSON) ->> '$.k' AS INTEGER), -1) AS k,
        TRY_CAST(CASE WHEN event_type = 'error' THEN left(props, 3) ELSE props END AS JSON) IS NULL AS defaulted FROM events""",
)
def parsed_args(spark, sf_dir):
    # Error events stand for broken arguments: their text is cut off.
    stored = F.when(F.col("event_type") == "error", F.substring("props", 1, 3)).otherwise(F.col("props"))
    parsed = arguments.parsed_object(stored)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("task_id"),
        F.coalesce(F.try_variant_get(parsed, "$.k", "int"), F.lit(-1)).alias("k"),
        (F.to_json(parsed) == "{}").alias("defaulted"),
    )


@query(
    "run_names",
    f"""SELECT schedule_id, 'dynamic_scope_' || left(md5(CAST(scope_id AS VARCHAR)), 8) || '_sch_' || left(md5(CAST(schedule_id AS VARCHAR)), 8) AS run_name,
        lower(execution_type) || '_' || left(md5(CAST(schedule_id AS VARCHAR)), 8) AS task_name FROM ({SCHEDULES_SQL})""",
)
def run_names(spark, sf_dir):
    scope = F.md5(F.col("scope_id").cast("string"))
    schedule = F.md5(F.col("schedule_id").cast("string"))
    return schedules(spark, sf_dir).select(
        "schedule_id",
        ids.run_name(scope, schedule).alias("run_name"),
        ids.task_name(F.col("execution_type"), schedule).alias("task_name"),
    )


@query(
    "trigger_requests",
    f"""SELECT e.event_id AS trigger_id, s.schedule_id, s.scope_id, e.event_type AS ticker, e."value" AS trigger_price,
        'STREAMING_FAST_LANE_BREAKOUT_RESISTANCE' AS trigger_source, strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%f') AS detected_at,
        'dynamic_scope_' || left(CAST(s.scope_id AS VARCHAR), 8) || '_sch_' || left(CAST(s.schedule_id AS VARCHAR), 8) AS run_name
        FROM events e JOIN ({SCHEDULES_SQL}) s ON s.schedule_id = e.user_id WHERE e."value" >= 200""",
)
def trigger_requests(spark, sf_dir):
    hits = ticks(spark, sf_dir).filter(breakout.is_breakout(200.0))
    fired = breakout.alert_payload(hits).withColumnRenamed("user_id", "schedule_id")
    runs = metadata.trigger_runs(fired, schedules(spark, sf_dir))
    return runs.select(
        F.col("id").alias("trigger_id"), "schedule_id", "scope_id", F.col("override_args.ticker").alias("ticker"),
        F.col("override_args.trigger_price").alias("trigger_price"), F.col("event_trigger_source").alias("trigger_source"),
        F.col("override_args.detected_at").alias("detected_at"), "run_name",
    )


@query(
    "scope_listing",
    """SELECT c_custkey AS scope_id, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status,
        count(o_orderkey) AS schedules FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
)
def scope_listing(spark, sf_dir):
    counts = schedules(spark, sf_dir).groupBy("scope_id").agg(F.count(F.lit(1)).alias("schedules"))
    scopes = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("scope_id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, "PAUSED").otherwise("ACTIVE").alias("status"),
    )
    joined = scopes.join(counts, "scope_id", "left").withColumn("schedules", F.coalesce("schedules", F.lit(0)))
    return metadata.listing(joined, ["scope_id", "name", "status", "schedules"], ["name", "scope_id"])


@query(
    "enum_check",
    """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'CRON' WHEN '2-HIGH' THEN 'CONTINUOUS' WHEN '3-MEDIUM' THEN 'ONCE' ELSE o_orderpriority END AS execution_type,
        o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS valid, count(*) AS n FROM orders GROUP BY ALL""",
)
def enum_check(spark, sf_dir):
    known = F.when(F.col("o_orderpriority") == "1-URGENT", "CRON").when(F.col("o_orderpriority") == "2-HIGH", "CONTINUOUS")
    kind = known.when(F.col("o_orderpriority") == "3-MEDIUM", "ONCE").otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(kind.alias("execution_type"))
    checked = rows.withColumn("valid", metadata.allowed("execution_type", "execution_type"))
    return checked.groupBy("execution_type", "valid").agg(F.count(F.lit(1)).alias("n"))
