"""Scopes, schedules, tasks and tools: joins, nesting, edges and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.ids import run_name
from tideline.operators.ordered import floor_div, number_rows
from tideline.schemas import ALLOWED


def cron_tasks(schedules: DataFrame, tasks: DataFrame, tools: DataFrame) -> DataFrame:
    """Cron schedules with their tasks and tools, one row per task.

    A schedule without tasks keeps one row with a null task; a task without a tool keeps
    its row too. The left join is written as inner join plus anti join: AQE can split a
    schedule with very many tasks in an inner join, but not on the right of a left join.
    """
    cron = schedules.filter((F.col("execution_type") == "CRON") & F.col("cron_expression").isNotNull()).select(
        "schedule_id", "scope_id", "cron_expression"
    )
    with_tasks = tasks.join(cron, "schedule_id").join(tools, "tool_id", "left")
    without = cron.join(tasks.select("schedule_id").distinct(), "schedule_id", "left_anti")
    return with_tasks.unionByName(without, allowMissingColumns=True)


def nested_schedules(joined: DataFrame, tasks_per_part: int = 10_000) -> DataFrame:
    """Each schedule with its ordered tasks as an array, empty when it has none.

    Tasks without an order come last. ``part`` is 0 but for schedules with more than
    ``tasks_per_part`` tasks, which continue in further rows.
    """
    late = F.col("execution_order").isNull()
    name = F.col("task_id").cast("string")
    rows = joined.withColumns({"__late": late, "__name": name})
    cell = F.struct(
        F.col("__late").alias("late"),
        floor_div(F.col("execution_order").cast("long"), 1000).alias("span"),
        F.when(F.col("__late"), F.substring("__name", 1, 3)).alias("head"),
    )
    numbered = number_rows(rows, ["schedule_id"], ["__late", "execution_order", "__name"], cell)
    task = F.struct(
        "rn", "task_id", "task_type", "depends_on_task_id", "script_url", "input_schema", "output_schema"
    )
    ordered = F.array_sort(F.collect_list(F.when(F.col("task_id").isNotNull(), task)))
    return (
        numbered.withColumn("part", floor_div(F.col("rn") - 1, tasks_per_part))
        .groupBy("schedule_id", "part")
        .agg(
            F.first("scope_id").alias("scope_id"),
            F.first("cron_expression").alias("cron"),
            F.transform(ordered, lambda t: t.dropFields("rn")).alias("tasks"),
        )
    )


def task_edges(tasks: DataFrame) -> DataFrame:
    """Parent and child of each dependency inside one schedule; dangling parents are dropped."""
    child = tasks.select("schedule_id", F.col("depends_on_task_id").alias("source"), F.col("task_id").alias("target"))
    parent = tasks.select("schedule_id", F.col("task_id").alias("source"))
    return child.join(parent, ["schedule_id", "source"])


# The reason given for a mismatch, and how it names an absent type.
MISMATCH = "File type mismatch: Output is %s but Input expects %s"
ABSENT_TYPE = "None"


def connection_valid(pairs: DataFrame, tools: DataFrame, strict: bool = False) -> DataFrame:
    """Whether each source tool's output type is the target tool's expected input type.

    Two absent types match unless ``strict``. Pairs naming an unknown tool are dropped.
    """
    out = tools.select(F.col("tool_id").alias("source_tool_id"), F.get_json_object("output_schema", "$.file_type").alias("file_type"))
    into = tools.select(
        F.col("tool_id").alias("target_tool_id"),
        F.get_json_object("input_schema", "$.expected_file_type").alias("expected_file_type"),
    )
    joined = pairs.join(out, "source_tool_id").join(into, "target_tool_id")
    valid = F.col("file_type").eqNullSafe(F.col("expected_file_type"))
    if strict:
        valid = valid & F.col("file_type").isNotNull()
    none = F.lit(ABSENT_TYPE)
    reason = F.format_string(MISMATCH, F.coalesce("file_type", none), F.coalesce("expected_file_type", none))
    return joined.withColumn("valid", valid).withColumn("reason", F.when(~F.col("valid"), reason))


def trigger_runs(triggers: DataFrame, schedules: DataFrame) -> DataFrame:
    """Run requests: the triggered schedule's scope, the run's name and its settings.

    ``schedules`` may be static while ``triggers`` streams. Unknown schedules give no run.
    """
    known = schedules.select("schedule_id", "scope_id")
    return triggers.join(known, "schedule_id").withColumn("run_name", run_name(F.col("scope_id"), F.col("schedule_id")))


def cascade_delete(
    scopes: DataFrame,
    schedules: DataFrame,
    tasks: DataFrame,
    tools: DataFrame,
    gone_scopes: DataFrame | None = None,
    gone_schedules: DataFrame | None = None,
    gone_tools: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """What is left of the four tables after removing scopes, schedules or tools.

    Schedules go with their scope, tasks with their schedule or tool; a task whose parent
    went keeps its row with a null parent.
    """
    if gone_scopes is not None:
        scopes = scopes.join(gone_scopes, "scope_id", "left_anti")
        schedules = schedules.join(gone_scopes, "scope_id", "left_anti")
    if gone_schedules is not None:
        schedules = schedules.join(gone_schedules, "schedule_id", "left_anti")
    tasks = tasks.join(schedules.select("schedule_id"), "schedule_id", "left_semi")
    if gone_tools is not None:
        tools = tools.join(gone_tools, "tool_id", "left_anti")
        tasks = tasks.join(gone_tools, "tool_id", "left_anti")
    parents = tasks.select(F.col("task_id").alias("depends_on_task_id"), F.lit(True).alias("__alive"))
    order = tasks.columns
    tasks = (
        tasks.join(parents, "depends_on_task_id", "left")
        .withColumn("depends_on_task_id", F.when(F.col("__alive"), F.col("depends_on_task_id")))
        .select(*order)
    )
    return {"scopes": scopes, "schedules": schedules, "tasks": tasks, "tools": tools}


def allowed(column: str, kind: str) -> Column:
    """True where an enumerated column holds one of its values; null is allowed."""
    return F.col(column).isNull() | F.col(column).isin(*ALLOWED[kind])


def listing(df: DataFrame, columns: list[str], order: list, where=None) -> DataFrame:
    """Filtered, ordered projection: the one form all metadata listings share."""
    rows = df if where is None else df.filter(where)
    return rows.orderBy(*order).select(*columns)
