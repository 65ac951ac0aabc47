"""Task arguments held as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.ids import BUCKET


def parsed_object(text: Column | str) -> Column:
    """JSON text as VARIANT; an empty object for null, empty or malformed text."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def argument_map(text: Column | str) -> Column:
    """A JSON object's entries as text; empty for null or malformed input."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.expr("map()").cast("map<string,string>"))


def _without(entries: Column, other: Column) -> Column:
    names = F.map_keys(other)
    return F.map_filter(entries, lambda k, _: ~F.array_contains(names, k))


def effective_arguments(scope_id: Column, schedule_id: Column, task_id: Column, stored: Column, overrides: Column) -> Column:
    """Ids as defaults, then the stored arguments, then the runtime overrides; later wins."""
    defaults = F.create_map(
        F.lit("scope_id"), scope_id.cast("string"),
        F.lit("schedule_id"), schedule_id.cast("string"),
        F.lit("task_id"), task_id.cast("string"),
    )
    given = F.struct(defaults.alias("defaults"), stored.alias("stored"), overrides.alias("overrides"))

    def merge(maps: Column) -> Column:
        base = F.map_concat(_without(maps["defaults"], maps["stored"]), maps["stored"])
        return F.map_concat(_without(base, maps["overrides"]), maps["overrides"])

    # Bound by a lambda, so that each map is built once and not for every key looked up.
    return F.element_at(F.transform(F.array(given), merge), 1)


def with_output_path(arguments: Column, run_id: Column, task_id: Column) -> Column:
    """Arguments with the run's own output folder, unless they name one."""
    path = F.concat(F.lit(f"s3a://{BUCKET}/task_outputs/run="), run_id, F.lit("/task="), task_id, F.lit("/"))
    named = F.map_contains_key(arguments, "output_path")
    return F.when(named, arguments).otherwise(F.map_concat(arguments, F.create_map(F.lit("output_path"), path)))


def sorted_text(entries: Column) -> Column:
    """``k=v`` pairs in key order."""
    pairs = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.array_join(pairs, ",")
