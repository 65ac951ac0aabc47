"""Lineage columns: stamping, searching and matching rows by them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.ids import literal_array
from tideline.schemas import STAGES


def check_stage(stage: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    return stage


def stamp(df: DataFrame, stage: str, scope_id: str, schedule_id: str, tags: Sequence[str] = (), task_id: str | None = None) -> DataFrame:
    columns = {
        "scope_ids": literal_array([scope_id]),
        "schedule_ids": literal_array([schedule_id]),
        "tags": literal_array(tags),
        "stage": F.lit(check_stage(stage)),
    }
    if task_id is not None:
        columns["task_ids"] = literal_array([task_id])
    return df.withColumns(columns)


def overlaps(column: str, wanted: Sequence[str]) -> Column:
    """True if the arrays share an element; false where the column is null or has none."""
    return F.coalesce(F.arrays_overlap(F.col(column), literal_array(wanted)), F.lit(False))


def lineage_match(
    stage: str, scope_ids: Sequence[str] = (), schedule_ids: Sequence[str] = (), tags: Sequence[str] = ()
) -> Column:
    """``stage AND ((scopes AND schedules) OR tags)``; an empty list drops its term."""
    both = None
    for column, wanted in (("scope_ids", scope_ids), ("schedule_ids", schedule_ids)):
        if wanted:
            term = overlaps(column, wanted)
            both = term if both is None else both & term
    any_of = both
    if tags:
        term = overlaps("tags", tags)
        any_of = term if any_of is None else any_of | term
    match = F.col("stage") == stage
    return match if any_of is None else match & any_of


def catalog_match(
    stage: str | None = None, scope_id: str | None = None, schedule_id: str | None = None, task_id: str | None = None
) -> Column:
    """Stage equality and membership of each given id; true when nothing is given."""
    match = F.lit(True)
    if stage:
        match = match & (F.col("stage") == stage)
    for column, wanted in (("scope_ids", scope_id), ("schedule_ids", schedule_id), ("task_ids", task_id)):
        if wanted:
            match = match & F.coalesce(F.array_contains(F.col(column), wanted), F.lit(False))
    return match


def metadata_match(attributes: str, expected: Mapping[str, Any]) -> Column:
    """Every expected key is present and equal, by value and by kind.

    Keys are looked up in ``custom_metadata`` first, then at the top. Whole and fractional
    numbers are one kind; text, booleans, null and nested values are others.
    """

    def equals_all(parsed: Column) -> Column:
        match = parsed.isNotNull()
        for key, value in expected.items():
            match = match & _entry_equals(parsed, key, value)
        return match

    # The lambda binds the parsed text, so it is parsed once per row however many keys.
    return F.coalesce(F.exists(F.array(F.try_parse_json(attributes)), equals_all), F.lit(False))


def _entry_equals(parsed: Column, key: str, value: Any) -> Column:
    entry = F.coalesce(_member(parsed, "$.custom_metadata", key), _member(parsed, "$", key))
    kind = F.schema_of_variant(entry)
    if value is None:
        return F.is_variant_null(entry)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(entry, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
        same = F.try_variant_get(entry, "$", "double") == float(value)
        if float(value).is_integer() and abs(value) < 1e38:
            # A large id would lose digits as a double; as a whole number it is compared exactly.
            same = same & (F.try_variant_get(entry, "$", "decimal(38,0)") == F.lit(str(int(value))).cast("decimal(38,0)"))
        return number & F.coalesce(same, F.lit(False))
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(entry, "$", "string") == value)
    return F.to_json(entry) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _member(parsed: Column, path: str, key: str) -> Column:
    """A member of the object at a path. Keys that no path can quote go through a map."""
    if "'" not in key:
        return F.try_variant_get(parsed, f"{path}['{key}']", "variant")
    members = F.try_variant_get(parsed, path, "map<string,variant>")
    return F.try_element_at(members, F.lit(key))


def name_contains(column: str, part: str) -> Column:
    """Substring match that ignores case."""
    return F.contains(F.lower(column), F.lower(F.lit(part)))
