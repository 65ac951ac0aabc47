"""Registered queries: a Spark build function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    build: Build
    sql: str | None


REGISTERED: dict[str, Registered] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        if name in REGISTERED:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Event times are stored without a zone and are all UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf_dir)

        REGISTERED[name] = Registered(name, run, sql)
        return build

    return keep
