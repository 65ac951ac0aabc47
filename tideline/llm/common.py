"""What the operators of this folder share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import scratch_dir

# A word, wherever an operator speaks of words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text column, a null being an empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_fold(key: str, mod: int) -> Column:
    """crc32 of the key written as text, modulo ``mod``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % mod


class Recent:
    """A cache of two generations: when the young one is full the old one goes.

    What is used again moves to the young one, so frequent keys stay.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def worker_object(name: str, make: Callable[[], Any]) -> Any:
    """An object made once per Python worker and kept for its later tasks.

    Functions of this package travel by value, so their module globals do not outlive a task.
    """
    holder = sys.modules.setdefault("_tideline_worker", types.ModuleType("_tideline_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)
