"""Workload registry and small shared helpers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUND = 6


@dataclass
class Workload:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Workload] = {}


def workload(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL."""
    def deco(fn):
        REGISTRY[name] = Workload(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r(c: str | Column, name: str | None = None) -> Column:
    """Round a double for order-insensitive hashing against the oracle."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), ROUND)
    return out.alias(name or (c if isinstance(c, str) else "value"))


# Train/test role used by the fit-on-train / apply-to-test workloads: every
# fifth id is a test row.  Both roles are processed and returned.
def is_test(id_col: str) -> Column:
    return (F.col(id_col) % 5) == 4

