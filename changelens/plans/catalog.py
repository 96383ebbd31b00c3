"""Registry of named queries: a Spark builder plus, where the result is
expressible in SQL, the DuckDB oracle text over the same Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rows: str  # inventory rows of SURVEY §2 this query covers


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, rows: str = ""):
    def deco(fn):
        REGISTRY[name] = Entry(name, fn, sql, rows)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> dict[str, Entry]:
    # importing the modules fills REGISTRY
    from . import q_text, q_reports, q_eval, q_sampling, q_ml  # noqa: F401
    return REGISTRY
