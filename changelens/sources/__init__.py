"""Sources (S1-S4): validated Parquet scans of the two change tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, IntegralType, StringType, StructField,
                               StructType)

# Reference input schemas (FIXTURES.md §1).
LINE_SCHEMA = StructType([
    StructField("commit", StringType()), StructField("repo", StringType()),
    StructField("filepath", StringType()), StructField("content", BinaryType()),
])
JIT_SCHEMA = StructType([
    StructField("commit", StringType()), StructField("repo", StringType()),
    StructField("filepath", StringType()), StructField("content", BinaryType()),
    StructField("lines", ArrayType(IntegerType())), StructField("datetime", StringType()),
    StructField("methods", ArrayType(StringType())),
])

SPLITS = ("train", "test", "val")


class MissingInputError(FileNotFoundError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # lists the path, reads one footer
        return True
    except Exception as e:  # AnalysisException PATH_NOT_FOUND
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return False
        raise


def require_inputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """S3: check every input and name all the missing ones at once."""
    missing = [f"{k}: {p}" for k, p in paths.items() if not _exists(spark, p)]
    if missing:
        raise MissingInputError("missing inputs: " + "; ".join(missing))


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Raise with the list of absent required columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def check_schema(df: DataFrame, schema: StructType, optional: tuple = ()) -> None:
    """Raise with every column that is absent or of another type.  Text may
    come as bytes or strings, times as strings or timestamps, and whole numbers
    in any width."""
    require_columns(df, [f.name for f in schema.fields if f.name not in optional])

    def kind(t) -> str:
        if isinstance(t, ArrayType):
            return f"array<{kind(t.elementType)}>"
        return {"binary": "text", "string": "text", "timestamp": "text", "timestamp_ntz": "text"}.get(
            t.typeName(), "whole" if isinstance(t, IntegralType) else t.typeName())
    wrong = [f"{f.name}: {df.schema[f.name].dataType.simpleString()}, expected {f.dataType.simpleString()}"
             for f in schema.fields if f.name in df.columns and kind(df.schema[f.name].dataType) != kind(f.dataType)]
    if wrong:
        raise ValueError("wrong column types: " + "; ".join(wrong))


def read_table(spark: SparkSession, path: str, schema: StructType | None = None,
               optional: tuple = ("methods",)) -> DataFrame:
    """Parquet scan; with a schema, its columns and types are checked."""
    df = spark.read.parquet(path)
    if schema is not None:
        check_schema(df, schema, optional)
    return df


def read_changes(spark: SparkSession, base: str, kind: str, splits: tuple = SPLITS) -> dict[str, DataFrame]:
    """Load the splits of ``kind`` ('line' or 'jit') from ``base``:
    ``{base}/{kind}_{split}.parquet`` (any codec; gzip is read from the footer)."""
    schema = LINE_SCHEMA if kind == "line" else JIT_SCHEMA
    paths = {s: f"{base.rstrip('/')}/{kind}_{s}.parquet" for s in splits}
    require_inputs(spark, paths)
    return {s: read_table(spark, p, schema) for s, p in paths.items()}
