"""Exact dedup (8): content sort over sampled range splitters.

Rows are range-partitioned by their normalised text (Spark samples the
splitters), sorted externally within each range, and a window compares each
text with its neighbour in full; the smallest identifier of a run of equal
texts stays.  The ranges are cut by the text's first characters and, among
texts that share those, its hash: the sampled splitters that pass through the
driver are then short whatever the texts' length.

A text whose copies would overfill one range is cut into several runs: the
sort key is (text, run), where ``run`` is 0 for all but hot texts.  The hot
list holds only texts with more than ``1 / (4 P)`` of all bytes (P: shuffle
partitions), so fewer than 4 P rows are broadcast; the leaders of a hot text's
runs, fewer than 8 P rows in all, are merged in a second, small step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, partitions

#: Ranges a hot text is cut into, per shuffle partition's share of all bytes.
RUNS_PER_PARTITION = 4
#: Characters of a text that the range splitters hold.
HEAD = 64


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` and, on kept rows only, the ``carry`` columns as a struct
    ``row`` (null on dropped rows).

    Defined cases: null texts equal empty ones; null ids sort last, so a group
    keeps a null id only if it has no other; of fully repeated rows exactly one
    is kept; an empty table gives an empty result; other columns are ignored
    unless named in ``carry``."""
    spark, n_parts = df.sparkSession, partitions(df.sparkSession)
    text = F.col(text_col)
    weight = F.octet_length(F.coalesce(text, F.lit(""))) + 64
    total = df.agg(F.sum(weight).alias("w")).first()["w"] or 1
    share = max(1, total // (RUNS_PER_PARTITION * n_parts))
    hot = (df.select(F.xxhash64(normalised(text)).alias("h"), weight.alias("w"))
           .groupBy("h").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
           .where((F.col("n") > 1) & (F.col("w") > share))
           .select("h", F.ceil(F.col("w") / share).cast("int").alias("runs")))

    cols = [F.col(id_col).alias("id"), normalised(text).alias("norm")]
    if carry:
        cols.append(F.struct(*[F.col(c) for c in carry]).alias("row"))
    keyed = (df.select(*cols, F.xxhash64(normalised(text)).alias("h"))
             .join(F.broadcast(hot), "h", "left").withColumn("head", F.substring("norm", 1, HEAD))
             .withColumn("runs", F.coalesce("runs", F.lit(1)))
             .withColumn("run", F.pmod(F.xxhash64("id"), F.col("runs")).cast("int")))
    runs = Window.partitionBy("head", "h", "norm", "run")
    ordered = runs.orderBy(F.col("id").asc_nulls_last())
    first = F.col("place") == 1
    content = (keyed.repartitionByRange(n_parts, "head", "h", "run")
               .withColumn("place", F.row_number().over(ordered))
               .withColumn("run_keep", F.min("id").over(runs))
               .withColumn("run_size", F.count("*").over(runs)))
    content = cut(content.select(
        "id", "run", "runs", "run_keep", "run_size", first.alias("first"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.when(first & (F.col("runs") > 1), F.col("norm")).alias("hot_text"),
        *([F.when(first, F.col("row")).alias("row")] if carry else [])), "content")

    same = Window.partitionBy("hot_text")
    merged = (content.where(F.col("hot_text").isNotNull())
              .select("text_sha256", "run",
                      F.min("run_keep").over(same).alias("keep"),
                      F.sum("run_size").over(same).alias("size"),
                      (F.row_number().over(same.orderBy(F.col("run_keep").asc_nulls_last(), "run")) == 1)
                      .alias("top")))
    out = content.drop("hot_text").join(F.broadcast(merged), ["text_sha256", "run"], "left")
    kept = F.col("first") & F.coalesce("top", F.lit(True))
    return out.select(F.col("id").alias(id_col),
                      F.coalesce("keep", "run_keep").alias("keep_id"),
                      F.coalesce("size", "run_size").alias("group_size"),
                      kept.alias("kept"), "text_sha256",
                      *([F.when(kept, F.col("row")).alias("row")] if carry else []))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all its columns in order."""
    out = exact_dedup(df, id_col, text_col, carry=df.columns).where("kept")
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
