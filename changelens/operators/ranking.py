"""Distributed ordered prefix sums and exact ranks.

A running total over an ordering (ROC/PR curves, exact quantiles, exact
samples) is usually written as a window without a partition, which pulls
every row into one task.  Here the ordering is cut into ``n_buckets``
ranges by approximate quantiles (a bounded list of split points), each
range is summed in parallel, the small table of range totals gives each
range its offset, and one window per (group, range) finishes the job.
The result is exact; the quantiles only balance the work.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


#: Rows a range should hold; the number of ranges follows the row count.
ROWS_PER_BUCKET = 250_000


def range_buckets(df: DataFrame, order_col: str, n_buckets: int | None = None) -> DataFrame:
    """Add ``__bucket``: a balanced range id monotone in ``order_col``.  By
    default there is a range for every ``ROWS_PER_BUCKET`` rows."""
    if n_buckets is None:
        n_buckets = max(1, -(-df.count() // ROWS_PER_BUCKET))
    qs = []
    if n_buckets > 1:
        fracs = [i / n_buckets for i in range(1, n_buckets)]
        row = df.agg(F.percentile_approx(F.col(order_col).cast("double"), fracs, max(10_000, 10 * n_buckets))
                     .alias("q")).first()
        qs = sorted(set(v for v in (row["q"] or []) if v is not None))
    splits = [float("-inf")] + qs + [float("inf")]
    if len(splits) < 3:
        return df.withColumn(BUCKET, F.lit(0.0))
    b = Bucketizer(splits=splits, inputCol="__bx", outputCol=BUCKET, handleInvalid="keep")
    return b.transform(df.withColumn("__bx", F.col(order_col).cast("double"))).drop("__bx")


def prefix_sums(df: DataFrame, group_cols: list[str], order_col: str, value_cols: list[str],
                descending: bool = True, n_buckets: int | None = None,
                suffix: str = "_cum") -> DataFrame:
    """Running totals of ``value_cols`` within each group in ``order_col``
    order (inclusive of the current row).  ``df`` should have one row per
    (group, order value) - aggregate ties first - so the order is total."""
    d = range_buckets(df, order_col, n_buckets)
    bucket_order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    totals = d.groupBy(*group_cols, BUCKET).agg(*[F.sum(v).alias(v + "__t") for v in value_cols])
    w_off = (Window.partitionBy(*group_cols).orderBy(bucket_order)
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*group_cols, BUCKET, *[
        F.coalesce(F.sum(v + "__t").over(w_off), F.lit(0)).alias(v + "__o") for v in value_cols])
    # groups x n_buckets rows; AQE turns this into a broadcast when it is small
    d = d.join(offsets, [*group_cols, BUCKET], "left")
    oc = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w_in = (Window.partitionBy(*group_cols, BUCKET).orderBy(oc)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for v in value_cols:
        d = d.withColumn(v + suffix, F.sum(v).over(w_in) + F.col(v + "__o"))
    return d.drop(*[v + "__o" for v in value_cols], BUCKET)


def ordered_rank(df: DataFrame, group_cols: list[str], order_col: str, tie_cols: list[str],
                 out: str = "rank") -> DataFrame:
    """0-based place of each row within its group in ``order_col`` order, with
    no group in one task: rows are counted per range, then numbered within."""
    d = range_buckets(df, order_col)
    counts = d.groupBy(*group_cols, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group_cols).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group_cols, BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*group_cols, BUCKET).orderBy(order_col, *tie_cols)
    return (d.join(offsets, [*group_cols, BUCKET])
            .withColumn(out, (F.col("__off") + F.row_number().over(inside) - 1).cast("long")).drop("__off", BUCKET))
