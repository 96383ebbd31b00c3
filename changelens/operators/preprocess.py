"""Feature preprocessing.

Statistics are computed with one aggregate pass each and kept as small
fitted state (a few numbers per column); transforms are plain column
expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

MISSING = "missing"
MAX_CATEGORIES = 10_000


def _is_float(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (DoubleType, FloatType))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULLs (and NaNs for floating columns) per column, one pass,
    returned long: (column, n_null)."""
    cols = cols or df.columns
    exprs = []
    for c in cols:
        miss = F.col(c).isNull() | F.isnan(c) if _is_float(df, c) else F.col(c).isNull()
        exprs.append(F.sum(miss.cast("long")).alias(c))
    row = df.agg(*exprs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null")) for c in cols])
    return row.select(F.explode(pairs).alias("x")).select("x.column", F.coalesce("x.n_null", F.lit(0)).alias("n_null"))


def constant_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A column is constant when its non-NULL values are all equal and
    there is at least one (all-NULL is not constant).  Exact: one pass of
    min/max/count, no approximate distinct counts."""
    cols = cols or [f.name for f in df.schema.fields
                    if isinstance(f.dataType, NumericType) or f.dataType.typeName() in ("string", "boolean", "date", "timestamp", "timestamp_ntz")]
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"), F.count(c).alias(f"{c}__n")]
    row = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"),
                               ((F.col(f"{c}__n") > 0) & (F.col(f"{c}__min") == F.col(f"{c}__max"))).alias("is_constant"))
                      for c in cols])
    return row.select(F.explode(pairs).alias("x")).select("x.column", F.coalesce("x.is_constant", F.lit(False)).alias("is_constant"))


def constant_column_names(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    return [r[0] for r in constant_columns(df, cols).where("is_constant").collect()]


@dataclass
class NumericPrep:
    """F1-F3 fitted state: mean imputation, population scaling, and the
    zero-variance filter, for a list of numeric columns."""
    cols: list[str]
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)
    kept: list[str] = field(default_factory=list)

    @staticmethod
    def fit(df: DataFrame, cols: list[str]) -> "NumericPrep":
        aggs = []
        for c in cols:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"{c}__m"), F.stddev_pop(x).alias(f"{c}__s")]
        row = df.agg(*aggs).first().asDict()
        means = {c: row[f"{c}__m"] for c in cols}
        stds = {c: row[f"{c}__s"] for c in cols}
        # imputed values sit at the mean, so the variance after imputation is
        # the variance of the observed values scaled; zero stays zero
        kept = [c for c in cols if stds[c] is not None and stds[c] > 0.0]
        return NumericPrep(cols, means, stds, kept)

    def impute(self, c: str) -> Column:
        m = self.means[c]
        return F.coalesce(F.col(c).cast("double"), F.lit(m if m is not None else 0.0))

    def scale(self, c: str) -> Column:
        s = self.stds[c]
        s = 1.0 if not s else s                       # zero variance: divide by 1
        return (self.impute(c) - F.lit(self.means[c] or 0.0)) / F.lit(s)

    def transform_columns(self, drop_constant: bool = True) -> list[Column]:
        cols = self.kept if drop_constant else self.cols
        return [self.scale(c).alias(c) for c in cols]


def impute_mean(df: DataFrame, cols: list[str], suffix: str = "_imputed") -> DataFrame:
    """F1 via Spark ML's Imputer (mean strategy)."""
    from pyspark.ml.feature import Imputer
    outs = [c + suffix for c in cols]
    d = df
    for c in cols:
        d = d.withColumn(c, F.col(c).cast("double"))
    return Imputer(strategy="mean", inputCols=cols, outputCols=outs).fit(d).transform(d)


def variances(df: DataFrame, cols: list[str]) -> DataFrame:
    """F3 scores: population variance per column (long form)."""
    row = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("variance")) for c in cols])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def variance_threshold(df: DataFrame, cols: list[str], threshold: float = 0.0) -> DataFrame:
    """keep features whose variance exceeds the threshold."""
    return variances(df, cols).withColumn("kept", F.col("variance") > F.lit(threshold))


def melt(df: DataFrame, id_cols: list[str], cols: list[str], var: str = "feature", val: str = "value") -> DataFrame:
    return df.select(*id_cols, F.explode(F.array(*[
        F.struct(F.lit(c).alias(var), F.col(c).cast("double").alias(val)) for c in cols])).alias("__m")).select(
        *id_cols, f"__m.{var}", f"__m.{val}")


def anova_f(long: DataFrame, label: str = "label", feature: str = "feature", value: str = "value") -> DataFrame:
    """one-way ANOVA F per feature (the univariate selector's score).

    Input is long (feature, label, value); per (feature, class) sums are a
    partial aggregate, so the shuffle carries classes x features rows.  A
    class without values does not count; one class gives a NULL score."""
    per = long.where(F.col(value).isNotNull()).groupBy(feature, label).agg(
        F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    tot = per.groupBy(feature).agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("S"), F.sum("ss").alias("SS"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"))
    sq_all = F.col("S") * F.col("S")
    sstot = F.col("SS") - sq_all / F.col("N")
    ssbn = F.col("B") - sq_all / F.col("N")
    sswn = sstot - ssbn
    msb = F.try_divide(ssbn, F.col("k") - 1)
    msw = F.try_divide(sswn, F.col("N") - F.col("k"))
    return tot.select(feature, F.try_divide(msb, msw).alias("f_score"))


def one_hot_fit(df: DataFrame, col: str) -> list[str]:
    """F5/F6 categories: NULL -> 'missing', sorted.  A column with more than
    ``MAX_CATEGORIES`` values is refused, so the list is bounded."""
    vals = (df.select(F.coalesce(F.col(col).cast("string"), F.lit(MISSING)).alias("v")).distinct()
            .limit(MAX_CATEGORIES + 1).collect())
    if len(vals) > MAX_CATEGORIES:
        raise ValueError(f"{col} has over {MAX_CATEGORIES} categories; it is no one-hot column")
    return sorted(r[0] for r in vals)


def one_hot_index(col: str, categories: list[str]) -> Column:
    """Position of the value among the fitted categories; NULL for unseen
    values (their one-hot vector is all zeros)."""
    m = F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(i))])
    return m[F.coalesce(F.col(col).cast("string"), F.lit(MISSING))]


def one_hot_vector(col: str, categories: list[str]) -> Column:
    """the one-hot vector; an unseen value gives all zeros."""
    at = one_hot_index(col, categories)
    return F.transform(F.sequence(F.lit(0), F.lit(len(categories) - 1)),
                       lambda i: F.coalesce((i == at).cast("double"), F.lit(0.0)))
