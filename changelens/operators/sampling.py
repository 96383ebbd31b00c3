"""Exact, reproducible sampling (R1-R6, U1, L4 folds).

Rows are ordered by ``md5(seed | key)``, the same in Spark and any SQL
engine.  The rank of a row within its class is computed without putting a
class into one task: rows are first counted per (class, md5 prefix), the
small count table gives each prefix its offset, and the final row_number
runs per (class, prefix) - about N / 16^prefix_len rows each.

A sample of the first n rows of a class needs no full ranking: the prefix
counts say which prefixes lie wholly inside, and only the one prefix per
class that holds the cut is ranked.  Rows of equal keys are ordered by a hash
of their other columns, so samples are the same in every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def md5_key(key_cols: list[str], seed: int = SEED, salt: str | None = None):
    parts = [F.lit(str(seed))] + ([F.lit(salt)] if salt else []) + [F.col(c).cast("string") for c in key_cols]
    return F.md5(F.concat_ws("|", *parts))


def _tie(df: DataFrame, key_cols: list[str]):
    """Hash of the columns beyond the key, to order rows of equal keys."""
    rest = [F.col(f.name) for f in df.schema.fields
            if f.name not in key_cols and f.dataType.typeName() not in ("map", "udt", "variant")
            and not f.name.startswith("__")]
    return F.xxhash64(*rest) if rest else F.lit(0)


def _prefix_offsets(d: DataFrame, g: list[str]) -> DataFrame:
    """(class..., prefix, count, rows before the prefix in its class)."""
    counts = d.groupBy(*g, "__pre").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*g).orderBy("__pre").rowsBetween(Window.unboundedPreceding, -1)
    # at most 16^prefix_len rows per class here, so this window is bounded
    return counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))


def exact_rank(df: DataFrame, key_cols: list[str], partition_cols: list[str] | None = None,
               seed: int = SEED, prefix_len: int = 4, out: str = "rank") -> DataFrame:
    """0-based rank of each row by md5 key within ``partition_cols`` (NULL is
    a class of its own)."""
    g = list(partition_cols or [])
    d = df.withColumn("__h", md5_key(key_cols, seed)).withColumn("__pre", F.substring("__h", 1, prefix_len))
    offsets = _prefix_offsets(d, g).select(*[F.col(c).alias(f"__g_{c}") for c in g],
                                           F.col("__pre").alias("__opre"), "__off")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in g],
                  F.col("__pre") == F.col("__opre"))
    d = d.join(offsets, same, "inner").drop("__opre", *[f"__g_{c}" for c in g])
    w2 = Window.partitionBy(*g, "__pre").orderBy("__h", *key_cols, _tie(df, key_cols))
    return d.withColumn(out, (F.col("__off") + F.row_number().over(w2) - 1).cast("long")).drop(
        "__h", "__pre", "__off")


def first_ranked(df: DataFrame, sizes: dict, key_cols: list[str], label: str | None = None,
                 seed: int = SEED, prefix_len: int = 4) -> DataFrame:
    """The ``sizes[c]`` rows of each class c with the smallest md5 keys (one
    class, ``sizes[None]``, without ``label``).  Whole prefixes pass a filter;
    only the prefix at the cut is shuffled and ranked."""
    g = [label] if label else []
    d = df.withColumn("__h", md5_key(key_cols, seed)).withColumn("__pre", F.substring("__h", 1, prefix_len))
    offsets = _prefix_offsets(d.select(*g, "__pre"), g)
    whole, left = F.lit(False), F.lit(0)
    for c, n in sizes.items():
        mine = F.col(label).eqNullSafe(F.lit(c)) if label else F.lit(True)
        # the prefix that holds the last row taken: one row per class comes back
        at = offsets.where(mine & (F.col("__off") < n)).orderBy(F.col("__off").desc()).first() if n > 0 else None
        if at is None:
            continue
        whole = whole | (mine & (F.col("__pre") < at["__pre"]))
        left = F.when(mine & (F.col("__pre") == at["__pre"]), F.lit(n - at["__off"])).otherwise(left)
    w = Window.partitionBy(*g, "__pre").orderBy("__h", *key_cols, _tie(df, key_cols))
    edge = (d.withColumn("__left", left).where(F.col("__left") > 0)
            .withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= F.col("__left")))
    return d.where(whole).select(*df.columns).unionByName(edge.select(*df.columns))


def class_counts(df: DataFrame, label: str = "label") -> dict:
    """Per-class row counts (a handful of numbers) for size arithmetic."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def sample_exact(df: DataFrame, sizes: dict, key_cols: list[str], label: str = "label",
                 seed: int = SEED) -> DataFrame:
    """Exactly ``sizes[c]`` rows of class c, without replacement."""
    return first_ranked(df, sizes, key_cols, label, seed)


def draw_index(i_col, n_rows, seed: int = SEED, salt: str = "draw"):
    """Deterministic index in [0, n_rows) for draw number i."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), i_col.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), n_rows)


def sample_bootstrap(df: DataFrame, n: int, key_cols: list[str], seed: int = SEED,
                     salt: str = "draw") -> DataFrame:
    """R2: exactly ``n`` draws with replacement from ``df`` (one class).

    The n draws are a Spark range mapped to row ranks, equi-joined to the
    ranked rows; ``draw`` numbers the copies.  Nothing is collected.
    """
    spark = df.sparkSession
    ranked = exact_rank(df, key_cols, None, seed, out="__rk")
    n_rows = df.count()
    if n_rows == 0 or n == 0:
        return ranked.drop("__rk").withColumn("draw", F.lit(None).cast("long")).limit(0)
    draws = spark.range(n).select(F.col("id").alias("draw"), draw_index(F.col("id"), F.lit(n_rows), seed, salt).alias("__rk"))
    return draws.join(ranked, "__rk", "inner").drop("__rk")


def resample(df: DataFrame, n: int, key_cols: list[str], replace: bool | None = None,
             seed: int = SEED, n_rows: int | None = None) -> DataFrame:
    """R1/R2 for one class: with replacement when asked or when the class
    has fewer than ``n`` rows (the reference's ``replace=len<n`` rule)."""
    n_rows = df.count() if n_rows is None else n_rows
    if replace is None:
        replace = n_rows < n
    if replace:
        return sample_bootstrap(df, n, key_cols, seed).drop("draw")
    return first_ranked(df, {None: n}, key_cols, None, seed)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def fraction_sample(df: DataFrame, frac: float, key_cols: list[str], seed: int = SEED) -> DataFrame:
    """Exactly round(frac * N) rows (frac = 1 keeps every row)."""
    if frac >= 1.0:
        return df
    return first_ranked(df, {None: int(round(frac * df.count()))}, key_cols, None, seed)


def target_sizes(n_train: int, val_pct: float = 0.20, test_pct: float = 0.20,
                 test_class1_ratio: float = 0.25) -> dict:
    """test = floor(test_pct * N_train) with the class-1 share; val =
    floor(val_pct * N_train), half per class."""
    test = int(n_train * test_pct)
    t1 = int(test * test_class1_ratio)
    val = int(n_train * val_pct)
    return {"test": {0: test - t1, 1: t1}, "val": {0: val // 2, 1: val // 2}}


def balance_classes(df: DataFrame, key_cols: list[str], label: str = "label", replace: bool = True,
                    seed: int = SEED) -> DataFrame:
    """R3 + U1: majority class drawn down to the minority size (with
    replacement by default, as the reference's call does) + all minority rows.
    A NULL class or a third one is an error, not a minority."""
    counts = class_counts(df, label)
    if None in counts or len(counts) > 2:
        raise ValueError(f"two classes are balanced, found {counts}; reject NULL classes first (reject_null_class)")
    if len(counts) < 2:
        return df
    minority = min(counts, key=lambda k: (counts[k], k))
    majority = [k for k in counts if k != minority]
    parts = [df.where(F.col(label) == minority)]
    for k in majority:
        part = df.where(F.col(label) == k)
        parts.append(resample(part, counts[minority], key_cols, replace, seed, counts[k]))
    return union_all(parts)


def reject_null_class(df: DataFrame, label: str = "label") -> tuple[DataFrame, int]:
    """The rows with a class, and how many had none."""
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull()).count()


def stratified_folds(df: DataFrame, key_cols: list[str], k: int = 3, label: str = "label",
                     seed: int = SEED, out: str = "fold") -> DataFrame:
    """L4 folds: md5 rank within class, modulo k (sizes differ by <= 1)."""
    r = exact_rank(df, key_cols, [label], seed, out="__rk")
    return r.withColumn(out, (F.col("__rk") % k).cast("int")).drop("__rk")


def seeded_subset(df: DataFrame, n: int, key_cols: list[str], seed: int = SEED) -> DataFrame:
    """A seeded subset of at most n rows (importance sample)."""
    return first_ranked(df, {None: n}, key_cols, None, seed)
