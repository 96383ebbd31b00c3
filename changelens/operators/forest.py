"""Forest with the class weights of each tree's own bootstrap (L1).

A row is drawn ``Poisson(rate)`` times for a tree, by the md5 of (seed, tree,
key), so a bootstrap needs no shuffle and is the same in every run.  In tree t a
row weighs its draws times n_t / (c_t n_tc): n_t draws in all, n_tc of the row's
class, c_t classes drawn.  Every tree is a Spark ML fit of its own, several at a
time; the trees are then one forest model, saved and scored as any other.

Defined cases: rows of equal keys are drawn together; a class that a bootstrap
holds no row of has no weight there; an empty table is an error; a NULL label
is refused by Spark ML's fit.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import run_at_once
from . import sampling as SM


def poisson_steps(rate: float) -> list[float]:
    """P(X <= k) of a Poisson variable for k = 0, 1, ... until doubles reach 1."""
    p, total, steps = math.exp(-rate), 0.0, []
    while total + p > total and total + p < 1.0:
        total += p
        steps.append(total)
        p *= rate / len(steps)
    return steps


def draws(key_cols: list[str], tree: Column | int, rate: float, seed: int = SM.SEED) -> Column:
    """How often a row is in the bootstrap of ``tree``."""
    tree = F.lit(tree) if isinstance(tree, int) else tree
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("boot"), tree.cast("string"),
                          *[F.col(c).cast("string") for c in key_cols]))
    place = F.conv(F.substring(h, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    # as the element of an array the place is computed once, not once a step
    return F.transform(F.array(place), lambda u: sum(((u >= F.lit(s)).cast("int") for s in poisson_steps(rate)),
                                                     F.lit(0)))[0]


def subsample_weights(df: DataFrame, key_cols: list[str], trees: int, rate: float = 0.9, label: str = "label",
                      seed: int = SM.SEED) -> DataFrame:
    """(tree, label, rows, draws, weight): distinct rows and draws of each class in
    each tree's bootstrap, and the weight of a draw.  One scan; what is shuffled is
    trees x classes rows a task."""
    each = df.select(*key_cols, label, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    each = each.withColumn("n", draws(key_cols, F.col("tree"), rate, seed)).where(F.col("n") > 0)
    per = each.groupBy("tree", label).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("draws"))
    tree = Window.partitionBy("tree")                    # a row per class
    return per.select("tree", label, "rows", "draws", (F.sum("draws").over(tree) / (
        F.count(F.lit(1)).over(tree) * F.col("draws"))).alias("weight"))


def fit_balanced_forest(train: DataFrame, params: dict | None = None, key_cols: list[str] | None = None,
                        seed: int = SM.SEED, label: str = "label", at_once: int = 2) -> RandomForestClassificationModel:
    """``numTrees`` trees on bootstraps of rate ``subsamplingRate``, each weighted by
    its own draws; the other settings are those of Spark ML's forest.  ``train`` is
    read once per tree, so it should be kept (a checkpoint or a table)."""
    p = {"numTrees": 20, "subsamplingRate": 1.0, "featureSubsetStrategy": "sqrt", **(params or {})}
    trees, rate, keys = p.pop("numTrees"), p.pop("subsamplingRate"), key_cols or ["rid"]
    weights: dict = {}
    for r in subsample_weights(train, keys, trees, rate, label, seed).collect():   # trees x 2 rows
        weights.setdefault(r["tree"], {})[r[label]] = r["weight"]
    if not weights:
        raise ValueError("no rows to fit a forest to")
    # a bootstrap without one of the classes still is a fit of two
    train = train.withMetadata(label, {"ml_attr": {"type": "nominal", "num_vals": 2}})

    def tree(t):
        own = F.create_map(*[F.lit(x) for kv in weights[t].items() for x in kv])
        rows = train.withColumn("__n", draws(keys, t, rate, seed)).where(F.col("__n") > 0)
        rows = rows.withColumn("__w", F.col("__n") * own[F.col(label)])
        fit = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="__w", numTrees=1, bootstrap=False,
                                     subsamplingRate=1.0, seed=seed + t, **p)
        return fit.fit(rows)
    fitted = run_at_once(train.sparkSession, [lambda t=t: tree(t) for t in sorted(weights)], at_once)
    return _one_model(train.sparkSession, fitted)


def _one_model(spark, fitted: list) -> RandomForestClassificationModel:
    """The trees of several forest models as one model."""
    jvm, first = spark._jvm, fitted[0]._java_obj
    kind = jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel
    trees = spark.sparkContext._gateway.new_array(kind, len(fitted))
    for i, m in enumerate(fitted):
        trees[i] = m._java_obj.trees()[0]
    java = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        first.uid(), trees, first.numFeatures(), first.numClasses())
    for name, value in (("numTrees", len(fitted)), ("featuresCol", "features"), ("labelCol", first.getLabelCol())):
        java.set(java.getParam(name), value)
    return RandomForestClassificationModel(java)
