"""Registered queries: preprocessing, TF-IDF / SVD, models (F1-F12, A8,
A9, T1, L1-L7, E11)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.metrics import METRIC_NAMES, with_metrics
from ..operators import forest as FO
from ..operators import preprocess as PP
from ..operators import text_features as TF
from ..session import cut_lineage, cut_lineage_dealt
from . import sqlgen as S
from . import standins as SI
from .catalog import register, table

LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
FLOAT_COLS = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}


@register("null_counts", rows="A8", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL"
    + (f" OR isnan({c})" if c in FLOAT_COLS else "") + ")::BIGINT AS n_null FROM lineitem" for c in LINE_COLS))
def null_counts(spark, sf):
    return PP.null_counts(table(spark, sf, "lineitem"), LINE_COLS)


def _metrics_sql_cte():
    return S.metric_ctes("SELECT doc_id, text AS c FROM documents")


@register("constant_columns", rows="A9,P9", sql=(
    "WITH m AS (" + _metrics_sql_cte() + "SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in S.metric_sql().items()) + " FROM s3) "
    + " UNION ALL ".join(f"SELECT '{n}' AS column, (count({n}) > 0 AND min({n}) = max({n})) AS is_constant FROM m"
                         for n in METRIC_NAMES)))
def constant_columns(spark, sf):
    """Constant-feature detection over the 33 metrics of every document."""
    m = with_metrics(table(spark, sf, "documents").select("doc_id", "text"), "text", keep=False)
    return PP.constant_columns(m, METRIC_NAMES)


@register("impute_mean", rows="F1", sql=(
    "SELECT d.doc_id, coalesce(l.quality::DOUBLE, avg(l.quality::DOUBLE) OVER ()) AS quality_imputed "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"))
def impute_mean(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return PP.impute_mean(d, ["quality"]).select("doc_id", "quality_imputed")


@register("standard_scale", rows="F2", sql=(
    "SELECT p_partkey, " + ", ".join(
        f"round(({c}::DOUBLE - avg({c}::DOUBLE) OVER ()) / (CASE WHEN coalesce(stddev_pop({c}::DOUBLE) OVER (), 0) = 0 "
        f"THEN 1.0 ELSE stddev_pop({c}::DOUBLE) OVER () END), 9) AS {c}" for c in ("p_size", "p_retailprice"))
    + " FROM part"))
def standard_scale(spark, sf):
    p = table(spark, sf, "part")
    prep = PP.NumericPrep.fit(p, ["p_size", "p_retailprice"])
    return p.select("p_partkey", *[F.round(prep.scale(c), 9).alias(c) for c in ("p_size", "p_retailprice")])


@register("variance_threshold", rows="F3", sql=(
    "WITH m AS (" + _metrics_sql_cte() + "SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in S.metric_sql().items()) + " FROM s3) "
    + " UNION ALL ".join(f"SELECT '{n}' AS feature, coalesce(var_pop({n}::DOUBLE), 0) > 0 AS kept FROM m"
                         for n in METRIC_NAMES)))
def variance_threshold(spark, sf):
    m = with_metrics(table(spark, sf, "documents").select("doc_id", "text"), "text", keep=False)
    return PP.variance_threshold(m, METRIC_NAMES).select(
        "feature", F.coalesce(F.col("kept"), F.lit(False)).alias("kept"))


def _emb_long(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("label", F.posexplode("embedding").alias("feature", "value")).withColumn(
        "value", F.col("value").cast("double"))


_ANOVA_SQL = (
    "WITH l AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS value "
    "FROM embeddings), "
    "p AS (SELECT feature, label, count(value) AS n, sum(value) AS s, sum(value * value) AS ss FROM l GROUP BY 1, 2), "
    "t AS (SELECT feature, sum(n) AS N, count(*) AS k, sum(s) AS S, sum(ss) AS SS, sum(s * s / n) AS B FROM p GROUP BY 1), "
    "f AS (SELECT feature, (B - S * S / N) / (k - 1) AS msb, ((SS - S * S / N) - (B - S * S / N)) / (N - k) AS msw FROM t) "
    "SELECT feature::INTEGER AS feature, round(CASE WHEN msw = 0 THEN NULL ELSE msb / msw END, 6) AS f_score FROM f"
)


@register("anova_f_scores", rows="F4", sql=_ANOVA_SQL)
def anova_f_scores(spark, sf):
    return PP.anova_f(_emb_long(spark, sf)).select(
        F.col("feature").cast("int"), F.round("f_score", 6).alias("f_score"))


@register("top_importance", rows="T1", sql=f"SELECT * FROM ({_ANOVA_SQL}) ORDER BY f_score DESC, feature ASC LIMIT 20")
def top_importance(spark, sf):
    """Top-20 feature scores (the ANOVA score table stands in for an
    importance table; same ordering rule)."""
    s = PP.anova_f(_emb_long(spark, sf)).select(F.col("feature").cast("int"), F.round("f_score", 6).alias("f_score"))
    return s.orderBy(F.col("f_score").desc(), F.col("feature").asc()).limit(20)


_BRAND = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END"


def _brands(spark, sf):
    """Parts with a NULL brand on every seventh."""
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice",
                                           F.expr(_BRAND).alias("p_brand"))


@register("one_hot", rows="F5,F6", sql=(
    f"WITH p AS (SELECT p_partkey, p_size, coalesce({_BRAND}, 'missing') AS v FROM part), "
    "c AS (SELECT list(DISTINCT v ORDER BY v) AS cats FROM p WHERE p_size <= 5) "
    "SELECT p_partkey, array_to_string(list_transform(cats, lambda x: CASE WHEN x = v THEN '1' ELSE '0' END), '') AS vector "
    "FROM p, c"))
def one_hot(spark, sf):
    """One-hot vectors with NULL values, and values not among the categories
    (taken from the small parts only)."""
    p = _brands(spark, sf)
    cats = PP.one_hot_fit(p.where("p_size <= 5"), "p_brand")
    bits = F.transform(PP.one_hot_vector("p_brand", cats), lambda x: x.cast("int").cast("string"))
    return p.select("p_partkey", F.array_join(bits, "").alias("vector"))


@register("feature_names", rows="F12", sql=(
    "SELECT (row_number() OVER (ORDER BY part, name) - 1)::INTEGER AS place, name FROM ("
    "SELECT 0 AS part, 'p_retailprice' AS name UNION ALL SELECT 1, 'p_size' UNION ALL "
    f"SELECT DISTINCT 2, 'p_brand_' || coalesce({_BRAND}, 'missing') FROM part)"))
def feature_names(spark, sf):
    """Names of the assembled vector's places: scaled numbers (a constant one is
    dropped) and one-hot categories."""
    from ..operators.models import Preprocessor
    p = _brands(spark, sf).withColumn("same", F.lit(1))
    pre = Preprocessor.fit(p, "p_partkey", ["p_retailprice", "p_size", "same"], ["p_brand"])
    names = F.array(*[F.lit(n) for n in pre.feature_names()])
    wide = pre.transform(p).select(F.posexplode(names).alias("place", "name"), F.col("features"))
    from pyspark.ml.functions import vector_to_array
    # a name for every place of every vector
    return (wide.groupBy("place", "name").agg(F.min(F.size(vector_to_array("features"))).alias("n"))
            .where(F.col("n") == len(pre.feature_names())).select(F.col("place").cast("int"), "name"))


_FEATURE_VALUES_SQL = (
    f"WITH p AS (SELECT p_partkey, p_size, p_retailprice, coalesce({_BRAND}, 'missing') AS v FROM part), "
    "x AS (" + " UNION ALL ".join(
        f"SELECT p_partkey, '{c}' AS name, round(({c}::DOUBLE - avg({c}::DOUBLE) OVER ()) / "
        f"stddev_pop({c}::DOUBLE) OVER (), 9) AS value FROM p" for c in ("p_retailprice", "p_size"))
    + " UNION ALL SELECT p_partkey, 'p_brand_' || c.v, CASE WHEN p.v = c.v THEN 1.0 ELSE 0.0 END::DOUBLE "
      "FROM p, (SELECT DISTINCT v FROM p) c) "
      "SELECT p_partkey, name, value FROM x")


@register("feature_values", rows="F11,F12", sql=_FEATURE_VALUES_SQL)
def feature_values(spark, sf):
    """Every place of the assembled vectors under the name that the vector
    column's attributes give it, kept through a lineage cut."""
    from ..operators.models import Preprocessor
    p = _brands(spark, sf).withColumn("same", F.lit(1))
    pre = Preprocessor.fit(p, "p_partkey", ["p_retailprice", "p_size", "same"], ["p_brand"])
    return _named_values(cut_lineage(pre.transform(p)))


def _named_values(rows):
    from pyspark.ml.functions import vector_to_array
    from ..operators.models import named_places
    names = F.array(*[F.lit(n) for n in named_places(rows)])
    pairs = F.arrays_zip(names.alias("name"), vector_to_array("features").alias("value"))
    return rows.select("p_partkey", F.explode(pairs).alias("x")).select(
        "p_partkey", "x.name", F.round("x.value", 9).alias("value"))


@register("saved_pipeline_values", rows="F1-F3,F6,F11,F12,L5,S5,S6", sql=_FEATURE_VALUES_SQL)
def saved_pipeline_values(spark, sf):
    """Names and values of the vectors of a Spark ML pipeline that was fitted,
    saved below the checkpoint folder and loaded again by ``PipelineModel``."""
    import uuid
    from pyspark.ml import Pipeline, PipelineModel
    from ..operators.stages import FeatureEstimator
    from ..session import ensure_checkpoint_dir
    p = _brands(spark, sf).withColumn("same", F.lit(1))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    Pipeline(stages=[FeatureEstimator(idCol="p_partkey", numericCols=["p_retailprice", "p_size", "same"],
                                      categoricalCols=["p_brand"])]).fit(p).write().session(spark).save(path)
    return _named_values(PipelineModel.read().session(spark).load(path).transform(p))


_TOK_SQL = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]+')"


def _ngram_sql(tok: str) -> str:
    parts = [f"(CASE WHEN len({tok}) >= {n} THEN list_transform(range(1, len({tok}) - {n} + 2), "
             f"lambda i: array_to_string({tok}[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END)" for n in (1, 2, 3)]
    return "list_concat(" + ", ".join(parts) + ")"


@register("ngrams", rows="F7", sql=(
    f"WITH t AS (SELECT item_id, {_TOK_SQL} AS tok FROM benchmark), g AS (SELECT item_id, {_ngram_sql('tok')} AS grams FROM t) "
    "SELECT item_id, generate_subscripts(grams, 1)::INTEGER AS pos, unnest(grams) AS term FROM g"))
def ngrams(spark, sf):
    b = table(spark, sf, "benchmark")
    t = TF.with_ngrams(TF.with_tokens(b.select("item_id", "text"), "text", "tok"), "tok")
    return t.select("item_id", F.posexplode("grams").alias("pos", "term")).withColumn(
        "pos", (F.col("pos") + 1).cast("int"))


def _tf_sql(src: str, id_col: str) -> str:
    return (f"WITH t AS (SELECT {id_col}, {_TOK_SQL} AS tok FROM {src}), "
            f"g AS (SELECT {id_col}, unnest({_ngram_sql('tok')}) AS term FROM t), "
            f"tf AS (SELECT {id_col}, term, count(*) AS tf FROM g GROUP BY 1, 2), "
            f"nd AS (SELECT count(*) AS n FROM {src}), "
            f"st AS (SELECT term, count({id_col}) AS df, sum(tf) AS cf FROM tf GROUP BY term), "
            "kept AS (SELECT * FROM st, nd WHERE df >= 1 AND df <= 0.7::DOUBLE * n), "
            "top AS (SELECT term, df, cf FROM kept ORDER BY cf DESC, term ASC LIMIT 12000), "
            "voc AS (SELECT term, df, cf, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS \"index\" FROM top) ")


@register("tfidf_vocabulary", rows="F8", sql=_tf_sql("documents", "doc_id") + 'SELECT term, df::BIGINT AS df, cf::BIGINT AS cf, "index" FROM voc')
def tfidf_vocabulary(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    n = d.count()
    grams = TF.token_grams(cut_lineage_dealt(TF.doc_tokens(d, "doc_id", "text")), "doc_id")  # texts are tokenized once
    v = TF.vocabulary(TF.frequent_stats(grams, "doc_id", n), n)
    return v.select("term", F.col("df").cast("long"), F.col("cf").cast("long"), "index")


def _dealt_grams(spark, sf):
    """Grams of the documents, their vocabulary and number."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    n = d.count()
    grams = TF.token_grams(cut_lineage_dealt(TF.doc_tokens(d, "doc_id", "text")), "doc_id")  # texts are tokenized once
    return grams, cut_lineage(TF.vocabulary(TF.frequent_stats(grams, "doc_id", n), n)), n


def _tfidf(spark, sf):
    grams, v, n = _dealt_grams(spark, sf)
    return TF.tfidf(TF.term_counts(grams, "doc_id", v), v, "doc_id", n), v, n


@register("tfidf_weights", rows="F9", sql=_tf_sql("documents", "doc_id") + (
    ", w AS (SELECT tf.doc_id, voc.\"index\", tf.term, (1.0 + ln(tf.tf::DOUBLE)) * (ln((SELECT n + 1 FROM nd)::DOUBLE / (voc.df + 1)::DOUBLE) + 1.0) AS w "
    "FROM tf JOIN voc ON tf.term = voc.term) "
    "SELECT doc_id, \"index\", term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"))
def tfidf_weights(spark, sf):
    return _tfidf(spark, sf)[0].select("doc_id", "index", "term", F.round("weight", 6).alias("weight"))


_SVD_K = 50


@register("svd_project", rows="F10", sql=(
    f"SELECT i::INTEGER AS i, j::INTEGER AS j, (i = j)::INTEGER::DOUBLE AS loadings_product, "
    f"(i = j)::INTEGER::DOUBLE AS scores_product, TRUE AS falling "
    f"FROM range(0, {_SVD_K}) a(i), range(0, {_SVD_K}) b(j) WHERE i <= j"))
def svd_project(spark, sf):
    """Truncated SVD (50 components) of the document TF-IDF matrix and the
    documents' projection, shown by what defines it: the components are
    orthonormal, the projected documents' components are orthogonal (their
    products over the singular values are 0 or 1, to 2 digits), and the singular values fall."""
    grams, v, n = _dealt_grams(spark, sf)
    w = cut_lineage(TF.document_weights(grams, v, "doc_id", n))
    comps = TF.svd_components(w, "doc_id", v.count(), _SVD_K)
    docs = TF.svd_project(w, comps, "doc_id", _SVD_K, "c")

    def products(df, col, name):
        def part(batches):
            for b in batches:
                if len(b):
                    x = np.array(b["x"].tolist())
                    i, j = np.triu_indices(x.shape[1])
                    yield pd.DataFrame({"i": i, "j": j, "v": (x.T @ x)[i, j]})
        parts = df.select(F.col(col).alias("x")).mapInPandas(part, "i int, j int, v double")
        return parts.groupBy("i", "j").agg(F.sum("v").alias(name))
    right = products(comps, "loadings", "loadings_product")
    left = products(docs, "c", "xx")
    sizes = left.where("i = j").select(F.col("i").alias("k"), F.sqrt("xx").alias("s"))
    before = sizes.select((F.col("k") + 1).alias("k"), F.col("s").alias("before"))
    falling = sizes.join(before, "k", "left").agg(
        F.min(F.coalesce(F.col("s") <= F.col("before") * (1 + 1e-9), F.lit(True))).alias("falling"))
    at = (left.join(sizes.select(F.col("k").alias("i"), F.col("s").alias("si")), "i")
          .join(sizes.select(F.col("k").alias("j"), F.col("s").alias("sj")), "j"))
    both = at.join(right, ["i", "j"]).withColumn("k", F.lit(1)).join(falling.withColumn("k", F.lit(1)), "k")

    def tidy(x, digits):
        return (F.round(x, digits) + F.lit(0.0)).cast("double")
    return both.select("i", "j", F.abs(tidy("loadings_product", 6)).alias("loadings_product"),
                       F.abs(tidy(F.col("xx") / (F.col("si") * F.col("sj")), 2)).alias("scores_product"), "falling")


# ------------------------------------------------------ model queries (rows-only)

def _config():
    """The library's settings but for the trees: the reference's 500 rounds of
    depth 15, three times over for calibration, are tens of thousands of Spark
    jobs however few the rows.  Trees and rounds are the documented parameters
    of this query; vocabulary, components, texts and rows are not cut."""
    from .jobs import Config
    return Config(rf_params={"numTrees": 100, "featureSubsetStrategy": "sqrt", "subsamplingRate": 0.9, "maxDepth": 10},
                  gbt_params={"maxIter": 10, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8,
                              "featureSubsetStrategy": "0.7", "minInfoGain": 0.3},
                  importance=False)   # E11 has its own registered query


@register("model_scores", rows="L1-L7,B1,F1-F12,R1-R5,J1,J5,P3-P5,A12,S1")
def model_scores(spark, sf):
    """The training flow on documents + labels: join, label, resample,
    features, preprocessing, SMOTE, three calibrated models; returns the
    long score table (model, split, repo, filepath, commit, label, p)."""
    from . import standins as SI
    from .jobs import train
    line, jit = SI.doc_splits(spark, sf)
    return train(spark, line, jit, _config())["scores"].drop("rid")


_TREES, _RATE = 10, 0.9
_DRAWS_SQL = " + ".join(f"(u >= {x!r}e0)::INTEGER" for x in FO.poisson_steps(_RATE))


@register("balanced_subsample_weights", rows="L1,R2", sql=(
    "WITH e AS (SELECT doc_id, quality, tree, ('0x' || substr(md5('42|boot|' || tree || '|' || doc_id), 1, 13))::BIGINT"
    f"::DOUBLE / 4503599627370496e0 AS u FROM labels, range(0, {_TREES}) t(tree)), "
    f"d AS (SELECT *, {_DRAWS_SQL} AS n FROM e), "
    "p AS (SELECT tree, quality, count(*) AS rows, sum(n)::BIGINT AS draws FROM d WHERE n > 0 GROUP BY tree, quality) "
    "SELECT tree::INTEGER AS tree, quality, rows, draws, round((sum(draws) OVER w)::DOUBLE / (count(*) OVER w * draws), 9) "
    "AS weight FROM p WINDOW w AS (PARTITION BY tree)"))
def balanced_subsample_weights(spark, sf):
    """Bootstraps of ten trees over the quality labels: rows, draws and the weight
    of a draw per tree and class."""
    lab = table(spark, sf, "labels")
    out = FO.subsample_weights(lab, ["doc_id"], _TREES, _RATE, "quality")
    return out.withColumn("weight", F.round("weight", 9))


@register("smote_oversample", rows="B1")
def smote_oversample(spark, sf):
    """SMOTE over the embeddings: class 0 against the rest, minority
    oversampled to parity with exact neighbours (k = 5)."""
    from pyspark.ml.functions import array_to_vector
    from ..operators.smote import smote
    e = table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").cast("string").alias("id"), array_to_vector("embedding").alias("features"),
                 (F.col("label") == 0).cast("int").alias("label"))
    return smote(v, "id")


@register("knn_exact", rows="B1", sql=(
    "WITH p AS (SELECT a.vec_id AS src, b.vec_id AS nb, list_sum(list_transform(range(1, len(a.embedding) + 1), "
    "lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS sq "
    "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), "
    "r AS (SELECT src, nb, sq, row_number() OVER (PARTITION BY src ORDER BY round(sq, 12), nb) AS place FROM p) "
    "SELECT src, nb, place::INTEGER AS place, round(sqrt(sq), 6) AS dist FROM r WHERE place <= 5"))
def knn_exact(spark, sf):
    """The 5 nearest other embeddings of every embedding, exactly."""
    from ..operators import neighbours as NB
    e = table(spark, sf, "embeddings")
    return NB.knn_exact(e, "vec_id", "embedding", 5).withColumn("dist", F.round("dist", 6))


@register("smote_draws", rows="B1", sql=(
    "WITH m AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) - 1 AS rk FROM embeddings WHERE label = 0), "
    "n AS (SELECT count(*) AS n FROM m), t AS (SELECT count(*) - 2 * (SELECT n FROM n) AS need FROM embeddings), "
    "d AS (SELECT unnest(range(need)) AS draw FROM t) "
    "SELECT d.draw, m.vec_id AS base, (('0x' || substr(md5('42|nb|' || d.draw), 1, 15))::BIGINT % 5)::BIGINT AS place, "
    "('0x' || substr(md5('42|gap|' || d.draw), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS gap "
    "FROM d, n JOIN m ON m.rk = ('0x' || substr(md5('42|base|' || d.draw), 1, 15))::BIGINT % n.n"))
def smote_draws(spark, sf):
    """The draws behind the synthetic embeddings of class 0: base point, which
    of its 5 neighbours, and how far towards it."""
    from ..operators import smote as SO
    e = table(spark, sf, "embeddings")
    mino = e.where(F.col("label") == 0).select("vec_id")
    n, total = mino.count(), e.count()
    d = SO.draw_bases(mino, "vec_id", n, total - 2 * n)
    return d.select("draw", F.col("vec_id").alias("base"), SO.draw_place(F.lit(5)).alias("place"), "gap")


def _platt_sql(name: str, src: str) -> str:
    """Newton's method as a recursive query over every row (no counts)."""
    return (
        f"{name}_r AS (SELECT label, p AS x FROM {src} WHERE p IS NOT NULL AND NOT isnan(p)), "
        f"{name}_n AS (SELECT sum(label)::DOUBLE AS n1, sum(1 - label)::DOUBLE AS n0 FROM {name}_r), "
        f"{name}_t AS (SELECT x, CASE WHEN label = 1 THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END AS t "
        f"FROM {name}_r, {name}_n), "
        f"{name}_w AS (SELECT 0 AS k, 0.0::DOUBLE AS a, ln((n1 + 1) / (n0 + 1)) AS b FROM {name}_n UNION ALL "
        "SELECT k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), "
        "b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM ("
        "SELECT k, a, b, sum((q - t) * x) AS ga, sum(q - t) AS gb, sum(q * (1 - q) * x * x) AS haa, "
        "sum(q * (1 - q) * x) AS hab, sum(q * (1 - q)) AS hbb FROM ("
        f"SELECT k, a, b, x, t, 1 / (1 + exp(-(a * x + b))) AS q FROM {name}_w, {name}_t WHERE k < 12) GROUP BY k, a, b)), "
        f"{name}_f AS (SELECT '{name}' AS source, round(a, 6) AS a, round(b, 6) AS b FROM {name}_w WHERE k = 12)")


@register("platt_sigmoid", rows="L4", sql=(
    f"WITH RECURSIVE {_platt_sql('customer', '(' + SI.SCORED_CUSTOMERS_SQL + ')')}, "
    f"{_platt_sql('lineitem', '(' + SI.SCORED_LINES_SQL + ')')} "
    "SELECT * FROM customer_f UNION ALL SELECT * FROM lineitem_f"))
def platt_sigmoid(spark, sf):
    """The sigmoid maps that calibrate two score tables, a continuous one and
    one of eleven values."""
    from ..operators import models as MD
    maps = [(name, *MD.platt(rows(spark, sf), s="p"))
            for name, rows in (("customer", SI.scored_customers), ("lineitem", SI.scored_lines))]
    return spark.createDataFrame(maps, "source string, a double, b double").select(
        "source", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


_RULE = "(p_retailprice > 1200 OR p_brand = 'Brand#11' OR p_type < 'F')"
_COLUMNS, _REPEATS = ["p_retailprice", "p_brand", "p_type"], 10
_PERMUTED = (
    "WITH s AS (SELECT p_partkey, p_retailprice, p_brand, p_type, (p_size > 25)::INTEGER AS label, "
    "row_number() OVER (ORDER BY md5('42|' || p_partkey), p_partkey) - 1 AS r0 FROM part), "
    "r AS (SELECT * FROM s WHERE r0 < 2000), "
    "t AS (SELECT unnest(['p_retailprice', 'p_brand', 'p_type']) AS col), k AS (SELECT unnest(range(10)) AS rep), "
    "c AS (SELECT r.*, t.col, k.rep, row_number() OVER (PARTITION BY t.col, k.rep ORDER BY "
    "md5('42|' || t.col || '|' || k.rep || '|' || p_partkey), p_partkey) - 1 AS donor FROM r, t, k), "
    "j AS (SELECT c.p_partkey, c.label, c.col, c.rep::INTEGER AS rep, "
    "CASE WHEN c.col = 'p_retailprice' THEN d.p_retailprice ELSE c.p_retailprice END AS p_retailprice, "
    "CASE WHEN c.col = 'p_brand' THEN d.p_brand ELSE c.p_brand END AS p_brand, "
    "CASE WHEN c.col = 'p_type' THEN d.p_type ELSE c.p_type END AS p_type FROM c JOIN r d ON d.r0 = c.donor) ")


def _importance_sample(spark, sf):
    from ..operators.sampling import seeded_subset
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_brand", "p_type",
                                        (F.col("p_size") > 25).cast("int").alias("label"))
    return seeded_subset(p, 2000, ["p_partkey"])


@register("permute_column", rows="E11,R6", sql=_PERMUTED + "SELECT * FROM j")
def permute_column(spark, sf):
    """The permuted copies behind the importances (2,000 rows at most, as the
    importance job takes)."""
    from ..operators import models as MD
    out = MD.permuted_copies(_importance_sample(spark, sf), _COLUMNS, "p_partkey", _REPEATS)
    return out.select("p_partkey", "label", F.col("__col").alias("col"), F.col("__rep").cast("int").alias("rep"),
                      "p_retailprice", "p_brand", "p_type")


def _f1_sql(src: str, g: str = "") -> str:
    f1 = lambda t, a, b: (f"(CASE WHEN 2 * {t} + {a} + {b} = 0 THEN 0.0 "  # noqa: E731
                          f"ELSE 2.0::DOUBLE * {t} / (2 * {t} + {a} + {b}) END)")
    cells = ", ".join(f"count(*) FILTER (WHERE label = {y} AND {'' if p else 'NOT '}{_RULE}) AS {n}"
                      for n, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
    return (f"SELECT {g}({f1('tp', 'fp', 'fn')} + {f1('tn', 'fn', 'fp')}) / 2 AS f1 FROM (SELECT {g}{cells} FROM {src}"
            + (f" GROUP BY {g.rstrip(', ')})" if g else ")"))


@register("permutation_importance", rows="E11,R6,T1", sql=_PERMUTED + (
    f", b AS ({_f1_sql('r')}), x AS ({_f1_sql('j', 'col, rep, ')}) "
    "SELECT col AS feature, round(avg(b.f1 - x.f1), 9) AS importance_mean, "
    "round(stddev_pop(b.f1 - x.f1), 9) AS importance_std FROM x, b GROUP BY col ORDER BY importance_mean DESC, feature LIMIT 20"))
def permutation_importance(spark, sf):
    """Permutation importance of a fixed rule's columns, 10 repeats, the top 20."""
    from ..operators import models as MD
    imp = MD.permutation_importance(_importance_sample(spark, sf), _COLUMNS,
                                    lambda d: d.withColumn("pred", F.expr(_RULE).cast("int")), "p_partkey", _REPEATS)
    imp = imp.select("feature", F.round("importance_mean", 9).alias("importance_mean"),
                     F.round("importance_std", 9).alias("importance_std"))
    return imp.orderBy(F.col("importance_mean").desc(), "feature").limit(20)


@register("forest_importance", rows="E11,L1,L7,T1")
def forest_importance(spark, sf):
    """Permutation importance (10 repeats) of the columns of a forest trained on
    half of the parts to tell dear or early types, on the other half."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from ..operators import models as MD
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice",
                                        F.expr("CAST(p_retailprice > 1200 OR p_type < 'F' AS INT)").alias("label"))
    codes = [StringIndexer(inputCol=c, outputCol=f"{c}_code", handleInvalid="keep") for c in ("p_brand", "p_type")]
    rows = VectorAssembler(inputCols=["p_retailprice", "p_size", "p_brand_code", "p_type_code"], outputCol="features")
    forest = RandomForestClassifier(numTrees=30, maxDepth=6, maxBins=256, seed=42, predictionCol="pred")
    model = Pipeline(stages=[*codes, rows, forest]).fit(p.where("p_partkey % 2 = 0"))
    imp = MD.permutation_importance(p.where("p_partkey % 2 = 1"), ["p_retailprice", "p_size", "p_brand", "p_type"],
                                    lambda d: model.transform(d).withColumn("pred", F.col("pred").cast("int")),
                                    "p_partkey", 10)
    return imp.orderBy(F.col("importance_mean").desc(), "feature").limit(20)
