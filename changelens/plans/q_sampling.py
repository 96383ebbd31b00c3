"""Registered queries: exact seeded samples (R1-R6, U1, L4 folds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as SM
from .catalog import register, table

KEY = ["l_orderkey", "l_linenumber"]
MD5_LINE = "md5('42|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR))"
MD5_DOC = "md5('42|' || CAST(doc_id AS VARCHAR))"


def _lines(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*KEY, (F.col("l_returnflag") == "R").cast("int").alias("label"))


_LINES_SQL = "(SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"


@register("sample_exact", rows="R1,R5,U1", sql=(
    f"WITH n AS (SELECT count(*) AS n FROM lineitem), "
    "t AS (SELECT floor(n * 0.2::DOUBLE)::BIGINT AS test FROM n), "
    "z AS (SELECT floor(test * 0.25::DOUBLE)::BIGINT AS t1, test - floor(test * 0.25::DOUBLE)::BIGINT AS t0 FROM t), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {MD5_LINE}, l_orderkey, l_linenumber) - 1 AS rk FROM {_LINES_SQL}) "
    "SELECT l_orderkey, l_linenumber, label FROM r, z WHERE rk < CASE WHEN label = 1 THEN t1 ELSE t0 END"))
def sample_exact(spark, sf):
    """Test-set draw: floor(0.2 N) rows with 25 % class 1, no replacement."""
    df = _lines(spark, sf)
    sizes = SM.target_sizes(df.count())["test"]
    return SM.sample_exact(df, sizes, KEY)


@register("sample_bootstrap", rows="R2", sql=(
    f"WITH c AS (SELECT l_orderkey, l_linenumber FROM {_LINES_SQL} WHERE label = 1), "
    "n AS (SELECT count(*) AS n FROM c), m AS (SELECT count(*) AS m FROM lineitem WHERE l_returnflag <> 'R'), "
    f"r AS (SELECT *, row_number() OVER (ORDER BY {MD5_LINE}, l_orderkey, l_linenumber) - 1 AS rk FROM c), "
    "d AS (SELECT unnest(range(m)) AS draw FROM m), "
    "d2 AS (SELECT draw, ('0x' || substr(md5('42|draw|' || CAST(draw AS VARCHAR)), 1, 15))::BIGINT % n AS rk FROM d, n) "
    "SELECT d2.draw, r.l_orderkey, r.l_linenumber FROM d2 JOIN r ON d2.rk = r.rk"))
def sample_bootstrap(spark, sf):
    """Minority class (returned lines) drawn with replacement up to the
    majority class size."""
    df = _lines(spark, sf)
    n = df.where(F.col("label") == 0).count()
    return SM.sample_bootstrap(df.where(F.col("label") == 1).select(*KEY), n, KEY)


@register("balance_train", rows="R3,U1,R2", sql=(
    "WITH l AS (SELECT doc_id, quality AS label FROM labels), "
    "c AS (SELECT label, count(*) AS n FROM l GROUP BY label), "
    "mi AS (SELECT label AS minority, n AS n_min FROM c ORDER BY n, label LIMIT 1), "
    "maj AS (SELECT l.* FROM l, mi WHERE l.label <> mi.minority), "
    "nm AS (SELECT count(*) AS n FROM maj), "
    f"r AS (SELECT *, row_number() OVER (ORDER BY {MD5_DOC}, doc_id) - 1 AS rk FROM maj), "
    "d AS (SELECT unnest(range(n_min)) AS draw FROM mi), "
    "d2 AS (SELECT ('0x' || substr(md5('42|draw|' || CAST(draw AS VARCHAR)), 1, 15))::BIGINT % n AS rk FROM d, nm) "
    "SELECT r.doc_id, r.label FROM d2 JOIN r ON d2.rk = r.rk "
    "UNION ALL SELECT l.doc_id, l.label FROM l, mi WHERE l.label = mi.minority"))
def balance_train(spark, sf):
    """Training balance: the majority class drawn down to the minority
    size with replacement (the reference's default), plus the minority."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return SM.balance_classes(lab, ["doc_id"]).select("doc_id", "label")


@register("stratified_folds", rows="L4,P6", sql=(
    "SELECT doc_id, quality AS label, ((row_number() OVER (PARTITION BY quality ORDER BY "
    f"{MD5_DOC}, doc_id) - 1) % 3)::INTEGER AS fold FROM labels"))
def stratified_folds(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return SM.stratified_folds(lab, ["doc_id"], 3)


_WITH_NULLS = "(SELECT d.doc_id, l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _labels_with_nulls(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")


@register("stratified_folds_nulls", rows="L4,P6", sql=(
    "SELECT doc_id, label, ((row_number() OVER (PARTITION BY label ORDER BY "
    f"{MD5_DOC}, doc_id) - 1) % 3)::INTEGER AS fold FROM {_WITH_NULLS}"))
def stratified_folds_nulls(spark, sf):
    """Folds over documents of which many have no class: NULL is a class of
    its own, and no row is lost."""
    return SM.stratified_folds(_labels_with_nulls(spark, sf), ["doc_id"], 3)


@register("balance_nulls", rows="R3,U1", sql=(
    f"WITH l AS (SELECT * FROM {_WITH_NULLS} WHERE label IS NOT NULL), "
    "c AS (SELECT label, count(*) AS n FROM l GROUP BY label), "
    "mi AS (SELECT label AS minority, n AS n_min FROM c ORDER BY n, label LIMIT 1), "
    "maj AS (SELECT l.* FROM l, mi WHERE l.label <> mi.minority), "
    f"r AS (SELECT *, row_number() OVER (ORDER BY {MD5_DOC}, doc_id) AS rk FROM maj) "
    "SELECT doc_id, label FROM r, mi WHERE rk <= n_min "
    "UNION ALL SELECT l.doc_id, l.label FROM l, mi WHERE l.label = mi.minority"))
def balance_nulls(spark, sf):
    """Rows without a class are rejected first; the two classes are then
    balanced without replacement."""
    kept, _ = SM.reject_null_class(_labels_with_nulls(spark, sf))
    return SM.balance_classes(kept, ["doc_id"], replace=False).select("doc_id", "label")


@register("fraction_sample", rows="R4", sql=(
    f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {MD5_LINE}, l_orderkey, l_linenumber) - 1 AS rk FROM lineitem) "
    "SELECT l_orderkey, l_linenumber FROM r WHERE rk < (SELECT round(0.5::DOUBLE * count(*)) FROM lineitem)"))
def fraction_sample(spark, sf):
    li = table(spark, sf, "lineitem").select(*KEY)
    return SM.fraction_sample(li, 0.5, KEY)


@register("importance_subset", rows="R6", sql=(
    f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {MD5_LINE}, l_orderkey, l_linenumber) - 1 AS rk FROM lineitem) "
    "SELECT l_orderkey, l_linenumber FROM r WHERE rk < 2000"))
def importance_subset(spark, sf):
    """The importance job's row subset: at most 2,000 rows, seeded."""
    li = table(spark, sf, "lineitem").select(*KEY)
    return SM.seeded_subset(li, 2000, KEY)
