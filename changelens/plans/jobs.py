"""The reference's three flows as Spark jobs:

* ``prepare_splits``: join diff and full tables, label, resample, decode
* ``features``: the 73-column feature table per split (+ constant drop)
* ``train`` / ``evaluate``: fit calibrated models, score, report

Everything stays distributed; the driver handles only counts, fitted model
state and the small report tables it writes.  Rows are joined, labelled and
sampled as keys and row hashes; the texts are joined to the chosen rows once.
"""

from __future__ import annotations

import json
import logging
import re
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import context as C
from ..functions.metrics import MODEL_METRICS
from ..session import cut_lineage
from ..operators import evaluation as EV
from ..operators import models as MD
from ..operators import prepare as P
from ..operators import reports as RP
from ..operators import sampling as SM
from ..operators import stages as ST
from ..operators.features import feature_table
from ..operators.preprocess import constant_column_names
from ..sources import SPLITS, read_changes
from ..sources.sinks import display_name, join_path, list_folders, published_run, write_report

NUMERIC = ([m + "_full" for m in MODEL_METRICS] + [m + "_diff" for m in MODEL_METRICS]
           + ["commit_hour", "commit_day", "filepath_length", "file_change_freq"])
CATEGORICAL = ["repo_domain"]
TEXT = {"text_full": "content_text_full", "text_diff": "content_text_diff"}
MODEL_KINDS = {"RandomForest": "rf", "XGBoost": "gbt", "VotingClassifier": "vote"}
KEYS = ["commit", "repo", "filepath"]
#: Report tables with a row per repository or score; the others are small.
LARGE_REPORTS = ("repo_metrics", "repo_stats", "extension_stats", "file_naming_stats", "roc_points", "vote_pr_curve")
log = logging.getLogger(__name__)


@dataclass
class Config:
    seed: int = 42
    data_type: int = 1
    val_pct: float = 0.20
    test_pct: float = 0.20
    test_class1_ratio: float = 0.25
    data_fraction: float = 1.0
    train_downsample_replace: bool = True
    models: tuple = ("RandomForest", "XGBoost", "VotingClassifier")
    rf_params: dict = field(default_factory=lambda: dict(MD.RF_PARAMS))
    gbt_params: dict = field(default_factory=lambda: dict(MD.GBT_PARAMS))
    search: bool = False
    search_grid: dict = field(default_factory=lambda: dict(MD.SEARCH_GRIDS))
    importance: bool = True
    max_features: int = 12000
    svd_k: int = 50
    max_df: float = 0.7
    fixed_threshold: float | None = None
    importance_rows: int = 2000
    importance_repeats: int = 10
    smote: bool = True
    parallel_fits: int = 2       # fits of folds and search settings that share the cluster at a time
    n_train: int = 193_420       # rows the evaluation's sample sizes derive from (it reads no train split)
    check_sizes: bool = True     # A12; the 0.01 share tolerance needs more than ~50 test rows


# ------------------------------------------------------------------ data

def load(spark: SparkSession, base: str, splits: tuple = SPLITS) -> tuple[dict, dict]:
    """The Parquet splits of both tables (evaluation needs no train)."""
    return read_changes(spark, base, "line", splits), read_changes(spark, base, "jit", splits)


def _row_hash(df: DataFrame, out: str) -> DataFrame:
    """``out`` and ``out``2: 96 bits that name a row by all its columns."""
    return df.withColumn(out, F.xxhash64(*df.columns)).withColumn(out + "2", F.hash(*df.columns))


def labelled_keys(jit: DataFrame, line: DataFrame, split: str = "") -> DataFrame:
    """J1 + P3 on keys: one row per joined pair with its label and the hashes
    of both rows.  A row without a changed-line list has no label; it is an
    error that says how many there are."""
    j = _row_hash(jit, "__jit").select(*KEYS, P.label_from_lines("lines").alias("label"), "__jit", "__jit2")
    l = _row_hash(line.select(*KEYS, "content"), "__line").select(*KEYS, "__line", "__line2")
    pairs = cut_lineage(P.join_diff_full(j, l, carry=["__line", "__line2"]))
    missing = pairs.where(F.col("label").isNull()).count()
    if missing:
        raise ValueError(f"{missing} rows of {split or 'a split'} have no changed-line list")
    return pairs


def attach_texts(chosen: DataFrame, jit: DataFrame, line: DataFrame) -> DataFrame:
    """The chosen pairs with the columns and texts of both tables, decoded."""
    j = _row_hash(jit, "__jit").withColumnRenamed("content", "content_diff")
    l = _row_hash(line.select(*KEYS, "content"), "__line").select(
        "__line", "__line2", F.col("content").alias("content_full"))
    # texts that were not chosen are left before anything is shuffled by text
    j = j.drop(*KEYS).join(chosen.select("__jit", "__jit2").distinct(), ["__jit", "__jit2"], "left_semi")
    l = l.join(chosen.select("__line", "__line2").distinct(), ["__line", "__line2"], "left_semi")
    j = j.dropDuplicates(["__jit", "__jit2"])
    l = l.dropDuplicates(["__line", "__line2"])
    out = chosen.join(j, ["__jit", "__jit2"]).join(l, ["__line", "__line2"])
    out = out.drop("__jit", "__jit2", "__line", "__line2")
    return (out.withColumn("content_diff", P.to_text(out, "content_diff"))
               .withColumn("content_full", P.to_text(out, "content_full")))


def check_sizes(test: DataFrame, val: DataFrame, target_test: int, ratio: float) -> None:
    """Test size within 10 and class-1 share within 0.01; val share 0.5 +- 0.01."""
    t = test.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("m")).first()
    v = val.agg(F.avg("label").alias("m")).first()
    if abs(t["n"] - target_test) > 10 or abs((t["m"] or 0) - ratio) > 0.01:
        raise ValueError(f"test split has {t['n']} rows / class-1 share {t['m']}, expected ~{target_test} / {ratio}")
    if abs((v["m"] or 0) - 0.5) > 0.01:
        raise ValueError("validation split is not balanced (~50/50)")


def sample_splits(keys: dict[str, DataFrame], conf: Config, n_train: int) -> dict[str, DataFrame]:
    """R1-R5 + U1 over labelled keys: sized test and val, balanced train."""
    sizes = SM.target_sizes(n_train, conf.val_pct, conf.test_pct, conf.test_class1_ratio)
    out = {}
    for split in ("test", "val"):
        counts = SM.class_counts(keys[split])
        out[split] = SM.union_all([
            SM.resample(keys[split].where(F.col("label") == c), n, KEYS, None, conf.seed, counts.get(c, 0))
            for c, n in sizes[split].items()])
    out["val"] = SM.fraction_sample(out["val"], conf.data_fraction, KEYS, conf.seed)
    if "train" in keys:
        train = SM.balance_classes(keys["train"], KEYS, "label", conf.train_downsample_replace, conf.seed)
        out["train"] = SM.fraction_sample(train, conf.data_fraction, KEYS, conf.seed)
    if conf.check_sizes:
        check_sizes(out["test"], out["val"], sum(sizes["test"].values()), conf.test_class1_ratio)
    return out


def prepare_splits(line: dict, jit: dict, conf: Config) -> dict[str, DataFrame]:
    """J1 + P3 + R1-R5 + U1 + P4/P5 for the splits given, each row with an id
    ``rid`` (evaluation has no
    train split and takes its sample sizes from ``conf.n_train``)."""
    if conf.data_type not in (0, 1):
        raise ValueError("data_type must be 0 or 1")
    splits = [s for s in ("train", "test", "val") if s in jit]
    chosen = {s: labelled_keys(jit[s], line[s], s) for s in splits}
    if conf.data_type == 1:
        chosen = sample_splits(chosen, conf, chosen["train"].count() if "train" in chosen else conf.n_train)
    return {s: attach_texts(_row_id(d), jit[s], line[s]) for s, d in chosen.items()}


def features(splits: dict[str, DataFrame], keep=("commit", "repo", "filepath", "label")) -> tuple[dict, list]:
    """73-column feature tables; constant columns are decided on train."""
    ft = {s: cut_lineage(feature_table(df, keep=list(keep))) for s, df in splits.items()}
    const = constant_column_names(ft["train"], NUMERIC + CATEGORICAL)
    return ft, const


# ---------------------------------------------------------------- train

def _row_id(df: DataFrame) -> DataFrame:
    """Unique id per chosen key (bootstrap copies included), before any text
    is joined to it."""
    r = SM.exact_rank(df, KEYS, None, out="__rid")
    return r.withColumn("rid", F.col("__rid").cast("string")).drop("__rid")


def _settings(name: str, conf: Config, train_vec: DataFrame, resample) -> dict:
    """The configured settings of a model, with the search's winner over them."""
    kind = MODEL_KINDS[name]
    params = {"rf": conf.rf_params, "gbt": conf.gbt_params}
    params = dict(params) if kind == "vote" else dict(params[kind])
    if conf.search and conf.search_grid.get(name):
        best, _ = MD.random_search(train_vec, kind, conf.search_grid[name], seed=conf.seed, base=params,
                                   resample=resample, at_once=conf.parallel_fits)
        params |= best
    return params


def train(spark: SparkSession, line: dict, jit: dict, conf: Config | None = None,
          output_dir: str | None = None) -> dict:
    """The training flow.  A model that fails ends the run, for want of memory
    too (the reference goes on without it): no scores are given that lack a
    configured model.  Importance that fails gives an empty table."""
    conf = conf or Config()
    splits = {s: cut_lineage(d) for s, d in prepare_splits(line, jit, conf).items()}
    # lineage cut: the ML steps run many small jobs; each would otherwise
    # re-plan the 73-column feature expressions (and recompute them after
    # an executor loss)
    ft, const = features(splits, keep=("rid", "commit", "repo", "filepath", "label"))
    numeric = [c for c in NUMERIC if c not in const]
    cats = [c for c in CATEGORICAL if c not in const]
    vectors = ST.FeatureEstimator(
        idCol="rid", numericCols=numeric, categoricalCols=cats, textCols=[f"{n}={c}" for n, c in TEXT.items()],
        maxFeatures=conf.max_features, k=conf.svd_k, maxDf=conf.max_df,
        keepCols=["label", "repo", "filepath", "commit"]).fit(ft["train"])
    pre = vectors.state
    vec = {s: cut_lineage(vectors.transform(d)) for s, d in ft.items()}
    plain = vec["train"].select("rid", "features", "label")
    resample = None
    if conf.smote:
        from ..operators.smote import smote

        def resample(d):
            return smote(d, "rid", seed=conf.seed).drop("synthetic")
    train_vec = cut_lineage(resample(plain)) if resample else plain
    models, settings, scores, importances = {}, {}, [], {}
    for name in conf.models:
        kind = MODEL_KINDS[name]
        try:
            params = settings[name] = _settings(name, conf, plain, resample)
            members = None
            if kind == "vote" and {"RandomForest", "XGBoost"} <= set(models) and (
                    settings["RandomForest"], settings["XGBoost"]) == (params["rf"], params["gbt"]):
                members = (models["RandomForest"], models["XGBoost"])
            cm = MD.fit_calibrated(train_vec, kind, params, key_cols=["rid"], seed=conf.seed, members=members,
                                   at_once=conf.parallel_fits)
        except Exception as e:
            if out_of_memory(e):
                log.error("%s needs more memory than there is: %s", name, e)
            raise
        cm.preprocessor = pre
        models[name] = cm
        if conf.importance:
            importances[name] = _importance_or_empty(spark, cm, ft["test"], conf, name)
        for split in ("test", "val"):
            p = cm.predict_proba(vec[split]).select("rid", "repo", "filepath", "commit", "label", "p")
            scores.append(p.withColumn("model", F.lit(display_name(name.lower()))).withColumn("split", F.lit(split)))
    long = cut_lineage(SM.union_all(scores))
    reports = make_reports(long, splits, conf)
    for name, imp in importances.items():
        reports[f"feature_importance_{name}"] = imp
        reports[f"feature_importance_top20_{name}"] = RP.top_n(imp, "importance_mean", 20, "feature")
    if output_dir:
        with published_run(spark, output_dir) as (scratch, out):
            write_reports(reports, scratch)
            for name, cm in models.items():
                save_calibrated(spark, cm, join_path(scratch, f"{name.lower()}_pipeline_model"))
        reports["output_dir"] = out
    return {"models": models, "scores": long, "reports": reports, "preprocessor": pre}


def out_of_memory(e: BaseException) -> bool:
    """Is it a lack of memory or an overflow, in Python, the driver's JVM or an
    executor?  Spark hands the latter on as text of the Java error."""
    if isinstance(e, (MemoryError, OverflowError)):
        return True
    return isinstance(e, (Py4JJavaError, PySparkException)) and bool(
        re.search(r"OutOfMemory|java heap space|GC overhead limit|MemoryError|OverflowError", str(e), re.IGNORECASE))


def write_reports(reports: dict, out: str) -> None:
    """Every report table below the run folder."""
    for name, df in reports.items():
        if isinstance(df, DataFrame):
            write_report(df, join_path(out, name), single_file=name not in LARGE_REPORTS)


def _importance_or_empty(spark, cm, test_ft, conf, name) -> DataFrame:
    try:
        return cut_lineage(model_importance(cm, test_ft, conf))
    except Exception as e:  # the reference goes on with an empty table
        log.exception("no permutation importance for %s: %s", name, e)
        return spark.createDataFrame([], "feature string, importance_mean double, importance_std double")


def model_importance(cm: MD.CalibratedModel, test_ft: DataFrame, conf: Config) -> DataFrame:
    """E11 + R6: permutation importance of the raw feature columns on a
    seeded subset of at most ``importance_rows`` test rows, scored with the
    calibrated model's default prediction.  Each raw column is turned into its
    block of features once, and the blocks are permuted, so no text is copied
    or tokenized per repeat."""
    pre = cm.preprocessor
    sample = SM.seeded_subset(test_ft, conf.importance_rows, ["rid"], conf.seed)
    blocks = cut_lineage(pre.blocks(sample, keep=["label"]))
    raw = {b: c for c, b in pre.block_columns().items()}
    imp = MD.permutation_importance(blocks, list(raw), lambda d: cm.predict(pre.assemble(d)), "rid",
                                    conf.importance_repeats, conf.seed)
    names = F.create_map(*[F.lit(x) for kv in raw.items() for x in kv])
    return imp.withColumn("feature", names[F.col("feature")])


def model_reports(long: DataFrame, conf: Config) -> dict[str, DataFrame]:
    """Per model x split: thresholds, reports, confusion, curves, comparisons.
    The scores are scanned once, into their counts."""
    g = ["model", "split"]
    ev = EV.evaluate_scores(long, g, conf.fixed_threshold)
    comp = EV.compare_models(ev["table"], g, conf.fixed_threshold)
    return {
        "all_models_comparison": comp.withColumn("class", EV.display_class("class")),
        "rf_xgb_comparison": EV.only_rf_xgb(comp).withColumn("class", EV.display_class("class")),
        "threshold_metrics": EV.threshold_metrics(ev["table"], g, conf.fixed_threshold),
        "f1_scores": EV.f1_by_model(comp),
        "classification_reports": EV.classification_report(ev["counts"], g),
        "confusion_matrices": EV.confusion_cells(ev["counts"], g),
        "roc_points": EV.roc_points(ev["table"], g),
    }


def vote_reports(vote: DataFrame) -> dict[str, DataFrame]:
    """The vote's own block on test: precision-recall curve, best-F1 threshold
    with report and confusion there, confusion at the default prediction, and
    the distribution of its probabilities."""
    table = cut_lineage(EV.score_counts(vote))
    curve = EV.pr_points(EV.roc_points(table))
    best = cut_lineage(EV.best_f1_threshold(curve))
    row = best.first()
    threshold = row["threshold"] if row else 0.5
    at_best = EV.evaluate_scores(table.withColumn("__all", F.lit(1)), ["__all"], threshold, with_auc=False)
    counts = at_best["counts"].drop("__all")
    return {
        "vote_pr_curve": curve, "vote_best_f1": best,
        "vote_best_f1_report": EV.classification_report(counts),
        "vote_best_f1_confusion": EV.confusion_cells(counts),
        "confusion_matrix": EV.confusion_matrix(EV.default_prediction(vote)),
        "prob_summary": EV.describe(vote), "prob_hist": EV.histogram(vote),
    }


def make_reports(long: DataFrame, splits: dict, conf: Config) -> dict[str, DataFrame]:
    rep = model_reports(long, conf)
    vote = long.where((F.col("model") == "Voting Classifier") & (F.col("split") == "test"))
    scored = EV.default_prediction(vote)
    f1 = RP.repo_f1(scored)
    tr = splits["train"]
    when = C.ensure_timestamp(tr, "datetime")
    texts = splits["test"].select("rid", "content_diff", "content_full")
    errors = scored.where(F.col("label") != F.col("pred")).join(texts, "rid")
    repo_stats, naming = RP.repo_stats(tr, f1), RP.path_length_by_repo(tr)
    if "VotingClassifier" in conf.models:
        rep.update(vote_reports(vote))
        rep.update({"repo_metrics": f1, "false_positives": RP.error_samples(errors, "fp"),
                    "false_negatives": RP.error_samples(errors, "fn")})
    rep.update({
        "repo_stats": repo_stats,
        "repo_stats_top10": RP.top_n(repo_stats, "n_commits", 10, "repo"),
        "extension_stats": RP.extension_share_long(tr),
        "extension_stats_top10": RP.extension_share_wide(tr, 10),
        "file_naming_stats": naming,
        "file_naming_stats_top10": RP.top_n(naming, "avg_filepath_length", 10, "repo"),
        "defects_by_hour": RP.defect_rate_by(tr, C.hour_or_null(when), "commit_hour"),
        "defects_by_day": RP.defect_rate_by(tr, C.weekday_or_null(when), "commit_day"),
    })
    return rep


# -------------------------------------------------------------- save/load

def save_calibrated(spark: SparkSession, cm: MD.CalibratedModel, path: str) -> None:
    """Preprocessing, fold models and sigmoid maps as one ``PipelineModel``,
    on the storage that ``path`` names."""
    ST.as_pipeline(cm).write().session(spark).overwrite().save(path)


def load_calibrated(spark: SparkSession, path: str) -> MD.CalibratedModel:
    """The inverse of ``save_calibrated``."""
    return ST.from_pipeline(PipelineModel.read().session(spark).load(path))


def load_models(spark: SparkSession, models_dir: str) -> dict:
    """Every ``*_pipeline_model`` folder, keyed by display name."""
    names = [d for d in list_folders(spark, models_dir) if d.endswith("_pipeline_model")]
    if not names:
        raise FileNotFoundError(f"no saved models in {models_dir}")
    return {display_name(n): load_calibrated(spark, join_path(models_dir, n)) for n in names}


def evaluate(spark: SparkSession, models_dir: str, line: dict, jit: dict, conf: Config | None = None,
             output_dir: str | None = None) -> dict:
    """The evaluation flow: load models, prepare test and val (no train inputs),
    score, report.  Each distinct preprocessor transforms a split once."""
    conf = conf or Config()
    models = load_models(spark, models_dir)
    wanted = ("test", "val")
    splits = prepare_splits({s: line[s] for s in wanted}, {s: jit[s] for s in wanted}, conf)
    ft = {s: cut_lineage(feature_table(d, keep=["rid", "commit", "repo", "filepath", "label"]))
          for s, d in splits.items()}
    scores = []
    for split, d in ft.items():
        vectors: dict = {}
        for name, cm in models.items():
            state = json.dumps([asdict(cm.preprocessor.numeric), cm.preprocessor.categories,
                                cm.preprocessor.n_docs, [(t.name, t.k) for t in cm.preprocessor.text]], sort_keys=True)
            if state not in vectors:   # models of one training run share it
                vectors[state] = cut_lineage(cm.preprocessor.transform(
                    d, keep=["label", "repo", "filepath", "commit"]))
            p = cm.predict_proba(vectors[state]).select("repo", "filepath", "commit", "label", "p")
            scores.append(p.withColumn("model", F.lit(name)).withColumn("split", F.lit(split)))
    long = cut_lineage(SM.union_all(scores))
    rep = model_reports(long, conf)
    if output_dir:
        with published_run(spark, output_dir) as (scratch, out):
            write_reports(rep, scratch)
        rep["output_dir"] = out
    return {"scores": long, "reports": rep}
