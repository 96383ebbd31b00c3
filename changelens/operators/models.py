"""Model layer (F11, F12, L1-L7, E11) on Spark ML.

* ``Preprocessor``: numeric (mean impute, population scale, zero-variance
  drop), categorical one-hot, and per text column TF-IDF + truncated SVD;
  assembled into one vector.  Fitted once and shared by all models.
* Classifiers: random forest, gradient-boosted trees, and their 1:2 soft
  vote; each wrapped in 3-fold sigmoid (Platt) calibration whose fold
  models are averaged.
* Random search by macro-F1 over folds; permutation importance.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_lineage_dealt, run_at_once
from . import preprocess as PP
from . import sampling as SM
from . import text_features as TF
from .evaluation import score_counts
from .forest import fit_balanced_forest

# The reference's model settings.  Spark trees stop at depth
# 30, so an unlimited forest depth maps to MAX_DEPTH.
RF_PARAMS = {"numTrees": 500, "featureSubsetStrategy": "sqrt", "subsamplingRate": 0.9, "maxDepth": 30}
GBT_PARAMS = {"maxIter": 500, "maxDepth": 15, "stepSize": 0.05, "subsamplingRate": 0.8,
              "featureSubsetStrategy": "0.7", "minInfoGain": 0.3}
VOTE_WEIGHTS = (1.0, 2.0)
MAX_DEPTH = 30

# The reference's random-search ranges, under Spark ML names
# (trees/rounds, depth with "unlimited" -> 30, leaf size, column share,
# learning rate, row share, split gain).  Ranges with no Spark counterpart
# (node split size, L2 weight) are left out.
SEARCH_GRIDS = {
    "RandomForest": {"numTrees": [100, 300, 500], "maxDepth": [10, 20, 30],
                     "minInstancesPerNode": [1, 5, 10], "featureSubsetStrategy": ["sqrt", "log2"]},
    "XGBoost": {"maxIter": [100, 300, 500], "stepSize": [0.01, 0.05, 0.1], "maxDepth": [6, 10, 15],
                "subsamplingRate": [0.7, 0.8, 1.0], "featureSubsetStrategy": ["0.7", "0.8", "1.0"],
                "minInfoGain": [0.0, 0.1, 0.3]},
    "VotingClassifier": {"voting": ["hard", "soft"], "weights": [(1, 1), (2, 1), (1, 2)]},
}


# --------------------------------------------------------------- features

@dataclass
class TextBranch:
    name: str
    column: str
    vocab: DataFrame
    comps: DataFrame
    k: int


@dataclass
class Preprocessor:
    id_col: str
    numeric: PP.NumericPrep
    categories: dict = field(default_factory=dict)
    text: list = field(default_factory=list)
    n_docs: int = 0          # training corpus size: the idf is fitted state

    @staticmethod
    def fit(df: DataFrame, id_col: str, numeric: list[str], categorical: list[str],
            text: dict[str, str] | None = None, max_features: int = 12000, k: int = 50,
            max_df: float = 0.7) -> "Preprocessor":
        num = PP.NumericPrep.fit(df, numeric)
        cats = {c: PP.one_hot_fit(df, c) for c in categorical}
        branches = []
        n_docs = df.count()
        for name, col in (text or {}).items():
            # texts are tokenized once; grams, several times the texts, are made anew from the tokens
            grams = TF.token_grams(cut_lineage_dealt(TF.doc_tokens(df, id_col, col)), id_col)
            vocab = cut_lineage(TF.vocabulary(TF.frequent_stats(grams, id_col, n_docs, max_features, 1, max_df),
                                              n_docs, max_features, 1, max_df))
            n_terms = vocab.count()
            if n_terms < 2:
                continue
            w = TF.tfidf(TF.term_counts(grams, id_col, vocab), vocab, id_col, n_docs)
            kk = max(1, min(k, n_terms - 1, n_docs - 1))
            comps = TF.svd_components(w, id_col, n_terms, kk)
            branches.append(TextBranch(name, col, vocab, comps, kk))
        return Preprocessor(id_col, num, cats, branches, n_docs)

    def feature_names(self) -> list[str]:
        """kept numeric names, one-hot names, text component names."""
        names = list(self.numeric.kept)
        for c, cats in self.categories.items():
            names += [f"{c}_{v}" for v in cats]
        for b in self.text:
            names += [f"{b.name}_component_{i + 1}" for i in range(b.k)]
        return names

    def blocks(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """One column per raw column it is made of: a scaled number, a one-hot
        array, or an array of text components.  Each text is read once."""
        cols = [F.col(self.id_col)] + [F.col(c) for c in keep or [] if c != self.id_col]
        cols += [self.numeric.scale(c).alias(f"b_{c}") for c in self.numeric.kept]
        cols += [PP.one_hot_vector(c, cats).alias(f"b_{c}") for c, cats in self.categories.items()]
        base = df.select(*cols)
        for b in self.text:
            tf = TF.term_counts(TF.doc_grams(df, self.id_col, b.column), self.id_col, b.vocab)
            w = TF.tfidf(tf, b.vocab, self.id_col, self.n_docs)
            base = base.join(TF.svd_project(w, b.comps, self.id_col, b.k, f"b_{b.column}"), self.id_col, "left")
            nothing = F.array_repeat(F.lit(0.0), b.k)            # a text with no kept term
            base = base.withColumn(f"b_{b.column}", F.coalesce(f"b_{b.column}", nothing))
        return base

    def block_columns(self) -> dict[str, str]:
        """Raw column -> its block column."""
        return {c: f"b_{c}" for c in [*self.numeric.kept, *self.categories, *(b.column for b in self.text)]}

    def assemble(self, blocks: DataFrame, out: str = "features") -> DataFrame:
        """the blocks side by side as one vector, in feature-name order; the
        names are the vector's ML attributes (see ``named_places``)."""
        parts = [F.array(*[F.col(f"b_{c}") for c in self.numeric.kept])] if self.numeric.kept else []
        parts += [F.col(f"b_{c}") for c in [*self.categories, *(b.column for b in self.text)]]
        drop = [f"b_{c}" for c in [*self.numeric.kept, *self.categories, *(b.column for b in self.text)]]
        names = self.feature_names()
        attributes = {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]},
                                  "num_attrs": len(names)}}
        return blocks.withColumn(out, array_to_vector(F.concat(*parts))).drop(*drop).withMetadata(out, attributes)

    def transform(self, df: DataFrame, out: str = "features", keep: list[str] | None = None) -> DataFrame:
        return self.assemble(self.blocks(df, keep), out)


def named_places(df: DataFrame, features: str = "features") -> list[str]:
    """the names in a vector column's ML attributes, in order of place;
    ``feature_<i>`` for a place without a name, and no names at all if the column
    has no attributes."""
    attributes = df.schema[features].metadata.get("ml_attr", {})
    found = {a["idx"]: a.get("name") for group in attributes.get("attrs", {}).values() for a in group}
    size = attributes.get("num_attrs", max(found, default=-1) + 1)
    return [found.get(i) or f"feature_{i}" for i in range(size)]


# ------------------------------------------------------------ classifiers

def class_weights(df: DataFrame, label: str = "label") -> dict:
    """'balanced' weights n / (2 n_c), computed once over the training set."""
    counts = SM.class_counts(df, label)
    n = sum(counts.values())
    return {k: n / (len(counts) * v) for k, v in counts.items()}


def _weighted(df: DataFrame, weights: dict, label: str = "label") -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return df.withColumn("__w", m[F.col(label)].cast("double"))


def make_estimator(kind: str, params: dict | None = None, seed: int = SM.SEED, label: str = "label"):
    p = dict(params or {})
    if kind == "rf":
        p.setdefault("maxDepth", MAX_DEPTH)
        return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="__w", seed=seed, **p)
    if kind == "gbt":
        return GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **p)
    raise ValueError(kind)


def p1(prob_col: str = "probability") -> Column:
    """Probability of class 1."""
    return vector_to_array(F.col(prob_col)).getItem(1)


@dataclass
class FittedScorer:
    """One uncalibrated scorer: a tree model, or the weighted vote of two
    (of their probabilities, or of their classes when ``hard``)."""
    models: list
    weights: tuple
    hard: bool = False

    def score(self, df: DataFrame, out: str = "s") -> DataFrame:
        d = df
        tmp = []
        for i, m in enumerate(self.models):
            t = f"__ms{i}_{out}"
            d = m.setProbabilityCol(f"__p{i}").setRawPredictionCol(f"__r{i}").setPredictionCol(f"__y{i}").transform(d)
            own = (p1(f"__p{i}") > 0.5).cast("double") if self.hard else p1(f"__p{i}")
            d = d.withColumn(t, F.lit(float(self.weights[i])) * own).drop(f"__p{i}", f"__r{i}", f"__y{i}")
            tmp.append(t)
        total = sum(self.weights)
        d = d.withColumn(out, sum((F.col(t) for t in tmp), F.lit(0.0)) / F.lit(total))
        return d.drop(*tmp)


def fit_scorer(train: DataFrame, kind: str, params: dict | None, seed: int, label: str = "label",
               key_cols: list[str] | None = None) -> FittedScorer:
    """``classWeight`` among a forest's settings: ``balanced`` (weights of the whole
    training set, the default) or ``balanced_subsample`` (of each tree's own
    bootstrap, drawn by ``key_cols``; a fit per tree)."""
    tw = _weighted(train, class_weights(train, label), label)

    def one(kind, params):
        p = dict(params or {})
        how = p.pop("classWeight", "balanced")
        if how not in ("balanced", "balanced_subsample"):
            raise ValueError(f"classWeight: {how}")
        if kind == "rf" and how == "balanced_subsample":
            return fit_balanced_forest(train, {"maxDepth": MAX_DEPTH, **p}, key_cols, seed, label)
        return make_estimator(kind, p, seed, label).fit(tw)
    if kind == "vote":
        p = params or {}
        return vote_of(one("rf", p.get("rf")), one("gbt", p.get("gbt")), p)
    return FittedScorer([one(kind, params)], (1.0,))


def vote_of(rf, gbt, params: dict) -> FittedScorer:
    """L3: the vote of two fitted models, with the settings' weights."""
    return FittedScorer([rf, gbt], tuple(params.get("weights", VOTE_WEIGHTS)), params.get("voting") == "hard")


@dataclass
class CalibratedModel:
    """L4: fold scorers with their sigmoid maps; probabilities averaged."""
    parts: list          # [(FittedScorer, a, b)]
    preprocessor: Preprocessor | None = None

    def predict_proba(self, vec: DataFrame, out: str = "p") -> DataFrame:
        d = vec
        cols = []
        for i, (sc, a, b) in enumerate(self.parts):
            d = sc.score(d, f"__s{i}")
            cols.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col(f"__s{i}") + F.lit(b)))))
        d = d.withColumn(out, sum(cols, F.lit(0.0)) / F.lit(float(len(cols))))
        return d.drop(*[f"__s{i}" for i in range(len(self.parts))])

    def predict(self, vec: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Class by arg-max of the two probabilities: p = 0.5 -> class 0."""
        d = self.predict_proba(vec)
        return d.withColumn("pred", (F.col("p") > F.lit(threshold)).cast("int"))


def platt(scored: DataFrame, label: str = "label", s: str = "s", tolerance: float = 1e-12,
          limit: int = 100) -> tuple[float, float]:
    """Sigmoid calibration p = 1 / (1 + exp(-(a s + b))) to the prior-corrected
    soft targets t+ = (N+ + 1)/(N+ + 2), t- = 1/(N- + 2), without a penalty.

    Scores are scanned once, into their rows per class.  On these counts Newton's
    method starts at a = 0 and the log odds of the classes; a step is one
    aggregate, halved while it does not lower the loss; it ends when the mean
    gradient is at most ``tolerance`` or no step lowers the loss any more.
    NULL and NaN scores and labels other than 0 and 1 are left out; equal scores
    give a = 0, no rows (0, 0)."""
    counts = score_counts(scored, label=label, p=s).where(F.col("pos") + F.col("zero") > 0)
    counts = cut_lineage(counts.select(F.col(s).alias("x"), "pos", "zero"))
    n = counts.agg(F.sum("pos").alias("pos"), F.sum("zero").alias("zero"), F.min("x").alias("low"),
                   F.max("x").alias("high")).first()
    if n["pos"] is None:
        return 0.0, 0.0
    high, low = (n["pos"] + 1.0) / (n["pos"] + 2.0), 1.0 / (n["zero"] + 2.0)
    total = float(n["pos"] + n["zero"])
    start = math.log((n["pos"] + 1.0) / (n["zero"] + 1.0))

    def at(a: float, b: float):
        z = F.lit(a) * F.col("x") + F.lit(b)
        rows = (F.col("pos") + F.col("zero")).cast("double")
        target = F.col("pos") * F.lit(high) + F.col("zero") * F.lit(low)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))       # log(1 + exp(z))
        miss, spread_ = rows * p - target, rows * p * (F.lit(1.0) - p)
        sums = (rows * soft - target * z, miss * F.col("x"), miss, spread_ * F.col("x") * F.col("x"),
                spread_ * F.col("x"), spread_)
        return [v / total for v in counts.agg(*[F.sum(v).alias(f"v{i}") for i, v in enumerate(sums)]).first()]

    a, b = 0.0, start
    now = at(a, b)
    for _ in range(limit):
        loss, ga, gb, haa, hab, hbb = now
        alike = n["low"] == n["high"]                    # then only b can be told
        if max(0.0 if alike else abs(ga), abs(gb)) <= tolerance:
            break
        if alike:
            da, db = 0.0, -gb / hbb
        else:
            det = haa * hbb - hab * hab
            da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        step, slope = 1.0, ga * da + gb * db
        while True:
            then = at(a + step * da, b + step * db)
            if then[0] <= loss + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if then[0] >= loss:                              # as low as doubles can tell
            if max(abs(then[1]), abs(then[2])) < max(abs(ga), abs(gb)):
                a, b = a + step * da, b + step * db
            break
        a, b, now = a + step * da, b + step * db, then
    return a, b


def fit_calibrated(vec: DataFrame, kind: str, params: dict | None = None, folds: int = 3,
                   key_cols: list[str] | None = None, seed: int = SM.SEED, label: str = "label",
                   members: tuple[CalibratedModel, CalibratedModel] | None = None,
                   at_once: int = 1) -> CalibratedModel:
    """L4: fit on two folds, calibrate on the third, three times; up to
    ``at_once`` folds at a time.

    ``members``: a forest and boosted trees fitted on the same rows, folds and
    settings; a vote then takes their fold models instead of fitting them again."""
    key_cols = key_cols or ["__rid"]
    f = cut_lineage(SM.stratified_folds(vec, key_cols, folds, label, seed))

    def fold(k):
        if kind == "vote" and members:
            sc = vote_of(*(m.parts[k][0].models[0] for m in members), params or {})
        else:
            sc = fit_scorer(f.where(F.col("fold") != k), kind, params, seed, label, key_cols)
        return (sc, *platt(sc.score(f.where(F.col("fold") == k)), label))
    return CalibratedModel(run_at_once(vec.sparkSession, [lambda k=k: fold(k) for k in range(folds)], at_once))


# ---------------------------------------------------------------- search

def draw_settings(grid: dict, n: int, seed: int = SM.SEED) -> list[dict]:
    """Up to ``n`` different settings drawn from a grid."""
    rnd, names, total, out = random.Random(seed), sorted(grid), 1, []
    for name in names:
        total *= len(grid[name])
    while len(out) < min(n, total):
        one = {name: rnd.choice(grid[name]) for name in names}
        if one not in out:
            out.append(one)
    return out


def random_search(vec: DataFrame, kind: str, grid: dict, n_candidates: int = 8, folds: int = 2,
                  seed: int = SM.SEED, label: str = "label", base: dict | None = None,
                  key_cols: list[str] | None = None, resample=None, at_once: int = 1) -> tuple[dict, float]:
    """``n_candidates`` settings drawn from ``grid``, laid over the ``base``
    settings the model will be fitted with, each scored by macro-F1 over
    ``folds`` md5 folds; returns the best setting and its score (the first of
    ties).  ``resample`` (such as SMOTE) is applied to the training part of each
    fold only, so no synthetic row is ever scored.  Folds are kept once, and up
    to ``at_once`` settings are fitted on them at a time; the winner does not
    depend on it."""
    key_cols = key_cols or ["rid"]
    f = cut_lineage(SM.stratified_folds(vec, key_cols, folds, label, seed))
    settings = draw_settings(grid, n_candidates, seed)
    totals = [0.0] * len(settings)
    for k in range(folds):
        part = f.where(F.col("fold") != k).drop("fold")
        part = cut_lineage(resample(part)) if resample else part
        held = f.where(F.col("fold") == k)
        # the members of a vote don't depend on what is searched
        fitted = fit_scorer(part, kind, base, seed, label, key_cols) if kind == "vote" else None

        def score(one, part=part, held=held, fitted=fitted):
            params = {**(base or {}), **one}
            sc = vote_of(*fitted.models, params) if fitted else fit_scorer(part, kind, params, seed, label,
                                                                                     key_cols)
            pred = sc.score(held).withColumn("pred", (F.col("s") > 0.5).cast("int"))
            return _macro_f1_by(pred, [], label).first()["f1"]
        for i, f1 in enumerate(run_at_once(vec.sparkSession, [lambda one=one: score(one) for one in settings], at_once)):
            totals[i] += f1
    best = max(range(len(settings)), key=lambda i: (totals[i], -i))
    return settings[best], totals[best] / folds


# ---------------------------------------------------------- importance

def permuted_copies(sample: DataFrame, columns: list[str], id_col: str, n_repeats: int = 10,
                    seed: int = SM.SEED) -> DataFrame:
    """A copy of ``sample`` per (``__col``, ``__rep``) in which that one column
    is permuted: within a copy (at most |sample| rows, a bounded window) the
    rows get a seeded order whose rank names the donor row, and one join brings
    the donors' values."""
    ranked = SM.exact_rank(sample, [id_col], None, seed, out="__r0")
    tags = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for c in columns for r in range(n_repeats)])
    copies = ranked.select("*", F.explode(tags).alias("__t")).select(
        "*", F.col("__t.c").alias("__col"), F.col("__t.r").alias("__rep")).drop("__t")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__col"), F.col("__rep").cast("string"),
                            F.col(id_col).cast("string")))
    w = Window.partitionBy("__col", "__rep").orderBy(key, F.col(id_col))
    copies = copies.withColumn("__donor", F.row_number().over(w) - 1)
    donors = ranked.select(F.col("__r0").alias("__donor"), *[F.col(c).alias(f"__d_{c}") for c in columns])
    j = copies.join(donors, "__donor")
    for c in columns:
        j = j.withColumn(c, F.when(F.col("__col") == c, F.col(f"__d_{c}")).otherwise(F.col(c)))
    return j.drop("__donor", "__r0", *[f"__d_{c}" for c in columns])


def permutation_importance(sample: DataFrame, columns: list[str], score_fn, id_col: str, n_repeats: int = 10,
                           seed: int = SM.SEED, label: str = "label") -> DataFrame:
    """Macro-F1 drop when one column is shuffled, ``n_repeats`` times per
    column; mean and population std of the drops.  All copies are scored by a
    single ``score_fn`` call (which must return an int ``pred`` and keep
    ``__col``/``__rep``) and grouped per copy."""
    base_f1 = _macro_f1_by(score_fn(sample), [], label).first()["f1"]
    j = permuted_copies(sample, columns, id_col, n_repeats, seed)
    j = j.withColumn(id_col, F.concat_ws("#", F.col(id_col).cast("string"), F.col("__col"),
                                         F.col("__rep").cast("string")))
    per = _macro_f1_by(score_fn(j), ["__col", "__rep"], label)
    drop = per.withColumn("drop", F.lit(base_f1) - F.col("f1"))
    return drop.groupBy(F.col("__col").alias("feature")).agg(F.avg("drop").alias("importance_mean"),
                                                             F.stddev_pop("drop").alias("importance_std"))


def _macro_f1_by(scored: DataFrame, g: list[str], label: str) -> DataFrame:
    y, yh = F.col(label), F.col("pred")
    a = scored.groupBy(*g).agg(*[F.sum(c.cast("long")).alias(n) for n, c in (
        ("tp", (y == 1) & (yh == 1)), ("fp", (y == 0) & (yh == 1)),
        ("fn", (y == 1) & (yh == 0)), ("tn", (y == 0) & (yh == 0)))])

    def f1(t, a_, b_):
        den = 2 * F.col(t) + F.col(a_) + F.col(b_)
        return F.when(den == 0, F.lit(0.0)).otherwise(2.0 * F.col(t) / den)
    return a.select(*g, ((f1("tp", "fp", "fn") + f1("tn", "fn", "fp")) / 2).alias("f1"))
