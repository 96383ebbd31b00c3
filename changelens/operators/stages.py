"""The model layer as Spark ML stages.

``FeatureEstimator`` and ``CalibratedClassifier`` are estimators over the
functions of ``models``; a ``Pipeline`` of the two fits one ``PipelineModel``
of a ``FeatureModel`` and a ``CalibratedClassifierModel``.  SMOTE runs inside
the classifier's fit, so a fitted pipeline holds no resampling step and scores
the rows it is given, no others.  All four are written and read by Spark ML's own
``save`` and ``load``, on the storage that the path names; a load needs this
package, and nothing else, to be importable.

Defined cases: an empty table is scored to an empty table; a NULL number takes
the training mean, a NULL or unseen category or a text without a known term
gives zeros; rows of equal ids are not supported where there are texts, as
components are joined by id; columns that are not listed in ``keepCols`` are
left out of the vector table (an empty list keeps all).
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml import classification as ML
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import models as MD
from . import sampling as SM
from .preprocess import NumericPrep
from .smote import smote


def _join(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


class _FeatureParams(Params):
    idCol = Param(Params._dummy(), "idCol", "unique id of a row", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    keepCols = Param(Params._dummy(), "keepCols", "columns kept beside the vector; none listed: all",
                     TypeConverters.toListString)

    def _kept(self, df: DataFrame) -> list[str]:
        return self.getOrDefault(self.keepCols) or df.columns


class FeatureEstimator(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits imputation, scaling, variance filter, one-hot lists, vocabularies and
    text components; see ``models.Preprocessor``.  ``textCols`` are given as
    ``name=column``, the name being the prefix of its components."""
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical columns", TypeConverters.toListString)
    textCols = Param(Params._dummy(), "textCols", "text branches, name=column", TypeConverters.toListString)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms of a vocabulary", TypeConverters.toInt)
    k = Param(Params._dummy(), "k", "components of a text", TypeConverters.toInt)
    maxDf = Param(Params._dummy(), "maxDf", "largest share of documents with a term", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, idCol="rid", outputCol="features", keepCols=(), numericCols=(), categoricalCols=(),
                 textCols=(), maxFeatures=12000, k=50, maxDf=0.7):
        super().__init__()
        self._setDefault(idCol="rid", outputCol="features", keepCols=[], numericCols=[], categoricalCols=[],
                         textCols=[], maxFeatures=12000, k=50, maxDf=0.7)
        self._set(**{name: list(v) if isinstance(v, tuple) else v for name, v in self._input_kwargs.items()})

    def _fit(self, df: DataFrame) -> "FeatureModel":
        get = self.getOrDefault
        pre = MD.Preprocessor.fit(df, get(self.idCol), get(self.numericCols), get(self.categoricalCols),
                                  dict(t.split("=", 1) for t in get(self.textCols)), get(self.maxFeatures),
                                  get(self.k), get(self.maxDf))
        return self._copyValues(FeatureModel(pre))


class FeatureModel(Model, _FeatureParams, MLReadable, MLWritable):
    """Rows to vectors, with the feature names as the vector's ML attributes."""

    def __init__(self, state: MD.Preprocessor):
        super().__init__()
        self._setDefault(idCol=state.id_col, outputCol="features", keepCols=[])
        self.state = state

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.state.transform(df, self.getOrDefault(self.outputCol), self._kept(df))

    def write(self) -> MLWriter:
        return _FeatureWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FeatureReader()


class _FeatureWriter(MLWriter):
    def __init__(self, stage: FeatureModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        pre = self.stage.state
        kept = {"numeric": asdict(pre.numeric), "categories": pre.categories, "n_docs": pre.n_docs,
                "id_col": pre.id_col, "text": [{"name": t.name, "column": t.column, "k": t.k} for t in pre.text]}
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"state": kept})
        for t in pre.text:
            t.vocab.write.parquet(_join(path, f"{t.name}_vocab"))
            t.comps.write.parquet(_join(path, f"{t.name}_comps"))


class _FeatureReader(MLReader):
    def load(self, path: str) -> FeatureModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        kept, read = meta["state"], self.sparkSession.read
        text = [MD.TextBranch(t["name"], t["column"], read.parquet(_join(path, f"{t['name']}_vocab")),
                              read.parquet(_join(path, f"{t['name']}_comps")), t["k"]) for t in kept["text"]]
        stage = FeatureModel(MD.Preprocessor(kept["id_col"], NumericPrep(**kept["numeric"]), kept["categories"], text,
                                             kept["n_docs"]))
        return _restored(stage, meta)


def _restored(stage, meta: dict):
    stage._resetUid(meta["uid"])
    DefaultParamsReader.getAndSetParams(stage, meta)
    return stage


class _ScoreParams(Params):
    probabilityCol = Param(Params._dummy(), "probabilityCol", "probability of class 1", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "class", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "class 1 lies above it", TypeConverters.toFloat)


class CalibratedClassifier(Estimator, _ScoreParams, DefaultParamsReadable, DefaultParamsWritable):
    """L4: fits ``kind`` (``rf``, ``gbt`` or ``vote``) with the estimator settings
    given as JSON, in ``folds`` folds by the md5 of ``idCol``, and calibrates each
    on its held-out fold.  With ``oversample`` the training rows are first brought
    to parity by SMOTE."""
    idCol = Param(Params._dummy(), "idCol", "unique id of a row", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0 or 1", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "rf, gbt or vote", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "estimator settings as JSON", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "calibration folds", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of folds, draws and trees", TypeConverters.toInt)
    oversample = Param(Params._dummy(), "oversample", "SMOTE before the fit", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, kind="rf", settings="{}", idCol="rid", labelCol="label", folds=3, seed=SM.SEED,
                 oversample=False, probabilityCol="p", predictionCol="pred", threshold=0.5):
        super().__init__()
        self._setDefault(kind="rf", settings="{}", idCol="rid", labelCol="label", folds=3, seed=SM.SEED,
                         oversample=False, probabilityCol="p", predictionCol="pred", threshold=0.5)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "CalibratedClassifierModel":
        get = self.getOrDefault
        key = get(self.idCol)
        vec = df.select(key, "features", F.col(get(self.labelCol)).alias("label"))
        if get(self.oversample):
            vec = cut_lineage(smote(vec, key, seed=get(self.seed)).drop("synthetic"))
        fitted = MD.fit_calibrated(vec, get(self.kind), json.loads(get(self.settings)) or None, get(self.folds), [key],
                                   get(self.seed))
        return self._copyValues(CalibratedClassifierModel(fitted))


class CalibratedClassifierModel(Model, _ScoreParams, MLReadable, MLWritable):
    """Adds the averaged calibrated probability and the class."""

    def __init__(self, state: MD.CalibratedModel):
        super().__init__()
        self._setDefault(probabilityCol="p", predictionCol="pred", threshold=0.5)
        self.state = state

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.getOrDefault(self.probabilityCol)
        above = F.col(p) > F.lit(self.getOrDefault(self.threshold))
        return self.state.predict_proba(df, p).withColumn(self.getOrDefault(self.predictionCol), above.cast("int"))

    def write(self) -> MLWriter:
        return _CalibratedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CalibratedReader()


class _CalibratedWriter(MLWriter):
    def __init__(self, stage: CalibratedClassifierModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        parts = []
        for i, (scorer, a, b) in enumerate(self.stage.state.parts):
            models = [(type(m).__name__, f"fold{i}_model{j}") for j, m in enumerate(scorer.models)]
            for m, (_, name) in zip(scorer.models, models):
                m.write().session(self.sparkSession).save(_join(path, name))
            parts.append({"models": models, "weights": list(scorer.weights), "hard": scorer.hard, "a": a, "b": b})
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"parts": parts})


class _CalibratedReader(MLReader):
    def load(self, path: str) -> CalibratedClassifierModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = [(MD.FittedScorer([getattr(ML, cls).load(_join(path, name)) for cls, name in p["models"]],
                                  tuple(p["weights"]), p["hard"]), p["a"], p["b"]) for p in meta["parts"]]
        return _restored(CalibratedClassifierModel(MD.CalibratedModel(parts)), meta)


def as_pipeline(model: MD.CalibratedModel) -> PipelineModel:
    """A calibrated model, with its preprocessor if it has one, as one pipeline."""
    first = [FeatureModel(model.preprocessor)] if model.preprocessor is not None else []
    return PipelineModel([*first, CalibratedClassifierModel(model)])


def from_pipeline(pipeline: PipelineModel) -> MD.CalibratedModel:
    """The inverse of ``as_pipeline``."""
    *first, last = pipeline.stages
    return MD.CalibratedModel(last.state.parts, first[0].state if first else None)
