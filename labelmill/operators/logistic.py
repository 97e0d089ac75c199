"""Multinomial logistic regression over hashed words, as a ``pyspark.ml`` pipeline."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from labelmill.functions.text import NON_WORD
from labelmill.operators import evaluate
from labelmill.scratch import materialize

# Training defaults.
ITERATIONS = 8
L2 = 0.01
FEATURES = 1 << 18


def terms(text: str = "text", features: int = FEATURES) -> Pipeline:
    """From ``text`` to the weighted term vector ``_features``."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=NON_WORD, toLowercase=True),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
        ]
    )


def regression(iterations: int = ITERATIONS, l2: float = L2) -> LogisticRegression:
    """Needs ``class_id`` and ``_features``."""
    return LogisticRegression(
        featuresCol="_features",
        labelCol="class_id",
        family="multinomial",
        maxIter=iterations,
        regParam=l2,
        elasticNetParam=0.0,
    )


def pipeline(
    text: str = "text", iterations: int = ITERATIONS, l2: float = L2, features: int = FEATURES
) -> Pipeline:
    """Both in one, for Spark's own tuning classes."""
    return Pipeline(stages=[*terms(text, features).getStages(), regression(iterations, l2)])


def fit_terms(train: DataFrame, **knobs) -> tuple[PipelineModel, DataFrame]:
    """The fitted ``terms``, and the vectors of ``train``, weighted as they are read from a written table of its term counts.

    Each text is split into words once, for the weights and for the vectors.
    """
    *counting, idf = terms(**knobs).getStages()
    counted = materialize(PipelineModel(counting).transform(train).select("class_id", "_tf"), "terms")
    weights = idf.fit(counted)
    return PipelineModel([*counting, weights]), weights.transform(counted).select("class_id", "_features")


def fit(
    train: DataFrame, text: str = "text", iterations: int = ITERATIONS, l2: float = L2, features: int = FEATURES
) -> PipelineModel:
    """Steps are row-wise, so the fitted model also runs on a stream."""
    model, vectors = fit_terms(train, text=text, features=features)
    return PipelineModel([*model.stages, regression(iterations, l2).fit(vectors)])


def probabilities(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``probability`` as a plain array; drops the pipeline's own columns."""
    out = model.transform(df)
    return out.withColumn("probability", vector_to_array("probability")).drop(
        "_words", "_tf", "_features", "rawPrediction", "prediction"
    )


class MacroF1(Evaluator):
    """Macro F1 for ``TrainValidationSplit``; the built-in evaluator only has weighted F1."""

    def __init__(self, label: str = "class_id", prediction: str = "prediction"):
        super().__init__()
        self._label, self._prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        pair = dataset.selectExpr(
            f"cast({self._label} as int) as label", f"cast({self._prediction} as int) as prediction"
        )
        return float(evaluate.metrics(pair).first()["f1_macro"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True
