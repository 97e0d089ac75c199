"""Model folders and the run log."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill import schemas
from labelmill.operators.labels import Classes
from labelmill.operators.naive_bayes import NaiveBayesModel
from labelmill.scratch import table_bytes
from labelmill.sources.publish import Folder, current, publish
from labelmill.sources.samples import CSV_OPTIONS

LOGGED = "logged="


def save_classes(spark: SparkSession, classes: Classes, path: str) -> None:
    classes.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")


def load_classes(spark: SparkSession, path: str) -> Classes:
    rows = spark.read.parquet(f"{path}/classes").collect()
    return Classes(tuple(r["class_name"] for r in sorted(rows, key=lambda r: r["class_id"])))


def save_naive_bayes(model: NaiveBayesModel, path: str) -> None:
    """Three Parquet tables, tokens, priors and classes, published together as one version of ``path``.

    A model may be saved over the folder it was loaded from, and a failure leaves the model before.
    """
    spark = model.tokens.sparkSession

    def write(folder: str) -> None:
        model.tokens.write.parquet(f"{folder}/tokens")
        priors = spark.createDataFrame(list(enumerate(model.log_priors)), "class_id int, log_prior double")
        priors.coalesce(1).write.parquet(f"{folder}/priors")
        save_classes(spark, model.classes, folder)

    publish(spark, path, write)


def save_pipeline(model: PipelineModel, classes: Classes, path: str) -> None:
    """A fitted pipeline, with all its stages hold, and its class names, published together."""
    spark = SparkSession.active()

    def write(folder: str) -> None:
        model.write().save(f"{folder}/pipeline")
        save_classes(spark, classes, folder)

    publish(spark, path, write)


def load_pipeline(spark: SparkSession, path: str) -> tuple[PipelineModel, Classes]:
    folder = current(spark, path)
    return PipelineModel.load(f"{folder}/pipeline"), load_classes(spark, folder)


def load_naive_bayes(spark: SparkSession, path: str) -> NaiveBayesModel:
    path = current(spark, path)
    tokens = spark.read.parquet(f"{path}/tokens")
    priors = spark.read.parquet(f"{path}/priors").collect()
    classes = load_classes(spark, path)
    if len(priors) != len(classes):
        raise ValueError(f"{path}: {len(priors)} priors for {len(classes)} classes")
    return NaiveBayesModel(
        classes,
        tuple(r["log_prior"] for r in sorted(priors, key=lambda r: r["class_id"])),
        tokens,
        table_bytes(tokens),
    )


def log_runs(runs: DataFrame, path: str) -> None:
    """Add ``runs`` to the log: one folder for each call, however many candidates it logs.

    A candidate that is logged again, such as by a retried append, replaces its own rows and no others;
    readers take the rows of the last folder that has it. Folders count up, and two that are
    written at once differ by their random end.
    """
    done = [n.removeprefix(LOGGED) for n in Folder(runs.sparkSession, path).names() if n.startswith(LOGGED)]
    number = max((int(n.split("-")[0]) for n in done), default=0) + 1
    runs.select(*schemas.RUNS.names).write.parquet(f"{path}/{LOGGED}{number:012d}-{uuid.uuid4().hex}")


def append_run(
    spark: SparkSession, path: str, run_id: str, candidate: int, metrics: dict[str, float]
) -> None:
    """Log the metrics of one candidate."""
    rows: Iterable = [(run_id, candidate, m, float(v)) for m, v in metrics.items()]
    log_runs(spark.createDataFrame(list(rows), schemas.RUNS).coalesce(1), path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The log, each (run, candidate) as it was logged last."""
    logged = spark.read.schema(T.StructType([*schemas.RUNS.fields, T.StructField("logged", T.StringType())])).parquet(path)
    last = F.max("logged").over(W.partitionBy("run_id", "candidate"))
    return logged.withColumn("_last", last).where(F.col("logged").eqNullSafe(F.col("_last"))).select(*schemas.RUNS.names)


def write_errors(report: DataFrame, path: str) -> None:
    """Error report as CSV, keeping its order."""
    report.select(*[F.col(f.name) for f in schemas.ERRORS]).write.mode("overwrite").options(
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **CSV_OPTIONS
    ).csv(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ERRORS).options(multiLine=True, **CSV_OPTIONS).csv(path)
