"""Prepare a session for the operators: the package for its Python workers, and smaller Arrow batches."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import labelmill

#: Spark's own bound is 64 MB a batch, held by the JVM, its off-heap buffers and the worker at once.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package once per application, by Spark's own file distribution.

    Batches of texts are bounded by ``BATCH_BYTES``, unless the session was started with a bound of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _sent:
        if spark.sparkContext.getConf().get(BATCH_SETTING) is None:
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        root = os.path.dirname(os.path.abspath(labelmill.__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="package-"), "labelmill")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
        _sent.add(app)
    return spark
