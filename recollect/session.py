"""What a Spark session needs so that the package's Python functions run on its workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Bytes of rows that Spark gives a Python worker at once, in place of its own 64 MB or 10,000 rows.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this machine's files import the package, and bound their batches by bytes.

    A limit of bytes that the session's owner has set stays.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if not spark.conf.get(_BATCH, None):
        spark.conf.set(_BATCH, BATCH_BYTES)
    return spark
