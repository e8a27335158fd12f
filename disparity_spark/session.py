"""Sessions, table loading and shipping the package to executors."""

from __future__ import annotations

import importlib.util
import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, or that every plan of ours profits from.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("disparity_spark")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per context, for jobs that weren't submitted with it installed."""
    context = spark.sparkContext
    if getattr(context, "_disparity_spark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(importlib.util.find_spec("disparity_spark").origin))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.join("disparity_spark", os.path.relpath(path, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="disparity-spark-"), "disparity_spark.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(path)
    context._disparity_spark_shipped = True
