"""Where a job may keep intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the shared folder the cluster sets in ``spark.checkpoint.dir``,
    or where that is unset, as in tests, under the session's warehouse."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/mcqflow-{uuid.uuid4().hex}"
