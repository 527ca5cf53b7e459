"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master may do without one (tests): executors do not share other folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {spark.sparkContext.master} share")
        root = tempfile.mkdtemp(prefix="skyfix-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root
