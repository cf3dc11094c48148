"""Egress: a view written to a folder that it replaces."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

SCHEMES = ("", "file", "hdfs", "s3a", "viewfs")


class EgressError(RuntimeError):
    pass


def egress(view: DataFrame, url: str | None = None) -> str:
    """Writes the view at ``url``, by default in the session's shared folder; whatever was there goes. Returns the place."""
    if url is None:
        root = view.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="weirflow-")
        url = f"{root.rstrip('/')}/egress-{uuid.uuid4().hex}"
    if urlparse(url).scheme not in SCHEMES:
        raise EgressError(f"egress: unsupported scheme in {url}")
    view.write.mode("overwrite").parquet(url)
    return url


def read_back(spark: SparkSession, url: str) -> DataFrame:
    return spark.read.parquet(url)
