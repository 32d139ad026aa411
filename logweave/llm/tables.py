"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession) -> str:
    """A fresh path below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, short lineage,
    and still there when executors are lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(uri: str):
    """(Arrow file system, path) of a folder in the shared store."""
    from pyarrow import fs
    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", uri))
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
