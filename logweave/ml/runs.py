"""Training runs as folders: configuration, model, predictions and metrics; retraining on a new version (TRN-15)."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans.training_input import choose_training_columns
from ..sources.readers import new_artifact_path
from .models import train_supervised


def train_run(df: DataFrame, config: dict[str, Any], base: str) -> str:
    """Choose the columns, train, and write everything to a fresh folder below ``base``; returns the folder.

    ``config``: ``algorithm``, ``target``, ``rid`` and optionally ``params``, ``context_columns`` and ``selection`` (arguments of
    ``choose_training_columns``).  The folder holds ``config`` (with the chosen columns, their source and lineage),
    ``model``, ``predictions`` and ``metrics``; an earlier run is never touched.
    """
    spark = df.sparkSession
    choice = choose_training_columns(df, target=config["target"], rid=config["rid"], **config.get("selection", {}))
    if not choice["used_feature_columns"]:
        raise ValueError("No usable training columns: " + json.dumps(choice["exclusion_reasons"]))
    model, predictions, metrics = train_supervised(df, choice["used_feature_columns"], config["target"], config["algorithm"],
                                                   config["rid"], config.get("params"), config.get("context_columns"))
    path = new_artifact_path(base, "run")
    if hasattr(model, "write"):
        model.write().save(f"{path}/model")
    else:
        model.save(f"{path}/model")
    predictions.write.parquet(f"{path}/predictions")
    metrics.write.parquet(f"{path}/metrics")
    # last, so that a folder with a configuration is a finished run
    text = json.dumps({"config": config, "choice": choice, "model_class": type(model).__name__})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/config")
    return path


def read_run(spark: SparkSession, path: str) -> dict[str, Any]:
    """The configuration of a finished run: ``config``, ``choice`` and ``model_class``."""
    return json.loads(spark.read.text(f"{path}/config").first().value)


def retrain(df: DataFrame, path: str, base: str) -> str:
    """TRN-15: the configuration of an earlier run on a new version of the dataset, as a new run.

    The columns are chosen anew from the same source, so the facts of the new version decide; the earlier run stays.
    """
    return train_run(df, read_run(df.sparkSession, path)["config"], base)
