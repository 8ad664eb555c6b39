"""Models and scalers on disk: a folder with one Parquet row, the kind and its numbers as JSON."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from ..operators.linear import LogisticModel
from ..operators.residual import Network

Scaler = dict[str, tuple[float, float]]


def save_model(spark: SparkSession, model: LogisticModel | Network | Scaler, path: str) -> None:
    """Replaces what is at path. A scaler is a median (or mean) and a spread for each feature."""
    if isinstance(model, LogisticModel):
        kind, held = "logistic", dict(vars(model))
    elif isinstance(model, Network):
        weights = {k: {"shape": list(v.shape), "values": v.ravel().tolist()} for k, v in model.weights.items()}
        kind, held = "network", vars(model) | {"weights": weights}
    elif isinstance(model, dict):
        kind, held = "scaler", {k: list(map(float, v)) for k, v in model.items()}
    else:
        raise TypeError(f"no model: {type(model).__name__}")
    spark.createDataFrame([(kind, json.dumps(held))], "kind string, model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> LogisticModel | Network | Scaler:
    row = spark.read.schema("kind string, model string").parquet(path).first()
    held = json.loads(row.model)
    if row.kind == "logistic":
        return LogisticModel(**held)
    if row.kind == "network":
        weights = {k: np.array(v["values"]).reshape(v["shape"]) for k, v in held["weights"].items()}
        return Network(held["columns"], weights, [tuple(x) for x in held["losses"]], held["best_epoch"])
    return {k: tuple(v) for k, v in held.items()}
