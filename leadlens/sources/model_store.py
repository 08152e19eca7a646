"""Model packages: fitted PipelineModels, each published with its name and feature names by a
numbered state, so a reader never gets the pipeline of one save with the names of another."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from leadlens.sources.numbered import complete, publish


def save_model(spark: SparkSession, model: PipelineModel, path: str, name: str, features: list[str]) -> int:
    """Save a package as the next version of ``path`` and return its number; older ones stay."""
    base = path.rstrip("/")
    folder = f"v-{uuid.uuid4().hex}"
    model.save(f"{base}/{folder}")
    return publish(spark.createDataFrame([(name, features, folder)], "model_name string, feature_names array<string>, folder string"),
                   f"{base}/_state")


def model_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the packages saved under ``path``, ascending."""
    return complete(spark, f"{path.rstrip('/')}/_state")


def load_model(spark: SparkSession, path: str, version: int | None = None):
    """(PipelineModel, model name, feature names) of a version, the newest by default;
    FileNotFoundError when absent, other errors as they are."""
    base, numbers = path.rstrip("/"), model_versions(spark, path)
    if not numbers or (version is not None and version not in numbers):
        raise FileNotFoundError(f"no model package at {path}" + ("" if version is None else f", version {version}"))
    meta = spark.read.parquet(f"{base}/_state/{numbers[-1] if version is None else version}").first()
    return PipelineModel.load(f"{base}/{meta['folder']}"), meta["model_name"], list(meta["feature_names"])
