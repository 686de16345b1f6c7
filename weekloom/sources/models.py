"""Saved topic models with their metadata."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

META = "filename string, created_at string, model_type string, classes array<int>, notes string"


def save_model(
    model: PipelineModel, path: str, *, classes: list[int], created_at: str, notes: str = ""
) -> None:
    """Model under ``path/model``, its description under ``path/meta``."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    kinds = ", ".join(type(s).__name__ for s in model.stages)
    row = (path.rstrip("/").rsplit("/", 1)[-1], created_at, f"PipelineModel({kinds})", classes, notes)
    spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """(model, metadata); raises if there is no model at ``path``."""
    meta = spark.read.schema(META).json(f"{path}/meta").first()
    if meta is None:
        raise FileNotFoundError(f"no model at {path}")
    return PipelineModel.load(f"{path}/model"), meta.asDict()


def model_name(spark: SparkSession, prefix: str = "topic_clf_v1") -> str:
    """A file name with the current UTC time."""
    now = spark.range(1).select(
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
    )
    return f"{prefix}_{now.first()[0]}"
