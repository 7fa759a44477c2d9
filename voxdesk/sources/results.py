"""Sinks for result tables, fitted models and encoder tables."""

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_results(table: DataFrame, path: str) -> None:
    """One row per model as CSV."""
    table.write.mode("errorifexists").option("header", "true").csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_encoders(
    path: str, token_index: DataFrame, label_maps: dict[str, DataFrame], run: DataFrame
) -> None:
    """Token index and label maps as parquet, run figures as JSON."""
    token_index.write.mode("errorifexists").parquet(os.path.join(path, "token_index"))
    for task, labels in label_maps.items():
        labels.write.mode("errorifexists").parquet(os.path.join(path, "labels", task))
    run.write.mode("errorifexists").json(os.path.join(path, "run"))


def load_encoders(spark: SparkSession, path: str, tasks: list[str]):
    token_index = spark.read.parquet(os.path.join(path, "token_index"))
    labels = {t: spark.read.parquet(os.path.join(path, "labels", t)) for t in tasks}
    return token_index, labels, spark.read.json(os.path.join(path, "run"))
