"""All registered queries and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxdesk.plans import (
    corpus_queries,
    evaluation_queries,
    feature_queries,
    model_queries,
    response_queries,
    sampling_queries,
    text_queries,
)
from voxdesk.plans.views import Tables

_MODULES = [
    text_queries,
    corpus_queries,
    evaluation_queries,
    sampling_queries,
    response_queries,
    feature_queries,
    model_queries,
]


def _on_folder(query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(Tables(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _on_folder(q) for module in _MODULES for key, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: text for module in _MODULES for key, text in module.ORACLE.items()}
