"""Tables that set several models side by side, from a long metric table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxdesk import fixed_values as V


def metrics_long(metrics: DataFrame, key: str = "model") -> DataFrame:
    """Wide metric columns to rows (model, metric, value)."""
    names = [c for c in metrics.columns if c != key]
    return metrics.unpivot(key, names, "metric", "value")


def _value_or_zero(metric: str) -> Column:
    """The metric's value: 0.0 if it has no row, null if its row says null."""
    here = F.col("metric") == metric
    return F.when(F.count_if(here) == 0, F.lit(0.0)).otherwise(F.max(F.when(here, F.col("value"))))


def compare_models(long: DataFrame, metric: str = "accuracy") -> DataFrame:
    return long.groupBy("model").agg(_value_or_zero(metric).alias("value"))


def compare_metrics(long: DataFrame, metrics: list[str] = V.COMPARED_METRICS) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), _value_or_zero(m).alias("value")) for m in metrics]
    )
    return long.groupBy("model").agg(cells.alias("cells")).select("model", F.inline("cells"))


def compare_two(long: DataFrame, first: dict[str, str], second: dict[str, str]) -> DataFrame:
    """Accuracy of two models per task; a missing or null figure is null.

    first and second map a task to the model name that stands for it.
    """
    accuracy = long.where(F.col("metric") == "accuracy")

    def value_of(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("value")))

    cells = F.array(
        *[
            F.struct(
                F.lit(task).alias("task"),
                value_of(first[task]).alias("first"),
                value_of(second[task]).alias("second"),
            )
            for task in first
        ]
    )
    return accuracy.agg(cells.alias("cells")).select(F.inline("cells"))


def results_table(long: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per model, one column per metric, rounded to four decimals."""
    wide = long.groupBy("model").pivot("metric", metrics).agg(F.first("value"))
    return wide.select("model", *[F.round(m, 4).alias(m) for m in metrics])
