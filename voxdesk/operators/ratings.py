"""Human ratings: validation, mean, distribution and summary."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxdesk import fixed_values as V

_STEPS = range(V.RATING_MIN, V.RATING_MAX + 1)


def _in_scale() -> Column:
    return F.coalesce(F.col("rating").between(V.RATING_MIN, V.RATING_MAX), F.lit(False))


def ratings_valid(df: DataFrame) -> DataFrame:
    return df.where(_in_scale())


def ratings_rejected(df: DataFrame) -> DataFrame:
    reason = f"Rating must be between {V.RATING_MIN} and {V.RATING_MAX}"
    return df.where(~_in_scale()).withColumn("reason", F.lit(reason))


def _mean() -> Column:
    return F.coalesce(F.avg("rating"), F.lit(0.0))


def rating_mean(df: DataFrame) -> DataFrame:
    return df.agg(_mean().alias("mean_rating"))


def _per_step() -> Column:
    return F.array(
        *[
            F.struct(F.lit(r).alias("rating"), F.count_if(F.col("rating") == r).alias("count"))
            for r in _STEPS
        ]
    )


def rating_distribution(df: DataFrame) -> DataFrame:
    """Counts of every rating on the scale, zeros included, in one aggregate."""
    return df.agg(_per_step().alias("steps")).select(F.inline("steps"))


def rating_summary(df: DataFrame) -> DataFrame:
    """Total, mean and percent per rating."""
    rows = df.agg(
        F.count("*").alias("total"), _mean().alias("mean_rating"), _per_step().alias("steps")
    ).select("total", "mean_rating", F.inline("steps"))
    percent = F.coalesce(
        F.try_divide(F.col("count") * F.lit(100.0), F.col("total").cast("double")), F.lit(0.0)
    )
    return rows.withColumn("percent", percent)
