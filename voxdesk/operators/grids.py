"""Dense tables over two sets of labels, for as many labels as a person can read."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More labels on a side make a dense table an error; the sparse counts have no such bound.
MAX_LABELS = 1_000


def label_set(counts: DataFrame, *columns: str) -> DataFrame:
    """One row with the distinct labels of the columns, null among them.

    The labels are counted before any are gathered.
    """
    names = counts.select(F.explode(F.array(*columns)).alias("label")).distinct()
    found = names.limit(MAX_LABELS + 1).count()
    if found > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} labels in {', '.join(columns)}: use the sparse counts or list the labels")
    return names.agg(F.collect_set(F.struct("label")).alias("labels"))


def listed(df: DataFrame, labels: list) -> DataFrame:
    """One row with the given labels."""
    structs = F.array(*[F.struct(F.lit(v).alias("label")) for v in labels])
    return df.sparkSession.range(1).select(structs.alias("labels"))


def fill(counts: DataFrame, a: str, b: str, n: str, rows: DataFrame, columns: Column) -> DataFrame:
    """(a, b, n) for every pair of a row label and a column label; null is a label like others."""
    sides = rows.select(F.explode("labels").alias("row"), columns.alias("columns"))
    grid = sides.select(F.col("row.label").alias(a), F.explode("columns").alias("column")).select(
        a, F.col("column.label").alias(b)
    )
    cells = counts.select(F.col(a).alias("__a"), F.col(b).alias("__b"), n)
    same = F.col(a).eqNullSafe(F.col("__a")) & F.col(b).eqNullSafe(F.col("__b"))
    return grid.join(cells, same, "left").select(a, b, F.coalesce(n, F.lit(0)).alias(n))
