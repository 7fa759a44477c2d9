"""Counts over the message corpus and over labels."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions.dates import month_key
from voxdesk.functions.text import length_bin, text_length
from voxdesk.operators import grids
from voxdesk.session import ensure_checkpoint_dir


def direction_counts(df: DataFrame) -> DataFrame:
    """Inbound and outbound counts; both rows are always there."""
    counts = df.agg(
        F.count_if(F.col("inbound")).alias("inbound_n"),
        F.count_if(~F.col("inbound")).alias("outbound_n"),
    )
    rows = F.array(
        F.struct(F.lit(V.INBOUND_LABEL).alias("type"), F.col("inbound_n").alias("count")),
        F.struct(F.lit(V.OUTBOUND_LABEL).alias("type"), F.col("outbound_n").alias("count")),
    )
    return counts.select(F.inline(rows))


def monthly_volume(df: DataFrame) -> DataFrame:
    """Messages per month and direction; rows without a time are left out.

    Rows are grouped by the first day of the month; only the few groups are
    turned into text.
    """
    first_day = F.trunc(F.col("created_at").cast("date"), "month")
    counts = (
        df.where(F.col("created_at").isNotNull())
        .groupBy(first_day.alias("__first_day"))
        .agg(
            F.count_if(F.col("inbound")).alias("inbound"),
            F.count_if(~F.col("inbound")).alias("outbound"),
        )
    )
    return counts.select(
        month_key(F.col("__first_day")).alias("month"), "inbound", "outbound"
    ).orderBy("month")


def top_authors(df: DataFrame, n: int = V.TOP_AUTHORS) -> DataFrame:
    """Most active outbound authors, ties by name."""
    return (
        df.where(~F.col("inbound"))
        .groupBy("author_id")
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "author_id")
        .limit(n)
    )


def length_histogram(df: DataFrame) -> DataFrame:
    """Non-empty length bins of inbound text in numeric order."""
    binned = df.where(F.col("inbound")).select(
        length_bin(text_length(F.col("text"))).alias("b")
    )
    return (
        binned.groupBy("b.bin_start", "b.bin")
        .agg(F.count("*").alias("count"))
        .orderBy("bin_start")
    )


def label_counts(df: DataFrame, column: str, by_label: bool = False) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    order = [column] if by_label else [F.col("count").desc(), column]
    return counts.orderBy(*order)


def cross_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of the pairs of a and b that occur, for any number of labels."""
    return df.groupBy(a, b).agg(F.count("*").alias("count"))


def cross_table(df: DataFrame, a: str, b: str, normalize: bool = False) -> DataFrame:
    """Dense counts of a x b, or shares within each a.

    The data is read once, for the counts, which are written. The grid is
    exploded from the two sets of distinct labels in them, null being a label;
    over MAX_LABELS labels on a side raise: cross_counts is the sparse form.
    """
    ensure_checkpoint_dir(df.sparkSession)
    counts = cross_counts(df, a, b).checkpoint()
    columns = grids.label_set(counts, b).scalar()
    dense = grids.fill(counts, a, b, "count", grids.label_set(counts, a), columns)
    if not normalize:
        return dense
    total = F.sum("count").over(Window.partitionBy(a))
    return dense.select(a, b, (F.col("count") / total).alias("share"))


def class_deficits(df: DataFrame, column: str, minimum: int = V.MIN_PER_CLASS) -> DataFrame:
    """Classes with fewer rows than the minimum and how many they lack."""
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("count"))
        .where(F.col("count") < minimum)
        .withColumn("needed", F.lit(minimum) - F.col("count"))
    )


def job_counts(raw: DataFrame, kept: Column) -> DataFrame:
    """Rows read, kept and dropped in one scan; a null condition drops its row."""
    counts = raw.agg(F.count("*").alias("processed"), F.count_if(kept).alias("kept"))
    return counts.withColumn("dropped", F.col("processed") - F.col("kept"))
