"""Filters, null fills, label normalisation and guards."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions.text import clean_text, is_blank, strip


def inbound_only(df: DataFrame) -> DataFrame:
    """Keep customer messages; a null direction is dropped."""
    return df.where(F.col("inbound"))


def non_blank(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(column)))


def truthy_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Keep non-null, non-empty text; white-space-only text stays."""
    return df.where(F.col(column) != "")


def fill_message_nulls(df: DataFrame) -> DataFrame:
    return df.na.fill({"inbound": False, "author_id": V.UNKNOWN_AUTHOR, "text": ""})


def with_clean_column(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(f"{column}_processed", clean_text(F.col(column)))


def normalise_labels(df: DataFrame) -> DataFrame:
    """Labels as trimmed strings."""
    return df.withColumns({
        "intent": strip(F.col("intent").cast("string")),
        "severity": strip(F.col("severity").cast("string")),
    })


def clean_labeled(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Replace text by its cleaned form, trim labels, drop emptied rows.

    corpus.job_counts tells how many rows a condition drops.
    """
    # A filter on a projected text is pushed below the projection, which would
    # clean every text twice. It is not pushed below an explode.
    once = F.explode_outer(F.array(clean_text(F.col("text")))).alias("text")
    cleaned = normalise_labels(df.select(*keep, once, "intent", "severity"))
    return non_blank(cleaned)


def clean_label_rows(df: DataFrame) -> DataFrame:
    """Rows of a label file that can be used: complete, trimmed, with text."""
    return non_blank(normalise_labels(df.dropna(subset=["text", "intent", "severity"])))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df
