"""Readers for the raw message table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxdesk import fixed_values as V
from voxdesk.functions.dates import parse_created_at
from voxdesk.operators.filters import inbound_only, non_blank, require_rows, truthy_text
from voxdesk.schemas import RAW_MESSAGES
from voxdesk.sources.records import read_csv

# A quoted text may hold line breaks and doubled quotes.
# A file of a folder whose header differs from the first one's raises.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "enforceSchema": "false"}


def _read(spark: SparkSession, path: str, format: str) -> DataFrame:
    if format == "csv":
        # The header gives the column order; no type is inferred from the rows.
        return read_csv(spark, path)
    return spark.read.format(format).load(path)


def _direction(c: Column) -> Column:
    return F.when(c.isin(V.TRUE_TOKENS), True).when(c.isin(V.FALSE_TOKENS), False)


def typed_messages(raw: DataFrame) -> DataFrame:
    """Raw columns to the declared message types; typed columns stay as they are."""
    text_dates = isinstance(raw.schema["created_at"].dataType, StringType)
    types = {
        "tweet_id": F.col("tweet_id").try_cast("bigint"),
        "author_id": F.col("author_id"),
        "inbound": _direction(F.col("inbound").cast("string")),
        "created_at": parse_created_at(F.col("created_at"))
        if text_dates
        else F.col("created_at").cast("timestamp_ntz"),
        "text": F.col("text"),
    }
    return raw.select(*[types[f.name].alias(f.name) for f in RAW_MESSAGES.fields])


def read_messages(
    spark: SparkSession, path: str, format: str = "csv", columns: list[str] | None = None
) -> DataFrame:
    """Typed scan of the five message columns, pruned to those asked for.

    A CSV file is read by as many tasks as it has splits, quoted line breaks or
    not. It is scanned twice, so a corpus that is read often is best rewritten
    once with write_messages.
    """
    typed = typed_messages(_read(spark, path, format))
    return typed.select(*columns) if columns else typed


def write_messages(df: DataFrame, path: str) -> None:
    """Typed messages as parquet: splittable, and pruned by column."""
    df.write.mode("errorifexists").parquet(path)


def read_inbound(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Customer messages with text; a missing path raises at read time."""
    return non_blank(inbound_only(read_messages(spark, path, format)))


def read_with_text(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    rows = truthy_text(read_messages(spark, path, format))
    return require_rows(rows, f"no rows with a 'text' field found in {path}")
