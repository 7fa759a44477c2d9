"""Readers and writers for label files and ratings."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxdesk.operators.filters import clean_label_rows, require_columns, require_rows
from voxdesk.schemas import LABELS, RATINGS
from voxdesk.sources.commits import CommittedTable
from voxdesk.sources.messages import CSV_OPTIONS

# Written values keep their white space, quotes and line breaks.
CSV_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _read_labels(spark: SparkSession, path: str) -> DataFrame:
    names = spark.read.options(**CSV_OPTIONS).csv(path).columns
    schema = ", ".join(f"`{n}` STRING" for n in names)
    rows = spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    return require_columns(rows, LABELS.fieldNames()).select(*LABELS.fieldNames())


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Usable rows of a label CSV; missing columns or no rows raise."""
    return require_rows(
        clean_label_rows(_read_labels(spark, path)), "the label file has no non-empty rows"
    )


def read_labels_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a label CSV as they are; an empty frame if it does not exist."""
    try:
        return _read_labels(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LABELS)


def appended_labels(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows as they are, then the new ones."""
    columns = LABELS.fieldNames()
    typed = new.select("text", "intent", F.col("severity").cast("string").alias("severity"))
    return existing.select(*columns).unionByName(typed)


def append_labels(existing: DataFrame, new: DataFrame, path: str) -> None:
    """Write old and new rows to a new path; the path read from stays whole."""
    rows = appended_labels(existing, new)
    rows.write.mode("errorifexists").options(**CSV_WRITE_OPTIONS).csv(path)


def label_table(spark: SparkSession, folder: str) -> CommittedTable:
    """Labels that grow by commits: old rows are not written again."""
    return CommittedTable(spark, folder, LABELS)


def append_label_batch(table: CommittedTable, new: DataFrame, token: str) -> bool:
    """Add labelled rows; False if a batch with that token is there, so that a repeated append adds nothing."""
    return table.append(new.select("text", "intent", F.col("severity").cast("string").alias("severity")), token)


def read_label_batches(table: CommittedTable) -> DataFrame:
    """Usable rows of all whole commits; no rows raise."""
    return require_rows(clean_label_rows(table.read()), "the label table has no non-empty rows")


def write_ratings(df: DataFrame, path: str) -> None:
    rows = df.select(*RATINGS.fieldNames())
    rows.write.mode("errorifexists").options(**CSV_WRITE_OPTIONS).csv(path)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RATINGS).options(**CSV_OPTIONS).csv(path)
