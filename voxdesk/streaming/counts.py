"""Corpus counts over arriving files, equal to the batch result."""

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxdesk.session import remove, shared_dir


def read_stream(
    spark: SparkSession, folder: str, schema, file_glob: str = "*.parquet",
    format: str = "parquet", files_per_trigger: int | None = None,
) -> DataFrame:
    """A file stream with a declared schema."""
    reader = spark.readStream.format(format).schema(schema).option("pathGlobFilter", file_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def run_counts(
    stream: DataFrame, count: Callable[[DataFrame], DataFrame], folder: str | None = None
) -> DataFrame:
    """Run an aggregation over all files there are and return its last result.

    State and results live in the folder, by default a fresh one under the
    shared folder. A later run with the same folder reads only new files and
    goes on from the last state. A batch writes its own folder; repeating it
    after a failure overwrites the same one. Only the newest result is kept.
    A folder without files counts like an empty table.
    """
    spark = stream.sparkSession
    base = folder or shared_dir(spark, "stream-counts")
    results = os.path.join(base, "results")

    def keep(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(os.path.join(results, f"batch={batch_id}"))
        if batch_id:
            remove(spark, os.path.join(results, f"batch={batch_id - 1}"))

    query = (
        count(stream)
        .writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", os.path.join(base, "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    try:
        written = spark.read.parquet(results)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return count(spark.createDataFrame([], stream.schema))
    newest = written.agg(F.max("batch").alias("newest"))
    return written.where(F.col("batch") == newest.scalar()).drop("batch")
