import pytest
from pyspark.sql import functions as F

from voxdesk.operators import corpus
from voxdesk.streaming.counts import read_stream, run_counts


@pytest.fixture(scope="module")
def corpus_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus") / "in")
    rows = spark.range(500).select(
        F.concat(F.lit("author"), F.col("id") % 7).alias("author_id"),
        (F.col("id") % 3 == 0).alias("inbound"),
        F.repeat(F.lit("x"), (F.col("id") * 3).cast("int")).alias("text"),
        F.when(F.col("id") % 50 != 0, F.make_timestamp_ntz(F.lit(2017), (F.col("id") % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("created_at"),
    )
    rows.repartition(5).write.parquet(folder)
    return folder


@pytest.mark.parametrize(
    "count", [corpus.direction_counts, corpus.monthly_volume, corpus.length_histogram, corpus.label_counts]
)
def test_stream_equals_batch(spark, corpus_folder, count):
    if count is corpus.label_counts:
        function = lambda df: corpus.label_counts(df, "author_id")
    else:
        function = count
    batch = spark.read.parquet(corpus_folder)
    stream = read_stream(spark, corpus_folder, batch.schema, files_per_trigger=2)
    got = sorted(map(tuple, run_counts(stream, function).collect()), key=repr)
    assert got == sorted(map(tuple, function(batch).collect()), key=repr)
    assert got


def test_a_later_run_goes_on_from_the_state(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([(True,), (False,)], "inbound boolean").write.parquet(source)

    def run():
        stream = read_stream(spark, source, "inbound boolean")
        rows = run_counts(stream, corpus.direction_counts, state).collect()
        return [r["count"] for r in sorted(rows, key=lambda r: r["type"])]

    assert run() == [1, 1]
    spark.createDataFrame([(True,)] * 3, "inbound boolean").write.mode("append").parquet(source)
    assert run() == [4, 1]
    assert run() == [4, 1]


def test_a_folder_without_files_counts_like_an_empty_table(spark, tmp_path):
    source = tmp_path / "none"
    source.mkdir()
    stream = read_stream(spark, str(source), "inbound boolean")
    assert [r["count"] for r in run_counts(stream, corpus.direction_counts).collect()] == [0, 0]
