"""Tables arrive in as many files as they are worth."""

from voxdesk.plans import model_queries


class Table:
    def __init__(self, spark, rows):
        self.spark, self.rows = spark, rows

    def read(self, name):
        return self.rows


def test_files_grow_with_the_table(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(model_queries, "FILE_ROWS", 10)
    monkeypatch.setattr(
        model_queries, "read_stream",
        lambda spark, path, schema, files_per_trigger: seen.append(
            (spark.read.parquet(path).count(), len(spark.read.parquet(path).inputFiles()), files_per_trigger)
        ),
    )
    for n, parts in ((9, 1), (200, 4)):
        model_queries._arriving(Table(spark, spark.range(0, n, 1, parts)), "any")
    assert seen == [(9, 3, 1), (200, 20, 7)]
