"""Tables that grow by whole, named commits.

An append writes its rows to a folder of its own and then puts a small file with
the commit's token beside it. Readers take only folders that such a file names,
so they see whole commits; a token that is there already adds nothing, so an
append can be repeated after a failure. Old rows are never read or written again.
"""

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"[\w.=-]+")


class CommittedTable:
    """A folder of commits with one schema. One writer appends at a time."""

    def __init__(self, spark: SparkSession, folder: str, schema):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, *names))

    def commits(self) -> dict[str, str]:
        """The folder of each committed token; one short file a commit is read."""
        top = self._path("commits")
        files = top.getFileSystem(self._conf)
        if not files.exists(top):
            return {}
        found = {}
        for status in files.listStatus(top):
            token = status.getPath().getName()
            if not token.startswith("."):
                stream = files.open(status.getPath())
                try:
                    found[token] = bytes(stream.readAllBytes()).decode()
                finally:
                    stream.close()
        return found

    def append(self, rows: DataFrame, token: str) -> bool:
        """Add rows under a token; False, and nothing done, if it has been committed before."""
        if not _TOKEN.fullmatch(token) or token.startswith("."):
            raise ValueError(f"a token consists of letters, digits, '_', '-', '=' and '.': {token!r}")
        if token in self.commits():
            return False
        name = os.path.join("data", f"{token}-{uuid.uuid4().hex}")
        rows.select(*self.schema.fieldNames()).write.parquet(os.path.join(self.folder, name))
        waiting, final = self._path("commits", f".{uuid.uuid4().hex}"), self._path("commits", token)
        files = final.getFileSystem(self._conf)
        stream = files.create(waiting, False)
        stream.write(bytearray(name.encode()))
        stream.close()
        return not files.exists(final) and files.rename(waiting, final)

    def read(self, tokens: list[str] | None = None) -> DataFrame:
        """All committed rows, or those of some tokens; an empty frame if there are none."""
        found = self.commits()
        names = [found[t] for t in (sorted(found) if tokens is None else tokens) if t in found]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[os.path.join(self.folder, n) for n in names])
