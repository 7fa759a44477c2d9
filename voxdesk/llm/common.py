"""What the operators on training text share."""

import contextlib
import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxdesk.session import shared_dir, ship_package

#: Rows of a few numbers each that may be sent to every task at once.
BROADCAST_ROWS = 500_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables of one job, written under the session's shared folder.

    A written table cuts the lineage: when an executor is lost, its tasks read
    the files again and nothing before them is repeated. A table that the
    returned frame reads stays until the caller removes the folder.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.folder = shared_dir(spark, purpose)
        ship_package(spark)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(self.folder, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, name))
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few short columns, marked for broadcast if it has no more rows than that."""
    return F.broadcast(table) if table.count() <= rows else table


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column in UTF-8."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return texts.cast(kind).to_pylist()


def sliced(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time, so that its texts are not all held twice."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def each_text(texts: pa.Array, rows: int = 256) -> Iterator[bytes | None]:
    """The texts of an Arrow column in UTF-8, converted a few at a time."""
    for at in range(0, len(texts), rows):
        yield from as_bytes(texts.slice(at, rows))


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task keeps none of the last one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, int]:
    """A number for each word, equal words having equal numbers, and how many there are."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return ids, len(known)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A local table of a few rows; no job is needed to make it."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = [field.split() for field in schema.split(", ")]
    columns = [pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, names=[name for name, _ in fields]))


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Enough tasks that none gets more than per_task rows on average."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


#: Bytes of a text that are split into words at once.
PIECE_BYTES = 1 << 20
_BLANKS = b" \t\n\x0b\x0c\r"


def word_pieces(text: bytes | None, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists that come from about `size` bytes each."""
    start, end = 0, len(text or b"")
    while start < end:
        stop = start + size
        while stop < end and text[stop] not in _BLANKS:
            stop += 1
        words = text[start:stop].split()
        if words:
            yield words
        start = stop
