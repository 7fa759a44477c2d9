"""CSV files with quoted line breaks, read by many tasks a file.

A line break inside quotes is no end of a record, so a task that starts in the
middle of a file cannot tell where a record starts. Quotes come in pairs: whether
a line starts inside quotes follows from the parity of all quotes before it. One
scan counts the quotes of each split, running sums over the splits of a file give
the parity at each split's start, and a second scan puts lines together into
records. Only the first and last record of a split may be in pieces, and only
these pieces are joined across splits.

Quotes inside a field are doubled, as CSV asks for. A single quote in the middle of
an unquoted field opens quotes here.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxdesk.operators.sizing import BROADCAST_BYTES, small_side
from voxdesk.session import ensure_checkpoint_dir

PIECES = "file string, block bigint, first boolean, open boolean, closed boolean, record string"
_KINDS = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
PARSE_OPTIONS = {"multiLine": "true", "quote": '"', "escape": '"'}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of each split in order; a carriage return stays at its line's end."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _open_blocks(lines: DataFrame) -> DataFrame:
    """(key) of the splits that start inside quotes. The window sees one row a split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return parity.withColumn("before", F.sum("odd").over(before)).where("before % 2 = 1").select(
        F.xxhash64("file", "block").alias("key")
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split. `open`: its first lines stand before; `closed`: its last line ends it."""
    block, waiting, opened, inside, started = None, [], False, False, False

    def finished(closed: bool) -> tuple:
        return (*block, not started and block[1] == 0, opened, closed, "\n".join(waiting))

    for batch in batches:
        rows = []
        values = batch.column("value")
        odd = pc.bit_wise_and(pc.count_substring(values, '"'), 1).to_numpy(zero_copy_only=False) == 1
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        starts_inside = batch.column("inside").to_numpy(zero_copy_only=False)
        names = pc.dictionary_encode(files).indices.to_numpy(zero_copy_only=False) if len(files) else np.empty(0, int)
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(names) != 0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
            if low == high:
                continue
            here = (files[low].as_py(), int(blocks[low]))
            if here != block:
                if waiting:
                    rows.append(finished(not inside))
                block, waiting, started = here, [], False
                inside = opened = bool(starts_inside[low])
            lines = values.slice(low, high - low).to_pylist()
            for line, flips in zip(lines, odd[low:high].tolist(), strict=True):
                if waiting and not inside:
                    rows.append(finished(True))
                    waiting, opened, started = [], False, True
                waiting.append(line)
                inside ^= flips
        yield _batch(rows)
    if waiting:
        yield _batch([finished(not inside)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(_KINDS)]
    return pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in PIECES.split(", ")])


def csv_records(spark: SparkSession, path: str, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(first, record) of every record of the files, as text; `first` marks the first one of a file.

    Empty lines between records are left out. The list of splits that start inside
    quotes goes to the tasks if it has at most limit_bytes; beyond that lines are
    dealt out by split.
    """
    ensure_checkpoint_dir(spark)
    lines = _lines(spark, path).withColumn("key", F.xxhash64("file", "block"))
    opens = _open_blocks(lines).withColumn("inside", F.lit(True))
    sent = small_side(opens, limit_bytes)
    if sent.count() * 64 > limit_bytes:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        dealt = numbered.join(sent, "key", "left").repartition("key").sortWithinPartitions("key", "at")
    else:
        dealt = lines.join(F.broadcast(sent), "key", "left")
    dealt = dealt.select("file", "block", F.coalesce("inside", F.lit(False)).alias("inside"), "value")
    pieces = dealt.mapInArrow(_pieces, PIECES)
    whole = pieces.where("closed AND NOT open").select("first", "record")
    parts = pieces.where("open OR NOT closed").checkpoint()
    # A piece that is not open begins a record; the window sees two short rows a split.
    order = Window.partitionBy("file").orderBy("block", F.col("open").desc())
    begins = F.sum(F.when(F.col("open"), 0).otherwise(1)).over(order)
    place = parts.select("file", "block", "open").withColumn("number", begins)
    joined = parts.join(place, ["file", "block", "open"]).groupBy("file", "number").agg(
        F.max("first").alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda p: p.record), "\n").alias("record"),
    )
    text = F.regexp_replace("record", "\r$", "")
    return whole.unionByName(joined.select("first", "record")).select("first", text.alias("record")).where("record != ''")


def read_csv(spark: SparkSession, path: str, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The files' columns as strings, named by their header. Headers that differ raise.

    An unquoted empty field is null, a quoted one is empty. A path without rows gives
    an empty frame.
    """
    records = csv_records(spark, path, limit_bytes)
    headers = [r["record"] for r in records.where("first").select("record").distinct().limit(2).collect()]
    if not headers:
        raise ValueError(f"no header found in {path}")
    names = _names(spark, headers[0])
    if len(headers) > 1 and _names(spark, headers[1]) != names:
        raise ValueError(f"files of {path} have different headers")
    schema = ", ".join(f"`{n}` STRING" for n in names)
    parsed = F.from_csv("record", F.lit(schema), PARSE_OPTIONS)
    return records.where("NOT first").select(parsed.alias("r")).select("r.*")


def _names(spark: SparkSession, header: str) -> list[str]:
    """The fields of a header line."""
    wide = ", ".join(f"`{k}` STRING" for k in range(header.count(",") + 1))
    row = spark.range(1).select(F.from_csv(F.lit(header.removeprefix("﻿")), F.lit(wide), PARSE_OPTIONS).alias("r")).select("r.*").first()
    return [c for c in row if c is not None]
