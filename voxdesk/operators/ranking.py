"""Ranks, cut-offs and running sums that never put one whole group in one task.

A plain row_number over a label sends all rows of a hot label to one task.
Here rows are first counted per (group, bucket), where buckets follow the
wanted order. Only the few buckets that hold a wanted rank are then sorted.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxdesk.operators.sizing import small_side
from voxdesk.session import ensure_checkpoint_dir

HASH_BUCKET_DIGITS = 4  # 65,536 buckets of the leading hex digits
ROWS_PER_BUCKET = 1_000_000
#: Strings sampled to part the rows into buckets: for each bucket, and in all.
SAMPLED_PER_BUCKET, MAX_SAMPLE, SAMPLE_SEED = 64, 500_000, 42


def hash_key(seed, *ids: str) -> Column:
    """Seeded pseudo-random order key, the same on every engine and layout."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def hash_bucket(key: Column) -> Column:
    """Order-preserving bucket of an md5 key; md5 spreads rows evenly."""
    return F.conv(F.substring(key, 1, HASH_BUCKET_DIGITS), 16, 10).cast("int")


def value_buckets(
    df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add an order-preserving bucket of a number or string column with even row counts.

    Rows whose value is null or NaN have no place in an order and are left out,
    whatever the number of rows; infinite values stand at the ends. The split
    points are taken once, so a retried task assigns the same buckets: of numbers
    approximate quantiles, of strings values of a sample. The number of buckets
    grows with the rows.
    """
    text = dict(df.dtypes)[column] == "string"
    value = F.col(column) if text else F.col(column).cast("double")
    known = F.col(column).isNotNull()
    df = df.where(known if text else known & ~F.isnan(value))
    rows = df.count()
    wanted = math.ceil(rows / rows_per_bucket)
    if wanted <= 1:
        return df.withColumn("bucket", F.lit(0))
    if text:
        return df.withColumn("bucket", _place_among(string_splitters(df, column, rows, wanted))(F.col(column)))
    finite = df.where(F.abs(value) < math.inf)
    quantiles = finite.agg(
        F.percentile_approx(value, [i / wanted for i in range(1, wanted)], 10 * wanted)
    ).first()[0]
    splits = [-math.inf, *sorted(set(quantiles or [])), math.inf]
    numeric = df.withColumn("__value", value)
    bucketed = Bucketizer(splits=splits, inputCol="__value", outputCol="bucket")
    return bucketed.transform(numeric).drop("__value").withColumn(
        "bucket", F.col("bucket").cast("int")
    )


def string_splitters(df: DataFrame, column: str, rows: int, wanted: int) -> list[bytes]:
    """Values that part the rows into about `wanted` even buckets, in the order of their UTF-8 bytes.

    They come from a sample of rows of bounded size. Nothing is cut off them, so ids
    with a long common prefix are parted like any other.
    """
    size = min(MAX_SAMPLE, SAMPLED_PER_BUCKET * wanted)
    drawn = df.where(F.rand(SAMPLE_SEED) < min(1.0, size / rows)).select(F.col(column).cast("binary"))
    values = sorted(bytes(r[0]) for r in drawn.collect())
    if not values:
        return []
    return sorted({values[k * len(values) // wanted] for k in range(1, wanted)})


def _place_among(splitters: list[bytes]):
    """The bucket of a string: an odd one for each splitter itself, even ones between them.

    So a value that many rows have, which is then a splitter, shares its bucket
    with no other.
    """
    table = np.array(splitters, object)

    @F.arrow_udf("int")
    def of(values: pa.Array) -> pa.Array:
        own = np.array(values.cast(pa.binary()).to_pylist(), object)
        if not len(table) or not len(own):
            return pa.array(np.zeros(len(own), np.int32))
        place = np.searchsorted(table, own, "left") + np.searchsorted(table, own, "right")
        return pa.array(place.astype(np.int32))

    return of


def _in_order(df: DataFrame, place: Column) -> DataFrame:
    """df sorted by all tasks and written, with its row's partition `__part` and place in it `__at`."""
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.withColumn("__place", place).orderBy("__place").withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    return placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))


def nth_place(df: DataFrame, place: Column, n: int) -> DataFrame:
    """One row `place`: the n-th (from 1) in the order of a column of any type; none if there are fewer rows.

    Rows are sorted by all tasks; the driver gets one count a partition.
    """
    placed = _in_order(df, place)
    left = n
    for part, rows in sorted(tuple(r) for r in placed.groupBy("__part").count().collect()):
        if left <= rows:
            found = placed.where((F.col("__part") == part) & (F.col("__at") == left - 1))
            return found.select(F.col("__place").alias("place"))
        left -= rows
    return placed.limit(0).select(F.col("__place").alias("place"))


def sums_before(df: DataFrame, place: Column, value: str, into: str) -> DataFrame:
    """Add the sum of `value` over all rows before each one in the order of a column of any type."""
    placed = _in_order(df, place)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition.
    bases = placed.groupBy("__part").agg(F.sum(value).alias("__sum")).select(
        "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base")
    )
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(small_side(bases), "__part")
    before = F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("__base")
    return joined.withColumn(into, before).select(*df.columns, into)


def bucket_counts(rows: DataFrame, group: str, *extra: Column) -> DataFrame:
    """Rows per (group, bucket), written once since several steps read them."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.groupBy(group, "bucket").agg(F.count("*").alias("n"), *extra).checkpoint()


def rank_cutoffs(
    rows: DataFrame, counts: DataFrame, targets: DataFrame, group: str, order: list[str]
) -> DataFrame:
    """For each (group, target), the order values of the target-th row.

    rows holds group, bucket and the order columns, counts their bucket_counts;
    targets holds group and target (1-based). A target of zero, or beyond the
    group, gives no row. Sorting touches only buckets that contain a target.
    """
    up_to = Window.partitionBy(group).orderBy("bucket")
    running = counts.select(
        group,
        "bucket",
        "n",
        F.sum("n").over(up_to.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    hits = (
        running.join(targets, group)
        .where((F.col("target") > F.col("upto") - F.col("n")) & (F.col("target") <= F.col("upto")))
        .select(group, "bucket", "target", (F.col("target") - F.col("upto") + F.col("n")).alias("need"))
    )
    hits = small_side(hits)
    touched = rows.join(hits.select(group, "bucket").distinct(), [group, "bucket"], "left_semi")
    inside = Window.partitionBy(group, "bucket").orderBy(*order)
    ranked = touched.withColumn("need", F.row_number().over(inside).cast("long"))
    return ranked.join(hits, [group, "bucket", "need"]).select(
        group, "target", F.struct(*[F.col(c) for c in order]).alias("cut")
    )


def running_totals(
    df: DataFrame,
    groups: list[str],
    order: str,
    values: list[str],
    descending: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add, per value column v and within the groups in the given order:

    v_upto, the inclusive running sum; v_total, the sum of the whole group;
    v_next, the value of the next row (null on the last one).

    Needs one row per (groups, order). Each task sorts one bucket of one group;
    what lies in other buckets comes from a table of one row per bucket.
    """
    bucketed = value_buckets(df, order, rows_per_bucket)

    def direction(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    leading = F.max_by if descending else F.min_by
    per_bucket = bucketed.groupBy(*groups, "bucket").agg(
        *[F.sum(v).alias(f"__{v}_sum") for v in values],
        *[leading(v, order).alias(f"__{v}_first") for v in values],
    )
    buckets = Window.partitionBy(*groups).orderBy(direction("bucket"))
    earlier = buckets.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    edges = per_bucket.select(
        *groups,
        "bucket",
        *[F.coalesce(F.sum(f"__{v}_sum").over(earlier), F.lit(0)).alias(f"__{v}_before") for v in values],
        *[F.sum(f"__{v}_sum").over(whole).alias(f"{v}_total") for v in values],
        *[F.lead(f"__{v}_first").over(buckets).alias(f"__{v}_after") for v in values],
    )
    inside = Window.partitionBy(*groups, "bucket").orderBy(direction(order))
    up_to_here = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = bucketed.join(small_side(edges), [*groups, "bucket"])
    return joined.select(
        *df.columns,
        *[(F.sum(v).over(up_to_here) + F.col(f"__{v}_before")).alias(f"{v}_upto") for v in values],
        *[f"{v}_total" for v in values],
        *[F.coalesce(F.lead(v).over(inside), F.col(f"__{v}_after")).alias(f"{v}_next") for v in values],
    )
