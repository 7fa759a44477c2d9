"""Seeded samples, splits and folds by cut-offs in hash order.

A row's place depends on the seed and its id only, not on partitioning. Every
operator finds cut-off keys first and then tags rows by comparison, so the rows
themselves are never sorted or shuffled.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.operators.ranking import (
    bucket_counts,
    hash_bucket,
    hash_key,
    nth_place,
    rank_cutoffs,
    sums_before,
    value_buckets,
)
from voxdesk.operators.sizing import small_side

_ALL = "__all"
_CLASS = "__class"


def _with_class(df: DataFrame, label: str) -> DataFrame:
    """Labels as a struct, so that rows without a label join as a class too."""
    return df.withColumn(_CLASS, F.struct(F.col(label)))


def _keyed(df: DataFrame, seed, id_col: str) -> DataFrame:
    return df.withColumn("__key", hash_key(seed, id_col)).withColumn(
        "bucket", hash_bucket(F.col("__key"))
    )


def _place(id_col: str) -> Column:
    return F.struct(F.col("__key"), F.col(id_col))


def _all_first_n(keyed: DataFrame, counts: DataFrame, n: int, seed, id_col: str) -> Column:
    """Condition that holds for the first n rows in hash order.

    keyed holds id, key and bucket; counts the rows per bucket.
    """
    if n <= 0:
        return F.lit(False)
    everything = F.lit(0).alias(_ALL)
    target = keyed.sparkSession.range(1).select(everything, F.lit(n).cast("long").alias("target"))
    cut = rank_cutoffs(
        keyed.select("*", everything),
        counts.groupBy("bucket").agg(F.sum("n").alias("n")).select("*", everything),
        target,
        _ALL,
        ["__key", id_col],
    ).first()
    if cut is None:
        return F.lit(True)
    key, last_id = cut["cut"]
    here = hash_key(seed, id_col)
    return (here < key) | ((here == key) & (F.col(id_col) <= F.lit(last_id)))


def _counted(df: DataFrame, seed, id_col: str, group: str | None = None):
    """Keyed ids and their counts per bucket, for all rows or per group."""
    keyed = _keyed(df.select(id_col, group or F.lit(0).alias(_ALL)), seed, id_col)
    return keyed, bucket_counts(keyed, group or _ALL)


def sample_n(df: DataFrame, n: int, seed=V.SEED, id_col: str = "message_id") -> DataFrame:
    """min(n, rows) rows without replacement."""
    keyed, counts = _counted(df, seed, id_col)
    return df.where(_all_first_n(keyed.drop(_ALL), counts, n, seed, id_col))


@dataclass(frozen=True)
class SplitPlan:
    rows: int
    classes: int
    smallest: int
    test_rows: int
    stratified: bool
    reason: str


def plan_split(
    df: DataFrame, label: str, fraction: float = V.TEST_FRACTION, need_room: bool = True
) -> SplitPlan:
    """Decide whether a split can follow the label.

    Every class needs two rows, and the floor of the test size must reach the
    number of classes (need_room). The test part has ceil(fraction * rows) rows.
    """
    return _plan(df.groupBy(label).agg(F.count("*").alias("n")), fraction, need_room)


def _plan(class_counts: DataFrame, fraction: float, need_room: bool) -> SplitPlan:
    stats = class_counts.agg(
        F.sum("n").alias("rows"), F.count("*").alias("classes"), F.min("n").alias("smallest")
    ).first()
    rows, classes, smallest = stats["rows"] or 0, stats["classes"], stats["smallest"] or 0
    if smallest < 2:
        reason = "class_below_two"
    elif need_room and math.floor(fraction * rows) < classes:
        reason = "test_below_classes"
    else:
        reason = "stratified"
    return SplitPlan(
        rows, classes, smallest, math.ceil(fraction * rows), reason == "stratified", reason
    )


def class_quotas(class_counts: DataFrame, label: str, test_rows: int) -> DataFrame:
    """Test rows per class: proportional floor, then largest remainder by label.

    Works on one row (label, n) per class. The classes that get one more row are
    those up to a cut-off in the order of remainders, which all tasks sort.
    """
    total = class_counts.agg(F.sum("n")).first()[0] or 0
    # exact in decimals; the product of two counts would overflow a long
    product = f"(CAST({test_rows} AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(18, 0)))"
    whole = f"CAST({max(total, 1)} AS DECIMAL(18, 0))"
    parts = class_counts.select(
        label, F.expr(f"{product} div {whole}").alias("floor"), F.expr(f"{product} % {whole}").alias("rest")
    )
    missing = test_rows - (parts.agg(F.sum("floor")).first()[0] or 0)
    if missing <= 0:
        return parts.select(label, F.col("floor").cast("long").alias("target"))
    place = F.struct((-F.col("rest")).alias("rest"), F.col(label).alias("label"))
    cut = nth_place(parts, place, int(missing))
    one_more = F.coalesce(place <= cut.scalar(), F.lit(True))
    return parts.select(label, (F.col("floor") + one_more.cast("int")).cast("long").alias("target"))


def split(
    df: DataFrame,
    fraction: float = V.TEST_FRACTION,
    seed=V.SEED,
    id_col: str = "doc_id",
    names: tuple[str, str] = ("train", "test"),
) -> DataFrame:
    """Tag rows: the first ceil(fraction * rows) in hash order are test."""
    keyed, counts = _counted(df, seed, id_col)
    rows = counts.agg(F.sum("n")).first()[0] or 0
    n = math.ceil(fraction * rows)
    return _tagged(df, _all_first_n(keyed.drop(_ALL), counts, n, seed, id_col), names)


def _tagged(df: DataFrame, is_test: Column, names: tuple[str, str]) -> DataFrame:
    train, test = names
    return df.withColumn("split", F.when(is_test, test).otherwise(train))


def safe_split(
    df: DataFrame,
    label: str,
    fraction: float = V.TEST_FRACTION,
    seed=V.SEED,
    id_col: str = "doc_id",
    need_room: bool = True,
    names: tuple[str, str] = ("train", "test"),
) -> DataFrame:
    """Split that follows the label where possible, else the plain split."""
    classed = _with_class(df, label)
    keyed, counts = _counted(classed, seed, id_col, _CLASS)
    class_counts = counts.groupBy(_CLASS).agg(F.sum("n").alias("n"))
    plan = _plan(class_counts, fraction, need_room)
    if not plan.stratified:
        first = _all_first_n(keyed.drop(_CLASS), counts, plan.test_rows, seed, id_col)
        return _tagged(df, first, names)
    quotas = class_quotas(class_counts, _CLASS, plan.test_rows)
    cuts = rank_cutoffs(keyed, counts, quotas, _CLASS, ["__key", id_col]).select(
        _CLASS, F.col("cut").alias("__cut")
    )
    keyed = classed.withColumn("__key", hash_key(seed, id_col)).join(small_side(cuts), _CLASS, "left")
    is_test = F.coalesce(_place(id_col) <= F.col("__cut"), F.lit(False))
    return _tagged(keyed, is_test, names).select(*df.columns, "split")


def split_per_task(df: DataFrame, labels: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """Independent splits, one per task; the task is part of the seed."""
    parts = [
        safe_split(df, column, seed=f"{V.SEED}|{task}", id_col=id_col).select(
            F.lit(task).alias("task"), F.col(id_col), F.col(column).cast("string").alias("label"), "split"
        )
        for task, column in labels.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nested_split(
    df: DataFrame, label: str, test: float = V.TEST_FRACTION,
    validation: float = V.VALIDATION_FRACTION, id_col: str = "doc_id",
) -> DataFrame:
    """Train / val / test: a test split, then a split of the training rows."""
    outer = safe_split(df, label, test, id_col=id_col)
    inner = safe_split(
        outer.where(F.col("split") == "train").drop("split"),
        label,
        validation,
        seed=f"{V.SEED}|validation",
        id_col=id_col,
        need_room=False,
        names=("train", "val"),
    )
    return outer.where(F.col("split") == "test").unionByName(inner)


def assign_folds(
    df: DataFrame, label: str, k: int = V.CV_FOLDS, id_col: str = "doc_id"
) -> DataFrame:
    """Unshuffled stratified folds: each class is cut into k runs in id order.

    Classes stand in order of first appearance. Fold i of a class holds as many
    rows as the class has positions p with p mod k = i in the class-sorted order.
    """
    rows = value_buckets(_with_class(df, label).select(id_col, _CLASS), id_col)
    counts = bucket_counts(rows, _CLASS, F.min(id_col).alias("first"))
    classes = counts.groupBy(_CLASS).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    starts = sums_before(classes, F.struct("first", _CLASS), "n", "start")

    def positions_below(limit: Column, i: Column) -> Column:
        # how many p in [0, limit) leave the remainder i modulo k
        return F.floor((limit - i + (k - 1)) / F.lit(k))

    sizes = starts.select(
        _CLASS,
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"),
        "start",
        (F.col("start") + F.col("n")).alias("stop"),
    ).withColumn(
        "size",
        positions_below(F.col("stop"), F.col("fold")) - positions_below(F.col("start"), F.col("fold")),
    )
    upto = Window.partitionBy(_CLASS).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    targets = sizes.select(_CLASS, F.sum("size").over(upto).cast("long").alias("target"))
    found = rank_cutoffs(rows, counts, targets.distinct(), _CLASS, [id_col])
    cuts = (
        targets.join(small_side(found), [_CLASS, "target"], "left")
        .groupBy(_CLASS)
        .agg(
            F.count_if(F.col("target") == 0).alias("__skipped"),
            F.collect_list(f"cut.{id_col}").alias("__cuts"),
        )
    )
    # leading folds without rows, then the folds that end before this row
    fold = (
        F.col("__skipped") + F.size(F.filter("__cuts", lambda cut: cut < F.col(id_col)))
    ).cast("int")
    return (
        _with_class(df, label)
        .join(small_side(cuts), _CLASS, "left")
        .withColumn("fold", fold)
        .select(*df.columns, "fold")
    )
