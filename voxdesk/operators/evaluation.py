"""Classifier evaluation from confusion counts.

Every metric starts from counts per (truth, prediction). That is one partial
and one final aggregation over the data; all later steps see label pairs only.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.operators import grids
from voxdesk.session import ensure_checkpoint_dir


def pair_counts(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double; 0 where the bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(pairs: DataFrame, labels: list | None = None) -> DataFrame:
    """Dense confusion matrix (y_true, y_pred, n).

    With a label list, pairs outside it are ignored. Otherwise the grid is the
    union of the labels that occur, null being one of them; the pairs are then
    counted once and the counts written, as grid and cells both come from them.
    Over MAX_LABELS labels raise: pair_counts is the sparse form for those.
    """
    counts = pair_counts(pairs)
    if labels is None:
        ensure_checkpoint_dir(pairs.sparkSession)
        counts = counts.checkpoint()
        domain = grids.label_set(counts, "y_true", "y_pred")
    else:
        domain = grids.listed(pairs, labels)
    return grids.fill(counts, "y_true", "y_pred", "n", domain, F.col("labels"))


def confusion_normalised(pairs: DataFrame, over: str, labels: list | None = None) -> DataFrame:
    """Confusion shares over 'true' rows, 'pred' columns or 'all' cells."""
    cells = confusion(pairs, labels)
    if over == "all":
        ensure_checkpoint_dir(pairs.sparkSession)
        cells = cells.checkpoint()
        total = cells.agg(F.sum("n")).scalar()
    else:
        total = F.sum("n").over(Window.partitionBy({"true": "y_true", "pred": "y_pred"}[over]))
    return cells.select(
        "y_true", "y_pred", _ratio(F.col("n"), total).alias("share")
    )


def _class_counts(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """tp, support and predicted per label, from pair counts."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")

    def side(label: str, tp: Column, support: Column, predicted: Column) -> Column:
        return F.struct(
            F.col(label).alias("label"),
            tp.cast("long").alias("tp"),
            support.cast("long").alias("support"),
            predicted.cast("long").alias("predicted"),
        )

    sides = F.array(
        side("y_true", hit, F.col("n"), zero), side("y_pred", zero, zero, F.col("n"))
    )
    return (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(
            F.sum("tp").alias("tp"),
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
        )
    )


def per_class_metrics(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; empty ratios are 0."""
    rows = _class_counts(pair_counts(pairs, by), by)
    return rows.select(
        *by,
        "label",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "tp",
    )


def per_class_ordered(pairs: DataFrame, labels: list) -> DataFrame:
    """Per-class metrics in a given label order; unknown labels are null."""
    wanted = pairs.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(v) for v in labels])).alias("position", "label")
    )
    metrics = per_class_metrics(pairs).drop("tp")
    return wanted.join(metrics, "label", "left").orderBy("position")


def evaluate(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, macro and weighted precision, recall and F1, one row per group."""
    classes = per_class_metrics(pairs, by)

    def weighted(metric: str) -> Column:
        return F.sum(F.col(metric) * F.col("support")) / F.sum("support")

    return classes.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[weighted(m).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")],
    )


def binary_metrics(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the greater label, if truth has two labels."""
    ensure_checkpoint_dir(pairs.sparkSession)
    counts = pair_counts(pairs).checkpoint()
    marked = counts.withColumn("positive", counts.agg(F.max("y_true")).scalar())
    is_true = F.col("y_true") == F.col("positive")
    is_pred = F.col("y_pred") == F.col("positive")
    sums = marked.agg(
        F.sum(F.when(is_true & is_pred, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(is_true, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(is_pred, F.col("n")).otherwise(0)).alias("predicted"),
        F.max("positive").alias("positive"),
        F.countDistinct("y_true").alias("truths"),
    ).where(F.col("truths") == 2)
    return sums.select(
        "positive",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision_binary"),
        _ratio(F.col("tp"), F.col("support")).alias("recall_binary"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1_binary"),
    )


def classification_report(pairs: DataFrame) -> DataFrame:
    """Class rows, then accuracy, macro and weighted averages.

    The averages come from the class rows in one aggregate.
    """
    classes = per_class_metrics(pairs)
    support = F.sum("support")

    def summary(name: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(name).alias("row"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    def weighted(metric: str) -> Column:
        return F.sum(F.col(metric) * F.col("support")) / support

    none = F.lit(None).cast("double")
    accuracy = F.sum("tp") / support
    averages = classes.agg(
        F.array(
            summary("accuracy", none, none, accuracy),
            summary("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
            summary("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
        ).alias("rows")
    ).select(F.inline("rows"))
    body = classes.select(
        F.col("label").cast("string").alias("row"), "precision", "recall", "f1", "support"
    )
    return body.unionByName(averages)


def accuracy_gate(metrics: DataFrame, threshold: float = V.ACCURACY_GATE) -> DataFrame:
    return metrics.withColumn(
        "meets_threshold", F.coalesce(F.col("accuracy") >= threshold, F.lit(False))
    )


def top_errors(pairs: DataFrame, n: int = V.TOP_ERRORS) -> DataFrame:
    """Most frequent wrong (truth, prediction) pairs."""
    wrong = pairs.where(F.col("y_true") != F.col("y_pred"))
    return (
        pair_counts(wrong)
        .orderBy(F.col("n").desc(), "y_true", "y_pred")
        .limit(n)
    )


def agreement_by_label(pairs: DataFrame, labels: list | None = None) -> DataFrame:
    """Share of agreeing rows per true label; listed labels without rows are null."""
    agree = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    rates = pairs.groupBy(F.col("y_true").alias("label")).agg(agree.alias("agreement"))
    if labels is None:
        return rates.orderBy("label")
    wanted = pairs.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(v) for v in labels])).alias("position", "label")
    )
    return wanted.join(rates, "label", "left").orderBy("position").drop("position")
