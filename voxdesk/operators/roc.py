"""ROC curves and areas from score tables (id, class, score, truth).

Scores collapse to one row per distinct value before anything is ordered, so
equal scores never pile up. Running sums go through ranking.running_totals.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxdesk.operators.ranking import ROWS_PER_BUCKET, running_totals
from voxdesk.session import ensure_checkpoint_dir


def score_counts(scores: DataFrame, groups: list[str]) -> DataFrame:
    """Positives and negatives per distinct score; needs a boolean positive.

    Written once, because running_totals reads its input three times.
    """
    ensure_checkpoint_dir(scores.sparkSession)
    counts = scores.groupBy(*groups, "score").agg(
        F.count_if(F.col("positive")).alias("pos"),
        F.count_if(~F.col("positive")).alias("neg"),
    )
    return counts.checkpoint()


def one_vs_rest(scores: DataFrame) -> DataFrame:
    return scores.select(
        "class", "score", (F.col("class") == F.col("truth")).alias("positive")
    )


def roc_auc(scores: DataFrame, groups: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Area under the curve per group; null if a side is empty.

    Each positive beats the negatives below it and half of those with its score.
    """
    counts = score_counts(scores, groups)
    ranked = running_totals(counts, groups, "score", ["neg"], rows_per_bucket=rows_per_bucket)
    below = F.col("neg_upto") - F.col("neg")
    wins = F.col("pos").cast("double") * (below + F.col("neg") / F.lit(2.0))
    sides = ranked.groupBy(*groups).agg(
        F.sum(wins).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    pairs = F.col("p").cast("double") * F.col("n").cast("double")
    return sides.select(*groups, F.try_divide(F.col("wins"), pairs).alias("auc"))


def auc_macro(scores: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Mean of the defined one-vs-rest areas and the number of undefined ones."""
    areas = roc_auc(one_vs_rest(scores), ["class"], rows_per_bucket)
    return areas.agg(
        F.avg("auc").alias("roc_auc_macro"),
        F.count_if(F.col("auc").isNull()).alias("undefined_classes"),
    )


def roc_points(
    scores: DataFrame,
    groups: list[str],
    drop_intermediate: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Curve points by falling threshold, from (0, 0) at a null threshold.

    drop_intermediate leaves out points where the curve does not bend: neither
    the first nor the last one, and the next lower score has the same counts.
    """
    ranked = running_totals(
        score_counts(scores, groups),
        groups,
        "score",
        ["pos", "neg"],
        descending=True,
        rows_per_bucket=rows_per_bucket,
    )
    first = (F.col("pos_upto") == F.col("pos")) & (F.col("neg_upto") == F.col("neg"))
    last = F.col("pos_next").isNull()
    bend = (F.col("pos") != F.col("pos_next")) | (F.col("neg") != F.col("neg_next"))
    if drop_intermediate:
        ranked = ranked.where(first | last | bend)

    def point(threshold: Column, tp: Column, fp: Column) -> Column:
        return F.struct(
            threshold.alias("threshold"),
            F.try_divide(fp.cast("double"), F.col("neg_total").cast("double")).alias("fpr"),
            F.try_divide(tp.cast("double"), F.col("pos_total").cast("double")).alias("tpr"),
        )

    origin = point(F.lit(None).cast("double"), F.lit(0), F.lit(0))
    here = point(F.col("score"), F.col("pos_upto"), F.col("neg_upto"))
    points = F.when(first, F.array(origin, here)).otherwise(F.array(here))
    return ranked.select(*groups, F.inline(points))
