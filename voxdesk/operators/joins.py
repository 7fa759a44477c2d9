"""Anti join against labelled texts, label maps, lookups and pairing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk.operators import bloom
from voxdesk.operators.ranking import ROWS_PER_BUCKET, running_totals
from voxdesk.operators.sizing import BROADCAST_BYTES, small_side

#: What a digest in quotes and its row count as when the size of a side is measured.
DIGEST_BYTES = 64 + 2 + 16 + len('{"__digest":}')


def unlabelled(
    messages: DataFrame, labels: DataFrame, dedupe: bool = False, id_col: str = "message_id",
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Messages whose exact text is not labelled yet.

    Texts are compared by SHA-256, so the labelled side ships 64 characters per
    distinct text. A labelled side too large to be sent to all tasks is sifted
    first: a Bloom filter of its digests, of bounded size, tells which messages
    cannot be labelled, and only the others are shuffled. Repeated candidate
    texts stay unless dedupe is set; then the row with the smallest id is kept,
    combined before the shuffle.
    """
    digest = F.sha2(F.col("text"), 256)
    known = labels.select(digest.alias("__digest")).distinct()
    candidates = messages.where(F.col("text").isNotNull())
    sent = small_side(known, limit_bytes)

    def without(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__digest", digest).join(sent, "__digest", "left_anti").drop("__digest")

    if sent.count() * DIGEST_BYTES <= limit_bytes:
        fresh = without(candidates)
    else:
        possible = bloom.might_hold(bloom.of_hashes(sent, F.xxhash64("__digest")), F.xxhash64(digest))
        fresh = candidates.where(~possible).unionByName(without(candidates.where(possible)))
    if not dedupe:
        return fresh
    rest = [c for c in fresh.columns if c not in ("text", id_col)]
    if not rest:
        # a minimum of plain ids stays in the hash aggregate
        return fresh.groupBy("text").agg(F.min(id_col).alias(id_col)).select(*fresh.columns)
    first = F.min(F.struct(F.col(id_col), *[F.col(c) for c in rest])).alias("__first")
    return fresh.groupBy("text").agg(first).select(
        *[F.col("text") if c == "text" else F.col(f"__first.{c}").alias(c) for c in fresh.columns]
    )


def label_map(df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Sorted distinct labels with ids from 0; null is no label.

    Labels are numbered within buckets of the order, which start from the counts
    of the buckets before, so no task needs to hold all labels.
    """
    labels = df.select(F.col(column).alias("label")).where(F.col("label").isNotNull()).distinct()
    placed = running_totals(labels.withColumn("one", F.lit(1)), [], "label", ["one"], rows_per_bucket=rows_per_bucket)
    return placed.select("label", (F.col("one_upto") - 1).cast("int").alias("label_id"))


def encode_labels(df: DataFrame, column: str, labels: DataFrame, into: str = "label_id") -> DataFrame:
    """Add the id of each label; a label the map lacks gets null."""
    lookup = labels.select(F.col("label").alias(column), F.col("label_id").alias(into))
    return df.join(small_side(lookup), column, "left")


def decode_labels(df: DataFrame, column: str, labels: DataFrame, into: str = "label") -> DataFrame:
    lookup = labels.select(F.col("label_id").alias(column), F.col("label").alias(into))
    return df.join(small_side(lookup), column, "left")


def pair_predictions(truth: DataFrame, predicted: DataFrame, id_col: str = "id") -> DataFrame:
    """Join truth and prediction on the row id."""
    return truth.select(id_col, "y_true").join(
        predicted.select(id_col, "y_pred"), id_col, "inner"
    )


def match_counts(truth: DataFrame, predicted: DataFrame, id_col: str = "id") -> DataFrame:
    """How many rows pair_predictions pairs, and how many of each side find no partner.

    Null ids never match. Repeated ids make one pair for each combination.
    """
    here = truth.select(id_col, F.lit(True).alias("__truth"))
    there = predicted.select(id_col, F.lit(True).alias("__predicted"))
    return here.join(there, id_col, "full").agg(
        F.count_if(F.col("__truth") & F.col("__predicted")).alias("paired"),
        F.count_if(F.col("__predicted").isNull()).alias("truth_only"),
        F.count_if(F.col("__truth").isNull()).alias("predicted_only"),
    )


def label_universe(pairs: DataFrame) -> DataFrame:
    """Distinct labels of truth and prediction, read in one pass."""
    both = F.explode(F.array("y_true", "y_pred")).alias("label")
    return pairs.select(both).distinct()
