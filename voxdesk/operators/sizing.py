"""Size checks before anything is broadcast."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk.session import ensure_checkpoint_dir

BROADCAST_BYTES = 64 * 1024 * 1024
_BYTES_PER_VALUE = 16


def small_side(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if it is small enough, else leave the join to AQE.

    The frame is written once; the check and the join read what was written, so
    nothing is computed twice, stays cached, or is lost with an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    written = df.checkpoint()
    text_bytes = F.lit(0)
    for field in df.schema.fields:
        text_bytes = text_bytes + F.coalesce(
            F.octet_length(F.to_json(F.struct(F.col(field.name)))), F.lit(0)
        )
    size = written.agg(
        F.coalesce(F.sum(text_bytes + _BYTES_PER_VALUE), F.lit(0)).alias("bytes")
    ).first()["bytes"]
    return F.broadcast(written) if size <= limit_bytes else written
