"""Message scoring on a stream."""

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxdesk.operators.asking import Model
from voxdesk.operators.ledger import CallLedger
from voxdesk.operators.scoring import score_messages
from voxdesk.session import shared_dir
from voxdesk.sources.commits import CommittedTable


def run_scoring(
    stream: DataFrame,
    intent_model: PipelineModel,
    severity_model: PipelineModel,
    responder: Model | None = None,
    keep: tuple[str, ...] = (),
    folder: str | None = None,
    explainer: Model | None = None,
    parallelism: int | None = None,
) -> DataFrame:
    """Score every message there is and return the sink's rows.

    A later run with the same folder scores only new files. Scoring alone keeps no
    state; the file sink's log makes each batch appear once. With replies or
    explanations each batch goes through a call ledger in the folder: its calls
    are written before they are used, and a batch that failed behind them is
    repeated without a call. Its rows are committed under the batch's number, so
    a repeated batch appears once. A quota error ends the calls of this and all
    later batches of the run; the next run on the folder calls again.
    """
    base = folder or shared_dir(stream.sparkSession, "stream-scores")
    if responder is None and explainer is None:
        return _run_to_files(stream, score_messages(stream, intent_model, severity_model, keep=keep), base)
    added = T.StructType.fromDDL("predicted_intent string, predicted_severity int, reply string, explanation string")
    schema = T.StructType([*[stream.schema[c] for c in (*keep, "text")], *added])
    ledgers: list[CallLedger] = []

    def score(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not ledgers:
            ledgers.append(CallLedger(spark, os.path.join(base, "ledger"), parallelism=parallelism))
        sink = CommittedTable(spark, os.path.join(base, "scored"), schema)
        token = f"batch-{number}"
        if token not in sink.commits():
            scored = score_messages(
                batch, intent_model, severity_model, responder, explainer, keep=keep, ledger=ledgers[0]
            )
            sink.append(scored, token)

    query = (
        stream.writeStream.foreachBatch(score)
        .option("checkpointLocation", os.path.join(base, "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return CommittedTable(stream.sparkSession, os.path.join(base, "scored"), schema).read()


def _run_to_files(stream: DataFrame, scored: DataFrame, base: str) -> DataFrame:
    sink = os.path.join(base, "scored")
    query = (
        scored.writeStream.outputMode("append")
        .format("parquet")
        .option("path", sink)
        .option("checkpointLocation", os.path.join(base, "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(scored.schema).parquet(sink)
