"""Scoring of new messages with two fitted tasks and optional reply models."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions.prompts import explanation_prompt, reply_prompt
from voxdesk.functions.responses import explanation_or_fallback, reply_or_fallback
from voxdesk.functions.text import clean_text, is_blank
from voxdesk.operators.asking import Model
from voxdesk.operators.classifiers import predict_tasks
from voxdesk.operators.ledger import Call, CallLedger


def empty_fallback(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages without text after cleaning, with their constant answer."""
    return df.where(is_blank(clean_text(F.col("text")))).select(
        *keep,
        "text",
        F.lit(V.DEFAULT_INTENT).alias("predicted_intent"),
        F.lit(V.ONLINE_DEFAULT_SEVERITY).alias("predicted_severity"),
        F.lit(V.EMPTY_REPLY).alias("reply"),
        F.lit(V.EMPTY_EXPLANATION).alias("explanation"),
    )


def score_messages(
    df: DataFrame,
    intent_model: PipelineModel,
    severity_model: PipelineModel,
    responder: Model | None = None,
    explainer: Model | None = None,
    parallelism: int | None = None,
    keep: tuple[str, ...] = (),
    ledger: CallLedger | None = None,
) -> DataFrame:
    """Predict intent and severity; attach replies and explanations if wanted.

    Prediction reads the cleaned text, prompts hold the raw one. Emptied
    messages get constants and are never sent to a model. Replies and
    explanations are calls of one ledger and stop together at a quota error;
    a given ledger shares its calls and its stop with other jobs. A stream has
    no ledger here, see streaming.scoring.
    """
    raw = df.select(*keep, F.col("text").alias("__raw"), clean_text(F.col("text")).alias("__clean"))
    scored = raw.withColumn("text", F.coalesce("__clean", F.lit("")))
    scored = predict_tasks([intent_model, severity_model], scored)
    empty = is_blank(F.col("__clean"))
    rows = scored.select(
        *keep,
        F.col("__raw").alias("text"),
        F.when(empty, F.lit(V.DEFAULT_INTENT)).otherwise(F.col("predicted_intent")).alias("predicted_intent"),
        F.when(empty, F.lit(V.ONLINE_DEFAULT_SEVERITY))
        .otherwise(F.col("predicted_severity").cast("int"))
        .alias("predicted_severity"),
        empty.alias("__empty"),
    )
    return _with_replies(rows, responder, explainer, keep, ledger or _ledger(rows, responder, explainer, parallelism)).drop(
        "__empty"
    )


def _ledger(rows: DataFrame, responder: Model | None, explainer: Model | None, parallelism: int | None) -> CallLedger | None:
    if responder is None and explainer is None:
        return None
    if rows.isStreaming:
        raise ValueError("calls of a stream need the ledger of streaming.scoring.run_scoring")
    return CallLedger(rows.sparkSession, parallelism=parallelism)


def _with_replies(rows, responder, explainer, keep, ledger) -> DataFrame:
    """Replies and explanations; a wave's replies come before its explanations."""
    empty = F.col("__empty")
    about = (F.col("text"), F.col("predicted_intent"), F.col("predicted_severity"))
    kinds = [
        ("reply", responder, reply_prompt, reply_or_fallback, V.EMPTY_REPLY),
        ("explanation", explainer, explanation_prompt, explanation_or_fallback, V.EMPTY_EXPLANATION),
    ]
    calls = [Call(kind, model, F.when(~empty, prompt(*about))) for kind, model, prompt, _, _ in kinds if model]
    out = ledger.ask(rows, calls, *keep, "text") if calls else rows
    for kind, model, _, finish, constant in kinds:
        given = F.when(empty, F.lit(constant))
        if model:
            given = given.otherwise(finish(F.col(f"{kind}_status"), F.col(f"{kind}_answer")))
        out = out.withColumn(kind, given)
    return out.drop(*[f"{c.kind}_{part}" for c in calls for part in ("answer", "error", "status")])
