"""Calls to a pluggable text model, and what follows from its answers.

A model is a callable that gets a pandas batch and returns one (answer, error)
pair per row. It runs inside mapInPandas on the executors; the library has no
network code. Status and parsing are column expressions.
"""

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxdesk import fixed_values as V
from voxdesk.functions.responses import (
    answer_lines,
    is_quota_error,
    label_from_lines,
    sample_lines,
    speaks_of_quota,
)
from voxdesk.session import ship_package

Model = Callable[[pd.DataFrame], Iterable[tuple[str | None, str | None]]]
#: Texts and candidate labels to one (list of (label, score), error) pair per text.
Scorer = Callable[[list[str], list[str]], Iterable[tuple[list[tuple[str, float]] | None, str | None]]]

#: Rows of an Arrow batch that a model sees at once, so that its texts are not all held twice.
ASK_ROWS = 256


def per_row(
    answer_one: Callable[[str], str], column: str = "prompt", delay: float = 0.0
) -> Model:
    """A model from a function of one text; what it raises becomes the error.

    delay is the pause in seconds after each call. With ask's parallelism it
    bounds the call rate.
    """

    def answer(batch: pd.DataFrame):
        for value in batch[column]:
            try:
                yield answer_one(value), None
            except Exception as error:  # any failure of the called service
                yield None, str(error)
            if delay:
                time.sleep(delay)

    return answer


def keyword_model(
    intents: list[tuple[str, str]], severities: list[tuple[str, int]], column: str = "text"
) -> Model:
    """A deterministic labeler: the first keyword found in the text decides."""

    def first_found(texts: pd.Series, listed: list[tuple], default) -> pd.Series:
        out = pd.Series(default, index=texts.index, dtype=object)
        for word, value in reversed(listed):
            out[texts.str.contains(word, regex=False)] = value
        return out

    def answer(batch: pd.DataFrame):
        texts = batch[column].str.lower()
        intent = first_found(texts, intents, V.DEFAULT_INTENT)
        severity = first_found(texts, severities, V.ONLINE_DEFAULT_SEVERITY)
        answers = "Intent: " + intent.astype(str) + "\nSeverity: " + severity.astype(str)
        return zip(answers, [None] * len(answers), strict=True)

    return answer


def _answers(model: Model, batch: pd.DataFrame, stop: bool) -> tuple[list, bool]:
    """(pairs, whether a quota error ended them); rows behind that error are not asked."""
    pairs = []
    for pair in model(batch):
        pairs.append(pair)
        if stop and pair[1] is not None and speaks_of_quota(pair[1]):
            return pairs + [(None, V.NOT_ASKED)] * (len(batch) - len(pairs)), True
    return pairs, False


def ask(
    df: DataFrame, model: Model, needs: str = "prompt", parallelism: int | None = None,
    stop_on_quota: bool = False, order: Column | None = None,
) -> DataFrame:
    """Add answer, error and status ('ok', 'quota', 'error').

    Rows whose needed column is null are passed on unasked with a null status.
    parallelism bounds how many callers run at once. With stop_on_quota a caller
    makes no further call after its first quota error, provided the model yields
    its answers one by one; its later rows get the status 'quota'. order sorts
    each caller's rows, so that all rows it leaves out stand behind the error.

    The model sees a pandas batch of ASK_ROWS rows at most, in which whole numbers stay whole numbers even
    beside nulls; the rows themselves never pass through pandas.
    """
    ship_package(df.sparkSession)
    schema = T.StructType(
        [*df.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stopped = False
        for whole in batches:
            for at in range(0, whole.num_rows, ASK_ROWS):
                batch = whole.slice(at, ASK_ROWS)
                asked = batch.column(needs).is_valid()
                rows = batch.filter(asked).to_pandas(integer_object_nulls=True)
                if stopped:
                    pairs = [(None, V.NOT_ASKED)] * len(rows)
                else:
                    pairs, stopped = _answers(model, rows, stop_on_quota)
                found = iter(pairs)
                listed = [next(found) if a else (None, None) for a in asked.to_pylist()]
                columns = [pa.array([pair[k] for pair in listed], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)
            pa.default_memory_pool().release_unused()

    spread = df.repartition(parallelism) if parallelism else df
    if order is not None:
        spread = spread.sortWithinPartitions(order)
    status = F.when(F.col(needs).isNotNull(), answer_status(F.col("error")))
    return spread.mapInArrow(run, schema).withColumn("status", status)


def score_labels(
    df: DataFrame, scorer: Scorer, asked: dict[str, tuple[Column, list[str]]], parallelism: int | None = None
) -> DataFrame:
    """df with, for each task, an array <task> of (label, score) and <task>_error.

    asked names the tasks with the text they read and the candidate labels. Rows
    whose text is null are not asked and have both columns null. What a scorer
    raises becomes the error of all rows of its batch that it had not answered.
    """
    ship_package(df.sparkSession)
    scores = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))
    kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))
    texts = df.select("*", *[text.alias(f"__{task}") for task, (text, _) in asked.items()])
    candidates, width = {task: labels for task, (_, labels) in asked.items()}, len(df.columns)
    added = [f for t in asked for f in (T.StructField(t, scores), T.StructField(f"{t}_error", T.StringType()))]
    schema = T.StructType([*df.schema.fields, *added])

    def rated(column: pa.Array, labels: list[str]) -> list[pa.Array]:
        given = [t for t in column.to_pylist() if t is not None]
        found = []
        try:
            for pair in scorer(given, labels):
                found.append(pair)
        except Exception as error:  # any failure of the called model
            found += [(None, str(error))] * (len(given) - len(found))
        answers = iter(found)
        rows = [next(answers) if t is not None else (None, None) for t in column.to_pylist()]
        listed = [None if s is None else [{"label": n, "score": v} for n, v in s] for s, _ in rows]
        return [pa.array(listed, kind), pa.array([e for _, e in rows], pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [c for task, labels in candidates.items() for c in rated(batch.column(f"__{task}"), labels)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *own], names=schema.names)

    return (texts.repartition(parallelism) if parallelism else texts).mapInArrow(run, schema)


def answer_status(error: Column) -> Column:
    return (
        F.when(error.isNull(), "ok").when(is_quota_error(error), "quota").otherwise("error")
    )


def cut_at_first_quota(df: DataFrame, order: Column) -> DataFrame:
    """Keep rows before the first quota error in the given order.

    The cut-off is a one-row aggregate used as a scalar, so no row is sorted.
    """
    first = df.where(F.col("status") == "quota").agg(F.min(order).alias("first"))
    return df.where(F.coalesce(order < first.scalar(), F.lit(True)))


def parse_labels(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Add intent and severity read from an answer; both null if it has no line."""
    lines = df.withColumn("__lines", answer_lines(F.col(answer)))
    parsed = lines.withColumn("__parsed", label_from_lines(F.col("__lines")))
    return parsed.select(*df.columns, "__parsed.intent", "__parsed.severity")


def explode_samples(df: DataFrame, answer: str, n: Column) -> DataFrame:
    """One row (pos, sample) per usable line of a generated list, at most n."""
    # The outer form avoids an added size filter that would parse every answer twice.
    lines = F.posexplode_outer(sample_lines(F.col(answer), n)).alias("pos", "sample")
    return df.select("*", lines).where(F.col("pos").isNotNull())


def _best_labels(scores: DataFrame, id_col: str, allowed: list[str]) -> DataFrame:
    """One row (id, best) per id.

    Labels without a score are no candidates. Scores first shrink to one per
    (id, label), so a hot id is combined before it meets in one task.
    """
    per_label = scores.where(F.col("score").isNotNull()).groupBy(id_col, "label").agg(F.max("score").alias("score"))
    place = F.array_position(F.array(*[F.lit(a) for a in allowed]), F.col("label"))
    place = F.when(place == 0, len(allowed) + 1).otherwise(place)
    lowest = F.min(F.struct((-F.col("score")).alias("s"), place.alias("p"), F.col("label")))
    return per_label.groupBy(id_col).agg(lowest["label"].alias("best"))


def top_label(
    ids: DataFrame, scores: DataFrame, id_col: str, allowed: list[str],
    default: str = V.DEFAULT_INTENT,
) -> DataFrame:
    """Best-scored label per id; unknown or missing labels become the default.

    Equal scores go to the label that stands first in the allowed list, then by name.
    """
    best = _best_labels(scores, id_col, allowed)
    known = F.when(F.col("best").isin(allowed), F.col("best"))
    return ids.select(id_col).join(best, id_col, "left").select(
        id_col, F.coalesce(known, F.lit(default)).alias("intent")
    )


def top_severity(
    ids: DataFrame, scores: DataFrame, id_col: str,
    allowed: list[str] = V.OFFLINE_SEVERITIES, default: int = V.OFFLINE_DEFAULT_SEVERITY,
) -> DataFrame:
    """Best-scored severity per id as int; outside the scale or missing is the default."""
    best = _best_labels(scores, id_col, allowed)
    value = F.col("best").try_cast("int")
    known = F.when(value.isin([int(a) for a in allowed]), value)
    return ids.select(id_col).join(best, id_col, "left").select(
        id_col, F.coalesce(known, F.lit(default)).alias("severity")
    )
