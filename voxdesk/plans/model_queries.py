"""Queries that write and read files, fit models or run streams. Models have no SQL form."""

from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions.text import is_blank
from voxdesk.operators import classifiers, corpus, evaluation, features, filters, joins, linear, scoring, splits
from voxdesk.plans import sql
from voxdesk.plans.corpus_queries import ORACLE as CORPUS_ORACLE
from voxdesk.session import ensure_checkpoint_dir, shared_dir
from voxdesk.sources.labels import (
    append_label_batch,
    append_labels,
    label_table,
    read_label_batches,
    read_labels,
    read_labels_or_empty,
    read_ratings,
    write_ratings,
)
from voxdesk.sources.messages import read_inbound, read_messages
from voxdesk.sources.results import load_encoders, save_encoders
from voxdesk.streaming.counts import read_stream, run_counts
from voxdesk.streaming.scoring import run_scoring

#: Most rows of a file that arrives.
FILE_ROWS = 100_000


def _labeled(t):
    """Cleaned labelled documents, written because splits and fits read them often."""
    ensure_checkpoint_dir(t.spark)
    return filters.clean_labeled(t.labeled(), keep=("doc_id",)).checkpoint()


def _parts(labeled, label):
    tagged = splits.safe_split(labeled, label)
    return tagged.where(F.col("split") == "train"), tagged.where(F.col("split") == "test")


def _pairs(labeled, label, family="auto"):
    train, test = _parts(labeled, label)
    model = classifiers.fit_task(train, label, family=family)
    predicted = classifiers.predict(model, test).select(
        F.col("doc_id").alias("id"), F.col(f"predicted_{label}").alias("y_pred")
    )
    truth = test.select(F.col("doc_id").alias("id"), F.col(label).alias("y_true"))
    return joins.pair_predictions(truth, predicted)


def _models(t):
    labeled = _labeled(t)
    vectorizer = classifiers.fit_vectorizer(labeled)  # both tasks read the same texts
    return classifiers.fit_tasks(labeled, {"intent": "auto", "severity": "multinomial"}, vectorizer)


def _reply(batch):
    for prompt in batch["prompt"]:
        yield f"Thank you for your message of {len(prompt)} characters.", None


def _evaluation(t):
    labeled = _labeled(t)  # both tasks read the same cleaned texts
    tasks = _pairs(labeled, "intent").withColumn("task", F.lit("intent")).unionByName(
        _pairs(labeled, "severity", "multinomial").withColumn("task", F.lit("severity"))
    )
    return evaluation.accuracy_gate(evaluation.evaluate(tasks, ("task",)))


def _intent_scores(t):
    train, test = _parts(_labeled(t), "intent")
    return classifiers.class_scores(classifiers.fit_task(train, "intent"), test, "doc_id")


def _fact(name, rows, wrong):
    """(fact, checked, violations) over rows with a condition."""
    return rows.agg(
        F.lit(name).alias("fact"), F.count("*").alias("checked"), F.count(F.when(wrong, 1)).alias("violations")
    )


def _score_differences(t, label, family="auto"):
    """Probabilities of a fitted model against the product of its tables with the documents' weights."""
    labeled = _labeled(t)
    model = classifiers.fit_task(labeled, label, family=family)
    tables = linear.model_tables(t.spark, model)
    # Written, since two of the facts read the probabilities, which would weigh all texts for each.
    own = classifiers.class_scores(model, labeled, "doc_id").withColumnsRenamed({"class": "label", "score": "own"}).checkpoint()
    joined = linear.scores_by_join(tables, labeled, "doc_id").join(own, ["doc_id", "label"], "full")
    far = F.col("own").isNull() | F.col("score").isNull() | (F.abs(F.col("own") - F.col("score")) > 1e-9)
    sums = own.groupBy("doc_id").agg(F.sum("own").alias("sum"), F.max_by("label", "own").alias("best"))
    predicted = classifiers.predict(model, labeled).select("doc_id", F.col(f"predicted_{label}").alias("predicted"))
    sums = sums.join(predicted, "doc_id", "full")
    return (
        _fact("scores of the join equal the model's", joined, far)
        .unionByName(_fact("scores sum to one", sums, ~F.coalesce(F.abs(F.col("sum") - 1) < 1e-9, F.lit(False))))
        .unionByName(_fact("the best score is predicted", sums, ~F.col("best").eqNullSafe(F.col("predicted"))))
    )


def _saved(t):
    """Predictions and loss curve of a model's tables, saved and loaded, against the model's own."""
    labeled = _labeled(t)
    model = classifiers.fit_task(labeled, "intent")
    path = shared_dir(t.spark, "model-tables")
    linear.save_tables(linear.model_tables(t.spark, model), path)
    loaded = linear.load_tables(t.spark, path)
    own = classifiers.predict(model, labeled).select("doc_id", "predicted_intent")
    both = linear.predict_by_join(loaded, labeled, "doc_id").join(own, "doc_id", "full")
    curves = loaded.curve.join(
        classifiers.training_curve(model).withColumnRenamed("value", "own"), ["epoch", "metric"], "full"
    )
    steps = _fact("losses after loading equal the fit's", curves, ~F.col("value").eqNullSafe(F.col("own")))
    return _fact("saved tables predict alike", both, ~F.col("label").eqNullSafe(F.col("predicted_intent"))).unionByName(
        # How many iterations a fit takes is its own affair.
        steps.withColumn("checked", F.least(F.col("checked"), F.lit(2).cast("bigint")))
    )


def _stream_facts(t):
    """Scores of a stream against those of the same messages in one batch."""
    models = _models(t)
    sent = t.messages().select("message_id", "text")
    rows = _arriving(t, "conversations")
    arrived = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "text")
    streamed = run_scoring(arrived, *models, responder=_reply, keep=("message_id",))
    batch = scoring.score_messages(sent, *models, _reply, keep=("message_id",))
    names = ["predicted_intent", "predicted_severity", "reply"]
    both = streamed.select("message_id", *names).join(
        batch.select("message_id", *[F.col(c).alias(f"own_{c}") for c in names]), "message_id", "full"
    )
    unlike = F.lit(False)
    for c in names:
        unlike = unlike | ~F.col(c).eqNullSafe(F.col(f"own_{c}"))
    return _fact("a stream scores like a batch", both, unlike)


def _curve(t):
    return classifiers.training_curve(classifiers.fit_task(_labeled(t), "intent"))


def _tuned(t):
    """Mean macro F1 of all candidates of the search over the folds of the labelled documents."""
    folded = splits.assign_folds(_labeled(t), "intent")
    candidates = [c for grid in classifiers.default_grids() for c in grid]
    rows = [
        F.struct(*(F.lit(getattr(c, k)).alias(k) for k in ("c", "terms", "solver", "penalty")), F.lit(score).alias("f1_macro"))
        for c, score in classifiers.tuning_scores(folded, "intent", candidates)
    ]
    return t.spark.range(1).select(F.inline(F.array(*rows)))


def _best_pairs(t):
    """Truth and predictions of the test part by the winner of the search, refitted on the training part."""
    train, test = _parts(_labeled(t), "intent")
    model, _, _ = classifiers.fit_best(splits.assign_folds(train, "intent"), "intent")
    predicted = classifiers.predict(model, test).select(
        F.col("doc_id").alias("id"), F.col("predicted_intent").alias("y_pred")
    )
    truth = test.select(F.col("doc_id").alias("id"), F.col("intent").alias("y_true"))
    return joins.pair_predictions(truth, predicted)


def _scored(t):
    sent = t.read("documents").select("doc_id", "text")
    return scoring.score_messages(sent, *_models(t), _reply, _reply, keep=("doc_id",))


def _arriving(t, table):
    """A table, written in its own partitions, as a stream of about three micro-batches."""
    path = shared_dir(t.spark, "arriving")
    rows = t.read(table)
    most = max(1, min(FILE_ROWS, -(-rows.count() // 3)))
    rows.write.option("maxRecordsPerFile", most).parquet(path)
    files = len(t.spark.read.schema(rows.schema).parquet(path).inputFiles())
    return read_stream(t.spark, path, rows.schema, files_per_trigger=max(1, -(-files // 3)))


def _messages_stream(t):
    rows = _arriving(t, "conversations")
    return rows.select((F.col("role") == "user").alias("inbound"), "text").where(
        ~is_blank(F.col("text"))
    )


def _volume_stream(t):
    return _arriving(t, "orders").select(
        F.col("o_custkey").cast("string").alias("author_id"),
        (F.col("o_orderstatus") != "F").alias("inbound"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


def _stream_scores(t):
    rows = _arriving(t, "conversations")
    sent = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "text")
    return run_scoring(sent, *_models(t), keep=("message_id",))


def _written_csv(t):
    """Conversations and their times written as a message CSV, then its path."""
    path = shared_dir(t.spark, "messages-csv")
    rows = t.messages_with_nulls().select(
        F.col("message_id").alias("tweet_id"),
        "author_id",
        F.when(F.col("inbound"), "True").when(~F.col("inbound"), "False").alias("inbound"),
        F.date_format(
            F.expr("timestamp_ntz'2017-10-31 22:10:47' + make_dt_interval(0, 0, 0, abs(message_id) % 900000)"),
            "EEE MMM dd HH:mm:ss '+0000' yyyy",
        ).alias("created_at"),
        "text",
    )
    rows.write.options(header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false",
                       ignoreTrailingWhiteSpace="false", emptyValue="").csv(path)
    return path


def _labels_file(t):
    """Labelled texts written in two steps, then read back cleaned."""
    labeled = t.labeled().select("text", "intent", "severity")
    calm, urgent = (labeled.where(c) for c in ("severity < 2", "severity >= 2"))
    first, second = (shared_dir(t.spark, "labels") for _ in range(2))
    append_labels(read_labels_or_empty(t.spark, first), calm, first)
    append_labels(read_labels_or_empty(t.spark, first), urgent, second)
    return read_labels(t.spark, second)


def _labels_appended(t):
    """Labelled texts added in two commits, each of them sent twice."""
    labeled = t.labeled().select("text", "intent", "severity")
    table = label_table(t.spark, shared_dir(t.spark, "label-table"))
    for _ in range(2):
        for token, part in (("calm", "severity < 2"), ("urgent", "severity >= 2")):
            append_label_batch(table, labeled.where(part), token)
    return read_label_batches(table)


def _ratings_file(t):
    path = shared_dir(t.spark, "ratings")
    rated = t.ratings().select(
        F.col("generated_reply").alias("original_tweet"),
        F.lit("other").alias("predicted_intent"),
        F.lit(1).alias("predicted_severity"),
        "generated_reply",
        "rating",
        "rater_id",
    )
    write_ratings(rated, path)
    return read_ratings(t.spark, path)


def _encoders(t):
    """Token numbers of the documents, saved and loaded."""
    path = shared_dir(t.spark, "encoders")
    index = features.token_index(t.documents())
    run = t.spark.range(1).select(F.lit(V.SEQUENCE_LENGTH).alias("length"))
    save_encoders(path, index, {"intent": joins.label_map(t.labeled(), "intent")}, run)
    loaded, labels, _ = load_encoders(t.spark, path, ["intent"])
    names = labels["intent"].select(F.col("label").alias("name"), F.col("label_id").alias("idx"))
    return loaded.select(F.col("word").alias("name"), "idx").unionByName(names)


def _csv_read(t):
    read = read_messages(t.spark, _written_csv(t))
    return read.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {
    "messages_csv": _csv_read,
    "inbound_csv": lambda t: read_inbound(t.spark, _written_csv(t)).select("tweet_id", "text"),
    "labels_file": _labels_file,
    "label_commits": _labels_appended,
    "ratings_file": _ratings_file,
    "encoder_tables": _encoders,
    "intent_predictions": lambda t: _pairs(_labeled(t), "intent"),
    "severity_predictions": lambda t: _pairs(_labeled(t), "severity", "multinomial"),
    "intent_scores": _intent_scores,
    "intent_score_facts": lambda t: _score_differences(t, "intent"),
    "severity_score_facts": lambda t: _score_differences(t, "severity", "multinomial"),
    "saved_model_facts": _saved,
    "stream_score_facts": _stream_facts,
    "model_evaluation": _evaluation,
    "training_curve": _curve,
    "tuning_scores": _tuned,
    "tuned_predictions": _best_pairs,
    "scored_messages": _scored,
    "stream_direction_counts": lambda t: run_counts(_messages_stream(t), corpus.direction_counts),
    "stream_length_histogram": lambda t: run_counts(_messages_stream(t), corpus.length_histogram),
    "stream_monthly_volume": lambda t: run_counts(_volume_stream(t), corpus.monthly_volume),
    "stream_top_authors": lambda t: run_counts(_volume_stream(t), corpus.top_authors),
    "stream_scored_messages": _stream_scores,
}

ORACLE = {
    "messages_csv": f"""WITH {sql.MESSAGES_WITH_NULLS}
SELECT message_id AS tweet_id, author_id, inbound,
  strftime(TIMESTAMP '2017-10-31 22:10:47' + to_seconds(abs(message_id) % 900000), '%Y-%m-%d %H:%M:%S') AS created_at,
  CASE WHEN text <> '' THEN text END AS text FROM nulled""",
    "inbound_csv": f"""WITH {sql.MESSAGES_WITH_NULLS}
SELECT message_id AS tweet_id, text FROM nulled WHERE inbound AND {sql.has_text('text')}""",
    "labels_file": f"""WITH {sql.LABELED}
SELECT text, intent, severity::VARCHAR AS severity FROM labeled WHERE {sql.has_text('text')}""",
    "ratings_file": f"""WITH {sql.RATINGS}
SELECT generated_reply AS original_tweet, 'other' AS predicted_intent, 1 AS predicted_severity,
  generated_reply, rating, rater_id FROM ratings""",
    "encoder_tables": f"""WITH {sql.LABELED}, words AS (
  SELECT unnest({sql.sequence_words('text')}) AS word FROM documents),
counts AS (SELECT word, count(*) AS n FROM words GROUP BY 1),
top AS (SELECT * FROM counts ORDER BY n DESC, word LIMIT {V.SEQUENCE_WORDS - 2})
SELECT word AS name, (row_number() OVER (ORDER BY n DESC, word) + 1)::INTEGER AS idx FROM top
UNION ALL SELECT '<OOV>', 1
UNION ALL SELECT intent, (row_number() OVER (ORDER BY intent) - 1)::INTEGER
  FROM (SELECT DISTINCT intent FROM labeled)""",
    "stream_direction_counts": f"""WITH {sql.MESSAGES}, kept AS (
  SELECT inbound FROM messages WHERE {sql.has_text('text')})
SELECT 'Customer (inbound)' AS type, count(*) FILTER (inbound) AS count FROM kept
UNION ALL SELECT 'Support (outbound)', count(*) FILTER (NOT inbound) FROM kept""",
    "stream_length_histogram": CORPUS_ORACLE["length_histogram"],
    "stream_monthly_volume": CORPUS_ORACLE["monthly_volume"],
    "stream_top_authors": CORPUS_ORACLE["top_authors"],
}
ORACLE["label_commits"] = ORACLE["labels_file"]


def _score_facts_sql(label: str) -> str:
    return f"""WITH {sql.LABELED}, usable AS (
  SELECT doc_id, {label} FROM labeled WHERE {sql.has_text(sql.cleaned('text'))})
SELECT 'scores of the join equal the model''s' AS fact, count(*) * count(DISTINCT {label}) AS checked, 0::BIGINT AS violations
FROM usable
UNION ALL SELECT 'scores sum to one', count(*), 0 FROM usable
UNION ALL SELECT 'the best score is predicted', count(*), 0 FROM usable"""


ORACLE["intent_score_facts"] = _score_facts_sql("intent")
ORACLE["severity_score_facts"] = _score_facts_sql("severity")
ORACLE["saved_model_facts"] = f"""WITH {sql.LABELED}
SELECT 'saved tables predict alike' AS fact, count(*) AS checked, 0::BIGINT AS violations
FROM labeled WHERE {sql.has_text(sql.cleaned('text'))}
UNION ALL SELECT 'losses after loading equal the fit''s', 2, 0"""
ORACLE["stream_score_facts"] = f"""WITH {sql.MESSAGES}
SELECT 'a stream scores like a batch' AS fact, count(*) AS checked, 0::BIGINT AS violations FROM messages"""
