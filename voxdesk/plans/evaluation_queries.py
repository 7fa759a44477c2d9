"""Queries over evaluation, comparison and rating tables, with their SQL.

Averages of fractions are rounded to nine decimals on both sides, because
engines add doubles in different orders.
"""

from pyspark.sql import functions as F

from voxdesk.functions.decisions import above_threshold, argmax
from voxdesk.operators import comparison, evaluation, joins, ratings, roc
from voxdesk.plans import sql
from voxdesk.plans.views import class_sums
from voxdesk.plans.views import PRIORITIES

_LISTED = ["5-LOW", "1-URGENT", "6-UNSEEN"]
_METRICS = [
    "accuracy",
    "precision_macro",
    "recall_macro",
    "f1_macro",
    "precision_weighted",
    "recall_weighted",
    "f1_weighted",
]


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _evaluated(df):
    return _rounded(df, *_METRICS)


def _by_task(t):
    by_priority = t.pairs().select(F.lit("intent").alias("task"), "y_true", "y_pred")
    by_quality = t.pairs_binary().select(
        F.lit("severity").alias("task"),
        F.col("y_true").cast("string").alias("y_true"),
        F.col("y_pred").cast("string").alias("y_pred"),
    )
    return _evaluated(evaluation.evaluate(by_priority.unionByName(by_quality), ("task",)))


def _long(t):
    """Metrics of both models; the price model's macro F1 is null, its recall is missing."""
    long = comparison.metrics_long(evaluation.evaluate(t.pairs_by_model(), ("model",)))
    price = F.col("model") == "price"
    blanked = F.when(price & (F.col("metric") == "f1_macro"), None).otherwise(F.col("value"))
    return long.where(~(price & (F.col("metric") == "recall_macro"))).withColumn(
        "value", F.round(blanked, 9)
    )


def _two_models(t):
    names = {"Intent": "status", "Severity": "absent"}
    others = {"Intent": "price", "Severity": "price"}
    return comparison.compare_two(_long(t), names, others)


def _decisions(t):
    """Class of the greatest class sum, and the sign of the first."""
    return t.read("embeddings").select("vec_id", class_sums(F.col("embedding")).alias("sums")).select(
        "vec_id",
        argmax(F.col("sums")).alias("predicted"),
        above_threshold(F.get("sums", F.lit(0)), 0.0).alias("decision"),
    )


QUERIES = {
    "class_decisions": _decisions,
    "paired_predictions": lambda t: joins.pair_predictions(
        t.pairs().select("id", "y_true"), t.pairs().select("id", "y_pred")
    ),
    "prediction_matches": lambda t: joins.match_counts(
        t.pairs().where("id % 5 != 0"), t.pairs().where("id % 7 != 0")
    ),
    "label_universe": lambda t: joins.label_universe(t.pairs()),
    "confusion_matrix": lambda t: evaluation.confusion(t.pairs()),
    "confusion_matrix_listed": lambda t: evaluation.confusion(t.pairs(), _LISTED),
    "confusion_norm_true": lambda t: _rounded(evaluation.confusion_normalised(t.pairs(), "true", _LISTED), "share"),
    "confusion_norm_pred": lambda t: _rounded(evaluation.confusion_normalised(t.pairs(), "pred", _LISTED), "share"),
    "confusion_norm_all": lambda t: _rounded(evaluation.confusion_normalised(t.pairs(), "all"), "share"),
    "eval_metrics": lambda t: _evaluated(evaluation.evaluate(t.pairs())),
    "eval_by_task": _by_task,
    "per_class_metrics": lambda t: _rounded(
        evaluation.per_class_metrics(t.pairs()).drop("tp"), "precision", "recall", "f1"
    ),
    "per_class_ordered": lambda t: _rounded(
        evaluation.per_class_ordered(t.pairs(), _LISTED), "precision", "recall", "f1"
    ),
    "binary_metrics": lambda t: _rounded(
        evaluation.binary_metrics(t.pairs_binary()), "precision_binary", "recall_binary", "f1_binary"
    ),
    "classification_report": lambda t: _rounded(
        evaluation.classification_report(t.pairs()), "precision", "recall", "f1"
    ),
    "accuracy_gate": lambda t: evaluation.accuracy_gate(
        evaluation.evaluate(t.pairs_by_model(), ("model",)).select("model", "accuracy"), 0.4
    ),
    "top_errors": lambda t: evaluation.top_errors(t.pairs()),
    "agreement_by_label": lambda t: _rounded(
        evaluation.agreement_by_label(t.pairs(), [*PRIORITIES, "6-UNSEEN"]), "agreement"
    ),
    "roc_binary": lambda t: roc.roc_points(t.scores_binary(), []),
    "roc_binary_full": lambda t: roc.roc_points(t.scores_binary(), [], drop_intermediate=False),
    "auc_binary": lambda t: roc.roc_auc(t.scores_binary(), []),
    "roc_per_class": lambda t: roc.roc_points(roc.one_vs_rest(t.scores()), ["class"]),
    "auc_per_class": lambda t: roc.roc_auc(roc.one_vs_rest(t.scores()), ["class"]),
    "roc_micro": lambda t: roc.roc_points(roc.one_vs_rest(t.scores()), []),
    "auc_micro": lambda t: roc.roc_auc(roc.one_vs_rest(t.scores()), []),
    "auc_macro": lambda t: _rounded(roc.auc_macro(t.scores()), "roc_auc_macro"),
    "model_comparison": lambda t: comparison.compare_models(_long(t), "recall_macro"),
    "metrics_comparison": lambda t: comparison.compare_metrics(_long(t)),
    "two_model_accuracy": _two_models,
    "results_table": lambda t: comparison.results_table(_long(t), _METRICS),
    "ratings_valid": lambda t: ratings.ratings_valid(t.ratings()),
    "ratings_rejected": lambda t: ratings.ratings_rejected(t.ratings()),
    "rating_mean": lambda t: _rounded(ratings.rating_mean(ratings.ratings_valid(t.ratings())), "mean_rating"),
    "rating_distribution": lambda t: ratings.rating_distribution(ratings.ratings_valid(t.ratings())),
    "rating_summary": lambda t: _rounded(
        ratings.rating_summary(ratings.ratings_valid(t.ratings())), "mean_rating", "percent"
    ),
}

_LISTED_SQL = f"listed AS (SELECT unnest([{sql.values(_LISTED)}]) AS label)"


def _cells_sql(labels: str) -> str:
    """CTEs of dense counts over the labels of one CTE."""
    return f"""domain AS (SELECT list(label) AS names FROM {labels}),
side AS (SELECT unnest(names) AS y_true, names FROM domain),
grid AS (SELECT y_true, unnest(names) AS y_pred FROM side),
cells AS (
  SELECT g.y_true, g.y_pred, count(p.id) AS n
  FROM grid g LEFT JOIN pairs p ON p.y_true = g.y_true AND p.y_pred = g.y_pred GROUP BY ALL)"""


_LISTED_CELLS = f"{sql.PAIRS}, {_LISTED_SQL}, {_cells_sql('listed')}"
_ALL_CELLS = f"""{sql.PAIRS}, u AS (SELECT y_true AS label FROM pairs UNION SELECT y_pred FROM pairs),
{_cells_sql('u')}"""


def _evaluate_sql(key: str = "") -> str:
    prefix = f"{key}, " if key else ""
    group = f" GROUP BY {key}" if key else ""
    macro = ", ".join(f"round(avg({m}), 9) AS {m}_macro" for m in ("precision", "recall", "f1"))
    weighted = ", ".join(
        f"round(sum({m} * support)::DOUBLE / sum(support)::DOUBLE, 9) AS {m}_weighted"
        for m in ("precision", "recall", "f1")
    )
    return f"""SELECT {prefix}round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 9) AS accuracy,
  {macro}, {weighted} FROM class_rows{group}"""


_TASKS = f"""{sql.PAIRS}, {sql.PAIRS_BINARY}, tasks AS (
  SELECT 'intent' AS task, y_true, y_pred FROM pairs
  UNION ALL SELECT 'severity', y_true::VARCHAR, y_pred::VARCHAR FROM pairs_binary)"""
_LONG = f"""{sql.PAIRS_BY_MODEL}, {sql.per_class('pairs_by_model', 'model')},
wide AS ({_evaluate_sql('model')}),
long_rows AS (
  SELECT model, metric, CASE WHEN model = 'price' AND metric = 'f1_macro' THEN NULL ELSE value END AS value
  FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (model)) INTO NAME metric VALUE value)
  WHERE NOT (model = 'price' AND metric = 'recall_macro'))"""


def _roc_sql(rows: str, key: str, full: bool = False) -> str:
    """Curve from rows (key, score, positive) by plain windows."""
    group = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    bend = "true" if full else "rn = 1 OR next_p IS NULL OR p <> next_p OR n <> next_n"
    totals = f"SELECT {group}0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM counts" + (
        f" GROUP BY {key}" if key else " LIMIT 1"
    )
    return f"""{rows}, counts AS (
  SELECT {group}score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n
  FROM positives GROUP BY ALL),
curve AS (
  SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, row_number() OVER w AS rn,
    lead(p) OVER w AS next_p, lead(n) OVER w AS next_n,
    sum(p) OVER ({part}) AS all_p, sum(n) OVER ({part}) AS all_n
  FROM counts WINDOW w AS ({part} ORDER BY score DESC))
SELECT {group}score AS threshold, fp::DOUBLE / all_n::DOUBLE AS fpr, tp::DOUBLE / all_p::DOUBLE AS tpr
FROM curve WHERE {bend}
UNION ALL
SELECT {group}NULL::DOUBLE AS threshold, fpr, tpr FROM ({totals})"""


def _auc_sql(rows: str, key: str) -> str:
    group = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    return f"""{rows}, counts AS (
  SELECT {group}score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n
  FROM positives GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER ({part} ORDER BY score) - n AS below FROM counts),
areas AS (
  SELECT {group}sum(p::DOUBLE * (below::DOUBLE + n::DOUBLE / 2::DOUBLE))
    / nullif(sum(p)::DOUBLE * sum(n)::DOUBLE, 0) AS auc
  FROM ranked {'GROUP BY ' + key if key else ''})"""


_BINARY = f"{sql.SCORES_BINARY}, positives AS (SELECT score, positive FROM scores_binary)"
_OVR = f"{sql.SCORES}, positives AS (SELECT class, score, class = truth AS positive FROM scores)"
_CLASS_COLUMNS = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"

ORACLE = {
    "prediction_matches": f"""WITH {sql.PAIRS}
SELECT count(*) FILTER (id % 5 <> 0 AND id % 7 <> 0) AS paired,
  count(*) FILTER (id % 5 <> 0 AND id % 7 = 0) AS truth_only,
  count(*) FILTER (id % 5 = 0 AND id % 7 <> 0) AS predicted_only FROM pairs""",
    "class_decisions": f"""SELECT vec_id,
  (list_position(sums, list_max(sums)) - 1)::INTEGER AS predicted,
  CASE WHEN sums[1] > 0 THEN 1 ELSE 0 END AS decision FROM (SELECT vec_id, {sql.CLASS_SUMS} AS sums FROM embeddings)""",
    "paired_predictions": f"WITH {sql.PAIRS} SELECT id, y_true, y_pred FROM pairs",
    "label_universe": f"""WITH {sql.PAIRS}
SELECT y_true AS label FROM pairs UNION SELECT y_pred FROM pairs""",
    "confusion_matrix": f"WITH {_ALL_CELLS} SELECT * FROM cells",
    "confusion_matrix_listed": f"WITH {_LISTED_CELLS} SELECT * FROM cells",
    "confusion_norm_true": f"""WITH {_LISTED_CELLS}
SELECT y_true, y_pred, round(coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY y_true), 0)::DOUBLE, 0), 9)
  AS share FROM cells""",
    "confusion_norm_pred": f"""WITH {_LISTED_CELLS}
SELECT y_true, y_pred, round(coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY y_pred), 0)::DOUBLE, 0), 9)
  AS share FROM cells""",
    "confusion_norm_all": f"""WITH {_ALL_CELLS}
SELECT y_true, y_pred, round(n::DOUBLE / (sum(n) OVER ())::DOUBLE, 9) AS share FROM cells""",
    "eval_metrics": f"WITH {sql.PAIRS}, {sql.per_class('pairs')} {_evaluate_sql()}",
    "eval_by_task": f"WITH {_TASKS}, {sql.per_class('tasks', 'task')} {_evaluate_sql('task')}",
    "per_class_metrics": f"""WITH {sql.PAIRS}, {sql.per_class('pairs')}
SELECT label, {_CLASS_COLUMNS}, support FROM class_rows""",
    "per_class_ordered": f"""WITH {sql.PAIRS}, {sql.per_class('pairs')},
wanted AS (SELECT unnest([{sql.values(_LISTED)}]) AS label, unnest([0, 1, 2])::INTEGER AS position)
SELECT label, position, {_CLASS_COLUMNS}, support FROM wanted LEFT JOIN class_rows USING (label)""",
    "binary_metrics": f"""WITH {sql.PAIRS_BINARY}, sums AS (
  SELECT 1 AS positive, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp,
    count(*) FILTER (y_true = 1) AS support, count(*) FILTER (y_pred = 1) AS predicted
  FROM pairs_binary)
SELECT positive::INTEGER AS positive, round({sql.ratio('tp', 'predicted')}, 9) AS precision_binary,
  round({sql.ratio('tp', 'support')}, 9) AS recall_binary,
  round({sql.ratio('2 * tp', 'support + predicted')}, 9) AS f1_binary FROM sums""",
    "classification_report": f"""WITH {sql.PAIRS}, {sql.per_class('pairs')}
SELECT label AS row, {_CLASS_COLUMNS}, support FROM class_rows
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 9), sum(support)::BIGINT
FROM class_rows
UNION ALL
SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
  sum(support)::BIGINT FROM class_rows
UNION ALL
SELECT 'weighted avg', round(sum(precision * support)::DOUBLE / sum(support)::DOUBLE, 9),
  round(sum(recall * support)::DOUBLE / sum(support)::DOUBLE, 9),
  round(sum(f1 * support)::DOUBLE / sum(support)::DOUBLE, 9), sum(support)::BIGINT FROM class_rows""",
    "accuracy_gate": f"""WITH {sql.PAIRS_BY_MODEL}, rates AS (
  SELECT model, count(*) FILTER (y_true = y_pred)::DOUBLE / count(*)::DOUBLE AS accuracy
  FROM pairs_by_model GROUP BY 1)
SELECT model, accuracy, accuracy >= 0.4 AS meets_threshold FROM rates""",
    "top_errors": f"""WITH {sql.PAIRS}
SELECT y_true, y_pred, count(*) AS n FROM pairs WHERE y_true <> y_pred
GROUP BY ALL ORDER BY n DESC, y_true, y_pred LIMIT 10""",
    "agreement_by_label": f"""WITH {sql.PAIRS},
wanted AS (SELECT unnest([{sql.values([*PRIORITIES, '6-UNSEEN'])}]) AS label)
SELECT w.label, round(count(p.id) FILTER (p.y_true = p.y_pred)::DOUBLE / nullif(count(p.id), 0)::DOUBLE, 9)
  AS agreement
FROM wanted w LEFT JOIN pairs p ON p.y_true = w.label GROUP BY 1""",
    "roc_binary": f"WITH {_roc_sql(_BINARY, '')}",
    "roc_binary_full": f"WITH {_roc_sql(_BINARY, '', full=True)}",
    "auc_binary": f"WITH {_auc_sql(_BINARY, '')} SELECT auc FROM areas",
    "roc_per_class": f"WITH {_roc_sql(_OVR, 'class')}",
    "auc_per_class": f"WITH {_auc_sql(_OVR, 'class')} SELECT class, auc FROM areas",
    "roc_micro": f"WITH {_roc_sql(_OVR, '')}",
    "auc_micro": f"WITH {_auc_sql(_OVR, '')} SELECT auc FROM areas",
    "auc_macro": f"""WITH {_auc_sql(_OVR, 'class')}
SELECT round(avg(auc), 9) AS roc_auc_macro, count(*) FILTER (auc IS NULL) AS undefined_classes FROM areas""",
    "model_comparison": f"""WITH {_LONG}
SELECT m.model, CASE WHEN count(l.metric) = 0 THEN 0.0::DOUBLE ELSE max(l.value) END AS value
FROM (SELECT DISTINCT model FROM long_rows) m
LEFT JOIN long_rows l ON l.model = m.model AND l.metric = 'recall_macro' GROUP BY 1""",
    "metrics_comparison": f"""WITH {_LONG}, grid AS (
  SELECT model, unnest(['accuracy', 'precision_macro', 'recall_macro', 'f1_macro']) AS metric
  FROM (SELECT DISTINCT model FROM long_rows))
SELECT g.model, g.metric, CASE WHEN count(l.metric) = 0 THEN 0.0::DOUBLE ELSE max(l.value) END AS value
FROM grid g LEFT JOIN long_rows l ON l.model = g.model AND l.metric = g.metric GROUP BY ALL""",
    "two_model_accuracy": f"""WITH {_LONG}, accuracy AS (
  SELECT model, value FROM long_rows WHERE metric = 'accuracy'),
wanted AS (
  SELECT 'Intent' AS task, 'status' AS a, 'price' AS b UNION ALL SELECT 'Severity', 'absent', 'price')
SELECT task, x.value AS first, y.value AS second
FROM wanted LEFT JOIN accuracy x ON x.model = a LEFT JOIN accuracy y ON y.model = b""",
    "results_table": f"""WITH {_LONG}
SELECT model, {', '.join(f"round(max(value) FILTER (metric = '{m}'), 4) AS {m}" for m in _METRICS)}
FROM long_rows GROUP BY 1""",
    "ratings_valid": f"WITH {sql.RATINGS} SELECT * FROM ratings WHERE rating BETWEEN 1 AND 5",
    "ratings_rejected": f"""WITH {sql.RATINGS}
SELECT *, 'Rating must be between 1 and 5' AS reason FROM ratings WHERE NOT rating BETWEEN 1 AND 5""",
    "rating_mean": f"""WITH {sql.RATINGS}
SELECT round(coalesce(avg(rating), 0), 9) AS mean_rating FROM ratings WHERE rating BETWEEN 1 AND 5""",
    "rating_distribution": f"""WITH {sql.RATINGS}, scale AS (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS rating)
SELECT s.rating, count(r.rating) AS count FROM scale s LEFT JOIN ratings r USING (rating) GROUP BY 1""",
    "rating_summary": f"""WITH {sql.RATINGS}, valid AS (SELECT * FROM ratings WHERE rating BETWEEN 1 AND 5),
scale AS (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS rating)
SELECT (SELECT count(*) FROM valid) AS total, (SELECT round(avg(rating), 9) FROM valid) AS mean_rating,
  s.rating, count(v.rating) AS count,
  round(100::DOUBLE * count(v.rating) / (SELECT count(*) FROM valid)::DOUBLE, 9) AS percent
FROM scale s LEFT JOIN valid v USING (rating) GROUP BY s.rating""",
}
