"""Queries over label joins, samples, splits and folds, with their SQL."""

from pyspark.sql import functions as F

from voxdesk.operators import joins, splits
from voxdesk.plans import sql
from voxdesk.sources.labels import appended_labels


def _existing(t):
    return t.labeled().select("text", "intent", F.col("severity").cast("string").alias("severity"))


def _appended(t):
    fresh = joins.unlabelled(t.documents(), _existing(t), id_col="doc_id")
    new = fresh.select("text", F.lit("other").alias("intent"), F.lit(2).alias("severity"))
    return appended_labels(_existing(t), new)


def _encoded(t):
    labels = joins.label_map(t.labeled(), "intent")
    return joins.encode_labels(t.labeled().select("doc_id", "intent"), "intent", labels)


def _decoded(t):
    labels = joins.label_map(t.labeled(), "intent")
    return joins.decode_labels(_encoded(t).select("doc_id", "label_id"), "label_id", labels)


def _decision(t):
    """Which way splits by intent, severity, length and doubled ids go, and their test sizes."""
    ids = t.read("documents").select("doc_id")
    tables = {
        "intent": (t.labeled(), "intent"),
        "severity": (t.labeled(), "severity"),
        "length": (t.read("documents"), "n_chars"),
        "doubled": (ids.union(ids), "doc_id"),
    }
    plans = {task: splits.plan_split(df, column) for task, (df, column) in tables.items()}
    rows = [F.struct(
        F.lit(task).alias("task"),
        F.lit(p.rows).cast("long").alias("rows"),
        F.lit(p.classes).cast("long").alias("classes"),
        F.lit(p.test_rows).cast("long").alias("test_rows"),
        F.lit(p.reason).alias("reason"),
    ) for task, p in plans.items()]
    return t.spark.range(1).select(F.inline(F.array(*rows)))


QUERIES = {
    "unlabelled_candidates": lambda t: joins.unlabelled(t.documents(), _existing(t), id_col="doc_id"),
    "unlabelled_distinct": lambda t: joins.unlabelled(
        t.documents(), _existing(t), dedupe=True, id_col="doc_id"
    ),
    "labels_appended": _appended,
    "label_map": lambda t: joins.label_map(t.labeled(), "intent"),
    "labels_encoded": _encoded,
    "labels_decoded": _decoded,
    "seeded_sample": lambda t: splits.sample_n(
        t.read("orders").select("o_orderkey", "o_custkey"), 500, id_col="o_orderkey"
    ),
    "split_random": lambda t: splits.split(
        t.read("orders").select("o_orderkey", "o_orderpriority"), id_col="o_orderkey"
    ),
    "split_stratified": lambda t: splits.safe_split(
        t.read("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", id_col="o_orderkey"
    ),
    "split_fallback": lambda t: splits.safe_split(
        t.read("documents").select("doc_id", "n_chars"), "n_chars"
    ),
    "split_fallback_reason": _decision,
    "split_per_task": lambda t: splits.split_per_task(
        t.labeled().select("doc_id", "intent", "severity"), {"intent": "intent", "severity": "severity"}
    ),
    "split_nested": lambda t: splits.nested_split(t.labeled().select("doc_id", "intent"), "intent"),
    "split_joint": lambda t: splits.safe_split(
        t.labeled().select("doc_id", "intent", "severity"), "intent"
    ),
    "cv_folds": lambda t: splits.assign_folds(t.labeled().select("doc_id", "intent"), "intent"),
}


def _key(seed: str, id_col: str) -> str:
    return f"md5('{seed}|' || {id_col})"


def _stratified(source: str, label: str, id_col: str, seed: str = "42", test: str = "test") -> str:
    """CTEs that tag the rows of a source by quota per class."""
    return f"""sizes_{test} AS (SELECT {label} AS c, count(*) AS n FROM {source} GROUP BY 1),
whole_{test} AS (
  SELECT sum(n)::BIGINT AS total, ceil(0.2::DOUBLE * sum(n)::DOUBLE)::BIGINT AS wanted FROM sizes_{test}),
floors_{test} AS (
  SELECT c, (wanted * n) // total AS base, (wanted * n) % total AS rest, wanted
  FROM sizes_{test}, whole_{test}),
quotas_{test} AS (
  SELECT c, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, c)
    <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM floors_{test}),
placed_{test} AS (
  SELECT s.*, row_number() OVER (PARTITION BY {label} ORDER BY {_key(seed, id_col)}, {id_col}) AS place
  FROM {source} s),
tagged_{test} AS (
  SELECT p.* EXCLUDE (place), CASE WHEN place <= quota THEN '{test}' ELSE 'train' END AS split
  FROM placed_{test} p JOIN quotas_{test} q ON q.c = p.{label})"""


_PRIORITY = "src AS (SELECT o_orderkey, o_orderpriority FROM orders)"

ORACLE = {
    "unlabelled_candidates": f"""WITH {sql.LABELED}
SELECT doc_id, text FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labeled l WHERE l.text = d.text)""",
    "unlabelled_distinct": f"""WITH {sql.LABELED}
SELECT min(doc_id) AS doc_id, text FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labeled l WHERE l.text = d.text) GROUP BY text""",
    "labels_appended": f"""WITH {sql.LABELED}
SELECT text, intent, severity::VARCHAR AS severity FROM labeled
UNION ALL
SELECT text, 'other', '2' FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labeled l WHERE l.text = d.text)""",
    "label_map": f"""WITH {sql.LABELED}
SELECT intent AS label, (row_number() OVER (ORDER BY intent) - 1)::INTEGER AS label_id
FROM (SELECT DISTINCT intent FROM labeled)""",
    "labels_encoded": f"""WITH {sql.LABELED}
SELECT doc_id, intent, (dense_rank() OVER (ORDER BY intent) - 1)::INTEGER AS label_id FROM labeled""",
    "labels_decoded": f"""WITH {sql.LABELED}
SELECT doc_id, (dense_rank() OVER (ORDER BY intent) - 1)::INTEGER AS label_id, intent AS label FROM labeled""",
    "seeded_sample": f"""SELECT o_orderkey, o_custkey FROM orders
ORDER BY {_key('42', 'o_orderkey')}, o_orderkey LIMIT 500""",
    "split_random": f"""SELECT o_orderkey, o_orderpriority,
  CASE WHEN row_number() OVER (ORDER BY {_key('42', 'o_orderkey')}, o_orderkey)
    <= ceil(0.2::DOUBLE * (SELECT count(*) FROM orders)) THEN 'test' ELSE 'train' END AS split
FROM orders""",
    "split_stratified": f"""WITH {_PRIORITY}, {_stratified('src', 'o_orderpriority', 'o_orderkey')}
SELECT o_orderkey, o_orderpriority, split FROM tagged_test""",
    "split_fallback": f"""SELECT doc_id, n_chars,
  CASE WHEN row_number() OVER (ORDER BY {_key('42', 'doc_id')}, doc_id)
    <= ceil(0.2::DOUBLE * (SELECT count(*) FROM documents)) THEN 'test' ELSE 'train' END AS split
FROM documents""",
    "split_fallback_reason": f"""WITH {sql.LABELED}, sizes AS (
  SELECT 'intent' AS task, intent AS c, count(*) AS n FROM labeled GROUP BY ALL
  UNION ALL SELECT 'severity', severity::VARCHAR, count(*) FROM labeled GROUP BY ALL
  UNION ALL SELECT 'length', n_chars::VARCHAR, count(*) FROM documents GROUP BY ALL
  UNION ALL SELECT 'doubled', doc_id::VARCHAR, 2 * count(*) FROM documents GROUP BY ALL)
SELECT task, sum(n)::BIGINT AS rows, count(*) AS classes,
  ceil(0.2::DOUBLE * sum(n)::DOUBLE)::BIGINT AS test_rows,
  CASE WHEN min(n) < 2 THEN 'class_below_two'
       WHEN floor(0.2::DOUBLE * sum(n)::DOUBLE) < count(*) THEN 'test_below_classes'
       ELSE 'stratified' END AS reason
FROM sizes GROUP BY task""",
    "split_per_task": f"""WITH {sql.LABELED}, {_stratified('labeled', 'intent', 'doc_id', '42|intent')},
a AS (SELECT 'intent' AS task, doc_id, intent AS label, split FROM tagged_test)
SELECT * FROM a
UNION ALL
SELECT * FROM (WITH {_stratified('labeled', 'severity', 'doc_id', '42|severity')}
  SELECT 'severity' AS task, doc_id, severity::VARCHAR AS label, split FROM tagged_test)""",
    "split_nested": f"""WITH {sql.LABELED}, {_stratified('labeled', 'intent', 'doc_id')},
remaining AS (SELECT doc_id, intent FROM tagged_test WHERE split = 'train'),
{_stratified('remaining', 'intent', 'doc_id', '42|validation', 'val')}
SELECT doc_id, intent, split FROM tagged_test WHERE split = 'test'
UNION ALL
SELECT doc_id, intent, split FROM tagged_val""",
    "split_joint": f"""WITH {sql.LABELED}, {_stratified('labeled', 'intent', 'doc_id')}
SELECT doc_id, intent, severity, split FROM tagged_test""",
    # Position in the class-sorted order, classes by first appearance, gives the
    # fold sizes; the rows of a class fill the folds in id order.
    "cv_folds": f"""WITH {sql.LABELED}, firsts AS (SELECT intent, min(doc_id) AS first FROM labeled GROUP BY 1),
sorted AS (
  SELECT l.intent, (row_number() OVER (ORDER BY first, l.intent, doc_id) - 1) % 3 AS fold
  FROM labeled l JOIN firsts f ON f.intent = l.intent),
sizes AS (SELECT intent, fold, count(*) AS n FROM sorted GROUP BY ALL),
ends AS (SELECT intent, fold, sum(n) OVER (PARTITION BY intent ORDER BY fold) AS upto FROM sizes),
placed AS (SELECT doc_id, intent, row_number() OVER (PARTITION BY intent ORDER BY doc_id) AS place FROM labeled)
SELECT p.doc_id, p.intent, min(e.fold)::INTEGER AS fold
FROM placed p JOIN ends e ON e.intent = p.intent AND p.place <= e.upto GROUP BY 1, 2""",
}
