"""Queries over corpus and label statistics, with their SQL."""

from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions.text import is_blank
from voxdesk.operators import corpus, filters
from voxdesk.plans import sql


def _length_histogram(t):
    return corpus.length_histogram(filters.non_blank(t.messages(), "text"))


def _share(t):
    table = corpus.cross_table(t.labeled(), "intent", "severity", normalize=True)
    return table.withColumn("share", F.round("share", 9))


QUERIES = {
    "length_histogram": _length_histogram,
    "direction_counts": lambda t: corpus.direction_counts(filters.fill_message_nulls(t.messages_with_nulls())),
    "monthly_volume": lambda t: corpus.monthly_volume(t.volume()),
    "top_authors": lambda t: corpus.top_authors(t.volume()),
    "intent_counts": lambda t: corpus.label_counts(t.labeled(), "intent"),
    "severity_counts": lambda t: corpus.label_counts(t.labeled(), "severity", by_label=True),
    "intent_severity_counts": lambda t: corpus.cross_table(t.labeled(), "intent", "severity"),
    "intent_severity_share": _share,
    "class_deficits": lambda t: corpus.class_deficits(
        t.labeled().withColumn("intent", F.concat_ws("_", "intent", "severity")), "intent"
    ),
    "job_counts": lambda t: corpus.job_counts(
        t.messages_with_nulls(), F.col("inbound") & ~is_blank(F.col("text"))
    ),
}


def _bins() -> str:
    uppers = V.LENGTH_EDGES[1:] + [None]
    cases = [
        f"WHEN n >= {low} THEN {{'s': {low}, 'b': '{low}+'}}" if high is None
        else f"WHEN n >= {low} AND n < {high} THEN {{'s': {low}, 'b': '{low}-{high - 1}'}}"
        for low, high in zip(V.LENGTH_EDGES, uppers)
    ]
    return "CASE " + " ".join(cases) + " END"


_CELLS = f"""{sql.LABELED}, domain AS (
  SELECT list(DISTINCT intent) AS intents, list(DISTINCT severity) AS severities FROM labeled),
side AS (SELECT unnest(intents) AS intent, severities FROM domain),
grid AS (SELECT intent, unnest(severities) AS severity FROM side),
cells AS (
  SELECT g.intent, g.severity, count(l.doc_id) AS n
  FROM grid g LEFT JOIN labeled l ON l.intent = g.intent AND l.severity = g.severity GROUP BY ALL)"""

ORACLE = {
    "length_histogram": f"""WITH {sql.MESSAGES}, sized AS (
  SELECT length(text) AS n FROM messages WHERE inbound AND {sql.has_text('text')}),
binned AS (SELECT {_bins()} AS b FROM sized)
SELECT b.s::INTEGER AS bin_start, b.b AS bin, count(*) AS count FROM binned GROUP BY ALL""",
    "direction_counts": f"""WITH {sql.MESSAGES_WITH_NULLS}
SELECT 'Customer (inbound)' AS type, count(*) FILTER (coalesce(inbound, false)) AS count FROM nulled
UNION ALL
SELECT 'Support (outbound)', count(*) FILTER (NOT coalesce(inbound, false)) FROM nulled""",
    "monthly_volume": f"""WITH {sql.VOLUME}
SELECT strftime(created_at, '%Y-%m') AS month, count(*) FILTER (inbound) AS inbound,
  count(*) FILTER (NOT inbound) AS outbound
FROM volume GROUP BY 1""",
    "top_authors": f"""WITH {sql.VOLUME}
SELECT author_id, count(*) AS count FROM volume WHERE NOT inbound
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
    "intent_counts": f"WITH {sql.LABELED} SELECT intent, count(*) AS count FROM labeled GROUP BY 1",
    "severity_counts": f"WITH {sql.LABELED} SELECT severity, count(*) AS count FROM labeled GROUP BY 1",
    "intent_severity_counts": f"WITH {_CELLS} SELECT intent, severity, n AS count FROM cells",
    "intent_severity_share": f"""WITH {_CELLS}
SELECT intent, severity,
  round(n::DOUBLE / (sum(n) OVER (PARTITION BY intent))::DOUBLE, 9) AS share FROM cells""",
    "class_deficits": f"""WITH {sql.LABELED}
SELECT intent || '_' || severity AS intent, count(*) AS count, 5 - count(*) AS needed
FROM labeled GROUP BY 1 HAVING count(*) < 5""",
    "job_counts": f"""WITH {sql.MESSAGES_WITH_NULLS}
SELECT count(*) AS processed, count(*) FILTER (coalesce(inbound, false) AND {sql.has_text('text')}) AS kept,
  count(*) FILTER (NOT (coalesce(inbound, false) AND {sql.has_text('text')})) AS dropped FROM nulled""",
}
