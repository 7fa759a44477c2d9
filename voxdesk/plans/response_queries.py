"""Queries over prompts, answers, labelling jobs and fallbacks, with their SQL."""

import re

from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions import prompts, responses
from voxdesk.operators import asking, corpus, labeling, scoring
from voxdesk.operators.ledger import Call, CallLedger
from voxdesk.plans import sql

_ALLOWED = ["view", "click", "purchase"]
_INTENT_WORDS = [
    ("the", "technical_issue"),
    ("der", "account_issue"),
    ("les", "billing_issue"),
    ("los", "shipping_issue"),
]
_SEVERITY_WORDS = [("@", 3), ("ing", 2), ("sch", 0)]


def _labeler():
    return asking.keyword_model(_INTENT_WORDS, _SEVERITY_WORDS)


def _failing_labeler():
    """Answers with a severity from the text's length; marked texts fail."""

    def answer_one(text):
        if "#" in text:
            raise RuntimeError("Quota exceeded, try again later")
        if "@" in text:
            raise RuntimeError("connection lost")
        return f"seen\n{len(text) % 4}"

    return asking.per_row(answer_one, column="text")


def _offline_scorer(texts, labels):
    """Rates labels by the text's length, one unknown label among them; marked texts fail."""
    for text in texts:
        rated = [(label, len(text) * (k + 2) % 11 / 8) for k, label in enumerate([*labels, "seen"])]
        yield (None, "model failed") if "#" in text else (rated, None)


def _sparing(marks: list[int], what: str):
    """Answers with the text's length; the quota ends at lengths divisible by a mark, every tenth call fails else."""

    def answer_one(text):
        if any(len(text) % m == 0 for m in marks):
            raise RuntimeError("429 quota used up")
        if len(text) % 10 == 3:
            raise RuntimeError("connection lost")
        return f" {what} {len(text)}"

    return asking.per_row(answer_one, column="text")


def _replies(ledger, t, marks):
    """Replies and explanations of all documents under one ledger."""
    about = (F.col("text"), F.lit(V.DEFAULT_INTENT), F.lit(V.ONLINE_DEFAULT_SEVERITY))
    calls = [
        Call("reply", _sparing(marks[0], "reply"), prompts.reply_prompt(*about), ("text",)),
        Call("explanation", _sparing(marks[1], "reason"), prompts.explanation_prompt(*about), ("text",)),
    ]
    return ledger.ask(t.documents(), calls, "doc_id")


def _quota_shared(t):
    """The first quota error of either kind ends both."""
    out = _replies(CallLedger(t.spark), t, ([499], [433]))
    return out.select(
        "doc_id", "reply_status", "explanation_status",
        responses.reply_or_fallback(F.col("reply_status"), F.col("reply_answer")).alias("reply"),
        responses.explanation_or_fallback(F.col("explanation_status"), F.col("explanation_answer")).alias("explanation"),
    )


def _resumed(t):
    """A run that met its quota's end, taken up by a second one: every call is made once."""
    first = CallLedger(t.spark)
    _replies(first, t, ([499], [433]))
    second = CallLedger(t.spark, first.folder)
    out = _replies(second, t, ([], []))
    paid = second.made().groupBy("call_key").agg(F.count(F.lit(1)).alias("calls"))
    key = F.to_json(F.array(F.col("doc_id").cast("string")))
    return out.join(paid, key == F.col("call_key")).select(
        "doc_id", "reply_status", "reply_answer", "explanation_status", "explanation_answer", "calls"
    )


def _list_generator(batch):
    """As many numbered lines as asked for, naming the class."""
    for intent, needed in zip(batch["wanted"], batch["needed"]):
        lines = [f"{i}. the complaint number {i} about {intent}" for i in range(1, needed + 1)]
        yield "\n".join(lines), None


def _rare(t):
    """Labelled documents with fine classes, some of which are rare."""
    return t.labeled().select(
        "text", F.concat_ws("_", "intent", "severity").alias("intent"), "severity"
    )


def _emptied(t):
    urls = t.read("pages").select(F.col("page_id").alias("id"), F.col("url").alias("text"))
    texts = t.read("documents").select(F.col("doc_id").alias("id"), "text")
    return scoring.empty_fallback(urls.unionByName(texts), keep=("id",))


def _with_status(t):
    return t.calls().withColumn("status", asking.answer_status(F.col("error")))


def _delayed(t):
    """Every message sent to a caller that pauses after each call."""
    model = asking.per_row(lambda text: f"{len(text)} characters", "text", delay=0.0005)
    return asking.ask(t.messages().select("message_id", "text"), model, needs="text").select("message_id", "answer")


QUERIES = {
    "delayed_answers": _delayed,
    "label_prompts": lambda t: t.messages().select(
        "message_id", prompts.label_prompt(F.col("text")).alias("prompt")
    ),
    "reply_prompts": lambda t: t.labeled().select(
        "doc_id", prompts.reply_prompt(F.col("text"), F.col("intent"), F.col("severity")).alias("prompt")
    ),
    "explanation_prompts": lambda t: t.labeled().select(
        "doc_id",
        prompts.explanation_prompt(F.col("text"), F.col("intent"), F.col("severity")).alias("prompt"),
    ),
    "augmentation_prompts": lambda t: corpus.class_deficits(_rare(t), "intent").select(
        "intent", prompts.augmentation_prompt(F.col("intent"), F.col("needed")).alias("prompt")
    ),
    "parsed_labels": lambda t: asking.parse_labels(t.responses()).drop("answer"),
    "parsed_documents": lambda t: asking.parse_labels(t.documents(), "text").drop("text"),
    "augmented_lines": lambda t: asking.explode_samples(t.documents(), "text", F.lit(5)).select(
        "doc_id", "pos", "sample"
    ),
    "quota_errors": lambda t: t.calls().select(
        "event_id", responses.is_quota_error(F.col("error")).alias("is_quota")
    ),
    "quota_cutoff": lambda t: asking.cut_at_first_quota(_with_status(t), F.col("event_id")).select(
        "event_id", "status"
    ),
    "reply_fallbacks": lambda t: _with_status(t).select(
        "event_id",
        responses.reply_or_fallback(F.col("status"), F.col("answer")).alias("reply"),
        responses.explanation_or_fallback(F.col("status"), F.col("answer")).alias("explanation"),
    ),
    "top_intent": lambda t: asking.top_label(
        t.read("customer").select(F.col("c_custkey").alias("user_id")),
        t.label_candidates(),
        "user_id",
        _ALLOWED,
    ),
    "top_severity": lambda t: asking.top_severity(
        t.read("customer").select(F.col("c_custkey").alias("customer")), t.severity_candidates(), "customer"
    ),
    "label_job_stub": lambda t: labeling.label_messages(
        t.documents(),
        _labeler(),
        n=V.OFFLINE_SAMPLE,
        existing=t.labeled().select("text"),
        id_col="doc_id",
    ),
    "label_job_offline": lambda t: labeling.label_by_scores(t.documents(), _offline_scorer, id_col="doc_id"),
    "quota_shared": _quota_shared,
    "resumed_calls": _resumed,
    "label_job_quota": lambda t: labeling.label_messages(
        t.documents(), _failing_labeler(), n=V.OFFLINE_SAMPLE, id_col="doc_id"
    ),
    "augment_stub": lambda t: labeling.augment(_rare(t), _list_generator, _labeler()),
    "score_empty_fallback": _emptied,
}


def _prompt_sql(template: str, **columns: str) -> str:
    pieces = re.split(r"<<(\w+)>>", template)
    return " || ".join(
        f"{columns[p]}::VARCHAR" if i % 2 else sql.quoted(p) for i, p in enumerate(pieces) if p
    )


def _lines_sql(expr: str) -> str:
    split = f"string_split_regex({expr}, {sql.quoted(V.LINE_BREAK)})"
    return f"list_filter(list_transform({split}, lambda x: {sql.stripped('x')}), lambda x: x <> '')"


def _parse_sql(source: str, id_col: str, text: str) -> str:
    return f"""lines AS (SELECT {id_col}, {_lines_sql(text)} AS lines FROM {source}),
split AS (
  SELECT {id_col}, lines, {sql.stripped("replace(lower(lines[1]), 'intent:', '')")} AS name,
    list_filter(list_transform(lines[2:], lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: x <> '')[1]
      AS digits
  FROM lines)
SELECT {id_col}, CASE WHEN len(lines) > 0 THEN CASE WHEN name = '' THEN 'other' ELSE name END END AS intent,
  CASE WHEN len(lines) > 0 THEN
    CASE WHEN digits IS NULL THEN 1 WHEN length(ltrim(digits, '0')) > 1 THEN 3
         ELSE least(3, coalesce(try_cast(ltrim(digits, '0') AS INTEGER), 0)) END END::INTEGER AS severity
FROM split"""


def _keyword_sql(words, default: str) -> str:
    cases = " ".join(
        f"WHEN contains(lower(text), {sql.quoted(w)}) THEN {sql.quoted(v) if isinstance(v, str) else v}"
        for w, v in words
    )
    return f"CASE {cases} ELSE {default} END"


_INTENT_SQL = _keyword_sql(_INTENT_WORDS, "'other'")
_SEVERITY_SQL = _keyword_sql(_SEVERITY_WORDS, "1") + "::INTEGER"
_RARE = sql.LABELED + """, rare AS (
  SELECT text, intent || '_' || severity AS intent, severity FROM labeled),
short_of AS (
  SELECT intent, count(*) AS n, 5 - count(*) AS needed FROM rare GROUP BY 1 HAVING count(*) < 5)"""
_STATUS = sql.CALLS + """, stated AS (
  SELECT *, CASE WHEN error IS NULL THEN 'ok'
    WHEN lower(error) LIKE '%resource_exhausted%' OR lower(error) LIKE '%quota%' OR error LIKE '%429%'
    THEN 'quota' ELSE 'error' END AS status
  FROM calls)"""

_WAVES = """WITH placed AS (
  SELECT doc_id, text, md5('42|' || doc_id) AS place, count(*) OVER () AS n FROM documents),
dealt AS (
  SELECT *, ((('0x' || place[1:6])::BIGINT * greatest(1, ceil(n / 1000)::BIGINT)) >> 24) AS before FROM placed),
called AS (
  SELECT doc_id, text, place, turn, CASE WHEN before = 0 THEN 0 ELSE length(bin(before)) END AS wave,
    CASE WHEN length(text) % CASE turn WHEN 0 THEN 499 ELSE 433 END = 0 THEN 'quota'
      WHEN length(text) % 10 = 3 THEN 'error' ELSE 'ok' END AS status
  FROM dealt, (SELECT unnest([0, 1]) AS turn))"""

ORACLE = {
    "delayed_answers": f"""WITH {sql.MESSAGES}
SELECT message_id, length(text) || ' characters' AS answer FROM messages""",
    "label_prompts": f"""WITH {sql.MESSAGES}
SELECT message_id, {_prompt_sql(V.LABEL_PROMPT, text='text')} AS prompt FROM messages""",
    "reply_prompts": f"""WITH {sql.LABELED}
SELECT doc_id, {_prompt_sql(V.REPLY_PROMPT, text='text', intent='intent', severity='severity')} AS prompt
FROM labeled""",
    "explanation_prompts": f"""WITH {sql.LABELED}
SELECT doc_id, {_prompt_sql(V.EXPLANATION_PROMPT, text='text', intent='intent', severity='severity')} AS prompt
FROM labeled""",
    "augmentation_prompts": f"""WITH {_RARE}
SELECT intent, {_prompt_sql(V.AUGMENTATION_PROMPT, intent='intent', needed='needed')} AS prompt FROM short_of""",
    "parsed_labels": f"WITH {sql.RESPONSES}, {_parse_sql('responses', 'event_id', 'answer')}",
    "parsed_documents": f"WITH {_parse_sql('documents', 'doc_id', 'text')}",
    "augmented_lines": f"""WITH lines AS (
  SELECT doc_id, list_filter(list_transform({_lines_sql('text')},
    lambda x: {sql.drop('x', V.LIST_PREFIX_PATTERN)}), lambda x: length(x) > 10)[1:5] AS kept
  FROM documents)
SELECT doc_id, (unnest(range(len(kept))))::INTEGER AS pos, unnest(kept) AS sample FROM lines""",
    "quota_errors": f"WITH {_STATUS} SELECT event_id, status = 'quota' AS is_quota FROM stated",
    "quota_cutoff": f"""WITH {_STATUS}
SELECT event_id, status FROM stated
WHERE event_id < coalesce((SELECT min(event_id) FROM stated WHERE status = 'quota'), 9223372036854775807)""",
    "reply_fallbacks": f"""WITH {_STATUS}
SELECT event_id,
  CASE status WHEN 'ok' THEN {sql.stripped('answer')} WHEN 'quota' THEN {sql.quoted(V.QUOTA_REPLY)}
    ELSE {sql.quoted(V.ERROR_REPLY)} END AS reply,
  CASE status WHEN 'ok' THEN {sql.stripped('answer')} WHEN 'quota' THEN {sql.quoted(V.QUOTA_EXPLANATION)}
    ELSE {sql.quoted(V.ERROR_EXPLANATION)} END AS explanation
FROM stated""",
    "top_intent": f"""WITH best AS (
  SELECT user_id, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY value DESC,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, event_type) AS place
  FROM events)
SELECT c_custkey AS user_id,
  CASE WHEN label IN ('view', 'click', 'purchase') THEN label ELSE 'other' END AS intent
FROM customer LEFT JOIN best ON user_id = c_custkey AND place = 1""",
    "top_severity": """WITH best AS (
  SELECT o_custkey, floor(o_totalprice / 100000)::INTEGER AS label,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place
  FROM orders)
SELECT c_custkey AS customer, CASE WHEN label IN (1, 2, 3) THEN label ELSE 2 END::INTEGER AS severity
FROM customer LEFT JOIN best ON o_custkey = c_custkey AND place = 1""",
    "label_job_stub": f"""WITH {sql.LABELED}, fresh AS (
  SELECT doc_id, text FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM labeled l WHERE l.text = d.text)),
sampled AS (SELECT * FROM fresh ORDER BY md5('42|' || doc_id), doc_id LIMIT 5000)
SELECT doc_id, text, {_INTENT_SQL} AS intent, {_SEVERITY_SQL} AS severity FROM sampled""",
    "label_job_offline": f"""WITH sampled AS (
  SELECT doc_id, text FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT {V.OFFLINE_SAMPLE}),
intent AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) * (k + 1) % 11 DESC, k) AS place
  FROM sampled, (SELECT unnest({[*V.OFFLINE_INTENTS, "seen"]}) AS label, unnest(range(1, {len(V.OFFLINE_INTENTS) + 2})) AS k)),
severity AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id
    ORDER BY length(text || ' ' || {sql.quoted(V.SEVERITY_SCALE)}) * (k + 1) % 11 DESC, k) AS place
  FROM sampled, (SELECT unnest({[*V.OFFLINE_SEVERITIES, "seen"]}) AS label, unnest(range(1, {len(V.OFFLINE_SEVERITIES) + 2})) AS k))
SELECT s.doc_id, text,
  CASE WHEN contains(text, '#') OR i.label = 'seen' THEN 'other' ELSE i.label END AS intent,
  CASE WHEN contains(text, '#') THEN 2 ELSE coalesce(try_cast(v.label AS INTEGER), 2) END::INTEGER AS severity
FROM sampled s JOIN intent i ON i.doc_id = s.doc_id AND i.place = 1 JOIN severity v ON v.doc_id = s.doc_id AND v.place = 1""",
    "quota_shared": f"""{_WAVES}, stopped AS (
  SELECT *, (wave, turn, place) < coalesce((SELECT min((wave, turn, place)) FROM called WHERE status = 'quota'),
    (99, 99, 'z')) AS before FROM called),
judged AS (SELECT *, CASE WHEN before THEN status ELSE 'quota' END AS known FROM stopped)
SELECT r.doc_id, r.known AS reply_status, e.known AS explanation_status,
  CASE r.known WHEN 'ok' THEN 'reply ' || length(r.text) WHEN 'quota' THEN {sql.quoted(V.QUOTA_REPLY)}
    ELSE {sql.quoted(V.ERROR_REPLY)} END AS reply,
  CASE e.known WHEN 'ok' THEN 'reason ' || length(r.text) WHEN 'quota' THEN {sql.quoted(V.QUOTA_EXPLANATION)}
    ELSE {sql.quoted(V.ERROR_EXPLANATION)} END AS explanation
FROM judged r JOIN judged e ON r.doc_id = e.doc_id AND r.turn = 0 AND e.turn = 1""",
    "resumed_calls": """SELECT doc_id, CASE WHEN length(text) % 10 = 3 THEN 'error' ELSE 'ok' END AS reply_status,
  CASE WHEN length(text) % 10 <> 3 THEN ' reply ' || length(text) END AS reply_answer,
  CASE WHEN length(text) % 10 = 3 THEN 'error' ELSE 'ok' END AS explanation_status,
  CASE WHEN length(text) % 10 <> 3 THEN ' reason ' || length(text) END AS explanation_answer, 2::BIGINT AS calls
FROM documents""",
    "label_job_quota": """WITH sampled AS (
  SELECT doc_id, text, md5('42|' || doc_id) AS place FROM documents ORDER BY place LIMIT 5000)
SELECT doc_id, text, 'seen' AS intent, (length(text) % 4)::INTEGER AS severity FROM sampled
WHERE NOT contains(text, '@')
  AND place < coalesce((SELECT min(place) FROM sampled WHERE contains(text, '#')), 'z')""",
    "augment_stub": f"""WITH {_RARE}, made AS (
  SELECT 'the complaint number ' || i || ' about ' || intent AS text
  FROM (SELECT intent, unnest(range(1, needed + 1)) AS i FROM short_of))
SELECT text, intent, severity, false AS is_synthetic FROM rare
UNION ALL
SELECT text, {_INTENT_SQL}, {_SEVERITY_SQL}, true FROM made""",
    "score_empty_fallback": f"""WITH sent AS (
  SELECT page_id AS id, url AS text FROM pages UNION ALL SELECT doc_id, text FROM documents)
SELECT id, text, 'other' AS predicted_intent, 1 AS predicted_severity,
  {sql.quoted(V.EMPTY_REPLY)} AS reply, {sql.quoted(V.EMPTY_EXPLANATION)} AS explanation
FROM sent WHERE NOT {sql.has_text(sql.cleaned('text'))}""",
}
