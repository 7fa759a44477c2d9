"""SQL texts of the table views and small SQL builders for the oracle."""

from voxdesk import fixed_values as V


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(items) -> str:
    return ", ".join(quoted(i) for i in items)


def drop(expr: str, pattern: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, '', 'g')"


def stripped(expr: str) -> str:
    return drop(expr, f"^{V.WS}+|{V.WS}+$")


def has_text(expr: str) -> str:
    return f"coalesce(regexp_matches({expr}, {quoted(V.NOT_WS)}), false)"


def collapsed(expr: str) -> str:
    return f"trim(regexp_replace({expr}, {quoted(V.WS + '+')}, ' ', 'g'))"


def cleaned(expr: str) -> str:
    out = f"lower({expr})"
    for pattern in (
        V.URL_PATTERN,
        V.MENTION_PATTERN,
        V.HASHTAG_PATTERN,
        V.EMOTICON_PATTERN,
        V.EMOJI_PATTERN,
        V.SPECIAL_KEEP_PATTERN,
    ):
        out = drop(out, pattern)
    return collapsed(out)


def words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {quoted(V.TOKEN_PATTERN)})"


def sequence_words(expr: str) -> str:
    chars = V.SEQUENCE_FILTER_CHARS
    spaced = f"translate(lower({expr}), {quoted(chars)}, {quoted(' ' * len(chars))})"
    return f"list_filter(string_split({spaced}, ' '), lambda t: t <> '')"


def ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN ({bottom}) = 0 THEN 0.0::DOUBLE ELSE ({top})::DOUBLE / ({bottom})::DOUBLE END"


MESSAGES = """messages AS (
  SELECT conv_id * 1000 + turn AS message_id, role AS author_id, role = 'user' AS inbound, text
  FROM conversations)"""

MESSAGES_WITH_NULLS = MESSAGES + """, nulled AS (
  SELECT message_id,
    CASE WHEN author_id <> 'system' THEN author_id END AS author_id,
    CASE WHEN author_id <> 'system' THEN inbound END AS inbound, text
  FROM messages
  UNION ALL
  SELECT -3 * message_id - pos - 1, author_id, inbound, blank
  FROM messages, (VALUES (0, NULL), (1, ''), (2, ' ' || chr(9) || chr(160))) AS b(pos, blank)
  WHERE message_id % 1000 = 0)"""

VOLUME = """volume AS (
  SELECT o_orderkey AS message_id, o_custkey::VARCHAR AS author_id,
    o_orderstatus <> 'F' AS inbound, o_orderdate AS created_at
  FROM orders)"""

CREATED_AT_TEXT = """dated AS (
  SELECT o_orderkey AS message_id,
    CASE WHEN o_orderstatus = 'P' THEN 'pending ' ELSE '' END
      || strftime(o_orderdate, '%a %b %d %H:%M:%S +0000 %Y') AS created_at
  FROM orders)"""

NOISY = """noisy AS (
  SELECT doc_id, concat_ws(' ', text, url) AS text
  FROM documents LEFT JOIN pages ON page_id = doc_id)"""

LABELED = """labeled AS (
  SELECT doc_id, text, lang AS intent, 2 * toxic + quality AS severity
  FROM documents JOIN labels USING (doc_id))"""

CLEAN_LABELED = LABELED + f""", cleaned AS (
  SELECT doc_id, {cleaned('text')} AS text, intent, severity::VARCHAR AS severity FROM labeled),
kept AS (SELECT * FROM cleaned WHERE {has_text('text')})"""

_BAND = """CASE least(floor(o_totalprice / 100000), 4)::INTEGER
      WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM'
      WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END"""

PAIRS = f"""pairs AS (
  SELECT o_orderkey AS id, o_orderpriority AS y_true,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE {_BAND} END AS y_pred
  FROM orders)"""

PAIRS_BY_MODEL = PAIRS + f""", pairs_by_model AS (
  SELECT 'status' AS model, id, y_true, y_pred FROM pairs
  UNION ALL
  SELECT 'price', o_orderkey, o_orderpriority, {_BAND} FROM orders)"""

PAIRS_BINARY = """pairs_binary AS (
  SELECT doc_id AS id, quality AS y_true, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS y_pred
  FROM documents JOIN labels USING (doc_id))"""

CLASS_SUMS = """list_transform(range(10), lambda k:
    list_sum(list_transform(range(k + 1, len(embedding) + 1, 10), lambda i: embedding[i]::DOUBLE)))"""

SCORES = """scores AS (
  SELECT vec_id AS id, label AS truth, k::INTEGER AS class, sums[k + 1] AS score
  FROM (SELECT *, unnest(range(10)) AS k FROM (SELECT *, """ + CLASS_SUMS + """ AS sums FROM embeddings)))"""

SCORES_BINARY = """scores_binary AS (
  SELECT n_chars::DOUBLE AS score, quality = 1 AS positive
  FROM documents JOIN labels USING (doc_id))"""

RATINGS = """ratings AS (
  SELECT conv_id, turn, text AS generated_reply,
    (1 + least(5, length(text) // 300))::INTEGER AS rating, 'r' || turn AS rater_id
  FROM conversations WHERE role = 'assistant')"""

RESPONSES = """responses AS (
  SELECT event_id, CASE event_type
      WHEN 'view' THEN 'Intent: View' || chr(10) || 'Severity (0-3): ' || floor(value)::BIGINT
      WHEN 'click' THEN '  Click_Issue ' || chr(13) || chr(10) || chr(10) || floor(value)::BIGINT
      WHEN 'signup' THEN 'signup'
      WHEN 'purchase' THEN 'intent:' || chr(10) || 'none' || chr(10) || 'level -' || floor(value)::BIGINT
      ELSE CASE WHEN value < 50 THEN ' ' || chr(10) || ' '
           ELSE 'error' || chr(10) || '0' || floor(value)::BIGINT END
    END AS answer
  FROM events)"""

CALLS = """calls AS (
  SELECT event_id, props AS answer,
    CASE WHEN event_type = 'error' THEN
      CASE WHEN value > 300 THEN 'HTTP 429 RESOURCE_EXHAUSTED' ELSE 'timeout' END END AS error
  FROM events)"""


def per_class(source: str, by: str = "") -> str:
    """CTE class_rows: tp, support, predicted, precision, recall, f1 per label."""
    key = f"{by}, " if by else ""
    same = f"p.{by} = l.{by} AND " if by else ""
    return f"""labels_seen AS (
  SELECT {key}y_true AS label FROM {source} UNION SELECT {key}y_pred FROM {source}),
class_counts AS (
  SELECT {key.replace(by, 'l.' + by) if by else ''}l.label,
    count(*) FILTER (p.y_true = l.label AND p.y_pred = l.label) AS tp,
    count(*) FILTER (p.y_true = l.label) AS support,
    count(*) FILTER (p.y_pred = l.label) AS predicted
  FROM labels_seen l JOIN {source} p ON {same}(p.y_true = l.label OR p.y_pred = l.label)
  GROUP BY ALL),
class_rows AS (
  SELECT *, {ratio('tp', 'predicted')} AS precision, {ratio('tp', 'support')} AS recall,
    {ratio('2 * tp', 'support + predicted')} AS f1
  FROM class_counts)"""
