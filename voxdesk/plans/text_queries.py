"""Queries over text functions and filters, with their SQL."""

from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions import dates, text
from voxdesk.operators import filters
from voxdesk.plans import sql

_STAGES = {
    "text_normalized": (text.normalize, lambda e: f"lower({e})"),
    "urls_removed": (text.strip_urls, lambda e: sql.drop(e, V.URL_PATTERN)),
    "mentions_removed": (text.strip_mentions, lambda e: sql.drop(e, V.MENTION_PATTERN)),
    "hashtags_removed": (text.strip_hashtags, lambda e: sql.drop(e, V.HASHTAG_PATTERN)),
    "emoticons_removed": (text.strip_emoticons, lambda e: sql.drop(e, V.EMOTICON_PATTERN)),
    "emoji_removed": (text.strip_emoji, lambda e: sql.drop(e, V.EMOJI_PATTERN)),
    "special_removed_keep": (
        lambda c: text.strip_special(c, True),
        lambda e: sql.collapsed(sql.drop(e, V.SPECIAL_KEEP_PATTERN)),
    ),
    "special_removed_drop": (
        lambda c: text.strip_special(c, False),
        lambda e: sql.collapsed(sql.drop(e, V.SPECIAL_DROP_PATTERN)),
    ),
    "whitespace_collapsed": (text.collapse_ws, sql.collapsed),
    "clean_text": (text.clean_text, sql.cleaned),
    "clean_text_minimal": (
        lambda c: text.clean_text(
            c, urls=False, mentions=False, hashtags=False, emoticons=False, special=False
        ),
        lambda e: sql.stripped(f"lower({e})"),
    ),
}


def _stage_query(function):
    return lambda t: t.noisy_text().select("doc_id", function(F.col("text")).alias("text"))


QUERIES = {key: _stage_query(spark_form) for key, (spark_form, _) in _STAGES.items()}
ORACLE = {
    key: f"WITH {sql.NOISY} SELECT doc_id, {sql_form('text')} AS text FROM noisy"
    for key, (_, sql_form) in _STAGES.items()
}

QUERIES |= {
    "clean_column": lambda t: filters.with_clean_column(t.messages().select("message_id", "text")),
    "required_columns": lambda t: filters.require_columns(t.labeled(), ["text", "intent", "severity"]).select(
        "doc_id", "intent", "severity"
    ),
    "required_rows": lambda t: filters.require_rows(
        filters.truthy_text(t.messages_with_nulls()), "no message has text"
    ).select("message_id"),
    "inbound_messages": lambda t: filters.non_blank(filters.inbound_only(t.messages_with_nulls())),
    "messages_typed": lambda t: t.messages().select("message_id", "author_id", "inbound", "text"),
    "non_blank_text": lambda t: filters.non_blank(t.messages_with_nulls()).select("message_id", "text"),
    "truthy_text": lambda t: filters.truthy_text(t.messages_with_nulls()).select("message_id", "text"),
    "filled_messages": lambda t: filters.fill_message_nulls(t.messages_with_nulls()),
    "text_length": lambda t: t.documents().select(
        "doc_id", text.text_length(F.col("text")).alias("n")
    ),
    "created_at_parsed": lambda t: _created_at(t),
    "tokens": lambda t: _listed(t, text.tokenize),
    "seq_tokens": lambda t: _listed(t, text.seq_tokens),
    "cleaned_labeled": lambda t: filters.clean_labeled(t.labeled(), keep=("doc_id",)),
    "labels_clean": lambda t: filters.clean_label_rows(_raw_labels(t)),
}


def _listed(t, tokenizer):
    found = t.documents().select("doc_id", tokenizer(F.col("text")).alias("found"))
    return found.select(
        "doc_id", F.size("found").alias("n"), F.array_join("found", " ").alias("tokens")
    )


def _created_at(t):
    stamp = dates.parse_created_at(F.col("created_at"))
    return t.created_at_text().select(
        "message_id",
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        dates.month_key(stamp).alias("month"),
    )


def _raw_labels(t):
    """Label rows with gaps and padded labels.

    Unrated documents have no severity; each rating adds a row with a blank text.
    """
    intent = F.concat(F.lit("\t "), F.col("lang"), F.lit(" \n")).alias("intent")
    severity = (2 * F.col("toxic") + F.col("quality")).alias("severity")
    documents = t.read("documents")
    whole = documents.join(t.read("labels"), "doc_id", "left").select("doc_id", "text", intent, severity)
    blank = t.read("labels").join(documents, "doc_id").select(
        (-F.col("doc_id") - 1).alias("doc_id"), F.lit(" \t").alias("text"), intent, severity
    )
    return whole.unionByName(blank)


ORACLE |= {
    "clean_column": f"""WITH {sql.MESSAGES}
SELECT message_id, text, {sql.cleaned('text')} AS text_processed FROM messages""",
    "required_columns": f"WITH {sql.LABELED} SELECT doc_id, intent, severity FROM labeled",
    "required_rows": f"WITH {sql.MESSAGES_WITH_NULLS} SELECT message_id FROM nulled WHERE text <> ''",
    "inbound_messages": f"""WITH {sql.MESSAGES_WITH_NULLS}
SELECT message_id, author_id, inbound, text FROM nulled WHERE inbound AND {sql.has_text('text')}""",
    "messages_typed": f"WITH {sql.MESSAGES} SELECT message_id, author_id, inbound, text FROM messages",
    "non_blank_text": f"""WITH {sql.MESSAGES_WITH_NULLS}
SELECT message_id, text FROM nulled WHERE {sql.has_text('text')}""",
    "truthy_text": f"""WITH {sql.MESSAGES_WITH_NULLS}
SELECT message_id, text FROM nulled WHERE text <> ''""",
    "filled_messages": f"""WITH {sql.MESSAGES_WITH_NULLS}
SELECT message_id, coalesce(author_id, 'unknown') AS author_id, coalesce(inbound, false) AS inbound,
  coalesce(text, '') AS text FROM nulled""",
    "text_length": "SELECT doc_id, length(text)::INTEGER AS n FROM documents",
    "created_at_parsed": f"""WITH {sql.CREATED_AT_TEXT}, parsed AS (
  SELECT message_id, try_strptime(created_at, '%a %b %d %H:%M:%S +0000 %Y') AS ts FROM dated)
SELECT message_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(ts, '%Y-%m') AS month
FROM parsed""",
    "tokens": f"""SELECT doc_id, len({sql.words('text')})::INTEGER AS n,
  coalesce(array_to_string({sql.words('text')}, ' '), '') AS tokens FROM documents""",
    "seq_tokens": f"""SELECT doc_id, len({sql.sequence_words('text')})::INTEGER AS n,
  coalesce(array_to_string({sql.sequence_words('text')}, ' '), '') AS tokens FROM documents""",
    "cleaned_labeled": f"WITH {sql.CLEAN_LABELED} SELECT doc_id, text, intent, severity FROM kept",
    "labels_clean": f"""WITH raw AS (
  SELECT doc_id, text, chr(9) || ' ' || lang || ' ' || chr(10) AS intent, 2 * toxic + quality AS severity
  FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL
  SELECT -doc_id - 1, ' ' || chr(9), chr(9) || ' ' || lang || ' ' || chr(10), 2 * toxic + quality
  FROM documents JOIN labels USING (doc_id))
SELECT doc_id, text, {sql.stripped('intent')} AS intent, {sql.stripped('severity::VARCHAR')} AS severity
FROM raw
WHERE text IS NOT NULL AND intent IS NOT NULL AND severity IS NOT NULL AND {sql.has_text('text')}""",
}
