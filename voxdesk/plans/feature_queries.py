"""Queries over vocabularies, weights and sequences, with their SQL."""

from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions.text import clean_text
from voxdesk.operators import features
from voxdesk.plans import sql


def _clean_documents(t):
    return t.documents().withColumn("text", clean_text(F.col("text")))


def _sequences(t, words: int):
    documents = _clean_documents(t)
    return features.encode_sequences(documents, features.token_index(documents, words))


def _shown(df):
    return df.select("doc_id", F.array_join(F.col("seq").cast("array<string>"), " ").alias("seq"))


QUERIES = {
    "ngram_counts": lambda t: features.ngram_counts(_clean_documents(t)),
    "ngram_vocabulary": lambda t: features.ngram_vocabulary(_clean_documents(t)),
    "tfidf_weights": lambda t: features.tfidf_weights(_clean_documents(t)).withColumn(
        "weight", F.round("weight", 9)
    ),
    "token_index": lambda t: features.token_index(_clean_documents(t)),
    "encoded_sequences": lambda t: _shown(_sequences(t, V.SEQUENCE_WORDS)),
    "padded_pre": lambda t: _shown(
        features.padded(_sequences(t, V.SEQUENCE_WORDS), V.SEQUENCE_LENGTH, "pre")
    ),
    "padded_post": lambda t: _shown(
        features.padded(_sequences(t, V.MULTITASK_WORDS), V.MULTITASK_LENGTH, "post")
    ),
}

_GRAMS = f"""cleaned AS (SELECT doc_id, {sql.cleaned('text')} AS text FROM documents),
worded AS (SELECT doc_id, {sql.words('text')} AS w FROM cleaned),
grams AS (
  SELECT doc_id, unnest(w) AS term FROM worded
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded),
per_doc AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
counts AS (SELECT term, sum(tf)::BIGINT AS n, count(*) AS docs FROM per_doc GROUP BY 1)"""
_VOCABULARY = f"{_GRAMS}, vocabulary AS (SELECT * FROM counts ORDER BY n DESC, term LIMIT 20000)"


def _sequence_sql(cap: int) -> str:
    return f"""cleaned AS (SELECT doc_id, {sql.cleaned('text')} AS text FROM documents),
worded AS (SELECT doc_id, {sql.sequence_words('text')} AS w FROM cleaned),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM worded),
counts AS (SELECT word, count(*) AS n FROM placed GROUP BY 1),
top AS (SELECT * FROM counts ORDER BY n DESC, word LIMIT {cap - 2}),
numbered AS (SELECT word, n, (row_number() OVER (ORDER BY n DESC, word) + 1)::INTEGER AS idx FROM top),
encoded AS (
  SELECT doc_id, list(coalesce(idx, 1) ORDER BY pos) AS seq
  FROM placed LEFT JOIN numbered USING (word) GROUP BY 1),
sequences AS (SELECT doc_id, coalesce(seq, []) AS seq FROM documents LEFT JOIN encoded USING (doc_id))"""


_JOINED = "coalesce(array_to_string({}, ' '), '')"

ORACLE = {
    "ngram_counts": f"WITH {_GRAMS} SELECT term, n, docs FROM counts",
    "ngram_vocabulary": f"""WITH {_VOCABULARY}
SELECT term, n, docs, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx FROM vocabulary""",
    "tfidf_weights": f"""WITH {_VOCABULARY}, raw AS (
  SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + docs)::DOUBLE)
    + 1::DOUBLE) AS raw
  FROM per_doc JOIN vocabulary USING (term)),
norms AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1)
SELECT doc_id, term, round(raw / norm, 9) AS weight FROM raw JOIN norms USING (doc_id)""",
    "token_index": f"""WITH {_sequence_sql(V.SEQUENCE_WORDS)}
SELECT word, n, idx FROM numbered UNION ALL SELECT '<OOV>', 0, 1""",
    "encoded_sequences": f"""WITH {_sequence_sql(V.SEQUENCE_WORDS)}
SELECT doc_id, {_JOINED.format('seq')} AS seq FROM sequences""",
    "padded_pre": f"""WITH {_sequence_sql(V.SEQUENCE_WORDS)}, cut AS (
  SELECT doc_id, CASE WHEN len(seq) > 100 THEN seq[len(seq) - 99:] ELSE seq END AS seq FROM sequences)
SELECT doc_id, array_to_string(list_transform(range(1, 101),
  lambda i: CASE WHEN i <= 100 - len(seq) THEN 0 ELSE seq[i - (100 - len(seq))] END), ' ') AS seq FROM cut""",
    "padded_post": f"""WITH {_sequence_sql(V.MULTITASK_WORDS)}
SELECT doc_id, array_to_string(list_transform(range(1, 51),
  lambda i: CASE WHEN i <= len(seq) THEN seq[i] ELSE 0 END), ' ') AS seq FROM sequences""",
}
