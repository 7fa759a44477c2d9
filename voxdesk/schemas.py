"""Declared schemas; no reader infers types."""

from pyspark.sql import types as T

# CSV columns as they lie in the file: booleans and dates arrive as text.
RAW_MESSAGES = T.StructType([
    T.StructField("tweet_id", T.LongType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
])

MESSAGES = T.StructType([
    T.StructField("tweet_id", T.LongType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("text", T.StringType()),
])

LABELS = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("severity", T.StringType()),
])

RATINGS = T.StructType([
    T.StructField("original_tweet", T.StringType()),
    T.StructField("predicted_intent", T.StringType()),
    T.StructField("predicted_severity", T.IntegerType()),
    T.StructField("generated_reply", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("rater_id", T.StringType()),
])
