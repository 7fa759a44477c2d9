"""Small documents with the cases every operator has to bear."""

BASE = (
    "The quick brown fox jumps over the lazy dog while a small bird sings high above in the old green tree "
    "and nobody in the quiet village hears it because all of them are asleep until the sun comes up again"
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string"


def odd_rows():
    """Null ids, texts and sources; empty, blank and long texts; repeated rows; copies."""
    long_text = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000))
    rows = [
        (1, BASE, "en", "a"), (2, BASE, "en", "b"), (3, BASE + " extra", "en", "a"), (4, None, "en", "a"),
        (5, "", "en", None), (6, " \t\n ", None, "b"), (7, long_text, "en", "c"), (8, "one", "en", "a"),
        (None, BASE, "en", None), (None, None, None, None), (1, BASE, "en", "a"), (9, "a\n\n\nb a", "en", "c"),
        (10, "Über été naïve — 漢字 x", "de", "c"),
    ]
    return [(d, t, lang, s, len(t) if t is not None else None, "mine") for d, t, lang, s in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
