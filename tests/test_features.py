import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from voxdesk.operators import classifiers, features

TEXTS = [(1, "red red blue"), (2, "blue green"), (3, "blue"), (4, ""), (5, None)]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_ngram_counts(spark):
    got = {r["term"]: (r["n"], r["docs"]) for r in features.ngram_counts(docs(spark)).collect()}
    assert got == {
        "red": (2, 1), "blue": (3, 3), "green": (1, 1),
        "red red": (1, 1), "red blue": (1, 1), "blue green": (1, 1),
    }


def test_vocabulary_ties_go_by_name(spark):
    rows = features.ngram_vocabulary(docs(spark), 3).orderBy("idx").collect()
    assert [(r["term"], r["idx"]) for r in rows] == [("blue", 0), ("blue green", 1), ("red", 2)]


def test_tfidf_weights_by_hand(spark):
    rows = {(r["doc_id"], r["term"]): r["weight"] for r in features.tfidf_weights(docs(spark), 3).collect()}
    idf = lambda df: math.log(6 / (1 + df)) + 1
    red, blue = 2 * idf(1), idf(3)
    norm = math.hypot(red, blue)
    assert rows[(1, "red")] == pytest.approx(red / norm)
    assert rows[(1, "blue")] == pytest.approx(blue / norm)
    assert rows[(3, "blue")] == pytest.approx(1.0)
    assert {d for d, _ in rows} == {1, 2, 3}


def test_model_features_equal_table_weights(spark):
    df = docs(spark, [(i, t) for i, t in TEXTS if t is not None])
    vectorizer = classifiers.fit_vectorizer(df, 4)
    terms = [r["term"] for r in features.ngram_vocabulary(df, 4).orderBy("idx").collect()]
    dense = vectorizer.transform(df).select("doc_id", vector_to_array("features").alias("v")).collect()
    from_model = {(r["doc_id"], t): w for r in dense for t, w in zip(terms, r["v"]) if w}
    from_table = {(r["doc_id"], r["term"]): r["weight"] for r in features.tfidf_weights(df, 4).collect()}
    assert from_model.keys() == from_table.keys()
    for key, weight in from_table.items():
        assert from_model[key] == pytest.approx(weight)


def test_token_index_and_sequences(spark):
    index = features.token_index(docs(spark), cap=4)
    assert {r["word"]: r["idx"] for r in index.collect()} == {"<OOV>": 1, "blue": 2, "red": 3}
    seqs = features.encode_sequences(docs(spark), index)
    assert {r["doc_id"]: r["seq"] for r in seqs.collect()} == {1: [3, 3, 2], 2: [2, 1], 3: [2], 4: [], 5: []}
    padded = features.padded(seqs, 2, "pre").where("doc_id = 1").first()["seq"]
    assert padded == [3, 2]


def test_text_is_cleaned_once_before_an_explode(spark, tmp_path):
    from voxdesk.functions.text import clean_text

    path = str(tmp_path / "docs")
    docs(spark).write.parquet(path)
    cleaned = spark.read.parquet(path).withColumn("text", clean_text(F.col("text")))
    plan = features.ngram_counts(cleaned)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?://") == 1


def test_text_is_cleaned_once_before_a_filter(spark, tmp_path):
    from voxdesk.operators.filters import clean_labeled

    path = str(tmp_path / "labels")
    spark.createDataFrame([("@a", "x", "1")], "text string, intent string, severity string").write.parquet(path)
    plan = clean_labeled(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?://") == 1


def test_a_repeated_id_is_two_documents_and_no_text_is_shuffled(spark):
    df = docs(spark, [(1, "red"), (1, "blue blue"), (None, "red")])
    rows = sorted((r["doc_id"] or 0, r["term"], round(r["weight"], 6)) for r in features.tfidf_weights(df, 2).collect())
    assert rows == [(0, "red", 1.0), (1, "blue", 1.0), (1, "red", 1.0)]
    index = features.token_index(df)
    encoded = features.encode_sequences(df, index)
    assert sorted(len(r["seq"]) for r in encoded.collect()) == [1, 1, 2]
    for frame in (encoded, features.tfidf_weights(df, 2)):
        assert "hashpartitioning(doc_id" not in frame._jdf.queryExecution().executedPlan().toString()


def test_no_documents_have_no_weights_and_no_sequences(spark):
    empty = docs(spark, [])
    assert features.tfidf_weights(empty).count() == 0
    assert features.encode_sequences(empty, features.token_index(empty)).count() == 0


def test_vocabulary_cut_amid_ties(spark):
    df = docs(spark, [(i, f"w{i:03d}") for i in range(50)] + [(99, "top top")])
    rows = features.ngram_vocabulary(df, 4).orderBy("idx").collect()
    assert [r["term"] for r in rows] == ["top", "top top", "w000", "w001"]


def test_grams_of_rows_beside_each_other_are_counted_together(spark):
    rows = [(i, "aa bb aa bb") for i in range(100)] + [(100, None), (101, " "), (102, "cc")]
    df = docs(spark, rows).coalesce(1)
    assert features._marks(df).count() == 5  # one row a gram, where each text had six
    got = {r["term"]: (r["n"], r["docs"]) for r in features.ngram_counts(df).collect()}
    assert got == {"aa": (200, 100), "bb": (200, 100), "aa bb": (200, 100), "bb aa": (100, 100), "cc": (1, 1)}


def test_small_pieces_and_folds_count_alike(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 9)), [0, 1, None][i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fold int")
    whole = sorted(map(tuple, features.ngram_counts(df).collect()))
    counts = features.fold_counts(df, 2)
    assert sorted((r["term"], r["n"], r["docs"]) for r in counts.terms.collect()) == whole
    own = {r["term"]: (r["n"], r["docs"]) for r in features.ngram_counts(df.where("fold = 1")).collect()}
    assert {r["term"]: (r["n_in"][1], r["docs_in"][1]) for r in counts.terms.collect() if r["n_in"][1]} == own
    monkeypatch.setattr(features, "PIECE_BYTES", 10)
    assert sorted(map(tuple, features.ngram_counts(df).collect())) == whole


def test_smaller_vocabulary_is_the_head_of_the_largest(spark):
    rows = [(i, f"w{i % 5}a w{i % 3}b", i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fold int")
    found, n = features.vocabularies_without(features.fold_counts(df, 2), 0, [3, 6])
    own = df.where("fold = 1")
    assert n == own.count()
    for k, vocabulary in zip((3, 6), found):
        assert sorted(map(tuple, vocabulary.collect())) == sorted(map(tuple, features.ngram_vocabulary(own, k).collect()))
