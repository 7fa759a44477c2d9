import pytest
from pyspark.sql import functions as F

from voxdesk.functions.text import clean_text, is_blank
from voxdesk.operators import comparison, corpus, evaluation, filters, joins, ratings


def pairs(spark, truth="aabbc", pred="abbba"):
    return spark.createDataFrame(list(zip(range(len(truth)), truth, pred)), "id int, y_true string, y_pred string")


def test_metrics_golden(spark):
    row = evaluation.evaluate(pairs(spark)).first()
    want = {
        "accuracy": 0.6, "precision_macro": 0.3889, "recall_macro": 0.5, "f1_macro": 0.4333,
        "precision_weighted": 0.4667, "recall_weighted": 0.6, "f1_weighted": 0.52,
    }
    assert {k: round(row[k], 4) for k in want} == want


def test_weighted_recall_is_accuracy_and_cells_sum_to_rows(spark):
    p = pairs(spark, "abcabcaabb", "abbbacaabc")
    row = evaluation.evaluate(p).first()
    assert row["recall_weighted"] == pytest.approx(row["accuracy"])
    cells = evaluation.confusion(p).collect()
    assert len(cells) == 9 and sum(r["n"] for r in cells) == 10


def test_confusion_with_listed_labels_ignores_other_pairs(spark):
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in evaluation.confusion(pairs(spark), ["b", "a"]).collect()}
    assert cells == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 2}


def test_normalised_confusion_of_empty_rows_is_zero(spark):
    cells = evaluation.confusion_normalised(pairs(spark, "aab", "abc"), "true").collect()
    by_row = {}
    for r in cells:
        by_row[r["y_true"]] = by_row.get(r["y_true"], 0) + r["share"]
    assert by_row == {"a": 1.0, "b": 1.0, "c": 0.0}


def test_binary_metrics(spark):
    row = evaluation.binary_metrics(pairs(spark, "nnyyy", "nyyyn")).first()
    assert row["positive"] == "y"
    assert (row["precision_binary"], row["recall_binary"]) == (2 / 3, 2 / 3)
    third = evaluation.binary_metrics(pairs(spark, "nnyyy", "nzyyn")).first()
    assert (third["precision_binary"], third["recall_binary"]) == (1.0, 2 / 3)
    assert evaluation.binary_metrics(pairs(spark)).count() == 0


def test_report_rows(spark):
    rows = {r["row"]: r for r in evaluation.classification_report(pairs(spark)).collect()}
    assert list(rows)[-3:] == ["accuracy", "macro avg", "weighted avg"] and set(rows) >= {"a", "b", "c"}
    assert rows["accuracy"]["f1"] == 0.6 and rows["accuracy"]["precision"] is None
    assert rows["c"]["precision"] == 0.0 and rows["c"]["support"] == 1


def test_one_class_input(spark):
    row = evaluation.evaluate(pairs(spark, "aaa", "aaa")).first()
    assert row["accuracy"] == row["f1_macro"] == row["f1_weighted"] == 1.0


def test_gate_and_errors_and_agreement(spark):
    gated = evaluation.accuracy_gate(evaluation.evaluate(pairs(spark)), 0.6).first()
    assert gated["meets_threshold"] is True
    assert evaluation.accuracy_gate(evaluation.evaluate(pairs(spark))).first()["meets_threshold"] is False
    errors = [(r["y_true"], r["y_pred"], r["n"]) for r in evaluation.top_errors(pairs(spark), 5).collect()]
    assert errors == [("a", "b", 1), ("c", "a", 1)]
    rates = {r["label"]: r["agreement"] for r in evaluation.agreement_by_label(pairs(spark), ["c", "a", "q"]).collect()}
    assert rates == {"c": 0.0, "a": 0.5, "q": None}


def test_comparisons_tell_missing_from_null(spark):
    long = spark.createDataFrame(
        [("m1", "accuracy", 0.5), ("m1", "f1_macro", None), ("m2", "f1_macro", 0.25)],
        "model string, metric string, value double",
    )
    one = {r["model"]: r["value"] for r in comparison.compare_models(long, "accuracy").collect()}
    assert one == {"m1": 0.5, "m2": 0.0}
    many = {(r["model"], r["metric"]): r["value"] for r in comparison.compare_metrics(long, ["accuracy", "f1_macro"]).collect()}
    assert many == {("m1", "accuracy"): 0.5, ("m1", "f1_macro"): None, ("m2", "accuracy"): 0.0, ("m2", "f1_macro"): 0.25}
    two = comparison.compare_two(long, {"Intent": "m1", "Severity": "m9"}, {"Intent": "m2", "Severity": "m1"}).collect()
    assert [tuple(r) for r in two] == [("Intent", 0.5, None), ("Severity", None, 0.5)]
    table = {r["model"]: r["accuracy"] for r in comparison.results_table(long, ["accuracy"]).collect()}
    assert table == {"m1": 0.5, "m2": None}


def test_ratings_without_rows(spark):
    empty = spark.createDataFrame([], "rating int")
    assert ratings.rating_mean(empty).first()["mean_rating"] == 0.0
    assert [tuple(r) for r in ratings.rating_distribution(empty).collect()] == [(i, 0) for i in range(1, 6)]
    assert {r["percent"] for r in ratings.rating_summary(empty).collect()} == {0.0}


def test_ratings_outside_the_scale(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (6,), (None,)], "rating int")
    assert sorted(r["rating"] for r in ratings.ratings_valid(df).collect()) == [1, 5]
    assert ratings.ratings_rejected(df).count() == 3


def test_cross_table_keeps_zero_cells(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "x string, y int")
    cells = {(r["x"], r["y"]): r["count"] for r in corpus.cross_table(df, "x", "y").collect()}
    assert cells == {("a", 1): 2, ("a", 2): 0, ("b", 1): 0, ("b", 2): 1}
    shares = {(r["x"], r["y"]): r["share"] for r in corpus.cross_table(df, "x", "y", True).collect()}
    assert shares == {("a", 1): 1.0, ("a", 2): 0.0, ("b", 1): 0.0, ("b", 2): 1.0}


def test_direction_counts_of_nothing(spark):
    df = spark.createDataFrame([], "inbound boolean")
    assert [r["count"] for r in corpus.direction_counts(df).collect()] == [0, 0]


def test_unlabelled_keeps_duplicates_unless_told(spark):
    messages = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, "z")], "message_id long, text string")
    labels = spark.createDataFrame([("z",), ("z",), (None,)], "text string")
    assert sorted(r["message_id"] for r in joins.unlabelled(messages, labels).collect()) == [1, 2, 3]
    assert sorted(r["message_id"] for r in joins.unlabelled(messages, labels, dedupe=True).collect()) == [1, 2]


def test_label_ids_round_trip(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "q")], "id int, label string")
    known = joins.label_map(df.where("label != 'q'"), "label")
    encoded = joins.encode_labels(df, "label", known)
    assert {r["id"]: r["label_id"] for r in encoded.collect()} == {1: 1, 2: 0, 3: 1, 4: None}
    decoded = joins.decode_labels(encoded.drop("label"), "label_id", known)
    assert {r["id"]: r["label"] for r in decoded.collect()} == {1: "b", 2: "a", 3: "b", 4: None}


def test_guards(spark):
    df = spark.createDataFrame([], "text string")
    with pytest.raises(ValueError, match="intent"):
        filters.require_columns(df, ["text", "intent"])
    with pytest.raises(ValueError, match="nothing"):
        filters.require_rows(df, "nothing to do")


def test_cleaning_drops_emptied_rows_and_counts_them(spark):
    df = spark.createDataFrame([("@a", "x", "1"), ("text", " y ", "2")], "text string, intent string, severity string")
    cleaned = filters.clean_labeled(df)
    assert [tuple(r) for r in cleaned.collect()] == [("text", "y", "2")]
    kept = ~is_blank(clean_text(F.col("text")))
    assert corpus.job_counts(df, kept).first().asDict() == {"processed": 2, "kept": 1, "dropped": 1}


def test_a_null_label_is_a_cell_like_others(spark):
    p = spark.createDataFrame([(1, "a", "a"), (2, None, "a"), (3, None, None)], "id int, y_true string, y_pred string")
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in evaluation.confusion(p).collect()}
    assert cells == {("a", "a"): 1, ("a", None): 0, (None, "a"): 1, (None, None): 1}
    table = corpus.cross_table(p, "y_true", "y_pred").collect()
    assert {(r["y_true"], r["y_pred"]): r["count"] for r in table} == cells


def test_many_labels(spark):
    many = spark.range(100_000).select("id", F.format_string("label %06d", "id").alias("y_true"))
    many = many.withColumn("y_pred", F.col("y_true"))
    with pytest.raises(ValueError, match="labels"):
        evaluation.confusion(many)
    assert evaluation.pair_counts(many).count() == 100_000
    assert corpus.cross_counts(many, "y_true", "y_pred").count() == 100_000
    ids = joins.label_map(many, "y_true", rows_per_bucket=30_000)
    wrong = ids.where(F.col("label") != F.format_string("label %06d", F.col("label_id")))
    assert (ids.count(), wrong.count()) == (100_000, 0)


def test_rows_without_a_partner_are_counted(spark):
    truth = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    predicted = spark.createDataFrame([(2,), (3,), (4,)], "id int")
    assert tuple(joins.match_counts(truth, predicted).first()) == (1, 2, 2)
