import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions import prompts
from voxdesk.operators import asking, labeling, scoring

PARSED = [
    ("billing_issue\n2", ("billing_issue", 2)),
    ("Intent: Billing_Issue\nSeverity: 3", ("billing_issue", 3)),
    ("refund", ("refund", 1)),
    ("", None),
    (" \n\t", None),
    ("intent:\n9", ("other", 3)),
    ("x\nSeverity (0-3): 2", ("x", 3)),
    ("x\nnone\n0", ("x", 0)),
    ("a\n-1", ("a", 1)),
    ("z\n" + "9" * 60, ("z", 3)),
    ("\n Y \n\n no\n" + "0" * 49 + "1", ("y", 1)),
    ("a b 2", ("a", 2)),
    (None, None),
]


def test_parse_labels_golden_rows(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PARSED)], "id int, answer string")
    rows = asking.parse_labels(df).orderBy("id").collect()
    got = [None if r["intent"] is None else (r["intent"], r["severity"]) for r in rows]
    assert got == [want for _, want in PARSED]
    assert all(r["severity"] is None for r in rows if r["intent"] is None)


def test_explode_samples(spark):
    answer = "1. My bill is wrong again\n- ok\n24 hours without service\n\n* short\n(x) twelve chars"
    df = spark.createDataFrame([(1, answer), (2, ""), (3, None)], "id int, answer string")
    rows = asking.explode_samples(df, "answer", F.lit(5)).orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["sample"]) for r in rows] == [
        (1, 0, "My bill is wrong again"),
        (1, 1, "hours without service"),
        (1, 2, "(x) twelve chars"),
    ]
    assert asking.explode_samples(df, "answer", F.lit(1)).count() == 1


def test_prompts_keep_percent_signs_and_quotes(spark):
    df = spark.createDataFrame([('100% "bad" {x} <<text>>', "b", 2)], "t string, i string, s int")
    row = df.select(
        prompts.label_prompt(F.col("t")).alias("label"),
        prompts.explanation_prompt(F.col("t"), F.col("i"), F.col("s")).alias("why"),
        prompts.augmentation_prompt(F.col("i"), F.col("s")).alias("more"),
    ).first()
    assert '"""100% "bad" {x} <<text>>"""' in row["label"]
    assert row["label"].startswith("\nYou are labeling") and row["label"].endswith("billing_issue\n2\n")
    assert 'as "b" with severity 2. \nFocus' in row["why"]
    assert row["more"].startswith("\nGenerate 2 realistic") and 'to the "b" category' in row["more"]


def test_ask_passes_null_rows_unasked_and_reports_status(spark):
    seen = spark.createDataFrame([(1, "a"), (2, None), (3, "fail"), (4, "busy")], "id int, prompt string")

    def answer_one(prompt):
        if prompt == "fail":
            raise RuntimeError("boom")
        if prompt == "busy":
            raise RuntimeError("Quota used up")
        return prompt.upper()

    rows = asking.ask(seen, asking.per_row(answer_one), parallelism=2).orderBy("id").collect()
    assert [(r["answer"], r["error"], r["status"]) for r in rows] == [
        ("A", None, "ok"), (None, None, None), (None, "boom", "error"), (None, "Quota used up", "quota"),
    ]


@pytest.mark.parametrize("quota_at,kept", [(None, [1, 2, 3, 4]), (3, [1, 2]), (1, [])])
def test_cut_at_first_quota(spark, quota_at, kept):
    rows = [(i, "quota" if i == quota_at else ("error" if i == 2 else "ok")) for i in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "seq int, status string")
    cut = asking.cut_at_first_quota(df, F.col("seq"))
    assert sorted(r["seq"] for r in cut.collect()) == kept


def test_top_label_ties_and_unknown(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    scores = spark.createDataFrame(
        [(1, "b", 0.5), (1, "a", 0.5), (2, "zzz", 0.9), (2, "a", 0.1), (3, "a", 0.2), (3, "b", 0.3)],
        "id int, label string, score double",
    )
    rows = asking.top_label(ids, scores, "id", ["b", "a"]).orderBy("id").collect()
    assert [r["intent"] for r in rows] == ["b", "other", "b", "other"]


def test_top_severity(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    scores = spark.createDataFrame(
        [(1, "3", 0.9), (1, "1", 0.1), (2, "7", 0.9), (3, "high", 0.9)],
        "id int, label string, score double",
    )
    rows = asking.top_severity(ids, scores, "id").orderBy("id").collect()
    assert [r["severity"] for r in rows] == [3, 2, 2, 2]


def messages(spark, n=40):
    rows = [(i, f"text number {i} bill" if i % 2 else f"text number {i}") for i in range(n)]
    return spark.createDataFrame(rows, "message_id long, text string")


LABELER = asking.keyword_model([("bill", "billing_issue")], [("bill", 2)])


def test_label_messages_skips_known_texts_and_samples(spark):
    existing = spark.createDataFrame([("text number 0",), ("text number 1 bill",)], "text string")
    rows = labeling.label_messages(messages(spark), LABELER, n=1000, existing=existing).collect()
    assert sorted(r["message_id"] for r in rows) == list(range(2, 40))
    for r in rows:
        assert (r["intent"], r["severity"]) == (("billing_issue", 2) if r["message_id"] % 2 else ("other", 1))
    assert labeling.label_messages(messages(spark), LABELER, n=7).count() == 7


def test_label_messages_errors(spark):
    def fails_on_some(batch: pd.DataFrame):
        for value in batch["text"]:
            yield (None, "boom") if "number 3" in value else ("x\n2", None)

    dropped = labeling.label_messages(messages(spark), fails_on_some, n=40)
    assert dropped.count() == 40 - 11
    kept = labeling.label_messages(messages(spark), fails_on_some, n=40, on_error="default")
    failed = kept.where(F.col("text").contains("number 3")).distinct().collect()
    assert kept.count() == 40
    assert {(r["intent"], r["severity"]) for r in failed} == {(V.DEFAULT_INTENT, V.OFFLINE_DEFAULT_SEVERITY)}
    with pytest.raises(ValueError):
        labeling.label_messages(messages(spark), fails_on_some, on_error="ignore")


def test_label_messages_stops_at_quota(spark):
    def quota_at_five(batch: pd.DataFrame):
        for value in batch["text"]:
            yield (None, "429") if value.startswith("text number 5") else ("x\n2", None)

    from voxdesk.operators.ranking import hash_key

    ordered = messages(spark).withColumn("key", hash_key(V.SEED, "message_id")).orderBy("key").collect()
    ids = [r["message_id"] for r in ordered]
    rows = labeling.label_messages(messages(spark), quota_at_five, n=40).collect()
    assert sorted(r["message_id"] for r in rows) == sorted(ids[: ids.index(5)])
    assert rows


def test_augment_relabels_and_stops_at_quota(spark):
    labeled = spark.createDataFrame(
        [("t", "big", 1)] * 5 + [("t", "mid", 1)] * 3 + [("t", "rare", 2)] * 1, "text string, intent string, severity int"
    )

    def generator(batch: pd.DataFrame):
        for wanted, needed in zip(batch["wanted"], batch["needed"]):
            yield "\n".join(f"{i}) bill trouble of {wanted} {i}" for i in range(needed + 2)), None

    out = labeling.augment(labeled, generator, LABELER)
    new = out.where("is_synthetic").collect()
    assert out.count() == 9 + 2 + 4
    assert {r["intent"] for r in new} == {"billing_issue"}

    def quota_on_rare(batch: pd.DataFrame):
        for text in batch["text"]:
            yield (None, "quota") if text.endswith("rare 2") else ("x\n1", None)

    cut = labeling.augment(labeled, generator, quota_on_rare).where("is_synthetic").collect()
    assert sorted(r["text"] for r in cut) == [
        "bill trouble of mid 0", "bill trouble of mid 1", "bill trouble of rare 0", "bill trouble of rare 1",
    ]


def test_empty_fallback(spark):
    df = spark.createDataFrame([("@brand 😡",), ("real text",), (None,)], "text string")
    rows = scoring.empty_fallback(df).collect()
    assert len(rows) == 2
    assert rows[0]["predicted_intent"] == "other" and rows[0]["predicted_severity"] == 1
    assert rows[0]["reply"] == V.EMPTY_REPLY and rows[0]["explanation"] == V.EMPTY_EXPLANATION


def test_ask_keeps_large_ids_beside_nulls(spark):
    ids = [927384650192837465, None, 9007199254740993]
    seen = spark.createDataFrame([(i, f"p{k}") for k, i in enumerate(ids)], "id long, prompt string").coalesce(1)
    rows = asking.ask(seen, asking.per_row(str.upper)).orderBy("prompt").collect()
    assert [r["id"] for r in rows] == ids
    assert [r["answer"] for r in rows] == ["P0", "P1", "P2"]


def test_ask_stops_after_a_quota_error(spark):
    calls = spark.sparkContext.accumulator(0)

    def answer_one(text):
        calls.add(1)
        if text == "p2":
            raise RuntimeError("quota exceeded")
        return text

    seen = spark.createDataFrame([(k, f"p{k}") for k in range(9)], "id long, prompt string").coalesce(1)
    model = asking.per_row(answer_one)
    rows = asking.ask(seen, model, stop_on_quota=True, order=F.col("id")).orderBy("id").collect()
    assert [r["status"] for r in rows] == ["ok", "ok"] + ["quota"] * 7
    assert calls.value == 3


def test_labels_without_a_score_are_no_candidates(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    scores = spark.createDataFrame(
        [(1, "a", None), (1, "b", 0.9), (2, "a", None)], "id long, label string, score double"
    )
    rows = asking.top_label(ids, scores, "id", ["a", "b"]).orderBy("id").collect()
    assert [r["intent"] for r in rows] == ["b", "other"]
