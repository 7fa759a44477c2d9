import hashlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.operators import classifiers, evaluation, scoring, splits
from voxdesk.operators.classifiers import Candidate
from voxdesk.operators.ledger import CallLedger
from voxdesk.plans import model_queries
from voxdesk.session import ensure_checkpoint_dir
from voxdesk.sources import results

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labeled(spark):
    rows = [
        (i, f"{w} {w}s please number {i}", intent, severity)
        for i in range(30)
        for w, intent, severity in (("bill", "billing", "2"), ("crash", "technical", "3"), ("hello", "other", "0"))
    ]
    df = spark.createDataFrame(
        [(n, *r[1:]) for n, r in enumerate(rows)], "doc_id long, text string, intent string, severity string"
    )
    return df.persist()


@pytest.fixture(scope="module")
def intent_model(labeled):
    return classifiers.fit_task(labeled, "intent")


@pytest.fixture(scope="module")
def severity_model(labeled):
    return classifiers.fit_task(labeled, "severity", family="multinomial")


def test_fit_predicts_above_the_majority_share(spark, labeled):
    tagged = splits.safe_split(labeled, "intent")
    train, test = tagged.where("split = 'train'"), tagged.where("split = 'test'")
    model = classifiers.fit_task(train, "intent")
    pairs = classifiers.predict(model, test).select(
        F.col("intent").alias("y_true"), F.col("predicted_intent").alias("y_pred")
    )
    assert evaluation.evaluate(pairs).first()["accuracy"] > 0.9


def test_language_is_learned_from_the_documents(spark):
    from voxdesk.operators.filters import clean_labeled
    from voxdesk.plans.views import Tables

    labeled = clean_labeled(Tables(spark, SF).labeled(), keep=("doc_id",)).persist()
    tagged = splits.safe_split(labeled, "intent").persist()
    model = classifiers.fit_task(tagged.where("split = 'train'"), "intent")
    pairs = classifiers.predict(model, tagged.where("split = 'test'")).select(
        F.col("intent").alias("y_true"), F.col("predicted_intent").alias("y_pred")
    )
    share = labeled.groupBy("intent").count().agg(F.max("count")).first()[0] / labeled.count()
    assert evaluation.evaluate(pairs).first()["accuracy"] > share


def test_class_scores_sum_to_one_and_follow_label_order(labeled, intent_model):
    scores = classifiers.class_scores(intent_model, labeled, "doc_id")
    sums = scores.groupBy("doc_id").agg(F.sum("score").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums) and len(sums) == 90
    best = scores.groupBy("doc_id").agg(F.max_by("class", "score").alias("c"))
    wrong = best.join(classifiers.predict(intent_model, labeled), "doc_id").where("c != predicted_intent")
    assert wrong.count() == 0


def test_regularisation_follows_c(labeled):
    weak = classifiers.fit_task(labeled, "intent", Candidate(c=10.0))
    strong = classifiers.fit_task(labeled, "intent", Candidate(c=0.1))
    size = lambda m: float((m.stages[-2].coefficientMatrix.toArray() ** 2).sum())
    assert size(weak) > size(strong)


def test_unfitted_model_raises(labeled):
    with pytest.raises(ValueError, match="no fitted model"):
        classifiers.predict(None, labeled)


def test_saved_model_predicts_the_same(labeled, intent_model, tmp_path):
    path = str(tmp_path / "model")
    results.save_model(intent_model, path)
    again = results.load_model(path)
    a = classifiers.predict(intent_model, labeled).select("doc_id", "predicted_intent").orderBy("doc_id").collect()
    b = classifiers.predict(again, labeled).select("doc_id", "predicted_intent").orderBy("doc_id").collect()
    assert a == b


def test_training_curve_falls(intent_model):
    rows = classifiers.training_curve(intent_model).orderBy("epoch").collect()
    assert rows[0]["epoch"] == 0 and rows[-1]["value"] < rows[0]["value"]


def test_grids():
    l2, l1 = classifiers.default_grids()
    assert len(l2) == 12 and len(l1) == 6
    assert {c.solver for c in l1} == {"liblinear"} and {c.penalty for c in l1} == {"l1"}


def test_tuning_picks_the_best_candidate(labeled):
    folded = splits.assign_folds(labeled, "intent")
    first = [Candidate(c=1.0, terms=50), Candidate(c=1e-9, terms=50, solver="liblinear")]
    second = [Candidate(c=1.0, terms=50, solver="liblinear", penalty="l1")]
    model, best, score = classifiers.fit_best(folded, "intent", [first, second])
    assert best == first[0] and score == pytest.approx(1.0)
    assert classifiers.predict(model, labeled).where("intent = predicted_intent").count() == 90


def test_score_messages(spark, intent_model, severity_model):
    sent = spark.createDataFrame(
        [(1, "My BILL is wrong, bills!"), (2, "@brand 😡"), (3, "crash crashs"), (4, None)],
        "message_id long, text string",
    )

    def reply(batch):
        for prompt in batch["prompt"]:
            yield (None, "quota gone") if "crash" in prompt else (f" got {len(prompt)} ", None)

    def place(seed, row):
        return hashlib.md5(f"{seed}|{row}".encode()).hexdigest()

    # The quota ends behind the first message, whatever the order of the rows.
    seed = next(s for s in range(99) if place(s, "1|My BILL is wrong, bills!") < place(s, "3|crash crashs"))
    out = scoring.score_messages(
        sent, intent_model, severity_model, reply, reply, keep=("message_id",), ledger=CallLedger(spark, seed=seed)
    )
    rows = {r["message_id"]: r for r in out.collect()}
    assert (rows[1]["predicted_intent"], rows[1]["predicted_severity"]) == ("billing", 2)
    assert rows[1]["reply"].startswith("got ") and rows[1]["text"] == "My BILL is wrong, bills!"
    assert (rows[3]["predicted_intent"], rows[3]["predicted_severity"]) == ("technical", 3)
    assert rows[3]["reply"] == V.QUOTA_REPLY and rows[3]["explanation"] == V.QUOTA_EXPLANATION
    assert rows[1]["explanation"] == V.QUOTA_EXPLANATION
    for key in (2, 4):
        assert (rows[key]["predicted_intent"], rows[key]["predicted_severity"]) == ("other", 1)
        assert rows[key]["reply"] == V.EMPTY_REPLY and rows[key]["explanation"] == V.EMPTY_EXPLANATION
    plain = scoring.score_messages(sent, intent_model, severity_model).where("reply is not null")
    assert plain.count() == 2


def test_stream_scores_equal_batch_scores(spark, intent_model, severity_model, tmp_path):
    from voxdesk.streaming.counts import read_stream
    from voxdesk.streaming.scoring import run_scoring

    folder = str(tmp_path / "in")
    sent = spark.createDataFrame([(i, f"bill {i}" if i % 2 else "#x") for i in range(20)], "message_id long, text string")
    sent.repartition(4).write.parquet(folder)
    stream = read_stream(spark, folder, sent.schema, files_per_trigger=1)
    got = run_scoring(stream, intent_model, severity_model, keep=("message_id",))
    want = scoring.score_messages(sent, intent_model, severity_model, keep=("message_id",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_reply_and_explanation_stop_together(spark, intent_model, severity_model):
    sent = spark.createDataFrame([(i, f"bill number {i}") for i in range(30)], "message_id long, text string")
    calls = spark.sparkContext.accumulator(0)

    def ends(batch):
        for _ in batch["prompt"]:
            yield None, "quota gone"

    def explains(batch):
        for _ in batch["prompt"]:
            calls.add(1)
            yield "because", None

    out = scoring.score_messages(sent, intent_model, severity_model, ends, explains, keep=("message_id",))
    assert {(r["reply"], r["explanation"]) for r in out.collect()} == {(V.QUOTA_REPLY, V.QUOTA_EXPLANATION)}
    assert calls.value == 0


def test_a_repeated_stream_batch_makes_no_call_twice(spark, intent_model, severity_model, tmp_path, monkeypatch):
    from voxdesk.sources.commits import CommittedTable
    from voxdesk.streaming.counts import read_stream
    from voxdesk.streaming.scoring import run_scoring

    log, folder, base = tmp_path / "calls", str(tmp_path / "in"), str(tmp_path / "out")

    def reply(batch):
        for prompt in batch["prompt"]:
            with open(log, "a") as out:
                out.write(prompt.replace("\n", " ") + "\n")
            yield "thanks", None

    def run():
        stream = read_stream(spark, folder, sent.schema, files_per_trigger=1)
        return run_scoring(stream, intent_model, severity_model, reply, keep=("message_id",), folder=base)

    sent = spark.createDataFrame([(i, f"bill {i}" if i % 4 else "#x") for i in range(12)], "message_id long, text string")
    sent.repartition(3).write.parquet(folder)
    append = CommittedTable.append

    def fails(table, rows, token):
        if token == "batch-1":
            raise RuntimeError("lost after the calls")
        return append(table, rows, token)

    monkeypatch.setattr(CommittedTable, "append", fails)
    with pytest.raises(Exception, match="lost after the calls"):
        run()
    monkeypatch.undo()
    before = log.read_text().splitlines()
    rows = run().collect()
    calls = log.read_text().splitlines()
    assert before and len(calls) == len(set(calls)) == 9
    assert sorted(r["message_id"] for r in rows) == list(range(12))
    assert all(r["reply"] == ("thanks" if r["message_id"] % 4 else V.EMPTY_REPLY) for r in rows)
    assert all(r["explanation"] is None or r["message_id"] % 4 == 0 for r in rows)
    assert len(run().collect()) == 12 and len(log.read_text().splitlines()) == 9


def test_tasks_on_the_same_texts_weigh_them_once(labeled, intent_model, severity_model):
    vectorizer, calls = classifiers.fit_vectorizer(labeled), []

    class Counted:
        stages = vectorizer.stages

        def transform(self, df):
            calls.append(df)
            return vectorizer.transform(df)

    both = classifiers.fit_tasks(labeled, {"intent": "auto", "severity": "multinomial"}, Counted())
    assert len(calls) == 1
    for own, model in zip((intent_model, severity_model), both, strict=True):
        assert own.stages[-1].getLabels() == model.stages[-1].getLabels()
        far = abs(own.stages[-2].coefficientMatrix.toArray() - model.stages[-2].coefficientMatrix.toArray()).max()
        assert far < 1e-6


def test_evaluation_cleans_the_texts_once(spark, labeled, monkeypatch):
    calls = []
    monkeypatch.setattr(model_queries, "_labeled", lambda t: calls.append(t) or labeled)
    pairs = labeled.select(F.col("intent").alias("y_true"), F.col("intent").alias("y_pred"))
    monkeypatch.setattr(model_queries, "_pairs", lambda *_: pairs)
    model_queries._evaluation(None).collect()
    assert len(calls) == 1


def test_score_facts_compute_each_probability_once(spark, labeled, monkeypatch):
    seen, scores = spark.sparkContext.accumulator(0), classifiers.class_scores

    def counted(score):
        seen.add(1)
        return score

    def class_scores(*given):
        rows = scores(*given)
        return rows.withColumn("score", F.udf(counted, "double").asNondeterministic()("score"))

    monkeypatch.setattr(classifiers, "class_scores", class_scores)
    monkeypatch.setattr(model_queries, "_labeled", lambda t: labeled)
    ensure_checkpoint_dir(spark)
    facts = model_queries._score_differences(SimpleNamespace(spark=spark), "intent").collect()
    assert [(r["checked"], r["violations"]) for r in facts] == [(270, 0), (90, 0), (90, 0)]
    assert seen.value == 270
