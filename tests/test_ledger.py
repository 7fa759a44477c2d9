"""Calls that are paid for once, and tables that grow by commits."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.operators import labeling, ledger

from voxdesk.operators.ledger import Call, CallLedger
from voxdesk.operators.ranking import hash_key
from voxdesk.session import shared_dir
from voxdesk.sources.commits import CommittedTable
from voxdesk.sources.labels import append_label_batch, label_table, read_label_batches


def counted(log, kind, quota=(), fails=()):
    """A model that writes every call to a file."""

    def answer(batch: pd.DataFrame):
        for prompt in batch["prompt"]:
            with open(log, "a") as out:
                out.write(f"{kind}:{prompt}\n")
            if prompt in quota:
                yield None, "429 too many"
            elif prompt in fails:
                yield None, "broken"
            else:
                yield f"{kind} of {prompt}", None

    return answer


def calls_in(log):
    return open(log).read().split("\n")[:-1] if os.path.exists(log) else []


def rows(spark, n=60):
    return spark.createDataFrame([(i, f"p{i}") for i in range(n)], "id long, text string").repartition(3)


def in_order(spark, n, first):
    df = rows(spark, n).withColumn("place", hash_key(V.SEED, "id"))
    return df.withColumn("wave", ledger.wave_of(F.col("place"), n, first)).orderBy("wave", "place").collect()


def test_waves_follow_the_hash_and_double(spark):
    listed = in_order(spark, 2000, 50)
    assert [r["place"] for r in listed] == sorted(r["place"] for r in listed)
    sizes = pd.Series([r["wave"] for r in listed]).value_counts().sort_index()
    assert list(sizes.index) == list(range(7))
    assert all(0.6 < sizes[k] / (50 * 2 ** max(0, k - 1)) < 1.5 for k in range(6))


def test_kinds_stop_together_and_a_second_run_repeats_no_call(spark, tmp_path):
    log = str(tmp_path / "calls")
    listed = in_order(spark, 60, 10)
    stop = next(r for r in listed if r["wave"] == 1)
    calls = [
        Call("reply", counted(log, "reply", quota={stop["text"]}, fails={listed[0]["text"]}), F.col("text")),
        Call("why", counted(log, "why"), F.when(F.col("id") % 2 == 0, F.col("text"))),
    ]
    first = CallLedger(spark, str(tmp_path / "ledger"), first_wave=10)
    out = {r["id"]: r for r in first.ask(rows(spark), calls, "id").collect()}
    assert first.stopped
    wave_0 = {r["id"] for r in listed if r["wave"] == 0}
    for r in out.values():
        want = ("error" if r["id"] == listed[0]["id"] else "ok") if r["id"] in wave_0 else "quota"
        assert r["reply_status"] == want
        assert r["why_status"] == (None if r["id"] % 2 else "ok" if r["id"] in wave_0 else "quota")
        assert r["reply_answer"] == (f"reply of {r['text']}" if want == "ok" else None)
    # No explanation of the wave whose replies met the error, and nothing of later waves.
    made = calls_in(log)
    later = {r["text"] for r in listed if r["wave"] > 1}
    assert not any(c.split(":")[1] in later for c in made)
    assert sum(c.startswith("why") for c in made) == sum(i % 2 == 0 for i in wave_0)
    # The same run makes no further call for any frame.
    assert {r["more_status"] for r in first.ask(rows(spark), [Call("more", counted(log, "more"), F.col("text"))], "id").collect()} == {"quota"}
    assert calls_in(log) == made
    # Another run on the folder makes those that are missing, once.
    answered = {c for c in made if c != f"reply:{stop['text']}"}
    calls = [Call("reply", counted(log, "reply"), F.col("text")), Call("why", counted(log, "why"), calls[1].prompt)]
    again = CallLedger(spark, str(tmp_path / "ledger"), first_wave=10).ask(rows(spark), calls, "id").collect()
    assert all(r["reply_status"] == ("error" if r["id"] == listed[0]["id"] else "ok") for r in again)
    assert not answered & set(calls_in(log)[len(made) :])
    assert sorted(set(calls_in(log))) == sorted(
        [f"reply:p{i}" for i in range(60)] + [f"why:p{i}" for i in range(0, 60, 2)]
    )
    # A third one makes none.
    before = len(calls_in(log))
    CallLedger(spark, str(tmp_path / "ledger")).ask(rows(spark), calls, "id").collect()
    assert len(calls_in(log)) == before


def test_a_changed_prompt_is_a_new_call_and_repeated_rows_share_one(spark, tmp_path):
    log = str(tmp_path / "calls")
    twice = rows(spark, 5).unionByName(rows(spark, 5))
    book = CallLedger(spark, str(tmp_path / "ledger"))
    model = counted(log, "a")
    out = book.ask(twice, [Call("a", model, F.col("text"))], "id")
    assert out.count() == 10 and len(calls_in(log)) == 5
    book.ask(twice, [Call("a", model, F.concat(F.col("text"), F.lit("!")))], "id").collect()
    assert len(calls_in(log)) == 10


def test_no_rows_and_null_prompts(spark, tmp_path):
    log = str(tmp_path / "calls")
    book = CallLedger(spark, str(tmp_path / "ledger"))
    assert book.ask(rows(spark, 3).limit(0), [Call("a", counted(log, "a"), F.col("text"))], "id").collect() == []
    nulls = book.ask(rows(spark, 3), [Call("a", counted(log, "a"), F.lit(None).cast("string"))], "id").collect()
    assert {(r["a_status"], r["a_answer"]) for r in nulls} == {(None, None)}
    assert calls_in(log) == []


def test_label_job_shares_the_stop(spark, tmp_path):
    log = str(tmp_path / "calls")
    book = CallLedger(spark, str(tmp_path / "ledger"))
    book.ask(rows(spark, 1), [Call("reply", counted(log, "reply", quota={"p0"}), F.col("text"))], "id").collect()
    messages = rows(spark, 20).withColumnRenamed("id", "message_id")
    assert labeling.label_messages(messages, counted(log, "label"), n=20, ledger=book).collect() == []
    assert len(calls_in(log)) == 1


# Offline scores


def test_label_by_scores(spark):
    def scorer(texts, labels):
        for text in texts:
            if "broken" in text:
                raise RuntimeError("no model")
            if V.SEVERITY_SCALE in text:
                assert labels == V.OFFLINE_SEVERITIES
                yield {"a": [("3", 0.9), ("1", 0.2)], "b": [("high", 0.9)], "c": []}[text[0]], None
            else:
                assert labels == V.OFFLINE_INTENTS
                yield {"a": [(labels[1], 0.4), (labels[2], 0.4)], "b": [("unheard", 1.0)], "c": []}[text[0]], None

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "broken"), (5, None)], "message_id long, text string")
    out = labeling.label_by_scores(df.repartition(5), scorer, n=10).collect()
    got = {r["message_id"]: (r["intent"], r["severity"]) for r in out}
    assert got == {1: (V.OFFLINE_INTENTS[1], 3), 2: ("other", 2), 3: ("other", 2), 4: ("other", 2), 5: ("other", 2)}


# Commits


def test_a_repeated_append_adds_nothing_and_readers_see_whole_commits(spark):
    table = CommittedTable(spark, shared_dir(spark, "commits"), "id long, name string")
    assert table.read().collect() == []
    assert table.append(rows(spark, 3).withColumnRenamed("text", "name"), "one")
    assert not table.append(rows(spark, 9).withColumnRenamed("text", "name"), "one")
    assert table.read().count() == 3

    def breaks(batches):
        raise RuntimeError("lost")
        yield

    with pytest.raises(Exception, match="lost"):
        table.append(rows(spark, 4).mapInPandas(breaks, "id long, name string"), "two")
    assert list(table.commits()) == ["one"] and table.read().count() == 3
    assert table.append(rows(spark, 4).withColumnRenamed("text", "name"), "two")
    assert table.read().count() == 7 and table.read(["two"]).count() == 4 and table.read(["none"]).count() == 0
    with pytest.raises(ValueError):
        table.append(rows(spark, 1), "../three")


def test_label_batches(spark):
    table = label_table(spark, shared_dir(spark, "labels"))
    with pytest.raises(Exception, match="no non-empty rows"):
        read_label_batches(table)
    new = spark.createDataFrame([("t", "a", 1), (" ", "a", 2)], "text string, intent string, severity int")
    assert append_label_batch(table, new, "b1") and not append_label_batch(table, new, "b1")
    assert append_label_batch(table, new, "b2")
    assert [tuple(r) for r in read_label_batches(table).collect()] == [("t", "a", "1")] * 2




@pytest.mark.parametrize("rows", [0, 1, 999, 1_000, 2_500, 77_777, 5_000_000])
def test_rows_of_a_wave_have_its_levels(spark, rows):
    shares = [0, 1, *[1 << b for b in range(24)], *[(1 << b) - 1 for b in range(1, 25)], *range(7, 1 << 24, 99_991)]
    places = spark.createDataFrame([(f"{s:06x}",) for s in shares], "place string")
    found = places.select(ledger.wave_of(F.col("place"), rows).alias("w"), ledger.level_of(F.col("place")).alias("l")).collect()
    for r in found:
        low, high = ledger.levels_of_wave(r["w"], rows)
        assert low <= r["l"] <= high and (r["w"] < 2 or high - low <= 2 or rows > 4_000_000)


def test_a_model_sees_few_texts_at_once(spark):
    from voxdesk.operators import asking

    def sizes(batch: pd.DataFrame):
        for _ in batch["prompt"]:
            yield str(len(batch)), None

    df = spark.range(1_000).select(F.lit("x").alias("prompt")).coalesce(1)
    got = [int(r["answer"]) for r in asking.ask(df, sizes).collect()]
    assert len(got) == 1_000 and max(got) <= 256
