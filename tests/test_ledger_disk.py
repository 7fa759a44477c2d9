"""A ledger keeps answers and digests, not texts."""

from pyspark.sql import functions as F

from voxdesk.operators.ledger import Call, CallLedger

LONG = "a long text of a message that is part of its key " * 20


def model(batch):
    for prompt in batch["prompt"]:
        yield f"{len(prompt)}", None


def test_texts_are_neither_in_the_keys_nor_written_again_as_prompts(spark, tmp_path):
    df = spark.createDataFrame([(i, LONG + str(i % 6)) for i in range(12)], "id long, text string")
    book, written = CallLedger(spark, str(tmp_path / "ledger")), []
    keep = book._written
    book._written = lambda *a: written.append(keep(*a)) or written[-1]
    calls = [Call(k, model, F.concat(F.lit(k), F.col("text"))) for k in ("x", "yy")]
    out = book.ask(df, calls, "id", "text").collect()
    assert {(r["x_answer"], r["yy_answer"]) for r in out} == {(str(len(LONG) + 2), str(len(LONG) + 3))} and len(out) == 12
    assert max(len(r["call_key"]) for r in book.made().collect()) <= 64
    named = written[0][0]
    assert [c for c in named.columns if any(LONG in str(r[c]) for r in named.collect())] == ["text"]


def test_calls_of_a_ledger_with_whole_keys_are_not_repeated(spark, tmp_path):
    df = spark.createDataFrame([(i, LONG + str(i)) for i in range(4)], "id long, text string")
    book = CallLedger(spark, str(tmp_path / "ledger"))
    book.ask(df, [Call("x", model, F.col("text"))], "id", "text").collect()
    old, whole = CallLedger(spark, str(tmp_path / "old")), F.to_json(F.array(F.col("id").cast("string"), "text"))
    rows = book.made().drop("call_key").join(df.select(F.sha2("text", 256).alias("digest"), whole.alias("call_key")), "digest")
    assert rows.count() == 4
    old.table.append(rows, "earlier")

    def never(batch):
        raise AssertionError("called again")
        yield

    again = old.ask(df, [Call("x", never, F.col("text"))], "id", "text").collect()
    assert {r["x_answer"] for r in again} == {str(len(LONG) + 1)}
    assert old.made().count() == 4
