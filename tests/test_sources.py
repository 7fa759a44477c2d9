import datetime as dt

import pytest

from voxdesk.operators import features
from voxdesk.operators.joins import label_map
from voxdesk.sources import labels, messages, results

HEADER = "tweet_id,author_id,inbound,created_at,text,extra\n"


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_message_csv_with_quoted_line_breaks_and_quotes(spark, tmp_path):
    path = write(
        tmp_path, "m.csv",
        HEADER
        + '1,a,True,Tue Oct 31 22:10:47 +0000 2017,"line one\nline ""two"", end",x\n'
        + "2,,FALSE,junk,plain,x\n"
        + "3,b,maybe,Tue Oct 31 22:10:47 +0000 2017,,x\n"
        + 'x,b,true,Tue Oct 31 22:10:47 +0000 2017,"  ",x\n',
    )
    rows = messages.read_messages(spark, path).collect()
    when = dt.datetime(2017, 10, 31, 22, 10, 47)
    assert [tuple(r) for r in rows] == [
        (1, "a", True, when, 'line one\nline "two", end'),
        (2, None, False, None, "plain"),
        (3, "b", None, when, None),
        (None, "b", True, when, "  "),
    ]
    assert messages.read_messages(spark, path, columns=["text"]).columns == ["text"]
    assert [r["tweet_id"] for r in messages.read_inbound(spark, path).collect()] == [1]
    assert messages.read_with_text(spark, path).count() == 3


def test_message_columns_are_found_by_name(spark, tmp_path):
    path = write(tmp_path, "m.csv", "text,inbound,tweet_id,created_at,author_id\nhi,true,7,,me\n")
    assert tuple(messages.read_messages(spark, path).first()) == (7, "me", True, None, "hi")


def test_typed_parquet_reads_back(spark, tmp_path):
    path = write(tmp_path, "m.csv", HEADER + "1,a,True,Tue Oct 31 22:10:47 +0000 2017,hi,x\n")
    read = messages.read_messages(spark, path)
    target = str(tmp_path / "typed")
    messages.write_messages(read, target)
    again = messages.read_messages(spark, target, format="parquet")
    assert again.schema == read.schema and again.collect() == read.collect()


def test_missing_messages_raise(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        messages.read_inbound(spark, str(tmp_path / "none.csv"))
    empty = write(tmp_path, "e.csv", HEADER + "1,a,True,x,,x\n")
    with pytest.raises(ValueError, match="text"):
        messages.read_with_text(spark, empty)


def test_label_file(spark, tmp_path):
    path = write(tmp_path, "l.csv", 'severity,text,intent\n 2 ,"a, b"," billing "\n1,  ,x\n,t,x\n3,t,\n')
    assert [tuple(r) for r in labels.read_labels(spark, path).collect()] == [("a, b", "billing", "2")]
    bad = write(tmp_path, "bad.csv", "text,intent\na,b\n")
    with pytest.raises(ValueError, match="severity"):
        labels.read_labels(spark, bad)
    with pytest.raises(ValueError, match="no non-empty rows"):
        labels.read_labels(spark, write(tmp_path, "none.csv", "text,intent,severity\n,x,1\n"))


def test_labels_grow_into_a_new_path(spark, tmp_path):
    none = labels.read_labels_or_empty(spark, str(tmp_path / "absent.csv"))
    assert none.count() == 0
    new = spark.createDataFrame([('say "hi"\nthere', "x", 2)], "text string, intent string, severity int")
    first = str(tmp_path / "first")
    labels.append_labels(none, new, first)
    old = labels.read_labels_or_empty(spark, first)
    second = str(tmp_path / "second")
    labels.append_labels(old, new, second)
    assert [tuple(r) for r in labels.read_labels_or_empty(spark, second).collect()] == [('say "hi"\nthere', "x", "2")] * 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        labels.append_labels(old, new, first)


def test_ratings_round_trip(spark, tmp_path):
    rows = [("tweet, one", "x", 2, "re\nply", 5, None)]
    df = spark.createDataFrame(
        rows,
        "original_tweet string, predicted_intent string, predicted_severity int, generated_reply string, rating int, rater_id string",
    )
    labels.write_ratings(df, str(tmp_path / "r"))
    assert [tuple(r) for r in labels.read_ratings(spark, str(tmp_path / "r")).collect()] == rows


def test_encoders_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b", "x"), (2, "b c", "y")], "doc_id long, text string, intent string")
    index, known = features.token_index(docs), label_map(docs, "intent")
    run = spark.createDataFrame([(50, 0.5)], "length int, accuracy double")
    path = str(tmp_path / "encoders")
    results.save_encoders(path, index, {"intent": known}, run)
    read_index, maps, read_run = results.load_encoders(spark, path, ["intent"])
    assert sorted(map(tuple, read_index.select("word", "idx").collect())) == [
        ("<OOV>", 1), ("a", 3), ("b", 2), ("c", 4),
    ]
    assert sorted(map(tuple, maps["intent"].collect())) == [("x", 0), ("y", 1)]
    assert read_run.first()["length"] == 50
