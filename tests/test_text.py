import re

import pytest
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions import dates, text

CLEANED = [
    ("@AppleSupport My iPhone is BROKEN!!! https://t.co/abc123 #fail 😡", "my iphone is broken!!!"),
    ("hello:) note:please", "hell notelease"),
    ("see http://x.com/~bob/a#frag now", "see boba now"),
    ("a b　c", "a bc"),
    ("@josé café naïve", "caf nave"),
    ("日本語 only", "only"),
    ("::pp", ":p"),
    ("price=/2 (ok) a_b", "price2 ok ab"),
    ("   ", ""),
    ("HTTP://X.CO/Y?q=1&z={k}", "k"),
    ("e-mail me@site.com, it's \"bad\" - ok?", "e-mail me.com, it's \"bad\" - ok?"),
    ("https://x.co/" + "a" * 60000, ""),
    (None, None),
]


def one_column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def results(df, column):
    rows = df.select("id", column.alias("out")).orderBy("id").collect()
    return [r["out"] for r in rows]


def test_clean_text_golden_rows(spark):
    df = one_column(spark, [raw for raw, _ in CLEANED])
    assert results(df, text.clean_text(F.col("text"))) == [want for _, want in CLEANED]


def test_clean_text_is_not_idempotent_in_corners(spark):
    df = one_column(spark, ["::pp"])
    twice = text.clean_text(text.clean_text(F.col("text")))
    assert results(df, twice) == [""]


def brute_clean(value):
    """The chain with Python's own regular expressions, one stage at a time."""
    ranges = [
        (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF),
        (0x1F1E0, 0x1F1FF), (0x2702, 0x27B0), (0x24C2, 0x1F251),
    ]
    value = value.lower()
    value = re.sub(r"https?://[!$-_a-zA-Z]+", "", value)
    value = re.sub(r"[@]\w+", "", value)
    value = re.sub(r"[#]\w+", "", value)
    value = re.sub(V.EMOTICON_PATTERN, "", value)
    value = "".join(ch for ch in value if not any(a <= ord(ch) <= b for a, b in ranges))
    value = "".join(
        ch for ch in value if ch.isspace() or (ch.isascii() and (ch.isalnum() or ch in ".,!?;:-'\""))
    )
    return " ".join(value.split())


def test_clean_text_equals_python_over_many_characters(spark):
    planes = [range(1, 0x3100), range(0x1F000, 0x1F900)]
    values = [f"a{chr(c)} {chr(c)}b  :{chr(c)})" for plane in planes for c in plane]
    # Java lower-cases these like Python; word characters newer than Java are not in the ranges
    df = one_column(spark, values)
    got = results(df, text.clean_text(F.col("text")))
    wrong = [(v, g, brute_clean(v)) for v, g in zip(values, got) if g != brute_clean(v)]
    assert wrong == []


def test_fused_and_separate_emoji_removal_agree(spark):
    values = ["x　y 😀 z", "日本　語", "a b ✂ c", "ⓜ ok"]
    df = one_column(spark, values)
    separate = text.strip_special(text.strip_emoji(text.strip_emoticons(F.lower("text"))))
    fused = text.clean_text(F.col("text"), urls=False, mentions=False, hashtags=False)
    assert results(df, fused) == results(df, separate)


@pytest.mark.parametrize(
    "flag,value,kept",
    [
        ("normalize_case", "ABC", "ABC"),
        # ":/" is an emoticon, so that stage takes it from a kept URL
        ("urls", "http://x.co", "http/x.co"),
        ("mentions", "@bob", "@bob"),
        ("hashtags", "#tag", "#tag"),
        ("emoticons", ":)", ":)"),
    ],
)
def test_each_flag_switches_one_stage(spark, flag, value, kept):
    df = one_column(spark, [value])
    off = text.clean_text(F.col("text"), special=False, **{flag: False})
    on = text.clean_text(F.col("text"), special=False)
    assert results(df, off) == [kept]
    assert results(df, on) != [kept]


def test_keep_punctuation_modes(spark):
    df = one_column(spark, ["it's 5_0%, é ok!"])
    assert results(df, text.strip_special(F.col("text"), True)) == ["it's 50, ok!"]
    assert results(df, text.strip_special(F.col("text"), False)) == ["its 50 ok"]


def test_collapse_and_strip_use_unicode_white_space(spark):
    df = one_column(spark, ["  a \t\n b c 　", " a b ", "a  b", "\n", " x"])
    assert results(df, text.collapse_ws(F.col("text"))) == ["a b c", "a b", "a b", "", "x"]
    assert results(df, text.strip(F.col("text"))) == ["a \t\n b c", "a b", "a  b", "", "x"]
    assert results(df, text.is_blank(F.col("text"))) == [False, False, False, True, False]


def test_white_space_text_and_class_are_the_same_set():
    spelled = {c for c in map(chr, range(0x3001)) if c.isspace()}
    assert set(V.WS_TEXT) == spelled


@pytest.mark.parametrize(
    "length,start,label",
    [
        (0, 0, "0-39"), (39, 0, "0-39"), (40, 40, "40-79"), (319, 260, "260-319"),
        (320, 320, "320-399"), (999, 800, "800-999"), (1000, 1000, "1000+"), (50000, 1000, "1000+"),
    ],
)
def test_length_bins(spark, length, start, label):
    row = spark.range(1).select(text.length_bin(F.lit(length)).alias("b")).first()["b"]
    assert tuple(row) == (start, label)


def test_tokens_and_ngrams(spark):
    df = one_column(spark, ["A bc_1 déf x, Gh!", "", "one", None])
    tokens = df.select("id", text.tokenize(F.col("text")).alias("t"))
    assert [r["t"] for r in tokens.orderBy("id").collect()] == [["bc_1", "déf", "gh"], [], ["one"], None]
    grams = tokens.select("id", text.with_ngrams(F.col("t"), 1, 3).alias("g")).orderBy("id").collect()
    assert grams[0]["g"] == ["bc_1", "déf", "gh", "bc_1 déf", "déf gh", "bc_1 déf gh"]
    assert grams[1]["g"] == [] and grams[2]["g"] == ["one"]


def test_sequence_tokens(spark):
    df = one_column(spark, ["Hello, wörld-wide\tweb (it's)\n"])
    assert results(df, text.seq_tokens(F.col("text"))) == [["hello", "wörld", "wide", "web", "it's"]]


@pytest.mark.parametrize(
    "ids,side,want",
    [
        ([1, 2, 3], "pre", [0, 0, 1, 2, 3]), ([1, 2, 3], "post", [1, 2, 3, 0, 0]),
        ([1, 2, 3, 4, 5, 6], "pre", [2, 3, 4, 5, 6]), ([1, 2, 3, 4, 5, 6], "post", [1, 2, 3, 4, 5]),
        ([], "pre", [0] * 5), ([], "post", [0] * 5),
    ],
)
def test_pad(spark, ids, side, want):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    assert df.select(text.pad(F.col("ids"), 5, side).alias("p")).first()["p"] == want


def test_pad_rejects_unknown_side():
    with pytest.raises(ValueError):
        text.pad(F.lit(None), 5, "middle")


def test_created_at(spark):
    df = one_column(
        spark,
        [
            "Tue Oct 31 22:10:47 +0000 2017", "Wed Nov 01 00:00:00 -0530 2017",
            "Tue Feb 31 22:10:47 +0000 2017", "2017-10-31", "", None,
        ],
    )
    stamp = dates.parse_created_at(F.col("text"))
    got = results(df, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2017-10-31 22:10:47", "2017-11-01 00:00:00", None, None, None, None]
    assert results(df, dates.month_key(stamp))[:2] == ["2017-10", "2017-11"]


def test_created_at_does_not_follow_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # this wall time does not exist in New York
        df = one_column(spark, ["Sun Mar 12 02:30:00 +0000 2017"])
        stamp = dates.parse_created_at(F.col("text")).cast("string")
        assert results(df, stamp) == ["2017-03-12 02:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
