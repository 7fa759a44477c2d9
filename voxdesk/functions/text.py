"""Text functions as native column expressions; no Python runs per row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxdesk import fixed_values as V


# Most characters of a text are plain letters. A look-ahead that turns them away
# first spares the long character classes; it does not change what matches.
_NOT_LETTER = "(?![a-z ])"
_NOT_PRINTABLE = "(?![ -~])"
_NOT_SINGLE_BLANK = "(?! ?[!-~])"
_EMOTICON_START = "(?=[:;=o-])"


def _drop(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def strip(c: Column) -> Column:
    """Trim Unicode white space; Spark's trim removes U+0020 by default."""
    return F.btrim(c, F.lit(V.WS_TEXT))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(F.rlike(c, F.lit(V.NOT_WS)), F.lit(False))


def normalize(c: Column) -> Column:
    return F.lower(c)


def strip_urls(c: Column) -> Column:
    return _drop(c, V.URL_PATTERN)


def strip_mentions(c: Column) -> Column:
    return _drop(c, V.MENTION_PATTERN)


def strip_hashtags(c: Column) -> Column:
    return _drop(c, V.HASHTAG_PATTERN)


def strip_emoticons(c: Column) -> Column:
    return _drop(c, f"{_EMOTICON_START}(?:{V.EMOTICON_PATTERN})")


def strip_emoji(c: Column) -> Column:
    return _drop(c, _NOT_PRINTABLE + V.EMOJI_PATTERN)


def collapse_ws(c: Column) -> Column:
    """Turn white-space runs into one blank and strip the ends."""
    return F.trim(F.regexp_replace(c, f"{_NOT_SINGLE_BLANK}{V.WS}+", " "))


def strip_special(c: Column, keep_punctuation: bool = True, emoji: bool = False) -> Column:
    """Remove special characters and collapse white space.

    With emoji, the emoji ranges go in the same pass. Special characters cover
    all of them but U+3000, which would otherwise stay as white space.
    """
    pattern = V.SPECIAL_KEEP_PATTERN if keep_punctuation else V.SPECIAL_DROP_PATTERN
    if emoji:
        pattern = pattern.replace(r"\x{3000}", "")
    return collapse_ws(_drop(c, _NOT_LETTER + pattern))


def clean_text(
    c: Column,
    normalize_case: bool = True,
    urls: bool = True,
    mentions: bool = True,
    hashtags: bool = True,
    emoticons: bool = True,
    special: bool = True,
    keep_punctuation: bool = True,
) -> Column:
    """The cleaning chain. Each flag switches one stage; the order is fixed."""
    stages = [
        (normalize_case, normalize),
        (urls, strip_urls),
        (mentions, strip_mentions),
        (hashtags, strip_hashtags),
        (emoticons, strip_emoticons),
        (emoticons and not special, strip_emoji),
        (special, lambda x: strip_special(x, keep_punctuation, emoji=emoticons)),
    ]
    for wanted, stage in stages:
        c = stage(c) if wanted else c
    return c if special else strip(c)


def text_length(c: Column) -> Column:
    """Length in code points."""
    return F.length(c)


def _bin_labels() -> list[tuple[int, str]]:
    uppers = V.LENGTH_EDGES[1:] + [None]
    return [
        (low, f"{low}+" if high is None else f"{low}-{high - 1}")
        for low, high in zip(V.LENGTH_EDGES, uppers)
    ]


def length_bin(length: Column) -> Column:
    """Struct (bin_start, bin): left-closed length bin and its label."""
    out = F.lit(None)
    for low, label in _bin_labels():
        piece = F.struct(F.lit(low).alias("bin_start"), F.lit(label).alias("bin"))
        out = F.when(length >= low, piece).otherwise(out)
    return out


def tokenize(c: Column) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({V.TOKEN_PATTERN})"), F.lit(1))


def with_ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams from low to high words, joined by one blank.

    tokens is used several times, so pass a column rather than an expression.
    """
    grams = {1: tokens}
    for n in range(2, high + 1):
        # an n-gram is the (n-1)-gram at its place followed by the n-th word
        ends = F.slice(tokens, F.lit(n), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
        grams[n] = F.array_compact(
            F.zip_with(grams[n - 1], ends, lambda a, b: F.concat(a, F.lit(" "), b))
        )
    return F.concat(*[grams[n] for n in range(low, high + 1)])


def seq_tokens(c: Column) -> Column:
    """Sequence tokens: lower-case, punctuation to blanks, split on blanks."""
    chars = V.SEQUENCE_FILTER_CHARS
    spaced = F.translate(F.lower(c), chars, " " * len(chars))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def pad(ids: Column, length: int, side: str) -> Column:
    """Cut and zero-fill an int array to a fixed length.

    side 'pre' keeps the tail and fills in front; 'post' keeps the head and
    fills behind.
    """
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    zeros = F.array_repeat(F.lit(0), missing)
    if side == "pre":
        start = F.greatest(F.size(ids) - length, F.lit(0)) + 1
        return F.concat(zeros, F.slice(ids, start, F.lit(length)))
    if side == "post":
        return F.concat(F.slice(ids, 1, length), zeros)
    raise ValueError(f"side must be 'pre' or 'post', not {side!r}")
