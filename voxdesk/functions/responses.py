"""Parsing of generated answers, as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions.text import strip


def answer_lines(c: Column) -> Column:
    """Trimmed lines that are not blank."""
    lines = F.transform(F.split(c, V.LINE_BREAK), strip)
    return F.filter(lines, lambda line: line != "")


def _severity_from_digits(digits: Column) -> Column:
    # Long digit runs would overflow an int, so only the length decides.
    significant = F.regexp_replace(digits, "^0+", "")
    top = V.ONLINE_MAX_SEVERITY
    return (
        F.when(digits.isNull(), F.lit(None))
        .when(F.length(significant) == 0, F.lit(0))
        .when(F.length(significant) > 1, F.lit(top))
        .otherwise(F.least(F.lit(top), significant.try_cast("int")))
    )


def label_from_lines(lines: Column) -> Column:
    """Struct (intent, severity) of an answer's lines; null if there is none.

    lines is used several times, so pass a column rather than an expression.
    """
    intent = strip(
        F.replace(F.lower(F.try_element_at(lines, F.lit(1))), F.lit("intent:"), F.lit(""))
    )
    later = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    digit_runs = F.filter(
        F.transform(later, lambda line: F.regexp_replace(line, "[^0-9]", "")),
        lambda digits: digits != "",
    )
    first = F.try_element_at(digit_runs, F.lit(1))
    severity = F.coalesce(
        _severity_from_digits(first), F.lit(V.ONLINE_DEFAULT_SEVERITY)
    )
    return F.when(
        F.size(lines) > 0,
        F.struct(
            F.when(intent == "", F.lit(V.DEFAULT_INTENT)).otherwise(intent).alias("intent"),
            severity.alias("severity"),
        ),
    )


def sample_lines(c: Column, n: Column) -> Column:
    """First n usable lines of a generated list, list markers removed."""
    unmarked = F.transform(
        answer_lines(c), lambda line: F.regexp_replace(line, V.LIST_PREFIX_PATTERN, "")
    )
    usable = F.filter(unmarked, lambda line: F.length(line) > V.MIN_AUGMENTED_LENGTH)
    return F.slice(usable, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def is_quota_error(c: Column) -> Column:
    """True if an error message speaks of a used-up quota; null is False."""
    low = F.lower(c)
    found = F.lit(False)
    for marker in V.QUOTA_MARKERS:
        found = found | F.contains(low, F.lit(marker))
    return F.coalesce(found, F.lit(False))


def speaks_of_quota(error: str) -> bool:
    """is_quota_error for one message."""
    return any(marker in error.lower() for marker in V.QUOTA_MARKERS)


def _fallback(status: Column, generated: Column, quota: str, error: str) -> Column:
    return (
        F.when(status == "ok", strip(generated))
        .when(status == "quota", F.lit(quota))
        .otherwise(F.lit(error))
    )


def reply_or_fallback(status: Column, generated: Column) -> Column:
    return _fallback(status, generated, V.QUOTA_REPLY, V.ERROR_REPLY)


def explanation_or_fallback(status: Column, generated: Column) -> Column:
    return _fallback(status, generated, V.QUOTA_EXPLANATION, V.ERROR_EXPLANATION)
