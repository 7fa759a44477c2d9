"""Prompt columns built by concatenation, so text may hold any character."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxdesk import fixed_values as V


def fill_template(template: str, **columns: Column) -> Column:
    pieces = re.split(r"<<(\w+)>>", template)
    filled = [
        columns[piece].cast("string") if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
        if piece
    ]
    return F.concat(*filled)


def label_prompt(text: Column) -> Column:
    return fill_template(V.LABEL_PROMPT, text=text)


def reply_prompt(text: Column, intent: Column, severity: Column) -> Column:
    return fill_template(V.REPLY_PROMPT, text=text, intent=intent, severity=severity)


def explanation_prompt(text: Column, intent: Column, severity: Column) -> Column:
    return fill_template(
        V.EXPLANATION_PROMPT, text=text, intent=intent, severity=severity
    )


def augmentation_prompt(intent: Column, needed: Column) -> Column:
    return fill_template(V.AUGMENTATION_PROMPT, intent=intent, needed=needed)
