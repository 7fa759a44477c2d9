"""Decisions from scores, as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """Position of the greatest score from 0; the first one of equal scores."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def above_threshold(probability: Column, threshold: float = 0.5) -> Column:
    """1 if the probability lies above the threshold, else 0."""
    return (probability > threshold).cast("int")
