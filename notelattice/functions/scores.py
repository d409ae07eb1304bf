"""Scores: vector distance, text score, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60


def squared_distance(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def vector_score(distance: Column) -> Column:
    return 1 / (1 + distance)


def text_score(score: Column, rank: Column) -> Column:
    """score / (1 + score); without a positive score, the same of 1 / (60 + rank)."""
    fall = 1 / (RRF_K + rank)
    s = F.when(score > 0, score).otherwise(fall)
    return s / (1 + s)


def rrf_term(rank: Column) -> Column:
    return 1 / (RRF_K + rank)
