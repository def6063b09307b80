"""Numeric and array functions, Column -> Column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqloom.functions.plan import let

# Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054
# Sentiment labels in order.
SENTIMENT_LABELS = ("Positiva", "Neutra", "Negativa")
SENTIMENT_NAMES: Mapping[str, str] = {"positive": "Positiva", "neutral": "Neutra", "negative": "Negativa"}


def array_sum(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda total, x: total + x.cast("double"))


def normalised(weights: Column) -> Column:
    """Weights that sum to one; all zero stays as it is."""
    shares = lambda held, total: F.transform(held, lambda x: F.when(total > 0, x.cast("double") / total).otherwise(x.cast("double")))
    return let(weights, lambda held: let(array_sum(held), lambda total: shares(held, total)))


def dominant(weights: Column) -> Column:
    """Place of the first largest weight; -1 for no weight at all."""
    place = lambda held: F.when(array_sum(held) > 0, (F.array_position(held, F.array_max(held)) - 1).cast("int")).otherwise(F.lit(-1))
    return let(weights, place)


def local_weight(distribution: Column, topic: Column, k: Column) -> tuple[Column, Column]:
    """(the topic's weight, whether the distribution is as it should be).

    It should have ``k`` finite weights of at least 0, which sum to 1 (within
    1e-5), or to 0 for topic -1, whose weight is 0.
    """
    total = array_sum(distribution)
    sound = (F.size(distribution) == k) & F.forall(distribution, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    close = F.when(topic == -1, F.abs(total) <= 1e-5).otherwise(topic.between(0, k - 1) & (F.abs(total - 1) <= 1e-5))
    weight = F.when(topic == -1, F.lit(0.0)).otherwise(F.get(distribution, topic))
    return weight, F.coalesce(sound & close, F.lit(False))


def wilson(positives: Column, n: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """(proportion, low, high) of Wilson's score interval."""
    p = positives / n
    spread = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / spread
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / spread
    return p, centre - half, centre + half


def close_to(a: Column, b: Column, absolute: float = 1e-6, relative: float = 1e-5) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def best_label(scores: Column) -> Column:
    """The struct (score, label) of the highest score in an array of (label, score); the first of equals."""
    ranked = F.transform(scores, lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("place"), s["label"].alias("label")))
    return F.array_max(ranked)


def sentiment_label(label: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in SENTIMENT_NAMES.items() for x in pair))
    return F.element_at(names, F.lower(label))
