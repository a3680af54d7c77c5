"""Similarity, recency and budget arithmetic."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DECAY = 0.007
BOOST = 1.5
CHARS_PER_TOKEN = 3.5


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero where either vector is."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def similarity(a: Column, b: Column) -> Column:
    """Cosine distance d as 1 - d / 2."""
    return (1 + cosine(a, b)) / 2


def days_before(as_of: datetime | str, ts: Column, clamp: bool) -> Column:
    now = F.lit(as_of).cast("timestamp")
    days = (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)
    return F.greatest(days, F.lit(0.0)) if clamp else days


def recency(as_of: datetime | str, ts: Column, decay: float = DECAY, clamp: bool = True) -> Column:
    return F.exp(-F.lit(decay) * days_before(as_of, ts, clamp))


def boost(project: Column, current: str | None, factor: float = BOOST) -> Column:
    return F.lit(1.0) if current is None else F.when(project == current, F.lit(factor)).otherwise(F.lit(1.0))


def estimated_tokens(text: Column) -> Column:
    return F.length(text) / CHARS_PER_TOKEN
