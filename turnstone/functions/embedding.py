"""Vectors for texts: a deterministic default, and a way to use a model."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions import text as T

DIM = 64


def hashed(text: Column, dim: int = DIM) -> Column:
    """How often tokens fall into each of dim slots by hash, brought to length one; zeros for a text without tokens."""
    slots = F.transform(T.tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)))

    def counted(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(held, lambda s: s == i)).cast("double"))

    def norm(counts: Column) -> Column:
        return F.sqrt(F.aggregate(counts, F.lit(0.0), lambda total, x: total + x * x))

    return let(slots, lambda held: let(counted(held), lambda counts: let(norm(counts), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_model(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """An embedding like hashed, by a model: load gives, once a worker, what turns texts into vectors."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in model([t or "" for t in texts])], dtype=object)

    return F.pandas_udf("array<double>")(embed)
