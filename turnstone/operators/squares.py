"""Two tables compared row by row with row, in squares of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 20_000


def squares(left: DataFrame, right: DataFrame, compare: Callable, schema: str, side: int = SIDE) -> DataFrame:
    """compare(rows of left, rows of right) -> rows, both pyarrow tables, over squares of about `side` rows a side that together cover each pair of rows once.

    Rows are dealt by a hash of all their columns' first one; a left row goes to each piece of right and the other way
    round, so what is shuffled is each table as often as the other has pieces."""
    p, q = (max(1, math.ceil(t.count() / side)) for t in (left, right))

    def dealt(rows: DataFrame, mine: int, others: int, names: tuple[str, str]) -> DataFrame:
        held = rows.withColumn(names[0], F.pmod(F.xxhash64(rows.columns[0]), F.lit(mine)).cast("int"))
        return held.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(p * q, "_p", "_q")

    mine = dealt(left, p, q, ("_p", "_q")).groupBy("_p", "_q")
    theirs = dealt(right, q, p, ("_q", "_p")).groupBy("_p", "_q")
    return mine.cogroup(theirs).applyInArrow(compare, schema)


def unit_rows(vectors):
    """A pyarrow column of vectors as a matrix of rows of length one; zeros stay."""
    import numpy as np
    import pyarrow.compute as pc

    held = vectors.to_pylist() if vectors.null_count else pc.list_flatten(vectors).to_numpy()
    v = np.array(held, float).reshape(len(vectors), -1)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
