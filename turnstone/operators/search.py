"""Vector search: exact nearest neighbours, re-ranked by recency and project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import scoring as S

CANDIDATES, RESULTS = 30, 10


def nearest(edus: DataFrame, query: Column, n: int) -> DataFrame:
    """The n rows most similar to the query, a vector literal; the sort and limit become one top-k per task."""
    return edus.withColumn("similarity", S.similarity(F.col("embedding"), query)).orderBy(F.desc("similarity"), "edu_id").limit(n)


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def search(edus: DataFrame, query: Column, as_of: str, current_project: str | None = None, strict_project: str | None = None, results: int = RESULTS, candidates: int = CANDIDATES, decay: float = S.DECAY, factor: float = S.BOOST, clamp: bool = False, since: str | None = None, until: str | None = None) -> DataFrame:
    """The best `results` of the `candidates` most similar rows by similarity x recency x boost.

    edus: edu_id, session_id, project, ts, embedding.  A strict project filters before the candidates are chosen; since and until bound ts in the same way."""
    chosen = edus if strict_project is None else edus.where(F.col("project") == strict_project)
    chosen = chosen if since is None else chosen.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    chosen = chosen if until is None else chosen.where(F.col("ts") < F.lit(until).cast("timestamp"))
    weight, factor = S.recency(as_of, F.col("ts"), decay, clamp), S.boost(F.col("project"), current_project, factor)
    # one projection: with two between them, a limit and its sort are not planned as a top-k
    scored = nearest(chosen, query, candidates).withColumns({"recency_weight": weight, "project_boost": factor, "score": F.col("similarity") * weight * factor})
    return scored.orderBy(F.desc("score"), "edu_id").limit(results).drop("embedding")
