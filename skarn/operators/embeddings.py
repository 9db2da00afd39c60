"""Searches over vectors and over claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.functions import vectors as V


def similarity(vector: str, like: list[float], measure: str = "cosine") -> Column:
    return (V.cosine if measure == "cosine" else V.dot)(vector, V.query(like))


def sift(rows: DataFrame, like: list[float], measure: str = "cosine", threshold: float = 0.0, limit: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows (id, timestamp, vector, seq) of at least ``threshold``, the first ``limit`` in scan order, with their score."""
    if start is not None or end is not None:
        rows = rows.filter(F.col("timestamp").between(start or 0, end if end is not None else 2**63 - 1))
    found = rows.withColumn("score", similarity("vector", like, measure)).filter(F.col("score") >= threshold).orderBy("seq")
    return found if limit is None else found.limit(limit)


def top(rows: DataFrame, like: list[float], k: int, measure: str = "cosine") -> DataFrame:
    """The ``k`` most similar rows; equal scores in scan order. One partial top-k for each task."""
    return rows.withColumn("score", similarity("vector", like, measure)).orderBy(F.desc("score"), "seq").limit(k)


def compose(rows: DataFrame, k: int, **parts) -> DataFrame:
    """The ``k`` rows of the highest composed score."""
    return rows.withColumn("score", V.composed_score("vector", timestamp="timestamp", **parts)).orderBy(F.desc("score"), "seq").limit(k)


def in_space(rows: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Rows whose first axes lie in an inclusive box."""
    test = F.lit(True)
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        test = test & F.col("vector")[i].between(a, b)
    return rows.filter(test)


def search_text(claims: DataFrame, query: str, k: int) -> DataFrame:
    """Claims (claim_id, text, seq) by the share of the query's words that they hold, those above zero."""
    return claims.withColumn("score", T.matched_share(query, "text")).filter("score > 0").orderBy(F.desc("score"), "seq").limit(k)


def search_vector(claims: DataFrame, like: list[float], k: int, least: float = 0.0) -> DataFrame:
    return claims.withColumn("score", similarity("vector", like)).filter(F.col("score") >= least).orderBy(F.desc("score"), "seq").limit(k)


def search_hybrid(claims: DataFrame, query: str, like: list[float] | None, text_weight: float, vector_weight: float, k: int) -> DataFrame:
    """Weighted sum of both scores, those above zero; without a vector the text alone counts."""
    score = F.lit(text_weight) * T.matched_share(query, "text")
    if like is not None:
        score = score + F.lit(vector_weight) * F.when(F.col("vector").isNotNull(), similarity("vector", like)).otherwise(0.0)
    return claims.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "seq").limit(k)


def keyword_claims(claims: DataFrame, query: str) -> DataFrame:
    """Claims that hold every word of the query, exactly."""
    asked = T.words(F.lit(query))
    return claims.filter(F.size(F.array_except(asked, T.words("text"))) == 0)
