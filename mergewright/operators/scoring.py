"""Pair scoring as a pluggable stage.

A scorer is made once per task from a factory and scores batches of texts. The
native scorers are columns and stay inside code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from .sampling import length_buckets


class Scorer(Protocol):
    def score(self, left: list[str], right: list[str]) -> list[float]: ...


class TokenJaccard:
    """Share of common tokens; two texts without tokens score 0."""

    def score(self, left: list[str], right: list[str]) -> list[float]:
        out = []
        for a, b in zip(left, right):
            x, y = set(a.lower().split()), set(b.lower().split())
            out.append(len(x & y) / len(x | y) if x | y else 0.0)
        return out


def score_pairs(df: DataFrame, make: Callable[[], Scorer], text1: str = "text1", text2: str = "text2", batch: int = 128, both_ways: bool = False, buckets: int | None = None, out: str = "predict") -> DataFrame:
    """M1, M2: the input's columns with a score.

    ``both_ways`` averages both directions; ``buckets`` puts texts of similar
    length together first (K2), for scorers that pad. Scores are in [0, 1].
    """
    src = length_buckets(df, buckets, text1, text2) if buckets else df
    schema = T.StructType([*src.schema.fields, T.StructField(out, T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for f in frames:
            scores: list[float] = []
            for at in range(0, len(f), batch):
                a, b = f[text1].iloc[at : at + batch].tolist(), f[text2].iloc[at : at + batch].tolist()
                s = scorer.score(a, b)
                if both_ways:
                    s = [0.5 * (x + y) for x, y in zip(s, scorer.score(b, a))]
                scores += s
            f[out] = scores
            yield f

    return src.mapInPandas(run, schema)


def token_jaccard(a: Column, b: Column) -> Column:
    """The token scorer as a column."""
    x, y = F.array_distinct(tokens(F.lower(a))), F.array_distinct(tokens(F.lower(b)))
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays of one length; 0 for a zero vector."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def predictions(scored: DataFrame, order: str) -> DataFrame:
    """id1, id2, predict of every pair in its order."""
    return scored.orderBy(order).select("id1", "id2", F.col("predict").cast("float").alias("predict"))
