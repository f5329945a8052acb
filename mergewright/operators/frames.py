"""Training frames of several weighted sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clip

TRAIN_COLUMNS = ("id1", "id2", "category", "label_target", "label_weight", "teacher_prob", "distill_weight", "gray_teacher_prob", "gray_distill_weight", "source")


def _framed(df: DataFrame, **columns: Column) -> DataFrame:
    """the fixed columns, floats in single precision as stored."""
    out = df.withColumns(columns)
    return out.select(*[F.col(c).cast("float").alias(c) if c not in ("id1", "id2", "category", "source") else F.col(c) for c in TRAIN_COLUMNS])


def human_rows(df: DataFrame, teacher: str = "teacher") -> DataFrame:
    """Weight grows with the teacher's error."""
    prob = clip(F.col(teacher), 0.001, 0.999)
    return _framed(df, label_target=F.col("target"), teacher_prob=prob, label_weight=F.lit(3.5) + F.lit(2.0) * F.abs(prob - F.col("target")), distill_weight=F.lit(0.02), gray_teacher_prob=F.lit(0.5), gray_distill_weight=F.lit(0.0), source=F.lit("human"))


def replay_rows(df: DataFrame, teacher: str = "teacher") -> DataFrame:
    """R2: hard rows weigh more as labels, anchor rows more as teacher's word."""
    hard = F.col("source") == "llm_hard"
    return _framed(df, label_target=F.col("target"), teacher_prob=clip(F.col(teacher), 0.001, 0.999), label_weight=F.when(hard, 1.5).otherwise(0.8), distill_weight=F.when(hard, 0.08).otherwise(1.0), gray_teacher_prob=F.lit(0.5), gray_distill_weight=F.lit(0.0))


def grey_rows(df: DataFrame, teacher: str = "teacher") -> DataFrame:
    """R3."""
    prob = clip(F.col(teacher), 0.001, 0.999)
    return _framed(df, label_target=F.col("target"), teacher_prob=prob, label_weight=F.lit(0.25), distill_weight=F.lit(0.05), gray_teacher_prob=prob, gray_distill_weight=F.lit(1.0), source=F.lit("gray"))


def train_frame(*parts: DataFrame) -> DataFrame:
    """R4, U1."""
    return reduce(DataFrame.unionByName, [p.select(*TRAIN_COLUMNS) for p in parts])
