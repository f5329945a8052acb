"""Ranking metrics and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_precision(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """A1: step-wise average precision per group over distinct scores.

    Returns the group, n, n_pos and ap (null for groups of a single class).
    Rows are summed per (group, score) first, so the ordered window runs over
    distinct scores and a group with most of the rows is no larger there.
    """
    per = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    steps = per.select(*by, "pos", "n", F.sum("pos").over(down).alias("cp"), F.sum("n").over(down).alias("cn"), F.sum("pos").over(whole).alias("tp"))
    ap = F.sum(F.when(F.col("tp") > 0, F.col("pos").cast("double") / F.col("tp") * (F.col("cp").cast("double") / F.col("cn"))))
    out = steps.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), ap.alias("ap"))
    return out.withColumn("ap", F.when((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")), F.col("ap")))


def macro_ap(per: DataFrame, by: list[str] | None = None, guarded: bool = True) -> DataFrame:
    """A2, A3: mean over categories. Guarded skips groups of a single class (0.0
    if none is left); unguarded counts them as 0.0 without and 1.0 with positives."""
    value = F.col("ap") if guarded else F.coalesce("ap", F.when(F.col("n_pos") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return per.groupBy(*(by or [])).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("macro_ap"))


def category_report(df: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """A4: category, n, pos_rate, ap in the order of categories (K3)."""
    per = average_precision(df, [by], score, label)
    return per.select(by, "n", (F.col("n_pos") / F.col("n")).alias("pos_rate"), "ap").orderBy(by)


def composite(problem: Column, grey: Column, tune: Column, weights: tuple[float, float, float]) -> Column:
    """A5: weighted sum; the weights are parameters."""
    return problem * weights[0] + grey * weights[1] + tune * weights[2]


def agreement(df: DataFrame, by: list[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Share of rows on the label's side of the threshold, and above it."""
    above = F.col(score) >= threshold
    return df.groupBy(*by).agg(F.avg((above == (F.col(label) >= threshold)).cast("double")).alias("agree"), F.avg(above.cast("double")).alias("pred_pos"), F.count(F.lit(1)).alias("n"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """A11."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1e-6))


def argmax(df: DataFrame, score: str, position: str) -> DataFrame:
    """The row with the greatest score, the first of equals."""
    return df.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), F.col(position)).limit(1)


def argmax_where(df: DataFrame, score: str, position: str, condition: Column) -> DataFrame:
    """Argmax among rows that meet the condition, of all if none does."""
    ranked = df.where(F.col(score).isNotNull()).withColumn("_ok", F.coalesce(condition, F.lit(False)))
    return ranked.orderBy(F.col("_ok").desc(), F.col(score).desc(), F.col(position)).limit(1).drop("_ok")


def percentile_rank(by: list[str], score: str) -> Column:
    """Percentile rank with averaged ties; not ``percent_rank``."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(score))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, score))
    return (rank + (ties - 1) / 2.0) / F.count(F.lit(1)).over(Window.partitionBy(*by))


def distributed_percentile_rank(df: DataFrame, by: list[str], score: str, out: str) -> DataFrame:
    """W1 for groups of any size: ranks come from counts of distinct scores, so a
    group's rows are never sorted in one task."""
    per = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_c"))
    up = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per.select(*by, score, ((F.coalesce(F.sum("_c").over(up), F.lit(0)) + 1 + (F.col("_c") - 1) / 2.0) / F.sum("_c").over(Window.partitionBy(*by))).alias(out))
    return df.join(ranks, [*by, score])


def rank_blend(df: DataFrame, by: list[str], first: str, second: str, weight: float) -> DataFrame:
    """Weight * rank(first) + (1 - weight) * rank(second)."""
    ranked = distributed_percentile_rank(distributed_percentile_rank(df, by, first, "r1"), by, second, "r2")
    return ranked.withColumn("blend", F.col("r1") * weight + F.col("r2") * (1.0 - weight))


def blend_grid(df: DataFrame, by: str, first: str, second: str, label: str, weights: list[float]) -> DataFrame:
    """Unguarded macro AP of the blend for each weight of a small grid."""
    ranked = distributed_percentile_rank(distributed_percentile_rank(df, [by], first, "r1"), [by], second, "r2")
    grid = F.posexplode(F.array(*[F.lit(w) for w in weights])).alias("position", "weight")
    # the ranks of ties are equal sums; rounding keeps equal blends equal
    blended = ranked.select(by, label, "r1", "r2", grid).withColumn("blend", F.floor((F.col("r1") * F.col("weight") + F.col("r2") * (1.0 - F.col("weight"))) * 1e6))
    return macro_ap(average_precision(blended, ["position", "weight", by], "blend", label), ["position", "weight"], guarded=False)


def observed(df: DataFrame, **metrics: Column):
    """Counters taken while another action runs; (df, Observation)."""
    from pyspark.sql import Observation

    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen
