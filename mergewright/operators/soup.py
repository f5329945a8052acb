"""Model parameters as rows: blends and averages (M3, M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import matched_parameters


def soup(a: DataFrame, b: DataFrame, alpha: float, keep_a: str | None = None) -> DataFrame:
    """M3: (1 - alpha) * b + alpha * a per parameter (param, shape, values).

    Parameters whose name matches ``keep_a`` stay a's, as do those of another
    shape in b.
    """
    both = matched_parameters(a, b)
    mixed = F.zip_with("values", "values_b", lambda x, y: x * F.lit(alpha) + y * F.lit(1.0 - alpha))
    keep = F.col("shape") != F.col("shape_b")
    if keep_a:
        keep |= F.col("param").rlike(keep_a)
    return both.select("param", "shape", F.when(keep, F.col("values")).otherwise(mixed).alias("values"))


def moving_average(steps: DataFrame, decay: float) -> DataFrame:
    """M4: exponential moving average of each parameter over ordered steps
    (param, step, value), started at the first step's value."""
    folded = F.array_sort(F.collect_list(F.struct("step", "value")))  # one short history per parameter
    start = F.col("h")[0]["value"]
    return steps.groupBy("param").agg(folded.alias("h")).select("param", F.aggregate(F.slice("h", F.lit(2), F.size("h")), start, lambda acc, x: acc * F.lit(decay) + x["value"] * F.lit(1.0 - decay)).alias("ema"))
