"""Joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the left side's rows, so
#: there are fewer than 1 / HOT_SHARE hot keys whatever the size of the data.
HOT_SHARE = 0.002
#: ... and at least this many rows; smaller groups never hurt.
HOT_ROWS = 20_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> list:
    """Keys that hold more than ``share`` of the rows: at most ``1 / share``.

    Counts are combined on the map side; only the hot keys reach the driver.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    big = counts.where(F.col("n") > least)
    rows = big.orderBy(F.col("n").desc()).limit(int(1 / share)).collect()
    if not rows:
        return []
    total = df.count()
    return [r[0] for r in rows if r["n"] > share * total]


def hot_split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``left.join(right, key, how)`` (inner or left) with hot keys of the left apart.

    ``right`` must hold at most one row per key. Its rows for hot keys are fewer
    than ``1 / HOT_SHARE``, a proven bound, so that part is broadcast and the hot
    rows of the left side stay where they are; the rest joins by shuffle.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if hot is None:
        hot = hot_keys(left, key)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right.where(~is_hot), key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)


def salted_join(left: DataFrame, right: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of two sides that may both hold many rows of a key.

    The rows of the left's hot keys (see ``hot_keys``) are dealt to as many salts as
    they fill with ``rows`` rows each; the right's rows of those keys are repeated
    once per salt. So a task gets at most a salt's share of a hot key.
    """
    hot = hot_keys(left, key, least=rows)
    if not hot:
        return left.join(right, key)
    counts = {r[0]: r[1] for r in left.where(F.col(key).isin(hot)).groupBy(key).agg(F.count(F.lit(1))).collect()}  # at most 1 / HOT_SHARE
    salts = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(-(-n // rows)))])
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right.where(~is_hot), key)
    dealt = left.where(is_hot).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.element_at(salts, F.col(key))).cast("int"))
    spread = right.where(is_hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.element_at(salts, F.col(key)).cast("int") - 1)))
    return cold.unionByName(dealt.join(spread, [key, "_salt"]).drop("_salt"))
