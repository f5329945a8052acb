"""Bands, keyed samples, top-k and orders.

Samples are exact in size: rows are ranked by a keyed hash within their group, so
they depend on the seed and the rows only. Every ranking is a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import keyed_hash, unit_hash


def confident(target: Column, low: float = 0.2, high: float = 0.8) -> Column:
    """at or beyond the bounds."""
    return (target <= low) | (target >= high)


def grey(target: Column, low: float = 0.2, high: float = 0.8) -> Column:
    """strictly between the bounds, the complement of F1."""
    return (target > low) & (target < high)


def binary(target: Column, threshold: float = 0.5) -> Column:
    """F3."""
    return (target >= threshold).cast("tinyint")


def swapped(df: DataFrame, seed: int, share: float, *key: str) -> DataFrame:
    """id1 and id2 change places for a share of the rows, by keyed hash."""
    coin = unit_hash(str(seed), *[F.col(k) for k in key]) < share
    return df.withColumns({"id1": F.when(coin, F.col("id2")).otherwise(F.col("id1")), "id2": F.when(coin, F.col("id1")).otherwise(F.col("id2")), "swapped": coin})


def dense_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """sorted distinct values as 0, 1, 2...

    Codes are given to the distinct values only, which are few enough to sort in
    one task; the rows join them.
    """
    values = df.select(column).distinct().where(F.col(column).isNotNull())
    coded = values.withColumn(out, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(coded, column, "left")


#: The optimizer limits groups before the shuffle up to this many rows a group only.
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_k(df: DataFrame, by: list[str], k: int | Column, *order: Column, most: int | None = None) -> DataFrame:
    """At most k rows per group in a total order.

    A bound on ``row_number`` becomes a group limit before the shuffle, so a
    group with most of the rows sends k rows per task; the session's threshold is
    raised to the bound where it is lower. Where k depends on the row, ``most`` is
    the greatest k and limits the groups first.
    """
    limit = k if isinstance(k, int) else most
    conf = df.sparkSession.conf
    if limit and 0 < int(conf.get(_GROUP_LIMIT, "1000")) < limit:
        conf.set(_GROUP_LIMIT, str(limit))
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("_n", F.row_number().over(w))
    if limit:
        ranked = ranked.where(F.col("_n") <= limit)
    return (ranked if isinstance(k, int) else ranked.where(F.col("_n") <= k)).drop("_n")


def keyed_order(seed: int | str, *key: str) -> list[Column]:
    """A shuffle as an order: keyed hash, then the key itself."""
    return [keyed_hash(str(seed), *[F.col(k) for k in key]), *[F.col(k) for k in key]]


def sample_per_group(df: DataFrame, by: list[str], cap: int | Column, seed: int | str, *key: str, most: int | None = None) -> DataFrame:
    """At most ``cap`` rows per group without replacement."""
    return top_k(df, by, cap, *keyed_order(seed, *key), most=most)


def hard_and_anchor(df: DataFrame, by: list[str], error: str, hard: int, anchor: int, seed: int, pair: list[str], *key: str) -> DataFrame:
    """The hardest rows per group and a sample of the rest,
    tagged before they are put together."""
    h = top_k(df, by, hard, F.col(error).desc(), *[F.col(k) for k in key])
    rest = df.join(h.select(*by, *pair).distinct(), [*by, *pair], "left_anti")
    a = sample_per_group(rest, by, anchor, seed, *key)
    return h.withColumn("source", F.lit("llm_hard")).unionByName(a.withColumn("source", F.lit("llm_anchor")))


def interleaved(df: DataFrame, by: str, epochs: int, seed: int, *key: str) -> DataFrame:
    """Epoch, round and place of every row: one row per group and round, the
    groups in another order each round."""
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    within = Window.partitionBy("epoch", by).orderBy(keyed_hash(str(seed), F.col("epoch"), *[F.col(k) for k in key]), *[F.col(k) for k in key])
    return e.withColumn("round", F.row_number().over(within) - 1).withColumn("turn", keyed_hash(str(seed), F.col("epoch"), F.col("round"), F.col(by)))


def batches(df: DataFrame, order: list[Column], size: int, drop_last: bool = False) -> DataFrame:
    """K8: batch number of every row of a total order.

    Positions come from range partitions and their counts; nothing is sorted in
    one task.
    """
    out = numbered(df, order).withColumn("batch", F.floor(F.col("position") / size))
    if drop_last:
        whole = out.groupBy("batch").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") == size).select("batch")
        out = out.join(whole, "batch", "left_semi")
    return out


def numbered(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Position of every row in a total order, by range partitions."""
    from ..session import Scratch, parallelism

    n = parallelism(df.sparkSession)
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({c: o for c, o in zip(names, order)})
    part = Scratch(df.sparkSession, "numbered").save(keyed.repartitionByRange(n, *names).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = sorted((r["_part"], r["n"]) for r in part.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for p, c in counts:
        starts.append((p, at))
        at += c
    first = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*names)) - 1
    return part.withColumn("_local", local).join(F.broadcast(first), "_part").withColumn(out, F.col("_start") + F.col("_local")).drop("_part", "_start", "_local", *names)


def sharded(df: DataFrame, shards: int, position: str = "position") -> DataFrame:
    """K9: round robin over positions."""
    return df.withColumn("shard", F.pmod(F.col(position), F.lit(shards)).cast("int"))


def length_buckets(df: DataFrame, partitions: int, *texts: str) -> DataFrame:
    """K2: rows of similar text length together, for a scorer that pads; the
    order is given back by the position column that the rows carry."""
    length = sum((F.length(t) for t in texts), F.lit(0))
    return df.withColumn("_len", length).repartitionByRange(partitions, "_len").sortWithinPartitions("_len").drop("_len")
