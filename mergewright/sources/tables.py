"""Scans of the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan of a table, projected where columns are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def current_rows(items: DataFrame, *columns: str) -> DataFrame:
    """The current row of every id: the one with the greatest ``updated_at``.

    ``max_by`` combines on the map side, so an id that holds many of the rows
    sends one row per map task. Equal stamps differ only in ``loaded_at``; the
    later one is taken. Rows with a null id are left out.
    """
    columns = columns or tuple(c for c in items.columns if c != "id")
    rank = F.struct(F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**63))), F.col("loaded_at"))
    best = F.max_by(F.struct(*[F.col(c) for c in columns]), rank)
    return items.where(F.col("id").isNotNull()).groupBy("id").agg(best.alias("_row")).select("id", "_row.*")


#: Ids with several rows that are broadcast at most; more of them are joined by shuffle.
REPEATED_IDS = 1_000_000


def current_narrow(items: DataFrame, scratch: Scratch, *columns: str) -> DataFrame:
    """(id, columns) of the current rows, for wide texts of which few ids repeat.

    Ids with several rows are found from ids and stamps alone. All other rows pass
    without a shuffle, before anything reads their texts; only the rows of the
    repeated ids are grouped. The repeated ids are counted first: up to
    ``REPEATED_IDS`` are broadcast, more are joined by shuffle. Rows that tie on
    ``updated_at`` give the one with the greatest columns; a null id is left out.
    """
    known = items.where(F.col("id").isNotNull())
    several = scratch.save(known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("again")), "repeated")
    small = F.broadcast(several) if several.count() <= REPEATED_IDS else several
    stamp = F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**63)))
    once = known.join(small, F.col("id") == F.col("again"), "left_anti").select(F.col("id").cast("long"), *columns)
    often = known.join(small, F.col("id") == F.col("again"), "left_semi")
    best = often.groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.struct(stamp.alias("_stamp"), *columns)).alias("_r")).select("id", *[F.col(f"_r.{c}") for c in columns])
    return once.unionByName(best)


def latest_by_window(items: DataFrame) -> DataFrame:
    """The same by ``row_number``, for tables whose ids are all small groups."""
    w = Window.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("loaded_at").desc_nulls_last())
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
