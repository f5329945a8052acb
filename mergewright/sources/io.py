"""Sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class CountError(RuntimeError):
    """A sink wrote another number of rows than it should have."""


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A scan; projection and filters reach the reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def needed(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is needed. No early stop: repeated ids would be lost."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows without decoding a column."""
    return spark.read.parquet(path).count()


def write_csv(df: DataFrame, path: str, expected: int | None = None, order: Column | None = None, single: bool = False) -> int:
    """CSV with a header; the rows are counted while they are written and
    must be as many as expected. ``single`` makes one ordered file, for results
    small enough for one task."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if single:
        out = out.repartition(1)
        out = out.sortWithinPartitions(order) if order is not None else out
    elif order is not None:
        out = out.orderBy(order)
    out.write.option("header", True).mode("overwrite").csv(path)
    n = seen.get["n"]
    if expected is not None and n != expected:
        raise CountError(f"{n} rows were written, not {expected}")
    return n


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """S8."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def json_document(rows: list[dict], path: str) -> None:
    """A small document of metrics, written by the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=2, ensure_ascii=False)


def append_events(df: DataFrame, path: str) -> None:
    """One JSON object per line, appended."""
    df.write.mode("append").json(path)


def last_events(spark: SparkSession, path: str, event: str, order: str, n: int = 20) -> DataFrame:
    """The last n lines of one kind of event."""
    return spark.read.json(path).where(F.col("event") == event).orderBy(F.col(order).desc()).limit(n)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def cached_parts(spark: SparkSession, path: str, key: str, wanted: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """A table partitioned by ``key``; only missing parts are computed and
    appended. A part counts as present once its directory has a file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for value, make in wanted.items():
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={value}")
        fs = p.getFileSystem(conf)
        if not fs.exists(p) or not any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p)):
            make().withColumn(key, F.lit(value)).write.mode("append").partitionBy(key).parquet(path)
    return spark.read.parquet(path).where(F.col(key).isin(list(wanted)))


def command_table(spark: SparkSession, text: str, columns: str) -> DataFrame:
    """Rows of a command's comma-separated output."""
    lines = [(x,) for x in text.splitlines() if x.strip()]
    rows = spark.createDataFrame(lines, "line string")
    return rows.select(F.from_csv("line", columns, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r")).select("r.*")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def ordered_listing(spark: SparkSession, path: str, glob: str, extras: tuple[str, ...] = ()) -> DataFrame:
    """K4: names of matching files in order, then extra names, with positions.

    A folder's listing is metadata; names are sorted by the driver.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/{glob}")
    found = p.getFileSystem(conf).globStatus(p) or []
    names = sorted(s.getPath().getName() for s in found)
    return spark.createDataFrame(list(enumerate([*names, *extras])), "position int, name string")
