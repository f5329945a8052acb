"""Session helpers: the shared scratch folder and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it.

    Read from ``spark.checkpoint.dir``. Only where the session leaves it unset
    (local tests) a temporary folder of this machine takes its place.
    """
    found = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mergewright-")
        spark.conf.set(_CHECKPOINT_KEY, found)
    return found.rstrip("/")


class Scratch:
    """Written tables of one run, below the shared folder.

    A table is written once and read back, so a lost executor costs only the
    tasks that were running, and an iteration's plan never grows.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/mergewright/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            where = getattr(t, "_scratch_path", None)
            if where:
                p = jvm.org.apache.hadoop.fs.Path(where)
                p.getFileSystem(conf).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
