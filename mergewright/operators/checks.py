"""Checks of data sets and artefacts (V1 to V7, V9).

Every check returns the rows that fail: (what, detail). An empty result passes.
"""

from __future__ import annotations

import ast
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mask import secrets, sha256

MAX_BYTES = 100 * 1024 * 1024


def _failures(df: DataFrame, what: str, detail) -> DataFrame:
    return df.select(F.lit(what).alias("what"), detail.cast("string").alias("detail"))


def required(files: DataFrame, names: list[str]) -> DataFrame:
    """V1: files that are missing or empty, by name."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    want = files.sparkSession.createDataFrame([(n,) for n in names], "name string")
    best = want.join(have.groupBy("name").agg(F.max("length").alias("length")), "name", "left")
    return _failures(best.where("length is null or length = 0"), "required", F.col("name"))


def forbidden(files: DataFrame, suffixes: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """V2: files with a forbidden suffix, or too large."""
    bad = reduce(lambda a, b: a | b, [F.col("path").endswith(s) for s in suffixes], F.lit(False))
    return _failures(files.where(bad | (F.col("length") > max_bytes)), "forbidden", F.col("path"))


def malformed_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """V3: lines that aren't well-formed JSON; blank lines don't count."""
    text = F.col(column)
    bad = (F.trim(text) != "") & F.expr(f"try_parse_json(`{column}`)").isNull()
    return _failures(lines.where(bad), "malformed_json", F.substring(text, 1, 200))


def leaked_secrets(files: DataFrame) -> DataFrame:
    """V4: credential shapes in text files (value, path)."""
    found = files.select("path", F.explode(secrets(F.col("value"))).alias("secret"))
    return _failures(found, "secret", F.concat_ws(": ", "secret", "path"))


def unbalanced_fences(files: DataFrame) -> DataFrame:
    """V4: Markdown texts (value, path) with an odd number of fences."""
    n = F.size(F.regexp_extract_all("value", F.lit("```"), F.lit(0)))
    return _failures(files.where(n % 2 == 1), "fence", F.col("path"))


def python_errors(files: DataFrame) -> DataFrame:
    """V4: Python texts (value, path) that don't parse."""

    def run(batches):
        for b in batches:
            bad = []
            for path, value in zip(b["path"], b["value"]):
                try:
                    ast.parse(value or "")
                except (SyntaxError, ValueError) as e:
                    bad.append(("python", f"{path}: {type(e).__name__}"))
            yield pd.DataFrame(bad, columns=["what", "detail"])

    return files.select("path", "value").mapInPandas(run, "what string, detail string")


def manifest(files: DataFrame) -> DataFrame:
    """Name, length and SHA-256 of files with content."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", sha256(F.col("content")).alias("sha256"))


def manifest_mismatch(files: DataFrame, expected: DataFrame) -> DataFrame:
    """V5: files that differ from a manifest, are missing or aren't listed."""
    m = manifest(files).withColumnsRenamed({"length": "length_", "sha256": "sha256_"})
    both = expected.join(m, "name", "full")
    bad = ~(F.col("length").eqNullSafe(F.col("length_")) & F.col("sha256").eqNullSafe(F.col("sha256_")))
    return _failures(both.where(bad), "manifest", F.col("name"))


def registry_problems(candidates: DataFrame, selected: DataFrame, tolerance: float = 1e-15) -> DataFrame:
    """V7: candidates (name, position, score) must be unique and in rising order
    of score; selected (name, score) must be among them with equal scores."""
    from pyspark.sql import Window

    repeated = _failures(candidates.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated", F.col("name"))
    before = F.lag("score").over(Window.orderBy("position"))  # a short registry
    falling = _failures(candidates.withColumn("before", before).where("score < before"), "order", F.col("name"))
    unknown = _failures(selected.join(candidates, "name", "left_anti"), "unknown", F.col("name"))
    other = selected.alias("s").join(candidates.alias("c"), "name").where(F.abs(F.col("s.score") - F.col("c.score")) > tolerance)
    return reduce(DataFrame.unionByName, [repeated, falling, unknown, _failures(other, "score", F.col("name"))])


def data_contract(pairs: DataFrame) -> DataFrame:
    """V6: rows of predictions that break the contract: null ids, or a score that
    is null or outside [0, 1]."""
    bad = F.col("id1").isNull() | F.col("id2").isNull() | F.col("predict").isNull() | ~F.col("predict").between(0.0, 1.0)
    return _failures(pairs.where(bad), "contract", F.concat_ws(",", F.col("id1").cast("string"), F.col("id2").cast("string"), F.col("predict").cast("string")))


def passed(*failures: DataFrame) -> bool:
    return reduce(DataFrame.unionByName, failures).isEmpty()


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "what string, detail string")
