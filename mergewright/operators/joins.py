"""Joins of pairs with items (J1 to J11) and set operations on ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import hot_split_join


class MissingError(ValueError):
    """A strict lookup found ids without a row."""


def first_per_key(df: DataFrame, key: str, *order: Column, columns: list[str] | None = None) -> DataFrame:
    """The first row per key by an explicit order, combined on the map side."""
    columns = columns or [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(key, "_r.*")


def last_per_key(df: DataFrame, key: str, *order: Column, columns: list[str] | None = None) -> DataFrame:
    """The last row per key by an explicit order."""
    columns = columns or [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(key, "_r.*")


def pair_texts(pairs: DataFrame, texts: DataFrame, policy: str = "preserve", hot: list | None = None) -> DataFrame:
    """Both texts of every pair as text1 and text2.

    ``texts`` has one row per id (id, text). ``preserve`` keeps every pair, with
    an empty text for a missing item; ``drop`` keeps pairs with two non-empty
    texts; ``error`` raises for ids without an item. Rows, repeated or not, are
    kept as they are; an id that holds many pairs is joined apart.
    """
    if policy not in ("preserve", "drop", "error"):
        raise ValueError(policy)
    a = texts.select(F.col("id").alias("id1"), F.col("text").alias("text1"), F.lit(True).alias("has1"))
    b = texts.select(F.col("id").alias("id2"), F.col("text").alias("text2"), F.lit(True).alias("has2"))
    out = hot_split_join(hot_split_join(pairs, a, "id1", "left", hot), b, "id2", "left")
    if policy == "error" and not out.where("has1 is null or has2 is null").isEmpty():
        raise MissingError("pairs name ids without an item")
    out = out.withColumns({"text1": F.coalesce("text1", F.lit("")), "text2": F.coalesce("text2", F.lit("")), "has1": F.coalesce("has1", F.lit(False)), "has2": F.coalesce("has2", F.lit(False))})
    return out.where("text1 <> '' and text2 <> ''") if policy == "drop" else out


def missing_counts(joined: DataFrame) -> DataFrame:
    """Pairs, missing items and empty texts of a J1 result."""
    def count(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    missing = (~F.col("has1")).cast("long") + (~F.col("has2")).cast("long")
    empty = (F.col("has1") & (F.col("text1") == "")).cast("long") + (F.col("has2") & (F.col("text2") == "")).cast("long")
    return joined.agg(F.count(F.lit(1)).alias("n_pairs"), count(missing).alias("missing_items"), count(empty).alias("empty_texts"))


def with_category(pairs: DataFrame, categories: DataFrame, default: str | None = "unknown", hot: list | None = None) -> DataFrame:
    """Category of id1; strict (default None) raises for missing ids."""
    c = categories.select(F.col("id").alias("id1"), F.col("category").alias("category"))
    out = hot_split_join(pairs, c, "id1", "left", hot)
    if default is None:
        if not out.where("category is null").isEmpty():
            raise MissingError("pairs name ids without a category")
        return out
    return out.withColumn("category", F.coalesce("category", F.lit(default)))


@dataclass
class Tier:
    """A source of texts; lower numbers are looked up first."""

    table: DataFrame
    number: int


def tiered_lookup(ids: DataFrame, tiers: list[Tier], strict: bool = False) -> DataFrame:
    """(id, text, tier) by the first tier that has the id, for the ids given."""
    both = None
    for t in tiers:
        part = t.table.select("id", "text", F.lit(t.number).alias("tier"))
        both = part if both is None else both.unionByName(part)
    found = both.join(ids.select("id").distinct(), "id", "left_semi")
    best = found.groupBy("id").agg(F.min(F.struct("tier", "text")).alias("_r")).select("id", "_r.text", "_r.tier")
    if strict and not ids.select("id").distinct().join(best, "id", "left_anti").isEmpty():
        raise MissingError("ids that no tier has")
    return best


def semi(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among the ids."""
    return df.join(ids, key, "left_semi")


def without_used(rest: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key combination was not used, repeated rows included."""
    return rest.join(used.select(*keys).distinct(), keys, "left_anti")


def matched_parameters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parameters of two models by name; raises for names that b lacks."""
    if not a.join(b, "param", "left_anti").isEmpty():
        raise MissingError("parameters that the second model lacks")
    return a.join(b.select("param", F.col("shape").alias("shape_b"), F.col("values").alias("values_b")), "param")


def ids_of(*frames: DataFrame) -> DataFrame:
    """Distinct ids of both columns of all frames."""
    both = None
    for f in frames:
        part = f.select(F.explode(F.array("id1", "id2")).alias("id"))
        both = part if both is None else both.unionByName(part)
    return both.where("id is not null").distinct()


def difference(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def oversampled(df: DataFrame, condition: Column, times: int = 2) -> DataFrame:
    """U4: rows that meet the condition ``times`` times, others once, in one pass."""
    n = F.when(F.coalesce(condition, F.lit(False)), F.lit(times)).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def is_subset(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """U5."""
    return a.join(b, keys, "left_anti").isEmpty()


def is_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """U5."""
    return a.join(b, keys, "left_semi").isEmpty()


def is_unique(df: DataFrame, keys: list[str]) -> bool:
    """U5."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
