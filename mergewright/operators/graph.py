"""Components over pair edges and leakage-free splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import keyed_hash, unit_hash
from ..session import Scratch
from .skew import hot_keys, hot_split_join


def components(edges: DataFrame, a: str = "id1", b: str = "id2", max_rounds: int = 100) -> DataFrame:
    """G1: (id, component) of every id of the edges; component is the least id.

    Alternating large-star and small-star steps until the edges are stars. Steps
    are group minima and joins back on the group's key; every round is a written
    table. Self pairs keep their id as a component of its own; null ends are
    ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    full = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    ids = full.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    links = scratch.save(full.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        large = scratch.save(_star(links, large=True), "large")
        small = scratch.save(_star(large, large=False), "small")
        done = links.join(small, ["u", "v"], "left_anti").isEmpty() and small.join(links, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(links, large)
        links = small
        if done:
            break
    else:
        raise RuntimeError(f"not stars after {max_rounds} rounds")
    return ids.join(links.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u > v). Large star: every vertex links its greater
    neighbours to its least neighbour or itself; small star: a vertex links its
    lesser neighbours and itself to the least of them."""
    if large:
        arcs = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = links
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = hot_split_join(arcs, least, "u", "inner", hot_keys(arcs, "u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def held_out(components_: Column, share: float, seed: int) -> Column:
    """Whether a component is held out, by keyed hash."""
    return unit_hash(str(seed), components_) < share


def split_components(rows: DataFrame, category: str, tune: float, evaluation: float, seed: int) -> DataFrame:
    """(component, category, split): components of each category in keyed
    order; the first ``max(1, bround(n * tune))`` are tune, the next eval, the
    rest train; categories of fewer than three components are all train.

    A component that spans categories belongs to its least one, so no component
    is in two splits.
    """
    comps = rows.groupBy("component").agg(F.min(category).alias("category"))
    w = Window.partitionBy("category")
    ranked = comps.withColumns({"n": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy(keyed_hash(str(seed), F.col("component")), "component"))})
    n_tune = F.greatest(F.lit(1), F.bround(F.col("n") * tune).cast("int"))
    n_eval = F.greatest(F.lit(1), F.bround(F.col("n") * evaluation).cast("int"))
    split = F.when(F.col("n") < 3, "train").when(F.col("r") <= n_tune, "tune").when(F.col("r") <= n_tune + n_eval, "eval").otherwise("train")
    return ranked.select("component", "category", split.alias("split"))


def with_component(pairs: DataFrame, comps: DataFrame, key: str = "id1") -> DataFrame:
    """The component of every pair by one of its ids."""
    return hot_split_join(pairs, comps.select(F.col("id").alias(key), "component"), key, "inner")


def assert_disjoint(train: DataFrame, evaluation: DataFrame, key: str = "component") -> None:
    """Refuse training and evaluation rows that share a component."""
    if not train.select(key).join(evaluation.select(key), key, "left_semi").isEmpty():
        raise ValueError("training and evaluation share components")
