"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every vertex draws an exponential shift. Clusters grow breadth-first from
shifted start times, so a vertex joins the cluster that reaches it first; each
cluster has a diameter of at most twice the number of rounds. Clusters contract
to super-vertices, edges inside a cluster vanish, and the decomposition recurses
on the inter-cluster edges until none are left. The assignments of all levels
are then composed from the last level back to the first, and each group takes
its smallest member as identifier.

Scale: a level is a fixed number of joins of arcs with the frontier; a vertex
with a large share of all edges is joined by the split of ``hot_split_join``;
minima are combined on the map side. Nothing but counts reaches the driver and
each level is a table in the shared folder, so lineage stays short.

Defined results: links with a null end, with equal ends or below the threshold
are ignored; repeated links and either order count once; a null target is no
link; an empty table gives an empty one; columns other than id1, id2 and target
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, hot_keys, hot_split_join
from ..session import Scratch

#: Rounds of growth per level, and the rate of the exponential shifts.
ROUNDS = 5
BETA = 0.35
MAX_LEVELS = 64


def links(matches: DataFrame, threshold: float | None = 0.5) -> DataFrame:
    """Distinct undirected links (u < v) of a table of pairs."""
    keep = F.col("id1").isNotNull() & F.col("id2").isNotNull() & (F.col("id1") != F.col("id2"))
    if threshold is not None:
        keep &= F.col("target").cast("float") >= F.lit(threshold).cast("float")
    u, v = F.least("id1", "id2").cast("long").alias("u"), F.greatest("id1", "id2").cast("long").alias("v")
    return matches.where(keep).select(u, v).distinct()


#: A unit of time on the scale of the arrivals, which are whole numbers.
TICK = 2**56


def _start(vertex: Column, level: int) -> Column:
    """Shifted start time in [0, ROUNDS] ticks: ROUNDS less a capped exponential draw."""
    draw = (F.pmod(F.xxhash64(vertex, F.lit(level)), F.lit(2**40)).cast("double") + 1.0) / float(2**40 + 1)
    return ((F.lit(float(ROUNDS)) - F.least(F.lit(float(ROUNDS)), -F.log(draw) / F.lit(BETA))) * float(TICK)).cast("long")


def _hot(df: DataFrame, key: str, rows: int) -> list:
    """Hot keys of a table of which the number of rows is known; small ones have none."""
    return hot_keys(df, key) if rows > HOT_ROWS else []


def decompose(edges: DataFrame, level: int, hot: list, scratch: Scratch) -> DataFrame:
    """Cluster of every end of the edges: (vertex, cluster).

    The state of a vertex is the earliest arrival that reached it, and its centre,
    as two numbers, so minima are taken by hashing. In round r those that arrived
    within [r - 1, r) are settled and reach out to their neighbours. Every vertex
    has an arc to itself that carries its own state, so a round reads the state
    once: one join on the arcs' start, one minimum by their end. Where hot vertices
    split the join, the state is written between rounds.
    """
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    ends = edges.select(F.explode(F.array("u", "v")).alias("src")).distinct()
    arcs = scratch.save(edges.select(F.inline(both)).unionByName(ends.withColumn("dst", F.col("src"))), f"arcs{level}")

    def reach(met: DataFrame, r: int) -> DataFrame:
        settled = (F.col("at") >= (r - 1) * TICK) & (F.col("at") < r * TICK)
        at = F.when(F.col("src") == F.col("dst"), F.col("at")).otherwise(F.when(settled, F.col("at") + TICK))
        out = met.select(F.col("dst").alias("vertex"), at.alias("at"), "centre").where("at is not null").groupBy("vertex")
        return out.agg(F.min("at").alias("at"), F.min_by("centre", "at").alias("centre"))

    state = reach(arcs.withColumns({"at": _start(F.col("src"), level), "centre": F.col("src")}), 1)
    for r in range(2, ROUNDS + 1):
        if hot:
            state = scratch.save(state, f"round{r}")
        state = reach(hot_split_join(arcs, state.withColumnRenamed("vertex", "src"), "src", "inner", hot), r)
    out = scratch.save(state.select("vertex", F.col("centre").alias("cluster")), f"level{level}")
    scratch.drop(arcs)
    return out


def connected_groups(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, group_id) of every end of the links; group_id is the least id."""
    current, levels = scratch.save(edges, "edges"), []
    for level in range(MAX_LEVELS):
        n = current.count()  # from the footers
        if not n:
            break
        hot = _hot(current.select(F.explode(F.array("u", "v")).alias("src")), "src", 2 * n)
        assigned = decompose(current, level, hot, scratch)
        levels.append((assigned, 2 * n))
        a = assigned.select(F.col("vertex").alias("u"), F.col("cluster").alias("cu"))
        b = assigned.select(F.col("vertex").alias("v"), F.col("cluster").alias("cv"))
        both = hot_split_join(hot_split_join(current, a, "u", "inner", hot), b, "v", "inner", hot)
        between = both.where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct()
        contracted = scratch.save(between, f"edges{level + 1}")
        scratch.drop(current)
        current = contracted
    else:
        raise RuntimeError(f"not contracted after {MAX_LEVELS} levels")
    if not levels:
        return current.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    final, rows = levels[-1]
    for assigned, rows in reversed(levels[:-1]):
        up = final.select(F.col("vertex").alias("cluster"), F.col("cluster").alias("top"))
        joined = hot_split_join(assigned, up, "cluster", "left", _hot(assigned, "cluster", rows))
        composed = scratch.save(joined.select("vertex", F.coalesce("top", "cluster").alias("cluster")), "composed")
        scratch.drop(assigned, final)
        final = composed
    least = final.groupBy("cluster").agg(F.min("vertex").alias("group_id"))
    return hot_split_join(final, least, "cluster", "inner", _hot(final, "cluster", rows)).select(F.col("vertex").alias("id"), "group_id")
