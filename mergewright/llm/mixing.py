"""Mixing sources to target weights.

The total is the largest one that every source can fill: the least of
size x max_repeats / share, unless a smaller total is asked for. A source's
budget is its share of the total. Its documents are repeated a whole number of
times, and those below a threshold of their hash once more.

Method: tokens are summed by source and hash bucket; the bucket in which the
budget is crossed is the only one refined, with the next bits of the hash, until
nothing is left to refine. The thresholds of growing budgets are nested, and the
documents are chosen by a filter, never by a sort.

Scale: one pass per 12 bits over (source, hash, size); a pass sends one row per
source to the driver. Sources are bounded by the table of targets, checked by
``MAX_SOURCES``.

Defined results: documents of a source without a target (or a null source) are
left out; a null or empty text has size 0 and is chosen like any other document
but adds nothing; rows with the same doc_id share a hash and are chosen
together; a source without tokens is left out of the total and reported with an
actual share of 0; targets that are null or not above 0, or without repeats,
contribute nothing; shares are normalised to a sum of 1. Empty tables give empty
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import tokens

MAX_SOURCES = 10_000
BITS, STEP = 60, 12


def _plan(totals: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None) -> dict[str, tuple[int, float]]:
    """Whole repeats and the remaining budget in tokens of each source."""
    live = {s: t for s, t in targets.items() if totals.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    shares = sum(share for share, _ in live.values())
    most = min((totals[s] * most / (share / shares) for s, (share, most) in live.items()), default=0.0)
    size = min(most, total) if total is not None else most
    out = {}
    for s, (share, most) in live.items():
        budget = size * share / shares
        whole = min(most, int(budget / totals[s] + 1e-12))
        out[s] = (whole, 0.0 if whole >= most else max(0.0, budget - whole * totals[s]))
    return out


def thresholds(sized: DataFrame, rest: dict[str, float]) -> dict[str, int]:
    """Hash threshold per source below which the sizes add up to the rest, or
    as near to it as whole documents allow.

    The running sums over a source's buckets are taken in Spark, at most 4096 to a
    source; one row per source reaches the driver: the bucket that crosses.
    """
    out: dict[str, int] = {s: 0 for s, r in rest.items() if r <= 0}
    open_: dict[str, tuple[int, float]] = {s: (0, r) for s, r in rest.items() if r > 0}  # prefix so far, what is left
    spark = sized.sparkSession
    along = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    for depth in range(BITS // STEP):
        if not open_:
            break
        low = BITS - STEP * (depth + 1)
        # the boundary buckets only: one prefix per source
        edge = F.broadcast(spark.createDataFrame([(s, p, x) for s, (p, x) in open_.items()], "source string, p long, rest double"))
        inside = sized.join(edge, "source").where(F.shiftright("h", low + STEP) == F.col("p")).select("source", "rest", F.shiftright("h", low).alias("b"), "n_tokens")
        sums = inside.groupBy("source", "rest", "b").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        crossing = sums.where(F.col("before") + F.col("n") > F.col("rest")).groupBy("source").agg(F.min(F.struct("b", "before", "n")).alias("c")).collect()
        nxt = {r["source"]: (r["c"]["b"], open_[r["source"]][1] - r["c"]["before"], r["c"]["n"]) for r in crossing}
        for s, (p, _) in open_.items():
            if s not in nxt:
                out[s] = ((p + 1) << STEP) << low
            elif depth == BITS // STEP - 1:  # one hash left: take it if that is nearer
                b, left, n = nxt[s]
                out[s] = b + (n - left < left)
        open_ = {s: (b, left) for s, (b, left, _) in nxt.items()}
    return out


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 9, folder: str = tokens.TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(chosen documents with repeats, report per source)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "p9")
    named = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    rows = named.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = {r["source"]: (float(r["share"]), int(r["most"])) for r in rows}
    wanted = docs.select("doc_id", "source", "text").where(F.col("source").isin(list(goal)))
    h = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 64 - BITS).alias("h")
    sized = scratch.save(tokens.sizes(wanted, ["doc_id", "source"], folder=folder).select("doc_id", "source", "n_tokens", h), "sizes")
    totals = {r["source"]: int(r["n"] or 0) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = _plan(totals, goal, total)
    below = thresholds(sized, {s: rest for s, (_, rest) in plan.items()})
    steps = spark.createDataFrame([(s, w, below[s]) for s, (w, _) in plan.items()], "source string, whole int, below long")
    picked = sized.join(F.broadcast(steps), "source").withColumn("repeats", F.col("whole") + (F.col("h") < F.col("below")).cast("int"))
    chosen = picked.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    all_tokens = sum(share for share, _ in goal.values()) or 1.0
    report = named.join(used, "source", "left").na.fill(0, ["n_docs", "n_tokens", "most_repeats"])
    grand = used.agg(F.sum("n_tokens").alias("grand"))
    report = report.crossJoin(F.broadcast(grand)).select(  # one row: the grand total
        "source", (F.col("share") / F.lit(all_tokens)).alias("target_share"), F.when(F.col("grand") > 0, F.col("n_tokens") / F.col("grand")).otherwise(F.lit(0.0)).alias("actual_share"), "n_docs", "n_tokens", "most_repeats",
    )
    return chosen, report
