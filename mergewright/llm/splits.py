"""Splits that keep related records together.

Bundles are the connected components over shared ids, whatever the target.

Method: Boruvka contraction. Every component picks its least incident edge under
a total order of hashed weights; the picks form a forest whose only cycles are
mutual picks; pointers are doubled until every vertex points at its root, and
roots become the vertices of the next level. The picked edges are written as a
spanning forest (``Forest.edges``) and the roots of all levels are composed to
one bundle per id, named by its least id.

Dealing: bundles are stratified by category and size band, and within a stratum
put on a line of their sizes in hashed order, by a distributed prefix sum. The
line is cut by the shares, and a bundle goes where its middle lies, whatever its
size. Where few bundles make up a stratum, it can't meet the shares; the band of
the smallest bundles is dealt last, by what each category still wants.

Scale: minima are of plain numbers, combined on the map side by hashing; joins on
a root that holds a large share of vertices are split; no group is ever collected
into one task, the prefix sum included (range partitions and their totals). Only
the targets reach the driver.

Defined results: a null id links nothing; a row without any id is a bundle of
its own with a null bundle_id; a pair of an id with itself is a bundle of that
id; a record delivered again (same pair_id) counts once; a null pair_id is left
out; null or empty categories form one stratum; shares that are null or not
above 0 get no rows, and without any target every split is null; empty tables
give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, hot_split_join
from ..session import Scratch, parallelism
from .components import _hot, links

MAX_LEVELS = 64
#: Doublings of pointers per level; each makes the longest chain four times shorter.
MAX_DOUBLINGS = 40
MAX_SPLITS = 100


@dataclass
class Forest:
    """edges: (level, u, v), a spanning forest of the links; roots: (id, bundle_id)."""

    edges: DataFrame
    roots: DataFrame


def _double(parents: DataFrame, hot: list) -> DataFrame:
    up = parents.select(F.col("vertex").alias("parent"), F.col("parent").alias("grand"))
    return hot_split_join(parents, up, "parent", "inner", hot).select("vertex", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved"))


def spanning_forest(edges: DataFrame, scratch: Scratch) -> Forest:
    """Spanning forest and bundles of distinct links (u < v)."""
    spark = edges.sparkSession
    current = scratch.save(edges.select("u", "v", F.col("u").alias("ou"), F.col("v").alias("ov")), "edges")
    picks, levels = [], []
    for level in range(MAX_LEVELS):
        n = current.count()  # from the footers
        if not n:
            break
        # the ends of an edge see it under one weight; all parts of the least edge are
        # taken by the same comparisons, so they belong together
        way = [F.xxhash64("u", "v", F.lit(level)).alias("w"), "ou", "ov"]
        arcs = current.select(F.inline(F.array(F.struct(F.col("u").alias("vertex"), F.col("v").alias("other"), *way), F.struct(F.col("v").alias("vertex"), F.col("u").alias("other"), *way))))
        best = scratch.save(arcs.groupBy("vertex").agg(*[F.min_by(c, "w").alias(c) for c in ("other", "ou", "ov")]), "picked")
        pointer = best.withColumnRenamed("other", "parent")
        theirs = best.select(F.col("vertex").alias("parent"), F.col("other").alias("back"))
        met = hot_split_join(pointer, theirs, "parent", "inner", _hot(pointer, "parent", 2 * n))
        # two vertices that picked the same edge: the lesser one is the root
        is_root = (F.col("back") == F.col("vertex")) & (F.col("vertex") < F.col("parent"))
        met = scratch.save(met.select("vertex", F.when(is_root, F.col("vertex")).otherwise(F.col("parent")).alias("parent"), "ou", "ov"), "met")
        scratch.drop(best)
        picks.append(met.where("vertex <> parent").select(F.lit(level).alias("level"), F.col("ou").alias("u"), F.col("ov").alias("v")))
        parents = met.select("vertex", "parent")
        for _ in range(MAX_DOUBLINGS):
            hot = _hot(parents, "parent", 2 * n)
            doubled = scratch.save(_double(_double(parents, hot).drop("moved"), hot), "doubled")
            settled = doubled.where("moved").isEmpty()
            if parents is not met:
                scratch.drop(parents)
            parents = doubled
            if settled:
                break
        else:
            raise RuntimeError(f"pointers not settled after {MAX_DOUBLINGS} doublings")
        levels.append(parents)
        a = parents.select(F.col("vertex").alias("u"), F.col("parent").alias("ru"))
        b = parents.select(F.col("vertex").alias("v"), F.col("parent").alias("rv"))
        hot = _hot(current.select(F.explode(F.array("u", "v")).alias("u")), "u", 2 * n)
        both = hot_split_join(hot_split_join(current, a, "u", "inner", hot), b, "v", "inner", hot).where("ru <> rv")
        order = F.xxhash64("ou", "ov")
        merged = both.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min_by("ou", order).alias("ou"), F.min_by("ov", order).alias("ov"))
        nxt = scratch.save(merged, "edges")
        scratch.drop(current)
        current = nxt
    else:
        raise RuntimeError(f"not contracted after {MAX_LEVELS} levels")
    if not levels:
        return Forest(spark.createDataFrame([], "level int, u long, v long"), spark.createDataFrame([], "id long, bundle_id long"))
    final = levels[-1]
    for assigned in reversed(levels[:-1]):
        up = final.select(F.col("vertex").alias("parent"), F.col("parent").alias("top"))
        composed = scratch.save(hot_split_join(assigned, up, "parent", "left").select("vertex", F.coalesce("top", "parent").alias("parent")), "composed")
        scratch.drop(assigned, final)
        final = composed
    least = final.groupBy("parent").agg(F.min("vertex").alias("bundle_id"))
    roots = hot_split_join(final, least, "parent").select(F.col("vertex").alias("id"), "bundle_id")
    forest = picks[0]
    for p in picks[1:]:
        forest = forest.unionByName(p)
    return Forest(forest, scratch.save(roots, "roots"))


def records(matches: DataFrame) -> DataFrame:
    """One row per pair_id: pair_id, id1, id2 and, where there is one, category."""
    if "category" not in matches.columns:
        order = F.xxhash64("id1", "id2")
        return matches.where("pair_id is not null").groupBy("pair_id").agg(F.min_by("id1", order).alias("id1"), F.min_by("id2", order).alias("id2")).withColumn("category", F.lit(None).cast("string"))
    one = F.min(F.struct("id1", "id2", "category")).alias("r")
    return matches.where("pair_id is not null").groupBy("pair_id").agg(one).select("pair_id", "r.*")


def bundles(matches: DataFrame, scratch: Scratch) -> DataFrame:
    """(pair_id, bundle_id, category), one row per record."""
    rows = records(matches)
    roots = spanning_forest(links(matches.where("pair_id is not null"), None), scratch).roots
    keyed = rows.select("pair_id", "category", F.coalesce("id1", "id2").alias("id"))
    joined = hot_split_join(keyed.where("id is not null"), roots, "id", "left", hot_keys(keyed, "id"))
    found = joined.select("pair_id", F.coalesce("bundle_id", "id").alias("bundle_id"), "category")
    alone = keyed.where("id is null").select("pair_id", F.lit(None).cast("long").alias("bundle_id"), "category")
    return found.unionByName(alone)


def _prefix_sums(df: DataFrame, stratum: list[str], order: str, size: str, scratch: Scratch) -> DataFrame:
    """``before``: the sum of the sizes that come earlier in the stratum.

    Rows are range-partitioned by (stratum, order); only the partitions' totals
    per stratum are summed in one place, and their number is that of partitions
    and strata, not of rows.
    """
    n = parallelism(df.sparkSession)
    part = scratch.save(df.repartitionByRange(n, *stratum, order).withColumn("part", F.spark_partition_id()), "ranged")
    totals = part.groupBy(*stratum, "part").agg(F.sum(size).alias("t"))
    earlier = Window.partitionBy(*stratum).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*stratum, "part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("offset"), F.sum("t").over(Window.partitionBy(*stratum)).alias("all"))
    inside = Window.partitionBy(*stratum, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("local", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return local.join(offsets, [*stratum, "part"]).withColumn("before", F.col("local") + F.col("offset")).drop("local", "offset", "part")


def assign(matches: DataFrame, targets: DataFrame, scratch: Scratch, seed: int = 6) -> DataFrame:
    """(pair_id, bundle_id, category, split_name): one split per record."""
    spark = matches.sparkSession
    goal = targets.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.max("target_share").alias("s")).orderBy(F.col("s").desc(), "split_name").limit(MAX_SPLITS + 1).collect()
    if len(goal) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    if not goal:
        return bundles(matches, scratch).withColumn("split_name", F.lit(None).cast("string"))
    whole = sum(r["s"] for r in goal)
    shares = [(r["split_name"], r["s"] / whole) for r in goal]

    rows = bundles(matches, scratch).withColumn("category", F.when(F.trim("category") != "", F.trim("category")))
    # a record without any id is a bundle of its own
    unit = F.coalesce(F.concat(F.lit("i"), F.col("bundle_id").cast("string")), F.concat(F.lit("p"), F.col("pair_id").cast("string")))
    rows = scratch.save(rows.withColumn("unit", unit).withColumn("cat", F.coalesce("category", F.lit(""))), "rows")
    per_cat = scratch.save(rows.groupBy("unit", "cat").agg(F.count(F.lit(1)).alias("n")), "per_cat")
    most = F.max(F.struct("n", "cat"))
    size = per_cat.groupBy("unit").agg(F.sum("n").alias("size"), most.alias("m")).select("unit", "size", F.col("m.cat").alias("cat"))
    band = F.floor(F.log2("size")).cast("int").alias("band")
    order = F.concat(F.hex(F.xxhash64("unit", F.lit(seed))), F.lit("-"), "unit").alias("o")
    size = scratch.save(size.select("unit", "size", "cat", band, order), "units")

    def deal(part: DataFrame, cuts: Column, name: str) -> DataFrame:
        """Where the middle of each bundle lies on its stratum's line of sizes."""
        run = _prefix_sums(part, ["cat", "band"], "o", "size", scratch)
        spot = (F.col("before") + F.col("size") / 2.0) / F.col("all")
        hit = F.filter(cuts, lambda x: (x["lo"] <= F.col("spot")) & (x["hi"] > x["lo"]))
        return scratch.save(run.withColumn("spot", spot).select("unit", F.element_at(hit, -1)["split_name"].alias("split_name")), name)

    at, fixed = 0.0, []
    for s, f in shares:
        fixed.append(F.struct(F.lit(at).alias("lo"), F.lit(at + f).alias("hi"), F.lit(s).alias("split_name")))
        at += f
    first = deal(size.where("band > 0"), F.array(*fixed), "larger")
    # what each category still wants of each split
    got = per_cat.join(first, "unit").groupBy("cat", "split_name").agg(F.sum("n").alias("got"))
    goals = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("split_name"), F.lit(f).alias("share")) for i, (s, f) in enumerate(shares)])
    want = rows.groupBy("cat").agg(F.count(F.lit(1)).alias("n")).select("cat", "n", F.inline(goals)).join(got, ["cat", "split_name"], "left")
    left = F.greatest(F.lit(0.0), F.col("n") * F.col("share") - F.coalesce("got", F.lit(0)))
    lists = want.groupBy("cat").agg(F.array_sort(F.collect_list(F.struct("i", "split_name", "share", left.alias("left")))).alias("g"))  # MAX_SPLITS each
    total = F.aggregate("g", F.lit(0.0), lambda acc, x: acc + x["left"])
    sure = F.transform("g", lambda x: F.struct(x["split_name"].alias("split_name"), F.when(F.col("total") > 0, x["left"] / F.col("total")).otherwise(x["share"]).alias("part")))

    def cut(x, i):
        lo = F.aggregate(F.slice("sure", F.lit(1), i), F.lit(0.0), lambda acc, y: acc + y["part"])
        return F.struct(lo.alias("lo"), (lo + x["part"]).alias("hi"), x["split_name"].alias("split_name"))

    cuts = lists.withColumn("total", total).select("cat", sure.alias("sure")).select("cat", F.transform("sure", cut).alias("cuts"))
    smallest = hot_split_join(size.where("band = 0"), scratch.save(cuts, "cuts"), "cat")
    dealt = first.unionByName(deal(smallest, F.col("cuts"), "smallest"))
    return hot_split_join(rows, dealt, "unit", "inner").select("pair_id", "bundle_id", "category", "split_name")


def report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows and shares per split, overall (null category key 'all') and per category."""
    n = assigned.groupBy(F.coalesce("category", F.lit("")).alias("category"), "split_name").agg(F.count(F.lit(1)).alias("n_rows"))
    both = n.unionByName(n.groupBy("split_name").agg(F.sum("n_rows").alias("n_rows")).withColumn("category", F.lit("all")))
    share = F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("category"))
    goal = targets.select("split_name", F.col("target_share").alias("target_share")).dropDuplicates(["split_name"])
    return both.withColumn("actual_share", share).join(goal, "split_name", "left").select("category", "split_name", "n_rows", "actual_share", "target_share")
