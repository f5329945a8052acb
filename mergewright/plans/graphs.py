"""Queries of components, splits and training frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import unit_hash
from ..operators import frames as R
from ..operators import graph as G
from ..operators import sampling as P
from ..operators import soup as M
from ..operators.joins import oversampled
from ..operators.metrics import argmax
from .fixtures import ANCHOR, FAST_VAL, HARD, OVERSAMPLED, POOL, PROBLEM, hash_sql, pairs, pairs_sql, scored, scored_sql, unit_sql
from .registry import query

LINKS_SQL = f"(select id1, id2 from ({pairs_sql('matches_llm')}) where target >= 0.8)"
COMPONENTS_SQL = f"""with recursive e as (select id1 as a, id2 as b from {LINKS_SQL} union select id2, id1 from {LINKS_SQL}),
 r(id, label) using key (id) as (select id, min(label) from (select a as id, least(a, b) as label from e) group by id
   union select e.b, min(r.label) from r join e on e.a = r.id join recurring.r c on c.id = e.b where r.label < c.label group by e.b)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d, "matches_llm").where("target >= 0.8").select("id1", "id2")


@query("components", COMPONENTS_SQL + " select id, label as component from r")
def components(spark: SparkSession, d: str) -> DataFrame:
    """G1: components over confident positive pairs."""
    return G.components(_links(spark, d))


@query("holdout_components", COMPONENTS_SQL + f" select distinct label as component from r where {unit_sql(repr('13'), 'label')} < 0.03")
def holdout_components(spark: SparkSession, d: str) -> DataFrame:
    """G2."""
    c = G.components(_links(spark, d)).select("component").distinct()
    return c.where(G.held_out(F.col("component"), 0.03, 13))


ROWS_SQL = f"(select p.*, r.label as component from ({pairs_sql('matches_llm')}) p join r on r.id = p.id1)"


@query(
    "component_split",
    COMPONENTS_SQL
    + f""", c as (select component, min(category) as category from {ROWS_SQL} group by component),
  k as (select *, count(*) over (partition by category) as n, row_number() over (partition by category order by {hash_sql(repr('21'), 'component')}, component) as i from c)
  select component, category, case when n < 3 then 'train' when i <= greatest(1, round_even(n * 0.1, 0)) then 'tune' when i <= greatest(1, round_even(n * 0.1, 0)) * 2 then 'eval' else 'train' end as split from k""",
)
def component_split(spark: SparkSession, d: str) -> DataFrame:
    """Whole components per category and split."""
    rows = G.with_component(pairs(spark, d, "matches_llm"), G.components(_links(spark, d)))
    return G.split_components(rows, "category", 0.1, 0.1, 21)


@query("split_is_disjoint", "select 0::bigint as n_shared")
def split_is_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """No component is in two splits of the pairs."""
    rows = G.with_component(pairs(spark, d, "matches_llm"), G.components(_links(spark, d)))
    labelled = rows.drop("category").join(G.split_components(rows, "category", 0.1, 0.1, 21), "component")
    two = labelled.groupBy("component").agg(F.countDistinct("split").alias("k")).where("k > 1")
    return two.agg(F.count(F.lit(1)).alias("n_shared"))


@query(
    "complement_pairs",
    COMPONENTS_SQL
    + f""", m as (select *, {unit_sql(repr('13'), 'component')} < 0.3 as held from {ROWS_SQL})
  select case when not held then 'train' when target > 0.2 and target < 0.8 then 'grey' else 'confident' end as part, count(*) as n from m group by 1""",
)
def complement_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs and the two parts of what is held out."""
    rows = G.with_component(pairs(spark, d, "matches_llm"), G.components(_links(spark, d)))
    part = F.when(~G.held_out(F.col("component"), 0.3, 13), "train").when(P.grey(F.col("target")), "grey").otherwise("confident")
    return rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def _teacher(df: DataFrame) -> DataFrame:
    return df.withColumn("teacher", unit_hash("t", F.col("pair_id")))


def training_frame(spark: SparkSession, d: str, pool_cap: int = POOL, hard: int = HARD, anchor: int = ANCHOR) -> DataFrame:
    """People's pairs with one category twice, replay and grey pairs, by the stored
    split. It isn't R6: no components are held out, so splits may share items."""
    human = _teacher(oversampled(pairs(spark, d).where("split_name = 'train'"), F.col("category") == OVERSAMPLED))
    llm = _teacher(pairs(spark, d, "matches_llm").where("split_name = 'train'"))
    pool = P.sample_per_group(llm.where(P.confident(F.col("target"))), ["category"], pool_cap, 31, "pair_id")
    pool = pool.withColumn("err", F.abs(F.col("teacher") - F.col("target")))
    replay = P.hard_and_anchor(pool.drop("source"), ["category"], "err", hard, anchor, 32, ["id1", "id2"], "pair_id")
    grey = llm.where(P.grey(F.col("target")))
    return R.train_frame(R.human_rows(human), R.replay_rows(replay), R.grey_rows(grey))


_LLM = f"(select *, {unit_sql(repr('t'), 'pair_id')} as teacher from ({pairs_sql('matches_llm')}) where split_name = 'train')"
_HUMAN = f"(select *, {unit_sql(repr('t'), 'pair_id')} as teacher from ({pairs_sql()}) where split_name = 'train')"


def _frame_sql(pool_cap: int, hard: int, anchor: int) -> str:
    return f"""with human as (select * from {_HUMAN} union all select * from {_HUMAN} where category = '{OVERSAMPLED}'), llm as {_LLM},
  pool as (select *, abs(teacher - target) as err from (select *, row_number() over (partition by category order by {hash_sql(repr('31'), 'pair_id')}, pair_id) as n from llm where target <= 0.2 or target >= 0.8) where n <= {pool_cap}),
  hard as (select * from (select * exclude (n), row_number() over (partition by category order by err desc, pair_id) as n from pool) where n <= {hard}),
  rest as (select * exclude (n) from pool p where not exists (select 1 from hard h where h.category = p.category and h.id1 = p.id1 and h.id2 = p.id2)),
  anchor as (select * from (select *, row_number() over (partition by category order by {hash_sql(repr('32'), 'pair_id')}, pair_id) as n from rest) where n <= {anchor}),
  f as (select 'human' as source, category, target, greatest(0.001::double, least(0.999::double, teacher)) as tp, 3.5 + 2.0 * abs(greatest(0.001::double, least(0.999::double, teacher)) - target) as lw, 0.02::double as dw, 0.0::double as gd from human
   union all select 'llm_hard', category, target, greatest(0.001::double, least(0.999::double, teacher)), 1.5, 0.08, 0.0 from hard
   union all select 'llm_anchor', category, target, greatest(0.001::double, least(0.999::double, teacher)), 0.8, 1.0, 0.0 from anchor
   union all select 'gray', category, target, greatest(0.001::double, least(0.999::double, teacher)), 0.25, 0.05, 1.0 from llm where target > 0.2 and target < 0.8)
  select source, category, count(*) as n, round(avg(lw), 4) as label_weight, round(avg(tp), 4) as teacher_prob, round(avg(dw), 4) as distill_weight, round(avg(gd), 4) as gray_distill_weight from f group by source, category"""


def _summed(f: DataFrame) -> DataFrame:
    return f.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in ("label_weight", "teacher_prob", "distill_weight", "gray_distill_weight")])


@query("train_frame", _frame_sql(POOL, HARD, ANCHOR))
def train_frame(spark: SparkSession, d: str) -> DataFrame:
    """R1 to R4, U4 at the limits of the recipe."""
    return _summed(training_frame(spark, d))


@query("train_frame_rows")
def train_frame_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the training frame."""
    return training_frame(spark, d)


def _stage_sql(fast: int) -> str:
    return COMPONENTS_SQL + f""", m as (select *, {unit_sql(repr('13'), 'component')} < 0.3 as held from {ROWS_SQL}),
 v as (select *, row_number() over (partition by category order by {hash_sql(repr('0'), 'pair_id')}, pair_id) as n from m where held and (target <= 0.2 or target >= 0.8))
 select 'train' as part, count(*) as n from m where not held union all select 'holdout', count(*) from v union all select 'fast_val', count(*) from v where n <= {fast}"""


def _stages(spark: SparkSession, d: str, fast: int) -> DataFrame:
    rows = G.with_component(pairs(spark, d, "matches_llm"), G.components(_links(spark, d)))
    held = G.held_out(F.col("component"), 0.3, 13)
    hold = rows.where(held & P.confident(F.col("target")))
    parts = [(rows.where(~held), "train"), (hold, "holdout"), (P.sample_per_group(hold, ["category"], fast, 0, "pair_id"), "fast_val")]
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for df, n in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("stage_frames", _stage_sql(FAST_VAL))
def stage_frames(spark: SparkSession, d: str) -> DataFrame:
    """R5 with the reference's limit of the validation frame."""
    return _stages(spark, d, FAST_VAL)


@query("eval_frames", f"select split_name, category, count(*) as n, count(*) filter (target > 0.2 and target < 0.8) as n_grey from ({pairs_sql()}) where split_name in ('tune', 'eval') group by split_name, category")
def eval_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames for selection, by category."""
    return pairs(spark, d).where(F.col("split_name").isin("tune", "eval")).groupBy("split_name", "category").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(P.grey(F.col("target")), 1)).alias("n_grey"))


@query("soup_blend", "select 'bias' as param, 0 as i, 0.15 * 1.0 + 0.85 * 3.0 as value union all select 'emb', 0, 5.0 union all select 'w', 0, 0.15 * 1.0 + 0.85 * 2.0 union all select 'w', 1, 0.15 * -2.0 + 0.85 * 4.0".replace("0.15", "0.15::double").replace("5.0", "5.0::double"))
def soup_blend(spark: SparkSession, d: str) -> DataFrame:
    """Two small parameter tables."""
    shape = "param string, shape array<int>, values array<double>"
    a = spark.createDataFrame([("w", [2], [1.0, -2.0]), ("bias", [1], [1.0]), ("emb", [1], [5.0])], shape)
    b = spark.createDataFrame([("w", [2], [2.0, 4.0]), ("bias", [1], [3.0]), ("emb", [1], [9.0])], shape)
    return M.soup(a, b, 0.15, keep_a="^emb").select("param", F.posexplode("values").alias("i", "value"))


@query("weight_ema", "with x as (select * from (values (1, 1.0::double), (2, 2.0::double), (3, 4.0::double)) t(step, value)) select 'w' as param, (1.0::double * 0.9 + 2.0 * (1.0 - 0.9::double)) * 0.9 + 4.0 * (1.0 - 0.9::double) as ema".replace("as ema", "as raw").replace("with x", "with x").replace("select 'w' as param, ", "select 'w' as param, round(").replace(" as raw", ", 9) as ema"))
def weight_ema(spark: SparkSession, d: str) -> DataFrame:
    """M4."""
    s = spark.createDataFrame([("w", 1, 1.0), ("w", 2, 2.0), ("w", 3, 4.0)], "param string, step int, value double")
    return M.moving_average(s, 0.9).select("param", F.round("ema", 9).alias("ema"))


@query("checkpoint_sweep")
def checkpoint_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a grid of blends of two scorers, and the best first."""
    from ..operators.metrics import average_precision, composite, macro_ap

    grid = [0.05, 0.1, 0.15, 0.17, 0.2]
    x = scored(spark, d).where(F.col("split_name").isin("tune", "eval"))
    each = x.select("category", "split_name", "y", "p", "q", F.posexplode(F.array(*[F.lit(a) for a in grid])).alias("position", "alpha"))
    each = each.withColumn("s", F.floor((F.col("p") * F.col("alpha") + F.col("q") * (1 - F.col("alpha"))) * 1e6))
    per = average_precision(each, ["position", "alpha", "split_name", "category"], "s", "y")
    tune = macro_ap(per.where("split_name = 'tune'"), ["position", "alpha"]).withColumnRenamed("macro_ap", "tune_macro")
    problem = macro_ap(per.where(F.col("category").isin(*PROBLEM) & (F.col("split_name") == "tune")), ["position", "alpha"]).withColumnRenamed("macro_ap", "problem_ap")
    grey = macro_ap(per.where("split_name = 'eval'"), ["position", "alpha"]).withColumnRenamed("macro_ap", "gray_full")
    rows = tune.join(problem, ["position", "alpha"]).join(grey, ["position", "alpha"])
    rows = rows.withColumn("composite_score", composite(F.col("problem_ap"), F.col("gray_full"), F.col("tune_macro"), (0.5, 0.3, 0.2)))
    best = argmax(rows, "composite_score", "position").select("position", F.lit(True).alias("selected"))
    return rows.join(F.broadcast(best), "position", "left").select("position", "alpha", *[F.round(c, 4).alias(c) for c in ("tune_macro", "problem_ap", "gray_full", "composite_score")], F.coalesce("selected", F.lit(False)).alias("selected"))


@query("scored_agreement", f"select category, count(*) as n, round(avg(p), 5) as mean_p, round(avg(q), 5) as mean_q from ({scored_sql('matches_llm')}) group by category")
def scored_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two scorers in one plan."""
    return scored(spark, d, "matches_llm").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 5).alias("mean_p"), F.round(F.avg("q"), 5).alias("mean_q"))
