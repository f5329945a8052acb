"""Queries of the ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import soft_distillation, symmetric
from ..functions import scores
from ..operators import metrics as M
from ..operators import sampling as P
from .fixtures import PROBLEM, PROBLEM_SQL, hash_sql, scored, scored_sql
from .registry import query

S = scored_sql()
AP_SQL = """t as (select {by}, {score} as score, sum(y) as pos, count(*) as n from x group by {by}, {score}),
 u as (select {by}, pos, n, sum(pos) over (partition by {by} order by score desc rows between unbounded preceding and current row) as cp,
   sum(n) over (partition by {by} order by score desc rows between unbounded preceding and current row) as cn, sum(pos) over (partition by {by}) as tp from t),
 ap as (select {by}, sum(n)::bigint as n, sum(pos)::bigint as n_pos,
   case when sum(pos) > 0 and sum(pos) < sum(n) then sum(pos::double / tp * (cp::double / cn)) end as ap from u group by {by})"""


def ap_sql(by: str = "category", score: str = "p") -> str:
    return AP_SQL.format(by=by, score=score)


@query("per_category_report", f"with x as ({S}), {ap_sql()} select category, n, round(n_pos::double / n, 6) as pos_rate, round(ap, 6) as ap from ap")
def per_category_report(spark: SparkSession, d: str) -> DataFrame:
    """A4 (with A1, K3): report per category."""
    return M.category_report(scored(spark, d), "category", "p", "y").select("category", "n", F.round("pos_rate", 6).alias("pos_rate"), F.round("ap", 6).alias("ap"))


@query("macro_ap_by_category", f"with x as ({S}), {ap_sql()} select round(coalesce(avg(ap), 0.0), 6) as macro_ap from ap")
def macro_ap_by_category(spark: SparkSession, d: str) -> DataFrame:
    """A2: guarded macro average precision."""
    return M.macro_ap(M.average_precision(scored(spark, d), ["category"], "p", "y")).select(F.round("macro_ap", 6).alias("macro_ap"))


@query("macro_ap_unguarded", f"with x as ({S}), {ap_sql('seller')} select round(avg(coalesce(ap, case when n_pos > 0 then 1.0 else 0.0 end)), 6) as macro_ap from ap".replace(f"x as ({S})", f"x as (select *, id1 % 50 as seller from ({S}))"))
def macro_ap_unguarded(spark: SparkSession, d: str) -> DataFrame:
    """A3: macro average precision that counts groups of a single class."""
    x = scored(spark, d).withColumn("seller", F.col("id1") % 50)
    return M.macro_ap(M.average_precision(x, ["seller"], "p", "y"), guarded=False).select(F.round("macro_ap", 6).alias("macro_ap"))


@query("macro_ap_by_split", f"with x as ({S}), {ap_sql('split_name, category')} select split_name, round(coalesce(avg(ap), 0.0), 6) as macro_ap from ap group by split_name")
def macro_ap_by_split(spark: SparkSession, d: str) -> DataFrame:
    """A2 per split."""
    per = M.average_precision(scored(spark, d), ["split_name", "category"], "p", "y")
    return M.macro_ap(per, ["split_name"]).select("split_name", F.round("macro_ap", 6).alias("macro_ap"))


@query(
    "composite_score",
    f"""with x as ({S}), {ap_sql('split_name, category')},
    v as (select coalesce(avg(ap) filter (split_name = 'tune'), 0.0) as tune, coalesce(avg(ap) filter (split_name = 'tune' and category in ({PROBLEM_SQL})), 0.0) as problem,
      coalesce(avg(ap) filter (split_name = 'eval'), 0.0) as grey from ap)
    select round(tune, 6) as tune_macro, round(problem, 6) as problem_ap, round(grey, 6) as grey_ap, round(problem * 0.5 + grey * 0.3 + tune * 0.2, 6) as blend_score,
      round(problem * 0.35 + grey * 0.45 + tune * 0.2, 6) as sweep_score from v""",
)
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    """A5 with both sets of weights, and A10: filtered macro averages."""
    per = M.average_precision(scored(spark, d), ["split_name", "category"], "p", "y")

    def part(condition):
        return F.coalesce(F.avg(F.when(condition, F.col("ap"))), F.lit(0.0))

    tune, evald = F.col("split_name") == "tune", F.col("split_name") == "eval"
    v = per.agg(part(tune).alias("tune"), part(tune & F.col("category").isin(*PROBLEM)).alias("problem"), part(evald).alias("grey"))
    c = [F.col(k) for k in ("problem", "grey", "tune")]
    return v.select(F.round("tune", 6).alias("tune_macro"), F.round("problem", 6).alias("problem_ap"), F.round("grey", 6).alias("grey_ap"), F.round(M.composite(*c, (0.5, 0.3, 0.2)), 6).alias("blend_score"), F.round(M.composite(*c, (0.35, 0.45, 0.2)), 6).alias("sweep_score"))


@query(
    "filtered_macro_ap",
    f"""with x as ({S}), {ap_sql()} select round(avg(ap) filter (category in ({PROBLEM_SQL})), 6) as problem_macro, round(avg(ap) filter (category not in ({PROBLEM_SQL})), 6) as other_macro,
    count(*) filter (category in ({PROBLEM_SQL})) as n_problem, count(*) filter (category not in ({PROBLEM_SQL})) as n_other from ap""",
)
def filtered_macro_ap(spark: SparkSession, d: str) -> DataFrame:
    """A10: macro averages of problem and other categories, null when empty."""
    per = M.average_precision(scored(spark, d), ["category"], "p", "y")
    problem = F.col("category").isin(*PROBLEM)
    return per.agg(F.round(F.avg(F.when(problem, F.col("ap"))), 6).alias("problem_macro"), F.round(F.avg(F.when(~problem, F.col("ap"))), 6).alias("other_macro"), F.count(F.when(problem, 1)).alias("n_problem"), F.count(F.when(~problem, 1)).alias("n_other"))


@query("agree_pred_pos", f"with x as ({S}) select source, round(avg(((p >= 0.5) = (y >= 0.5))::int::double), 6) as agree, round(avg((p >= 0.5)::int::double), 6) as pred_pos, count(*) as n from x group by source")
def agree_pred_pos(spark: SparkSession, d: str) -> DataFrame:
    """A6."""
    return M.agreement(scored(spark, d), ["source"], "p", "y").select("source", F.round("agree", 6).alias("agree"), F.round("pred_pos", 6).alias("pred_pos"), "n")


@query("source_counts", f"with x as ({S}) select source, split_name, count(*) as n, count(distinct category) as n_categories, min(y) <> max(y) as both_classes, round(avg(target), 6) as mean_target, round(avg(y::double), 6) as pos_rate from x group by source, split_name")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts, distinct counts and means per source and split."""
    return scored(spark, d).groupBy("source", "split_name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("n_categories"), (F.min("y") != F.max("y")).alias("both_classes"), F.round(F.avg("target"), 6).alias("mean_target"), F.round(F.avg(F.col("y").cast("double")), 6).alias("pos_rate"),
    )


@query("weighted_mean", f"with x as ({S}) select category, round(sum(p * (0.75::double + 0.25::double * abs(2 * target - 1))) / greatest(sum(0.75::double + 0.25::double * abs(2 * target - 1)), 1e-6), 6) as wmean from x group by category")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    """A11 with the linear confidence weight of F11."""
    w = F.lit(0.75) + F.lit(0.25) * F.abs(2 * F.col("target") - 1)
    return scored(spark, d).groupBy("category").agg(F.round(M.weighted_mean(F.col("p"), w), 6).alias("wmean"))


@query(
    "pct_rank_avg",
    f"""with x as ({S}) select pair_id, category, round((rank() over (partition by category order by p) + (count(*) over (partition by category, p) - 1) / 2.0) / count(*) over (partition by category), 6) as rp from x""",
)
def pct_rank_avg(spark: SparkSession, d: str) -> DataFrame:
    """Percentile ranks with averaged ties."""
    return M.distributed_percentile_rank(scored(spark, d).select("pair_id", "category", "p"), ["category"], "p", "rp").select("pair_id", "category", F.round("rp", 6).alias("rp"))


RANKS_SQL = """r as (select *, (rank() over (partition by category order by p) + (count(*) over (partition by category, p) - 1) / 2.0) / count(*) over (partition by category) as r1,
  (rank() over (partition by category order by q) + (count(*) over (partition by category, q) - 1) / 2.0) / count(*) over (partition by category) as r2 from x)"""


@query("rank_blend", f"with x as ({S}), {RANKS_SQL} select pair_id, round(r1 * 0.7 + r2 * 0.3, 5) as blend from r")
def rank_blend(spark: SparkSession, d: str) -> DataFrame:
    """W2."""
    return M.rank_blend(scored(spark, d), ["category"], "p", "q", 0.7).select("pair_id", F.round("blend", 5).alias("blend"))


GRID = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return M.blend_grid(scored(spark, d).where("split_name = 'tune'"), "category", "p", "q", "y", GRID)


@query("blend_weight_grid")
def blend_weight_grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid of blend weights with its macro AP."""
    return _grid(spark, d).select("weight", F.round("macro_ap", 4).alias("macro_ap"))


@query("blend_weight_best")
def blend_weight_best(spark: SparkSession, d: str) -> DataFrame:
    """The best weight, the first of equals."""
    return M.argmax(_grid(spark, d), "macro_ap", "position").select("weight", F.round("macro_ap", 4).alias("macro_ap"))


_METRIC_ROWS = "(0, 0.05, 0.6312, 0.7981, 0.5531, 0.6458), (1, 0.10, 0.6331, 0.7990, 0.5547, 0.6444), (2, 0.15, 0.6333, 0.7987, 0.5478, 0.6458), (3, 0.17, 0.6346, 0.7988, 0.5554, 0.6437), (4, 0.20, 0.6289, 0.7912, 0.5601, 0.6399)"
_METRIC_COLUMNS = "position, alpha, problem_ap, tune_macro, gray_full, composite_score"


def _metric_grid(spark: SparkSession) -> DataFrame:
    cast = ", ".join("cast(position as int) position" if c == "position" else f"cast({c} as double) {c}" for c in _METRIC_COLUMNS.split(", "))
    return spark.sql(f"select {cast} from values {_METRIC_ROWS} as t({_METRIC_COLUMNS})")


@query("argmax_first", f"select position, alpha::double as alpha from (values {_METRIC_ROWS}) as t({_METRIC_COLUMNS}) order by composite_score desc, position limit 1")
def argmax_first(spark: SparkSession, d: str) -> DataFrame:
    """The first of the greatest."""
    return M.argmax(_metric_grid(spark), "composite_score", "position").select("position", "alpha")


@query("argmax_constrained", f"select position, alpha::double as alpha, gray_full::double as gray_full from (values {_METRIC_ROWS}) as t({_METRIC_COLUMNS}) where problem_ap >= 0.632 order by gray_full desc, position limit 1")
def argmax_constrained(spark: SparkSession, d: str) -> DataFrame:
    """A14, F19."""
    return M.argmax_where(_metric_grid(spark), "gray_full", "position", F.col("problem_ap") >= 0.632).select("position", "alpha", "gray_full")


@query("argmax_fallback", f"select position, alpha::double as alpha from (values {_METRIC_ROWS}) as t({_METRIC_COLUMNS}) order by gray_full desc, position limit 1")
def argmax_fallback(spark: SparkSession, d: str) -> DataFrame:
    """nothing meets the condition, so all rows count."""
    return M.argmax_where(_metric_grid(spark), "gray_full", "position", F.col("problem_ap") >= 0.99).select("position", "alpha")


@query("metric_table", f"select position, metric, round(value, 3) as value from (select position, unnest(['gray_full', 'problem_ap', 'tune_macro']) as metric, unnest([gray_full::double, problem_ap::double, tune_macro::double]) as value from (values {_METRIC_ROWS}) as t({_METRIC_COLUMNS}))")
def metric_table(spark: SparkSession, d: str) -> DataFrame:
    """Metrics as rows, rounded."""
    long = _metric_grid(spark).unpivot("position", ["gray_full", "problem_ap", "tune_macro"], "metric", "value")
    return long.select("position", "metric", F.round("value", 3).alias("value"))


LOGIT_SQL = "ln(greatest(1e-4, least(1 - 1e-4, {p})) / (1 - greatest(1e-4, least(1 - 1e-4, {p}))))"


@query(
    "losses_bce",
    f"""with x as ({S}), l as (select *, {LOGIT_SQL.format(p='p')} as xl, {LOGIT_SQL.format(p='q')} as xr from x)
    select category, round(avg(greatest(xl, 0) - xl * y + ln(1 + exp(-abs(xl)))), 5) as bce,
      round(avg((greatest(xl / 1.5, 0) - (xl / 1.5) * (1 / (1 + exp(-xr / 1.5))) + ln(1 + exp(-abs(xl / 1.5)))) * 2.25), 5) as distill,
      round(avg((xl - xr) * (xl - xr)), 5) as symmetry, round(avg((p + q) * 0.5), 6) as symmetric_score from l group by category""",
)
def losses_bce(spark: SparkSession, d: str) -> DataFrame:
    """Losses over stored scores per category."""
    x = scored(spark, d).select("category", "y", "p", "q", scores.logit(F.col("p")).alias("xl"), scores.logit(F.col("q")).alias("xr"))
    return x.groupBy("category").agg(
        F.round(F.avg(scores.bce_with_logits(F.col("xl"), F.col("y"))), 5).alias("bce"),
        F.round(F.avg(soft_distillation(F.col("xl"), F.col("q"), 1.5)), 5).alias("distill"),
        F.round(F.avg(F.pow(F.col("xl") - F.col("xr"), 2)), 5).alias("symmetry"),
        F.round(F.avg(symmetric(F.col("p"), F.col("q"))), 6).alias("symmetric_score"),
    )


def rank_loss(df: DataFrame, by: list[str], score: str, label: str, margin: float = 0.1, temperature: float = 0.2) -> DataFrame:
    """Mean soft hinge over all positive and negative rows of a group.

    Pairs are counted per distinct score, so a group costs the product of its
    distinct scores, not of its rows.
    """
    per = df.groupBy(*by, score, (F.col(label) > 0.5).alias("pos")).agg(F.count(F.lit(1)).alias("c"))
    pos = per.where("pos").select(*by, F.col(score).alias("sp"), F.col("c").alias("cp"))
    neg = per.where("not pos").select(*by, F.col(score).alias("sn"), F.col("c").alias("cn"))
    w = F.col("cp") * F.col("cn")
    loss = F.sum(scores.ranking_hinge(F.col("sp"), F.col("sn"), margin, temperature) * w) / F.sum(w)
    return pos.join(neg, by).groupBy(*by).agg(loss.alias("rank_loss"), F.sum(w).alias("n_pairs"))


#: Rows of a batch within which positive and negative rows of a category meet.
BATCH = 128


def batched_rank_loss(df: DataFrame, category: str, score: str, label: str, seed: int = 6) -> DataFrame:
    """The loss over the pairs within a batch and category, per category.
    Batches are dealt from a keyed order, so a group holds at most ``BATCH`` rows."""
    dealt = P.batches(df, P.keyed_order(seed, "pair_id"), BATCH, drop_last=False)
    per = rank_loss(dealt, ["batch", category], score, label)
    total = F.sum("n_pairs")
    return per.groupBy(category).agg((F.sum(F.col("rank_loss") * F.col("n_pairs")) / total).alias("rank_loss"), total.alias("n_pairs"))


@query(
    "losses_rank",
    f"""with x as (select *, (row_number() over (order by {hash_sql(repr('6'), 'pair_id')}, pair_id) - 1) // {BATCH} as batch from ({S})),
    j as (select a.category, (0.1 - (a.p - b.p)) / 0.2 as z from x a join x b on a.batch = b.batch and a.category = b.category and a.y = 1 and b.y = 0)
    select category, round(sum((greatest(z, 0) + ln(1 + exp(-abs(z)))) * 0.2) / count(*), 5) as rank_loss, count(*) as n_pairs from j group by category""",
)
def losses_rank(spark: SparkSession, d: str) -> DataFrame:
    """J10, X19."""
    return batched_rank_loss(scored(spark, d), "category", "p", "y").select("category", F.round("rank_loss", 5).alias("rank_loss"), F.col("n_pairs").cast("long").alias("n_pairs"))


@query(
    "combined_loss",
)
def combined_loss(spark: SparkSession, d: str) -> DataFrame:
    """M5: the five terms and their weighted sum over batches of stored scores."""
    x = scored(spark, d).select("pair_id", "category", "y", "target", "p", "q", scores.logit(F.col("p")).alias("xl"), scores.logit(F.col("q")).alias("xr"))
    lw = F.lit(3.5) + F.lit(2.0) * F.abs(F.col("q") - F.col("target"))
    flat = x.agg(
        M.weighted_mean(scores.bce_with_logits(F.col("xl"), F.col("y")), lw).alias("sup"),
        M.weighted_mean(soft_distillation(F.col("xl"), F.col("q"), 1.5), F.lit(0.02)).alias("distill"),
        M.weighted_mean(soft_distillation(F.col("xl"), F.col("q"), 1.5), F.when(F.col("target").between(0.2001, 0.7999), 1.0).otherwise(0.0)).alias("grey_distill"),
        F.avg(F.pow(F.col("xl") - F.col("xr"), 2)).alias("symmetry"),
    )
    rank = batched_rank_loss(x, "category", "xl", "y").agg(F.coalesce(F.avg("rank_loss"), F.lit(0.0)).alias("rank"))
    both = flat.crossJoin(F.broadcast(rank))  # one row each
    total = F.col("sup") * 0.45 + F.col("distill") * 0.18 + F.col("grey_distill") * 0.40 + F.col("rank") * 0.20 + F.col("symmetry") * 0.10
    return both.select(*[F.round(c, 4).alias(c) for c in ("sup", "distill", "grey_distill", "rank", "symmetry")], F.round(total, 4).alias("total"))
