"""Queries of filters, joins, set operations, windows and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import clip
from ..operators import joins as J
from ..operators import sampling as P
from ..operators.metrics import observed
from ..sources.tables import current_rows, table
from .fixtures import ANCHOR, FAST_VAL, GREY_OTHER, GREY_PROBLEM, HARD, OVERSAMPLED, POOL, PROBLEM, PROBLEM_SQL, hash_sql, named_category, pairs, pairs_sql, scored, scored_sql, unit_sql
from .registry import query

X, S = pairs_sql(), scored_sql()
CATEGORY_SQL = "case when trim(category) <> '' then trim(category) else 'unknown' end"
#: Current rows of items by the greatest stamp, then load.
CURRENT_SQL = "(select * from items where id is not null qualify row_number() over (partition by id order by updated_at desc nulls last, loaded_at desc nulls last, name, attributes) = 1)"
HUMAN_SQL = "(select id, min(struct_pack(name := coalesce(name, ''), attributes := coalesce(attributes, ''), category := category)) as r from items_human where id is not null group by id)"


def current(spark: SparkSession, d: str) -> DataFrame:
    """Current items: id, name, category."""
    return current_rows(table(spark, d, "items", "id", "name", "category", "updated_at", "loaded_at"), "name", "category")


def human(spark: SparkSession, d: str) -> DataFrame:
    """Reference cards, the first of an id's wordings."""
    h = table(spark, d, "items_human").where("id is not null")
    return h.groupBy("id").agg(F.min(F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("attributes", F.lit("")).alias("attributes"), "category")).alias("r")).select("id", "r.*")


def texts_of(spark: SparkSession, d: str) -> DataFrame:
    """Names of all current items as texts; a null name is an empty one."""
    return current(spark, d).select("id", F.coalesce("name", F.lit("")).alias("text"))


TEXTS_SQL = f"(select id, coalesce(name, '') as text from {CURRENT_SQL})"


def joined_sql(texts: str) -> str:
    return f"select p.*, coalesce(a.text, '') as text1, coalesce(b.text, '') as text2, a.id is not null as has1, b.id is not null as has2 from ({X}) p left join {texts} a on p.id1 = a.id left join {texts} b on p.id2 = b.id"


JOINED_SQL = joined_sql(TEXTS_SQL)


@query("band_confident", f"select pair_id, target, (target >= 0.5)::int as y from ({X}) where target <= 0.2 or target >= 0.8")
def band_confident(spark: SparkSession, d: str) -> DataFrame:
    """F1, F3, F4."""
    return pairs(spark, d).where(P.confident(F.col("target"))).select("pair_id", "target", P.binary(F.col("target")).cast("int").alias("y"))


@query("band_grey", f"select pair_id, target, (target >= 0.5)::int as y from ({X}) where target > 0.2 and target < 0.8")
def band_grey(spark: SparkSession, d: str) -> DataFrame:
    """F2, F3."""
    return pairs(spark, d).where(P.grey(F.col("target"))).select("pair_id", "target", P.binary(F.col("target")).cast("int").alias("y"))


@query("band_counts", f"select category, count(*) filter (target <= 0.2 or target >= 0.8) as n_confident, count(*) filter (target > 0.2 and target < 0.8) as n_grey, count(*) as n from ({X}) group by category")
def band_counts(spark: SparkSession, d: str) -> DataFrame:
    """F1, F2, A7 in one pass."""
    t = F.col("target")
    return pairs(spark, d).groupBy("category").agg(F.count(F.when(P.confident(t), 1)).alias("n_confident"), F.count(F.when(P.grey(t), 1)).alias("n_grey"), F.count(F.lit(1)).alias("n"))


@query(
    "filter_projection",
    f"""select pair_id as record, id1 as a, category, case when source = 'complaint' then 1.5 else 0.8 end::double as weight, greatest(0.001::double, least(0.999::double, p)) as clipped,
      round(abs(p - target), 6) as err, round(3.5 + 2.0 * abs(p - target), 6) as label_weight, 'human' as tag from ({S}) where category in ({PROBLEM_SQL}) and split_name = 'train'""",
)
def filter_projection(spark: SparkSession, d: str) -> DataFrame:
    """List and equality filters, conditional, clipped,
    derived, constant and renamed columns."""
    x = scored(spark, d).where(F.col("category").isin(*PROBLEM) & (F.col("split_name") == "train"))
    err = F.abs(F.col("p") - F.col("target"))
    return x.select(F.col("pair_id").alias("record"), F.col("id1").alias("a"), "category", F.when(F.col("source") == "complaint", 1.5).otherwise(0.8).alias("weight"), clip(F.col("p"), 0.001, 0.999).alias("clipped"), F.round(err, 6).alias("err"), F.round(F.lit(3.5) + 2.0 * err, 6).alias("label_weight"), F.lit("human").alias("tag"))


@query("not_in_list", f"select category, count(*) as n from ({X}) where category not in ({PROBLEM_SQL}) group by category")
def not_in_list(spark: SparkSession, d: str) -> DataFrame:
    """F5 negated."""
    return pairs(spark, d).where(~F.col("category").isin(*PROBLEM)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("filled_and_total", f"select count(*) as n, count(*) filter (category = 'unknown') as n_filled, count(*) filter (category is null) as n_null from ({X})")
def filled_and_total(spark: SparkSession, d: str) -> DataFrame:
    """No null is left after filling."""
    x = pairs(spark, d)
    return x.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("category") == "unknown", 1)).alias("n_filled"), F.count(F.when(F.col("category").isNull(), 1)).alias("n_null"))


@query("swap_augmentation", f"select pair_id, case when {unit_sql(repr('7'), 'pair_id')} < 0.5 then id2 else id1 end as id1, case when {unit_sql(repr('7'), 'pair_id')} < 0.5 then id1 else id2 end as id2 from ({X}) where split_name = 'train'")
def swap_augmentation(spark: SparkSession, d: str) -> DataFrame:
    """F18."""
    return P.swapped(pairs(spark, d).where("split_name = 'train'"), 7, 0.5, "pair_id").select("pair_id", "id1", "id2")


@query("dict_encode", f"select pair_id, dense_rank() over (order by category) - 1 as code from ({X})")
def dict_encode(spark: SparkSession, d: str) -> DataFrame:
    """F21."""
    return P.dense_codes(pairs(spark, d), "category", "code").select("pair_id", F.col("code").cast("long").alias("code"))


@query("pair_text_preserve", f"select pair_id, text1, text2 from ({JOINED_SQL})")
def pair_text_preserve(spark: SparkSession, d: str) -> DataFrame:
    """J1 with the whole catalogue."""
    return J.pair_texts(pairs(spark, d), texts_of(spark, d), "preserve").select("pair_id", "text1", "text2")


@query("pair_text_drop", f"select pair_id, text1, text2 from ({JOINED_SQL}) where text1 <> '' and text2 <> ''")
def pair_text_drop(spark: SparkSession, d: str) -> DataFrame:
    """J1 with the whole catalogue."""
    return J.pair_texts(pairs(spark, d), texts_of(spark, d), "drop").select("pair_id", "text1", "text2")


@query("missing_counts", f"select count(*) as n_pairs, sum((not has1)::int + (not has2)::int)::bigint as missing_items, sum((has1 and text1 = '')::int + (has2 and text2 = '')::int)::bigint as empty_texts from ({JOINED_SQL})")
def missing_counts(spark: SparkSession, d: str) -> DataFrame:
    """A12 with the whole catalogue."""
    return J.missing_counts(J.pair_texts(pairs(spark, d), texts_of(spark, d)))


@query("category_default", f"select p.pair_id, coalesce(c.category, 'unknown') as category from ({X}) p left join (select id, {CATEGORY_SQL} as category from {CURRENT_SQL}) c on p.id1 = c.id")
def category_default(spark: SparkSession, d: str) -> DataFrame:
    """Category of id1 with a default."""
    c = current(spark, d).select("id", named_category().alias("category"))
    return J.with_category(pairs(spark, d).drop("category"), c).select("pair_id", "category")


@query("category_strict", f"select p.pair_id, c.category from ({X}) p join (select id, {CATEGORY_SQL} as category from {CURRENT_SQL}) c on p.id1 = c.id")
def category_strict(spark: SparkSession, d: str) -> DataFrame:
    """J2 strict, over the pairs whose id1 is in the catalogue (J6 first)."""
    c = current(spark, d).select("id", named_category().alias("category"))
    known = pairs(spark, d).drop("category").join(c.select(F.col("id").alias("id1")), "id1", "left_semi")
    return J.with_category(known, c, None).select("pair_id", "category")


LOOKUP_SQL = f"(select id, 0 as tier, r.name as text from {HUMAN_SQL} union all select id, 1, coalesce(name, '') from {CURRENT_SQL})"
IDS_SQL = f"(select id1 as id from ({X}) union select id2 from ({X}))"


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    tiers = [J.Tier(human(spark, d).select("id", F.col("name").alias("text")), 0), J.Tier(current(spark, d).select("id", F.coalesce("name", F.lit("")).alias("text")), 1)]
    return J.tiered_lookup(J.ids_of(pairs(spark, d)), tiers)


@query("two_tier_lookup", f"select id, text, tier from (select l.*, row_number() over (partition by id order by tier, text) as n from {LOOKUP_SQL} l where id in (select id from {IDS_SQL})) where n = 1")
def two_tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    """J3, J6."""
    return _lookup(spark, d)


@query("lookup_missing", f"select id from {IDS_SQL} where id not in (select id from {LOOKUP_SQL})")
def lookup_missing(spark: SparkSession, d: str) -> DataFrame:
    """Ids that no tier has."""
    return J.difference(J.ids_of(pairs(spark, d)), _lookup(spark, d))


@query("semi_ids", f"select id, category from {CURRENT_SQL} where id in (select id from {IDS_SQL})")
def semi_ids(spark: SparkSession, d: str) -> DataFrame:
    """J6, S4."""
    return J.semi(current(spark, d).select("id", "category"), J.ids_of(pairs(spark, d)))


@query("anti_pairs", f"select pair_id, category from ({X}) x where not exists (select 1 from ({X}) h where h.target >= 0.9 and h.category = x.category and h.id1 = x.id1 and h.id2 = x.id2)")
def anti_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of pairs not used elsewhere, repeated ones included."""
    x = pairs(spark, d)
    return J.without_used(x, x.where("target >= 0.9"), ["category", "id1", "id2"]).select("pair_id", "category")


@query("id_union", f"select id from (select id1 as id from ({X}) union select id2 from ({X}) union select id1 from ({pairs_sql('matches_llm')}) union select id2 from ({pairs_sql('matches_llm')}))")
def id_union(spark: SparkSession, d: str) -> DataFrame:
    """A15, U2."""
    return J.ids_of(pairs(spark, d), pairs(spark, d, "matches_llm"))


@query("id_difference", f"select id from {IDS_SQL} except select id from {CURRENT_SQL}")
def id_difference(spark: SparkSession, d: str) -> DataFrame:
    """U3."""
    return J.difference(J.ids_of(pairs(spark, d)), current(spark, d))


@query("union_all", f"select 'matches' as origin, count(*) as n from ({X}) union all select 'matches_llm', count(*) from ({pairs_sql('matches_llm')})")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    """U1."""
    both = pairs(spark, d).withColumn("origin", F.lit("matches")).unionByName(pairs(spark, d, "matches_llm").withColumn("origin", F.lit("matches_llm")))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("oversample", f"select pair_id, 1 as copy from ({X}) union all select pair_id, 2 from ({X}) where category = '{OVERSAMPLED}'")
def oversample(spark: SparkSession, d: str) -> DataFrame:
    """U4."""
    return J.oversampled(pairs(spark, d), F.col("category") == OVERSAMPLED).select("pair_id", "copy")


@query("set_checks", f"select (select count(*) from (select id from {CURRENT_SQL} group by id having count(*) > 1)) = 0 as ids_unique, not exists (select 1 from {IDS_SQL} i where i.id not in (select id from {CURRENT_SQL})) as ids_known, not exists (select 1 from items_human where id in (select id from {CURRENT_SQL})) as tiers_disjoint")
def set_checks(spark: SparkSession, d: str) -> DataFrame:
    """U5."""
    now = current(spark, d).select("id")
    return spark.createDataFrame([(J.is_unique(now, ["id"]), J.is_subset(J.ids_of(pairs(spark, d)), now, ["id"]), J.is_disjoint(human(spark, d).select("id"), now, ["id"]))], "ids_unique boolean, ids_known boolean, tiers_disjoint boolean")


@query("dedup_keep_first", f"select id, seller_id from (select id, seller_id, row_number() over (partition by id order by updated_at nulls first, loaded_at nulls first, seller_id nulls first) as n from items where id is not null) where n = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """W6."""
    i = table(spark, d, "items", "id", "seller_id", "updated_at", "loaded_at").where("id is not null")
    return J.first_per_key(i, "id", F.col("updated_at"), F.col("loaded_at"), F.col("seller_id"), columns=["seller_id"])


@query("dedup_keep_last", f"select id, seller_id from (select id, seller_id, row_number() over (partition by id order by updated_at desc nulls last, loaded_at desc nulls last, seller_id desc nulls last) as n from items where id is not null) where n = 1")
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    i = table(spark, d, "items", "id", "seller_id", "updated_at", "loaded_at").where("id is not null")
    return J.last_per_key(i, "id", F.col("updated_at"), F.col("loaded_at"), F.col("seller_id"), columns=["seller_id"])


def _per_group_sql(cap: str, seed: str, where: str = "true") -> str:
    return f"select pair_id, category from (select *, row_number() over (partition by category order by {hash_sql(repr(seed), 'pair_id')}, pair_id) as n from ({S}) where {where}) where n <= {cap}"


@query("pool_per_category", _per_group_sql(str(POOL), "1"))
def pool_per_category(spark: SparkSession, d: str) -> DataFrame:
    """P1 at the limit of the recipe."""
    return P.sample_per_group(scored(spark, d), ["category"], POOL, 1, "pair_id").select("pair_id", "category")


@query("grey_caps", _per_group_sql(f"case when category in ({PROBLEM_SQL}) then {GREY_PROBLEM} else {GREY_OTHER} end", "2", "target > 0.2 and target < 0.8"))
def grey_caps(spark: SparkSession, d: str) -> DataFrame:
    """P2 at the limits of the recipe."""
    cap = F.when(F.col("category").isin(*PROBLEM), GREY_PROBLEM).otherwise(GREY_OTHER)
    return P.sample_per_group(scored(spark, d).where(P.grey(F.col("target"))), ["category"], cap, 2, "pair_id", most=max(GREY_PROBLEM, GREY_OTHER)).select("pair_id", "category")


@query("fast_val_head", _per_group_sql(str(FAST_VAL), "3", "split_name = 'eval'"))
def fast_val_head(spark: SparkSession, d: str) -> DataFrame:
    """W3, P5 at the limit of the recipe."""
    return P.sample_per_group(scored(spark, d).where("split_name = 'eval'"), ["category"], FAST_VAL, 3, "pair_id").select("pair_id", "category")


HARD_SQL = f"(select *, row_number() over (partition by category order by abs(p - target) desc, pair_id) as n from ({S}))"


@query("hard_topk", f"select pair_id, category, round(abs(p - target), 6) as err from {HARD_SQL} where n <= {HARD}")
def hard_topk(spark: SparkSession, d: str) -> DataFrame:
    """K1 at the limit of the recipe."""
    x = scored(spark, d).withColumn("err", F.abs(F.col("p") - F.col("target")))
    return P.top_k(x, ["category"], HARD, F.col("err").desc(), F.col("pair_id")).select("pair_id", "category", F.round("err", 6).alias("err"))


def _hard_plus_anchor_sql(hard: int, anchor: int) -> str:
    return f"""with h as (select * from {HARD_SQL} where n <= {hard}), r as (select x.* from ({S}) x where not exists (select 1 from h where h.category = x.category and h.id1 = x.id1 and h.id2 = x.id2)),
    a as (select * from (select *, row_number() over (partition by category order by {hash_sql(repr('4'), 'pair_id')}, pair_id) as n from r) where n <= {anchor})
    select pair_id, 'llm_hard' as source from h union all select pair_id, 'llm_anchor' from a"""


def _hard_plus_anchor(spark: SparkSession, d: str, hard: int, anchor: int) -> DataFrame:
    x = scored(spark, d).withColumn("err", F.abs(F.col("p") - F.col("target")))
    return P.hard_and_anchor(x, ["category"], "err", hard, anchor, 4, ["id1", "id2"], "pair_id").select("pair_id", "source")


@query("hard_plus_anchor", _hard_plus_anchor_sql(HARD, ANCHOR))
def hard_plus_anchor(spark: SparkSession, d: str) -> DataFrame:
    """K1, J7, P3, P4 at the limits of the recipe."""
    return _hard_plus_anchor(spark, d, HARD, ANCHOR)


@query(
    "epoch_interleave",
    f"""with e as (select x.*, epoch from ({S}) x, (select unnest([0, 1]) as epoch)), r as (select *, row_number() over (partition by epoch, category order by {hash_sql(repr('5'), 'epoch', 'pair_id')}, pair_id) - 1 as round from e)
    select pair_id, epoch, round, {hash_sql(repr('5'), 'epoch', 'round', 'category')} as turn from r""",
)
def epoch_interleave(spark: SparkSession, d: str) -> DataFrame:
    """W5, P6."""
    return P.interleaved(scored(spark, d), "category", 2, 5, "pair_id").select("pair_id", "epoch", F.col("round").cast("long").alias("round"), "turn")


@query("fixed_batches", f"with b as (select pair_id, row_number() over (order by {hash_sql(repr('6'), 'pair_id')}, pair_id) - 1 as position from ({S})), c as (select *, position // 128 as batch from b) select pair_id, position, batch, (position % 4)::int as shard from c where batch in (select batch from c group by batch having count(*) = 128)")
def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    """K8, K9: batches of a shuffle without the last partial one, and shards."""
    b = P.batches(scored(spark, d).select("pair_id"), P.keyed_order(6, "pair_id"), 128, drop_last=True)
    return P.sharded(b, 4).select("pair_id", "position", "batch", "shard")


def _by_length(spark: SparkSession, d: str, texts: DataFrame) -> DataFrame:
    j = J.pair_texts(pairs(spark, d), texts)
    return P.length_buckets(j, 8, "text1", "text2").select("pair_id", (F.length("text1") + F.length("text2")).cast("long").alias("len"))


@query("length_sorted", f"select pair_id, length(text1) + length(text2) as len from ({JOINED_SQL})")
def length_sorted(spark: SparkSession, d: str) -> DataFrame:
    """K2, X14 with the whole catalogue."""
    return _by_length(spark, d, texts_of(spark, d))


@query("log_tail", "select event_id, event_type from (select * from events where event_type = 'click' order by ts desc, event_id desc limit 20)")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last lines of one kind of event."""
    return table(spark, d, "events", "event_id", "event_type", "ts").where("event_type = 'click'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20).select("event_id", "event_type")


@query("row_counts", "select 'items' as name, count(*) as n from items union all select 'matches', count(*) from matches union all select 'lineitem', count(*) from lineitem")
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    """Row counts without decoding columns."""
    parts = [spark.read.parquet(f"{d}/{t}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("items", "matches", "lineitem")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("row_range", "select l_returnflag, round(sum(l_quantity), 2) as sum_qty, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag")
def row_range(spark: SparkSession, d: str) -> DataFrame:
    """A projected scan with a filter that reaches the Parquet reader."""
    li = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_shipdate").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count(F.lit(1)).alias("n"))


@query("observed_counts", f"select count(*) as n_rows, count(*) filter (target >= 0.5) as n_pos from ({X})")
def observed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counters that come with another action."""
    df, seen = observed(pairs(spark, d), n_rows=F.count(F.lit(1)), n_pos=F.count(F.when(F.col("target") >= 0.5, 1)))
    df.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["n_rows"], got["n_pos"])], "n_rows long, n_pos long")


@query("top_per_window", "select category, pair_id from (select category, pair_id, row_number() over (partition by category order by p desc, pair_id) as n from (" + S + ")) where n <= 3")
def top_per_window(spark: SparkSession, d: str) -> DataFrame:
    """K1 by score, with the window's order explicit."""
    w = Window.partitionBy("category").orderBy(F.col("p").desc(), "pair_id")
    return scored(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3").select("category", "pair_id")


@query("positional_join", f"select pair_id, p from ({S})")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows and their scores, which come without ids in the same order."""
    x = scored(spark, d)
    rows = P.numbered(x.select("pair_id"), [F.col("pair_id")])
    scores = P.numbered(x.select("pair_id", "p"), [F.col("pair_id")]).select("position", "p")
    return rows.join(scores, "position").select("pair_id", "p")
