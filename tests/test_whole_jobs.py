"""Queries that must cover whole tables and the reference's limits."""

from pyspark.sql import functions as F

from mergewright.functions import attrs
from mergewright.plans import core, relational
from mergewright.plans.fixtures import ANCHOR, HARD, POOL, PROBLEM, pairs

from .conftest import SF


def test_scorer_reads_every_item(spark):
    """The two forms of the scorer agree over all items."""
    got = core.QUERIES["plugged_scorer"](spark, SF)
    want = core.QUERIES["symmetric_score"](spark, SF)
    both = got.join(want.withColumnRenamed("predict", "whole"), "pair_id")
    assert both.count() == got.count() > 0
    assert both.where("abs(predict - whole) > 1e-6").isEmpty()


def test_whole_texts_have_all_current_items(spark):
    whole = relational.texts_of(spark, SF)
    assert whole.count() == relational.current(spark, SF).count()
    touched = pairs(spark, SF).where("id1 % 50 = 0 or id1 % 51 = 0").join(relational.current(spark, SF).where("name <> ''").select(F.col("id").alias("id1")), "id1", "left_semi")
    texts = core.QUERIES["pair_text_preserve"](spark, SF)
    assert not touched.isEmpty() and touched.join(texts.where("text1 = ''"), "pair_id", "left_semi").isEmpty()


def test_training_frame_keeps_the_reference_limits(spark):
    """No category of the small tables reaches a limit, so every confident pair is a hard one."""
    llm = pairs(spark, SF, "matches_llm").where("split_name = 'train' and (target <= 0.2 or target >= 0.8)")
    assert llm.groupBy("category").count().where("count > 8000").isEmpty()
    hard = core.QUERIES["train_frame_rows"](spark, SF).where("source = 'llm_hard'")
    assert hard.count() == llm.count()
    assert (POOL, HARD, ANCHOR) == (12_000, 8_000, 3_000)


def test_samples_reach_the_reference_limits(spark):
    """The samples take min(limit, rows) of each category."""
    x = pairs(spark, SF)
    n = {r["category"]: r["count"] for r in x.groupBy("category").count().collect()}
    grey = {r["category"]: r["count"] for r in x.where("target > 0.2 and target < 0.8").groupBy("category").count().collect()}
    held = {r["category"]: r["count"] for r in x.where("split_name = 'eval'").groupBy("category").count().collect()}
    assert max(n.values()) > 80
    want = {
        "pool_per_category": sum(min(k, 12_000) for k in n.values()),
        "hard_topk": sum(min(k, 8_000) for k in n.values()),
        "hard_plus_anchor": sum(min(k, 11_000) for k in n.values()),
        "grey_caps": sum(min(k, 2_000 if c in PROBLEM else 500) for c, k in grey.items()),
        "fast_val_head": sum(min(k, 3_000) for k in held.values()),
    }
    got = {q: core.QUERIES[f"{q}"](spark, SF).count() for q in want}
    assert got == want
    parts = {r["part"]: r["n"] for r in core.QUERIES["stage_frames"](spark, SF).collect()}
    assert parts["fast_val"] == parts["holdout"]


def test_entries_below_many_groups_are_read():
    for depth in (3, 21, 200):
        text = '{"g": ' * depth + '{"a": "1", "b": ["2", "3"]}' + "}" * depth
        assert attrs.entries(text) == [("a", "1"), ("b", "2"), ("b", "3")]
        assert attrs.entries("[" * depth + '{"name": "a", "value": "1"}' + "]" * depth) == [("a", "1")]


def test_cache_holds_every_source(spark):
    got = {r["source"]: r["n"] for r in core.QUERIES["partial_cache"](spark, SF).collect()}
    assert sum(got.values()) == pairs(spark, SF).count() and {"complaint", "unknown"} <= set(got)
