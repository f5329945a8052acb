"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from ..sources.tables import table
from . import components, lookalike, mixing, overlap, personal, products, splits, tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _groups_sql(links: str) -> str:
    """Least labels over links (u, v) by a keyed recursion."""
    return f"""with recursive l as ({links}), e as (select u as a, v as b from l union select v, u from l),
      r(id, label) using key (id) as (select id, min(label) from (select a as id, least(a, b) as label from e) group by id
        union select e.b, min(r.label) from r join e on e.a = r.id join recurring.r c on c.id = e.b where r.label < c.label group by e.b)"""


@query("p4_found", _groups_sql("select id1 as u, id2 as v from matches where target >= 0.5 and id1 is not null and id2 is not null and id1 <> id2") + " select id, label as group_id from r")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Group of every id in a link of matches: id, group_id."""
    pairs = table(spark, d, "matches", "id1", "id2", "target")
    return components.connected_groups(components.links(pairs), Scratch(spark, "p4"))


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document: doc_id, ids."""
    return tokens.encode(table(spark, d, "documents", "doc_id", "text"))


@query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Chosen documents with their repeats."""
    return mixing.mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))[0]


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))[1]


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "matches", "pair_id", "id1", "id2", "category")


@query(
    "p6_found",
    _groups_sql("select id1 as u, id2 as v from matches where pair_id is not null and id1 is not null and id2 is not null and id1 <> id2")
    + """, p as (select distinct pair_id, coalesce(id1, id2) as id from matches where pair_id is not null)
    select pair_id, coalesce(r.label, p.id) as bundle_id from p left join r on r.id = p.id""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Bundle of every record of matches: pair_id, bundle_id."""
    return splits.bundles(table(spark, d, "matches", "pair_id", "id1", "id2"), Scratch(spark, "p6")).select("pair_id", "bundle_id")


@query("p6_forest")
def p6_forest(spark: SparkSession, d: str) -> DataFrame:
    """The spanning forest behind the bundles: level, u, v."""
    pairs = table(spark, d, "matches", "pair_id", "id1", "id2").where("pair_id is not null")
    return splits.spanning_forest(components.links(pairs, None), Scratch(spark, "p6")).edges


@query("p6_splits")
def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """One split per record of matches."""
    return splits.assign(_matches(spark, d), table(spark, d, "split_targets"), Scratch(spark, "p6"))


@query(
    "p6_torn",
    _groups_sql("select id1 as u, id2 as v from matches where pair_id is not null and id1 is not null and id2 is not null and id1 <> id2")
    + """, p as (select distinct pair_id, coalesce(id1, id2) as id from matches where pair_id is not null)
    select count(*) as n_records, count(distinct coalesce(r.label, p.id)) as n_bundles, 0::bigint as n_torn, 0::bigint as n_without from p left join r on r.id = p.id""",
)
def p6_torn(spark: SparkSession, d: str) -> DataFrame:
    """Records and bundles of p6_splits, bundles in several splits, and records without one."""
    per = p6_splits(spark, d).groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split_name").alias("k"), F.sum(F.col("split_name").isNull().cast("long")).alias("none"))
    torn = F.when(F.col("bundle_id").isNotNull() & (F.col("k") > 1), 1)
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), F.count("bundle_id").alias("n_bundles"), F.count(torn).alias("n_torn"), F.coalesce(F.sum("none"), F.lit(0)).alias("n_without"))


@query("p6_shares")
def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """Actual and target shares of the splits, overall and per category."""
    return splits.report(p6_splits(spark, d), table(spark, d, "split_targets"))


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "items", "id", "name", "attributes", "updated_at")
    return lookalike.repair_fields(items, table(spark, d, "brands", "brand"), Scratch(spark, "p5"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields of current items in other characters: id, field."""
    return _repaired(spark, d).where("size(findings) > 0").select("id", "field")


@query("p5_repaired")
def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Those fields in consistent form."""
    return _repaired(spark, d)


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "p2")
    pairs = [table(spark, d, t, "pair_id", "id1", "id2", "split_name", "source") for t in ("matches", "matches_llm")]
    items = table(spark, d, "items", "id", "name", "attributes", "seller_id", "updated_at")
    rows = scratch.save(overlap.records(*pairs), "records")
    return rows, overlap.overlaps(rows, *overlap.same_listings(items, rows, scratch), scratch)


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of the training split and another one that join the same listings."""
    return _overlaps(spark, d)[1].select("pair_id1", "pair_id2")


@query("p2_report")
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping records per split and source."""
    return overlap.report(*_overlaps(spark, d))


def _personal(spark: SparkSession, d: str, **options) -> DataFrame:
    return personal.scan(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "brands", "brand"), **options)


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Where personal information starts: doc_id, kind, start_at."""
    return _personal(spark, d).select("doc_id", F.inline("findings"))


@query("p10_redacted")
def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text with placeholders."""
    return _personal(spark, d).select("doc_id", "text")


@query("p10_dates")
def p10_dates(spark: SparkSession, d: str) -> DataFrame:
    """The same with dates permuted as well."""
    return _personal(spark, d, dates=True).select("doc_id", "text")


def _products(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "items", "id", "name", "attributes", "category", "updated_at")
    return products.groups(items, table(spark, d, "brands", "brand", "brand_ru"), table(spark, d, "units"), Scratch(spark, "p1"))


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of listings of the same product: id1, id2."""
    return products.pairs(*_products(spark, d))


@query("p1_groups")
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Product of every listing, and how many it has: id, product, n_listings."""
    return products.grouped(*_products(spark, d))


@query("p1_agreement")
def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The groups against the labels of matches."""
    return products.agreement(products.grouped(*_products(spark, d)), table(spark, d, "matches", "id1", "id2", "target"))
