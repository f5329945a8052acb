"""Views over the driver's tables that several queries share, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import unit_hash
from ..sources.tables import table

#: Categories that count as problems.
PROBLEM = ("Обувь", "Одежда", "Галантерея и аксессуары", "Ювелирные изделия")
PROBLEM_SQL = ", ".join(f"'{c}'" for c in PROBLEM)
OVERSAMPLED = "Обувь"
#: The reference's rows per category: P1, K1, P3; P2 for problems and others; W3.
POOL, HARD, ANCHOR = 12_000, 8_000, 3_000
GREY_PROBLEM, GREY_OTHER, FAST_VAL = 2_000, 500, 3_000


def named_category(c: str = "category"):
    trimmed = F.trim(F.col(c))
    return F.when(trimmed != "", trimmed).otherwise(F.lit("unknown"))


def pairs(spark: SparkSession, d: str, name: str = "matches") -> DataFrame:
    """Labelled pairs, one row per record: F16, F3 and F4 in one projection."""
    rows = table(spark, d, name, "pair_id", "id1", "id2", "target", "category", "split_name", "source")
    full = rows.where("pair_id is not null and id1 is not null and id2 is not null and target is not null")
    return full.select(
        "pair_id", "id1", "id2", F.round(F.col("target").cast("double"), 4).alias("target"), named_category().alias("category"),
        F.coalesce("split_name", F.lit("unknown")).alias("split_name"), F.coalesce("source", F.lit("unknown")).alias("source"),
    ).distinct()


def scored(spark: SparkSession, d: str, name: str = "matches") -> DataFrame:
    """Labelled pairs with two deterministic scores p and q, rich in ties."""
    def score(salt: str):
        return F.floor(F.col("target") * 60.0 + unit_hash(salt, F.col("pair_id")) * 40.0) / 100.0

    return pairs(spark, d, name).select("*", (F.col("target") >= 0.5).cast("int").alias("y"), score("p").alias("p"), score("q").alias("q"))


def hash_sql(*parts: str) -> str:
    text = " || '|' || ".join(p if p.startswith("'") else f"coalesce({p}::varchar, '')" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint)"


def unit_sql(*parts: str) -> str:
    return f"({hash_sql(*parts)}::double / 4294967296.0::double)"


def pairs_sql(name: str = "matches") -> str:
    return f"""select distinct pair_id, id1, id2, round(target::double, 4) as target,
      case when trim(category) <> '' then trim(category) else 'unknown' end as category,
      coalesce(split_name, 'unknown') as split_name, coalesce(source, 'unknown') as source
      from {name} where pair_id is not null and id1 is not null and id2 is not null and target is not null"""


def scored_sql(name: str = "matches") -> str:
    def score(salt: str) -> str:
        return f"(floor(target * 60.0::double + {unit_sql(repr(salt), 'pair_id')} * 40.0::double) / 100.0::double)"

    return f"select *, (target >= 0.5)::int as y, {score('p')} as p, {score('q')} as q from ({pairs_sql(name)})"
