"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import eav, quantities
from ..sources.tables import table
from . import graphs, metrics, relational, textual  # noqa: F401
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query("p3_wide")
def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per item with the typed columns of attr_defs."""
    return eav.widen(table(spark, d, "items", "id", "attributes", "updated_at"), table(spark, d, "attr_defs"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The non-empty cells of p3_wide: id, attr_name, val."""
    return eav.long_cells(p3_wide(spark, d))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of current items in base units: id, kind, amount."""
    return quantities.quantities(table(spark, d, "items", "id", "name", "attributes", "updated_at"), table(spark, d, "units"))


@query("p7_disagreements", "select '' as what, kind, unit, '' as other, 0.0::double as stated_a, 0.0::double as stated_b, factor as composed_a, 0.0::double as composed_b from units u where exists (select 1 from units v where v.unit = u.unit and (v.kind <> u.kind or v.factor <> u.factor))")
def p7_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Conversions of the table of units that disagree with each other."""
    return quantities.disagreements(table(spark, d, "units"))
