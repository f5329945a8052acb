"""Entity, attribute, value rows into one wide typed row per entity.

Method: ``combineByKey`` over (entity, cell). An entity's combiner is a slot
register: the version it was read from and, per column, the last readable cell.
Merging two registers is associative and commutative, so duplicates, older
versions and repeated attributes are resolved on the map side and at most one
register per entity leaves a map task, however often an entity occurs.

Defined results: a row with a null entity id gives nothing; null, blank, cut-off
or unreadable attributes give a row of nulls; rows that tie on version are
merged, the cell with the greatest position (then value) wins; an empty input
gives an empty table; other columns of the input are ignored, whatever their
names. Attributes of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.attrs import entries
from ..functions.chars import plain, skeleton
from ..session import parallelism

MAX_COLUMNS = 2000
#: Input rows per reduce task at most, on average.
ROWS_PER_PARTITION = 200_000

_INT = re.compile(r"([+\-−–]?)\s*(\d+)(?:[.,]0+)?(?![\d.,]*\d)[^\d]*")
# Words that mean yes, no, or nothing at all.
_TRUE = frozenset(map(skeleton, ("да", "true", "yes", "есть", "1", "1.0", "истина", "y")))
_FALSE = frozenset(map(skeleton, ("нет", "false", "no", "отсутствует", "0", "0.0", "ложь", "n")))
_SAYS_NOTHING = frozenset(map(skeleton, (
    "", "-", "—", "–", "−", "null", "none", "nan", "n/a", "na", "н/д", "нет данных", "не указано", "не указан", "не указана",
    "уточняйте у продавца", "см. описание", "неизвестно", "нет информации", "not given", "not specified", "unknown", "?",
)))


def read_int(value: object) -> int | None:
    """Whole number at the start of the value; a unit after it is dropped."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int):
        out = value
    elif isinstance(value, float):
        out = int(value) if value == value and abs(value) < 2**62 and value == int(value) else None
    else:
        m = _INT.fullmatch(plain(str(value)).strip())
        out = int(m[2]) * (-1 if m[1] in ("-", "−", "–") and m[1] else 1) if m else None
    return out if out is not None and -(2**63) <= out < 2**63 else None


def read_bool(value: object) -> bool | None:
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return {0: False, 1: True}.get(value)
    s = skeleton(str(value)) if value is not None else ""
    return True if s in _TRUE else False if s in _FALSE else None


def read_string(value: object) -> str | None:
    if value is None or isinstance(value, (bool, float, int)):
        return None if value is None else str(value).lower()
    s = plain(value).strip().lower()
    return None if skeleton(s) in _SAYS_NOTHING else s


READERS = {"int": read_int, "bool": read_bool, "string": read_string}
TYPES = {"int": T.LongType(), "bool": T.BooleanType(), "string": T.StringType()}


def column_keys(defs: Iterable) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """Columns as (name, type), and the slot of each comparison key of a title or alias."""
    columns, slots = [], {}
    for d in defs:
        for name in (d["title"], *(d["aliases"] or ())):
            if name is not None:
                slots.setdefault(skeleton(name).rstrip(":"), len(columns))
        columns.append((d["attr_name"], d["value_type"]))
    return columns, slots


def _cells(columns: list[tuple[str, str]], slots: dict[str, int]):
    readers = [READERS[kind] for _, kind in columns]

    def run(rows: Iterator) -> Iterator[tuple[int, tuple]]:
        known: dict[str, int] = {}
        for entity, version, text in rows:
            # the marker lets a newer version without cells hide an older one
            yield entity, (version, -1, -1, None)
            for pos, (key, value) in enumerate(entries(text)):
                slot = known.get(key)
                if slot is None:
                    if len(known) > 100_000:
                        known.clear()
                    slot = known[key] = slots.get(skeleton(key).rstrip(":"), -1)
                if slot >= 0 and (cell := readers[slot](value)) is not None:
                    yield entity, (version, slot, pos, cell)

    return run


def _open(cell: tuple) -> tuple:
    version, slot, pos, value = cell
    return version, {slot: (pos, value)} if slot >= 0 else {}


def _add(register: tuple, cell: tuple) -> tuple:
    version, slot, pos, value = cell
    if version != register[0]:
        return _open(cell) if version > register[0] else register
    if slot >= 0 and ((old := register[1].get(slot)) is None or (pos, value) > old):
        register[1][slot] = (pos, value)
    return register


def _merge(a: tuple, b: tuple) -> tuple:
    if a[0] != b[0]:
        return a if a[0] > b[0] else b
    for slot, cell in b[1].items():
        if (old := a[1].get(slot)) is None or cell > old:
            a[1][slot] = cell
    return a


def widen(items: DataFrame, attr_defs: DataFrame, entity: str = "id", text: str = "attributes", version: str | None = "updated_at") -> DataFrame:
    """One row per entity with a typed column per row of ``attr_defs``.

    ``attr_defs`` is a table of columns, so its size is bounded by
    ``MAX_COLUMNS``, which is checked.
    """
    spark: SparkSession = items.sparkSession
    defs = attr_defs.select("attr_name", "value_type", "title", "aliases").orderBy("attr_name").limit(MAX_COLUMNS + 1).collect()
    if len(defs) > MAX_COLUMNS:
        raise ValueError(f"attr_defs has more than {MAX_COLUMNS} columns")
    columns, slots = column_keys(defs)
    schema = T.StructType([T.StructField("id", T.LongType())] + [T.StructField(n, TYPES[k]) for n, k in columns])
    stamp = F.coalesce(F.unix_micros(F.col(version).cast("timestamp")), F.lit(-(2**63))) if version else F.lit(0).cast("long")
    rows = items.where(F.col(entity).isNotNull()).select(F.col(entity).cast("long"), stamp, F.col(text).cast("string")).rdd
    width = len(columns)
    # the footers' row count sizes the reduce tasks, so that a task's registers fit its memory
    partitions = max(parallelism(spark), -(-items.count() // ROWS_PER_PARTITION))

    def encode(pair: tuple) -> tuple:
        got = pair[1][1]
        return (pair[0], *(got[i][1] if i in got else None for i in range(width)))

    wide = rows.mapPartitions(_cells(columns, slots)).combineByKey(_open, _add, _merge, numPartitions=partitions).map(encode)
    return spark.createDataFrame(wide, schema, verifySchema=False)


def long_cells(wide: DataFrame) -> DataFrame:
    """The non-empty cells of a wide table as (id, attr_name, val)."""
    cells = [F.struct(F.lit(c).alias("attr_name"), F.col(f"`{c}`").cast("string").alias("val")) for c in wide.columns if c != "id"]
    if not cells:
        return wide.select("id", F.lit("").alias("attr_name"), F.lit("").alias("val")).limit(0)
    return wide.select("id", F.inline(F.array(*cells))).where(F.col("val").isNotNull())
