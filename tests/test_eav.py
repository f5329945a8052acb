from datetime import datetime

from mergewright.functions.attrs import entries
from mergewright.functions.chars import skeleton
from mergewright.operators import eav

DEFS = "attr_name string, value_type string, title string, aliases array<string>"
ITEMS = "id long, attributes string, updated_at timestamp"


def defs(spark):
    return spark.createDataFrame(
        [("year", "int", "Год выпуска", ["Release year"]), ("kids", "bool", "Для детей", None), ("country", "string", "Страна производства", ["Country of origin"])], DEFS
    )


def cells(spark, rows, schema=ITEMS):
    w = eav.widen(spark.createDataFrame(rows, schema), defs(spark))
    return w, sorted(tuple(r) for r in eav.long_cells(w).collect())


def test_values(spark):
    rows = [
        (1, '{"Год выпуска": "2019.0", "для  детей:": "ДА", "COUNTRY OF ORIGIN": " Китай "}', None),
        (2, '{"Release year": "-5 °C", "Для детей": 0}', None),
        (3, '{"Год выпуска": "нет данных", "Для детей": "н/д", "Страна производства": "Россия", "Страна производства": "—"}', None),
        (4, '{"Год выпуска": 2001, "Год выпуска": 2002, "Год выпуска": null}', None),
        (5, "Release year: 1999 год; Для детей: no", None),
        (6, '{"Год выпуска": "20', None),
        (7, None, None),
        (8, '{"Гoд выпycка": "−7"}', None),
        (9, '{"Год выпуска": "12.5"}', None),
        (10, '{"Год выпуска": "1234567890123456789"}', None),
        (11, '{"Год выпуска": "9999999999999999999"}', None),
    ]
    _, got = cells(spark, rows)
    assert got == [(1, "country", "китай"), (1, "kids", "true"), (1, "year", "2019"), (2, "kids", "false"), (2, "year", "-5"), (3, "country", "россия"), (4, "year", "2002"), (5, "kids", "false"), (5, "year", "1999"), (8, "year", "-7"), (10, "year", "1234567890123456789")]


def test_versions_and_nulls(spark):
    t = [datetime(2025, 1, d) for d in range(1, 4)]
    rows = [(1, '{"Год выпуска": 1}', t[0]), (1, '{"Для детей": "да"}', t[1]), (2, '{"Год выпуска": 3}', t[0]), (2, None, t[2]), (2, None, t[2]), (None, '{"Год выпуска": 9}', t[0])]
    w, got = cells(spark, rows)
    assert got == [(1, "kids", "true")]
    assert w.count() == 2


def test_hot_entity_empty_table_and_clashing_columns(spark):
    rows = [(1, '{"Год выпуска": 5}', None, "x", 1)] * 3000 + [(2, '{"Год выпуска": 6}', None, "y", 2)]
    w, got = cells(spark, rows, ITEMS + ", year string, slot int")
    assert got == [(1, "year", "5"), (2, "year", "6")]
    assert cells(spark, [])[1] == []


def test_long_text(spark):
    text = '{"Описание": "' + "слово " * 50_000 + '", "Год выпуска": 7}'
    assert cells(spark, [(1, text, None)])[1] == [(1, "year", "7")]


def test_against_plain_fold(spark):
    from .conftest import SF

    items = spark.read.parquet(f"{SF}/items.parquet")
    real = spark.read.parquet(f"{SF}/attr_defs.parquet")
    got = {tuple(r) for r in eav.long_cells(eav.widen(items, real)).collect()}
    columns, slots = eav.column_keys(real.orderBy("attr_name").collect())
    newest: dict = {}
    for r in items.collect():
        k = (r["updated_at"] or datetime.min, r["loaded_at"])
        if r["id"] is not None and (r["id"] not in newest or k > newest[r["id"]][0]):
            newest[r["id"]] = (k, r["attributes"])
    want = set()
    for i, (_, text) in newest.items():
        row: dict = {}
        for key, value in entries(text):
            slot = slots.get(skeleton(key).rstrip(":"), -1)
            if slot >= 0 and (v := eav.READERS[columns[slot][1]](value)) is not None:
                row[columns[slot][0]] = str(v).lower() if isinstance(v, bool) else str(v)
        want |= {(i, k, v) for k, v in row.items()}
    assert got == want
