import pytest

from mergewright.operators import quantities as q

UNITS = [("g", "weight", 1.0), ("kg", "weight", 1000.0), ("oz", "weight", 28.349523125), ("ml", "volume", 1.0), ("l", "volume", 1000.0), ("cl", "volume", 10.0), ("mm", "length", 1.0), ("cm", "length", 10.0), ("in", "length", 25.4), ("m", "length", 1000.0), ("mb", "memory", 1.0), ("gb", "memory", 1024.0), ("w", "power", 1.0), ("hp", "power", 735.49875), ("kw", "power", 1000.0), ("mah", "battery", 1.0), ("ah", "battery", 1000.0)]
SHAPE = "unit string, kind string, factor double"
ITEMS = "id long, name string, attributes string, updated_at timestamp, kind string"


def found(spark, rows, units=UNITS, shape=SHAPE, edges=None):
    items = spark.createDataFrame(rows, ITEMS)
    return sorted(tuple(r) for r in q.quantities(items, spark.createDataFrame(units, shape), edges).collect())


@pytest.mark.parametrize(
    "name, attributes, want",
    [
        ("Шампунь 0,5 л", None, [("volume", 500)]),
        ("Порошок 1 500 гр / x10", None, [("weight", 1500)]),
        ("Чайник 1,7 литра 1.63 л. с.", None, [("power", 1199), ("volume", 1700)]),
        ("Кабель 59,1\" AB 5457L", None, [("length", 1501)]),
        ("Кабель нагрузка до 15 кг, для экранов до 6,7 дюйма, от сети 2 кВт и выше, подходит к ёмкостям 19 л, fits loads up to 30 lb", None, []),
        ("Комплект из 10 500 г размер 42", None, [("weight", 500)]),
        ("зонт ０,５ м", '{"Вес, г": 500, "Вес с упаковкой": "2 кг", "Габариты коробки": "1x2x3 см", "Площадь хранения": "4 м²", "Год выпуска": "2020 г."}', [("length", 500), ("weight", 500)]),
        (None, "Battery: 5 А·ч; Объем, сл: 50", [("battery", 5000), ("volume", 500)]),
        ("шкаф 5 м² 500", '{"Длина": "500"', []),
        ("", "нет", []),
        ("Чай 1 000 г, до 5 кг", None, [("weight", 1000)]),
        ("Фен AB-1234W 800Вт", '{"Вес с упаковкой": "1 кг", "Power, кВт": "0,8"}', [("power", 800)]),
        ("Аккумулятор 5 А·ч", '{"Площадь хранения": "4 м²"}', [("battery", 5000)]),
        ("Дрель", '{"Power": "0.2 hp", "Длина, см": 30}', [("length", 300), ("power", 147)]),
        (None, None, []),
        ("", "{", []),
        ("x" * 200_000 + " 5 кг", None, [("weight", 5000)]),
    ],
)
def test_statements(spark, name, attributes, want):
    assert [x[1:] for x in found(spark, [(1, name, attributes, None, "x")])] == want


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "Чай 5 кг", None, None, "x"), (1, "Чай 5 кг", None, None, "y"), (None, "Чай 5 кг", None, None, None)]
    assert found(spark, rows) == [(1, "weight", 5000)]
    assert found(spark, []) == []
    assert found(spark, rows, []) == []


def test_affine_units(spark):
    units = [("k", "temperature", 1.0, 0.0), ("c", "temperature", 1.0, 273.15), ("f", "temperature", 5 / 9, 255.372222222)]
    got = found(spark, [(1, "Печь 180 c", None, None, "x"), (2, "Печь 212 f", None, None, "x"), (3, "Печь 300 k", None, None, "x")], units, SHAPE + ", offset double")
    assert got == [(1, "temperature", 453), (2, "temperature", 373), (3, "temperature", 300)]


def test_units_without_spellings_of_their_own(spark):
    assert found(spark, [(1, "Нить 8 denier", None, None, "x")], [("tex", "titre", 1.0), ("denier", "titre", 0.5)]) == [(1, "titre", 4)]


def test_chains_and_redundant_conversions(spark):
    units = spark.createDataFrame([("mm", "length", 1.0), ("m", "length", 1000.0)], SHAPE)
    edges = spark.createDataFrame([("km", "m", 1000.0), ("mile", "km", 1.609344), ("mile", "m", 1609.344)], "unit string, other string, factor double")
    ways = {s: a for s, _, _, a, _ in q.conversions(units, edges)}
    assert ways["mm"] == 1.0 and ways["m"] == 1000.0
    assert q.disagreements(units, edges).count() == 0
    wrong = edges.union(spark.createDataFrame([("mile", "mm", 5.0)], edges.schema))
    bad = q.disagreements(units, wrong).collect()
    assert bad and all(r["what"] == "conversion" for r in bad)
    assert found(spark, [(1, "Лента 2 м", None, None, "x")], [("mm", "length", 1.0), ("m", "length", 1000.0), ("m", "length", 999.0)])  # one bad row doesn't stop the rest


def test_distant_units_compose(spark):
    edges = [("a", "b", 2.0, 1.0), ("b", "c", 3.0, 0.0), ("c", "d", 1.0, 4.0)]
    seen, bad = q.compose(edges, "d")
    assert seen["a"] == (6.0, 7.0) and not bad
    back, _ = q.compose(edges, "a")
    assert back["d"][0] * 13.0 + back["d"][1] == pytest.approx(1.0)


def test_a_spelling_of_two_kinds_is_reported(spark):
    units = [("g", "weight", 1.0), ("g", "force", 9.8), ("kg", "weight", 1000.0)]
    assert found(spark, [(1, "Чай 5 g, 2 kg", None, None, "x")], units) == [(1, "weight", 2000)]
    assert {r["unit"] for r in q.disagreements(spark.createDataFrame(units, SHAPE)).collect()} >= {"g"}


def test_current_rows(spark):
    from datetime import datetime

    a, b = datetime(2025, 1, 1), datetime(2025, 1, 2)
    rows = [(1, "5 кг", None, a, "x"), (1, "6 кг", None, b, "x"), (2, "7 кг", "Вес: 7000 г", None, "x"), (2, "7 кг", "Вес: 7000 г", None, "x"), (None, "8 кг", None, None, "x")]
    assert found(spark, rows) == [(1, "weight", 6000), (2, "weight", 7000)]
