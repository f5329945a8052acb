import json
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergewright.llm import listing, overlap, products
from mergewright.operators import quantities

ITEMS = "id long, name string, attributes string, seller_id long, updated_at timestamp, category string, rep string"
PAIRS = "pair_id long, id1 long, id2 long, split_name string, source string, train string"


def item(i, name, attributes=None, seller=1, day=None):
    return (i, name, attributes, seller, datetime(2025, 1, day) if day else None, None, "y")


# --- overlap ---------------------------------------------------------------------
def slips(a, b):
    """Optimal string alignment distance, in full."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(1, 3))
def test_banded_programme_is_the_whole_one(a, b, most):
    whole, got = slips(a, b), overlap.edits(a, b, most)
    assert (got is not None) == (whole <= most)
    if got is not None:
        assert len(got) == whole
        # the edits lead from the one string to the other
        out, at = "", 0
        for p, k, q, n in got:
            out += a[at:p] + b[q : q + n]
            at = p + k
        assert out + a[at:] == b
    assert overlap.within_one_slip(a, b) == (whole == 1)


@settings(max_examples=400, deadline=None)
@given(st.text("abcd", max_size=16), st.integers(1, 3), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 15), st.sampled_from("abcd")), max_size=3))
def test_segments_meet_probes(s, most, changes):
    t = s
    for kind, at, c in changes[:most]:
        at %= len(t) + 1
        t = (t[:at] + t[at + 1 :], t[:at] + c + t[at:], t[:at] + c + t[at + 1 :], t[:at] + t[at : at + 2][::-1] + t[at + 2 :])[kind]
    if slips(s, t) <= most:
        assert set(overlap.segments(s, most)) & set(overlap.probes(t, most))


def naive_links(rows, train, other, most=1):
    """Pairs of listings that are the same, by the definition, all with all."""
    by = {r[0]: (None if r[3] is None else (r[3], overlap.attribute_key(r[2])), overlap.words(r[1] or "")) for r in rows}
    near = {x: {x} for x in {*by, *train, *other}}
    for x, (block, p) in by.items():
        for y, (block2, q) in by.items():
            if x < y and block and block == block2 and p and q and (p == q or "".join(p) == "".join(q) or overlap.same_name(p, q, most)):
                near[x].add(y)
                near[y].add(x)
    return {(o, t) for o in other for z in near[o] for t in near[z] & set(train)}


def links(spark, scratch, rows, train, other, most=1):
    """The same by the operator: every id is in a record with itself."""
    recs = [(i, x, x, "train", "s", "x") for i, x in enumerate(train)] + [(10_000 + i, x, x, "eval", "s", "x") for i, x in enumerate(other)]
    r = overlap.records(spark.createDataFrame(recs, PAIRS))
    items = spark.createDataFrame(rows, ITEMS)
    found = overlap.overlaps(r, *overlap.same_listings(items, r, scratch, most), scratch).collect()
    assert len(found) == len({(x["pair_id1"], x["pair_id2"]) for x in found})
    return {(other[x["other_id"] - 10_000], train[x["train_id"]]) for x in found}


def test_same_listings(spark, scratch):
    a, b = '{"цвет": "красный", "вес": "5 кг"}', '{"ВЕС:": "5  кг", "Цвет": "кpасный"}'
    rows = [
        item(1, "Шампунь для волос Gorka 5 л", a), item(2, "шамунь | для волос gorka, 5 л!", b), item(3, "Шампунь для воолс Gorka 5 л", a), item(4, "Шампунь для волос Gorka 6 л", a),
        item(5, "Шампунь для волос Gorka 5 л", a, seller=2), item(6, "Шампунь для волос Gorka 5 л", '{"цвет": "синий"}'), item(7, "Шампунь для волос Gorka 5 л", None), item(8, "шампунь для волос gorka 5 Л", None),
        item(9, None, a), item(10, None, a), item(11, "!!!", a), item(12, "???", a), item(13, "Шампунь для волос Gorka 5 л", a, seller=None),
        item(14, "Шампунь для волос Gorka 5 л", a, day=1), item(14, "Другое", a, day=2), item(15, "чай II 5", a), item(16, "чай III 5", a),
    ]
    ids = [*range(1, 17), 99]
    same = {(x, x) for x in ids} | {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} | {(7, 8), (8, 7)}
    assert links(spark, scratch, rows, ids, ids) == same
    assert links(spark, scratch, rows, [1, 5, 8], [2, 3, 4, 7]) == {(2, 1), (3, 1), (7, 8)}
    assert links(spark, scratch, [], [1], [1, 2]) == {(1, 1)}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_same_listings_against_all_pairs(spark, scratch, most):
    rnd = random.Random(most)
    base = ["флешнакопитель белый сувенир", "кроссовки спортивные новые", "стиральный порошок лимон"]
    rows = []
    for i in range(50):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, most + 1)):
            k = rnd.randrange(len(w))
            if w[k] != " ":
                w[k : k + 1] = rnd.choice(["", w[k] * 2, "ж"])
        rows.append(item(i, "".join(w), rnd.choice([None, '{"a": 1}']), rnd.randint(1, 2)))
    train, other = list(range(0, 50, 2)), list(range(0, 50, 3))
    assert links(spark, scratch, rows, train, other, most) == naive_links(rows, train, other, most)


def test_no_chains(spark, scratch):
    """Every wording is a slip from the next one; the first reaches two steps far."""
    w = ["абвгдежзик" + "".join("ямуфхцчшщэ"[:i]) + "лмнопрст" for i in range(6)]
    got = links(spark, scratch, [item(i, x) for i, x in enumerate(w)], list(range(6)), [0])
    assert got == {(0, 0), (0, 1), (0, 2)}


def test_a_seller_with_many_listings_of_one_beginning(spark, scratch, monkeypatch):
    from mergewright.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    monkeypatch.setattr(skew.salted_join, "__defaults__", (50,))
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (0.002, 50))
    rows = [item(i, f"шампунь для волос обыкновенный {chr(1072 + i % 32)}{chr(1072 + i // 32 % 32)}{chr(1072 + i * 7 % 32)}номер") for i in range(300)]
    train, other = list(range(0, 300, 2)), list(range(1, 300, 2))
    got = links(spark, scratch, rows, train, other[:40])
    assert got == naive_links(rows, train, other[:40])


def test_overlaps(spark, scratch):
    rows = [(1, 10, 20, "train", "h", "x"), (2, 20, 10, "eval", None, "x"), (3, 10, 21, "tune", "h", "x"), (4, 10, None, "eval", "h", "x"), (5, 30, 30, "train", "h", "x"), (6, 30, 30, "holdout", "h", "x"), (7, 10, 20, None, "h", "x"), (8, 10, 20, "train", "h", "x"), (2, 20, 10, "eval", None, "x"), (9, 99, 98, "eval", "h", "x"), (10, 40, 22, "eval", "h", "x")]
    renamed = spark.createDataFrame([(21, 20)], "id long, listing long")
    near = spark.createDataFrame([(40, [10, 41]), (22, [10, 20])], "listing long, others array<long>")
    r = overlap.records(spark.createDataFrame(rows[:5], PAIRS), spark.createDataFrame(rows[5:], PAIRS))
    found = overlap.overlaps(r, renamed, near, scratch)
    assert sorted((x["pair_id1"], x["pair_id2"]) for x in found.collect()) == [(1, 2), (1, 3), (1, 10), (2, 8), (3, 8), (5, 6), (8, 10)]
    rep = {(x["split_name"], x["source"]): (x["n_records"], x["n_overlapping"]) for x in overlap.report(r, found).collect()}
    assert rep == {("eval", None): (1, 1), ("tune", "h"): (1, 1), ("holdout", "h"): (1, 1), ("eval", "h"): (2, 1)}
    none = overlap.records(spark.createDataFrame([], PAIRS))
    assert overlap.overlaps(none, renamed, near, scratch).count() == 0


# --- products ----------------------------------------------------------------------
BRANDS = [("Gorka", None), ("Remto", "Ремто"), ("TEKCOP", None), ("Köhlmar", None)]
UNITS = [("g", "weight", 1.0), ("kg", "weight", 1000.0), ("ml", "volume", 1.0), ("l", "volume", 1000.0), ("w", "power", 1.0), ("kw", "power", 1000.0), ("hp", "power", 735.49875)]


@pytest.mark.parametrize(
    "name, attributes, want, words",
    [
        ("Шампунь для волос Ремто Vavava Start - 0,5 л, комплект из 6, новинка 2025", None, ("remto", None, None, None, 6), "шампунь для волос  vavava start   комплект  новинка 2025"),
        ("ТЕКСОР дрель ударная / Novelfi ONE AB-1234X 0,3 КВТ", None, ("tekcop", None, None, None, None), " дрель ударная  novelfi one"),
        ("футболка хлопковая 🔥 р-р XL, чёрный матовый", '{"Торговая марка": "kohlmar", "Линейка": "Silpol II"}', ("kohlmar", "silpol ii", "black", "xl", None), "футболка хлопковая р р xl матовый"),
        (None, '{"Размер": "17,5", "Серия": "Ран Один", "Бренд": "Gorka", "Цвет": "бирюзовый"}', ("gorka", "ран один", "бирюзовый", "17.5", None), ""),
        (None, '{"Серия": "не указано", "Цвет": null}', (None, None, None, None, None), ""),
        (None, None, (None, None, None, None, None), ""),
        ("", "x", (None, None, None, None, None), ""),
    ],
)
def test_listing(name, attributes, want, words):
    got = listing.Reader(listing.Brands.of(BRANDS), quantities.patterns(("л", "квт", "вт"))).read(name, attributes)
    assert tuple(got[k] for k in ("brand", "series", "colour", "size", "pack")) == want
    assert " ".join(got["words"]).split() == words.split()


def test_many_brands_cost_no_more():
    many = listing.Brands.of([(f"Brand{i} Of {i}", None) for i in range(20_000)])
    assert many.at(["brand7", "of", "7", "x"], 0) == 3 and many.at(["brand7", "of"], 0) == 0


def pairs(spark, scratch, rows, **kw):
    b = spark.createDataFrame(BRANDS, "brand string, brand_ru string")
    u = spark.createDataFrame(UNITS, "unit string, kind string, factor double")
    members, named = products.groups(spark.createDataFrame(rows, ITEMS), b, u, scratch)
    got = products.pairs(members, named).collect()
    assert len(got) == len({(r["id1"], r["id2"]) for r in got})
    together = {}
    for r in products.grouped(members, named).collect():
        together.setdefault(r["product"], []).append((r["id"], r["n_listings"]))
    # the groups and the pairs say the same
    assert {(a, b) for g in together.values() for a, _ in g for b, _ in g if a < b} == {(r["id1"], r["id2"]) for r in got}
    assert all(n == len(g) for g in together.values() for _, n in g)
    return {(r["id1"], r["id2"]) for r in got}


def test_products(spark, scratch):
    rows = [
        item(1, "Дрель Gorka Novelfi One 150 Вт"), item(2, "дрель ударная novelfi one, best price", '{"Brand": "GORKA", "Power": "0.2 hp"}', 2), item(3, "Drill Gorka 0,15 кВт", '{"Серия": "Novelfi One"}'),
        item(4, "Дрель Gorka Novelfi Pro 150 Вт", '{"Серия": "Novelfi Pro"}'), item(5, "Дрель Remto Novelfi One 150 Вт", '{"Серия": "Novelfi One"}'), item(6, "Дрель Gorka Novelfi One 300 Вт"),
        item(7, "Шампунь Gorka Tifetu 1 л, 2 шт", '{"Линейка": "TIFETU"}'), item(8, "Шампунь Gorka Tifetu 1 л"), item(9, "Шампунь Gorka Tifetu 1000 мл, 1 шт"), item(10, "Шампунь Gorka Tifetu 1 л, x2"),
        item(11, None), item(12, None), item(13, ""), item(14, "Дрель Gorka Novelfi One 150 Вт", day=1), item(14, "Дрель Gorka Novelfi Neo 150 Вт", day=2), item(1, "Дрель Gorka Novelfi One 150 Вт"),
        (None, "Дрель Gorka Novelfi One 150 Вт", None, 1, None, None, "y"),
    ]
    assert pairs(spark, scratch, rows) == {(1, 2), (1, 3), (2, 3), (7, 10), (8, 9)}
    assert pairs(spark, scratch, []) == set()


def test_kinds_that_no_table_names(spark, scratch):
    """Listings of ten kinds of products, most with the series in the name only."""
    rnd = random.Random(5)
    kinds = [("холодильник", "fridge"), ("ноутбук", "laptop"), ("велосипед", "bicycle"), ("кресло", "armchair"), ("аквариум", "fish tank"), ("гитара", "guitar"), ("палатка", "tent"), ("микроскоп", "microscope"), ("самокат", "scooter"), ("наушники", "headphones")]
    noise = ["хит", "новинка", "best price", "оригинал", "для дома", "топ качество", "доставка", ""]
    ends = ["Frost", "Max", "Эко"]
    rows, want, i = [], {}, 0
    for k, words in enumerate(kinds):
        for s in range(6):
            brand, head = rnd.choice([b for b, _ in BRANDS]), f"{rnd.choice('бвгдлмнр')}{rnd.choice('аеиоу')}{chr(97 + k)}{chr(97 + s)}олин"
            series = f"{head} {ends[s % 3]}"
            for power in (100, 200):
                for _ in range(4):
                    i += 1
                    name = [rnd.choice(words), brand if rnd.random() < 0.7 else "", rnd.choice(noise), rnd.choice(noise)]
                    said = {"Бренд": brand}
                    if rnd.random() < 0.4:
                        said["Серия"] = series
                    else:
                        name.append(series)
                    if rnd.random() < 0.2:
                        said["Вес"] = f"{rnd.randint(1, 9)} кг"
                    name.append(f"{power} Вт")
                    rnd.shuffle(name)
                    rows.append((i, " / ".join(x for x in name if x), json.dumps(said, ensure_ascii=False), i % 7, None, f"kind {k}" if rnd.random() < 0.8 else None, "x"))
                    want.setdefault((k, s, power), []).append(i)
    true = {(a, b) for g in want.values() for a in g for b in g if a < b}
    got = pairs(spark, scratch, rows)
    assert len(got & true) >= 0.9 * len(true) and len(got & true) >= 0.98 * len(got)


def test_one_series_of_two_types(spark, scratch):
    rows = [(i, "Gorka Tifetu Pro 80 см", None, i, None, c, "x") for i, c in enumerate(("cables", "belts", "cables", None, "belts"))]
    assert pairs(spark, scratch, rows) == {(0, 2), (1, 4)}


def test_large_group_is_cut_into_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(products, "BLOCK", 7)
    got = pairs(spark, scratch, [item(i, "Дрель Gorka Novelfi One 150 Вт") for i in range(60)])
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60)}


@pytest.mark.parametrize("rows, window", [(34, 12), (34, 3), (200, 12)])
def test_windows_are_the_same_however_the_order_is_cut(spark, scratch, monkeypatch, rows, window):
    monkeypatch.setattr(products, "WINDOW", window)
    shape = "rep long, n long, " + ", ".join(f"{f} {'long' if f in products.KINDS or f == 'pack' else 'string'}" for f in products.FIELDS)
    reps = spark.createDataFrame([(i, 1, "gorka", "novelfi one", "drill", None, None, 1, None, None, None, None, 1000, None) for i in range(rows)], shape).withColumn("t", products.tokens())
    want = {(i, j) for i in range(rows) for j in range(i + 1, min(rows, i + window + 1))}
    for parts in (1, 2, 4, 17):
        monkeypatch.setattr(products, "parallelism", lambda _, parts=parts: parts)
        got = products.neighbours(reps, F.lpad(F.col("rep").cast("string"), 20, "0"), scratch).collect()
        assert {(r["u"], r["v"]) for r in got} == want, parts


def test_pivots_do_not_chain(spark, scratch):
    # 1 - 2 - 3 - 4 in a row: the pivot with most members takes its neighbours only
    edges = spark.createDataFrame([(1, 2, 5.0, 1, 9), (2, 3, 5.0, 9, 1), (3, 4, 5.0, 1, 1)], "u long, v long, score double, nu long, nv long")
    got = {r["rep"]: r["centre"] for r in products.pivots(edges, scratch).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: 2, 2: 2, 3: 2} and got.get(4, 4) == 4
    assert products.pivots(edges.limit(0), scratch).count() == 0


def test_agreement_of_tokens():
    def t(**k):
        return [str(k.get(f, "")) for f in products.FIELDS]

    a = t(brand="gorka", series="novelfi one", type="дрель", power=150)
    assert products.agree(a, t(brand="gorka", series="novelfi one", type="дрель", power=147)) >= products.LEAST_SCORE
    assert products.agree(a, t(brand="gorka", series="novelfi one", type="дрель", power=170)) < 0
    assert products.agree(a, t(brand="gorka", series="noveelfi one", type="дрель", power=150)) > 0
    assert products.agree(a, t(brand="gorka", series="novelfi pro", type="дрель", power=150)) < 0
