import random

import pytest
from pyspark.sql import functions as F

from mergewright.llm import components as C
from mergewright.llm import splits as S

from .conftest import union_find

MATCHES = "pair_id long, id1 long, id2 long, target float, category string"


def groups(spark, scratch, rows):
    df = spark.createDataFrame(rows, MATCHES)
    return {r["id"]: r["group_id"] for r in C.connected_groups(C.links(df), scratch).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, scratch, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(1, 60), rnd.randint(1, 60), rnd.choice([0.0, 0.4, 0.5, 0.9]), "c") for i in range(50)]
    assert groups(spark, scratch, rows) == union_find([(a, b) for _, a, b, t, _ in rows if t >= 0.5 and a != b])


def test_chain_star_and_threshold(spark, scratch):
    rows = [(i, i, i + 1, 1.0, "c") for i in range(100, 140)]  # a chain
    rows += [(1000 + i, 5000, 6000 + i, 0.5, None) for i in range(300)]  # a star
    rows += [(2000, 1, 2, 0.49, "c"), (2001, None, 3, 1.0, "c"), (2002, 3, None, 1.0, "c"), (2003, 4, 4, 1.0, "c"), (2004, 7, 8, None, "c"), (2005, 9, 10, 1.0, ""), (2006, 10, 9, 1.0, ""), (2006, 10, 9, 1.0, "")]
    got = groups(spark, scratch, rows)
    assert got == {**{i: 100 for i in range(100, 141)}, 5000: 5000, **{6000 + i: 5000 for i in range(300)}, 9: 9, 10: 9}


def test_empty(spark, scratch):
    assert groups(spark, scratch, []) == {}
    assert groups(spark, scratch, [(1, 1, 1, 1.0, "c")]) == {}


def test_hot_vertex_is_split_and_right(spark, scratch, monkeypatch):
    from mergewright.operators import skew

    rows = [(i, 1, i, 1.0, "c") for i in range(2, 400)]
    edges = C.links(spark.createDataFrame(rows, MATCHES))
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    arcs = edges.select(F.explode(F.array("u", "v")).alias("src"))
    assert skew.hot_keys(arcs, "src", 0.1, 10) == [1]
    got = {r["vertex"]: r["cluster"] for r in C.decompose(edges, 0, [1], scratch).collect()}
    assert got == {r["vertex"]: r["cluster"] for r in C.decompose(edges, 0, [], scratch).collect()}


def test_clusters_have_low_diameter(spark, scratch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    clusters: dict = {}
    for r in C.decompose(edges, 0, [], scratch).collect():
        clusters.setdefault(r["cluster"], []).append(r["vertex"])
    for c, vs in clusters.items():
        assert c in vs and max(vs) - min(vs) <= 2 * C.ROUNDS and sorted(vs) == list(range(min(vs), max(vs) + 1))


def test_forest(spark, scratch):
    rnd = random.Random(5)
    links = sorted({(min(a, b), max(a, b)) for a, b in ((rnd.randint(1, 40), rnd.randint(1, 40)) for _ in range(60)) if a != b})
    f = S.spanning_forest(spark.createDataFrame(links, "u long, v long"), scratch)
    want = union_find(links)
    assert {r["id"]: r["bundle_id"] for r in f.roots.collect()} == want
    chosen = [(r["u"], r["v"]) for r in f.edges.collect()]
    assert set(chosen) <= set(links) and len(chosen) == len(want) - len(set(want.values()))
    assert union_find(chosen) == want


def test_bundles_with_nulls(spark, scratch):
    rows = [(1, 10, 11, 0.0, "a"), (2, 11, None, None, None), (3, None, 12, 1.0, "b"), (4, None, None, 1.0, "b"), (5, 13, 13, 1.0, "b"), (6, 12, 14, 0.0, "b"), (6, 12, 14, 0.0, "b"), (None, 10, 14, 1.0, "b")]
    got = {r["pair_id"]: r["bundle_id"] for r in S.bundles(spark.createDataFrame(rows, MATCHES), scratch).collect()}
    assert got == {1: 10, 2: 10, 3: 12, 4: None, 5: 13, 6: 12}


def test_splits_keep_bundles_and_shares(spark, scratch):
    rnd = random.Random(9)
    rows = [(i, rnd.randint(1, 700) * 2, rnd.randint(1, 700) * 2 + 1, 1.0, rnd.choice(["a", "b", None])) for i in range(600)]
    rows += [(1000 + i, 90_001, 90_002 + i, 0.0, "a") for i in range(120)]
    targets = spark.createDataFrame([("train", 0.8), ("tune", 0.1), ("eval", 0.1), (None, 0.5), ("none", 0.0)], "split_name string, target_share double")
    got = S.assign(spark.createDataFrame(rows, MATCHES), targets, scratch).collect()
    assert len(got) == 720
    of = {}
    for r in got:
        assert of.setdefault(r["bundle_id"], r["split_name"]) == r["split_name"]
    for s, share in (("train", 0.8), ("tune", 0.1), ("eval", 0.1)):
        assert abs(sum(r["split_name"] == s for r in got) / 720 - share) < 0.06
    again = S.assign(spark.createDataFrame(rows[::-1], MATCHES), targets, scratch)
    assert {(r["pair_id"], r["split_name"]) for r in again.collect()} == {(r["pair_id"], r["split_name"]) for r in got}
    assert S.report(again, targets).where("category = 'all'").count() == 3


def test_splits_of_nothing(spark, scratch):
    targets = spark.createDataFrame([("train", 1.0)], "split_name string, target_share double")
    assert S.assign(spark.createDataFrame([], MATCHES), targets, scratch).count() == 0
    one = spark.createDataFrame([(1, 1, 2, 1.0, "a")], MATCHES)
    assert S.assign(one, targets.limit(0), scratch).first()["split_name"] is None
