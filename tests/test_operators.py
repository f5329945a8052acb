import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergewright.functions import text as X
from mergewright.functions.mask import masked, secrets
from mergewright.functions.scores import keyed_hash
from mergewright.operators import checks as V
from mergewright.operators import frames as R
from mergewright.operators import graph as G
from mergewright.operators import joins as J
from mergewright.operators import metrics as M
from mergewright.operators import sampling as P
from mergewright.operators import scoring, skew, soup
from mergewright.session import Scratch
from mergewright.sources import io


def brute_ap(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    n_pos = sum(y for _, y in rows)
    out = tp = n = 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        group = [y for t, y in rows if t == s]
        n += len(group)
        tp += sum(group)
        out += sum(group) / n_pos * tp / n
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1)), min_size=2, max_size=30))
def test_average_precision(spark, rows):
    df = spark.createDataFrame([("a", float(s), y) for s, y in rows], "cat string, s double, y int")
    got = M.average_precision(df, ["cat"], "s", "y").first()
    if 0 < sum(y for _, y in rows) < len(rows):
        assert got["ap"] == pytest.approx(brute_ap(rows)) and 0 <= got["ap"] <= 1
        assert M.average_precision(df.withColumn("s", F.exp("s")), ["cat"], "s", "y").first()["ap"] == pytest.approx(got["ap"])
    else:
        assert got["ap"] is None


def test_single_class_groups(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("b", 0.2, 1)], "cat string, s double, y int")
    per = M.average_precision(df, ["cat"], "s", "y")
    assert M.macro_ap(per).first()[0] == 0.0
    assert M.macro_ap(per, guarded=False).first()[0] == 0.5
    assert M.macro_ap(per.limit(0)).first()[0] == 0.0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 15), st.integers(1, 15)), min_size=1, max_size=20), st.randoms())
def test_components(spark, edges, rnd):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    rnd.shuffle(edges)
    got = {r["id"]: r["component"] for r in G.components(spark.createDataFrame(edges, "id1 long, id2 long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_chain_nulls_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(None, 3), (7, None), (99, 99)]
    got = {r["id"]: r["component"] for r in G.components(spark.createDataFrame(chain, "id1 long, id2 long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99}
    assert G.components(spark.createDataFrame([], "id1 long, id2 long")).count() == 0


def test_disjoint_guard(spark):
    a = spark.createDataFrame([(1,)], "component long")
    G.assert_disjoint(a, spark.createDataFrame([(2,)], "component long"))
    with pytest.raises(ValueError):
        G.assert_disjoint(a, a)


def test_pair_join_policies(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (999, 3), (1, 2), (2, 2)], "id1 long, id2 long")
    texts = spark.createDataFrame([(1, "normal-a"), (2, ""), (3, "normal-b")], "id long, text string")
    kept = sorted((r["text1"], r["text2"]) for r in J.pair_texts(pairs, texts).collect())
    assert kept == sorted([("normal-a", ""), ("", "normal-b"), ("", "normal-b"), ("normal-a", ""), ("", "")])
    assert J.pair_texts(pairs, texts, "drop").count() == 0
    assert tuple(J.missing_counts(J.pair_texts(pairs, texts)).first()) == (5, 1, 5)
    with pytest.raises(J.MissingError):
        J.pair_texts(pairs, texts, "error")


def test_strict_lookups(spark):
    pairs = spark.createDataFrame([(1, 2)], "id1 long, id2 long")
    with pytest.raises(J.MissingError):
        J.with_category(pairs, spark.createDataFrame([(5, "x")], "id long, category string"), None)
    t = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(J.MissingError):
        J.tiered_lookup(J.ids_of(pairs), [J.Tier(t, 0)], strict=True)
    human = spark.createDataFrame([(1, "h"), (1, "g")], "id long, text string")
    got = {tuple(r) for r in J.tiered_lookup(J.ids_of(pairs), [J.Tier(t, 1), J.Tier(human, 0)]).collect()}
    assert got == {(1, "g", 0)}


def test_hot_join_equals_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(i, 0) for i in range(2, 40)] + [(None, 7)], "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in range(1, 30)], "k long, w long")
    assert skew.hot_keys(left, "k", 0.1, 100) == [1]
    for how in ("inner", "left"):
        got = sorted(map(repr, skew.hot_split_join(left, right, "k", how, [1]).collect()))
        assert got == sorted(map(repr, left.join(right, "k", how).collect()))


def test_samples_are_exact_and_keyed(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, g long")
    a = {r["id"] for r in P.sample_per_group(df, ["g"], 10, 1, "id").collect()}
    assert a == {r["id"] for r in P.sample_per_group(df.repartition(7), ["g"], 10, 1, "id").collect()} and len(a) == 30
    assert a != {r["id"] for r in P.sample_per_group(df, ["g"], 10, 2, "id").collect()}


def test_positions_are_dense(spark):
    df = spark.createDataFrame([(i,) for i in range(501)], "id long")
    got = P.numbered(df, [keyed_hash("s", F.col("id")), F.col("id")]).collect()
    assert sorted(r["position"] for r in got) == list(range(501))
    assert P.batches(df, [F.col("id")], 100, drop_last=True).count() == 500


def test_interleaving_takes_one_per_group_and_round(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(9)], "id long, c string")
    got = P.interleaved(df, "c", 2, 0, "id").collect()
    assert len(got) == 18 and len({(r["epoch"], r["round"], r["c"]) for r in got}) == 18


TEXTS = [
    ("Шампунь 0,5 л, набор из 2", '{"Бренд": "X", "Объем": "500 мл", "ё": "ё"}'),
    (None, None), ("", "{}"), ("a", "[1]"), ("a", "1"), ("a", "x"), ("х2 10×20 3 упаковки по 4", '{"Ключ": {"a": 1}}'),
    ("1001 шт", '{"тип": "б", "ТИП": "в", "код": "г"}'), ("Moдель Лoфт", '{"x": "128 GB"}'), ("\x1cа б", '{"цвет": "", "вес": null, "n": false}'), ("６ кг ５ шт", "{}"),
    (" ".join(f"{i} мм" for i in range(1, 20)), None), ("т" * 3000, '{"a": "' + "б" * 900 + '"}'),
]


@pytest.mark.parametrize("version", ["v1", "v2"])
def test_text_contract(spark, version):
    df = spark.createDataFrame(TEXTS, "name string, attributes string").coalesce(1)
    got = df.select(X.pair_text(F.col("name"), F.col("attributes"), version).alias("a"), X.pair_text_exact(version)("name", "attributes").alias("b")).collect()
    for i, r in enumerate(got):
        if i != 6:  # nested values print as JSON natively, as Python exactly
            assert r["a"] == r["b"], TEXTS[i]
    assert "ед: 500ml" in got[0]["a"] and "кол-во: 2" in got[0]["a"] and all(len(r["a"]) <= 2000 for r in got)
    assert "кол-во: 12" in got[6]["a"] and "кол-во" not in got[7]["a"]


def test_contracts_differ_in_order(spark):
    df = spark.createDataFrame([("n", '{"бренд": "Б", "размер": "Р"}')], "n string, a string")
    one, two = df.select(X.pair_text(F.col("n"), F.col("a"), "v1"), X.pair_text(F.col("n"), F.col("a"), "v2")).first()
    assert one == "n | бренд:Б ; размер:Р" and two == "n | размер:Р ; бренд:Б"


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 999_999), st.integers(-9, 9)), min_size=1, max_size=20))
def test_general_number(spark, parts):
    xs = [float(f"{m}e{e}") for m, e in parts]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", X.general_number(F.col("x")).alias("g")).collect()
    assert all(r["g"] == f"{r['x']:g}" for r in got)


def test_frames(spark):
    df = spark.createDataFrame([(1, 2, "c", 1.0, 0.0, "llm_hard")], "id1 long, id2 long, category string, target double, teacher double, source string")
    h, r, g = R.human_rows(df).first(), R.replay_rows(df).first(), R.grey_rows(df).first()
    assert h["label_weight"] == pytest.approx(5.498, abs=1e-3) and h["source"] == "human" and h["teacher_prob"] == pytest.approx(0.001)
    assert r["label_weight"] == 1.5 and g["gray_distill_weight"] == 1.0
    assert R.train_frame(R.human_rows(df), R.grey_rows(df)).columns == list(R.TRAIN_COLUMNS)


def test_soup_refuses_missing_parameters(spark):
    shape = "param string, shape array<int>, values array<double>"
    a = spark.createDataFrame([("w", [1], [1.0])], shape)
    with pytest.raises(J.MissingError):
        soup.soup(a, spark.createDataFrame([("v", [1], [1.0])], shape), 0.5)
    assert soup.soup(a, spark.createDataFrame([("w", [1], [3.0])], shape), 0.25).first()["values"] == [2.5]


def test_scorer_is_symmetric_and_equals_the_column(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices("abcde", k=rnd.randint(0, 6))), " ".join(rnd.choices("abcde", k=rnd.randint(0, 6)))) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, text1 string, text2 string")
    got = {r["i"]: r["predict"] for r in scoring.score_pairs(df, scoring.TokenJaccard, both_ways=True, buckets=3, batch=7).collect()}
    want = {r["i"]: r["p"] for r in df.select("i", scoring.token_jaccard(F.col("text1"), F.col("text2")).alias("p")).collect()}
    assert got == pytest.approx(want)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(10)], "i long")
    assert io.write_csv(df, str(tmp_path / "a"), 10, F.col("i"), single=True) == 10
    with pytest.raises(io.CountError):
        io.write_csv(df, str(tmp_path / "b"), 11)
    io.append_events(spark.createDataFrame([("e", i) for i in range(30)], "event string, step int"), str(tmp_path / "ev"))
    assert [r["step"] for r in io.last_events(spark, str(tmp_path / "ev"), "e", "step", 2).collect()] == [29, 28]
    io.json_document([{"a": "б"}], str(tmp_path / "m.json"))
    assert io.read_document(spark, str(tmp_path / "m.json")).first()["a"] == "б"
    assert io.needed(df, df.limit(0).withColumnRenamed("i", "i"), "i").count() == 0


def test_checks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.pt").write_text("w")
    files = io.listing(spark, str(tmp_path))
    assert [r["detail"] for r in V.required(files, ["a.json", "c.json"]).collect()] == ["c.json"]
    assert V.forbidden(files, [".pt"]).count() == 1
    m = V.manifest(files)
    assert V.passed(V.manifest_mismatch(files, m)) and not V.passed(V.manifest_mismatch(files, m.where("name = 'b.pt'")))
    lines = spark.createDataFrame([('{"a": 1}',), ("{",), ("",)], "value string")
    assert V.malformed_json(lines).count() == 1
    texts = spark.createDataFrame([("p", "token = 'abcdefgh1234'"), ("q", "```\nx")], "path string, value string")
    assert V.leaked_secrets(texts).count() == 1 and V.unbalanced_fences(texts).count() == 1
    bad = spark.createDataFrame([(1, 2, 0.5), (None, 2, 0.5), (1, 2, 1.5)], "id1 long, id2 long, predict double")
    assert V.data_contract(bad).count() == 2 and V.empty(spark).isEmpty()
    assert texts.select(F.size(secrets(F.col("value"))).alias("n")).agg(F.sum("n")).first()[0] == 1
    assert spark.range(1).select(masked(F.lit("/home/me/x"), ["/home/me"])).first()[0] == "***/x"


def test_scratch_lives_below_the_shared_folder(spark):
    s = Scratch(spark, "t")
    df = s.save(spark.range(3), "r")
    assert s.root.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 3
    s.drop(df)


def test_salted_join_is_a_join(spark):
    from mergewright.operators.skew import salted_join

    left = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7), (None, 8), (3, 9)], "k long, x long")
    right = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 1), (2, 2), (None, 3)], "k long, y long")
    want = {tuple(r) for r in left.join(right, "k").collect()}
    got = salted_join(left, right, "k", rows=100).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert salted_join(left.limit(0), right, "k").count() == 0


def test_masked_json_stays_json(spark):
    import json

    from mergewright.functions.mask import masked_json

    inner = json.dumps({"path": "/home/a", "n": 69})
    rows = [(1, '{"home": 69, "a": ["/home/b", {"c": "x /home/d"}], "t": null}'), (2, json.dumps({"k": inner})), (3, "see /home/a"), (4, None), (5, '{"cut": "/home'), (6, "")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "id int, t string").select("id", masked_json(F.col("t"), "/home/[a-z]+")).collect()}
    assert json.loads(got[1]) == {"home": 69, "a": ["***", {"c": "x ***"}], "t": None}
    assert json.loads(json.loads(got[2])["k"]) == {"path": "***", "n": 69}
    assert got[3] == "see ***" and got[4] is None and got[5] == '{"cut": "/home' and got[6] == ""


def test_credentials_and_python(spark):
    t = [("a", "x AKIA" + "A" * 16), ("b", "github_pat_" + "a1_" * 8), ("c", "hf_" + "b" * 20), ("d", "sk-" + "c" * 24), ("e", "sk-short"), ("f", None)]
    files = spark.createDataFrame(t, "path string, value string")
    assert sorted(r["detail"][-1] for r in V.leaked_secrets(files).collect()) == ["a", "b", "c", "d"]
    code = spark.createDataFrame([("ok.py", "def f():\n    return 1\n"), ("bad.py", "def f(:\n"), ("none.py", None)], "path string, value string")
    assert [r["detail"].split(":")[0] for r in V.python_errors(code).collect()] == ["bad.py"]
    fences = spark.createDataFrame([("a", "x ``` y"), ("b", "```\ncode\n```")], "path string, value string")
    assert [r["detail"] for r in V.unbalanced_fences(fences).collect()] == ["a"]
