import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mergewright.llm import mixing, tokens
from mergewright.llm.lexicon import Lexicon, compile_lexicon

tiktoken = pytest.importorskip("tiktoken")


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 60_000), max_size=4), max_size=60))
def test_lexicon(words):
    lex = Lexicon(compile_lexicon(sorted(words.items())))
    assert lex.words == len(words)
    for w, ids in words.items():
        assert lex.get(w) == ids
        assert lex.get(w + b"\x00\x01") == words.get(w + b"\x00\x01")
    assert lex.get(b"") == words.get(b"")


def test_lexicon_shares_endings(tmp_path):
    words = sorted(a + b"ing" for a in (b"sing", b"ring", b"bring", b"walk", b"talk"))
    data = compile_lexicon((w, [i]) for i, w in enumerate(words))
    (tmp_path / "l").write_bytes(data)
    lex = Lexicon.open(str(tmp_path / "l"))
    assert [lex.get(w) for w in words] == [[i] for i in range(5)] and lex.get(b"sin") is None
    assert len(lex.first) - 1 < sum(map(len, words))
    with pytest.raises(ValueError):
        compile_lexicon([(b"b", []), (b"a", [])])


TEXTS = ["", None, " ", "\n\n x", "Привет, мир! 123", "a b\x1cc", "<|endoftext|>", "é" * 50, "x" * 5000, " " * 300, "🔥✅ don't", "Ａ１ ", "日本語テキスト", "word " * 2000]


@pytest.mark.parametrize("words", [0, 5, 50_000])
def test_ids_equal_the_tokenizer(spark, words):
    enc = tokens._merger(tokens.TOKENIZERS, "byte_bpe_50k")
    rows = [(i, t, "ids") for i, t in enumerate(TEXTS * 3)] + [(None, "null id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode(df, words=words).collect()
    assert len(got) == len(rows)
    want = sorted((repr(i), enc.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == want


def test_ids_equal_the_other_library():
    lib = pytest.importorskip("tokenizers")
    t = lib.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    e = tokens.Encoder(None, tokens.TOKENIZERS, "byte_bpe_50k")
    for x in TEXTS:
        if x:
            assert e(x) == t.encode(x, add_special_tokens=False).ids, x


def test_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


DOCS, TARGETS = "doc_id long, source string, text string, n_tokens string", "source string, target_share double, max_repeats int"


def test_mix_meets_shares_and_caps(spark):
    rnd = random.Random(2)
    rows = [(i, "big" if i % 10 else "small", "слово " * rnd.randint(1, 30), "x") for i in range(2000)]
    rows += [(10_000 + i, None, "a b", "x") for i in range(10)] + [(20_000 + i, "untold", "a b", "x") for i in range(10)]
    rows += [(30_000, "big", None, "x"), (30_001, "big", "", "x"), (None, "big", "a b c", "x")]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("empty", 0.0, 1), (None, 1.0, 1)], TARGETS)
    chosen, report = mixing.mix(spark.createDataFrame(rows, DOCS), targets)
    shares = {r["source"]: r for r in report.collect()}
    assert abs(shares["big"]["actual_share"] - 0.6) < 0.01 and abs(shares["small"]["actual_share"] - 0.4) < 0.01
    got = chosen.collect()
    assert {r["source"] for r in got} == {"big", "small"}
    assert max(r["repeats"] for r in got if r["source"] == "big") == 1 and max(r["repeats"] for r in got if r["source"] == "small") == 3
    half, _ = mixing.mix(spark.createDataFrame(rows, DOCS), targets, total=2000)
    most = {r["doc_id"] for r in got if r["source"] == "big"}
    assert {r["doc_id"] for r in half.collect() if r["source"] == "big"} <= most  # nested


def test_thresholds_against_sorting(spark):
    rnd = random.Random(4)
    rows = [("a", rnd.randrange(2**60), rnd.randint(1, 9)) for _ in range(300)] + [("b", 5, 10)] * 3
    df = spark.createDataFrame(rows, "source string, h long, n_tokens long")
    for rest in (0.0, 1.0, 100.5, 700.0, 1e9):
        t = mixing.thresholds(df, {"a": rest})["a"]
        taken = sum(n for s, h, n in rows if s == "a" and h < t)
        nearest, run = 0, 0
        for _, h, n in sorted(r for r in rows if r[0] == "a"):
            run += n
            if abs(run - rest) < abs(nearest - rest):
                nearest = run
        assert abs(taken - rest) <= abs(nearest - rest) + 1e-9
    assert mixing.thresholds(df, {"b": 16.0})["b"] in (0, 6)


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    docs = spark.createDataFrame([], DOCS)
    chosen, report = mixing.mix(docs, targets)
    assert chosen.count() == 0 and report.first()["actual_share"] == 0.0
    chosen, report = mixing.mix(docs, targets.limit(0))
    assert chosen.count() == 0 and report.count() == 0
