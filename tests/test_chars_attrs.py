from hypothesis import given
from hypothesis import strategies as st

from mergewright.functions import chars
from mergewright.functions.attrs import entries


def test_plain():
    assert chars.plain("ａｂＣ１２") == "abC12"
    assert chars.plain("до\u200bм\u00adа\ufeff") == "дома"
    assert chars.plain("и\u0306од e\u0301") == "йод \u00e9"
    assert chars.plain("a\u00a0b\u2009c\u3000d") == "a b c d"
    assert chars.plain("флoy Moдeль SЕNМАR") == "флоу Модель SENMAR"


def test_legitimate_text_is_unchanged():
    for t in ("3D-эффект № 5 ® ° ² ³ × · ₽ ″ — −", "USB-кабель", "Élavie Köhlmar Señalo", "🔥 ✅", "Wi-Fi роутер", ""):
        assert chars.plain(t) == t


@given(st.text())
def test_plain_is_stable(t):
    once = chars.plain(t)
    assert chars.plain(once) == once


def test_unescape():
    assert chars.unescape('{"\\u0430": "\\u0431\\nв"}') == '{"а": "б в"}'
    assert chars.unescape('"{\\"\\\\u0430\\""') == '"{\\"а\\""' and chars.unescape("C:\\new") == "C:\\new"
    assert chars.unescape("\\ud83d\\udd25") == "🔥"


def test_skeleton_ignores_alphabet_case_and_space():
    assert chars.skeleton("Страна  производства") == chars.skeleton("СТPAHA пpoизвoдcтва")
    assert chars.skeleton("год") != chars.skeleton("год.")


def test_entries_arrangements():
    want = [("a", "1"), ("b", "x")]
    for t in (
        '{"a": "1", "b": "x"}',
        '[{"name": "a", "value": "1"}, {"name": "b", "value": "x"}]',
        '[{"attr": "a", "val": "1"}, {"attr": "b", "val": "x"}]',
        '{"a": "1", "group": {"b": "x"}}',
        '"{\\"a\\": \\"1\\", \\"b\\": \\"x\\"}"',
        '{"a": ["1"], "b": "x"}',
        "a: 1; b: x",
    ):
        assert entries(t) == want, t
    assert entries('{"a": 1, "a": 2}') == [("a", 1), ("a", 2)]


def test_entries_of_unreadable_text():
    for t in (None, "", "  ", "нет", "null", "[]", "[1, 2]", "0", '{"a": "x', '[{"name": "a", "value": "x', '""', '{"a": {"b": "x'):
        assert entries(t) == [], t


@given(st.text(max_size=60))
def test_entries_never_fails(t):
    entries(t)
    entries('{"' + t)


def test_entries_at_any_depth_and_quoting():
    import json

    deep = {"b": "x"}
    for _ in range(60):
        deep = {"group": deep}
    assert entries(json.dumps(deep)) == [("b", "x")]
    text = '{"a": "1"}'
    for _ in range(6):
        text = json.dumps(text)
    assert entries(text) == [("a", "1")]
