"""Characters that look alike: one plain form for text from many keyboards.

Everything here is deterministic and needs no corpus. ``plain`` is the shared
normaliser (full-width forms, separate accents, invisible characters, spaces
and look-alike letters inside a run of letters); ``skeleton`` is a comparison
key that ignores alphabet and case altogether.
"""

from __future__ import annotations

import re
import sys
import unicodedata

# Letters of Latin, Cyrillic and Greek with the same shape.
LATIN = "ABCEËHKMOPTXYaceëopxyk"
CYRILLIC = "АВСЕЁНКМОРТХУасеёорхук"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονκ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXovk"

TO_LATIN = dict(zip(CYRILLIC, LATIN)) | dict(zip(GREEK, GREEK_AS_LATIN))
TO_CYRILLIC = dict(zip(LATIN, CYRILLIC))
TO_CYRILLIC |= {g: TO_CYRILLIC[a] for g, a in zip(GREEK, GREEK_AS_LATIN) if a in TO_CYRILLIC}
TO_GREEK = {a: g for g, a in zip(GREEK, GREEK_AS_LATIN)}
TO_GREEK |= {c: TO_GREEK[a] for c, a in zip(CYRILLIC, LATIN) if a in TO_GREEK}
TO = {"L": TO_LATIN, "C": TO_CYRILLIC, "G": TO_GREEK}


def _tables() -> tuple[dict[int, str | None], str, str]:
    invisible, spaces = [], []
    for o in range(0x80, 0x3001):
        kind = unicodedata.category(chr(o))
        if kind == "Cf":
            invisible.append(o)
        elif kind == "Zs":
            spaces.append(o)
    invisible += [0xFEFF]
    table: dict[int, str | None] = {o: None for o in invisible}
    table |= {o: " " for o in spaces}
    table |= {o: chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F)}
    return table, "".join(map(chr, invisible)), "".join(map(chr, spaces))


#: str.translate table; the invisible (format) characters; spaces other than U+0020.
FOLD, INVISIBLE, SPACES = _tables()
#: Escaped code units in JSON text, also in JSON text quoted once more.
ESCAPE = re.compile(r"\\+u([0-9a-fA-F]{4})")
CONTROL = re.compile(r"\\+[nrtbf]")
RUN = re.compile(r"[^\W\d_]+")
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Two neighbouring letters of different alphabets; cheap test for a mixed run.
MIXED = re.compile(f"[{_LETTER}][Ͱ-ϿЀ-ԯ]|[Ѐ-ԯ][{_LETTER}Ͱ-Ͽ]|[Ͱ-Ͽ][{_LETTER}Ѐ-ԯ]")


def script(ch: str) -> str:
    """L, C or G: the alphabet of a letter."""
    o = ord(ch)
    return "C" if 0x400 <= o <= 0x52F else "G" if 0x370 <= o <= 0x3FF else "L"


def dominant(run: str) -> str:
    """The alphabet a mixed run was meant in: the one whose letters have no
    twin elsewhere in the run's other alphabets, else the most frequent one; of
    equally frequent ones Cyrillic before Latin before Greek."""
    seen: dict[str, int] = {}
    for ch in run:
        s = script(ch)
        seen[s] = seen.get(s, 0) + 1
    best, key = "L", (-1, -1, -1)
    for s, n in seen.items():
        others = [TO[o] for o in seen if o != s]
        anchors = sum(script(ch) == s and not any(ch in t for t in others) for ch in run)
        if (k := (anchors, n, "GLC".index(s))) > key:
            best, key = s, k
    return best


def repaired_run(run: str) -> str:
    """The run with its look-alike letters in its dominant alphabet."""
    to = TO[dominant(run)]
    return "".join(to.get(ch, ch) for ch in run)


def _repair(m: re.Match) -> str:
    run = m.group(0)
    return repaired_run(run) if MIXED.search(run) else run


#: Any character that folding may change.
ODD = re.compile("[" + "".join(re.escape(chr(o)) for o in FOLD) + "̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯]")


def unescape(text: str) -> str:
    """Text with its JSON code unit escapes decoded; in JSON text, escaped
    control characters are spaces."""
    if "\\" not in text:
        return text
    out = ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), text)
    if out.lstrip()[:1] in ("{", "[", '"'):
        out = CONTROL.sub(" ", out)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in out) else out


def fold(text: str) -> str:
    """Full-width forms, separate accents, invisible characters and spaces."""
    if text.isascii() or not ODD.search(text):
        return text
    text = text.translate(FOLD)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def plain(text: str) -> str:
    """One consistent form of the text; legitimate text stays as it is."""
    if text.isascii():
        return text
    text = fold(text)
    return RUN.sub(_repair, text) if MIXED.search(text) else text


_SKELETON = {ord(c): a for c, a in zip(CYRILLIC + GREEK, LATIN + GREEK_AS_LATIN) if c.isupper()}


def skeleton(text: str) -> str:
    """Comparison key: upper case, no alphabet, no white space."""
    return "".join(fold(text).upper().translate(_SKELETON).split())


assert sys.maxunicode > 0xFFFF
