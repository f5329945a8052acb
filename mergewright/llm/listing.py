"""What a listing says of its product: brand, series, varying features and words.

Readers turn name and attributes into typed tokens in one consistent form. What
kinds of products and which series there are is in no table: a listing states its
series under a key, or ``products`` learns it from the words of all listings,
which come out here. The tables below hold general words only (colours, and the
names that catalogues give to these keys); brands come from the table of brands.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from ..functions import chars
from ..functions.attrs import entries
from ..operators import quantities as q
from ..operators.eav import read_string
from .overlap import within_one_slip

# Colours by the beginnings of their names.
_COLOURS = """
white: бел white
black: черн black
red: красн red
blue: син blue
green: зел green
yellow: желт yellow
orange: оранж orange
pink: роз pink
purple: фиолет purple
grey: сер grey gray
brown: корич brown
beige: беж beige
"""
# Keys of attributes, in lower case without closing colon.
_BRAND_KEYS = "бренд | brand | торговая марка | производитель | марка | manufacturer"
_SERIES_KEYS = "серия | линейка | модель | название модели | model | series"
_COLOUR_KEYS = "цвет | цвет товара | color | colour"
_SIZE_KEYS = "размер | размер товара | российский размер | size"
_PACK_KEYS = "количество в упаковке | кол-во в упаковке | штук в упаковке | pack quantity"


def _keys(text: str) -> frozenset[str]:
    return frozenset(chars.skeleton(k) for k in text.split("|"))


_ACCENTED = re.compile("[à-ɏ]")


def bare(text: str) -> str:
    """Lower case without accents; Cyrillic letters keep theirs but for ё."""
    low = text.lower().replace("ё", "е")
    return _ACCENTED.sub(lambda m: unicodedata.normalize("NFD", m.group(0))[0], low) if _ACCENTED.search(low) else low


_COLOUR_OF = [(p, c) for c, ps in (x.split(":") for x in _COLOURS.strip().splitlines()) for p in ps.split()]
_COLOUR = re.compile(r"(?:" + "|".join(p + (r"(?:ен|ов|ев|нев)?(?:ый|ий|ая|яя|ое|ее|ые|ие)?" if p[0] > "z" else "") for p, _ in _COLOUR_OF) + ")")
# Full names of the colours.
_COLOUR_WORDS = "белый черный красный синий зеленый желтый оранжевый розовый фиолетовый серый коричневый бежевый white black green yellow orange purple brown beige".split()
_SIZE_NAME = re.compile(r"(?<![^\W_])(?:р\.|р-р|размер|size)\s?(\d{2}(?:[.,]\d)?|x{0,3}[sl]|m)(?![^\W_])|(?<![\w.,])(\d{2}(?:[.,]\d)?|x{0,3}[sl]|m) (?:размер|size)(?![^\W_])")
_SIZE_VALUE = re.compile(r"(\d{2}(?:[.,]\d)?|x{0,3}[sl]|m)", re.I)
_PACK_NAME = re.compile(r"(?<![^\W_])(?:из|of|набор|упаковка|set|pack)\s(\d{1,3})(?!\d|[.,]\d)|(?<![^\W_])[xх]\s?(\d{1,3})(?!\d)|(?<![\w.,])(\d{1,3})\s?(?:шт|pcs|pieces)(?:ук[аи]?|\.)?(?![^\W_])")
_COUNT = re.compile(r"(\d{1,4})(?:[.,]0+)?(?:шт\.?|штук[аи]?|pcs|pieces)?", re.I)
_WORD = re.compile(r"[^\W_]+")
#: Words, and what parts them more than a space does.
_PIECE = re.compile(r"[^\W_]+|[,;/|()]| [-–—] ")
_KEY_GROUPS = {k: g for g, keys in (("brand", _BRAND_KEYS), ("series", _SERIES_KEYS), ("colour", _COLOUR_KEYS), ("size", _SIZE_KEYS), ("pack", _PACK_KEYS)) for k in _keys(keys)}


@dataclass(frozen=True)
class Brands:
    """Spellings of brands as words, by their first word, to the standard one.

    Looking a brand up costs the same however many there are.
    """

    known: dict[str, str]
    starts: dict[str, list[tuple[str, ...]]]

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]]) -> Brands:
        from .lookalike import disguised_brands

        known: dict[str, str] = {}
        for brand, other in sorted(rows, key=lambda r: (r[0] or "", r[1] or "")):
            if brand and words_of(brand):
                for s in (brand, other):
                    if s and words_of(s):
                        known.setdefault(" ".join(words_of(s)), " ".join(words_of(brand)))
        for spelled, brand in disguised_brands([b for b, _ in rows if b]).items():
            known.setdefault(" ".join(words_of(spelled)), " ".join(words_of(brand)))
        starts: dict[str, list[tuple[str, ...]]] = {}
        for s in known:
            starts.setdefault(s.split()[0], []).append(tuple(s.split()))
        for forms in starts.values():
            forms.sort(key=len, reverse=True)
        return cls(known, starts)

    def at(self, words: list[str], i: int) -> int:
        """Words of the longest brand that starts at a place, 0 for none."""
        for form in self.starts.get(words[i], ()):
            if len(form) == 1 or tuple(words[i : i + len(form)]) == form:
                return len(form)
        return 0


def words_of(text: str) -> list[str]:
    """Words and numbers of a text in bare form."""
    return _WORD.findall(bare(chars.plain(text)))


def colour_of(word: str) -> str | None:
    m = _COLOUR.fullmatch(word)
    return next((c for p, c in _COLOUR_OF if word.startswith(p)), None) if m else None


def _near_colour(word: str) -> str | None:
    """A colour that the word is one slip away from."""
    if len(word) < 5:
        return None
    return next((colour_of(c) for c in _COLOUR_WORDS if abs(len(c) - len(word)) < 2 and (c[0] == word[0] or c[-1] == word[-1]) and within_one_slip(c, word)), None)


class Reader:
    """Reads listings; remembers what words, keys and entries say."""

    MOST = 200_000

    def __init__(self, brands: Brands, patterns: q.Patterns):
        self.brands, self.patterns = brands, patterns
        self.keys: dict[str, tuple[str | None, tuple[bool, str | None]]] = {}
        self.said: dict[tuple[str, object], tuple[str | None, object]] = {}
        self.exact: dict[str, str | None] = {}
        self.near: dict[str, str | None] = {}

    def _remember(self, memo: dict, key: object, value: object) -> object:
        if len(memo) >= self.MOST:
            memo.clear()
        memo[key] = value
        return value

    def _colour(self, words: list[str]) -> tuple[str | None, int]:
        """The first colour among the words and its place; else one with a slip."""
        exact = self.exact
        for i, w in enumerate(words):
            if w in exact:
                c = exact[w]
            else:
                c = self._remember(exact, w, colour_of(w))
            if c:
                return c, i
        near = self.near
        for i, w in enumerate(words):
            if w in near:
                c = near[w]
            else:
                c = self._remember(near, w, _near_colour(w))
            if c:
                return c, i
        return None, -1

    def _entry(self, key: str, value: object) -> tuple[str | None, object]:
        """What an entry says: a group of keys and its reading, or (None, amounts)."""
        known = self.keys.get(key)
        if known is None:
            known = self._remember(self.keys, key, (_KEY_GROUPS.get(chars.skeleton(key).rstrip(":")), self.patterns.key_unit(key)))
        group, own = known
        if group is None:
            return None, self.patterns.value_mentions(value, own) if own[0] else []
        if read_string(value) is None:
            return group, None
        words = words_of(str(value))
        if not words:
            return group, None
        s = " ".join(words)
        if group == "brand":
            # an unknown brand is a brand, if no known one is named
            return group, (s in self.brands.known, self.brands.known.get(s, s))
        if group == "series":
            return group, s
        if group == "colour":
            # a colour outside the table is its own word
            return group, self._colour(words)[0] or s
        t = " ".join(bare(chars.plain(str(value))).split())
        if group == "size":
            m = _SIZE_VALUE.fullmatch(t)
            return group, m[1].replace(",", ".") if m else None
        m = _COUNT.fullmatch(t.replace(" ", ""))
        return group, int(m[1]) if m else None

    def read(self, name: str | None, attributes: str | None) -> dict:
        """Typed tokens of a listing: brand, series (as stated), colour, size, pack,
        amounts, a list of (number, unit spelling), and the words of the name that
        are left, with an empty one where something stood between them."""
        out: dict = {"brand": None, "series": None, "colour": None, "size": None, "pack": None, "amounts": [], "words": []}
        if attributes:
            for key, value in entries(attributes):
                if value is None or isinstance(value, bool):
                    continue
                said = self.said.get((key, value))
                if said is None:
                    said = self._remember(self.said, (key, value), self._entry(key, value))
                group, got = said
                if group is None:
                    out["amounts"] += got
                elif got is not None:
                    if group == "brand":
                        if got[0] or out["brand"] is None:
                            out["brand"] = got[1]
                    else:
                        out[group] = got
        if name:
            self._read_name(name, out)
        return out

    def _read_name(self, name: str, out: dict) -> None:
        text = " ".join(chars.plain(name).split())
        coded = q.without_codes(text).lower()
        if out["size"] is None and q.speaks_of_size(coded) and (m := _SIZE_NAME.search(coded)):
            out["size"] = (m[1] or m[2]).replace(",", ".")
        if q._DIGIT.search(coded):
            if out["pack"] is None and q.speaks_of_pack(coded) and (m := _PACK_NAME.search(coded)):
                out["pack"] = int(m[1] or m[2] or m[3])
            coded = q.without_counts(coded)
            said, coded = self.patterns.taken_from(coded)
            out["amounts"] += said
        words = ["" if w[0] in " ,;/|()" else w for w in _PIECE.findall(bare(coded))]
        own, starts = None, self.brands.starts
        if not starts.keys().isdisjoint(words):
            i = 0
            while i < len(words):
                if words[i] in starts and (n := self.brands.at(words, i)):
                    own = own or self.brands.known[" ".join(words[i : i + n])]
                    words[i : i + n] = [""]
                i += 1
        if out["brand"] is None:
            out["brand"] = own
        if out["colour"] is None:
            c, i = self._colour(words)
            if c:
                out["colour"], words[i] = c, ""
        out["words"] = words
