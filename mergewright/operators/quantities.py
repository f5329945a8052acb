"""Quantities recorded in different units, brought to base units.

Method: units and their spellings are nodes of a graph whose edges are affine
conversions (value * a + b), inverses included. The rows of ``units`` are edges
to the base unit of their kind, with an optional column ``offset``; further rows
may join any two units (``edges``). Shortest compositions from every spelling to
the base unit are computed once; every edge outside the search tree closes a
cycle and is compared with the composition along the tree. Edges that disagree,
and spellings of two kinds, are rows of ``disagreements``; a single bad edge
spoils nothing else: the shortest composition, first in order, counts.
Mentions of quantities are read from the text in one pass and converted by an
equi-join on their unit.

Scale: one narrow pass over the current rows (``current_narrow``); what is
shuffled is the short list of converted mentions. The spellings are metadata (``MAX_NODES``, checked) that the
reading pattern is built from; their join is left to the optimizer's own check
of the size.

What counts as the item's own: a number with a unit in the name unless a limit
or another thing is named before it; an attribute value that is a number with a
unit, or a number whose key names the unit, unless the key speaks of packaging,
loads, areas, box dimensions and the like.

Defined results: null, blank or unreadable fields state nothing; the current row
of an id counts, ties on ``updated_at`` are merged; equal quantities of an item
are one row; a null id is left out; units missing from the table of units are
ignored; a spelling that two kinds share converts to neither; units of the table
without spellings of their own here are read by their symbol; empty tables give
an empty table. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.attrs import entries
from ..functions.words import one_of
from ..session import Scratch
from ..sources.tables import current_narrow

#: Conversions and units that one table may hold; both are metadata.
MAX_NODES = 100_000
Affine = tuple[float, float]

# Spellings of units, without dots, spaces and middle dots.
SPELLINGS = {
    "g": "g gr gram grams gramme г гр грамм грамма граммов граммы",
    "kg": "kg kilo kilogram kilograms кг кило килограмм килограмма килограммов килограммы",
    "oz": "oz ounce ounces унция унции унций",
    "lb": "lb lbs pound pounds фунт фунта фунтов",
    "ml": "ml milliliter milliliters millilitre millilitres мл миллилитр миллилитра миллилитров",
    "cl": "cl centiliter centiliters centilitre centilitres сл сантилитр сантилитра сантилитров",
    "l": "l liter liters litre litres л литр литра литров",
    "floz": "floz flozs fluidounce fluidounces жидкунция жидкунции жидкунций",
    "mm": "mm millimeter millimeters millimetre millimetres мм миллиметр миллиметра миллиметров",
    "cm": "cm centimeter centimeters centimetre centimetres см сантиметр сантиметра сантиметров",
    "m": "m meter meters metre metres м метр метра метров",
    "in": 'in inch inches ″ " ” дюйм дюйма дюймов',
    "mb": "mb megabyte megabytes мб мегабайт мегабайта мегабайтов",
    "gb": "gb gigabyte gigabytes гб гигабайт гигабайта гигабайтов",
    "tb": "tb terabyte terabytes тб терабайт терабайта терабайтов",
    "w": "w watt watts вт ватт ватта ваттов",
    "kw": "kw kilowatt kilowatts квт киловатт киловатта киловаттов",
    "hp": "hp horsepower лс лошсил лошсила",
    "mah": "mah мач миллиамперчас",
    "ah": "ah ач амперчас",
}


def _then(first: Affine, second: Affine) -> Affine:
    """Composition: the first conversion, then the second."""
    return first[0] * second[0], first[1] * second[0] + second[1]


Edge = tuple[str, str, float, float]


def compose(edges: list[Edge], target: str) -> tuple[dict[str, Affine], list[tuple[str, str, Affine, Affine]]]:
    """Shortest compositions from every node to the target, and the edges (u, v,
    conversion stated, conversion composed) that disagree with them.

    An edge (u, v, a, b) says that u is a * u + b in v. Breadth first, edges in
    order, so the result is the same for the same edges.
    """
    graph: dict[str, list[tuple[str, Affine]]] = {}
    for u, v, a, b in sorted(edges):
        graph.setdefault(v, []).append((u, (a, b)))  # walked from the target: u is converted to v
        graph.setdefault(u, []).append((v, (1 / a, -b / a)))
    seen: dict[str, Affine] = {target: (1.0, 0.0)}
    todo = deque([target])
    while todo:
        at = todo.popleft()
        for node, step in graph.get(at, ()):
            if node not in seen:
                seen[node] = _then(step, seen[at])
                todo.append(node)
    bad = []
    for u, v, a, b in sorted(edges):
        if u in seen and v in seen:
            way = _then((a, b), seen[v])
            if any(abs(x - y) > 1e-6 * max(1e-9, abs(x), abs(y)) for x, y in zip(way, seen[u])):
                bad.append((u, v, way, seen[u]))
    return seen, bad


def graph_of(units: DataFrame, edges: DataFrame | None = None) -> tuple[list[tuple[str, str, str, float, float]], list[tuple[str, str, str, str, float | None, float | None, float | None, float | None]]]:
    """(spelling, kind, base, a, b) of every spelling, and what disagrees: (what,
    kind, unit, other, stated a, stated b, composed a, composed b).

    units: unit, kind, factor and perhaps offset; edges: unit, other, factor and
    perhaps offset, conversions between units of one kind.
    """
    offset = F.col("offset").cast("double") if "offset" in units.columns else F.lit(0.0)
    rows = units.where("unit is not null and kind is not null and factor is not null").select("unit", "kind", "factor", offset).distinct().limit(MAX_NODES + 1).collect()
    more: list = []
    if edges is not None:
        extra = F.col("offset").cast("double") if "offset" in edges.columns else F.lit(0.0)
        more = edges.where("unit is not null and other is not null and factor is not null").select("unit", "other", "factor", extra).distinct().limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES or len(more) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} conversions")
    kinds: dict[str, list] = {}
    for r in rows:
        kinds.setdefault(r[1], []).append(r)
    spelled: dict[str, set[str]] = {}
    ways: dict[tuple[str, str], tuple[str, float, float]] = {}
    bad: list = []
    for kind, own in sorted(kinds.items()):
        base = min(own, key=lambda r: (abs(r[2] - 1.0) + abs(r[3] or 0.0), r[0]))[0]
        names = {r[0] for r in own}
        links = [(u, base, float(a), float(b or 0.0)) for u, _, a, b in own if a and (u, a, b or 0.0) != (base, 1.0, 0.0)]
        links += [(u, v, float(a), float(b or 0.0)) for u, v, a, b in more if a and {u, v} & names]
        # spellings are nodes of their own, apart from the units they spell
        links += [(f"={s}", u, 1.0, 0.0) for u in sorted(names | {x for u, v, *_ in links for x in (u, v)}) for s in spellings_of(u)]
        found, wrong = compose(links, base)
        bad += [("conversion", kind, u.lstrip("="), v, *x, *y) for u, v, x, y in wrong]
        for node, (a, b) in found.items():
            if node[0] == "=":
                spelled.setdefault(node[1:], set()).add(kind)
                ways[node[1:], kind] = (base, a, b)
    bad += [("spelling", k, s, ", ".join(sorted(ks - {k})), None, None, None, None) for s, ks in sorted(spelled.items()) if len(ks) > 1 for k in sorted(ks)]
    return [(s, k, *ways[s, k]) for s, ks in sorted(spelled.items()) if len(ks) == 1 for k in ks], bad


def spellings_of(unit: str) -> list[str]:
    """Spellings of a unit, squeezed; a unit without any here is its own."""
    return list(dict.fromkeys(_squeezed(s) for s in (*SPELLINGS.get(unit.lower(), "").split(), unit) if _squeezed(s)))


def conversions(units: DataFrame, edges: DataFrame | None = None) -> list[tuple[str, str, str, float, float]]:
    """(spelling, kind, base, a, b) of every spelling of the table's units."""
    return graph_of(units, edges)[0]


def disagreements(units: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """What in the graph of units disagrees: conversions that close a cycle with
    another result than the shortest composition, and spellings of two kinds."""
    shape = "what string, kind string, unit string, other string, stated_a double, stated_b double, composed_a double, composed_b double"
    return units.sparkSession.createDataFrame(graph_of(units, edges)[1], shape)


_DIGIT = re.compile(r"\d")
# The patterns below, but for codes, are for text in lower case.
_NUMBER = r"(?:\d{1,3}(?: \d{3})+|\d+)(?:[.,]\d+)?"
_BARE = re.compile(r"\s*(" + _NUMBER + r")\s*")


@dataclass(frozen=True)
class Patterns:
    """Patterns of quantities in text, for the spellings of a table of units."""

    in_name: re.Pattern
    whole: re.Pattern
    in_key: re.Pattern

    def mentions_of(self, text: str) -> list[tuple[float, str]]:
        """(number, unit) of a cleaned lower-case text, but for limits and other things."""
        return [(_value(m[1]), _squeezed(m[2])) for m in self.in_name.finditer(text) if not limited(text, m.start())]

    def taken_from(self, text: str) -> tuple[list[tuple[float, str]], str]:
        """The same mentions, and the text without any number with a unit."""
        said: list[tuple[float, str]] = []

        def take(m: re.Match) -> str:
            if not limited(text, m.start()):
                said.append((_value(m[1]), _squeezed(m[2])))
            return " ; "

        return said, self.in_name.sub(take, text)

    def name_mentions(self, name: str) -> list[tuple[float, str]]:
        """(number, unit) of quantities that the name states of the item."""
        text = " ".join(chars.plain(name).split())
        return self.mentions_of(without_counts(without_codes(text).lower())) if _DIGIT.search(text) else []

    def key_unit(self, key: str) -> tuple[bool, str | None]:
        """Whether a key's quantity is the item's own, and the unit the key names."""
        k = chars.plain(key).lower()
        if _NOT_OWN.search(k):
            return False, None
        m = self.in_key.fullmatch(k)
        return True, _squeezed(m[1]) if m else None

    def value_mentions(self, value: object, own: tuple[bool, str | None]) -> list[tuple[float, str]]:
        """The quantity of an attribute's value, by what its key says."""
        if isinstance(value, str):
            # most values hold no digit at all
            if not _DIGIT.search(value):
                return []
            s = " ".join(chars.plain(value).lower().split())
            if m := self.whole.fullmatch(s):
                return [(_value(m[1]), _squeezed(m[2]))]
            if own[1] and (m := _BARE.fullmatch(s)):
                return [(_value(m[1]), own[1])]
        elif own[1] and value == value and abs(value) < 1e15:
            return [(float(value), own[1])]
        return []

    def attribute_mentions(self, text: str, keys: dict[str, tuple[bool, str | None]]) -> list[tuple[float, str]]:
        """The same of the attributes. keys: remembers what keys say."""
        out = []
        for key, value in entries(text):
            if value is None or isinstance(value, bool):
                continue
            known = keys.get(key)
            if known is None:
                if len(keys) > 100_000:
                    keys.clear()
                known = keys[key] = self.key_unit(key)
            if known[0]:
                out += self.value_mentions(value, known)
        return out


@lru_cache(maxsize=8)
def patterns(spellings: tuple[str, ...]) -> Patterns:
    """Patterns of a set of (squeezed) spellings."""
    parted = [p for s, p in _PARTED.items() if s in spellings]
    unit = "(?:" + "|".join([*parted, one_of(sorted(spellings))]) + r")(?![^\W_]|[²³])" if spellings else r"(?!)"
    return Patterns(
        re.compile(r"(?<![\w.,])(" + _NUMBER + r")\s?-?\s?(" + unit + ")"),
        re.compile(r"\s*(" + _NUMBER + r")\s?(" + unit + r")\.?\s*"),
        re.compile(r".*[,(]\s*(" + unit + r")[.)]*\s*:?\s*"),
    )


# Units written with something between their parts.
_PARTED = {
    "лс": r"л\.?\s?с", "floz": r"fl\.?\s?oz", "жидкунции": r"жидк\.?\s?унци[ийя]", "мач": r"ма[·*.\- ]?ч", "ач": r"а[·*.\- ]?ч", "fluidounce": r"fluid ounces?",
}
# Article codes, packs and sizes are no quantities, whatever letter follows.
_CODE = re.compile(r"(?:(?<![^\W_])(?:[A-Z]{2}|[a-z]{2})([-/ ]?)|(?<![^\W_])[A-Za-z]{2}([-/])|^\s*[A-Z][a-z]([-/ ]?))\d{3,5}[A-Za-z](?![^\W_])")
_SUFFIXES = frozenset({"II", "IV", "GO", "ii", "iv", "go"})
_PACK = re.compile(r"(?<![^\W_])(?:из|of)\s\d{1,3}(?!\d|[.,]\d)|(?<![^\W_])[xх]\s?\d{1,3}(?!\d)|(?<![\w.,])\d{1,3}\s?(?:шт|pcs|pieces|пар)(?:ук[аи]?|\.)?(?![^\W_])")
_SIZE = re.compile(r"(?<![^\W_])(?:р\.|р-р|размер|size)\s?\d{1,3}(?:[.,]\d)?(?!\d)|(?<![\w.,])\d{1,3}(?:[.,]\d)? (?:размер|size)(?![^\W_])")
# A limit or another thing named right before the number.
_LIMIT = re.compile(r"(?:(?<![^\W_])(?:до|от|свыше|более|менее|выше|ниже|под|to|from|over|under|above|below|least|most|than)|[её]мкост\w*|объ[её]мом|сет[ьи]|сетью|нагрузк\w*|loads?|mains|≤|≥|<|>)\s*:?\s*$")
_NOT_OWN = re.compile(r"упаков|нагруз|габарит|площад|короб|комплект|описан|совмест|комнат|помещен|бонус|(?<![^\W_])год(?![^\W_])|(?<![^\W_])years?(?![^\W_])|артикул|партномер|код товара|температур|гарант|packag|packing|\bbox|dimension|\bload|\barea|\broom|compatib|\bsku|model|модел|серия|линейк|бренд|brand")


_SQUEEZE = {ord(c): None for c in " .·*-"}


def _squeezed(unit: str) -> str:
    return unit.lower().translate(_SQUEEZE)


def _value(number: str) -> float:
    return float(number.replace(" ", "").replace(",", "."))


def without_codes(text: str) -> str:
    """The text without article codes."""
    return text if not _DIGIT.search(text) else _CODE.sub(lambda m: m.group(0) if not (m[1] or m[2] or m[3] or "").strip() and m.group(0)[:2] in _SUFFIXES else " ; ", text)


def speaks_of_size(text: str) -> bool:
    """Cheap test for what every size pattern holds."""
    return "р." in text or "р-р" in text or "размер" in text or "size" in text


_TIMES = re.compile(r"[xх]\s?\d")


def speaks_of_pack(text: str) -> bool:
    """Cheap test for what every pack pattern holds."""
    return "шт" in text or "из " in text or "pcs" in text or "pieces" in text or "of " in text or "пар" in text or "набор " in text or "упаковка " in text or "set " in text or "pack " in text or _TIMES.search(text) is not None


def without_counts(text: str) -> str:
    """Lower-case text, with single spaces, without packs and sizes."""
    if speaks_of_pack(text):
        text = _PACK.sub(" ; ", text)
    return _SIZE.sub(" ; ", text) if speaks_of_size(text) else text


def limited(text: str, at: int) -> bool:
    """Whether a limit or another thing is named right before the place."""
    start = at
    while start and text[start - 1] in " :":
        start -= 1
    while start and not text[start - 1].isspace():
        start -= 1
    return _LIMIT.search(text, start, at) is not None


def mentions(items: DataFrame, spellings: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """(id, said: array of (number, unit)) of the current row of every item."""
    texts = items.select("id", "updated_at", F.col("name").cast("string"), F.col("attributes").cast("string"))
    rows = current_narrow(texts, scratch, "name", "attributes")
    kind = pa.list_(pa.struct([("number", pa.float64()), ("unit", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, tuple[bool, str | None]] = {}
        p = patterns(spellings)
        for b in batches:
            said = []
            for name, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = p.name_mentions(name) if name else []
                if text:
                    got += p.attribute_mentions(text, keys)
                said.append([{"number": n, "unit": u} for n, u in dict.fromkeys(got)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, kind)], ["id", "said"])

    return rows.mapInArrow(read, "id long, said array<struct<number: double, unit: string>>")


def quantities(items: DataFrame, units: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(id, kind, amount): each quantity of each item in the kind's base unit."""
    ways = conversions(units, edges)
    table = items.sparkSession.createDataFrame(ways, "unit string, kind string, base string, a double, b double")
    said = mentions(items, tuple(w[0] for w in ways), Scratch(items.sparkSession, "p7")).select("id", F.inline("said"))
    found = said.join(table.select("unit", "kind", "a", "b"), "unit")
    return found.select("id", "kind", F.round(F.col("number") * F.col("a") + F.col("b")).cast("long").alias("amount")).distinct()
