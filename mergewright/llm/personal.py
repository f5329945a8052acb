"""Personal information in free text, replaced by typed placeholders.

Finds e-mail addresses, phone numbers, identity numbers, street addresses with a
house number, and names of persons by at least two parts. Identity and tax
numbers are validated by their check digits.

Method: format-preserving Feistel pseudonyms. Validated numbers are permuted
under a key within their format, and the other kinds become keyed labels, so
equal values stay linked across documents while the rest of the text stays as it
is: ``[phone +7 901 555-01-31]``, ``[name 5e1c9a0b]``. A number's country or
trunk prefix is kept; values are compared without their formatting. Dates are no
personal information by themselves and stay, unless asked for (``dates``): then
they become other dates in the same writing.

The key is the session's ``spark.mergewright.pseudonym.key``. Without one, every
run draws a key of its own, which is kept nowhere: its pseudonyms agree with each
other, but not with another run's, and nobody can undo them.

Names: at least two of first name, patronymic, surname and initials side by side.
A first name may be in the lists or not: a patronymic, two initials, a surname's
shape within a sentence, or words that introduce a person tell it as well.

Scale: a narrow pass without a shuffle. A text is scanned a fixed number of
times and findings are marked on a map of the text, so the time is linear in its
length. Brands are looked up by their words, at a cost that doesn't grow with
them; the table travels with the tasks, so its rows are checked (``MAX_BRANDS``).

Defined results: a null text stays null, empty and blank ones stay as they are;
nulls in other columns and repeated rows don't matter; overlapping findings give
the one that starts first, then the longer one; brands that look like names are
none; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feistel import permute_date, permute_digits

MAX_BRANDS = 1_000_000
KEY = "spark.mergewright.pseudonym.key"
KINDS = ("email", "phone", "id_number", "address", "name")
Finding = tuple[str, int, int]  # kind, start, end

_DIGIT = re.compile(r"\d")

# --- e-mail -----------------------------------------------------------------
_AT = r"(?:\s?[@＠]\s?|\s?[(\[]\s?(?:at|собака)\s?[)\]]\s?)"
_DOT = r"(?:\.|\s?[(\[]\s?(?:dot|точка)\s?[)\]]\s?|\s(?:dot|точка)\s)"
_LOCAL = r"(?<![\w.+\-@])[A-Za-z0-9][\w.+\-]*"
_HOST = r"[A-Za-z0-9][A-Za-z0-9\-]*"
EMAIL = re.compile(rf"{_LOCAL}(?:{_AT}{_HOST}(?:{_DOT}[A-Za-z][A-Za-z0-9\-]*)+|\s(?:at|собака)\s{_HOST}(?:\s(?:dot|точка)\s[A-Za-z][A-Za-z0-9\-]*)+)", re.I)

# --- phone ------------------------------------------------------------------
_S = r"[  .\-‑–]"
PHONE = re.compile(
    rf"(?<![\w+.,№/\-])(?<!№ )(?:\+7|[78])(?:{_S}?\(\d{{3}}\){_S}?|{_S}\d{{3}}{_S})\d{{3}}{_S}?\d{{2}}{_S}?\d{{2}}(?![\w]|{_S}\d)"
    rf"|(?<![\w+.,№/\-])\+\d{{11,13}}(?!\w)"
    rf"|(?<![\w+.,№/\-])\+[1-9]\d{{0,2}}(?:{_S}?\(?\d{{1,4}}\)?){{2,6}}(?!\w|{_S}?\d)"
    rf"|(?<![\w+.,№/\-])[78]\d{{10}}(?![\w]|{_S}\d)"
    rf"|(?<![\w+.,№/\-])\+7{_S}?\d{{3}}{_S}?\d{{3}}{_S}?\d{{2}}{_S}?\d{{2}}(?!\w)"
    rf"|(?<![\w+.,№/\-])\(?\d{{3}}\)? \d{{3}}[\-‑–]\d\d[\-‑–]\d\d(?![\w]|{_S}\d)"
    rf"|(?<![\w+.,№/\-])(?:\+?1{_S})?(?:\(\d{{3}}\) ?|\d{{3}}[.\-])\d{{3}}[.\-]\d{{4}}(?!\w|[.\-]\d)"
    rf"|(?<![\w+.,№/\-])(?:\+49|0049|0){_S}?\(?\d{{2,4}}\)?{_S}\d{{3,8}}(?:{_S}\d{{2,5}})?(?!\w|[.\-]\d)"
)
#: What every phone, insurance and tax number holds: seven digits not far apart.
_NUMBERS = re.compile(r"\d(?:[  .()\-‑–]{0,3}\d){6}")
# Numbers of these things aren't phone numbers, whatever they look like.
_NO_PHONE = re.compile(r"(?:заказ\w*|заявк\w*|накладн\w*|трек\w*(?:-номер\w*)?|посылк\w*|сери\w*|штрихкод\w*|артикул\w*|сч[её]т\w*|договор\w*|инн|огрн|кпп|организации|снилс|документ\w*|код\w*|order|invoice|tracking|barcode|parcel|serial|bestellung|rechnung|sendung|nr)\.?\s?[:№#]?\s?$", re.I)

# --- identity numbers ---------------------------------------------------------
_PASSPORT_RU = re.compile(r"(?<!\w)паспорт\w*(?:\s+рф)?(?:[ ,:]+сери[яи])?[ :№]*(\d{2} ?\d{2}(?:[ ,\-]*(?:№|номер|N|No\.?)? ?)\d{6})(?!\d)", re.I)
_PASSPORT_EN = re.compile(r"(?<!\w)(?:passport|ausweis|personalausweis|reisepass|identity card|id card)(?:nummer)?\s*(?:no|nr|number|num|№|#)?[.:]?\s*([A-Z0-9]*\d[A-Z0-9]{5,10})(?!\w)", re.I)
_SSN = re.compile(r"(?<![\w\-])(\d{3}-\d{2}-\d{4})(?![\w\-])")
_SNILS = re.compile(r"(?<![\w\-+.№])(\d{3}[ \-]\d{3}[ \-]\d{3}[ \-]\d{2}|\d{11})(?![\w]|[\-.]\d)")
_SNILS_LABEL = re.compile(r"(?:снилс|страхов\w+(?: свидетельств\w*)?(?: номер)?|пенсионн\w+(?: свидетельств\w*)?|документ\w*)\s?[:№]*\s*$", re.I)
_INN = re.compile(r"(?<![\w\-+.№])(\d{12})(?![\w]|[\-.]\d)")
_INN_LABEL = re.compile(r"инн[^\d\n]{0,15}$", re.I)


def snils_valid(digits: str) -> bool:
    n = sum(int(c) * (9 - i) for i, c in enumerate(digits[:9])) % 101 % 100
    return n == int(digits[9:])


def inn_valid(digits: str) -> bool:
    a = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
    x, y = (sum(w * int(c) for w, c in zip(ws, digits)) % 11 % 10 for ws in (a, (3, *a)))
    return digits[10:] == f"{x}{y}"


# --- street addresses ---------------------------------------------------------
_TYPE = r"(?:улиц[аыеу]|ул\.?|проспект[аеу]?|просп\.?|пр-т\.?|пр-кт\.?|переул(?:ок|к[аеу])|пер\.?|бульвар[аеу]?|б-р\.?|бул\.|набережн(?:ая|ой|ую)|наб\.?|шоссе|площад[ьи]|пл\.|проезд[аеу]?|пр-д\.?|тупик[аеу]?|алле[яюие]|лини[яюи]|микрорайон|мкр\.?)"
_CAP = r"[А-ЯЁ][А-ЯЁа-яё\-]*"
_NAME_RU = rf"(?:\d{{1,2}}-(?:я|й|ая|ый|ой) )?(?:{_CAP}|\d{{1,2}} {_CAP})(?: (?:{_CAP}|и {_CAP})){{0,3}}"
_ADJ = r"(?:\d{1,2}-(?:я|й|ая|ый|ой) )?(?:(?:Больш|Мал|Нижн|Верхн|Нов|Стар)[а-я]{2,3} )?[А-ЯЁ][А-ЯЁа-яё]*(?:ая|яя|ую|юю|ый|ий|ой|ое|ее|ого|его|ому|ему|ом|ем|ей|АЯ|ЯЯ|УЮ|ЫЙ|ИЙ|ОЙ|ОЕ|ОМ)"
_HOUSE = r"(?:,? ?(?:д\.?|дом|вл\.?|стр\.?) ?|,? )(\d{1,4}(?: ?[/-] ?\d{1,4}(?! ?[/-]?\d))?(?:[А-Яа-я](?![А-Яа-яё]))?)"
# What follows a house number belongs to the value, not to its start.
_WITHIN = r"(?:,? ?(?:корп|стр|лит)\.? ?\w{1,3}(?!\w))?(?:,? ?(?:кв|квартира|оф|офис)\.? ?\d{1,4}(?!\d)| - \d{1,4}(?!\d))?"
_WITHIN_EN = r"(?:,? (?:Apt|Unit|Suite)\.? ?\d{1,4}(?!\d)|,? #\d{1,4}(?!\d))?"
STREET_RU = re.compile(rf"(?<![\w\-])(?:(?i:{_TYPE})\s?{_NAME_RU}|{_ADJ} (?i:{_TYPE})(?![\w\-])){_HOUSE}(?!\d|[.,]\d){_WITHIN}")
#: A street without regard to a number, to keep its name from being a person's.
_STREET_ONLY = re.compile(rf"(?<![\w\-])(?:(?i:{_TYPE})\s?{_NAME_RU}|{_ADJ} (?i:{_TYPE})(?![\w\-]))")
STREET_EN = re.compile(r"(?<![\w\-#№/.])\d{1,5}[A-Za-z]? (?:[A-Z][a-z'’]+ ){1,4}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Pl|Square|Sq|Terrace|Way|Close|Crescent|Row|Hill)(?![\w\-])\.?" + _WITHIN_EN)
STREET_DE = re.compile(r"(?<![\w\-])(?:[A-ZÄÖÜ][a-zäöüß\-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|steig|pfad|chaussee)|(?:[A-ZÄÖÜ][a-zäöüß\-]+[ \-]){1,3}(?:Straße|Strasse|Str\.|Weg|Platz|Allee|Gasse|Ring|Damm|Ufer)|(?:Am|An der|Im|In der|Auf dem|Zum|Zur) [A-ZÄÖÜ][a-zäöüß\-]+) \d{1,4} ?(?:[a-z](?!\w))?(?!\d)")

# --- names ----------------------------------------------------------------------
# Common first names.
_FIRST_RU = (
    "Александр Алексей Анатолий Андрей Антон Аркадий Арсений Артём Артур Богдан Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Владислав "
    "Всеволод Вячеслав Геннадий Георгий Глеб Григорий Даниил Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Лев Леонид Макар Максим Марк "
    "Матвей Михаил Никита Николай Олег Павел Пётр Роман Руслан Савелий Семён Сергей Станислав Степан Тарас Тимофей Тимур Фёдор Филипп Эдуард Юрий Яков Ярослав "
    "Александра Алина Алиса Алла Анастасия Ангелина Анна Антонина Валентина Валерия Варвара Василиса Вера Вероника Виктория Галина Дарья Диана Евгения Екатерина Елена "
    "Елизавета Жанна Зинаида Злата Зоя Инна Ирина Карина Кира Клавдия Кристина Ксения Лариса Лидия Любовь Людмила Маргарита Марина Мария Милана Надежда Наталья Нина "
    "Оксана Ольга Полина Раиса Регина Светлана Снежана София Софья Таисия Тамара Татьяна Ульяна Эльвира Юлия Яна Ярослава"
)
_FIRST_LATIN = (
    "Alexander Alexei Andrei Anton Artem Bogdan Boris Daria Denis Dmitry Egor Elena Elvira Gleb Igor Irina Ivan Ksenia Maria Marina Mikhail Natalia Nikolai Oleg Olga Pavel Polina Ruslan Sergei Stepan Svetlana Tatiana Timur Vera Viktor Vladimir Yulia Zhanna Alina "
    "Adam Alice Amelia Arthur Benjamin Charles Charlotte Corwin Daniel David Edith Edward Eleanor Elizabeth Emily Emma George Grace Greta Hannah Harlan Harry Henry Isolde Jack James Jane John Joseph Julia Laura Lenora Lucy Maeve Margaret Mary Matthew Michael Oliver Paul Peter Philip Quentin Rachel Richard Robert Rufus Samuel Sarah Sophie Stephen Thomas Tobias Walter William "
    "Anke Bernd Birgit Dieter Franz Friedrich Hans Heike Heinrich Ingrid Jens Johannes Jorin Jürgen Karl Klaus Lena Mareike Markus Matthias Monika Sabine Stefan Swantje Ursula Uwe Veit Wolfgang"
)
_SPECIAL = {"Павел": "Павл", "Пётр": "Петр", "Лев": "Льв"}


def _forms(name: str) -> set[str]:
    """Case forms of a Russian first name, by its ending."""
    if name[-1] == "й":
        stem, ends = name[:-1], ("й", "я", "ю", "ем", "е", "и")
    elif name.endswith("ия"):
        stem, ends = name[:-1], ("я", "и", "ю", "ей")
    elif name[-1] == "я":
        stem, ends = name[:-1], ("я", "и", "е", "ю", "ей", "ёй", "ьи", "ье", "ью")
    elif name[-1] == "ь":
        stem, ends = name[:-1], ("ь", "я", "ю", "ем", "е", "и", "ью")
    elif name[-1] == "а":
        stem, ends = name[:-1], ("а", "ы", "и", "е", "у", "ой", "ою")
    else:
        stem, ends = _SPECIAL.get(name, name), ("а", "у", "ом", "е", "ом")
    out = {name, *(stem + e for e in ends)}
    return {x.lower().replace("ё", "е") for x in out}


FIRST_RU = frozenset(f for n in _FIRST_RU.split() for f in _forms(n))
FIRST_LATIN = frozenset(n.lower() for n in _FIRST_LATIN.split())
_PATRONYMIC = re.compile(r"[а-яё]{2,}(?:[оеё]вич|[оеё]вн|ьич|[иы]ничн|ич)(?:а|у|ем|ом|е|ы|ой|ою|и)?", re.I)
_SURNAME = re.compile(r"[а-яё\-]{2,}(?:(?:[оеё]в|[иы]н)(?:а|у|ым|е|ой|ою|ы)?|[сц]к(?:ий|ого|ому|им|ом|ая|ой|ую)|енко|[уюя]к|ян|дзе|швили|[ыи]х)", re.I)
_SURNAME_LATIN = re.compile(r"[A-Za-z\-]{2,}(?:[oe]v|[iy]n|sky|skiy)a?", re.I)
_STRICT = re.compile(r"[а-яё\-]{2,}(?:[оеё]в(?:а|у|ым|е|ой|ою|ы)?|[сц]к(?:ий|ого|ому|им|ом|ая|ой|ую)|енко|ян|дзе|швили)", re.I)
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿА-ЯЁа-яё"
#: Capital words and initials; whatever stands between them parts them.
_TOKEN = re.compile(rf"(?:[А-ЯЁ]\.\s?[А-ЯЁ]\.|(?<![{_LETTER}])[А-ЯЁ]\.|(?<![{_LETTER}])[A-Z]\.)|(?<![{_LETTER}])(?<![{_LETTER}]['’\-])(?:[А-ЯЁ][А-ЯЁа-яё]*(?:-[А-ЯЁа-яё]+)*|[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]*(?:['’\-][A-Za-zÀ-ÖØ-öø-ÿ]+)*)")
# Endings of verbs, which begin a sentence with a capital as names do.
_VERB = re.compile(r".*(?:[иеуй]те|л[аио]?|ть|т?ся|ешь|ишь|[еиаую]т)", re.I)
# A name follows: then a capital word beside a first name needs no shape.
_NAMED = re.compile(r"(?<!\w)(?:зовут|получатель:?|покупатель\w*|уважением,?|контакт:?|на имя|возврата:|клиент\w*:?|отправитель:?|regards,?|sincerely,?|gru(?:ß|ss),?|grüßen,?|name:?|name is|this is|mr\.?|mrs\.?|ms\.?|herr|frau|dear|signed:?|recipient:?|customer:?|contact:?|attn\.?:?|ask for|empfänger:?|kunde:?|ansprechpartner:?|имя:?|фио:?)\s+$", re.I)


#: Words of these cues are no names, though they may have a capital.
_CUE_WORD = re.compile(r"зовут|получател\w*|покупател\w*|уважением|контакт\w*|клиент\w*|отправител\w*|имя|фио|regards|sincerely|gru(?:ß|ss)|grüßen|name|mr|mrs|ms|herr|frau|dear|signed|recipient|customer|contact|this|phone|my", re.I)
#: Cues after which a person signs, surname first or not.
_SIGNS = re.compile(r"(?<!\w)(?:regards,?|sincerely,?|gru(?:ß|ss),?|grüßen,?|name is|this is|уважением,?)\s+$", re.I)
#: What follows a person in an address line: a house number and street, or a phone number.
_ADDRESSED = re.compile(r", (?:\d{1,5}[A-Za-z]? [A-Z]|[+(]\d)")


_CONTACT = re.compile(r",? (?:[\d(+#]|паспорт|[Уу]л)")


@lru_cache(maxsize=200_000)
def _tag(tok: str, latin: bool) -> str:
    """F first name, P patronymic, S surname by shape, I an initial, J two, C capital word,
    N none of them."""
    if tok[-1] == ".":
        return "I" if tok.count(".") == 1 else "J"
    low = tok.lower().replace("ё", "е")
    if _CUE_WORD.fullmatch(low):
        return "N"
    if latin:
        return "F" if low in FIRST_LATIN else "S" if _SURNAME_LATIN.fullmatch(low) else "C"
    return "F" if low in FIRST_RU else "P" if _PATRONYMIC.fullmatch(low) and len(low) > 5 else "S" if _SURNAME.fullmatch(low) else "C"


_RU_SHAPES = ("SFP", "FPS", "FSP", "SPF", "SF", "FP", "FS", "SI", "IS", "SJ", "JS", "FJ", "JF", "SCP", "CPS", "CJ", "JC")
_RU_NAMED = ("CFP", "FPC", "CCP", "CPC", "CF", "FC", "CI", "IC", "CP", "CS", "SC", "CC")
_RU_WITHIN = ("CCP", "CP", "CS", "SC")
_LATIN_SHAPES = ("FIS", "FIC", "FPS", "FS", "FC", "FF", "SF")
_LATIN_NAMED = ("CIC", "CIS", "IC", "IS", "CI", "IF", "CF", "SC", "SS", "CC", "CS")
_LATIN_ADDRESSED = ("CC", "CS", "SC", "SS", "CIC", "CIS")
_LONGEST = 3


def _cue(pattern: re.Pattern, text: str, at: int, reach: int) -> bool:
    """Whether the words before a place, whatever the space between, are a cue; a
    cue has at most ``reach`` characters."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    return pattern.search(text, max(0, end - reach), at) is not None


def _within(text: str, at: int) -> bool:
    """Whether a place is within a sentence."""
    while at and text[at - 1] == " ":
        at -= 1
    return at > 0 and (text[at - 1].isalnum() or text[at - 1] == ",")


def _title(word: str) -> bool:
    return len(word) > 2 and word[1:].islower()


def _fits(shape: str, toks: list, i: int, text: str) -> bool:
    """Whether a shape without a listed first name stands for a person: within a
    sentence, or at its start with a word that no verb looks like."""
    words = [t[0] for t in toks[i : i + len(shape)]]
    if not all(map(_title, words)):
        return False
    if "P" not in shape and not _STRICT.fullmatch(words[shape.index("S")]):
        return False
    return _within(text, toks[i][1]) or not _VERB.fullmatch(words[0])


def names(text: str, taken: bytearray) -> list[Finding]:
    """Names of persons outside the places that are taken by something else."""
    toks = [(m.group(0), *m.span()) for m in _TOKEN.finditer(text)]
    latin = [t[0] < "Ͱ" for t, _, _ in toks]
    tags = [_tag(t, x) for (t, _, _), x in zip(toks, latin)]
    out: list[Finding] = []
    i, most = 0, len(toks)
    while i < most:
        start = toks[i][1]
        if taken[start]:
            i += 1
            continue
        # tokens that run on without anything but a space between them
        n = 1
        while n < _LONGEST and i + n < most and latin[i + n] == latin[i] and not taken[toks[i + n][1]]:
            gap = text[toks[i + n - 1][2] : toks[i + n][1]]
            if gap not in ("", " ", "\u00a0") or (gap == "" and tags[i + n - 1] not in "IJ"):
                break
            n += 1
        hit = 0
        if n > 1:
            run = "".join(tags[i : i + n])
            hit = max((len(s) for s in (_LATIN_SHAPES if latin[i] else _RU_SHAPES) if run.startswith(s)), default=0)
            if hit < n and _cue(_NAMED, text, start, 40):
                hit = max([hit, *(len(s) for s in (_LATIN_NAMED if latin[i] else _RU_NAMED) if run.startswith(s))])
            if not hit and not latin[i]:
                hit = max((len(s) for s in _RU_WITHIN if run.startswith(s) and _fits(s, toks, i, text)), default=0)
            if not hit and run in _LATIN_ADDRESSED and _ADDRESSED.match(text, toks[i + n - 1][2]) and not _within(text, start) and all(_title(t[0]) or t[0][-1] == "." for t in toks[i : i + n]):
                hit = n
        # surname, first name: where a name is expected or its address or number follows
        elif tags[i] in "CS" and i + 1 < most and latin[i + 1] == latin[i] and text[toks[i][2] : toks[i + 1][1]] == ", ":
            if tags[i + 1] == "F" and (_CONTACT.match(text, toks[i + 1][2]) or _cue(_NAMED, text, start, 40)):
                hit = 2
            elif tags[i + 1] in "CS" and _title(toks[i][0]) and _title(toks[i + 1][0]) and (_cue(_SIGNS, text, start, 40) or (not _within(text, start) and _ADDRESSED.match(text, toks[i + 1][2]))):
                hit = 2
        end = toks[i + hit - 1][2] if hit else start
        if hit and taken.find(1, start, end) < 0:
            out.append(("name", start, end))
            i += hit
        else:
            i += 1
    return out


class Brands:
    """Brands of several words, in any case form: they may look like names. Words
    are looked up by their beginnings."""

    def __init__(self, brands: list[str]):
        self.starts: dict[str, list[list[str]]] = {}
        for b in sorted(brands):
            words = [w.lower() for w in b.split()]
            if len(words) > 1:
                stems = [w[: max(3, len(w) - 1)] for w in words]
                self.starts.setdefault(stems[0], []).append(stems)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where a brand stands; a word's ending has at most three letters more."""
        out = []
        words = [(m.group(0).lower(), *m.span()) for m in re.finditer(r"\w+", text)] if self.starts else []
        for i, (w, start, _) in enumerate(words):
            for n in range(max(3, len(w) - 3), len(w) + 1):
                for stems in self.starts.get(w[:n], ()):
                    part = words[i : i + len(stems)]
                    if len(part) == len(stems) and all(x.startswith(s) and len(x) <= len(s) + 3 for (x, _, _), s in zip(part, stems)):
                        out.append((start, part[-1][2]))
        return out


# What a street of either language holds, to pass over other texts.
_HINT_RU = ("ул", "просп", "пр-", "переул", "пер.", "пер ", "бульв", "б-р", "бул.", "наб", "шоссе", "площад", "пл.", "проезд", "тупик", "алле", "лини", "микрор", "мкр")
_HINT_EN = ("Street", "St", "Road", "Rd", "Ave", "Lane", "Ln", "Dr", "Boulevard", "Blvd", "Court", "Ct", "Pl", "Sq", "Terrace", "Way", "Close", "Crescent", "Row", "Hill")
_HINT_DE = ("straße", "strasse", "str.", "Straße", "Strasse", "Str.", "weg", "Weg", "platz", "Platz", "allee", "Allee", "gasse", "Gasse", "ring", "Ring", "damm", "Damm", "ufer", "Ufer", "steig", "pfad", "chaussee", "Am ", "An der ", "Im ", "In der ", "Auf dem ", "Zum ", "Zur ")
_PASSPORT_HINT = ("паспорт", "passport", "ausweis", "reisepass", "card")


def find(text: str, brands: Brands | None = None) -> list[Finding]:
    """All findings in a text, in order, without overlaps."""
    found: list[Finding] = []
    low = text.lower()
    taken = bytearray(len(text))

    def take(kind: str, a: int, b: int) -> None:
        found.append((kind, a, b))
        taken[a:b] = b"\x01" * (b - a)

    if "@" in text or "＠" in text or "at" in low or "собака" in low:
        for m in EMAIL.finditer(text):
            take("email", *m.span())
    if _DIGIT.search(text):
        if any(h in low for h in _PASSPORT_HINT):
            for p in (_PASSPORT_RU, _PASSPORT_EN):
                for m in p.finditer(text):
                    take("id_number", *m.span(1))
        if _NUMBERS.search(text):
            for m in _SSN.finditer(text):
                take("id_number", *m.span(1))
            for m in _SNILS.finditer(text):
                d = re.sub(r"\D", "", m[1])
                if snils_valid(d) and (len(m[1]) > 11 or _cue(_SNILS_LABEL, text, m.start(), 60)):
                    take("id_number", *m.span(1))
            for m in _INN.finditer(text):
                if inn_valid(m[1]) and _cue(_INN_LABEL, text, m.start(), 25):
                    take("id_number", *m.span(1))
            for m in PHONE.finditer(text):
                if 7 <= sum(map(str.isdigit, m.group(0))) <= 15 and taken.find(1, *m.span()) < 0 and not _cue(_NO_PHONE, text, m.start(), 60):
                    take("phone", *m.span())
        for p, hints, where in ((STREET_RU, _HINT_RU, low), (STREET_EN, _HINT_EN, text), (STREET_DE, _HINT_DE, text)):
            if any(h in where for h in hints):
                for m in p.finditer(text):
                    take("address", *m.span())
    people = names(text, taken)
    if people:
        # streets and brands may look like names
        mine = [m.span() for m in _STREET_ONLY.finditer(text)] if any(h in low for h in _HINT_RU) else []
        mine += brands.spans(text) if brands else []
        if mine:
            for a, b in mine:
                taken[a:b] = b"\x01" * (b - a)
            people = names(text, taken)
    found += people
    out: list[Finding] = []
    for f in sorted(found, key=lambda f: (f[1], -f[2])):
        if not out or f[1] >= out[-1][2]:
            out.append(f)
    return out


# --- dates ------------------------------------------------------------------------
# Months as they are written beside a day.
_MONTHS = [m.split() for m in (
    "января января january januar", "февраля февраля february februar", "марта марта march märz", "апреля апреля april april", "мая мая may mai", "июня июня june juni",
    "июля июля july juli", "августа августа august august", "сентября сентября september september", "октября октября october oktober", "ноября ноября november november", "декабря декабря december dezember",
)]
_MONTH_OF = {w: i + 1 for i, ws in enumerate(_MONTHS) for w in ws}
DATE = re.compile(r"(?<![\w.,/\-])(?:(\d{1,2})([./\-])(\d{1,2})\2(\d{4})|(\d{4})-(\d{2})-(\d{2})|(\d{1,2})(\.? )(" + "|".join(sorted(_MONTH_OF, key=len, reverse=True)) + r") (\d{4}))(?!\w|[./\-]\d)", re.I)


def other_date(m: re.Match, key: bytes) -> str:
    """Another date in the same writing; what is no date stays."""
    try:
        if m[1]:
            d = permute_date(date(int(m[4]), int(m[3]), int(m[1])), key)
            return f"{d.day:0{len(m[1])}d}{m[2]}{d.month:0{len(m[3])}d}{m[2]}{d.year}"
        if m[5]:
            return permute_date(date(int(m[5]), int(m[6]), int(m[7])), key).isoformat()
        month = m[10].lower()
        d = permute_date(date(int(m[11]), _MONTH_OF[month], int(m[8])), key)
        written = _MONTHS[d.month - 1][_MONTHS[_MONTH_OF[month] - 1].index(month)]
        return f"{d.day}{m[9]}{written.capitalize() if m[10][0].isupper() else written} {d.year}"
    except ValueError:
        return m.group(0)


def normal(kind: str, value: str) -> str:
    """What equal values have in common, apart from their writing."""
    if kind == "phone":
        d = re.sub(r"\D", "", value)
        return d[1:] if len(d) == 11 and d[0] in "78" else d
    if kind == "id_number":
        return re.sub(r"[^A-Z0-9]", "", value.upper())
    s = value.lower()
    if kind == "email":
        s = re.sub(_DOT, ".", re.sub(r"\s(?:at|собака)\s", "@", re.sub(_AT, "@", s)))
    return re.sub(r"[\s.,]+", " ", s).strip() if kind != "email" else s


def placeholder(kind: str, value: str, key: bytes) -> str:
    """Typed placeholder with a pseudonym that equal values share."""
    same = normal(kind, value)
    if kind in ("phone", "id_number") and same.isdigit():
        secret = permute_digits(same, key, kind.encode())
        # the pseudonym is written in the value's own format
        at = [i for i, c in enumerate(value) if c.isdigit()]
        out = list(value)
        for i, c in zip(at[len(at) - len(secret) :], secret):
            out[i] = c
        return f"[{kind} {''.join(out)}]"
    if kind == "id_number":
        return f"[{kind} {permute_digits(same, key, kind.encode() + re.sub(r'[0-9]', '', same).encode())}]"
    return f"[{kind} {hmac.new(key, f'{kind}|{same}'.encode(), hashlib.sha256).hexdigest()[:8]}]"


def redact(text: str, found: list[Finding], key: bytes) -> str:
    out, at = [], 0
    for kind, a, b in found:
        out += (text[at:a], placeholder(kind, text[a:b], key))
        at = b
    return "".join((*out, text[at:]))


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, or one of this run's own."""
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    return named.encode() if named else secrets.token_bytes(32)


def scan(docs: DataFrame, brands: DataFrame, key: bytes | None = None, doc: str = "doc_id", text: str = "text", dates: bool = False) -> DataFrame:
    """(doc_id, text with placeholders, findings) of every document. key: instead of
    the session's; dates: permute dates as well."""
    rows = brands.select("brand").where("brand is not null").distinct().limit(MAX_BRANDS + 1).collect()
    if len(rows) > MAX_BRANDS:
        raise ValueError(f"more than {MAX_BRANDS} brands")
    table = [r[0] for r in rows]
    secret = key if key is not None else session_key(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start_at", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = Brands(table)
        for b in batches:
            texts, lists = [], []
            for t in b.column(1).to_pylist():
                found = find(t, spelled) if t else []
                new = redact(t, found, secret) if found else t
                texts.append(DATE.sub(lambda m: other_date(m, secret), new) if dates and new else new)
                lists.append([{"kind": k, "start_at": a} for k, a, _ in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(lists, kind)], ["doc_id", "text", "findings"])

    return docs.select(F.col(doc).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, text string, findings array<struct<kind: string, start_at: long>>")
