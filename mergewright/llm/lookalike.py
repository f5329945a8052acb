"""Text that looks right but is made of other characters, in one consistent form.

Method: script-aware repair. Full-width forms, separate accents, invisible
characters and odd spaces are folded. Every run of letters that mixes alphabets
gets candidates, its dominant alphabet first; the look-alike letters are
substituted only if the result occurs in the corpus vocabulary, which is counted
over all texts. Brands spelled wholly in look-alike letters are recognised by
the table of brands. A repair is taken only into a word that is seen at least
``LEAST_SEEN`` times in the corpus.

Scale: one pass counts words and mixed runs, combined per task before the
shuffle, and sets apart the fields that hold something suspicious; the
vocabulary test is an equi-join of distinct words; no other field is shuffled. Brands are a bounded table
(``MAX_BRANDS``, checked).

Defined results: null and empty fields are never reported; legitimate text comes
back unchanged; ids with several rows are judged by their current row, rows that
tie on it count once; a null id is left out; a mixed run whose repair the
vocabulary hasn't got stays as it is but is reported; empty tables give empty
ones. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.words import one_of
from ..operators.skew import hot_split_join
from ..session import Scratch

#: The table of brands travels with the tasks; a lookup costs the same however many there are.
MAX_BRANDS = 1_000_000
#: Letters of a run from which a foreign letter counts.
LONG_RUN = 4
#: Occurrences that make a word part of the vocabulary.
LEAST_SEEN = 2

_MARKS = "̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯"
_EMOJI = "\U0001f000-\U0001faff☀-➿️"
# Characters without shape besides the format ones.
_BLANK = "͏ᅟᅠㅤ឴឵"
_UNSEEN = "".join(c for c in chars.INVISIBLE + _BLANK if c != "‍" and c not in "؀؁؂؃؄؅۝܏࣢")
WIDE = re.compile("[Ａ-Ｚａ-ｚ０-９]")
ACCENT = re.compile(f"[^\\W\\d_][{_MARKS}]")
UNSEEN = re.compile(f"[{re.escape(_UNSEEN)}]|(?<![{_EMOJI}])‍")
SPACE = re.compile(f"[{chars.SPACES}]")
#: Any character that folding changes or that is a finding by itself.
ODD = re.compile(f"[{_MARKS}{chars.SPACES}‍！-～{re.escape(_UNSEEN + chars.INVISIBLE)}]")


def disguised_brands(brands: list[str]) -> dict[str, str]:
    """Each brand that can be spelled wholly in letters of another alphabet:
    that spelling to the brand as given."""
    out: dict[str, str] = {}
    for brand in sorted(brands):
        for form in dict.fromkeys((brand, brand.upper(), brand.lower(), brand.title())):
            own = {chars.script(c) for c in form if c.isalpha()}
            for to in ("L", "C", "G"):
                table = chars.TO[to]
                if len(own) == 1 and to not in own and all(c in table for c in form if c.isalpha()):
                    out.setdefault("".join(table.get(c, c) for c in form), form)
    for known in brands:
        out.pop(known, None)
    return out


def brand_pattern(disguised: dict[str, str]) -> str | None:
    if not disguised:
        return None
    return one_of(disguised)


def candidates(run: str) -> list[str]:
    """Single-alphabet forms of a mixed run, the dominant alphabet's first."""
    first = chars.dominant(run)
    out = []
    for s in (first, *(x for x in "CLG" if x != first)):
        form = "".join(chars.TO[s].get(c, c) for c in run)
        if form not in out and not chars.MIXED.search(form) and len({chars.script(c) for c in form}) == 1:
            out.append(form)
    return out


def mixed_runs(text: str) -> list[str]:
    """Runs of letters of more than one alphabet."""
    return [r for r in chars.RUN.findall(text) if chars.MIXED.search(r)] if chars.MIXED.search(text) else []


def tidy(text: str) -> str:
    """Folded text that keeps joined emoji together."""
    if text.isascii():
        return text
    if "‍" in text:
        return "".join(tidy(p) if i % 2 == 0 else p for i, p in enumerate(re.split(f"((?<=[{_EMOJI}])‍)", text))) if re.search(f"[{_EMOJI}]‍", text) else chars.fold(text.replace("‍", ""))
    return unicodedata.normalize("NFC", chars.fold(text))


def findings(text: str, brand: re.Pattern | None) -> list[str]:
    """What is wrong with a decoded field."""
    if text.isascii():
        return []
    out = [k for k, p in (("wide", WIDE), ("accent", ACCENT), ("unseen", UNSEEN), ("space", SPACE)) if p.search(text)]
    if any(len(r) >= LONG_RUN for r in mixed_runs(text)):
        out.append("mixed")
    if brand and brand.search(text):
        out.append("brand")
    return out


def scan(items: DataFrame, fields: tuple[str, ...], disguised: dict[str, str]) -> DataFrame:
    """One pass over all rows with two kinds of output.

    kind 0: (word, n, mixed), the words of all texts as folded lower-case runs;
    mixed runs keep their letters' case. kind 1: (id, stamp, field, text,
    findings, runs) of the fields that aren't in consistent form.
    """
    spelled = brand_pattern(disguised)
    inner = f"(?<![^\\W\\d_])(?:{spelled})(?![^\\W\\d_])" if spelled else None
    firsts = frozenset(w for b in disguised for w in chars.RUN.findall(b)[:1])
    stamp = F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**63)))
    rows = items.select(F.col("id").cast("long"), stamp, *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    texts = pa.list_(pa.string())
    shape = pa.schema([("kind", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("mixed", pa.bool_()), ("id", pa.int64()), ("stamp", pa.int64()), ("field", pa.string()), ("text", pa.string()), ("findings", texts), ("runs", texts)])

    def batch(height: int, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(height, f.type) for f in shape], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        brand = re.compile(inner) if inner else None
        seen: Counter = Counter()
        pure: set[str] = set()
        both: set[str] = set()
        find, odd, is_mixed = chars.RUN.findall, ODD.search, chars.MIXED.search

        def flush() -> pa.RecordBatch:
            total: Counter = Counter()
            for w, n in seen.items():
                if len(w) > 1:
                    total[w if w in both else w.lower()] += n
            out = batch(len(total), kind=[0] * len(total), word=list(total), n=list(total.values()), mixed=[w in both for w in total])
            seen.clear()
            pure.clear()
            both.clear()
            return out

        for b in batches:
            ids, stamps = b.column(0).to_pylist(), b.column(1).to_pylist()
            bad: list[tuple] = []
            for name, column in zip(fields, b.columns[2:]):
                for i, s, t in zip(ids, stamps, column.to_pylist()):
                    if not t:
                        continue
                    if "\\" in t:
                        t = chars.unescape(t)
                    strange = odd(t) is not None
                    folded = tidy(t) if strange else t
                    words = find(folded)
                    seen.update(words)
                    here = set(words)
                    for w in here - pure:
                        if w not in both:
                            (both if is_mixed(w) else pure).add(w)
                    runs = here & both
                    if strange or runs or here & firsts:
                        found = findings(t, brand)
                        if (found or runs) and i is not None:
                            bad.append((i, s, name, folded, found, sorted(runs)))
            if bad:
                i, s, f, t, x, r = map(list, zip(*bad))
                yield batch(len(bad), kind=[1] * len(bad), id=i, stamp=s, field=f, text=t, findings=x, runs=r)
            if len(seen) > 300_000:
                yield flush()
        yield flush()

    return rows.mapInArrow(run, "kind int, word string, n long, mixed boolean, id long, stamp long, field string, text string, findings array<string>, runs array<string>")


def repairs(words: DataFrame) -> DataFrame:
    """(run, repaired): mixed runs whose repair occurs in the vocabulary."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, f, i) for r in b.column(0).to_pylist() for i, f in enumerate(candidates(r))]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in rows], pa.string()), pa.array([f for _, f, _ in rows], pa.string()), pa.array([f.lower() for _, f, _ in rows], pa.string()), pa.array([i for *_, i in rows], pa.int32())], ["run", "form", "word", "rank"])

    tried = words.where("mixed").select("word").mapInArrow(expand, "run string, form string, word string, rank int")
    vocabulary = words.where(~F.col("mixed") & (F.col("n") >= LEAST_SEEN)).select("word")
    return tried.join(vocabulary, "word").groupBy("run").agg(F.min(F.struct("rank", "form")).alias("b")).select("run", F.col("b.form").alias("repaired"))


def repair_fields(items: DataFrame, brands: DataFrame, scratch: Scratch, fields: tuple[str, ...] = ("name", "attributes")) -> DataFrame:
    """(id, field, findings, repaired, n_runs, n_repaired) of every field of a
    current row that isn't in consistent form. Other fields are as they are."""
    names = [r[0] for r in brands.select("brand").where("brand is not null").distinct().limit(MAX_BRANDS + 1).collect()]
    if len(names) > MAX_BRANDS:
        raise ValueError(f"more than {MAX_BRANDS} brands")
    disguised = disguised_brands(names)
    spelled = brand_pattern(disguised)
    inner = f"(?<![^\\W\\d_])(?:{spelled})(?![^\\W\\d_])" if spelled else None
    scanned = scratch.save(scan(items, fields, disguised), "scan")
    words = scanned.where("kind = 0").groupBy("word", "mixed").agg(F.sum("n").alias("n"))
    fix = scratch.save(repairs(scratch.save(words, "words")), "repairs")

    stamp = F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**63)))
    current = items.where("id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.max(stamp).alias("stamp"))
    doubtful = scanned.where("kind = 1").select("id", "stamp", "field", "text", "findings", "runs")
    # of rows that tie with different texts the one with the least text counts
    first = F.min(F.struct("text", "findings", "runs")).alias("r")
    now = scratch.save(doubtful.join(current, ["id", "stamp"]).groupBy("id", "field").agg(first).select("id", "field", "r.*"), "doubtful")
    wanted = now.select("id", "field", F.explode("runs").alias("run"))
    pairs = hot_split_join(wanted, fix, "run").groupBy("id", "field").agg(F.map_from_entries(F.collect_list(F.struct("run", "repaired"))).alias("fix"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        brand = re.compile(inner) if inner else None
        for b in batches:
            out = []
            for text, fixes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if fixes:
                    known = dict(fixes)
                    text = chars.RUN.sub(lambda m: known.get(m.group(0), m.group(0)), text)
                out.append(brand.sub(lambda m: disguised[m.group(0)], text) if brand else text)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, pa.string())], ["id", "field", "findings", "n_runs", "n_repaired", "repaired"])

    joined = now.join(pairs, ["id", "field"], "left").select("text", "fix", "id", "field", "findings", F.size("runs").alias("n_runs"), F.coalesce(F.size("fix"), F.lit(0)).alias("n_repaired"))
    return joined.mapInArrow(apply, "id long, field string, findings array<string>, n_runs int, n_repaired int, repaired string")
