"""Same or near-same records across splits.

Two listings are the same if one seller entered them with the same attributes
(in any order) and the same name, apart from writing and at most ``SLIPS`` typing
slips, each in a long word. Two records overlap if one is in the training split,
the other is not, and they join the same two listings in either order.

Method: edit-distance segment join. A slip is an edit or a swap of neighbours and
touches two segments at most, so a string of an evaluation record is cut into
2 x ``SLIPS`` + 1 segments, of which one is untouched. Strings of training records
are probed with their substrings at the positions a segment can have moved to,
within a block (seller, attributes). Candidates are verified by a banded dynamic
programme over what is left between their common beginning and end. Equal strings
are one string beforehand. Copies of one wording may each have slips of their own,
so two strings are also the same if a third string of the block is within the
slips of both: one step further and no more, found by a second, smaller join.

Scale: one narrow pass over the current rows; everything shuffled afterwards is
ids, hashes and names; candidates meet by equi-joins on hashed segments, never
all pairs of a block, and a segment that very many strings share is salted. Only
strings of evaluation records meet strings of training records. The id that holds
a large share of the records is joined by ``hot_split_join``, and a pair of
listings that very many records join is salted.

Defined results: sameness is a relation of two listings, at most two steps of
``SLIPS`` slips apart; it isn't carried on along a chain. Records with a null id never count; null split names are
neither training nor another split; ids outside the catalogue equal only
themselves, as do listings with a null seller or without any letter or digit in
the name; records delivered again count once; the order of the ids doesn't
matter; empty tables give an empty one. Texts are compared whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.attrs import entries
from ..operators.skew import hot_split_join, salted_join
from ..session import Scratch
from ..sources.tables import current_narrow

#: Slips that two names of one listing may have.
SLIPS = 1
#: Letters of a word that can hold a slip.
LONG_WORD = 5

_WORDS = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")


def words(text: str) -> list[str]:
    """Words and numbers of a text, without case, alphabet and punctuation."""
    return [w.replace(",", ".") for w in _WORDS.findall(chars.fold(text).upper().translate(chars._SKELETON))]


def attribute_key(text: str | None) -> str:
    """Hash of the attributes, whatever their order and writing."""
    got = entries(text)
    if got:
        parts = sorted("".join(words(k)) + "=" + "".join(words(str(v))) for k, v in got)
    else:
        parts = words(chars.unescape(text)) if text else []
    return hashlib.md5("\x1f".join(parts).encode("utf-8", "replace")).hexdigest()


def edits(a: str, b: str, most: int) -> list[tuple[int, int, int, int]] | None:
    """The edits that make one string the other, at most ``most`` of insertion,
    deletion, substitution and swap of neighbours: (position, length) in either
    string. None if it takes more.

    A banded dynamic programme (optimal string alignment): only cells at most
    ``most`` beside the diagonal are filled, and only between the strings' common
    beginning and end, which no best alignment touches.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    i, least = 0, min(n, m)
    while i < least and a[i] == b[i]:
        i += 1
    j = 0
    while j < least - i and a[n - 1 - j] == b[m - 1 - j]:
        j += 1
    x, y = a[i : n - j], b[i : m - j]
    n, m = len(x), len(y)
    if not n and not m:
        return []
    far = most + 1
    rows: list[dict[int, int]] = [{k: k for k in range(min(m, most) + 1)}]
    for r in range(1, n + 1):
        last, row = rows[-1], {}
        for c in range(max(0, r - most), min(m, r + most) + 1):
            if c == 0:
                row[0] = r
                continue
            d = min(last.get(c, far) + 1, row.get(c - 1, far) + 1, last.get(c - 1, far) + (x[r - 1] != y[c - 1]))
            if r > 1 and c > 1 and x[r - 1] == y[c - 2] and x[r - 2] == y[c - 1]:
                d = min(d, rows[r - 2].get(c - 2, far) + 1)
            row[c] = d
        if min(row.values()) > most:
            return None
        rows.append(row)
    if rows[n].get(m, far) > most:
        return None
    out, r, c = [], n, m
    while r or c:
        d = rows[r][c]
        if r and c and x[r - 1] == y[c - 1] and rows[r - 1].get(c - 1) == d:
            r, c = r - 1, c - 1
        elif r > 1 and c > 1 and x[r - 1] == y[c - 2] and x[r - 2] == y[c - 1] and rows[r - 2].get(c - 2) == d - 1:
            r, c = r - 2, c - 2
            out.append((i + r, 2, i + c, 2))
        elif r and c and rows[r - 1].get(c - 1) == d - 1:
            r, c = r - 1, c - 1
            out.append((i + r, 1, i + c, 1))
        elif r and rows[r - 1].get(c) == d - 1:
            r -= 1
            out.append((i + r, 1, i + c, 0))
        else:
            c -= 1
            out.append((i + r, 0, i + c, 1))
    return out[::-1]


def within_one_slip(a: str, b: str) -> bool:
    """Whether two different strings are one edit or swap apart; a shortcut for the
    programme above where there is a single slip to find."""
    n, m = len(a), len(b)
    if abs(n - m) > 1 or a == b:
        return False
    i, least = 0, min(n, m)
    while i < least and a[i] == b[i]:
        i += 1
    j = 0
    while j < least - i and a[n - 1 - j] == b[m - 1 - j]:
        j += 1
    x, y = a[i : n - j], b[i : m - j]
    return max(len(x), len(y)) <= 1 or (len(x) == len(y) == 2 and x == y[::-1])


def _long_word_at(words_: list[str], at: int, length: int) -> int | None:
    """Letters of the word that holds a stretch of the joined words; None if it is no
    word of letters, nearly too short, or the stretch leaves it; 0 for nothing there."""
    start = 0
    for w in words_:
        if start <= at < start + len(w):
            if not length:
                return 0
            return len(w) if w.isalpha() and len(w) >= LONG_WORD - 1 and at + length <= start + len(w) else None
        start += len(w)
    return 0


def same_name(a: list[str], b: list[str], most: int = SLIPS) -> bool:
    """Whether two names (as words) are equal but for slips in long words of
    letters: every character that differs is in such a word of its name."""
    found = edits("".join(a), "".join(b), most)
    if found is None:
        return False
    for p, k, q, n in found:
        u, v = _long_word_at(a, p, k), _long_word_at(b, q, n)
        if u is None or v is None or max(u, v) < LONG_WORD:
            return False
    return True


def cuts(n: int, most: int = SLIPS) -> list[tuple[int, int]]:
    """(start, length) of the 2 x most + 1 segments of a string of length n."""
    parts = 2 * most + 1
    size, extra = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        w = size + (i >= parts - extra)
        out.append((at, w))
        at += w
    return out


def segments(s: str, most: int = SLIPS) -> list[str]:
    """Segments of a string. One that is too short to be cut is its own segment of
    every length it may be compared with."""
    if len(s) <= 2 * most:
        return ["short"]
    return [f"{len(s)}/{i}/{s[p : p + w]}" for i, (p, w) in enumerate(cuts(len(s), most)) if w]


def probes(s: str, most: int = SLIPS) -> list[str]:
    """Substrings that could be a segment of a string within ``most`` slips."""
    out = ["short"] if len(s) <= 3 * most else []
    for n in range(max(2 * most + 1, len(s) - most), len(s) + most + 1):
        d = len(s) - n
        # slips before a segment move it by t, those after it make up for the rest
        moves = [t for t in range(-most, most + 1) if abs(t) + abs(d - t) <= most]
        for i, (p, w) in enumerate(cuts(n, most)):
            for t in moves if w else ():
                if 0 <= p + t <= len(s) - w:
                    out.append(f"{n}/{i}/{s[p + t : p + t + w]}")
    return list(dict.fromkeys(out))


def listings(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, block, key, name) of current rows in comparison form: hashes of seller
    and attributes, and of these and the name's letters and digits."""
    texts = items.where("seller_id is not null").select("id", "updated_at", F.col("seller_id").cast("long"), F.col("name").cast("string"), F.col("attributes").cast("string"))
    rows = current_narrow(texts, scratch, "seller_id", "name", "attributes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, seller, name, attributes in zip(*(c.to_pylist() for c in b.columns)):
                got = words(name) if name else []
                if got:
                    block = f"{seller}|{attribute_key(attributes)}"
                    out.append((i, _hash(block), _hash(block + "|" + "".join(got)), " ".join(got)))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.string()))], ["id", "block", "key", "name"])

    return rows.mapInArrow(read, "id long, block binary, key binary, name string")


def _hash(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "replace")).digest()


def sides(rows: DataFrame) -> DataFrame:
    """(id, train, other) of the ids of records: where they occur."""
    ids = rows.select("train", F.explode(F.array("id1", "id2")).alias("id"))
    return ids.groupBy("id").agg(F.max(F.col("train").cast("int")).alias("train"), F.max((~F.col("train")).cast("int")).alias("other"))


def same_listings(items: DataFrame, rows: DataFrame, scratch: Scratch, slips: int = SLIPS) -> tuple[DataFrame, DataFrame]:
    """(renamed, links): renamed has (id, listing) of ids whose string has a lesser
    id, the listing; links has (listing, others): for a listing of evaluation
    records, those of training records that are the same but for slips."""
    keyed = scratch.save(listings(items, scratch).join(sides(rows), "id", "left").na.fill(0, ["train", "other"]), "listings")
    # equal strings are one string, under its least id
    strings = keyed.groupBy("key", "block").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("train").alias("train"), F.max("other").alias("other"))
    strings = scratch.save(strings, "strings")
    renamed = keyed.select("id", "key").join(strings.where("n > 1").select("key", F.col("rep").alias("listing")), "key").where("id <> listing").select("id", "listing")
    # blocks in which an evaluation string has a training string beside it
    busy = strings.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.max("train").alias("t"), F.max("other").alias("o")).where("k > 1 and t = 1 and o = 1").select("block")
    mine = strings.join(busy, "block").select("rep", "block", "train", "other")
    named = scratch.save(mine.join(keyed.select(F.col("id").alias("rep"), "name"), "rep"), "busy")

    def cut(of) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    part = b.slice(at, 2000)
                    got = [of(t.replace(" ", ""), slips) for t in part.column(2).to_pylist()]
                    take = pa.array([i for i, g in enumerate(got) for _ in g], pa.int32())
                    segs = pa.array([s for g in got for s in g], pa.string())
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns), segs], ["rep", "block", "name", "seg"])

        return run

    shape = "rep long, block binary, name string, seg string"
    h = F.xxhash64("block", "seg").alias("h")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [same_name(x.split(), y.split(), slips) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    def near(these: DataFrame, those: DataFrame, name: str) -> DataFrame:
        """(u, v) of different strings within the slips, u of these and v of those."""
        left = these.select("rep", "block", "name").mapInArrow(cut(segments), shape).select("rep", "name", h)
        right = those.select("rep", "block", "name").mapInArrow(cut(probes), shape).select(F.col("rep").alias("rep2"), F.col("name").alias("name2"), h)
        met = salted_join(scratch.save(left, f"{name}-segments"), right, "h").where("rep <> rep2").select("rep", "rep2", "name", "name2").dropDuplicates(["rep", "rep2"])
        return scratch.save(met.mapInArrow(verify, "u long, v long"), name)

    first = near(named.where("other = 1"), named, "first")
    # the wordings between; few, since only those that some evaluation string is close to
    between = named.join(first.select(F.col("v").alias("rep")).distinct(), "rep", "left_semi")
    second = near(between, named.where("train = 1"), "second").select(F.col("u").alias("v"), F.col("v").alias("w"))
    direct = first.join(named.where("train = 1").select(F.col("rep").alias("v")), "v", "left_semi").select("u", "v")
    by_way = first.join(second, "v").where("u <> w").select("u", F.col("w").alias("v"))
    links = direct.unionByName(by_way).groupBy(F.col("u").alias("listing")).agg(F.collect_set("v").alias("others"))
    return renamed, scratch.save(links, "links")


def records(*tables: DataFrame) -> DataFrame:
    """One row per pair_id with both ids: pair_id, id1, id2, train, split_name, source."""
    both = None
    for t in tables:
        part = t.select("pair_id", "id1", "id2", "split_name", "source")
        both = part if both is None else both.unionByName(part)
    both = both.where("pair_id is not null and id1 is not null and id2 is not null and split_name is not null")
    one = both.groupBy("pair_id").agg(F.min(F.struct("id1", "id2", "split_name", "source")).alias("r")).select("pair_id", "r.*")
    return one.withColumn("train", F.col("split_name") == "train")


def overlaps(rows: DataFrame, renamed: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(pair_id1, pair_id2, train_id, other_id) of all overlaps across splits."""
    renamed = scratch.save(renamed, "renamed")
    a = renamed.select(F.col("id").alias("id1"), F.col("listing").alias("l1"))
    b = renamed.select(F.col("id").alias("id2"), F.col("listing").alias("l2"))
    mapped = hot_split_join(hot_split_join(rows, a, "id1", "left"), b, "id2", "left")
    mapped = scratch.save(mapped.select("pair_id", "train", F.coalesce("l1", "id1").alias("x"), F.coalesce("l2", "id2").alias("y")), "mapped")
    pair = (F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    train = mapped.where("train").select(*pair, F.col("pair_id").alias("train_id"))
    # an evaluation record stands for every two training listings that are the same as its own
    p = links.select(F.col("listing").alias("x"), F.col("others").alias("xs"))
    q = links.select(F.col("listing").alias("y"), F.col("others").alias("ys"))
    other = hot_split_join(hot_split_join(mapped.where("not train"), p, "x", "left"), q, "y", "left")
    exact = other.where("xs is null and ys is null").select("pair_id", *pair)
    near = other.where("xs is not null or ys is not null")
    near = near.select("pair_id", F.explode(F.array_union(F.array("x"), F.coalesce("xs", F.array().cast("array<bigint>")))).alias("x"), "y", "ys")
    near = near.select("pair_id", "x", F.explode(F.array_union(F.array("y"), F.coalesce("ys", F.array().cast("array<bigint>")))).alias("y")).select("pair_id", *pair).distinct()
    other = exact.unionByName(near).select("a", "b", F.col("pair_id").alias("other_id"))
    h = F.xxhash64("a", "b")
    left = train.withColumn("h", h)
    right = other.select(F.col("a").alias("a2"), F.col("b").alias("b2"), "other_id").withColumn("h", F.xxhash64("a2", "b2"))
    met = salted_join(left, right, "h").where("a = a2 and b = b2")
    return met.select(F.least("train_id", "other_id").alias("pair_id1"), F.greatest("train_id", "other_id").alias("pair_id2"), "train_id", "other_id")


def report(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per split and source: records, and those that overlap with training."""
    hit = found.select(F.col("other_id").alias("pair_id")).distinct().withColumn("hit", F.lit(1))
    per = rows.where("not train").join(hit, "pair_id", "left").groupBy("split_name", "source")
    return per.agg(F.count(F.lit(1)).alias("n_records"), F.count("hit").alias("n_overlapping")).withColumn("share", F.col("n_overlapping") / F.col("n_records"))
