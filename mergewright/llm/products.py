"""Listings of the same product, whoever sells them and however they put it.

Listings are read into typed tokens (``listing``): brand, series, type and
varying features. The type is the listing's category. What the series is, is
learned from the corpus, not from a table:

* a series that listings state under a key is known for their brand, and is
  looked for among the words of the brand's other names (longest first);
* where none is found, the series starts at the word of the name that the fewest
  brands use (at least ``OWN`` of its listings are of one brand; of such words the
  most frequent, then the first one);
* a series of one word takes in a next word that ends stated series of any brand.

A listing without a category has that of its series, if all others agree. Every
feature that two listings state must agree, but for the weight, which catalogues
add to products that it doesn't tell apart: it counts within a series (and type)
if more than ``MOST`` of its listings state it. Listings with equal tokens are
one representative, so copies never meet in pairs.

Method: multi-pass sorted neighbourhood. The representatives are sorted by
several token orders; along each order every one is compared with its next
``WINDOW`` neighbours by soft token alignment (equal, one slip apart, or within
the rounding of converted units; what only one of them states costs a little).
Agreements become edges, and correlation clustering by pivots turns edges into
groups without chaining: a pivot takes its undecided neighbours, nothing more.

Scale: one narrow pass reads the current rows (``current_narrow``). Words and
series meet by equi-joins, whose hot keys adaptive execution splits. A sorted
order is cut into range partitions that are read as streams; the rows next to a
cut are compared across it afterwards, so every two rows at most ``WINDOW``
places apart meet, however the order is cut. Keys end in the representative's id,
so a brand or product with most of the rows is cut like any other stretch. Pairs
come out by an equi-join on group and block, with large groups cut into blocks.

Defined results: the current row of an id counts, of rows that tie on
``updated_at`` the one with the greater text; a null id is left out; null, blank
and unreadable fields say nothing; a listing without a series, or that says less
than ``LEAST_SCORE``, is a group by itself in ``grouped`` and in no pair; no pack
stated means one piece; an id without another listing gives no pair; empty tables
give an empty one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quantities
from ..operators.skew import hot_keys
from ..session import Scratch, parallelism
from ..sources.tables import current_narrow
from . import listing
from .overlap import within_one_slip

#: Brands are looked up by their words, at a cost that doesn't grow with them; the
#: table travels with the tasks, so its rows are checked.
MAX_BRANDS = 1_000_000
#: Share of a word's listings that are of one brand, for a word that names a series.
OWN = 0.5
#: Share of a series' listings above which the weight counts.
MOST = 0.5
WINDOW = 12
#: Relative difference that the rounding of converted amounts explains.
ROUNDING = 0.035
LEAST_SCORE = 4.0
#: Members of a group that meet as one block.
BLOCK = 1_000

KINDS = ("weight", "volume", "length", "memory", "power", "battery")
WHO = ("brand", "series", "type")
FEATURES = ("colour", "size", "pack", *KINDS)
FIELDS = (*WHO, *FEATURES)
WEIGHTS = {"brand": 1.0, "series": 2.0, "type": 1.0}


def read_listings(items: DataFrame, brands: DataFrame, units: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, brand, series as stated, type, colour, size, pack, a column per kind,
    words) of every current row."""
    rows = brands.select("brand", "brand_ru").where("brand is not null").distinct().limit(MAX_BRANDS + 1).collect()
    if len(rows) > MAX_BRANDS:
        raise ValueError(f"more than {MAX_BRANDS} brands")
    table = [(r[0], r[1]) for r in rows]
    ways = {s: (k, a, b) for s, k, _, a, b in quantities.conversions(units)}
    texts = items.select("id", "updated_at", *[F.col(c).cast("string") for c in ("name", "attributes", "category")])
    src = current_narrow(texts, scratch, "name", "attributes", "category")
    kinds = {f: pa.int64() if f in KINDS or f == "pack" else pa.string() for f in FIELDS}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = listing.Reader(listing.Brands.of(table), quantities.patterns(tuple(ways)))
        for b in batches:
            cols: dict[str, list] = {f: [] for f in (*FIELDS, "words")}
            for name, text, category in zip(*(c.to_pylist() for c in b.columns[1:])):
                got = reader.read(name, text)
                got["type"] = (category or "").strip().lower() or None
                amounts: dict[str, int] = {}
                for n, u in got["amounts"]:
                    if (way := ways.get(u)) and way[0] in KINDS:
                        amounts.setdefault(way[0], round(n * way[1] + way[2]))
                for f in (*WHO, "colour", "size", "pack", "words"):
                    cols[f].append(got[f])
                for k in KINDS:
                    cols[k].append(amounts.get(k))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[f], kinds[f]) for f in FIELDS), pa.array(cols["words"], pa.list_(pa.string()))], ["id", *FIELDS, "words"])

    shape = ", ".join(f"{f} {'long' if f in KINDS or f == 'pack' else 'string'}" for f in FIELDS)
    return src.mapInArrow(read, f"id long, {shape}, words array<string>")


def learned_series(listings: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, learned) of listings that state no series but name one."""
    stated = scratch.save(listings.where("series is not null").select("brand", "series").distinct(), "stated")
    open_ = listings.where("series is null and size(words) > 0").select("id", "brand", "words")
    # the lengths of stated series in words: a few small numbers
    lengths = sorted(r[0] for r in stated.select(F.size(F.split("series", " "))).distinct().collect())
    b = F.coalesce("brand", F.lit(""))

    def span(n: int):
        hashed = F.when(F.col("at") + n <= F.size("words"), F.xxhash64(b, F.slice("words", F.col("at") + 1, F.lit(n))))
        return F.struct(hashed.alias("h"), (F.lit(n).cast("long") * 2**32 - F.col("at")).alias("rank"))

    # spans of words are hashes here; the longest that is a stated series, and of these the first
    spans = open_.select("id", "brand", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at")).where(F.element_at("words", F.col("at") + 1) != "")
    spans = spans.select("id", F.inline(F.array(*[span(n) for n in lengths or [1]]))).where("h is not null")
    known = stated.select(F.xxhash64(b, F.split("series", " ")).alias("h")).distinct()
    best = spans.join(known, "h", "left_semi").groupBy("id").agg(F.max("rank").alias("rank"))
    length = F.ceil(F.col("rank") / 2**32).cast("int")
    at = (length.cast("long") * 2**32 - F.col("rank")).cast("int")
    head, after = F.array_join(F.slice("words", at + 1, length), " "), at + length + 1
    next_ = F.when(after <= F.size("words"), F.element_at("words", after))
    open_ = scratch.save(open_.join(best, "id", "left").select("id", "words", F.when(F.col("rank").isNotNull(), head).alias("head"), F.when(F.col("rank").isNotNull(), next_).alias("next")), "open")
    heads = open_.where("head is not null").select("id", "head", "next")
    open_ = open_.where("head is null").select("id", "words")

    # what brands use a word, over all listings
    uses = listings.select(F.coalesce("brand", F.lit("")).alias("brand"), F.explode(F.array_distinct("words")).alias("word")).groupBy("word", "brand").agg(F.count(F.lit(1)).alias("n"))
    words = uses.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("spread"), F.max("n").alias("top"))
    letters = F.col("word").rlike(r"\p{L}") & (F.length("word") > 2)
    places = open_.select("id", F.posexplode("words").alias("at", "word")).where(letters)
    own = places.join(words.where(F.col("top") >= OWN * F.col("n")), "word")
    best = own.groupBy("id").agg(F.min(F.struct("spread", (-F.col("n")).alias("n"), "at")).alias("b")).select("id", F.col("b.at").alias("at"))
    rest = open_.join(best, "id").select("id", F.element_at("words", F.col("at") + 1).alias("head"), F.when(F.col("at") + 1 < F.size("words"), F.element_at("words", F.col("at") + 2)).alias("next"))
    ends = stated.where("series like '% %'").select(F.substring_index("series", " ", -1).alias("next")).distinct().withColumn("ends", F.lit(True))
    # a head of one word takes in a next word that ends series
    more = F.when(F.col("ends") & ~F.col("head").contains(" "), F.col("next"))
    return heads.unionByName(rest).join(ends, "next", "left").select("id", F.concat_ws(" ", "head", more).alias("learned"))


def keys() -> dict:
    """Two hashes of all fields; nulls are values, or they would be skipped."""
    filled = [F.coalesce(f, F.lit(-1).cast("long") if f in KINDS or f == "pack" else F.lit("")) for f in FIELDS]
    return {"k1": F.xxhash64(F.lit(1), *filled), "k2": F.xxhash64(F.lit(2), *filled)}


def _family(*columns: str):
    return F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def signatures(listings: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (id, k1, k2) and representatives (k1, k2, rep, n, told, t, a text per order)."""
    named = learned_series(listings, scratch)
    own = listings.join(named, "id", "left").withColumns({"series": F.coalesce("series", "learned"), "pack": F.coalesce("pack", F.lit(1).cast("long"))}).select("id", *FIELDS)
    own = scratch.save(own, "named")
    per = own.groupBy("brand", "series", "type").agg(F.count(F.lit(1)).alias("n"), F.count("weight").alias("nw"))
    per = scratch.save(per, "families")
    whole = per.groupBy("brand", "series").agg(F.count("type").alias("types"), F.max("type").alias("only"), F.sum("n").alias("all"), F.sum("nw").alias("all_w"))
    whole = whole.select(_family("brand", "series").alias("family"), "types", "only", "all", "all_w")
    weighs = F.when(F.col("types") > 1, F.col("nw") > F.col("n") * MOST).otherwise(F.col("all_w") > F.col("all") * MOST)
    facts = per.withColumn("family", _family("brand", "series")).join(whole, "family")
    facts = facts.select(_family("brand", "series", "type").alias("family"), weighs.alias("weighs"), F.when(F.col("types") == 1, F.col("only")).alias("only"))
    both = own.withColumn("family", _family("brand", "series", "type")).join(facts, "family")
    kept = both.withColumns({"weight": F.when(F.col("weighs"), F.col("weight")), "type": F.coalesce("type", "only")}).select("id", *FIELDS)
    kept = scratch.save(kept.withColumns(keys()), "kept")
    reps = kept.groupBy(*FIELDS).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumns(keys())
    # the texts of all orders are made once
    reps = reps.withColumns({"told": told(), "t": tokens()} | {f"order{i}": o for i, o in enumerate(orders())})
    return kept.select("id", "k1", "k2"), scratch.save(reps.drop(*FIELDS), "reps")


def _amount(f: str):
    return F.lpad(F.coalesce(F.col(f).cast("string"), F.lit("")), 12, "0")


def orders() -> list[object]:
    """Token orders of the passes, as one comparable text each: amounts last,
    amounts turned round without regard to the brand, colour last by the series'
    last letters, and the series last."""
    p = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in (*WHO, "colour", "size", "pack")}
    amounts = [_amount(k) for k in KINDS]

    def key(*cols):
        return F.concat_ws("|", *cols, F.lpad(F.col("rep").cast("string"), 20, "0"))

    return [
        key(p["brand"], p["series"], p["type"], p["colour"], p["size"], p["pack"], *amounts),
        key(p["series"], p["colour"], p["size"], p["pack"], p["type"], p["brand"], *reversed(amounts)),
        key(F.reverse(p["series"]), p["brand"], p["size"], p["pack"], *amounts, p["colour"], p["type"]),
        key(p["brand"], p["colour"], p["size"], p["pack"], *amounts, p["series"], p["type"]),
    ]


def told() -> object:
    """Whether a wording says enough to be compared."""
    says = sum((F.when(F.col(f).isNotNull(), F.lit(WEIGHTS.get(f, 1.0))).otherwise(F.lit(0.0)) for f in FIELDS), F.lit(0.0))
    return F.col("series").isNotNull() & (says >= LEAST_SCORE)


def agree(a: list[str], b: list[str]) -> float:
    """Soft alignment of two token lists (texts in the order of FIELDS, empty where
    nothing is said): a score, or less than 0 on any conflict."""
    score = 0.0
    for i, x, y, w in zip(_INDEX, a, b, _WEIGHT):
        if x == y:
            if x:
                score += w
        elif not x or not y:
            score -= 0.5
        elif i >= _FIRST_KIND:
            # weight, length and the like come rounded from other units
            p, q = int(x), int(y)
            if abs(p - q) > ROUNDING * max(abs(p), abs(q)) + 1:
                return -1.0
            score += 1.0
        elif i < 2 and len(x) > 5 and len(y) > 5 and _slip_in_long_word(x, y):
            score += 0.5
        else:
            return -1.0
    return score


_INDEX, _WEIGHT, _FIRST_KIND = range(len(FIELDS)), [WEIGHTS.get(f, 1.0) for f in FIELDS], FIELDS.index(KINDS[0])
_SEPARATOR = "\x1f"


def tokens() -> object:
    """All fields as one text, which ``agree`` takes apart."""
    return F.concat_ws(_SEPARATOR, *[F.coalesce(F.translate(F.col(f).cast("string"), _SEPARATOR, " "), F.lit("")) for f in FIELDS])


def _slip_in_long_word(x: str, y: str) -> bool:
    """Whether two names differ by a missing or doubled letter in one word of
    over five letters; sisters of a series differ by whole or short words."""
    if abs(len(x) - len(y)) != 1 or not within_one_slip(x, y):
        return False
    a, b = x.split(), y.split()
    other = [(u, v) for u, v in zip(a, b) if u != v]
    return len(a) == len(b) and len(other) == 1 and min(map(len, other[0])) > 5


def _compare(last: deque, rep: int, n: int, tokens: list, out: list) -> None:
    """Compare a row with the last ones. Rows of another series that can't be a
    slip of this one's (a letter more or less) are passed over at once."""
    series = tokens[1]
    near = len(series) - 1, len(series) + 1
    for other, m, toks in last:
        if (toks[1] == series or len(toks[1]) in near) and (s := agree(toks, tokens)) >= LEAST_SCORE:
            out.append((rep, other, s, n, m) if rep < other else (other, rep, s, m, n))
    last.append((rep, n, tokens))


_EDGE = ["u", "v", "score", "nu", "nv"]
_EDGE_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
_EDGE_SHAPE = "u long, v long, score double, nu long, nv long"


def _edges(out: list) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, _EDGE_TYPES)]


def neighbours(reps: DataFrame, key: object, scratch: Scratch) -> DataFrame:
    """Edges (u, v, score, members of either) between rows at most WINDOW places apart in the order
    of the key that agree.

    The order is cut into range partitions, which are read as streams. Their
    first and last WINDOW rows come out as well and are compared across the cuts
    in one small step: 2 x WINDOW rows per partition, whatever the data's size.
    Where a partition's first and last rows aren't neighbours, the step starts
    anew, so the edges are the same however the order is cut.
    """
    n = parallelism(reps.sparkSession)
    ordered = reps.select("rep", "n", "t", key.alias("key")).repartitionByRange(n, "key").sortWithinPartitions("key").drop("key")

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        last: deque = deque(maxlen=WINDOW)
        head: list = []
        for b in batches:
            out: list = []
            for rep, n_, t in zip(*(c.to_pylist() for c in b.columns)):
                if place < WINDOW:
                    head.append((place, rep, n_, t))
                _compare(last, rep, n_, t.split(_SEPARATOR), out)
                place += 1
            yield batch(_edges(out), [], part)
        tail = [(place - len(last) + i, rep, n_, _SEPARATOR.join(t)) for i, (rep, n_, t) in enumerate(last)]
        yield batch(_edges([]), list({x[0]: x for x in (*head, *tail)}.values()), part)

    def batch(edges: list[pa.Array], rows: list, part: int) -> pa.RecordBatch:
        m, k = len(edges[0]), len(rows)
        cols = [pa.concat_arrays([e, pa.nulls(k, e.type)]) for e in edges]
        cols.append(pa.array([None] * m + [part] * k, pa.int32()))
        cols += [pa.array([None] * m + [r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(cols, [*_EDGE, "part", "place", "rep", "n", "t"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: deque = deque(maxlen=WINDOW)
        before = (-1, -1)
        for b in batches:
            out: list = []
            for part, place, rep, n_, t in zip(*(c.to_pylist() for c in b.columns)):
                if part == before[0] and place != before[1] + 1:
                    last.clear()
                before = part, place
                _compare(last, rep, n_, t.split(_SEPARATOR), out)
            yield pa.RecordBatch.from_arrays(_edges(out), _EDGE)

    slid = scratch.save(ordered.mapInArrow(slide, f"{_EDGE_SHAPE}, part int, place long, rep long, n long, t string"), "slid")
    cuts = slid.where("rep is not null").select("part", "place", "rep", "n", "t").repartition(1).sortWithinPartitions("part", "place")
    return slid.where("u is not null").select(*_EDGE).unionByName(cuts.mapInArrow(across, _EDGE_SHAPE))


def pivots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Correlation clustering: (rep, centre) of every end of an edge.

    A vertex that comes before all its undecided neighbours (more members, then
    by hash) is a pivot and takes those neighbours; a neighbour of several pivots
    goes to the one it agrees with best. Repeated until all are decided.
    """
    def rank(n: str, v: str):
        return F.struct((-F.col(n)).alias("n"), F.xxhash64(v).alias("h"), F.col(v).alias("rep"))

    both = edges.select("u", "v", "score", rank("nu", "u").alias("ru"), rank("nv", "v").alias("rv"))
    arcs = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "score", F.col("rv").alias("ru"), F.col("ru").alias("rv")))
    left, done = scratch.save(arcs, "arcs"), []
    while not left.isEmpty():
        first = left.groupBy("u", "ru").agg(F.min("rv").alias("best")).where(F.col("ru") < F.col("best")).select(F.col("u").alias("pivot"))
        first = scratch.save(first, "pivots")
        taken = left.join(first, left["u"] == first["pivot"]).groupBy(F.col("v").alias("rep")).agg(F.max_by("pivot", F.struct("score", F.struct(-F.col("pivot")))).alias("centre"))
        decided = scratch.save(first.select(F.col("pivot").alias("rep"), F.col("pivot").alias("centre")).unionByName(taken), "decided")
        done.append(decided)
        gone = decided.select(F.col("rep"))
        rest = left.join(gone, left["u"] == gone["rep"], "left_anti")
        rest = rest.join(gone, rest["v"] == gone["rep"], "left_anti")
        nxt = scratch.save(rest, "arcs")
        scratch.drop(left, first)
        left = nxt
    if not done:
        return edges.select(F.col("u").alias("rep"), F.col("v").alias("centre")).limit(0)
    return reduce(DataFrame.unionByName, done)


def groups(items: DataFrame, brands: DataFrame, units: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members, named): members are (id, k1, k2); named has (k1, k2, told, product,
    total) of every wording (tokens that listings share). Listings of one product share a number, the least id
    of its centre, and ``total`` is the number of its listings; ``told`` is whether
    a wording says enough to be compared."""
    members, reps = signatures(scratch.save(read_listings(items, brands, units, scratch), "read"), scratch)
    known = reps.where("told")
    found = [neighbours(known, F.col(f"order{i}"), scratch) for i in range(len(orders()))]
    edges = scratch.save(reduce(DataFrame.unionByName, found).groupBy("u", "v").agg(F.max("score").alias("score"), F.max("nu").alias("nu"), F.max("nv").alias("nv")), "edges")
    centre = pivots(edges, scratch)
    named = reps.select("k1", "k2", "rep", "n", "told").join(centre, "rep", "left").select("k1", "k2", "n", "told", F.coalesce("centre", "rep").alias("product"))
    named = scratch.save(named, "products")
    totals = named.where("told").groupBy("product").agg(F.sum("n").alias("total"))
    return members, scratch.save(named.join(totals, "product", "left").withColumn("total", F.coalesce("total", F.lit(1))), "totals")


def _placed(members: DataFrame, named: DataFrame) -> DataFrame:
    """Members with their wording's columns. Wordings that many listings share are
    joined apart, on the spot: few, by ``hot_keys``' proven bound."""
    hot = hot_keys(members, "k1")
    if not hot:
        return members.join(named, ["k1", "k2"])
    is_hot = F.col("k1").isin(hot)
    return members.where(~is_hot).join(named.where(~is_hot), ["k1", "k2"]).unionByName(members.where(is_hot).join(F.broadcast(named.where(is_hot)), ["k1", "k2"]))


def grouped(members: DataFrame, named: DataFrame) -> DataFrame:
    """(id, product, n_listings) of every listing."""
    n = F.when(F.col("told"), F.col("total")).otherwise(F.lit(1))
    return _placed(members, named).select("id", F.when(F.col("told"), F.col("product")).otherwise(F.col("id")).alias("product"), n.cast("long").alias("n_listings"))


def pairs(members: DataFrame, named: DataFrame) -> DataFrame:
    """(id1, id2), id1 < id2, of every pair within a group.

    Groups over BLOCK members are cut into blocks by hash; every two blocks of a
    group meet as one key, so no task holds a whole large group.
    """
    several = named.where("told and total > 1").select("k1", "k2", "product", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"))
    cut = _placed(members, several).select("id", "product", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    # the keys (lesser block, greater block) that a member takes part in
    with_ = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("lo"), F.greatest(F.col("block"), j).alias("hi")))
    spread = cut.select("product", "id", "block", F.inline(with_))
    a = spread.where("block = lo").select("product", "lo", "hi", F.col("id").alias("x"))
    b = spread.where("block = hi").select("product", "lo", "hi", F.col("id").alias("y"))
    met = a.join(b, ["product", "lo", "hi"]).where("x <> y and (lo < hi or x < y)")
    return met.select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"))


def agreement(products: DataFrame, matches: DataFrame) -> DataFrame:
    """How the groups agree with the noisy labels: rows per label side and
    whether the two listings share a group, without repeated pairs."""
    known = matches.where("id1 is not null and id2 is not null and id1 <> id2 and target is not null")
    votes = known.groupBy(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).agg(F.avg("target").alias("target"))
    a = products.select(F.col("id").alias("id1"), F.col("product").alias("p1"))
    b = products.select(F.col("id").alias("id2"), F.col("product").alias("p2"))
    both = votes.join(a, "id1").join(b, "id2")
    return both.groupBy((F.col("target") >= 0.5).alias("labelled_same"), (F.col("p1") == F.col("p2")).alias("grouped_same")).agg(F.count(F.lit(1)).alias("n_pairs"))
