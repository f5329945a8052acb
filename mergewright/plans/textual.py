"""Queries of text functions, scorers, sinks, checks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.mask import masked, masked_json
from ..operators import checks as V
from ..operators import joins as J
from ..operators import scoring as M
from ..session import Scratch
from ..sources import io
from ..sources.tables import current_rows, table
from ..streaming import pairs as streams
from .fixtures import pairs, pairs_sql
from .registry import query
from .relational import CURRENT_SQL, JOINED_SQL, texts_of

#: White space by its Unicode property, and the separators Python adds, for RE2.
WS = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NAMES_SQL = f"(select id, coalesce(name, '') as name from {CURRENT_SQL})"
CYR, LAT = X.CYRILLIC_IN, X.LATIN_OUT
UNITS_RE = "|".join(X.UNITS)
WIDE_SQL = "translate({x}, '０１２３４５６７８９,', '0123456789.')"


def _names(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "items", "id", "name", "attributes", "updated_at", "loaded_at")
    return current_rows(i, "name", "attributes").select("id", F.coalesce("name", F.lit("")).alias("name"), "attributes")


@query("text_basics", f"select id, lower(translate(name, 'ёЁ', 'еЕ')) as low, length(name) as len, substr(name, 1, 20) as head from {NAMES_SQL}")
def text_basics(spark: SparkSession, d: str) -> DataFrame:
    """X5, X14, X15, K6."""
    return _names(spark, d).select("id", F.lower(X.without_yo(F.col("name"))).alias("low"), F.length("name").cast("long").alias("len"), F.substring("name", 1, 20).alias("head"))


@query("token_rejoin", f"select id, trim(regexp_replace(name, '{WS}+', ' ', 'g')) as text from {NAMES_SQL}")
def token_rejoin(spark: SparkSession, d: str) -> DataFrame:
    """X6, X4."""
    return _names(spark, d).select("id", F.array_join(X.tokens(F.col("name")), " ").alias("text"))


_FIX = f"""case when length(regexp_replace(t, '[^\\x{{400}}-\\x{{4ff}}]', '', 'g')) > 0 and length(regexp_replace(t, '[^A-Za-z]', '', 'g')) > 0
  then case when length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= length(regexp_replace(t, '[^\\x{{400}}-\\x{{4ff}}]', '', 'g')) then translate(t, '{CYR}', '{LAT}') else translate(t, '{X.LATIN_IN}', '{X.CYRILLIC_OUT}') end else t end"""
REPAIRED_SQL = f"(select id, array_to_string([{_FIX} for t in string_split(trim(regexp_replace(translate(name, 'ёЁ', 'еЕ'), '{WS}+', ' ', 'g')), ' ')], ' ') as text from {NAMES_SQL})"
BASE_SQL = f"(select id, regexp_replace(text, '[×хХ](\\p{{Nd}})', 'x\\1', 'g') as text from {REPAIRED_SQL})"


def _base(name):
    return X.times_sign(F.array_join(F.transform(X.tokens(X.without_yo(name)), X.repaired_token), " "))


@query("homoglyph_fix", f"select id, text from {BASE_SQL}")
def homoglyph_fix(spark: SparkSession, d: str) -> DataFrame:
    """X7, X8 over X5 and X6."""
    return _names(spark, d).select("id", _base(F.col("name")).alias("text"))


UNIT_SQL_RE = rf"(?i)(\p{{Nd}}+(?:[.,]\p{{Nd}}+)?){WS}*({UNITS_RE})(?:$|[^\p{{L}}\p{{N}}_])"


@query(
    "unit_canon",
    f"""with m as (select id, text, regexp_extract_all(text, '{UNIT_SQL_RE}', 1) as n, regexp_extract_all(text, '{UNIT_SQL_RE}', 2) as u from {BASE_SQL}),
    e as (select id, unnest(n) as n, lower(unnest(u)) as u from m),
    f as (select id, try_cast({WIDE_SQL.format(x='n')} as double) * case u {" ".join(f"when '{u}' then {f}::double" for u, (_, f) in X.UNITS.items())} end as v, case u {" ".join(f"when '{u}' then '{b}'" for u, (b, _) in X.UNITS.items())} end as b from e)
    select id, string_agg(s, ' ' order by s) as units from (select distinct id, printf('%g', v) || b as s from f where v is not null) group by id""",
)
def unit_canon(spark: SparkSession, d: str) -> DataFrame:
    """X9, X10."""
    u = X.canonical_units(_base(F.col("name")))
    return _names(spark, d).select("id", u.alias("u")).where(F.size("u") > 0).select("id", F.array_join("u", " ").alias("units"))


@query(
    "pack_qty",
    f"""with b as (select id, lower(text) as t from {BASE_SQL}), q as (select id, coalesce(
      try_cast({WIDE_SQL.format(x="regexp_extract(t, '(" + chr(92) + "p{Nd}+)" + WS + "*(?:набор|упаков|комплект)[" + chr(92) + "p{L}" + chr(92) + "p{N}_]*" + WS + "+по" + WS + "+(" + chr(92) + "p{Nd}+)', 1)")} as bigint) * try_cast({WIDE_SQL.format(x="regexp_extract(t, '(" + chr(92) + "p{Nd}+)" + WS + "*(?:набор|упаков|комплект)[" + chr(92) + "p{L}" + chr(92) + "p{N}_]*" + WS + "+по" + WS + "+(" + chr(92) + "p{Nd}+)', 2)")} as bigint),
      try_cast({WIDE_SQL.format(x="regexp_extract(t, '(" + chr(92) + "p{Nd}+)" + WS + "*шт', 1)")} as bigint),
      try_cast({WIDE_SQL.format(x="regexp_extract(t, 'набор[" + chr(92) + "p{L}" + chr(92) + "p{N}_]*" + WS + "+из" + WS + "+(" + chr(92) + "p{Nd}+)', 1)")} as bigint),
      try_cast({WIDE_SQL.format(x="regexp_extract(t, '[xх*](" + chr(92) + "p{Nd}+)(?:$|[^" + chr(92) + "p{L}" + chr(92) + "p{N}_])', 1)")} as bigint)) as q from b)
    select id, case when q between 2 and 1000 then q end as q from q where q is not null""",
)
def pack_qty(spark: SparkSession, d: str) -> DataFrame:
    """X11, X12."""
    n = _names(spark, d).select("id", X.pack_quantity(_base(F.col("name"))).alias("n")).where("n is not null")
    return n.select("id", X.guarded_quantity(F.col("n")).alias("q"))


@query("pair_text_v1")
def pair_text_v1(spark: SparkSession, d: str) -> DataFrame:
    """X13 (X1 to X12, K5, K6): native comparison text, first contract."""
    return _names(spark, d).select("id", X.pair_text(F.col("name"), F.col("attributes"), "v1").alias("text"))


@query("pair_text_v2")
def pair_text_v2(spark: SparkSession, d: str) -> DataFrame:
    """Second contract."""
    return _names(spark, d).select("id", X.pair_text(F.col("name"), F.col("attributes"), "v2").alias("text"))


@query("pair_text_exact")
def pair_text_exact(spark: SparkSession, d: str) -> DataFrame:
    """X13 with exact JSON value types, Arrow-batched."""
    return _names(spark, d).select("id", X.pair_text_exact("v1")("name", "attributes").alias("text"))


@query("key_priority")
def key_priority(spark: SparkSession, d: str) -> DataFrame:
    """Attribute keys in the order of the contract."""
    e = X.ordered_entries(X.kept_entries(X.json_entries(F.col("attributes"))), X.V1)
    return _names(spark, d).select("id", F.posexplode(F.transform(e, lambda x: x["key"])).alias("place", "key"))


_TOK = f"list_filter(list_distinct(string_split(lower(regexp_replace(@, '{WS}+', ' ', 'g')), ' ')), lambda t: t <> '')"


def _symmetric_sql(joined: str) -> str:
    return f"""with j as (select pair_id, {_TOK.replace('@', 'text1')} as a, {_TOK.replace('@', 'text2')} as b from ({joined}))
  select pair_id, round(case when len(list_distinct(a || b)) > 0 then len(list_intersect(a, b))::double / len(list_distinct(a || b)) else 0.0 end, 6) as predict from j"""


def _symmetric(spark: SparkSession, d: str, texts: DataFrame) -> DataFrame:
    j = J.pair_texts(pairs(spark, d), texts)
    one, two = M.token_jaccard(F.col("text1"), F.col("text2")), M.token_jaccard(F.col("text2"), F.col("text1"))
    return j.select("pair_id", F.round((one + two) * 0.5, 6).alias("predict"))


@query("symmetric_score", _symmetric_sql(JOINED_SQL))
def symmetric_score(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2, X21 natively with the whole catalogue."""
    return _symmetric(spark, d, texts_of(spark, d))


@query("plugged_scorer")
def plugged_scorer(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2, K2: a scorer made once per task, in length buckets."""
    j = J.pair_texts(pairs(spark, d).select("pair_id", "id1", "id2"), texts_of(spark, d)).drop("has1", "has2")
    return M.score_pairs(j, M.TokenJaccard, both_ways=True, buckets=8).select("pair_id", F.round("predict", 6).alias("predict"))


@query("embedding_cosine", f"""with p as (select pair_id, (id1 % (select count(*) from embeddings))::bigint as a, (id2 % (select count(*) from embeddings))::bigint as b from ({pairs_sql()}))
  select pair_id, round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 5) as predict from p join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b""")
def embedding_cosine(spark: SparkSession, d: str) -> DataFrame:
    """A second scorer: cosine of stored vectors."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    n = e.count()
    p = pairs(spark, d).select("pair_id", (F.col("id1") % n).alias("a"), (F.col("id2") % n).alias("b"))
    j = p.join(e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb")), "b")
    return j.select("pair_id", F.round(M.cosine(F.col("ea"), F.col("eb")), 5).alias("predict"))


@query("masking", "select event_id, replace(event_type, 'click', '***') as event_type, props from events")
def masking(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a JSON text are no strings, so the structure stays."""
    e = table(spark, d, "events", "event_id", "event_type", "props")
    return e.select("event_id", masked(F.col("event_type"), ["click"]).alias("event_type"), masked_json(F.col("props"), "[0-9]+").alias("props"))


@query("digests", "select r_name, sha256(r_name) as digest from region")
def digests(spark: SparkSession, d: str) -> DataFrame:
    """X23."""
    return table(spark, d, "region", "r_name").select("r_name", F.sha2("r_name", 256).alias("digest"))


@query("sinks_round_trip", f"select count(*) as n, round(sum(target), 4) as total from ({pairs_sql()})")
def sinks_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """CSV with a checked count, Parquet and JSON lines."""
    scratch = Scratch(spark, "sinks")
    x = pairs(spark, d)
    csv, pq, js = (scratch.path(k) for k in ("csv", "parquet", "json"))
    io.write_parquet(x, pq, "split_name")
    back = spark.read.parquet(pq)
    io.write_csv(back.select("pair_id", "target"), csv, expected=back.count())
    io.append_events(spark.read.option("header", True).schema("pair_id long, target double").csv(csv), js)
    return spark.read.schema("pair_id long, target double").json(js).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("target"), 4).alias("total"))


@query("partial_cache", f"select source, count(*) as n from ({pairs_sql()}) group by source")
def partial_cache(spark: SparkSession, d: str) -> DataFrame:
    """S13 over every source of the table."""
    where, x = Scratch(spark, "cache").path("parts"), pairs(spark, d)
    io.cached_parts(spark, where, "source", {"human": lambda: x.where("source = 'human'").drop("source")})
    sources = sorted(r["source"] for r in x.select("source").distinct().collect())
    parts = {s: (lambda s=s: x.where(F.col("source") == s).drop("source")) for s in sources}
    return io.cached_parts(spark, where, "source", parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("command_rows", "select * from (values (0, 81559), (1, 40960)) t(gpu, free_mb)")
def command_rows(spark: SparkSession, d: str) -> DataFrame:
    """A command's output as rows."""
    return io.command_table(spark, "0, 81559\n1, 40960\n", "gpu int, free_mb int")


@query("file_manifest")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """V1, V2, V5: the folder's files with length and digest."""
    files = io.listing(spark, d, "*.parquet")
    if not V.passed(V.forbidden(files, [".zip", ".pt"], 2**31)):
        raise ValueError("forbidden files")
    return V.manifest(files)


@query("json_lines_check", "select count(*) filter (attributes is not null and trim(attributes) <> '' and not json_valid(attributes)) as n_malformed from items")
def json_lines_check(spark: SparkSession, d: str) -> DataFrame:
    """V3: texts that aren't JSON at all (objects whose keys repeat are)."""
    a = F.col("attributes")
    valid = F.from_json(a, "map<string,string>").isNotNull() | F.expr("try_parse_json(attributes)").isNotNull()
    return table(spark, d, "items", "attributes").agg(F.count(F.when(a.isNotNull() & (F.trim(a) != "") & ~valid, 1)).alias("n_malformed"))


@query("registry_check", "select 'unknown' as what, 'x9' as detail")
def registry_check(spark: SparkSession, d: str) -> DataFrame:
    """V7."""
    c = spark.createDataFrame([("c1", 1, 0.51), ("c2", 2, 0.55), ("c3", 3, 0.553)], "name string, position int, score double")
    s = spark.createDataFrame([("c3", 0.553), ("x9", 0.1)], "name string, score double")
    return V.registry_problems(c, s)


def _stream_sql(joined: str) -> str:
    return f"select count(*) as n, sum((text1 <> '')::int)::bigint as n_text1, round(sum(target), 4) as total from ({joined})"


def _streamed(spark: SparkSession, d: str, texts: DataFrame) -> DataFrame:
    scratch = Scratch(spark, "stream")
    src = scratch.save(pairs(spark, d), "pairs")
    stream = streams.with_texts(streams.pair_stream(spark, src._scratch_path, src.schema), texts)
    out = scratch.path("out")
    streams.run_available(stream.select("pair_id", "target", "text1", "text2"), out, scratch.path("offsets"))
    got = spark.read.parquet(out)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("text1") != "", 1)).alias("n_text1"), F.round(F.sum("target"), 4).alias("total"))


@query("stream_pairs", _stream_sql(JOINED_SQL))
def stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    """S3, J1 as a stream with the whole catalogue."""
    return _streamed(spark, d, texts_of(spark, d))


@query("event_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windowed counts with a watermark (the same plan runs on a stream)."""
    return streams.windowed_counts(table(spark, d, "events", "ts", "event_type"), "ts", "1 hour", "1 hour", "event_type")


@query("ordered_listing")
def ordered_listing(spark: SparkSession, d: str) -> DataFrame:
    """K4: the folder's tables in order, then two extra names."""
    return io.ordered_listing(spark, d, "*.parquet", ("last", "last_ema"))


@query("prediction_contract", "select 'contract' as what, concat_ws(',', id1::varchar, id2::varchar, round(target::double, 4)::varchar) as detail from matches where id1 is null or id2 is null or target is null or not target between 0.0 and 1.0")
def prediction_contract(spark: SparkSession, d: str) -> DataFrame:
    """V6: records whose ids or score break the contract of predictions."""
    m = table(spark, d, "matches", "id1", "id2", "target")
    return V.data_contract(m.select("id1", "id2", F.round(F.col("target").cast("double"), 4).alias("predict")))


@query("text_hygiene", "select 'fence' as what, doc_id::varchar as detail from documents where ((length(text) - length(replace(text, '```', ''))) // 3) % 2 = 1 union all select 'secret', 'AWS access key: ' || doc_id::varchar from documents where regexp_matches(text, '\\bAKIA[0-9A-Z]{16}\\b')")
def text_hygiene(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an odd number of fences or a credential's shape."""
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("value"))
    return V.unbalanced_fences(docs).unionByName(V.leaked_secrets(docs))


@query("required_files", "select 'required' as what, 'labels.csv' as detail")
def required_files(spark: SparkSession, d: str) -> DataFrame:
    """V1: of the files that should be there, those that are missing or empty."""
    return V.required(io.listing(spark, d, "*.parquet"), ["items.parquet", "matches.parquet", "labels.csv"])


@query("manifest_changes", "select 'manifest' as what, 'changed.parquet' as detail union all select 'manifest', 'items.parquet'")
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    """V5: files that differ from a manifest or are missing."""
    files = io.listing(spark, d, "*.parquet")
    m = V.manifest(files)
    expected = m.withColumn("length", F.when(F.col("name") == "items.parquet", F.col("length") + 1).otherwise(F.col("length")))
    return V.manifest_mismatch(files, expected.unionByName(spark.createDataFrame([("changed.parquet", 1, "x")], "name string, length long, sha256 string")))
