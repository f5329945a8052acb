"""Encoding of a whole corpus with a public tokenizer.

Method: the corpus is cut into words by the tokenizer's pattern and the words
are counted over all documents. The most frequent ones, at most
``LEXICON_WORDS``, are compiled with their ids into a minimal acyclic transducer
(``lexicon``), which every worker maps from the shared folder. A word the
lexicon hasn't got is merged exactly by the tokenizer's ranks. The lexicon only
saves work; ids don't depend on it.

Defined results: an empty or null text has an empty list of ids; blank text is
encoded like any other; a null doc_id stays; repeated rows stay; texts of any
length are encoded whole; special tokens' strings are ordinary text; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .lexicon import Lexicon, compile_lexicon

#: Where the public vocabulary files are; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Bound of the lexicon, hence of what the driver compiles and workers map.
LEXICON_WORDS = 50_000
#: Longer words are merged but not remembered.
LONG_WORD = 64
#: The words that a worker remembers with their ids, besides the lexicon.
MEMO_WORDS = 200_000

#: Fixed value: the pattern that splits text before the merges, with white space
#: by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


@lru_cache(maxsize=2)
def _merger(folder: str, name: str):
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _splitter() -> Callable[[str], list[str]]:
    import regex

    return regex.compile(PATTERN, regex.V0).findall


@lru_cache(maxsize=4)
def _mapped(path: str) -> Lexicon:
    return Lexicon.open(path)


class Encoder:
    """Ids of a text: lexicon first, exact merge for the other words."""

    def __init__(self, lexicon: Lexicon | None, folder: str, name: str):
        self._get = lexicon.get if lexicon else lambda w: None
        self._merge = _merger(folder, name)._encode_single_piece
        self._split, self._memo = _splitter(), {}

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        ids = self._get(raw)
        if ids is None:
            ids = self._merge(raw)
        if len(raw) <= LONG_WORD:
            if len(self._memo) >= MEMO_WORDS:
                self._memo.clear()
            self._memo[word] = ids
        return ids

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        out, memo = [], self._memo
        for w in self._split(text):
            ids = memo.get(w)
            out += ids if ids is not None else self.word(w)
        return out


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word of the pattern occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _splitter(), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(split(t))
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", words: int = LEXICON_WORDS) -> bytes:
    """Compiled lexicon of the most frequent words of all texts.

    A takeOrdered of at most ``words`` short words comes to the driver.
    """
    short = word_counts(docs, text).where((F.octet_length("word") <= LONG_WORD) & (F.col("n") > 1))
    top = [r["word"] for r in short.orderBy(F.col("n").desc(), "word").limit(words).select("word").collect()]
    merge = _merger(folder, name)._encode_single_piece
    return compile_lexicon((w, merge(w)) for w in sorted(x.encode() for x in top))


def shared_lexicon(spark: SparkSession, data: bytes) -> Callable[[], Lexicon]:
    """Put the lexicon into the shared folder; returns how a worker opens it.

    Where the folder isn't a mounted one, workers get the bytes by broadcast,
    whose size ``LEXICON_WORDS`` bounds.
    """
    where = Scratch(spark, "lexicon").root
    at = spark._jvm.org.apache.hadoop.fs.Path(where)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        folder = at.toUri().getPath()
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/words.lex"
        with open(path, "wb") as f:
            f.write(data)
        return lambda: _mapped(path)
    held = spark.sparkContext.broadcast(data)
    return lambda: Lexicon(held.value)


def _apply(docs: DataFrame, keep: list[str], text: str, folder: str, name: str, words: int, out: str, kind: str) -> DataFrame:
    spark = docs.sparkSession
    opened = shared_lexicon(spark, build_lexicon(docs, text, folder, name, words))
    # renamed, so that an input column with the name of the result doesn't clash
    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    schema = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    result = pa.list_(pa.int32()) if kind == "array<int>" else pa.int64()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(opened(), folder, name)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = map(enc, part.column(part.num_columns - 1).to_pylist())
                col = pa.array(list(ids) if kind == "array<int>" else [len(x) for x in ids], result)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], col], [*(f"k{i}" for i in range(len(keep))), "r"])

    done = src.mapInArrow(encode, f"{schema}, r {kind}")
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("r").alias(out))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", words: int = LEXICON_WORDS) -> DataFrame:
    """(key, ids): the ids of every text, without special tokens."""
    return _apply(docs, [key], text, folder, name, words, "ids", "array<int>")


def sizes(docs: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", words: int = LEXICON_WORDS) -> DataFrame:
    """The kept columns with n_tokens, the number of ids of the text."""
    return _apply(docs, keep, text, folder, name, words, "n_tokens", "long")
