"""Problem 7: the whole corpus as token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracemill.runtime import dealt, table

VOCABULARY = os.environ.get("TRACEMILL_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Words up to this many bytes use the contiguous rank array, whose scans are quadratic; longer ones use a heap over the same boundaries.
SHORT = 128
#: Distinct words kept by a worker; the store is emptied when full, which changes no result.
KEPT_WORDS = 300_000
#: Texts are taken in blocks of about so many bytes.
BLOCK = 1_000_000
NEVER = 1 << 60
# The split pattern that goes with the vocabulary; white space is what Unicode calls White_Space.
BLANK = "\\t\\n\\x0b\\f\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
# The same pattern for the standard library's faster matcher, right for texts without odd numerals.
FAST_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^{BLANK}\w]|_)+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Part boundaries and the rank of each adjacent pair lie in two arrays; the least rank is found by a scan."""
    edge = list(range(len(word) + 1))
    rank = [ranks.get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
    while rank:
        least = min(rank)
        if least == NEVER:
            break
        at = rank.index(least)
        del edge[at + 1], rank[at]
        if at < len(rank):
            rank[at] = ranks.get(word[edge[at] : edge[at + 2]], NEVER)
        if at:
            rank[at - 1] = ranks.get(word[edge[at - 1] : edge[at + 1]], NEVER)
    return [ranks[word[a:b]] for a, b in zip(edge, edge[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in the same order, n log n."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    end = list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


@lru_cache(maxsize=1)
def odd_numerals() -> frozenset[str]:
    """Numerals that aren't decimal digits; the standard library counts them as letters."""
    return frozenset(chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) in ("No", "Nl"))


class Words(dict[str, tuple[int, ...]]):
    """Ids of the words met so far; a new word is merged when it is first asked for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        if (whole := self.ranks.get(raw)) is not None:
            ids: tuple[int, ...] = (whole,)
        else:
            ids = tuple(merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks))
        if len(raw) <= SHORT:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts by one rank file; every single byte must have a rank."""

    def __init__(self, path: str) -> None:
        import regex

        self.words = Words(read_ranks(path))
        self.find_any = regex.compile(PATTERN).findall
        self.find_fast = re.compile(FAST_PATTERN).findall
        self.plain = odd_numerals().isdisjoint

    def encode(self, text: str) -> list[int]:
        pieces = self.find_fast(text) if text.isascii() or self.plain(text) else self.find_any(text)
        return list(chain.from_iterable(map(self.words.__getitem__, pieces)))

    def arrow(self, texts: pa.Array) -> pa.Array:
        sizes, flat = [], []
        for text in texts.to_pylist():
            ids = self.encode(text) if text else ()
            sizes.append(len(ids))
            flat.append(np.array(ids, np.int32))
        offs = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offs[1:])
        return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    group = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    yield from (texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def token_ids(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Token ids of a text column; null and empty give an empty list. Text that spells a special token is ordinary text."""

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        code = encoder(vocabulary)
        return pa.concat_arrays([code.arrow(part) for part in _slices(texts)])

    return ids(text)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir, "documents").select("doc_id", token_ids("text").alias("ids"))


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, tokens, and bytes of text."""
    docs = dealt(table(spark, sf_dir, "documents").select("source", "text"), sf_dir, "documents").select("source", "text", F.size(token_ids("text")).alias("n"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


QUERIES = {"p7_ids": p7_ids, "p7_lengths": p7_lengths}
SQL: dict[str, str] = {}
