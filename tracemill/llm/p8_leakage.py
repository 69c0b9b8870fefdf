"""Problem 8: evaluation passages inside the training documents."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.p9_visual import visual_form_sql
from tracemill.llm.visual_form import blocks, to_code_points, unify
from tracemill.runtime import dealt, interim_table, table

#: Words that make a passage.
PASSAGE = 12
#: Bytes of text per suffix array (one document at least) and of evaluation text per pass.
SHARD = 4_000_000
ITEMS = 8_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case form, and whether it belongs to a word."""
    lower = np.arange(0x110000, dtype=np.int32)
    inside = np.zeros(0x110000, bool)
    for cp in range(0x32000):
        ch = chr(cp)
        inside[cp] = ch.isalnum() or unicodedata.category(ch)[0] == "M"
        if len(low := ch.lower()) == 1:
            lower[cp] = ord(low)
    return lower, inside


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(9))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _letter_hashes() -> np.ndarray:
    """A hash for each code point's lower-case form."""
    return _mix(_letters()[0])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts as a reader sees them, and the text of each word."""
    inside = _letters()[1]
    cps, offs = unify(*to_code_points(texts))
    word = inside[cps]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = offs[:-1][offs[:-1] < len(cps)]
    begin[edge] = word[edge]
    at, begins = np.flatnonzero(word), np.flatnonzero(begin)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(begin[at])
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
    power = np.full(int(sizes.max()), MULTIPLIER, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    hashes = _mix(np.add.reduceat(_letter_hashes()[cps[at]] * power[place], first))
    return hashes, np.searchsorted(offs, begins, side="right") - 1


class TestIndex:
    """The words of one block of evaluation items, as numbers from 1; suffixes of PASSAGE words or more."""

    def __init__(self, item_ids: list[int], texts: list[str], least: int) -> None:
        hashes, row = word_hashes(pa.array(texts, pa.string()))
        self.vocabulary, word = np.unique(hashes, return_inverse=True)
        self.least, self.items = least, np.array(item_ids, np.int64)
        self.words = np.append(word.astype(np.int32) + 1, np.full(least, -1, np.int32))
        self.row = row
        starts = np.arange(len(word))
        self.suffixes = starts[starts + least <= np.searchsorted(row, row, side="right")]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words; 0 for a word in no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        found = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[found] == hashes, found + 1, 0).astype(np.int32)


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts in the order of the suffixes' first depth words or more, by prefix doubling."""
    rank, k = words.astype(np.int64), 1
    while k < depth:
        nxt = np.zeros_like(rank)
        nxt[:-k or None] = rank[k:]
        rank = np.unique(rank << 32 | nxt, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def _bounds(words: np.ndarray, order: np.ndarray, index: TestIndex, upper: bool) -> np.ndarray:
    """Binary search of all test suffixes at once, by their first words."""
    lo, hi = np.zeros(len(index.suffixes), np.int64), np.full(len(index.suffixes), len(order), np.int64)
    steps = np.arange(index.least)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        diff = words[order[mid][:, None] + steps] - index.words[index.suffixes[open_][:, None] + steps]
        first = diff[np.arange(len(diff)), (diff != 0).argmax(1)]
        right = first <= 0 if upper else first < 0
        lo[open_[right]], hi[open_[~right]] = mid[right] + 1, mid[~right]


def find_passages(doc_ids: np.ndarray, texts: pa.Array, index: TestIndex) -> dict[str, np.ndarray]:
    """Maximal verbatim runs of at least index.least words shared by a text and an item."""
    hashes, row = word_hashes(texts)
    words = index.numbers(hashes)
    empty = {k: np.empty(0, np.int64) for k in ("doc_id", "item_id", "n_words", "doc_word", "item_word")}
    n, least = len(words), index.least
    if n < least or not len(index.suffixes):
        return empty
    # A passage lies in a run of words that occur in items, inside one text.
    stop = np.flatnonzero((words[:-1] == 0) | (np.diff(row) > 0) | (words[1:] == 0)) + 1
    edges = np.concatenate(([0], stop, [n]))
    long_ = np.flatnonzero((np.diff(edges) >= least) & (words[np.minimum(edges[:-1], n - 1)] > 0))
    if not len(long_):
        return empty
    sizes = np.diff(edges)[long_]
    inside = np.repeat(edges[long_] - np.concatenate(([0], np.cumsum(sizes + 1)[:-1])), sizes + 1) + np.arange(int((sizes + 1).sum()))
    seps = np.cumsum(sizes + 1) - 1
    kept = words[np.minimum(inside, n - 1)]
    kept[seps] = 0
    left = np.repeat(seps, sizes + 1) - np.arange(len(kept))
    kept = np.append(kept, np.zeros(least, np.int32))
    order = suffix_array(kept, np.flatnonzero(left >= least), least)
    lo, hi = _bounds(kept, order, index, False), _bounds(kept, order, index, True)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return empty
    many = (hi - lo)[hit]
    query = np.repeat(index.suffixes[hit], many)
    pos = order[np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))]
    # Only where the run begins: the word before differs, or there is none.
    before = np.where(pos > 0, kept[pos - 1], 0)
    same_item = (query > 0) & (index.row[np.maximum(query - 1, 0)] == index.row[query])
    begin = ~(same_item & (before > 0) & (before == index.words[query - 1]))
    pos, query = pos[begin], query[begin]
    length = np.full(len(pos), least)
    growing = np.arange(len(pos))
    while len(growing):
        a, b = pos[growing] + length[growing], query[growing] + length[growing]
        inner = np.minimum(b, len(index.row) - 1)
        more = (kept[a] > 0) & (b < len(index.row)) & (index.row[inner] == index.row[query[growing]]) & (kept[a] == index.words[b])
        growing = growing[more]
        length[growing] += 1
    token = inside[pos]
    doc_row = row[token]
    first = np.searchsorted(row, doc_row)
    item_first = np.searchsorted(index.row, index.row[query])
    return {"doc_id": doc_ids[doc_row], "item_id": index.items[index.row[query]], "n_words": length.astype(np.int64), "doc_word": token - first, "item_word": query - item_first}


OUT = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "item_id", "n_words", "doc_word", "item_word")])


def leaked_passages(docs: DataFrame, items: DataFrame, least: int = PASSAGE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """One row per maximal run of at least least words that a document shares with an item.

    Columns doc_id, item_id, n_words, doc_word and item_word (0-based places).
    Words are lower-cased runs of letters or digits of the visual form. Null and
    empty texts match nothing; a row with a null id is left out, as it can't be
    reported; extra columns are ignored; repeated items report the same id once
    per run.

    The items are the stated query set: they go to the tasks in blocks of ITEMS
    bytes, one pass over the documents for each, so that neither a task nor the
    driver holds more than one block. Each task indexes its own documents;
    nothing is shuffled. With several blocks each pass is written to the shared
    folder before the next block is read.
    """
    docs = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))

    def one(ids: list[int], texts: list[str]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = TestIndex(ids, texts, least)
            for batch in batches:
                numbers = np.asarray(batch.column(0))
                for at, part in blocks(batch.column(1), SHARD):
                    found = find_passages(numbers[at : at + len(part)], part, index)
                    if len(found["doc_id"]):
                        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in found.items()})

        return docs.mapInArrow(search, OUT)

    parts = item_blocks(held, ITEMS)
    block, after = next(parts), next(parts, None)
    if after is None:
        return one(*block).distinct()
    out = interim_table(one(*block), "passages")
    for ids, texts in chain([after], parts):
        out = out.unionAll(interim_table(one(ids, texts), "passages"))
    return out.distinct()


def item_blocks(items: DataFrame, limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of items (id, text) in blocks of about limit letters; one empty block if there are none."""
    ids: list[int] = []
    texts: list[str] = []
    size, given = 0, False
    for r in items.toLocalIterator():
        if size and size + len(r.text) > limit:
            yield ids, texts
            ids, texts, size, given = [], [], 0, True
        ids.append(r.id)
        texts.append(r.text)
        size += len(r.text)
    if ids or not given:
        yield ids, texts


def without_leaks(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """The documents that hold no passage, all columns kept; those with a null id or text stay."""
    key = names.get("doc_id", "doc_id")
    hit = leaked_passages(docs, items, **names).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(hit, F.col(key) == F.col("_leaked"), "left_anti")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"), sf_dir, "documents")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(_docs(spark, sf_dir), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents, longest passage in words, and the smallest document with one so long."""
    runs = leaked_passages(_docs(spark, sf_dir), table(spark, sf_dir, "eval_items"))
    return runs.groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"), F.max("n_words").alias("longest"), F.max(F.struct("n_words", (-F.col("doc_id")).alias("neg")))["neg"].alias("neg")).select("item_id", "docs", "longest", (-F.col("neg")).alias("doc_id"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, the documents that stay when leaking ones are removed."""
    return without_leaks(_docs(spark, sf_dir), table(spark, sf_dir, "eval_items")).groupBy("source").agg(F.count(F.lit(1)).alias("docs"))


QUERIES = {"p8_found": p8_found, "p8_longest": p8_longest, "p8_kept": p8_kept}
_WORDS = lambda text: f"regexp_extract_all(lower({visual_form_sql(text)}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"
_RUNS = lambda words, key: f"SELECT {key}, md5(array_to_string(w[k:k + 11], ' ')) AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {key}, {words} AS w FROM @t@))"
_LEAKS = f"""leaks AS MATERIALIZED (SELECT DISTINCT doc_id, item_id FROM ({_RUNS(_WORDS("text"), "doc_id").replace("@t@", "documents WHERE text IS NOT NULL")}) d JOIN ({_RUNS(_WORDS("item_text"), "item_id").replace("@t@", "eval_items WHERE item_text IS NOT NULL")}) i USING (g))"""
SQL = {
    "p8_found": f"WITH {_LEAKS} SELECT * FROM leaks",
    # A run of n words is n - 11 runs of twelve words, one after another in both texts.
    "p8_longest": f"""WITH d AS MATERIALIZED ({_RUNS(_WORDS("text"), "doc_id").replace("SELECT doc_id, md5", "SELECT doc_id, k, md5", 1).replace("@t@", "documents WHERE text IS NOT NULL AND doc_id IS NOT NULL")}), i AS MATERIALIZED ({_RUNS(_WORDS("item_text"), "item_id").replace("SELECT item_id, md5", "SELECT item_id, k, md5", 1).replace("@t@", "eval_items WHERE item_text IS NOT NULL")}),
        m AS (SELECT DISTINCT doc_id, item_id, d.k AS x, d.k - i.k AS shift FROM d JOIN i USING (g)), r AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY x) AS island FROM m),
        n AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM r GROUP BY doc_id, item_id, shift, island), b AS (SELECT *, max(n) OVER (PARTITION BY item_id) AS most FROM n)
        SELECT item_id, count(DISTINCT doc_id) AS docs, max(n) AS longest, min(doc_id) FILTER (n = most) AS doc_id FROM b GROUP BY 1""",
    "p8_kept": f"WITH {_LEAKS} SELECT source, count(*) AS docs FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM leaks) GROUP BY 1",
}
