"""Problem 4: groups of records that differ by small edits."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tracemill.llm.visual_form import blocks
from tracemill.operators.components import component_labels
from tracemill.runtime import dealt, interim_table, table

#: Likeness asked for, and the banding: a pair at .85 shares one of 16 bands of 8 with probability .994, one at .9 with .9999.
LIKENESS = 0.85
BANDS, ROWS = 16, 8
#: Chance taken that a like pair is pruned by its sketch.
MISS = 1e-4
#: Bits of the sketch compared at a time.
BATCH = 32
#: Rows of a bucket that meet in one step of a task, and rows of small buckets that a task handles together.
BLOCK, TOGETHER = 4096, 50_000
KEPT_WORDS = 1_000_000
#: Bytes of text handled at once.
TEXTS = 1_000_000
_words = re.compile(r"[^\W_]+").findall


def word_set(text: str) -> set[str]:
    """Distinct lower-cased runs of letters or digits."""
    return set(_words(text.lower()))


class WordHashes(dict[str, int]):
    """64-bit hashes of the words met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


@cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_611).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set of word hashes, none empty: a 128-bit digest, a 128-bit sketch, and the band keys.

    Hash functions and sets are taken some at a time, so that memory is bounded
    by the longest set.
    """
    sizes = np.array([len(s) for s in sets])
    flat, word = np.unique(np.concatenate(sets), return_inverse=True)
    mult = _multipliers(bands * rows)
    at = np.concatenate(([0], np.cumsum(sizes)))
    least = np.empty((len(sets), bands * rows), np.uint32)
    some = int(np.clip(4_000_000 // max(len(flat), int(sizes.max())), 1, bands * rows))
    cuts = np.unique(np.concatenate((np.flatnonzero(np.diff(at[:-1] // 32_768)) + 1, [0, len(sets)])))
    for c in range(0, bands * rows, some):
        values = ((flat[:, None] * mult[c : c + some]) >> np.uint64(32)).astype(np.uint32)
        for lo, hi in zip(cuts, cuts[1:]):
            least[lo:hi, c : c + some] = np.minimum.reduceat(values[word[at[lo] : at[hi]]], at[lo:hi] - at[lo], axis=0)
    bits = np.packbits(((least * np.uint32(2654435761)) >> np.uint32(16) & 1).astype(np.uint8)[:, :128], axis=1)
    sketch = np.ascontiguousarray(bits).view(np.int64)
    mixed = _mix(least.reshape(len(sets), bands, rows).astype(np.uint64) + (np.arange(rows, dtype=np.uint64) << np.uint64(32)))
    keys = mixed[:, :, 0]
    for k in range(1, rows):
        keys = _mix(keys * np.uint64(31) ^ mixed[:, :, k])
    keys = keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = np.add.reduceat(_mix(flat)[word], at[:-1])
    two = np.add.reduceat(_mix(flat ^ np.uint64(0x5851F42D4C957F2D))[word], at[:-1])
    return np.stack([one, two], 1).view(np.int64), sketch, keys.view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def posterior(n: int, likeness: float) -> np.ndarray:
    """For m = 0..n agreeing bits of n: the probability that the likeness is exceeded, all likenesses being equally probable before.

    A bit of two sketches agrees with probability (1 + likeness) / 2.
    """
    p = (1 + (np.arange(20_000) + 0.5) / 20_000) / 2
    m = np.arange(n + 1)[:, None]
    log = m * np.log(p) + (n - m) * np.log1p(-p)
    weight = np.exp(log - log.max(1, keepdims=True))
    return weight[:, p > (1 + likeness) / 2].sum(1) / weight.sum(1)


def may_be_alike(x: np.ndarray, y: np.ndarray, likeness: float, miss: float) -> np.ndarray:
    """Sequential test of sketch pairs (n x 2 longs each): batch by batch, pairs whose posterior falls under miss leave."""
    alive = np.arange(len(x))
    agree = np.zeros(len(x), np.int64)
    parts = (x ^ y).view(np.uint32)
    for k in range(parts.shape[1]):
        agree[alive] += BATCH - np.bitwise_count(parts[alive, k])
        alive = alive[posterior((k + 1) * BATCH, likeness)[agree[alive]] >= miss]
        if not len(alive):
            break
    keep = np.zeros(len(x), bool)
    keep[alive] = True
    return keep


def _hopeful(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, likeness: float) -> np.ndarray:
    """Pairs whose sizes allow the likeness and whose sketches pass the sequential test."""
    keep = np.minimum(nx, ny) > likeness * np.maximum(nx, ny)
    at = np.flatnonzero(keep)
    keep[at] = may_be_alike(x[at], y[at], likeness, MISS)
    return keep


MEMBERS = "key long, id long, s0 long, s1 long, n long, center long, star boolean"


def stars(batches: Iterator[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """The rows (key, id, s0, s1, n) of buckets with more than one row, in order of key, each with the bucket's first row as center.

    star says that row and center may be alike. The first and the last bucket of
    the input are given even if they have one row, as they may go on elsewhere.
    Memory is that of a batch.
    """
    tail: np.ndarray | None = None  # the last row, not given yet if it is its bucket's first
    center: np.ndarray | None = None
    first, given = True, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(c) for c in batch.columns], 1)
        skip = 0
        if tail is not None:
            rows, skip = np.vstack([tail, rows]), int(given)
        key = rows[:, 0]
        new = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        middle = rows[starts][run]
        if tail is not None and center is not None:
            middle[run == 0] = center
        several = np.diff(np.append(starts, len(rows)))[run] > 1
        several |= (run == 0) & (first | given)
        single_end = not several[-1]  # may go on in the next batch
        shown = several.copy()
        shown[:skip] = False
        at = np.flatnonzero(shown)
        star = (rows[at, 1] != middle[at, 1]) & _hopeful(rows[at, 2:4], middle[at, 2:4], rows[at, 4], middle[at, 4], likeness)
        if len(at):
            out = [*rows[at].T, middle[at, 1]]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in out), pa.array(star)], ["key", "id", "s0", "s1", "n", "center", "star"])
        first = first and run[-1] == 0
        tail, center, given = rows[-1:], middle[-1], not single_end
    if tail is not None and not given:
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in tail.T), pa.array(tail[:, 1]), pa.array([False])], ["key", "id", "s0", "s1", "n", "center", "star"])


FIELDS = ("key", "label", "id", "s0", "s1", "n", "center")
BLOCKED = "a long, b long, block long, " + ", ".join(f"{c} long" for c in FIELDS)


def _new_pairs(rows: np.ndarray, x: np.ndarray, y: np.ndarray, likeness: float) -> np.ndarray:
    """Ids (less, more) of the row pairs x, y of different labels that may be alike and that no star has tested; columns as FIELDS."""
    ids, center = rows[:, 2], rows[:, 6]
    ok = (rows[x, 1] != rows[y, 1]) & (center[x] != ids[y]) & (center[y] != ids[x])
    x, y = x[ok], y[ok]
    ok = _hopeful(rows[x, 3:5], rows[y, 3:5], rows[x, 5], rows[y, 5], likeness)
    x, y = ids[x[ok]], ids[y[ok]]
    return np.stack([np.minimum(x, y), np.maximum(x, y)], 1)


def _within(rows: np.ndarray, ends: np.ndarray, likeness: float) -> np.ndarray:
    """New pairs of rows of one block each; ends has the place behind each row's block."""
    found = [np.empty((0, 2), np.int64)]
    last = rows[ends - 1, 1]
    at = np.flatnonzero(rows[:, 1] != last)  # rows come by label, so that those of the block's last label are done
    for d in range(1, BLOCK):
        at = at[at + d < ends[at]]
        if not len(at):
            break
        found.append(_new_pairs(rows, at, at + d, likeness))
    return np.concatenate(found)


def blocked(batches: Iterator[pa.RecordBatch], likeness: float, part: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) within the blocks of rows FIELDS that come in order of key, label and id.

    A bucket is cut into blocks of up to BLOCK rows. Rows of buckets of several
    blocks, and of the first and the last bucket of the input, are given as well
    with the number of their block, which is unique for a part.
    """
    held: list[np.ndarray] = []
    count, number, before = 0, 0, None  # before: the key that the rows given last end with, or that of the input's first row

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, count, number, before
        rows = np.concatenate(held)
        key = rows[:, 0]
        new = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        done = len(rows) if last else max(int(starts[-1]), (len(rows) - int(starts[-1])) // BLOCK * BLOCK + int(starts[-1]))
        rest, rows, new = rows[done:], rows[:done], new[:done]
        held, count = [rest] if len(rest) else [], len(rest)
        if not len(rows):
            return
        starts = np.flatnonzero(new)
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        edge = np.flatnonzero(place % BLOCK == 0)
        sizes = np.diff(np.append(edge, len(rows)))
        block = (part << 36) + number + np.repeat(np.arange(len(edge)), sizes)
        number += len(edge)
        pairs = _within(rows, np.repeat(edge + sizes, sizes), likeness)
        pairs = np.unique(pairs, axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        names = ["a", "b", "block", *FIELDS]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *[none] * (1 + len(FIELDS))], names)
        run = np.repeat(np.diff(np.append(starts, len(rows))), np.diff(np.append(starts, len(rows))))
        open_ = (run > BLOCK) | (rows[:, 0] == before) | (rows[:, 0] == rows[-1, 0])
        before = rows[-1, 0]
        none = pa.nulls(int(open_.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(block[open_]), *(pa.array(np.ascontiguousarray(c)) for c in rows[open_].T)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(c) for c in batch.columns], 1)
        if before is None:
            before = rows[0, 0]
        held.append(rows)
        count += len(rows)
        if count >= TOGETHER:
            yield from flush(False)
    if count:
        yield from flush(True)


def across(rows: pa.Table, likeness: float) -> pa.Table:
    """Candidate pairs (a, b) between two blocks x and y of one bucket; side tells the blocks apart."""
    side = rows.column("side").to_numpy()
    values = np.stack([rows.column(c).to_numpy() for c in FIELDS], 1)
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = [np.empty((0, 2), np.int64), *(_new_pairs(values, np.repeat(row, len(y)), y, likeness) for row in x)]
    both = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})


def pairs_across(rows: DataFrame, likeness: float) -> DataFrame:
    """Candidate pairs of rows block and FIELDS that lie in different blocks of a bucket.

    Blocks that are all of one label, or whose sizes allow no likeness, don't meet.
    """
    blocks = rows.groupBy("key", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = blocks.selectExpr("key", "block AS x", "lo", "hi", "least", "most"), blocks.selectExpr("key", "block AS y", "lo AS lo2", "hi AS hi2", "least AS least2", "most AS most2")
    fit = f"x < y AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2) AND most > {likeness} * least2 AND most2 > {likeness} * least"
    met = a.join(b, "key").where(fit).select("x", "y")
    sides = met.select("x", "y", F.inline(F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side")))))
    return rows.join(sides, "block").select("x", "y", "side", *FIELDS).groupBy("x", "y").applyInArrow(lambda t: across(t, likeness), "a long, b long")


def likeness_of(a: Column | str, b: Column | str) -> Column:
    """Common words by all words of two sets, given as the bytes of their sorted hashes."""

    @arrow_udf("double")
    def like(x: pa.Array, y: pa.Array) -> pa.Array:
        def one(s: bytes, t: bytes) -> float:
            common = len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True))
            return common / ((len(s) + len(t)) // 8 - common)

        return pa.array([one(s, t) for s, t in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    return like(a, b)


def near_groups(df: DataFrame, id_col: str = "path_id", text_col: str = "reasoning", likeness: float = LIKENESS) -> DataFrame:
    """(id, group) for every record that is linked to another: group is the least id of those linked, in chains too.

    Two records are linked if the words they share exceed likeness of all their
    words. Null and empty texts, and texts without a word, are in no group; a
    null id is left out; rows with one id count once; ids are integers. Extra
    columns are ignored; an empty table gives no rows.

    Records with one set of words become one class first. Classes meet in
    buckets of MinHash bands; sketches prune pairs batch by batch, with a chance
    of MISS to lose a like pair; the words of the survivors are compared exactly.
    First every class is held against the first one of its bucket. Then all
    pairs of a bucket that those links have not put into one group are tested
    in the same way, so that no pair of a bucket is passed over, whatever its
    size. Buckets are spread by range over the tasks and met in blocks of BLOCK
    rows, so that none is gathered in one task.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    names = ["id", "h0", "h1", "n", "s0", "s1", *(f"k{j}" for j in range(BANDS))]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        known = WordHashes()
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for lo, texts in blocks(batch.column(1), TEXTS):
                sets = [np.fromiter(map(known.__getitem__, s), np.uint64, len(s)) for s in map(word_set, texts.to_pylist())]
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    yield ids[lo : lo + len(sets)][full], [sets[i] for i in full]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in hashed(batches):
            digest, sketch, keys = signatures(sets)
            cols = np.hstack([ids[:, None], digest, np.array([len(s) for s in sets])[:, None], sketch, keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols.T], names)

    def word_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in hashed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([np.sort(s).tobytes() for s in sets], pa.binary())], ["id", "words"])

    signed = interim_table(src.mapInArrow(sign, schema), "signed")
    classes = signed.groupBy("h0", "h1").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in names[3:]))
    rows = classes.select(F.explode(F.array(*names[6:])).alias("key"), "id", "s0", "s1", "n")
    ordered = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    met = interim_table(ordered.mapInArrow(lambda batches: stars(batches, likeness), MEMBERS), "met")
    needed = src.join(met.select("id").distinct(), "id", "left_semi")
    words = interim_table(needed.mapInArrow(word_numbers, "id long, words binary"), "words")

    def links(pairs: DataFrame) -> DataFrame:
        one = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
        two = one.join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
        return two.where(likeness_of("wa", "wb") > likeness).select("a", "b")

    labels = component_labels(links(met.where("star").select(F.least("id", "center").alias("a"), F.greatest("id", "center").alias("b")).distinct()))
    labelled = met.join(labels, F.col("id") == F.col("node"), "left").select("key", F.coalesce("label", "id").alias("label"), "id", "s0", "s1", "n", "center")
    parted = labelled.repartitionByRange("key", "label", "id").sortWithinPartitions("key", "label", "id")
    second = interim_table(parted.mapInArrow(lambda batches: blocked(batches, likeness, TaskContext.get().partitionId()), BLOCKED), "blocked")
    pairs = second.where("a is not null").select("a", "b").unionAll(pairs_across(second.where("a is null").drop("a", "b"), likeness))
    labels = component_labels(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(links(pairs.distinct())))
    members = signed.select("id", "h0", "h1").join(signed.groupBy("h0", "h1").agg(F.min("id").alias("rep"), F.max("id").alias("last")), ["h0", "h1"])
    grouped = members.join(labels, F.col("rep") == F.col("node"), "left").where("label is not null or rep < last")
    return grouped.select("id", F.coalesce("label", "rep").alias("group")).distinct().select(F.col("id").alias(id_col), "group")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(dealt(table(spark, sf_dir, "reasoning_paths").select("path_id", "reasoning"), sf_dir, "reasoning_paths")).where("path_id != group").select(F.col("group").alias("path_id_a"), F.col("path_id").alias("path_id_b"))


def p4_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    groups = near_groups(dealt(table(spark, sf_dir, "reasoning_paths").select("path_id", "reasoning"), sf_dir, "reasoning_paths"))
    return groups.groupBy("group").count().groupBy(F.col("count").alias("members")).agg(F.count(F.lit(1)).alias("groups"))


QUERIES = {"p4_found": p4_found, "p4_sizes": p4_sizes}
# Rarest words find every pair, words decide, and groups are what can be reached; copies hang on the least of them.
_GROUPS = r"""
    t AS MATERIALIZED (SELECT path_id, list_sort(list_distinct(list_transform(regexp_extract_all(lower(any_value(reasoning)), '[\p{L}\p{N}]+'), lambda x: hash(x)))) AS s FROM reasoning_paths WHERE path_id IS NOT NULL AND reasoning IS NOT NULL GROUP BY 1),
    m AS MATERIALIZED (SELECT path_id, s, min(path_id) OVER (PARTITION BY s) AS rep FROM t WHERE len(s) > 0), c AS MATERIALIZED (SELECT path_id AS id, s, len(s) AS n FROM m WHERE path_id = rep),
    w AS MATERIALIZED (SELECT id, n, unnest(s) AS w FROM c), f AS (SELECT w, count(*) AS df FROM w GROUP BY 1), r AS (SELECT id, n, w.w, row_number() OVER (PARTITION BY id ORDER BY df, w.w) AS k FROM w JOIN f USING (w)),
    p AS MATERIALIZED (SELECT id, n, w FROM r WHERE k <= n - ceil(0.85 * n) + 1), q AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) > 0.85 * greatest(a.n, b.n)),
    l AS MATERIALIZED (SELECT x, y FROM (SELECT x, y, len(list_intersect(a.s, b.s)) AS c, a.n + b.n AS n FROM q JOIN c a ON a.id = x JOIN c b ON b.id = y) WHERE c > 0.85 * (n - c)),
    e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), reach AS (SELECT id AS x, id AS y FROM c UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y), g AS (SELECT x, min(y) AS label FROM reach GROUP BY 1),
    k AS MATERIALIZED (SELECT path_id, label, count(*) OVER (PARTITION BY label) AS size FROM m JOIN g ON g.x = m.rep)
"""
SQL = {
    "p4_found": f"WITH RECURSIVE {_GROUPS} SELECT label AS path_id_a, path_id AS path_id_b FROM k WHERE path_id <> label",
    "p4_sizes": f"WITH RECURSIVE {_GROUPS} SELECT size AS members, count(DISTINCT label) AS groups FROM k WHERE size > 1 GROUP BY 1",
}
