"""Exact and near duplicates among the traces of a problem."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.components import component_labels
from tracemill.runtime import interim_table

LIKENESS = 0.85
#: Traces of a problem that one task compares as they are; more are dealt out by keys.
CROWD = 1000
#: Rows that are compared at once, beside those of an open problem.
CHUNK = 1000
#: Pairs that a task gives out at once, at most.
BATCH = 1 << 17

_FOUND = pa.schema([("kind", pa.int32()), ("problem_id", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("likeness", pa.float64()), ("words", pa.string())])
_MEMBER, _LINK, _CROWDED = range(3)
_KEYED = "key long, class long, n long, low long, high long, place int"
_PAIRS = "a long, b long, likeness double"


def like_classes(traces: DataFrame, likeness: float = LIKENESS, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Traces (ord, class) and links (x, y, likeness; x < y) of the classes of a problem whose word sets are alike by more than likeness.

    The traces of a problem with one set of words are one class, named by its
    least ord. Traces without words or without a problem are left out; likeness is
    above 0. Texts are shuffled once: a problem meets in one task, which compares
    all its classes; the traces of one with more than crowd are dealt out and
    linked by keys.
    """
    crowded = traces.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("problem_id", F.lit(True).alias("crowded"))
    rows = traces.where("problem_id is not null and reasoning is not null").select("ord", "problem_id", F.lower("reasoning").alias("text")).join(F.broadcast(crowded), "problem_id", "left")
    rows = rows.select("problem_id", F.coalesce("crowded", F.lit(False)).alias("crowded"), "ord", "text").repartition("problem_id", F.when(F.col("crowded"), F.col("ord")))
    kinds = "kind int, problem_id string, x long, y long, likeness double, words string"
    found = interim_table(rows.sortWithinPartitions("problem_id", "ord").mapInArrow(partial(_compared, likeness=likeness), kinds), "compared")
    keyed = found.where(F.col("kind") == _CROWDED).select(F.col("x").alias("ord"), "problem_id", "words", F.md5("words").alias("key"))
    classes = interim_table(keyed.groupBy("problem_id", "key").agg(F.min("ord").alias("class"), F.first("words").alias("words")), "classes")
    named = keyed.select("ord", "problem_id", "key").join(classes.select("problem_id", "key", "class"), ["problem_id", "key"]).select("ord", "class")
    members = found.where(F.col("kind") == _MEMBER).select(F.col("x").alias("ord"), F.col("y").alias("class")).unionAll(named)
    links = found.where(F.col("kind") == _LINK).select("x", "y", "likeness")
    links = links.unionAll(_crowded_pairs(classes.withColumn("members", F.array("class")), likeness).toDF("x", "y", "likeness")) if likeness < 1 else links
    return interim_table(members, "members"), interim_table(links, "links")


def _crowded_pairs(classes: DataFrame, likeness: float) -> DataFrame:
    """(a, b, likeness) of the members of alike classes (class, problem_id, words, members) of a problem; a < b.

    Sets of a and b words that are alike differ in at most
    (1 - likeness) / (1 + likeness) * (a + b) words. With the words dealt out to
    one more part than that, two such sets have a part in common, so that meeting
    by the prints of the parts loses no pair. Parts are counted by levels of size:
    a set has keys at its own level and at those of larger sets that it can be
    like; a pair counts at the level of its larger set. Only rows of classes are
    shuffled, never pairs: classes that, by their bits, can be like another one of
    a key are given the prints of all parts, and those that have a pair whose
    first common part is that of the key are given their words, so that each pair
    is compared in one place.
    """
    keys = classes.select("class", "problem_id", "words").mapInArrow(partial(_keys, likeness=likeness), _KEYED)
    met = keys.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_meet, likeness=likeness), "key long, class long, place int")
    printed = met.join(classes.select("class", "words"), "class").select("key", "class", "place", "words").mapInArrow(partial(_printed, likeness=likeness), f"{_KEYED}, prints binary")
    first = printed.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_first, likeness=likeness), f"{_KEYED}, prints binary")
    worded = first.join(classes.select("class", "words", "members"), "class").select(*first.columns, "words", "members")
    return worded.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_linked, likeness=likeness), _PAIRS)


class _Hashes(dict):
    """64 bits for each word, the same in all tasks."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = found = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sketched(sets: list, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words, set by set, the size of each set and 128 bits of it in two halves.

    Each word turns one bit over, so two sets differ in at least as many words as their bits differ in.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.fromiter(chain.from_iterable(map(hashes.__getitem__, s) for s in sets), np.uint64, int(n.sum()))
    bit, upper = np.uint64(1) << (flat & np.uint64(63)), (flat & np.uint64(64)) != 0
    starts = np.cumsum(n) - n
    low, high = (np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), starts) for half in (~upper, upper))
    return flat, n, low, high


def _close(run: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, likeness: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j, of equal run, which is sorted, but those that sizes or bits show to be no more alike than likeness."""
    apart = (1 - likeness) / (1 + likeness)
    i, step = np.arange(len(run)), 1
    while True:
        i = i[: np.searchsorted(i, len(run) - step)]
        i = i[run[i] == run[i + step]]
        if not i.size:
            return
        j = i + step
        a, b = n[i], n[j]
        fits = (np.bitwise_count(low[i] ^ low[j]) + np.bitwise_count(high[i] ^ high[j]) <= apart * (a + b) + 1e-9) & (np.minimum(a, b) > likeness * np.maximum(a, b))
        yield i[fits], j[fits]
        step += 1


def _compared(batches: Iterable[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """Members and links of problems that aren't crowded, out of rows problem_id, crowded, ord, text by problem and ord; traces of crowded ones with their words."""
    hashes = _Hashes()
    held: list[tuple[str, int, frozenset[str]]] = []
    for batch in batches:
        dealt = []
        for problem, crowded, ord_, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = frozenset(text.split())  # parts at the same blanks as X.words
            if not words:
                continue
            if crowded:
                dealt.append((_CROWDED, problem, ord_, None, None, "\n".join(sorted(words))))
                continue
            if len(held) >= CHUNK and held[-1][0] != problem:
                yield _found(_within(held, likeness, hashes))
                held = []
            held.append((problem, ord_, words))
        if dealt:
            yield _found(dealt)
    if held:
        yield _found(_within(held, likeness, hashes))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _FOUND)], schema=_FOUND)


def _exact(close: Iterable[tuple[np.ndarray, np.ndarray]], n: np.ndarray, common: Callable[[np.ndarray, np.ndarray], np.ndarray], likeness: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, likeness) of those pairs that are alike by more than likeness; common counts the words that sets i and j share."""
    for i, j in close:
        both = common(i, j)
        like = both / (n[i] + n[j] - both)
        fits = like > likeness
        if fits.any():
            yield i[fits], j[fits], like[fits]


def _alike(classes: Iterable[tuple[str, frozenset[str]]], likeness: float, hashes: _Hashes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, likeness) of the alike ones of these classes of whole problems."""
    sets, runs = [words for _, words in classes], {}
    run = np.array([runs.setdefault(problem, len(runs)) for problem, _ in classes])
    _, n, low, high = _sketched(sets, hashes)
    common = lambda i, j: np.fromiter((len(sets[x] & sets[y]) for x, y in zip(i.tolist(), j.tolist())), np.int64, len(i))
    return _exact(_close(run, n, low, high, likeness), n, common, likeness)


def _within(held: list[tuple[str, int, frozenset[str]]], likeness: float, hashes: _Hashes) -> list[tuple]:
    """Members and links of whole problems."""
    classes: dict[tuple[str, frozenset[str]], int] = {}
    rows = [(_MEMBER, None, ord_, classes.setdefault((problem, words), ord_), None, None) for problem, ord_, words in held]
    names = list(classes.values())
    for some in _alike(classes, likeness, hashes):
        rows += [(_LINK, None, min(names[i], names[j]), max(names[i], names[j]), like, None) for i, j, like in zip(*(c.tolist() for c in some))]
    return rows


def _paired(i: np.ndarray, j: np.ndarray, like: np.ndarray, members: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, likeness), a < b, of the pairs between the members of classes i and j; members holds those of all classes up to their ends, in order in each class."""
    size = np.diff(ends, prepend=0)
    upto = np.cumsum(size[i] * size[j])
    for at in range(0, int(upto[-1]) if len(upto) else 0, BATCH):
        k = np.arange(at, min(at + BATCH, upto[-1]))
        pair = np.searchsorted(upto, k, side="right")
        x, y = i[pair], j[pair]
        k -= upto[pair] - size[x] * size[y]
        p, q = members[ends[x] - size[x] + k // size[y]], members[ends[y] - size[y] + k % size[y]]
        keep = (x != y) | (p < q)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (np.minimum(p, q), np.maximum(p, q), like[pair])], ["a", "b", "likeness"])


def _problem_pairs(batches: Iterable[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """Alike traces of rows problem_id, ord, text by problem and ord; a trace that comes again counts once."""
    hashes = _Hashes()

    def found(held: list[tuple[str, int, frozenset[str]]]) -> Iterator[pa.RecordBatch]:
        classes: dict[tuple[str, frozenset[str]], list[int]] = {}
        for problem, ord_, words in held:
            classes.setdefault((problem, words), []).append(ord_)
        members, ends = np.array([o for m in classes.values() for o in m], np.int64), np.cumsum([len(m) for m in classes.values()])
        many = np.flatnonzero(np.diff(ends, prepend=0) > 1)
        for some in chain([(many, many, np.ones(len(many)))] if likeness < 1 else [], _alike(classes, likeness, hashes)):
            yield from _paired(*some, members, ends)

    def wholes() -> Iterator[list[tuple[str, int, frozenset[str]]]]:
        held: list[tuple[str, int, frozenset[str]]] = []
        last = None
        for batch in batches:
            for problem, ord_, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (problem, ord_) == last:
                    continue
                last = problem, ord_
                if len(held) >= CHUNK and held[-1][0] != problem:
                    yield held
                    held = []
                if words := frozenset(text.split()):  # parts at the same blanks as X.words
                    held.append((problem, ord_, words))
        if held:
            yield held

    return chain.from_iterable(map(found, wholes()))


def _worded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted words of rows problem_id, ord, text, without rows that have none."""
    for batch in batches:
        words = pa.array(["\n".join(sorted(set(t.split()))) or None for t in batch.column(2).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], ["problem_id", "ord", "words"]).filter(words.is_valid())


def _level(n: np.ndarray, likeness: float) -> np.ndarray:
    """The level of a size; the largest set that one of n words is like is about one level up."""
    return np.floor(np.log(n) / -np.log(likeness)).astype(np.int64)


def _parts(level: int, likeness: float) -> int:
    """One part more than alike sets of at most the largest size of a level can differ in."""
    largest = np.floor(likeness ** -(level + 1)) + 1
    return int(2 * largest * (1 - likeness) / (1 + likeness)) + 1


def _prints(flat: np.ndarray, n: np.ndarray, of: np.ndarray, level: int, likeness: float) -> np.ndarray:
    """16 bits of each part at a level, a row for each set out of those of n words that of picks."""
    m, taken = _parts(level, likeness), flat[np.repeat(of, n)]
    part = (((taken >> np.uint64(8)) & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
    sums = np.zeros(int(of.sum()) * m, np.uint64)
    np.add.at(sums, np.repeat(np.arange(int(of.sum())), n[of]) * m + part.astype(np.int64), _mixed(taken))
    return (sums >> np.uint64(48)).astype(np.uint16).reshape(-1, m)


def _keys(batches: Iterable[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """A row (key, class, n, low, high, place) for each part of each class (class, problem_id, words) at each of its levels; place is level and part."""
    hashes = _Hashes()
    for batch in (b.slice(k, CHUNK) for b in batches for k in range(0, b.num_rows, CHUNK)):
        name, problems, words = batch.columns
        flat, n, low, high = _sketched([w.split("\n") for w in words.to_pylist()], hashes)
        names, problem = name.to_numpy(), np.array([hashes[p] for p in problems.to_pylist()], np.uint64)
        first, last = _level(n, likeness), _level(np.floor(n / likeness), likeness)
        for level in range(first.min(), last.max() + 1):
            of = (first <= level) & (level <= last)
            if not of.any():
                continue
            prints = _prints(flat, n, of, level, likeness)
            place = np.arange(prints.shape[1]) + (level << 16)
            key = _mixed(prints + _mixed(place.astype(np.uint64) + np.uint64(1 << 40)) + problem[of][:, None]).ravel().view(np.int64)
            columns = (key, *(np.repeat(v[of], prints.shape[1]).view(np.int64) for v in (names, n, low, high)), np.tile(place, len(prints)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "class", "n", "low", "high", "place"])


def _by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of whole keys out of rows by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.concat_batches(held)
            held = []
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _candidates(batch: pa.RecordBatch, likeness: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) of a key that count at its level and can be alike, out of whole keys; with prints, only those whose first common part is that of the key."""
    key, _, n, low, high, place = (c.to_numpy() for c in batch.columns[:6])
    own = _level(n, likeness) == place >> 16
    prints = None
    if batch.num_columns > 6:
        parts = [np.frombuffer(p, np.uint16) for p in batch.column(6).to_pylist()]
        prints = np.zeros((len(parts), max(map(len, parts))), np.uint16)
        for k, p in enumerate(parts):
            prints[k, : len(p)] = p
    for i, j in _close(key, n, low.view(np.uint64), high.view(np.uint64), likeness):
        fits = own[i] | own[j]
        i, j = i[fits], j[fits]
        if prints is not None and i.size:
            fits = (prints[i] == prints[j]).argmax(axis=1) == place[i] & 0xFFFF
            i, j = i[fits], j[fits]
        yield i, j


def _having(batch: pa.RecordBatch, likeness: float) -> pa.RecordBatch:
    """Those rows of whole keys that have a candidate."""
    hit = np.zeros(batch.num_rows, bool)
    for i, j in _candidates(batch, likeness):
        hit[i] = hit[j] = True
    return batch.filter(pa.array(hit))


def _meet(batches: Iterable[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """The keys (key, class, place) at which a class can be like another, out of rows of _keys by key."""
    for batch in _by_key(batches):
        yield _having(batch, likeness).select(["key", "class", "place"])


def _printed(batches: Iterable[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """Rows of _keys with the prints of all parts at their level, out of rows key, class, place, words."""
    hashes = _Hashes()
    for batch in (b.slice(k, CHUNK) for b in batches for k in range(0, b.num_rows, CHUNK)):
        key, name, place = (c.to_numpy() for c in batch.columns[:3])
        _, one, which = np.unique(name, return_index=True, return_inverse=True)
        flat, n, low, high = _sketched([w.split("\n") for w in batch.column(3).take(pa.array(one)).to_pylist()], hashes)
        prints: list[bytes] = [b""] * len(key)
        for level in np.unique(place >> 16).tolist():
            rows = np.flatnonzero(place >> 16 == level)
            of = np.zeros(len(n), bool)
            of[which[rows]] = True
            own = _prints(flat, n, of, level, likeness)
            for row, k in zip(rows.tolist(), (np.cumsum(of) - 1)[which[rows]].tolist()):
                prints[row] = own[k].tobytes()
        columns = (key, name, n[which], low[which].view(np.int64), high[which].view(np.int64), place)
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(prints, pa.binary())], ["key", "class", "n", "low", "high", "place", "prints"])


def _first(batches: Iterable[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """Those rows of _printed, by key, that have a candidate whose first common part is that of the key."""
    for batch in _by_key(batches):
        yield _having(batch, likeness)


def _common(words: list[list[str]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Counts the words that sets i and j have in common, by a bit for each word that several of these sets hold."""
    ids: dict[str, int] = {}
    of = np.fromiter((ids.setdefault(w, len(ids)) for s in words for w in s), np.int64)
    shared = np.bincount(of) > 1
    keep, bit = shared[of], (np.cumsum(shared) - 1)[of]
    row, bit = np.repeat(np.arange(len(words)), [len(s) for s in words])[keep], bit[keep]
    bits = np.zeros((len(words), int(shared.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    step = max(1, (1 << 21) // bits.shape[1])

    def count(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    return count


def _linked(batches: Iterable[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """Pairs of the members of alike classes, out of rows of _first by key with words and members."""
    for batch in _by_key(batches):
        common = _common([w.split("\n") for w in batch.column("words").to_pylist()])
        members = batch.column("members")
        names, ends = members.flatten().to_numpy(), np.cumsum(members.value_lengths().to_numpy())
        for some in _exact(_candidates(batch, likeness), batch.column("n").to_numpy(), common, likeness):
            yield from _paired(*some, names, ends)


def like_pairs(traces: DataFrame, likeness: float = LIKENESS, crowd: int = CROWD) -> DataFrame:
    """(a, b, likeness) of the traces (ord, problem_id, reasoning) of a problem whose word sets are alike by more than likeness; a < b.

    A trace that is delivered more than once, with the same content, counts once.
    Texts are shuffled once: by problem, or those of problems with more than crowd
    traces by their words. Classes of equal sets are compared with their members
    at hand, so pairs come out where they are found and none is shuffled.
    """
    crowded = F.broadcast(traces.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("problem_id"))
    rows = traces.where("ord is not null and problem_id is not null and reasoning is not null").select("problem_id", "ord", F.lower("reasoning").alias("text"))
    alone = rows.join(crowded, "problem_id", "left_anti").repartition("problem_id").sortWithinPartitions("problem_id", "ord")
    pairs = alone.mapInArrow(partial(_problem_pairs, likeness=likeness), _PAIRS)
    if likeness >= 1:
        return pairs
    worded = rows.join(crowded, "problem_id", "left_semi").mapInArrow(_worded, "problem_id string, ord long, words string")
    classes = worded.groupBy("problem_id", F.md5("words").alias("key")).agg(F.collect_set("ord").alias("members"), F.first("words").alias("words"))
    classes = interim_table(classes.select(F.array_min("members").alias("class"), "problem_id", "words", "members"), "classes")
    equal = classes.where(F.size("members") > 1).select(F.explode("members").alias("a"), "members").select("a", F.explode("members").alias("b"), F.lit(1.0).alias("likeness")).where("a < b")
    return pairs.unionAll(equal).unionAll(_crowded_pairs(classes, likeness))


def greedy_dedup(traces: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """The traces that greedy deduplication keeps, in order of ord.

    Each trace is held against those kept so far; the first that is alike
    decides: the more confident of the two stays, and one that takes another's
    place goes to the end. Only traces linked by likeness can affect each other,
    so each linked group is resolved by itself, as numbers: its traces pass by in
    order, and what is held are the links between its classes and what is kept.
    Traces without words are alike to none and stay.
    """
    members, links = like_classes(traces, likeness)
    labels = component_labels(links, "x", "y")
    rows = traces.select("ord", "confidence").join(members, "ord").join(labels, F.col("class") == F.col("node"), "left")
    rows = rows.select(F.coalesce("label", "class").alias("label"), F.lit(1).alias("kind"), "ord", "class", F.lit(None).cast("long").alias("other"), "confidence")
    edges = links.join(labels, F.col("x") == F.col("node")).select("label", F.lit(0).alias("kind"), F.col("x").alias("ord"), F.col("x").alias("class"), F.col("y").alias("other"), F.lit(0.0).alias("confidence"))
    ordered = rows.unionAll(edges).repartition("label").sortWithinPartitions("label", "kind", "ord")
    stay = ordered.mapInPandas(_resolve, "ord long").unionAll(traces.select("ord").join(members, "ord", "left_anti"))
    return traces.join(stay, "ord", "left_semi")


def _resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The kept ones of rows label, kind, ord, class, other and confidence in this order: links (kind 0) come before the traces of a label."""
    label = None
    near: dict[int, list[int]] = {}
    kept: dict[int, dict[int, tuple[int, float]]] = {}  # by class: ord, with the time it was kept and its confidence
    for frame in frames:
        done: list[int] = []
        for now, kind, ord_, own, other, sure in zip(*(frame[c].tolist() for c in ("label", "kind", "ord", "class", "other", "confidence"))):
            if now != label:
                done += [o for c in kept.values() for o in c]
                label, near, kept, clock = now, {}, {}, 0
            if kind == 0:
                near.setdefault(own, []).append(int(other))
                near.setdefault(int(other), []).append(own)
                continue
            clock += 1
            alike = [(at, o, c, theirs) for c in (own, *near.get(own, ())) for o, (at, theirs) in kept.get(c, {}).items()]
            if alike:
                _, o, c, theirs = min(alike)
                if not sure > theirs:
                    continue
                del kept[c][o]
            kept.setdefault(own, {})[ord_] = (clock, sure)
        yield pd.DataFrame({"ord": pd.Series(done, dtype="int64")})
    yield pd.DataFrame({"ord": pd.Series([o for c in kept.values() for o in c], dtype="int64")})


def distinct_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")


def batches_of(rows: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Frames of n rows out of a stream of frames, the rest at the end."""
    held: list[pd.DataFrame] = []
    have = 0
    for frame in rows:
        held.append(frame)
        have += len(frame)
        if have >= n:
            whole = pd.concat(held, ignore_index=True)
            cut = have - have % n
            for at in range(0, cut, n):
                yield whole.iloc[at : at + n]
            held, have = [whole.iloc[cut:]], have - cut
    if have:
        yield pd.concat(held, ignore_index=True)
