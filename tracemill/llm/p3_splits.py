"""Problem 3: records of evaluation splits that also stand, exactly or almost, in the training split."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.p4_near import WordHashes
from tracemill.llm.visual_form import blocks
from tracemill.runtime import interim_table, table

#: Words two records must share, as a part of all their words.
LIKENESS = 0.8
#: Words of the rolling window, and the mean words of a chunk.
WINDOW, MEAN_CHUNK = 2, 3
#: Counters of words by hash, from which the order of rarity comes; their number is fixed, so that they may go to the driver.
COUNTERS = 1 << 16
_word = re.compile(r"[^\W\d_]+").findall
_number = re.compile(r"\d{1,3}(?:[,'’   ]\d{3})+(?!\d)(?:\.\d+)?|\d+(?:\.\d+)?").findall
_grouping = re.compile(r"[^\d.]").sub


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, in order."""
    return _word(text.lower())


def numbers_of(text: str) -> list[str]:
    """The numbers without digit grouping, sorted, with repeats."""
    return sorted(_grouping("", n) for n in _number(text))


def _digest(parts: list[str]) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks_of(words: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, lengths in letters and first places of the content-defined chunks of a normalised record.

    A record is given as the hashes and lengths of its words in a fixed order.
    A chunk ends where the rolling hash of the last WINDOW words falls on a
    multiple of MEAN_CHUNK, so that an edit changes the chunks around it alone.
    """
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    rolling = np.zeros(len(words), np.uint64)
    for k in range(WINDOW):
        rolling[k:] += words[: len(words) - k] * np.uint64(pow(0x100000001B3, k, 1 << 64))
    cut = _mix(rolling) % np.uint64(MEAN_CHUNK) == 0
    cut[-1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate(([0], ends[:-1]))
    place = np.arange(len(words)) - np.repeat(starts, ends - starts)
    digests = _mix(np.add.reduceat(_mix(words + place.astype(np.uint64)), starts)).view(np.int64)
    return digests, np.add.reduceat(letters, starts), starts


def pieces_of(words: np.ndarray, letters: np.ndarray, rarity: np.ndarray, likeness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digests by which a record meets others, and the digests and lengths of all its chunks.

    Words come in the order of rarity. Two sets that are alike share one of
    their rarest words, of which a set of n words needs n - ceil(likeness n) + 1.
    A record meets others by the chunks that begin among those, and by those
    words as chunks of one word each; so no pair that is alike is lost, and a
    common word brings none together.
    """
    order = np.lexsort((words, rarity[words & np.uint64(COUNTERS - 1)]))
    words, letters = words[order], letters[order]
    digests, sizes, starts = chunks_of(words, letters)
    rare = len(words) - int(np.ceil(likeness * len(words) - 1e-9)) + 1
    return np.unique(np.concatenate([digests[starts < rare], _mix(words[:rare]).view(np.int64)])), digests, sizes


def split_name(split: Column) -> Column:
    """Split names trimmed and in lower case; val and dev are validation."""
    name = F.lower(F.trim(split))
    return F.when(name.isin("val", "dev"), F.lit("validation")).otherwise(name)


FEATURES = "id string, side int, numbers long, class long, words array<long>, letters array<int>"
PIECES = "class long, side int, numbers long, n int, pieces array<long>, words array<long>, chunks array<long>, sizes array<long>"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offs = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([np.empty(0, np.int64), *values]), kind))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        for at, part in blocks(batch.column(2)):
            numbers, classes, words, letters = [], [], [], []
            for text in part.to_pylist():
                distinct, found = sorted(set(words_of(text))), numbers_of(text)
                numbers.append(_digest(found))
                classes.append(_digest([*distinct, "\1", *found]))
                words.append(np.array([known[w] for w in distinct], np.uint64).view(np.int64))
                letters.append(np.array([len(w) for w in distinct], np.int64))
            ids, side = (batch.column(k).slice(at, len(part)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, side, pa.array(numbers, pa.int64()), pa.array(classes, pa.int64()), _lists(words, pa.int64()), _lists(letters, pa.int32())], ["id", "side", "numbers", "class", "words", "letters"])


def cross_split_overlaps(records: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(train_id, eval_id, chunk_overlap, likeness) of records with id, text and split that overlap between splits.

    Two records overlap if their numbers are the same, digit grouping aside, and
    the words they share exceed likeness of all their words, in any order.
    Splits other than train, test and validation (val, dev) are neither side;
    null splits, ids and texts say nothing; texts without a word overlap with
    nothing. A pair of ids appears once, with its best texts. Extra columns are
    ignored.

    Records with the same words and numbers are one class, so copies meet once.
    A class is normalised to its distinct words, rarest first, and cut into
    chunks; classes of the two sides are joined by chunk digest and numbers, in
    such a way that no pair that is alike is lost (pieces_of). The lengths of
    all shared chunks give the overlap fraction, and the words decide exactly.
    """
    name = split_name(F.col("split"))
    side = F.when(name == "train", 0).when(name.isin("test", "validation"), 1)
    src = records.select(F.col("id").cast("string").alias("id"), side.alias("side"), F.col("text").cast("string").alias("text"))
    src = src.where("id is not null and side is not null and text is not null").distinct()
    rows = interim_table(src.mapInArrow(_features, FEATURES), "features")
    members = rows.select("id", "side", "class").distinct()
    classes = rows.where("size(words) > 0").groupBy("class", "side").agg(*(F.first(c).alias(c) for c in ("numbers", "words", "letters")))
    slots = classes.select(F.explode("words").alias("word")).groupBy(F.col("word").bitwiseAND(COUNTERS - 1).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    rarity = np.zeros(COUNTERS, np.int64)
    for r in slots.collect():
        rarity[r.slot] = r.n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [pieces_of(np.asarray(w.values).view(np.uint64), np.asarray(n.values).astype(np.int64), rarity, likeness) for w, n in zip(batch.column("words"), batch.column("letters"))]
            pieces, chunks, sizes = ([d[k] for d in done] for k in range(3))
            n = pc.list_value_length(batch.column("words")).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "side", "numbers")), n, _lists(pieces, pa.int64()), batch.column("words"), _lists(chunks, pa.int64()), _lists(sizes, pa.int64())], ["class", "side", "numbers", "n", "pieces", "words", "chunks", "sizes"])

    pieces = interim_table(classes.mapInArrow(cut, PIECES), "pieces")
    meeting = pieces.select("class", "side", "numbers", "n", F.explode("pieces").alias("piece"))
    left = meeting.where("side = 0").select(F.col("class").alias("ca"), "numbers", "piece", F.col("n").alias("na"))
    right = meeting.where("side = 1").select(F.col("class").alias("cb"), "numbers", "piece", F.col("n").alias("nb"))
    fits = F.least("na", "nb") > likeness * F.greatest("na", "nb")
    found = left.join(right, ["numbers", "piece"]).where(fits).select("ca", "cb").distinct()
    one = pieces.where("side = 0").select(F.col("class").alias("ca"), F.col("words").alias("wa"), F.col("chunks").alias("ha"), F.col("sizes").alias("za"))
    two = pieces.where("side = 1").select(F.col("class").alias("cb"), F.col("words").alias("wb"), F.col("chunks").alias("hb"), F.col("sizes").alias("zb"))
    common = F.size(F.array_intersect("wa", "wb"))
    checked = found.join(one, "ca").join(two, "cb").withColumn("likeness", common / (F.size("wa") + F.size("wb") - common)).where(F.col("likeness") > likeness)
    total = lambda z: F.aggregate(z, F.lit(0).cast("long"), lambda a, b: a + b)
    shared = total(F.transform(F.filter(F.arrays_zip("ha", "za"), lambda c: F.array_contains("hb", c["ha"])), lambda c: c["za"]))
    pairs = checked.select("ca", "cb", (shared / F.least(total("za"), total("zb"))).alias("chunk_overlap"), "likeness")
    a = members.where("side = 0").select(F.col("class").alias("ca"), F.col("id").alias("train_id"))
    b = members.where("side = 1").select(F.col("class").alias("cb"), F.col("id").alias("eval_id"))
    met = pairs.join(a, "ca").join(b, "cb").where("train_id != eval_id")
    return met.groupBy("train_id", "eval_id").agg(F.max("chunk_overlap").alias("chunk_overlap"), F.max("likeness").alias("likeness"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dpo_pairs_v1").select(F.lower(F.trim("pair.problem_id")).alias("id"), F.col("provenance.source_split").alias("split"), F.col("pair.problem").alias("text"), F.lower(F.trim("provenance.source_dataset")).alias("source"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split_overlaps(_records(spark, sf_dir))
    return pairs.select(F.least("train_id", "eval_id").alias("problem_id_a"), F.greatest("train_id", "eval_id").alias("problem_id_b")).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source: problems, and how many of them overlap with training ones."""
    records = _records(spark, sf_dir)
    hit = cross_split_overlaps(records).select(F.col("eval_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    problems = records.where("id is not null").select("id", split_name(F.col("split")).alias("split"), "source").where("split in ('test', 'validation')").distinct()
    return problems.join(hit, "id", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("problems"), F.count("hit").alias("overlapping"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
_OVERLAPS = r"""
        r AS (SELECT DISTINCT lower(trim(pair.problem_id)) AS id, lower(trim(provenance.source_split)) AS s, pair.problem AS t FROM dpo_pairs_v1 WHERE pair.problem_id IS NOT NULL AND pair.problem IS NOT NULL),
        f AS (SELECT DISTINCT id, CASE WHEN s = 'train' THEN 0 WHEN s IN ('test', 'validation', 'val', 'dev') THEN 1 END AS side,
                     list_distinct(regexp_extract_all(lower(t), '\p{L}+')) AS w, list_sort(list_transform(regexp_extract_all(t, '\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?'), lambda x: replace(x, ',', ''))) AS n FROM r),
        p AS (SELECT a.id AS x, b.id AS y, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS la, len(b.w) AS lb FROM f a JOIN f b ON a.n = b.n AND a.side = 0 AND b.side = 1 AND a.id <> b.id),
        o AS (SELECT DISTINCT x, y FROM p WHERE c > 0.8 * (la + lb - c))
"""
SQL = {
    "p3_found": f"WITH {_OVERLAPS} SELECT DISTINCT least(x, y) AS problem_id_a, greatest(x, y) AS problem_id_b FROM o",
    "p3_report": f"""WITH {_OVERLAPS},
        e AS (SELECT DISTINCT lower(trim(pair.problem_id)) AS id, CASE WHEN lower(trim(provenance.source_split)) IN ('val', 'dev') THEN 'validation' ELSE lower(trim(provenance.source_split)) END AS split, lower(trim(provenance.source_dataset)) AS source FROM dpo_pairs_v1 WHERE pair.problem_id IS NOT NULL)
        SELECT split, source, count(*) AS problems, count(*) FILTER (id IN (SELECT y FROM o)) AS overlapping FROM e WHERE split IN ('test', 'validation') GROUP BY 1, 2""",
}
