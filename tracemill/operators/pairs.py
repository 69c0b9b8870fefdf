"""Preference pairs out of correct and incorrect traces of one problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.runtime import compute_once, interim_table

SALTS = 16
#: Traces of either side of a problem that are paired first, to learn what the best pairs reach.
PROBES = 8
#: Least quality and diversity of a pair, and what its parts weigh.
LEAST_QUALITY, LEAST_DIVERSITY = 0.05, 0.2
DIVERSITY, GAP, ALIGNED, DISAGREE, ANSWER, CONFIDENCE, SURE = 0.38, 0.22, 0.14, 0.10, 0.08, 0.12, 0.75
# What a kind of failure adds to a pair's quality.
BONUS = {"answer_mismatch": 0.18, "reasoning_gap": 0.12, "parse_like_failure": -0.05, "missing_final_answer": -0.10, "trivial_short": -0.15, "repetitive": -0.12}


def cross(traces: DataFrame, chosen: Column | None = None, *columns: str) -> DataFrame:
    """Every correct with every incorrect trace of a problem: c_ and r_ columns.

    chosen limits the correct side before the join. The correct side of a
    problem is dealt into SALTS parts, the incorrect side is given to each, so
    that a crowded problem is shared by that many tasks.
    """
    names = ["ord", *columns]
    good = traces.where("is_correct") if chosen is None else traces.where("is_correct").where(chosen)
    good = good.select("problem_id", F.pmod(F.hash("ord"), F.lit(SALTS)).alias("salt"), *(F.col(c).alias(f"c_{c}") for c in names))
    bad = traces.where("not is_correct").select("problem_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), *(F.col(c).alias(f"r_{c}") for c in names))
    return good.join(bad, ["problem_id", "salt"]).drop("salt")


def _with_likeness(pairs: DataFrame) -> DataFrame:
    """Pairs with the likeness of c_set and r_set, met once each, and whether either is empty; the sets are dropped."""
    counted = compute_once(pairs, {"common": F.size(F.array_intersect("c_set", "r_set")), "all": F.size("c_set") + F.size("r_set"), "empty": (F.size("c_set") == 0) | (F.size("r_set") == 0)}).drop("c_set", "r_set")
    return counted.withColumn("likeness", F.when(F.col("empty"), 0.0).otherwise(F.col("common") / (F.col("all") - F.col("common")))).drop("common", "all")


def word_sets(traces: DataFrame) -> DataFrame:
    """(problem_id, is_correct, set, n, ord): the different word sets of a problem's traces of either kind, how many traces have each, and the first of them."""
    sets = compute_once(traces, {"set": F.array_sort(F.array_distinct(F.transform(X.words(F.col("reasoning")), lambda w: F.xxhash64(w))))}).select("problem_id", "is_correct", "ord", "set").dropDuplicates(["ord"])
    return sets.groupBy("problem_id", "is_correct", "set").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))


def diverse_pairs(traces: DataFrame, least: float = 0.1) -> DataFrame:
    """All pairs of word sets that differ by at least least, with the number of pairs of traces each stands for; a side without words has diversity 0."""
    pairs = _with_likeness(cross(word_sets(traces), None, "set", "n"))
    pairs = pairs.withColumn("diversity", F.when(F.col("empty"), 0.0).otherwise(1 - F.col("likeness")))
    return pairs.where(F.col("diversity") >= least).select("problem_id", F.col("c_ord").alias("chosen"), F.col("r_ord").alias("rejected"), (F.col("c_n") * F.col("r_n")).alias("n"), "diversity")


def first_pairs(traces: DataFrame, n: int = 2) -> DataFrame:
    """The first n correct with the first n incorrect traces of a problem."""
    place = F.row_number().over(Window.partitionBy("problem_id", "is_correct").orderBy("ord"))
    return cross(traces.select("problem_id", "is_correct", "ord").withColumn("place", place).where(F.col("place") <= n)).select("problem_id", F.col("c_ord").alias("chosen"), F.col("r_ord").alias("rejected"))


def _rejected(prefix: str) -> list[Column]:
    """What the rejected side alone adds to the quality of a pair: how it ends, how it fails, how sure it is."""
    bonus = F.lit(0.0)
    for mode, value in BONUS.items():
        bonus = F.when(F.col(prefix + "mode") == mode, value).otherwise(bonus)
    return [F.when(F.col(prefix + "has_answer"), ANSWER).otherwise(-ANSWER), bonus, CONFIDENCE * F.least(F.col(prefix + "confidence"), F.lit(SURE))]


def pair_quality(diversity: Column | float) -> Column:
    """Quality of a pair with c_ and r_ columns of features."""
    gap = F.greatest(F.lit(0.0), F.col("c_confidence") - F.col("r_confidence"))
    aligned = F.least("r_steps", "c_steps") / F.greatest(F.col("c_steps"), F.lit(1))
    disagree = F.coalesce((F.col("r_answer_key") != F.col("c_answer_key")).cast("double"), F.lit(0.0))
    ends, bonus, sure = _rejected("r_")
    return DIVERSITY * diversity + GAP * gap + ALIGNED * aligned + DISAGREE * disagree + ends + bonus + sure


def millionths(x: Column) -> Column:
    """Rounded to six decimals by plain arithmetic, so that ranks don't hang on the last bit."""
    return F.floor(x * 1e6 + 0.5) / 1e6


COLUMNS = ("set", "steps", "mode", "answer_key", "has_answer", "confidence", "text_key")


def slim(feats: DataFrame) -> DataFrame:
    """What pairing needs of features, once per trace."""
    words = F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))
    return compute_once(feats.withColumn("text_key", F.md5("text")), {"set": words}).select("problem_id", "ord", "is_correct", *COLUMNS).dropDuplicates(["ord"])


def judged(pairs: DataFrame) -> DataFrame:
    """Pairs with c_ and r_ columns, with diversity, quality and the first reason to reject them."""
    pairs = compute_once(_with_likeness(pairs), {"diversity": millionths(1 - F.col("likeness"))}).drop("likeness")
    pairs = compute_once(pairs, {"quality": millionths(pair_quality(F.col("diversity")))})
    loose = (F.col("c_steps") > 0) & (F.col("r_steps") / F.greatest(F.col("c_steps"), F.lit(1)) < 0.5) & F.col("r_mode").isin("trivial_short", "missing_final_answer", "repetitive")
    reason = F.when(F.col("diversity") < LEAST_DIVERSITY, "low_diversity").when(F.col("c_answer_key") == F.col("r_answer_key"), "same_answer").when(loose, "unstructured_negative").when(F.col("quality") < LEAST_QUALITY, "low_quality")
    return pairs.withColumn("reject", reason)


def judged_pairs(feats: DataFrame) -> DataFrame:
    """All pairs with diversity, quality and the first reason to reject them."""
    return judged(cross(slim(feats), F.col("confidence") >= 0.5, *COLUMNS))


def _shared(core: str, first: int) -> Column:
    """Which of 63 words of core, from the first on, are in set, as bits."""
    return F.expr(f"aggregate(sequence(0, 62), 0L, (acc, i) -> acc | IF(array_contains(set, get({core}, {first} + i)), shiftleft(1L, i), 0L))")


def promising_pairs(traces: DataFrame, per_type: int) -> DataFrame:
    """The judged pairs among which the best per_type of every problem and kind of failure lie, ties and all.

    A few likely pairs of each problem are judged first; the last of the best
    that they give is a bar. A pair that can't reach it by any words is passed
    over, and so is a trace that can't with the best partner its problem could
    have. What two traces share is at least what both share with the surest
    correct trace of the problem, which bits tell without meeting their words.
    """
    heads = traces.where("is_correct and confidence >= 0.5").groupBy("problem_id").agg(F.max("confidence").alias("surest"), F.min_by("set", F.struct(-F.col("confidence"), "ord")).alias("core"))
    marked = traces.where("not is_correct or confidence >= 0.5").join(heads, "problem_id").withColumns({"m0": _shared("core", 0), "m1": _shared("core", 63), "n": F.size("set")}).drop("core")
    marked = interim_table(marked, "marked")
    good, bad = marked.where("is_correct"), marked.where("not is_correct").withColumn("own", sum(_rejected(""), F.lit(0.0)))
    place = lambda keys, *by: F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    first_good = good.withColumn("k", place(["problem_id"], F.col("confidence").desc(), "ord")).where(F.col("k") <= PROBES)
    first_bad = bad.withColumn("k", place(["problem_id", "mode"], (F.col("own") - GAP * F.col("confidence")).desc(), "ord")).where(F.col("k") <= PROBES)
    probes = judged(cross(first_good.unionByName(first_bad.drop("own")), None, *COLUMNS)).where("reject is null")
    reached = F.get(F.sort_array(F.collect_list("quality"), asc=False), F.lit(per_type - 1))
    bars = probes.groupBy("problem_id", F.col("r_mode").alias("mode")).agg(reached.alias("bar"))
    most = DIVERSITY + ALIGNED + DISAGREE + 1e-5
    bad = bad.join(bars, ["problem_id", "mode"], "left").withColumn("bar", F.coalesce("bar", F.lit(LEAST_QUALITY)))
    bad = bad.where(most + GAP * F.greatest(F.lit(0.0), F.col("surest") - F.col("confidence")) + F.col("own") >= F.col("bar"))
    both = good.withColumn("bar", F.lit(None).cast("double")).unionByName(bad.drop("own"))
    shared = F.bit_count(F.col("c_m0").bitwiseAND(F.col("r_m0"))) + F.bit_count(F.col("c_m1").bitwiseAND(F.col("r_m1")))
    differ = 1 - F.coalesce(F.try_divide(shared, F.col("c_n") + F.col("r_n") - shared), F.lit(0.0))
    pairs = cross(both, None, *COLUMNS, "bar", "m0", "m1", "n").where((pair_quality(differ) + 1e-5 >= F.col("r_bar")) & (differ + 1e-5 >= LEAST_DIVERSITY))
    return judged(pairs.select("problem_id", "c_ord", "r_ord", *(f"{x}_{c}" for c in COLUMNS for x in "cr")))


def smart_pairs(feats: DataFrame, per_type: int = 2, per_chosen: int = 2, per_problem: int = 5) -> DataFrame:
    """The best pairs of a problem: so many per kind of failure, then per chosen text, then in all."""
    best = [F.col("quality").desc(), F.col("diversity").desc(), F.col("c_confidence").desc(), "c_ord", F.col("r_confidence").desc(), "r_ord"]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
    pairs = promising_pairs(interim_table(slim(feats), "slim"), per_type).where("reject is null")
    pairs = pairs.withColumn("k", rank("problem_id", "r_mode")).where(F.col("k") <= per_type)
    pairs = pairs.withColumn("k", rank("problem_id", "c_text_key")).where(F.col("k") <= per_chosen)
    pairs = pairs.withColumn("k", rank("problem_id")).where(F.col("k") <= per_problem)
    return pairs.select("problem_id", F.col("c_ord").alias("chosen"), F.col("r_ord").alias("rejected"), F.col("r_mode").alias("error_type"), "diversity", "quality", F.col("k").alias("rank"))


def ordered_pairs(traces: DataFrame, per_problem: int = 3, total: int | None = None) -> DataFrame:
    """Pairs in order of arrival, so many per problem and in all; one per pair_id, the first.

    A pair_id stands for a problem and two canonical texts, so the first pair of
    an id joins the first traces with these texts; and the first pairs of a
    problem lie among its first texts of either kind. Nothing else is joined.
    """
    texts = traces.where("problem_id is not null").select("problem_id", "is_correct", "ord", X.dedup_hash(F.col("reasoning")).alias("h")).groupBy("problem_id", "is_correct", "h").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("problem_id", "is_correct").orderBy("ord"))
    first = texts.withColumn("k", place).where(F.col("k") <= per_problem).select("ord")
    few = traces.select("problem_id", "ord", "is_correct", "reasoning").join(first, "ord", "left_semi")
    good = few.where("is_correct").select("problem_id", F.col("ord").alias("c_ord"), F.col("reasoning").alias("c_reasoning"))
    bad = few.where("not is_correct").select("problem_id", F.col("ord").alias("r_ord"), F.col("reasoning").alias("r_reasoning"))
    pairs = good.join(bad, "problem_id").withColumn("k", F.row_number().over(Window.partitionBy("problem_id").orderBy("c_ord", "r_ord"))).where(F.col("k") <= per_problem)
    pairs = pairs if total is None else pairs.orderBy("c_ord", "r_ord").limit(total)
    return pairs.select("problem_id", F.col("c_ord").alias("chosen"), F.col("r_ord").alias("rejected"), X.pair_id(F.col("problem_id"), F.col("c_reasoning"), F.col("r_reasoning")).alias("pair_id"))
