"""Single operators on small inputs with known results."""

import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import symbolic
from tracemill.functions import text as X
from tracemill.operators import agreement, dedup, hooks, pairs, perturb, robustness, search, training, verify, voting
from tracemill.operators.components import component_labels
from tracemill.operators.ranking import place_in_group
from tracemill.plans import q_custom, q_train
from tracemill.runtime import table
from tracemill.sources import readers, receipts, sinks
from tracemill.streaming import messages, pipelines


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("All in all \\boxed{318} tiles.", "318"), ("The two crates hold 29.\n#### 29", "29"), ("Therefore, the answer is 64 plums.", "64"), ("Both rows together: sum = 71", "71"),
        ("First the left side.\nFinal Answer: 83", "83"), ("<|user|>\n<|assistant|>\n|", None), ("", None), (None, None), ("answer: k=5, m=-8", "k=5, m=-8"),
    ],
)
def test_final_answer(spark, text, expected):
    assert A.with_final_answer(spark.createDataFrame([(text, 1)], "t string, _x int"), "t", "a", "m").first().a == expected


@pytest.mark.parametrize(("value", "expected"), [("1,234", 1234.0), ("$100", 100.0), ("1/2", 0.5), ("1e-3", 0.001), ("7d", None), ("1_000", None), ("3 1/2", None), ("100 \\text{ minutes", 100.0), ("1/0", None), (None, None), ("42 dollars", 42.0)])
def test_number(spark, value, expected):
    assert A.with_number(spark.createDataFrame([(value,)], "t string"), "t", "n").first().n == expected


@pytest.mark.parametrize(("a", "b", "same"), [("y=-3, x=2", "x=2, y=-3", True), ("x=2", "x=2.5", False), ("x=2", "2", False), (None, "x=1", False)])
def test_assignments(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(A.assignments_equal(F.col("a"), F.col("b")).alias("y")).first().y is same


@pytest.mark.parametrize(("a", "b", "same"), [("2*t", "t+t", True), ("(x+1)^2", "x^2+2x+1", True), ("x/2", "0.5x", True), ("1/x", "x", False), ("x", None, False), ("__import__('os')", "1", False), ("x/0", "x/0", False), ("x**99", "x**99", True), ("(x+y)^40 * (x-y)^40", "(x^2-y^2)^40", True), ("(x+y)^40", "(x-y)^40", False), ("2^10", "1024", True), ("sqrt(16)", "4", True), ("pi", "3.1415926536", True), ("1/3", "0.33333333333", True), ("x^1.5", "x^1.5", False), ("", "", False), ("0.1+0.2", "0.3", True)])
def test_symbolic(a, b, same):
    assert symbolic.equal(a, b) is same


@pytest.mark.parametrize(("a", "b", "same"), [("a=2t, b=7", "b = 14/2; a=t+t", True), ("a=1", "a=1, b=2", False), ("a=1, 7", "a=1", False), ("", "", False), (None, "a=1", False), ("a=k^2", "a=k", False)])
def test_symbolic_assignments(a, b, same):
    assert symbolic.same_assignments(a, b) is same


def test_verify_chain(spark):
    rows = [
        (1, "We get 1,204 in all.\n#### 1,204", "1204.0", "correct", "number", 1.0), (2, "The answer is Red Kite", "red kite", "correct", "text", 1.0), (3, "answer: m=2, n=-3", "n=-3, m=2", "correct", "assignments", 1.0),
        (4, "The answer is t*k", "k*t", "correct", "expression", 1.0), (5, "#### 8", "9", "incorrect", None, 0.0), (6, "no such thing can be said of any of those old green boats at all", "9", "parse_error", None, 1.0), (7, None, "9", "parse_error", None, 1.0),
        (8, "#### 8", None, "incorrect", None, 0.0), (9, "The answer is about 12 geese", "12", "correct", "text", 1.0), (10, "answer: m=k+k", "m=2k", "correct", "expression", 1.0), (11, "", "", "parse_error", None, 1.0),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, reasoning string, gold string").withColumn("confidence", F.lit("clash"))
    got = {r.id: (r.status, r.by, r.confidence) for r in verify.verified(df.drop("confidence"), "reasoning", "gold").collect()}
    assert got == {r[0]: r[3:] for r in rows}
    assert verify.verified(df.limit(0), "reasoning", "gold").count() == 0


def test_rewards(spark):
    rows = [("correct", 1.0), ("incorrect", 0.0), ("parse_error", -0.25), ("timeout", -0.25), ("odd", -0.1), (None, -0.1)]
    df = spark.createDataFrame(rows, "status string, want double")
    assert all(r.want == r.got for r in df.withColumn("got", verify.reward(F.col("status"))).collect())
    rows = [("we have\n#### 41.4", "41", 0.5, False), ("#### 41", "$41", 1.0, True), ("therefore it must be 41", "41", 0.0, True), ("41 of them", "41", 0.0, True), ("none", "41", 0.0, False), (None, "41", 0.0, False), ("#### 41", None, 0.0, False), ("The answer is: 90", "1,041", 0.0, False)]
    df = spark.createDataFrame(rows, "r string, g string, reward double, right boolean").withColumns({"a": verify.graded_reward(F.col("r"), F.col("g")), "b": verify.strictly_right(F.col("r"), F.col("g"))})
    assert [(r.a, r.b) for r in df.collect()] == [(r[2], r[3]) for r in rows]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("<<48/2=24>> <<48+24=72>>", 1.0), ("<<2+2=5>> <<3*3=10>>", 0.0), ("<<2+2=4>> <<3*3=10>>", 0.5), ("none", 1.0), ("<<1+1=2>> <<5/0=0>>", 0.5), ("<<1.5+0.5=2.0>> <<3x4=12>>", 1.0), (None, 1.0)],
)
def test_step_coherence(spark, text, expected):
    assert one(spark, text, X.step_coherence) == expected


@pytest.mark.parametrize(("n", "median", "expected"), [(100, 200, 1), (400, 200, 1), (600, 200, 0.75), (800, 200, 0.5), (1200, 200, 0), (100, 0, 1)])
def test_length_penalty(spark, n, median, expected):
    assert spark.range(1).select(X.length_penalty(F.lit(n), F.lit(median)).alias("y")).first().y == expected


def test_hashes(spark):
    assert one(spark, "step 1\nstep 2\n", X.dedup_hash) == one(spark, "Step 1\tStep 2", X.dedup_hash)
    key = lambda c, r: spark.range(1).select(X.pair_id(F.lit("p1"), F.lit(c), F.lit(r)).alias("y")).first().y
    assert key("Hello World", "X") == key("  hello   world\n", "x")


@pytest.mark.parametrize(("value", "expected"), [("1/2", "0.5"), ("x 3, then 4.50", "4.5"), ("5/0", "5/0"), ("Blue  Cat!", "blue cat"), ("  ", None), (None, None), ("1,204", "1204"), ("37.0", "37")])
def test_answer_key(spark, value, expected):
    assert one(spark, value, X.answer_key) == expected


@pytest.mark.parametrize(
    ("a", "b", "kappa"),
    [("TFTF", "TFTF", 1.0), ("TTFF", "FFTT", -1.0), ("T" * 10, "T" * 10, 1.0), ("T" * 5, "F" * 5, 0.0), ("TNTFF", "TTTFF", 1.0), ("", "", 0.0)],
)
def test_kappa(spark, a, b, kappa):
    code = {"T": True, "F": False, "N": None}
    df = spark.createDataFrame([(code[x], code[y]) for x, y in zip(a, b)], "a boolean, b boolean")
    assert agreement.with_kappa(df.agg(*agreement.rates())).first().kappa == kappa


def test_pairs(spark):
    rows = [(1, "p", "a b c d", True, 1.0), (2, "p", "a b x y", False, 0.1), (3, "p", "", False, 0.2), (4, "q", "a", True, 1.0), (5, None, "a", False, 0.0)]
    t = spark.createDataFrame(rows, "ord long, problem_id string, reasoning string, is_correct boolean, confidence double")
    assert {(r.chosen, r.rejected) for r in pairs.diverse_pairs(t).collect()} == {(1, 2)}
    assert {(r.chosen, r.rejected) for r in pairs.ordered_pairs(t, per_problem=1).collect()} == {(1, 2)}
    assert pairs.ordered_pairs(t.limit(0)).count() == 0


def test_greedy_dedup(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, "p", base, 0.1), (2, "p", base + " x", 0.9), (3, "p", base + " x y", 0.5), (4, "p", "other words", 0.1), (5, "q", base, 0.1), (6, "p", "", 0.1), (7, "p", "", 0.2)]
    t = spark.createDataFrame(rows, "ord long, problem_id string, reasoning string, confidence double")
    assert sorted(r.ord for r in dedup.greedy_dedup(t).collect()) == [2, 4, 5, 6, 7]
    assert dedup.greedy_dedup(t.limit(0)).count() == 0


def _crowd(spark, rows=1100):
    """Traces of one problem that share their words, in families of near copies, and their bytes of text."""
    rng = random.Random(7)
    words = [f"word{k}" for k in range(150)]
    texts: list[list[str]] = []
    for k in range(rows):
        own = rng.sample(words, 60) if k % 5 < 3 else list(texts[rng.randrange(max(0, k - 40), k)])
        for _ in range(rng.randrange(4) if k % 5 >= 3 else 0):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(own[: rng.randrange(52, 61)] if k % 5 == 4 else own)
    made = [(k, "p", " ".join(t), rng.random()) for k, t in enumerate(texts)]
    return made, spark.createDataFrame(made, "ord long, problem_id string, reasoning string, confidence double").repartition(8), sum(len(r[2]) for r in made)


def _alike(rows, likeness=0.85):
    sets = [(r[0], r[1], set(r[2].split())) for r in rows]
    return {(a, b) for k, (a, p, s) in enumerate(sets) for b, q, t in sets[k + 1 :] if p == q and s and t and len(s & t) / len(s | t) > likeness}


def _greedy(rows):
    near = _alike(rows)
    kept: list[tuple] = []
    for r in rows:
        hit = next((h for h in kept if (h[0], r[0]) in near or (r[0], h[0]) in near), None)
        if hit is None or r[3] > hit[3]:
            kept = [h for h in kept if h is not hit] + [r]
    return sorted(r[0] for r in kept)


def _shuffled(spark):
    """Bytes that all tasks have shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_greedy_dedup_of_a_crowded_problem(spark, no_broadcasts):
    rows, t, size = _crowd(spark)
    before = _shuffled(spark)
    got = sorted(r.ord for r in dedup.greedy_dedup(t).collect())
    assert got == _greedy(rows) and len(got) < len(rows)
    assert _shuffled(spark) - before < 12 * size


def test_like_pairs_of_a_crowded_problem(spark, no_broadcasts):
    rows, t, size = _crowd(spark)
    before = _shuffled(spark)
    got = [(r.a, r.b) for r in dedup.like_pairs(t).collect()]
    assert len(got) == len(set(got)) and set(got) == _alike(rows)
    assert _shuffled(spark) - before < 12 * size


@pytest.mark.parametrize("likeness", [0.5, 0.85])
@pytest.mark.parametrize("crowd", [0, 20, 10**6])
def test_classes_by_keys_or_at_once(spark, crowd, likeness):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        size = rng.choice((1, 2, 5, 8, 20, 21, 60))
        old = rng.choice(rows)[2].split() if rows and rng.random() < 0.7 else [f"w{rng.randrange(300)}" for _ in range(size)]
        rows.append((k, rng.choice("ppppqr"), " ".join(old[: len(old) - rng.randrange(2)] + ["new"] * rng.randrange(2))))
    t = spark.createDataFrame(rows + [(400, None, rows[0][2]), (401, None, rows[0][2]), (402, "p", None)], "ord long, problem_id string, reasoning string")
    members, links = dedup.like_classes(t, likeness, crowd)
    of = {r.ord: getattr(r, "class") for r in members.collect()}
    first = {}
    assert of == {k: first.setdefault((p, frozenset(x.split())), k) for k, p, x in rows if x.split()}
    apart = {(a, b) for a, b in _alike(rows, likeness) if of[a] == a and of[b] == b}
    got = [(r.x, r.y) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == apart


@pytest.mark.parametrize("crowd", [0, 10**6])
def test_like_pairs_with_members(spark, crowd):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[:k] + [f"x{rng.randrange(9)}"] + base[k + 1 :]) for k in (rng.randrange(60) for _ in range(120))]
    rows = [(1000 - k, rng.choice("pppq"), rng.choice(texts[: 1 + k])) for k in range(300)] + [(2000, "q", " "), (2001, "p", "")]
    t = spark.createDataFrame(rows + rows[:20] + [(2002, None, texts[0]), (2003, None, texts[0]), (2004, "p", None)], "ord long, problem_id string, reasoning string").repartition(4)
    got = {(r.a, r.b): r.likeness for r in dedup.like_pairs(t, crowd=crowd).collect()}
    sets = {r[0]: set(r[2].split()) for r in rows}
    expected = {(min(k), max(k)) for k in _alike(rows)}
    assert dedup.like_pairs(t, crowd=crowd).count() == len(got) and set(got) == expected
    assert all(like == len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for (a, b), like in got.items())


def test_like_pairs_of_a_family_of_near_copies(spark, no_broadcasts):
    rng = random.Random(11)
    base = [f"word{k}" for k in range(150)]
    rows = []
    for k in range(1200):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(150)] = f"own{rng.randrange(10**6)}"
        rows.append((k, "p", " ".join(own)))
    t = spark.createDataFrame(rows, "ord long, problem_id string, reasoning string").repartition(8)
    got = dedup.like_pairs(t).selectExpr("count(*)", "count(distinct a, b)", "count_if(a < b)").first()
    assert tuple(got) == (1200 * 1199 // 2,) * 3  # any two differ in at most six of 150 words
    before = _shuffled(spark)
    dedup.like_pairs(t).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before < 12 * sum(len(r[2]) for r in rows)


def test_words_part_at_the_same_blanks(spark):
    every = spark.range(1, 0x110000).where("id not between 55296 and 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') as c")
    blank = {r.id for r in every.where(F.col("c").rlike(f"^{X.BLANK}$")).collect()}
    assert blank == {k for k in range(1, 0x110000) if not chr(k).split()}


def test_batches():
    frames = [pd.DataFrame({"x": range(a, b)}) for a, b in ((0, 3), (3, 4), (4, 11))]
    assert [f["x"].tolist() for f in dedup.batches_of(iter(frames), 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]]


def test_components(spark):
    got = {r.node: r.label for r in component_labels(spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 21), (5, 5), (None, 1)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10), 0), 20: 20, 21: 20}


def test_places(spark):
    rows = [(k % 2 if k % 7 else None, k) for k in range(50)]
    got = place_in_group(spark.createDataFrame(rows, "g int, x int"), "g", "x").collect()
    for g in (0, 1, None):
        mine = sorted((r.x, r.place, r["size"]) for r in got if r.g == g)
        assert [m[1] for m in mine] == list(range(1, len(mine) + 1)) and {m[2] for m in mine} == {len(mine)}


def test_voting(spark):
    t = spark.createDataFrame([(1, "p", "9", 1.0, False), (2, "p", "12", 0.2, True), (3, "p", "12", 0.2, True), (4, "q", None, 0.3, False)], "ord long, problem_id string, answer string, score double, is_correct boolean")
    counted = voting.votes(t)
    assert [(r.problem_id, r.answer, r.n) for r in voting.majority(counted).collect()] == [("p", "12", 2)]
    assert voting.weighted(counted).first().answer == "9"
    assert {r.k: r.passed for r in voting.pass_at(t, (1, 2)).collect()} == {1: 0, 2: 1}


def test_perturbations(spark):
    p = spark.createDataFrame([("It costs 5 dollars.", "5"), ("He walks 2 hours.", "4"), ("It weighs 3 kg.", "6"), ("No unit.", "1"), ("2 hours", "x")], "t string, a string")
    got = [r.o for r in p.select(perturb.unit_change(F.col("t"), F.col("a")).alias("o")).collect()]
    assert [(g.answer, g.applicable) for g in got] == [("500", True), ("240", True), ("6000", True), (None, False), (None, False)]
    assert got[0].text == "It costs 5 cents."
    s = spark.createDataFrame([("Tom ran. Ann sat. Who won?",), ("He ran. Ann sat. Who?",), ("Tom ran. He sat. Who?",), ("One. Two.",)], "t string")
    out = [r.o for r in s.select(perturb.reordering(perturb.sentences(F.col("t")), F.col("t")).alias("o")).collect()]
    assert [o.reason for o in out] == [None, "pronoun_in_s1", "pronoun_at_s2_start", "too_few_sentences"] and out[0].text == "Ann sat. Tom ran. Who won?"
    n = spark.createDataFrame([("a", "Ann has 4 bags of 3.", "12", "<<4*3=12>>"), ("b", "5 and 7", "12", "<<5+7=12>>"), ("c", "x", "1", None)], "id string, t string, a string, s string")
    swap = [r.o for r in n.select(perturb.number_swap(F.col("id"), F.col("t"), F.col("a"), F.col("s")).alias("o")).collect()]
    assert [o.reason for o in swap] == [None, "non_multiplicative_final", "no_solution"]
    assert float(swap[0].answer) == 12 * float(swap[0].new_operand) / float(swap[0].operand)


def test_robustness(spark):
    rows = [("c", True, True, k < 5) for k in range(10)]
    o = spark.createDataFrame(rows, "change string, applicable boolean, before boolean, after boolean")
    assert robustness.retention(o).first().retention == 0.5
    rows = spark.range(200).selectExpr("id", "'g' AS g", "CAST(id % 2 AS double) AS v", "1 AS low").unionAll(spark.sql("SELECT 7L, 'one', 3D, 1 UNION ALL SELECT 8L, 'none', NULL, 1 UNION ALL SELECT NULL, 'g', 9D, 1"))
    got = {r.group: r for r in robustness.bootstrap_metric(rows, "id", "g", {"s": F.col("v"), "n": F.col("v").isNotNull().cast("int")}, F.try_divide("s", "n")).collect()}
    assert got["g"].low < got["g"].value == 0.5 < got["g"].high and got["g"].high - got["g"].low < 0.2
    assert (got["one"].low, got["one"].value, got["one"].high) == (3, 3, 3) and got["none"].value is None and got["none"].low is None
    p = spark.createDataFrame([("a", "Ann has 4 bags of 3. Bob has 2. Who won?", "12", "<<4*3=12>>", 1), ("b", None, None, None, 1)], "id string, problem string, answer string, full_solution string, change int")
    out = {(r.id, r.change): r for r in perturb.apply_all(p).collect()}
    assert len(out) == 12 and list(perturb.REGISTRY)[0] == "number_swap" and not out["b", "reordering"].applicable
    swap = out["a", "number_swap"]
    assert swap.applicable and swap.rewrites and swap.text != "Ann has 4 bags of 3. Bob has 2. Who won?" and out["a", "irrelevant_context"].new_answer == "12"
    assert spark.createDataFrame([(2.0,), (8.0,)], "v double").select(robustness.geometric_mean(F.col("v")).alias("g")).first().g == pytest.approx(4.0)


def test_training(spark):
    h = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.505), ("r", 3, 0.52), ("r", 4, None)], "run string, step long, score double")
    b = training.best_checkpoint(h, 0.01).first()
    assert (b.score, b.step, b.since) == (0.52, 3, 0)
    s = spark.createDataFrame([("k", "rejected", 0, 1), ("k", "rejected", 1, 0), ("k", "rejected", 2, None), ("k", "chosen", 0, None)], "key string, side string, i int, label int")
    assert [(r.i, r.label) for r in training.step_labels(s).orderBy("i").collect()] == [(0, 1), (1, 0), (2, 0)]


def test_running_median_of_all_so_far(spark):
    rows = [(k, "pq"[k % 2], None if k % 11 == 3 else (k * 37) % 101) for k in range(120)]
    got = {r.ord: r.median for r in training.running_median(spark.createDataFrame(rows, "ord long, part string, n int")).collect()}
    for k, p, _ in rows:
        far = [n for o, q, n in rows if q == p and o <= k and n is not None]
        assert got[k] == (int(statistics.median(far)) if far else None)


def test_hooks(spark):
    p = spark.createDataFrame([("a", "x"), ("b", None)], "problem_id string, problem string")
    got = hooks.generate(p, lambda t, n: [t.upper()] * n, 2).collect()
    assert sorted((r.problem_id, r.reasoning, r.error is None) for r in got) == [("a", "X", True), ("a", "X", True), ("b", None, False)]
    v = hooks.verify(spark.createDataFrame([("1", "1"), ("x", "2")], "answer string, gold string"), lambda a, g: float(a) == float(g)).orderBy("answer").collect()
    assert [(r.is_correct, r.error is None) for r in v] == [(True, True), (False, False)]
    assert hooks.clean_code("```python\ndef f():\n    return 1\n\ndef g():\n    pass\n```") == "def f():\n    return 1"
    cache = hooks.PrefixCache(6)
    cache.put([1, 2, 3])
    assert cache.get([1, 2, 3, 4]) == 3
    cache.put([5, 6, 7, 8])
    assert cache.evicted == 1 and cache.get([1]) == 0
    often = hooks.PrefixCache(6, "lfu")
    for tokens in ([1, 2, 3], [1, 2, 3], [4, 5]):
        if often.get(tokens) < len(tokens):
            often.put(tokens)
    often.put([6, 7])
    assert set(often.held) == {(1, 2, 3), (6, 7)} and often.evicted == 1 and often.get([1, 2, 3, 9]) == 3
    long = hooks.PrefixCache(20_000)
    for k in range(4):
        long.put([k, *range(5000)])
    assert long.get([3, *range(6000)]) == 5001 and long.get([0, *range(5000)]) == 0 and long.evicted == 1
    assert search.beam("p", lambda p, t, n: ["a", "b"], lambda p, t: t.count("b"), lambda t: len(t) == 3) == "bbb"
    assert one(spark, "SyntaxError: x", hooks.failure_class).status == "compile_error"


def test_cache_takes_whole_problems(spark, tmp_path):
    text = "one two three four five six seven eight"
    rows = [("a", text), ("b", text + " nine"), ("c", "one two three four five six SEVEN eight ten"), ("d", "one two three four five six other")]
    spark.createDataFrame(rows, "id string, problem string").write.parquet(str(tmp_path / "problems.parquet"))
    assert [(r.hits, r.misses, r.evicted) for r in q_custom.lru_cache(spark, str(tmp_path)).collect()] == [(2, 2, 0)]


def test_stage_keeps_all_events(spark, sf):
    want = table(spark, sf, "events").where("value > 10").select("event_id")
    got = q_custom.stream_stage(spark, sf).select("event_id")
    assert want.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_prefix_of_more_than_32_words(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(92))
    spark.createDataFrame([(1, text), (2, text + " end"), (3, "w0 w1 x"), (4, "x"), (5, text[:text.index(" w40")] + " other"), (6, " ".join(text.split()[:32]))], "item_id long, item_text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    spark.createDataFrame([("a", text + " and more"), ("b", None), ("c", "w0 w1")], "id string, problem string").write.parquet(str(tmp_path / "problems.parquet"))
    assert {r.item_id: r.n_words for r in q_train.prefix_match(spark, str(tmp_path)).collect()} == {1: 92, 2: 92, 3: 2, 4: 0, 5: 40, 6: 32}


def test_messages_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("k1", 1), ("k2", None)], "key string, n int").select("key", F.struct("n").alias("data"))
    sent = messages.envelope(rows, "t", "kind", F.lit(1.5)).unionByName(spark.createDataFrame([("t", "k3", "not-json")], "topic string, key string, value string"))
    back = messages.open_envelope(sent, "n int").orderBy("key").collect()
    assert [(r.key, r.type, r.data.n, r.timestamp) for r in back] == [("k1", "kind", 1, 1.5), ("k2", "kind", None, 1.5)]
    sent.write.parquet(str(tmp_path / "in"))
    stream = pipelines.stage(spark.readStream.schema(sent.schema).parquet(str(tmp_path / "in")), "n int", lambda d: d.where("n is not null"))
    pipelines.run_available(stream, lambda b, k: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={k}")), str(tmp_path / "state"))
    assert [(r.key, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("k1", 1)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"prompt":"p","chosen":"c","rejected":"r"}\nnot-json\n\n{"prompt":"","problem":"q","chosen":"c","rejected":"r"}\n{"prompt":"p","chosen":"c"}\n')
    got = readers.preference_pairs(spark, str(tmp_path / "in.jsonl"))
    assert sorted(r.prompt for r in got.collect()) == ["p", "q"]
    q = spark.createDataFrame([(1, "Q1", "s\n#### 1,234"), (2, "Q2", "a\nlast")], "ord int, question string, answer string")
    assert [(r.id, r.answer) for r in readers.gsm8k(q, "test").orderBy("id").collect()] == [("gsm8k_test_0", "1234"), ("gsm8k_test_1", "last")]
    m = spark.createDataFrame([(1, "P", "so \\boxed{7}", "Level 5", "Algebra"), (2, "P", "x", "Level 1", "Algebra")], "ord int, problem string, solution string, level string, type string")
    assert [(r.id, r.answer) for r in readers.math(m, "train", limit=1, level="5").collect()] == [("math_train_0", "7")]
    with pytest.raises(ValueError):
        readers.loader("nothing")
    p = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "pair_id string, x int")
    assert sinks.append_new(p, str(tmp_path / "pairs")) == 2 and sinks.append_new(p.union(spark.createDataFrame([("c", 3)], p.schema)), str(tmp_path / "pairs")) == 1
    odd = f"file:{tmp_path}/uri pairs"
    assert [sinks.append_new(p, odd) for _ in range(2)] == [2, 0] and spark.read.parquet(odd).count() == 2
    assert sinks.held_keys(spark, str(tmp_path / "none")) is None and sinks.append_new(p.limit(0), str(tmp_path / "empty")) == 0
    flat = str(tmp_path / "flat")
    spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string").write.parquet(flat)
    assert [sinks.migrate_path(spark, flat, "2026-01-01T00:00:00+00:00") for _ in range(2)] == [True, False]
    assert sinks.is_v1(spark.read.parquet(flat)) and spark.read.parquet(flat + ".bak").columns == ["prompt", "chosen", "rejected"]
    counts = spark.createDataFrame([("a b", 1, 2, 3, None, 0.5)], "pair string, tp long, fp long, fn long, tn long, kappa double")
    sinks.confusion_files(counts, str(tmp_path / "rep"), "confusion")
    assert spark.read.json(str(tmp_path / "rep" / "confusion")).first().matrix == [[1, 2], [3, 0]]
    text = sinks.markdown_table(counts.select("pair", "kappa"), "Agreement")
    assert text.startswith("## Agreement") and "| a b | 0.5000 |" in text and "More than 0 rows." in sinks.markdown_table(counts, "x", 0)
    judged = spark.createDataFrame([(1, False, True, None), (2, True, True, "X"), (3, None, True, "X")], "path_id long, a boolean, b boolean, reason_code string")
    sinks.shortcut_lines(judged, str(tmp_path / "cuts"))
    assert [(r.path_id, r.reason) for r in spark.read.json(str(tmp_path / "cuts")).collect()] == [(1, "OTHER")]
    sinks.outcome_lines(judged.withColumn("change", F.lit("swap")), str(tmp_path / "outcomes"))
    assert {r.change for r in spark.read.json(str(tmp_path / "outcomes")).collect()} == {"swap"}
    sinks.point_to_latest(spark, str(tmp_path), "r7")
    sinks.training_step(spark, str(tmp_path / "log"), 3, loss=0.5)
    assert spark.read.json(str(tmp_path / "latest.json")).first().run == "r7" and spark.read.json(str(tmp_path / "log")).first().loss == 0.5
    assert sinks.checkpoint_of(spark, str(tmp_path)) is None
    (tmp_path / "final").mkdir()
    assert sinks.checkpoint_of(spark, str(tmp_path)).endswith("final")
    samples = spark.createDataFrame([(1, True), (2, False), (3, None)], "path_id long, is_correct boolean")
    sinks.run_outputs(samples, spark.createDataFrame([("q", "c", "r")], "problem string, chosen string, rejected string"), str(tmp_path / "out"), kept=samples.limit(1))
    assert spark.read.json(str(tmp_path / "out" / "stats")).first().asDict() == {"samples": 3, "correct": 1, "incorrect": 1, "pairs": 1} and (tmp_path / "out" / "filtered_samples").is_dir()
    old = sinks.migrate_pairs(spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string"), "2026-01-01T00:00:00+00:00").first()
    assert old.provenance.generator_backend == "legacy" and old.quality_score is None and old.pair.problem_id.startswith("legacy_")
    run = sinks.RunRecord(str(tmp_path / "run"), "r")
    run.metrics(a=1.0)
    assert run.finish()["metrics"] == {"a": 1.0} and sinks.flatten_numbers({"a": {"b": 1, "c": True}, "d": 2.5}) == {"a.b": 1.0, "d": 2.5}
    assert [r.output for r in readers.rotating(spark.createDataFrame([(1, "p", "x"), (2, "p", "y")], "ord int, problem string, reasoning string"), spark.createDataFrame([("p",)], "problem string"), 3).orderBy("k").collect()] == ["x", "y", "x"]


def test_receipts(spark, tmp_path):
    good = {"run_id": "r1", "timestamp_utc": "2026-01-02T03:04:05+00:00", "n_problems": 3, "wall_clock_seconds": 1.5}
    receipts.write_receipt(spark, str(tmp_path / "a.json"), "agreement", **good, pairs=[{"name": "a b", "kappa": 0.5, "low": 0.1, "high": 0.8, "agreement": 0.9}])
    receipts.write_receipt(spark, str(tmp_path / "b.json"), "replication", **good, seeds=[1, 2], metrics={"pass_at_1": 0.5}, n_samples=8)
    with pytest.raises(ValueError, match="seeds"):
        receipts.write_receipt(spark, str(tmp_path / "c.json"), "replication", **good, seeds=[1, 1], metrics={"pass_at_1": 0.5}, n_samples=8)
    with pytest.raises(ValueError, match="unknown kind"):
        receipts.write_receipt(spark, str(tmp_path / "d.json"), "dream", **good)
    (tmp_path / "e.json").write_text("no json")
    found = {r.path.rsplit("/", 1)[1]: r.faults for r in receipts.read_receipts(spark, str(tmp_path / "*.json")).collect()}
    assert found["a.json"] == found["b.json"] == [] and found["c.json"] == ["seeds"] and found["e.json"][0] == "kind"


def test_stages_and_verifiers(spark, tmp_path):
    run = sinks.RunRecord(str(tmp_path / "run"), "r")
    done = []
    assert sinks.run_stages(run, {"one": lambda: done.append(1), "two": lambda: 1 / 0, "three": lambda: done.append(3)}) == 1
    assert done == [1, 3] and run.body["status"] == "failed" and "two failed" in run.body["notes"][0] and "three_s" in run.body["metrics"]
    df = spark.createDataFrame([("#### 4", "4")], "t string, g string")
    assert [verify.verifier(n)(df, "t", "g").first().status for n in ("Math", "strict")] == ["correct", "correct"]
    with pytest.raises(ValueError):
        verify.verifier("magic")


def test_pairs_by_key(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"prompt": "a", "chosen": null, "rejected": "r"}\n{"problem": "b", "chosen": "c", "rejected": "r"}\n{"prompt": "c", "rejected": "r"}\nbroken\n\n')
    assert [(r.prompt, r.chosen) for r in readers.preference_pairs(spark, str(tmp_path / "p.jsonl")).orderBy("prompt").collect()] == [("a", None), ("b", "c")]


def test_bounded_stream(spark, tmp_path):
    spark.range(100).repartition(5).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = []
    assert pipelines.run_bounded(stream, lambda b, n: got.extend(r.id for r in b.collect()), str(tmp_path / "s1"), 30) == 30 and len(set(got)) == 30
    assert pipelines.run_bounded(stream, lambda b, n: None, str(tmp_path / "s2"), 1000) == 100


def test_beam_frame(spark):
    more = lambda p, t: F.when(t == "", F.array(F.lit("ab"), F.lit("abc"))).otherwise(F.array(F.lit("#### 1"), F.lit("x")))
    got = search.beam_frame(spark.createDataFrame([("p",)], "problem_id string"), more, 2, 5).first()
    assert (got.text, got.done) == ("ab#### 1", True) and got.score == pytest.approx(10 - 0.008)
    assert search.beam_frame(spark.createDataFrame([], "problem_id string"), more).count() == 0
