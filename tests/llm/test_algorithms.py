import random

import numpy as np
import pyarrow as pa

from tracemill.llm import p4_near as p4
from tracemill.llm import p6_cap as p6
from tracemill.operators.components import component_labels
from tracemill.llm.p3_splits import chunks_of, cross_split_overlaps, numbers_of
from tracemill.llm.p5_consensus import Consensus, usable_votes
from tracemill.llm.p6_cap import latest_scores, over_cap


def _groups(sets: dict[int, set]) -> dict[int, int]:
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) > p4.LIKENESS * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    size = {}
    for i in sets:
        size[root(i)] = size.get(root(i), 0) + 1
    return {i: root(i) for i in sets if size[root(i)] > 1}


def test_near_groups_against_brute_force(spark):
    random.seed(11)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(25):
        base = random.sample(words, 60)
        for _ in range(random.randrange(1, 5)):
            text = list(base)
            for _ in range(random.randrange(4)):
                text[random.randrange(60)] = random.choice(words)
            random.shuffle(text)
            rows.append((len(rows), " ".join(text), "x", 1))
    rows += [(len(rows) + k, t, "x", 1) for k, t in enumerate(["Same words, twice!", "twice same WORDS", None, "", "...", "same"])]
    rows += [rows[3], (None, rows[0][1], "x", 1)]
    df = spark.createDataFrame(rows, "path_id long, reasoning string, id string, text int")
    expected = _groups({i: p4.word_set(t or "") for i, t, *_ in rows if i is not None})
    assert {r.path_id: r.group for r in p4.near_groups(df).collect()} == expected
    assert p4.near_groups(df.limit(0)).count() == 0


def _rows_batch(rows, names):
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.asarray(rows, np.int64).T], names)


def test_stars_over_batches():
    rng = np.random.default_rng(1)
    sizes = [1, 1, 5, 1, 300, 2, 1, 1]
    keys = np.repeat(np.arange(len(sizes)), sizes)
    sketch = np.stack([keys * 12345, keys * 777], 1)
    sketch[:, 0] ^= 1 << rng.integers(0, 40, len(keys))
    rows = np.column_stack([keys, np.arange(len(keys)), sketch, np.full(len(keys), 60)])
    for cuts in ([], [1], [2, 3, 4], [7, 8, 9, 200], list(range(len(rows)))):
        parts = np.split(rows, cuts)
        got = [dict(zip(b.schema.names, r)) for b in p4.stars(iter(_rows_batch(p, ["key", "id", "s0", "s1", "n"]) for p in parts if len(p)), 0.85) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert [(g["key"], g["id"]) for g in got] == [(k, i) for i, k in enumerate(keys) if sizes[k] > 1 or k in (0, len(sizes) - 1)]
        assert all(g["center"] == np.flatnonzero(keys == g["key"])[0] and g["star"] == (g["id"] != g["center"]) for g in got)


def test_crowded_bucket_keeps_satellites(spark):
    random.seed(3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(150):
        copy = list(base)
        copy[random.randrange(100)] = f"c{k}"
        far = list(copy)
        for n, at in enumerate(random.sample(range(100), 7)):
            far[at] = f"s{k}x{n}"
        rows += [(len(rows), " ".join(copy)), (len(rows) + 1, " ".join(far))]
    expected = _groups({i: p4.word_set(t) for i, t in rows})
    got = {r.path_id: r.group for r in p4.near_groups(spark.createDataFrame(rows, "path_id long, reasoning string")).collect()}
    assert len(expected) == 300 and got == expected


def test_crowd_of_chains(spark, monkeypatch):
    monkeypatch.setattr(p4, "BLOCK", 50)
    random.seed(8)
    base, rows = [f"w{k}" for k in range(40)], []
    for k in range(400):
        text = list(base)
        for n, at in enumerate(random.sample(range(40), 1 if k < 300 else random.choice([2, 3]))):
            text[at] = f"e{k}x{n}"
        rows.append((k, " ".join(text)))
    got = {r.path_id: r.group for r in p4.near_groups(spark.createDataFrame(rows, "path_id long, reasoning string")).collect()}
    assert got == _groups({i: p4.word_set(t) for i, t in rows}) and len(got) == 400


def test_blocks_meet_each_other(spark, monkeypatch):
    rng = np.random.default_rng(6)
    sketches = rng.integers(-(1 << 62), 1 << 62, (100, 2))
    rows = [(7, 0 if k in (3, 103) else k, k, *map(int, s), 50, 5000) for k, s in enumerate(np.concatenate([sketches, sketches]))] + [(8, 1000, 1000 + k, 5, 5, 50, 1000) for k in range(70)]
    rows = [(1, 1, 1, 1, 1, 50, 1)] + sorted(rows) + [(9 + k, 2000 + k, 2000 + k, 1, 1, 50, 2000 + k) for k in range(20)]
    expected = sorted((k, 100 + k) for k in range(100) if k != 3)
    names = list(p4.FIELDS)
    for block, together, cuts in ((40, 60, [30, 100, 210]), (4096, 50_000, [30]), (7, 1, list(range(1, len(rows)))), (300, 10, [100])):
        monkeypatch.setattr(p4, "BLOCK", block)
        monkeypatch.setattr(p4, "TOGETHER", together)
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        out = pa.Table.from_batches(list(p4.blocked(iter(_rows_batch(p, names) for p in parts), 0.85, 3))).to_pylist()
        pairs = {(r["a"], r["b"]) for r in out if r["a"] is not None}
        left = spark.createDataFrame([tuple(r[c] for c in ("block", *names)) for r in out if r["a"] is None], "block long, " + ", ".join(f"{c} long" for c in names))
        more = {(r.a, r.b) for r in p4.pairs_across(left, 0.85).collect()}
        assert sorted(pairs | more) == expected and not pairs & more


def test_pruning_keeps_like_pairs():
    rng = np.random.default_rng(2)
    n = 4000
    x = rng.integers(-(1 << 62), 1 << 62, (n, 2))
    differ = rng.random((n, 128)) < (1 - 0.9) / 2
    y = x ^ np.packbits(differ, axis=1).view(np.int64)
    assert p4.may_be_alike(x, y, 0.85, p4.MISS).mean() > 0.998
    assert p4.may_be_alike(x, np.roll(x, 1, 0), 0.85, p4.MISS).mean() < 0.001


def test_component_labels(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cross_split_overlaps(spark):
    base = "A baker sells 1,204 fresh rolls and 7 brown loaves to the old miller on market day before lunch"
    rows = [
        ("t1", base, "Train"), ("e1", base.replace("1,204", "1204").upper(), " test"), ("e2", base.replace("7", "8"), "test"), ("e3", base.replace("fresh ", ""), "val"),
        ("s1", base, "synthetic"), ("n1", base, None), (None, base, "test"), ("e4", None, "test"), ("t2", "", "train"), ("e5", "", "test"), ("e6", "12", "test"), ("t3", "12", "train"), ("t1", base, "test"), ("e1", base, "test"),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "id string, text string, split string, side int")
    found = {(r.train_id, r.eval_id): r for r in cross_split_overlaps(df).collect()}
    assert set(found) == {("t1", "e1"), ("t1", "e3")}
    assert found["t1", "e1"].likeness == 1 and found["t1", "e1"].chunk_overlap == 1
    assert cross_split_overlaps(df.limit(0)).count() == 0


def test_chunks_survive_an_edit():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    letters = rng.integers(1, 9, 60)
    a, sizes, starts = chunks_of(words, letters)
    assert sizes.sum() == letters.sum() and starts[0] == 0
    b = chunks_of(np.insert(words, 20, 5), np.insert(letters, 20, 3))[0]
    assert len(set(a) & set(b)) >= len(a) - 3
    assert numbers_of("1,204 and 3.5, 7") == ["1204", "3.5", "7"]


def test_shuffled_words_overlap(spark):
    random.seed(4)
    common, rows, expected = [f"{a}{b}" for a in "abcdefg" for b in "klmno"], [], set()
    for k in range(200):
        words = random.sample(common, 8) + [f"rare{chr(97 + k % 26)}{chr(97 + k // 26)}", "the", "of"]
        other = random.sample(words, len(words))
        if k % 4 == 1:
            other[0] = "else"
        rows += [(f"t{k}", " ".join(words) + (" 17" if k < 100 else ""), "train"), (f"e{k}", " ".join(other) + (" 17" if k < 100 else ""), "test")]
    sets = {i: (frozenset(t.replace(" 17", "").split()), "17" in t) for i, t, _ in rows}
    for x in sets:
        for y in sets:
            if x[0] == "t" and y[0] == "e" and sets[x][1] == sets[y][1] and len(sets[x][0] & sets[y][0]) > 0.8 * len(sets[x][0] | sets[y][0]):
                expected.add((x, y))
    got = {(r.train_id, r.eval_id): r.chunk_overlap for r in cross_split_overlaps(spark.createDataFrame(rows, "id string, text string, split string")).collect()}
    assert set(got) == expected and len(expected) >= 200
    assert all(got[f"t{k}", f"e{k}"] == 1 for k in range(200) if k % 4 != 1)


def test_consensus_learns_bad_judges(spark):
    rng = np.random.default_rng(4)
    skill = {"good": (0.95, 0.95), "fair": (0.8, 0.8), "soft": (0.97, 0.3), "liar": (0.1, 0.1), "meek": (0.6, 0.9)}
    truth = rng.random(600) < 0.55
    rows = [(i, j, "ACCEPT" if (rng.random() < (a if t else 1 - r)) else "REJECT", float(i), None) for i, t in enumerate(truth) for j, (a, r) in skill.items()]
    rows += [(0, "good", "maybe", 9e9, None), (1, None, "ACCEPT", 1.0, None), (None, "good", "ACCEPT", 1.0, None), (2, " ", "ACCEPT", 1.0, None), (3, "Good ", "**accept**" if truth[3] else "reject!", 9e9, None), (900, "good", "ACCEPT", 1.0, None)]
    df = spark.createDataFrame(rows, "path_id long, judge_id string, verdict string, judged_at double, item string")
    fitted = Consensus(usable_votes(df)).fit()
    got = {r.item: r.verdict == "ACCEPT" for r in fitted.verdicts().collect()}
    assert set(got) == set(range(600))
    assert np.mean([got[i] == t for i, t in enumerate(truth)]) > 0.95
    rel = {r.judge: r for r in fitted.reliability().collect()}
    assert rel["liar"].right_on_accept < 0.3 and rel["soft"].right_on_reject < 0.5 < rel["good"].right_on_reject
    assert Consensus(usable_votes(df.limit(0))).fit().verdicts().count() == 0


def test_over_cap_against_brute_force(spark, monkeypatch):
    random.seed(9)
    rows = []
    for who, n in (("a", 50), ("b", 8), ("c", 9), ("d", 200), ("e", 12), (None, 20)):
        for _ in range(n):
            score = random.choice([None, float("nan"), 0.5, 0.5, 0.25, random.random(), -1.0, float("inf"), -0.0, 0.0]) if who != "e" else None
            rows.append((f"id{len(rows):04}", who, score, 1))
    rows += rows[:30] + [(None, "a", 9.0, 1)]
    expected = set()
    for who in "abcde":
        mine = sorted({(i, s if s is not None and s == s else float("-inf")) for i, w, s, _ in rows if w == who and i is not None}, key=lambda r: (-r[1], r[0]))
        expected |= {i for i, _ in mine[8:]}
    df = spark.createDataFrame(rows, "id string, who string, score double, salt int")
    for part in (p6.PART, 7):
        monkeypatch.setattr(p6, "PART", part)
        got = [r.id for r in over_cap(df).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert over_cap(df.limit(0)).count() == 0
    scores = spark.createDataFrame([("p", 1, 0.9), ("p", 2, None), ("q", 1, 0.1), ("q", 2, 0.2), ("q", None, 0.9)], "pair_id string, scored_at int, diversity_score double")
    assert {r.id: r.score for r in latest_scores(scores).collect()} == {"p": None, "q": 0.2}
