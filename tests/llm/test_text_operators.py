import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import p2_answers as p2
from tracemill.llm import p7_tokens as p7
from tracemill.llm.p1_cut import cut_fields
from tracemill.llm import p8_leakage as p8
from tracemill.llm.p8_leakage import leaked_passages, without_leaks
from tracemill.llm.p9_visual import look_alike_pairs
from tracemill.llm.visual_form import visual_form

PATHS = "path_id long, reasoning string, final_answer string, id string, text string, w1 string"


def test_cut_fields(spark):
    whole = "We add the two bags. The pile grows by 3 and we reach 8. So the final count is 8 figs."
    rows = [(k, whole, "8", "x", None, "clash") for k in range(40)]
    rows += [
        (100, "We add the two bags. The pile grows by", None, "x", None, None),
        (100, "We add the two bags. The pile grows by", None, "x", None, None),
        (101, "We add the two bags. The pi", "", "x", None, None),
        (102, "We add the two bags. The pile grows by 3 and [truncated]", None, "x", None, None),
        (103, whole + " Ann ends up with 8 red figs.", "Ann ends up with 8 r", "x", None, None),
        (104, whole + " Ann ends up with 8 red figs.", "Ann ends up with 8 red figs", "x", None, None),
        (105, None, None, None, None, None),
        (106, "", " ", None, None, None),
        (107, "  \n ", "...", None, None, None),
        (None, "We add the two", None, None, None, None),
        (108, whole + " pad" * 60_000 + " end.", "8", None, None, None),
        (109, "We add the two bags. So the final count is 8 kumquats", None, None, None, None),
        (110, "We add the two bags. So the final count is 8 fi", None, None, None, None),
        (111, "We add the two bags. So we count" + " one fig and" * 60 + " reach 8 figs.", "So we count" + " one fig and" * 50, None, None, None),
        (112, "We add the two bags. The pile grows by 3 \\u00", None, None, None, None),
    ]
    got = {tuple(r) for r in cut_fields(spark.createDataFrame(rows, PATHS)).collect()}
    assert got == {(100, "reasoning"), (101, "reasoning"), (102, "reasoning"), (103, "final_answer"), (110, "reasoning"), (111, "final_answer"), (112, "reasoning")}
    assert cut_fields(spark.createDataFrame([], PATHS)).count() == 0


def test_cuts_that_many_rows_share(spark):
    whole = "We add the two bags. The pile grows by 3 and we reach 8. So the final count is 8 figs."
    rows = [(k, whole, None) for k in range(90)]
    rows += [(100 + k, "We add the two bags. The pile grows by", None) for k in range(9)]
    rows += [(200 + k, f"Ann has {k} bags. We add the two bags. The pile grows by 3 and we", None) for k in range(9)]
    rows += [(300 + k, f"Ann has {k} bags and 3 boxes.\nGrand total: 8 figs", None) for k in range(9)]
    got = {r.path_id for r in cut_fields(spark.createDataFrame(rows, "path_id long, reasoning string, final_answer string")).collect()}
    assert got == {i for i, *_ in rows if 100 <= i < 300}


PROMPT = "There are 12 figs in the shed of Ann and the cook takes 5 of them. How many figs are left with Ann?"


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        (None, "empty"), ("", "empty"), (" ​ ", "empty"), ("<|endoftext|>", "empty"), ("N/A", "empty"), ("\\boxed{}", "empty"), ("[no response]", "empty"),
        ("I'm sorry, but I can't help with this request.", "refusal"), ("I’m sorry; I have no permission to do this.", "refusal"),
        ("I'd prefer to not do this one.", "refusal"), ("Unfortunately I must pass on this question.", "refusal"), ("This request falls outside what I do.", "refusal"), ("Sorry, no.", "refusal"),
        ("Tut mir leid, dabei kann ich nicht helfen.", "refusal"), ("很抱歉，我无法回答这个问题。", "refusal"), ("We can't take 5 figs twice, so we subtract once: 12 - 5 = 7.\n#### 7", None),
        ("I can't simply add them. So 12 - 5 = 7.\n#### 7", None), ("I'm sorry for the mix-up; here it is. The answer is 7.", None),
        ("Question: " + PROMPT, "copy"), (PROMPT.upper() + " " + PROMPT, "copy"), (PROMPT + "\nWe take five away from twelve, and seven of the round figs stay in there.\n#### 7", None),
        ("We take 5 of the 12 figs away and the", "truncated"), ("We have <<12-5=7", "truncated"), ("We take them. This makes 12 - 5 = 7", "truncated"), ("Then we see tha...", "truncated"),
        ("The answer is 7", None), ("7", None), ("Answer: 7 figs. ####", None), ("```\nresult = 7\nprint(result)\n```", None),
        ("Zuerst ziehen wir die fünf von den zwölf ab und das ist dann auch die Antwort.", "language"),
    ],
)
def test_defects(answer, expected):
    assert p2.defect(p2.Prompt(PROMPT), answer) == expected


def test_broken_sides(spark):
    rows = [("a", PROMPT, "", "7", 1), ("a", PROMPT, "", "7", 1), ("b", None, "The answer is 7.", None, 2), (None, PROMPT, "", "", 3), ("c", PROMPT, "word " * 200_000 + "end.", "7", 4)]
    df = spark.createDataFrame(rows, "pair_id string, prompt string, chosen string, rejected string, side int")
    disguised = PROMPT.replace("a", "\u0430")
    twice = spark.createDataFrame([("d", disguised, PROMPT, disguised)], "pair_id string, prompt string, chosen string, rejected string")
    assert {tuple(r) for r in p2.broken_sides(twice).collect()} == {("d", "chosen", "copy"), ("d", "rejected", "copy")}
    assert {tuple(r) for r in p2.broken_sides(df).collect()} == {("a", "chosen", "empty"), ("b", "rejected", "empty")}
    assert p2.broken_sides(df.limit(0)).count() == 0


def test_suffix_automaton_against_brute_force():
    random.seed(5)
    for _ in range(300):
        a, b = ([random.choice("abc") for _ in range(random.randrange(1, 25))] for _ in range(2))
        hit = set()
        for k in range(len(b) - 2):
            if any(a[i : i + 3] == b[k : k + 3] for i in range(len(a) - 2)):
                hit |= {k, k + 1, k + 2}
        assert p2.SuffixAutomaton(a).covered(b, 3) == len(hit)


def test_tokens_against_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    ranks = p7.read_ranks(p7.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(7)
    texts = ["".join(random.choice("aab bé'sll12１²\t\n\r\u0085  \x1c.!-_<|endoftext|>\U0001f642‍漢字") for _ in range(random.randrange(80))) for _ in range(400)]
    texts += ["x" * 5000, "ab" * 3000, " " * 300, "<|endoftext|>"]
    code = p7.encoder(p7.VOCABULARY)
    assert [code.encode(t) for t in texts] == [own.encode_ordinary(t) for t in texts]
    for n in (1, 2, 50, 127, 400):
        word = "".join(random.choice("etaoin") for _ in range(n)).encode()
        assert p7.merge_short(word, ranks) == p7.merge_long(word, ranks)
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b", 9)], "doc_id long, text string, ids int").select("doc_id", p7.token_ids("text").alias("out"))
    assert {r[0]: r[1] for r in df.collect()} == {1: [], 2: [], 3: own.encode_ordinary("a b")}


def test_visual_form():
    same = [("Ａｂｃ１", "Abc1"), ("é", "é"), ("ﬁsh", "fish"), ("pаy​", "pay"), ("a b c", "a b c"), ("q̣̇", "q̣̇"), ("ṩ", "ṩ"), ("АΤ", "AT"), ("ё", "ë")]
    for a, b in same:
        assert visual_form(pa.array([a])) == visual_form(pa.array([b])), (a, b)
    for a, b in (("A", "a"), ("e", "é"), ("2", "²"), ("a b", "a\nb"), ("1", "2"), ("\U0001f468‍\U0001f469", "\U0001f468\U0001f469")):
        assert visual_form(pa.array([a])) != visual_form(pa.array([b])), (a, b)
    assert visual_form(pa.array([None, "", "x"])).to_pylist() == [None, "", "x"]
    assert visual_form(pa.array([], pa.string())).to_pylist() == []
    assert visual_form(pa.array(["́x", "́"])).to_pylist() == ["́x", "́"]
    random.seed(2)
    chars = [chr(c) for c in range(0xC0, 0x250)] + ["a", "́", "̈", "̣"]
    texts = ["".join(random.choice(chars) for _ in range(20)) for _ in range(300)]
    forms = visual_form(pa.array(texts)).to_pylist()
    assert visual_form(pa.array([unicodedata.normalize("NFD", t) for t in texts])).to_pylist() == forms
    assert visual_form(pa.array(forms)).to_pylist() == forms


def test_visual_form_of_all_characters():
    chars = [chr(c) for c in range(0x21, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co", "Cc") and not 0x4E00 <= c < 0x9FFF]
    texts = [f"x{c}" for c in chars]
    form = lambda kind: visual_form(pa.array([unicodedata.normalize(kind, t) for t in texts])).to_pylist()
    forms = visual_form(pa.array(texts)).to_pylist()
    for kind in ("NFC", "NFD"):
        assert [(c, a, b) for c, a, b in zip(chars, forms, form(kind)) if a != b] == []
    assert [c for c, a, b in zip(chars, forms, visual_form(pa.array(forms)).to_pylist()) if a != b] == []
    for a, b in (("\ud55c\uad6d", unicodedata.normalize("NFD", "\ud55c\uad6d")), ("\U0001d400", "A"), ("\u0251\u0261", "ag"), ("\u03c1\u03b1y", "pay"), ("a\u2010b", "a-b"), ("a\U000e0041b", "ab"), ("\u13a2\u0578", "Tn"), ("\u1112\u1161\u11ab\u200b", "\ud55c")):
        assert visual_form(pa.array([a])) == visual_form(pa.array([b])), (a, b)
    england, black = "\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U0001f3f4"
    assert visual_form(pa.array([england, black])).to_pylist() == [england, black]
    # Letters of neighbouring texts don't join.
    assert visual_form(pa.array(["\u1112", "\u1161", "\ud558", "\u11ab"])).to_pylist() == ["\u1112", "\u1161", "\ud558", "\u11ab"]


def test_copies_of_one_text_stay_linear(spark):
    rows = spark.range(100_000).selectExpr("id AS doc_id", "IF(id = 7, 'p\u0430y', 'pay') AS text")
    got = look_alike_pairs(rows).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("doc_id_a = 7 or doc_id_b = 7")).alias("k")).first()
    assert (got.n, got.k) == (99_999, 99_999)


def test_look_alike_pairs(spark):
    rows = [(1, "abc", 0), (2, "аbc", 0), (3, "abc", 0), (4, None, 0), (5, "", 0), (6, "​", 0), (7, "abC", 0), (2, "аbc", 0), (None, "abc", 0)]
    got = {tuple(r) for r in look_alike_pairs(spark.createDataFrame(rows, "doc_id long, text string, _f int")).collect()}
    assert got == {(1, 2), (2, 3), (5, 6)}
    assert look_alike_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_leaked_passages_against_brute_force(spark, monkeypatch):
    random.seed(3)
    word = lambda: random.choice(["ab", "cd", "ef"])
    items = [(i, " ".join(word() for _ in range(random.randrange(3, 12)))) for i in range(8)] + [(90, None), (91, "")]
    docs = [(i, ", ".join(word().upper() for _ in range(random.randrange(30)))) for i in range(60)] + [(200, None), (201, ""), (None, "ab cd"), (202, "zz " * 50_000 + items[0][1])]
    least = 5
    expected = set()
    for d, t in docs:
        for i, u in items:
            a, b = (t or "").lower().replace(",", "").split(), (u or "").split()
            if d is not None and any(a[x : x + least] == b[y : y + least] for y in range(len(b) - least + 1) for x in range(len(a) - least + 1)):
                expected.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    held = spark.createDataFrame(items, "item_id long, item_text string")
    runs = leaked_passages(df, held, least)
    assert {(r.doc_id, r.item_id) for r in runs.collect()} == expected
    assert all(r.n_words >= least for r in runs.collect())
    monkeypatch.setattr(p8, "ITEMS", 60)
    assert len(list(p8.item_blocks(held.where("item_text is not null").selectExpr("item_id id", "item_text text"), 60))) > 2
    assert {tuple(r) for r in leaked_passages(df, held, least).collect()} == {tuple(r) for r in runs.collect()}
    assert leaked_passages(df.limit(0), held, least).count() == 0
    assert leaked_passages(df, held.limit(0), least).count() == 0
    assert without_leaks(df, held).count() == len(docs)
