"""Problem 2: prompt and response pairs whose response is no proper answer."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracemill.llm.visual_form import blocks, visual_form
from tracemill.runtime import dealt, table

#: Words of a copied run, and the part of a response that copied runs make up if it only gives the question back.
RUN, COPIED = 4, 0.8
#: Votes that name a language, and how many times those of the next.
VOTES, LEAD = 3, 1.5

#: Characters of prompts kept at hand.
KEPT = 4_000_000

# Responses that stand for nothing.
PLACEHOLDERS = frozenset("null none nil nan na n/a tbd todo undefined empty placeholder answer response assistant user system blank no_answer no_response no_content".split())
# How a response declines, as words; a slash parts words that may stand in one place.
REFUSALS = (
    "i/we can't/cannot/couldn't provide/help/assist/answer/solve/comply/complete/fulfill/fulfil/continue/discuss", "i can't/cannot do/share/give/offer",
    "i/we can not provide/help/assist/answer/solve/comply/complete/fulfill/fulfil/continue/discuss", "i/we won't/don't answer/solve/do/help/provide/comply/assist", "i/we will not answer/solve/do/help/provide/comply/assist", "i/we won't be able to", "i/we will not be able to", "i/we am/are unable to", "i'm/we're unable to", "i/we am/are not able to", "i'm/we're not able to", "i'm/we're not going to", "i/we am/are not going to",
    "i/we must/have/need/will/would to/like decline/refuse/pass", "i/we must/will/would decline/refuse/pass", "i/we have/need/want/prefer/like to decline/refuse/pass", "i'll have to decline/refuse/pass", "i'd have to decline/refuse/pass", "i'd like to decline/pass", "i'll decline/refuse/pass", "i decline/refuse to", "i/we do/don't not feel comfortable", "i/we don't feel comfortable", "i/we am/are not comfortable", "i'm/we're not comfortable",
    "i'd/i'll/we'd rather not", "i/we would rather not", "i'd prefer not", "i'd prefer to not", "i/we would prefer not", "i/we would prefer to not", "i/we prefer not", "pass on this/that/your/answering", "what i am/i'm allowed to", "what i'm/i/we allowed/can/do/may", "i am not allowed to", "i'm not allowed to", "i have no permission", "not possible for me to", "guidelines keep/prevent/stop/forbid me", "guidelines keep me from", "guidelines do not allow", "guidelines don't allow",
    "as a language model", "as an ai", "against my/our guidelines/policy/policies/rules", "something i can't/cannot/won't", "not something i/we", "outside/beyond of/what/my/our i/we/what/scope/abilities", "outside/beyond my/our scope/abilities/capabilities", "outside/beyond the scope", "outside/beyond what i/we", "sorry no", "no comment",
    "ich kann/darf/werde das/dies/dir/ihnen/diese/dabei/hier/darauf/leider nicht", "kann/darf/werde ich nicht/leider", "kann/darf/werde ich das/dir/ihnen/dabei/hier/leider nicht", "das kann ich nicht", "tut mir leid", "je ne peux/puis/veux pas", "je refuse de", "je suis désolé", "je suis désolée", "no puedo ayudar/ayudarte/ayudarle/responder/resolver/hacer/contestar", "lo siento", "non posso aiutare/aiutarti/aiutarla/rispondere/risolvere/fare", "mi dispiace",
    "nie mogę pomóc/odpowiedzieć/tego/rozwiązać/na", "przykro mi", "я не могу", "не могу помочь/ответить/решить", "к сожалению я",
)
# Refusals in a script without blanks.
SPACELESS = re.compile("(?:我|很抱歉|抱歉|对不起)[^。！？\n]{0,12}(?:不能|无法|不会|拒绝)")
# Frequent words of each language.
STOPWORDS = {
    "en": "the of and to is are was were that this with for from not have has had how many then which there what they them by at be you i we it after before all each so",
    "de": "der die das und ist nicht mit für von auf ein eine einen dem den wir sich auch noch wie viele dann diese dieser wird sind hat im zum zur nach aus bei also aber",
    "fr": "le la les des et est une un dans pour que qui avec sur il elle nous pas du au ce cette combien sont il en ensuite par ont plus donc reste ainsi ne",
    "es": "el la los las y es un una en para que con por del al se no hemos lo su más cuántos cuántas después entonces como son luego así esta este ya sobre",
    "it": "il lo la gli le e è un una di che per con del della dei al si non quanti quante dopo poi come sono questa questo nel alla quindi anche ha dal",
    "pl": "i w na z że się nie do jest to jak po co od za dla ale ile oraz następnie potem więc tego tym przez sztuk został czyli jeszcze można już przy",
}
MARK = re.compile(r"(?:…|\.\.\.|\[\.\.\.\]|\[(?:truncated|cut|cut off)\]|�|<\|?|<\|[a-z_]+\|?|\\u?[0-9a-fA-F]{0,3}|\\u[0-9a-fA-F]{4})\s*$")
MARKUP = re.compile(r"<\|[^|<>]*\|>|</?[a-zA-Z][^<>]*>|\\[a-zA-Z]+|\[/?INST\]|(?m:^\s*(?:assistant|user|system|answer|response|ai)\s*:)", re.IGNORECASE)
TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\W_]+")
HAN = re.compile("[一-鿿]")
WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
LETTERS, NEAR = re.compile(r"[^\W\d_]+"), 200
SENTENCE_END = re.compile(r"[.!?。！？][\"”’)\]]*$")
NUMBERS = re.compile(r"\d+(?:[.,]\d+)*")
VALUE = r"\\?\$?-?\d[\d.,/]*%?"
SOLVED = re.compile(r"####\s*\S*\d|\\boxed|=\s*-?\$?\d")
WHOLE_END = re.compile(
    rf"(?:####\s*{VALUE}|\\boxed\{{[^{{}}]*\}}\$?|\$?{VALUE}\s*\\text\{{[^{{}}]*\}}\$?|```|(?i:\banswer:\s[^\n]{{1,80}}####)|(?i:\b(?:answer|total|result|count|value|sum)\b)\W*(?:(?i:is)\W+|=\s*|:\s*)?{VALUE}\$?|(?:^|\n)\W*{VALUE}\W*(?:\s\w+)?)$"
)


class SuffixAutomaton:
    """All runs of words of one prompt, in states and transitions linear in its length."""

    def __init__(self, words: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            state = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[state] = q
                else:
                    twin = len(self.next)
                    self.next.append(self.next[q].copy())
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[state] = twin
            last = state

    def covered(self, words: list[str], least: int) -> int:
        """Words of a response that lie in runs of at least least words of the prompt."""
        state = size = done = total = 0
        for at, w in enumerate(words, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            if size >= least:
                total += at - max(done, at - size)
                done = at
        return total


class PhraseAutomaton:
    """Aho-Corasick over words: whether any phrase stands in a text."""

    def __init__(self, phrases: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.hit = [False]
        for words in (ws for phrase in phrases for ws in product(*(p.split("/") for p in phrase.split()))):
            state = 0
            for w in words:
                if w not in self.next[state]:
                    self.next[state][w] = len(self.next)
                    self.next.append({})
                    self.hit.append(False)
                state = self.next[state][w]
            self.hit[state] = True
        self.begins = frozenset(self.next[0])
        self.fail = [0] * len(self.next)
        queue = list(self.next[0].values())
        for s in queue:
            for w, t in self.next[s].items():
                f = self.fail[s]
                while f and w not in self.next[f]:
                    f = self.fail[f]
                self.fail[t] = self.next[f].get(w, 0)
                self.hit[t] |= self.hit[self.fail[t]]
                queue.append(t)

    def found(self, words: list[str]) -> bool:
        if self.begins.isdisjoint(words):
            return False
        state = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(w, 0)
            if self.hit[state]:
                return True
        return False


REFUSAL = PhraseAutomaton(REFUSALS)
#: The languages that a word votes for.
VOTES_OF = {w: tuple(k for k, v in STOPWORDS.items() if w in v.split()) for v in STOPWORDS.values() for w in v.split()}


def language(text: str, words: list[str] | None = None) -> str | None:
    """The language most words vote for; Cyrillic and Han letters vote by themselves. words are those of the text, if known."""
    if words is None:
        words = words_of(text)
    votes = dict.fromkeys(STOPWORDS, 0)
    for spoken in [VOTES_OF[w] for w in words if w in VOTES_OF]:
        for k in spoken:
            votes[k] += 1
    if not text.isascii():
        votes["ru"] = sum("Ѐ" <= w[0] <= "ӿ" for w in words)
        votes["zh"] = len(HAN.findall(text)) // 2
    (best, most), (_, second) = sorted(votes.items(), key=lambda x: -x[1])[:2]
    return best if most >= VOTES and most >= LEAD * second else None


def words_of(text: str) -> list[str]:
    """Lower-cased words, with one kind of apostrophe inside."""
    return WORDS.findall(text.lower().replace("’", "'"))


def is_empty(text: str, words: list[str] | None = None) -> bool:
    """Nothing visible, or only placeholders and markup."""
    bare, marks = MARKUP.subn(" ", text)
    if marks or words is None:
        words = words_of(bare)
    return not words or words == ["n", "a"] or (len(words) <= 2 and "_".join(words) in PLACEHOLDERS) or (len(words) == 1 and words[0] in PLACEHOLDERS)


def open_delimiters(text: str) -> bool:
    """Whether a bracket, fence or formula is still open at the end, by a stack; stray closing ones are passed over."""
    stack: list[str] = []
    closes = {">>": "<<", "}": "{", "”": "“"}
    for m in re.finditer(r"```|<<|>>|[{}$“”]", text):
        d = m[0]
        if d in ("```", "$"):
            if stack and stack[-1] == d:
                stack.pop()
            elif d == "$" and not re.match(r"\$\S[^$\n]*\$", text[m.start() :]) and re.match(r"\$\s?\d[\d,.]*(?:\W|$)", text[m.start() :]) and not re.match(r"\$\s?\d[\d,.]*\s*(?:[-+*/=\\]|$)", text[m.start() :]):
                continue  # an amount of money
            else:
                stack.append(d)
        elif d in closes:
            if stack and stack[-1] == closes[d]:
                stack.pop()
        else:
            stack.append(d)
    return bool(stack) and stack[-1] != "“" or "“" in stack[-1:] and not SENTENCE_END.search(text)


def whole_end(body: str) -> bool:
    """Whether a text ends with one of the forms of WHOLE_END.

    But for what stands in braces, such an end holds three words of letters at
    most; if the last letters of the text hold more, it begins among them.
    """
    if body[-1:] not in ("}", "$") and len(LETTERS.findall(body, max(0, len(body) - NEAR))) > 4:
        return WHOLE_END.search(body, max(0, len(body) - NEAR)) is not None
    return WHOLE_END.search(body) is not None


def is_truncated(text: str) -> bool:
    """Stops inside a word, expression or statement, or carries a mark of the cut."""
    body = text.rstrip()
    if MARK.search(body) or open_delimiters(body):
        return True
    line = body[body.rfind("\n") + 1 :]
    if re.fullmatch(r"\s*(?:\d+\.|(?i:step) \d+:?|[-*•])\s*", line):
        return True
    if SENTENCE_END.search(body):
        return False
    if line.endswith("####"):
        return not re.search(r"(?i)answer: [^\n]{1,80}####$", line)
    if re.search(r"\d \W \d[\d.,]* = [\d.,]*$", line):
        return True
    return not whole_end(body)


class Prompt:
    """What answers are held against; each part is made when it is first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def tokens(self) -> list[str]:
        return TOKEN.findall(self.text.lower())

    @cached_property
    def known(self) -> frozenset[str]:
        return frozenset(self.tokens)

    @cached_property
    def automaton(self) -> SuffixAutomaton:
        return SuffixAutomaton(self.tokens)

    @cached_property
    def numbers(self) -> frozenset[str]:
        return frozenset(NUMBERS.findall(self.text))

    @cached_property
    def language(self) -> str | None:
        return language(max(re.split(r"\n\s*\n", self.text), key=len))

    def copied(self, answer: list[str]) -> bool:
        """Whether copied runs make up nearly all of an answer; the automaton is only asked if enough of its words are the prompt's."""
        if len(answer) < RUN or sum(map(self.known.__contains__, answer)) < COPIED * len(answer):
            return False
        return self.automaton.covered(answer, RUN) >= COPIED * len(answer)


class Prompts(dict[str, Prompt]):
    """The prompts met last, up to KEPT characters of them."""

    size = 0

    def __missing__(self, text: str) -> Prompt:
        if self.size > KEPT:
            self.clear()
            self.size = 0
        self.size += len(text)
        self[text] = made = Prompt(text)
        return made


def defect(prompt: Prompt, answer: str | None) -> str | None:
    """The defect of a response, or None: the first of empty, refusal, copy, truncated and language that applies.

    A null response is empty. Without a prompt a response can't be a copy or in another language.
    """
    words = words_of(answer or "")
    if answer is None or is_empty(answer, words):
        return "empty"
    if REFUSAL.found(words) or SPACELESS.search(answer):
        if not SOLVED.search(answer) and prompt.numbers.issuperset(NUMBERS.findall(answer)):
            return "refusal"
    if prompt.copied(words if answer.isascii() and "'" not in answer else TOKEN.findall(answer.lower())):
        return "copy"
    if is_truncated(answer):
        return "truncated"
    if prompt.language and (given := language(answer, words)) and given != prompt.language:
        return "language"
    return None


def defect_of(prompt: Column | str, answer: Column | str) -> Column:
    """The defect of a response column to a prompt column, null if there is none."""

    @arrow_udf("string")
    def judge(prompts: pa.Array, answers: pa.Array) -> pa.Array:
        known = Prompts()
        out: list[str | None] = []
        for at, part in blocks(answers):
            asked = visual_form(prompts.slice(at, len(part))).to_pylist()
            out += [defect(known[p or ""], a) for p, a in zip(asked, visual_form(part).to_pylist())]
        return pa.array(out, pa.string())

    return judge(prompt, answer)


def broken_sides(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, defect) of the broken sides of pairs with pair_id, prompt, chosen and rejected.

    Rows with one pair_id are one record; a null pair_id is left out. Extra
    columns are ignored; an empty table gives no rows.
    """
    src = pairs.where("pair_id is not null").select("pair_id", "prompt", "chosen", "rejected")
    judged = src.select("pair_id", defect_of("prompt", "chosen").alias("chosen"), defect_of("prompt", "rejected").alias("rejected"))
    sides = judged.select("pair_id", F.expr("inline(array(struct('chosen' AS side, chosen AS defect), struct('rejected' AS side, rejected AS defect)))"))
    return sides.where("defect is not null").groupBy("pair_id", "side").agg(F.min("defect").alias("defect"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "dpo_pairs_v1").select(F.col("provenance.pair_id").alias("pair_id"), "pair.prompt", "pair.chosen", "pair.rejected"), sf_dir, "dpo_pairs_v1")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_sides(_pairs(spark, sf_dir))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sides have each defect."""
    return p2_found(spark, sf_dir).groupBy("side", "defect").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}
SQL: dict[str, str] = {}
