"""Places where models and sandboxes plug in; nothing here runs generated code."""

from __future__ import annotations

import re
import time
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Generate = Callable[[str, int], list[str]]
Verify = Callable[[str, str], bool | None]


def generate(problems: DataFrame, fn: Generate, n: int) -> DataFrame:
    """(problem_id, problem, k, reasoning, error): n outputs of fn for each problem; an exception becomes the error of one row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for pid, text in zip(frame["problem_id"], frame["problem"]):
                try:
                    rows += [(pid, text, k, out, None) for k, out in enumerate(fn(text, n))]
                except Exception as e:
                    rows.append((pid, text, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["problem_id", "problem", "k", "reasoning", "error"])

    return problems.select("problem_id", "problem").mapInPandas(run, "problem_id string, problem string, k int, reasoning string, error string")


def verify(rows: DataFrame, fn: Verify, answer: str = "answer", gold: str = "gold") -> DataFrame:
    """rows with is_correct, error and seconds; an exception is an incorrect answer with its error."""
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",is_correct:boolean,error:string,seconds:double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for a, g in zip(frame[answer], frame[gold]):
                began = time.perf_counter()
                try:
                    out.append((fn(a, g), None, time.perf_counter() - began))
                except Exception as e:
                    out.append((False, f"{type(e).__name__}: {e}", time.perf_counter() - began))
            yield frame.assign(is_correct=pd.Series([o[0] for o in out], index=frame.index, dtype="boolean"), error=[o[1] for o in out], seconds=[o[2] for o in out])

    return rows.mapInPandas(run, schema)


def failure_class(stderr: Column) -> Column:
    """compile_error or fail, with its reward."""
    bad = F.lower(stderr).rlike("syntaxerror|indentationerror|taberror")
    return F.struct(F.when(bad, "compile_error").otherwise("fail").alias("status"), F.when(bad, -0.1).otherwise(0.0).alias("reward"))


def clean_code(code: str) -> str:
    """Out of a fence, and cut at the second top-level def."""
    fenced = re.search(r"```(?:python)?\s*\n(.*?)```", code, re.DOTALL)
    lines = (fenced[1] if fenced else code).split("\n")
    tops = [k for k, line in enumerate(lines) if line.startswith("def ")]
    return "\n".join(lines[: tops[1]] if len(tops) > 1 else lines).rstrip()


def program(code: Column, tests: Column) -> Column:
    """Code and test lines as one program text."""
    return F.concat_ws("\n\n", code, F.array_join(tests, "\n"))


class PrefixCache:
    """Longest stored prefix of token lists, with least-recent or least-frequent eviction above a number of tokens."""

    def __init__(self, room: int, policy: str = "lru") -> None:
        self.room, self.policy = room, policy
        self.held: OrderedDict[tuple[int, ...], int] = OrderedDict()
        self.marks: Counter[tuple[int, int]] = Counter()
        self.used = self.hits = self.misses = self.evicted = 0

    @staticmethod
    def _marks(tokens: Iterable[int]) -> Iterator[tuple[int, int]]:
        """Length and rolling hash of every prefix; equal marks are checked by the tokens."""
        h = 0
        for n, token in enumerate(tokens, 1):
            h = (h * 1_000_003 + token + 1) % 2_305_843_009_213_693_951
            yield n, h

    def get(self, tokens: list[int]) -> int:
        for mark in reversed(list(self._marks(tokens))):
            n = mark[0]
            if mark in self.marks and (key := tuple(tokens[:n])) in self.held:
                self.held[key] += 1
                self.held.move_to_end(key)
                self.hits += 1
                return n
        self.misses += 1
        return 0

    def put(self, tokens: list[int]) -> None:
        key = tuple(tokens)
        if not key or key in self.held or len(key) > self.room:
            return
        while self.used + len(key) > self.room:
            gone = next(iter(self.held)) if self.policy == "lru" else min(self.held, key=self.held.__getitem__)
            self.used -= len(gone)
            del self.held[gone]
            *_, mark = self._marks(gone)
            self.marks[mark] -= 1
            if not self.marks[mark]:
                del self.marks[mark]
            self.evicted += 1
        self.held[key] = 1
        *_, mark = self._marks(key)
        self.marks[mark] += 1
        self.used += len(key)


def simulate_cache(requests: DataFrame, room: int, policy: str = "lru", shards: int = 8) -> DataFrame:
    """Hits, misses and evictions of requests (ord, tokens) on caches sharded by the first token."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = lambda: pd.DataFrame({"shard": [shard], "hits": [cache.hits], "misses": [cache.misses], "evicted": [cache.evicted]})
        cache = shard = None
        for frame in frames:
            for at, tokens in zip(frame["shard"].tolist(), frame["tokens"]):
                if at != shard:
                    if cache is not None:
                        yield row()
                    cache, shard = PrefixCache(room, policy), at
                tokens = tokens.tolist()
                if cache.get(tokens) < len(tokens):
                    cache.put(tokens)
        if cache is not None:
            yield row()

    sharded = requests.where(F.size("tokens") > 0).withColumn("shard", F.pmod(F.col("tokens")[0], F.lit(shards)).cast("int"))
    ordered = sharded.select("shard", "ord", "tokens").repartition("shard").sortWithinPartitions("shard", "ord")
    return ordered.mapInPandas(run, "shard int, hits long, misses long, evicted long")
