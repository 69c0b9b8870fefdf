"""Search over partial traces of one problem at a time, with the generator and scorer passed in."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.runtime import cut_lineage

Expand = Callable[[str, str, int], list[str]]
Score = Callable[[str, str], float]
Done = Callable[[str], bool]


def beam(problem: str, expand: Expand, score: Score, done: Done, width: int = 4, depth: int = 8) -> str:
    """The best finished text of a beam of so many; the best unfinished one if none finishes."""
    front = [""]
    for _ in range(depth):
        grown = [(score(problem, t), t) for head in front for t in (head + step for step in expand(problem, head, width))]
        if not grown:
            break
        grown.sort(key=lambda x: (-x[0], x[1]))
        front = [t for _, t in grown[:width]]
        ended = [t for t in front if done(t)]
        if ended:
            return ended[0]
    return front[0]


class Node:
    """A partial text with its visits and value."""

    def __init__(self, text: str, parent: Node | None = None) -> None:
        self.text, self.parent = text, parent
        self.children: list[Node] = []
        self.visits, self.value = 0, 0.0

    def bound(self, explore: float) -> float:
        if not self.visits:
            return math.inf
        return self.value / self.visits + explore * math.sqrt(math.log(self.parent.visits) / self.visits)


def tree_search(problem: str, expand: Expand, score: Score, done: Done, rounds: int = 32, branch: int = 4, explore: float = 1.4) -> str:
    """Upper-confidence tree search; the end of the most visited path. It never sees the gold answer."""
    root = Node("")
    for _ in range(rounds):
        node = root
        while node.children:
            node = max(node.children, key=lambda c: c.bound(explore))
        if not done(node.text) and (node.visits or node is root):
            node.children = [Node(node.text + step, node) for step in dict.fromkeys(expand(problem, node.text, branch))]
            node = node.children[0] if node.children else node
        value = score(problem, node.text)
        while node is not None:
            node.visits += 1
            node.value += value
            node = node.parent
    while root.children:
        root = max(root.children, key=lambda c: c.visits)
    return root.text


def search(problems: DataFrame, method: Callable[..., str], **parts: object) -> DataFrame:
    """(problem_id, output) of a search on each problem."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"problem_id": frame["problem_id"], "output": [method(p, **parts) for p in frame["problem"]]})

    return problems.select("problem_id", "problem").mapInPandas(run, "problem_id string, output string")


# What ends a text, the bonus for it and the price of a letter.
ENDS, BONUS, PRICE = ("####", "answer is"), 10.0, 0.001


def ended(text: Column) -> Column:
    return text.contains(ENDS[0]) | F.lower(text).contains(ENDS[1])


def beam_frame(problems: DataFrame, expand: Callable[[Column, Column], Column], width: int = 4, steps: int = 5) -> DataFrame:
    """(problem_id, text, score, done): a beam search over all problems at once, a step being one pass over their partial texts.

    expand gives an array of continuations of a text of a problem. A continuation
    with an answer gains BONUS, and every letter costs PRICE; ties go by the
    text. A problem is done when its best text has an answer; the others go on
    for so many steps.
    """
    front = problems.select("problem_id", F.lit(0.0).alias("score"), F.lit("").alias("text"), F.lit(False).alias("done"))
    for k in range(steps):
        grown = front.where(~F.col("done")).select("problem_id", "score", "text", F.explode(expand(F.col("problem_id"), F.col("text"))).alias("more"))
        scored = grown.select("problem_id", F.round(F.col("score") + F.when(ended(F.col("more")), BONUS).otherwise(0.0) - F.length("more") * PRICE, 6).alias("score"), F.concat("text", "more").alias("text"))
        best = scored.withColumn("place", F.row_number().over(Window.partitionBy("problem_id").orderBy(F.col("score").desc(), "text"))).where(F.col("place") <= width)
        over = F.max((F.col("place") == 1) & ended(F.col("text"))).over(Window.partitionBy("problem_id"))
        front = best.select("problem_id", "score", "text", over.alias("done")).unionAll(front.where("done").select("problem_id", "score", "text", "done"))
        if k % 4 == 3:
            front = cut_lineage(front)
    top = F.row_number().over(Window.partitionBy("problem_id").orderBy(F.col("score").desc(), "text"))
    return front.withColumn("place", top).where("place = 1").select("problem_id", "text", "score", "done")
