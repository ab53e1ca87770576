"""Word segmentation by a dictionary, for text that sets no spaces between words.

A run of letters and digits is a lattice: an edge for every dictionary word in it and one for every single
character. The segmentation is the path of least cost; characters that no word takes stay together as one word.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import words

#: Words that a dictionary may have at most: each task holds it as a trie.
MOST_WORDS = 1_000_000
#: Runs whose segmentation a task remembers.
REMEMBERED = 200_000
_END = ""


class Lattice:
    """A dictionary as a trie, and the best path through a run's lattice."""

    def __init__(self, costs: dict[str, int], unknown: int) -> None:
        self.unknown, self.root = unknown, {}
        for word, cost in costs.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[_END] = cost
        self.known: dict[str, list[str]] = {}

    def best(self, run: str) -> list[str]:
        """The words of the path of least cost; of equal ones that whose marked text, ``|word|`` for words of the
        dictionary, comes first."""
        held = self.known.get(run)
        if held is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            held = self.known[run] = self._path(run)
        return held

    def _path(self, run: str) -> list[str]:
        n = len(run)
        least: list = [None] * (n + 1)  # cost of the best path to each place, its last edge's begin, and whether that is a word
        least[0] = (0, -1, False)

        def marked(edges: list) -> str:
            return "".join(f"|{run[a:b]}|" if word else run[a:b] for a, b, word in reversed(edges))

        def earlier(edge: tuple, other: tuple) -> bool:
            """Whether the path with one last edge comes before that with the other: they are compared from where they part."""
            x, y = [edge], [other]
            while x[-1][0] != y[-1][0]:
                side = x if x[-1][0] > y[-1][0] else y
                end = side[-1][0]
                side.append((least[end][1], end, least[end][2]))
            return marked(x) < marked(y)

        def offer(i: int, end: int, cost: int, word: bool) -> None:
            now = least[end]
            if now is None or cost < now[0] or cost == now[0] and earlier((i, end, word), (now[1], end, now[2])):
                least[end] = (cost, i, word)

        for i in range(n):
            cost = least[i][0]
            offer(i, i + 1, cost + self.unknown, False)
            node = self.root
            for j in range(i, n):
                node = node.get(run[j])
                if node is None:
                    break
                if _END in node:
                    offer(i, j + 1, cost + node[_END], True)
        edges, at = [], n
        while at > 0:
            edges.append((least[at][1], at, least[at][2]))
            at = least[at][1]
        out: list[str] = []
        loose = False
        for begin, end, word in reversed(edges):
            if not word and loose:
                out[-1] += run[begin:end]
            else:
                out.append(run[begin:end])
            loose = not word
        return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def word_costs(counts: DataFrame, word: str = "word", count: str = "n") -> tuple[DataFrame, int]:
    """Counted words as a dictionary -> (``word, cost``), and the cost of an unknown character.

    A word costs the bits by which it is rarer than all words together, so common words are cheap; an unknown
    character costs more than the rarest word.
    """
    bits = lambda c: F.length(F.bin(c))
    total = counts.agg(bits(F.sum(count)).alias("b")).first()["b"] or 1
    return counts.select(F.col(word).alias("word"), (F.lit(total) - bits(F.col(count)) + 1).cast("int").alias("cost")), total + 1


def segmenter(dictionary: DataFrame, unknown: int, most_words: int = MOST_WORDS) -> Callable[[Column | str], Column]:
    """A tokenizer that cuts the runs of a text's letters and digits by a dictionary (``word, cost``): give it to the
    keyword job as ``tokenize``. Text is lower-cased; null text has no words.

    The dictionary goes to every task, so its size is checked: more than ``most_words`` words raise. Costs are whole
    numbers of one or more; of a word listed twice the least counts, null and empty words count for nothing.
    """
    usable = dictionary.filter((F.length("word") > 0) & F.col("cost").isNotNull())
    listed = usable.groupBy("word").agg(F.min("cost").alias("cost")).limit(most_words + 1).collect()
    if len(listed) > most_words:
        raise ValueError(f"a dictionary has at most {most_words} words")
    costs = {r["word"]: int(r["cost"]) for r in listed}
    held: list[Lattice] = []

    @F.pandas_udf("array<string>")
    def cut(runs: pd.Series) -> pd.Series:
        if not held:
            held.append(Lattice(costs, unknown))
        lattice = held[0]
        return runs.map(lambda rs: None if rs is None else [w for r in rs for w in lattice.best(r)])

    return lambda text: cut(words(text))
