"""Hundreds of terms looked for in one pass over each text, by an Aho-Corasick automaton.

The automaton is a table: states by letters, where letters are the characters that any term has, and one more for all
others. Texts are cut into pieces that overlap by the longest term, and the pieces of a batch walk through the table side
by side, one character of each at a time, so that a step is one lookup for all of them. The table is sent to the workers
with the function; its size is bounded: terms that don't fit into one are dealt to several.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of one automaton's table at most (four bytes each).
ENTRIES = 8_000_000
#: Characters of the texts that are looked through at a time.
SLICE = 2_000_000
#: Characters of a piece, and pieces that walk side by side.
PIECE, SIDE_BY_SIDE = 2048, 4096


class Automaton:
    """The states of some distinct, non-empty terms."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        letters = sorted({c for t in terms for c in t})
        self.points, self.longest = np.array([ord(c) for c in letters], np.int64), max(map(len, terms), default=0)
        code = {c: i + 1 for i, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, t in enumerate(terms):
            at = 0
            for c in t:
                if code[c] not in children[at]:
                    children[at][code[c]] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][code[c]]
            ends[at].append(k)
        self.step = np.zeros((len(children), len(letters) + 1), np.int32)
        back = [0] * len(children)
        order = [0]
        for s in order:  # breadth first: the state that a state falls back to is complete before it
            self.step[s] = self.step[back[s]] if s else 0
            for c, to in children[s].items():
                back[to] = int(self.step[s, c]) if s else 0
                self.step[s, c] = to
                ends[to] += ends[back[to]]
                order.append(to)
        self.ends = ends
        self.has = np.array([bool(e) for e in ends])

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.points, points)
        known = (at < len(self.points)) & (self.points[np.minimum(at, len(self.points) - 1)] == points) if len(self.points) else np.zeros(len(points), bool)
        return np.where(known, at + 1, 0).astype(np.int32)

    def hits(self, texts: Sequence[str]) -> Iterator[tuple[int, int, int]]:
        """(text, end, state) wherever terms end, in no order; ends count characters."""
        reach = PIECE + max(self.longest - 1, 0)
        pieces = [(i, a, min(len(t), a + reach)) for i, t in enumerate(texts) for a in range(0, len(t), PIECE)]
        pieces.sort(key=lambda p: p[2] - p[1])  # pieces that walk together are of one length, nearly
        for start in range(0, len(pieces), SIDE_BY_SIDE):
            own = pieces[start : start + SIDE_BY_SIDE]
            sizes = np.array([b - a for _, a, b in own])
            grid = np.zeros((sizes[-1], len(own)), np.int32)
            flat = np.frombuffer("".join(texts[i][a:b] for i, a, b in own).encode("utf-32-le", "surrogatepass"), np.uint32)
            column, row = np.repeat(np.arange(len(own)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            grid[row, column] = self.codes(flat.astype(np.int64))
            state = np.zeros(len(own), np.int32)
            for k in range(sizes[-1]):
                state = self.step[state, grid[k]]
                for p in np.flatnonzero(self.has[state]).tolist():
                    i, a, b = own[p]
                    if a + k < b:
                        yield i, a + k + 1, int(state[p])


def automata(terms: Sequence[str], entries: int = ENTRIES) -> list[Automaton]:
    """As few automata as it takes for no table to be larger than `entries`."""
    terms = list(dict.fromkeys(t for t in terms if t))
    size = lambda ts: (1 + sum(map(len, ts))) * (1 + len({c for t in ts for c in t}))
    out, todo = [], [terms] if terms else []
    while todo:
        own = todo.pop()
        if size(own) > entries and len(own) > 1:
            todo += [own[: len(own) // 2], own[len(own) // 2 :]]
        else:
            out.append(Automaton(own))
    return out


def occurrences(texts: Sequence[str], machines: Sequence[Automaton], ranks: dict[str, int]) -> list[list[tuple[int, int, int]]]:
    """For each text (start, rank, end) of every place where a term stands, each once."""
    found: list[set[tuple[int, int, int]]] = [set() for _ in texts]
    for m in machines:
        for i, end, state in m.hits(texts):
            for k in m.ends[state]:
                found[i].add((end - len(m.terms[k]), ranks[m.terms[k]], end))
    return [sorted(f) for f in found]


def slices(texts: Iterable[str | None], chars: int = SLICE) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters (or one text): what is held at a time, places included."""
    own, size = [], 0
    for t in texts:
        own.append(t or "")
        size += len(own[-1]) + 1
        if size >= chars:
            yield own
            own, size = [], 0
    if own:
        yield own


def _over(text: Column, terms: Sequence[str], entries: int, of) -> Column:
    terms = list(dict.fromkeys(t for t in terms if t))
    machines, ranks = automata(terms, entries), {t: i for i, t in enumerate(terms)}

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[terms[k] for k in of(places)] for texts in slices(batch) for places in occurrences(texts, machines, ranks)], dtype=object)

    return run(text)


def held(text: Column, terms: Sequence[str], entries: int = ENTRIES) -> Column:
    """The terms that stand in the text, in the order of `terms`; none of a null."""
    return _over(text, terms, entries, lambda places: sorted({k for _, k, _ in places}))


def mentions(text: Column, terms: Sequence[str], entries: int = ENTRIES) -> Column:
    """The terms as an alternation of them finds them: from the left, the first in the list of those that begin at a place, and
    on behind it; repeats included."""

    def first(places: list[tuple[int, int, int]]) -> list[int]:
        out, at = [], 0
        for start, k, end in places:
            if start >= at:
                out.append(k)
                at = end
        return out

    return _over(text, terms, entries, first)
