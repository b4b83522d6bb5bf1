"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

The kernel compares two strings by their common subsequences of three characters, each weighted by LAMBDA to the power
of the span it takes (spans up to SPAN), and is normalised. A gap or an inserted character lowers it but doesn't zero
it: "i.d.i.o.t" keeps subsequences of "idiot". A sentence is a set of strings: its words, and its runs of single
characters. Characters are a to z, digits, the LETTERS other letters that the training texts hold most, and the rest.

Training takes at most `SAMPLE` distinct labelled texts of label 1, and of label 0 what makes it up to twice that (rows
outside the holdout, least hash of the id first). Telling strings are those that stand in toxic documents more often than chance would have it (binomial tail,
false discovery rate RATE), with near copies counted once, else all words of a copied text would tell; and those that
hold a run of four characters that does so, as an insult's inflected forms do. Each sentence of a toxic document that holds a telling
string is a positive instance by it, with copies that have characters inserted; strings of other sentences are the
negatives. The Nystroem map turns a string's kernels with the landmarks into coordinates, a linear machine (squared
hinge) is fitted, strings of toxic documents that it puts on the positive side and that tell toxic documents become
positives (inflected forms of a telling word), the highest strings of the others become negatives and landmarks, and it
is fitted again, some rounds.

A document has two margins: those of its two highest strings, a repeated string counting twice. A logistic curve over
both, fitted on a part of the sample that is kept from the machine, gives the probability; labels that are wrong whatever
the margins get a floor in the same maximum-likelihood fit.

Since the machine is linear in the map, a string's margin is a sum over its subsequences of one table of ALPHABET ** 3
weights, divided by the string's norm: a worker needs that table only (a fixed size), computes a distinct string of a
batch once and keeps a bounded memo.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import crc_mod, read

LAMBDA = 0.7
SPAN = 10
LONGEST = 40
SAMPLE = 1500
#: Bytes of the sample's texts of a label, at most: whole texts, as many as fit.
SAMPLE_BYTES = 12_000_000
#: Landmarks: telling strings; and inflected forms, common strings and the hard negatives of a round, of each.
TOLD, LANDMARKS = 80, 40
#: Rate of false discoveries among telling strings, and how many times as often they stand in toxic documents at least.
RATE, LEAST_RATIO = 0.02, 4.0
ROUNDS = 4
CUT = 0.3
MEMO = 200_000
#: The commonest letters beyond a to z have codes of their own; all further ones, of whatever script, share CLASSES codes by
#: their place in it, so that neighbours are told apart.
LETTERS, CLASSES = 19, 16
DIGIT, OTHER = 27, 28
ALPHABET = 29 + LETTERS + CLASSES
EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_~`/\\+=@^"
_SENTENCE = re.compile(r"[.!?]+[\x20\x09-\x0D]+|\n")


def letters_of(texts: list[str]) -> np.ndarray:
    """Code of each code point: 1 to 26 for a to z, one for digits, one each for the commonest other letters, one of a few for
    every further letter, one for the rest."""
    places = np.arange(0x110000)
    alpha = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    out = np.where(alpha & (places > 0x7F), OTHER + 1 + LETTERS + places % CLASSES, OTHER).astype(np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = DIGIT
    seen = Counter()
    for t in texts:
        seen.update(c for c in t.lower() if c > "\x7f" and c.isalpha())
    for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c))[:LETTERS]):
        out[ord(c)] = OTHER + 1 + i
    return out


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j < k of a string of n characters within a span, and their weights."""
    at = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
    at = np.array(at, np.int64).reshape(-1, 3)
    return at, LAMBDA ** (at[:, 2] - at[:, 0] + 1)


def codes(strings: list[str], n: int, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strings x triples) subsequence codes and the triples' weights, of strings that all have n characters, marked at both ends."""
    at, weight = triples(n + 2)
    c = np.zeros((len(strings), n + 2), np.int64)
    c[:, 1:-1] = letters[np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)]
    return (c[:, at[:, 0]] * ALPHABET + c[:, at[:, 1]]) * ALPHABET + c[:, at[:, 2]], weight


def norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The root of each string's kernel with itself."""
    order = np.argsort(code, axis=1)
    code, w = np.take_along_axis(code, order, 1), weight[order]
    rows, cols = code.shape
    new = np.ones((rows, cols), bool)
    new[:, 1:] = code[:, 1:] != code[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    return np.sqrt(np.bincount(np.nonzero(new)[0], sums**2, rows))


def by_length(strings: list[str], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in strings, codes, weights) for strings of three characters or more, in blocks."""
    lengths = np.array([min(len(s), LONGEST) for s in strings], np.int64)
    for n in np.unique(lengths[lengths >= 3]).tolist():
        own, step = np.flatnonzero(lengths == n), max(1, 400_000 // len(triples(n + 2)[0]))
        for i in range(0, len(own), step):
            yield (own[i : i + step], *codes([strings[j][:n] for j in own[i : i + step]], n, letters))


def vectors(strings: list[str], letters: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The normalised feature vectors of the landmarks, as (codes, weights)."""
    out = [(np.empty(0, np.int64), np.empty(0))] * len(strings)
    for at, code, weight in by_length(strings, letters):
        for i, row in zip(at.tolist(), code):
            own, back = np.unique(row, return_inverse=True)
            v = np.bincount(back, weight)
            out[i] = (own, v / np.linalg.norm(v))
    return out


def kernels(strings: list[str], marks: list[tuple[np.ndarray, np.ndarray]], letters: np.ndarray) -> np.ndarray:
    """strings x marks: the normalised kernels."""
    out, dense = np.zeros((len(strings), len(marks))), np.zeros(ALPHABET**3)
    for at, code, weight in by_length(strings, letters):
        size = norms(code, weight)
        for m, (own, v) in enumerate(marks):
            dense[own] = v
            out[at, m] = dense[code] @ weight / size
            dense[own] = 0
    return out


def pieces(word: str) -> list[str]:
    """A string as it is, or overlapping windows of a long one."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def strings_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct strings, places in them, place of the text) of each string of each text: its words without the marks
    around them, and its runs of three or more single characters with their gaps."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    owner = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(words).dictionary_encode()
    held, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    single = np.concatenate(([False], pc.utf8_length(held).to_numpy(zero_copy_only=False)[at] == 1, [False]))
    single[1:-1] &= held.is_valid().to_numpy(zero_copy_only=False)[at] if len(at) else single[1:-1]
    edges = np.flatnonzero(np.concatenate((single[1:] != single[:-1], [False])) | np.concatenate(([False], owner[1:] != owner[:-1], [False, False]))[: len(single)])
    runs = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b - a > 2 and single[a + 1]]
    plain = pc.utf8_trim(held, characters=EDGE)
    spaced = [" ".join(held[int(i)].as_py() for i in at[a:b]) for a, b in runs]
    if spaced:
        plain = pa.concat_arrays([plain.cast(pa.string()), pa.array(spaced, pa.string())])
        at = np.concatenate((at, np.arange(len(held), len(held) + len(spaced))))
        owner = np.concatenate((owner, owner[[a for a, _ in runs]]))
        order = np.argsort(owner, kind="stable")
        at, owner = at[order], owner[order]
    again = plain.dictionary_encode()
    return again.dictionary, again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at], owner


class Machine:
    """letters: codes of characters; table: ALPHABET ** 3 weights; curve: weights of a document's margins and the shift;
    floor: the share of label 1 whatever the margins; empty: the margin where no string is."""

    def __init__(self, letters: np.ndarray, table: np.ndarray, curve: np.ndarray, floor: float = 0.0, empty: float = 0.0):
        self.letters, self.table, self.curve, self.floor, self.empty = letters, table, curve, floor, empty

    def margins(self, strings: list[str]) -> np.ndarray:
        parts = [pieces(s) for s in strings]
        flat = np.zeros(sum(map(len, parts)))
        for at, code, weight in by_length(list(chain.from_iterable(parts)), self.letters):
            flat[at] = self.table[code] @ weight / norms(code, weight)
        return np.maximum.reduceat(flat, np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))) if strings else flat

    def two_highest(self, margin: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(texts x 2) margins of each text's two highest strings, and the place of the highest (-1: none)."""
        order = np.lexsort((margin, owner))
        ends = np.searchsorted(owner[order], np.arange(n), "right")
        sizes = np.bincount(owner, minlength=n)
        out, best = np.full((n, 2), self.empty), np.full(n, -1)
        best[sizes > 0] = order[ends[sizes > 0] - 1]
        out[sizes > 0, 0] = margin[best[sizes > 0]]
        out[sizes > 1, 1] = margin[order[ends[sizes > 1] - 2]]
        return out, best

    def probability(self, top: np.ndarray) -> np.ndarray:
        return self.floor + (1 - self.floor) / (1 + np.exp(-np.clip(top @ self.curve[:2] + self.curve[2], -40, 40)))


def inserted(word: str) -> list[str]:
    """The word with characters put in: between all letters, at one place, and one letter doubled."""
    mid = len(word) // 2
    return [sep.join(word) for sep in (".", "-", "*", " ")] + [word[:mid] + x + word[mid:] for x in ("*", "-", "'", "x", word[mid : mid + 1])]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and shift by Newton's steps on weighted rows (y from 0 to 1), with a light pull to zero."""
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 0.01 * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights and shift, floor) of floor + (1 - floor) * logistic, by expectation maximisation: a label 1 is due to the
    margins or to the floor, in the proportion that the fit itself gives."""
    due, floor = np.ones(len(y)), 0.0
    for _ in range(25):
        w = logistic(x, y * due, weight)
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        floor = float((weight * y * (1 - due)).sum() / (weight * (1 - y * due)).sum()) if (due < 1).any() else 0.01
        due = (1 - floor) * p / (floor + (1 - floor) * p)
    return w, floor


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, cost: float = 100.0) -> np.ndarray:
    """Weights and bias of the squared-hinge machine, by Newton's method on its support; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(y)) if weight is None else weight
    weight = cost * weight * np.where(y > 0, 0.5 / max(1e-9, weight[y > 0].sum()), 0.5 / max(1e-9, weight[y < 0].sum())) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None]
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def log_tail(k: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """log P(X >= k), X ~ Binomial(n, q), from its first term and a geometric bound of the rest; 0 at or below the mean."""
    facts = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, int(n.max(initial=0)) + 2)))))
    first = facts[n] - facts[k] - facts[n - k] + k * np.log(q) + (n - k) * np.log1p(-q)
    step = (n - k) / (k + 1) * q / (1 - q)
    return np.where(k > n * q, np.minimum(0, first - np.log1p(-np.minimum(step, 1 - 1e-9))), 0.0)


def once(positive: list[set[str]], pos: Counter, neg: Counter, n: int) -> np.ndarray:
    """Which texts come first among their near copies: those that share half of their rarer strings."""
    often = max(10, n // 20)
    shared = {w: i for i, w in enumerate(sorted(w for w, k in pos.items() if k > 1 and k + neg[w] <= often))}
    own = [np.array([shared[w] for w in s if w in shared], np.int64) for s in positive]
    both = np.zeros((len(positive), len(positive)), np.float32)
    for start in range(0, len(shared), 4096):
        part = np.zeros((len(positive), 4096), np.float32)
        for row, at in zip(part, own):
            row[at[(at >= start) & (at < start + 4096)] - start] = 1
        both += part @ part.T
    size = np.array([sum(pos[w] + neg[w] <= often for w in s) for s in positive])
    return ~np.tril(2 * both >= np.maximum(np.maximum(size[:, None], size), 1), -1).any(axis=1)


def discovered(k: np.ndarray, other: np.ndarray, n: int, n_neg: int, tests: int) -> np.ndarray:
    """Places of what stands in k of n toxic and in `other` of n_neg other texts more often than chance would have it
    (false discovery rate RATE among `tests`), and LEAST_RATIO times as often; the most telling first."""
    p = log_tail(k, k + other, n / (n + n_neg))
    passed = np.flatnonzero(np.sort(p) <= np.log(RATE * np.arange(1, len(p) + 1) / max(1, tests)))
    if not len(passed):
        return np.empty(0, np.int64)
    own = np.flatnonzero((p <= np.sort(p)[passed[-1]]) & (k > 2) & (k * n_neg >= LEAST_RATIO * other * n))
    return own[np.argsort(p[own], kind="stable")]


def telling(positive: list[set[str]], neg: Counter, n_neg: int) -> list[str]:
    """The strings that tell toxic documents; those of a greedy cover of the documents first."""
    pos = Counter(chain.from_iterable(positive))
    words = sorted(w for w, k in pos.items() if k > 2 and 3 <= len(w) <= LONGEST)
    k, other = np.array([pos[w] for w in words], int), np.array([neg[w] for w in words], int)
    own = discovered(k, other, len(positive), n_neg, len(words) + sum(n > 2 and not pos[w] for w, n in neg.items()))
    words, other = [words[i] for i in own], other[own]
    held = np.array([[w in s for w in words] for s in positive], bool).reshape(len(positive), len(words))
    free, first = np.ones(len(held), bool), []
    while (k := held[free].sum(axis=0)).max(initial=0) > 2:
        first.append(int(np.argmin(np.where(k > 2, log_tail(k, k + other, len(positive) / (len(positive) + n_neg)), 1.0))))
        free &= ~held[:, first[-1]]
    return [words[i] for i in [*first, *(i for i in range(len(words)) if i not in first)]]


def stemmed(positive: list[set[str]], negative: list[set[str]]) -> list[str]:
    """The strings of toxic documents that hold a telling run of four characters (a word's start counts as one): forms of
    one stem, each too rare to tell by itself. Those in most documents first."""
    grams: dict[str, int] = {}
    words = sorted(w for w in set().union(*positive, *negative) if 3 <= len(w) <= LONGEST)
    place = {w: i for i, w in enumerate(words)}
    flat = np.fromiter((grams.setdefault(f"^{w}"[i : i + 4], len(grams)) for w in words for i in range(len(w) - 2)), np.int32)
    edges = np.concatenate(([0], np.cumsum([len(w) - 2 for w in words], dtype=np.int64)))
    of = lambda w: flat[edges[place[w]] : edges[place[w] + 1]]
    counts = []
    for texts in (positive, negative):
        counts.append(np.zeros(len(grams), np.int64))
        for s in texts:
            if own := [of(w) for w in s if w in place]:
                counts[-1][np.unique(np.concatenate(own))] += 1
    found = np.zeros(len(grams), bool)
    found[discovered(*counts, len(positive), len(negative), int((counts[0] + counts[1] > 2).sum()))] = True
    pos, neg = Counter(chain.from_iterable(positive)), Counter(chain.from_iterable(negative))
    return sorted((w for w in pos if w in place and found[of(w)].any() and pos[w] * len(negative) >= LEAST_RATIO * neg[w] * len(positive)), key=lambda w: (-pos[w], w))


def fit(texts: list[tuple[str, int]], totals: tuple[int, int] | None = None) -> Machine:
    """texts: (text, label). totals: how many rows of labels 0 and 1 the sample stands for (else itself); the curve
    weighs the sample's rows by them. Without both labels, or without telling strings, the score is the share of label 1."""
    letters = letters_of([t for t, _ in texts])
    y = np.array([y for _, y in texts], int)
    total_neg, total_pos = totals or (int((y == 0).sum()), int((y == 1).sum()))
    rate = (total_pos + 0.5) / (total_pos + total_neg + 1)
    plain = Machine(letters, np.zeros(ALPHABET**3), np.array([0.0, 0.0, np.log(rate / (1 - rate))]))
    held, at, owner = strings_of(pa.array([t for t, _ in texts], pa.string()))
    held = held.to_pylist()
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = [{held[i] for i in np.unique(at[a:b]).tolist()} for a, b in zip(cuts, cuts[1:])]
    pa.default_memory_pool().release_unused()  # Arrow keeps what the texts took; the driver has little to spare
    # A quarter of the sample stays apart for the curve: the machine's own negatives lie closer together than others do.
    apart = np.arange(len(texts)) % 4 == 3
    own = [(s, label) for s, label, aside in zip(sets, y.tolist(), apart) if not aside]
    neg = Counter(chain.from_iterable(s for s, label in own if not label))
    positive, n_neg = [s for s, label in own if label], sum(1 for _, label in own if not label)
    pos = Counter(chain.from_iterable(positive))
    if not positive or not n_neg:
        return plain
    distinct = [s for s, first in zip(positive, once(positive, pos, neg, len(own))) if first]
    told, forms = telling(distinct, neg, n_neg), stemmed(distinct, [s for s, label in own if not label])
    n_pos = len(positive)
    del sets, own, positive, distinct  # the largest of what the driver holds
    told, forms = told or forms[:TOLD], sorted(set(forms) - set(told), key=forms.index)
    if not told:
        return plain
    fit_for = lambda w: 3 <= len(w) <= LONGEST
    common = sorted((w for w in neg if fit_for(w) and w not in told), key=lambda w: (-neg[w], w))[:LANDMARKS]
    # A positive instance weighs as many documents as it stands in; copies with inserted characters share one such weight.
    strings = {v: pos[w] * share for w in reversed(told) for v, share in [*((v, 1 / 9) for v in inserted(w)), (w, 1.0)] if len(v) <= LONGEST}
    taken = {*told, *forms}
    pool = sorted(w for w in neg if fit_for(w) and w not in taken)
    there = sorted(w for w, k in pos.items() if k > 1 and fit_for(w) and k * n_neg >= LEAST_RATIO * neg[w] * n_pos and w not in told)
    negative = [pool[i] for i in np.linspace(0, len(pool) - 1, min(len(pool), 4000)).astype(int)] if pool else []
    marks = [*told[:TOLD], *(".".join(w) for w in told[: TOLD // 4]), *forms[:LANDMARKS], *common]
    for step in range(ROUNDS):
        marks = sorted(set(marks))
        space = vectors(marks, letters)
        gram = kernels(marks, space, letters)
        values, axes = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-6 * values.max()
        root = axes[:, keep] / np.sqrt(values[keep])  # coordinates: kernels with the landmarks times this
        instances = strings | {x: float(pos[x]) for x in forms}
        label = np.array([1.0] * len(instances) + [-1.0] * len(negative))
        w = linear_svm(kernels([*instances, *negative], space, letters) @ root, label, np.array([*instances.values(), *[1.0] * len(negative)]))
        table = np.zeros(ALPHABET**3)
        for weight, (code, v) in zip(root @ w[:-1], space):
            table[code] += weight * v
        # All strings share the bias, so a document's order doesn't need it; the curve below takes it in.
        machine = Machine(letters, table, np.zeros(3))
        if step == ROUNDS - 1:
            break
        margin = machine.margins(pool)
        hard = [pool[i] for i in np.argsort(-margin, kind="stable")[:2000]]
        found = dict(zip(there, machine.margins(there) + w[-1]))
        forms = sorted({*forms, *(x for x in there if found[x] > 0)}, key=lambda x: (-pos[x], x))
        negative = sorted({*negative, *hard} - set(forms))
        marks += [*hard[:LANDMARKS], *forms[:LANDMARKS]]
    margin = machine.margins(held)
    machine.empty = float(margin.min(initial=0.0))
    top, _ = machine.two_highest(margin[at], owner, len(texts))
    top, y = top[apart], y[apart].astype(float)
    if not 0 < y.sum() < len(y):
        return plain
    weight = np.where(y > 0, total_pos / y.sum(), total_neg / (len(y) - y.sum()))
    machine.curve, machine.floor = curve(top, y, weight * len(y) / weight.sum())
    return machine


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """At most `limit` labelled texts of label 1, and of label 0 what makes it up to twice `limit`, those whose ids hash
    lowest as far as SAMPLE_BYTES of each label go, equal texts of a label once; and how many rows of each label there are."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1)).distinct()
    out, totals = [], {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    for label in (1, 0):
        room = limit if label else 2 * limit - min(limit, totals.get(1, 0))
        ids = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(room)  # bounded: the sample's ids
        rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids.select("doc_id")), "doc_id")
        so_far = F.sum(F.octet_length("text")).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES)
        out += [(t, label) for t in dict.fromkeys(t for _, t in sorted((r["doc_id"], r["text"]) for r in rows.collect()))]
    return sorted(out, key=lambda x: x[1]), (totals.get(0, 0), totals.get(1, 0))


_held: dict[str, tuple] = {}


def classify(docs: DataFrame, machine: Machine) -> DataFrame:
    """row (a struct of all columns of docs), score, witness (the string that decides) of every row, in one pass over
    whole texts without a shuffle. Null texts are empty."""
    shared, job = docs.sparkSession.sparkContext.broadcast(machine), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if job not in _held:
            _held.clear()
            _held[job] = (shared.value, {})
        machine, memo = _held[job]
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                held, at, owner = strings_of(batch.column(1))
                held = held.to_pylist()
                if len(memo) > MEMO:
                    memo.clear()
                fresh = [w for w in held if w not in memo]
                margin = dict(zip(fresh, machine.margins(fresh).tolist()))
                values = np.array([margin[w] if w in margin else memo[w] for w in held], float)
                memo.update((w, m) for w, m in margin.items() if len(w) <= LONGEST)  # so the memo is bounded in bytes, too
                top, best = machine.two_highest(values[at], owner, batch.num_rows)
                witness = pa.array([None if b < 0 else held[at[b]] for b in best.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.probability(top)), witness], ["row", "score", "witness"])

    source = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, T.StructType([source.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("witness", T.StringType())]))


def learned(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Machine:
    """A machine that has seen the labels (doc_id, toxic) of rows outside the holdout only."""
    return fit(*sample(docs, labels.where(~(crc_mod("doc_id", 4) == 2)), limit))


def score(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, score, witness of every row of docs, by learned().

    No labels, or labels of one kind: every score is the (smoothed) share of label 1. Repeated rows are each scored,
    null ids are kept and never labelled, an empty table gives no rows, other columns are ignored.
    """
    return classify(docs.select("doc_id", "text"), learned(docs, labels, limit)).select("row.doc_id", "score", "witness")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "witness")


def keep_civil(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs whose score is below the cut, each row judged by its own text."""
    return classify(docs, learned(docs, read(spark, sf_dir, "labels"))).where(F.col("score") < CUT).select("row.*")
