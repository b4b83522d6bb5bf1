"""Substring dedup with compact windows.

The units are five-word shingles, hashed by HASHES functions. For one function, the Cartesian tree over a document's
values groups all its subsequences of at least LEAST shingles (50 words) by their minimum: a node at place m spans a
compact window [l, r], and every subsequence l <= a <= m <= b <= r has the minimum of m as its signature. There are
about 2 n / LEAST such windows in n shingles, and two equal passages share the signature of each function.

Windows meet by signature. With a window go sketches of the SIDE shingles on each side of its minimum (128 bits, each
shingle flips one). Windows that agree in them have the same text around the minimum; the first stands for the others,
which become links on the spot, so that copies send one window of each task on. The rest is dealt to buckets by hash and
packed. There all distinct windows of a signature are compared, in tiles; a signature of more than HOT windows is cut
into blocks, and each pair of blocks is dealt anew. Of the windows in smaller documents, a window is linked to the one most
alike on both sides together, if it is alike enough (by which the middle of the window is a passage itself); if there is
none, to the most alike on the left and the most alike on the right. A passage of 46 shingles has 23 on one side of any
minimum; one changed word flips at most 11 bits there. So a window has at most two links in each block, however many
copies there are; comparisons, which are cheap, grow with the square of the distinct windows of one signature.

A link keeps the part of both windows that aligns; parts shorter than LEAST go. It is sure if the windows are alike on both
sides or equal on one. The links of two documents are joined as intervals: a stretch that a sure link or ENOUGH functions
cover is a candidate. Its texts are then compared exactly, for each shift of its links: the stretches of one whose shingles
stand in the other, with gaps of up to GAP shingles, count if they are long enough and have a Jaccard similarity of
SIMILARITY or more with the best stretch of the other at that shift.

The most alike may fail there where another would not. So there is a second look at the windows of linked texts whose minimum no
verified passage covers: for each stretch of LEAST shingles through the minimum, the smallest document that holds the same stretch is
found by its hash among all places with the minimum's shingle, and is verified. So repeats that are equal are not lost to a
nearer neighbour; of those that are alike only, the nearest are tried. Within a run of one shingle the first place counts, and
every SIDE-th from the run's end, so that each stretch that reaches into the run holds one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import WordHashes, buckets, lower_words, mix, read, stored

WIDTH = 5
WORDS = 50
LEAST = WORDS - WIDTH + 1
HASHES = 2
ENOUGH = 1
SIMILARITY = 0.8
#: Shingles of a sketch; bits in which two sketches of one side, or of both sides together, may differ.
SIDE = LEAST // 2
ALIKE_SIDE, ALIKE = 12, 10
#: Windows of a signature that one task compares.
HOT = 4096
TILE = 1024
#: Shingles beside a stretch of links that are looked at, too: a window ends at its neighbour's minimum, not at a passage's end.
MARGIN = LEAST // 2
#: What the function of a sure link has in addition.
SURE = 8
#: One changed word breaks WIDTH shingles; two changes side by side may break twice as many.
GAP = 2 * WIDTH
#: Shingles that a task handles at a time.
CHUNK = 2_000_000
WINDOW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("m", "<u4"), ("left", "<u4"), ("right", "<u4"), ("side", "<u8", (4,))])
LINK = np.dtype([("doc", "<i8"), ("rep", "<i8"), ("tag", "<u4"), ("rep_tag", "<u4"), ("lo", "<u4"), ("hi", "<u4"), ("shift", "<i4"), ("fn", "u1")])
#: Bits of a filter for each of its numbers, of which a number sets two.
BITS = 32
#: A place of the second look, with a byte for each of the shingles around it.
PLACE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("m", "<u4"), ("near", "u1", 2 * LEAST - 1)])
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(words: list[bytes], hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    h = hashes.of(words)
    if len(h) < width:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
    return mix(out)


def _sliding(x: np.ndarray, t: int, best) -> np.ndarray:
    """best over x[w : w + t] for every w, by running bests over blocks of t from both sides."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % t, x[-1], x.dtype)]).reshape(-1, t)
    ahead = best.accumulate(padded, axis=1).ravel()
    back = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - t + 1], ahead[t - 1 : n])


def windows(x: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, m, r): the compact windows of at least `least` places of the sequences that stand end to end in x.

    The nodes of the Cartesian trees that span so much are the minima of some stretch of that length, and so are the
    nodes above them; the others never matter. Of equal values the leftmost is the minimum.
    """
    none = np.empty(0, np.int64)
    if len(x) < least:
        return none, none, none
    ends = np.append(starts[1:], len(x))
    low = _sliding(x, least, np.minimum)
    end_of = np.repeat(ends, ends - starts)
    low[np.arange(len(low)) + least > end_of[: len(low)]] = 0  # stretches over an end
    padded = np.concatenate([np.zeros(least - 1, x.dtype), low, np.zeros(least - 1, x.dtype)])
    nodes = np.flatnonzero((_sliding(padded, least, np.maximum) == x) & (x > 0))
    seq = np.searchsorted(starts, nodes, "right") - 1
    left, right = starts[seq].copy(), ends[seq] - 1
    stack: list[int] = []
    values, owner, place = x[nodes].tolist(), seq.tolist(), nodes.tolist()
    current = -1
    for k, v in enumerate(values):
        if owner[k] != current:
            stack, current = [], owner[k]
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = place[k] - 1
        if stack:
            left[k] = place[stack[-1]] + 1
        stack.append(k)
    keep = right - left + 1 >= least
    return left[keep], nodes[keep], right[keep]


def compact_windows(docs: np.ndarray, tags: np.ndarray, texts: list[np.ndarray], n_hashes: int = HASHES) -> np.ndarray:
    """The window rows of documents given as shingle arrays, all functions; the function is in the key's last bits. A tag
    tells the texts of one id apart."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    s = np.concatenate(texts)
    ends = np.append(starts[1:], len(s)) - 1
    flips = np.zeros((2, len(s) + 1), np.uint64)
    bit = np.uint64(1) << ((s >> np.uint64(8)) & np.uint64(63))
    for w in (0, 1):
        np.bitwise_xor.accumulate(np.where(s >> np.uint64(63) == w, bit, np.uint64(0)), out=flips[w, 1:])
    out = []
    for f in range(n_hashes):
        x = mix(s + np.uint64((f + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        l, m, r = windows(x, starts)
        seq = np.searchsorted(starts, m, "right") - 1
        own = np.empty(len(m), WINDOW)
        own["key"] = (x[m] & ~np.uint64(7)) | np.uint64(f)
        before, after = np.maximum(m - SIDE, starts[seq]), np.minimum(m + SIDE, ends[seq])
        for w in (0, 1):
            own["side"][:, w] = flips[w, m] ^ flips[w, before]
            own["side"][:, 2 + w] = flips[w, after + 1] ^ flips[w, m + 1]
        own["doc"], own["tag"], own["m"], own["left"], own["right"] = docs[seq], tags[seq], m - starts[seq], m - l, r - m
        out.append(own)
    return np.concatenate(out)


def pair_links(x: np.ndarray, y: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Links of the windows x with the windows y of their signatures, as far as they align on LEAST shingles."""
    swap = x["doc"] < y["doc"]  # the smaller document stands for the other
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    left, right = np.minimum(x["left"], y["left"]).astype(np.int64), np.minimum(x["right"], y["right"]).astype(np.int64)
    keep = (x["doc"] != y["doc"]) & (left + right + 1 >= LEAST)
    link = np.empty(int(keep.sum()), LINK)
    m = x["m"][keep].astype(np.int64)
    link["tag"], link["rep_tag"] = x["tag"][keep], y["tag"][keep]
    link["doc"], link["rep"], link["lo"], link["hi"] = x["doc"][keep], y["doc"][keep], m - left[keep], m + right[keep]
    link["shift"], link["fn"] = y["m"][keep].astype(np.int64) - m, (x["key"][keep] & np.uint64(7)) + SURE * sure[keep].astype(np.uint64)
    return link


def firsts(group: np.ndarray) -> np.ndarray:
    """For each place the first place of its group."""
    _, first, of = np.unique(group, return_index=True, return_inverse=True)
    return first[of]


def folded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, representatives): windows of one text are linked to the one in the smallest document, which stays."""
    rows = rows[np.lexsort((rows["m"], rows["doc"]))]
    same = rows["key"]
    for part in rows["side"].T:
        same = mix(same + mix(part + np.uint64(1)))
    head = firsts(same)
    rest = np.flatnonzero(head != np.arange(len(rows)))
    return pair_links(rows[rest], rows[head[rest]], np.ones(len(rest), bool)), rows[head == np.arange(len(rows))]


def _differ(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = [np.bitwise_count(x[..., k] ^ y[..., k]) for k in range(4)]
    return n[0] + n[1], n[2] + n[3]


class Nearest:
    """For each window of x the most alike of y so far: on both sides together, on the left, on the right."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        self.best = np.full((3, len(x)), np.iinfo(np.int64).max)  # distance and place in one number: ties go to the first

    def see(self, i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        for k, (d, limit) in enumerate(((left + right, ALIKE), (left, ALIKE_SIDE), (right, ALIKE_SIDE))):
            near = d <= limit
            np.minimum.at(self.best[k], i[near], d[near].astype(np.int64) << 40 | j[near])

    def links(self) -> np.ndarray:
        known = self.best < np.iinfo(np.int64).max
        known[1:] &= ~known[0]
        out = []
        for k in range(3):
            i = np.flatnonzero(known[k])
            out.append(pair_links(self.x[i], self.y[self.best[k, i] & ((1 << 40) - 1)], (self.best[k, i] < 1 << 40) | (k == 0)))
        return np.concatenate(out)


def tiled(x: np.ndarray, y: np.ndarray, whole: bool) -> Iterator[np.ndarray]:
    """Links of the windows x with those of y in smaller documents; whole: in others."""
    for a in range(0, len(x), TILE):
        own = x[a : a + TILE]
        nearest = Nearest(own, y)
        for b in range(0, len(y), TILE):
            there = y[b : b + TILE]
            left, right = _differ(own["side"][:, None], there["side"][None])
            near = (left + right <= ALIKE) | (np.minimum(left, right) <= ALIKE_SIDE)
            near &= (own["doc"][:, None] != there["doc"][None]) if whole else (own["doc"][:, None] > there["doc"][None])
            i, j = np.nonzero(near)
            nearest.see(i, j + b, left[i, j], right[i, j])
        yield nearest.links()


def met(rows: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(links, pairs of blocks left to compare) of the windows of whole signatures."""
    found, rows = folded(rows)
    out, left = [found], []
    rows = rows[np.lexsort((rows["m"], rows["doc"], rows["key"]))]
    starts = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1])))
    sizes = np.diff(np.append(starts, len(rows)))
    few = rows[np.repeat((sizes > 1) & (sizes <= 48), sizes)]
    nearest = Nearest(few, few)
    for d in range(1, 48):
        i = np.flatnonzero((few["key"][d:] == few["key"][:-d]) & (few["doc"][d:] != few["doc"][:-d])) + d if len(few) > d else np.empty(0, np.int64)
        if len(i):
            nearest.see(i, i - d, *_differ(few["side"][i], few["side"][i - d]))
    out.append(nearest.links())
    for at in np.flatnonzero(sizes > 48):
        own = rows[starts[at] : starts[at] + sizes[at]]
        if len(own) <= HOT:
            out += tiled(own, own, False)
        else:
            blocks = [own[i : i + HOT] for i in range(0, len(own), HOT)]
            left += [(x, y) for k, x in enumerate(blocks) for y in blocks[: k + 1]]
    return np.concatenate(out), left


def packed_rows(kind: int, rows: np.ndarray, bucket: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    rows = rows[order]
    full = np.flatnonzero(np.diff(edges))
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32)), pa.array([rows[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary())], ["bucket", "kind", "data"]
    )


def dealt(x: np.ndarray, n: int) -> np.ndarray:
    return (((mix(x) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


LINKS = "doc long, rep long, tag int, rep_tag int, lo int, hi int, shift int, fn int"


def documents(docs: DataFrame) -> DataFrame:
    """doc, tag (32 bits of the text's hash), text of the rows that can have passages."""
    as_text = F.col("text").cast("string")
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), tagged(as_text).alias("tag"), as_text.cast("binary").alias("text"))


def tagged(text: Column) -> Column:
    return F.hash(text)


def links(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc, rep (documents, rep the smaller id), tag, rep_tag (of their texts), lo, hi (shingles of doc), shift (to those
    of rep), fn."""
    n_buckets = buckets(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids, tags, held, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, rows = folded(compact_windows(np.array(ids, np.int64), np.array(tags, np.int32).view(np.uint32), held))
            yield packed_rows(0, rows, dealt(rows["key"], n_buckets), n_buckets)
            if len(found):
                yield packed_rows(1, found, dealt(found["doc"].astype(np.uint64), n_buckets), n_buckets)

        for batch in batches:
            for doc, tag, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingles(lower_words(raw.as_py()), hashes)
                if len(s) < LEAST:
                    continue
                ids.append(doc)
                tags.append(tag)
                held.append(s)
                size += len(s)
                if size >= chunk:
                    yield from flush()
                    ids, tags, held, size = [], [], [], 0
        if held:
            yield from flush()

    def joined(table: pa.Table) -> pa.Table:
        parts = {0: [], 1: []}
        for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist()):
            parts[kind].append(np.frombuffer(data, LINK if kind else WINDOW))
        out, left = list(parts[1]), []
        if parts[0]:
            found, left = met(np.concatenate(parts[0]))
            out.append(found)
        out = [x for x in out if len(x)]
        return pa.table({"x": pa.array([None] * len(out) + [x.tobytes() for x, _ in left], pa.binary()), "y": pa.array([x.tobytes() for x in out] + [y.tobytes() for _, y in left], pa.binary())})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = x.as_py(), y.as_py()
                if x is None:
                    parts = [np.frombuffer(y, LINK)]
                else:
                    parts = tiled(np.frombuffer(x, WINDOW), np.frombuffer(y, WINDOW), x != y)
                for found in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(found[n].astype(np.int64 if n in ("doc", "rep") else np.int32)) for n in LINK.names], list(LINK.names))

    packed = documents(docs).mapInArrow(run, "bucket int, kind int, data binary").groupBy("bucket").applyInArrow(joined, "x binary, y binary")
    return packed.repartition(n_buckets).mapInArrow(compared, LINKS)


def covered(spans: list[dict], enough: int) -> list[tuple[int, int]]:
    """The interval join of two documents' links: each stretch that a sure link or `enough` functions cover."""
    events = sorted([(s["lo"], 0, s["fn"]) for s in spans] + [(s["hi"] + 1, -1, s["fn"]) for s in spans], key=lambda e: (e[0], e[1]))
    count, out, open_at = {}, [], None
    for at, kind, fn in events:
        count[fn] = count.get(fn, 0) + (1 if kind == 0 else -1)
        live = sum(v > 0 and (enough if k >= SURE else 1) for k, v in count.items())
        if live >= enough and open_at is None:
            open_at = at
        elif live < enough and open_at is not None:
            out.append((open_at, at - 1))
            open_at = None
    merged: list[list[int]] = []
    for lo, hi in out:
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [(lo, hi) for lo, hi in merged]


def clusters(spans: list[dict], lo: int, hi: int) -> list[list[int]]:
    """The shifts of the links that touch lo..hi, those within GAP of each other together."""
    shifts = sorted({s["shift"] for s in spans if s["lo"] <= hi and s["hi"] >= lo})
    cuts = [i for i in range(1, len(shifts)) if shifts[i] - shifts[i - 1] > GAP]
    return [shifts[i:j] for i, j in zip([0, *cuts], [*cuts, len(shifts)])] if shifts else []


def uncovered(lo: int, hi: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of lo..hi between and beside the stretches found that are longer than two gaps."""
    out, at = [], lo
    for s, e in sorted(found):
        if s - at > 2 * GAP:
            out.append((at, s - 1))
        at = max(at, e + 1)
    return [*out, (at, hi)] if hi + 1 - at > 2 * GAP else out


def runs(hit: np.ndarray) -> list[np.ndarray]:
    if not len(hit):
        return []
    cuts = (np.flatnonzero(np.diff(hit) > GAP) + 1).tolist()
    return [hit[i:j] for i, j in zip([0, *cuts], [*cuts, len(hit)])]


def counterpart(own: np.ndarray, b: np.ndarray, start: int, end: int, shifts: list[int]) -> tuple[float, int, int]:
    """(similarity, first, last): the stretch of b, near start..end moved by the shifts, that is most like the sorted distinct
    shingles `own`. Stretches are ranked by counts that take a shingle's first place near there for its only one; the best
    is then counted exactly."""
    lo, hi = max(0, start + shifts[0] - GAP), min(len(b) - 1, end + shifts[-1] + GAP)
    near = b[lo : hi + 1]
    at = np.minimum(np.searchsorted(own, near), len(own) - 1)
    shared = own[at] == near
    theirs = np.flatnonzero(shared)
    if not len(theirs):
        return 0.0, 0, -1
    fresh = np.zeros(len(near) + 1, np.int64)
    fresh[1:][np.unique(near, return_index=True)[1]] = 1
    both = np.concatenate(([0], np.cumsum(fresh[1:] * shared)))
    fresh = np.cumsum(fresh)
    cuts = np.flatnonzero(np.diff(theirs) > GAP)
    edges = [(theirs[0], theirs[-1]), *zip(theirs[np.concatenate(([0], cuts + 1))], theirs[np.append(cuts, -1)])]
    for first, last in [(start + shifts[0] - GAP, end + shifts[-1] + GAP), *((start + x, end + x) for x in shifts)]:
        i, j = np.searchsorted(theirs, (first - lo, last - lo + 1))
        if i < j:
            edges.append((theirs[i], theirs[j - 1]))
    p, q = np.array(edges).T
    common = both[q + 1] - both[p]
    best = int(np.argmax(common / (len(own) + fresh[q + 1] - fresh[p] - common)))
    p, q = int(p[best]), int(q[best])
    there = np.unique(near[p : q + 1])
    common = len(np.intersect1d(own, there, assume_unique=True))
    return common / (len(own) + len(there) - common), lo + p, lo + q


def aligned(a: np.ndarray, b: np.ndarray, lo: int, hi: int, shift: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(start, end, partner's start, partner's end, similarity), in shingles, of the stretches of a at lo..hi that are
    passages at one shift."""
    start = max(lo - MARGIN, -shift, 0)
    end = min(hi + MARGIN, len(b) - 1 - shift, len(a) - 1)
    out = []
    for part in runs(np.flatnonzero(a[start : end + 1] == b[start + shift : end + 1 + shift]) + start):
        s, e = int(part[0]), int(part[-1])
        if e - s + 1 < LEAST:
            continue
        jaccard = 1.0
        if len(part) < e - s + 1:
            mine, theirs = np.unique(a[s : e + 1]), np.unique(b[s + shift : e + 1 + shift])
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            jaccard = both / (len(mine) + len(theirs) - both)
        if jaccard >= similarity:
            out.append((s, e, s + shift, e + shift, jaccard))
    return out


def searched(a: np.ndarray, b: np.ndarray, lo: int, hi: int, shifts: list[int], similarity: float) -> list[tuple[int, int, int, int, float]]:
    """The same for stretches of one whose shingles stand anywhere near the shifts in the other."""
    lo, hi = max(0, lo - MARGIN), min(len(a) - 1, hi + MARGIN)
    r_lo, r_hi = max(0, lo + shifts[0] - GAP), min(len(b) - 1, hi + shifts[-1] + GAP)
    there = np.sort(b[r_lo : r_hi + 1])
    if not len(there):
        return []
    mine = a[lo : hi + 1]
    stack = [(part, False) for part in runs(np.flatnonzero(there[np.minimum(np.searchsorted(there, mine), len(there) - 1)] == mine) + lo)]
    out = []
    while stack:
        part, at_shift = stack.pop()
        s, e = int(part[0]), int(part[-1])
        if e - s + 1 < LEAST:
            continue
        own = np.unique(a[s : e + 1])
        # What isn't anywhere there can't be in common: most stretches with too many changes end here.
        jaccard, p, q = counterpart(own, b, s, e, shifts) if len(part) >= similarity * len(own) else (0.0, 0, -1)
        if jaccard >= similarity:
            out.append((s, e, p, q, jaccard))
            continue
        if len(gaps := np.diff(part)) and gaps.max() > 1:
            cut = int(np.argmax(gaps)) + 1  # part it at its widest gap and look again
            stack += [(part[cut:], at_shift), (part[:cut], at_shift)]
        if not at_shift:  # some of it stands elsewhere in b: look at what stands at one shift
            for x in shifts:
                i = np.arange(max(s, -x), min(e, len(b) - 1 - x) + 1)
                stack += [(one, True) for one in runs(i[a[i] == b[i + x]])]
    return out


def passages(a: np.ndarray, b: np.ndarray, spans: list[dict], enough: int = ENOUGH, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(start, end, rep start, rep end, similarity), in words, of the verified passages of a that stand in b.

    First what stands at a shift with no other near it; what that leaves uncovered is searched, shifts within GAP of each
    other together, against the stretch of b that fits best, so that what repeats near or far in b does not widen it.
    """
    out: list[tuple[int, int, int, int, float]] = []
    for lo, hi in covered(spans, enough):
        found = [p for shifts in clusters(spans, lo, hi) if len(shifts) == 1 for p in aligned(a, b, lo, hi, shifts[0], similarity)]
        for s, e in uncovered(lo, hi, [p[:2] for p in found]):
            s, e = max(lo, s - LEAST), min(hi, e + LEAST)
            left = [(s, e)]
            for shifts in sorted(clusters(spans, s, e), key=len, reverse=True):
                if left:
                    found += searched(a, b, s, e, shifts, similarity)
                    left = uncovered(s, e, [p[:2] for p in found])
        out += found
    return sorted({(s, e + WIDTH, p, q + WIDTH, j) for s, e, p, q, j in out})


def anchors(s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it counts, number of the run) for each place of the texts that stand end to end in s. Of runs of one shingle
    the first counts and every SIDE-th from the end."""
    same = np.concatenate((s[1:] == s[:-1], [False]))  # as the next one
    same[starts[1:] - 1] = False
    ends, at = np.flatnonzero(~same), np.arange(len(s))
    first = ~np.concatenate(([False], same[:-1]))
    return first | ((np.repeat(ends, np.diff(ends, prepend=-1)) - at) % SIDE == 0), np.cumsum(first)


def places(s: np.ndarray, starts: np.ndarray, docs: np.ndarray, tags: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The rows of places m of texts that stand end to end in s. Beyond a text's ends there are zeros."""
    out, seq = np.empty(len(m), PLACE), np.searchsorted(starts, m, "right") - 1
    out["key"], out["doc"], out["tag"], out["m"] = s[m], docs[seq], tags[seq], m - starts[seq]
    low, high, byte = starts[seq], np.append(starts[1:], len(s))[seq], (s >> np.uint64(40)).astype(np.uint8) | np.uint8(1)
    for k in range(2 * LEAST - 1):
        at = m + (k - LEAST + 1)
        there = (at >= low) & (at < high)
        out["near"][:, k] = np.where(there, byte[np.where(there, at, 0)], 0)
    return out


def opened(s: np.ndarray, doc: int, tag: int, found: list[tuple[int, int]]) -> np.ndarray:
    """The minima of a text's windows that stand in none of its passages (words)."""
    start, free = np.zeros(1, np.int64), np.ones(len(s), bool)
    for a, b in found:
        free[a : b - WIDTH + 1] = False
    if not free.any():
        return np.empty(0, PLACE)
    m = np.unique(np.concatenate([windows(mix(s + np.uint64((f + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)), start)[1] for f in range(HASHES)]))
    counts, run = anchors(s, start)
    m = np.flatnonzero(counts & np.isin(run, run[m[free[m]]]))
    return places(s, start, np.array([doc]), np.array([tag & 0xFFFFFFFF]), m)


def repeated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each place of x and each stretch of LEAST shingles through it a link to the smallest document that has it in y."""
    rows = np.concatenate([y, x])
    rows = rows[np.argsort(rows["doc"], kind="stable")]
    base = 0x9E3779B97F4A7C15
    power, back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * LEAST - 1, v, np.uint64)))) for v in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(rows["near"] * power[:-1], axis=1, dtype=np.uint64)], axis=1)
    ends = np.cumsum(np.concatenate([np.zeros((len(rows), 1), np.int64), rows["near"] == 0], axis=1), axis=1)
    out = []
    for k in range(LEAST):
        whole = np.flatnonzero(ends[:, k + LEAST] == ends[:, k])
        group = mix((sums[whole, k + LEAST] - sums[whole, k]) * back[k] + mix(rows["key"][whole]))
        i, j = whole, whole[firsts(group)]
        keep = rows["doc"][i] != rows["doc"][j]
        p, q = rows[i[keep]], rows[j[keep]]
        link, m = np.zeros(len(p), LINK), p["m"].astype(np.int64) - (LEAST - 1 - k)
        for name, value in (("doc", p["doc"]), ("rep", q["doc"]), ("tag", p["tag"]), ("rep_tag", q["tag"]), ("lo", m), ("hi", m + LEAST - 1), ("shift", q["m"].astype(np.int64) - p["m"].astype(np.int64)), ("fn", SURE)):
            link[name] = value
        out.append(link)
    return np.concatenate(out)


def joined_spans(link: np.ndarray) -> np.ndarray:
    """Links of two texts at one shift that overlap or touch as one."""
    link = link[np.lexsort((link["lo"], link["shift"], link["rep_tag"], link["rep"], link["tag"], link["doc"]))]
    if len(link) < 2:
        return link
    new = np.concatenate(([True], link["lo"][1:].astype(np.int64) > link["hi"][:-1].astype(np.int64) + 1))
    for name in ("doc", "tag", "rep", "rep_tag", "shift"):
        new[1:] |= link[name][1:] != link[name][:-1]
    first = np.flatnonzero(new)
    out = link[first]
    out["hi"] = np.maximum.reduceat(link["hi"], first)
    return out


def _slots(number: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(number)
    return x >> np.uint64(64 - bits), mix(x) >> np.uint64(64 - bits)


def marked(df: DataFrame, number: Column, n: int) -> np.ndarray:
    """A filter of at least BITS bits for each of n numbers (long), two of which a number sets."""
    bits = max(15, (BITS * n).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_slots(batch.column(0).to_numpy().view(np.uint64), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 12), pa.array(at & 4095)], ["part", "at"])

    def packed(table: pa.Table) -> pa.Table:
        own = np.zeros(4096, bool)
        own[table["at"].to_numpy()] = True
        return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    out = np.zeros((1 << bits - 12, 512), np.uint8)
    for part, own in df.select(number.alias("number")).mapInArrow(run, "part long, at long").groupBy("part").applyInArrow(packed, "part long, bits binary").collect():
        out[part] = np.frombuffer(own, np.uint8)
    return out.ravel()


def may_be(known: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Whether numbers are in a filter; of the others few are taken for it."""
    out = np.ones(len(number), bool)
    for at in _slots(number, len(known).bit_length() + 2):
        out &= (known[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return out


def further_links(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The links of the second look, as links(). windows: column window, PLACE rows of the places that are open."""
    n_buckets, spark = buckets(docs), docs.sparkSession
    keys = spark.sparkContext.broadcast(marked(windows.select(F.explode("keys").alias("key")), F.col("key"), windows.agg(F.sum(F.size("keys"))).first()[0] or 0))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), PLACE)
                yield packed_rows(1, rows, dealt(rows["key"], n_buckets), n_buckets)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids, tags, texts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            s, starts = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
            m = np.flatnonzero(may_be(keys.value, s) & anchors(s, starts)[0])
            rows = places(s, starts, np.array(ids, np.int64), np.array(tags, np.int32).view(np.uint32), m)
            return packed_rows(0, rows, dealt(rows["key"], n_buckets), n_buckets)

        for batch in batches:
            for doc, tag, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingles(lower_words(raw.as_py()), hashes)
                if len(s) < LEAST:
                    continue
                ids.append(doc)
                tags.append(tag)
                texts.append(s)
                size += len(s)
                if size >= CHUNK // 4:
                    yield flush()
                    ids, tags, texts, size = [], [], [], 0
        if texts:
            yield flush()

    def met_again(table: pa.Table) -> pa.Table:
        y, x = (np.concatenate([np.frombuffer(d, PLACE) for k, d in zip(table["kind"].to_pylist(), table["data"].to_pylist()) if k == kind] or [np.empty(0, PLACE)]) for kind in (0, 1))
        found = repeated(x, y[np.isin(y["key"], x["key"])])
        # What stands in the links is asked for by a place of x.
        asked = np.unique(x[["doc", "tag"]])
        found = joined_spans(found[np.isin(found[["doc", "tag"]], asked)])
        return pa.table({n: pa.array(found[n].astype(np.int64 if n in ("doc", "rep") else np.int32)) for n in LINK.names})

    kind = "bucket int, kind int, data binary"
    return windows.select("window").mapInArrow(asked, kind).unionAll(documents(docs).mapInArrow(held, kind)).groupBy("bucket").applyInArrow(met_again, LINKS)


PASSAGES = "doc_id long, start_word long, end_word long, rep_doc_id long, rep_start_word long, rep_end_word long, similarity double, tag int"
#: What is verified of a text, and its places that are open, with their keys.
VERIFIED = PASSAGES + ", window binary, keys array<long>"


def tagged_passages(docs: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """repeated_passages() with the tag of the text that a row's places belong to."""
    texts = documents(docs).dropDuplicates(["doc", "tag"])
    first = stored(verified_links(gathered(links(docs), enough), texts, enough, True), "passages")
    windows = first.where("window is not null").select("window", "keys")
    found = gathered(further_links(docs, windows), 1)
    ends = found.select(F.explode(F.array("doc", "rep")).alias("doc"))
    known = docs.sparkSession.sparkContext.broadcast(marked(ends, F.col("doc"), ends.count()))

    @F.pandas_udf("boolean")
    def meant(doc: pd.Series) -> pd.Series:
        return pd.Series(may_be(known.value, doc.to_numpy(np.int64).view(np.uint64)))

    more = verified_links(found, documents(docs).where(meant("doc")).dropDuplicates(["doc", "tag"]), 1, False)
    columns = [c.split()[0] for c in PASSAGES.split(", ")]
    return first.where("window is null").select(columns).unionAll(more.select(columns)).distinct()


def gathered(found: DataFrame, enough: int) -> DataFrame:
    """The links of two texts together, as far as they are enough."""
    found = found.groupBy("doc", "rep", "tag", "rep_tag").agg(F.collect_set(F.struct("lo", "hi", "shift", "fn")).alias("spans"))
    return stored(found.where((F.size(F.array_distinct(F.transform("spans", lambda s: s["fn"]))) >= enough) | F.exists("spans", lambda s: s["fn"] >= SURE)), "passage-links")


def verified_links(found: DataFrame, texts: DataFrame, enough: int, look: bool) -> DataFrame:
    """The passages of gathered links; look: and a row with the places of a text that are open."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text of the representative becomes the shingles around the spans."""
        hashes, last, s = WordHashes(), None, None
        for batch in batches:
            rep, tag, raw, spans = batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(5), batch.column(4)
            flat, starts = spans.flatten(), spans.offsets.to_numpy()[:-1] - spans.offsets[0].as_py()
            lo, hi, shift = (flat.field(n).to_numpy().astype(np.int64) for n in ("lo", "hi", "shift"))
            room = MARGIN + 2 * GAP
            first, end = np.maximum(0, np.minimum.reduceat(lo + shift, starts) - room), np.maximum.reduceat(hi + shift, starts) + room + 1
            parts = []
            for i, key in enumerate(zip(rep, tag)):
                if key != last:
                    last, s = key, shingles(lower_words(raw[i].as_py()), hashes)
                parts.append(s[first[i] : end[i]].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first), pa.array(parts, pa.binary())], ["doc", "rep", "tag", "rep_tag", "spans", "first", "part"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, s = WordHashes(), None, None
        covering: list[tuple[int, int]] = []
        names = [x.split()[0] for x in VERIFIED.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.float64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

        def left() -> list[tuple]:
            own = opened(s, *last, covering) if look and len(s) else ()
            return [(last[0], *[None] * 6, last[1], own.tobytes(), own["key"].view(np.int64).tolist())] if len(own) else []

        for batch in batches:
            out = []
            doc, rep, tags, spans, first, parts = (batch.column(i).to_pylist() for i in range(6))
            for i, key in enumerate(zip(doc, tags)):
                if key != last:
                    out += left() if last else []
                    covering = []
                    last, s = key, shingles(lower_words(batch.column(6)[i].as_py()), hashes)
                own = [x | {"shift": x["shift"] - first[i]} for x in spans[i]]
                for a, b, c, d, j in passages(s, np.frombuffer(parts[i], np.uint64), own, enough):
                    out.append((doc[i], a, b, rep[i], c + first[i], d + first[i], j, tags[i], None, None))
                    covering += [(a, b)] if look else []
            yield rows(out)
        if last:
            yield rows(left())

    near = found.join(texts.select(F.col("doc").alias("rep"), F.col("tag").alias("rep_tag"), "text"), ["rep", "rep_tag"]).select("doc", "rep", "tag", "rep_tag", "spans", "text")
    cut = near.mapInArrow(sliced, T.StructType([*near.schema.fields[:5], T.StructField("first", T.LongType()), T.StructField("part", T.BinaryType())]))
    both = cut.join(texts, ["doc", "tag"]).select("doc", "rep", "tag", "spans", "first", "part", "text")
    return both.mapInArrow(verified, VERIFIED)


def repeated_passages(docs: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """A row for each passage of 50 words or more of a document that stands, with similarity 0.8 or more, in one with a
    smaller id: doc_id, start_word, end_word (words from 0, end exclusive), rep_doc_id, rep_start_word, rep_end_word,
    similarity. A passage in many documents gives a row for each but the first of them, not one for each pair.

    Words are runs of anything but the six ASCII blanks, A-Z lower-cased. Null ids, null and short texts have no rows;
    ids must be integers. Rows that repeat an id and a text count as one document; rows that repeat an id with other
    texts are compared each, but not with one another. Repeats within one document don't count. An empty table gives no
    rows; other columns are ignored.
    """
    return tagged_passages(docs, enough).drop("tag").distinct()


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (start, end); what stands between two left words stays as it was."""
    words = [m.span() for m in _WORD.finditer(raw)]
    gone = np.zeros(len(words) + 1, bool)
    for a, b in spans:
        gone[a : min(b, len(words))] = True
    out, at = [], 0
    for i in np.flatnonzero(gone[:-1] & ~np.concatenate(([False], gone[:-2]))).tolist():
        j = i + int(np.argmax(~gone[i:]))
        out.append(raw[at : words[i][0]])
        at = words[j][0] if j < len(words) else words[-1][1]
    return b"".join([*out, raw[at:]])


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs with their repeated passages cut out of the text (and n_chars set to fit); documents of which
    nothing but white space is left go. The copy in the smallest id stays. Rows that repeat an id are cut each by the
    passages of its own text; null ids and null texts stay as they are."""
    gone = tagged_passages(docs).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            left = [x if s is None or x is None else without(x.encode(), [(y["start_word"], y["end_word"]) for y in s]).decode() for x, s in zip(texts, spans)]
            keep = pa.array([i for i, (x, s) in enumerate(zip(left, spans)) if s is None or x is None or x.strip()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), pa.array(left, pa.string()).take(keep)], ["row", "text"])

    rest = [F.col(c) for c in docs.columns if c != "text"]
    # The text travels beside the row, so no column of docs can clash with a name of this stage.
    rows = docs.select(F.struct(*rest).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), tagged(F.col("text").cast("string")).alias("tag"))
    marked = rows.join(gone, ["doc_id", "tag"], "left").select("row", "spans", "text")
    left = marked.mapInArrow(run, T.StructType([marked.schema["row"], T.StructField("text", T.StringType())]))
    n_chars = lambda c: F.coalesce(F.length("text").cast(docs.schema[c].dataType), F.col("row")[c])
    return left.select(*[F.col("text") if c == "text" else (n_chars(c) if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])
