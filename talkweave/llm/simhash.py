"""SimHash near-dedup with pivot distance tables.

Every document gets a 64-bit fingerprint of its 4-word shingles. Documents with one fingerprint are one node. Two
fingerprints that differ in at most 4 bits agree in all bits of at least two out of six blocks, so the fingerprints are
dealt out once for each of the 15 pairs of blocks, by the bits of the two; a key's fingerprints are compared with each
other only (the number of blocks grows with the number of fingerprints, which keeps the groups small; no pair is lost
at any number). Within a group the pivot table decides: the Hamming distances of each fingerprint to 16 reference
fingerprints. A pair whose distances to some reference differ by more than 4 can't be within 4 bits (triangle
inequality) and is discarded; the survivors are verified on the bits. A task gives back no pairs but the links of a
spanning forest of its group, so a group of thousands of near copies yields thousands of links and not millions.
A group above `GROUP` rows is cut into chunks, and each pair of chunks is a group of its own.

The pipeline's stage asks for a similarity of 0.8, at which 64 bits differ in 10 at the mean: as many as blocks of bits
can't tell from chance. It takes 256 bits of five-word shingles, whose differing share is the angle between two sets, and
deals the fingerprints out by keys of random bits, as many as a pair at that similarity needs to agree in one. The radius is
two standard deviations wider than such a pair's mean, so that few are missed, and what is within it is verified: the
texts of both ends are read again, and the Jaccard similarity of their shingles decides. First a fingerprint's likeliest
links are, which join most of what belongs together; then all other pairs within the radius whose ends these have not
joined. So what a component is does not depend on which links were tried first. Those other pairs may be as many as the
square of a group's size, so no task gives them back: documents that links of fingerprints connect and verified ones
don't meet with their shingles, and pairs are verified where they are found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import WordHashes, lower_words, mix, read, stored
from talkweave.llm.components import DEALS, components, least_names
from talkweave.llm.substring_dedup import shingles

BITS = 4
SHINGLE = 4
GROUP = 30_000
#: Reference fingerprints: SplitMix64 of 1 to 16.
PIVOTS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(raw: bytes | None, width: int = SHINGLE) -> int:
    words = lower_words(raw)
    if not words:
        return 0
    n = len(words)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(n - width + 1, 1)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(text[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[min(width, n) - 1 :].tolist())], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; null texts count as empty, whose fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, width) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    source = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("fp", T.LongType())]))


def masks(n: int, bits: int) -> list[int]:
    """The masks of all choices of `n_blocks - bits` blocks; one of them is equal in any two that differ in `bits` bits.

    Six blocks (keys of about 21 bits) serve some million fingerprints; one block more for each factor of 64 beyond.
    """
    blocks = bits + 2
    while blocks < bits + 5 and n > 1 << (64 * (blocks - bits) // blocks + 1):
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, blocks - bits)]


class Forest:
    """Union-find over places of an array; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def group_links(fp: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest (places) of the links among a group's fingerprints."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    low = np.searchsorted(table[:, 0], table[:, 0] - bits)
    forest = Forest(len(fp))
    label = np.arange(len(fp))
    for i in range(1, len(fp)):
        a = int(low[i])
        near = np.flatnonzero(label[a:i] != label[i]) + a  # already joined: nothing to learn
        for c in range(0, table.shape[1], 4):  # pivots in fours: few pairs reach the later ones
            near = near[(np.abs(table[near, c : c + 4] - table[i, c : c + 4]) <= bits).all(axis=1)]
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= bits]
        for tree in np.unique(label[near]):
            j = int(near[np.argmax(label[near] == tree)])
            forest.join(i, j)
            label[label == tree] = label[i]
    return [(int(order[i]), int(order[j])) for i, j in forest.links]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key columns, fp) sorted by key -> links. Small groups are compared by shifts over the whole batch."""

    def flush(part: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        new = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        out, small = [], sizes[group] <= 48
        fp, g = part[small], group[small]
        table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
        for s in range(1, 48):
            i = np.flatnonzero(g[s:] == g[:-s]) if len(g) > s else np.empty(0, np.int64)
            if not len(i):
                break
            i = i[(np.abs(table[i] - table[i + s]) <= BITS).all(axis=1)]
            i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= BITS]
            out.append(np.stack([fp[i], fp[i + s]]))
        starts = np.flatnonzero(new)
        for k in np.flatnonzero(sizes > 48):
            own = part[starts[k] : starts[k] + sizes[k]]
            if links := group_links(own):
                out.append(own[np.array(links).T])
        return out

    rest_fp, rest_key = np.empty(0, np.uint64), np.empty((0, 4), np.int64)

    def emit(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found:
            x = np.concatenate(found, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], ["u", "v"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        fp = np.concatenate([rest_fp, cols[4].view(np.uint64)])
        key = np.concatenate([rest_key, np.stack(cols[:4], axis=1)])
        if not len(fp):
            continue
        cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
        yield from emit(flush(fp[:cut], key[:cut]) if cut else [])
        rest_fp, rest_key = fp[cut:], key[cut:]  # the last group may go on; a group has at most 2 * GROUP rows or so
    yield from emit(flush(rest_fp, rest_key) if len(rest_fp) else [])


def fingerprint_links(distinct: DataFrame, n: int, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """u, v: links that connect all fingerprints (column fp, distinct) within `bits` bits of each other."""
    choice = masks(n, bits)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(choice)])).alias("x")).select("x.c", "x.key", "fp")
    return _dealt(keyed, group, ["fp"]).mapInArrow(_linked, "u long, v long")


def _dealt(keyed: DataFrame, group: int, carried: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Rows in order of their group (c, key, a, b): a key with more than `group` rows (or of that size: c, key, n) is cut into
    chunks, and each pair of chunks (a, b) is a group of its own."""
    large = (keyed.groupBy("c", "key").agg(F.count("*").alias("n")) if sizes is None else sizes).where(F.col("n") > group).select("c", "key", F.ceil(F.col("n") / (group // 2)).cast("long").alias("chunks"))
    marked = keyed.join(large, ["c", "key"], "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("chunks")), F.lit(0).cast("long")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda o: F.struct(F.least(o, "chunk").alias("a"), F.greatest(o, "chunk").alias("b")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    dealt = marked.select("c", "key", F.explode(F.when(F.col("chunks").isNull(), whole).otherwise(others)).alias("p"), *carried).select("c", "key", "p.a", "p.b", *carried)
    return dealt.repartition("c", "key", "a", "b").sortWithinPartitions("c", "key", "a", "b", "fp")


def named(fps: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """fps with component_id: the smallest id (least) of all nodes of a row's component."""
    return fps.join(least_names(nodes.select(F.col("fp").alias("node"), "least"), roots).withColumnRenamed("node", "fp"), "fp")


def near_duplicates(docs: DataFrame, bits: int = BITS, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links, itself included) for each row of docs.

    Null and empty texts share fingerprint 0 and are linked like any other. A null doc_id gets its component's id, null
    if none of the component has one. Repeated rows are repeated. An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, width), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    n = nodes.count()
    roots = components(fingerprint_links(nodes.select("fp"), n, bits))
    return named(fps, nodes, roots).select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near duplicates by similarity


def wide_fingerprint(raw: bytes | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """256 bits as four unsigned longs, each bit the majority over the distinct shingles; no words: zero."""
    words = lower_words(raw)
    if not words:
        return np.zeros(4, np.uint64)
    distinct = np.unique(shingles(words, hashes, min(width, len(words))))
    out = []
    for plane in range(4):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(distinct), 1 << 16):
            h = mix(distinct[i : i + (1 << 16)] ^ np.uint64((plane + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(distinct), bitorder="little").view("<u8")[0])
    return np.array(out, np.uint64)


def likely_differ(similarity: float) -> float:
    """The share of bits that two fingerprints of sets with this Jaccard similarity differ in: their angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables(n: int, similarity: float, miss: float = 0.03) -> list[np.ndarray]:
    """Places of the bits of each key: so many bits that chance pairs stay few at n fingerprints, and so many keys that a
    pair at the similarity agrees in one of them with probability 1 - miss."""
    bits = 12 + max(0, math.ceil(math.log2(max(1, n) / 65_536)))
    same = (1 - likely_differ(similarity)) ** bits
    rng = np.random.default_rng(7)
    return [np.sort(rng.permutation(256)[:bits]) for _ in range(math.ceil(math.log(miss) / math.log1p(-same)))]


#: Bytes of shingles in a block of the second look.
BLOCK = 32 << 20
#: Standard deviations that a link's bits may differ in above the mean at the similarity, before it is verified.
WIDER = 2.0


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _wide(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Batches sorted by their first four columns, cut so that each group lies in one: the group of a row, where groups
    start, the batch."""
    held: list[pa.RecordBatch] = []
    last = None

    def joined() -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
        batch = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = keys(batch)
        new = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))
        return np.cumsum(new) - 1, np.flatnonzero(new), batch

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], axis=1)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = keys(batch)
        if held and (key[0] != last).any():
            yield joined()
            held = []
        other = np.flatnonzero((key != key[-1]).any(axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            held.append(batch.slice(0, cut))
            yield joined()
            held = []
        held.append(batch.slice(cut))
        last = key[-1]
    if held:
        yield joined()


def _links(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def _similar(radius: int):
    """Batches of (c, key, a, b, node, bits), sorted by key -> links of nodes within the radius: in small groups of each
    with the nearest two and the first before it, in large ones with the nearest and the first of each tree so far; and what
    connects all that lie within the radius of each other."""
    pivots = np.stack([mix(np.arange(k, k + 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (1, 9)])

    def small(x: np.ndarray, group: np.ndarray) -> np.ndarray:
        table = np.stack([_apart(x, p) for p in pivots], 1)
        found = [np.empty((3, 0), np.int64)]
        for s in range(1, 48):
            i = np.flatnonzero(group[s:] == group[:-s]) if len(group) > s else np.empty(0, np.int64)
            if not len(i):
                break
            i = i[(np.abs(table[i] - table[i + s]) <= radius).all(axis=1)]
            d = _apart(x[i], x[i + s])
            found.append(np.stack([i + s, i, d])[:, d <= radius])
        j, i, d = np.concatenate(found, axis=1)
        # The two nearest before it, and the first: an estimate may be wrong about one of them.
        near = np.lexsort((i, d, j))
        first = np.flatnonzero(np.diff(j[near], prepend=-1))
        second = first[:-1] + 1 if len(first) else first
        second = np.append(second, first[-1] + 1) if len(first) else second
        second = second[second < len(near)]
        second = second[j[near[second]] == j[near[second - 1]]]
        chosen = np.concatenate([near[first], near[second], (order := np.lexsort((i, j)))[np.unique(j[order], return_index=True)[1]]])
        links, forest = np.unique(np.stack([j, i])[:, chosen], axis=1), Forest(len(x))
        for u, v in links.T.tolist():
            forest.join(u, v)
        joined, root = len(forest.links), np.array([forest.root(k) for k in range(len(x))], np.int64)
        for u, v in zip(*(part[root[i] != root[j]].tolist() for part in (j, i))):
            forest.join(u, v)
        return np.concatenate([links, np.array(forest.links[joined:], np.int64).reshape(-1, 2).T], axis=1)

    def large(x: np.ndarray) -> np.ndarray:
        table, label, out = np.stack([_apart(x, p) for p in pivots], 1), np.arange(len(x)), []
        for i in range(1, len(x)):
            near = np.flatnonzero(label[:i] != label[i])
            near = near[(np.abs(table[near] - table[i]) <= radius).all(axis=1)]
            d = _apart(x[near], x[i])
            near, d = near[d <= radius], d[d <= radius]
            for tree in np.unique(label[near]):
                own = np.flatnonzero(label[near] == tree)
                out += [(i, int(near[k])) for k in {int(own[0]), int(own[np.argmin(d[own])])}]
                label[label == tree] = label[i]
        return np.array(out, np.int64).reshape(-1, 2).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, starts, batch in _whole_groups(batches):
            node, x, sizes = batch.column(4).to_numpy(zero_copy_only=False), _wide(batch.column(5)), np.bincount(group)
            few = np.flatnonzero((sizes[group] <= 48) & (sizes[group] > 1))
            pairs = [few[small(x[few], group[few])]] + [starts[k] + large(x[starts[k] : starts[k] + sizes[k]]) for k in np.flatnonzero(sizes > 48)]
            yield _links(node[np.concatenate(pairs, axis=1)])

    return run


def _alike(radius: int, similarity: float):
    """Batches of (c, key, a, b, node, bits, tree, chunk, grams), sorted by key -> a spanning forest, over the trees of each
    group, of the pairs within the radius whose grams have the similarity."""

    def links(x: np.ndarray, label: np.ndarray, chunk: np.ndarray, grams: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.fromiter(map(len, grams), np.int64, len(grams))
        ends = np.cumsum(size)
        names, flat = np.unique(np.concatenate(grams), return_inverse=True)
        mark, found, own = np.zeros(len(names), np.int64), [], (chunk == chunk[0]).all()
        for i in range(1, len(x)):
            near = np.flatnonzero((label[:i] != label[i]) & (own | (chunk[:i] != chunk[i])))
            near = near[_apart(x[near], x[i]) <= radius]
            near = near[np.minimum(size[near], size[i]) >= similarity * np.maximum(size[near], size[i])]
            if not len(near):
                continue
            mark[flat[ends[i] - size[i] : ends[i]]] = 1
            to = np.cumsum(size[near])
            sums = np.concatenate(([0], np.cumsum(mark[flat[np.repeat(ends[near] - to, size[near]) + np.arange(to[-1])]])))
            mark[flat[ends[i] - size[i] : ends[i]]] = 0
            both = sums[to] - sums[to - size[near]]
            near = near[both >= similarity * (size[near] + size[i] - both)]
            for t in np.unique(label[near]).tolist():
                found.append((i, int(near[np.argmax(label[near] == t)])))
                label[label == t] = label[i]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, starts, batch in _whole_groups(batches):
            node, tree, chunk = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in (4, 6, 7))
            x, pairs = _wide(batch.column(5)), []
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
                if (tree[at:end] != tree[at]).any():
                    grams = [np.frombuffer(g, "<u8") for g in batch.column(8).slice(at, end - at).to_pylist()]
                    pairs += [(at + i, at + j) for i, j in links(x[at:end], tree[at:end], chunk[at:end], grams)]
            yield _links(node[np.array(pairs, np.int64).reshape(-1, 2).T])

    return run


def radius_at(similarity: float) -> int:
    differ = likely_differ(similarity)
    return int(256 * differ + WIDER * math.sqrt(256 * differ * (1 - differ)))


def similar_links(nodes: DataFrame, n: int, similarity: float, group: int = GROUP) -> DataFrame:
    """u, v: links of nodes (fp, bits) whose fingerprints say that they may be so similar: to be verified. Each node has a few,
    and they connect all nodes that share a key and are within the radius."""
    places = tables(n, similarity)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 32), axis=1, bitorder="little")
            for c, at in enumerate(places):
                key = bits[:, at].astype(np.int64) @ (1 << np.arange(len(at), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), c, np.int32)), pa.array(key), *batch.columns], ["c", "key", "fp", "bits"])

    keyed = nodes.select("fp", "bits").mapInArrow(keys, "c int, key long, fp long, bits binary")
    return _dealt(keyed, group, ["fp", "bits"]).mapInArrow(_similar(radius_at(similarity)), "u long, v long").distinct()


def gram_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """fp, grams (sorted hashes of the distinct shingles, unsigned 64-bit) of texts (fp, text). Texts without words have none;
    shorter ones than a shingle are one shingle."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            grams = []
            for raw in batch.column(1).to_pylist():
                words = lower_words(raw)
                grams.append(np.unique(shingles(words, hashes, min(width, len(words)))).tobytes() if words else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], ["fp", "grams"])

    return stored(texts.select("fp", "text").mapInArrow(sets, "fp long, grams binary"), "simhash-grams")


def verified(links: DataFrame, texts: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """The links (u, v) whose nodes' texts (fp, text: one row a node) have a Jaccard similarity of shingles of at least
    `similarity`. Texts without words are alike."""
    return _verified(links, gram_sets(texts, width), similarity)


def _verified(links: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    pairs = links.join(grams.select(F.col("fp").alias("u"), F.col("grams").alias("a")), "u").join(grams.select(F.col("fp").alias("v"), F.col("grams").alias("b")), "v")
    return pairs.select("u", "v", "a", "b").mapInArrow(alike, "u long, v long")


def alike_links(inside: DataFrame, grams: DataFrame, similarity: float, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """u, v: verified links that connect, within each key of inside (key, fp, bits, tree), the trees that have any pair within
    the radius whose grams (fp, grams) have the similarity. A key with more than `group` rows or `block` bytes of grams is
    worked off in pairs of chunks."""
    inside = inside.select(F.lit(0).alias("c"), "key", "fp", "bits", "tree")
    size = F.greatest(F.count("*"), F.ceil(F.sum("bytes") * group / block))
    sizes = inside.join(grams.select("fp", F.length("grams").alias("bytes")), "fp").groupBy("c", "key").agg(size.alias("n"))
    return _dealt(inside.join(grams, "fp"), group, ["fp", "bits", "tree", "chunk", "grams"], sizes).mapInArrow(_alike(radius_at(similarity), similarity), "u long, v long")


def similar_roots(nodes: DataFrame, n: int, similarity: float, texts: Callable[[DataFrame], DataFrame], group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """node, root of nodes (fp, bits), by all links that similar_links() can propose and whose texts have the similarity.
    texts: from a table of fps to their (fp, text).

    The links of each node's likeliest partners are verified first. That one of them fails says nothing of the others, so
    all pairs that these have left in different trees are verified then; within a tree there is nothing to learn. They may
    be as many as the square of a group's rows, so no table holds them: the nodes that links connect, verified or not, meet
    by their common name, each with its grams.
    """
    links = stored(similar_links(nodes, n, similarity, group), "simhash-links")
    grams = gram_sets(texts(links.select(F.explode(F.array("u", "v")).alias("fp")).distinct()))
    roots = stored(components(_verified(links, grams, similarity)), "simhash-roots")
    met = components(links).select(F.col("node").alias("fp"), F.col("root").alias("key"))
    met = stored(met.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "key", F.coalesce("root", "fp").alias("tree")), "simhash-met")
    apart = met.groupBy("key").agg(F.min("tree").alias("least"), F.max("tree").alias("most")).where("least < most")
    # A key may hold a third of all nodes: it is repeated for each of DEALS parts of it.
    deals = apart.select("key", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    inside = met.withColumn("deal", F.pmod(F.xxhash64("fp"), F.lit(DEALS)).cast("int")).join(deals, ["key", "deal"]).join(nodes.select("fp", "bits"), "fp")
    inside = stored(inside.select("key", "fp", "bits", "tree"), "simhash-inside")
    if inside.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(alike_links(inside, grams, similarity, group, block)))


def near_similar(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: near duplicates by the Jaccard similarity of five-word shingles. Fingerprints of 256 bits
    propose links, and miss some 5 % of the pairs that are just at the similarity; the texts decide. Rows as for
    near_duplicates()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            fps = np.array([wide_fingerprint(x, hashes) for x in batch.column(1).to_pylist()], np.uint64).reshape(-1, 4)
            node = mix(fps[:, 0] + mix(fps[:, 1] + mix(fps[:, 2] + mix(fps[:, 3])))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node), pa.array([x.tobytes() for x in fps], pa.binary())], ["doc_id", "digest", "fp", "bits"])

    text = F.col("text").cast("string").cast("binary")
    # A row is found again by its id and a digest of its text: a null id alone would meet all other null ids.
    source = docs.select("doc_id", text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(b""))).alias("digest"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("name")
    kind = T.StructType([source.schema["doc_id"], T.StructField("digest", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bits", T.BinaryType())])
    fps = stored(source.mapInArrow(run, kind), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("bits").alias("bits"), F.min(F.struct("doc_id", "digest")).alias("one"))

    def texts(ends: DataFrame) -> DataFrame:
        ends = ends.join(nodes, "fp").select("fp", F.col("one.digest").alias("digest"), name(F.col("one.doc_id")))
        return ends.join(source.select("digest", name(F.col("doc_id")), "text"), ["digest", "name"]).select("fp", "text").dropDuplicates(["fp"])

    return named(fps, nodes, similar_roots(nodes, nodes.count(), similarity, texts)).select("doc_id", "component_id")


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five-word shingles, similarity 0.8) the rows of the document with
    the smallest id.

    Repeated rows of one doc_id share its fate. A null doc_id stays only if no document of its group has an id.
    """
    found = near_similar(docs)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"))  # so that no column of docs can clash
    return rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
