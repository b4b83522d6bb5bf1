"""Language-model scoring with a log-frequency Bloom filter.

An n-gram with quantised count level q (1 + floor(2 log2 count)) is entered at levels 1 to q; probing goes upwards until
the first miss. The model backs off from two words to one with absolute discounting, all counts as the filter gives them:

    P(w | h) = max(c(h w) - D, 0) / c(h) + a(h) P(w),    P(w) = (c(w) + 1) / (N + V + 1),    a(h) = D T(h) / c(h)

T(h): the number of different words after h. a(h) is in the filter too, at levels of a quarter bit.

A filter of everything that was counted grows with the corpus, so it is not broadcast: it lies in blocks, one for each
bucket of the hash space, of BITS bits an entered level whatever the size of the corpus, and the probes go to the blocks.
Texts are cut into chunks of about CHUNK tokens, kept once in the shared folder as the chunk's distinct words, the most
frequent first, and each token's number among them, compressed.

To learn, a chunk sends each bucket one packed row of the distinct pairs of its learning texts with their counts (so an
n-gram that is in every text is one entry of a chunk). The bucket adds them up, makes its block, and forgets keys and sums;
back to the chunks go bits alone: one of the chunks that hold a pair is named its owner, so that T(h) is a sum over chunks.
Words then go to their buckets with counts and T, and give blocks as well; of words the exact counts are kept beside, for the
base. The stored blocks are the model (Model), and any texts can be scored by it.

To score, a chunk sends each bucket its distinct pairs and words, they are probed in the stored blocks, and the levels come
back to the chunk, which scores its texts.

Pairs are told apart by 40 bits of hash within a bucket, words by 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import buckets, crc_mod, mix, read, stored

DISCOUNT = 0.75
BITS = 10
PROBES = 4
#: No word hashes to these by design of the hash; they stand for the start and the end of a text.
START, END = np.uint64(0x5374617274), np.uint64(0x456E64)
#: Tokens of a chunk, and texts that a task takes up at a time.
CHUNK, BATCH = 2_000_000, 500
#: Kinds of filter entries: words, pairs of words, back-off levels of contexts.
WORDS, PAIRS, BACKOFF = 1, 2, 3
#: Levels end below this, in a byte's reach.
HIGHEST = 128


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths): of each text the start mark, its words' hashes, and the end mark, end to end."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(words).dictionary_encode()
    held = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in held), np.uint64, len(held))
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = np.fromiter((w != "" for w in held), bool, len(held))[at]  # blanks at a text's ends leave empty words
    owner = np.repeat(np.arange(len(size)), size)[full]
    lengths = np.bincount(owner, minlength=len(size)) + 2
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    out, inner = np.empty(int(lengths.sum()), np.uint64), np.ones(int(lengths.sum()), bool)
    out[starts], out[starts + lengths - 1] = START, END
    inner[starts], inner[starts + lengths - 1] = False, False
    out[inner] = hashes[at[full]]
    return out, lengths


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) ^ mix(right + np.uint64(0xD1B54A32D192ED03)))


def levels(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, 1 + np.floor(2 * np.log2(np.maximum(c, 1)) + 1e-9), 0).astype(np.int64)


def expected(q: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; 0 for none."""
    low, high = np.ceil(np.exp2((q - 1) / 2) - 1e-9), np.ceil(np.exp2(q / 2) - 1e-9) - 1
    return np.where(q > 0, (low + np.maximum(low, high)) / 2, 0.0)


def backoff_levels(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """a(h) in quarter bits, at most 32."""
    a = np.clip(DISCOUNT * t / np.maximum(c, 1), 2.0**-8, 1.0)
    return np.where(c > 0, np.rint(-4 * np.log2(a)), 0).astype(np.int64)


class Block:
    """One bucket's part of the log-frequency Bloom filter."""

    def __init__(self, entered: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS):
        """entered: (kind, keys, levels)."""
        self.bits = np.zeros(8 * max(8, sum(int(q.sum()) for _, _, q in entered) * bits // 8), bool)
        for kind, keys, q in entered:
            keys, q, level = self.entry(kind, keys)[q > 0], q[q > 0], 1
            while len(keys):
                for probe in range(PROBES):
                    self.bits[self.place(keys, level, probe)] = True
                level += 1
                keys, q = keys[q >= level], q[q >= level]

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> Block:
        block = cls.__new__(cls)
        block.bits = np.unpackbits(np.frombuffer(raw, np.uint8)).view(bool)
        return block

    @staticmethod
    def entry(kind: int, keys: np.ndarray) -> np.ndarray:
        """Kinds share the block; their keys must not."""
        return mix(keys ^ np.uint64(kind * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))

    def place(self, keys: np.ndarray, level: int, probe: int) -> np.ndarray:
        return (mix(keys + np.uint64((level * 64 + probe) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(len(self.bits))).astype(np.int64)

    def level(self, kind: int, keys: np.ndarray) -> np.ndarray:
        found, keys = np.zeros(len(keys), np.int64), self.entry(kind, keys)
        live, level = np.arange(len(keys)), 1
        while len(live) and level < HIGHEST:
            for probe in range(PROBES):
                live = live[self.bits[self.place(keys[live], level, probe)]]
            found[live] = level
            level += 1
        return found


def grouped(bucket: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, from, to) of each that has entries."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    return order, [(b, int(edges[b]), int(edges[b + 1])) for b in np.flatnonzero(np.diff(edges)).tolist()]


def five(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unfive(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def few(c: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each, which is what most take, and the large ones as (place, count) apart."""
    large = np.flatnonzero(c > 255)
    return np.minimum(c, 255).astype(np.uint8).tobytes(), np.stack([large, c[large]], 1).astype("<i8").tobytes()


def unfew(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    at = np.frombuffer(large, "<i8").reshape(-1, 2)
    out[at[:, 0]] = at[:, 1]
    return out


CHUNKED = "learn binary, lengths binary, words binary, low binary, middle binary, high binary"


def chunks(docs: DataFrame, train: Column, size: int) -> DataFrame:
    """chunk, ids, and packed: whether each text learns, its tokens with both marks, the chunk's distinct token hashes, and
    each token's number among them, a compressed plane for each byte: the numbers of frequent words are small."""
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("learn"))
    kind = source.schema["doc_id"].dataType
    names = ["chunk", "ids", *_names(CHUNKED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, held, tokens = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            ids, learn = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
            words, number, n = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            number = rank[number]
            packed = [learn.to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), np.concatenate([h[3] for h in held]).astype("<u4").tobytes(), words[order].astype("<u8").tobytes()]
            packed += [zipped((number >> shift & 0xFF).astype(np.uint8)) for shift in (0, 8, 16)]
            rows = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), rows, *(pa.array([x], pa.binary()) for x in packed)], names)

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                held.append((batch.column(0), batch.column(2), *token_hashes(batch.column(1))))
                tokens += len(held[-1][2])
                if tokens >= size:
                    yield flush()
                    k, held, tokens = k + 1, [], 0
        if held:
            yield flush()

    return source.mapInArrow(run, T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *T._parse_datatype_string(CHUNKED).fields]))


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def zipped(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def unzipped(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n, "zstd", asbytes=True), np.uint8)


class Chunk:
    """A row of chunks(): numbers of the tokens, and the distinct pairs of numbers that follow each other in a text."""

    def __init__(self, row: dict):
        self.learn, self.lengths = np.frombuffer(row["learn"], np.uint8) > 0, np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.words = np.frombuffer(row["words"], "<u8")
        n = int(self.lengths.sum())
        self.number = np.zeros(n, np.int64)
        for shift, plane in enumerate(("low", "middle", "high")):
            self.number |= unzipped(row[plane], n).astype(np.int64) << 8 * shift
        self.learns = np.repeat(self.learn, self.lengths)  # by token
        self.first = np.zeros(len(self.number), bool)
        self.first[np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)] = True

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs as left * words + right, of each token that isn't a text's first its pair, keys)."""
        inner = np.flatnonzero(~self.first)
        pairs, of = np.unique(self.number[inner - 1] * len(self.words) + self.number[inner], return_inverse=True)
        return pairs, of, pair_keys(self.words[pairs // len(self.words)], self.words[pairs % len(self.words)])


class Dealt:
    """What of a chunk lies in which bucket, to put a bucket's answers back in the chunk's order."""

    def __init__(self, keys: np.ndarray, n_buckets: int):
        self.order, self.cuts = grouped(bucket_of(keys, n_buckets), n_buckets)

    def back(self, of: dict[int, np.ndarray]) -> np.ndarray:
        out = np.empty(len(self.order), np.int64)
        for b, i, j in self.cuts:
            out[self.order[i:j]] = of[b]
        return out


def counted_pairs(x: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, keys, counts) of the chunk's pairs that its learning texts hold."""
    pairs, of, keys = x.pairs()
    c = np.bincount(of, x.learns[~x.first], len(pairs)).astype(np.int64)
    return pairs[c > 0], keys[c > 0], c[c > 0]


def summed(keys: list[np.ndarray], *c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, of each entry its number among them, sums of each count)."""
    distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, of, [np.rint(np.bincount(of, np.concatenate(x), len(distinct))).astype(np.int64) for x in c]


PAIR_BLOCKS = "chunk long, bucket int, owned binary, bits binary"


def pair_blocks(parts: DataFrame, n_buckets: int, bits: int) -> DataFrame:
    """chunk, bucket, owned: a bit for each counted pair of a chunk in a bucket, whether the chunk owns it; and for each
    bucket a row without a chunk, with the bits of its block."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, keys, c = counted_pairs(Chunk(row))
                order, own = grouped(bucket_of(keys, n_buckets), n_buckets)
                keys, c = keys[order], c[order]
                counts = [few(c[a:b]) for _, a, b in own]
                columns = [pa.array([row["chunk"]] * len(own), pa.int64()), pa.array([b for b, _, _ in own], pa.int32()), pa.array([five(keys[a:b]) for _, a, b in own], pa.binary()), *(pa.array([y[i] for y in counts], pa.binary()) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "keys", "small", "large"])

    def entered(table: pa.Table) -> pa.Table:
        keys = [unfive(x) for x in table["keys"].to_pylist()]
        distinct, of, (sums,) = summed(keys, [unfew(x, y) for x, y in zip(table["small"].to_pylist(), table["large"].to_pylist())])
        owner = np.zeros(len(of), bool)
        owner[np.unique(of, return_index=True)[1]] = True  # the first that counts a pair
        owned = [np.packbits(x).tobytes() for x in np.split(owner, np.cumsum([len(k) for k in keys])[:-1])]
        block = Block([(PAIRS, distinct, levels(sums))], bits).packed()
        bucket = table["bucket"][0].as_py()
        columns = [pa.array([*table["chunk"].to_pylist(), None], pa.int64()), pa.array([bucket] * (len(keys) + 1), pa.int32()), pa.array([*owned, None], pa.binary()), pa.array([None] * len(keys) + [block], pa.binary())]
        return pa.Table.from_arrays(columns, _names(PAIR_BLOCKS))

    rows = parts.select("chunk", *_names(CHUNKED)).mapInArrow(sent, "chunk long, bucket int, keys binary, small binary, large binary")
    return rows.groupBy("bucket").applyInArrow(entered, PAIR_BLOCKS)


WORD_ROWS = "chunk long, bucket int, keys binary, c binary, c_large binary, t binary, t_large binary"


def word_rows(parts: DataFrame, owned: DataFrame, n_buckets: int) -> DataFrame:
    """chunk, bucket, and packed: the words of a chunk's learning texts, their counts there, and how many of the pairs that
    they begin the chunk owns."""

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        x = Chunk(left.to_pylist()[0])
        pairs, keys, _ = counted_pairs(x)
        dealt, got = Dealt(keys, n_buckets), {r["bucket"]: np.frombuffer(r["owned"], np.uint8) for r in right.to_pylist()}
        own = dealt.back({b: np.unpackbits(got[b], count=j - i) for b, i, j in dealt.cuts}) > 0
        t = np.bincount(pairs[own] // len(x.words), minlength=len(x.words))
        c = np.bincount(x.number[x.learns], minlength=len(x.words))
        known = np.flatnonzero(c)
        dealt = Dealt(x.words[known], n_buckets)
        places = [known[dealt.order[i:j]] for _, i, j in dealt.cuts]
        packed = [(x.words[o].tobytes(), *few(c[o]), *few(t[o])) for o in places]
        columns = [pa.array([left["chunk"][0].as_py()] * len(places), pa.int64()), pa.array([b for b, _, _ in dealt.cuts], pa.int32()), *(pa.array([p[i] for p in packed], pa.binary()) for i in range(5))]
        return pa.Table.from_arrays(columns, _names(WORD_ROWS))

    return parts.select("chunk", *_names(CHUNKED)).groupBy("chunk").cogroup(owned.groupBy("chunk")).applyInArrow(rows, WORD_ROWS)


BLOCKS = "bucket int, kind int, bits binary, keys binary, c binary, c_large binary, total long, words long"


def word_blocks(rows: DataFrame, bits: int) -> DataFrame:
    """A row of BLOCKS for each bucket of words: the filter's bits for counts and back-off, and the exact counts for the base."""

    def entered(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        keys, _, (c, t) = summed([np.frombuffer(r["keys"], "<u8") for r in sent], [unfew(r["c"], r["c_large"]) for r in sent], [unfew(r["t"], r["t_large"]) for r in sent])
        block = Block([(WORDS, keys, levels(c)), (BACKOFF, keys, backoff_levels(c, t))], bits).packed()
        inside = keys != START
        row = [sent[0]["bucket"], WORDS, block, keys.tobytes(), *few(c), int(c[inside].sum()), int(inside.sum())]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK_TYPES)], BLOCK_TYPES.names)

    return rows.groupBy("bucket").applyInArrow(entered, BLOCKS)


BLOCK_TYPES = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in BLOCKS.split(", "))])


@dataclass(frozen=True)
class Model:
    """What was learned: the filter's blocks (BLOCKS), by hash range, and the totals of the learning texts."""

    blocks: DataFrame
    n_buckets: int
    tokens: int
    words: int


def fit(parts: DataFrame, n_buckets: int, bits: int = BITS) -> Model:
    """The model of the learning texts of chunks()."""
    pairs = stored(pair_blocks(parts, n_buckets, bits), "lm-pairs")
    words = stored(word_blocks(word_rows(parts, pairs.where("chunk is not null").select("chunk", "bucket", "owned"), n_buckets), bits), "lm-words")
    size = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()
    blocks = pairs.where("chunk is null").select("bucket", F.lit(PAIRS).alias("kind"), "bits").unionByName(words, allowMissingColumns=True)
    return Model(blocks, n_buckets, size["n"], size["v"])


PROBED = "chunk long, bucket int, pairs binary, words binary"
ANSWERS = "chunk long, bucket int, pairs binary, c binary, c_large binary, q binary, b binary"


def answers(parts: DataFrame, model: Model) -> DataFrame:
    """chunk, bucket, and packed: the levels of a chunk's pairs and words in a bucket, and the words' exact counts."""
    n_buckets = model.n_buckets

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = Chunk(row)
                keys, raw = x.pairs()[2], {}
                for column, values, pack in ((0, keys, five), (1, x.words, np.ndarray.tobytes)):
                    dealt = Dealt(values, n_buckets)
                    for b, i, j in dealt.cuts:
                        raw.setdefault(b, [b"", b""])[column] = pack(values[dealt.order[i:j]])
                columns = [pa.array([row["chunk"]] * len(raw), pa.int64()), pa.array(list(raw), pa.int32()), *(pa.array([y[i] for y in raw.values()], pa.binary()) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, _names(PROBED))

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        blocks = {r["kind"]: r for r in held.to_pylist()}
        filters = {kind: Block.unpacked(r["bits"]) for kind, r in blocks.items()}
        level = lambda at, kind, keys: filters[at].level(kind, keys).astype(np.uint8) if at in filters else np.zeros(len(keys), np.uint8)
        known, count = np.empty(0, np.uint64), np.empty(0, np.int64)
        if WORDS in blocks:
            known, count = np.frombuffer(blocks[WORDS]["keys"], "<u8"), unfew(blocks[WORDS]["c"], blocks[WORDS]["c_large"])
        out = []
        for chunk, bucket, raw, words in zip(*(asked[n].to_pylist() for n in _names(PROBED))):
            keys, words = unfive(raw), np.frombuffer(words, "<u8")
            at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
            c = np.where(known[at] == words, count[at], 0) if len(known) else np.zeros(len(words), np.int64)
            out.append((chunk, bucket, zipped(level(PAIRS, PAIRS, keys)), *few(c), zipped(level(WORDS, WORDS, words)), zipped(level(WORDS, BACKOFF, words))))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], _names(ANSWERS))

    asked = parts.select("chunk", *_names(CHUNKED)).mapInArrow(probes, PROBED)
    held = model.blocks.select("bucket", "kind", "bits", "keys", "c", "c_large")
    return asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(answer, ANSWERS)


def scored(parts: DataFrame, model: Model) -> DataFrame:
    """What score() returns, of the texts of chunks(), whether they learn or not."""
    n_buckets, denominator = model.n_buckets, float(model.tokens + model.words + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        x = Chunk(left.to_pylist()[0])
        _, of, keys = x.pairs()
        got = {r["bucket"]: r for r in right.to_pylist()}
        dealt = Dealt(keys, n_buckets)
        both = expected(dealt.back({b: unzipped(got[b]["pairs"], j - i) for b, i, j in dealt.cuts}))[of]
        dealt = Dealt(x.words, n_buckets)
        exact = dealt.back({b: unfew(got[b]["c"], got[b]["c_large"]) for b, _, _ in dealt.cuts})
        c, back = expected(dealt.back({b: unzipped(got[b]["q"], j - i) for b, i, j in dealt.cuts})), dealt.back({b: unzipped(got[b]["b"], j - i) for b, i, j in dealt.cuts})
        inner = np.flatnonzero(~x.first)
        ahead, here, known = x.number[inner - 1], x.number[inner], exact[x.number]
        a = np.where(c[ahead] > 0, np.exp2(-back[ahead] / 4), 1.0)
        logs, base = np.zeros(len(x.number)), np.log10((known + 1) / denominator)
        logs[inner] = np.log10(np.maximum(np.minimum(both, c[ahead]) - DISCOUNT, 0) / np.maximum(c[ahead], 1) + a * (c[here] + 1) / denominator)
        base[x.first] = 0
        starts = np.flatnonzero(x.first)
        columns = [pa.array(x.lengths - 1), pa.array(np.add.reduceat(((known > 0) & ~x.first).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))]
        return pa.Table.from_arrays([pc.list_flatten(left["ids"]).combine_chunks(), *columns], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    schema = T.StructType([T.StructField("doc_id", parts.schema["ids"].dataType.elementType), *T._parse_datatype_string("n_tokens long, n_known long, base_score double, score double").fields])
    rows = parts.groupBy("chunk").cogroup(answers(parts, model).groupBy("chunk")).applyInArrow(finish, schema)
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def learned(docs: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> Model:
    """A model of all texts of docs, to score others with (score_with). Null texts are empty; an empty table gives a model of
    nothing, by which every token's probability is 1."""
    return fit(stored(chunks(docs, F.lit(True), chunk), "lm-chunks"), buckets(docs), bits)


def score_with(model: Model, docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The columns of score() for every row of docs, by a model that is there already."""
    return scored(stored(chunks(docs, F.lit(False), chunk), "lm-chunks"), model)


def score(docs: DataFrame, train: Column, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs; learns from the rows where train holds.

    Null texts are empty: one token, the end. With no training row at all N = V = 0, so every token's probability is 1.
    Repeated rows are each scored; null ids stay null; other columns drop; an empty table gives no rows. `chunk` is a size
    of work and changes no result.
    """
    parts = stored(chunks(docs, train, chunk), "lm-chunks")
    return scored(parts, fit(parts, buckets(docs), bits))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 7) == 2
    rows = score(read(spark, sf_dir, "documents"), ~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
