"""Lexical retrieval packing: sequences of related documents with next to no padding.

Every document becomes token ids and an end id. What fills whole sequences is cut off first; the rests are dealt to
partitions by range of a content signature (the least hash of a document's rarer ids), so that likely neighbours meet,
and a partition is worked off in shards of `SHARD` documents. A shard has a BM25 inverted index over token ids, with
document frequencies counted over the whole corpus (an array as long as the tokenizer's vocabulary). The first unused
document is the seed; the index returns its unused neighbours, best first, and they fill the window one after another.
The one that no longer fits is cut: its head closes the sequence and its tail stays in the pool. A sequence that a shard
leaves open goes on with the next shard, so a partition pads one sequence at most.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import mix, read, stored

LENGTH = 2048
END = 1
SHARD = 1500
K1, B = 1.2, 0.75
MEMO = 600_000
#: Bytes of a part that goes through the batch merge, and of one that the memo keeps.
LONGEST = 64
#: Small Latin letters in UTF-8, which lower-casing and composing leave as they are: one token run. The apostrophe is
#: not among the marks that may follow, as it begins runs of its own.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_LETTERS = r"\A[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+\z"
_MARKS = "".join(map(chr, [*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merger:
    """The tokenizer's merges for many words at once: a row of symbols for each word, and in each round the pair of
    least rank of every row is merged, the leftmost of equals, until no row has a pair with a rank."""

    def __init__(self, definition: str):
        model = json.loads(definition)["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        # The byte alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.inner = np.array([vocabulary.get(letters[b], 0) for b in range(256)], np.int64)
        self.last = np.array([vocabulary.get(letters[b] + suffix, 0) for b in range(256)], np.int64)
        pairs = [(vocabulary[a] << 16 | vocabulary[b], rank, vocabulary[a + b]) for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        key, rank, self.made = (np.array(x, np.int64) for x in zip(*pairs))
        # An open table of pairs: slots by hash, the next free one where it is taken.
        self.mask, self.none = (1 << 18) - 1, 1 << 30
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, self.none, np.int64)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            _, first = np.unique(slot[left], return_index=True)
            won = left[first[self.keys[slot[left][first]] < 0]]
            self.keys[slot[won]], self.ranks[slot[won]] = key[won], rank[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B1) >> 15) & self.mask

    def rank(self, key: np.ndarray) -> np.ndarray:
        out, slot = np.full(key.shape, self.none, np.int64), self._slot(key)
        held = self.keys[slot]
        hit = held == key
        out[hit] = self.ranks[slot[hit]]
        live = np.nonzero(~hit & (held >= 0))
        at = slot[live]
        while len(at):
            at = (at + 1) & self.mask
            held, k = self.keys[at], key[live]
            hit = held == k
            out[tuple(x[hit] for x in live)] = self.ranks[at[hit]]
            go = ~hit & (held >= 0)
            live, at = tuple(x[go] for x in live), at[go]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids (unsigned 16-bit) of words that are one run of letters each."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            for i in range(0, len(own), 20_000):
                part = own[i : i + 20_000]
                raw = np.frombuffer(b"".join([words[j] for j in part]), np.uint8).reshape(-1, n)
                ids, count = self._merged(np.concatenate([self.inner[raw[:, :-1]], self.last[raw[:, -1:]]], axis=1))
                data = ids.astype("<u2").tobytes()
                for j, at, c in zip(part.tolist(), range(0, len(data), 2 * n), count.tolist()):
                    out[j] = data[at : at + 2 * c]
        return out

    def _merged(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.full(len(ids), ids.shape[1])
        done, live = ids.copy(), np.arange(len(ids))
        ranks = self.rank(ids[:, :-1] << 16 | ids[:, 1:]) if ids.shape[1] > 1 else np.empty((len(ids), 0), np.int64)
        while ids.shape[1] > 1 and len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(ids)), at]
            go = best < self.none
            done[live[~go], : ids.shape[1]] = ids[~go]
            ids, ranks, live, at, best = ids[go], ranks[go], live[go], at[go], best[go]
            if not len(live):
                break
            rows, place = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
            ids[rows, at] = self.made[best]
            ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
            count[live] -= 1
            # Only the pairs next to the merge are new; the gap at a row's end has symbol -1, which has no pair.
            place = place[:-1]
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), axis=1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < ids.shape[1] - 1))
                ranks[ok, side[ok]] = self.rank(ids[ok, side[ok]] << 16 | ids[ok, side[ok] + 1])
        done[live, : ids.shape[1]] = ids
        return done, count


class Tokens:
    """Ids of texts as little-endian unsigned 16-bit integers, by a bounded memo of parts of lower-cased words (between ASCII blanks).

    The tokenizer drops white space and no token spans it, so a text's ids are its words' ids in a row. It lower-cases
    anyway. Marks after letters are a run of their own, so "word," is "word" and ",". Arrow splits a batch into distinct
    words and those into distinct parts, and puts their ids in a row; only distinct parts pass through Python.
    """

    def __init__(self, definition: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.memo, self.known = Tokenizer.from_str(definition), memo, {}
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.merger = Merger(definition)

    def parts(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts of words."""
        fresh = list(filterfalse(self.known.__contains__, parts))
        letters = [x for x in fresh if 0 < len(x) <= LONGEST and ((x.isalpha() and x.islower()) or _PLAIN.fullmatch(x))]
        ids = {b"": b"", **dict(zip(letters, self.merger.encode(letters)))}
        rest = [x for x in fresh if x not in ids]
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            ids.update((x, np.array(e.ids, "<u2").tobytes()) for x, e in zip(part, self.batch([x.decode() for x in part], add_special_tokens=False)))
        known = self.known
        out = [ids[x] if x in ids else known[x] for x in parts]
        if len(known) + len(ids) > self.memo:
            known.clear()
        known.update(ids if not rest else ((x, y) for x, y in ids.items() if len(x) <= LONGEST))  # long parts are rare: so the memo is bounded in bytes, too
        return out

    def words(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words. A word is cut in two where marks follow its letters: by one more offset into its bytes."""
        words = words.cast(pa.large_string())
        heads, edges = pc.ascii_rtrim(words, characters=_MARKS), np.zeros(2 * len(words) + 1, np.int64)
        edges[2::2] = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False))
        plain = pc.match_substring_regex(heads, _LETTERS).to_numpy(zero_copy_only=False)
        edges[1::2] = np.where(plain, edges[:-1:2] + pc.binary_length(heads).to_numpy(zero_copy_only=False), edges[2::2])
        edges += np.frombuffer(words.buffers()[1], np.int64)[words.offset] if len(words) else 0
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.tobytes()), words.buffers()[2]]).dictionary_encode()
        ids = pa.array(self.parts(parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.frombuffer(ids.buffers()[1], np.int64)[: len(edges) : 2].tobytes()), ids.buffers()[2]])

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """Ids of each text (no nulls), and the end id after them."""
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pc.match_substring(texts, "<|"), "", texts) if len(special) else texts))
        coded, offsets = pc.list_flatten(words).dictionary_encode(), np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))))
        tail = b"" if end is None else np.array([end], "<u2").tobytes()
        each = pa.concat_arrays([self.words(coded.dictionary), pa.array([tail], pa.large_binary())])
        at = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets[1:], len(each) - 1)
        rows = each.take(pa.array(at))
        edges = np.frombuffer(rows.buffers()[1], np.int64)[: len(rows) + 1][offsets + np.arange(len(offsets))]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(edges.tobytes()), rows.buffers()[2]])
        if len(special):  # may hold a special token, which is told apart by case
            own = out.to_pylist()
            for i in special.tolist():
                own[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u2").tobytes() + tail
            out = pa.array(own, pa.large_binary())
        return out.cast(pa.binary())


_held: dict[str, Tokens] = {}


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary, unsigned 16-bit, the end id last) of every row; a null text is empty."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(definition), hashlib.md5(definition.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _held:
            _held.clear()
            _held[key] = Tokens(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                yield pa.RecordBatch.from_arrays([batch.column(0), _held[key].encode(batch.column(1), END)], ["doc_id", "ids"])

    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("ids", T.BinaryType())]))


def frequencies(ids: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency by token id (16-bit ids: at most 65,536 rows come back), documents, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(1 << 16, np.int64), 0, 0
        mark = np.zeros(1 << 16, bool)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                x = np.frombuffer(x, "<u2")
                mark[x] = True
                own = np.flatnonzero(mark)
                mark[own] = False
                df[own] += 1
                n, total = n + 1, total + len(x)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [n, total]))], ["token", "n"])

    rows = ids.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    got = {r["token"]: r["n"] for r in rows}
    df = np.zeros(1 << 16, np.int64)
    for token, n in got.items():
        if token >= 0:
            df[token] = n
    return df, got.get(-1, 0), got.get(-2, 0)


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def full_pieces(ids: DataFrame, length: int) -> DataFrame:
    """The pieces that fill a sequence each. Odd sequence ids, so that they never meet those of the rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, base = 0, TaskContext.get().partitionId() << 34
        for batch in batches:
            rows, out = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                x = np.frombuffer(x, "<u2")
                for start in range(0, len(x) - length + 1, length):
                    rows.append(i)
                    out.append((start, length, crc(x[start : start + length]), len(x), 2 * (base + k) + 1, 0))
                    k += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array([r[c] for r in out], pa.int64()) for c in range(6))], ["doc_id", *PIECE_NAMES])

    return ids.where(F.length("ids") >= 2 * length).mapInArrow(run, _schema(ids))


PIECE_NAMES = [x.split()[0] for x in PIECE.split(", ")]


def _schema(ids: DataFrame) -> T.StructType:
    return T.StructType([ids.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in PIECE_NAMES)])


class Shard:
    """A BM25 index over documents given as arrays of ids."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        owner, ids = np.repeat(np.arange(len(docs)), [len(x) for x in docs]), np.concatenate(docs).astype(np.int64)
        pairs, tf = np.unique(ids * len(docs) + owner, return_counts=True)
        self.term, self.doc = pairs // len(docs), (pairs % len(docs)).astype(np.int32)
        self.n, long = len(docs), np.array([len(x) for x in docs])[self.doc]
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * long / mean))
        # A query is all distinct terms of its document.
        self.query = np.split(self.term[np.argsort(self.doc, kind="stable")], np.cumsum(np.bincount(self.doc, minlength=self.n))[:-1])
        self.indexed = self.n
        self._edges()

    def _edges(self) -> None:
        self.edges = np.searchsorted(self.term, np.arange((1 << 16) + 1))

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, by BM25 of its whole text, best first; ties by place."""
        return np.fromiter(self.best(seed, free), np.int64)

    def best(self, seed: int, free: np.ndarray, first: int = 32) -> Iterator[int]:
        """The neighbours one by one: a window takes few of them, so those behind the first are sorted when asked for."""
        if 2 * (left := int(free.sum())) < self.indexed:  # used documents leave the index
            keep = free[self.doc]
            self.term, self.doc, self.weight, self.indexed = self.term[keep], self.doc[keep], self.weight[keep], left
            self._edges()
        start, size = self.edges[self.query[seed]], self.edges[self.query[seed] + 1] - self.edges[self.query[seed]]
        at = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        found = np.flatnonzero((score > 0) & free)
        least = -score[found]
        near = least <= (np.partition(least, first)[first] if len(least) > first else 0)
        for part in (near, ~near):
            yield from found[part][np.argsort(least[part], kind="stable")].tolist()


def _packer(idf: np.ndarray, mean: float, length: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 34, 0
        room = length  # of the open sequence

        def pack(rows: list[tuple]) -> Iterator[tuple]:
            nonlocal k, room
            docs = [np.frombuffer(r[2], "<u2") for r in rows]
            index = Shard(docs, idf, mean)
            free, done = np.ones(len(docs), bool), np.zeros(len(docs), np.int64)
            at = 0

            def put(i: int) -> Iterator[tuple]:
                nonlocal k, room
                n = min(room, len(docs[i]) - int(done[i]))
                x = docs[i][done[i] : done[i] + n]
                yield (rows[i][0], rows[i][1] + int(done[i]), n, crc(x), rows[i][3], 2 * (base + k), length - room)
                done[i] += n
                room -= n
                free[i] = done[i] < len(docs[i])
                if not room:
                    k, room = k + 1, length

            while True:
                while at < len(docs) and not free[at]:
                    at += 1
                if at == len(docs):
                    break
                seed, own = at, k
                yield from put(seed)
                if k != own:
                    continue
                for i in index.best(seed, free):
                    yield from put(i)
                    if k != own:
                        break

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            out = list(pack(rows))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), *(pa.array([r[c] for r in out], pa.int64()) for c in range(1, 7))], ["doc_id", *PIECE_NAMES])

        held: list[tuple] = []
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            held += zip(*(batch.column(i).to_pylist() for i in range(4)))
            while len(held) >= shard:
                yield emit(held[:shard])
                del held[:shard]
        if held:
            yield emit(held)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: the pieces of all rows' ids, each id in one.

    Null and empty texts have one token, the end. Repeated rows are packed each; null ids are kept; an empty table gives
    no rows; other columns are ignored. Sequences are padded to `length` by the reader (unless a power of two long).
    """
    ids = stored(tokenized(docs, tokenizer or default_tokenizer()), "packing-ids")
    df, n, total = frequencies(ids)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    # The signature's hash by id: common ids come last, so they decide only where there are no others.
    order = (mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(2)).astype(np.int64) | np.where(df <= max(1, n // 20), 0, 1 << 62)

    def signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                x = np.frombuffer(x, "<u2")
                start = len(x) // length * length
                rows.append((start, x[start:].tobytes(), len(x), int(order[x[start:]].min()) if start < len(x) else 0))
            keep = [i for i, r in enumerate(rows) if r[1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), *(pa.array([rows[i][c] for i in keep], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64())))],
                ["doc_id", "start", "rest", "doc_tokens", "sig"],
            )

    fields = [ids.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("rest", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sig", T.LongType())]
    rests = ids.mapInArrow(signature, T.StructType(fields))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ids.rdd.getNumPartitions())
    tie = F.xxhash64("doc_id", "start", "rest")
    dealt = rests.withColumn("tie", tie).repartitionByRange(parts, "sig", "tie").sortWithinPartitions("sig", "tie").select("doc_id", "start", "rest", "doc_tokens")
    packed = dealt.mapInArrow(_packer(idf, max(1.0, total / max(1, n)), length, shard), _schema(ids))
    return full_pieces(ids, length).unionAll(packed)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def packed_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all rows of docs."""
    return pack(docs)
