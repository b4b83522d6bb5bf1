"""Byte-level BPE over a rank file, both ways, as tiktoken's encode_ordinary and decode would give it.

Two tiers. A minimal perfect hash (hash, displace) over the vocabulary resolves a whole pre-token that is itself a
vocabulary entry: one probe, one comparison. Any other pre-token is merged from its bytes: the bytes are a doubly linked
list, the candidate pairs wait in a heap by (rank, place), and a pair that a merge has made stale is skipped when it
surfaces. The hash is built once on the driver; it is as large as the vocabulary file, so broadcasting it is bounded by
that file. Each worker keeps a memo of pre-tokens, emptied when full; long
ones, which seldom come again, are merged each time.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import read

M64 = (1 << 64) - 1
#: Entries of a worker's memo, and the characters of the longest pre-token that it takes up, so that its bytes are bounded.
MEMO, MEMO_CHARS = 400_000, 64


def _scatter(h: int, d: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    return x ^ (x >> 29)


class PerfectHash:
    """bytes -> id for a fixed set of keys, in exactly as many slots as keys.

    Keys fall into buckets by their hash. Large buckets first, a displacement is searched that puts a bucket's keys in
    free slots; a bucket of one key names its slot outright (as -1 - slot).
    """

    def __init__(self, ids: dict[bytes, int]):
        n = self.n = len(ids)
        self.n_buckets = n // 4 + 1
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(self.n_buckets)]
        for key in ids:
            h = xxhash.xxh64_intdigest(key)
            buckets[h % self.n_buckets].append((h, key))
        self.shift = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        free = bytearray(b"\1") * n
        singles = []
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) < 2:
                singles += [(b, *own[0])] if own else []
                continue
            d = 0
            while True:
                slots = {_scatter(h, d) % n for h, _ in own}
                if len(slots) == len(own) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for h, key in own:
                self._put(_scatter(h, d) % n, key, ids[key], free)
        places = iter([s for s in range(n) if free[s]])
        for b, _, key in singles:
            slot = next(places)
            self.shift[b] = -1 - slot
            self._put(slot, key, ids[key], free)

    def _put(self, slot: int, key: bytes, value: int, free: bytearray) -> None:
        self.keys[slot], self.values[slot], free[slot] = key, value, 0

    def find(self, key: bytes) -> int:
        """The key's id, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.n_buckets]
        slot = -1 - d if d < 0 else _scatter(h, d) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


class Vocabulary:
    """A rank file's entries as a perfect hash, and as bytes by id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.hash, self.pattern = PerfectHash(ids), pattern
        self.bytes_of = {i: key for key, i in ids.items()}


class Pairs(dict):
    """left id << 32 | right id -> the id of their joint bytes, or -1; a bounded memo before the perfect hash."""

    def __init__(self, vocabulary: Vocabulary, memo: int):
        super().__init__()
        self.v, self.memo = vocabulary, memo

    def __missing__(self, key: int) -> int:
        if len(self) >= self.memo:
            self.clear()
        found = self[key] = self.v.hash.find(self.v.bytes_of[key >> 32] + self.v.bytes_of[key & 0xFFFFFFFF])
        return found


class Encoder(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO):
        super().__init__()
        self.v, self.memo, self.pairs = vocabulary, memo, Pairs(vocabulary, memo)
        self.byte_ids = [vocabulary.hash.find(bytes([b])) for b in range(256)]
        # regex's \\s and the rank file's library agree on White_Space; Python's re has four control characters more.
        self.any = regex.compile(vocabulary.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ascii = re.compile(vocabulary.pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\S", r"[^\t-\r ]").replace(r"\s", r"[\t-\r ]"))

    def __missing__(self, token: str) -> bytes:
        raw = token.encode()
        whole = self.v.hash.find(raw)
        out = np.array([whole] if whole >= 0 else self.merged(raw), "<u4").tobytes()
        if len(token) <= MEMO_CHARS:
            if len(self) >= self.memo:
                self.clear()
            self[token] = out
        return out

    def merged(self, raw: bytes) -> list[int]:
        pairs, n = self.pairs, len(raw)
        ids = [self.byte_ids[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := pairs[ids[i] << 32 | ids[i + 1]]) >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0 or pairs[ids[i] << 32 | ids[j]] != rank:
                continue  # a merge nearby has made it stale
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pairs[rank << 32 | ids[k]]) >= 0:
                    heapq.heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := pairs[ids[h] << 32 | rank]) >= 0:
                heapq.heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        tokens = (self.ascii if text.isascii() else self.any).findall(text)
        return b"".join(map(self.__getitem__, tokens))


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: One encoder for each running `encode`, kept while its worker process lives, so that its memo serves later tasks.
_encoders: dict[str, Encoder] = {}


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of each row's whole text; a null text is an empty one.

    Rows stay where they are: nothing is shuffled. Repeated rows and null ids are kept as they come; other columns drop.
    """
    shared, job = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if job not in _encoders:
            _encoders.clear()
            _encoders[job] = Encoder(shared.value)
        encoder = _encoders[job]
        for batch in batches:
            ids = [encoder.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    source = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The columns of `encode` and decoded (binary): the bytes that the ids stand for. Null ids decode to nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.bytes_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = shared.value
        for batch in batches:
            out = [b"".join(map(bytes_of.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    vocabulary = default_vocabulary()
    both = decode(encode(read(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
