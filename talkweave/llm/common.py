"""What several operators of this subpackage share: scratch tables, word hashing, bucket counts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: CRC-32 in DuckDB: its table, made from the polynomial, to be selected AS t; and the sum of {text}.
CRC_TABLE_SQL = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
CRC_SQL = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a folder of our own only on one machine, where it is unset."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = known or tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def buckets(df: DataFrame) -> int:
    """How many hash buckets to deal packed rows to: follows the input, so that a bucket keeps its size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.rdd.getNumPartitions())


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


class WordHashes(dict):
    """word (bytes) -> XXH64; emptied when it holds `limit` words, so memory stays bounded."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64 over an array of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_words(raw: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; bytes.split() splits at exactly the six blanks of SPACE."""
    return raw.lower().split() if raw else []
