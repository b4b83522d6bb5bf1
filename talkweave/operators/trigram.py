"""Substring search by a trigram index: posting lists as a table, intersected rarest first, survivors verified.

An index is a folder with three tables. `postings` (slot, gram, field, n, keys): which rows hold a trigram of their lower-cased
text, a list for each batch of rows; written by slot, a hash of the gram, and sorted by gram, so a search opens the folders of
its grams and, in them, the row groups whose range holds the gram. `grams` (slot, gram, n_rows): how common each is. `rows` (part, all columns): the
rows themselves by a hash of their key, so that survivors are read from few folders.

A row that holds a term holds all its trigrams; the reverse isn't so, hence the last look at the text. The result is that
of a scan for every term: one of fewer than three characters has no trigram and is scanned for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.operators import search as S

GRAM = 3
#: Posting lists of a term that are intersected; the others, which are longer, would cost more than they discard.
LISTS = 3
#: Folders of postings and of rows. For large tables: so that a folder holds some hundred MB.
SLOTS = PARTS = 64
#: A gram's postings are dealt over this many files at most, so that no task writes a common gram alone.
SALTS = 8
#: Characters (or one text) of which a task makes lists at a time.
SLICE = 4_000_000


@dataclass(frozen=True)
class Index:
    at: str
    key: str
    fields: tuple[str, ...]
    slots: int
    parts: int
    #: The rows' columns; an empty table leaves no file that tells them.
    columns: T.StructType

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        own = self.columns[self.key].dataType.simpleString()
        schema = {"rows": T.StructType([*self.columns, T.StructField("part", T.IntegerType())]), "postings": f"field string, gram string, n long, keys array<{own}>, slot int", "grams": "gram string, field string, n_rows long, slot int"}
        return spark.read.schema(schema[name]).parquet(f"{self.at}/{name}")


def grams_of(text: Column) -> Column:
    """The distinct trigrams of the lower-cased text; none if it is shorter or null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Pieces of three from each of the first three characters on are all the trigrams, in one pass each: taking them by
    # their places would count the characters before each place anew.
    runs = [F.regexp_extract_all(F.substring(low, k, 2_000_000_000), F.lit("(?s).{%d}" % GRAM), F.lit(0)) for k in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*runs))


def slot_of(gram: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(slots)).cast("int")


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")


def _lists(texts: list[str], first: int = 0) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(grams, ends, places): the distinct trigrams of the texts, and one after the other the places (from `first` on) of the
    texts that hold each. A gram and a text are one number, by the letters that are there, so one sort does it all."""
    point = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    there = np.zeros(0x110000, bool)
    there[point] = True
    letters, n = np.flatnonzero(there), len(texts)
    if n > 1 and len(letters) ** GRAM * n >= 1 << 63:
        yield from _lists(texts[: n // 2], first)
        yield from _lists(texts[n // 2 :], first + n // 2)
        return
    code = (np.cumsum(there) - 1)[point]
    text = np.repeat(np.arange(n), [len(t) for t in texts])
    size = max(len(point) - GRAM + 1, 0)
    gram = np.zeros(size, np.int64)
    for k in range(GRAM):
        gram = gram * len(letters) + code[k : k + size]
    inside = text[:size] == text[GRAM - 1 :] if size else np.zeros(0, bool)  # a gram doesn't reach into the next text
    both = np.sort(gram[inside] * n + text[:size][inside])
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    gram, place = np.divmod(both, max(n, 1))
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
    digits = [letters[gram[starts] // len(letters) ** k % len(letters)] for k in reversed(range(GRAM))] if len(starts) else [[]] * GRAM
    whole = np.stack(digits, axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    yield [whole[i : i + GRAM] for i in range(0, len(whole), GRAM)], np.append(starts, len(gram)), place + first


def lists_of(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """field, gram, n, keys: the n rows of a slice of a batch that hold a gram. A row for each gram and text would be a
    thousand rows for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, field in enumerate(fields):
                texts = [t or "" for t in batch.column(k + 1).to_pylist()]
                size, a = 0, 0
                for b, t in enumerate(texts, 1):
                    size += len(t)
                    if size >= SLICE or b == len(texts):
                        for grams, ends, places in _lists(texts[a:b], a):
                            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), batch.column(0).take(pa.array(places)))
                            yield pa.RecordBatch.from_arrays([pa.array([field] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(np.diff(ends), pa.int64()), keys], ["field", "gram", "n", "keys"])
                        size, a = 0, b

    own = rows.schema[key].dataType.simpleString()
    return rows.select(key, *[F.lower(F.col(f)).alias(f"in_{i}") for i, f in enumerate(fields)]).mapInArrow(run, f"field string, gram string, n long, keys array<{own}>")


def build(df: DataFrame, key: str, fields: Sequence[str], at: str, *, slots: int = SLOTS, parts: int = PARTS) -> Index:
    """Index the text columns `fields` of df into the folder `at`, which must not exist. key: unique, not null; df has no
    columns named slot, part, gram or field."""
    spark = df.sparkSession
    df.withColumn("part", part_of(F.col(key), parts)).repartition("part").sortWithinPartitions("part", key).write.partitionBy("part").parquet(f"{at}/rows")
    index = Index(at, key, tuple(fields), slots, parts, df.schema)
    rows = index.table(spark, "rows")
    postings = lists_of(rows, key, fields).withColumn("slot", slot_of(F.col("gram"), slots)).repartition("slot", F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.lit(SALTS)))
    postings.sortWithinPartitions("slot", "gram", "field").write.partitionBy("slot").parquet(f"{at}/postings")
    counts = index.table(spark, "postings").groupBy("slot", "gram", "field").agg(F.sum("n").alias("n_rows"))
    counts.repartition("slot").sortWithinPartitions("slot", "gram").write.partitionBy("slot").parquet(f"{at}/grams")
    return index


def term_grams(terms: DataFrame, slots: int) -> DataFrame:
    """term, gram, slot of a table of terms (column term); terms without a trigram have no row."""
    return terms.select("term", F.explode(grams_of(F.col("term"))).alias("gram")).withColumn("slot", slot_of(F.col("gram"), slots))


def _one(index: Index, spark: SparkSession, term: str) -> DataFrame:
    """key, part of the candidates of one term: its rarest lists read by literal slots and grams, semi-joined rarest first."""
    found = term_grams(spark.createDataFrame([(term,)], "term string"), index.slots).collect()  # as many as the term has characters
    postings = index.table(spark, "postings")
    own = [(F.col("slot") == g["slot"]) & (F.col("gram") == g["gram"]) for g in found]
    n_rows = index.table(spark, "grams").where(F.col("slot").isin(*{g["slot"] for g in found}) & F.col("gram").isin(*[g["gram"] for g in found]))
    counts = {r["gram"]: r["n"] for r in n_rows.groupBy("gram").agg(F.sum("n_rows").alias("n")).collect()}
    order = sorted(range(len(found)), key=lambda i: (counts.get(found[i]["gram"], 0), found[i]["gram"]))
    held = lambda i: postings.where(own[i]).select("field", F.explode("keys").alias("key"))
    out = held(order[0])
    for i in order[1:LISTS]:
        out = out.join(held(i), ["field", "key"], "left_semi")
    return out.select("key", part_of(F.col("key"), index.parts).alias("part")).distinct()


def holding(index: Index, spark: SparkSession, terms: Iterable[str]) -> DataFrame:
    """The indexed rows of which any field holds any of the terms (ignoring case), each once."""
    terms = list(dict.fromkeys(t for t in terms if t))
    rows = index.table(spark, "rows")
    none = rows.where(F.lit(False)).drop("part")
    if not terms:
        return none
    test = lambda ts: [S.holds(f, t) for f in index.fields for t in ts]
    any_of = lambda tests: F.array_contains(F.array(*tests), True)
    if any(len(t.lower()) < GRAM for t in terms):
        return rows.where(any_of(test(terms))).drop("part")
    found = None
    for t in terms:
        own = _one(index, spark, t)
        found = own if found is None else found.unionAll(own)
    few = found.distinct().withColumnRenamed("key", index.key)
    # Both part and key join: part prunes the folders that are read, at run time.
    return rows.join(few, ["part", index.key], "left_semi").where(any_of(test(terms))).drop("part")


def keyword_search(index: Index, spark: SparkSession, phrases: Sequence[str], tokens: Sequence[str], **options) -> DataFrame:
    """As search.keyword_search over the indexed table, but only rows that hold a term are read and scored."""
    return S.keyword_search(holding(index, spark, [*phrases, *tokens]), index.key, phrases, tokens, **options)
