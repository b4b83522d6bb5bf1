"""Chunking: sentences, greedy packing, context and embedding text, batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave import config as C
from talkweave.functions import fixed as K
from talkweave.functions.text import lstrip, once, rstrip, strip

#: After a sentence mark, if a blank or anything but a digit follows: decimals stay whole.
SENTENCE_END = r"(?<=[.!?。])(?=\s|[^\d\s])"


def sentences(text: Column) -> Column:
    """Sentences as they stand: each but the first begins with the blanks that part it from the one before."""
    return F.split(text, SENTENCE_END)


def hard_split(parts: Column, chars: int = C.HARD_SPLIT) -> Column:
    """Sentences above `chars` cut into pieces of that length."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / chars).cast("int")), lambda i: F.substring(s, i * chars + 1, F.lit(chars)))
    return F.flatten(F.transform(parts, lambda s: F.when(F.length(s) <= chars, F.array(s)).otherwise(cut(s))))


def packed(parts: Column, max_chars: int = C.MAX_CHARS) -> Column:
    """Sentences joined by a blank into buffers; a buffer is closed when the next sentence, with its leading blanks, would pass
    max_chars. A buffer loses the blanks at its ends whenever a sentence joins it, and when it is closed.

    The fold keeps the places where buffers begin and the size and blanks of the open one; texts are joined once, after it.
    """
    state = lambda starts, place, size, lead, trail: F.struct(starts.alias("starts"), place.alias("place"), size.alias("size"), lead.alias("lead"), trail.alias("trail"))

    def step(s: Column, p: Column) -> Column:
        fits = (s["size"] > 0) & (s["size"] + p["n"] + 1 <= max_chars)
        # What is blank as a whole leaves nothing but the other, stripped at both ends.
        size = F.when(s["lead"] == s["size"], F.greatest(p["n"] - p["lead"] - p["trail"], F.lit(0))).otherwise(s["size"] - s["lead"] + F.when(p["n"] > p["lead"], p["n"] - p["trail"] + 1).otherwise(-s["trail"]))
        # A sentence that joins an empty buffer is the buffer, which begins with it.
        starts = F.when(s["size"] == 0, F.slice(s["starts"], F.lit(1), F.greatest(F.size(s["starts"]) - 1, F.lit(0)))).otherwise(s["starts"])
        return F.when(fits, state(s["starts"], s["place"] + 1, size, F.lit(0), F.lit(0))).otherwise(state(F.concat(starts, F.array(s["place"] + 1)), s["place"] + 1, p["n"], p["lead"], p["trail"]))

    size = lambda x: F.struct(F.length(x).alias("n"), (F.length(x) - F.length(lstrip(x))).alias("lead"), (F.length(x) - F.length(rstrip(x))).alias("trail"))

    def joined(all_: Column) -> Column:
        starts = F.aggregate(F.transform(all_, size), state(F.array().cast("array<int>"), F.lit(0), F.lit(0), F.lit(0), F.lit(0)), step, lambda s: s["starts"])
        own = lambda at, a, i: F.slice(all_, a, F.coalesce(F.get(at, i + 1), F.size(all_) + 1) - a)
        # The first keeps the blanks at its end until a sentence joins that is more than blanks.
        first = lambda xs, x: F.when(strip(F.coalesce(F.get(xs, F.lit(1)), F.lit(""))) == "", rstrip(x)).otherwise(x)
        text = lambda xs: strip(F.array_join(F.filter(F.transform(xs, lambda x, k: F.when(k == 0, first(xs, x)).otherwise(rstrip(x))), lambda x: x != ""), " "))
        return once(starts, lambda at: F.transform(at, lambda a, i: once(own(at, a, i), text)))

    return once(parts, joined)


def chunks(df: DataFrame, keys: Sequence[str], text: str, *, max_chars: int = C.MAX_CHARS, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each chunk: chunk_id, chunk_index (from 1), chunk_total, chunk_text, is_short. Texts that fit stay whole.

    Null and blank texts have one empty chunk. Per row only: no shuffle.
    """
    pieces = once(strip(F.coalesce(F.col(text), F.lit(""))), lambda body: F.when(F.length(body) <= max_chars, F.array(body)).otherwise(packed(hard_split(sentences(body)), max_chars)))
    out = df.select(*keys, *keep, pieces.alias("__p")).select(*keys, *keep, F.size("__p").alias("chunk_total"), F.posexplode("__p").alias("__i", "chunk_text"))
    name = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    return out.select(
        *keys, *keep, F.format_string("%s_chunk_%03d", name, F.col("__i") + 1).alias("chunk_id"), (F.col("__i") + 1).alias("chunk_index"), "chunk_total", "chunk_text",
        (F.length("chunk_text") < C.SHORT_CHARS).alias("is_short"),
    )


def with_context(df: DataFrame, group: str, order: str, speaker: str, role: str, text: str) -> DataFrame:
    """prev_context and next_context: the neighbouring turns as `speaker role: text`, 80 characters of it, empty at the ends."""
    line = F.concat(F.coalesce(speaker, F.lit("")), F.lit(" "), F.coalesce(role, F.lit("")), F.lit(": "), F.left(F.coalesce(text, F.lit("")), F.lit(C.CONTEXT_CHARS)))
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("prev_context", F.coalesce(F.lag(line).over(w), F.lit(""))).withColumn("next_context", F.coalesce(F.lead(line).over(w), F.lit("")))


def embed_text(committee: Column, date: Column, speaker: Column, role: Column, text: Column) -> Column:
    """What is embedded: committee, date, speaker and role before the text; nulls are empty, and a role that is leaves no blank."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    title = F.when(known(role) != "", F.concat(F.lit(" "), role)).otherwise("")
    return F.concat(known(committee), F.lit(" "), known(date), F.lit(" "), known(speaker), title, F.lit(f" {K.SPEECH_MARK}: "), known(text))


def fixed_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """batch: rows in order, `size` to a batch. One window over all rows, as the numbering is global: sort ranges first
    number themselves, then are offset by the sizes of those before, so no task sees all rows."""
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    local = ranged.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    counts = local.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = local.join(F.broadcast(before.select("__part", "__before")), "__part")  # a row for each partition
    return placed.withColumn("batch", F.floor((F.col("__before") + F.col("__rn") - 1) / size)).drop("__part", "__rn", "__before")


def budget_batches(df: DataFrame, group: str, order: str, length: str, items: int = C.EMBED_ITEMS, chars: int = C.EMBED_CHARS) -> DataFrame:
    """batch within each group: closed when it has `items` rows or the next would pass `chars`.

    A batch depends on where the one before ended, so a group is folded in order, as a stream of sorted rows.
    """
    columns = [group, order, length]
    schema = df.select(*columns).schema.add("batch", "long")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, n, size = object(), 0, 0, 0
        for pdf in frames:
            out = []
            for key, x in zip(pdf[group], pdf[length]):
                x = 0 if pd.isna(x) else int(x)
                if key != now:
                    now, batch, n, size = key, 0, 0, 0
                if n and (n >= items or size + x > chars):
                    batch, n, size = batch + 1, 0, 0
                n, size = n + 1, size + x
                out.append(batch)
            yield pdf.assign(batch=pd.Series(out, index=pdf.index, dtype="int64"))

    return df.select(*columns).repartition(group).sortWithinPartitions(group, order).mapInPandas(run, schema)


def estimate(df: DataFrame, text: str, usd_per_million: float, by: Sequence[str] = ()) -> DataFrame:
    """rows, chars, usd (per group): about one token a character."""
    n = F.coalesce(F.sum(F.length(text)), F.lit(0))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), n.cast("long").alias("chars"), F.round(n * F.lit(usd_per_million) / 1e6, 6).alias("usd"))


def emitted(df: DataFrame, by: Sequence[str], text: str, chars: int = C.SHORT_CHARS) -> DataFrame:
    """is_short, n, chars per group: how many chunks are below `chars`."""
    return df.groupBy((F.length(text) < chars).alias("is_short"), *by).agg(F.count("*").alias("n"), F.sum(F.length(text)).cast("long").alias("chars"))
