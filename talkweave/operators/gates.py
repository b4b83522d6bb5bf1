"""Quality gates: checks as aggregates, reports, audits, load rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave import config as C
from talkweave.functions import fixed as K


def share(condition: Column) -> Column:
    """The share of rows for which the condition holds; null counts as no, and no rows give null."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def gate(df: DataFrame, checks: Sequence[tuple[str, str, Column, float, bool]], by: Sequence[str] = ()) -> DataFrame:
    """A row for each check (and group): check, severity, value, threshold, status. checks: (name, BLOCK or WARNING,
    aggregate, threshold, strict). One pass over df; strict: above the threshold fails, else reaching it does."""
    wide = df.groupBy(*by).agg(*[value.cast("double").alias(f"c{i}") for i, (_, _, value, _, _) in enumerate(checks)])
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.round(f"c{i}", 6).alias("value"), F.lit(float(limit)).alias("threshold"),
            F.when(F.col(f"c{i}").isNull(), "SKIP").when(F.col(f"c{i}") > limit if strict else F.col(f"c{i}") >= limit, severity).otherwise("OK").alias("status"),
        ) for i, (name, severity, _, limit, strict) in enumerate(checks)
    ])
    return wide.select(*by, F.inline(rows))


def report(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """result (BLOCK or OK; warnings alone don't stop a load), n_blocked, n_warnings and the joined reasons, per group."""
    blocked = F.col("status") == "BLOCK"
    reason = F.when(blocked, F.concat("check", F.lit(": "), F.format_string("%.4f", "value"), F.lit(" > "), F.format_string("%.4f", "threshold")))
    return results.groupBy(*by).agg(
        F.when(F.bool_or(blocked), "BLOCK").otherwise("OK").alias("result"),
        F.count_if(blocked).alias("n_blocked"),
        F.count_if(F.col("status") == "WARNING").alias("n_warnings"),
        F.concat_ws("; ", F.array_sort(F.collect_list(reason))).alias("reasons"),
    )


def duplicates(key: Column) -> Column:
    return F.count(key) - F.count_distinct(key)


def turn_checks(*, speaker: Column, date: Column, turn_id: Column, page_start: Column, page_end: Column, leaked: Column, meta: Sequence[Column], text: Column, marker: str) -> list:
    missing = meta[0].isNull()
    for m in meta[1:]:
        missing = missing | m.isNull()
    return [
        ("empty", "BLOCK", F.when(F.count("*") == 0, 1).otherwise(0), 0, True),
        ("speaker missing", "BLOCK", share(speaker.isNull() | (speaker == "")), C.TURN_SPEAKER_MISSING, False),
        ("bad date", "BLOCK", F.count_if(~F.coalesce(date.cast("string").rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))), 0, True),
        ("duplicate ids", "BLOCK", duplicates(turn_id), 0, True),
        ("pages inverted", "BLOCK", F.count_if(page_start > page_end), 0, True),
        ("no speaker", "BLOCK", F.count_if(leaked), 0, True),
        ("meta missing", "BLOCK", F.count_if(missing), 0, True),
        ("marker left", "WARNING", F.count_if(text.rlike(marker)), 0, True),
        ("short turns", "WARNING", share(F.length(text) < C.TURN_SHORT_CHARS), C.TURN_SHORT_RATE, False),
    ]


def chunk_checks(*, date: Column, speaker: Column, committee: Column, text: Column, chunk_id: Column, chunk_type: Column, source: Sequence[Column]) -> list:
    """Ten checks and the empty batch; `source`: the columns of which none may be null."""
    none = lambda c: c.isNull() | (c.cast("string") == "")
    untraced = source[0].isNull()
    for c in source[1:]:
        untraced = untraced | c.isNull()
    return [
        ("empty", "BLOCK", F.when(F.count("*") == 0, 1).otherwise(0), 0, True),
        ("date null", "BLOCK", share(none(date)), C.CHUNK_DATE_NULL, True),
        ("speaker missing", "BLOCK", share(none(speaker)), C.CHUNK_SPEAKER_MISSING, True),
        ("committee missing", "BLOCK", F.count_if(none(committee)), 0, True),
        ("blank text", "BLOCK", share(text.isNull() | ~text.rlike(r"(?U)\S")), C.CHUNK_BLANK, True),
        ("short text", "WARNING", share(F.length(F.coalesce(text, F.lit(""))) < C.CHUNK_GATE_SHORT_CHARS), C.CHUNK_SHORT, True),
        ("long text", "WARNING", share(F.length(text) > C.CHUNK_GATE_LONG_CHARS), C.CHUNK_LONG, True),
        ("duplicate ids", "BLOCK", duplicates(F.nullif(chunk_id.cast("string"), F.lit(""))), 0, True),
        ("marker detection", "WARNING", F.lit(None).cast("double") + F.count("*"), 0, True),
        ("chunk type invalid", "BLOCK", F.count_if(~F.coalesce(chunk_type.isin(*K.CHUNK_TYPES), F.lit(False))), 0, True),
        ("source missing", "BLOCK", share(untraced), C.CHUNK_SOURCE_MISSING, True),
    ]


def loadable(df: DataFrame, source: str, date: str, text: str) -> DataFrame:
    """source, n, date_null, blank, load: sources with too many null dates or blank texts aren't loaded."""
    g = df.groupBy(source).agg(F.count("*").alias("n"), share(F.col(date).isNull()).alias("date_null"), share(F.col(text).isNull() | (F.trim(text) == "")).alias("blank"))
    return g.withColumn("load", ~((F.col("date_null") > C.SKIP_DATE_NULL) | (F.col("blank") > C.SKIP_BLANK)))


def probes(squashed: Column, n: int = C.PROBES, chars: int = C.PROBE_CHARS, least: int = C.PROBE_LEAST) -> Column:
    """Pieces of a text without blanks from n places spread over it, the last from its end; those below `least` characters and
    repeats left out."""
    size = F.length(squashed)
    places = [F.least(F.floor(size * (i / (n - 1))), F.greatest(size - chars, F.lit(0))).cast("int") for i in range(n)]
    return F.array_distinct(F.filter(F.array(*[F.substring(squashed, p + 1, F.lit(chars)) for p in places]), lambda p: F.length(p) >= least))


def source_audit(chunks: DataFrame, pages: DataFrame, *, source: str = "source_id", margin: int = 1) -> DataFrame:
    """chunk_id, hits, n_probes, text_ok, speaker_ok, all_ok: whether each chunk stands in the pages that it is said to come from.

    chunks: chunk_id, source, page_start, page_end, speaker, text; pages: source, page, text. A chunk meets the pages of its
    range and `margin` more, in order. All but one of its probes (all, of fewer than three) must stand in them; a chunk that
    fails is looked for piece by piece over the page breaks. No pages: nothing is found. No speaker: not ok.
    """
    near = chunks.select("chunk_id", source, F.explode(F.sequence(F.col("page_start") - margin, F.col("page_end") + margin)).alias("page"))
    held = near.join(pages.select(source, "page", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "").alias("t")), [source, "page"])
    raw = held.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]).alias("pages"))
    squash = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    both = chunks.select("chunk_id", squash(F.col("text")).alias("chunk"), squash(F.col("speaker")).alias("who")).join(raw, "chunk_id", "left")
    both = both.withColumn("pages", F.coalesce("pages", F.array().cast("array<string>"))).withColumn("probes", probes(F.col("chunk"))).withColumn("joined", F.array_join("pages", ""))
    checked = both.withColumn("hits", F.size(F.filter("probes", lambda p: F.contains(F.col("joined"), p)))).withColumn("n_probes", F.size("probes"))
    checked = checked.withColumn("ok", probes_pass(F.col("hits"), F.col("n_probes"))).withColumn("speaker_ok", (F.col("who") != "") & F.contains("joined", F.col("who")))
    again = spans_pages(checked.where("NOT ok").select(F.col("chunk_id").alias("key"), "chunk", "pages")).select(F.col("key").alias("chunk_id"), F.col("ok").alias("split_ok"))
    text_ok = F.col("ok") | F.coalesce("split_ok", F.lit(False))
    return checked.join(again, "chunk_id", "left").select("chunk_id", "hits", "n_probes", text_ok.alias("text_ok"), "speaker_ok", (text_ok & F.col("speaker_ok")).alias("all_ok"))


def verified(counts: DataFrame, expected: str = "expected", found: str = "found") -> DataFrame:
    """The rows whose counts differ; null counts as 0. No row: the load is whole."""
    return counts.where(F.coalesce(F.col(expected), F.lit(0)) != F.coalesce(F.col(found), F.lit(0)))


def probes_pass(hits: Column, n: Column) -> Column:
    """All but one of three probes or more, all of fewer."""
    return F.when(n >= 3, hits >= n - 1).otherwise(hits >= n)


def spans_pages(texts: DataFrame, least: int = 10) -> DataFrame:
    """ok: whether a squashed chunk is split over the squashed pages (array) from some page on, in order, each part at
    least `least` characters but for the last. A search with a state that depends on the part before, per row."""

    def whole(chunk: str, pages: list[str]) -> bool:
        todo = [(chunk, 0)]
        while todo:
            rest, at = todo.pop()
            for i in range(at, len(pages)):
                if rest in pages[i] and (at or len(rest) >= least):
                    return True
                lo, hi = 0, len(rest)
                while lo < hi:
                    mid = (lo + hi + 1) // 2
                    lo, hi = (mid, hi) if rest[:mid] in pages[i] else (lo, mid - 1)
                if lo >= least:
                    todo.append((rest[lo:], i + 1))
        return False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"key": pdf["key"], "ok": [bool(c is not None and whole(c, list(p) if p is not None else [])) for c, p in zip(pdf["chunk"], pdf["pages"])]})

    return texts.select("key", "chunk", "pages").mapInPandas(run, f"key {texts.schema['key'].dataType.simpleString()}, ok boolean")


def field_report(df: DataFrame, key: str, fields: dict[str, int], samples: int, short: Column, seed: str = "0") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What enrichment has put into array columns: (field, n, filled, coverage; field, value, n, place: the most frequent values,
    as many as `fields` says; field, filled, key: a sample of filled and of empty rows, short ones left out of the empty).

    Values are counted once for each time they stand in a row. A null array is empty.
    """
    size = lambda f: F.coalesce(F.greatest(F.size(f), F.lit(0)), F.lit(0))
    marks = df.select(key, F.coalesce(short, F.lit(False)).alias("short"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), (size(f) > 0).alias("filled")) for f in fields])))
    coverage = marks.groupBy("field").agg(F.count("*").alias("n"), F.count_if("filled").alias("n_filled")).withColumn("coverage", F.round(F.col("n_filled") / F.col("n"), 4))
    values = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("vs")) for f in fields]))).select("field", F.explode("vs").alias("value"))
    limit = F.element_at(F.create_map(*[x for f, n in fields.items() for x in (F.lit(f), F.lit(n))]), F.col("field"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "value"))
    top = values.groupBy("field", "value").agg(F.count("*").alias("n")).withColumn("place", place).where(F.col("place") <= limit)
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed)).cast("binary"))
    drawn = marks.where(F.col("filled") | ~F.col("short")).withColumn("rn", F.row_number().over(Window.partitionBy("field", "filled").orderBy(draw, key))).where(F.col("rn") <= samples)
    return coverage, top, drawn.select("field", "filled", key)


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """A sample that is the same on every engine: the n rows whose md5 of key and seed is least, in order of key."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed)).cast("binary")), key).limit(n).orderBy(key)


def failures(df: DataFrame, good: Callable[[DataFrame], Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that don't), to be written apart; a null verdict is a failure."""
    ok = F.coalesce(good(df), F.lit(False))
    return df.where(ok), df.where(~ok)
