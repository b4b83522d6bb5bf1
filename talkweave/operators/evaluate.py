"""Retrieval and label evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave import config as C


def relevant(criteria: Column, *, text: Column, speaker: Column, committee: Column, date: Column) -> Column:
    """Whether a hit meets a question's criteria.

    committee_any and date_any (prefixes) must hold where they are given. Of speaker_any (the whole name) and text_any one
    must hold, or both if mode is `and`; text_all, which wants one of each group, counts only beside text_any. No criteria:
    everything is relevant. Nulls of a hit meet nothing.
    """
    given = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    sure = lambda c: F.coalesce(c, F.lit(False))
    by_speaker, by_text = given(criteria["speaker_any"]), given(criteria["text_any"])
    who = sure(F.array_contains(criteria["speaker_any"], speaker))
    what = sure(F.exists(criteria["text_any"], lambda t: F.contains(text, t))) & F.coalesce(F.forall(criteria["text_all"], lambda g: sure(F.exists(g, lambda t: F.contains(text, t)))), F.lit(True))
    fixed = (~given(criteria["committee_any"]) | sure(F.array_contains(criteria["committee_any"], committee))) & (
        ~given(criteria["date_any"]) | sure(F.exists(criteria["date_any"], lambda d: date.cast("string").startswith(d)))
    )
    either = F.when(sure(criteria["mode"] == "and"), who & what).otherwise(who | what)
    return fixed & F.when(by_speaker & by_text, either).when(by_speaker, who).when(by_text, what).otherwise(F.lit(True))


def by_axis(lists: dict[str, DataFrame], questions: DataFrame, docs: DataFrame, q: str, key: str, *, text: str, speaker: str, committee: str, date: str | None) -> DataFrame:
    """axis, n, recall_5, recall_10, mrr_10: ranked lists (q, key, rank) of several ways to search, each judged on all
    questions (q, criteria) by the whole rows of docs. A question without hits counts 0."""
    hits = None
    for axis, ranks in lists.items():
        own = ranks.where(F.col("rank") <= C.MRR_CUT).select(F.lit(axis).alias("axis"), q, key, F.col("rank").cast("int").alias("rank"))
        hits = own if hits is None else hits.unionAll(own)
    rows = docs.select(key, F.struct(F.col(text).alias("text"), F.col(speaker).alias("speaker"), F.col(committee).alias("committee"), (F.col(date) if date else F.lit(None)).cast("string").alias("date")).alias("doc"))
    rel = F.coalesce(relevant(F.col("criteria"), text=F.col("doc.text"), speaker=F.col("doc.speaker"), committee=F.col("doc.committee"), date=F.col("doc.date")), F.lit(False))
    judged = hits.join(questions, q).join(rows, key).select("axis", q, "rank", rel.alias("rel"))
    every = questions.select(q, F.explode(F.array(*map(F.lit, lists))).alias("axis"))
    return recall_mrr(every.join(judged, [q, "axis"], "left"), q, ["axis"], "rank", F.col("rel"))


def recall_mrr(hits: DataFrame, query: str, by: Sequence[str], rank: str, is_relevant: Column) -> DataFrame:
    """n, recall_5, recall_10, mrr_10 (half-even, three decimals) per group; a query without a relevant hit counts 0."""
    first = hits.groupBy(*by, query).agg(F.min(F.when(is_relevant, F.col(rank))).alias("r"))
    at = lambda k: F.bround(F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double")), 3)
    mrr = F.bround(F.avg(F.when(F.col("r") <= C.MRR_CUT, 1.0 / F.col("r")).otherwise(0.0)), 3)
    return first.groupBy(*by).agg(F.count("*").alias("n"), *[at(k).alias(f"recall_{k}") for k in C.RECALL_CUTS], mrr.alias(f"mrr_{C.MRR_CUT}"))


def confusion(a: DataFrame, b: DataFrame, key: str, label_a: str, label_b: str, labels: Sequence) -> DataFrame:
    """label_a, label_b, n on the keys that both have; every pair of labels has a row."""
    spark = a.sparkSession
    kind = a.schema[label_a].dataType.simpleString()
    spine = spark.createDataFrame([(x, y) for x in labels for y in labels], f"label_a {kind}, label_b {kind}")
    n = a.select(key, F.col(label_a).alias("label_a")).join(b.select(key, F.col(label_b).alias("label_b")), key).groupBy("label_a", "label_b").agg(F.count("*").alias("n"))
    return spine.join(n, ["label_a", "label_b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def agreement(matrix: DataFrame) -> DataFrame:
    """n, rate: the share on the diagonal; null without rows."""
    n = F.sum("n")
    return matrix.agg(n.alias("n"), F.bround(F.try_divide(F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)), n), 3).alias("rate"))


def disagreements(a: DataFrame, b: DataFrame, key: str, label_a: str, label_b: str) -> DataFrame:
    """key, label_a, label_b of the keys that both have and label otherwise."""
    both = a.select(key, F.col(label_a).alias("label_a")).join(b.select(key, F.col(label_b).alias("label_b")), key)
    return both.where(~F.col("label_a").eqNullSafe(F.col("label_b")))


def revalidated(unanswerable: Column, gate: Column) -> Column:
    """KEEP where a question without an answer is blocked and one with an answer isn't; else REVIEW. A null gate is none."""
    blocked = F.coalesce(gate.isin("NONE", "REFUSED"), F.lit(False))
    return F.when(unanswerable == blocked, "KEEP").otherwise("REVIEW")


def blind_sheet(rows: DataFrame, by: str, key: str, head: Column, text: Column) -> DataFrame:
    """by, sheet: a labelling sheet of all rows of a group, in order of key, without the labels."""
    entry = F.concat(F.lit("## "), F.col(key).cast("string"), F.lit(" "), head, F.lit("\nlabel:\n"), text, F.lit("\n"))
    g = rows.select(by, key, entry.alias("entry")).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "entry"))), lambda x: x["entry"]), "\n").alias("sheet"))
    return g.select(by, "sheet")


def pass_rate(df: DataFrame, by: Sequence[str], verdict: str) -> DataFrame:
    """n, passed, rate without the verdicts `na`; the rate is null where nothing is left."""
    counted = F.count_if(F.col(verdict) != "na")
    return df.groupBy(*by).agg(counted.alias("n"), F.count_if(F.col(verdict) == "pass").alias("passed"), F.bround(F.try_divide(F.count_if(F.col(verdict) == "pass"), counted), 3).alias("rate"))


def label_sheet(lines: DataFrame, source: str, order: str, line: str, labels: Sequence[str], id_pattern: str = r"^##\s+(\S+)", label_pattern: str = r"^label:\s*(\S*)") -> DataFrame:
    """id, label: each label line goes to the id line before it; unknown and empty labels don't count, the first valid wins."""
    w = Window.partitionBy(source).orderBy(order)
    here = F.when(F.col(line).rlike(id_pattern), F.regexp_extract(line, id_pattern, 1))
    marked = lines.withColumn("id", F.last(here, ignorenulls=True).over(w)).withColumn("label", F.regexp_extract(line, label_pattern, 1))
    return marked.where(F.col("label").isin(*labels) & F.col("id").isNotNull()).groupBy(source, "id").agg(F.min_by("label", order).alias("label"))
