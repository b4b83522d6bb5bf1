"""What each filter of a chain takes, in every order, by counting paths through the lattice of filter sets.

A state of the lattice is the set of filters that have run; an edge S -> S + f runs filter f after those of S, and removes
the documents that fail f and nothing in S. What an edge removes doesn't depend on the order inside S, so 2^k * k / 2 edges
answer for all k! orders: forward counting gives the orders that reach a state, backward counting those that leave it for
the end, and their product the orders that take an edge. A filter's Shapley sum is its edges' removals weighted by that
product; a step of one order reads the edge that the step takes. The five filters are

    A short: under 200 words               B repetitive: 100 * distinct words < 50 * words
    C shouting: 100 * [A-Z] > 3 * code points    D symbols: any of #$%&*|
    E copy: the same text as any smaller doc_id's

Documents become counts by the set of filters they fail, so only (doc_id, digest of the text) is shuffled, never a text,
and the lattice works on one row a part and set. A-D depend on the text alone; E needs the least doc_id of each text, which
is found from groups of equal rows, so a text that a third of all documents share is a few rows there.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm.common import SPACE, read, stored
from talkweave.llm.quality_rules import bound

#: The filters' names, a bit each; all but the copy filter by a condition on the text.
FILTERS = "ABCDE"
COPY = "E"


def failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    n_words, few = bound(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), F.length(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [lambda w: w["n"] < 200, lambda w: 100 * w["d"] < 50 * w["n"], lambda w: 100 * capitals > 3 * few, lambda w: text.rlike(r"[#$%&*|]")]
    return bound(n_words, lambda w: sum((F.when(t(w), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0)))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, n_good, n_toxic: how many documents of each lang fail exactly the filters of mask.

    docs: doc_id, text, lang (other columns are ignored); labels: doc_id, quality, toxic. Null text: an empty one, equal to
    other empty ones. Null lang: the part ''. Null doc_id: has no label, is neither smaller nor larger than another, so
    never a copy. Repeated rows count each; rows of one id and text are no copies of each other. A document labelled twice
    is good (toxic) if any of its labels says so. No documents: no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # Rows without an id meet no label: they are dealt by their text, or they would all go to one task.
    deal = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = rows.withColumn("deal", deal).groupBy("doc_id", "deal", "part", "mask", "digest").agg(F.count("*").alias("n"))
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("deal", F.lit(0).cast("long"))
    false = F.lit(False)
    rows = rows.join(known, ["doc_id", "deal"], "left").select("doc_id", "part", "mask", "digest", "n", F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"))
    # A row for each text and kind: how many, the least id among them, and how many have that id. The same id may stand
    # in several kinds, so the least of the whole text decides below.
    ids = rows.groupBy("digest", "mask", "part", "good", "toxic", "doc_id").agg(F.sum("n").alias("n"))
    kinds = ids.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("nameless"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")
    )
    texts = kinds.groupBy("digest", "mask").agg(F.min("least").alias("first"), F.collect_list(F.struct("part", "good", "toxic", "n", "nameless", "least", "n_least")).alias("kinds"))
    one = texts.select("mask", "first", F.explode("kinds").alias("k")).select("mask", "first", "k.*")
    own = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
    bit = 1 << FILTERS.index(COPY)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - own).alias("n"))))
    counted = one.select("part", "good", "toxic", split.alias("s"))
    n = F.col("s.n")
    return counted.groupBy("part", F.col("s.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(F.lit(0))).alias("n_good"), F.sum(F.when(F.col("toxic"), n).otherwise(F.lit(0))).alias("n_toxic"))


def lattice(filters: str = FILTERS) -> list[tuple[int, str, int, int]]:
    """(state, filter, bit, orders): the edges, with the number of orders that take each (paths in times paths out)."""
    k = len(filters)
    ahead, behind = [1] + [0] * (2**k - 1), [0] * (2**k - 1) + [1]
    for s in range(2**k):  # every edge leads to a larger number
        for i in range(k):
            if s >> i & 1:
                ahead[s] += ahead[s ^ 1 << i]
    for s in reversed(range(2**k)):
        for i in range(k):
            if not s >> i & 1:
                behind[s] += behind[s | 1 << i]
    edges = [(s, filters[i], 1 << i, ahead[s] * behind[s | 1 << i]) for s in range(2**k) for i in range(k) if not s >> i & 1]
    assert sum(e[3] for e in edges) == k * factorial(k)
    return edges


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order, step, filter, state: the edge that each step of each order takes."""
    at = {f: 1 << i for i, f in enumerate(filters)}
    rows = [("".join(o), j + 1, f, sum(at[g] for g in o[:j])) for o in permutations(filters) for j, f in enumerate(o)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, state int")


def audited(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit from failure counts: a row for each part, order and step. No counts: no rows."""
    spark = counts.sparkSession
    hit = F.col("mask").bitwiseAND(F.col("bit")) > 0
    fresh = F.col("mask").bitwiseAND(F.col("state")) == 0
    total = lambda value, when: F.sum(F.when(when, F.col(value)).otherwise(F.lit(0)))
    # Each count meets each edge: 2^k counts a part and k * 2^(k-1) edges, bounded by the number of filters.
    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(b).alias("bit"), F.lit(n).cast("long").alias("orders")) for s, f, b, n in lattice(filters)])
    by_edge = counts.select("*", F.explode(edges).alias("e")).select(*counts.columns, "e.*").groupBy("part", "state", "filter", "orders").agg(
        total("n", fresh & hit).alias("removed"),
        total("n", fresh & ~hit).alias("kept"),
        total("n", ~fresh & hit).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("n_good", fresh & hit).alias("good_lost"),
        total("n_toxic", fresh & hit).alias("toxic_lost"),
    )
    by_edge = stored(by_edge, "filter-edges")
    shapley = by_edge.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return steps(spark, filters).join(by_edge, ["filter", "state"]).join(shapley, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audited(failure_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  concat(CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
    CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * len(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN first < w.doc_id THEN 'E' END) AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, o[step] AS x, o[1:step - 1] AS past FROM o, generate_series(1, 5) AS g(step)),
r AS (SELECT part, o, step, x, past, fails, n, good, toxic, contains(fails, x) AS hit, len(fails) > 0 AND past <> '' AND regexp_matches(fails, '[' || past || '-]') AS gone FROM s, c),
t AS (SELECT part, o AS filter_order, step::INT AS step, x, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM t
"""
