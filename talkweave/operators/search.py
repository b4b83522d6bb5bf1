"""Keyword, vector and hybrid search, and what follows on ranked hits."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave import config as C
from talkweave.functions import fixed as K


def holds(column: str, term: str) -> Column:
    """Case-insensitive substring; there is no pattern, so there is nothing to escape. Null counts as no."""
    return F.coalesce(F.contains(F.lower(F.col(column)), F.lower(F.lit(term))), F.lit(False))


def query_tokens(query: str) -> list[str]:
    """The content words of a question: marks and one particle off, no stop words, two characters or more."""
    out = []
    for word in query.split():
        word = word.strip(K.EDGE_MARKS)
        if len(word) < 2 or word in K.STOPWORDS:
            continue
        ends = sorted((p for p in K.PARTICLES if word.endswith(p) and len(word) - len(p) >= 2), key=len)
        stem = word[: -len(ends[-1])] if ends else word
        if stem not in K.STOPWORDS:
            out.append(stem)
    return out


def query_terms(query: str, aliases: dict[str, Sequence[str]] | None = None) -> tuple[list[str], list[str]]:
    """(phrases, tokens) of a question: at most two phrases (only if it has a blank) and eight tokens, each with its aliases.

    Originals come first, then their aliases in code point order, so the cut doesn't depend on hashing.
    """
    aliases = with_twins(aliases or {})
    query = query.strip()
    spelled = lambda term: [term, *sorted(set(aliases.get(term, ())) - {term})]
    phrases = spelled(query) if " " in query else []
    tokens = [x for token in query_tokens(query) for x in spelled(token)]
    return phrases[: C.MAX_PHRASES], list(dict.fromkeys(tokens))[: C.MAX_TOKENS]


def with_twins(aliases: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Alias groups with the NFKC form of each spelling as one more: compatibility characters look like the standard ones."""
    out: dict[str, set[str]] = {}
    for term, own in aliases.items():
        group = {term, *own}
        group |= {unicodedata.normalize("NFKC", x) for x in group}
        for x in group:
            out.setdefault(x, set()).update(group)
    return {x: sorted(group - {x}) for x, group in out.items()}


#: Rows, and words of them, of a block; questions of a block; rows of one while there are too few blocks for all cores.
ROWS, WORDS, ASKED, FEW = 32_768, 4_000_000, 32_768, 512


def word_hits(df: DataFrame, queries: DataFrame, key: str, query: str, words: Column, query_words: Column, limit: int) -> DataFrame:
    """query, key, n_hits, rank: for each of many queries its best rows by the number of words that both have; a row isn't a
    hit of itself. Ties by key. Rows that repeat a key are one, their hits added up.

    A row for each word, query and row that has it would be more than either table, and a common word's would meet in one task.
    Rows and queries meet in blocks of bounded size: a block has posting lists of its words, adds up each query's lists, and
    sends on `limit` rows a query. Pairs still grow with rows times queries."""
    spark = df.sparkSession
    held = df.select(F.col(key).alias("key"), F.array_distinct(words).alias("words")).where("key is not null and size(words) > 0")
    asked = queries.select(F.col(query).alias("q"), F.array_distinct(query_words).alias("words")).where("q is not null and size(words) > 0")
    size = lambda rows: F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.coalesce(F.sum(F.size("words")), F.lit(0)) / WORDS), F.lit(1))
    least = F.least(F.lit(spark.sparkContext.defaultParallelism), F.ceil(F.count("*") / FEW))
    blocks = held.agg(F.greatest(size(ROWS), least).cast("int").alias("n_row_block")).crossJoin(asked.agg(size(ASKED).cast("int").alias("n_q_block")))

    def dealt(df: DataFrame, by: str, own: str, other: str):
        block = F.pmod(F.xxhash64(by), F.col(f"n_{own}")).cast("int")
        return df.crossJoin(F.broadcast(blocks)).withColumns({own: block, other: F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))}).drop("n_row_block", "n_q_block").groupBy("row_block", "q_block")

    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        return _most_words(held, asked, limit)

    kind = T.StructType([T.StructField("q", queries.schema[query].dataType), T.StructField("key", df.schema[key].dataType), T.StructField("n_hits", T.LongType())])
    hits = dealt(held, "key", "row_block", "q_block").cogroup(dealt(asked, "q", "q_block", "row_block")).applyInArrow(best, kind)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("n_hits").desc(), "key"))).where(F.col("rank") <= limit)
    return ranked.select(F.col("q").alias(query), F.col("key").alias(key), "n_hits", "rank")


def _lists(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(distinct values of the column, in order; for each word the place of its row's value; the words)."""
    words, values = table["words"].combine_chunks(), table[name].combine_chunks()
    distinct = pc.unique(values)
    distinct = distinct.take(pc.sort_indices(distinct))
    return distinct, np.repeat(pc.index_in(values, distinct).to_numpy(), pc.list_value_length(words).to_numpy()), pc.list_flatten(words)


def _most_words(held: pa.Table, asked: pa.Table, limit: int) -> pa.Table:
    """q, key, n_hits: the `limit` best rows of a block for each of its queries."""
    if not held.num_rows or not asked.num_rows:
        return pa.table({"q": asked["q"].slice(0, 0), "key": held["key"].slice(0, 0), "n_hits": pa.array([], pa.int64())})
    keys, row, words = _lists(held, "key")
    queries, owner, wanted = _lists(asked, "q")
    coded = words.dictionary_encode()
    word = coded.indices.to_numpy()
    row = row[np.argsort(word, kind="stable")]
    ends = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(coded.dictionary)))))
    at = pc.fill_null(pc.index_in(wanted, coded.dictionary), -1).to_numpy()
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(owner, kind="stable")
    owner, at = owner[order], at[order]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    itself = pc.fill_null(pc.index_in(queries, keys), -1).to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, own in zip(owner[starts].tolist(), np.split(at, starts[1:])):
        n = np.zeros(len(keys), np.int64)
        for i in own.tolist():
            np.add.at(n, row[ends[i] : ends[i + 1]], 1)
        if itself[q] >= 0:
            n[itself[q]] = 0
        there = np.flatnonzero(n)
        if len(there) > limit:
            there = there[np.argpartition(there - n[there] * len(n), limit - 1)[:limit]]
        out.append((np.full(len(there), q), there, n[there]))
    q, key, n = (np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), (), ())))
    return pa.table({"q": queries.take(pa.array(q)), "key": keys.take(pa.array(key)), "n_hits": pa.array(n)})


def keyword_search(
    df: DataFrame, key: str, phrases: Sequence[str], tokens: Sequence[str], *, text: str = "text", speaker: str | None = None, role: str | None = None,
    where: Column | None = None, newest: Column | None = None, limit: int = 20,
) -> DataFrame:
    """key, score, snippet of the rows that hold any term, by weighted hits; ties newest first, then by key.

    `where` is on columns of the scan, so it is pushed down; ranking is a top-k without a full sort. Rows without a hit go
    after the top-k, not before it: a filter would lower each text once for each term, the projection does so once.
    """
    parts = [holds(text, p).cast("int") * C.PHRASE_WEIGHT for p in phrases] + [holds(text, t).cast("int") * C.TOKEN_WEIGHT for t in tokens]
    parts += [holds(speaker, t).cast("int") * C.SPEAKER_WEIGHT for t in tokens if speaker] + [holds(role, t).cast("int") * C.ROLE_WEIGHT for t in tokens if role]
    score = sum(parts[1:], parts[0]) if parts else F.lit(0)
    found = df if where is None else df.where(where)
    scored = found.select(key, score.cast("int").alias("score"), F.left(F.col(text), F.lit(C.SNIPPET)).alias("snippet"), *([newest.alias("__newest")] if newest is not None else []))
    by = [F.col("score").desc(), *([F.col("__newest").desc_nulls_last()] if newest is not None else []), F.col(key).asc()]
    return scored.orderBy(*by).limit(limit).where("score > 0").select(key, "score", "snippet")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(df: DataFrame, key: str, vector: str, query: Sequence[float], *, where: Column | None = None, limit: int = 20) -> DataFrame:
    """key, vec_score (6 decimals): the nearest by cosine, exactly; a scan with a top-k, ties by key."""
    found = df if where is None else df.where(where)
    # The query's length is a constant; a row's dot product and length are one pass over it.
    length = sum(float(x) * float(x) for x in query) ** 0.5
    sums = F.aggregate(
        F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in query]), lambda p, q: F.struct(p.cast("double").alias("p"), q.alias("q"))),
        F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("own")),
        lambda s, x: F.struct((s["dot"] + x["p"] * x["q"]).alias("dot"), (s["own"] + x["p"] * x["p"]).alias("own")),
        lambda s: F.try_divide(s["dot"], F.sqrt(s["own"]) * F.lit(length)),
    )
    return found.select(key, F.round(sums, 6).alias("vec_score")).orderBy(F.col("vec_score").desc_nulls_last(), F.col(key)).limit(limit)


def ranked(df: DataFrame, *by: Column) -> DataFrame:
    """rank over a list that a limit has made short."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def fuse(keyword: DataFrame, vector: DataFrame, key: str, *, by: Sequence[str] = (), short: DataFrame | None = None, turns: bool = False, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of two short ranked lists (key, rank; vector also vec_score), or of many, a list for each value
    of `by`.

    Returns by, key, kw_rank, vec_rank, vec_score, found_in, pre_penalty, rrf. `short` (key, is_short) lowers the short ones.
    turns: the keys are fragments, and only the best of each turn stands when the list is cut.
    """
    k = keyword.select(*by, key, F.col("rank").alias("kw_rank"))
    v = vector.select(*by, key, F.col("rank").alias("vec_rank"), "vec_score")
    both = k.join(v, [*by, key], "full")
    part = lambda rank, w: F.coalesce(F.lit(float(w)) / (F.lit(C.RRF_K) + F.col(rank)), F.lit(0.0))
    scored = both.withColumn("pre_penalty", part("kw_rank", C.RRF_KEYWORD) + part("vec_rank", C.RRF_VECTOR))
    scored = scored.withColumn("found_in", F.when(F.col("vec_rank").isNull(), "keyword").when(F.col("kw_rank").isNull(), "vector").otherwise("both"))
    if short is not None:
        scored = scored.join(short.select(key, "is_short"), key, "left")
        scored = scored.withColumn("rrf", F.round(F.col("pre_penalty") * F.when(F.col("is_short"), C.SHORT_PENALTY).otherwise(1.0), 5)).drop("is_short")
    else:
        scored = scored.withColumn("rrf", F.round("pre_penalty", 5))
    scored = scored.withColumn("pre_penalty", F.round("pre_penalty", 5))
    if turns:
        scored = best_per_turn(scored, key, by)
    if not by:
        return scored.orderBy(F.col("rrf").desc(), F.col(key)).limit(limit)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("rrf").desc(), F.col(key)))
    return scored.withColumn("rank", place).where(F.col("rank") <= limit)


def best_per_turn(hits: DataFrame, chunk_id: str = "chunk_id", by: Sequence[str] = ()) -> DataFrame:
    """The best fragment of each turn: turn id is what stands before the last `_chunk_` (the whole id, if nothing does); ties
    go to keyword hits, then rank."""
    turn = F.regexp_extract(chunk_id, r"^(.*)_chunk_", 1)
    w = Window.partitionBy(*by, "turn_id").orderBy(F.col("rrf").desc(), F.col("kw_rank").isNull(), F.coalesce("kw_rank", "vec_rank"), F.col(chunk_id))
    return hits.withColumn("turn_id", F.when(turn == "", F.col(chunk_id).cast("string")).otherwise(turn)).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def balance(hits: DataFrame, group: str, key: str, n_groups: int, limit: int, score: str = "rrf") -> DataFrame:
    """Quota per group in rank order (limit // groups, at least one); leftovers fill; sorted by score again."""
    quota = max(1, limit // max(1, n_groups))
    inside = F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(key)))
    flagged = hits.withColumn("in_quota", inside <= quota)
    n_quota = flagged.where("in_quota").select(key, score, group, "in_quota")
    # More quota rows than places are cut by score; otherwise the rest fills by score as well: one order says both.
    return flagged.orderBy(F.col("in_quota").desc(), F.col(score).desc(), F.col(key)).limit(limit).select(n_quota.columns).orderBy(F.col(score).desc(), F.col(key))


def repaired_order(hits: DataFrame, key: str, proposed: Sequence, limit: int) -> DataFrame:
    """A proposed order of ids (say, a model's) made whole: unknown ids dropped, repeats once, missing ones after, as they stood (`rank`)."""
    places = {k: i for i, k in reversed(list(enumerate(proposed)))}
    position = F.lit(None).cast("long")
    if places:
        position = F.try_element_at(F.create_map(*[x for k, i in places.items() for x in (F.lit(k), F.lit(i).cast("long"))]), F.col(key))
    return hits.withColumn("new_rank", F.coalesce(position, F.lit(1_000_000) + F.col("rank"))).orderBy("new_rank").limit(limit)
