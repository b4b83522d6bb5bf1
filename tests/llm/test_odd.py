"""Rows that are rare in the given tables: very long words and lines, columns whose names clash, repeated vectors."""

import hashlib

import pytest
from pyspark.sql import functions as F

from talkweave.llm import bpe, embedding_dedup, html_extract, license_scan, lm_scoring, packing, quality_rules, simhash, substring_dedup, toxicity

MEGA = 1 << 20
#: One word, one line of short words, one line of marks, and letters of another script.
LONG = ["ab" * (MEGA // 2), "so it is " * (MEGA // 9), "#*" * (MEGA // 2), "말" * (MEGA // 3)]


@pytest.fixture(scope="module")
def long_texts(spark):
    return spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns named as the operators name theirs."""
    rows = [(1, "the first text has some words", "en", 0, 0, b"", 1.5, True, "x"), (2, None, None, 0, 0, b"", 1.5, False, "y"), (2, "the first text has some words", "en", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, chunk long, bucket int, ids binary, score double, learn boolean, tokens string")


def test_long_words_and_lines(spark, long_texts):
    v = bpe.default_vocabulary()
    coded = bpe.decode(bpe.encode(long_texts, v), v).select("doc_id", F.sha2("decoded", 256).alias("h")).collect()
    assert {r.doc_id: r.h for r in coded} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(LONG)}
    assert license_scan.scan_documents(long_texts).where("n_base = 0").count() == len(LONG)
    scored = lm_scoring.score(long_texts, F.lit(True)).collect()
    assert {r.doc_id: r.n_tokens for r in scored} == {i: len(t.split()) + 1 for i, t in enumerate(LONG)}
    packed = packing.pack(long_texts).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(packed) == len(LONG) and all(r.n == r.m for r in packed)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(long_texts, labels).where("score between 0 and 1").count() == len(LONG)
    assert quality_rules.apply_rules(long_texts, labels).count() == len(LONG)
    assert simhash.near_duplicates(long_texts).where("component_id = doc_id").count() == len(LONG)
    pages = long_texts.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("<html><body><article><p>"), "text", F.lit("</p></article></body></html>")).alias("html"))
    assert {r.page_id: r.n_chars for r in html_extract.main_text(pages).withColumn("n_chars", F.length("text")).collect()} == {i: len(" ".join(t.split())) for i, t in enumerate(LONG)}


def test_long_pre_tokens_are_not_kept():
    encoder = bpe.Encoder(bpe.default_vocabulary())
    word = "q" * (bpe.MEMO_CHARS + 1)
    assert encoder.encode(word) == encoder.encode(word) != b"" and word not in encoder
    assert encoder.encode(word[1:]) and word[1:] in encoder


def test_clashing_columns(spark, clashing):
    plain = clashing.select("doc_id", "text", "lang")
    v = bpe.default_vocabulary()
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(bpe.decode(bpe.encode(clashing, v), v)) == rows(bpe.decode(bpe.encode(plain, v), v))
    assert rows(lm_scoring.score(clashing, F.lit(True))) == rows(lm_scoring.score(plain, F.lit(True)))
    assert rows(simhash.near_duplicates(clashing)) == rows(simhash.near_duplicates(plain))
    assert rows(packing.pack(clashing).select("doc_id", "start", "length", "ids_crc32")) == rows(packing.pack(plain).select("doc_id", "start", "length", "ids_crc32"))
    assert substring_dedup.repeated_passages(clashing).count() == 0
    pages = lambda df: df.withColumns({"page_id": F.col("doc_id"), "url": F.lit("u"), "html": F.col("text")})
    assert rows(html_extract.main_text(pages(clashing).drop("text")).select("page_id", "text")) == rows(html_extract.main_text(pages(plain).drop("text")).select("page_id", "text"))


def test_repeated_and_nameless_vectors(spark):
    """Repeated rows link with each other, a null vec_id takes part, and columns of the operator's own names are ignored."""
    a, b = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    rows = [(3, a, 1, "x", 0), (3, a, 1, "y", 0), (None, a, 1, "z", 0), (7, b, 1, None, 0), (None, b, 2, None, 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, weight int")).collect()
    want = [(3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, None), (7, 0, 7, True), (None, 0, None, None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_a_stored_model_scores_other_texts(spark):
    """Scores by a model that learned apart are those of learning and scoring at once; its blocks come back from a table."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 23}" for k in range(60)), i % 3 != 0) for i in range(90)], "doc_id long, text string, learns boolean")
    model = lm_scoring.learned(docs.where("learns").drop("learns"), chunk=700)
    apart = lm_scoring.score_with(model, docs.drop("learns"), chunk=900)
    at_once = lm_scoring.score(docs, F.col("learns"))
    rows = lambda df: {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()}
    assert rows(apart) == rows(at_once)
    one, other = ({r.doc_id: r.score for r in df.collect()} for df in (apart, at_once))
    assert all(abs(one[i] - other[i]) < 2 for i in one)  # buckets may differ, and false answers with them
    held = model.blocks.agg(F.sum(F.length("bits")).alias("n")).first().n
    assert 0 < held < 64 * 1024


def test_a_model_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = lm_scoring.learned(docs.where("false"))
    assert [(r.doc_id, r.n_tokens, r.n_known, r.score) for r in lm_scoring.score_with(model, docs).orderBy("doc_id").collect()] == [(1, 3, 0, 0.0), (2, 1, 0, 0.0)]
