"""Queries against their SQL on made tables that hold what the small test tables lack."""

import random

import duckdb

from talkweave.plans import CORE_QUERIES, CORE_SQL


def differing(spark, at, name, **tables):
    """Rows of the query and its SQL that the other lacks, on tables made of (rows, schema)."""
    db = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    result = db.execute(CORE_SQL[name])
    names = [d[0] for d in result.description]
    want = {repr([r[names.index(c)] for c in sorted(names)]) for r in result.fetchall()}
    got = {repr([r[c] for c in sorted(names)]) for r in CORE_QUERIES[name](spark, str(at)).collect()}
    return got ^ want


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def document(i, text, source="src2"):
    return (i, text, "de", source, len(text))


def test_windows_over_sentences_that_begin_with_blanks(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(" " * rng.randint(1, 9) + rng.choice("xyz") * rng.randint(300, 490) + "." for _ in range(30)) for _ in range(120)]
    assert not differing(spark, tmp_path, "evidence_window", documents=([document(i, t) for i, t in enumerate(texts)], DOCS))


def test_capitals_are_letter_by_letter(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZÄ. " * 3 + "ßᾳŉ") for _ in range(300)) for _ in range(200)]
    assert not differing(spark, tmp_path, "source_audit", documents=([document(i, t) for i, t in enumerate(texts)], DOCS))


def test_pending_rows_of_every_source(spark, tmp_path):
    docs = [document(i, "text" if i else " ", f"src{i}") for i in range(8)]
    assert not differing(spark, tmp_path, "pending_antijoin", documents=(docs, DOCS), labels=([(3, 1, 0)], "doc_id long, quality int, toxic int"))
    assert {r.doc_id for r in CORE_QUERIES["pending_antijoin"](spark, str(tmp_path)).collect()} == {1, 2, 4, 5, 6, 7}
