"""The trigram index, the inverted file and retrieval for tables of questions, against scans."""

import datetime
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.operators import cells, questions, search, trigram
from talkweave.session import fresh

WORDS = ["Alpha", "betabeta", "ΓΔΕ", "ab", "a", "50%", "under_score", "back\\slash", "東京都庁", "naïve", "x", "Gamma ray", "'quote'", "ray"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))]), rng.choice(["Kim", "Lee", None]), rng.choice(["north", "south"]), datetime.date(2024, 1, 1 + i % 28), [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    return spark.createDataFrame(data, "id long, text string, speaker string, committee string, day date, vector array<float>")


@pytest.fixture(scope="module")
def index(spark, rows):
    return trigram.build(rows, "id", ["text", "speaker"], fresh(spark, "t"), slots=4, parts=4)


@pytest.mark.parametrize("terms", [["alpha"], ["BETA"], ["γδε"], ["50%"], ["r_s"], ["k\\s"], ["東京都"], ["aïv"], ["a ra"], ["'quote'"], ["ab"], ["x", "zzz"], ["zzz"], ["zzzz", "Kim"], ["ray", "Alpha", "lee"], []])
def test_index_equals_scan(spark, rows, index, terms):
    want = {r.id for r in rows.collect() if any(t.lower() in (f or "").lower() for t in terms for f in (r.text, r.speaker))}
    got = trigram.holding(index, spark, terms)
    assert sorted(r.id for r in got.collect()) == sorted(want)
    assert got.columns == rows.columns


def test_index_reads_the_folders_of_its_grams(spark, index):
    plan = trigram._one(index, spark, "betabeta")._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan.*postings.*", plan)
    assert len(scans) == trigram.LISTS and all(re.search(r"PartitionFilters: \[[^\]]*slot#\d+ = ", s) and "EqualTo(gram" in s for s in scans)


def test_empty_index(spark, rows):
    empty = trigram.build(rows.limit(0), "id", ["text"], fresh(spark, "t"))
    assert trigram.holding(empty, spark, ["alpha"]).count() == 0 and trigram.holding(empty, spark, ["a"]).count() == 0


def test_indexed_search_scores_as_the_scan(spark, rows, index):
    options = dict(speaker="speaker", newest=F.col("day"), where=F.col("committee") == "north", limit=15)
    for phrases, tokens in ([], ["alpha", "ray"]), (["gamma ray"], ["gamma", "kim"]):
        want = search.keyword_search(rows, "id", phrases, tokens, **options).collect()
        assert want and trigram.keyword_search(index, spark, phrases, tokens, **options).collect() == want


@pytest.fixture(scope="module")
def filed(spark):
    """3,000 vectors around 40 points, and some without a direction."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(40, 32))
    x = points[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 32))
    data = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(5000, None, 0), (5001, [0.0] * 32, 0), (5002, [float("nan")] * 32, 0), (5003, [None] * 32, 0)]
    df = spark.createDataFrame(data, "id long, vector array<double>, kind int")
    return df, cells.build(df, "id", "vector", fresh(spark, "c")), x


def test_recall_of_few_cells(spark, filed):
    df, index, x = filed
    found = total = 0
    for i in range(0, 3000, 150):
        want = {r.id for r in search.vector_search(df.where("id < 5000"), "id", "vector", x[i].tolist(), where=F.col("kind") != 1).collect()}
        got = cells.vector_search(index, spark, x[i].tolist(), where=F.col("kind") != 1)
        found, total = found + len(want & {r.id for r in got.collect()}), total + len(want)
    assert found / total >= 0.95
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (IN|INSET)", plan)
    assert len(index.centroids) > 4 * cells.PROBES
    assert index.rows(spark).where("cell = -1").count() == 4 and index.rows(spark).count() == 3004


def test_many_questions_ask_as_one(spark, rows, index):
    asked = [(1, "Alpha ray", None, None, None), (2, "the Gamma ray, naïve?", ["north"], None, None), (3, "ab", None, datetime.date(2024, 1, 5), datetime.date(2024, 1, 9)), (4, "", None, None, None), (5, "zzzz", ["south"], None, None), (6, "Kim x", [], None, datetime.date(2024, 1, 20))]
    q = spark.createDataFrame(asked, "q int, text string, names array<string>, date_from date, date_to date")
    got = questions.keyword_lists(index, q, speaker="speaker", committee="committee", date="day", newest="day", aliases={"Alpha": ["betabeta"]}, limit=7).collect()
    for number, text, names, first, last in asked:
        phrases, tokens = search.query_terms(text, {"Alpha": ["betabeta"]})
        where = F.lit(True)
        where = where & F.col("committee").isin(names) if names else where
        where = where & (F.col("day") >= first) if first else where
        where = where & (F.col("day") <= last) if last else where
        want = search.keyword_search(rows, "id", phrases, tokens, speaker="speaker", where=where, newest=F.col("day"), limit=7).collect() if tokens else []
        assert [(r.id, r.score) for r in want] == [(r.id, r.score) for r in sorted((g for g in got if g.q == number), key=lambda g: g["rank"])]


def test_many_vectors_ask_as_one(spark, filed):
    df, index, x = filed
    asked = [(i, x[i * 9].tolist(), ["1"] if i % 2 else None) for i in range(6)] + [(7, None, None), (8, [0.0] * 32, None)]
    q = spark.createDataFrame(asked, "q int, vector array<double>, names array<string>")
    named = spark.read.parquet(f"{index.at}/rows")
    assert named.columns == ["id", "vector", "kind", "cell"]
    exact = questions.vector_lists(index, q.drop("names"), probes=None, limit=9).collect()
    few = questions.vector_lists(index, q.drop("names"), limit=9).collect()
    for i in range(6):
        want = [(r.id, r.vec_score) for r in search.vector_search(df.where("id < 5000"), "id", "vector", x[i * 9].tolist(), limit=9).collect()]
        assert want == [(r.id, r.vec_score) for r in sorted((g for g in exact if g.q == i), key=lambda g: g["rank"])]
    assert {r.q for r in exact} == set(range(6))
    assert len({(r.q, r.id) for r in few} & {(r.q, r.id) for r in exact}) >= 0.95 * len(exact)


def test_question_words():
    assert search.query_tokens("과기부에서 정부의 반응은 어떻게 했나요?") == ["과기부", "정부", "반응"]
    assert search.query_terms("  '과기부에서' AI  ", {"과기부": ["과기정통부"], "AI": ["인공지능"]}) == (["'과기부에서' AI"], ["과기부", "과기정통부", "AI", "인공지능"])
    assert search.query_terms("AI 기본법", {"AI 기본법": ["AI기본법"]})[0] == ["AI 기본법", "AI기본법"]
    assert search.query_terms("의 a 발언") == (["의 a 발언"], [])


def test_fragments_of_a_turn_count_once_before_the_cut(spark):
    k = spark.createDataFrame([(1, f"t{i // 3}_chunk_{i:03d}", i + 1) for i in range(12)], "q int, chunk_id string, rank int")
    v = spark.createDataFrame([], "q int, chunk_id string, rank int, vec_score double")
    got = search.fuse(k, v, "chunk_id", by=["q"], turns=True, limit=4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["t0_chunk_000", "t1_chunk_003", "t2_chunk_006", "t3_chunk_009"]


def test_quota_of_many_questions(spark):
    rows = [(1, i, "north" if i < 8 else "south", 1.0 - i / 100) for i in range(12)] + [(2, i, "north", 1.0 - i / 100) for i in range(6)]
    hits = spark.createDataFrame(rows, "q int, id int, committee string, rrf double")
    asked = spark.createDataFrame([(1, ["north", "south"]), (2, None)], "q int, names array<string>")
    got = questions.balanced_lists(hits, asked, "committee", "id", 4).collect()
    assert sorted(r.id for r in got if r.q == 1) == [0, 1, 8, 9] and sorted(r.id for r in got if r.q == 2) == [0, 1, 2, 3]


def test_blocks_of_vectors_give_what_all_pairs_give(spark, tmp_path, monkeypatch):
    """Many copies of a vector, limits that leave little, and blocks that are smaller than a list."""
    import numpy as np

    from talkweave.operators import cells as V
    from talkweave.operators import questions as Q
    from talkweave.operators import search as S

    monkeypatch.setattr(Q, "ROWS", 40)
    monkeypatch.setattr(Q, "ASKED", 7)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8)).round(2)
    rows = [(i, base[i % 60 if i % 3 else 0].tolist() if i % 50 else None, f"s{i % 3}" if i % 7 else None, i % 90 if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, v array<double>, who string, day int")
    cells = V.build(df, "k", "v", str(tmp_path / "cells"))
    asked = df.where("k % 9 = 1").select(F.col("k").alias("q"), F.col("v").alias("vector"), F.when(F.col("k") % 2 == 0, F.col("who")).alias("speaker"), F.when(F.col("k") % 4 > 0, F.array(F.lit("s1"), F.lit("s2"))).alias("names"), (F.col("day") - 30).alias("date_from"), (F.col("day") + 30).alias("date_to"))
    got = Q.vector_lists(cells, asked, committee="who", speaker="who", date="day", probes=None, limit=12)
    pairs = df.join(asked, Q.allowed(asked.withColumnRenamed("speaker", "speaker"), "who", "who", "day")).select("q", "k", F.round(S.cosine(F.col("v"), F.col("vector")), 6).alias("vec_score")).where("vec_score IS NOT NULL")
    want = Q.first_of_each(pairs, 12, F.col("vec_score").desc(), F.col("k"))
    plain = lambda d: sorted((r.q, r["rank"], r.k, r.vec_score) for r in d.collect())
    assert plain(got) == plain(want) and got.count() > 100
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_common_terms_of_many_questions_make_no_row_for_each_hit(spark, monkeypatch):
    """Terms that nearly every row holds, in blocks that are smaller than a list; terms with blanks, marks and of one letter."""
    from talkweave.operators import questions as Q

    monkeypatch.setattr(Q, "WORDED", 3)
    monkeypatch.setattr(Q, "FEW", 40)
    rng = random.Random(5)
    data = [(i, rng.choice([None, "", "  ", *[" ".join(rng.choices(["these", "Those", "THESEthose", "o se", "the", "İx", "Σας"], k=rng.randint(1, 30))) for _ in range(9)]]), rng.choice([1.5, float("nan"), None, 2.0])) for i in range(300)]
    df = spark.createDataFrame(data, "id long, text string, age double")
    asked = [(1, "these those"), (2, "those  these"), (3, "hese the"), (4, "the These those these"), (5, "σας İx"), (6, "o se these"), (7, None)]
    q = spark.createDataFrame(asked, "q int, text string")
    got = Q.keyword_lists(df, q, key="id", newest="age", aliases={"the": ["s"], "those": ["these t", " "]}, limit=50)
    held = F.contains(F.lower("text"), F.lower("term"))
    pairs = df.crossJoin(Q.terms(q, {"the": ["s"], "those": ["these t", " "]})).where(held).groupBy("q", "id", "age").agg(F.sum(F.when(F.col("phrase"), 2).otherwise(1)).cast("int").alias("score"))
    want = Q.first_of_each(pairs, 50, F.col("score").desc(), F.col("age").desc_nulls_last(), F.col("id"))
    plain = lambda d: sorted((r.q, r["rank"], r.id, r.score) for r in d.collect())
    assert plain(got) == plain(want) and len({r.q for r in got.collect()}) == 6
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_postings_are_lists_of_keys(spark, rows, index, monkeypatch):
    """A row for each gram of a slice, not for each gram and text; every gram of every text stands in one of them."""
    monkeypatch.setattr(trigram, "SLICE", 300)
    low = [(r.id, f, (r[f] or "").lower()) for r in rows.collect() for f in ("text", "speaker")]
    want = {(f, t[k : k + 3], i) for i, f, t in low for k in range(len(t) - 2)}
    for lists in (trigram.lists_of(rows, "id", ["text", "speaker"]).collect(), index.table(spark, "postings").collect()):
        got = [(r.field, r.gram, i) for r in lists for i in r["keys"]]
        assert sorted(got) == sorted(want) and all(r.n == len(r["keys"]) for r in lists) and 2 * len(lists) < len(got)


def test_word_hits_meet_in_blocks(spark, monkeypatch):
    """The best rows by words in common equal brute force, with repeated keys and nulls, and no join is on a word."""
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, [rng.choice("abcdefghijkl") for _ in range(rng.randrange(9))]])) for _ in range(150)]
    df = spark.createDataFrame(rows, "k long, w array<string>")
    queries = df.where("k % 4 = 0 or k is null").select(F.col("k").alias("q"), F.col("w").alias("qw"))
    want = Counter()
    for q, asked in rows:
        for k, held in rows:
            if q is not None and k is not None and q % 4 == 0 and q != k:
                want[q, k] += len(set(asked or ()) & set(held or ()))
    for most in (search.ROWS, 20):
        monkeypatch.setattr(search, "ROWS", most)
        monkeypatch.setattr(search, "ASKED", most // 2)
        hits = search.word_hits(df, queries, "k", "q", F.col("w"), F.col("qw"), limit=5)
        got = sorted((r.q, r["rank"], -r.n_hits, r.k) for r in hits.collect())
        assert got == [(q, i + 1, *x) for q in range(0, 60, 4) for i, x in enumerate(sorted((-n, k) for (x, k), n in want.items() if x == q and n)[:5])]
    assert "SortMergeJoin" not in hits._jdf.queryExecution().executedPlan().toString()


def test_best_rows_of_many_questions_by_brute_force(monkeypatch):
    """Texts and questions in steps, groups and tiles that are smaller than the block; limits, two columns, odd blanks; and a
    term with blanks is looked for only in texts in which its inner words follow each other."""
    import pyarrow as pa
    from talkweave.operators import questions as Q

    for name, value in (("STEP", 192), ("FIRST", (64, 128)), ("GROUP", 16), ("TILE", 5), ("BYTES", 40), ("HITS", 60), ("KEPT", 3)):
        monkeypatch.setattr(Q, name, value)
    rng = random.Random(9)
    words = ["the", "then", "lathe", "é", "été", "a", "these", "überlang-gewordenes", "überlang", "wordenes", "x\x1cy", "of"]
    text = lambda n: rng.choice([" ", " ", " ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(0, n)))
    rows = [(i, rng.choice([None, text(40), text(40), " " + text(9)]), rng.choice([None, "the é", "of"]), rng.choice([None, "n", "s"]), rng.choice([None, *range(9)])) for i in range(500)]
    rng.shuffle(rows)
    term = lambda: rng.choice([rng.choice(words), rng.choice(words)[:2], " ".join(rng.choices(words, k=rng.randint(2, 5))), " ", "e  t", "o", "den"])
    asked = [(q, [(term(), rng.random() < 0.4) for _ in range(rng.randint(0, 6))], rng.choice([None, [], ["n"], ["s", "z"]]), rng.choice([None, 3, 12])) for q in range(81)]
    held = pa.table({c: pa.array(x, k) for c, x, k in zip(("key", "in_0", "in_1", "of_committee", "of_date"), zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))})
    kind = pa.list_(pa.struct([("term", pa.string()), ("phrase", pa.bool_())]))
    wanted = pa.table({"q": [a[0] for a in asked], "terms": pa.array([[{"term": t, "phrase": p} for t, p in a[1]] for a in asked], kind), "names": pa.array([a[2] for a in asked], pa.list_(pa.string())), "date_from": pa.array([a[3] for a in asked], pa.int64())})
    want = []
    for q, terms, names, first in asked:
        score = {k: sum((2 if p else 1) * (t in (a or "")) + (0 if p else 3) * (t in (b or "")) for t, p in terms) for k, a, b, c, d in rows if (not names or c in names) and (first is None or d is not None and d >= first)}
        want += [(q, k, n) for k, n in sorted(score.items(), key=lambda x: (-x[1], x[0])) if n][:7]
    got = Q._best_rows(held, wanted, [(2, 1), (0, 3)], 7).to_pydict()
    assert sorted(zip(got["q"], got["key"], got["score"])) == sorted(want) and len(want) > 150

    block = pa.table({"terms": pa.array([[{"term": "xa b c xd", "phrase": True}]], kind)})
    looked = Q._Words(pa.array(["a b c d", "c b a d", "za b c dz", None, "a b\nc d", "b a c d"]), Q._Asked(block))
    assert Q._places(looked.being(np.array([len(looked.whole) - 1])))[1][:3].tolist() == [0, 2, 4]


def test_keyword_lists_of_the_evaluation_are_made_once(spark):
    from talkweave.plans import CORE_QUERIES

    plan = CORE_QUERIES["eval_by_axis"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 2 and "/lists-" in plan
