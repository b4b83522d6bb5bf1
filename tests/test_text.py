"""Text functions: expectations by hand, and a fold in plain Python where order matters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from talkweave.functions import text as X
from talkweave.operators import chunk as K
from talkweave.operators import turns as T


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values)))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "line, noise",
    [("3 제415회-과학기술정보방송통신제1차(2024년6월11일)", True), ("12", True), ("12345", False), ("──────", True), ("- 3 -", True), ("(임시회)", True), ("국토교통위원회", True), ("", False), ("본문입니다.", False)],
)
def test_noise(spark, line, noise):
    assert one(spark, X.is_noise, line) is noise


@pytest.mark.parametrize(
    "prev, nxt, whole",
    [("국가경", "쟁력 강화", "국가경쟁력 강화"), ("말씀드리겠습니다", "다음은", "말씀드리겠습니다 다음은"), ("위원회에서 개의하", "겠습니다", "위원회에서 개의하겠습니다"), ("정부는", "앞으로", "정부는 앞으로"), ("alpha", "beta", "alpha beta"), ("", "가나", "가나")],
)
def test_joined(spark, prev, nxt, whole):
    assert one(spark, X.joined, prev, nxt) == whole


@pytest.mark.parametrize(
    "header, name, role",
    [
        ("위원장 김하나", "김하나", "위원장"), ("외교부장관 홍길동", "홍길동", "외교부장관"), ("국토교통부제2차관 박이나", "박이나", "국토교통부제2차관"), ("김하나 위원", "김하나", "위원"),
        ("박하늘", "박하늘", None), ("어떤 위원", None, None), ("증인 이하나", "이하나", "증인"), ("보고사항입니다 오늘은", None, None),
    ],
)
def test_speaker(spark, header, name, role):
    got = one(spark, X.speaker, header)
    assert (got and got["name"], got and got["role"]) == (name, role)


def test_header_split(spark):
    got = one(spark, X.split_header, "김하나 위원 질의하겠습니다 장관님")
    assert (got["name"], got["role"], got["rest"]) == ("김하나", "위원", "질의하겠습니다 장관님")


def test_suffix(spark):
    assert [one(spark, X.without_suffix, w) for w in ("위원회에서의", "정부는", "나는", "국가")] == ["위원회", "정부", "나는", "국가"]


def test_dates(spark):
    assert [str(d) for d in one(spark, X.dates_in, "2025-07-14 2025-13-01 2025-02-30 2024-02-29")] == ["2025-07-14", "2024-02-29"]
    assert one(spark, X.iso_date, "20240611") == "2024-06-11"
    assert one(spark, X.iso_date, "2024") == "2024"


def test_speaker_group(spark):
    roles = ["위원", "수석전문위원", "증인", "장관후보자", "통일부장관", "금융위원장", "손님"]
    assert [one(spark, X.speaker_group, r) for r in roles] == ["assembly", "staff", "witness", "unknown", "government", "government", "unknown"]


def test_turns_go_on_over_pages(spark):
    pages = spark.createDataFrame([("s", 1, "◯위원장 김하나 시작합니다."), ("s", 2, "이어집니다.\n◯홍길동 위원 질문입니다."), ("s", 3, "◯출석 위원\n명단\n◯박하늘 위원 끝.")], "source_id string, page int, text string")
    rows = T.turns(T.normalized(pages)).orderBy("turn_no").collect()
    assert [(r.turn_id, r.speaker, r.page_start, r.page_end) for r in rows] == [("s_turn_0001", "김하나", 1, 2), ("s_turn_0002", "홍길동", 2, 2), ("s_turn_0003", "박하늘", 3, 3)]
    assert "이어집니다." in rows[0].text and "명단" not in "".join(r.text for r in rows)


def fold(text, limit, hard):
    """Buffers as texts: what joins one is stripped with it, what begins one keeps its blanks until it is closed."""
    parts = re.split(r"(?<=[.!?。])(?=\s|[^\d\s])", text)
    parts = [p[i : i + hard] for p in parts for i in range(0, max(len(p), 1), hard)]
    out = [""]
    for p in parts:
        if out[-1] and len(out[-1]) + len(p) + 1 > limit:
            out.append(p)
        else:
            out[-1] = f"{out[-1]} {p}".strip() if out[-1] else p
    return [x.strip() for x in out]


def test_packing_is_the_fold(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab 3.4! ?") for _ in range(n)) for n in (0, 1, 30, 200, 900)] + ["x" * 500, "1.5 and 2.5. End!Next"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select("id", K.packed(K.hard_split(K.sentences(F.col("text")), 70), 50).alias("p")).collect()
    for r in rows:
        assert r.p == fold(texts[r.id], 50, 70)
        assert "".join("".join(r.p).split()) == "".join(texts[r.id].split())


def test_sizes_count_the_blanks_between_sentences(spark):
    df = spark.createDataFrame([("Aaaa.   Bbbb.   Cccc.",), ("",), (None,), ("  short  ",)], "t string")
    got = [r.p for r in df.select(K.packed(K.sentences(F.col("t")), 14).alias("p")).limit(1).collect()]
    assert got == [["Aaaa.    Bbbb.", "Cccc."]]  # 5 + 1 + 8, and then 14 + 1 + 8 is too much
    rows = K.chunks(df.select(F.monotonically_increasing_id().alias("k"), F.col("t")), ["k"], "t", max_chars=30).collect()
    assert sorted(r.chunk_text for r in rows) == ["", "", "Aaaa.   Bbbb.   Cccc.", "short"]


def test_batches(spark):
    df = spark.range(45).withColumnRenamed("id", "k")
    got = sorted(r["n"] for r in K.fixed_batches(df, "k", 20).groupBy("batch").agg(F.count("*").alias("n")).collect())
    assert got == [5, 20, 20]
    sized = spark.createDataFrame([("g", i, n) for i, n in enumerate([50, 60, 10, 200, 5])], "g string, k int, n int")
    assert [r["batch"] for r in K.budget_batches(sized, "g", "k", "n", items=2, chars=100).orderBy("k").collect()] == [0, 1, 1, 2, 3]


@pytest.mark.parametrize(
    "text, span",
    [
        ("2025년 7월 14일부터 9월 1일까지", ("2025-07-14", "2025-09-01")), ("2025년 7월부터 2025년 9월까지", ("2025-07-01", "2025-09-30")), ("2025년 13월 40일", (None, None)), ("9월 1일", (None, None)),
        ("3월과 2024-05-02", ("2024-03-01", "2024-05-02")), ("2024년 2월", ("2024-02-01", "2024-02-29")),
    ],
)
def test_question_dates(text, span):
    from talkweave.functions.question import parse

    got = parse(text, {})
    assert tuple(d and d.isoformat() for d in (got.date_from, got.date_to)) == span


def test_question_names():
    from talkweave.functions.question import parse

    got = parse("국토교통위원회와 국토위 그리고 정무위 2024-05-02 논의", {"국토교통위원회": "국토위", "국토위": "국토위", "정무위": "정무위"})
    assert (got.names, got.text) == (["국토위", "정무위"], "국토교통위원회와 국토위 그리고 정무위 논의"), "dates go, names stay"


def test_callers_filters_come_first():
    from datetime import date

    from talkweave.functions.question import search_filters

    names = {"국방위": "국방위"}
    auto = search_filters("국방위 2024-05-02 논의", names)
    assert (auto.names, auto.date_from, auto.date_to) == (["국방위"], date(2024, 5, 2), date(2024, 5, 2))
    told = search_filters("국방위 2024-05-02 논의", names, committee="외통위", date_from=date(2024, 1, 1))
    assert (told.names, told.date_from, told.date_to) == (["외통위"], date(2024, 1, 1), date(2024, 5, 2))


def test_alias_twins():
    from talkweave.operators.search import query_terms, with_twins

    old, new = "\uf9c9榮夏", "\u67f3榮夏"  # the compatibility character and its standard form
    twins = with_twins({"유영하": [old]})
    assert twins == {"유영하": sorted({old, new}), old: sorted({"유영하", new}), new: sorted({"유영하", old})}
    assert set(query_terms("유영하", {"유영하": [old]})[1]) == {"유영하", old, new}


def test_cached_embedding():
    from talkweave.functions.question import cached

    asked = []
    embed = cached(lambda texts: asked.append(list(texts)) or [[float(len(t))] for t in texts], size=2)
    assert embed(["a", "bb", "a"]) == [[1.0], [2.0], [1.0]] and embed(["bb", "ccc"]) == [[2.0], [3.0]] and embed(["a"]) == [[1.0]]
    assert asked == [["a", "bb"], ["ccc"], ["a"]]


def test_nfkc(spark):
    from talkweave.functions.question import nfkc

    assert one(spark, nfkc, " 柳榮夏 ") == "柳榮夏"


def test_packing_follows_its_definition_where_sentences_are_blank(spark):
    """Hard pieces may be blank or end in blanks: the fold over places gives what joining the texts one by one gives."""
    import random

    rng = random.Random(5)

    def defined(parts, most):
        out, last = [], ""
        for x in parts:
            if last == "":
                last = x
            elif len(last) + len(x) + 1 > most:
                out, last = [*out, last.strip()], x
            else:
                last = f"{last} {x}".strip()
        return [*out, last.strip()]

    rows = [(i, [rng.choice(["", " ", "   ", "ab", " ab", "abc  ", "  abcd  ", "\nabcdef\n", "ab cd"]) for _ in range(rng.randint(1, 12))]) for i in range(400)]
    for most in (6, 14):
        got = spark.createDataFrame(rows, "id int, p array<string>").select("id", K.packed(F.col("p"), most).alias("p")).collect()
        assert {r.id: list(r.p) for r in got} == {i: defined(p, most) for i, p in rows}
