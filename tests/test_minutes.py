"""Line repair, sections, turns and the census on cases worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from talkweave.functions import fixed as K
from talkweave.functions import text as X
from talkweave.operators import turns as T


def lines_of(spark, lines):
    return spark.createDataFrame([(lines,)], "l array<string>").select(X.restored(F.col("l")).alias("r")).first().r


@pytest.mark.parametrize(
    "lines, want",
    [
        ([], []),
        (["가나다라.", "마바사", "abc", "def 12", "34 x"], ["가나다라.", "마바사", "abc", "def 12", "34 x"]),  # not Hangul on both sides
        (["긴문장입니다", "그리고"], ["긴문장입니다 그리고"]),  # an ending closes
        (["사람이 보", "호를"], ["사람이 보호를"]),  # a short token goes on
        (["개의하려고준비하", "겠습니다"], ["개의하려고준비하겠습니다"]),  # so does what must be joined
        (["가나다라마바", "사아자"], ["가나다라마바 사아자"]),
        (["가나더 ", "  라마 ", "바"], ["가나더라마 바"]),  # glued, the token has five characters, so the next line is parted
        (["가나다라마 바", "", "사"], ["가나다라마 바", "", "사"]),
        (["나라", "◯위원 말", "■ 보고사항", "의 사 일 정"], ["나라", "◯위원 말", "■ 보고사항", "의 사 일 정"]),
        (["  앞 빈칸", "  12 뒤 ", "x"], ["  앞 빈칸", "  12 뒤 ", "x"]),  # lines that stay keep their blanks
    ],
)
def test_line_repair(spark, lines, want):
    assert lines_of(spark, lines) == want


def blocks_of(spark, lines, page):
    got = spark.createDataFrame([(lines, page)], "l array<string>, p int").select(X.sections(F.col("l"), F.col("p")).alias("s")).first().s
    return [(b.section_type, b.text) for b in got]


def test_sections(spark):
    assert blocks_of(spark, ["■ 보고사항", "가", "■ 처리된 의안", "나", "◯위원 김하나", "의사일정"], 3) == [("report", "■ 보고사항\n가"), ("report", "■ 처리된 의안\n나\n◯위원 김하나\n의사일정")]
    assert blocks_of(spark, ["표지", "의사일정", "1. 심사", "상정된 안건", " ◯위원장 김하나", "말", "의사일정"], 1) == [("cover", "표지"), ("agenda", "의사일정\n1. 심사\n상정된 안건"), ("body", "◯위원장 김하나\n말\n의사일정")]
    assert blocks_of(spark, ["말", "의사일정", "◯위원 홍길동"], 5) == [("body", "말\n의사일정\n◯위원 홍길동")]
    assert blocks_of(spark, ["", "  "], 1) == [] and blocks_of(spark, [], 1) == []


def turns_of(spark, *pages):
    kind = "source_id string, page int, segments array<struct<section_type:string,text:string>>"
    df = spark.createDataFrame([("s", page, segments) for page, segments in pages], kind)
    return df, [(r.speaker, r.role, r.text, r.page_start, r.page_end) for r in T.turns(df).orderBy("turn_no").collect()]


def test_only_body_blocks_have_turns(spark):
    _, got = turns_of(
        spark,
        (1, [("cover", "◯위원 표지인"), ("body", "앞말\n◯위원장 김하나 시작합니다.\n둘째 줄\n◎홍길동 장관 예."), ("report", "■ 보고사항\n◯위원 나보고"), ("agenda", "의사일정\n◯위원 나일정")]),
        (2, [("cover", "이어진 말◯위원 안나옴 말"), ("agenda", "안 이어짐"), ("body", "또 이어짐\n◯출석 위원\n명단\n◯여러 위원 아니오"), ("cover", "뒤의 표지")]),
        (3, [("cover", "본문이 없는 쪽")]),
        (4, [("body", "끝까지 이어짐"), ("body", "◯박하늘 위원")]),
    )
    assert got == [
        ("김하나", "위원장", "시작합니다. 둘째 줄", 1, 1),
        ("홍길동", "장관", "예. 이어진 말 또 이어짐 끝까지 이어짐", 1, 4),
        ("박하늘", "위원", "", 4, 4),
    ]


def test_census_counts_nameless_headers_of_bodies(spark):
    df, _ = turns_of(spark, (1, [("body", "◯출석 위원\n◯여러 위원 아니오\n◯보고사항\n◯여러 위원 아니오\n◯출장 위원(1인)\n◯위원 아닌 출석 의원(2인)"), ("report", "◯모르는 머리 글 하나")]))
    assert [tuple(r) for r in T.dropped_headers(df).collect()] == [("여러 위원 아니오", 2)]


@pytest.mark.parametrize(
    "header, name, role",
    [
        ("위원장 나하나 자리를 정돈해 주십시오.", "나하나", "위원장"),
        ("다도현 위원 묻겠습니다.", "다도현", "위원"),
        ("기상청차장 라민서 예.", "라민서", "기상청차장"),
        ("증인 앨런스미스 맞습니다.", "앨런스미스", "증인"),
        ("참고인 마00 예.", "마00", "참고인"),
        ("환경부제2차관 바지우 예.", "바지우", "환경부제2차관"),
        ("(전)해군작전사령관 사은호 그렇습니다.", "사은호", "(전)해군작전사령관"),
        ("한빛㈜대표이사 아정민 예.", "아정민", "한빛㈜대표이사"),
        ("金一二 위원 알겠습니다.", "金一二", "위원"),
    ],
)
def test_headers(spark, header, name, role):
    s = spark.createDataFrame([(header,)], "h string").select(X.split_header(F.col("h")).alias("s")).first().s
    assert (s.name, s.role) == (name, role)


def test_patterns_stand_once_in_the_plan(spark):
    pages = spark.createDataFrame([("s", 1, "◯위원 김하나 말")], "source_id string, page int, text string")
    plan = T.turns(T.normalized(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(K.NOISE["meeting_header"]) == 1 and plan.count(K.SENTENCE_LAST) == 1
    assert len(re.findall(re.escape(K.SPEAKER_FORMS[0][0]), plan)) <= 3  # the form itself, and the two groups that it takes
