"""Search, evidence, analytics, gates, evaluation, layers, streams: small tables and expectations by hand."""

from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF
from talkweave.operators import analytics as A
from talkweave.operators import evaluate as V
from talkweave.operators import evidence as E
from talkweave.operators import gates as G
from talkweave.operators import search as S
from talkweave.sources import layers as L
from talkweave.streaming import ratelimit, windows


def test_wildcards_are_text(spark):
    df = spark.createDataFrame([(1, "50% off"), (2, "5000 off"), (3, "a_b"), (4, "acb"), (5, "back\\slash"), (6, None)], "k int, text string")
    hit = lambda t: [r.k for r in S.keyword_search(df, "k", [], [t]).collect()]
    assert (hit("50%"), hit("a_b"), hit("\\s")) == ([1], [3], [5])


def test_query_terms_have_an_order():
    assert S.query_terms("aa bb", {"aa": ["zz", "cc"]}) == (["aa bb"], ["aa", "cc", "zz", "bb"])
    assert S.query_terms("one") == ([], ["one"])


def test_fusion_and_best_fragment(spark):
    k = spark.createDataFrame([("m_turn_1_chunk_001", 1), ("m_turn_1_chunk_002", 2)], "chunk_id string, rank int")
    v = spark.createDataFrame([("m_turn_1_chunk_002", 1, 0.9), ("m_turn_2_chunk_001", 2, 0.5)], "chunk_id string, rank int, vec_score double")
    rows = {r.chunk_id: r for r in S.fuse(k, v, "chunk_id").collect()}
    assert rows["m_turn_1_chunk_002"].rrf == round(1.2 / 62 + 1 / 61, 5) and rows["m_turn_1_chunk_002"].found_in == "both"
    best = S.best_per_turn(S.fuse(k, v, "chunk_id")).collect()
    assert {(r.turn_id, r.chunk_id) for r in best} == {("m_turn_1", "m_turn_1_chunk_002"), ("m_turn_2", "m_turn_2_chunk_001")}


@pytest.mark.parametrize("sizes, want", [((7, 3), {"a": 3, "b": 3}), ((8, 1), {"a": 5, "b": 1})])
def test_quota(spark, sizes, want):
    rows = [(f"{g}{i}", g, 1.0 - i / 100 - (g == "b") / 2) for g, n in zip("ab", sizes) for i in range(n)]
    hits = spark.createDataFrame(rows, "k string, g string, rrf double")
    assert {r.g: r.n for r in S.balance(hits, "g", "k", 2, 6).groupBy("g").agg(F.count("*").alias("n")).collect()} == want


def test_repaired_order(spark):
    hits = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, rank int")
    assert [r.k for r in S.repaired_order(hits, "k", ["c", "x", "c", "a"], 5).collect()] == ["c", "a", "b"]


def test_window_never_cuts_the_hit():
    parts = ["a" * 30, "b" * 30, "c" * 30, "d" * 30]
    got = E.assembled(parts, 2, 70)
    assert "c" * 30 in got and len(got) <= 72 and got.count("…") >= 1
    assert E.assembled(parts[:2], 0, 100) == " ".join(parts[:2])


@pytest.mark.parametrize(
    "parts, hit, limit, want",
    [
        (["aaaa", "bbbb", "cccc", "dddd"], 1, 14, "aaaa bbbb cccc"),  # before, then after, in each round
        (["aaaa", "bbbb", "cccc", "dddddddd"], 2, 16, "aaaa bbbb cccc"),  # room for two is no room for an end
        (["a" * 20, "bb", "c" * 20], 1, 22, "…" + "a" * 8 + " bb " + "c" * 8 + "…"),  # half of 20, less two; and what is left
        (["a" * 20, "bb"], 1, 12, "…" + "a" * 8 + " bb"),
        (["bb", "c" * 20], 0, 12, "bb " + "c" * 8 + "…"),
        (["a" * 9, "bb", "cc"], 1, 10, "…aaa bb cc"),
    ],
)
def test_window_takes_turns(parts, hit, limit, want):
    assert E.assembled(parts, hit, limit) == want


def test_turn_without_its_hit_begins_at_the_first_fragment(spark):
    df = spark.createDataFrame([("t", i, c * 10, False) for i, c in enumerate("abc")], "k string, i int, x string, hit boolean")
    assert E.windows(df, "k", "i", "x", "hit", 15).first().evidence == "a" * 10 + " bbb…"


def test_grounding(spark):
    hits = spark.createDataFrame([("q1", None, 0.4), ("q2", None, 0.39), ("q3", 1, 0.1), ("q4", None, None)], "q string, kw_rank int, vec_score double")
    assert {r.q: r.gate for r in E.pre_gate(hits, "q").collect()} == {"q1": "PASS", "q2": "REFUSED", "q3": "PASS", "q4": "PASS"}
    asked = spark.createDataFrame([("q1",), ("q9",)], "q string")
    assert {r.q: (r.gate, r.n_hits) for r in E.pre_gate(hits, "q", asked).collect()} == {"q1": ("PASS", 1), "q9": ("NONE", 0)}
    df = spark.createDataFrame([("fine [1]", 1, 0), ("fine [1] [9]", 1, 1), ("cannot be confirmed [1]", 1, 0), ("not mentioned", 0, 0), ("claim", 0, 0), ("fine [1]\n## 논의의 한계\ncannot be confirmed", 1, 0)], "a string, c int, i int")
    got = df.select(*E.judged(F.col("a"), F.col("c"), F.col("i"), strict="cannot be confirmed", broad="cannot be confirmed|not mentioned")).collect()
    assert [(r.grounding, r.ungrounded) for r in got] == [("FULL", False), ("PARTIAL", False), ("PARTIAL", False), ("REFUSED", False), ("PARTIAL", True), ("FULL", False)]


def test_spike_and_gap_fill(spark):
    df = spark.createDataFrame([("x", "1", 100), ("x", "2", 100), ("x", "3", 110), ("x", "4", 300), ("y", "1", 1), ("y", "2", 9)], "g string, m string, n int")
    assert [(r.g, r.m, r.ratio) for r in A.spikes(df, ["g"], "m", "n").collect()] == [("x", "4", 3.0)]
    months = spark.createDataFrame([("2024-12", 3), ("2025-03", 1), (None, 7)], "month string, n int")
    assert [(r.month, r.n) for r in A.gap_filled(months).orderBy("month").collect()] == [("2024-12", 3), ("2025-01", 0), ("2025-02", 0), ("2025-03", 1)]


@pytest.mark.parametrize("s, o, c, want", [(2, 2, 0, "mixed"), (4, 1, 0, "support"), (0, 0, 0, "no_stance"), (1, 1, 1, "mixed"), (0, 2, 2, "oppose"), (1, 0, 3, "concern")])
def test_stance_label(spark, s, o, c, want):
    assert spark.range(1).select(A.stance_label(F.lit(s), F.lit(o), F.lit(c)).alias("x")).first()["x"] == want


def test_candidates_keep_the_threshold(spark):
    v = spark.createDataFrame([("a", 0.4), ("b", 0.39)], "id string, vec_score double")
    k = spark.createDataFrame([("c",)], "id string")
    assert {r.id for r in A.candidates(v, k, "id", 0.4).collect()} == {"a", "c"}


def test_aliases_and_ambiguity(spark):
    assert A.canonical([["a", "bb"], ["bb", "ccc"], ["z"]]) == {"a": "ccc", "bb": "ccc", "ccc": "ccc", "z": "z"}
    df = spark.createDataFrame([("p", "x"), ("p", "x"), ("q", "x"), ("q", "y")], "name string, party string")
    assert {r.name: r.party for r in A.unambiguous(df, "name", "party").collect()} == {"p": "x", "q": None}


def test_gate_is_strict(spark):
    df = spark.createDataFrame([(i, None if i < 5 else "d") for i in range(100)], "k int, d string")
    rows = {r["check"]: r.status for r in G.gate(df, [("at", "BLOCK", G.share(F.col("d").isNull()), 0.05, True), ("reached", "BLOCK", G.share(F.col("d").isNull()), 0.05, False), ("none", "WARNING", F.lit(None).cast("double") + F.count("*"), 0, True)]).collect()}
    assert rows == {"at": "OK", "reached": "BLOCK", "none": "SKIP"}


def test_audit_over_pages(spark):
    df = spark.createDataFrame([(1, "abcdefghijklmnopqrst", ["xxabcdefghijkl", "mnopqrstyy"]), (2, "abcdefghijklmnopqrst", ["abcdefghijkl", "zz"]), (3, None, ["a"])], "key int, chunk string, pages array<string>")
    assert [r.ok for r in G.spans_pages(df).orderBy("key").collect()] == [True, False, False]


def test_relevance(spark):
    crit = "struct<text_any:array<string>,text_all:array<array<string>>,speaker_any:array<string>,committee_any:array<string>,date_any:array<string>,mode:string>"
    hit = dict(text=F.lit("budget of the port"), speaker=F.lit("Kim"), committee=F.lit("C1"), date=F.lit("2025-07-14"))
    cases = [((None,) * 6, True), ((["port"], None, ["Lee"], None, None, "and"), False), ((["port"], None, ["Lee"], None, None, None), True), ((["port"], None, ["Kim X"], None, None, "and"), False), ((["zzz"], None, ["Ki"], None, None, None), False), ((["port"], [["zzz"]], None, None, None, None), False), ((None, [["zzz"]], None, None, None, None), True), ((["port"], None, ["Kim"], None, None, "and"), True), ((None, [["port", "x"], ["budget"]], None, None, ["2025-07"], None), True), ((None, None, None, ["C2"], None, None), False)]
    for c, want in cases:
        df = spark.createDataFrame([(c,)], f"c {crit}")
        assert df.select(V.relevant(F.col("c"), **hit).alias("x")).first()["x"] is want


def test_label_sheet(spark):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["## t1", "", "label: support", "label: oppose", "## t2", "label:", "label: what", "## t3", "label: concern"])], "f string, i int, line string")
    assert {r.id: r.label for r in V.label_sheet(lines, "f", "i", "line", ["support", "oppose", "concern"]).collect()} == {"t1": "support", "t3": "concern"}


def test_layers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    at = str(tmp_path / "x")
    assert L.write_layer(df, at, by=["s"]) == 2
    new = L.replaced(df, spark.createDataFrame([(9, "b"), (8, "b")], "k int, s string"), ["s"])
    assert L.write_layer(new, at, by=["s"], expected=3) == 3
    with pytest.raises(RuntimeError):
        L.write_layer(df, at, expected=5)
    assert sorted((r.k, r.s) for r in L.read_layer(spark, at, schema=df.schema).collect()) == [(1, "a"), (8, "b"), (9, "b")], "a load that isn't whole leaves the layer as it was"
    (tmp_path / "x" / "v9").mkdir()  # a version whose job never ended
    assert L.read_layer(spark, at).count() == 3
    with pytest.raises(FileNotFoundError):
        L.read_layer(spark, str(tmp_path / "none"))
    (tmp_path / "20240611_a.bin").write_bytes(b"abc")
    m = L.manifest(spark, str(tmp_path), "*.bin").first()
    assert (m.file_name, m.size, m.date_hint, m.sha256[:8], m.status) == ("20240611_a.bin", 3, "20240611", "ba7816bf", "pending")
    (tmp_path / "r.jsonl").write_text('{"k": 1}\n\n{"k": \n{"k": 2}\n')
    rows = L.json_lines(spark, str(tmp_path / "r.jsonl"), "k int").collect()
    assert sorted(r.k for r in rows if r._corrupt_record is None) == [1, 2] and sum(r._corrupt_record is not None for r in rows) == 1
    assert {r.k for r in L.insert_ignore(df, spark.createDataFrame([(2, "z"), (3, "c")], "k int, s string"), ["k"]).collect()} == {1, 2, 3}
    p = L.Pipeline(("one", lambda d: d.withColumn("x", F.lit(1)), None), ("two", lambda d: d.where("k > 1"), lambda d: d.count() > 5))
    with pytest.raises(RuntimeError):
        p.run(df, str(tmp_path / "p"))
    assert L.Pipeline(("one", lambda d: d, None), ("two", lambda d: d.where("k > 1"), None)).run(df, str(tmp_path / "p"), start="two").count() == 1


def test_chunk_gate(spark):
    rows = [(i, "2024-06-11", "who", "committee", "x" * 200, "utterance", "f", 1) for i in range(100)]
    kind = "k int, d string, speaker string, committee string, text string, kind string, f string, p int"

    def result(change):
        d = spark.createDataFrame(change(rows), kind)
        checks = G.gate(d, G.chunk_checks(date=F.col("d"), speaker=F.col("speaker"), committee=F.col("committee"), text=F.col("text"), chunk_id=F.col("k"), chunk_type=F.col("kind"), source=[F.col("f"), F.col("p")]))
        r = G.report(checks).first()
        return r.result, r.n_warnings, r.reasons.split(":")[0]

    some = lambda n, **new: lambda rs: [tuple(new.get(c, v) for c, v in zip(kind.replace(" int", "").replace(" string", "").split(", "), r)) if i < n else r for i, r in enumerate(rs)]
    assert result(lambda rs: rs) == ("OK", 0, "")
    assert result(lambda rs: []) == ("BLOCK", 0, "empty")
    assert result(some(10, speaker=None)) == ("OK", 0, "") and result(some(11, speaker="")) == ("BLOCK", 0, "speaker missing")
    assert result(some(1, committee="")) == ("BLOCK", 0, "committee missing") and result(some(1, kind="note")) == ("BLOCK", 0, "chunk type invalid")
    assert result(some(6, text=" \u3000\n")) == ("BLOCK", 0, "blank text") and result(some(30, text="short")) == ("OK", 1, "")
    assert result(some(2, p=None)) == ("BLOCK", 0, "source missing") and result(some(2, k=7)) == ("BLOCK", 0, "duplicate ids")


def test_display_names_and_stripped_answers(spark):
    df = spark.createDataFrame([("柳榮夏",), ("김하나",), ("other",), (None,)], "n string")
    assert [r.x for r in df.select(E.display_name(F.col("n"), {"柳榮夏": "유영하"}).alias("x")).collect()] == ["柳榮夏(유영하)", "김하나", "other", None]
    tail, party = "이외의 내용은 확인할 수 없습니다.", "위원의 소속 정당은 확인할 수 없습니다."
    rows = [(f"답입니다. {tail} {party} {tail}", False, "답입니다."), (f"답입니다. {party}", True, f"답입니다. {party}"), (tail, False, tail), (f"답.\n## 논의의 한계\n{tail}", False, f"답.\n## 논의의 한계\n{tail}"), (f"{tail} 답입니다.", False, f"{tail} 답입니다.")]
    got = spark.createDataFrame(rows, "a string, about boolean, want string").select(E.stripped(F.col("a"), F.col("about")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_scope_falls_back(spark):
    sizes = spark.createDataFrame([(1, 10, 5), (2, 20_000, 5_000), (3, 40_000, 20_000), (4, 90_000, 80_000)], "k int, near long, core long")
    got = {r.k: (r.neighbours, r.indexed, r.n_chunks) for r in A.chosen_scope(sizes, "near", "core").collect()}
    assert got == {1: (True, True, 10), 2: (False, True, 5_000), 3: (False, False, 20_000), 4: (False, False, 80_000)}


def test_model_answers(spark):
    df = spark.createDataFrame([('{"relevant": [2, 0, 2, 9, -1]}', '{"items": [{"i": 1, "stance": "oppose"}, {"i": 1, "stance": "support"}, {"i": 7, "stance": "oppose"}, {"i": 0, "stance": "odd"}]}'), ("no", "no"), ('{"relevant": "x"}', '{"other": 1}')], "a string, b string")
    got = df.select(A.parsed_choice(F.col("a"), 3).alias("a"), A.parsed_stances(F.col("b"), 3).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [([2, 0], [None, "support", None]), (None, None), (None, None)]


def test_cached_check():
    now, asked = [0.0], []
    check = ratelimit.CachedCheck(lambda: asked.append(1) or 2.0 * len(asked) - 1.5, limit=1.0, seconds=60, clock=lambda: now[0])
    assert not check.exceeded()
    now[0] = 59.9
    assert not check.exceeded() and len(asked) == 1
    now[0] = 60.0
    assert check.exceeded() and len(asked) == 2


def test_day_cost(spark):
    log = spark.createDataFrame([("2024-01-02 10:00:00", 0.5), ("2024-01-02 23:59:00", None), ("2024-01-01 10:00:00", 9.0)], "ts string, usd double").withColumn("ts", F.col("ts").cast("timestamp"))
    cost = lambda day: ratelimit.day_cost(log, "ts", F.col("usd"), F.lit(day).cast("date")).first().cost
    assert (cost("2024-01-02"), cost("2024-01-03")) == (0.5, 0.0)


def test_rate_limit_window():
    w: deque = deque()
    assert [ratelimit.allow(w, t, 2, 60) for t in (0, 1, 2, 59.9, 60.0, 60.5, 61.0)] == [True, True, False, False, True, False, True]


def test_rate_limit_table_and_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=t), i) for i, (k, t) in enumerate([(k, t) for k in ("a", "b") for t in (0, 1, 2, 59, 60, 61, 62)])]
    df = spark.createDataFrame(rows, "key string, ts timestamp, event int")
    want = {(r.key, r.event): r.allowed for r in ratelimit.limited(df, "key", "ts", "event", 2).collect()}
    assert [v for k, v in sorted(want.items()) if k[0] == "a"] == [True, True, False, False, True, True, False]
    df.write.parquet(str(tmp_path / "in"))
    s = ratelimit.limited_stream(windows.stream_of(spark, str(tmp_path / "in"), df.schema).withWatermark("ts", "1 minute"), "key", "ts", "event", 2)
    got = windows.drain(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {(r.key, r.event): r.allowed for r in got.collect()} == want


def test_stream_windows_are_the_tables(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.stream_of(spark, str(tmp_path / "in"), events.schema), "1 day", "event_type", late="1 hour")
    got = windows.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    last = events.agg(F.max(F.col("ts").cast("timestamp")) - F.expr("interval 1 hour")).first()[0]
    batch = windows.tumbling(events, "1 day", "event_type").where(F.col("start") + F.expr("interval 1 day") <= F.lit(last))
    key = lambda df: {(r.start, r.event_type, r.n) for r in df.collect()}
    assert key(got) == key(batch) and key(got)


def test_composition_rows(spark):
    actors = [("a", "support", "red", "assembly"), ("b", "mixed", "red", "assembly"), ("c", "no_stance", "blue", "assembly"), ("d", "oppose", "무소속", "assembly"), ("e", "concern", "red", "unknown"), ("f", "support", None, "assembly"), ("g", "support", "red", "government"), ("h", "oppose", "red", "witness"), ("i", "oppose", "red", "staff")]
    got = A.composition(spark.createDataFrame(actors, "who string, stance string, party string, grp string"), "stance", "party", "grp").orderBy("place").collect()
    assert [(r.row, r.n, r.support, r.oppose, r.concern, r.mixed, r.no_stance) for r in got] == [("red", 2, 1, 0, 0, 1, 0), ("blue", 1, 0, 0, 0, 0, 1), ("정부측", 1, 1, 0, 0, 0, 0), ("무소속/미상", 3, 1, 1, 1, 0, 0)]


def test_citations_of_a_matrix(spark):
    said = [("s", 1, "support"), ("s", 2, "oppose"), ("s", 3, "none"), ("n", 4, "neutral"), ("n", 5, "none"), ("c", 6, "concern"), ("c", 7, "neutral")]
    stances = spark.createDataFrame([("i", *r, "2024-06-01") for r in said], "issue string, who string, turn int, stance string, day string")
    pieces = spark.createDataFrame([(t, f"t{t}_chunk_{k:03d}", k, c * 90) for t in range(1, 8) for k, c in ((2, "b"), (1, "a"))], "turn int, chunk_id string, k int, x string")
    actors, cited = A.stance_matrix(stances, pieces, by=["issue"], speaker="who", turn="turn", stance="stance", date="day", chunk="chunk_id", order="k", text="x")
    assert {r.who: (r.label, r.none, r.total) for r in actors.collect()} == {"s": ("mixed", 1, 3), "n": ("no_stance", 1, 2), "c": ("concern", 0, 2)}
    rows = cited.collect()
    assert sorted(r.turn for r in rows) == [1, 2, 4, 5, 6]
    assert {(r.chunk_id, r.snippet) for r in rows if r.turn == 6} == {("t6_chunk_001", "a" * 90 + " " + "b" * 69)}


def test_as_of_periods(spark):
    periods = [("x", "2020-01-01", "2020-12-31", "old"), ("x", "2020-06-01", "2021-01-31", "new"), ("x", "2020-06-01", "2020-06-30", "also"), ("x", "2021-03-01", None, "open"), ("x", "2022-01-01", "2021-01-01", "never"), ("y", "2000-01-01", None, "y")]
    p = spark.createDataFrame(periods, "k string, a string, b string, v string")
    days = {("x", "2019-12-31"): None, ("x", "2020-01-01"): "old", ("x", "2020-05-31"): "old", ("x", "2020-06-01"): "also", ("x", "2020-07-01"): "new", ("x", "2021-01-31"): "new", ("x", "2021-02-01"): None, ("x", "2021-03-01"): "open", ("x", "9000-01-01"): "open", ("y", "2021-02-01"): "y", ("z", "2021-02-01"): None, ("x", None): None}
    rows = spark.createDataFrame([*days, *days], "k string, d string")
    got = A.as_of(rows, ["k"], "d", p, "a", "b", "v")
    assert got.columns == ["k", "d", "v"] and [r.v for r in got.collect() if days[r.k, r.d] != r.v] == [] and got.count() == 24
    assert {r.d: r.v for r in A.as_of(spark.createDataFrame([("2020-03-01",), ("2021-02-01",)], "d string"), [], "d", p.where("k = 'x'").drop("k"), "a", "b", "v").collect()} == {"2020-03-01": "old", "2021-02-01": None}
    assert A.as_of(rows, ["k"], "d", p.limit(0), "a", "b", "v").where("v IS NOT NULL").count() == 0


def test_party_labels(spark):
    members = spark.createDataFrame([("나하나", None, "가나당"), ("다도현", "\uf9c9\u69ae", "국민의미래"), ("라민서", None, "무소속"), ("마", None, "가나당"), ("마", None, "다라당")], "name string, hanja string, party string")
    periods = spark.createDataFrame([("2024-01-01", "2024-12-31", "국민의힘"), ("2025-06-01", None, "가나당")], "start string, end string, ruling string")
    said = [("나하나", "위원", "2024-06-01", "가나당(당시 야당)"), ("나하나", "위원장", "2025-06-01", "가나당(당시 여당)"), ("나하나", "위원", "2025-02-01", "가나당"), ("\u67f3\u69ae", "위원", "2024-06-01", "국민의미래(당시 여당)"), ("라민서", "간사", "2024-06-01", "무소속"), ("마", "위원", "2024-06-01", None), ("나하나", "통일부장관", "2024-06-01", "정부측"), ("나하나", "증인", "2024-06-01", None), ("나하나", None, "2024-06-01", None), ("나하나", "위원", None, None), (None, "위원", "2024-06-01", None), ("모름", "위원", "2024-06-01", None)]
    df = spark.createDataFrame(said, "who string, role string, d string, want string")
    assert [tuple(r) for r in A.party_label(df, speaker="who", role="role", date="d", members=members, periods=periods).where("NOT (want <=> party_label)").collect()] == []


def test_source_audit_verdicts(spark):
    page = lambda n: "".join(chr(0xAC00 + (n * 97 + i * 7) % 11000) for i in range(80))
    pages = spark.createDataFrame([("s", n, f"머리말 {n}\n김하나 " + page(n)) for n in range(1, 6)], "source_id string, page int, text string")
    whole, over = page(2)[5:75], page(2)[40:] + page(3)[:45]
    many = page(1)[60:] + page(2) + page(3) + page(4)[:30]
    rows = [("whole", 2, 2, "김하나", whole), ("over", 2, 3, "김 하나", over), ("over wide", 3, 3, "김하나", over), ("many", 1, 4, "김하나", many), ("changed", 2, 3, "김하나", over[:30] + "x" * 60), ("far", 5, 5, "김하나", page(1)[:40]), ("no speaker", 2, 2, None, whole), ("other", 2, 2, "홍길동", whole), ("tiny", 2, 2, "김하나", "짧다"), ("lost", 90, 91, "김하나", whole)]
    chunks = spark.createDataFrame([("s", c, a, b, w, t) for c, a, b, w, t in rows], "source_id string, chunk_id string, page_start int, page_end int, speaker string, text string")
    got = {r.chunk_id: (r.text_ok, r.speaker_ok) for r in G.source_audit(chunks, pages).collect()}
    assert got == {"whole": (True, True), "over": (True, True), "over wide": (True, True), "many": (True, True), "changed": (False, True), "far": (False, True), "no speaker": (True, False), "other": (True, False), "tiny": (True, True), "lost": (False, False)}


def test_clean_runs(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    p = L.Pipeline(("one", lambda d: d, None), ("two", lambda d: d.where("k > 1"), None), ("three", lambda d: d, None))
    at = str(tmp_path / "p")
    versions = lambda: [len(L._versions(spark, f"{at}/{n}")) for n in ("one", "two", "three")]
    p.run(df, at)
    p.run(df, at)
    assert versions() == [2, 2, 2]
    p.run(df, at, start="three", clean=True)
    assert versions() == [2, 2, 1]
    p.run(df, at, clean=True)
    assert versions() == [3, 1, 1]  # the first stage's layer stays
    assert p.run(df, at, clean=True, clean_first=True).count() == 1 and versions() == [1, 1, 1]


def test_timeline_of_two_axes(spark):
    chunks = [(1, 1, "2024-01-05", "the PORT opens"), (2, 1, "2024-01-06", "port again"), (3, 2, "2024-04-01", "nothing"), (4, 3, None, "port without a day"), (5, 4, "2024-02-01", None), (6, 5, "2023-12-31", "a bridge")]
    c = spark.createDataFrame(chunks, "chunk_id int, turn_id int, date string, text string")
    m = spark.createDataFrame([("i", 3, True), ("i", 5, False), ("i", 4, True), ("j", 1, False)], "issue string, chunk_id int, core boolean")
    got = {(r.issue, r.month): (r.corpus_turns, r.mapped_turns, r.mapped_core_turns) for r in A.issue_timeline(c, m, {"i": ["port", "bridge"], "j": [], "k": ["zzz"]}).collect()}
    assert got == {("i", "2023-12"): (1, 0, 0), ("i", "2024-01"): (1, 0, 0), ("i", "2024-02"): (0, 1, 0), ("i", "2024-03"): (0, 0, 0), ("i", "2024-04"): (0, 1, 1), ("j", "2024-01"): (0, 1, 0)}


def test_rendered_source(spark):
    row = spark.createDataFrame([(1, "Kim", None, "blue", "C", "2024-06-11", 3, "Said.", None, "After."), (2, None, "chair", "", "C", None, None, "Said.", None, "")], "n int, s string, r string, p string, c string, d string, g int, t string, b string, a string")
    got = [r[0] for r in row.select(E.rendered(*[F.col(x) for x in "n s r p c d g t b a".split()]).alias("x")).collect()]
    assert got[0] == "[1]\nspeaker: Kim [blue]\ncommittee: C\ndate: 2024-06-11\npage: 3\ncontent:\nSaid.\n\n[1 주변 맥락]\nnext: After."
    assert got[1] == "[2]\nspeaker:  chair\ncommittee: C\ndate: \npage: \ncontent:\nSaid."


def test_ledgers_and_copies(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 3}", "x" if i else " ") for i in range(10)], "k int, source string, t string")
    at = str(tmp_path / "ledger")
    assert L.ledger(df.where("k < 2"), at) == 2 and L.ledger(df.where("k = 5"), at) == 1
    assert [r.k for r in L.read_layer(spark, at).collect()] == [5]
    assert L.ledger(df.where("k > 99"), at) == 0 and L._versions(spark, at) == []
    ids = spark.createDataFrame([(1,), (1,), (4,), (77,)], "k int")
    assert L.copied(df, str(tmp_path / "some"), "k", ids) == 2 and L.copied(df, str(tmp_path / "all")) == 10
    done = spark.createDataFrame([(3,)], "k int")
    assert sorted(r.k for r in L.pending(df, done, "k", "t", "source", ["s0", "s2"]).collect()) == [2, 5, 6, 8, 9]


def test_members_of_an_era(spark):
    df = spark.createDataFrame([(" Kim ", "제21대, 제22대", "가/나/ 다 "), ("Lee", "제21대", "가"), ("Park", "제22대", None), ("Choi", "제22대", "라/")], "n string, e string, h string")
    assert [tuple(r) for r in A.members(df, "n", "e", "h", "제22대").collect()] == [("Kim", "다"), ("Park", None), ("Choi", None)]


def test_stripping_is_linear_in_a_line(spark):
    """The same as the pattern at every place, and a line of 400,000 letters is no matter of minutes."""
    import random
    import time

    always, unless = E.K.DANGLING_TAIL, E.K.PARTY_DISCLAIMER
    rng = random.Random(11)
    bits = [" ", "\n", ".", "가", "이외의 것은 확인할 수 없습니다.", "이\n외 것 확인할 수 없습니다", "그의 소속 정당은 확인할 수 없습니다.", "소속 정당 확인할 수 없습니다", "소속 정당", "　", "  \n "]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))), rng.random() < 0.3) for _ in range(3000)]
    plain = lambda a, p: F.regexp_replace(F.regexp_replace(a, r"(?U)\s+$", ""), rf"(?U)\s*(?:(?:{p})\s*)+$", "")
    want = F.when(F.col("about"), plain(F.col("a"), always)).otherwise(plain(F.col("a"), f"{always}|{unless}"))
    df = spark.createDataFrame(rows, "a string, about boolean")
    bad = df.select("a", E.stripped(F.col("a"), F.col("about")).alias("got"), F.when(want == "", F.col("a")).otherwise(want).alias("want")).where("NOT got <=> want").collect()
    assert bad == []
    began = time.time()
    df = spark.range(1).select(F.concat(F.repeat(F.lit("가 "), 200_000), F.lit("소속 정당은 확인할 수 없습니다. 끝")).alias("a"))
    assert df.select((E.stripped(F.col("a"), F.lit(False)) == F.col("a")).alias("same")).first().same
    assert time.time() - began < 20
