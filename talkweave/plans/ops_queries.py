"""Loads, lookups, logs, gates, evaluation, streams and set operations on the test tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave import config as C
from talkweave.functions import fixed as K
from talkweave.operators import evaluate as V
from talkweave.operators import gates as G
from talkweave.operators import search as S
from talkweave.plans.base import Registry, spread, table
from talkweave.session import fresh
from talkweave.sources import layers as L
from talkweave.streaming import ratelimit, windows

R = Registry()
_GATE = "unnest([{rows}], recursive := true)"


def _sql_gate(source: str, checks: list[tuple[str, str, str, float, bool]], by: str = "") -> str:
    """(name, severity, aggregate, threshold, strict) as rows, like talkweave.operators.gates.gate."""
    aggs = ", ".join(f"({a})::DOUBLE AS c{i}" for i, (_, _, a, _, _) in enumerate(checks))
    rows = " UNION ALL ".join(
        f"SELECT {by + ', ' if by else ''}'{n}' AS \"check\", '{s}' AS severity, round(c{i}, 6) AS value, {float(t)}::DOUBLE AS threshold, CASE WHEN c{i} IS NULL THEN 'SKIP' WHEN c{i} {'>' if strict else '>='} {float(t)}::DOUBLE THEN '{s}' ELSE 'OK' END AS status FROM w"
        for i, (n, s, _, t, strict) in enumerate(checks)
    )
    return f"WITH w AS (SELECT {by + ', ' if by else ''}{aggs} FROM {source} {'GROUP BY ' + by if by else ''}) {rows}"


def _share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)"


def _turn_gate(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("turn_id", F.format_string("%d_turn_%04d", "conv_id", "turn"))
    checks = G.turn_checks(
        speaker=F.col("role"), date=F.lit("2024-06-11"), turn_id=F.col("turn_id"), page_start=F.col("turn"), page_end=F.col("turn") + 1, leaked=F.col("role") == "system", meta=[F.col("conv_id"), F.col("text")], text=F.col("text"), marker="[◯◎]"
    )
    return G.gate(t, checks, ["role"])


@R.add(_sql_gate("(SELECT *, printf('%d_turn_%04d', conv_id, turn) AS turn_id FROM conversations)", [
    ("empty", "BLOCK", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END", 0, True), ("speaker missing", "BLOCK", _share("role IS NULL OR role = ''"), C.TURN_SPEAKER_MISSING, False),
    ("bad date", "BLOCK", "0", 0, True), ("duplicate ids", "BLOCK", "count(turn_id) - count(DISTINCT turn_id)", 0, True), ("pages inverted", "BLOCK", "0", 0, True),
    ("no speaker", "BLOCK", "count(*) FILTER (role = 'system')", 0, True), ("meta missing", "BLOCK", "count(*) FILTER (conv_id IS NULL OR text IS NULL)", 0, True),
    ("marker left", "WARNING", "count(*) FILTER (regexp_matches(text, '[◯◎]'))", 0, True), ("short turns", "WARNING", _share(f"length(text) < {C.TURN_SHORT_CHARS}"), C.TURN_SHORT_RATE, False),
], "role"))
def gate_turns(spark, sf_dir):
    return _turn_gate(spark, sf_dir)


_KINDS = ", ".join(f"'{k}'" for k in K.CHUNK_TYPES)
_CHUNK_SQL = _sql_gate("(SELECT *, CASE WHEN doc_id % 50 = 7 THEN 'note' ELSE 'utterance' END AS kind FROM documents)", [
    ("empty", "BLOCK", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END", 0, True),
    ("date null", "BLOCK", _share("lang IS NULL OR lang = ''"), C.CHUNK_DATE_NULL, True), ("speaker missing", "BLOCK", _share("source IS NULL OR source = ''"), C.CHUNK_SPEAKER_MISSING, True),
    ("committee missing", "BLOCK", "count(*) FILTER (lang IS NULL OR lang = '')", 0, True),
    ("blank text", "BLOCK", _share("text IS NULL OR NOT regexp_matches(text, '\\S')"), C.CHUNK_BLANK, True), ("short text", "WARNING", _share(f"length(coalesce(text, '')) < {C.CHUNK_GATE_SHORT_CHARS}"), C.CHUNK_SHORT, True),
    ("long text", "WARNING", _share(f"length(text) > {C.CHUNK_GATE_LONG_CHARS}"), C.CHUNK_LONG, True), ("duplicate ids", "BLOCK", "count(doc_id) - count(DISTINCT doc_id)", 0, True),
    ("marker detection", "WARNING", "NULL", 0, True), ("chunk type invalid", "BLOCK", f"count(*) FILTER (kind NOT IN ({_KINDS}))", 0, True),
    ("source missing", "BLOCK", _share("doc_id IS NULL OR source IS NULL OR n_chars IS NULL OR lang IS NULL"), C.CHUNK_SOURCE_MISSING, True),
], "source")


def _chunk_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 50 == 7, "note").otherwise("utterance")
    trace = [F.col(c) for c in ("doc_id", "source", "n_chars", "lang")]
    return G.gate(d, G.chunk_checks(date=F.col("lang"), speaker=F.col("source"), committee=F.col("lang"), text=F.col("text"), chunk_id=F.col("doc_id"), chunk_type=kind, source=trace), ["source"])


@R.add(_CHUNK_SQL)
def gate_chunks(spark, sf_dir):
    return _chunk_gate(spark, sf_dir)


@R.add(f"""SELECT source, CASE WHEN bool_or(status = 'BLOCK') THEN 'BLOCK' ELSE 'OK' END AS result, count(*) FILTER (status = 'BLOCK') AS n_blocked, count(*) FILTER (status = 'WARNING') AS n_warnings,
coalesce(string_agg(CASE WHEN status = 'BLOCK' THEN "check" || ': ' || printf('%.4f', value) || ' > ' || printf('%.4f', threshold) END, '; ' ORDER BY "check"), '') AS reasons FROM ({_CHUNK_SQL}) GROUP BY source""")
def gate_report(spark, sf_dir):
    return G.report(_chunk_gate(spark, sf_dir), ["source"])


@R.add("SELECT d.doc_id, m.first_id, m.n FROM documents d JOIN (SELECT md5(text) AS h, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) m ON md5(d.text) = m.h")
def dup_hash_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    m = d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return d.join(m, "h").drop("h")


@R.add("SELECT a.vec_id, round(b.embedding[1], 5)::DOUBLE AS x FROM (SELECT vec_id, (SELECT text FROM documents WHERE doc_id = vec_id) AS text FROM embeddings) a LEFT JOIN (SELECT md5(text) AS h, arg_min(embedding, vec_id) AS embedding FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 2 = 0 GROUP BY 1) b ON md5(a.text) = b.h")
def embedding_carry_over(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    chunks = e.select("vec_id").join(d, "vec_id", "left")
    stored = e.where("vec_id % 2 = 0").join(d, "vec_id")
    return L.carried_over(chunks, stored, "text", "embedding", "vec_id").select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("x"))


@R.add("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND trim(text) <> ''")
def pending_antijoin(spark, sf_dir):
    return L.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text").select("doc_id", "source")


@R.add("SELECT doc_id, left(text, 600) AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join_scope(spark, sf_dir):
    """Documents within a scope copied into a layer of their own, counted, and read from there."""
    ids, at = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), fresh(spark, "scope")
    L.copied(table(spark, sf_dir, "documents").select("doc_id", "text"), at, "doc_id", ids)
    return L.read_layer(spark, at).select("doc_id", F.left("text", F.lit(C.EXCERPT)).alias("text"))


@R.add("SELECT user_id, count(*) AS n, avg(CASE WHEN props IS NULL OR value < 20 THEN 1.0 ELSE 0.0 END) AS date_null, avg(CASE WHEN trim(event_type) IN ('', 'view') THEN 1.0 ELSE 0.0 END) AS blank FROM events GROUP BY user_id HAVING NOT (avg(CASE WHEN props IS NULL OR value < 20 THEN 1.0 ELSE 0.0 END) > 0.5 OR avg(CASE WHEN trim(event_type) IN ('', 'view') THEN 1.0 ELSE 0.0 END) > 0.2)")
def skip_ratio(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("props").isNotNull() & (F.col("value") >= 20), F.col("ts")).alias("date"), F.when(F.trim("event_type") == "view", "").otherwise(F.col("event_type")).alias("text"))
    return G.loadable(e, "user_id", "date", "text").where("load").drop("load")


@R.add("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return L.latest(e, ["user_id"], F.col("ts"), F.col("event_id")).drop("ts")


@R.add("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_dimension(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return L.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@R.add("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND (doc_id % 3 = 0 OR doc_id % 2 = 0)")
def change_detection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    before = d.where("doc_id % 4 = 0 OR doc_id % 3 = 0 OR doc_id % 2 = 1").withColumn("digest", F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 4 != 0), "old").when(F.col("doc_id") % 2 == 0, F.col("digest")))
    return L.changed(d, before, "doc_id", "digest").select("doc_id")


@R.add("SELECT 'pages' AS layer, count(*) AS n_rows, count(DISTINCT source) AS n_sources, 1.0::DOUBLE AS share FROM documents UNION ALL SELECT 'labelled', count(*), count(DISTINCT source), round(count(DISTINCT source) / (SELECT count(DISTINCT source) FROM documents), 4) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def layer_census(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return L.census({"pages": d, "labelled": d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")}, "source")


@R.add("SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 5000 GROUP BY n_name ORDER BY n DESC, n_name")
def dim_count_left(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n")).orderBy(F.col("n").desc(), "n_name")


@R.add("SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def list_paged(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate").cast("date").between(F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date")))
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderdate").orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").offset(20).limit(20)


@R.add("SELECT l_orderkey, l_linenumber, o_orderdate, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_orderkey IN (1, 7, 1000)")
def point_lookup(spark, sf_dir):
    keys = [1, 7, 1000]
    li = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey").isin(keys)).select("l_orderkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(keys)).select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "o_orderdate", "c_name")


@R.add("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') ORDER BY p_name, p_partkey LIMIT 10")
def autocomplete(spark, sf_dir):
    return table(spark, sf_dir, "part").where(S.holds("p_name", "re")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(10)


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@R.add(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in _TABLES]
    return functools.reduce(DataFrame.unionAll, parts)


@R.add("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_high, count(*) FILTER (user_id % 2 = 0) AS n_even, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS cost, count(*) FILTER (value < 1) AS n_rated, round(avg(value), 6) AS avg_value FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY event_type""")
def ops_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.count_if(F.col("user_id") % 2 == 0).alias("n_even"), q.alias("q"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("cost"), F.count_if(F.col("value") < 1).alias("n_rated"), F.round(F.avg("value"), 6).alias("avg_value"))
    return g.select("event_type", "n", "n_high", "n_even", F.round(F.get("q", F.lit(0)), 6).alias("p50"), F.round(F.get("q", F.lit(1)), 6).alias("p95"), "cost", "n_rated", "avg_value")


@R.add("SELECT ts::DATE AS day, count(*) AS n, round(avg(value), 4) AS avg_value, round(sum(value), 2) AS total FROM events GROUP BY 1")
def ops_daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"), F.round(F.sum("value"), 2).alias("total"))


@R.add("SELECT event_id, user_id, ts FROM events WHERE event_type = 'view' OR json_extract_string(props, '$.k')::INT = 0 ORDER BY ts DESC, event_id DESC LIMIT 50")
def ops_review(spark, sf_dir):
    bad = (F.col("event_type") == "view") | (F.get_json_object("props", "$.k").cast("int") == 0)
    return table(spark, sf_dir, "events").where(bad).select("event_id", "user_id", "ts").orderBy(F.col("ts").desc_nulls_last(), F.col("event_id").desc()).limit(50)


@R.add("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20")
def my_latest(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc_nulls_last(), F.col("event_id").desc())
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("user_id", "event_id", "ts")


@R.add("SELECT coalesce(sum(value) FILTER (ts::DATE = (SELECT max(ts)::DATE FROM events)), 0) > 1.0 AS over_limit, round(coalesce(sum(value) FILTER (ts::DATE = (SELECT max(ts)::DATE FROM events)), 0), 2) AS cost FROM events")
def daily_cost(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "value").groupBy("day").agg(F.sum("value").alias("v"))
    return e.agg(F.max_by(F.coalesce("v", F.lit(0.0)), "day").alias("c")).select((F.col("c") > C.DAILY_COST).alias("over_limit"), F.round("c", 2).alias("cost"))


@R.add("""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, true AS allowed, [ts] AS held FROM o WHERE rn = 1
  UNION ALL SELECT user_id, event_id, rn, len(held) < 2, CASE WHEN len(held) < 2 THEN list_append(held, ts) ELSE held END
  FROM (SELECT o.user_id, o.event_id, o.rn, o.ts, list_filter(f.held, lambda x: x > o.ts - INTERVAL 1 HOUR) AS held FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1))
SELECT user_id, event_id, allowed FROM f""")
def rate_limit(spark, sf_dir):
    return ratelimit.limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=2, seconds=3600)


@R.add("SELECT page_id, coalesce(nullif(left(trim(string_split(CASE WHEN page_id % 3 = 0 THEN '' ELSE url || ', proxy' END, ',')[1]), 64), ''), 'peer' || page_id) AS client FROM pages")
def client_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ratelimit.client_key(F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat("url", F.lit(", proxy"))), F.concat(F.lit("peer"), F.col("page_id"))).alias("client"))


@R.add("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "1 day", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R.add("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM m) SELECT min(ts) AS start, max(ts) AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_session(spark, sf_dir):
    s = windows.sessions(table(spark, sf_dir, "events"), "6 hours", "user_id")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


_WORDS = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 9))"


@R.add(f"""WITH w AS (SELECT doc_id, lang, source, {_WORDS} AS w FROM documents), d AS (SELECT doc_id, unnest(w) AS x FROM w), q AS (SELECT doc_id AS q, lang, unnest(w) AS x FROM w WHERE doc_id % 20 = 0),
h AS (SELECT q, d.doc_id, count(*) AS n FROM q JOIN d USING (x) WHERE q <> d.doc_id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, doc_id) AS rank FROM h),
f AS (SELECT a.lang, a.doc_id AS q, min(rank) FILTER (b.lang = a.lang AND b.source = a.source) AS r FROM w a LEFT JOIN r ON r.q = a.doc_id AND rank <= 10 LEFT JOIN w b ON b.doc_id = r.doc_id WHERE a.doc_id % 20 = 0 GROUP BY ALL)
SELECT lang, count(*) AS n, round_even(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 3) AS recall_5, round_even(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 3) AS recall_10, round_even(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0.0 END), 3) AS mrr_10 FROM f GROUP BY lang""")
def eval_recall_mrr(spark, sf_dir):
    """Every twentieth document's long words as a question to all documents; a hit of its language and source is relevant."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    d = docs.select("doc_id", "lang", "source", F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), lambda x: F.length(x) >= 9).alias("w"))
    q = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("q"), F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), F.col("w").alias("qw"))
    hits = S.word_hits(d, q, "doc_id", "q", F.col("w"), F.col("qw"), limit=C.MRR_CUT).join(d.select("doc_id", "lang", "source"), "doc_id")
    asked = q.drop("qw").join(hits, "q", "left")
    criteria = F.struct(F.array("q_source").alias("committee_any"), F.array().cast("array<string>").alias("date_any"), F.array("q_lang").alias("speaker_any"), F.array().cast("array<string>").alias("text_any"), F.array().cast("array<array<string>>").alias("text_all"), F.lit("and").alias("mode"))
    rel = F.coalesce(V.relevant(criteria, text=F.lit(""), speaker=F.col("lang"), committee=F.col("source"), date=F.lit("")), F.lit(False))
    return V.recall_mrr(asked.select("q", F.col("q_lang").alias("lang"), "rank", rel.alias("rel")), "q", ["lang"], "rank", F.col("rel"))


@R.add("SELECT a AS label_a, b AS label_b, count(l.doc_id) AS n FROM (VALUES (0), (1)) x(a) CROSS JOIN (VALUES (0), (1)) y(b) LEFT JOIN labels l ON l.quality = a AND l.toxic = b GROUP BY ALL")
def eval_confusion(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return V.confusion(labels, labels, "doc_id", "quality", "toxic", [0, 1])


@R.add("SELECT count(*) AS n, round_even(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 3) AS rate FROM labels")
def eval_agreement(spark, sf_dir):
    return V.agreement(eval_confusion(spark, sf_dir))


@R.add("""WITH v AS (SELECT source, CASE WHEN l.doc_id IS NULL THEN 'na' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) FILTER (verdict <> 'na') AS n, count(*) FILTER (verdict = 'pass') AS passed, round_even(count(*) FILTER (verdict = 'pass') / nullif(count(*) FILTER (verdict <> 'na'), 0), 3) AS rate FROM v GROUP BY source""")
def eval_pass_rate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("m")), "doc_id", "left")
    return V.pass_rate(d.withColumn("verdict", F.when(F.col("m").isNull(), "na").when(F.col("quality") == 1, "pass").otherwise("fail")), ["source"], "verdict")


@R.add("SELECT k FROM (SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT c_nationkey FROM customer) EXCEPT SELECT 0")
def set_ops(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return n.union(r.intersect(c)).distinct().exceptAll(spark.range(1).select(F.lit(0).alias("k")))


@R.add("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
