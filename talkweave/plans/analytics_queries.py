"""Profiles, timelines, spikes, stances and mappings, bound to orders, events, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkweave import config as C
from talkweave.operators import analytics as A
from talkweave.operators import chunk as K
from talkweave.operators import judging as J
from talkweave.operators import search as S
from talkweave.operators import terms as M
from talkweave.plans.base import Registry, spread, table
from talkweave.plans.text_queries import chunks_sql
from talkweave.plans.search_queries import _Q, _query_vector

R = Registry()


@R.add("""SELECT o_custkey, count(DISTINCT l_orderkey) AS n_units, count(DISTINCT l_suppkey) AS n_meetings, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def profile_totals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.totals(lines, "o_custkey", "l_orderkey", "l_suppkey", "o_orderdate")


@R.add("""SELECT n_name, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def profile_by_dim(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.count_distinct("c_custkey").alias("n_customers"))


@R.add("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def profile_by_month(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add("SELECT user_id, event_type, n, round_even(n / sum(n) OVER (PARTITION BY user_id), 3) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def profile_type_ratio(spark, sf_dir):
    return A.ratio(table(spark, sf_dir, "events"), ["user_id"], "event_type")


_ALIASES = A.canonical([["the", "ththe"], ["of", "ofof"], ["und", "die", "der"], ["de", "la", "les"]])
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(_ALIASES.items()))


@R.add(f"""SELECT term, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, CASE w {_CASES} ELSE w END AS term FROM (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents) WHERE length(w) >= 2)
GROUP BY term ORDER BY n DESC, term LIMIT 10""")
def profile_top_mentions(spark, sf_dir):
    # Repeats go first, by a hash set; what a lambda does is dearer and then sees each word of a text once.
    words = F.filter(F.array_distinct(F.split(F.lower("text"), " ")), lambda w: F.length(w) >= 2)
    return A.top_mentions(spread(table(spark, sf_dir, "documents").select("text")), words, _ALIASES)


@R.add("SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 3")
def profile_recent(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").orderBy(F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()).limit(3)


@R.add("""WITH m AS (SELECT o_custkey AS grp, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_orderkey) AS corpus, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS core
  FROM orders GROUP BY ALL),
s AS (SELECT grp, strftime(unnest(generate_series(min(strptime(month || '-01', '%Y-%m-%d')), max(strptime(month || '-01', '%Y-%m-%d')), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM m GROUP BY grp)
SELECT grp, month, coalesce(corpus, 0) AS corpus, coalesce(core, 0) AS core FROM s LEFT JOIN m USING (grp, month)""")
def timeline_gapfill(spark, sf_dir):
    """Months of each customer, from the first order to the last."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("grp"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_distinct("o_orderkey").alias("corpus"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("core"))
    return A.gap_filled(m, columns=["corpus", "core"], by=["grp"])


@R.add(f"""WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
x AS (SELECT a.user_id, a.day, a.n, median(b.n) AS med, count(*) AS others FROM c a JOIN c b ON a.user_id = b.user_id AND a.day <> b.day GROUP BY ALL)
SELECT user_id, day, n, med AS median_others, round_even(n / med, 2) AS ratio FROM x WHERE med > 0 AND n / med >= {C.SPIKE_RATIO}::DOUBLE AND others + 1 >= {C.MIN_MONTHS}""")
def spike_months(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return A.spikes(c, ["user_id"], "day", "n")


@R.add("SELECT DISTINCT o_orderpriority AS priority, date_trunc('quarter', o_orderdate)::DATE AS quarter FROM orders")
def quarter_cells(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter")).distinct()


@R.add("""WITH q AS (SELECT unnest(generate_series(date_trunc('quarter', min(o_orderdate)), date_trunc('quarter', max(o_orderdate)), INTERVAL 3 MONTH))::DATE AS q FROM orders)
SELECT q AS start_date, (q + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS end_date FROM q""")
def quarter_spine(spark, sf_dir):
    quarter = lambda f: F.to_date(F.date_trunc("quarter", f("o_orderdate")))
    q = table(spark, sf_dir, "orders").agg(quarter(F.min).alias("a"), quarter(F.max).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 3 month"))).alias("start_date"))
    return q.select("start_date", F.date_sub(F.add_months("start_date", 3), 1).alias("end_date"))


@R.add("""SELECT priority, quarter, o_orderkey FROM (SELECT o_orderpriority AS priority, date_trunc('quarter', o_orderdate)::DATE AS quarter, o_orderkey,
row_number() OVER (PARTITION BY o_orderpriority, date_trunc('quarter', o_orderdate) ORDER BY md5(o_orderkey || '|7'), o_orderkey) AS rn FROM orders) WHERE rn <= 5""")
def stratified_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter"), "o_orderkey")
    return A.stratified(o, ["priority", "quarter"], "o_orderkey", 5, "7")


@R.add(f"""WITH v AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS s FROM embeddings ORDER BY s DESC NULLS LAST, id LIMIT {C.VECTORS_PER_QUERY}),
kq AS (SELECT doc_id AS id, kw, row_number() OVER (PARTITION BY kw, lang ORDER BY length(text) DESC, doc_id) AS rn FROM documents, (VALUES ('nation'), ('tion of')) t(kw) WHERE contains(lower(text), kw)),
u AS (SELECT id, round(s, 4) AS vec_score, false AS kw_hit FROM v UNION ALL SELECT id, NULL, true FROM kq WHERE rn <= {C.KEYWORD_HITS_PER_QUARTER})
SELECT id, max(vec_score) AS vec_score, bool_or(kw_hit) AS kw_hit FROM u GROUP BY id HAVING bool_or(kw_hit) OR max(vec_score) >= 0.3""")
def candidates_union_cut(spark, sf_dir):
    v = S.vector_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), limit=C.VECTORS_PER_QUERY).withColumnRenamed("vec_id", "id")
    words = F.explode(F.filter(F.array(F.lit("nation"), F.lit("tion of")), lambda k: F.contains(F.lower("text"), k)))
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.length("text").alias("size"), words.alias("kw"))
    top = hits.withColumn("rn", F.row_number().over(Window.partitionBy("kw", "lang").orderBy(F.col("size").desc(), "id"))).where(F.col("rn") <= C.KEYWORD_HITS_PER_QUARTER)
    return A.candidates(v, top, "id", 0.3)


@R.add("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'core' WHEN l.quality = 0 THEN 'mention' ELSE 'mention?' END AS tier FROM documents d LEFT JOIN labels l USING (doc_id)")
def tier_merge(spark, sf_dir):
    mapping = table(spark, sf_dir, "documents").select("doc_id", F.lit("mention?").alias("tier"))
    return A.tiers(mapping, table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "core").otherwise("mention").alias("tier")), "doc_id")


_STANCE = "CASE event_type WHEN 'click' THEN 'support' WHEN 'view' THEN 'oppose' WHEN 'purchase' THEN 'concern' WHEN 'login' THEN 'neutral' ELSE 'none' END"
_COUNTS = ", ".join(f"count(*) FILTER (stance = '{k}') AS {k}" for k in ("support", "oppose", "concern", "neutral", "none"))
_LABEL = "CASE WHEN support + oppose + concern = 0 THEN 'no_stance' WHEN support > 0 AND oppose > 0 AND 3 * support >= support + oppose + concern AND 3 * oppose >= support + oppose + concern THEN 'mixed' WHEN support >= oppose AND support >= concern THEN 'support' WHEN oppose >= concern THEN 'oppose' ELSE 'concern' END"


def _stances(spark, sf_dir):
    e = F.col("event_type")
    stance = F.when(e == "click", "support").when(e == "view", "oppose").when(e == "purchase", "concern").when(e == "login", "neutral").otherwise("none")
    return table(spark, sf_dir, "events").withColumn("stance", stance)


@R.add(f"SELECT *, {_LABEL} AS label FROM (SELECT user_id, {_COUNTS} FROM (SELECT *, {_STANCE} AS stance FROM events) GROUP BY user_id)")
def stance_label(spark, sf_dir):
    counts = _stances(spark, sf_dir).groupBy("user_id").agg(*A.stance_counts(F.col("stance")))
    return counts.withColumn("label", A.stance_label(F.col("support"), F.col("oppose"), F.col("concern")))


_SAID = "CASE WHEN toxic = 1 THEN 'oppose' WHEN quality = 1 AND d.doc_id % 3 = 0 THEN 'support' WHEN quality = 0 THEN 'concern' WHEN d.doc_id % 2 = 0 THEN 'neutral' ELSE 'none' END"


@R.add(f"""WITH {chunks_sql('documents', 'doc_id', C.MAX_CHARS)}, e AS (SELECT lang, source || '/' || d.doc_id % 5 AS speaker, d.doc_id, {_SAID} AS stance FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT lang, speaker, {_LABEL} AS label FROM (SELECT lang, speaker, {_COUNTS} FROM e GROUP BY ALL)),
r AS (SELECT doc_id, min(printf('%d_chunk_%03d', doc_id, chunk_index)) AS chunk_id, left(string_agg(chunk_text, ' ' ORDER BY chunk_index), {C.CITATION_CHARS}) AS snippet FROM chunks GROUP BY doc_id)
SELECT lang, speaker, label, doc_id, stance, DATE '2024-06-01' + (doc_id % 100)::INT AS date, chunk_id, snippet FROM e JOIN c USING (lang, speaker) JOIN r USING (doc_id)
WHERE stance = label OR label = 'mixed' AND stance IN ('support', 'oppose') OR label = 'no_stance'""")
def stance_matrix(spark, sf_dir):
    """The turns that each actor's label rests on, with the restored text: documents as turns, languages as issues."""
    d, l = table(spark, sf_dir, "documents").alias("d"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled")
    said = d.join(l, F.col("doc_id") == F.col("labelled"), "left").select("lang", F.concat("source", F.lit("/"), F.col("doc_id") % 5).alias("speaker"), "doc_id", F.expr(_SAID).alias("stance"), F.date_add(F.lit("2024-06-01").cast("date"), (F.col("doc_id") % 100).cast("int")).alias("date"))
    pieces = K.chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"], "text")
    return A.stance_matrix(said, pieces, by=["lang"], speaker="speaker", turn="doc_id", stance="stance", date="date", chunk="chunk_id", order="chunk_index", text="chunk_text")[1]


@R.add(f"""WITH e AS (SELECT *, {_STANCE} AS stance FROM events), g AS (SELECT user_id, stance, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT user_id, arg_max(stance, (n, -CASE stance WHEN 'oppose' THEN 1 WHEN 'support' THEN 2 WHEN 'concern' THEN 3 ELSE 99 END, stance)) AS grp FROM g GROUP BY user_id)
SELECT c_mktsegment AS segment, grp, count(*) AS n FROM m JOIN customer ON user_id = c_custkey GROUP BY ALL""")
def party_composition(spark, sf_dir):
    e = _stances(spark, sf_dir)
    modal = A.modal(e, "user_id", "stance", ["oppose", "support", "concern"]).withColumnRenamed("stance", "grp")
    return modal.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("user_id") == F.col("c_custkey")).groupBy("segment", "grp").agg(F.count("*").alias("n"))


#: Periods that overlap, leave a gap, and stay open.
_PERIODS = [("1995-01-01", "1996-06-30", "first"), ("1996-03-01", "1999-12-31", "second"), ("2000-06-01", None, "third")]
_PERIOD_ROWS = ", ".join(f"(DATE '{a}', DATE '{b or '9999-12-31'}', '{c}')" for a, b, c in _PERIODS)


@R.add(f"""WITH p(a, b, side) AS (VALUES {_PERIOD_ROWS}), d AS (SELECT day, (SELECT arg_max(side, a) FROM p WHERE day BETWEEN a AND b) AS side FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders))
SELECT side, o_orderstatus, count(*) AS n FROM orders JOIN d ON day = o_orderdate::DATE GROUP BY ALL""")
def interval_side(spark, sf_dir):
    periods = spark.createDataFrame(_PERIODS, "start string, end string, side string")
    return A.as_of(table(spark, sf_dir, "orders"), [], "o_orderdate", periods, "start", "end", "side").groupBy("side", "o_orderstatus").agg(F.count("*").alias("n"))


_RULED = [("1995-01-01", "1997-12-31", "가나당"), ("1998-01-01", "1999-06-30", "국민의힘"), ("2000-01-01", None, "다라당")]
_MEMBER = {"BUILDING": "가나당", "MACHINERY": "다라당", "HOUSEHOLD": "무소속", "AUTOMOBILE": "국민의미래"}
#: Every fourth customer shares a name with others.
_NAME = "CASE WHEN c_custkey % 4 = 0 THEN left(c_name, 17) ELSE c_name END"
_STANDING = {"1-URGENT": "위원", "2-HIGH": "국토부장관", "3-MEDIUM": "증인", "4-NOT SPECIFIED": "위원장"}
_cases = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


@R.add(f"""WITH p(a, b, ruling) AS (VALUES {", ".join(f"(DATE '{a}', DATE '{b or '9999-12-31'}', '{c}')" for a, b, c in _RULED)}),
m AS (SELECT name, CASE WHEN count(DISTINCT party) = 1 THEN min(party) END AS party FROM (SELECT {_NAME} AS name, {_cases('c_mktsegment', _MEMBER)} AS party FROM customer) WHERE party IS NOT NULL GROUP BY name),
o AS (SELECT {_NAME} AS speaker, o_orderdate::DATE AS day, {_cases('o_orderpriority', _STANDING)} AS role FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT o.*, party, ruling FROM o LEFT JOIN m ON m.name = o.speaker LEFT JOIN p ON day BETWEEN a AND b)
SELECT party_label, count(*) AS n FROM (SELECT CASE WHEN role = '국토부장관' THEN '{A.K.GOVERNMENT_ROW}' WHEN role IN ('위원', '위원장') THEN CASE WHEN party = '무소속' OR ruling IS NULL THEN party
  ELSE party || '(당시 ' || CASE WHEN CASE party WHEN '국민의미래' THEN '국민의힘' ELSE party END = ruling THEN '여당' ELSE '야당' END || ')' END END AS party_label FROM r) GROUP BY ALL""")
def party_labels(spark, sf_dir):
    """What stands beside a speaker's name at a date: party and its side then, the government, or nothing."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_NAME).alias("speaker"), F.expr(_cases("c_mktsegment", _MEMBER)).alias("party"))
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", F.expr(_cases("o_orderpriority", _STANDING)).alias("role")).join(customers.drop("party"), "c_custkey")
    members = customers.where("party IS NOT NULL").select(F.col("speaker").alias("name"), F.lit(None).cast("string").alias("hanja"), "party")
    labelled = A.party_label(said, speaker="speaker", role="role", date="o_orderdate", members=members, periods=spark.createDataFrame(_RULED, "start string, end string, ruling string"))
    return labelled.groupBy("party_label").agg(F.count("*").alias("n"))


@R.add("SELECT p_name, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS p_brand FROM part GROUP BY p_name")
def ambiguous_map(spark, sf_dir):
    return A.unambiguous(table(spark, sf_dir, "part"), "p_name", "p_brand")


@R.add("""WITH c AS (SELECT event_type, user_id, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place, sum(n) OVER (PARTITION BY event_type) AS total FROM c)
SELECT event_type, user_id, n, place::INT AS place, round(100.0 * n / total, 2)::DOUBLE AS percent FROM r WHERE place <= 3""")
def topk_summary(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    total = c.groupBy("event_type").agg(F.sum("n").alias("total"))
    top = c.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("n").desc(), "user_id"))).where("place <= 3")
    return top.join(total, "event_type").select("event_type", "user_id", "n", "place", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 2).alias("percent"))


@R.add("""WITH m AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, max(n) AS peak, min(day) FILTER (n = mx) AS peak_day, count(*) AS days FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS mx FROM m) GROUP BY user_id)
SELECT user_id, peak, peak_day, days, CASE WHEN q >= 0.65 THEN 'mostly' WHEN q > 0 AND q <= 0.35 THEN 'rarely' ELSE 'partly' END AS band FROM p JOIN (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) AS q FROM events GROUP BY user_id) USING (user_id)""")
def profile_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    p = m.groupBy("user_id").agg(F.max("n").alias("peak"), F.min_by("day", F.struct(-F.col("n"), F.col("day"))).alias("peak_day"), F.count("*").alias("days"))
    q = e.groupBy("user_id").agg(F.avg((F.col("event_type") == "click").cast("double")).alias("q"))
    return p.join(q, "user_id").select("user_id", "peak", "peak_day", "days", F.when(F.col("q") >= 0.65, "mostly").when((F.col("q") > 0) & (F.col("q") <= 0.35), "rarely").otherwise("partly").alias("band"))


@R.add("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, lang, source LIMIT 80")
def topic_tally(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang", "source").limit(80)


@R.add("SELECT source, count(l.doc_id) AS n_mapped, count(l.doc_id) FILTER (quality = 1) AS n_core, CASE WHEN count(l.doc_id) = 0 THEN 'MISS' ELSE 'OK' END AS status, CASE WHEN source IN ('src3', 'src7') THEN 'low' ELSE 'ok' END AS quality_flag FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def anchor_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("m")), "doc_id", "left")
    g = d.groupBy("source").agg(F.count("m").alias("n_mapped"), F.count_if(F.col("quality") == 1).alias("n_core"))
    return g.withColumn("status", F.when(F.col("n_mapped") == 0, "MISS").otherwise("OK")).withColumn("quality_flag", F.when(F.col("source").isin("src3", "src7"), "low").otherwise("ok"))


_ISSUES = {1: ["nation", "tion of"], 2: ["hand"], 3: ["onst"]}


@R.add(f"""WITH i AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}')" for i, ks in _ISSUES.items() for k in ks)}) t(issue, kw)),
h AS (SELECT doc_id, issue, count(*) FILTER (contains(lower(text), kw)) AS hits FROM documents, i GROUP BY ALL)
SELECT doc_id, CASE WHEN mx > 0 AND n = 1 THEN best END AS issue FROM (SELECT doc_id, max(hits) AS mx, count(*) FILTER (hits = m) AS n, min(issue) FILTER (hits = m) AS best FROM (SELECT *, max(hits) OVER (PARTITION BY doc_id) AS m FROM h) GROUP BY doc_id)""")
def issue_detection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", A.detected_issue(F.col("text"), _ISSUES).alias("issue"))


@R.add("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE list_distinct(list_filter([doc_id % 9, doc_id % 4, doc_id % 9], lambda x: x < 6)).list_sort() END AS chosen FROM documents""")
def model_choice(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 2, F.lit("no json")).otherwise(F.format_string('{"relevant": [%d, %d, %d]}', F.col("doc_id") % 9, F.col("doc_id") % 4, F.col("doc_id") % 9))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(A.parsed_choice(raw, 6)).cast("array<bigint>").alias("chosen"))


@R.add("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN i = doc_id % 6 THEN 'oppose' WHEN i = doc_id % 3 THEN 'support' ELSE '-' END), ',') END AS stances FROM documents""")
def model_stances(spark, sf_dir):
    """A list of stances by number: one, a later one, one that is no stance, and broken answers."""
    raw = F.when(F.col("doc_id") % 5 == 4, F.lit('{"items": 3')).otherwise(F.format_string('{"items": [{"i": %d, "stance": "support"}, {"i": %d, "stance": "oppose"}, {"i": 1, "stance": "shrug"}]}', F.col("doc_id") % 3, F.col("doc_id") % 6))
    stances = A.parsed_stances(raw, 4)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(stances.isNotNull(), F.array_join(F.transform(stances, lambda x: F.coalesce(x, F.lit("-"))), ",")).alias("stances"))


_PARTY = "CASE c_mktsegment WHEN 'BUILDING' THEN 'blue' WHEN 'MACHINERY' THEN 'red' WHEN 'HOUSEHOLD' THEN 'green' WHEN 'AUTOMOBILE' THEN '무소속' END"
_GROUP = "CASE user_id % 6 WHEN 0 THEN 'government' WHEN 1 THEN 'witness' WHEN 2 THEN 'unknown' ELSE 'assembly' END"


_LABEL_COUNTS = ", ".join(f"count(*) FILTER (stance = '{k}') AS {k}" for k in A.K.STANCE_LABELS)


@R.add(f"""WITH e AS (SELECT user_id, {_STANCE} AS stance FROM events), c AS (SELECT user_id, {_COUNTS} FROM e GROUP BY user_id), l AS (SELECT user_id, {_LABEL} AS stance FROM c),
a AS (SELECT stance, CASE {_GROUP} WHEN 'government' THEN '{A.K.GOVERNMENT_ROW}' WHEN 'assembly' THEN CASE WHEN {_PARTY} = '{A.K.NO_PARTY}' THEN '{A.K.NO_PARTY_ROW}' ELSE coalesce({_PARTY}, '{A.K.NO_PARTY_ROW}') END ELSE '{A.K.NO_PARTY_ROW}' END AS "row" FROM l JOIN customer ON c_custkey = user_id WHERE {_GROUP} <> 'witness'),
g AS (SELECT "row", count(*) AS n, {_LABEL_COUNTS} FROM a GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY CASE "row" WHEN '{A.K.GOVERNMENT_ROW}' THEN 1 WHEN '{A.K.NO_PARTY_ROW}' THEN 2 ELSE 0 END, n DESC, "row")::INT AS place FROM g""")
def party_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.expr(_PARTY).alias("party"))
    labels = stance_label(spark, sf_dir).select("user_id", F.col("label").alias("stance")).join(c, "user_id")
    return A.composition(labels.withColumn("grp", F.expr(_GROUP)), "stance", "party", "grp")


@R.add("""WITH m AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL),
x AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS top, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM m),
p AS (SELECT event_type, min(day) AS peak FROM x WHERE n = top GROUP BY 1)
SELECT event_type, day, n, round(n / top, 4) AS share, day = peak AS is_peak, i % ceil(c / 4.0)::BIGINT = 0 AS is_tick FROM x JOIN p USING (event_type)""")
def monthly_bars(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return A.bars(m, ["event_type"], "day", "n")


@R.add("""SELECT grp, n, dominant FROM (SELECT c_mktsegment AS grp, count(*) AS n, arg_max(event_type, (k, event_type)) AS dominant, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS rn
FROM (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL) e JOIN customer ON c_custkey = user_id GROUP BY 1 HAVING count(DISTINCT user_id) >= 3) WHERE rn <= 3""")
def group_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("grp"))
    g = e.join(c, "user_id").groupBy("grp").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("k", "event_type")).alias("dominant"), F.count_distinct("user_id").alias("users"))
    return g.where("users >= 3").orderBy(F.col("n").desc(), "grp").limit(3).drop("users")


@R.add("""SELECT c_custkey, a AS start, b AS "end", CASE WHEN c_mktsegment = ruling THEN 'ruling' ELSE 'opposition' END AS side FROM customer, (VALUES ('1995-01-01', '1997-12-31', 'BUILDING'), ('1998-01-01', '9999-12-31', 'MACHINERY')) p(a, b, ruling)""")
def party_history(spark, sf_dir):
    periods = [("1995-01-01", "1997-12-31", "BUILDING"), ("1998-01-01", "9999-12-31", "MACHINERY")]
    return A.history(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", periods)


@R.add("""WITH r AS (SELECT upper(left(p_name, 3)) AS name, nullif(trim(string_split(replace(p_type, ' ', ' / '), '/')[-1]), '') AS party FROM part WHERE contains(p_brand, '1'))
SELECT name, CASE WHEN count(DISTINCT party) = 1 THEN min(party) END AS party FROM r GROUP BY name""")
def member_party(spark, sf_dir):
    """Parties of the members of one era, the last of each history; none for a name that stands for several."""
    rows = table(spark, sf_dir, "part").select(F.upper(F.left("p_name", F.lit(3))).alias("who"), "p_brand", F.replace("p_type", F.lit(" "), F.lit(" / ")).alias("history"))
    return A.unambiguous(A.members(rows, "who", "p_brand", "history", "1"), "name", "party")


_VOCABULARY = "SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 7"


@R.add(f"""WITH v AS ({_VOCABULARY}) SELECT doc_id, count(*) AS n_terms, string_agg(w, ' ' ORDER BY w) AS terms FROM documents JOIN v ON contains(lower(text), w) GROUP BY doc_id""")
def terms_held(spark, sf_dir):
    """Which of hundreds of terms stand in each document: the long words of all benchmark items, in one pass over a text."""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")
    vocabulary = table(spark, sf_dir, "benchmark").select(words).where(F.length("w") >= 7).distinct().orderBy("w")
    terms = [r["w"] for r in vocabulary.collect()]  # a dictionary: the benchmark's, not the corpus's
    found = table(spark, sf_dir, "documents").select("doc_id", M.held(F.lower(F.coalesce("text", F.lit(""))), terms).alias("t")).where(F.size("t") > 0)
    return found.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.array_join("t", " ").alias("terms"))


def _rule_client():
    """A stand-in for a model: finds excerpts with a word relevant; every seventh answer of a task is no JSON at first."""
    import json

    class Client:
        calls = 0

        def __call__(self, prompt: str) -> str:
            self.calls += 1
            if self.calls % 7 == 0:
                return "let me think"
            return json.dumps({"relevant": [i for i, x in enumerate(prompt.split("\x1e")[1:]) if "nation" in x]})

    def parse(text: str, n: int):
        try:
            chosen = set(json.loads(text)["relevant"])
        except ValueError:
            return None
        return ["core" if i in chosen else "mention" for i in range(n)]

    return Client(), parse


@R.add(f"SELECT lang, doc_id, CASE WHEN contains(left(text, {C.EXCERPT}), 'nation') THEN 'core' ELSE 'mention' END AS verdict, NULL::VARCHAR AS failure FROM documents")
def judged_mapping(spark, sf_dir):
    """Every document's excerpt judged in batches of a language."""
    client, parse = _rule_client()
    rows = J.numbered(table(spark, sf_dir, "documents").select("lang", "doc_id", F.left("text", F.lit(C.EXCERPT)).alias("text")), ["lang"], "doc_id")
    return J.judged(rows, ["lang"], "doc_id", "text", prompt=lambda group, texts: "\x1e".join([group["lang"], *texts]), generate=client, parse=parse)


_KEYWORDS = {0: ["nation", "tion of"], 1: ["HAND"], 2: []}
_WHEN = "CASE WHEN doc_id % 11 > 0 THEN DATE '2023-01-01' + (doc_id % 100 * 9 + CASE WHEN doc_id % 3 = 0 THEN 300 ELSE 0 END)::INT END"


@R.add(f"""WITH k(issue, kw) AS (VALUES {", ".join(f"({i}, '{w.lower()}')" for i, ws in _KEYWORDS.items() for w in ws)}),
c AS (SELECT doc_id, doc_id // 2 AS turn_id, lower(text) AS low, strftime({_WHEN}, '%Y-%m') AS month FROM documents WHERE {_WHEN} IS NOT NULL),
a AS (SELECT issue::BIGINT AS issue, month, count(DISTINCT turn_id) AS corpus_turns FROM c JOIN k ON contains(low, kw) GROUP BY ALL),
b AS (SELECT doc_id % 3 AS issue, month, count(DISTINCT turn_id) AS mapped_turns, count(DISTINCT CASE WHEN quality = 1 THEN turn_id END) AS mapped_core_turns FROM labels JOIN c USING (doc_id) GROUP BY ALL),
m AS (SELECT issue, month, corpus_turns, mapped_turns, mapped_core_turns FROM a FULL JOIN b USING (issue, month)),
s AS (SELECT issue, strftime(unnest(generate_series(min(strptime(month || '-01', '%Y-%m-%d')), max(strptime(month || '-01', '%Y-%m-%d')), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM m GROUP BY issue)
SELECT issue, month, coalesce(corpus_turns, 0) AS corpus_turns, coalesce(mapped_turns, 0) AS mapped_turns, coalesce(mapped_core_turns, 0) AS mapped_core_turns FROM s LEFT JOIN m USING (issue, month)""")
def issue_timelines(spark, sf_dir):
    """Months of three issues by keyword and by mapping, from the first to the last of either."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("turn_id"), F.expr(_WHEN.replace("DATE '2023-01-01' + (", "date_add(DATE '2023-01-01', (").replace(")::INT END", ")::INT) END")).alias("date"), "text")
    mapping = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 3).alias("issue"), (F.col("quality") == 1).alias("core"))
    return A.issue_timeline(chunks, mapping, _KEYWORDS, chunk="doc_id")
