"""Loads, dimensions, mappings, scopes and sheets on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkweave import config as C
from talkweave.functions import text as X
from talkweave.operators import analytics as A
from talkweave.operators import evaluate as V
from talkweave.operators import gates as G
from talkweave.operators import search as S
from talkweave.plans.base import Registry, table
from talkweave.session import fresh
from talkweave.sources import keyed
from talkweave.sources import layers as L

R = Registry()


# Loads


@R.add("SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1') OR starts_with(source, 'src5')")
def prefix_sources(spark, sf_dir):
    return L.from_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["src1", "src5"])


@R.add("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN upper(lang) ELSE lang END AS lang, source, CASE WHEN source IN ('src1', 'src2') THEN 2 ELSE 1 END AS version FROM documents")
def source_reload(spark, sf_dir):
    """Two sources loaded anew in place of what they had, with a version."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").withColumn("version", F.lit(1))
    at = fresh(spark, "keyed")
    keyed.replace(d, at, "source")
    keyed.replace(d.where("source IN ('src1', 'src2')").withColumn("lang", F.upper("lang")).withColumn("version", F.lit(2)), at, "source")
    return keyed.read(spark, at, "source", d.schema)


@R.add("SELECT source, n AS expected, n - lost AS found FROM (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 100 = 3) AS lost FROM documents GROUP BY source) WHERE lost > 0")
def load_verification(spark, sf_dir):
    """Sources of which a load has lost rows."""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id") % 100 == 3)
    counts = d.toDF("source", "lost").groupBy("source").agg(F.count("*").alias("expected"), F.count_if(~F.col("lost")).alias("found"))
    return G.verified(counts)


@R.add("SELECT doc_id, length(text) AS chars, 'short' AS ledger FROM documents WHERE text IS NULL OR length(text) < 500 UNION ALL SELECT doc_id, length(text), 'kept' FROM documents WHERE length(text) >= 500")
def failure_ledger(spark, sf_dir):
    good, bad = G.failures(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")), lambda d: d["chars"] >= 500)
    return good.withColumn("ledger", F.lit("kept")).unionByName(bad.withColumn("ledger", F.lit("short")))


@R.add("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_ignored(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return L.insert_ignore(labels, table(spark, sf_dir, "documents").select("doc_id", F.lit(9).cast(labels.schema["quality"].dataType).alias("quality")), ["doc_id"])


@R.add("""WITH f AS (SELECT user_id % 400 AS k, event_type AS rating, ts, event_id FROM events), b AS (SELECT k, rating FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS rn FROM f) WHERE rn = 1)
SELECT c_custkey, coalesce(rating, 'none') AS rating, false AS missing FROM customer LEFT JOIN b ON k = c_custkey UNION ALL SELECT DISTINCT k, NULL, true FROM f WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def feedback_update(spark, sf_dir):
    """The newest feedback of each log row in the log, and feedback on rows that don't exist."""
    log = table(spark, sf_dir, "customer").select("c_custkey", F.lit("none").alias("rating"))
    changes = table(spark, sf_dir, "events").select((F.col("user_id") % 400).alias("c_custkey"), F.col("event_type").alias("rating"), F.struct("ts", "event_id").alias("at"))
    new, missing = L.updated(log, changes, "c_custkey", "at", ["rating"])
    return new.withColumn("missing", F.lit(False)).unionByName(missing.select("c_custkey").distinct().withColumns({"rating": F.lit(None).cast("string"), "missing": F.lit(True)}))


@R.add("SELECT event_id, user_id, 'click' AS kind FROM events WHERE event_type = 'click' UNION ALL SELECT event_id + 1000000, user_id, 'retry' FROM events WHERE event_type = 'view'")
def log_append(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    log = e.where("event_type = 'click'").select("event_id", "user_id", F.lit("click").alias("kind"))
    return L.appended(log, e.where("event_type = 'view'").select((F.col("event_id") + 1_000_000).alias("event_id"), "user_id", F.lit("retry").alias("kind")))


# Dimensions and lookups


@R.add("SELECT role AS speaker, CASE WHEN turn % 2 = 0 THEN 'even' END AS role, conv_id % 5 AS committee, count(*) AS n FROM conversations WHERE role <> '' GROUP BY ALL")
def speaker_dimension(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("role").alias("speaker"), F.when(F.col("turn") % 2 == 0, "even").alias("role"), (F.col("conv_id") % 5).alias("committee"))
    return A.speaker_dimension(t, "speaker", "role", "committee")


@R.add("SELECT s_name, n_name, round(s_acctbal, 2) AS n FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_name <> 'CHINA' WHERE s_name ILIKE '%r#0000000%' ORDER BY s_acctbal DESC, s_name LIMIT 20 OFFSET 5")
def speaker_list(spark, sf_dir):
    """Suppliers as speakers: by a part of the name, with their nation if it is listed, most first."""
    n = table(spark, sf_dir, "nation").where("n_name <> 'CHINA'").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier").where(S.holds("s_name", "r#0000000")).select("s_name", "s_nationkey", "s_acctbal")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_name", "n_name", F.round("s_acctbal", 2).alias("n"))
    return rows.orderBy(F.col("n").desc_nulls_last(), "s_name").offset(5).limit(20)


@R.add("SELECT DISTINCT text AS question FROM conversations WHERE role = 'user'")
def user_questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("text").alias("question")).distinct().orderBy("question")


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def iso_dates(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 3 == 0, " n/a ").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.iso_date(raw).alias("date"))


@R.add("SELECT doc_id, nfc_normalize(split_part(text, ' ', 1)) AS name FROM documents")
def normal_names(spark, sf_dir):
    """First words in their standard form; the test tables hold no compatibility characters, for which NFC would not do."""
    from talkweave.functions.question import nfkc

    return table(spark, sf_dir, "documents").select("doc_id", nfkc(F.get(F.split("text", " "), F.lit(0))).alias("name"))


# Mappings and scopes


_MONTHS = """m AS (SELECT c_mktsegment AS issue, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS corpus, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE count(*) FILTER (o_orderstatus = 'F') END AS core FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, strftime(o_orderdate, '%Y-%m'))"""


@R.add(f"""WITH {_MONTHS}, top AS (SELECT issue, max(core) AS top FROM m GROUP BY issue), v AS (SELECT m.issue, month, CASE WHEN top > 0 THEN core ELSE corpus END AS n FROM m JOIN top USING (issue)),
p AS (SELECT issue, string_agg(month || '(' || n || ')', ', ' ORDER BY n DESC, month) AS peaks FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY n DESC, month) AS rn FROM v WHERE n > 0) WHERE rn <= 3 GROUP BY issue),
c AS (SELECT c_mktsegment AS issue, n_name AS row, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY n DESC, row) AS place FROM c),
a AS (SELECT issue, string_agg(row || ' ' || n, ' / ' ORDER BY place) AS a FROM r WHERE place <= 4 GROUP BY issue),
o AS (SELECT c_mktsegment AS issue, c_custkey AS actor, n_name AS row, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
k AS (SELECT o.*, row_number() OVER (PARTITION BY o.issue ORDER BY o.n DESC, actor::VARCHAR) AS rn FROM o JOIN r ON r.issue = o.issue AND r.row = o.row WHERE place <= 4),
b AS (SELECT issue, string_agg(actor || '(' || row || ', ' || n || ')', ', ' ORDER BY rn) AS b FROM k WHERE rn <= 5 GROUP BY issue)
SELECT a.issue, 'composition: ' || a || chr(10) || 'peaks: ' || peaks || chr(10) || 'actors: ' || b AS block FROM a JOIN p USING (issue) JOIN b USING (issue)""")
def issue_block(spark, sf_dir):
    """Segments as issues: the four largest nations, the months of most orders, the customers of most orders among those."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("issue")).join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("row")), F.col("c_nationkey") == F.col("n_nationkey"))
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    core = F.when(F.col("issue") == "BUILDING", 0).otherwise(F.count_if(F.col("o_orderstatus") == "F"))
    months = both.groupBy("issue", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("corpus"), core.alias("core"))
    rows = c.groupBy("issue", "row").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("issue").orderBy(F.col("n").desc(), "row"))).where("place <= 4")
    counts = both.groupBy("issue", "row", F.col("c_custkey").alias("actor")).agg(F.count("*").alias("n"))
    actors = counts.join(rows.select("issue", "row"), ["issue", "row"])
    return A.issue_block(rows, months, actors, "issue", "month", "core", "corpus")


@R.add("SELECT doc_id, CASE WHEN l.quality = 1 THEN 'core' ELSE 'mention' END AS tier, CASE WHEN d.source IN ('src0', 'src3') THEN 'v2' ELSE 'v1' END AS map_version, source AS issue FROM documents d JOIN labels l USING (doc_id)")
def mapping_replace(spark, sf_dir):
    """Two issues' mappings replaced as a whole, with the version of the mapping."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("issue")).join(table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "core").otherwise("mention").alias("tier")), "doc_id")
    old, at = d.withColumn("map_version", F.lit("v1")), fresh(spark, "keyed")
    keyed.replace(old, at, "issue")
    keyed.replace(old.where("issue IN ('src0', 'src3')").withColumn("map_version", F.lit("v2")), at, "issue", expected=old.where("issue IN ('src0', 'src3')").groupBy("issue").agg(F.count("*").alias("n_rows")))
    return keyed.read(spark, at, "issue", old.schema)


@R.add(f"""WITH s AS (SELECT source, count(*) AS core, count(*) * 3 AS near FROM documents GROUP BY source), e AS (SELECT *, {C.SCOPE_LIMIT_MB / 100}::DOUBLE AS mb,
near * {C.ROW_KB['chunk'] + C.ROW_KB['indexed']}::DOUBLE / 1024 AS a, core * {C.ROW_KB['chunk'] + C.ROW_KB['indexed']}::DOUBLE / 1024 AS b, core * {C.ROW_KB['chunk'] + C.ROW_KB['raw']}::DOUBLE / 1024 AS c FROM s)
SELECT source, near, core, a <= mb AS neighbours, a <= mb OR b <= mb AS indexed, CASE WHEN a <= mb THEN near ELSE core END AS n_chunks, round(CASE WHEN a <= mb THEN a WHEN b <= mb THEN b ELSE c END, 1) AS est_mb FROM e""")
def scope_cascade(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("core")).select("source", (F.col("core") * 3).alias("near"), "core")
    return A.chosen_scope(sizes, "near", "core", C.SCOPE_LIMIT_MB / 100)


@R.add(f"SELECT source, count(*) AS n, round(count(*) * ({C.EXCERPT} * 0.9::DOUBLE + 60) / 1000000.0::DOUBLE * 0.15::DOUBLE, 6) AS usd FROM documents GROUP BY source")
def judging_cost(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("usd", F.round(A.judging_cost(F.col("n")), 6))


@R.add("""WITH m AS (SELECT source AS issue, d.doc_id, CASE WHEN source = 'src4' THEN 'mapped' WHEN quality = 1 THEN 'core' ELSE 'mention' END AS tier FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT issue, count(*) FILTER (tier = 'core') AS n_core, count(*) FILTER (tier = 'mention') AS n_mention, count(*) AS n_all, bool_or(tier <> 'mapped') AS tiered FROM m GROUP BY issue)
SELECT issue, doc_id, n_core, n_mention, n_all FROM (SELECT m.*, n_core, n_mention, n_all, row_number() OVER (PARTITION BY issue ORDER BY md5(doc_id || '|0'), doc_id) AS rn FROM m JOIN c USING (issue) WHERE NOT tiered OR tier = 'core') WHERE rn <= 5""")
def spot_check(spark, sf_dir):
    """A few rows to look at for each issue; one issue has no tiers yet."""
    tier = F.when(F.col("issue") == "src4", "mapped").when(F.col("quality") == 1, "core").otherwise("mention")
    m = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("issue")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn("tier", tier)
    return A.spot_check(m, "issue", "doc_id", "tier", 5)


# Evaluation


@R.add("SELECT doc_id, quality AS label_a, toxic AS label_b FROM labels WHERE quality <> toxic")
def eval_disagreements(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return V.disagreements(labels, labels, "doc_id", "quality", "toxic")


@R.add("""WITH h AS (SELECT doc_id, CASE WHEN length(text) < 300 THEN 'NONE' WHEN length(text) < 600 THEN 'REFUSED' ELSE 'PASS' END AS gate FROM documents)
SELECT l.doc_id, CASE WHEN (quality = 0) = (gate <> 'PASS') THEN 'KEEP' ELSE 'REVIEW' END AS verdict FROM labels l JOIN h USING (doc_id)""")
def eval_revalidate(spark, sf_dir):
    n = F.length("text")
    h = table(spark, sf_dir, "documents").select("doc_id", F.when(n < 300, "NONE").when(n < 600, "REFUSED").otherwise("PASS").alias("gate"))
    return table(spark, sf_dir, "labels").join(h, "doc_id").select("doc_id", V.revalidated(F.col("quality") == 0, F.col("gate")).alias("verdict"))


@R.add("""SELECT conv_id, string_agg('## ' || turn || ' ' || role || chr(10) || 'label:' || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS sheet FROM conversations GROUP BY conv_id""")
def label_sheets(spark, sf_dir):
    return V.blind_sheet(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role"), F.col("text"))


@R.add("SELECT conv_id, turn::VARCHAR AS id, CASE role WHEN 'user' THEN 'support' ELSE 'oppose' END AS label FROM conversations WHERE turn % 3 <> 1 AND role IN ('user', 'assistant')")
def label_sheet_read(spark, sf_dir):
    """Filled sheets read back: an id line, a label line; some labels are empty, some unknown, some given twice."""
    t = table(spark, sf_dir, "conversations")
    label = F.when(F.col("turn") % 3 == 1, "").when(F.col("role") == "user", "support").when(F.col("role") == "assistant", "oppose").otherwise("shrug")
    lines = F.array(F.concat(F.lit("## "), "turn", F.lit(" x")), F.lit(""), F.concat(F.lit("label: "), label), F.lit("label: "), F.when(label.isin("support", "oppose"), F.lit("label: neutral")).otherwise(F.lit("text")))
    rows = t.select("conv_id", (F.col("turn") * 10).alias("at"), F.posexplode(lines).alias("i", "line")).select("conv_id", (F.col("at") + F.col("i")).alias("at"), "line")
    return V.label_sheet(rows, "conv_id", "at", "line", ["support", "oppose", "neutral"])


@R.add("""SELECT doc_id, lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3') AND (contains(text, 'the') OR contains(text, 'ung')) AND (contains(text, 'tion') OR contains(text, 'und')) AS both,
lang IN ('en', 'de') AND (contains(text, 'ation') OR source = 'src1') AS either, lang IN ('en', 'de') AS lone FROM documents""")
def eval_relevance(spark, sf_dir):
    """Documents held against criteria of mode `and`, of no mode, and with groups of words but no words of their own."""
    none, words = F.array().cast("array<string>"), lambda *x: F.array(*map(F.lit, x))
    groups = F.array().cast("array<array<string>>")
    d = table(spark, sf_dir, "documents")
    args = dict(text=F.col("text"), speaker=F.col("source"), committee=F.col("lang"), date=F.lit("2024-01-01"))
    both = F.struct(words("en", "de").alias("committee_any"), words("2024").alias("date_any"), words("src1", "src2", "src3").alias("speaker_any"), words("the", "ung").alias("text_any"), F.array(words("tion", "und")).alias("text_all"), F.lit("and").alias("mode"))
    either = F.struct(words("en", "de").alias("committee_any"), none.alias("date_any"), words("src1").alias("speaker_any"), words("ation").alias("text_any"), groups.alias("text_all"), F.lit(None).cast("string").alias("mode"))
    lone = F.struct(words("en", "de").alias("committee_any"), none.alias("date_any"), none.alias("speaker_any"), none.alias("text_any"), F.array(words("never there")).alias("text_all"), F.lit("and").alias("mode"))
    return d.select("doc_id", V.relevant(both, **args).alias("both"), V.relevant(either, **args).alias("either"), V.relevant(lone, **args).alias("lone"))


@R.add("SELECT doc_id, text FROM (SELECT * FROM documents ORDER BY md5(doc_id || '|11'), doc_id LIMIT 25) ORDER BY doc_id")
def audit_sample(spark, sf_dir):
    return G.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 25, "11")


@R.add("""WITH k AS (SELECT doc_id, length(text) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 30), r AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id)::INT AS rank FROM k)
SELECT doc_id, rank, coalesce(p, 1000000 + rank)::BIGINT AS new_rank FROM r LEFT JOIN (VALUES (3, 0), (10, 2), (0, 3)) v(d, p) ON d = doc_id ORDER BY new_rank LIMIT 10""")
def rerank_repair(spark, sf_dir):
    """The thirty longest documents in an order that names one twice, one that isn't there, and few of them."""
    top = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).orderBy(F.col("n").desc(), "doc_id").limit(C.RERANK_POOL)
    return S.repaired_order(S.ranked(top, F.col("n").desc(), F.col("doc_id")).select("doc_id", "rank"), "doc_id", [3, -1, 10, 0, 3], 10)
