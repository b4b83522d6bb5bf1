"""Cleaning, sections, turns, enrichment and chunks, bound to pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave import config as C
from talkweave.functions import text as X
from talkweave.operators import chunk as K
from talkweave.operators import turns as T
from talkweave.plans.base import Registry, spread, table
from talkweave.sources import layers as L

R = Registry()
#: On the test tables, which have no minutes: short lines, lines of marks and lines that name a licence are noise.
_NOISE = [r"^\s*\d{1,4}\s*$", r"^[\s=*/-]{5,}$", r"^(Licensed|Released) under .{0,60}$"]


def _noise(line):
    hit = F.lit(False)
    for p in _NOISE:
        hit = hit | line.rlike(p)
    return hit


_IS_NOISE = " OR ".join(f"regexp_matches(x, '{p}')" for p in _NOISE)


@R.add(f"""SELECT doc_id, len(l)::INT AS n_lines, array_to_string(list_transform(l, lambda x: regexp_replace(x, '[ \\t]{{2,}}', ' ', 'g')), chr(10)) AS clean
FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT ({_IS_NOISE})) AS l FROM documents)""")
def noise_line_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", X.clean_lines(F.col("text"), _noise).alias("l"))
    return lines.select("doc_id", F.size("l").alias("n_lines"), F.array_join("l", "\n").alias("clean"))


@R.add(f"""SELECT line, count(*) AS n FROM (SELECT trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t]+', ' ', 'g')) AS line FROM documents)
WHERE length(line) >= {C.MIN_AGENDA_CHARS} GROUP BY line ORDER BY n DESC, line LIMIT {C.TOP_AGENDA}""")
def line_census(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim(F.regexp_replace("line", r"[ \t]+", " ")).alias("line"))
    return lines.where(F.length("line") >= C.MIN_AGENDA_CHARS).groupBy("line").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "line").limit(C.TOP_AGENDA)


@R.add(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_text_extract(spark, sf_dir):
    return L.page_texts(table(spark, sf_dir, "pages"), "page_id", "html")[0]


@R.add(r"""SELECT page_id FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '<p> </p>' ELSE html END AS html FROM pages) GROUP BY page_id
HAVING bool_and(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) = '')""")
def blank_sources(spark, sf_dir):
    """Sources all of whose pages are blank; here every fifth page's text is taken away."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 5 == 0, "<p> </p>").otherwise(F.col("html")))
    return L.page_texts(pages, "page_id", "html")[1]


@R.add(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query,
regexp_extract(url, '(\d{4,})', 1) AS number, starts_with(url, 'https://') AS secure FROM pages""")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(url, r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, r"^https?://[^/]+(/[^?#]*)", 1).alias("path"), F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"),
        F.regexp_extract(url, r"(\d{4,})", 1).alias("number"), url.startswith("https://").alias("secure"),
    )


@R.add(r"""SELECT page_id, lang || '_' || number || '_' || replace(host, '.', '-') || '.html' AS file_name FROM (SELECT page_id, regexp_extract(html, '<html lang="(\w+)"', 1) AS lang, regexp_extract(url, '(\d{4,})', 1) AS number, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)""")
def file_names(spark, sf_dir):
    name = L.file_name(F.regexp_extract("html", r'<html lang="(\w+)"', 1), F.regexp_extract("url", r"(\d{4,})", 1), host=F.regexp_extract("url", r"^https?://([^/]+)", 1))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("file_name"))


#: Letters as Hangul syllables, so that the minutes below have words that end, go on, and carry particles.
_HANGUL = "나리지마다교보소고하가스디는사회부을수로구버무세법조"
_HEADER = "제415회-국토교통위원회제2차(2024년6월11일)"
_WHO = {"user": "위원 김하나", "assistant": "홍길동 장관"}


def _minutes(spark, sf_dir):
    """Conversations as pages of minutes: each turn a marked speaker and Hangul lines of 14 characters, some of them under an
    agenda heading or two report headings, some headers naming no one; three turns a page, each page with a running header, a
    page mark and, from the second on, a line that goes on from the page before."""
    body = F.regexp_replace(F.translate(F.lower(F.regexp_replace("text", r"\s+", " ")), "abcdefghijklmnopqrstuvwxyz", _HANGUL), "(.{14})", "$1\n")
    who = F.when(F.col("role") == "user", _WHO["user"]).when(F.col("role") == "assistant", _WHO["assistant"]).otherwise("출석 위원")
    who = F.when(F.col("turn") % 5 == 3, "여러 위원").otherwise(who)
    head = F.when(F.col("turn") % 6 == 2, "의사일정\n").when(F.col("turn") % 7 == 4, "■ 보고사항\n■ 처리된 의안\n").otherwise("")
    line = F.concat(head, F.when(F.col("turn") % 3 == 2, "").otherwise("◯"), who, F.lit(" "), body)
    turns = table(spark, sf_dir, "conversations").withColumn("page", F.floor(F.col("turn") / 3).cast("int") + 1).withColumn("line", line)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    # A number of partitions that is asked for isn't made smaller: the pages' repair is much work on few bytes.
    turns = turns.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "conv_id")
    pages = turns.groupBy(F.col("conv_id").alias("source_id"), "page").agg(lines.alias("text"))
    return pages.withColumn("text", F.concat(F.lit(_HEADER + "\n"), F.when(F.col("page") > 1, "앞에서 이어진 말\n").otherwise(""), "text", F.lit("\n- "), "page", F.lit(" -")))


_MINUTES = f"""SELECT conv_id AS source_id, (turn // 3)::INT + 1 AS page, '{_HEADER}' || chr(10) || CASE WHEN turn // 3 > 0 THEN '앞에서 이어진 말' || chr(10) ELSE '' END || string_agg(CASE WHEN turn % 6 = 2 THEN '의사일정' || chr(10) WHEN turn % 7 = 4 THEN '■ 보고사항' || chr(10) || '■ 처리된 의안' || chr(10) ELSE '' END
 || CASE WHEN turn % 3 = 2 THEN '' ELSE '◯' END || CASE WHEN turn % 5 = 3 THEN '여러 위원' ELSE CASE role WHEN 'user' THEN '{_WHO['user']}' WHEN 'assistant' THEN '{_WHO['assistant']}' ELSE '출석 위원' END END || ' '
 || regexp_replace(translate(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'abcdefghijklmnopqrstuvwxyz', '{_HANGUL}'), '(.{{14}})', '\\1' || chr(10), 'g'), chr(10) ORDER BY turn)
 || chr(10) || '- ' || ((turn // 3)::INT + 1) || ' -' AS text FROM conversations GROUP BY conv_id, turn // 3"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _any(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


_NOISE_SQL = f"({_strip('x')} <> '' AND ({_any(_strip('x'), X.K.NOISE.values())} OR regexp_matches({_strip('x')}, '{X.K.PAGE_MARK}') AND length({_strip('x')}) < 12))"
_STARTS = f"^[{X.K.MARKERS}{X.K.HEADINGS}]|{X.K.REPORT_START}|{X.K.AGENDA_START}"
_LAST = "split_part(a, chr(10), -1)"
_PREV, _CURR = f"regexp_replace({_LAST}, '\\s+$', '')", "regexp_replace(x, '^\\s+', '')"
_HANGUL_BOTH = f"regexp_matches({_PREV}, '[가-힣]$') AND regexp_matches({_CURR}, '^[가-힣]')"
_GLUE = f"""NOT regexp_matches({_PREV}, '[{X.K.SENTENCE_LAST}{X.K.PARTICLE_LAST}]$')
 AND (regexp_matches({_CURR}, '{X.K.FORCED_JOIN}') OR length(regexp_extract({_PREV}, '(\\S*)$', 1)) <= 3)"""
_NOW = "split_part(split_part(a, chr(30), -1), chr(31), 1)"
_NEW = "a || chr(30) || '{kind}' || chr(31) || x"
_SAME = "a || chr(10) || x"
#: Folds over a text that carries its own state: lines parted by a line feed, blocks by chr(30), a block's kind by chr(31).
_BLOCKS = f"""m AS ({_MINUTES}),
clean AS (SELECT *, list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT {_NOISE_SQL}), lambda x: regexp_replace(x, '[ \t]{{2,}}', ' ', 'g')) AS l FROM m),
whole AS (SELECT *, string_split(substr(list_reduce(list_prepend('', l), lambda a, x: CASE WHEN {_PREV} = '' OR {_CURR} = '' OR regexp_matches({_CURR}, '{_STARTS}') OR NOT ({_HANGUL_BOTH}) THEN a || chr(10) || x
  ELSE regexp_replace(a, '\\s+$', '') || CASE WHEN {_GLUE} THEN '' ELSE ' ' END || {_CURR} END), 2), chr(10)) AS lines FROM clean WHERE len(l) > 0),
folded AS (SELECT *, list_reduce(list_prepend((CASE WHEN page <= 2 THEN 'cover' ELSE 'body' END) || chr(31), lines), lambda a, x: CASE
  WHEN regexp_matches({_strip('x')}, '{X.K.REPORT_START}') THEN {_NEW.format(kind='report')} WHEN {_NOW} = 'report' THEN {_SAME}
  WHEN regexp_matches({_strip('x')}, '^[{X.K.MARKERS}]') THEN CASE WHEN {_NOW} <> 'body' THEN {_NEW.format(kind='body')} ELSE {_SAME} END
  WHEN regexp_matches({_strip('x')}, '{X.K.AGENDA_START}') AND {_NOW} NOT IN ('body', 'agenda') THEN {_NEW.format(kind='agenda')} ELSE {_SAME} END) AS acc FROM whole),
blocks AS (SELECT source_id, page, text, list_filter(list_transform(string_split(acc, chr(30)), lambda b: split_part(b, chr(31), 1) || '|' || {_strip("split_part(b, chr(31), 2)")}), lambda b: NOT regexp_matches(b, '^[a-z]+[|]$')) AS b FROM folded)"""


@R.add(f"""WITH {_BLOCKS}, k AS (SELECT *, list_distinct(list_transform(b, lambda x: split_part(x, '|', 1))) AS kinds FROM blocks)
SELECT source_id, page, CASE len(kinds) WHEN 0 THEN 'unknown' WHEN 1 THEN kinds[1] ELSE 'mixed' END AS page_type, regexp_matches(text, '{X.K.SESSION_HEADER}') AS has_header,
len(list_filter(b, lambda x: starts_with(x, 'body|') AND regexp_matches(x, '[{X.K.MARKERS}]'))) > 0 AS has_marker, len(b)::INT AS n_segments, array_to_string(b, chr(29)) AS segments FROM k""")
def section_segments(spark, sf_dir):
    joined = F.array_join(F.transform("segments", lambda s: F.concat(s["section_type"], F.lit("|"), s["text"])), "\x1d")
    return T.normalized(_minutes(spark, sf_dir)).select("source_id", "page", "page_type", "has_header", "has_marker", F.size("segments").alias("n_segments"), joined.alias("segments"))


def _speaker_sql(h: str, what: str) -> str:
    """The name or the role of a header: forms in order, no pronouns in the forms where the name could be one."""
    out = []
    for i, (p, name, role) in enumerate(X.K.SPEAKER_FORMS):
        person = f"regexp_extract({h}, '{p}', {name})"
        value = person if what == "name" else f"regexp_extract({h}, '{p}', {role})" if role else "NULL"
        pronouns = ", ".join(f"'{x}'" for x in X.K.NOT_NAMES)
        out.append(f"WHEN regexp_matches({h}, '{p}') THEN " + (value if i < 2 else f"CASE WHEN {person} NOT IN ({pronouns}) THEN {value} END"))
    return "CASE " + " ".join(out) + " END"


def _split_sql(source: str) -> str:
    """CTEs from a table with a stripped header: who(name, role, rest) of its first two tokens, its first, or all of it."""
    return f"""tokens AS (SELECT *, string_split(header, ' ') AS t FROM {source}),
heads AS (SELECT *, {_strip("t[1] || ' ' || t[2]")} AS h2, {_strip("t[1]")} AS h1, {_strip("header")} AS h0 FROM tokens),
names AS (SELECT *, CASE WHEN len(t) >= 2 THEN {_speaker_sql('h2', 'name')} END AS n2, CASE WHEN len(t) >= 2 THEN {_speaker_sql('h1', 'name')} END AS n1, {_speaker_sql('h0', 'name')} AS n0 FROM heads),
who AS (SELECT *, coalesce(n2, n1, n0) AS name, CASE WHEN n2 IS NOT NULL THEN {_speaker_sql('h2', 'role')} WHEN n1 IS NOT NULL THEN {_speaker_sql('h1', 'role')} WHEN n0 IS NOT NULL THEN {_speaker_sql('h0', 'role')} END AS "role",
  CASE WHEN n2 IS NOT NULL THEN array_to_string(t[3:], ' ') WHEN n1 IS NOT NULL THEN array_to_string(t[2:], ' ') WHEN n0 IS NOT NULL THEN '' END AS rest FROM names)"""


_LISTED = f"regexp_matches(header, '{X.K.DROPPED_HEADERS}')"
_DROPPED = f"(name IS NULL OR {_LISTED} OR name IN ({', '.join(repr(x) for x in X.K.DROPPED_NAMES)}))"
#: The pieces of each page's body, and of what may stand before it, with the speakers at their markers.
_PIECES = f"""{_BLOCKS}, seg AS (SELECT source_id, page, split_part(x, '|', 1) AS kind, substr(x, length(split_part(x, '|', 1)) + 2) AS body, seg FROM (SELECT source_id, page, unnest(b) AS x, generate_subscripts(b, 1) AS seg FROM blocks)),
firsts AS (SELECT *, min(seg) FILTER (kind = 'body') OVER (PARTITION BY source_id, page) AS first FROM seg),
parts AS (SELECT source_id, page, seg, kind, CASE WHEN kind = 'body' THEN string_split(regexp_replace(body, '([{X.K.MARKERS}])', chr(30) || '\\1', 'g'), chr(30)) ELSE [regexp_extract(body, '^[^{X.K.MARKERS}]*')] END AS p
  FROM firsts WHERE kind = 'body' OR page > 1 AND seg < first AND kind NOT IN ('agenda', 'report', 'attendance')),
pieces AS (SELECT source_id, page, seg, kind, unnest(p) AS raw, generate_subscripts(p, 1) AS piece FROM parts),
heads0 AS (SELECT *, kind = 'body' AND regexp_matches(raw, '^[{X.K.MARKERS}]') AS is_turn, {_strip(f"regexp_extract(raw, '^[{X.K.MARKERS}]?([^\n]*)', 1)")} AS header, {_strip("regexp_extract(raw, '(?s)^[^\n]*\n(.*)$', 1)")} AS below FROM pieces WHERE {_strip("raw")} <> ''),
{_split_sql('heads0')}"""


@R.add(f"""WITH {_PIECES},
kept AS (SELECT *, sum(is_turn::INT) OVER (PARTITION BY source_id ORDER BY page, seg, piece) AS turn_no,
  CASE WHEN NOT is_turn THEN {_strip("raw")} WHEN rest = '' THEN below ELSE {_strip("rest || ' ' || below")} END AS said FROM who WHERE NOT is_turn OR NOT {_DROPPED})
SELECT source_id, turn_no::BIGINT AS turn_no, printf('%s_turn_%04d', source_id::VARCHAR, turn_no::BIGINT) AS turn_id, max(name) FILTER (is_turn) AS speaker, max("role") FILTER (is_turn) AS "role",
coalesce(string_agg(nullif(said, ''), ' ' ORDER BY page, seg, piece), '') AS text, min(page) AS page_start, max(page) AS page_end FROM kept WHERE turn_no > 0 GROUP BY source_id, turn_no""")
def speaker_turns(spark, sf_dir):
    return T.turns(T.normalized(_minutes(spark, sf_dir)))


_HEADS = {"user": "위원장 김하나", "assistant": "홍길동 장관", "system": "국토교통부제2차관 박이나"}
_PRONOUN = "여러 위원"


@R.add(f"""WITH h AS (SELECT conv_id, turn, CASE WHEN turn % 9 = 8 THEN '{_PRONOUN}' WHEN role = 'user' THEN '{_HEADS['user']}' WHEN role = 'assistant' THEN '{_HEADS['assistant']}' ELSE '{_HEADS['system']}' END || ' ' || text AS header FROM conversations),
{_split_sql('h')} SELECT conv_id, turn, name, "role", rest FROM who""")
def speaker_split(spark, sf_dir):
    who = F.when(F.col("turn") % 9 == 8, _PRONOUN).when(F.col("role") == "user", _HEADS["user"]).when(F.col("role") == "assistant", _HEADS["assistant"]).otherwise(_HEADS["system"])
    heads = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(who, F.lit(" "), "text").alias("header"))
    return heads.select("conv_id", "turn", X.split_header(F.col("header")).alias("s")).select("conv_id", "turn", "s.*")


@R.add(f"""WITH {_PIECES} SELECT left(header, 60) AS header, count(*) AS n FROM who WHERE is_turn AND name IS NULL AND NOT {_LISTED} GROUP BY 1 ORDER BY n DESC, header""")
def dropped_header_census(spark, sf_dir):
    return T.dropped_headers(T.normalized(_minutes(spark, sf_dir)))


@R.add(f"""WITH m AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations)
SELECT conv_id AS source_id, no::BIGINT AS turn_no, printf('%s_turn_%04d', conv_id::VARCHAR, no::BIGINT) AS turn_id, '김하나' AS speaker, '위원장' AS "role",
coalesce(string_agg(nullif({_strip("regexp_replace(text, '[" + X.K.MARKERS + "]', '', 'g')")}, ''), ' ' ORDER BY turn), '') AS text, 1 AS page_start, 1 AS page_end FROM m WHERE no > 0 GROUP BY conv_id, no""")
def turn_ids(spark, sf_dir):
    """Turns of ready-made segments, one for each conversation turn: a user's begins a turn, the others go on with it."""
    said = X.strip(F.regexp_replace("text", f"[{X.K.MARKERS}]", ""))
    text = F.concat(F.when(F.col("role") == "user", F.lit("◯" + _HEADS["user"] + "\n")).otherwise(""), said)
    segments = F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("text")))), lambda x: F.struct(F.lit("body").alias("section_type"), x["text"].alias("text")))
    return T.turns(table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("source_id")).agg(segments.alias("segments"), F.lit(1).alias("page")))


_EN = {"motion": ["approve", "reject", "vote", "ration"], "positive": ["the", "agree"], "negative": ["of", "not"], "question": "[?]|why|how"}
_LIST = {k: ", ".join(f"'{x}'" for x in v) for k, v in _EN.items() if k != "question"}


@R.add(f"""SELECT conv_id, turn, CASE WHEN list_has_any(w, [{_LIST['motion']}]) THEN 'motion' WHEN regexp_matches(text, '{_EN['question']}') THEN 'question' ELSE 'statement' END AS utterance_type,
CASE WHEN p AND n THEN 'mixed' WHEN p THEN 'positive' WHEN n THEN 'negative' ELSE 'neutral' END AS stance
FROM (SELECT *, list_has_any(w, [{_LIST['positive']}]) AS p, list_has_any(w, [{_LIST['negative']}]) AS n FROM (SELECT *, string_split_regex(text, '\\s+') AS w FROM conversations))""")
def enrich_type_stance(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.utterance_type(F.col("text"), _EN["motion"], _EN["question"]).alias("utterance_type"), X.stance_signal(F.col("text"), _EN["positive"], _EN["negative"]).alias("stance")
    )


_ENTITIES = r"(?:Apache|GNU|MIT|CC BY)[A-Za-z -]{0,20}License|https?://[a-z.]+"


@R.add(f"""WITH m AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '{_ENTITIES}')) AS m FROM documents)
SELECT value, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(m) AS value FROM m) GROUP BY value ORDER BY n DESC, value LIMIT 50""")
def enrich_mentions(spark, sf_dir):
    turns = T.enriched(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), entities=_ENTITIES)
    hits = turns.select("doc_id", F.explode("mentions").alias("value"))
    return hits.groupBy("value").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs")).orderBy(F.col("n").desc(), "value").limit(50)


_FIELDS = {"licences": r"(?:Apache|GNU|MIT|CC BY)[A-Za-z -]{0,20}License", "numbers": r"\d{3,}"}
_FIELD_SQL = " UNION ALL ".join(f"SELECT doc_id, length(text) < {C.SHORT_CHARS} AS short, '{f}' AS field, regexp_extract_all(text, '{p}') AS vs FROM documents" for f, p in _FIELDS.items())


@R.add(f"""WITH v AS ({_FIELD_SQL}), c AS (SELECT field, count(*) AS n, count_if(len(vs) > 0) AS filled FROM v GROUP BY field),
t AS (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS place FROM (SELECT field, unnest(vs) AS value FROM v) GROUP BY field, value QUALIFY place <= CASE field WHEN 'licences' THEN 30 ELSE 20 END),
s AS (SELECT field, len(vs) > 0 AS filled, doc_id FROM v WHERE len(vs) > 0 OR NOT short QUALIFY row_number() OVER (PARTITION BY field, len(vs) > 0 ORDER BY md5(doc_id || '|0'), doc_id) <= 10)
SELECT 'coverage' AS part, field, n || ' ' || filled || ' ' || printf('%.4f', filled / n) AS line FROM c UNION ALL SELECT 'top', field, place || ' ' || value || ' ' || n FROM t UNION ALL SELECT 'sample', field, (CASE WHEN filled THEN 'filled ' ELSE 'empty ' END) || doc_id FROM s""")
def field_reports(spark, sf_dir):
    """Coverage, most frequent values and samples of what two patterns find in the documents."""
    from talkweave.operators.gates import field_report

    d = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") < C.SHORT_CHARS).alias("short"), *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f) for f, p in _FIELDS.items()])
    coverage, top, drawn = field_report(d, "doc_id", {"licences": 30, "numbers": 20}, 10, F.col("short"))
    line = lambda df, part, *cols: df.select(F.lit(part).alias("part"), "field", F.concat_ws(" ", *cols).alias("line"))
    return (
        line(coverage, "coverage", "n", "n_filled", F.format_string("%.4f", "coverage")).unionAll(line(top, "top", "place", "value", "n"))
        .unionAll(line(drawn, "sample", F.when(F.col("filled"), "filled").otherwise("empty"), "doc_id"))
    )


@R.add("""SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT (lang, source)) AS n_pairs, avg(CASE WHEN len(regexp_extract_all(text, 'License')) > 0 THEN 1.0 ELSE 0.0 END) AS coverage FROM documents GROUP BY lang""")
def enrichment_audit(spark, sf_dir):
    has = (F.size(F.regexp_extract_all("text", F.lit("License"), F.lit(0))) > 0).cast("double")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.count_distinct(F.struct("lang", "source")).alias("n_pairs"), F.avg(has).alias("coverage"))


@R.add(f"""SELECT conv_id, turn, coalesce(lag(x) OVER w, '') AS prev_context, coalesce(lead(x) OVER w, '') AS next_context, conv_id || ' 2024-06-' || lpad((turn + 1)::VARCHAR, 2, '0') || ' ' || conv_id || CASE WHEN role = 'user' THEN '' ELSE ' ' || role END || ' {X.K.SPEECH_MARK}: ' || text AS embed_text
FROM (SELECT *, conv_id || ' ' || role || ': ' || left(text, {C.CONTEXT_CHARS}) AS x FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def chunk_context(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("speaker", F.col("conv_id").cast("string"))
    out = K.with_context(turns, "conv_id", "turn", "speaker", "role", "text")
    return out.select("conv_id", "turn", "prev_context", "next_context", K.embed_text(F.col("conv_id"), F.concat(F.lit("2024-06-"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0")), F.col("speaker"), F.when(F.col("role") != "user", F.col("role")), F.col("text")).alias("embed_text"))


_DOMAINS = {"src1": "law", "src2": "budget", "src5": "health"}
_BILLS = [r"\bact \d+", r"(?:Apache|MIT|GNU)[A-Za-z ]{0,30}License"]


@R.add(f"""WITH w AS (SELECT doc_id, source, text, string_split_regex(text, '\\s+') AS w FROM documents)
SELECT doc_id, CASE source {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DOMAINS.items())} ELSE 'other' END AS policy_domain,
array_to_string(list_distinct(list_transform(list_concat({", ".join(f"regexp_extract_all(text, '{p}')" for p in _BILLS)}), lambda x: trim(x))).list_sort(), '; ') AS bills,
CASE WHEN list_has_any(w, ['찬성']) THEN 'motion' WHEN regexp_matches(text, '[?？]') THEN 'question' ELSE 'statement' END AS utterance_type, 'neutral' AS stance_signal FROM w""")
def enriched_turns(spark, sf_dir):
    """The whole enrichment: domain by source, references, type and stance."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    domains = spark.createDataFrame(list(_DOMAINS.items()), "source string, policy_domain string")
    out = T.enriched(d, committee="source", domains=domains).withColumn("bill_refs", X.found_in_order(F.col("text"), _BILLS))
    return out.select("doc_id", "policy_domain", F.array_join(F.array_sort("bill_refs"), "; ").alias("bills"), "utterance_type", "stance_signal")


@R.add(f"SELECT length(text) < {C.SHORT_CHARS} AS is_short, role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ALL")
def chunk_short_flags(spark, sf_dir):
    return K.emitted(table(spark, sf_dir, "conversations"), ["role"], "text")


def chunks_sql(source: str, key: str, max_chars: int, keep: str = "", apart: str = "") -> str:
    """CTEs up to chunks(key, keep, chunk_index, chunk_total, chunk_text): sentences marked by chr(30), long ones cut, then a
    fold over a text whose buffers are parted by chr(30). apart: `\\x1e`, so that a place marked once isn't marked again, which
    puts empty sentences there and takes a buffer's first blanks off before the next sentence is measured."""
    mark = "body"
    for _ in range(3):  # a match takes the character after the mark, which may be a mark itself
        mark = f"regexp_replace({mark}, '([.!?。])(\\s|[^0-9\\s{apart}])', '\\1' || chr(30) || '\\2', 'g')"
    last = "split_part(a, chr(30), -1)"
    before = f"left(a, length(a) - length({last}))"
    return f"""trimmed AS (SELECT {key}, {keep} {_strip("coalesce(text, '')")} AS body FROM {source}),
sentences AS (SELECT {key}, {keep} body, string_split({mark}, chr(30)) AS s FROM trimmed),
cut AS (SELECT {key}, {keep} body, flatten(list_transform(s, lambda x: list_transform(range(0, greatest((length(x) - 1) // {C.HARD_SPLIT} + 1, 1)::BIGINT), lambda i: substr(x, i * {C.HARD_SPLIT} + 1, {C.HARD_SPLIT})))) AS s FROM sentences),
packed AS (SELECT {key}, {keep} CASE WHEN length(body) <= {max_chars} THEN [body]
  ELSE list_transform(string_split(list_reduce(list_prepend('', s), lambda a, x: CASE WHEN {last} = '' THEN a || x WHEN length({last}) + length(x) + 1 > {max_chars} THEN {before} || {_strip(last)} || chr(30) || x ELSE {before} || {_strip(f"{last} || ' ' || x")} END), chr(30)), lambda x: {_strip('x')}) END AS p FROM cut),
chunks AS (SELECT {key}, {keep} unnest(p) AS chunk_text, generate_subscripts(p, 1)::INT AS chunk_index, len(p)::INT AS chunk_total FROM packed)"""


@R.add(f"""WITH {chunks_sql('documents', 'doc_id', C.MAX_CHARS, 'lang,')} SELECT doc_id, lang, printf('%d_chunk_%03d', doc_id, chunk_index) AS chunk_id, chunk_index, chunk_total, chunk_text, length(chunk_text) < {C.SHORT_CHARS} AS is_short FROM chunks""")
def chunk_pack(spark, sf_dir):
    return K.chunks(spread(table(spark, sf_dir, "documents")), ["doc_id"], "text", keep=["lang"])


_HITS = " + ".join(f"{C.TOKEN_WEIGHT} * contains(lower(chunk_text), '{t}')::INT" for t in ("the", "nation"))


@R.add(f"""WITH {chunks_sql('documents', 'doc_id', C.MAX_CHARS)}, k AS (SELECT printf('%d_chunk_%03d', doc_id, chunk_index) AS chunk_id, {_HITS} AS score FROM chunks WHERE {_HITS} > 0 ORDER BY score DESC, chunk_id LIMIT 60),
r AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS kw_rank FROM k), s AS (SELECT *, regexp_extract(chunk_id, '^(.*)_chunk_', 1) AS turn_id, round({C.RRF_KEYWORD}::DOUBLE / ({C.RRF_K} + kw_rank), 5) AS rrf FROM r)
SELECT chunk_id, kw_rank, NULL::INT AS vec_rank, rrf, turn_id FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY rrf DESC, kw_rank, chunk_id) AS rn FROM s) WHERE rn = 1""")
def hybrid_dedup_turn(spark, sf_dir):
    """The best chunk of each document by keyword hits."""
    from talkweave.operators import search as S

    pieces = K.chunks(spread(table(spark, sf_dir, "documents")), ["doc_id"], "text")
    hits = S.ranked(S.keyword_search(pieces, "chunk_id", [], ["the", "nation"], text="chunk_text", limit=60), F.col("score").desc(), F.col("chunk_id"))
    scored = hits.select("chunk_id", F.col("rank").alias("kw_rank"), F.lit(None).cast("int").alias("vec_rank"), F.round(C.RRF_KEYWORD / (C.RRF_K + F.col("rank")), 5).alias("rrf"))
    return S.best_per_turn(scored)


@R.add("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 20)::BIGINT AS batch FROM documents")
def batch_fixed(spark, sf_dir):
    return K.fixed_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", C.MAP_BATCH)


@R.add("""WITH RECURSIVE o AS (SELECT source, doc_id, coalesce(length(text), 0) AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT source, doc_id, chars, rn, 0 AS batch, 1 AS n, chars AS size FROM o WHERE rn = 1
  UNION ALL SELECT o.source, o.doc_id, o.chars, o.rn, f.batch + CASE WHEN f.n >= 20 OR f.size + o.chars > 30000 THEN 1 ELSE 0 END, CASE WHEN f.n >= 20 OR f.size + o.chars > 30000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 20 OR f.size + o.chars > 30000 THEN o.chars ELSE f.size + o.chars END
  FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1)
SELECT source, doc_id, chars::INT AS chars, batch::BIGINT AS batch FROM f""")
def batch_budget(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("chars"))
    return K.budget_batches(sized, "source", "doc_id", "chars", items=20, chars=30_000)


@R.add("SELECT lang, count(*) AS rows, sum(length(text))::BIGINT AS chars, round(sum(length(text)) * 0.13 / 1e6, 6)::DOUBLE AS usd FROM documents GROUP BY lang")
def embed_estimate(spark, sf_dir):
    return K.estimate(table(spark, sf_dir, "documents"), "text", 0.13, ["lang"])


_STOP = ["the", "of", "and"]
_NOT_STOP = "length(x) >= 2 AND x NOT IN (" + ", ".join(f"'{x}'" for x in _STOP) + ")"


@R.add(f"""SELECT conv_id, turn, list_filter(list_transform(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda x: regexp_replace(x, '^[^0-9A-Za-z_\u00aa-\uffff]+|[^0-9A-Za-z_\u00aa-\uffff]+$', '', 'g')), lambda x: {_NOT_STOP}),
lambda x: regexp_replace(x, '^(.{{2,}}?)(?:tion|ing|ed)$', '\\1')), lambda x: {_NOT_STOP}) AS tokens FROM conversations""")
def content_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.content_tokens(F.col("text"), _STOP, ["tion", "ing", "ed"]).alias("tokens"))


_ASKED = {"여야 입장은": "the", "논의 경과는": "ing", "국토부 장관의 그 생각": "ou"}


@R.add(f"""WITH q AS (SELECT conv_id, turn, text || {" || ".join(f"CASE WHEN contains(text, '{v}') THEN ' {k}' ELSE '' END" for k, v in _ASKED.items())} AS q FROM conversations)
SELECT conv_id, turn, list_filter([{", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{k}' END" for k, p in (("compare", X.K.COMPARE), ("timeline", X.K.TIMELINE), ("actor", X.K.ACTOR)))}], lambda x: x IS NOT NULL) AS types FROM q""")
def question_types(spark, sf_dir):
    """Kinds of questions: conversation turns that ask for sides, a course of events or a person's view, by what they hold."""
    q = F.concat("text", *[F.when(F.col("text").contains(v), F.lit(" " + k)).otherwise("") for k, v in _ASKED.items()])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.question_types(q).alias("types"))


#: Documents as pages of 60 characters under a running header, and a stretch of each as a chunk of some of its pages: as it
#: stands, changed, with the wrong pages, and without a speaker.
_PAGE, _FROM, _LONG = 60, 31, 200


def _capitals(text):
    """Upper case letter by letter, as SQL has it: what would become several letters (ß) becomes its one capital or stays."""
    few = "ßᾳῃῳ" + "".join(map(chr, (*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8))))
    one = "ẞᾼῌῼ" + "".join(map(chr, (*range(0x1F88, 0x1F90), *range(0x1F98, 0x1FA0), *range(0x1FA8, 0x1FB0))))
    letters = F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, few, one)))
    return F.array_join(letters, "")


@R.add(f"""WITH RECURSIVE pages AS (SELECT doc_id, n + 1 AS page, regexp_replace('[' || (n + 1) || '] ' || source || chr(10) || substr(text, n * {_PAGE} + 1, {_PAGE}), '\\s+', '', 'g') AS t FROM documents, generate_series(0, (length(text) - 1) // {_PAGE}) AS g(n)),
c AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 4 = 1 THEN upper(substr(text, {_FROM}, {_LONG})) ELSE substr(text, {_FROM}, {_LONG}) END, '\\s+', '', 'g') AS chunk, CASE WHEN doc_id % 7 > 0 THEN source ELSE '' END AS who, CASE WHEN doc_id % 4 = 2 THEN 100000 ELSE 0 END AS shift FROM documents),
near AS (SELECT c.doc_id, page, t FROM c JOIN pages p ON p.doc_id = c.doc_id AND page BETWEEN shift AND shift + {(_FROM + _LONG - 2) // _PAGE + 2}),
raw AS (SELECT doc_id, string_agg(t, '' ORDER BY page) AS raw FROM near GROUP BY doc_id),
probes AS (SELECT c.*, coalesce(raw, '') AS raw, list_distinct(list_filter(list_transform([0.0, 0.25, 0.5, 0.75, 1.0], lambda f: substr(chunk, least(floor(length(chunk) * f), greatest(length(chunk) - 20, 0))::BIGINT + 1, 20)), lambda p: length(p) >= 10)) AS probes FROM c LEFT JOIN raw ON raw.doc_id = c.doc_id),
h AS (SELECT *, len(list_filter(probes, lambda p: contains(raw, p)))::INT AS hits, len(probes)::INT AS n_probes FROM probes),
k AS (SELECT *, CASE WHEN n_probes >= 3 THEN hits >= n_probes - 1 ELSE hits >= n_probes END AS probes_ok FROM h),
r AS (SELECT doc_id, chunk AS rest, 0::BIGINT AS page, length(chunk) < 0 AS done FROM k WHERE NOT probes_ok
  UNION ALL SELECT doc_id, substr(rest, lo + 1), page, lo = length(rest) OR EXISTS (SELECT 1 FROM near n WHERE n.doc_id = x.doc_id AND n.page > x.page AND contains(n.t, substr(rest, lo + 1)))
  FROM (SELECT r.doc_id, r.rest, near.page, coalesce(list_max(list_filter(range(1, length(r.rest) + 1), lambda k: contains(near.t, left(r.rest, k)))), 0) AS lo FROM r JOIN near ON near.doc_id = r.doc_id AND near.page > r.page WHERE NOT r.done) x WHERE lo >= 10),
s AS (SELECT doc_id, bool_or(done) AS split_ok FROM r GROUP BY doc_id)
SELECT k.doc_id AS chunk_id, hits, n_probes, probes_ok OR coalesce(split_ok, false) AS text_ok, who <> '' AND contains(raw, who) AS speaker_ok, (probes_ok OR coalesce(split_ok, false)) AND who <> '' AND contains(raw, who) AS all_ok FROM k LEFT JOIN s ON s.doc_id = k.doc_id""")
def source_audit(spark, sf_dir):
    """Chunks held against the pages they come from: probes, and the search over page breaks for those that fail."""
    from talkweave.operators import gates

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "source", "text")
    n = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / _PAGE).cast("int"))).alias("n")
    pages = docs.where("text <> ''").select("source_id", "source", "text", n).select("source_id", (F.col("n") + 1).alias("page"), F.concat(F.lit("["), F.col("n") + 1, F.lit("] "), "source", F.lit("\n"), F.substring("text", F.col("n") * _PAGE + 1, F.lit(_PAGE))).alias("text"))
    part, shift = F.substring("text", _FROM, _LONG), F.when(F.col("source_id") % 4 == 2, 100_000).otherwise(0)
    chunks = docs.select(
        "source_id", F.col("source_id").alias("chunk_id"), (shift + 1).alias("page_start"), (shift + (_FROM + _LONG - 2) // _PAGE + 1).alias("page_end"),
        F.when(F.col("source_id") % 7 > 0, F.col("source")).alias("speaker"), F.when(F.col("source_id") % 4 == 1, _capitals(part)).otherwise(part).alias("text"),
    )
    return gates.source_audit(chunks, pages)


_CENSUS = {"marks": r"[*$%&#|]{1,}", "numbers": r"\d+", "shouts": r"!!", "links": r"https?://"}


@R.add("SELECT source, pattern, sum(n)::BIGINT AS n, count(*) FILTER (n > 0) AS n_docs FROM (" + " UNION ALL ".join(f"SELECT source, '{k}' AS pattern, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for k, p in _CENSUS.items()) + ") GROUP BY ALL")
def pattern_census(spark, sf_dir):
    counts = F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_count("text", F.lit(p)).alias("n")) for k, p in _CENSUS.items()])
    rows = table(spark, sf_dir, "documents").select("source", F.inline(counts))
    return rows.groupBy("source", "pattern").agg(F.sum("n").cast("long").alias("n"), F.count_if(F.col("n") > 0).alias("n_docs"))


_TAILS = {"always": "이외의 사항은 확인할 수 없습니다.", "unless": "위원의 소속 정당은 확인할 수 없습니다."}


@R.add(f"""WITH a AS (SELECT doc_id, regexp_replace(text, '[.]\\s*$', '') || '.' AS body FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN body WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN body || ' {_TAILS["unless"]}' ELSE body END WHEN 2 THEN '{_TAILS["always"]}'
  WHEN 3 THEN body || chr(10) || '{X.K.LIMITS_HEADING}' || chr(10) || '{_TAILS["always"]}' ELSE CASE WHEN doc_id % 2 = 0 THEN body || ' {_TAILS["unless"]}' ELSE body END END AS answer FROM a""")
def stripped_answers(spark, sf_dir):
    """Answers with one and many stock sentences at the end, with nothing else, and with a limits section."""
    from talkweave.operators.evidence import stripped

    body, k = F.concat(F.regexp_replace("text", r"[.]\s*$", ""), F.lit(".")), F.col("doc_id") % 5
    always, unless = _TAILS["always"], _TAILS["unless"]
    raw = (
        F.when(k == 0, F.concat(body, F.lit((" " + always) * 9))).when(k == 1, F.concat(body, F.lit(" " + unless))).when(k == 2, F.lit(always))
        .when(k == 3, F.concat(body, F.lit(f"\n{X.K.LIMITS_HEADING}\n{always}"))).otherwise(F.concat(body, F.lit(f" {unless} {always} \n {always}")))
    )
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", stripped(raw, F.col("doc_id") % 2 == 0).alias("answer"))


_NAMES = {"user": "person", "assistant": "machine"}


@R.add(f"""WITH q AS (SELECT conv_id, turn, role || ' said on 2024-0' || (turn % 9 + 1) || '-1' || (conv_id % 10) || ' and 9월 and 2025년 13월 5일: ' || text AS q, make_date(2024, (turn % 9 + 1)::INT, (10 + conv_id % 10)::INT) AS d,
  role || ' said on and and 2025년 13월 5일: ' || text AS rest FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(rest, '\\s+', ' ', 'g')) AS text, list_transform(list_distinct_in_order, lambda x: CASE x WHEN 'user' THEN 'person' ELSE 'machine' END) AS names, least(d, DATE '2024-09-01') AS date_from, greatest(d, DATE '2024-09-30') AS date_to
FROM (SELECT *, list_filter(names, lambda x, i: list_position(names, x) = i) AS list_distinct_in_order FROM (SELECT *, regexp_extract_all(rest, 'assistant|user') AS names FROM q))""")
def question_filters(spark, sf_dir):
    """Names and dates of questions made from whole turns: a day, a month that takes its year, and a day that doesn't exist."""
    from talkweave.functions.question import filters

    day = F.concat(F.lit(" 2024-0"), F.col("turn") % 9 + 1, F.lit("-1"), F.col("conv_id") % 10)
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.col("role"), F.lit(" said on"), day, F.lit(" and 9월 and 2025년 13월 5일: "), F.col("text")).alias("q"))
    return q.select("conv_id", "turn", filters(F.col("q"), _NAMES).alias("f")).select("conv_id", "turn", "f.*")
