"""Repair of the structure of conversations by target alignment.

A conversation's role initials should read (s?(ua)+)?. Turns may be kept (0), given another role (2), deleted (3; blank
and repeated ones must be) and empty turns inserted (2); a truncated turn that stays costs 1 more. For each feasible length
m there is one target: the last m symbols of uaua..., with s in front if m is odd. Turns are aligned to it by Wagner and
Fischer's table. Targets share their endings, so the table runs from the end and its column j, "j symbols left", serves
every target that has j symbols or more; each feasible length is read from its own column. The table is banded as Ukkonen
has it: a cell stands only while its cost, and the least cost that the turns before it take in any case, are within the
cost at hand. That cost begins at the least cost that ignores lengths and rises by one as long as no length is aligned
within it. All alignments of that cost are traced back, each to the ASCII-least audit of its length, and the least audit
of all lengths is taken: a string of K(eep), R(erole), D(elete) and I(nsert).

An alignment needs one letter a turn, not its text. So Spark sorts and judges the rows of a conversation by windows, which
spill; the letters of a conversation meet in one aggregate; the audits go back to the rows; and texts are hashed as they
stream by in order, row by row. A conversation is the unit of work, since its digest is that of its text in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import CRC_SQL, CRC_TABLE_SQL, WORD, read

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 30
#: Letters of aligned conversations that a worker remembers before it forgets all.
MEMO = 4_000_000


def least_before(turns: str) -> np.ndarray:
    """[i, e]: the least cost of the turns before i if the next symbol is u (e = 0) or a (e = 1), whatever the length."""
    out = np.empty((len(turns) + 1, 2), np.int64)
    u, a, gone = 0, INSERT, 0
    out[0] = u, a
    for i, t in enumerate(turns):
        extra, role = TRUNCATED * t.isupper(), t.lower()
        to_u = min(u + DELETE, a + extra + (0 if role == "a" else REROLE))
        to_a = min(a + DELETE, u + extra + (0 if role == "u" else REROLE))
        if role == "s":
            to_u = min(to_u, gone + extra)
        gone += DELETE
        u, a = min(to_u, to_a + INSERT), min(to_a, to_u + INSERT)
        out[i + 1] = u, a
    return out


def table(turns: str, before: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """[i] = (lo, costs): costs[j - lo] of aligning the turns from i on to the last j symbols, within the band of `most`
    (FAR outside); no costs where a row has no cell in the band."""
    none = (0, np.empty(0, np.int64))

    def kept(lo: int, costs: np.ndarray, i: int) -> tuple[int, np.ndarray]:
        costs = np.where(costs + before[i, (lo + np.arange(len(costs))) & 1] <= most, costs, FAR)
        inside = np.flatnonzero(costs < FAR)
        return (lo + int(inside[0]), costs[inside[0] : inside[-1] + 1]) if len(inside) else none

    n = len(turns)
    rows = [none] * (n + 1)
    rows[n] = kept(0, INSERT * np.arange(most // INSERT + 2), n)
    for i in range(n - 1, -1, -1):
        lo, below = rows[i + 1]
        if not len(below):
            break
        size = len(below) + 3  # one more for the turn itself, two for insertions: three in a row are never cheapest
        j = lo + np.arange(size)
        extra, role = TRUNCATED * turns[i].isupper(), turns[i].lower()
        costs = np.full(size, FAR, np.int64)
        costs[: len(below)] = below + DELETE
        match = np.where(j & 1 == (role == "a"), extra + REROLE * (role not in "ua"), extra + REROLE)
        costs[1 : len(below) + 1] = np.minimum(costs[1 : len(below) + 1], below + match[1 : len(below) + 1])
        costs = np.minimum.accumulate(costs - INSERT * j) + INSERT * j
        rows[i] = kept(lo, costs, i)
    return rows


def traced(turns: str, rows: list[tuple[int, np.ndarray]], i: int, j: int) -> str:
    """The ASCII-least cheapest edits that align the turns from i on to the last j symbols: D before I before K and R."""

    def cost(i: int, j: int) -> int:
        lo, costs = rows[i]
        return int(costs[j - lo]) if lo <= j < lo + len(costs) else FAR

    out, now = [], cost(i, j)
    while i < len(turns) or j:
        if i < len(turns) and cost(i + 1, j) + DELETE == now:
            out.append("D")
            i, now = i + 1, now - DELETE
        elif j and cost(i, j - 1) + INSERT == now:
            out.append("I")
            j, now = j - 1, now - INSERT
        else:
            keep = turns[i].lower() == "ua"[j & 1]
            out.append("K" if keep else "R")
            i, j = i + 1, j - 1
            now = cost(i, j)
    return "".join(out)


def aligned(codes: str) -> tuple[int, str]:
    """(cost, audit) of a conversation. codes: a letter a turn, "-" if it must be deleted, else s, u, a or o (another role),
    in capitals if truncated."""
    turns = codes.replace("-", "")
    before = least_before(turns)
    most = int(before[len(turns), 0])
    while True:
        rows = table(turns, before, most)
        # Lengths that are reached within the cost: even ones from the first turn; odd ones after an s, with no turn before it.
        within = lambda i, spent, least: [j for j, c in enumerate(rows[i][1].tolist(), rows[i][0]) if j % 2 == 0 and j >= least and spent + c <= most]
        found = [("", 0, j) for j in within(0, 0, 0)]
        for i in range(min(len(turns), most // DELETE + 1)):
            if turns[i] in "sS":
                found += [("D" * i + "K", i + 1, j) for j in within(i + 1, DELETE * i + TRUNCATED * (turns[i] == "S"), 2)]
        if found:
            break
        most += 1
    audits = []
    for head, i, j in found:
        edits = iter(head + traced(turns, rows, i, j))
        whole = []  # forced deletions go back to their places, where they are the least letter
        for c in codes:
            if c == "-":
                whole.append("D")
                continue
            while (e := next(edits)) == "I":
                whole.append(e)
            whole.append(e)
        audits.append("".join(whole) + "".join(edits))
    return most + DELETE * (len(codes) - len(turns)), min(audits)


class Aligned(dict):
    """codes -> aligned(codes), for the many conversations that look alike; bounded by the letters it holds."""

    held = 0

    def __missing__(self, codes: str) -> tuple[int, str]:
        if self.held > MEMO:
            self.clear()
            self.held = 0
        self.held += 2 * len(codes) + 50
        out = self[codes] = aligned(codes)
        return out


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live after the damage that crc32("conv_id:turn") % 20 tells; a dropped row stays as one
    that isn't live, so that its conversation isn't lost."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("kind") == 4, F.lit("user")).otherwise(name("role")).alias("role"), text.alias("text"),
        (F.col("kind") != 0).alias("live"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)))).alias("copy"),
    )
    return out.drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, live) with key, pos (1..., live rows first), fault, code and what the counts need.

    Rows of a conversation are ordered by turn (nulls first), then role and text, so ties have an order too.
    """
    rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    whole = Window.partitionBy("key").orderBy(F.desc("live"), F.asc_nulls_first("turn"), "role", "text")
    initial = F.left("role", F.lit(1))
    rows = rows.select(
        "*",
        F.row_number().over(whole).alias("pos"),
        F.concat(F.lag(initial).over(whole), initial).alias("step"),
        (F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(whole) == F.col("turn"), F.lit(False))).alias("new_turn"),
    )
    seen = F.row_number().over(Window.partitionBy("key", "role", "text").orderBy("pos")) > 1
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(WORD), F.lit("blank")).when(F.col("seen"), F.lit("duplicate")).when(~last.isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("-")).otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o")))
    return rows.withColumn("seen", seen).withColumn("fault", fault).withColumn("code", F.when(F.col("fault") == "truncated", F.upper(code)).otherwise(code))


@F.pandas_udf(T.StructType().add("cost", "long").add("audit", "string"))
def _aligned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    memo = Aligned()
    for part in parts:
        yield pd.DataFrame([memo[c] for c in part], columns=["cost", "audit"])


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (key, pos) to a digest for each conversation; holds one digest at a time."""
    digest, first, user = hashlib.sha256(), True, True
    for part in parts:
        keys, shas = [], []
        for key, last, role, text, edits in zip(*(part[c].to_pylist() for c in ("key", "last", "role", "text", "edits")), strict=True):
            for e in edits:
                if e == "D":
                    continue
                name = role if e == "K" else "user" if user else "assistant"
                line = f"{name}:" if e == "I" else f"{name}:{text}"
                digest.update((line if first else "\n" + line).encode())
                first, user = False, name[0] != "u"
            if last:
                keys.append(key)
                shas.append(digest.hexdigest())
                digest, first, user = hashlib.sha256(), True, True
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "sha": pa.array(shas, pa.string())})


def audited(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation: key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit;
    the live rows: key, conv_id, pos, role, text, fault, edits). key: conv_id as text, empty for null. edits: the letters of a
    row, insertions before it first; the last row has those at the end too.

    rows: conv_id, turn, role, text, live. Conversations without a live row: zeros and an empty audit. A null conv_id is a
    conversation like any other. A role that is empty or begins with none of s, u and a can't be kept. No rows: no rows.
    """
    marked = judged(rows)
    live, turn = F.col("live"), F.when(F.col("live"), F.col("turn"))
    count = lambda c: F.count_if(live & c)
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(live, F.struct("pos", "code")))), lambda x: x["code"]), "")
    talks = marked.groupBy("key").agg(
        F.max("conv_id").alias("conv_id"),
        (F.coalesce(F.max(turn) - F.min(turn) + 1, F.lit(0).cast("long")) - count(F.col("new_turn"))).alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count((F.col("pos") > 1) & ~F.col("step").isin("su", "ua", "au")).alias("illegal"),
        codes.alias("codes"),
    )
    talks = talks.withColumn("best", _aligned("codes")).select("key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")
    edits = talks.select("key", F.regexp_extract_all("audit", F.lit("I*[DKR](?:I+$)?"), 0).alias("all"))
    lines = marked.where("live").select("key", "conv_id", "pos", "role", "text", "fault").join(edits, "key")
    return talks, lines.select("key", "conv_id", "pos", "role", "text", "fault", F.get("all", F.col("pos") - 1).alias("edits"))


def repaired(rows: DataFrame) -> DataFrame:
    """The audit of each conversation, with repaired_sha256: of its repaired `role:text` lines."""
    talks, lines = audited(rows)
    # The window brings the rows of a conversation together in order, and tells the last.
    last = F.lead("pos").over(Window.partitionBy("key").orderBy("pos")).isNull()
    streams = lines.select("key", "pos", "role", "text", "edits", last.alias("last")).sortWithinPartitions("key", "pos")
    digests = streams.mapInArrow(_digests, "key string, sha string")
    none = hashlib.sha256().hexdigest()
    return talks.join(digests, "key", "left").withColumn("repaired_sha256", F.coalesce("sha", F.lit(none))).drop("key", "sha")


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(read(spark, sf_dir, "conversations")))


_STATES = ("N", "S", "U", "A")  # nothing yet; after s; next is u (may end); next is a
_INSERTED = {"N": "A", "S": "A", "U": "A", "A": "U"}


def _sql_steps() -> str:
    """The least (cost, audit) of the rows from one on, for each state that it may begin in: a fold from the last row."""
    out = []
    for state in _STATES:
        after = {"N": {"s": "S", "u": "A"}, "S": {"u": "A"}, "U": {"u": "A"}, "A": {"a": "U"}}[state]
        new = {"u": "A", "a": "U"}
        ways = [f"{{c: b.{state}.c + 3, a: 'D' || b.{state}.a}}"]
        for role, to in after.items():
            ways.append(f"CASE WHEN i = '{role}' AND NOT bad THEN {{c: b.{to}.c + t, a: 'K' || b.{to}.a}} END")
        for role in after:
            if role != "s":
                ways.append(f"CASE WHEN i <> '{role}' AND NOT bad THEN {{c: b.{new[role]}.c + 2 + t, a: 'R' || b.{new[role]}.a}} END")
        out.append(f"list_min([{', '.join(ways)}]) AS {state}0")
    return ", ".join(out)


def _sql_inserts(of: str) -> str:
    once = {s: _INSERTED[s] for s in _STATES}
    return ", ".join(f"{s}: list_min([{of}{s}0, {{c: {of}{once[s]}0.c + 2, a: 'I' || {of}{once[s]}0.a}}, {{c: {of}{once[once[s]]}0.c + 4, a: 'II' || {of}{once[once[s]]}0.a}}])" for s in _STATES)


ORACLE_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE_SQL} AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  ({CRC_SQL.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}) % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, generate_series(1, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM n),
f AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS step,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM m),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
  count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
  count_if(pos > 1 AND step NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS top FROM f GROUP BY conv_id),
r AS (SELECT conv_id, top + 1 AS pos, {{{_sql_inserts("e.")}}} AS b
    FROM s, (SELECT {{c: 0, a: ''}} AS N0, {{c: 1000000000, a: ''}} AS S0, {{c: 0, a: ''}} AS U0, {{c: 1000000000, a: ''}} AS A0) AS e
  UNION ALL
  SELECT conv_id, pos, {{{_sql_inserts("w.")}}} AS b FROM (SELECT conv_id, pos, {_sql_steps()} FROM (
    SELECT r.conv_id, f.pos, r.b, f.i, f.fault IN ('blank', 'duplicate') AS bad, CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END AS t
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos - 1)) AS w),
p AS (SELECT conv_id, b.N.c AS cost, b.N.a AS audit FROM r WHERE pos = 1),
e AS (SELECT conv_id, g, m, sum(CASE WHEN op = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY g) AS out,
    CASE WHEN op <> 'I' THEN sum(CASE WHEN op <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY g) END AS pos, op
  FROM (SELECT conv_id, audit AS m, g, audit[g] AS op FROM p, generate_series(1, len(audit)) AS x(g))),
l AS (SELECT e.conv_id, g, op, out - max(CASE WHEN op = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS o, f.role, f.text
  FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos),
h AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN o % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY g) AS lines
  FROM l WHERE op <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""
