"""Evidence: restored turns, windows around a hit, neighbours, citations, grounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave import config as C
from talkweave.functions import fixed as K
from talkweave.functions.text import once

#: What `\s` stands for in patterns with (?U).
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def restored(df: DataFrame, keys: Sequence[str], order: str, text: str, chars: int) -> DataFrame:
    """A turn's fragments in order, joined by a blank, cut to `chars`. Null fragments are left out."""
    return df.groupBy(*keys).agg(F.left(F.expr(f"listagg({text}, ' ') WITHIN GROUP (ORDER BY {order})"), F.lit(chars)).alias("text"), F.count("*").alias("n_fragments"))


def neighbours(turns: DataFrame, hits: DataFrame, group: str, ordinal: str, reach: int = 1) -> DataFrame:
    """The turns next to the hits that aren't hits themselves; keys are integers, so ids of any width stay in order."""
    steps = F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d])
    near = hits.select(group, F.explode(F.transform(steps, lambda d: F.col(ordinal) + d)).alias(ordinal)).where(F.col(ordinal) >= 0).distinct()
    return turns.join(near, [group, ordinal], "left_semi").join(hits.select(group, ordinal), [group, ordinal], "left_anti")


def expanded(turns: DataFrame, hits: DataFrame, group: str, ordinal: str) -> DataFrame:
    """Hits and their neighbours, once each."""
    near = hits.select(group, F.explode(F.array(F.col(ordinal) - 1, F.col(ordinal), F.col(ordinal) + 1)).alias(ordinal)).distinct()
    return turns.join(near, [group, ordinal], "left_semi")


def assembled(parts: list[str], hit: int, limit: int) -> str:
    """The whole turn if it fits; else the hit and what fits beside it: round by round the fragment before, then the one
    after, as long as either does. What room is left goes to the end of the next one before (half, if there is one after) and
    to the beginning of the next one after, with a mark where they are cut.

    The hit itself is never cut.
    """
    whole = " ".join(parts)
    if len(whole) <= limit:
        return whole
    ends, size, grown = {-1: hit, 1: hit}, len(parts[hit]), True
    beyond = lambda side: parts[ends[side] + side] if 0 <= ends[side] + side < len(parts) else None
    while grown:
        grown = False
        for side in (-1, 1):
            if (part := beyond(side)) is not None and size + 1 + len(part) <= limit:
                ends[side] += side
                size, grown = size + 1 + len(part), True
    text, room = " ".join(parts[ends[-1] : ends[1] + 1]), limit - size
    before, after = beyond(-1), beyond(1)
    if before is not None and room > 4:
        take = room // 2 - 2 if after is not None else room - 2
        text, room = f"…{before[max(len(before) - take, 0):]} {text}", room - take - 2
    if after is not None and room > 4:
        text = f"{text} {after[: room - 2]}…"
    return text


def windows(df: DataFrame, key: str, order: str, text: str, hit: str, limit: int = C.EVIDENCE_CHARS) -> DataFrame:
    """key, evidence: for each key its fragments around the first hit, or around the first fragment where none is a hit.

    A group is one turn's fragments, so it is as large as a turn is.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        hits = [i for i, h in enumerate(pdf[hit]) if h] or [0]
        parts = ["" if x is None else x for x in pdf[text]]
        return pd.DataFrame({key: pdf[key].iloc[:1], "evidence": [assembled(parts, hits[0], limit)]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, order, text, hit).groupBy(key).applyInPandas(one, f"{key} {kind}, evidence string")


def citations(answer: Column, n_sources: Column) -> list[Column]:
    """cited and invalid: the distinct numbers in [n], in order, inside and outside 1 to n_sources."""
    numbers = F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))))
    return [F.filter(numbers, lambda x: x.between(1, n_sources)).alias("cited"), F.filter(numbers, lambda x: ~x.between(1, n_sources)).alias("invalid")]


def pre_gate(hits: DataFrame, query: str, queries: DataFrame | None = None) -> DataFrame:
    """query, n_hits, best_score, gate. No keyword hit, and vector scores that are all below the threshold: REFUSED; hits
    without either pass. No hit at all: NONE, for which `queries` must say what was asked."""
    g = hits.groupBy(query).agg(F.count("*").alias("n_hits"), F.bool_or(F.col("kw_rank").isNotNull()).alias("kw"), F.max("vec_score").alias("best_score"))
    if queries is not None:
        g = queries.select(query).distinct().join(g, query, "left")
    gate = F.when(F.col("n_hits").isNull(), "NONE").when(~F.col("kw") & F.coalesce(F.col("best_score") < C.SIMILARITY_GATE, F.lit(False)), "REFUSED").otherwise("PASS")
    return g.select(query, F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "best_score", gate.alias("gate"))


def judged(answer: Column, n_cited: Column, n_invalid: Column, *, strict: str = K.REFUSAL_STRICT, broad: str = K.REFUSAL_BROAD, limits: str = K.LIMITS_SECTION) -> list[Column]:
    """grounding and ungrounded: cited answers are FULL unless they refuse (their limits section aside), uncited ones
    REFUSED if they refuse in any wording, else PARTIAL and ungrounded; invalid citations lower FULL to PARTIAL."""
    text = F.coalesce(answer, F.lit(""))
    cited = n_cited > 0
    level = F.when(cited, F.when(F.regexp_replace(text, limits, "").rlike(strict), "PARTIAL").otherwise("FULL")).otherwise(F.when(text.rlike(broad), "REFUSED").otherwise("PARTIAL"))
    return [F.when((n_invalid > 0) & (level == "FULL"), "PARTIAL").otherwise(level).alias("grounding"), (~cited & (level == "PARTIAL")).alias("ungrounded")]


def stripped(answer: Column, question_about: Column, always: str = K.DANGLING_TAIL, unless: str = K.PARTY_DISCLAIMER, limits: str = K.LIMITS_HEADING) -> Column:
    """Stock sentences at an answer's end taken off, however many, `unless` only where the question isn't about them.

    Never to nothing, and not at all where the answer has a limits section, whose sentences are asked for.

    The sentences begin at a blank's first place, and one that takes all before it in its line at the line's or sentence's
    beginning: from any other place a match would begin further left, so none is tried there, which keeps long lines linear.
    """
    rest = r"[^.\n]*"
    first = lambda p: rf"(?<![^.\n]){p}" if p.startswith(rest) else p
    tail = lambda text, *ps: F.regexp_replace(F.rtrim(text, F.lit(SPACES)), rf"(?U)(?<!\s)\s*(?:{'|'.join(map(first, ps))})\s*(?:(?:{'|'.join(ps)})\s*)*$", "")

    def of(whole: Column) -> Column:
        text = F.when(question_about, tail(whole, always)).otherwise(tail(whole, always, unless))
        return F.when(whole.contains(limits), whole).otherwise(once(text, lambda t: F.when(t == "", whole).otherwise(t)))

    return once(answer, of)


def display_name(name: Column, aliases: Mapping[str, str]) -> Column:
    """A name that isn't all Hangul with its Hangul alias in parentheses, where it has one."""
    known = F.try_element_at(F.create_map(*[x for k, v in sorted(aliases.items()) for x in (F.lit(k), F.lit(v))]), name) if aliases else F.lit(None).cast("string")
    return F.when(name.rlike("^[가-힣]+$") | known.isNull(), name).otherwise(F.concat(name, F.lit("("), known, F.lit(")")))


def summaries(sources: DataFrame, text: str = "text", fields: Sequence[str] = ("n", "chunk_id", "speaker", "role", "party", "committee", "date", "page_start")) -> DataFrame:
    """The fields of a source that an answer shows, and the first characters of its text."""
    return sources.select(*[c for c in fields if c in sources.columns], F.left(text, F.lit(C.SNIPPET)).alias("snippet"))


def cited_only(sources: DataFrame, answers: DataFrame, key: str, number: str = "n") -> DataFrame:
    """The sources whose number is cited by the answer (key, cited: array of numbers) of their key."""
    return sources.join(answers.select(key, F.explode("cited").alias(number)), [key, number], "left_semi")


def rendered(n: Column, speaker: Column, role: Column, party: Column, committee: Column, date: Column, page: Column, text: Column, previous: Column, following: Column) -> Column:
    """A numbered source as it is shown: who, where and when, the text, and what was said before and after, where it is known."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    extra = lambda c, form: F.when(known(c) != "", F.format_string(form, c)).otherwise("")
    head = F.concat(F.lit("["), known(n), F.lit("]\nspeaker: "), known(speaker), extra(role, " %s"), extra(party, " [%s]"), F.lit("\ncommittee: "), known(committee), F.lit("\ndate: "), known(date), F.lit("\npage: "), known(page), F.lit("\ncontent:\n"), known(text))
    around = F.concat(F.lit("\n\n["), known(n), F.lit(f" {K.AROUND}]"), extra(previous, "\nprevious: %s"), extra(following, "\nnext: %s"))
    return F.concat(head, F.when((known(previous) != "") | (known(following) != ""), around).otherwise(""))


def source_blocks(df: DataFrame, group: str, rank: str, line: Column, by: Sequence[str] = ()) -> DataFrame:
    """A block of numbered sources for each group of a question (`by`) under its heading, groups in order of first appearance."""
    g = df.select(*by, group, rank, line.alias("line")).groupBy(*by, group).agg(F.min(rank).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "line"))), lambda x: x["line"]), "\n\n").alias("lines"))
    block = F.concat(F.format_string(K.GROUP_HEADING, F.coalesce(F.col(group).cast("string"), F.lit(""))), F.lit("\n\n"), F.col("lines"))
    return g.select(*by, group, block.alias("block"), F.row_number().over(Window.partitionBy(*by).orderBy("first")).alias("place"))


def cost(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """US dollars at prices per million tokens, six decimals."""
    return F.round((input_tokens * input_price + output_tokens * output_price) / 1e6, 6)
