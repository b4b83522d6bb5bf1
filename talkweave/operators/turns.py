"""Pages to segments to speaker turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions import fixed as K
from talkweave.functions import text as X


def normalized(pages: DataFrame, *, text: str = "text", page: str = "page", **patterns) -> DataFrame:
    """Adds segments, page_type, has_header, has_marker. Null texts are empty pages."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = X.restored(X.clean_lines(raw, **{k: v for k, v in patterns.items() if k == "noise"}), **{k: v for k, v in patterns.items() if k == "starts"})
    with_segments = pages.withColumn("segments", X.sections(lines, F.col(page), **{k: v for k, v in patterns.items() if k in ("speaker", "report", "agenda")}))
    marker = patterns.get("speaker", f"[{K.MARKERS}]").lstrip("^")
    return with_segments.withColumns(
        {
            "page_type": X.page_type(F.col("segments")),
            "has_header": raw.rlike("(?U)" + K.SESSION_HEADER),
            "has_marker": F.exists("segments", lambda s: (s["section_type"] == "body") & s["text"].rlike(marker)),
        }
    )


def _parsed(pages: DataFrame, source: str, page: str, marker: str, **forms) -> DataFrame:
    """source, page, seg, piece, is_turn, header, rest, raw, who: the pieces of each page's text in reading order.

    Only body blocks have turns. A piece is what stands from one marker to the next, or before the first. Of the blocks
    before a page's first body block (from the second page on, and no agenda, report or attendance list) what stands before
    their first marker is a piece as well: text that a page break has cut off from the turn before.
    """
    first = F.array_position(F.transform("segments", lambda s: s["section_type"]), "body")
    # The outer form, since for the other a filter on the array's size is put below, which builds the segments two times more.
    blocks = pages.select(source, page, first.alias("first"), F.posexplode_outer("segments").alias("seg", "s")).select(source, page, "first", "seg", F.col("s.section_type").alias("kind"), F.col("s.text").alias("body"))
    body = F.col("kind") == "body"
    before = (F.col(page) > 1) & (F.col("seg") + 1 < F.col("first")) & ~F.col("kind").isin("agenda", "report", "attendance")
    parts = F.when(body, F.split(X.strip(F.col("body")), f"(?={marker})")).otherwise(F.slice(F.split("body", marker, 2), 1, 1))
    pieces = blocks.where(body | before).select(source, page, "seg", body.alias("body"), F.posexplode(parts).alias("piece", "raw"))
    lines = F.split(F.regexp_replace("raw", f"^{marker}", ""), "\n", 2)
    is_turn = F.col("body") & F.col("raw").rlike(f"^{marker}")
    cut = pieces.select(source, page, "seg", "piece", is_turn.alias("is_turn"), X.strip(F.get(lines, F.lit(0))).alias("header"), X.strip(F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).alias("rest"), X.strip(F.col("raw")).alias("raw"))
    # The speaker comes out of a generator: a filter on it can't be moved below, where it would parse the header again.
    known = F.array(F.when(F.col("is_turn"), X.split_header(F.col("header"), **forms)))
    return cut.where("raw <> ''").select("*", F.explode(known).alias("who"))


def turns(pages: DataFrame, *, source: str = "source_id", page: str = "page", marker: str = f"[{K.MARKERS}]", dropped: str = K.DROPPED_HEADERS, not_speakers=tuple(K.DROPPED_NAMES), **forms) -> DataFrame:
    """Speaker turns from normalised pages: source, turn_no, turn_id, speaker, role, text, page_start, page_end.

    Text before a block's first marker goes on with the last turn kept, over blocks and pages, after a blank. A header that is
    no speech goes with its own text. Turn numbers are a running sum in reading order and have no holes. A source is one
    group of the window, as its turns are one sequence.
    """
    parsed = _parsed(pages, source, page, marker, **forms)
    name = F.col("who.name")
    speech = name.isNotNull() & ~F.col("header").rlike("(?U)" + dropped) & ~F.coalesce(name.isin(*not_speakers), F.lit(False))
    order = Window.partitionBy(source).orderBy(page, "seg", "piece")
    numbered = parsed.where(~F.col("is_turn") | speech).withColumn("turn_no", F.sum(F.col("is_turn").cast("int")).over(order)).where("turn_no > 0")
    said = F.when(F.col("is_turn"), F.when(F.col("who.rest") == "", F.col("rest")).otherwise(X.strip(F.concat_ws(" ", "who.rest", "rest")))).otherwise(F.col("raw"))
    full = numbered.withColumn("said", said).withColumn("at", F.struct(page, "seg", "piece"))
    return full.groupBy(source, "turn_no").agg(
        F.format_string("%s_turn_%04d", F.first(F.col(source).cast("string")), F.first("turn_no")).alias("turn_id"),
        F.max("who.name").alias("speaker"),
        F.max("who.role").alias("role"),
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), lambda t: t != ""), " ").alias("text"),
        F.min(page).alias("page_start"),
        F.max(page).alias("page_end"),
    )


def dropped_headers(pages: DataFrame, *, source: str = "source_id", page: str = "page", marker: str = f"[{K.MARKERS}]", dropped: str = K.DROPPED_HEADERS, **forms) -> DataFrame:
    """How often each header (60 characters) stands at a marker of a body block without naming anyone; most frequent first.
    Headers that are known to be no speech don't count."""
    lost = _parsed(pages, source, page, marker, **forms).where(F.col("is_turn") & F.col("who.name").isNull() & ~F.col("header").rlike("(?U)" + dropped))
    return lost.groupBy(F.left("header", F.lit(60)).alias("header")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "header")


def enriched(turns_: DataFrame, text: str = "text", committee: str | None = None, domains: DataFrame | None = None, entities: str | None = None) -> DataFrame:
    """Adds policy_domain (if a dimension is given), bill_refs, utterance_type, stance_signal, mentions."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = turns_.withColumns({"bill_refs": X.found_in_order(body, K.BILLS), "utterance_type": X.utterance_type(body), "stance_signal": X.stance_signal(body)})
    if entities:
        out = out.withColumn("mentions", F.array_distinct(F.regexp_extract_all(body, F.lit(entities), F.lit(0))))
    if domains is not None and committee:
        out = out.join(domains.select(committee, "policy_domain"), committee, "left").withColumn("policy_domain", F.coalesce("policy_domain", F.lit("other")))
    return out
