"""Text as columns: cleaning, line repair, sections, speakers, terms. Java's classes are ASCII, hence (?U)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave.functions import fixed as K


#: All characters that count as blanks, of any script.
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Blanks of any script taken off both ends: a look at the ends, where a pattern would look at every blank within."""
    return F.btrim(text, F.lit(BLANKS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def squashed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(v) with v evaluated once: a lambda's variable isn't computed anew wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_noise(line: Column) -> Column:
    """Running headers, titles, page numbers and dividers; blank lines are not noise."""
    patterns = "(?U)" + "|".join(f"(?:{p})" for p in K.NOISE.values())
    return once(strip(line), lambda s: (s != "") & (s.rlike(patterns) | ((F.length(s) < 12) & s.rlike("(?U)" + K.PAGE_MARK))))


def clean_lines(text: Column, noise: Callable[[Column], Column] = is_noise) -> Column:
    """The lines that aren't noise, with runs of blanks made one."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: ~noise(x)), lambda x: F.regexp_replace(x, r"[ \t]{2,}", " "))


def glued(last: Column, token: Column, nxt: Column) -> Column:
    """Whether two lines that a page break or margin has parted are one word: a Hangul word that goes on. last: the last
    character before, token: the last token before."""
    hangul = F.right(last, F.lit(1)).rlike("[가-힣]") & F.left(nxt, F.lit(1)).rlike("[가-힣]")
    return hangul & ~F.right(last, F.lit(1)).rlike(f"[{K.SENTENCE_LAST}{K.PARTICLE_LAST}]") & (nxt.rlike(K.FORCED_JOIN) | (F.length(token) <= 3))


def joined(prev: Column, nxt: Column) -> Column:
    """The two lines glued, or else with a blank; an empty one adds nothing."""
    glue = glued(prev, F.element_at(F.split(strip(prev), r"(?U)\s+"), -1), nxt)
    return F.when((prev == "") | (nxt == "") | glue, F.concat(prev, nxt)).otherwise(F.concat(prev, F.lit(" "), nxt))


def restored(lines: Column, starts: str = f"^[{K.MARKERS}{K.HEADINGS}]|{K.REPORT_START}|{K.AGENDA_START}") -> Column:
    """Lines put together again. A line goes on with the one before only if both touching characters are Hangul and it
    doesn't begin with a marker or heading; every other line stays as it is, blanks and all.

    The fold keeps how each line is joined, and of what it is joined to only the last token and how that ends; the text is
    put together once, after it.
    """
    hangul = lambda c: (c >= "가") & (c <= "힣")  # noqa: E731  strings compare by code point

    def facts(x: Column) -> Column:
        ends = lambda r: F.struct(x.alias("x"), r.alias("r"), hangul(F.left(r, F.lit(1))).alias("opens"), F.right(r, F.lit(1)).alias("last"))
        # Patterns are tried only where they can matter: on lines that a line might be joined to, or that might be joined.
        more = lambda e: F.struct(
            e["x"], e["r"], e["opens"], hangul(e["last"]).alias("ends"),
            (hangul(e["last"]) & F.contains(F.lit(K.SENTENCE_LAST + K.PARTICLE_LAST), e["last"])).alias("closed"),
            (e["opens"] & e["r"].rlike("(?U)" + starts)).alias("starts"),
            (e["opens"] & e["r"].rlike(K.FORCED_JOIN)).alias("forced"),
            F.when(hangul(e["last"]), F.element_at(F.split(e["r"], r"(?U)\s+"), -1)).otherwise("").alias("token"),
        )
        return once(once(strip(x), ends), more)

    def step(s: Column, f: Column) -> Column:
        how = F.when(~s["ends"] | ~f["opens"] | f["starts"], "\n").when(~s["closed"] & (f["forced"] | (F.length(s["token"]) <= 3)), "").otherwise(" ")
        token = lambda h: F.when((h == "") & (f["token"] == f["r"]), F.concat(s["token"], f["r"])).otherwise(f["token"])
        return once(how, lambda h: F.struct(F.concat(s["how"], F.array(h)).alias("how"), f["ends"].alias("ends"), f["closed"].alias("closed"), token(h).alias("token")))

    def together(known: Column, how: Column) -> Column:
        def piece(f: Column, i: Column) -> Column:
            begins, stays = F.get(how, i) == "\n", F.coalesce(F.get(how, i + 1), F.lit("\n")) == "\n"
            own = F.when(begins & stays, f["x"]).when(begins, rstrip(f["x"])).when(stays, lstrip(f["x"])).otherwise(f["r"])
            return F.concat(F.get(how, i), own)

        # Lines hold no line feed, so it parts the restored ones; the first of them has one before it.
        return F.split(F.substring(F.array_join(F.transform(known, piece), ""), 2, 2_000_000_000), "\n", -1)

    start = F.struct(F.array().cast("array<string>").alias("how"), F.lit(False).alias("ends"), F.lit(False).alias("closed"), F.lit("").alias("token"))
    whole = lambda known: once(F.aggregate(known, start, step, lambda s: s["how"]), lambda how: together(known, how))
    return once(F.transform(lines, facts), lambda known: F.when(F.size(known) == 0, F.array().cast("array<string>")).otherwise(whole(known)))


def sections(lines: Column, page: Column, speaker: str = f"^[{K.MARKERS}]", report: str = K.REPORT_START, agenda: str = K.AGENDA_START) -> Column:
    """array<struct<section_type, text>>: cover (first two pages) or body, until a report, agenda or speaker line says
    otherwise. Each report heading begins a block, and a report stays one; an agenda heading counts only before the body.
    The fold keeps a kind for each line, and whether a block begins there."""

    def step(s: Column, x: Column) -> Column:
        now = s["kind"]

        def moved(line: Column) -> Column:
            new_report = line.rlike("(?U)" + report)
            kind = (
                F.when(new_report | (now == "report"), "report").when((now == "body") | line.rlike(speaker), "body")
                .when(line.rlike("(?U)" + agenda), "agenda").otherwise(now)
            )
            return once(kind, lambda k: F.struct(k.alias("kind"), F.concat(s["lines"], F.array(F.struct(k.alias("kind"), (new_report | (k != now)).alias("begins")))).alias("lines")))

        return once(strip(x), moved)

    start = F.struct(F.when(page <= 2, "cover").otherwise("body").alias("kind"), F.array().cast("array<struct<kind:string,begins:boolean>>").alias("lines"))

    def blocks(ls: Column, kinds: Column) -> Column:
        begin = F.filter(F.transform(kinds, lambda k, i: F.when((i == 0) | k["begins"], i + 1)), lambda i: i.isNotNull())
        text = lambda b, i, j: strip(F.array_join(F.slice(ls, i, F.coalesce(F.get(b, j + 1), F.size(kinds) + 1) - i), "\n"))
        return once(begin, lambda b: F.transform(b, lambda i, j: F.struct(F.element_at(kinds, i)["kind"].alias("section_type"), text(b, i, j).alias("text"))))

    whole = once(lines, lambda ls: once(F.aggregate(ls, start, step, lambda s: s["lines"]), lambda kinds: blocks(ls, kinds)))
    return F.filter(whole, lambda b: b["text"] != "")


def page_type(segments: Column) -> Column:
    kinds = F.array_distinct(F.transform(segments, lambda s: s["section_type"]))
    return F.when(F.size(kinds) == 0, "unknown").when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("mixed")


def speaker(header: Column, forms: Sequence[tuple[str, int, int]] = K.SPEAKER_FORMS, not_names: Sequence[str] = K.NOT_NAMES) -> Column:
    """struct<name, role> of a stripped header, or null. The first form that matches decides, even if its name is a pronoun (then null)."""
    h = header
    out = F.lit(None).cast("struct<name:string,role:string>")
    for i, (pattern, name, role) in reversed(list(enumerate(forms))):
        person = F.regexp_extract(h, pattern, name)
        held = F.struct(person.alias("name"), (F.regexp_extract(h, pattern, role) if role else F.lit(None).cast("string")).alias("role"))
        # The two titles that can only stand before a name need no look at pronouns.
        out = F.when(h.rlike(pattern), held if i < 2 else F.when(~person.isin(*not_names), held)).otherwise(out)
    return out


def split_header(line: Column, **forms) -> Column:
    """struct<name, role, rest>: a speaker in the first two tokens, else the first, else the whole line (no rest)."""
    tokens = F.split(line, " ", 3)
    option = lambda head, rest: F.struct(strip(head).alias("head"), rest.alias("rest"))
    whole = option(line, F.lit(""))
    two, one = option(F.concat_ws(" ", F.slice(tokens, 1, 2)), F.concat_ws(" ", F.slice(tokens, 3, 3))), option(F.get(tokens, F.lit(0)), F.concat_ws(" ", F.slice(tokens, 2, 3)))
    # One lambda holds the forms, so that they stand in the plan once and not for each option.
    read = F.transform(F.when(F.size(tokens) >= 2, F.array(two, one, whole)).otherwise(F.array(whole)), lambda o: F.struct(speaker(o["head"], **forms).alias("s"), o["rest"].alias("rest")))
    first = F.get(F.filter(read, lambda r: r["s"].isNotNull()), F.lit(0))
    return once(first, lambda r: F.struct(r["s"]["name"].alias("name"), r["s"]["role"].alias("role"), r["rest"].alias("rest")))


def iso_date(raw: Column) -> Column:
    s = strip(raw.cast("string"))
    return F.when(s.rlike(r"^\d{8}$"), F.concat_ws("-", s.substr(1, 4), s.substr(5, 2), s.substr(7, 2))).otherwise(s)


def found_in_order(text: Column, patterns: Sequence[str]) -> Column:
    """All matches, pattern by pattern, trimmed, once each."""
    hits = F.concat(*[F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0)) for p in patterns])
    return F.array_distinct(F.filter(F.transform(hits, strip), lambda x: x != ""))


def utterance_type(text: Column, motion: Sequence[str] = K.MOTION, question: str = K.QUESTION) -> Column:
    tokens = F.split(text, r"(?U)\s+")
    return F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, motion))), "motion").when(text.rlike("(?U)" + question), "question").otherwise("statement")


def stance_signal(text: Column, positive: Sequence[str] = K.POSITIVE, negative: Sequence[str] = K.NEGATIVE) -> Column:
    tokens = F.split(text, r"(?U)\s+")
    yes, no = F.arrays_overlap(tokens, F.array(*map(F.lit, positive))), F.arrays_overlap(tokens, F.array(*map(F.lit, negative)))
    return F.when(yes & no, "mixed").when(yes, "positive").when(no, "negative").otherwise("neutral")


def without_suffix(token: Column, suffixes: Sequence[str] = K.PARTICLES, stem: int = 2) -> Column:
    """One suffix off, the longest that leaves a stem of two characters."""
    return F.regexp_replace(token, f"^(.{{{stem},}}?)(?:{'|'.join(sorted(suffixes, key=lambda s: (-len(s), s)))})$", "$1")


def content_tokens(text: Column, stopwords: Sequence[str], suffixes: Sequence[str] = K.PARTICLES, edge: str = r"[^\w]") -> Column:
    """Words without the marks around them (`edge`) and without suffix, two characters or more, no stop words before or after."""
    words = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.regexp_replace(w, f"(?U)^{edge}+|{edge}+$", ""))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords))
    return F.filter(F.transform(kept, lambda w: without_suffix(w, suffixes)), lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords))


#: The edge of a question's words, for content_tokens.
QUESTION_EDGE = "[" + "".join("\\" + c if c in "[].?" else c for c in K.EDGE_MARKS) + "]"


def question_types(text: Column, forms: dict[str, str] | None = None) -> Column:
    """The kinds of a question, in order: those of `forms` (kind -> pattern) that it matches."""
    forms = forms or {"compare": K.COMPARE, "timeline": K.TIMELINE, "actor": K.ACTOR}
    return F.array_compact(F.array(*[F.when(text.rlike("(?U)" + p), F.lit(k)) for k, p in forms.items()]))


def dates_in(text: Column) -> Column:
    """The full dates written as YYYY-MM-DD that exist, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)), lambda d: F.try_to_date(d, "yyyy-MM-dd")), lambda d: d.isNotNull())


def speaker_group(role: Column) -> Column:
    """assembly, staff, witness, government or unknown; nominees are tested before offices, whose endings they share."""
    return (
        F.when(role.isNull(), "unknown").when(role.isin(*K.ASSEMBLY_ROLES), "assembly").when(role.isin(*K.STAFF_ROLES), "staff").when(role.isin(*K.WITNESS_ROLES), "witness")
        .when(role.rlike(K.NOMINEE), "unknown").when(role.rlike(K.EXECUTIVE), "government").otherwise("unknown")
    )
