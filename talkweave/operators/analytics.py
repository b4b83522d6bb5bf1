"""Profiles, timelines, spikes, stances, composition, candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave import config as C
from talkweave.functions import fixed as K
from talkweave.functions.question import nfkc
from talkweave.functions.text import speaker_group
from talkweave.operators.terms import held


def totals(df: DataFrame, who: str, unit: str, meeting: str, date: str) -> DataFrame:
    """Distinct units and meetings, first and last date, per actor."""
    return df.groupBy(who).agg(F.count_distinct(unit).alias("n_units"), F.count_distinct(meeting).alias("n_meetings"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def ratio(df: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
    """n and share (half-even, three decimals) of each kind within its group."""
    counts = df.groupBy(*by, kind).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 3))


def top_mentions(df: DataFrame, terms: Column, aliases: dict[str, str], limit: int = 10) -> DataFrame:
    """term, n: in how many rows (units) of df a term is mentioned, aliases folded into their canonical name; most frequent
    first. Folding and distinctness are a row's own affair, so the count combines before the shuffle."""
    fold = lambda t: t
    if aliases:
        canon = F.create_map(*[x for k, v in sorted(aliases.items()) for x in (F.lit(k), F.lit(v))])
        fold = lambda t: F.when(t.isin(*sorted(aliases)), F.try_element_at(canon, t)).otherwise(t)
    t = df.select(F.explode(F.array_distinct(F.transform(terms, fold))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(limit)


def canonical(groups: Sequence[Sequence[str]]) -> dict[str, str]:
    """term -> the longest of its merged group (least in code points of equal lengths)."""
    merged: list[set[str]] = []
    for g in map(set, groups):
        for other in [m for m in merged if m & g]:
            merged.remove(other)
            g |= other
        merged.append(g)
    return {t: min(g, key=lambda x: (-len(x), x)) for g in merged for t in g}


def gap_filled(months: DataFrame, *, month: str = "month", columns: Sequence[str] = ("n",), by: Sequence[str] = ()) -> DataFrame:
    """Every month from the first to the last (of each group), zeros where none is. Null months are left out."""
    first = F.to_date(F.concat(F.col(month), F.lit("-01")))
    spine = months.where(F.col(month).isNotNull()).groupBy(*by).agg(F.min(first).alias("a"), F.max(first).alias("b"))
    spine = spine.where("a IS NOT NULL").select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("d")).select(*by, F.date_format("d", "yyyy-MM").alias(month))
    return spine.join(months, [*by, month], "left").select(*by, month, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def issue_timeline(chunks: DataFrame, mapping: DataFrame, keywords: dict, *, chunk: str = "chunk_id", turn: str = "turn_id", date: str = "date", text: str = "text", issue: str = "issue", core: str = "core") -> DataFrame:
    """issue, month, corpus_turns, mapped_turns, mapped_core_turns for each month from the first to the last that either axis
    has: the turns that hold a keyword of the issue (ignoring case; an issue without keywords has none), and the turns that are
    mapped to it. Chunks without a date count nowhere.

    keywords: issue -> its terms, a dictionary; all of them are looked for in one pass over a text.
    """
    kind = mapping.schema[issue].dataType
    owners = [(i, k.lower()) for i, ks in keywords.items() for k in ks if k]
    dated = chunks.where(F.col(date).isNotNull()).withColumn("month", F.date_format(date, "yyyy-MM"))
    found = dated.select("month", turn, F.explode(held(F.lower(F.coalesce(text, F.lit(""))), [k for _, k in owners])).alias("term"))
    spark = chunks.sparkSession
    terms = spark.createDataFrame(owners, f"{issue} {kind.simpleString()}, term string")
    corpus = found.join(F.broadcast(terms), "term").groupBy(issue, "month").agg(F.count_distinct(turn).alias("corpus_turns"))  # a row a keyword
    mapped = mapping.join(dated.select(chunk, turn, "month"), chunk).groupBy(issue, "month").agg(F.count_distinct(turn).alias("mapped_turns"), F.count_distinct(F.when(F.col(core), F.col(turn))).alias("mapped_core_turns"))
    return gap_filled(corpus.join(mapped, [issue, "month"], "full"), columns=["corpus_turns", "mapped_turns", "mapped_core_turns"], by=[issue])


def spikes(counts: DataFrame, by: Sequence[str], period: str, n: str, at_least: float = C.SPIKE_RATIO, periods: int = C.MIN_MONTHS) -> DataFrame:
    """by, period, n, median_others, ratio: periods of `at_least` times the median of the group's other periods.

    Leave-one-out medians come from the sorted list of a group's periods by place, without a self join: taking out the
    k-th of m values leaves the middle at fixed places.
    """
    groups = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(n).cast("double").alias("n"), F.col(period).alias("p")))).alias("xs")).where(F.size("xs") >= periods)
    each = groups.select(*by, "xs", F.posexplode("xs").alias("k", "x"))
    rest = lambda i: F.get("xs", F.when(i < F.col("k"), i).otherwise(i + 1))["n"]
    m = F.size("xs") - 1
    median = (rest(F.floor((m - 1) / 2).cast("int")) + rest(F.floor(m / 2).cast("int"))) / 2
    out = each.select(*by, F.col("x.p").alias(period), F.col("x.n").alias(n), median.alias("median_others"))
    return out.where(F.col("median_others") > 0).withColumn("ratio", F.bround(F.col(n) / F.col("median_others"), 2)).where(F.col(n) / F.col("median_others") >= at_least)


def stance_counts(stance: Column, kinds: Sequence[str] = K.STANCES) -> list[Column]:
    return [F.count_if(stance == k).alias(k) for k in kinds]


def stance_label(support: Column, oppose: Column, concern: Column) -> Column:
    """no_stance, mixed (support and oppose both a third of the three or more), else the largest; ties in that order."""
    total = support + oppose + concern
    return (
        F.when(total == 0, "no_stance").when((support > 0) & (oppose > 0) & (3 * support >= total) & (3 * oppose >= total), "mixed")
        .when((support >= oppose) & (support >= concern), "support").when(oppose >= concern, "oppose").otherwise("concern")
    )


def modal(df: DataFrame, who: str, group: str, priority: Sequence[str]) -> DataFrame:
    """who, group: its most frequent group; ties by priority. Counted first, so a hot actor is a few rows."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(group)).cast("int"), F.lit(99))
    counts = df.groupBy(who, group).agg(F.count("*").alias("n"))
    return counts.groupBy(who).agg(F.max_by(F.col(group), F.struct(F.col("n"), -F.when(rank == 0, 99).otherwise(rank))).alias(group))


def in_period(df: DataFrame, date: str, periods: Sequence[tuple[str, str, str]], name: str) -> DataFrame:
    """The name of the closed date interval each row's date is in, null if in none: a few intervals are an expression."""
    out = F.lit(None).cast("string")
    for start, end, value in reversed(periods):
        out = F.when(F.to_date(F.col(date)).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))), value).otherwise(out)
    return df.withColumn(name, out)


def members(df: DataFrame, name: str, era: str, history: str, wanted: str) -> DataFrame:
    """name, party of those whose eras name the wanted one: the last of the parties that a history parts by strokes, trimmed; an
    empty one is none."""
    last = F.trim(F.element_at(F.split(F.coalesce(history, F.lit("")), "/"), -1))
    return df.where(F.contains(F.col(era), F.lit(wanted))).select(F.trim(name).alias("name"), F.nullif(last, F.lit("")).alias("party"))


def unambiguous(df: DataFrame, name: str, value: str) -> DataFrame:
    """name, value: null where the name stands for several values."""
    return df.groupBy(name).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def stratified(df: DataFrame, cell: Sequence[str], key: str, n: int, seed: str = "0") -> DataFrame:
    """The n rows of each cell with the least md5 of key and seed; limits within partitions come before the shuffle."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed)).cast("binary"))
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*cell).orderBy(draw, key))).where(F.col("__rn") <= n).drop("__rn")


def candidates(vector: DataFrame, keyword: DataFrame, key: str, threshold: float) -> DataFrame:
    """Union of vector hits (their largest score, four decimals) and keyword hits, kept if hit by a keyword or at the threshold."""
    v = vector.select(key, F.round("vec_score", 4).alias("vec_score"), F.lit(False).alias("kw_hit"))
    k = keyword.select(key, F.lit(None).cast("double").alias("vec_score"), F.lit(True).alias("kw_hit"))
    both = v.unionByName(k).groupBy(key).agg(F.max("vec_score").alias("vec_score"), F.bool_or("kw_hit").alias("kw_hit"))
    return both.where(F.col("kw_hit") | (F.col("vec_score") >= threshold))


def tiers(mapping: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """New tiers where there is a decision, else the old one."""
    return mapping.join(decisions.select(key, F.col("tier").alias("__new")), key, "left").withColumn("tier", F.coalesce("__new", "tier")).drop("__new")


def parsed_choice(raw: Column, size: int, key: str = "relevant") -> Column:
    """A model's JSON list of numbers under `key`: distinct ones from 0 to size - 1, in order; null if it isn't such JSON."""
    numbers = F.from_json(raw, f"struct<`{key}`:array<int>>")[key]
    return F.when(numbers.isNotNull(), F.array_distinct(F.filter(numbers, lambda x: (x >= 0) & (x < size))))


def parsed_stances(raw: Column, size: int, kinds: Sequence[str] = K.STANCES) -> Column:
    """A model's JSON list of {i, stance} as an array of `size` stances by i; what is missing, out of range or no stance is
    null, later answers for one i win. Null as a whole if it isn't such JSON."""
    items = F.from_json(raw, "struct<items:array<struct<i:int,stance:string>>>")["items"]
    at = lambda i: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(items, lambda x: (x["i"] == i) & x["stance"].isin(*kinds)), lambda x: x["stance"])), -1)
    return F.when(items.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at))


def speaker_dimension(df: DataFrame, speaker: str, role: str, committee: str) -> DataFrame:
    """speaker, role, committee, n: rebuilt from all rows that have a speaker; a null role is a role of its own."""
    return df.where(F.col(speaker).isNotNull() & (F.col(speaker) != "")).groupBy(speaker, role, committee).agg(F.count("*").alias("n"))


def detected_issue(text: Column, keywords: dict) -> Column:
    """The issue (key) with the most keywords in the text; null if none is there or several have as many."""
    one = lambda low: F.array(*[F.struct(sum((F.contains(low, F.lit(k.lower())).cast("int") for k in ks[1:]), F.contains(low, F.lit(ks[0].lower())).cast("int")).alias("hits"), F.lit(i).alias("issue")) for i, ks in keywords.items()])
    best = lambda h: F.filter(h, lambda x: (x["hits"] > 0) & (x["hits"] == F.array_max(F.transform(h, lambda y: y["hits"]))))
    found = F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda low: best(one(low))), F.lit(0))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))["issue"])


def peaks(months: DataFrame, by: Sequence[str], month: str, core: str, corpus: str, n: int = 3) -> DataFrame:
    """by, peaks: the n months of most core turns as "month(turns)", or of most corpus turns where no month has a core one."""
    places = F.collect_list(F.struct((-F.col(core)).alias("a"), F.col(month).alias("m"), F.col(core).alias("n")))
    others = F.collect_list(F.struct((-F.col(corpus)).alias("a"), F.col(month).alias("m"), F.col(corpus).alias("n")))
    best = lambda xs: F.array_join(F.transform(F.slice(F.array_sort(F.filter(xs, lambda x: x["n"] > 0)), 1, n), lambda x: F.concat(x["m"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", ")
    g = months.groupBy(*by).agg(F.max(core).alias("__top"), places.alias("__core"), others.alias("__corpus"))
    return g.select(*by, F.when(F.col("__top") > 0, best(F.col("__core"))).otherwise(best(F.col("__corpus"))).alias("peaks"))


def issue_block(rows: DataFrame, months: DataFrame, actors: DataFrame, issue: str, month: str, core: str, corpus: str, n_actors: int = 5) -> DataFrame:
    """issue, block: a few lines on an issue: its composition rows (row, n, place), its peak months, and its most active
    actors (actor, n) that have a row (`row`). Lines without content are left out."""
    made = rows.groupBy(issue).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "row", "n"))), lambda x: F.concat(x["row"], F.lit(" "), x["n"].cast("string"))), " / ").alias("a"))
    known = actors.where(F.col("row").isNotNull()).groupBy(issue).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("actor").cast("string").alias("actor"), "n", "row"))).alias("x"))
    named = known.select(issue, F.array_join(F.transform(F.slice("x", 1, n_actors), lambda x: F.concat(x["actor"], F.lit("("), x["row"], F.lit(", "), x["n"].cast("string"), F.lit(")"))), ", ").alias("b"))
    both = made.join(peaks(months, [issue], month, core, corpus), issue, "left").join(named, issue, "left")
    line = lambda head, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(head), F.col(c)))
    return both.select(issue, F.concat_ws("\n", line("composition: ", "a"), line("peaks: ", "peaks"), line("actors: ", "b")).alias("block"))


def chosen_scope(sizes: DataFrame, with_neighbours: str, core: str, limit_mb: float = C.SCOPE_LIMIT_MB) -> DataFrame:
    """Adds neighbours, indexed, n_chunks, est_mb: the first that fits of all with an index, core with an index, core
    without; the last if none fits."""
    mb = lambda n, kind: F.col(n) * (C.ROW_KB["chunk"] + C.ROW_KB[kind]) / 1024
    row = lambda near, index, n, kind: F.struct(F.lit(near).alias("neighbours"), F.lit(index).alias("indexed"), F.col(n).alias("n_chunks"), F.round(mb(n, kind), 1).alias("est_mb"))
    pick = F.when(mb(with_neighbours, "indexed") <= limit_mb, row(True, True, with_neighbours, "indexed")).when(mb(core, "indexed") <= limit_mb, row(False, True, core, "indexed")).otherwise(row(False, False, core, "raw"))
    return sizes.withColumn("__s", pick).select(*sizes.columns, "__s.*")


def judging_cost(n: Column, chars: int = C.EXCERPT, usd_per_million: float = 0.15) -> Column:
    """US dollars to have n excerpts judged: 0.9 tokens a character and 60 more for each."""
    return n * (chars * 0.9 + 60) / 1e6 * usd_per_million


def spot_check(mapping: DataFrame, issue: str, key: str, tier: str, n: int, seed: str = "0", core: str = "core", untiered: str = "mapped") -> DataFrame:
    """issue, key, n_core, n_mention, n_all: a sample for each issue, of the core rows only where it has tiers."""
    counts = mapping.groupBy(issue).agg(F.count_if(F.col(tier) == core).alias("n_core"), F.count_if(F.col(tier) == "mention").alias("n_mention"), F.count("*").alias("n_all"), F.bool_or(F.col(tier) != untiered).alias("__tiered"))
    rows = mapping.join(counts, issue).where(~F.col("__tiered") | (F.col(tier) == core))
    return stratified(rows.select(issue, key, "n_core", "n_mention", "n_all"), [issue], key, n, seed)


def composition(actors: DataFrame, stance: str, party: str, group: str, kinds: Sequence[str] = K.STANCE_LABELS) -> DataFrame:
    """row, n, a count for each label, place. Only those of the assembly have a party's row; the government has one of its own,
    all others and those without a party share one; witnesses and staff have none. Parties by size, the two others last."""
    kept = actors.where(~F.col(group).isin("witness", "staff"))
    has_party = (F.col(group) == "assembly") & (F.coalesce(F.col(party), F.lit("")) != "") & (F.col(party) != K.NO_PARTY)
    row = F.when(F.col(group) == "government", K.GOVERNMENT_ROW).when(has_party, F.col(party)).otherwise(K.NO_PARTY_ROW)
    last = F.when(F.col("row") == K.GOVERNMENT_ROW, 1).when(F.col("row") == K.NO_PARTY_ROW, 2).otherwise(0)
    g = kept.groupBy(row.alias("row")).agg(F.count("*").alias("n"), *stance_counts(F.col(stance), kinds))
    return g.withColumn("place", F.row_number().over(Window.orderBy(last, F.col("n").desc(), "row")))


def stance_matrix(stances: DataFrame, fragments: DataFrame, *, by: Sequence[str], speaker: str, turn: str, stance: str, date: str, chunk: str, order: str, text: str, chars: int = C.CITATION_CHARS) -> tuple[DataFrame, DataFrame]:
    """(by, speaker, a count for each stance, total, label; by, speaker, label, turn, stance, date, chunk_id, snippet).

    stances has a row for each turn, fragments the turns' pieces. An actor's citations are the turns that its label rests on (for
    a mixed one those for and against), and all of its turns if none does; each with the first characters of the restored
    turn and its first piece. They are rows, since one actor may have very many.
    """
    counts = stances.groupBy(*by, speaker).agg(*stance_counts(F.col(stance)), F.count("*").alias("total"))
    actors = counts.withColumn("label", stance_label(F.col("support"), F.col("oppose"), F.col("concern")))
    rests_on = (F.col(stance) == F.col("label")) | ((F.col("label") == "mixed") & F.col(stance).isin("support", "oppose")) | (F.col("label") == "no_stance")
    cited = stances.join(actors.select(*by, speaker, "label"), [*by, speaker]).where(rests_on)
    whole = fragments.groupBy(turn).agg(F.min(chunk).alias("chunk_id"), F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), " "), F.lit(chars)).alias("snippet"))
    return actors, cited.join(whole, turn).select(*by, speaker, "label", turn, stance, date, "chunk_id", "snippet")


def as_of(df: DataFrame, keys: Sequence[str], date: str, periods: DataFrame, start: str, end: str, value: str) -> DataFrame:
    """df with the value of the period of its keys that its date is in, null if in none: periods are closed, a null end is open.
    Of periods that overlap the one that began last holds, of those that began together the least value.

    Periods are cut into spans that don't overlap; distinct dates and spans are merged in order, and the last span that
    began decides. Only distinct dates are sorted, so a key that most rows have is as many rows as it has days.
    """
    day = lambda c: F.to_date(F.col(c))
    known = periods.select(*keys, day(start).alias("__a"), F.coalesce(day(end), F.to_date(F.lit("9999-12-31"))).alias("__b"), F.col(value).alias("__value")).where("__a <= __b")
    cuts = known.select(*keys, F.explode(F.array("__a", F.date_add("__b", 1))).alias("__cut")).distinct() if keys else known.select(F.explode(F.array("__a", F.date_add("__b", 1))).alias("__cut")).distinct()
    inside = (F.col("__cut") >= F.col("__a")) & (F.col("__cut") <= F.col("__b"))
    # A span's value from all periods of its keys: their number is that of a dimension, not of the rows.
    one = F.lit(0).alias("__one")
    spans = cuts.select("*", one).join(known.select("*", one), ["__one", *keys], "left").groupBy(*keys, "__cut").agg(F.min(F.when(inside, F.struct(F.date_diff(F.lit("9999-12-31").cast("date"), F.col("__a")).alias("late"), F.col("__value").alias("v")))).alias("__best"))
    asked = df.select(*keys, day(date).alias("__cut")).where("__cut IS NOT NULL").distinct()
    both = spans.select(*keys, "__cut", F.lit(0).alias("__kind"), F.struct(F.col("__best.v").alias("v")).alias("__span")).unionByName(asked.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    merged = both.withColumn("__span", F.last("__span", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__cut", "__kind"))).where("__kind = 1")
    found = merged.select(*keys, F.col("__cut").alias("__day"), F.col("__span.v").alias(value))
    return df.withColumn("__day", day(date)).join(found, [*keys, "__day"], "left").drop("__day")


def party_label(df: DataFrame, *, speaker: str, role: str, date: str, members: DataFrame, periods: DataFrame, name: str = "party_label") -> DataFrame:
    """df with the label of each speaker at the date: the party with its side then, or what stands in its place; null for those
    whose standing isn't known. members: name, hanja, party; a name of several parties has none. periods: start, end, ruling."""
    key = lambda c: F.nullif(nfkc(F.coalesce(c, F.lit(""))), F.lit(""))
    names = members.select(F.explode(F.array(key(F.col("name")), key(F.col("hanja")))).alias("__name"), F.col("party").alias("__party")).where("__name IS NOT NULL")
    party = unambiguous(names, "__name", "__party")
    parent = F.col("__party")
    for k, v in K.SATELLITES.items():
        parent = F.when(F.col("__party") == k, v).otherwise(parent)
    side = F.when(parent == F.col("ruling"), K.RULING_SIDE).otherwise(K.OPPOSING_SIDE)
    of_party = F.when(F.col("__party") == K.NO_PARTY, K.NO_PARTY).when(F.col("ruling").isNull(), F.col("__party")).otherwise(F.format_string("%s(당시 %s)", F.col("__party"), side))
    group = speaker_group(F.col(role))
    known = (F.coalesce(F.col(speaker), F.lit("")) != "") & F.col(date).isNotNull()
    joined = as_of(df.withColumn("__name", key(F.col(speaker))), [], date, periods, "start", "end", "ruling").join(party, "__name", "left")
    label = F.when(known & (group == "government"), K.GOVERNMENT_ROW).when(known & (group == "assembly") & F.col("__party").isNotNull(), of_party)
    return joined.withColumn(name, label).drop("__name", "__party", "ruling")


def history(actors: DataFrame, who: str, party: str, periods: Sequence[tuple[str, str, str]] = tuple(K.RULING)) -> DataFrame:
    """who, start, end, side for each ruling period: ruling or opposition; satellites count as their parents."""
    parent = F.col(party)
    for k, v in K.SATELLITES.items():
        parent = F.when(F.col(party) == k, v).otherwise(parent)
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(p).alias("ruling")) for a, b, p in periods])
    each = actors.select(who, party, parent.alias("__p"), F.explode(spans).alias("s"))
    return each.select(who, "s.start", "s.end", F.when(F.col("__p").isNull(), None).when(F.col("__p") == F.col("s.ruling"), "ruling").otherwise("opposition").alias("side"))


def bars(months: DataFrame, by: Sequence[str], month: str, n: str, ticks: int = 4) -> DataFrame:
    """Adds share of the group's largest month, is_peak (its first) and is_tick (every ceil(months / ticks)-th)."""
    w, all_ = Window.partitionBy(*by).orderBy(month), Window.partitionBy(*by)
    top = F.max(n).over(all_)
    first = F.min(F.when(F.col(n) == F.col("__top"), F.col(month))).over(all_)
    step = F.ceil(F.count("*").over(all_) / ticks)
    out = months.withColumn("__top", top).withColumn("__i", F.row_number().over(w) - 1)
    return out.select(*by, month, n, F.round(F.try_divide(F.col(n), F.col("__top")), 4).alias("share"), (F.col(month) == first).alias("is_peak"), (F.pmod("__i", step) == 0).alias("is_tick"))
