"""What a question says about names and dates. A question is a scalar, so this runs on the driver; `filters` is for columns."""

from __future__ import annotations

import calendar
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave.functions import fixed as K

_WITH_YEAR = [re.compile(p) for p in (K.DATE_FULL, K.DATE_ISO, K.DATE_MONTH)]
_WITHOUT = [re.compile(p) for p in (K.DATE_DAY_ONLY, K.DATE_MONTH_ONLY)]


@dataclass
class Parsed:
    text: str
    names: list[str]
    date_from: date | None = None
    date_to: date | None = None


def span(year: int, month: int, day: int | None) -> tuple[date, date] | None:
    """A day, or a month's first and last; None if there is no such day."""
    try:
        first = date(year, month, day if day is not None else 1)
    except ValueError:
        return None
    return first, first if day is not None else first.replace(day=calendar.monthrange(year, month)[1])


def dates(text: str) -> list[tuple[int, int, date, date]]:
    """(start, end, first day, last day) of each date that exists, in order; a date within another isn't one. One without a
    year takes that of the nearest existing dated one before it, else after it; without any it isn't a date."""
    found: list[tuple[int, int, date, date]] = []

    def add(pattern: re.Pattern, year_of: Callable[[int], int | None] | None) -> None:
        for m in pattern.finditer(text):
            parts = [int(x) for x in m.groups()]
            year, rest = (parts[0], parts[1:]) if year_of is None else (year_of(m.start()), parts)
            if year is None or any(m.start() < b and m.end() > a for a, b, _, _ in found):
                continue
            if days := span(year, rest[0], rest[1] if len(rest) > 1 else None):
                found.append((*m.span(), *days))

    for pattern in _WITH_YEAR:
        add(pattern, None)
    dated = sorted(found)

    def nearest(at: int) -> int | None:
        before, after = [f for a, b, f, _ in dated if b <= at], [f for a, b, f, _ in dated if a >= at]
        return before[-1].year if before else after[0].year if after else None

    for pattern in _WITHOUT:
        add(pattern, nearest)
    return sorted(found)


def parse(text: str, names: Mapping[str, str]) -> Parsed:
    """Names (any spelling -> canonical, longest first, each once, in order) and the span of all dates. Dates are taken out
    of the text; names stay, as they mean something to a search."""
    days = dates(text)
    rest, at = [], 0
    for a, b, _, _ in days:
        rest.append(text[at:a])
        at = b
    left = " ".join(" ".join([*rest, text[at:]]).split())
    found: list[str] = []
    if names:
        found = [names[x] for x in re.findall("|".join(map(re.escape, sorted(names, key=lambda n: (-len(n), n)))), left)]
    return Parsed(left, list(dict.fromkeys(found)), min((f for _, _, f, _ in days), default=None), max((t for _, _, _, t in days), default=None))


def search_filters(text: str, names: Mapping[str, str], committee: str | None = None, date_from: date | None = None, date_to: date | None = None) -> Parsed:
    """What a question says, except where the caller says it."""
    p = parse(text, names)
    return Parsed(p.text, [committee] if committee else p.names, date_from or p.date_from, date_to or p.date_to)


def filters(text: Column, names: Mapping[str, str]) -> Column:
    """struct<text, names, date_from, date_to> of each question of a column, in batches."""

    @F.pandas_udf("text string, names array<string>, date_from date, date_to date")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([vars(parse(t or "", names)) for t in batch], columns=["text", "names", "date_from", "date_to"])

    return run(text)


def nfkc(text: Column) -> Column:
    """Compatibility characters in their standard form, trimmed; Spark has no such function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip())

    return run(text)


Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[str], str]


def cached(embed: Embed, size: int = 256) -> Embed:
    """The same, keeping the vectors of the last `size` questions; what isn't known yet goes to the model in one call."""
    known: OrderedDict[str, list[float]] = OrderedDict()

    def run(texts: list[str]) -> list[list[float]]:
        fresh = [t for t in dict.fromkeys(texts) if t not in known]
        found = dict(zip(fresh, embed(fresh))) if fresh else {}
        out = [found[t] if t in found else known[t] for t in texts]
        for t, v in zip(texts, out):
            known[t] = v
            known.move_to_end(t)
        while len(known) > size:
            known.popitem(last=False)
        return out

    return run
