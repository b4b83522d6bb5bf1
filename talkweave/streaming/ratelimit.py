"""A sliding-window rate limiter. Refused events don't count, so each verdict depends on those before: a fold, in order."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkweave import config as C


def allow(window: deque, now: float, limit: int, seconds: float) -> bool:
    """Evicts what is `seconds` old or older, and admits if there is room."""
    while window and now - window[0] >= seconds:
        window.popleft()
    if len(window) >= limit:
        return False
    window.append(now)
    return True


def limited(df: DataFrame, key: str, ts: str, event: str, limit: int = C.LLM_PER_MINUTE, seconds: float = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """key, event, allowed for a table: rows of a key stream by in order, and the state is at most `limit` times."""
    rows = df.select(key, event, F.col(ts).cast("timestamp").cast("double").alias("__t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window = object(), deque()
        for pdf in frames:
            out = []
            for k, t in zip(pdf[key], pdf["__t"]):
                if k != now:
                    now, window = k, deque()
                out.append(allow(window, t, limit, seconds))
            yield pdf[[key, event]].assign(allowed=out)

    schema = rows.select(key, event).schema.add("allowed", "boolean")
    return rows.repartition(key).sortWithinPartitions(key, "__t", event).mapInPandas(run, schema)


def limited_stream(df: DataFrame, key: str, ts: str, event: str, limit: int = C.LLM_PER_MINUTE, seconds: float = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """The same for a stream with a watermark on ts: keyed state holds the admitted times and goes when they are old.
    Events later than the watermark are dropped before they get here."""
    kind = df.select(key, event).schema

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["__t", event])
        rows["allowed"] = [allow(window, t, limit, seconds) for t in rows["__t"]]
        state.update((list(window),))
        if window:
            state.setTimeoutTimestamp(max(int((window[-1] + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[[key, event, "allowed"]]

    rows = df.select(key, event, ts, F.col(ts).cast("double").alias("__t"))
    return rows.groupBy(key).applyInPandasWithState(run, kind.add("allowed", "boolean"), "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def client_key(forwarded: Column, peer: Column) -> Column:
    """The first address of a forwarded header, 64 characters of it, or else the peer's."""
    first = F.left(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit(64))
    return F.coalesce(F.nullif(first, F.lit("")), peer, F.lit("unknown"))


class CachedCheck:
    """Whether a cost has reached its limit, asked at most once in `seconds`: what is asked may be a Spark job."""

    def __init__(self, cost: Callable[[], float], limit: float = C.DAILY_COST, seconds: float = C.RATE_WINDOW_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.cost, self.limit, self.seconds, self.clock = cost, limit, seconds, clock
        self.known: tuple[float, float] | None = None

    def exceeded(self) -> bool:
        now = self.clock()
        if self.known is None or now - self.known[0] >= self.seconds:
            self.known = (now, self.cost())
        return self.known[1] >= self.limit


def day_cost(log: DataFrame, ts: str, cost: Column, day: Column) -> DataFrame:
    """cost of the day's rows; rows without one (blocked before a call) don't count, none at all is 0."""
    return log.where(F.to_date(ts) == day).agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"))
