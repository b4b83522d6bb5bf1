"""Judging rows in batches by a model that is reached through an injected client.

Batches go to the client from the tasks, one after another in each; an answer that can't be read is asked for once more, an
error that passes is waited out with growing pauses. What stays unanswered comes back as dead letters with the reason, so a
run ends with a verdict or a letter for every row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave import config as C
from talkweave.functions.question import Generate

#: A batch's answer as a verdict for each of its n rows (null: none was given), or None if it can't be read.
Parse = Callable[[str, int], Sequence[str | None] | None]
#: Parts of a group when its rows get their batches.
DEALS = 64


def numbered(rows: DataFrame, by: Sequence[str], key: str, size: int = C.MAP_BATCH) -> DataFrame:
    """batch: about `size` rows of a group, dealt by a hash of the key, so no group is sorted or counted in one task. Whether a
    batch is a little larger or smaller doesn't matter to a judge, and `judged` cuts those that are larger.

    A group may hold most rows: its size is repeated for each of DEALS parts of it, so that no task of the join reads it whole."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("__n")).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(DEALS)).cast("int"))
    return dealt.join(sizes, [*by, "__deal"]).withColumn("batch", F.pmod(F.xxhash64(key), F.col("__n"))).select(*rows.columns, "batch")


def answered(generate: Generate, prompt: str, parse: Parse, n: int, *, transient: tuple[type[BaseException], ...], forms: int = 2, tries: int = 5, pause: float = 2.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[Sequence[str | None] | None, str | None]:
    """(verdicts, None), or (None, the reason why there are none)."""
    for _ in range(forms):
        wait, text = pause, None
        for left in range(tries - 1, -1, -1):
            try:
                text = generate(prompt)
                break
            except transient as e:
                if not left:
                    return None, f"{type(e).__name__} {tries} times"
                sleep(wait)
                wait = min(2 * wait, longest)
        verdicts = parse(text, n)
        if verdicts is not None:
            return verdicts, None
    return None, f"no readable answer {forms} times"


def judged(rows: DataFrame, by: Sequence[str], key: str, text: str, *, prompt: Callable[[dict, list[str]], str], generate: Generate, parse: Parse, transient: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError), size: int = C.MAP_BATCH, chars: int = C.EXCERPT, **waits) -> DataFrame:
    """by, key, verdict, failure: of each row its verdict, or why there is none. rows has `batch` (see numbered); a batch of
    more than `size` rows is asked for in several. prompt gets the group's values and the first characters of each text."""
    columns = [*by, "batch", key, text]
    schema = rows.select(*by, key).schema.add("verdict", "string").add("failure", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(part: pd.DataFrame) -> pd.DataFrame:
            texts = [t if isinstance(t, str) else "" for t in part[text]]
            verdicts, failure = answered(generate, prompt({b: part[b].iloc[0] for b in by}, texts), parse, len(part), transient=transient, **waits)
            verdicts = list(verdicts) if verdicts is not None else [None] * len(part)
            return part[[*by, key]].assign(verdict=pd.Series(verdicts, index=part.index, dtype=object), failure=pd.Series([failure or (None if v is not None else "not in the answer") for v in verdicts], index=part.index, dtype=object))

        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            whole = rest.groupby([*by, "batch"], sort=False, dropna=False).ngroup()
            done = rest[whole < whole.max()] if len(rest) else rest
            for _, part in done.groupby([*by, "batch"], sort=False, dropna=False):
                for a in range(0, len(part), size):
                    yield ask(part.iloc[a : a + size])
            rest = rest[whole == whole.max()] if len(rest) else rest
            while len(rest) > 50 * size:  # a batch that grows on: its full parts needn't wait
                yield ask(rest.iloc[:size])
                rest = rest.iloc[size:]
        if rest is not None:
            for a in range(0, len(rest), size):
                yield ask(rest.iloc[a : a + size])

    # Only what is shown to the judge is shuffled.
    shown = rows.select(*by, "batch", key, F.left(F.col(text), F.lit(chars)).alias(text))
    return shown.select(*columns).repartition(*by, "batch").sortWithinPartitions(*by, "batch", key).mapInPandas(run, schema)


def letters(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a verdict, dead letters)."""
    return verdicts.where("failure IS NULL").drop("failure"), verdicts.where("failure IS NOT NULL").drop("verdict")
