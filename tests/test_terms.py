"""Many terms at once against substring search and alternation; judging with a client that fails on plan."""

import json
import random
import re

from pyspark.sql import functions as F

from talkweave.operators import judging, terms


def test_terms_equal_contains_and_alternation(spark):
    rng = random.Random(8)
    vocabulary = list(dict.fromkeys("".join(rng.choice("abc가é ") for _ in range(rng.randint(1, 6))) for _ in range(300)))
    texts = ["".join(rng.choice("abc가é xyz") for _ in range(n)) for n in (0, 1, 5, 40, 300, 2047, 2048, 2049, 5000, 9000)] + ["", None, "ab" * 3000, "가" * 2050]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    pattern = re.compile("|".join(map(re.escape, vocabulary)))
    for entries in (terms.ENTRIES, 500):  # one automaton, and many
        rows = df.select("i", terms.held(F.col("t"), vocabulary, entries).alias("h"), terms.mentions(F.col("t"), vocabulary, entries).alias("m")).collect()
        for r in rows:
            text = texts[r.i] or ""
            assert r.h == [w for w in vocabulary if w in text]
            assert r.m == pattern.findall(text)
    assert len(terms.automata(vocabulary, 500)) > 5 and all(a.step.size <= 500 or len(a.terms) == 1 for a in terms.automata(vocabulary, 500))
    assert [r.h for r in df.select(terms.held(F.col("t"), []).alias("h")).collect()] == [[]] * len(texts)


def client_and_parse():
    """A client that counts calls and fails as the first words of the prompt say, and a parser of its answers. Made here, so that
    both can be sent to the workers."""

    class Client:
        calls = 0

        def __call__(self, prompt):
            self.calls += 1
            kind = prompt.split("\n")[0]
            if kind == "down" or kind == "shaky" and self.calls % 3:
                raise ConnectionError("no route")
            if kind == "broken" or kind == "once broken" and self.calls % 2:
                return "no json"
            lines = prompt.split("\n")[1:]
            return json.dumps({"items": [{"i": i, "v": "yes" if "good" in x else "no"} for i, x in enumerate(lines) if "silent" not in x]})

    def parse(text, n):
        try:
            items = json.loads(text)["items"]
        except ValueError:
            return None
        out = [None] * n
        for x in items:
            if 0 <= x["i"] < n:
                out[x["i"]] = x["v"]
        return out

    return Client(), parse


def test_waits_and_retries():
    waited, (client, parse) = [], client_and_parse()
    ask = lambda kind: judging.answered(client, f"{kind}\ngood", parse, 1, transient=(ConnectionError,), sleep=waited.append)
    assert ask("down") == (None, "ConnectionError 5 times") and waited == [2.0, 4.0, 8.0, 16.0]
    client.calls = 0
    assert ask("shaky") == (["yes"], None) and waited[4:] == [2.0, 4.0]
    client.calls = 0
    assert ask("once broken") == (["yes"], None) and client.calls == 2
    client.calls = 0
    assert ask("broken") == (None, "no readable answer 2 times") and client.calls == 2


def test_every_row_has_a_verdict_or_a_letter(spark):
    rows = [(g, i, "good" if i % 2 else "silent" if i % 10 == 4 else "bad") for g, n in (("fine", 95), ("down", 7), ("broken", 30), ("once broken", 41), (None, 3)) for i in range(n)]
    client, parse = client_and_parse()
    df = judging.numbered(spark.createDataFrame([(g or "none", i, t) for g, i, t in rows], "g string, i int, t string"), ["g"], "i", size=10)
    got = judging.judged(df, ["g"], "i", "t", prompt=lambda group, texts: "\n".join([group["g"], *texts]), generate=client, parse=parse, size=10, sleep=lambda s: None)
    good, dead = (d.collect() for d in judging.letters(got))
    assert len(good) + len(dead) == len(rows)
    assert {(r.g, r.failure) for r in dead} == {("down", "ConnectionError 5 times"), ("broken", "no readable answer 2 times"), ("fine", "not in the answer"), ("once broken", "not in the answer")}
    assert all((r.verdict == "yes") == (r.i % 2 == 1) for r in good) and {r.g for r in good} == {"fine", "once broken", "none"}


def test_texts_are_looked_through_in_slices_of_bounded_size():
    texts = ["a" * 30, None, "b" * 500, "", "c" * 99, "d"]
    got = list(terms.slices(texts, 100))
    assert [t for own in got for t in own] == [t or "" for t in texts]
    assert all(sum(map(len, own[:-1])) < 100 for own in got) and len(got) == 3 and list(terms.slices([])) == []


def test_rows_of_one_group_are_numbered_by_many_tasks(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = spark.range(4000).select(F.lit("g").alias("g"), F.col("id").alias("k"))
        got = judging.numbered(rows, ["g"], "k", size=20).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2500
        assert got.select("batch").distinct().count() == 200
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
