"""Tables replaced key by key, and the log that a stream appends to."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talkweave.session import fresh
from talkweave.sources import keyed
from talkweave.streaming import sink

SCHEMA = "id long, source string, n int"


def files_of(at):
    root = at.removeprefix("file:")
    return {p: (os.stat(p).st_mtime_ns, os.stat(p).st_size) for p in map(str, Path(root, "data").rglob("*.parquet"))}


@pytest.fixture
def loaded(spark):
    at = fresh(spark, "keyed")
    first = spark.createDataFrame([(i, f"s{i % 4}" if i % 5 else None, 1) for i in range(100)], SCHEMA)
    assert {r.key: r.n_rows for r in keyed.replace(first, at, "source").collect()} == {None: 20, "s0": 20, "s1": 20, "s2": 20, "s3": 20}
    return at, first


def rows_of(spark, at, first):
    return sorted((tuple(r) for r in keyed.read(spark, at, "source", first.schema).collect()), key=repr)


def test_other_keys_keep_their_files(spark, loaded):
    at, first = loaded
    before = files_of(at)
    new = spark.createDataFrame([(i, s, 2) for i, s in [(1, "s1"), (2, "s1"), (3, "s9"), (4, None)]], SCHEMA)
    keyed.replace(new, at, "source")
    after = files_of(at)
    assert before.items() <= after.items()
    want = [tuple(r) for r in first.where("source NOT IN ('s1')").collect()] + [tuple(r) for r in new.collect()]
    assert rows_of(spark, at, first) == sorted(want, key=repr)
    assert keyed.vacuum(spark, at, "source") == 0  # the first load still has three keys
    keyed.replace(spark.createDataFrame([(7, s, 3) for s in ("s0", "s2", "s3")], SCHEMA), at, "source")
    assert keyed.vacuum(spark, at, "source") == 1
    assert rows_of(spark, at, first) == sorted([tuple(r) for r in new.collect()] + [(7, s, 3) for s in ("s0", "s2", "s3")], key=repr)


def test_failed_load_leaves_the_old_manifest(spark, loaded):
    at, first = loaded
    before, rows = files_of(at), rows_of(spark, at, first)
    new = spark.createDataFrame([(1, "s1", 2)], SCHEMA)
    with pytest.raises(RuntimeError, match="s1: 1 rows, 2 expected"):
        keyed.replace(new, at, "source", expected=spark.createDataFrame([("s1", 2)], "source string, n_rows long"))
    with pytest.raises(Exception, match="broken"):
        keyed.replace(new.withColumn("n", F.raise_error(F.lit("broken")).cast("int")), at, "source")
    assert files_of(at) == before and rows_of(spark, at, first) == rows


def test_reading_leaves_superseded_folders_out(spark, loaded):
    at, first = loaded
    keyed.replace(spark.createDataFrame([(1, "s1", 2)], SCHEMA), at, "source")
    one = keyed.read(spark, at, "source", first.schema).where("source = 's1'")
    assert [tuple(r) for r in one.collect()] == [(1, "s1", 2)]
    assert keyed.read(spark, fresh(spark, "none"), "source", first.schema).count() == 0


class Killed(sink.Appender):
    """Dies on the n-th batch, before or after its rows are written."""

    def __init__(self, at, when, after):
        super().__init__(at)
        self.when, self.after = when, after

    def __call__(self, rows, batch):
        if batch == self.when and not self.after:
            rows.limit(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.folder(batch))
            raise RuntimeError("killed in the middle")
        super().__call__(rows, batch)
        if batch == self.when:
            raise RuntimeError("killed at the end")


@pytest.mark.parametrize("after", [True, False])
def test_restarted_stream_appends_once(spark, after):
    inbox, at, checkpoint = fresh(spark, "inbox"), fresh(spark, "log"), fresh(spark, "point")
    schema = spark.createDataFrame([], SCHEMA).schema
    put = lambda a, b: spark.createDataFrame([(i, "s", i) for i in range(a, b)], SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    run = lambda s: sink.appending(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox), s, checkpoint).trigger(availableNow=True).start()
    for k in range(3):
        put(10 * k, 10 * k + 10)
    query = run(Killed(at, 1, after))
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    assert sink.appended(spark, at, schema).count() == (20 if after else 10)
    run(sink.Appender(at)).awaitTermination()
    put(30, 40)
    run(sink.Appender(at)).awaitTermination()
    got = sink.appended(spark, at, schema).collect()
    assert sorted(r.id for r in got) == list(range(40)) and {r.batch for r in got} == {0, 1, 2, 3}
