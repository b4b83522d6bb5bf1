"""Tables that are replaced key by key: folders for each load, and a manifest that says which of them count.

A table is a folder with `data/load=<id>/<key>=<value>/` and the layer `manifest` (key, load, n_rows). A load writes the
folders of its own keys, counts what it has written, and then writes a new version of the manifest, in which its keys
point to the new load. Readers take the newest complete manifest, so they see all of a load or nothing, and no file of
another key is read, moved or written. A load that fails leaves its folders unread and the old manifest in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.sources.layers import _removed, _versions, read_layer, write_layer


def known(spark: SparkSession, at: str, key: str) -> DataFrame | None:
    """key (as text), load, n_rows of the table's keys; None before the first load."""
    return read_layer(spark, f"{at}/manifest", schema=T._parse_datatype_string("key string, load string, n_rows long")) if _versions(spark, f"{at}/manifest") else None


def replace(new: DataFrame, at: str, key: str, expected: DataFrame | None = None, files: int = 8) -> DataFrame:
    """Put the rows of `new` in place of all rows of its keys; returns key (as text) and n_rows of what was loaded.

    expected: key, n_rows that the load must have (else: what `new` counts); the load is taken back if it hasn't. A key may be
    null; its rows are dealt over at most `files` files. Loads of one table must not run at once.
    """
    spark, load = new.sparkSession, uuid.uuid4().hex
    text = F.col(key).cast("string")
    place = f"{at}/data/load={load}"
    try:
        dealt = F.pmod(F.xxhash64(*new.columns), F.lit(files))
        new.repartition(key, dealt).write.partitionBy(key).parquet(place)
        loaded = spark.read.schema(new.schema).parquet(place).groupBy(text.alias("key")).agg(F.count("*").alias("n_rows"))
        wanted = expected.select(text.alias("key"), F.col("n_rows").alias("wanted")) if expected is not None else new.groupBy(text.alias("key")).agg(F.count("*").alias("wanted"))
        off = loaded.alias("l").join(wanted.alias("w"), F.col("l.key").eqNullSafe(F.col("w.key")), "full").where(~F.coalesce(F.col("n_rows"), F.lit(0)).eqNullSafe(F.coalesce(F.col("wanted"), F.lit(0))))
        wrong = [f"{r[0]}: {r[1]} rows, {r[3]} expected" for r in off.limit(5).collect()]
        if wrong:
            raise RuntimeError(f"{at}: " + "; ".join(wrong))
        rows = loaded.select("key", F.lit(load).alias("load"), "n_rows")
        before = known(spark, at, key)
        if before is not None:
            kept = before.alias("b").join(loaded.alias("l"), F.col("b.key").eqNullSafe(F.col("l.key")), "left_anti")
            rows = kept.unionByName(rows)
        write_layer(rows, f"{at}/manifest")
    except BaseException:
        _removed(spark, place)
        raise
    return loaded


def read(spark: SparkSession, at: str, key: str, schema: T.StructType) -> DataFrame:
    """The table's rows: of each key those of the load that the manifest names. The manifest has a row for each key, and
    meets the folders' names, so superseded folders are left out when the scan is planned or, at the latest, run."""
    manifest = known(spark, at, key)
    if manifest is None:
        return spark.createDataFrame([], schema)
    with_load = T.StructType([*schema, T.StructField("load", T.StringType())])
    data = spark.read.schema(with_load).parquet(f"{at}/data")
    live = manifest.select(F.col("key").alias("__key"), F.col("load").alias("__load"))
    return data.join(live, (F.col("load") == F.col("__load")) & F.col(key).cast("string").eqNullSafe(F.col("__key")), "left_semi").select(*schema.names)


def vacuum(spark: SparkSession, at: str, key: str) -> int:
    """Delete the folders of loads that the newest manifest doesn't name at all; returns how many. Not while readers of an
    older manifest run."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{at}/data")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    manifest = known(spark, at, key)
    live = {r["load"] for r in manifest.select("load").distinct().collect()} if manifest is not None else set()  # a name a load
    gone = [n for n in (f.getPath().getName() for f in fs.listStatus(root)) if n.startswith("load=") and n[5:] not in live]
    for n in gone:
        _removed(spark, f"{at}/data/{n}")
    return len(gone)
