"""Layers of files: binary scans, JSON lines, change detection, merges, partitioned loads, exact counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file_path, file_name, size, sha256, date_hint (eight digits a name begins with), status."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    hint = F.regexp_extract(name, r"^(\d{8})", 1)
    return files.select(
        F.col("path").alias("file_path"), name.alias("file_name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"),
        F.when(hint != "", hint).alias("date_hint"), F.when(F.col("length") > 0, "pending").otherwise("error").alias("status"),
    )


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a JSON-lines layer; blank lines are skipped, broken ones stand in _corrupt_record."""
    from pyspark.sql.types import StructField, StringType, _parse_datatype_string

    s = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*s.fields, StructField("_corrupt_record", StringType())])).option("mode", "PERMISSIVE").json(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a layer, in order: those whose job was committed."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _removed(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def write_layer(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = (), expected: int | None = None) -> int:
    """Write a layer whole or not at all: as a new version beside the old ones, which readers take up when its job is
    committed. Returns its rows; if `expected` isn't that many, the version is taken back and the old one stays."""
    spark = df.sparkSession
    at = f"{path}/v{max(_versions(spark, path), default=0) + 1}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).format(fmt).save(at)
    n = spark.read.schema(df.schema).format(fmt).load(at).count()
    if expected is not None and n != expected:
        _removed(spark, at)
        raise RuntimeError(f"{path}: {n} rows written, {expected} expected")
    return n


def read_layer(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """The newest complete version of a layer."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(fmt).load(f"{path}/v{versions[-1]}")


def replaced(stored: DataFrame, new: DataFrame, keys: Sequence[str], **stamps: Column) -> DataFrame:
    """stored without the rows of the keys that new has, and new's rows in their place, with what `stamps` says (a version,
    say). Write it with write_layer(expected=...), so that a load is whole or isn't there."""
    fresh = new.withColumns(stamps) if stamps else new
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def from_sources(df: DataFrame, source: str, prefixes: Sequence[str]) -> DataFrame:
    """The rows whose source begins with one of the prefixes; all rows if there are none. Reaches the scan."""
    keep = F.lit(not prefixes)
    for p in prefixes:
        keep = keep | F.col(source).startswith(p)
    return df.where(keep)


def updated(log: DataFrame, changes: DataFrame, key: str, version: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(log with the newest change of each key in its columns, changes of keys that the log doesn't have)."""
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("__new"))
    out = log.join(newest, key, "left").select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in log.columns])
    return out, changes.join(log.select(key), key, "left_anti")


def changed(now: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of now that aren't done: unknown keys, and known ones whose stored digest differs (no stored digest: done)."""
    old = before.select(key, F.col(digest).alias("__old"), F.lit(True).alias("__known"))
    return now.join(old, key, "left").where(F.col("__known").isNull() | (F.col("__old").isNotNull() & ~F.col("__old").eqNullSafe(F.col(digest)))).drop("__old", "__known")


def latest(df: DataFrame, keys: Sequence[str], *version: Column) -> DataFrame:
    """The newest row of each key, as a max of structs: it combines before the shuffle, as a window doesn't."""
    rest = [c for c in df.columns if c not in keys]
    order = [v.alias(f"__v{i}") for i, v in enumerate(version)]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*")


def page_texts(pages: DataFrame, key: str, html: str) -> tuple[DataFrame, DataFrame]:
    """(key, text of each page without its markup), and the keys whose pages are all blank: an error of the source."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>", " "), r"<[^>]*>", " ")
    out = pages.select(key, F.trim(F.regexp_replace(F.coalesce(bare, F.lit("")), r"\s+", " ")).alias("text"))
    return out, out.groupBy(key).agg(F.bool_and(F.col("text") == "").alias("__blank")).where("__blank").select(key)


def file_name(*parts: Column, host: Column, ending: str = ".html") -> Column:
    """The parts and the host with dashes for dots, joined by underscores: a name that a page is stored under."""
    return F.concat(F.concat_ws("_", *parts, F.regexp_replace(host, r"\.", "-")), F.lit(ending))


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stored with new's rows in place of those of the same keys (the last of equal keys in new isn't defined: make it unique)."""
    return stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.unionByName(new.join(stored.select(*keys), list(keys), "left_anti"))


def appended(log: DataFrame, rows: DataFrame) -> DataFrame:
    """A log with more rows; columns that either lacks are null there, as a log grows columns over time."""
    return log.unionByName(rows, allowMissingColumns=True)


def pending(all_rows: DataFrame, done: DataFrame, key: str, text: str | None = None, source: str | None = None, prefixes: Sequence[str] = ()) -> DataFrame:
    """The rows that aren't done yet, without blank texts, of the sources that begin with one of the prefixes (all, if none)."""
    rows = (from_sources(all_rows, source, prefixes) if source else all_rows).join(done.select(key), key, "left_anti")
    return rows.where(F.coalesce(F.trim(F.col(text)), F.lit("")) != "") if text else rows


def copied(df: DataFrame, path: str, key: str | None = None, ids: DataFrame | None = None, by: Sequence[str] = ()) -> int:
    """Copy a table, or its rows whose key is among `ids`, into a layer, and count the copy against it; returns the rows."""
    rows = df if ids is None else df.join(ids.select(key).distinct(), key, "left_semi")
    return write_layer(rows, path, by=by, expected=rows.count())


def ledger(failed: DataFrame, path: str) -> int:
    """Keep the rows that a stage failed on as the layer `path`, in place of what a former run left there; without any, no
    ledger stays behind. Returns how many there are."""
    n = failed.count()
    _removed(failed.sparkSession, path)
    return write_layer(failed, path, expected=n) if n else 0


def carried_over(chunks: DataFrame, vectors: DataFrame, text: str, vector: str, id_: str) -> DataFrame:
    """chunks with the vector of the same text (by md5), of the least id that has one; null where none has."""
    known = vectors.where(F.col(vector).isNotNull()).groupBy(F.md5(F.col(text).cast("binary")).alias("__md5")).agg(F.min_by(vector, id_).alias(vector))
    return chunks.withColumn("__md5", F.md5(F.col(text).cast("binary"))).join(known, "__md5", "left").drop("__md5")


def census(layers: dict[str, DataFrame], source: str) -> DataFrame:
    """layer, n_rows, n_sources, share of the first layer's sources."""
    parts = [df.agg(F.lit(name).alias("layer"), F.lit(i).alias("place"), F.count("*").alias("n_rows"), F.count_distinct(source).alias("n_sources")) for i, (name, df) in enumerate(layers.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.first("n_sources").over(Window.orderBy("place"))
    return out.select("layer", "n_rows", "n_sources", F.round(F.try_divide(F.col("n_sources"), first), 4).alias("share"))


class Pipeline:
    """Named stages on DataFrames with gates between them; a gate that says False stops the run."""

    def __init__(self, *stages: tuple[str, Callable[[DataFrame], DataFrame], Callable[[DataFrame], bool] | None]):
        self.stages = stages

    def run(self, df: DataFrame, path: str, start: str | None = None, clean: bool = False, clean_first: bool = False) -> DataFrame:
        """The last stage's layer. clean: what the stages from `start` on have written before goes first, but for the first
        stage's layer, which is dear to make again and goes only if clean_first says so."""
        names = [n for n, _, _ in self.stages]
        at = names.index(start) if start else 0
        if clean:
            for name in names[at:]:
                if name != names[0] or clean_first:
                    _removed(df.sparkSession, f"{path}/{name}")
        if at:
            df = read_layer(df.sparkSession, f"{path}/{names[at - 1]}")
        for name, stage, gate in self.stages[at:]:
            write_layer(stage(df), f"{path}/{name}")
            df = read_layer(df.sparkSession, f"{path}/{name}")
            if gate is not None and not gate(df):
                raise RuntimeError(f"gate after {name}")
        return df
