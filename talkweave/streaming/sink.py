"""A log that a stream appends to, each batch once.

A batch is written to a folder of its own number and counts when its job is committed there, so a batch that a restarted
stream plays again is either left out, being there, or written anew over what a killed one has left. Readers read
committed batches only. Columns may be added over time; older batches have null in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


class Appender:
    """What foreachBatch calls. `at` belongs to one stream, whose checkpoint numbers the batches."""

    def __init__(self, at: str):
        self.at = at

    def folder(self, batch: int) -> str:
        return f"{self.at}/batch={batch}"

    def committed(self, spark: SparkSession, batch: int) -> bool:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder(batch)}/_SUCCESS")
        return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if not self.committed(rows.sparkSession, batch):
            rows.write.mode("overwrite").parquet(self.folder(batch))


def appending(rows: DataFrame, sink: Appender, checkpoint: str) -> DataStreamWriter:
    """The stream's writer, to be started."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def appended(spark: SparkSession, at: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches, with `batch`."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(at)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    paths = [f"{at}/{n}" for n in sorted(names) if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{at}/{n}/_SUCCESS"))]
    whole = T.StructType([*schema, T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).option("basePath", at).parquet(*paths) if paths else spark.createDataFrame([], whole)
