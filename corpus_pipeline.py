"""From raw documents to packed training sequences.

Toxic documents go, then those that the quality rules reject; of near duplicates the first stays; repeated passages are
cut out; what is left is packed. Each stage gets the rows that its predecessor kept, reread from Parquet. All but the
last return the columns of documents; the last returns pieces (see talkweave.llm.packing.pack).

Null doc_ids are kept and judged by their texts, but have no part in cutting passages. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm.common import read, stored
from talkweave.llm.packing import packed_stage
from talkweave.llm.quality_rules import keep_good
from talkweave.llm.simhash import keep_first
from talkweave.llm.substring_dedup import cut_repeats
from talkweave.llm.toxicity import keep_civil

STAGES = [
    ("toxicity", keep_civil),
    ("quality rules", keep_good),
    ("simhash near-dedup", keep_first),
    ("substring dedup", cut_repeats),
    ("packing", packed_stage),
]

#: The kernel machine, fingerprints and packing can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
