"""Sharding by a hierarchical weighted hash tree.

The tree has three levels: regions, racks, shards. A row descends from the root: at each node every child draws a number
from a hash of the row's key and the child's own path, -ln(u) / weight, and the least draw wins, so a child is chosen in
proportion to its weight. A child's draw depends on nothing but the key, its path and its weight: where a weight changes,
a row moves only into (or out of) the subtree whose weight did, at every level, and all other draws stand. A node weighs what
its shards weigh together.

`key` law: the key and the tree decide, whatever else the table holds. `tree_of(n)` gives the tree for n shards: 2 regions
of 2 racks of 2 shards, and from the ninth on each further shard as a region of its own. A new region changes no other
weight, so one more shard takes rows only into itself; hung into an old rack it would draw rows into the whole rack.

Places in a shard (slots) are gapless and follow (doc_id, size, text_crc32). A shard is too large for one task, so rows are
dealt into ranges of these three, numbered within a range, and shifted by what the earlier ranges of the shard hold. Equal
rows are counted before they are shuffled and spread out again after it, so no range holds more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm.common import CRC_SQL, CRC_TABLE_SQL, buckets, read, stored

#: region -> rack -> shard -> weight.
Tree = dict[str, dict[str, dict[int, float]]]

SHARDS = 8
#: Shards of a tree as planned: regions, racks of a region, shards of a rack. Later ones are regions of their own.
PLAN = (2, 2, 2)
#: Equal rows are spread out in runs of this length.
RUN = 4096
DIGITS = 13


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    shard = 1 + max((s for racks in tree.values() for shards in racks.values() for s in shards), default=-1)
    return {**tree, f"own{shard}": {"0": {shard: weight}}}


def tree_of(shards: int) -> Tree:
    """The tree for a number of shards of weight 1. Fewer than the plan has: regions of their own only."""
    regions, racks, each = PLAN
    if shards < regions * racks * each:
        tree: Tree = {}
    else:
        tree = {str(r): {str(k): {(r * racks + k) * each + s: 1.0 for s in range(each)} for k in range(racks)} for r in range(regions)}
    for _ in range(shards - regions * racks * each * bool(tree)):
        tree = grown(tree)
    return tree


def children(tree: Tree) -> dict[str, list[tuple[str, str, float]]]:
    """path -> (path, name, weight) of its children of positive weight; the root's path is empty."""
    out: dict[str, list[tuple[str, str, float]]] = {"": []}
    for region, racks in tree.items():
        below = []
        for rack, shards in racks.items():
            at = f"{region}/{rack}"
            leaves = [(f"{at}/{s}", str(s), float(w)) for s, w in shards.items() if w > 0]
            if leaves:
                out[at] = leaves
                below.append((at, rack, sum(x[2] for x in leaves)))
        if below:
            out[region] = below
            out[""].append((region, region, sum(x[2] for x in below)))
    if not out[""]:
        raise ValueError("a tree needs a shard of positive weight")
    return out


def placed(key: Column, tree: Tree) -> Column:
    """The struct (region, rack, shard) where a key lies. A null key is a key like any other (the text 'null')."""
    below = children(tree)
    table = F.create_map(*[x for path, nodes in below.items() for x in (F.lit(path), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(n).alias("name"), F.lit(w).alias("weight")) for p, n, w in nodes]))])
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def draw(node: Column) -> Column:
        u = F.conv(F.substring(F.md5(F.concat(name, F.lit("|"), node["path"]).cast("binary")), 1, DIGITS), 16, 10).cast("double")
        return F.struct((-F.log((u + 0.5) / F.lit(16.0**DIGITS)) / node["weight"]).alias("draw"), node["path"].alias("path"), node["name"].alias("name"))

    def down(path: Column, use) -> Column:
        """use(child) for the child with the least draw, evaluated once."""
        return F.get(F.transform(F.array(F.array_min(F.transform(F.element_at(table, path), draw))), use), F.lit(0))

    return down(F.lit(""), lambda r: down(r["path"], lambda k: down(k["path"], lambda s: F.struct(r["name"].alias("region"), k["name"].alias("rack"), s["name"].cast("int").alias("shard")))))


def assigned(docs: DataFrame, tree: Tree, larger: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot, grown_shard of every row of docs; grown_shard: in `larger`.

    Null text: no bytes. Null doc_id: one key, so such rows share a shard. Repeated rows have slots of their own. Other
    columns are ignored. An empty table gives no rows. Slots are the rows' order by doc_id (nulls first), size and crc.
    """
    blob = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(blob) + 1).cast("long").alias("size"), F.crc32(blob).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    where = F.struct(placed(F.col("doc_id"), tree).alias("at"), (placed(F.col("doc_id"), larger)["shard"] if larger else F.lit(None).cast("int")).alias("grown_shard"))
    rows = rows.withColumn("w", where).repartitionByRange(buckets(docs), "doc_id", "size", "text_crc32")
    # Written once, so that both readers below see the same ranges.
    rows = stored(rows.select("doc_id", "size", "text_crc32", "n", "w.at.region", "w.at.rack", "w.at.shard", "w.grown_shard", F.spark_partition_id().alias("range")), "sharding-rows")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "range").agg(F.sum("n").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "range").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.join(starts, ["shard", "range"]).withColumn("first", F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    return runs.select("doc_id", "size", "text_crc32", "region", "rack", "shard", F.explode(F.sequence(F.col("first") + F.col("run"), F.col("first") + F.least(F.col("n"), F.col("run") + RUN) - 1)).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, tree: Tree, key: str = "doc_id") -> None:
    """The rows of docs as Parquet below path, a folder for each region, rack and shard. Any key column will do: with a
    digest of the text, equal texts share a shard. docs may have no columns of these three names."""
    at = placed(F.col(key), tree)
    docs.withColumn("_at", at).select("*", "_at.*").drop("_at").write.partitionBy("region", "rack", "shard").parquet(path)


def moves(docs: DataFrame, tree: Tree, larger: Tree, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose shard changes between two trees, with from_shard and to_shard."""
    both = docs.withColumn("from_shard", placed(F.col(key), tree)["shard"]).withColumn("to_shard", placed(F.col(key), larger)["shard"])
    return both.where("from_shard <> to_shard")


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    tree = tree_of(SHARDS)
    rows = assigned(read(spark, sf_dir, "documents"), tree, grown(tree))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def _descent(tree: Tree, out: str) -> str:
    nodes = ", ".join(f"('{up}', '{p}', {w!r}::DOUBLE)" for up, below in children(tree).items() for p, _, w in below)
    least = "(SELECT arg_min(n.path, (-ln((('0x' || left(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || n.path), {d}))::BIGINT + 0.5::DOUBLE) / pow(16::DOUBLE, {d})) / n.weight, n.path)) FROM {o} n WHERE n.up = {at})"
    at = lambda x: least.format(d=DIGITS, o=f"{out}_nodes", at=x)
    return f"""{out}_nodes(up, path, weight) AS (VALUES {nodes}),
{out}_1 AS (SELECT doc_id, {at("''")} AS node FROM ids), {out}_2 AS (SELECT doc_id, {at("node")} AS node FROM {out}_1), {out} AS (SELECT doc_id, {at("node")} AS path FROM {out}_2)"""


ORACLE_SQL = f"""
WITH ids AS (SELECT DISTINCT doc_id FROM documents), {_descent(tree_of(SHARDS), "p")}, {_descent(tree_of(SHARDS + 1), "q")},
crc AS (SELECT {CRC_TABLE_SQL} AS t),
d AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, ({CRC_SQL.format(text="coalesce(text, '')")})::BIGINT AS text_crc32 FROM documents, crc)
SELECT d.doc_id, size, text_crc32, 'key' AS law, string_split(p.path, '/')[3]::INT AS shard,
  row_number() OVER (PARTITION BY string_split(p.path, '/')[3] ORDER BY d.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  string_split(q.path, '/')[3]::INT AS grown_shard, string_split(p.path, '/')[1] AS region, string_split(p.path, '/')[2] AS rack
FROM d JOIN p ON d.doc_id IS NOT DISTINCT FROM p.doc_id JOIN q ON d.doc_id IS NOT DISTINCT FROM q.doc_id
"""
