"""Connected components of a table of links, by alternating stars.

Each round is two joins: the large star hangs every larger neighbour of a node on the node's smallest neighbour, the
small star does so with the smaller ones. Both keep the components and shrink their depth, so few rounds are needed.
A round's links are cut from their lineage with checkpoint(). The joins are sort-merge joins on the node, which adaptive
execution splits when one node has very many links; the smallest neighbour is a min() that combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import shared_dir


def _digest(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of its component, for every node that a link has. links: u, v (any order, repeats
    and self links allowed, nulls dropped). No links: no rows. Raises if `rounds` aren't enough, which would take a
    component with a path of about 2 ** rounds links."""
    shared_dir(links.sparkSession)
    now = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = _digest(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        now = small.checkpoint()
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the links need more rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Parts that the nodes of one component are dealt over when they get its name.
DEALS = 16


def least_names(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """node, component_id for each row of nodes (node, least): the smallest `least` of its component (roots: node, root, from
    components()); its own where no link has it. Nulls count last.

    A component may hold a third of all nodes. Its name is a min() that combines before the shuffle; then it is repeated for
    each of DEALS parts of the component, so that the join that hands it out has no row of all its nodes in one task.
    """
    linked = nodes.join(roots, "node")
    deal = F.pmod(F.xxhash64("node"), F.lit(DEALS)).cast("int")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id")).select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    named = linked.withColumn("deal", deal).join(names, ["root", "deal"]).select("node", "component_id")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
