"""Connected components of an edge table by alternating large-star and small-star rounds.

What a task holds of the edges is first made into stars, so that few rounds are left: each plans some
ten shuffles and joins on the driver, whose memory grows with the plans and the threads that run them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, release, remove

#: Nodes that a task joins at once, about; some 150 bytes each.
BLOCK_NODES = 1 << 18


def _stars(batches):
    """Edges (u, v) with u > v in, edges of the same components out: each node of a block with the smallest it reaches there."""
    above: dict = {}

    def root(x):
        while x in above:
            if above[x] in above:
                above[x] = above[above[x]]
            x = above[x]
        return x

    def close():
        nodes = list(above)
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["u", "v"])

    for batch in batches:
        kind = batch.schema.types[0]
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                above[max(u, v)] = min(u, v)
        if len(above) > BLOCK_NODES:
            yield close()
            above.clear()
    if above:
        yield close()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for all nodes of ``edges`` (a, b).

    Nodes without an edge are absent; loops and repeated edges do no harm. Each round joins and
    aggregates by node and is written to the shared folder, so lineage stays short; the number of
    rounds grows with the logarithm of the number of nodes. It ends when a round changes nothing, which
    only stars are left alone by.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path, schema = fresh_path(spark, "components"), edges.schema

    def written(found: DataFrame, at: str):
        """The edges as stars, read again, with their number and the sum of their hashes."""
        bounded_batches(found).mapInArrow(_stars, schema).write.parquet(at)
        stars = spark.read.schema(schema).parquet(at)
        return stars, stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    current, mark = written(edges, path)
    for k in range(rounds):
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        current, seen = written(small, f"{path}-{k}")
        remove(spark, path if k == 0 else f"{path}-{k - 1}")
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    release(spark)
    roots = current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


