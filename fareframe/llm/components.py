"""Connected components of an edge table, by union-find inside tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareframe.llm.scratch import ship, written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of each batch: (node, smallest node of its tree)."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        nodes = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"]
        )


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its smallest node.

    Union-find shrinks each task's edges to a forest. Large-star and small-star steps then hang every node under the
    smallest one it knows, until nothing changes: a number of rounds that grows with the logarithm of the longest path.
    Minima combine before the shuffle, so a node with very many edges is no hot spot. Each round is a written table.
    Edges with a null end and loops are left out; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    ship(spark)
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = written(edges.mapInArrow(_forest, "a long, b long"), f"{name}-0")  # a > b from here on
    before, step = None, 0
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            break
        before, step = state, step + 1
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = written(small.unionByName(down.withColumnRenamed("m", "b")).distinct(), f"{name}-{step}")
    found = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.unionByName(roots) if before else spark.createDataFrame([], "node long, component long")
