"""Groups of linked ids: union-find inside partitions, then stars until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.session import scratch_path


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: an equal forest of (node, smallest node)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in list(parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for low in range(0, len(pairs), 50_000):
        some = pairs[low : low + 50_000]
        yield pa.record_batch([pa.array([x for x, _ in some], pa.int64()), pa.array([y for _, y in some], pa.int64())], ["u", "v"])


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two long columns); the component is its smallest node.

    Each partition first replaces its links by a forest. Then large stars (every larger neighbour is
    tied to the smallest neighbour) and small stars (every smaller one is) alternate until the links
    stay the same, after about log(longest path) rounds. Smallest neighbours are aggregates and the
    ties are joins, so a node with a third of all links is reduced in each task and split in the
    join. A round's links are written to the shared scratch folder: a lost executor costs no round.
    No links give no rows; links of a node with itself and repeated links change nothing.
    """
    a, b = links.columns[:2]
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    edges = _written(pairs.mapInArrow(_local_roots, "u long, v long").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = _written(small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
