"""Connected components by alternating large-star and small-star steps, or at once if the edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import dealt_join, discard, hot_keys, materialize


#: Edges that one task writes in a round.
EDGES_PER_FILE = 500_000
#: Edges that one task joins by itself (about a megabyte); more take rounds.
FEW_EDGES = 1 << 16


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """`edges` written, with the count and checksum of what the write saw."""
    seen = Observation()
    out = materialize(
        edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")), "edges"
    )
    return out, (seen.get["n"], seen.get["s"] or 0)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node reached) for all the edges of one task."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            up[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in up], pa.int64())], names=["node", "label"])


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One step, and a written table it reads. The least neighbour is pre-aggregated and joined back, a hub's edges in several tasks."""
    both = edges if not large else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    met = dealt_join(both, least.drop("n"), ["u"], hot_keys(least, ["u"], "n"), F.col("v"))
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """Map every node of `edges` (u, v: long) to `label`, the least node it reaches.

    Returns (node, label) for nodes with a link other than to themselves; other
    nodes are their own label. Null ends are ignored. Each round is written to
    the shared folder, and only a row count and a checksum reach the driver.
    """
    now, mark = _written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if mark[0] <= FEW_EDGES:
        return now.coalesce(1).mapInArrow(_joined, "node long, label long")
    parts = mark[0] // EDGES_PER_FILE + 1  # edges never get more, so rounds need no more files
    while mark[0]:
        grown, read = _star(now, True)
        middle = materialize(grown.coalesce(parts), "edges")
        discard(read)
        shrunk, read = _star(middle, False)
        after, seen = _written(shrunk.coalesce(parts))
        discard(now, middle, read)
        now = after
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())
