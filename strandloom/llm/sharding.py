"""Best-fit-decreasing sharding of indivisible groups.

Groups of one size are interchangeable, so the packing is exact on the histogram
of group sizes: `best_fit` walks sizes downwards and lets each run of equal sizes
enter the bin with the tightest remaining capacity, kept in a balanced tree. The
driver sees one row per distinct size (at most sqrt(2 * total bytes) of them),
never a group; groups then find their bin by their rank within their size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ranked, table


class _Tree:
    """Treap of (remaining capacity, bin): a balanced search tree with best-fit lookup."""

    def __init__(self):
        self.root, self.seed = None, 0x2545F491

    def _rand(self) -> int:
        self.seed = (self.seed * 1103515245 + 12345) & 0x7FFFFFFF
        return self.seed

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            t[2], right = self._split(t[2], key)
            return t, right
        left, t[1] = self._split(t[1], key)
        return left, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, None, None, self._rand()]), right)

    def pop_best(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least (remaining, bin) with remaining >= size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        t, parent = right, None
        while t[1] is not None:
            parent, t = t, t[1]
        if parent is None:
            right = t[2]
        else:
            parent[1] = t[2]
        self.root = self._merge(left, right)
        return t[0]


def best_fit(sizes: list[tuple[int, int]], capacity: int, limit: int | None = None):
    """Best-fit decreasing over (size, count) pairs, largest size first.

    Returns (runs, bins): runs are (size, first rank, end rank, bin). A size above
    `capacity` gets a bin of its own. None if more than `limit` bins are needed.
    """
    tree, bins, runs = _Tree(), 0, []
    for size, count in sizes:
        done = 0
        while done < count:
            found = tree.pop_best(size)
            if found is None:
                if limit is not None and bins >= limit:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            room, b = found
            take = count - done if size == 0 else min(count - done, room // size)
            runs.append((size, done, done + take, b))
            done += take
            tree.add((room - take * size, b))
    return runs, bins


def balanced(sizes: list[tuple[int, int]], shards: int):
    """Runs over exactly `shards` bins with sizes near equal.

    A group larger than an even share of what remains takes a shard alone; the
    others are packed under the least capacity, raised from the even share in
    doubling steps and then narrowed, at which best fit needs no more bins.
    """
    rest, left, runs = [list(x) for x in sizes], shards, []
    start: dict[int, int] = {}
    total = sum(s * c for s, c in rest)
    while left > 1 and rest and rest[0][0] * left > total:
        size = rest[0][0]
        rank = start.get(size, 0)
        left -= 1
        runs.append((size, rank, rank + 1, left))
        start[size], total = rank + 1, total - size
        rest[0][1] -= 1
        if not rest[0][1]:
            rest.pop(0)
    if rest:
        low = max(-(-total // left), rest[0][0])
        step, high = 0, low
        while (found := best_fit(rest, high, left)) is None:
            low, step = high + 1, max(1, step * 2, high >> 14)
            high += step
        for _ in range(8):
            if low >= high:
                break
            mid = (low + high) // 2
            tried = best_fit(rest, mid, left)
            if tried is None:
                low = mid + 1
            else:
                found, high = tried, mid
        runs += [(s, start.get(s, 0) + a, start.get(s, 0) + b, k) for s, a, b, k in found[0]]
    return runs


def _assign(groups: DataFrame, pack) -> DataFrame:
    spark = groups.sparkSession
    ranks = ranked(groups, ["size"], ["key"], ["key"], "rank")
    histogram = groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).toPandas()
    sizes = sorted(((int(s), int(n)) for s, n in zip(histogram["size"], histogram["n"])), reverse=True)
    runs = pack(sizes)
    plan = spark.createDataFrame(
        pd.DataFrame(runs, columns=["_size", "_first", "_end", "bin"]).astype("int64"),
        "_size long, _first long, _end long, bin long",
    )
    on = (F.col("size") == F.col("_size")) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_end"))
    return ranks.join(plan, on).select("key", "size", "bin")


def pack_groups(groups: DataFrame, capacity: int) -> DataFrame:
    """Pack groups (key, size) into the fewest bins of `capacity` that best-fit decreasing finds.

    Returns (key, size, bin). `key` must be unique and not null; a size above the
    capacity gets its own bin; an empty table gives an empty result.
    """
    return _assign(groups, lambda sizes: best_fit(sizes, capacity)[0])


def shard_documents(documents: DataFrame, shards: int, overhead: int = 8) -> DataFrame:
    """Shard (doc_id, text) rows into `shards` shards of near equal bytes, equal texts together.

    Size is the text's UTF-8 bytes plus `overhead`; a null text is empty but forms
    a group apart from the empty text. Repeated rows and null ids are rows like any
    others. Other columns are ignored. An empty table gives no rows. Slots number a
    shard's rows from 0 without gaps.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        documents.select(
            F.col("doc_id"),
            (F.octet_length(text) + overhead).cast("long").alias("bytes"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("key"),
        ),
        "sizes",
    )
    groups = materialize(rows.groupBy("key").agg(F.sum("bytes").alias("size")), "groups")
    placed = _assign(groups, lambda sizes: balanced(sizes, shards))
    met = rows.join(placed.select("key", F.col("bin").cast("int").alias("shard")), "key")
    return ranked(met, ["shard"], ["key", "doc_id"], ["key", "doc_id"], "slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select(
        "doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
