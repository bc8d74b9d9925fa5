"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as `spark.checkpoint.dir` names it.

    A temporary folder is made only where the session names none and all tasks run
    in the driver's process (local tests); elsewhere a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="strandloom-")
        atexit.register(shutil.rmtree, path, True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/strandloom-{what}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch sent to Python. Rows are never split, so one long text may exceed it.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a lower bound already."""
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH))
    if now and not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Cuts the lineage; a lost executor costs only the tasks it ran. The shuffle files
    that the write needed are deleted as it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    bound_batches(spark)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames made by `materialize`, once nothing reads them."""
    for df in frames:
        path = getattr(df, "_strandloom_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot that holds more than so many rows, and more than one in HOT_KEYS of all rows.
HOT_ROWS, HOT_KEYS = 512, 4096


def hot_keys(counts: DataFrame, on: list[str], count: str) -> DataFrame:
    """(on, _parts) for the hot keys of `counts`, one row per key, `count` the rows that hold it.

    At most HOT_KEYS keys are hot, so the result can be broadcast. `counts` is read
    twice: it should be a written table.
    """
    total = counts.agg(F.sum(count)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    return counts.filter(F.col(count) > limit).select(*on, F.ceil(F.col(count) / F.lit(limit)).cast("int").alias("_parts"))


def dealt_join(rows: DataFrame, keyed: DataFrame, on: list[str], hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """`rows` joined with `keyed`, one row per key, with the rows of `hot` keys dealt to several tasks.

    A row's part follows `by`, a whole number that must differ among the rows of a
    key and come out the same if a task is run again. `keyed` gets a copy of its
    row for each part, at most 2 * HOT_KEYS more rows in all.
    """
    hot = F.broadcast(hot)
    nameless = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])  # these match nothing, so any part will do
    part = F.coalesce(F.pmod(by, F.when(nameless, HOT_KEYS).otherwise(F.col("_parts"))).cast("int"), F.lit(0))
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    left = rows.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    right = keyed.join(hot, on, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


#: What is broadcast has at most so many bytes, counted first; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20


def attach(rows: DataFrame, facts: DataFrame, key: str, by: Column) -> DataFrame:
    """`rows` left joined with `facts`, a written table of one row per `key`: broadcast if it is small, else dealt."""
    wide = {"string": F.octet_length, "binary": F.octet_length, "array": lambda c: F.octet_length(F.to_json(c))}
    parts = [F.coalesce(wide[t.split("<")[0]](F.col(c)), F.lit(0)) if t.split("<")[0] in wide else F.lit(8) for c, t in facts.dtypes]
    size = facts.agg(F.sum(reduce(lambda a, b: a + b, parts) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts), key, "left")
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS)
    return dealt_join(rows, facts, [key], hot_keys(materialize(counts, "counts"), [key], "n"), by, "left")


def spread(spark: SparkSession) -> int:
    """Number of value-hash blocks used to number rows; follows the shuffle width."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, group: list[str], order: list[str], block_of: list[str], out: str) -> DataFrame:
    """Add `out`: a gapless 0-based rank within each `group`, without one task per group.

    Rows are dealt to hash blocks of `block_of`; a window numbers each (group,
    block), and offsets come from the small table of block counts. A hot group
    is thus spread over all blocks. The order over blocks is the block number,
    within a block it is `order`; equal rows are numbered in any order. The
    `group` columns must not be null.
    """
    from pyspark.sql import Window as W

    blocks = spread(df.sparkSession)
    block = F.pmod(F.xxhash64(*block_of), F.lit(blocks)).cast("int")
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
    )
    within = W.partitionBy(*group, "_block").orderBy(*order)
    numbered = rows.withColumn("_row", F.row_number().over(within) - 1)
    on = F.col("_block") == F.col("_b")
    for i, g in enumerate(group):
        on = (F.col(g) == F.col(f"_g{i}")) & on
    return (
        numbered.join(base, on)
        .withColumn(out, (F.col("_row") + F.col("_base")).cast("long"))
        .drop("_row", "_base", "_block", "_b", *[f"_g{i}" for i in range(len(group))])
    )
