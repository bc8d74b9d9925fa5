"""Aggregations over samples and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_sequence(samples: DataFrame, key: str) -> DataFrame:
    """Samples per sequence: key, n."""
    return samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def spread(samples: DataFrame, sequences: DataFrame, key: str) -> DataFrame:
    """Mean and population standard deviation of samples per sequence; sequences without one count as 0."""
    n = sequences.select(key).join(per_sequence(samples, key), key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("sequences"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("stddev"))


def density(samples: DataFrame, sequences: DataFrame, seq: str) -> DataFrame:
    """All samples over all bases."""
    bases = sequences.agg(F.sum(F.length(seq)).cast("long").alias("bases"))
    return samples.agg(F.count(F.lit(1)).alias("positions")).crossJoin(F.broadcast(bases)).select(
        "positions", "bases", (F.col("positions") / F.col("bases")).alias("density")
    )


def ends(closed: DataFrame, w: int) -> DataFrame:
    """How many closed syncmers have their least k-mer first, and how many last (both, if w is 1)."""
    return closed.agg(
        F.count_if(F.col("pos") == F.col("win")).alias("prefix"), F.count_if(F.col("pos") == F.col("win") + (w - 1)).alias("suffix"), F.count(F.lit(1)).alias("all")
    )


def ratio(numerator: DataFrame, denominator: DataFrame) -> DataFrame:
    """Rows of one sampling over rows of another."""
    a, b = (d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((numerator, "a"), (denominator, "b")))
    return a.crossJoin(F.broadcast(b)).select("a", "b", F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("ratio"))


def value_sum(samples: DataFrame) -> DataFrame:
    """Sum of values, widened so that it cannot overflow."""
    return samples.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))


def shared_values(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pairs of sequences with the number of distinct sampled values they share.

    Each side is reduced to distinct (key, value) before the join on value.
    """
    a, b = left.select(left_key, "value").distinct(), right.select(right_key, "value").distinct()
    return a.join(b, "value").groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias("shared"))


def median_table(timings: DataFrame, row: list[str], column: str, measure: str, names: list[str]) -> DataFrame:
    """Median of a measure by rows and pivoted columns."""
    return timings.groupBy(*row).pivot(column, names).agg(F.median(measure))


def extremes(timings: DataFrame, key: list[str], measure: str) -> DataFrame:
    return timings.groupBy(*key).agg(F.avg(measure).alias("mean"), F.min(measure).alias("least"), F.max(measure).alias("most"))
