"""Sequence sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.bases import dna_letters


def _missing(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)


def read_fasta(spark: SparkSession, path: str, records: int | None = None) -> DataFrame:
    """FASTA records as (record, name, seq). `records` keeps the first so many of the file order.

    A record is all the text up to the next line that begins with ">", so it must
    fit a task's memory; cut long ones with the `chunk` option of the operators. A
    path without files gives no rows.
    """
    if _missing(spark, path):
        return spark.createDataFrame([], "record long, name string, seq string")
    text = spark.read.text(path, lineSep="\n>").filter("trim(value) <> ''").withColumn("record", F.monotonically_increasing_id())
    if records is not None:
        text = text.orderBy("record").limit(records)
    head = F.split(F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"\A>", ""), "\n", 2)
    return text.select("record", F.trim(head[0]).alias("name"), F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """FASTQ records of four lines as (record, name, seq, quality). A path without files gives no rows.

    Files are split by Spark where a line begins with "@". A quality line may begin
    so too: the record is then two pieces, three lines and one, and the second is
    looked up by its number, which is the next one of its split or the first of the
    file's next split. Only such records are joined.
    """
    if _missing(spark, path):
        return spark.createDataFrame([], "record long, name string, seq string, quality string")
    text = spark.read.text(path, lineSep="\n@").select(
        F.regexp_replace("value", r"\r", "").alias("value"), "_metadata.file_path", "_metadata.file_block_start"
    )
    text = text.withColumn("record", F.monotonically_increasing_id())
    lines = F.split("value", "\n", -1)
    pieces = text.select("record", "file_path", "file_block_start", "value", F.size(lines).alias("n"))
    order = Window.partitionBy("file_path").orderBy("file_block_start")
    blocks = pieces.groupBy("file_path", "file_block_start").agg(F.min("record").alias("first"), F.max("record").alias("last"))
    after = blocks.select("last", F.lead("first").over(order).alias("next"))
    cut = pieces.filter("n = 3").join(after, F.col("record") == F.col("last"), "left").select(
        "record", "value", F.when(F.col("last").isNotNull(), F.col("next")).otherwise(F.col("record") + 1).alias("tail")
    )
    tails = pieces.filter("n = 1 or n = 2 and value like '%\\n'").select(F.col("record").alias("tail"), F.col("value").alias("rest"))
    whole = pieces.filter("n >= 4").select("record", "value").union(
        cut.join(tails, "tail").select("record", F.concat("value", F.lit("\n@"), "rest"))
    )
    return whole.select(
        "record", F.regexp_replace(F.trim(lines[0]), r"\A@", "").alias("name"), F.trim(lines[1]).alias("seq"), F.trim(lines[3]).alias("quality")
    )


def write_fasta(df: DataFrame, name: str, seq: str, path: str) -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def from_text(df: DataFrame, text: str, out: str = "seq", ambiguous: bool = False) -> DataFrame:
    """Add the DNA letters of a text column as a sequence."""
    return df.withColumn(out, dna_letters(F.col(text), ambiguous))


def from_codes(df: DataFrame, codes: str, out: str = "seq") -> DataFrame:
    """Add the sequence of an array of codes 0 to 3."""
    return df.withColumn(out, F.array_join(F.transform(codes, lambda c: F.substring(F.lit("ACTG"), c + 1, F.lit(1))), ""))


def lcg_bases(spark: SparkSession, n: int) -> DataFrame:
    """Deterministic pseudo-random bases (pos, letter), generated by all tasks."""
    # Multiplier, increment, modulus and letters of the generator.
    state = F.pmod(F.col("id") * F.lit(1103515245) + F.lit(12345), F.lit(1 << 32))
    at = F.pmod(F.shiftright(state, 16), F.lit(4)).cast("int")
    return spark.range(n).select(F.col("id").alias("pos"), F.substring(F.lit("ACGT"), at + 1, F.lit(1)).alias("letter"))


def lcg_sequence(spark: SparkSession, n: int) -> DataFrame:
    """The same as one row: (id, seq)."""
    rows = lcg_bases(spark, n).groupBy(F.lit(0).cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "letter"))).alias("b"))
    return rows.select("id", F.array_join("b.letter", "").alias("seq"))


def random_sequences(spark: SparkSession, count: int, length: int, seed: int = 0) -> DataFrame:
    """`count` random DNA sequences (id, seq), the same for the same seed and partitioning-free."""
    letter = lambda i: F.substring(F.lit("ACGT"), F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(4)).cast("int") + 1, F.lit(1))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "") if length else F.lit("")
    return spark.range(count).select("id", body.alias("seq"))


def write_samples(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_bench(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
