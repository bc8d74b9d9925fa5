"""Harmonic packing of tokenised documents into fixed-capacity sequences.

Class j holds lengths in (C/(j+1), C/j]; every sequence of class j takes exactly j
pieces, so a worker fills sequences of a class by counting. Documents are cut so
that pieces end at class bounds: a whole sequence of C tokens while one is left,
then the longest floor(C/j) that fits, until at most `tail` tokens remain as a last
piece. Classes thus waste less than j tokens per sequence (nothing where j divides
C), tail classes under `tail`. Sequences are numbered from counts per class and
block. Pieces past a class's last full sequence, fewer than j per class, are packed
together first-fit decreasing.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ranked, table

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(2)
def _encoder(path: str):
    """Text -> ids of the vocabulary file at `path`.

    The ranks beside it, if it has them, are the same vocabulary for a faster
    encoder with the same ids. Texts that hold a special token's string go to the
    full tokenizer, which is loaded when the first such text comes.
    """
    import json
    import os

    @lru_cache(1)
    def full():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    slow = lambda text: full().encode(text, add_special_tokens=False).ids
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
    del table_

    def encode(text: str):
        return slow(text) if any(s in text for s in special) else fast.encode_to_numpy(text)

    return encode


def cut_lengths(total: int, capacity: int, tail: int) -> list[int]:
    """Piece lengths of a document: each but a last one of at most `tail` is floor(capacity / j) for some j."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest > tail:
        j = -(-capacity // rest)
        while capacity // j > rest:
            j += 1
        out.append(capacity // j)
        rest -= capacity // j
    return out + [rest] * (rest > 0)


def _pieces(path: str, end_id: int, capacity: int, tail: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            out, where = [[], [], [], []], []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                ids = np.append(np.asarray(encode(text), np.uint32), np.uint32(end_id)).astype("<u4")
                start = 0
                for n in cut_lengths(len(ids), capacity, tail):
                    where.append(k)
                    for column, value in zip(out, (start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids))):
                        column.append(value)
                    start += n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], names=names)
    return run


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each of the lengths, which are given in decreasing order."""
    room, out = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), len(room))
        if b == len(room):
            room.append(capacity)
        out.append((b, capacity - room[b]))
        room[b] -= n
    return out


def pack_documents(documents: DataFrame, capacity: int = 1024, end_id: int = 0, vocabulary: str | None = None, tail: int = 32) -> DataFrame:
    """Pack (doc_id, text) rows into sequences of at most `capacity` tokens.

    Returns a row per piece: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset). A document is its token ids and then `end_id`; a null text
    is empty and gives one piece of `end_id`. Repeated rows are packed each; a null
    doc_id stays null. Other columns are ignored. No rows give no pieces. The pieces
    packed apart are under j per class, `capacity` classes: a constant number.
    """
    spark = documents.sparkSession
    path = vocabulary or vocabulary_path()
    rows = materialize(
        documents.select("doc_id", "text").mapInArrow(
            _pieces(path, end_id, capacity, tail), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
        ),
        "pieces",
    )
    kind = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    numbered = ranked(rows.withColumn("kind", kind), ["kind"], ["doc_id", "start", "ids_crc32"], ["doc_id", "start", "ids_crc32"], "rank")
    sizes = {int(r["kind"]): int(r["n"]) for r in rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    first, whole = {}, 0
    for j in sorted(sizes):
        first[j] = whole
        whole += sizes[j] // j
    plan = F.broadcast(spark.createDataFrame([(j, first[j], sizes[j] // j * j) for j in sizes], "k long, first long, filled long"))
    met = materialize(numbered.join(plan, F.col("kind") == F.col("k"), "left"), "numbered")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # offsets in a sequence: its pieces are at most `capacity`
    from pyspark.sql import Window as W

    before = W.partitionBy("sequence_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    full = met.filter("rank < filled").withColumn("sequence_id", (F.col("first") + F.floor(F.col("rank") / F.col("kind"))).cast("long"))
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(columns)
    rest = met.filter("rank >= filled").select("doc_id", "start", "length", "ids_crc32", "doc_tokens").orderBy(F.desc("length"), "doc_id", "start").toPandas()
    spots = first_fit_decreasing(rest["length"].tolist(), capacity)
    left = [
        (None if pd.isna(d) else int(d), int(s), int(n), int(c), int(t), whole + b, o)
        for (d, s, n, c, t), (b, o) in zip(rest.itertuples(index=False, name=None), spots)
    ]
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return full.unionByName(spark.createDataFrame(left, kinds))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
