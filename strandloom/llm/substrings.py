"""Substring dedup with compressed FM-indexes over word sequences.

1. An Arrow pass winnows each text: every window of `span` words has a fingerprint,
   the least hash of its k-grams. Fingerprints seen in more than one text are kept;
   a window whose fingerprint is not among them occurs in no other text. Equal texts
   need no search: all but those of the least doc_id are repeats as a whole.
2. Runs of windows with a shared fingerprint become segments. Equal segments are
   one unit with the least doc_id. A unit's shard follows from its fingerprint, so
   all occurrences of a window meet in one shard; a fingerprint with very many units
   is dealt out window by window instead.
3. Each shard builds an FM-index of its sources, the units of each fingerprint's
   least doc_id: a Burrows-Wheeler transform in a wavelet matrix of bit vectors with
   rank counts, and a bit vector that marks where suffixes begin to differ within
   `span` words; the suffix array itself is dropped. All other units are streamed
   against it: backward search gives the matching statistic at each window end. A
   window that reaches `span` has its first document among the sources. The units
   that keep a window below `span` are indexed by themselves and searched again.
   Intervals of windows with one first document are reported.
4. Windows seen in a document with a smaller doc_id are cut from their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize, table
from .words import forget, grams, pieces, row_of, scan

GRAM = 5
#: Words of units that one shard's index holds on average.
SHARD_WORDS = 400_000
#: Units above which a fingerprint is dealt out window by window.
HOT_UNITS = 4096
#: Windows in a segment at most.
RUN = 64


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        a = np.minimum(a[:-step], a[step:]) if len(a) > step else a[:0]
        have += step
    return a


def _spots(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in pieces(batch.column(2)):
                _, _, firsts, h = scan(buf, offsets)
                least = sliding_min(grams(h, GRAM), span - GRAM + 1)
                if not len(least):
                    continue
                row = row_of(firsts)
                row = np.where(row[: len(least)] == row[span - 1 :], row[: len(least)], -1)
                place = np.arange(len(least)) - firsts[:-1][row]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                begin = np.flatnonzero(new)
                age = np.arange(len(least)) - np.repeat(begin, np.diff(np.append(begin, len(least))))
                begin = np.flatnonzero(age % RUN == 0)
                n = np.diff(np.append(begin, len(least)))
                ok = row[begin] >= 0
                begin, n = begin[ok], n[ok]
                at = pa.array(row[begin] + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[begin].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(place[begin].astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["fp", "doc_id", "th", "at", "n"],
                )
    return run


def _segments(span: int):
    """Segments; the first of equal ones in a batch has the content and the least doc_id.

    Units that repeat in a batch are remembered by the task, which then sends them
    again only with a smaller doc_id: a passage of every third document costs a task
    a few rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            contents = []
            for k in range(batch.num_rows):
                words = batch.column(2)[k].as_py().encode().split()
                spots = batch.column(3)[k].values
                fp, at, n = (spots.field(c).to_numpy().tolist() for c in ("fp", "at", "n"))
                contents += [b" ".join(words[a : a + m + span - 1]) for a, m in zip(at, n)]
                doc, th = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for column, values in zip(columns, (fp, [doc] * len(fp), [th] * len(fp), at, n)):
                    column += values
            units = [hashlib.blake2b(c, digest_size=16).digest() for c in contents]
            least: dict[bytes, int] = {}
            often = set()
            for unit, doc in zip(units, columns[1]):
                if unit in least:
                    often.add(unit)
                    if doc < least[unit]:
                        least[unit] = doc
                else:
                    least[unit] = doc
            lowest: list[int | None] = []
            for k, unit in enumerate(units):
                doc = least.pop(unit, None)
                if doc is not None and sent.get(unit, doc + 1) <= doc:
                    doc = None
                if doc is None:
                    contents[k] = None
                elif unit in often:
                    sent[unit] = doc
                lowest.append(doc)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, kind) for c, kind in zip(columns, kinds)), pa.array(units, pa.binary()), pa.array(contents, pa.binary()), pa.array(lowest, pa.int64())],
                names=["fp", "doc_id", "th", "at", "n", "unit", "content", "doc"],
            )
    return run


def _single(span: int):
    """Units of hot fingerprints, window by window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for key, doc, content in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words = content.split(b" ")
                for j in range(len(words) - span + 1):
                    for column, value in zip(out, (key, doc, j, b" ".join(words[j : j + span]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["unit", "doc", "j", "content"]
            )
    return run


class BitVector:
    """Packed bits with a rank count per 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & low).astype(np.int64)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            self.levels.append((bit, BitVector(ones.astype(np.uint8))))
            self.zeros.append(int(len(values) - ones.sum()))
            values = np.concatenate([values[ones == 0], values[ones == 1]])
        symbols = np.arange(sigma)
        self.start = self._down(symbols, np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (bit, vector), zeros in zip(self.levels, self.zeros):
            ones = vector.rank(i)
            i = np.where((c >> bit) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] before position i[k]."""
        return self._down(c, i) - self.start[c]


class FMIndex:
    """Index of word sequences for patterns of up to `depth` symbols.

    `symbols` holds the sequences, each closed by symbol 0, and `docs` the document
    of each symbol. Suffixes are sorted by `depth` symbols, which is what backward
    search of such patterns needs; those equal so far form a group, of which the
    index keeps the beginning, as a bit, and the least document.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, depth: int, docs: np.ndarray | None = None):
        rank, have = symbols, 1
        while have < depth:
            step = min(have, depth - have)
            after = np.zeros_like(rank)
            after[:-step or None] = rank[step:]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
            have += step
        suffixes = np.argsort(rank, kind="stable")
        order = rank[suffixes]
        begins = np.concatenate([[True], order[1:] != order[:-1]])
        self.begins = BitVector(begins.astype(np.uint8))
        self.docs = None if docs is None else np.minimum.reduceat(docs[suffixes], np.flatnonzero(begins))
        self.bwt = WaveletMatrix(symbols[suffixes - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.size, self.depth = len(symbols), depth

    def least(self, lo: np.ndarray) -> np.ndarray:
        """The least document of the group at each `lo`, for patterns of `depth` symbols."""
        return self.docs[self.begins.rank(lo + 1) - 1]

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray):
        """Longest match, up to `depth`, that ends before each of `ends`, and its suffix interval."""
        length = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        alive = np.arange(len(ends))
        for step in range(1, self.depth + 1):
            at = ends[alive] - step
            c = np.where(at >= 0, stream[at], 0)
            a = self.first[c] + self.bwt.rank(c, lo[alive])
            b = self.first[c] + self.bwt.rank(c, hi[alive])
            ok = (c > 0) & (a < b)
            alive, a, b = alive[ok], a[ok], b[ok]
            lo[alive], hi[alive], length[alive] = a, b, step
        return length, lo, hi


def first_documents(text: np.ndarray, owner: np.ndarray, docs: np.ndarray, fps: np.ndarray, window: np.ndarray, begin: np.ndarray, sigma: int, span: int) -> np.ndarray:
    """The least document of each window of units, by matching statistics against indexes.

    `text` holds the units, each closed by 0, `owner` the unit of each symbol,
    `docs` and `fps` are the units' documents and fingerprints, and `window`, `begin`
    the unit and first symbol of each window.
    """
    order = np.argsort(fps, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], fps[order][1:] != fps[order][:-1]]))
    low = np.empty_like(docs)
    low[order] = np.repeat(np.minimum.reduceat(docs[order], cuts), np.diff(np.append(cuts, len(docs))))
    indexed = docs == low  # sources first
    found = docs[window]
    left = np.flatnonzero(~indexed[window])
    while len(left):
        part = indexed[owner]
        index = FMIndex(text[part], sigma, span, docs[owner[part]])
        missed = []
        for at in range(0, len(left), 1 << 16):
            some = left[at : at + (1 << 16)]
            length, lo, _ = index.matching_statistics(text, begin[some] + span)
            ok = length == span
            found[some[ok]] = index.least(lo[ok])
            missed.append(some[~ok])
        left = np.concatenate(missed)
        # what no source holds is searched among the units that hold it
        indexed = np.zeros(len(docs), bool)
        indexed[window[left]] = True
    return found


def _shard(span: int):
    def run(shard: pa.Table) -> pa.Table:
        units, docs, fps = shard.column("unit"), shard.column("doc").to_numpy(), shard.column("fp").to_numpy()
        names = np.frombuffer(b"".join(units.to_pylist()), np.uint64).reshape(-1, 2)
        order = np.lexsort((docs, names[:, 1], names[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (names[order[1:]] != names[order[:-1]]).any(1)
        once = order[new]  # each unit with its least document
        docs, fps = docs[once], fps[once]
        column = shard.column("content").combine_chunks().take(pa.array(once)).cast(pa.large_binary()).view(pa.large_string())
        for i, j, buf, offsets in pieces(column, 1 << 40):
            _, _, firsts, h = scan(buf, offsets)
        words, ids = np.unique(h, return_inverse=True)
        n = np.diff(firsts)
        text = np.zeros(len(ids) + len(n), np.int64)
        text[np.arange(len(ids)) + row_of(firsts)] = ids + 1  # a 0 closes each unit
        windows = np.maximum(n - span + 1, 0)
        window = np.repeat(np.arange(len(n)), windows)
        j = np.arange(len(window)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = np.repeat(np.cumsum(n + 1) - (n + 1), windows) + j
        found = first_documents(text, np.repeat(np.arange(len(n)), n + 1), docs, fps, window, begin, len(words) + 1, span)
        forget()
        head = np.ones(len(window), bool)
        head[1:] = (window[1:] != window[:-1]) | (found[1:] != found[:-1])
        a = np.flatnonzero(head)
        b = np.append(a[1:], len(window)) - 1
        return pa.table({
            "unit": units.combine_chunks().take(pa.array(once[window[a]])), "first": pa.array(j[a].astype(np.int32)),
            "last": pa.array((j[b] + 1).astype(np.int32)), "least": pa.array(found[a]),
        })
    return run


def _strip(span: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digest, kept_text = [], [], [], []
            whole = batch.column(2).to_pylist()
            for k in range(batch.num_rows):
                words = (batch.column(1)[k].as_py() or "").encode().split()
                cuts = batch.column(3)[k]
                kept = words
                if whole[k]:
                    kept = words if len(words) < span else []
                elif cuts.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    v = cuts.values
                    np.add.at(change, v.field("first").to_numpy(), 1)
                    np.add.at(change, v.field("end").to_numpy() + span - 1, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                joined = b" ".join(kept)
                total.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined.decode() if texts else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )
    return run


def cut_repeats(documents: DataFrame, span: int = 13, texts: bool = True) -> DataFrame:
    """Remove words covered by a window of `span` words that also starts under a smaller doc_id.

    Returns (doc_id, n_words, n_removed, kept_sha256, kept_text), a row per row of
    `documents` (doc_id, text); kept words are joined by one space, and kept_text is
    null unless `texts`. A null text has no words. Rows without doc_id lose nothing
    and take nothing from others; rows that repeat a doc_id are judged each on its
    own text, and not against each other. Texts under `span` words stay as they are.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    base = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")
    some = base.filter("doc_id is not null and text is not null")
    spots = some.mapInArrow(_spots(span), "fp long, doc_id long, th long, at int, n int")
    shared = materialize(
        spots.groupBy("fp").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).filter("lo < hi").select("fp"), "shared"
    )
    # equal texts have equal spots: once each, under the least doc_id
    spotted = materialize(
        spots.join(shared, "fp", "left_semi").groupBy("th", "at").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.min("doc_id").alias("doc_id")), "spots"
    )
    discard(shared)
    lists = spotted.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.collect_list(F.struct("fp", "at", "n")).alias("spots"))
    segments = materialize(
        some.join(lists, ["doc_id", "th"]).select("doc_id", "th", "text", "spots")
        .mapInArrow(_segments(span), "fp long, doc_id long, th long, at int, n int, unit binary, content binary, doc long"),
        "segments",
    )
    discard(spotted)
    units = segments.filter("content is not null").select("fp", "unit", "doc", "content")
    crowded = materialize(units.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT_UNITS).select("fp"), "crowded")
    single = materialize(
        units.join(crowded, "fp", "left_semi").select("unit", "doc", "content").mapInArrow(_single(span), "unit binary, doc long, j int, content binary")
        .withColumn("window", F.substring(F.unhex(F.sha2("content", 256)), 1, 16)),
        "single",
    )
    loose = single.groupBy("window").agg(F.min("doc").alias("doc"), F.first("content").alias("content"))
    dealt = units.join(crowded, "fp", "left_anti").unionByName(
        loose.select(F.xxhash64("window").alias("fp"), F.col("window").alias("unit"), "doc", "content")
    )
    size = units.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(1, int(size / 6 / SHARD_WORDS), spark.sparkContext.defaultParallelism)
    least = materialize(
        dealt.withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(shards))).groupBy("shard").applyInArrow(
            lambda t: _shard(span)(t), "unit binary, first int, last int, least long"
        ),
        "least",
    )
    one = single.select(F.col("unit").alias("owner"), "j", F.col("window").alias("unit")).distinct()
    whole = one.join(least, "unit").select(F.col("owner").alias("unit"), F.col("j").alias("first"), (F.col("j") + 1).alias("last"), "least")
    cuts = (
        segments.select("doc_id", "th", "at", "unit").join(least.unionByName(whole), "unit").filter(F.col("least") < F.col("doc_id"))
        .select("doc_id", "th", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("end")).distinct()
    )
    found = materialize(cuts.groupBy("th", "doc_id").agg(F.collect_list(F.struct("first", "end")).alias("cuts")), "cuts")
    discard(segments, crowded, single, least)
    copies = some.groupBy("th").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("th", "lo")
    facts = materialize(found.join(copies, "th", "full").select("th", F.col("doc_id").alias("own"), "cuts", "lo"), "facts")
    discard(found)
    met = base.join(facts, "th", "left").select(
        "doc_id", "text", F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False)).alias("whole"), F.when(F.col("doc_id") == F.col("own"), F.col("cuts")).alias("cuts")
    )
    bound_batches(spark)
    return met.mapInArrow(
        _strip(span, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), m AS (SELECT x, min(doc_id) AS lo FROM g GROUP BY x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (x) WHERE lo < doc_id),
k AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
