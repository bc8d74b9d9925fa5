"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides are cut into words and hashed k-gram by k-gram; in each window of
k-grams the least hash is kept as a fingerprint. Any `span` words shared by a
document and an item lie over one same window of k-grams, so they share a
fingerprint. Texts that share one are then extended: their `span`-word windows
are compared with the items' windows word for word, and hit words are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, attach, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text whose hits are counted together; a long text is many such ranges.
RANGE = 1024


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


def _shifted(hashes: Column, by: int) -> Column:
    """Each element hashed with the one `by` places on; shorter by `by`."""
    n = F.size(hashes) - by
    return F.when(n > 0, F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b)))


def _least(hashes: Column, by: int) -> Column:
    n = F.size(hashes) - by
    return F.when(n > 0, F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(by + 1), n), lambda a, b: F.least(a, b)))


def _steps(width: int) -> list[int]:
    """Shifts that widen a window of 1 to `width` by doubling."""
    out, have = [], 1
    while have < width:
        step = min(have, width - have)
        out.append(step)
        have += step
    return out


def fingerprints(df: DataFrame, words: str, span: int, k: int) -> DataFrame:
    """Add `fps`: the distinct winnowing fingerprints of the array column `words`.

    Texts under `span` words give one fingerprint per window they can fill, down
    to none below `k` words.
    """
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    for step in _steps(k):
        df = df.withColumn("_h", _shifted(F.col("_h"), step))
    for step in _steps(span - k + 1):
        df = df.withColumn("_h", _least(F.col("_h"), step))
    return df.withColumn("fps", F.array_distinct(F.coalesce("_h", F.array().cast("array<long>")))).drop("_h")


def _windows(words: str, size: Column) -> Column:
    """(start, window) for every window of `size` words: the words joined by a space."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i - 1).cast("long").alias("at"), F.array_join(F.slice(F.col(words), i, size), " ").alias("window"))))


def _short_marks(words: str, size: int) -> Column:
    """The hash of every run of `size` words, as short items are anchored."""
    n = F.size(words) - size + 1
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.lit(-1), F.array_join(F.slice(words, i, size), " ")))
    return F.when(n > 0, every).otherwise(F.array().cast("array<long>"))


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 9) -> DataFrame:
    """(digest, n_hit, whole, ids) for each distinct text of `documents` with a hit; digest is the text's SHA-256.

    whole says whether a hit window has `span` words and is not a shorter item.
    ids are the item_ids as strings, sorted. See `decontaminate` for the rules.
    """
    items = materialize(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), word_list(F.col("text")).alias("words"))
        .filter("size(words) > 0").withColumn("size", F.least(F.size("words"), F.lit(span))),
        "items",
    )
    grams = materialize(
        items.select("item_id", "size", F.explode_outer(_windows("words", F.col("size"))).alias("g"))
        .select("item_id", "size", F.col("g.window").alias("window")).distinct(),
        "grams",
    )
    long = fingerprints(items.filter(f"size = {span}"), "words", span, k).select(F.explode_outer("fps").alias("fp")).filter("fp is not null")
    # a short item is anchored by the hash of its words as one gram of that many words
    short = items.filter(f"size < {span}").select(F.xxhash64(F.lit(-1), F.array_join("words", " ")).alias("fp"))
    marks = materialize(long.union(short).distinct(), "marks")
    sizes = [r[0] for r in items.select("size").filter(f"size < {span}").distinct().collect()]  # at most span - 1 rows
    small = marks.count() * 32 <= BROADCAST_BYTES

    texts = documents.select("text").filter("text is not null").withColumn("words", word_list(F.col("text")))
    texts = fingerprints(texts, "words", span, k)
    parts = [F.col("fps")]
    parts += [_short_marks("words", m) for m in sorted(sizes)]
    # explode_outer: a filter inferred from explode would be pushed below and repeat the hashing
    met = texts.select("text", F.explode_outer(F.concat(*parts)).alias("fp")).join(F.broadcast(marks) if small else marks, "fp", "left_semi")
    # candidates: each text that shares a mark, once
    found = materialize(met.select("text", F.sha2("text", 256).alias("digest")).groupBy("digest").agg(F.first("text").alias("text")), "candidates")

    every = sorted({*sizes, span})
    spans = found.withColumn("words", word_list(F.col("text"))).select("digest", "words")
    cut = [
        spans.select("digest", F.lit(m).alias("size"), F.explode_outer(_windows("words", F.lit(m))).alias("g")).select("digest", "size", "g.at", "g.window")
        for m in every
    ]
    windows = cut[0]
    for c in cut[1:]:
        windows = windows.union(c)
    keys = grams.select("window", "size").distinct()
    few = (grams.agg(F.sum(F.octet_length("window") + 32)).first()[0] or 0) <= BROADCAST_BYTES
    hits = materialize(windows.join(F.broadcast(keys) if few else keys, ["window", "size"]), "hits")
    # words covered by a hit window, each once: a window adds what the earlier ones of its text have not reached
    from pyspark.sql import Window as W

    ends = hits.groupBy("digest", "at").agg(F.max(F.col("at") + F.col("size")).alias("end"), F.max(F.col("size") == span).alias("whole"))
    # each range of a text is counted apart; a hit over a range's end counts in both, with its own part
    parts = ends.withColumn("range", F.explode(F.sequence(F.floor(F.col("at") / RANGE), F.floor((F.col("end") - 1) / RANGE)))).select(
        "digest", "range", "whole", F.greatest("at", F.col("range") * RANGE).alias("at"), F.least("end", (F.col("range") + 1) * RANGE).alias("end")
    )
    reach = F.max("end").over(W.partitionBy("digest", "range").orderBy("at", "end").rowsBetween(W.unboundedPreceding, -1))
    covered = parts.withColumn("_reach", F.coalesce(reach, F.lit(0))).groupBy("digest").agg(
        F.sum(F.greatest(F.col("end") - F.greatest("at", "_reach"), F.lit(0))).alias("n_hit"), F.max("whole").alias("whole")
    )
    named = (
        hits.select("digest", "window", "size").distinct().join(grams, ["window", "size"])
        .select("digest", "item_id").filter("item_id is not null").distinct()
        .groupBy("digest").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    )
    return covered.join(named, "digest", "left").select("digest", F.col("n_hit").cast("long").alias("n_hit"), "whole", "ids")


def decontaminate(documents: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 9, share: int = 20) -> DataFrame:
    """Benchmark hits of each document.

    `documents` has doc_id and text, `benchmark` has item_id and text; other columns
    are ignored. Returns (doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated), a row per document row; rows that repeat a doc_id keep their own
    row, judged on their own text. A null or empty text has no words and no hits.
    An item under `span` words, but not none, is one window; items without words
    hit nothing; hits of an item without item_id count as words, not as items.
    Contaminated means n_hit > 0 and share * n_hit >= n_words.
    """
    facts = materialize(benchmark_hits(documents, benchmark, span, k), "facts")
    rows = documents.select("doc_id", word_count(F.col("text")).alias("n_words"), F.sha2("text", 256).alias("digest"))
    out = attach(rows, facts, "digest", F.xxhash64("doc_id"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 9, share: int = 20) -> DataFrame:
    """The rows of `documents`, all columns as they are, that no benchmark passage has leaked into.

    A row goes if it holds any `span` words of an item, however long it is, or if
    `decontaminate` calls it contaminated: items of fewer words are too common for
    one hit in a long text to tell. Rows with a null text, and repeated rows, stay
    or go by their own text.
    """
    hits = materialize(
        benchmark_hits(documents, benchmark, span, k).select("digest", F.col("n_hit").alias("hit"), "whole", F.lit(True).alias("met")), "hits"
    )
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")).withColumn("digest", F.sha2("row.text", 256))
    met = attach(rows, hits, "digest", F.monotonically_increasing_id())
    clean = F.col("met").isNull() | (~F.col("whole") & (share * F.col("hit") < word_count(F.col("row.text"))))
    return met.filter(clean).select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 13) AS m FROM (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i+m-1], ' ') AS x
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)
), t AS (
  SELECT doc_id, m, i, array_to_string(w[i:i+m-1], ' ') AS x
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)
), h AS (SELECT t.doc_id, t.m, t.i, g.item_id FROM t JOIN g USING (m, x)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
n AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
