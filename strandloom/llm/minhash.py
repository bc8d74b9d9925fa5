"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One Arrow pass over the texts gives, per row, the size and a 128-bit digest of
   its shingle set and a MinHash signature. Equal sets form one class.
2. Signatures of class representatives are cut into bands; members of a band
   bucket are compared with a few centres of the bucket (never all pairs).
3. Candidate signatures are compared in batches; a pair is dropped as soon as the
   posterior probability of a similarity above the threshold falls below the miss
   probability. Survivors are verified on the full sets.
4. Buckets that still hold members of different components are compared across
   components only, block against block in memory: first signatures, which gives
   clusters of possible links, then full sets within each cluster. Only edges that
   connect something leave a task, and no link that could join components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, discard, hot_keys, materialize, table
from .graph import components
from .words import grams, mix, pieces, scan

BANDS, ROWS, BATCH = 32, 5, 32
_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows and each row's first, the total at the end."""
    _, _, firsts, h = scan(buf, offsets, lower=True)
    n = np.diff(firsts)
    rows = np.arange(len(n))
    long = np.maximum(n - width + 1, 0)
    g = grams(h, width)
    row = np.repeat(rows, long)
    at = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long) + np.repeat(firsts[:-1], long)
    value = g[at] if len(row) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = np.array([mix(np.array([_fold(h[firsts[i] : firsts[i + 1]])], np.uint64))[0] for i in short], np.uint64)
        row, value = np.concatenate([row, short]), np.concatenate([value, whole])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[keep], value[keep]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


def _fold(h: np.ndarray) -> np.uint64:
    out = len(h)
    for x in h.tolist():
        out = (out * 0xA0761D6478BD642F + x) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(out)


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint32 MinHash signatures, one row each; rows without shingles are all ones."""
    out = np.full((len(first) - 1, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        low, at = (value >> np.uint64(32)).astype(np.uint32), first[some]
        work = np.empty_like(low)
        for i in range(BANDS * ROWS):
            np.multiply(low, _A[i], out=work)
            work += _B[i]
            work ^= work >> np.uint32(15)
            out[some, i] = np.minimum.reduceat(work, at)
    return out


def digests(value: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each row's set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)]) for v in (mix(value), mix(value ^ np.uint64(0x5851F42D4C957F2D)))]
    return [s[first[1:]] - s[first[:-1]] for s in sums]


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, offsets in pieces(batch.column(1)):
                value, first = shingle_sets(buf, offsets, width)
                d = digests(value, first)
                sig = signatures(value, first)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.diff(first)), _long(d[0]), _long(d[1]), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "d0", "d1", "sig"],
                )
    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(ids), -1).astype(np.uint64)
        for b in range(BANDS):
            h = np.full(len(ids), b + 1, np.uint64)
            for x in sig[:, b * ROWS : (b + 1) * ROWS].T:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
            yield pa.RecordBatch.from_arrays([_long(h), pa.array(ids)], names=["bucket", "rep"])


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """For each whole batch compared, the fewest equal values that keep a pair.

    The similarity has a uniform prior, so after m of n equal values it is
    Beta(m + 1, n - m + 1); a pair goes if the mass above `threshold` is under `miss`.
    """
    x = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            logs = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(logs - logs.max())
            if p[x >= threshold].sum() >= miss * p.sum():
                out.append(m)
                break
    return np.array(out)


def _prune(floor: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in (2, 3))
            alive, same = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, least in enumerate(floor):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                same[alive] += (a[alive, cut] == b[alive, cut]).sum(1)
                alive = alive[same[alive] >= least]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(same[alive])], names=["a", "b", "same"]
            )
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in pieces(batch.column(1)):
                value, first = shingle_sets(buf, offsets, width)
                d = digests(value, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(first)), _long(d[0]), _long(d[1]), pa.array([value[x:y].tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())],
                    names=["doc", "n_shingles", "d0", "d1", "set"],
                )
    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).rename_columns(["u", "v"])
    return run


#: Members of a group compared at once: a block against a block.
BLOCK = 256


def _in_blocks(rows: DataFrame, group: str, *more: str) -> DataFrame:
    """Deal (group, rep, label, sig) to pairs of blocks, sorted so that each pair is a run of rows.

    Only members of different labels need to meet. A label with BLOCK members or more
    in a group has blocks of its own; the rest of the group shares blocks. A member
    goes to each pair of its block with a block that may hold other labels, so a
    group is sent as often as it has members across labels, over BLOCK, and no task
    needs more than two blocks of a group at a time.
    """
    from pyspark.sql import Window as W

    large = (F.col("_c") >= BLOCK).alias("large")
    own_label = F.when(F.col("_c") >= BLOCK, F.col("label")).otherwise(F.lit(0)).alias("own_label")
    sizes = materialize(rows.groupBy(group, "label").agg(F.count(F.lit(1)).alias("_c")).select(group, "label", "_c", large, own_label), "sizes")
    kinds = sizes.groupBy(group, "large", "own_label").agg(F.ceil(F.sum("_c") / BLOCK).cast("int").alias("blocks"))
    up_to = F.sum("blocks").over(W.partitionBy(group).orderBy("large", "own_label").rowsBetween(W.unboundedPreceding, 0))
    kinds = kinds.withColumn("begin", (up_to - F.col("blocks")).cast("int")).withColumn("total", F.sum("blocks").over(W.partitionBy(group)).cast("int"))
    placed = sizes.drop("_c").join(kinds, [group, "large", "own_label"]).drop("own_label")
    own = F.col("begin") + F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    met = dealt_join(rows, placed, [group, "label"], hot_keys(sizes, [group, "label"], "_c"), F.col("rep")).withColumn("own", own)
    others = F.filter(
        F.sequence(F.lit(0), F.col("total") - 1), lambda x: ~F.col("large") | (x < F.col("begin")) | (x >= F.col("begin") + F.col("blocks"))
    )
    dealt = met.withColumn("other", F.explode(others))
    key = F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(key.alias("key"), (F.col("own") < F.col("other")).alias("low"), (F.col("own") == F.col("other")).alias("same"), "rep", "label", "sig", *more)
    return dealt.repartition("key").sortWithinPartitions("key")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one key at a time, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    """Union-find over positions; starts from the given labels."""

    def __init__(self, label: np.ndarray):
        _, first, at = np.unique(label, return_index=True, return_inverse=True)
        self.up = first[at].tolist()

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _pairs(run: pa.Table, floor: np.ndarray):
    """Positions of the pairs of a run that differ in label and pass the sequential test, likeliest first."""
    low, same = run.column("low").to_numpy(), run.column("same").to_numpy()
    label = run.column("label").to_numpy()
    sig = np.frombuffer(b"".join(run.column("sig").to_pylist()), np.uint32).reshape(len(label), -1)
    x = np.flatnonzero(low | same)
    y = np.flatnonzero(~low)
    i, j = (v.ravel() for v in np.meshgrid(x, y, indexing="ij"))
    ok = (label[i] != label[j]) & (~same[i] | (i < j))
    i, j = i[ok], j[ok]
    equal = np.zeros(len(i), np.int64)
    for k, least in enumerate(floor):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        for at in range(0, len(i), 1 << 15):
            some = slice(at, at + (1 << 15))
            equal[some] += (sig[i[some], cut] == sig[j[some], cut]).sum(1)
        ok = equal >= least
        i, j, equal = i[ok], j[ok], equal[ok]
    order = np.argsort(-equal, kind="stable")
    return i[order].tolist(), j[order].tolist(), label


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])


def _near(floor: np.ndarray):
    """Edges that connect what the sequential test lets through, a forest per run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            if rows.num_rows > 1:
                i, j, _ = _pairs(rows, floor)
                if i:
                    rep = rows.column("rep").to_numpy()
                    forest = _Forest(np.arange(len(rep)))
                    yield _edges([(int(rep[x]), int(rep[y])) for x, y in zip(i, j) if forest.join(x, y)])
    return run


def _exact(floor: np.ndarray, percent: int):
    """Links verified on full sets, as many as connect what is linked, a forest per run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            if rows.num_rows > 1:
                i, j, label = _pairs(rows, floor)
                if not i:
                    continue
                rep, forest = rows.column("rep").to_numpy(), _Forest(label)
                sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
                found = []
                for x, y in zip(i, j):
                    if forest.find(x) != forest.find(y):
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                            forest.join(x, y)
                            found.append((int(rep[x]), int(rep[y])))
                yield _edges(found)
    return run


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6, orders: int = 4) -> DataFrame:
    """Near-duplicate classes of (doc_id, text) rows by word-shingle Jaccard similarity.

    Returns (doc_id, n_shingles, component_id, kept), a row per input row. Texts
    with fewer than `width` words have their whole sequence as one shingle; null,
    empty and blank texts have none and link with nothing. Rows that repeat a
    doc_id keep their own row. Rows without doc_id link with nothing, unless an
    equal text has one, and are never kept. Other columns are ignored. Any text
    length is handled whole. `miss` bounds the posterior of a pruned pair; the
    bands miss a pair at the threshold with probability 3e-6.
    """
    class_id = F.xxhash64("n_shingles", "d0", "d1")
    base = materialize(
        documents.select("doc_id", "text").mapInArrow(
            _sketch(width), "doc_id long, n_shingles long, d0 long, d1 long, sig binary"
        ),
        "sketch",
    )
    some = base.filter("n_shingles > 0")
    reps = materialize(
        some.groupBy("n_shingles", "d0", "d1").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
        .filter("doc is not null").withColumn("rep", class_id),
        "reps",
    )
    sigs = reps.select("rep", "sig")
    buckets = sigs.mapInArrow(_bands, "bucket long, rep long")
    crowded = materialize(
        buckets.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.min(F.struct(F.xxhash64("rep", F.lit(o)).alias("h"), F.col("rep").alias("c"))).alias(f"c{o}") for o in range(orders)],
        ).filter("n > 1").select("bucket", "n", F.array(*[F.col(f"c{o}.c") for o in range(orders)]).alias("centres")),
        "crowded",
    )
    hot = hot_keys(crowded, ["bucket"], "n")
    members = materialize(dealt_join(buckets, crowded.drop("n"), ["bucket"], hot, F.col("rep")), "members")
    pairs = (
        members.select("rep", F.explode("centres").alias("c")).filter("rep <> c")
        .select(F.greatest("rep", "c").alias("a"), F.least("rep", "c").alias("b")).distinct()
    )
    floor = least_matches(percent / 100, miss)
    needed = members.select("rep").distinct()
    wanted = reps.join(needed, "rep", "left_semi").select("doc", "rep")
    texts = documents.select(F.col("doc_id").alias("doc"), "text").join(wanted.select("doc").distinct(), "doc", "left_semi")
    # a doc_id may repeat with another text: a set belongs to the class that its own digest names
    sets = materialize(
        texts.mapInArrow(_sets(width), "doc long, n_shingles long, d0 long, d1 long, set binary")
        .select("doc", class_id.alias("rep"), "set").join(wanted, ["doc", "rep"], "left_semi").dropDuplicates(["rep"]).select("rep", "set"),
        "sets",
    )

    def survivors(found: DataFrame) -> DataFrame:
        met = (
            found.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
        )
        return met.mapInArrow(_prune(floor), "a long, b long, same long")

    def verified(found: DataFrame) -> DataFrame:
        met = (
            found.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
        )
        return materialize(met.mapInArrow(_verify(percent), "u long, v long"), "links")

    def apart(found: DataFrame, labels: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            found = found.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left")
        return found.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    stars = materialize(survivors(pairs), "stars")
    best = stars.groupBy("a").agg(F.max(F.struct("same", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    links = verified(best)
    labels = materialize(components(links), "labels")
    links = links.union(verified(apart(stars.select("a", "b"), labels)))
    labels = materialize(components(links), "labels")
    # buckets whose members are in different components: find who may be linked across them
    tagged = members.select("bucket", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", F.coalesce("label", "rep").alias("label")
    )
    mixed = tagged.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("mixed")).filter("mixed")
    left = dealt_join(tagged, mixed.select("bucket"), ["bucket"], hot, F.col("rep"), "left_semi").join(sigs, "rep")
    maybe = _in_blocks(left, "bucket").mapInArrow(_near(floor), "u long, v long")
    cluster = components(materialize(maybe, "maybe"))
    # then verify within those clusters, block by block, each set shipped once per block
    inside = cluster.select(F.col("node").alias("rep"), F.col("label").alias("bucket")).join(
        labels.withColumnRenamed("node", "rep"), "rep", "left"
    ).withColumn("label", F.coalesce("label", "rep"))
    more = materialize(_in_blocks(inside.join(sigs, "rep").join(sets, "rep"), "bucket", "set").mapInArrow(_exact(floor, percent), "u long, v long"), "links")
    if more.limit(1).count():
        labels = materialize(components(links.union(more)), "labels")
    discard(members, stars, crowded)
    classes = materialize(
        reps.select("rep", "doc", "n_shingles", "d0", "d1", "copies")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")),
        "classes",
    )
    discard(reps, sets)
    least = materialize(classes.groupBy("label").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    named = dealt_join(classes, least.drop("n"), ["label"], hot_keys(least, ["label"], "n"), F.col("rep"))
    on = ["n_shingles", "d0", "d1"]
    component = F.coalesce("least", "doc_id")
    # rows may be equal in all columns, so their place in the written table deals them
    met = dealt_join(base.drop("sig"), named.select(*on, "least"), on, hot_keys(classes, on, "copies"), F.monotonically_increasing_id(), "left")
    return met.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept")
    )


def keep_rows(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `documents` that a near-duplicate class keeps: one of each class, of its least doc_id.

    Rows are judged by their texts, whatever ids they repeat or lack: rows that share
    a doc_id but are not alike all stay. A row without doc_id stays only if no other
    row kept is like it. Texts without words are like nothing, but of rows with equal
    doc_id and text one stays.
    """
    # a row goes by a hash of what it holds, so ids may repeat or be missing
    row = F.xxhash64("doc_id", "text")
    classes = near_duplicates(documents.select(row.alias("doc_id"), "text"), width, percent)
    ids = documents.select(row.alias("_row"), "doc_id").distinct()
    best = (
        classes.select(F.col("doc_id").alias("_row"), "component_id").distinct().join(ids, "_row")
        .groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_row")).alias("best"))
        .select("best._row")
    )
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), row.alias("_row"), "doc_id", "text")
    kept = whole.join(best, "_row", "left_semi").dropDuplicates(["_row", "doc_id", "text"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`keep_rows` for a table whose doc_ids must come out unique: of rows that repeat a doc_id one stays."""
    rows = keep_rows(documents, width, percent)
    return rows.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(rows.filter("doc_id is null"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS sh FROM d)
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.c + nb.c - i)
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM d
  UNION
  SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach
), c AS (SELECT node, min(reach) AS m FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
