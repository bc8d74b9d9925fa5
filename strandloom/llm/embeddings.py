"""Embedding near-dedup by cross-polytope hashing with fast Hadamard rotations.

A vector is rotated by three rounds of random signs and a Walsh-Hadamard
transform; its hash is the nearest signed axis. A table's key joins `HASHES` such
hashes. Each vector enters its base bucket in every table, and its next-nearest
buckets as probes; a base member meets base members and probes of its bucket. A
pair found by base keys is passed on only by the first table that finds it.
Candidates are verified by cosine in double precision. Hashes per key follow the
counted vectors of the largest label, so that a bucket's load by chance stays
constant, and tables follow from what one table finds of simulated pairs at the
threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table
from .graph import components

TABLES, HASHES, PROBES = 10, 2, 4
#: Vectors that share a bucket of a table by chance, at most.
LOAD = 0.25


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, of a power-of-two length, scaled to keep norms."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """int64 keys, (rows, tables, 1 + probes): the base key first, then the likeliest other keys."""
    n = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    signs = np.random.default_rng([seed, n]).choice([-1.0, 1.0], (tables, hashes, 3, n))
    out = np.empty((len(x), tables, 1 + probes), np.int64)
    near = min(n, 1 + probes)
    for t in range(tables):
        axes, gaps = [], []
        for h in range(hashes):
            y = x
            for s in signs[t, h]:
                y = hadamard(y * s)
            size = np.abs(y)
            order = np.argsort(-size, axis=1, kind="stable")[:, :near]
            top = np.take_along_axis(size, order, 1)
            axes.append(order * 2 + (np.take_along_axis(y, order, 1) < 0))
            gaps.append(top[:, :1] - top)
        base = sum(axes[h][:, 0] * (2 * n) ** h for h in range(hashes))
        out[:, t, 0] = base
        # a probe moves one hash to a later axis; the smallest losses come first
        loss = np.concatenate([g[:, 1:] for g in gaps], 1)
        moved = np.concatenate([base[:, None] + (axes[h][:, 1:] - axes[h][:, :1]) * (2 * n) ** h for h in range(hashes)], 1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t, 1 : 1 + best.shape[1]] = np.take_along_axis(moved, best, 1)
        out[:, t, 1 + best.shape[1] :] = base[:, None]
    return out


def found_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of rows of `codes` meets, by table: base to base, or base to probe either way."""
    return (a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)


def simulated_pairs(size: int, cosine: float, pairs: int = 1000, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and others at `cosine` to them."""
    rng = np.random.default_rng([seed, size])
    x, z = rng.normal(size=(2, pairs, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


def choose(count: int, size: int, cosine: float, miss: float = 1e-3) -> tuple[int, int]:
    """(tables, hashes) for `count` vectors of `size` numbers, so that `miss` of the pairs at `cosine` are lost at most."""
    axes = 2 << max(1, int(size - 1).bit_length())
    hashes = HASHES
    while count > LOAD * axes**hashes and hashes * np.log2(axes) < 56:
        hashes += 1
    if size < 2:
        return 1, hashes
    a, b = (codes(v, 8, hashes) for v in simulated_pairs(size, cosine))
    rate = min(max(found_pairs(a, b).mean(), 1e-3), 0.999)
    return int(np.ceil(np.log(miss) / np.log1p(-rate))), hashes


def _keys(tables: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _keys_of(batch, tables, hashes)
    return run


def _keys_of(batch: pa.RecordBatch, tables: int, hashes: int) -> Iterator[pa.RecordBatch]:
    raw = batch.column(1).to_pylist()
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), 512):
            some = rows[at : at + 512]
            x = np.frombuffer(b"".join(raw[i] for i in some), np.float64).reshape(len(some), -1)
            found = codes(x / np.linalg.norm(x, axis=1)[:, None], tables, hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(found[:, :, 0].tolist(), pa.list_(pa.int64())), pa.array(found[:, :, 1:].reshape(len(some), -1).tolist(), pa.list_(pa.int64()))],
                names=["rep", "base", "probe"],
            )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as float64 bytes; only those with a finite, positive norm and no null component."""
    for batch in batches:
        keep, out = [], []
        for k, v in enumerate(batch.column(2).to_pylist()):
            if v and None not in v:
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    keep.append(k)
                    out.append(x.tobytes())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])


def _cosine(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for at in range(0, batch.num_rows, 4096):
                x, y = (np.array([np.frombuffer(r) for r in v[at : at + 4096]]) for v in (a, b))
                dot = np.einsum("ij,ij->i", x, y)
                keep[at : at + 4096] = dot >= least * np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
            yield batch.select([0, 1]).filter(pa.array(keep)).rename_columns(["u", "v"])
    return run


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """Links between (vec_id, embedding, label) rows of one label with cosine >= `least`.

    Returns (vec_id, n_links, component_id, kept), a row per input row. Vectors that
    are null, empty, zero or hold null or non-finite components, and rows without
    label or vec_id, link with nothing: 0 links, their own component, kept unless
    vec_id is null. Vectors of different lengths are not compared. Equal vectors of
    a label form one class, compared once; rows that repeat a vec_id count as
    vectors of their own. Other columns are ignored.
    """
    base = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    good = base.filter("vec_id is not null and label is not null and embedding is not null").mapInArrow(_pack, "vec_id long, label long, vec binary")
    rows = materialize(good.withColumn("key", F.sha2("vec", 256)), "vectors")
    reps = materialize(
        rows.groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
        .withColumn("rep", F.xxhash64("label", "key")),
        "classes",
    )
    # one row per length of vectors reaches the driver
    counts = reps.groupBy("label", F.length("vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).groupBy("size").agg(F.max("n").alias("n")).collect()
    most = max(counts, key=lambda r: (r["n"], r["size"]), default=None)
    tables, hashes = choose(most["n"], most["size"] // 8, least) if most else (1, HASHES)
    for r in counts:  # longer vectors may need more tables
        if r["size"] > most["size"]:
            tables = max(tables, choose(most["n"], r["size"] // 8, least)[0])
    keyed = materialize(reps.select("rep", "vec").mapInArrow(_keys(tables, hashes), "rep long, base array<long>, probe array<long>"), "keys").join(
        reps.select("rep", "label", F.length("vec").alias("size")), "rep"
    )
    bases = keyed.select("rep", "label", "size", "base", F.posexplode("base").alias("t", "code"))
    probes = keyed.select("rep", "label", "size", "base", F.posexplode("probe").alias("p", "code")).withColumn("t", F.floor(F.col("p") / PROBES).cast("int")).drop("p")
    both = bases.withColumn("probed", F.lit(False)).unionByName(probes.withColumn("probed", F.lit(True)))
    x, y = bases.alias("x"), both.alias("y")
    first = F.array_position(F.zip_with("x.base", "y.base", lambda a, b: a == b), F.lit(True))
    found = (
        x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("t", "code", "label", "size")])
        .filter((F.col("y.probed") & (F.col("x.rep") != F.col("y.rep")) & (first == 0)) | (~F.col("y.probed") & (F.col("x.rep") > F.col("y.rep")) & (first == F.col("x.t") + 1)))
        .select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()
    )
    vecs = reps.select("rep", "vec")
    met = found.join(vecs.select(F.col("rep").alias("a"), F.col("vec").alias("va")), "a").join(vecs.select(F.col("rep").alias("b"), F.col("vec").alias("vb")), "b")
    links = materialize(met.select("a", "b", "va", "vb").mapInArrow(_cosine(least), "u long, v long"), "links")
    labels = components(links)
    copies = reps.select("rep", "copies")
    ways = links.union(links.select("v", "u")).toDF("rep", "other").join(copies.toDF("other", "n"), "other").groupBy("rep").agg(F.sum("n").alias("others"))
    facts = materialize(
        reps.select("label", "key", "rep", "copies", "least").join(ways, "rep", "left").join(labels.toDF("rep", "comp"), "rep", "left")
        .select("label", "key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("comp"), "least"),
        "facts",
    )
    heads = facts.groupBy("comp").agg(F.min("least").alias("component_id"))
    facts = facts.join(heads, "comp").select("label", "key", "n_links", "component_id")
    linked = rows.select("vec_id", "label", "key").join(facts, ["label", "key"]).select("vec_id", "n_links", "component_id")
    rest = vectors.select("vec_id", "label", "embedding").filter(
        F.col("vec_id").isNull() | F.col("label").isNull() | F.col("embedding").isNull()
        | F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) | F.forall("embedding", lambda e: e == 0)
    ).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS node, vec_id AS reach FROM embeddings
  UNION
  SELECT r.node, l.w FROM r JOIN l ON l.u = r.reach
), c AS (SELECT node, min(reach) AS m FROM r GROUP BY node),
n AS (SELECT u, count(*) AS k FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
