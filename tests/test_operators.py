import pytest
from pyspark.sql import functions as F

from strandloom.functions import bases, sql
from strandloom.operators import analytics, sketch
from strandloom.options import SketchOptions
from strandloom.plans import relational
from strandloom.sources import sequences

from . import naive

SEQS = ["ACGTGCTCAGAGACTCAG", "ACGTGCTCAGAGACTCAGAGGA", "", None, "AC", "A" * 60, "ACGTACGTACGT", "acgtNNACGTTGCAACGGTCATGACCNTAGACATTAGCA" * 3]
OPTIONS = [
    SketchOptions(5, 7), SketchOptions(5, 7, canonical=True), SketchOptions(3, 5, canonical=True, kind="closed"), SketchOptions(3, 5, kind="open"),
    SketchOptions(5, 7, canonical=True, ambiguous="skip"), SketchOptions(5, 7, canonical=True, all_windows=True), SketchOptions(1, 1),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SEQS)], "id long, seq string")


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("o", OPTIONS)
def test_engines_agree(df, o):
    arrow = rows(sketch.sketch(df, "seq", o))
    assert arrow == rows(relational.sketch(df, "seq", o, ["id"]).select("id", "win", "pos"))
    for chunk in (1, 3, 50):
        assert arrow == rows(sketch.sketch(df, "seq", o, chunk=chunk))


def test_against_definition(df):
    want = [(i, w, p) for i, s in enumerate(SEQS) for w, p in naive.dedup(naive.windows(s or "", 5, 7, True))]
    assert rows(sketch.canonical_minimizers(df, "seq", 5, 7)) == want


def test_one_evaluation_and_pushdown(spark, df, tmp_path):
    path = str(tmp_path / "t")
    df.withColumn("other", F.lit(1)).write.parquet(path)
    out = sketch.minimizers(spark.read.parquet(path), "seq", 5, 7, keep=["id"]).filter("id = 3")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,3)]" in plan and "other" not in plan


def test_super_kmers_tile(df):
    out = sketch.super_kmers(df, "seq", SketchOptions(5, 7, canonical=True)).collect()
    for i, s in enumerate(SEQS):
        mine = sorted((r["win"], r["end_win"], r["length"]) for r in out if r["id"] == i)
        if s and len(s) >= 11:
            assert mine[0][0] == 0 and mine[-1][1] == len(s) - 10
            assert all(a[1] == b[0] for a, b in zip(mine, mine[1:])) and all(x[2] == x[1] - x[0] + 10 for x in mine)
        else:
            assert not mine


@pytest.mark.parametrize("length", [5, 31, 33, 63, 64])
def test_value_types(spark, length):
    s = "ACGGTCA" * 20
    out = sketch.minimizers(spark.createDataFrame([(1, s)], "id int, seq string"), "seq", length, 3, value=True).collect()
    for r in out:
        v = int.from_bytes(r["value"], "big") if isinstance(r["value"], (bytes, bytearray)) else int(r["value"])
        assert v == sum(c << 2 * j for j, c in enumerate(naive.code(s[r["pos"] : r["pos"] + length])))


def test_hashes_and_one_minimizer(df):
    got = {r["id"]: r["pos"] for r in sketch.one_minimizer(df, "seq", 5).collect()}
    for i, s in enumerate(SEQS):
        h = [naive.kmer_hash(naive.code(s[j : j + 5]), False) >> 16 for j in range(len(s) - 4)] if s else []
        assert got[i] == (h.index(min(h)) if h else None)


def test_bases(spark):
    df = spark.createDataFrame([("ACTGacgtA",)], "s string")
    r = df.select(bases.reverse_complement(F.col("s")).alias("r"), bases.pack_bases(F.col("s")).alias("p"), bases.unpack_bases(bases.pack_bases(F.col("s")), F.length("s")).alias("u")).first()
    assert r["r"] == "TacgtCAGT" and bytes(r["p"]) == bytes([0b11100100, 0b10110100, 0]) and r["u"] == "ACTGACGTA"


def test_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nACG\n>two\r\nTT\r\n")
    got = [(r["name"], r["seq"]) for r in sequences.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("record").collect()]
    assert got == [("one x", "ACGTACG"), ("two", "TT")]
    assert sequences.read_fasta(spark, str(tmp_path / "a.fa"), 1).count() == 1
    assert sequences.read_fasta(spark, str(tmp_path / "none.fa")).count() == 0
    assert sequences.lcg_sequence(spark, 1000).first()["seq"] == "".join("ACGT"[((i * 1103515245 + 12345) % 2**32 >> 16) % 4] for i in range(1000))
    one = sequences.random_sequences(spark, 3, 50, 7).collect()
    assert [len(r["seq"]) for r in one] == [50] * 3 and one == sequences.random_sequences(spark, 3, 50, 7).repartition(3).orderBy("id").collect()
    assert sequences.from_codes(spark.createDataFrame([([0, 1, 2, 3],)], "c array<int>"), "c").first()["seq"] == "ACTG"
    bench = spark.createDataFrame([("a", 1.5)], "name string, s double")
    sequences.write_bench(bench, str(tmp_path / "b"))
    assert sequences.read_bench(spark, str(tmp_path / "b")).select("name", "s").collect() == bench.collect()


def test_adjacent_distinct(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([0, 1, 1, None, 2, 3, None, None, 4])], "k int, i int, v int")
    assert [r["v"] for r in relational.adjacent_distinct(df, ["k"], "i", "v").orderBy("i").collect()] == [0, 1, 2, 3, 4]


def test_sql_surface(spark, df):
    sql.register(spark)
    df.createOrReplaceTempView("seqs")
    got = spark.sql("SELECT canonical_minimizer_positions(seq, 5, 7) AS p FROM seqs WHERE id = 1").first()["p"]
    assert list(got) == [0, 7, 9, 15]
    assert [r["pos"] for r in spark.sql("SELECT pos FROM minimizers('ACGTGCTCAGAGACTCAG', 5, 7, false)").collect()] == [4, 5, 8, 13]


def test_analytics(spark, df):
    o = SketchOptions(3, 5, kind="closed")
    samples = sketch.sketch(df, "seq", o)
    r = analytics.ends(samples, 5).first()
    assert r["all"] == samples.count() and r["prefix"] + r["suffix"] >= r["all"]
    assert analytics.spread(samples, df, "id").first()["sequences"] == len(SEQS)


def test_stream(spark, df, tmp_path):
    from strandloom.streaming.stream import sketch_stream, windowed_counts

    df.withColumn("ts", F.timestamp_seconds(F.col("id") * 60)).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, seq string, ts timestamp").parquet(str(tmp_path / "in"))
    q = sketch_stream(source, "seq", SketchOptions(5, 7, canonical=True), ["id"]).writeStream.format("memory").queryName("m").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("m")) == rows(sketch.canonical_minimizers(df, "seq", 5, 7))
    counts = windowed_counts(sketch_stream(source, "seq", SketchOptions(5, 7), ["ts"]), "ts", "1 hour", "10 minutes")
    q = counts.writeStream.format("memory").queryName("c").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("c").agg(F.sum("n")).first()[0] == sketch.minimizers(df, "seq", 5, 7).count()


def test_stream_query_waits_for_its_end(spark, monkeypatch):
    from pyspark.sql.streaming import StreamingQuery

    from strandloom import queries

    wait = StreamingQuery.awaitTermination
    # a stream that outlasts any timeout: waiting with one gives up at once
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self) if timeout is None else False)
    sf = "/root/testdata/sf0.001"
    out = queries.QUERIES["stream_minimizers"](spark, sf)
    source = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", bases.dna_letters(F.col("text")).alias("seq"))
    assert rows(out) == rows(sketch.sketch(source, "seq", queries.C5)) != []
    assert out.inputFiles()  # from the shared folder, not from the driver's memory


def test_fasta_header_with_mark(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b">a b>c\r\nACGT\r\nAC\r\n>second\nGG\n>empty\n")
    out = sequences.read_fasta(spark, str(tmp_path / "x.fa")).orderBy("record").collect()
    assert [(r["name"], r["seq"]) for r in out] == [("a b>c", "ACGTAC"), ("second", "GG"), ("empty", "")]


@pytest.mark.parametrize("size", ["48b", "200b", "1m"])
def test_fastq(spark, tmp_path, size):
    import random

    rng, want = random.Random(3), []
    for i in range(120):
        n = rng.choice([0, 1, 5, 30])
        quality = "".join(rng.choices("@+>I#", k=n))
        want.append((f"r{i} x@y", "".join(rng.choices("ACGTN", k=n)), "@" + quality[1:] if n and i % 3 == 0 else quality))
    for name, part in (("a.fq", want[:70]), ("b.fq", want[70:])):
        (tmp_path / name).write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in part))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        out = sequences.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["name"], r["seq"], r["quality"]) for r in out) == sorted(want)
    assert sequences.read_fastq(spark, str(tmp_path / "none")).count() == 0


def test_one_long_row_is_spread_over_tasks(spark):
    row = sequences.random_sequences(spark, 1, 1000).select("id", F.repeat("seq", 2000).alias("seq"))
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(sketch.sketch(row, "seq", SketchOptions(21, 11), chunk=100_000)) == 1
    spread = sketch.sketch(row, "seq", SketchOptions(21, 11), chunk=100_000, spread=8)
    assert tasks(spread) > 4
    plain = sketch.sketch(row, "seq", SketchOptions(21, 11))
    assert spread.count() == plain.count() and spread.exceptAll(plain).count() == 0


def test_sql_functions_with_nulls_and_mixed_windows(spark):
    from strandloom.functions import sql

    sql.register(spark)
    text = "ACGTGCTCAGAGACTCAG"
    df = spark.createDataFrame([(1, text, 5, 7), (2, None, 5, 7), (3, text, 3, 3), (4, text, None, 3), (5, "", 5, 7)], "id int, s string, k int, w int")
    out = {r["id"]: r["p"] for r in df.selectExpr("id", "minimizer_positions(s, k, w) AS p").collect()}
    assert out[1] == [4, 5, 8, 13] and out[2] is None and out[4] is None and out[5] == []
    assert out[3] == [r["pos"] for r in sketch.minimizers(df.filter("id = 3").select("id", "s"), "s", 3, 3).orderBy("win").collect()]
