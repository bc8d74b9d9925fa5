import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import common, decontam, minhash, sharding, substrings

from . import brute

VOCABULARY = [f"w{i}" for i in range(400)]
ODD = ["", None, "   \n", "one", "one two", "one two", "A b C d", "a B c D", "x" * 5000, "the " * 3000, "é ñ ß 漢字 ﬁ", "a\x0bb\x0cc\x1cd"]


def texts(seed, n=60):
    rng = random.Random(seed)
    passage = rng.choices(VOCABULARY, k=40)
    out = list(ODD)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and len(out) > len(ODD):
            w = rng.choice(out[len(ODD) :]).split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        else:
            w = rng.choices(VOCABULARY, k=rng.randint(1, 150))
        if rng.random() < 0.4:
            at = rng.randrange(len(w) + 1)
            a = rng.randrange(30)
            w[at:at] = passage[a : a + rng.randint(5, 40)]
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("label", F.lit(1)).withColumn("n", F.lit(2))


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = texts(seed)
    assert got(minhash.near_duplicates(frame(spark, rows), 4)) == brute.near_duplicates(rows, 4)


def test_near_duplicate_chain_in_one_bucket(spark):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(700):  # over two blocks of one group, similarities on both sides of the threshold
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    assert got(minhash.near_duplicates(frame(spark, rows), 4)) == brute.near_duplicates(rows, 4)


def test_blocks_hold_pairs_across_labels_once(spark):
    def dealt(labels):
        rows = [(1, i, l, i.to_bytes(4, "little")) for i, l in enumerate(labels)]
        return minhash._in_blocks(spark.createDataFrame(rows, "bucket long, rep long, label long, sig binary"), "bucket").collect()

    # members of one label and a stranger: in proportion to the members, not to their square
    assert len(dealt([5] * 2000 + [9])) == 2000 + 8 + 1
    rng = random.Random(1)
    labels = [5] * 600 + [-7] * 300 + [0] * 256 + [rng.randrange(100, 400) for _ in range(500)]
    pairs = {}
    for r in dealt(labels):
        pairs.setdefault(r["key"], []).append(r)
    met = {}
    for rows in pairs.values():
        x, y = [r for r in rows if r["low"] or r["same"]], [r for r in rows if not r["low"]]
        for a in x:
            for b in y:
                if a["label"] != b["label"] and (not a["same"] or a["rep"] < b["rep"]):
                    key = (min(a["rep"], b["rep"]), max(a["rep"], b["rep"]))
                    met[key] = met.get(key, 0) + 1
    want = {(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels)) if labels[i] != labels[j]}
    assert set(met) == want and set(met.values()) == {1}


def test_hot_keys_are_dealt_to_tasks(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 6000, 1).otherwise(F.col("id")).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    rows = rows.union(spark.createDataFrame([(None, 5)], "k long, v long"))
    counts = rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = common.hot_keys(counts, ["k"], "n")
    assert got(hot) == [(1, 12)]
    keyed = counts.select("k", (F.col("k") * 2).alias("x")).filter("k % 5 > 0")
    by = F.monotonically_increasing_id()
    for how in ("inner", "left", "left_semi"):
        out = common.dealt_join(rows, keyed, ["k"], hot, by, how)
        want = rows.join(keyed, ["k"], how)
        assert out.columns == want.columns
        assert out.exceptAll(want).count() == want.exceptAll(out).count() == 0
    assert common.hot_keys(counts.filter("n < 0"), ["k"], "n").count() == 0


def test_near_duplicates_of_many_copies(spark):
    rng = random.Random(4)
    base = rng.choices(VOCABULARY, k=100)
    rows = [(i, " ".join(base)) for i in range(1500)] + [(1500 + i, " ".join([*base, f"e{i}"])) for i in range(700)] + [(3000, "some other text of few words")]
    out = got(minhash.near_duplicates(frame(spark, rows), 4))
    assert out == [(i, len({tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)}), 0 if i < 3000 else 3000, i in (0, 3000)) for i, t in rows]


def test_near_duplicates_odd_rows(spark):
    long = " ".join(VOCABULARY)
    rows = [(5, long), (5, long), (3, long + " end"), (None, long), (None, "alone here it is"), (7, None), (9, "twin a b c d"), (9, "other text of the same id")]
    out = got(minhash.near_duplicates(frame(spark, rows), 4).select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("component_id", F.lit(-1)), "kept"))
    assert out == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (-1, 3, False), (-1, -1, False), (7, 7, True), (9, 9, True), (9, 9, True)])
    assert minhash.near_duplicates(frame(spark, []), 4).count() == 0
    kept = minhash.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "label", "n"]
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [3, 7, 9]


def test_least_matches_keep_the_threshold():
    floor = minhash.least_matches(0.8, 1e-6)
    assert len(floor) == 5 and (floor < 0.8 * 32 * (1 + minhash.np.arange(5))).all() and floor[-1] > 80


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, short):
    rng = random.Random(3)
    rows = texts(4)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(13, 40)))) for i in range(12)] + [(40, None), (41, "")]
    items += [(50, "w1 w2"), (51, "W3"), (52, " ".join(VOCABULARY[5:12]))] if short else []
    for i in range(20):
        item = rng.choice(items[:12])[1].split()
        a = rng.randrange(len(item))
        text = rng.choices(VOCABULARY, k=30) + [x.upper() + "," for x in item[a : a + rng.randint(8, 40)]] + rng.choices(VOCABULARY, k=300)
        rows.append((1000 + i, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert got(decontam.decontaminate(frame(spark, rows), bench)) == sorted(brute.decontaminate(rows, items))
    clean = decontam.drop_contaminated(frame(spark, rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - brute.leaked(rows, items)


def test_decontamination_odd_rows(spark):
    text = " ".join(VOCABULARY[:20])
    bench = spark.createDataFrame([(None, text), (1, None)], "item_id long, text string")
    rows = frame(spark, [(1, text), (1, text), (None, text), (2, None)])
    out = decontam.decontaminate(rows, bench).select("n_hit", "n_items", "contaminated").collect()
    assert sorted(map(tuple, out)) == [(0, 0, False)] + [(20, 0, True)] * 3
    assert decontam.decontaminate(rows.limit(0), bench).count() == 0
    assert decontam.decontaminate(rows, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_passage_in_a_long_document(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    item = " ".join(VOCABULARY[100:140])
    cut = lambda a, b: " ".join(VOCABULARY[a:b])
    rows = [(1, f"{filler(3000)} {cut(110, 123)} {filler(2000)}"), (2, f"{filler(3000)} {cut(110, 122)} {filler(2000)}"), (3, filler(5000)), (4, None), (4, None), (5, f"short word {filler(200)}")]
    bench = spark.createDataFrame([(1, item), (2, "short word"), (3, None)], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_own", "_hit", "digest", "whole", "row", "a.b", "_digest", "hit", "item_id"):
        df = df.withColumn(c, F.lit(c))
    out = decontam.drop_contaminated(df, bench)
    assert out.columns == df.columns
    kept = out.collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 3, 4, 4, 5] and all(r["_own"] == "_own" and r["a.b"] == "a.b" for r in kept)
    hits = {r["doc_id"]: r["n_hit"] for r in decontam.decontaminate(df, bench).collect()}
    assert hits == {1: 13, 2: 0, 3: 0, 4: 0, 5: 2}


def test_hits_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(decontam, "RANGE", 10)
    rows, items = texts(6), [(1, " ".join(VOCABULARY[:60])), (2, "w1 w2")]
    rows.append((500, " ".join(VOCABULARY[:60] + VOCABULARY[300:340] + VOCABULARY[20:50])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontam.decontaminate(frame(spark, rows), bench)) == sorted(brute.decontaminate(rows, items))
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert got(decontam.decontaminate(frame(spark, rows), bench)) == sorted(brute.decontaminate(rows, items))


def test_hits_too_many_to_broadcast(spark, monkeypatch):
    rows, items = texts(5), [(f"b{i}", t) for i, t in texts(6) if t]
    rows += [(1000 + i, rows[20][1]) for i in range(40)] + [(2000 + i, None) for i in range(40)]
    docs, bench = frame(spark, rows), spark.createDataFrame([*items, ("own", rows[20][1])], "item_id string, text string")
    want, kept = got(decontam.decontaminate(docs, bench)), list(map(tuple, decontam.drop_contaminated(docs, bench).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    assert any(r[-1] for r in want) and len(kept) < len(rows)
    assert got(decontam.decontaminate(docs, bench)) == want
    key = lambda r: (r[0], r[1] or "")
    assert sorted(map(tuple, decontam.drop_contaminated(docs, bench).collect()), key=key) == sorted(kept, key=key)


def test_decontamination_runs_no_python(spark):
    rows = frame(spark, texts(1, 3))
    plan = decontam.decontaminate(rows, rows.select(F.col("doc_id").alias("item_id"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 0)])
def test_cut_repeats(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_UNITS", hot)
    rows = texts(seed)
    out = substrings.cut_repeats(frame(spark, rows))
    assert got(out.drop("kept_text")) == sorted(brute.cut_repeats(rows))


def test_cut_repeats_odd_rows(spark):
    text = " ".join(VOCABULARY[:30])
    rows = [(4, text), (4, text), (2, "lead " + text), (None, text), (4, text + " tail"), (6, None)]
    out = substrings.cut_repeats(frame(spark, rows)).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, out)) == sorted([(4, 30, 30, ""), (4, 30, 30, ""), (2, 31, 0, "lead " + text), (-1, 30, 0, text), (4, 31, 30, "tail"), (6, 0, 0, "")])
    assert substrings.cut_repeats(frame(spark, [])).count() == 0


def test_many_equal_rows(spark, monkeypatch):
    made = []
    keep = substrings.materialize
    monkeypatch.setattr(substrings, "materialize", lambda df, what: made.append((what, t := keep(df, what), t.count())) or t)
    body = " ".join(VOCABULARY[:120])
    rows = [(7, body)] * 500 + [(100 + i, body) for i in range(500)] + [(5, "head " + body), (9, body + " tail"), (2000, "one " * 12), (2001, "one " * 12)]
    out = substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "n_words", "n_removed", "kept_text").count().collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["count"]) for r in out if r["doc_id"] < 100} == {(7, 120, 120, 500), (5, 121, 0, 1), (9, 121, 120, 1)}
    assert sum(r["count"] for r in out if r["doc_id"] >= 100 and r["n_removed"] == 120) == 500
    assert sorted(r["n_removed"] for r in out if r["doc_id"] >= 2000) == [0, 0]
    sizes = {what: n for what, _, n in made}
    assert sizes["segments"] <= 510 * 110 and sizes["spots"] < 400  # in proportion to rows, whatever the copies


def test_sources_decide_and_the_rest_is_searched_again(monkeypatch):
    import numpy as np

    seen = []
    search = substrings.FMIndex.matching_statistics
    monkeypatch.setattr(substrings.FMIndex, "matching_statistics", lambda self, *a: seen.append((self.size, r := search(self, *a))) or r)
    rng = np.random.default_rng(3)
    span, sigma = 4, 5
    units = [rng.integers(1, sigma, rng.integers(4, 9)) for _ in range(60)]
    docs = rng.integers(0, 12, 60)
    fps = np.zeros(60, np.int64)  # one fingerprint: only the least document's units are sources
    text = np.concatenate([np.append(u, 0) for u in units])
    owner = np.repeat(np.arange(60), [len(u) + 1 for u in units])
    window = np.repeat(np.arange(60), [len(u) - span + 1 for u in units])
    begin = np.concatenate([np.flatnonzero(owner == k)[: len(u) - span + 1] for k, u in enumerate(units)])
    found = substrings.first_documents(text, owner, docs, fps, window, begin, sigma, span)
    keys = [tuple(text[b : b + span]) for b in begin]
    least = {}
    for key, w in zip(keys, window):
        least[key] = min(least.get(key, 99), docs[w])
    assert found.tolist() == [least[k] for k in keys]
    first = seen[0][1][0]
    assert (first == span).any() and (first < span).any()  # some windows are found among the sources, some only later
    assert seen[-1][0] < len(text) and (seen[-1][1][0] == span).all()


def test_matching_statistics():
    import numpy as np

    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 4, 300), 0)
    stream = rng.integers(1, 5, 200)
    index = substrings.FMIndex(text, 5, 6)
    ends = np.arange(1, 201)
    length, lo, hi = index.matching_statistics(stream, ends)
    hay = text.tolist()
    for e, n, a, b in zip(ends.tolist(), length.tolist(), lo.tolist(), hi.tolist()):
        count = lambda m: sum(hay[i : i + m] == stream[e - m : e].tolist() for i in range(len(hay) - m + 1))  # noqa: B023, E731
        assert n == max(m for m in range(0, min(6, e) + 1) if m == 0 or count(m))
        if n:
            assert b - a == count(n)


def test_sharding(spark):
    rows = texts(5, 200) + [(1000 + i, "same text of all") for i in range(50)] + [(None, "no id"), (None, None)]
    out = sharding.shard_documents(frame(spark, rows), 24).collect()
    assert len(out) == len(rows)
    for s in range(24):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    for key in {bytes(r["key"]) for r in out}:
        assert len({r["shard"] for r in out if bytes(r["key"]) == key}) == 1
    assert sum(r["bytes"] for r in out) == sum(len((t or "").encode()) + 8 for _, t in rows)
    assert sharding.shard_documents(frame(spark, []), 24).count() == 0


def plain_best_fit(sizes, capacity):
    room, out = [], []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        b = min(fits, key=lambda i: (room[i], i)) if fits else len(room)
        if not fits:
            room.append(max(capacity, s))
        room[b] -= s
        out.append((s, b))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_is_exact(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(0, 100), rng.randint(0, 10)]) for _ in range(rng.randint(0, 150))]
    counts = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
    runs, bins = sharding.best_fit(counts, 100)
    flat = [(s, b) for s, a, e, b in runs for _ in range(e - a)]
    assert sorted(flat) == sorted(plain_best_fit(sizes, 100))
    assert bins == len({b for _, b in plain_best_fit(sizes, 100)})


def test_balanced():
    rng = random.Random(1)
    sizes = [rng.randint(100, 3000) for _ in range(2000)] + [200_000]
    counts = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
    load = [0] * 24
    for s, a, e, b in sharding.balanced(counts, 24):
        load[b] += s * (e - a)
    assert sum(load) == sum(sizes) and max(load) == 200_000
    rest = sorted(load)[:-1]
    assert rest[-1] - rest[0] < 0.02 * rest[-1]


def test_pack_groups(spark):
    groups = spark.createDataFrame([(bytes([i]), 10 + i % 7) for i in range(60)], "key binary, size long")
    out = sharding.pack_groups(groups, 40).collect()
    load = {}
    for r in out:
        load[r["bin"]] = load.get(r["bin"], 0) + r["size"]
    assert len(out) == 60 and max(load.values()) <= 40
