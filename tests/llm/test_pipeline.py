import importlib
import re

import pytest
from pyspark.sql import functions as F

from strandloom.llm import packing, pii, toxicity

from . import brute

SF = "/root/testdata/sf0.001"
pipeline = importlib.import_module("corpus_pipeline")


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents before and after each stage."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxicity(spark, stages):
    scored = rows(toxicity.score_toxicity(stages[0], spark.read.parquet(f"{SF}/labels.parquet")))
    assert set(rows(stages[1])) == {d for d, r in scored.items() if r["predicted"] == 0}


def test_near_duplicates(stages):
    want = {d for d, _, _, kept in brute.near_duplicates([(r["doc_id"], r["text"]) for r in stages[1].collect()], 5) if kept}
    assert set(rows(stages[2])) == want


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = brute.leaked([(r["doc_id"], r["text"]) for r in stages[2].collect()], items)
    assert set(rows(stages[3])) == set(rows(stages[2])) - gone


def test_personal_data(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for d, r in after.items():
        assert r["text"] == pii.redact(before[d]["text"], pii.base_spans(before[d]["text"])) or re.search("<(email|ip|card|phone)>", r["text"])
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])


def test_packing(stages):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.vocabulary_path())
    pieces = stages[5].collect()
    for d, r in rows(stages[4]).items():
        ids = full.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        own = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == d)
        assert sum(n for _, n, _ in own) == len(ids)
        assert all(brute.crc(ids[s : s + n]) == c for s, n, c in own)


def test_run(spark, stages):
    out = pipeline.run(spark, SF)
    assert out.columns == stages[5].columns
    assert out.agg(F.sum("length")).first()[0] == stages[5].agg(F.sum("length")).first()[0]


def test_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_nulls_and_repeats(spark):
    body = " ".join(f"w{i}" for i in range(50))
    rows = [(1, body), (1, body), (None, body), (2, None), (3, ""), (4, "call +1 (555) 010-9999 " + body[::-1]), (None, None), (5, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    for c in ("score", "predicted", "_own", "_hit", "_digest", "row", "new", "redacted", "_row", "component_id", "a.b"):
        df = df.withColumn(c, F.lit(9.0))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        got = out.collect()
        assert all(r[c] == 9.0 for r in got for c in df.columns[3:]), name
        if name != "near_duplicates":
            assert len(got) == len(rows), name
    assert pipeline.STAGES[-1][1](spark, df, SF).filter("start = 0").count() == len(rows)


def test_near_duplicates_judges_rows_not_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [
        (3, a), (5, a + " end"), (5, b), (5, b), (5, b + " end"),  # 5 repeats: once like 3, once unlike anything
        (9, c), (9, "quite another text under one id"), (None, c), (None, c + " end"),  # without id, like 9
        (None, d), (None, d), (None, "short"), (2, None), (4, None), (4, None), (4, " "),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = pipeline.drop_near_duplicates(spark, df, SF)
    assert out.columns == df.columns
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect())
    fives = [t for i, t in got if i == 5]
    assert len(fives) == 1 and fives[0] in (b, b + " end")
    want = [(3, a), (9, c), (9, "quite another text under one id"), (-1, d), (-1, "short"), (2, ""), (4, ""), (4, " ")]
    assert [x for x in got if x[0] != 5] == sorted(want)
    assert pipeline.drop_near_duplicates(spark, df.limit(0), SF).count() == 0


def test_near_duplicates_of_one_hot_id(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(50)], "doc_id long, text string")
    assert pipeline.drop_near_duplicates(spark, df, SF).count() == 50
