"""Loaders, settings, reports and checkpoints; hand cases of token categories."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions.tokens import category
from tokenloom.operators import clusters, corpus, selection
from tokenloom.sources import tables


def test_digits_in_the_wide_sense(spark):
    tokens = ["x1", "²", "①", "x⁷", "½", "Ⅷ", "٣", "cat"]
    got = {r["t"]: r["c"] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", category(F.col("t")).alias("c")).collect()}
    assert {t: c == "NUMERIC" for t, c in got.items()} == {t: any(c.isdigit() for c in t) for t in tokens}


def test_samples_have_exactly_their_size(spark):
    rows = spark.range(503).withColumnRenamed("id", "vec_id")
    got = clusters.sampled(rows, 0.8, [0, 1, 2]).collect()
    for n in range(3):
        own = [r["vec_id"] for r in got if r["iter"] == n]
        assert len(own) == len(set(own)) == 402
    assert {r["vec_id"] for r in got if r["iter"] == 0} != {r["vec_id"] for r in got if r["iter"] == 1}


def test_flat_indexes_of_empty_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "a " * 9001), (5, "x")], "doc_id long, text string")
    asked = spark.createDataFrame([(0,), (1,), (2,), (4097,), (9001,), (9002,), (-1,), (None,)], "flat long")
    got = {(r["flat"], r["doc_id"], r["pos"]) for r in corpus.looked_up(asked, docs).collect()}
    assert got == {(0, 1, 0), (1, 1, 1), (2, 4, 0), (4097, 4, 4095), (9001, 4, 8999)}


def test_clusterings_are_validated(spark):
    rows = spark.createDataFrame([("ssc", 10, 1, 0), ("ssc", 20, 1, 1), ("omp", 10, 1, None)], "method string, k int, token_id long, label int")
    assert tables.clustering(rows, method="ssc", k=20).first()["label"] == 1
    with pytest.raises(KeyError, match="'k': 20"):
        tables.clustering(rows, method="ssc", k=30)
    with pytest.raises(ValueError, match="without a label"):
        tables.clustering(rows, method="omp", k=10)


def test_settings():
    assert tables.Settings.read({}) == tables.Settings()
    assert tables.Settings.read({"LOOM_CLUSTERS": "20", "LOOM_SHARE": "0.5"}, iterations=3) == tables.Settings(clusters=20, iterations=3, share=0.5)


def test_outputs_are_replaced_by_a_rerun(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double")
    for _ in range(2):
        tables.write_results(rows, f"{tmp_path}/one", f"{tmp_path}/mirror")
        tables.write_results(rows, f"{tmp_path}/odd", f"{tmp_path}/no", canonical=False)
        tables.write_report(rows, f"{tmp_path}/report")
        for n in (0, 1):
            tables.write_iteration(rows, f"{tmp_path}/steps", n)
    assert [spark.read.parquet(f"{tmp_path}/{p}").count() for p in ("one", "mirror", "odd")] == [2, 2, 2] and not Path(f"{tmp_path}/no").exists()
    lines = [json.loads(x) for p in Path(f"{tmp_path}/report").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["a"]) == [{"a": 1, "b": 0.5}, {"a": 2}]
    assert {(r["iteration"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/steps").groupBy("iteration").count().collect()} == {(0, 2), (1, 2)}
    assert tables.first_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/one", f"{tmp_path}/odd"]).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [f"{tmp_path}/none"])
    made = []
    for _ in range(2):
        assert tables.once(spark, f"{tmp_path}/cache", lambda: made.append(1) or rows).count() == 2
    assert made == [1]
    assert tables.text_report(rows) == "a  b\n1  0.5\n2  None"


def test_columns_fall_back(spark):
    rows = spark.createDataFrame([(1, 2)], "first int, X int")
    assert [rows.select(tables.column(rows, *n)).first()[0] for n in (("X",), ("Y", "X"), ("Y",))] == [2, 2, 1]


def test_category_files(spark, tmp_path):
    for name, text in (("list", '[{"cluster": 1, "category": "A"}, {"cluster": "2", "category": "B"}]'), ("flat", '{"1": "A", "2": "B"}')):
        Path(f"{tmp_path}/{name}.json").write_text(text)
        assert sorted(map(tuple, tables.categories(spark, f"{tmp_path}/{name}.json").collect())) == [(1, "A"), (2, "B")]


def test_small_columns(spark):
    r = spark.createDataFrame([("hierarchical_x", "SSC-Lasso", 0.004, "En")], "a string, b string, c double, d string").select(
        selection.without_prefix(F.col("a"), "hierarchical_").alias("rest"), selection.without_prefix(F.col("b"), "hierarchical_").alias("none"), selection.slug(F.col("b")).alias("slug"),
        selection.nulled(F.col("c"), 0.01).alias("nulled"), selection.found(F.col("d"), {"en": "blue"}, "grey").alias("found"), selection.folded(F.col("d"), {"En": "English"}).alias("folded"),
        selection.flat_key(d=F.lit(500), alpha=F.lit("0.0001")).alias("key"), selection.signed(F.lit(-0.5)).alias("signed"),
    ).first()
    assert tuple(r) == ("x", None, "ssc_lasso", None, "blue", "English", "d=500_alpha=0.0001", "-0.5000")


@pytest.mark.parametrize("below", [0.05, 1.0, 3.0, 50.0])
def test_pairs_under_a_loss_are_all_found_without_moving_all_pairs(spark, monkeypatch, below):
    monkeypatch.setattr(corpus, "BUCKETS", 64)  # most buckets hold several pairs
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, size=40) % 60) for _ in range(40)] + ["new york new york", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {(r["doc_id"], r["pos"]): r["loss"] for r in corpus.losses(docs, True).where(F.col("loss") < below).where("not repeated").collect()}
    found = corpus.eligible(docs, below)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["doc_id"], r["pos"]): r["loss"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("frequent", [1, 40, 1 << 19])
def test_document_losses_move_infrequent_pairs_alone(spark, monkeypatch, frequent):
    monkeypatch.setattr(corpus, "FREQUENT", frequent)
    monkeypatch.setattr(corpus, "BUCKETS", 64)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, size=40) % 60) for _ in range(40)] + ["new york new york", "one", "", None, "x y"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)] + [(3, "new york"), (None, "x y z")], "doc_id long, text string").repartition(3)
    want = {r["doc_id"]: r for r in corpus.losses(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("loss").alias("mean_loss"), F.count_if(F.col("loss") < 0.1).alias("zero_loss")).collect()}
    found = corpus.document_losses(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r for r in found.collect()}
    assert "SortMergeJoin" not in plan and got.keys() == want.keys()
    assert all(got[k]["n"] == want[k]["n"] and got[k]["zero_loss"] == want[k]["zero_loss"] and abs(got[k]["mean_loss"] - want[k]["mean_loss"]) < 1e-9 for k in want)
