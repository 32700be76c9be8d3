"""Lanczos eigenvectors, self-expression, exact linkage, diagonal mixtures, reclustering and checkpoints against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_clusterings import agreed, plain_linkage, planted
from tokenloom.operators import clusters, expression, lanczos, linkage, mixtures, spectral, stability
from tokenloom.sources.shared import Checkpoint


def graph(spark, w):
    i, j = np.nonzero(w)
    return spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(i, j)], "i long, j long, a double")


def communities(n=60, groups=3, seed=1, bridges=True):
    rng = np.random.default_rng(seed)
    same = np.arange(n)[:, None] % groups == np.arange(n) % groups
    w = np.triu((rng.random((n, n)) < np.where(same, 0.4, 0.02 if bridges else 0)) * rng.random((n, n)), 1)
    return w + w.T


def plain_vectors(w, k):
    s = 1 / np.sqrt(np.maximum(w.sum(axis=1), 1e-12))
    values, v = np.linalg.eigh(s[:, None] * w * s)
    return values[::-1][:k], v[:, ::-1][:, :k] * s[:, None]


def matrix(z, n, k):
    out = np.zeros((n, k))
    for r in z.collect():
        out[r["vec_id"]] = r["z"]
    return out


@pytest.mark.parametrize("bridges", [True, False])
def test_leading_equals_a_plain_eigensolver(spark, bridges):
    w = communities(bridges=bridges)
    s = 1 / np.sqrt(w.sum(axis=1))
    nodes = spark.range(60).withColumnRenamed("id", "vec_id").repartition(3)
    z, values, residual = lanczos.leading(lanczos.graph_product(graph(spark, s[:, None] * w * s)), nodes, 3)
    want, v = plain_vectors(w, 3)
    assert residual < 1e-3 and np.allclose(values, want, atol=1e-5)
    got = matrix(z, 60, 3) * s[:, None]
    assert np.allclose(got @ got.T, v @ v.T, atol=1e-4)  # eigenvectors are fixed but for a turn


def test_leading_of_tiny_and_closed_spaces(spark):
    w = np.diag([3.0, 2.0, 2.0, 1.0, 0.0])
    nodes = spark.range(5).withColumnRenamed("id", "vec_id")
    _, values, residual = lanczos.leading(lanczos.graph_product(graph(spark, w)), nodes, 4)
    assert np.allclose(values, [3, 2, 2, 1], atol=1e-6) and residual < 1e-4


def test_graph_labels_equal_those_of_plain_eigenvectors(spark):
    w = communities(groups=3)
    w[7] = w[:, 7] = 0  # a node without edges
    nodes = spark.range(60).withColumnRenamed("id", "vec_id")
    labels, residual = lanczos.graph_spectral(graph(spark, w), nodes, [3, 2])
    assert residual < 1e-3 and labels.groupBy("k").count().collect() and labels.where("k = 3").count() == 60
    z = plain_vectors(w, 3)[1]
    z[7] = 0
    plain = lanczos.k_means(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "vec_id long, z array<double>"), [3])
    assert agreed(labels.where("k = 3"), plain) == 1.0
    truth = nodes.where("vec_id <> 7").withColumn("label", F.col("vec_id") % 3)
    assert agreed(labels.where("k = 3"), truth) == 1.0


@pytest.mark.parametrize("kind", ["angular", "absolute"])
def test_exact_spectral_over_tiles(spark, monkeypatch, kind):
    monkeypatch.setattr(lanczos, "STRIP", 5)
    monkeypatch.setattr(lanczos.tiles, "__defaults__", (16,))
    rows = planted(spark)
    labels, residual = lanczos.exact_spectral(rows, [3], kind)
    assert residual < 1e-3 and agreed(labels, rows) == 1.0
    x = np.array([r["u"] for r in spectral.unit_rows(rows).orderBy("vec_id").collect()])
    w = spectral.kernel(x, x, kind)
    y = lanczos.kernel_product(rows, kind)(rows.select("vec_id", F.array(F.col("vec_id").cast("double"), F.lit(1.0)).alias("x")), 2)
    got = {r["vec_id"]: r["y"] for r in y.collect()}
    assert np.allclose([got[i] for i in range(90)], w @ np.c_[np.arange(90), np.ones(90)])


def test_landmarks_agree_with_the_whole_affinity(spark):
    """2,000 rows around 8 centres that overlap: 512 landmarks against all columns."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 16))
    rows = spark.createDataFrame([(i, (centres[i % 8] + rng.normal(size=16) * 0.6).tolist(), i % 8) for i in range(2000)], "vec_id long, embedding array<double>, label int").repartition(4)
    exact, residual = lanczos.exact_spectral(rows, [8])
    assert residual < 1e-3 and agreed(spectral.spectral(rows, 8), exact) > 0.9


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(0)
    for trial in range(150):
        n, axes = int(rng.integers(2, 200)), int(rng.integers(1, 15))
        d = rng.normal(size=(n, axes))
        if trial % 5 == 0 and n > 4:
            d[3] = d[2]
        y, alpha = d[0] + rng.normal(size=axes) / 10, 10 ** rng.uniform(-3, 0)
        w = np.zeros(n)
        for j, c in expression.lasso_row(d, y, 0, alpha).items():
            w[j] = c
        slope = d @ (y - w @ d) / axes
        assert w[0] == 0 and np.abs(slope[1:]).max() <= alpha * (1 + 1e-6)
        assert np.allclose(slope[w != 0], alpha * np.sign(w[w != 0]), rtol=1e-6)


@pytest.mark.parametrize("method, amount", [("lasso", 0.001), ("omp", 3)])
def test_self_expression_finds_planted_subspaces(spark, method, amount):
    rng = np.random.default_rng(3)
    bases = [np.linalg.qr(rng.normal(size=(12, 2)))[0] for _ in range(3)]
    points = [(i, (bases[i % 3] @ rng.normal(size=2)).tolist(), i % 3) for i in range(150)]
    rows = spark.createDataFrame(points, "vec_id long, embedding array<double>, label int")
    axes = rows.select("vec_id", F.col("embedding").alias("y"))
    labels, edges, _ = expression.expression_clusters(rows, method, 12, amount, [3], axes=axes)
    assert agreed(labels, rows) > 0.95
    assert edges.where("i = j").count() == 0


def test_axes_equal_plain_principal_axes_and_sweep(spark):
    rows = planted(spark, 60)
    axes, share = expression.similarity_axes(rows, 3)
    _, x = spectral.landmark_rows(rows)
    f = spectral.kernel(np.array([r["u"] for r in spectral.unit_rows(rows).orderBy("vec_id").collect()]), x, "angular")
    f -= f.mean(axis=0)
    power, v = np.linalg.eigh(f.T @ f)
    got = np.array([r["y"] for r in axes.orderBy("vec_id").collect()])
    assert np.allclose(got @ got.T, f @ v[:, ::-1][:, :3] @ v[:, ::-1][:, :3].T @ f.T, atol=1e-8)
    assert np.allclose(share, power[::-1][:3] / power.sum())
    told = expression.sweep(rows, [("omp", 3, 2), ("lasso", 2, 0.001)], [2, 3]).collect()
    assert len(told) == 4 and all(r["n_edges"] > 0 and -1 <= r["silhouette"] <= 1 for r in told)


@pytest.mark.parametrize("seed", range(2))
def test_exact_linkage_equals_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(linkage, "TILE", 7)
    monkeypatch.setattr(linkage, "STRIP", 3)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.arccos(np.clip(u @ u.T, -1, 1))
    got = linkage.complete_linkage(rows, [1, 2, 5, 8], top=8).collect()
    for k in (1, 2, 5, 8):
        parts = {}
        for r in got:
            if r["k"] == k:
                parts.setdefault(r["label"], set()).add(r["vec_id"])
        assert sorted(parts) == list(range(len(parts)))
        assert {frozenset(p) for p in parts.values()} == plain_linkage(d, k)
    assert {r["vec_id"] for r in got} == set(range(40))


def test_exact_linkage_of_copies_few_and_no_rows(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i < 12 else [0.0, 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["label"] for r in linkage.complete_linkage(rows, [2], top=2).collect()}
    assert [got[i] for i in range(20)] == [0] * 12 + [1] * 8
    assert {r["label"] for r in linkage.complete_linkage(rows.limit(1), [3]).collect()} == {0}
    assert linkage.complete_linkage(rows.limit(0), [3]).count() == 0
    with pytest.raises(ValueError, match="raise top"):
        linkage.complete_linkage(rows, [9], top=8)


def test_diagonal_mixture_equals_plain_rounds(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, s, size=(80, 3)) for m, s in ((0, 1), (3, 0.5), (-4, 2))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, y array<double>").repartition(5)
    start = mixtures.Mixture(np.full(3, 1 / 3), x[[0, 90, 200]].copy(), np.ones((3, 3)))
    got, history, good = mixtures.fitted(rows, start, 60, 1e-9)
    w, m, v = start
    told = []
    for _ in range(len(history)):
        dens = np.array([[np.log(w[c]) - 0.5 * sum(np.log(2 * np.pi * v[c, a]) + (p[a] - m[c, a]) ** 2 / v[c, a] for a in range(3)) for c in range(3)] for p in x])
        total = np.logaddexp.reduce(dens, axis=1)
        told.append(total.mean())
        r = np.exp(dens - total[:, None])
        n = r.sum(axis=0)
        w, m = n / n.sum(), (r.T @ x) / n[:, None]
        v = (r.T @ x**2) / n[:, None] - m**2 + mixtures.FLOOR
    assert good and np.allclose(history, told, atol=1e-7) and all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    assert np.allclose(got.means, m, atol=1e-5) and np.allclose(got.variances, v, atol=1e-5)
    each = mixtures.posterior(rows, got).collect()
    assert len(each) == 240 and all(1 <= r["effective_k"] <= 3 + 1e-9 for r in each)
    one = mixtures.diagonal_summary(rows, 3).first()
    assert one["n"] == 240 and one["active"] == 3 and one["converged"]


def test_reclustering_resumes_and_tells_errors(spark, tmp_path):
    rows, calls = planted(spark), []

    def fit(v):
        calls.append(v.count())
        if len(calls) == 3:
            raise RuntimeError("no luck")
        return v.select("vec_id", "label")

    path = f"{tmp_path}/study"
    first = stability.reclustered(rows, "truth", fit, 2, 0.8, path, {"k": 3}).orderBy("iter").collect()
    assert calls == [90, 72, 72] and first[0]["ari"] == 1.0 and first[0]["n"] == 72 and first[0]["active"] == 3
    assert first[1]["error"] == "RuntimeError: no luck" and first[1]["ari"] is None
    again = stability.reclustered(rows, "truth", fit, 3, 0.8, path, {"k": 3})
    assert calls == [90, 72, 72, 90, 72] and again.count() == 3
    assert stability.reclustered(rows, "truth", fit, 3, 0.8, path, {"k": 3}).count() == 3 and len(calls) == 5
    told = stability.summary(again).first()
    assert (told["completed"], told["failed"], told["ari_mean"]) == (2, 1, 1.0)
    with pytest.raises(ValueError, match="another configuration"):
        stability.reclustered(rows, "truth", fit, 3, 0.8, path, {"k": 4})


def test_checkpoint_steps_stand_once_written(spark, tmp_path):
    study = Checkpoint(spark, f"{tmp_path}/c", {"a": 1})
    assert study.done() == set() and study.read("x int").count() == 0
    study.write(0, spark.createDataFrame([(1,)], "x int"))
    study.write(0, spark.createDataFrame([(2,)], "x int"))  # stands already
    Checkpoint(spark, f"{tmp_path}/c", {"a": 1}).write(4, spark.createDataFrame([(3,)], "x int"))
    (tmp_path / "c" / ".step-left").mkdir()  # an interrupted write
    assert study.done() == {0, 4}
    assert sorted((r["x"], r["step"]) for r in study.read("x int").collect()) == [(1, 0), (3, 4)]


def test_exact_linkage_merges_copies_at_once(spark, monkeypatch):
    """Copies are all at distance zero from the one of least id, so rounds of pairs would take them one by one."""
    tables = []
    monkeypatch.setattr(linkage, "written", lambda df, write=linkage.written: tables.append(0) or write(df))
    x = [[1.0, 0.0, 0.0]] * 30 + [[0.0, 1.0, 0.0]] * 20 + [[0.0, 0.0, 1.0], [0.0, 0.6, 0.8], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    rows = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["k"]): r["label"] for r in linkage.complete_linkage(rows, [2, 3, 5], top=5).collect()}
    assert [got[i, 5] for i in range(54)] == [0] * 30 + [1] * 20 + [2, 2, 3, 4]
    assert len(tables) < 25


def test_dense_product_does_not_copy_rows(spark, monkeypatch):
    """Tiles meet without a copy of their rows for each tile that they meet, and a task adds up its share before it leaves."""
    monkeypatch.setattr(lanczos.tiles, "__defaults__", (4,))
    rows = planted(spark)
    y = lanczos.kernel_product(rows, "angular")(rows.select("vec_id", F.array(F.lit(1.0)).alias("x")), 1)
    plan = y._jdf.queryExecution().executedPlan().toString()
    assert y.count() == 90 and "CoGroup" not in plan and "Generate" not in plan
