"""Spectral and complete-linkage clusterings, matching, adjusted information and the one-cluster sweep against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions.tokens import without_accents
from tokenloom.operators import clusters, fingerprints, models, spectral


def planted(spark, n=90, groups=3, dims=8, seed=4):
    rng = np.random.default_rng(seed)
    centres = np.eye(groups, dims)  # apart in absolute values, too
    rows = [(i, (centres[i % groups] + rng.normal(size=dims) * 0.05).tolist(), i % groups) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def agreed(labels, truth):
    return clusters.agreement(clusters.contingency(labels, truth)).first()["ari"]


@pytest.mark.parametrize("kind", ["angular", "absolute"])
@pytest.mark.parametrize("landmarks", [20, 512])
def test_spectral_finds_planted_clusters(spark, kind, landmarks):
    rows = planted(spark)
    assert agreed(spectral.spectral(rows, 3, kind, landmarks), rows) == 1.0


def test_spectral_embedding_equals_eigenvectors(spark):
    rows = planted(spark, 40)
    ids, x = spectral.landmark_rows(rows)
    w = spectral.kernel(x, x, "angular")
    s = 1 / np.sqrt(w.sum(axis=1))
    v = np.linalg.eigh(s[:, None] * w * s)[1][:, ::-1][:, :3]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {r["vec_id"]: r["z"] for r in spectral.spectral_embedding(rows, 3).collect()}
    z = np.array([got[i] for i in ids.tolist()])
    assert np.allclose(z @ z.T, v @ v.T, atol=1e-6)  # eigenvectors are fixed but for their signs


def test_sums_over_many_partitions(spark):
    rows = spectral.unit_rows(planted(spark).repartition(70))
    assert np.allclose(spectral.summed(rows, lambda x: np.array([len(x)]), (1,)), [90])


def plain_linkage(d, k):
    """At most k clusters by merging the pair of least largest distance, equal heights together."""
    parts = [[i] for i in range(len(d))]
    heights = []
    states = [[list(p) for p in parts]]
    while len(parts) > 1:
        h, a, b = min((max(d[i][j] for i in p for j in q), x, y) for (x, p), (y, q) in itertools.combinations(enumerate(parts), 2))
        parts[a] = parts[a] + parts.pop(b)
        heights.append(h)
        states.append([list(p) for p in parts])
    n = max(0, len(d) - k)
    while 0 < n < len(heights) and heights[n] == heights[n - 1]:
        n += 1
    return {frozenset(p) for p in states[n]}


@pytest.mark.parametrize("seed", range(4))
def test_complete_linkage_equals_plain(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(25, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for k in (1, 2, 5, 12, 25, 40):
        label = spectral.cut(25, spectral.complete_merges(d), k)
        assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())} == plain_linkage(d, k)


def test_complete_linkage_of_rows(spark):
    rows = planted(spark)
    for landmarks in (12, 512):
        assert agreed(spectral.complete_linkage(rows, [3], landmarks), rows) == 1.0
    each = clusters.agreement(spectral.linkage_bootstrap(rows, 3, 4), "iter").collect()
    assert len(each) == 4 and all(r["ari"] == 1.0 for r in each)
    copies = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r["label"] for r in spectral.complete_linkage(copies, [3]).collect()} == {0}


def test_odd_vectors(spark):
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for rows, n in ((odd, 3), (odd.where("false"), 0)):
        assert spectral.complete_linkage(rows, [2]).count() == n
        assert spectral.spectral(rows, 2).count() == n
        assert clusters.agreement(spectral.linkage_bootstrap(rows, 2, 2), "iter").count() == (2 if n else 0)


def test_power_iteration_parts_a_graph(spark):
    rng = np.random.default_rng(5)
    edges = [(a, b, float(0.9 + 0.1 * rng.random()) if a % 2 == b % 2 else 0.01) for a, b in itertools.permutations(range(20), 2)]
    # a little unlike in degree, so that the first vector is no fixed point
    edges = [(a, b, w * (2 if a % 2 and b % 2 else 1)) for a, b, w in edges]
    found = spectral.power_iteration(spark.createDataFrame(edges, "i long, j long, a double"), 2, 30)
    truth = spark.createDataFrame([(i, i % 2) for i in range(20)], "vec_id long, label int")
    assert agreed(found, truth) == 1.0


@pytest.mark.parametrize("shape", [(4, 4), (3, 5), (5, 3), (1, 4)])
def test_assignment_equals_all_permutations(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        gain = rng.integers(0, 9, size=shape).astype(float)
        a, b = shape
        if a <= b:
            best = max(sum(gain[i, p[i]] for i in range(a)) for p in itertools.permutations(range(b), a))
        else:
            best = max(sum(gain[p[j], j] for j in range(b)) for p in itertools.permutations(range(a), b))
        pairs = clusters.assignment(gain)
        assert len(pairs) == min(shape) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        assert sum(gain[i, j] for i, j in pairs) == best


def test_assigned_clusters(spark):
    cells = spark.createDataFrame([(0, 7, 5), (0, 8, 4), (1, 7, 5), (2, 9, 3)], "la int, lb int, n long")
    assert sorted(tuple(r)[:3] for r in clusters.assigned(cells).collect()) == [(0, 8, 4), (1, 7, 5), (2, 9, 3)]


def test_adjusted_information(spark):
    n = spark.range(200).select(F.max(clusters.log_factorial(F.col("id")) - sum(F.when(F.col("id") == i, F.lit(math.lgamma(i + 1))).otherwise(0.0) for i in range(200)))).first()[0]
    assert abs(n) < 1e-9
    same = spark.createDataFrame([(0, 5, 4), (1, 6, 3), (2, 7, 2)], "la int, lb int, n long")
    assert abs(clusters.adjusted_information(same).first()[0] - 1) < 1e-9
    one = spark.createDataFrame([(0, 0, 9)], "la int, lb int, n long")
    assert clusters.adjusted_information(one).first()[0] == 1.0
    # the expected information of random labels is what shuffles show
    rng = np.random.default_rng(6)
    la, lb = rng.integers(0, 3, 60), rng.integers(0, 4, 60)

    def information(a, b):
        p = np.zeros((3, 4))
        np.add.at(p, (a, b), 1 / 60)
        q = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
        return (p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum()

    chance = np.mean([information(la, rng.permutation(lb)) for _ in range(4000)])
    h = sum(-(c := np.bincount(x) / 60) @ np.log(c) for x in (la, lb)) / 2
    cells = spark.createDataFrame(list(zip(la.tolist(), lb.tolist(), strict=True)), "la int, lb int").groupBy("la", "lb").agg(F.count("*").alias("n"))
    assert abs(clusters.adjusted_information(cells).first()[0] - (information(la, lb) - chance) / (h - chance)) < 3e-3


def test_one_cluster_sweep_equals_single_fits(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(80):
        n = rng.poisson(3, 4) + (np.arange(4) == i % 2) * rng.poisson(4)
        n[3] = 0 if i else 1
        rows += [(f"d{i}", "assistant" if i % 2 else "user", c, int(x), float(x / n.sum())) for c, x in enumerate(n) if x]
    prints = spark.createDataFrame(rows, "doc string, class string, cluster int, n long, p double")
    got = {r["cluster"]: r["mcc"] for r in models.single_cluster_sweep(prints).collect()}
    assert set(got) == {0, 1, 2, 3} and max(got, key=got.get) in (0, 1)
    for c in (0, 2):
        each = models.cross_validated(models.wide(prints, [c])).collect()
        assert abs(np.mean([r["mcc"] for r in each]) - got[c]) < 1e-6


def test_folds_follow_one_order(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = fingerprints.folds(rows, "id", "y", 4, [0, 1]).toPandas()
    import hashlib

    for (_, _), g in got.groupby(["seed", "y"]):
        order = g.assign(h=[hashlib.md5(f"{s}:{i}".encode()).hexdigest() for s, i in zip(g["seed"], g["id"], strict=True)]).sort_values("h")
        assert (order["fold"].to_numpy() == np.arange(len(g)) % 4).all()


def test_accents(spark):
    rows = spark.createDataFrame([("Éáçüñ ÿạ ß日",)], "t string").select(without_accents(F.col("t")))
    assert rows.first()[0] == "Eacun ya ß日"


def test_chi_squared_tail():
    for x in (0.3, 2.0, 11.0, 60.0):
        assert abs(fingerprints.chi_squared_tail(x, 2) - math.exp(-x / 2)) < 1e-12
        assert abs(fingerprints.chi_squared_tail(x, 4) - math.exp(-x / 2) * (1 + x / 2)) < 1e-12
    assert abs(fingerprints.chi_squared_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(fingerprints.chi_squared_tail(7.814727903251179, 3) - 0.05) < 1e-9
    assert fingerprints.chi_squared_tail(0, 5) == 1.0


def test_two_by_two_is_corrected(spark):
    rows = spark.createDataFrame([("user", 0, 12), ("user", 1, 5), ("assistant", 0, 3), ("assistant", 1, 10)], "class string, cluster int, n long")
    r = fingerprints.with_tail(fingerprints.chi_squared(rows)).first()
    want = sum((abs(o - e) - 0.5) ** 2 / e for o, e in ((12, 8.5), (5, 8.5), (3, 6.5), (10, 6.5)))
    assert r["dof"] == 1 and abs(r["statistic"] - want) < 1e-9 and abs(r["p_value"] - math.erfc(math.sqrt(want / 2))) < 1e-12
