"""Fitted models on planted data and against plain versions; categories and agreement by hand."""

import json

import numpy as np
from pyspark.sql import functions as F

from tokenloom.functions.tokens import category
from tokenloom.operators import clusters, fingerprints, models
from tokenloom.plans import catalogue
from tokenloom.plans.catalogue import ORACLES, QUERIES
from tokenloom.sources import tables


def test_categories_by_hand(spark):
    want = {"\n": "FORMATTING", "->": "SYNTACTIC", "x1": "NUMERIC", " The": "FUNCTION_WORDS", " Paris": "PROPER_NOUNS", "foo_bar": "CODE", "cat": "CONTENT", "  ": "FORMATTING", "Foo_bar": "PROPER_NOUNS", "Q": "CONTENT", "I": "FUNCTION_WORDS"}
    rows = spark.createDataFrame([(t,) for t in want], "tok string").withColumn("c", category(F.col("tok")))
    assert {r["tok"]: r["c"] for r in rows.collect()} == want


def test_agreement_by_hand(spark):
    same = spark.createDataFrame([(0, 5, 4), (1, 6, 3), (2, 7, 2)], "la int, lb int, n long")
    assert [tuple(r) for r in clusters.agreement(same).collect()] == [(1.0, 1.0)]
    flat = spark.createDataFrame([(a, b, 5) for a in range(2) for b in range(2)], "la int, lb int, n long")
    ari, nmi = clusters.agreement(flat).first()
    assert ari < 0.01 and abs(nmi) < 1e-9


def test_slope_by_hand(spark):
    points = spark.createDataFrame([(1, 1000), (10, 100), (100, 10)], "rank int, size long")
    r = clusters.slope(points, 1, 100).first()
    assert (round(r["slope"], 9), round(r["intercept"], 9), round(r["anchor"], 6)) == (-1, 3, 1000)
    assert clusters.slope(points.limit(2), 1, 100).first()["slope"] is None


def test_confusion_by_hand(spark):
    rows = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 7
    r = fingerprints.confusion(spark.createDataFrame(rows, "y int, p int"), "y", "p").first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (6, 2, 1, 7) and abs(r["mcc"] - 0.629941) < 1e-6 and r["balanced_accuracy"] == 0.8125


def test_logistic_finds_planted_classes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        p = rng.dirichlet(np.ones(models.BUCKETS))
        p[i % 2] += 0.5
        p /= p.sum()
        rows += [(f"d{i}", "assistant" if i % 2 else "user", c, float(x)) for c, x in enumerate(p)]
    wide = models.wide(spark.createDataFrame(rows, "doc string, class string, cluster int, p double")).cache()
    assert min(r["mcc"] for r in models.cross_validated(wide, strength=100.0).collect()) > 0.9
    assert abs(np.mean([r["mcc"] for r in models.cross_validated(models.permuted(wide), strength=100.0).collect()])) < 0.35
    assert wide.count() == models.permuted(wide).count()


def test_bag_of_words_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    texts = {(i, i % 2): " ".join(rng.choice([f"w{j}" for j in range(12)], 12, p=np.roll(np.r_[[0.2, 0.12], np.full(10, 0.068)], i % 2 * 2))) for i in range(60)}
    texts[60, 0], texts[61, 1] = "only here once", "Ét é ete"
    turns = spark.createDataFrame([(f"d{i}", ("user", "assistant")[y], t) for (i, y), t in texts.items()], "doc string, class string, text string")
    got = {(r["seed"], r["fold"]): (r["tp"], r["fp"], r["tn"], r["fn"]) for r in models.bag_of_words(turns, 3, [0, 1], 9).collect()}
    rows = {f"d{i}": (y, t.lower().replace("é", "e").split()) for (i, y), t in texts.items()}
    dealt = fingerprints.folds(spark.createDataFrame([(d, y) for d, (y, _) in rows.items()], "doc string, y int"), "doc", "y", 3, [0, 1]).collect()
    for seed in (0, 1):
        fold = {r["doc"]: r["fold"] for r in dealt if r["seed"] == seed}
        for f in range(3):
            inside = [w for d, (_, w) in rows.items() if fold[d] != f]
            every = sorted({t for w in inside for t in w}, key=lambda t: (-sum(w.count(t) for w in inside), t))[:9]
            idf = {t: np.log((1 + len(inside)) / (1 + sum(t in w for w in inside))) + 1 for t in every}

            def vector(w, every=every, idf=idf):
                x = np.array([(1 + np.log(w.count(t))) * idf[t] if t in w else 0.0 for t in every])
                return np.r_[x / max(np.linalg.norm(x), 1e-300), 1.0]

            x, y = np.stack([vector(w) for _, w in rows.values()]), np.array([y for y, _ in rows.values()])
            train = np.array([fold[d] != f for d in rows])
            weight = np.where(y == 1, 1 / y[train].mean(), 1 / (1 - y[train].mean())) / 2
            b, keep = np.zeros(10), np.r_[np.ones(9), 0]
            for _ in range(30):
                p = 1 / (1 + np.exp(-x[train] @ b))
                b -= np.linalg.solve((x[train] * (weight[train] * p * (1 - p))[:, None]).T @ x[train] + np.diag(keep), x[train].T @ (weight[train] * (p - y[train])) + keep * b)
            hit, true = x[~train] @ b > 0, y[~train] == 1
            assert got[seed, f] == ((hit & true).sum(), (hit & ~true).sum(), (~hit & ~true).sum(), (~hit & true).sum())
    assert models.bag_of_words(turns.limit(0), 3, [0]).count() == 0


def test_seeds_are_summed_up(spark):
    rows = [(0, 0.5, 0.7), (0, 0.7, 0.9), (1, 0.2, 0.6), (1, 0.2, 0.6)]
    r = models.seed_summary(spark.createDataFrame(rows, "seed int, mcc double, balanced_accuracy double")).first()
    assert np.allclose(tuple(r), (0.4, 0.2, 0.7, 0.1, 2))


def test_mixture_and_pca_find_planted_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 6)) * 8
    rows = spark.createDataFrame([(i, (centres[i % 3] + rng.normal(size=6) * 0.1).tolist()) for i in range(150)], "vec_id long, embedding array<double>")
    _, shares = models.projected(rows, 4)
    assert shares[:2].sum() > 0.99
    assert {r["label"] for r in models.mixture(rows, 2, 3).collect()} == {0, 1, 2}


def test_sparse_self_expression(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(size=(30, 12))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    y = 2 * d[3] - 0.5 * d[17]
    found = models.pursuit(d, y, -1, 6)
    assert {k for k, v in found.items() if abs(v) > 1e-6} == {3, 17} and abs(found[3] - 2) < 1e-6
    gram, target = d @ d.T, (y @ d.T)[None]
    c = models.lasso(gram, target, 0.01, 4000)
    slack = gram @ c[0] - target[0]
    assert (np.abs(slack) <= 0.01 + 1e-4).all()
    on = np.abs(c[0]) > 1e-6
    assert np.allclose(slack[on], -0.01 * np.sign(c[0][on]), atol=1e-4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "vec_id long, embedding array<double>")
    for method, amount in (("omp", 3), ("lasso", 0.05)):
        edges = models.self_expression(rows, method, amount).collect()
        assert edges and all(e["i"] != e["j"] for e in edges)


def test_category_files(spark, tmp_path):
    for n, data in enumerate(([{"cluster": 3, "category": "CODE"}], {"3": "CODE"})):
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps(data))
        assert [tuple(r) for r in tables.categories(spark, str(path)).collect()] == [(3, "CODE")]


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_logistic_seed_summary_query(spark, monkeypatch):
    """The query's means and deviations are those of its own 25 fits, five a seed."""
    seen, validated = [], models.cross_validated

    def keep(*args):
        seen.append(validated(*args).cache())
        return seen[-1]

    monkeypatch.setattr(models, "cross_validated", keep)
    got = catalogue.QUERIES["logistic_seed_summary"](spark, "/root/testdata/sf0.001").first()
    rows = seen[0].collect()
    assert sorted((r["seed"], r["fold"]) for r in rows) == [(s, f) for s in range(5) for f in range(5)]
    table = np.array([[np.mean([r[c] for r in rows if r["seed"] == s]) for c in ("mcc", "balanced_accuracy")] for s in range(5)])
    assert np.allclose([got["mcc_mean"], got["bal_mean"]], table.mean(axis=0)) and np.allclose([got["mcc_std"], got["bal_std"]], table.std(axis=0)) and got["seeds"] == 5


def test_searches_work_by_matrix_products(spark):
    """Queries against all vectors leave no pair to Spark's expressions; null and NaN vectors and repeated ids count as in SQL."""
    import duckdb

    from tokenloom.plans import oracles

    nan = float("nan")
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), i % 3 if i % 7 else None) for i in range(250)]
    rows += [(300, None, 1), (400, [nan, 1.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0, 0.0], 1), (200, rows[3][1], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    queries = vectors.where("vec_id % 100 = 0")
    db = duckdb.connect()
    db.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    db.executemany("insert into embeddings values (?, ?, ?)", [list(r) for r in rows])

    def bag(found):
        return sorted([tuple(None if v is None else "nan" if v != v else round(v, 5) for v in r) for r in found], key=str)

    found = clusters.similarities(vectors, queries, 6)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert bag(found.collect()) == bag(db.execute(oracles.ORACLES["similarity_search"]).fetchall())
    each = clusters.silhouette(vectors, queries)
    assert "NestedLoop" not in each._jdf.queryExecution().executedPlan().toString()
    assert bag(each.collect()) == bag(db.execute(oracles.ORACLES["silhouette_search"]).fetchall())


def test_rounding_is_that_of_spark(spark):
    x = [0.5e-6, 1.5e-6, -2.5e-6, 0.1234565, 1.0000005, -1e-9, 0.3, 123456.7890125, float("nan"), float("inf")] + np.random.default_rng(1).normal(size=500).tolist()
    want = [r[0] + 0.0 for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert np.array_equal(clusters.rounded(np.array(x)), want, equal_nan=True)
