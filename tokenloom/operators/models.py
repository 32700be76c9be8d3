"""Fitted models: logistic classifiers under stratified folds, L1 selection, PCA, Gaussian mixtures, sparse self-expression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.vectors import doubles
from tokenloom.operators.fingerprints import BUCKETS, fold_terms, folds, scored, term_counts
from tokenloom.operators.spectral import landmark_rows, unit_rows


def wide(prints: DataFrame, keep: list[int] | None = None) -> DataFrame:
    """doc, y (1: assistant), x: the fingerprint as a vector over BUCKETS (or the buckets kept)."""
    p = F.map_from_entries(F.collect_list(F.struct("cluster", "p")))  # at most BUCKETS entries a document
    every = F.array(*[F.coalesce(F.col("m")[c], F.lit(0.0)) for c in (keep or range(BUCKETS))])
    return prints.groupBy("doc", "class").agg(p.alias("m")).select("doc", (F.col("class") == "assistant").cast("int").alias("y"), array_to_vector(every).alias("x"))


def label_counts(rows: DataFrame) -> dict[int, int]:
    return {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}


def balanced(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rows with w, so that both classes weigh the same."""
    weight = F.lit(1.0)
    for y, n in counts.items():
        weight = F.when(F.col("y") == y, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    return rows.withColumn("w", weight)


def logistic(rows: DataFrame, strength: float, l1: float = 0.0, weighted: bool = True, counts: dict[int, int] | None = None):
    """A fitted model; strength is C, the inverse of the penalty on summed losses. counts: rows by label, where they are known."""
    counts = label_counts(rows) if counts is None else counts
    rows = balanced(rows, counts) if weighted else rows.withColumn("w", F.lit(1.0))
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / (strength * max(1, sum(counts.values()))), elasticNetParam=l1, standardization=False, maxIter=200).fit(rows)


def permuted(rows: DataFrame, seed: int = 0, part_rows: int = 50_000) -> DataFrame:
    """rows with the labels of other rows: within parts of about part_rows rows, dealt by a hash, rows in the order of their ids meet labels in the order of another hash."""
    parts = max(1, rows.count() // part_rows)
    h = F.md5(F.concat(F.lit(f"{seed}:"), "doc").cast("binary"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts)))
    a = dealt.select("doc", "x", "part", F.row_number().over(Window.partitionBy("part").orderBy("doc")).alias("n"))
    b = dealt.select("y", "part", F.row_number().over(Window.partitionBy("part").orderBy(h)).alias("n"))
    return a.join(b, ["part", "n"]).select("doc", "y", "x")


def held_out(rows_of: Callable[[int, int], DataFrame], dealt: DataFrame, k: int, strength: float) -> DataFrame:
    """seed, fold, tp, fp, tn, fn, mcc, balanced_accuracy of the models of all seeds and folds.

    rows_of(seed, fold) gives doc, y, fold and x as the model without that fold sees them. Only four counts a model come to the driver.
    """
    sizes = {(r["seed"], r["fold"], r["y"]): r["n"] for r in dealt.groupBy("seed", "fold", "y").agg(F.count("*").alias("n")).collect()}

    def tally(at: tuple[int, int]) -> tuple:
        seed, f = at
        counts = {y: n for y in (0, 1) if (n := sum(v for (s, g, c), v in sizes.items() if s == seed and g != f and c == y))}
        rows = rows_of(seed, f)
        if sum(counts.values()) == 0:  # nothing to learn from
            found = {(r["y"], 0): r["n"] for r in rows.where(F.col("fold") == f).groupBy("y").agg(F.count("*").alias("n")).collect()}
        else:
            rows = rows.persist()
            told = logistic(rows.where(F.col("fold") != f), strength, counts=counts).transform(rows.where(F.col("fold") == f))
            found = {(r["y"], r["p"]): r["n"] for r in told.groupBy("y", F.col("prediction").cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
            rows.unpersist()
        return (seed, f, *[found.get(c, 0) for c in ((1, 1), (0, 1), (0, 0), (1, 0))])

    found = [tally(at) for at in sorted({(s, f) for s, f, _ in sizes})]  # one after another: fits in threads can lock up while their classes load
    return scored(dealt.sparkSession.createDataFrame(found, "seed int, fold int, tp long, fp long, tn long, fn long"))


def cross_validated(rows: DataFrame, k: int = 5, seeds: int | list[int] = 0, strength: float = 1.0) -> DataFrame:
    """seed, fold, tp, fp, tn, fn, mcc, balanced_accuracy of k stratified folds a seed; rows: doc, y, x."""
    seeds = [seeds] if isinstance(seeds, int) else seeds
    dealt = folds(rows.select("doc", "y"), "doc", "y", k, seeds).persist()
    rows = rows.persist()
    out = held_out(lambda seed, _: rows.join(dealt.where(F.col("seed") == seed).select("doc", "y", "fold"), ["doc", "y"]), dealt, k, strength)
    rows.unpersist()
    dealt.unpersist()
    return out


def bag_of_words(turns: DataFrame, k: int = 5, seeds: int | list[int] = 0, terms: int = 10_000, strength: float = 1.0) -> DataFrame:
    """The columns of cross_validated() for a balanced classifier over TF-IDF, whose terms and idf are fitted without the held-out fold.

    Counts are kept by document, so that joining a model's terms (at most `terms` rows, broadcast) and gathering a document's
    weights move no rows. Documents without a known term are judged by the intercept.
    """
    counts = term_counts(turns).persist()
    docs = counts.select("doc", "y").distinct()
    dealt = folds(docs, "doc", "y", k, [seeds] if isinstance(seeds, int) else seeds).persist()
    fitted = fold_terms(counts, dealt, k, terms).persist()
    form = T.StructType([T.StructField("x", VectorUDT())])

    def rows_of(seed: int, f: int) -> DataFrame:
        model = fitted.where((F.col("seed") == seed) & (F.col("held") == f)).select("tok", "place", "idf")
        weighted = counts.join(F.broadcast(model), "tok", "left").withColumn("w", (1 + F.log("n")) * F.col("idf"))
        known = F.when(F.col("place").isNotNull(), F.struct("place", "w"))
        gathered = weighted.groupBy("doc", "y").agg(F.sort_array(F.collect_list(known)).alias("e"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
        unit = F.transform("e", lambda e: e["w"] / F.col("length"))
        sparse = F.to_json(F.struct(F.struct(F.lit(0).alias("type"), F.lit(terms).alias("size"), F.col("e.place").alias("indices"), unit.alias("values")).alias("x")))
        vectors = gathered.select("doc", "y", F.from_json(sparse, form)["x"].alias("x"))  # a vector's fields, read as a vector
        return vectors.join(dealt.where(F.col("seed") == seed).select("doc", "y", "fold"), ["doc", "y"])

    out = held_out(rows_of, dealt, k, strength)
    for kept in (fitted, dealt, counts):
        kept.unpersist()
    return out


def seed_summary(validated: DataFrame) -> DataFrame:
    """Mean and deviation over seeds of each seed's mean over folds: mcc_mean, mcc_std, bal_mean, bal_std, seeds."""
    means = validated.groupBy("seed").agg(F.avg("mcc").alias("m"), F.avg("balanced_accuracy").alias("b"))
    return means.agg(F.avg("m").alias("mcc_mean"), F.stddev_pop("m").alias("mcc_std"), F.avg("b").alias("bal_mean"), F.stddev_pop("b").alias("bal_std"), F.count("*").alias("seeds"))


def single_cluster_sweep(prints: DataFrame, k: int = 5, seed: int = 0, strength: float = 1.0, rounds: int = 25) -> DataFrame:
    """cluster, mcc: mean over k stratified folds of a weighted logistic classifier that sees one cluster's share alone.

    All classifiers take each Newton step together: one grouped aggregation over distinct shares and their counts.
    Only coefficients come to the driver, one pair for each cluster and fold.
    """
    docs = prints.select("doc", (F.col("class") == "assistant").cast("int").alias("y")).distinct()
    dealt = folds(docs, "doc", "y", k, [seed]).select("doc", "y", "fold")
    sizes = dealt.groupBy("fold", "y").agg(F.count("*").alias("size")).cache()  # 2k rows
    seen = prints.join(dealt, "doc").groupBy("cluster", "fold", "y", F.col("p").alias("x")).agg(F.count("*").alias("n"))
    some = seen.groupBy("cluster", "fold", "y").agg(F.sum("n").alias("some"))
    cells = some.select("cluster").distinct().crossJoin(F.broadcast(sizes)).join(some, ["cluster", "fold", "y"], "left")
    zeros = cells.select("cluster", "fold", "y", F.lit(0.0).alias("x"), (F.col("size") - F.coalesce("some", F.lit(0))).alias("n")).where("n > 0")
    rows = seen.union(zeros).cache()
    total = {(r["fold"], r["y"]): r["size"] for r in sizes.collect()}
    weight = F.lit(1.0)
    for f in range(k):
        side = [sum(n for (g, y), n in total.items() if g != f and y == c) for c in (0, 1)]
        for c in (0, 1):
            weight = F.when((F.col("held") == f) & (F.col("y") == c), sum(side) / (2 * max(1, side[c]))).otherwise(weight)
    models = {(r["cluster"], f): np.zeros(2) for r in rows.select("cluster").distinct().collect() for f in range(k)}
    p = 1 / (1 + F.exp(-(F.col("a") * F.col("x") + F.col("b"))))
    x, n, h, g = F.col("x"), F.col("n") * F.col("w") * strength, F.col("h"), F.col("g")

    def with_models() -> DataFrame:
        held = rows.sparkSession.createDataFrame([(c, f, float(m[0]), float(m[1])) for (c, f), m in models.items()], "cluster int, held int, a double, b double")
        return rows.join(F.broadcast(held), "cluster")  # a row for each cluster and fold

    for _ in range(rounds if models else 0):
        step = with_models().where("fold <> held").withColumn("w", weight).withColumn("p", p).withColumn("g", n * (F.col("p") - F.col("y"))).withColumn("h", n * F.col("p") * (1 - F.col("p")))
        sums = step.groupBy("cluster", "held").agg(F.sum(g * x).alias("ga"), F.sum(g).alias("gb"), F.sum(h * x * x).alias("aa"), F.sum(h * x).alias("ab"), F.sum(h).alias("bb")).collect()
        moved = 0.0
        for r in sums:
            m = models[r["cluster"], r["held"]]
            move = np.linalg.solve([[r["aa"] + 1, r["ab"]], [r["ab"], r["bb"] + 1e-9]], [r["ga"] + m[0], r["gb"]])
            move *= min(1.0, 10 / max(1e-12, np.abs(move).max()))
            m -= move
            moved = max(moved, float(np.abs(move).max()))
        if moved < 1e-8:
            break
    told = with_models().where("fold = held").withColumn("hit", F.col("a") * F.col("x") + F.col("b") > 0)
    count = [F.sum(F.when((F.col("y") == y) & (F.col("hit") == bool(t)), F.col("n")).otherwise(0)).cast("double") for y, t in ((1, 1), (0, 1), (0, 0), (1, 0))]
    c = told.groupBy("cluster", "fold").agg(*[v.alias(name) for v, name in zip(count, ("tp", "fp", "tn", "fn"), strict=True)])
    under = F.expr("sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))")
    return c.withColumn("m", F.when(under > 0, F.expr("tp * tn - fp * fn") / under).otherwise(0.0)).groupBy("cluster").agg(F.avg("m").alias("mcc"))


def l1_selected(rows: DataFrame, strengths: list[float]) -> DataFrame:
    """strength, selected: coefficients beyond 1e-6 of unweighted L1 fits."""
    found = [(c, int((np.abs(logistic(rows, c, 1.0, False).coefficients.toArray()) > 1e-6).sum())) for c in strengths]
    return rows.sparkSession.createDataFrame(found, "strength double, selected int")


def projected(vectors: DataFrame, dims: int) -> tuple[DataFrame, np.ndarray]:
    """vec_id, z: centred vectors on their first principal axes; and the share of variance of each axis."""
    rows = vectors.select("vec_id", array_to_vector(doubles(F.col("embedding"))).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=dims, inputCol="c", outputCol="z").fit(centred)
    return model.transform(centred).select("vec_id", "z"), model.explainedVariance.toArray()


def mixture(vectors: DataFrame, dims: int = 10, k: int = 10, seed: int = 42, starts: int = 3) -> DataFrame:
    """vec_id, label, effective_k, top_ratio of a Gaussian mixture over principal axes, the likeliest of several starts."""
    rows = projected(vectors, dims)[0].cache()
    fits = [GaussianMixture(k=k, featuresCol="z", probabilityCol="w", predictionCol="label", maxIter=50, seed=seed + s).fit(rows) for s in range(starts)]
    told = max(fits, key=lambda m: m.summary.logLikelihood).transform(rows).withColumn("w", vector_to_array("w"))
    entropy = -F.aggregate("w", F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log(p)).otherwise(0.0))
    top = F.sort_array("w", asc=False)
    return told.select("vec_id", "label", F.exp(entropy).alias("effective_k"), (top[0] / F.greatest(top[1], F.lit(1e-30))).alias("top_ratio"))


def mixture_summary(posterior: DataFrame) -> DataFrame:
    q = F.percentile("effective_k", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    ratio = F.col("top_ratio")
    return posterior.agg(F.count("*").alias("n"), F.count_distinct("label").alias("active"), q.alias("effective_k"), F.avg((ratio < 2).cast("int")).alias("unsure"), F.avg((ratio > 10).cast("int")).alias("sure"))


def pursuit(d: np.ndarray, y: np.ndarray, banned: int, nonzero: int) -> dict[int, float]:
    """Orthogonal matching pursuit of y over the rows of d."""
    chosen: list[int] = []
    coefficients = np.empty(0)
    rest = y
    for _ in range(min(nonzero, len(d) - (banned >= 0))):
        fit = np.abs(d @ rest)
        fit[[*chosen, *([banned] if banned >= 0 else [])]] = -1
        if fit.max() < 1e-10:
            break
        chosen.append(int(fit.argmax()))
        coefficients = np.linalg.lstsq(d[chosen].T, y, rcond=None)[0]
        rest = y - coefficients @ d[chosen]
    return dict(zip(chosen, coefficients.tolist(), strict=True))


def lasso(gram: np.ndarray, target: np.ndarray, alpha: float, rounds: int = 200) -> np.ndarray:
    """Rows of coefficients that minimise half the squared error plus alpha times the absolute sum, by accelerated proximal steps; a target of NaN bans its coefficient."""
    banned = np.isnan(target)
    target = np.where(banned, 0, target)
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    now = momentum = np.zeros_like(target)
    t = 1.0
    for _ in range(rounds):
        moved = momentum - step * (momentum @ gram - target)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * alpha, 0)
        new[banned] = 0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = new + (t - 1) / t_new * (new - now)
        now, t = new, t_new
    return now


def self_expression(vectors: DataFrame, method: str, amount: float) -> DataFrame:
    """i, j, coef: each vector as a sparse combination of the landmarks, itself left out. method: omp (amount: number of landmarks) or lasso (amount: alpha)."""
    own = unit_rows(vectors)
    shared = vectors.sparkSession.sparkContext.broadcast(landmark_rows(vectors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, d = shared.value
        gram = d @ d.T
        for pdf in batches:
            if not len(pdf):
                continue
            x, own = np.stack(pdf["u"].to_list()), pdf["vec_id"].to_numpy()
            if method == "omp":
                found = [(i, int(ids[j]), c) for i, y in zip(own, x, strict=True) for j, c in pursuit(d, y, int(np.flatnonzero(ids == i)[0]) if (ids == i).any() else -1, int(amount)).items()]
                yield pd.DataFrame(found, columns=["i", "j", "coef"]).astype({"i": "int64", "j": "int64", "coef": "float64"})
            else:
                target = x @ d.T
                target[own[:, None] == ids[None]] = np.nan
                c = lasso(gram, target, amount)
                a, b = np.nonzero(np.abs(c) > 1e-6)
                yield pd.DataFrame({"i": own[a], "j": ids[b], "coef": c[a, b]})

    return own.mapInPandas(run, "i long, j long, coef double")


def affinity(edges: DataFrame) -> DataFrame:
    """i, j, a: coefficients over each row's largest, their absolute values added to those of the swapped pair."""
    most = F.max(F.abs("coef")).over(Window.partitionBy("i"))
    scaled = edges.withColumn("m", most).where("m > 1e-10").select("i", "j", (F.abs("coef") / F.col("m")).alias("a"))
    return scaled.union(scaled.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")).groupBy("i", "j").agg(F.sum("a").alias("a"))


def graph_stats(edges: DataFrame, nodes: int) -> DataFrame:
    return edges.where("a > 1e-6").agg(F.count("*").alias("n_edges"), (F.count("*") / max(1, nodes)).alias("nnz_per_row"), (100 * F.count("*") / max(1, nodes) ** 2).alias("density_pct"))
