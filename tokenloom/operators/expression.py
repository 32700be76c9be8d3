"""Sparse self-expression on principal axes of similarity rows, and the clusterings of its graph.

A row's features are its angular similarities to the landmarks (all rows, where there are no more), its axes the first
principal ones of those features. Each row is then written as a sparse combination of the dictionary's rows, itself
left out; the coefficients make a graph, whose spectral clusterings are the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import clusters, lanczos
from tokenloom.operators.models import affinity, graph_stats, pursuit
from tokenloom.operators.spectral import LANDMARKS, kernel, landmark_rows, summed, unit_rows
from tokenloom.sources.shared import written

#: Rows of the dictionary at most: a table of this size times the axes travels to each task.
DICTIONARY = 4096
#: Rows that one task expresses.
TASK_ROWS = 250


def similarity_axes(vectors: DataFrame, dims: int, landmarks: int = LANDMARKS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, y; shares of variance) of the rows' angular similarities to the landmarks on their first principal axes. Means and products are summed in one pass; the driver holds a square of the landmarks."""
    rows, (_, marks) = unit_rows(vectors), landmark_rows(vectors, landmarks)
    if not len(marks):
        return rows.select("vec_id", F.col("u").alias("y")), np.zeros(0)
    shared = vectors.sparkSession.sparkContext.broadcast(marks)

    def moments(x: np.ndarray) -> np.ndarray:
        f = kernel(x, shared.value, "angular")
        return np.vstack([f.T @ f, f.sum(axis=0), np.full(f.shape[1], len(f))])

    total = summed(rows, moments, (len(marks) + 2, len(marks)))
    n, mean = total[-1, 0], total[-2] / total[-1, 0]
    power, axes = np.linalg.eigh(total[:-2] / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :dims]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    told = vectors.sparkSession.sparkContext.broadcast((marks, mean, axes))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, mean, axes = told.value
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "y": list((kernel(np.stack(pdf["u"].to_list()), marks, "angular") - mean) @ axes)})

    return rows.mapInPandas(project, "vec_id long, y array<double>"), np.maximum(power[::-1][:dims], 0) / max(float(np.maximum(power, 0).sum()), 1e-300)


def lasso_row(d: np.ndarray, y: np.ndarray, banned: int, alpha: float) -> dict[int, float]:
    """Coefficients w of y over the rows of d that minimise |y - w d|^2 / (2 axes) + alpha |w|_1, row `banned` left out (-1: none).

    The solution is followed from the penalty at which it is zero down to alpha: between two changes of the set of rows in
    use it is linear in the penalty, so each step solves one system of at most as many rows as there are axes.
    """
    goal = alpha * d.shape[1]
    c = d @ y
    free = np.ones(len(d), bool)
    if banned >= 0:
        free[banned] = False
    if not free.any():
        return {}
    first = int(np.where(free, np.abs(c), -1).argmax())
    level = abs(float(c[first]))
    used, signs, w = [first], [np.sign(c[first])], np.zeros(1)
    if level <= goal:
        return {}
    free[first] = False
    for _ in range(20 * d.shape[1] + 100):
        v = np.linalg.lstsq(d[used] @ d[used].T, np.array(signs), rcond=None)[0]
        a = d @ (v @ d[used])  # how fast each row's product with the rest falls
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(free & (1 - a > 1e-9), (level - c) / (1 - a), np.inf)
            down = np.where(free & (1 + a > 1e-9), (level + c) / (1 + a), np.inf)
            out = np.where(w * v < 0, -w / v, np.inf)
        joins = np.maximum(np.minimum(up, down), 0)
        step = min(level - goal, float(joins.min()), float(out.min()))
        w, c, level = w + step * v, c - step * a, level - step
        if level <= goal * (1 + 1e-12):
            break
        if step == float(out.min()):
            k = int(out.argmin())
            free[used[k]] = True
            # just left: its product stands at the level, so it must not come back at once
            c[used[k]] -= np.sign(c[used[k]]) * 1e-12 * level
            w = np.delete(w, k)
            del used[k], signs[k]
        elif len(used) < d.shape[1]:
            j = int(joins.argmin())
            used.append(j)
            signs.append(np.sign(c[j]))
            w = np.append(w, 0.0)
            free[j] = False
        else:
            free[int(joins.argmin())] = False  # as many rows as axes: another one depends on them
        if not used:
            break
    return dict(zip(used, w.tolist(), strict=True))


def expressed(axes: DataFrame, method: str, amount: float, dictionary: int = DICTIONARY) -> DataFrame:
    """i, j, coef of rows (vec_id, y): lasso (amount: alpha, the squared error over the number of axes) or omp (amount: number of rows). The dictionary is all rows up to its bound, then those of least md5."""
    order = F.md5(F.col("vec_id").cast("string").cast("binary"))
    own = axes.orderBy(order, "vec_id").limit(dictionary).collect()
    ids, d = np.array([r["vec_id"] for r in own], np.int64), np.array([list(r["y"]) for r in own], np.float64)
    shared = axes.sparkSession.sparkContext.broadcast((ids, d))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, d = shared.value
        place = {v: n for n, v in enumerate(ids.tolist())}
        for pdf in batches:
            found = []
            for i, y in zip(pdf["vec_id"].tolist(), pdf["y"].to_list(), strict=True):
                y, own = np.asarray(y), place.get(i, -1)
                w = pursuit(d, y, own, int(amount)) if method == "omp" else lasso_row(d, y, own, amount)
                found += [(i, int(ids[j]), c) for j, c in w.items() if abs(c) > 1e-6]
            yield pd.DataFrame(found, columns=["i", "j", "coef"]).astype({"i": "int64", "j": "int64", "coef": "float64"})

    tasks = max(1, -(-axes.count() // TASK_ROWS))  # by work, not by bytes
    return axes.repartition(tasks, "vec_id").mapInPandas(run, "i long, j long, coef double")


def expression_clusters(vectors: DataFrame, method: str, dims: int, amount: float, ks: list[int], dictionary: int = DICTIONARY, axes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, float]:
    """(vec_id, k, label; edges i, j, a; residual of the eigenvectors) of one configuration. axes: those of similarity_axes with dims axes or more, where they are at hand."""
    axes = similarity_axes(vectors, dims)[0] if axes is None else axes
    rows = axes.select("vec_id", F.slice("y", 1, dims).alias("y"))
    edges = written(affinity(expressed(rows, method, amount, dictionary)))
    labels, residual = lanczos.graph_spectral(edges, rows, ks)
    return labels, edges, residual


#: What a sweep tells of each configuration and k.
SWEEP = "method string, dims int, amount double, k int, n_edges long, nnz_per_row double, residual double, active long, largest long, silhouette double, slope double, delta double"


def sweep(vectors: DataFrame, configurations: list[tuple[str, int, float]], ks: list[int], low: int = 2, high: int = 1000, target: float = clusters.TARGET) -> DataFrame:
    """A row for each (method, dims, amount) and k: edges of the graph, sizes of the clusters, mean silhouette by the centres' simplified form, and slope of the configuration's envelope over all k with its distance from the target. Axes are found once, for the largest dims."""
    spark = vectors.sparkSession
    axes = written(similarity_axes(vectors, max(d for _, d, _ in configurations))[0])
    nodes, out = axes.count(), None
    for method, dims, amount in configurations:
        labels, edges, residual = expression_clusters(vectors, method, dims, amount, ks, axes=axes)
        sized = clusters.sizes(labels, "k").groupBy("k").agg(F.count("*").alias("active"), F.max("size").alias("largest"))
        line = clusters.slope(clusters.envelope(labels), low, high).select("slope", F.abs(F.col("slope") - target).alias("delta"))
        graph = graph_stats(edges, nodes).select("n_edges", "nnz_per_row")
        given = {"method": F.lit(method), "dims": F.lit(dims), "amount": F.lit(float(amount)), "residual": F.lit(residual)}
        told = sized.crossJoin(F.broadcast(graph)).crossJoin(F.broadcast(line)).withColumns(given)  # one row each
        told = told.join(simplified_silhouette(axes.select("vec_id", F.slice("y", 1, dims).alias("y")), labels), "k", "left")
        part = written(told.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in SWEEP.split(", ")]))
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], SWEEP)


def simplified_silhouette(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """k, silhouette: mean over rows (vec_id, y) of (b - a) / max(a, b), a and b the distances to the own and to the nearest other centre; null with one cluster. Centres are broadcast: at most the sum of all k."""
    joined = labels.join(rows, "vec_id")
    means = joined.select("k", "label", F.posexplode("y").alias("axis", "v")).groupBy("k", "label", "axis").agg(F.avg("v").alias("m"))
    centres = means.groupBy("k", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "m"))), lambda s: s["m"]).alias("c"))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in centres.orderBy("k", "label").collect():
        ids, c = held.get(r["k"], ([], []))
        held[r["k"]] = ([*ids, r["label"]], [*c, list(r["c"])])
    shared = rows.sparkSession.sparkContext.broadcast({k: (np.array(i), np.array(c)) for k, (i, c) in held.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, own in pdf.groupby("k"):
                ids, c = shared.value[k]
                y = np.stack(own["y"].to_list())
                far = np.sqrt(np.maximum((y**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * y @ c.T, 0))
                at = np.searchsorted(ids, own["label"].to_numpy())
                a = far[np.arange(len(y)), at]
                far[np.arange(len(y)), at] = np.inf
                b = far.min(axis=1)
                s = (b - a) / np.maximum(np.maximum(a, b), 1e-300) if len(ids) > 1 else np.full(len(y), np.nan)
                yield pd.DataFrame({"k": own["k"].to_numpy(np.int32), "s": s})

    each = joined.select("k", "label", "y").mapInPandas(run, "k int, s double")
    return each.groupBy("k").agg(F.avg(F.when(~F.isnan("s"), F.col("s"))).alias("silhouette"))
