"""Gaussian mixtures with diagonal covariances, fitted by expectation and maximisation in one grouped sum a round."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.models import mixture_summary
from tokenloom.operators.spectral import summed

#: Added to variances; rise of the mean log-likelihood below which a fit has converged.
FLOOR, TOLERANCE = 1e-6, 1e-3


class Mixture(NamedTuple):
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each row under each component."""
        p = 1 / self.variances
        square = x**2 @ p.T - 2 * x @ (self.means * p).T + (self.means**2 * p).sum(axis=1)
        return np.log(np.maximum(self.weights, 1e-300)) - (square + np.log(self.variances).sum(axis=1) + x.shape[1] * np.log(2 * np.pi)) / 2


def shares(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the components and log-likelihood of each row."""
    most = logs.max(axis=1, keepdims=True)
    total = np.log(np.exp(logs - most).sum(axis=1, keepdims=True)) + most
    return np.exp(logs - total), total[:, 0]


def moments(x: np.ndarray, r: np.ndarray, told: float) -> np.ndarray:
    """Sums of the rows that components hold: their weight, x, x squared; the log-likelihood in a column of its own."""
    last = np.zeros((r.shape[1], 1))
    last[0] = told
    return np.hstack([r.sum(axis=0)[:, None], r.T @ x, r.T @ x**2, last])


def maximised(total: np.ndarray) -> Mixture:
    axes = (total.shape[1] - 2) // 2
    n = total[:, :1] + 10 * np.finfo(float).eps
    means = total[:, 1 : axes + 1] / n
    return Mixture(total[:, 0] / total[:, 0].sum(), means, np.maximum(total[:, axes + 1 : -1] / n - means**2, 0) + FLOOR)


def started(rows: DataFrame, k: int, seed: int) -> Mixture:
    """The mixture of the clusters of a k-means run on rows (vec_id, y)."""
    x = rows.select(array_to_vector("y").alias("x")).cache()
    centres = np.array(KMeans(k=k, featuresCol="x", seed=seed, initSteps=2, maxIter=20).fit(x).clusterCenters())
    x.unpersist()
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def hard(x: np.ndarray) -> np.ndarray:
        c = shared.value
        near = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        return moments(x, np.eye(len(c))[near], 0.0)

    return maximised(summed(rows.select(F.col("y").alias("u")), hard, (len(centres), 2 * centres.shape[1] + 2)))


def fitted(rows: DataFrame, start: Mixture, rounds: int = 100, tolerance: float = TOLERANCE) -> tuple[Mixture, list[float], bool]:
    """(mixture, mean log-likelihood before each round, whether it converged) of rows (vec_id, y). A round sums k x (2 axes + 2) numbers over all rows, as a tree."""
    now, history = start, []
    u = rows.select(F.col("y").alias("u"))
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(now)

        def part(x: np.ndarray) -> np.ndarray:
            r, told = shares(shared.value.logs(x))
            return moments(x, r, float(told.sum()))

        total = summed(u, part, (len(now.weights), 2 * now.means.shape[1] + 2))
        shared.destroy()
        history.append(float(total[0, -1] / max(total[:, 0].sum(), 1e-300)))
        now = maximised(total)
        if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance:
            return now, history, True
    return now, history, False


def posterior(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """vec_id, label, effective_k, top_ratio, log_likelihood of rows (vec_id, y)."""
    shared = rows.sparkSession.sparkContext.broadcast(mixture)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                r, told = shares(shared.value.logs(np.stack(pdf["y"].to_list())))
                two = np.sort(r, axis=1)[:, ::-1]
                second = two[:, 1] if r.shape[1] > 1 else np.zeros(len(r))
                entropy = -np.where(r > 0, r * np.log(np.maximum(r, 1e-300)), 0).sum(axis=1)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": r.argmax(axis=1).astype(np.int32), "effective_k": np.exp(entropy), "top_ratio": two[:, 0] / np.maximum(second, 1e-30), "log_likelihood": told})

    return rows.mapInPandas(run, "vec_id long, label int, effective_k double, top_ratio double, log_likelihood double")


def diagonal_summary(rows: DataFrame, k: int = 400, seed: int = 42, rounds: int = 100) -> DataFrame:
    """One row on a diagonal mixture of rows (vec_id, y): what mixture_summary tells, the mean log-likelihood, rounds and whether it converged."""
    mixture, history, good = fitted(rows, started(rows, k, seed), rounds)
    told = posterior(rows, mixture)
    mean = told.agg(F.avg("log_likelihood").alias("log_likelihood"))
    return mixture_summary(told).crossJoin(mean).withColumns({"rounds": F.lit(len(history)), "converged": F.lit(good)})  # one row each
