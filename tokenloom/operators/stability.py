"""Stability of a clustering: it is fitted again on exact samples of all rows, one checkpointed step for each sample."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import clusters
from tokenloom.sources.shared import Checkpoint, written

STEP = "method string, iter int, n long, ari double, nmi double, active long, slope double, seconds double, error string"

Fit = Callable[[DataFrame], DataFrame]


def reclustered(vectors: DataFrame, method: str, fit: Fit, iterations: int, share: float, path: str, configuration: dict, low: int = 2, high: int = 400) -> DataFrame:
    """STEP rows: for each iteration, how the clusters fitted on an exact sample agree with those fitted on all rows.

    fit takes vectors and returns (vec_id, label); samples are `share` of the rows, drawn by iteration. Each iteration is a step of the
    checkpoint at path, so a run that was interrupted goes on where it stopped, one with more iterations extends it, and
    one of another configuration is refused. An iteration whose fit fails leaves a row with the error instead of ending
    the study.
    """
    spark = vectors.sparkSession
    study = Checkpoint(spark, path, {"method": method, "share": share, **configuration})
    remaining = sorted(set(range(iterations)) - study.done())
    whole = written(fit(vectors).select("vec_id", "label")) if remaining else None
    for i in remaining:
        began = time.time()
        try:
            own = written(vectors.join(clusters.sampled(vectors, share, [i]).where(F.col("iter") == i).select("vec_id"), "vec_id", "left_semi"))
            again = written(fit(own).select("vec_id", "label"))
            agreed = clusters.agreement(clusters.contingency(whole, again)).first()
            sized = clusters.ranked(clusters.sizes(again))
            line = clusters.slope(sized, low, high).first()
            row = (method, i, again.count(), agreed["ari"], agreed["nmi"], sized.count(), line["slope"], round(time.time() - began, 1), None)
        except Exception as e:  # the step's own outcome
            row = (method, i, None, None, None, None, None, round(time.time() - began, 1), f"{type(e).__name__}: {e}"[:500])
        study.write(i, spark.createDataFrame([row], STEP).coalesce(1))
    return study.read(STEP).drop("step")


def summary(steps: DataFrame) -> DataFrame:
    """method, completed, failed, and mean and deviation of ari, nmi, active and slope over the completed iterations."""
    told = [f(c).alias(f"{c}_{n}") for c in ("ari", "nmi", "active", "slope") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return steps.groupBy("method").agg(F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"), *told)
