"""Clusterings over vectors and what is read off them: sizes, envelopes, slopes, power laws, agreement, medoids."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.vectors import dot, doubles, unit

KS = [5, 10, 20, 50, 100]
TARGET = -1.237
#: Pairs of a query and a vector that a task holds at once, that it takes in all, and sums of queries by label that it holds.
PAIRS, TASK_PAIRS, SUMS = 1 << 18, 1 << 26, 1 << 22


def _seeds(vectors: DataFrame, most: int, offset: int = 0) -> list[tuple[int, list[float]]]:
    """The `most` vectors of least id behind an offset: a bounded set."""
    rows = vectors.orderBy("vec_id").limit(most + offset).select("vec_id", unit(doubles(F.col("embedding"))).alias("u")).collect()
    return [(r["vec_id"], list(r["u"])) for r in rows[offset:]]


def nearest_seed(vectors: DataFrame, ks: list[int] = KS, offset: int = 0) -> DataFrame:
    """vec_id, k, label, similarity: the nearest of the first k seeds for each k; the earlier seed wins ties. One pass over the vectors, a matrix product for each Arrow batch; only the bounded set of seeds travels."""
    seeds = np.array([s for _, s in _seeds(vectors, max(ks), offset)])
    shared = vectors.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["u"].to_list()) if len(pdf) else np.empty((0, 1))
            for k in ks if len(pdf) and len(shared.value) else ():
                c = np.round(x @ shared.value[:k].T, 9)
                best = c.argmax(axis=1)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "k": np.int32(k), "label": best.astype(np.int32), "similarity": c[np.arange(len(c)), best]})

    return vectors.select("vec_id", unit(doubles(F.col("embedding"))).alias("u")).mapInPandas(run, "vec_id long, k int, label int, similarity double")


def _whole(v: Column) -> Column:
    """The unit vector of v; null where v or a component is null."""
    return F.when(F.forall(v, lambda x: x.isNotNull()), unit(doubles(v)))


class Queries:
    """A bounded set of query vectors on the driver. valid: whether a query has a vector; one without has null cosines, whose angle SQL's least and greatest take for that of 1."""

    def __init__(self, queries: DataFrame):
        label = F.col("label").cast("long") if "label" in queries.columns else F.lit(None).cast("long")
        rows = queries.where("vec_id is not null").select("vec_id", label.alias("label"), _whole(F.col("embedding")).alias("q")).collect()
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.labels = pa.array([r["label"] for r in rows], pa.int64())
        self.dims = max((len(r["q"]) for r in rows if r["q"] is not None), default=0)
        self.valid = np.array([r["q"] is not None and len(r["q"]) == self.dims for r in rows], bool)
        self.q = np.array([r["q"] if ok else [np.nan] * self.dims for r, ok in zip(rows, self.valid, strict=True)], np.float64).reshape(len(rows), self.dims)

    def dealt(self, vectors: DataFrame, *columns: str) -> DataFrame:
        """vec_id, columns and u of the vectors, in as many tasks as their pairs with the queries ask for."""
        tasks = -(-vectors.count() * len(self.ids) // TASK_PAIRS)
        rows = vectors.where("vec_id is not null")
        rows = rows.repartition(tasks) if tasks > rows.rdd.getNumPartitions() else rows
        return rows.select("vec_id", *columns, _whole(F.col("embedding")).alias("u"))

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of a batch, and whether each has one."""
        on = pc.equal(pc.list_value_length(column), self.dims).fill_null(False)
        valid = on.to_numpy(zero_copy_only=False)
        u = np.full((len(valid), self.dims), np.nan)
        u[valid] = column.filter(on).flatten().to_numpy().reshape(-1, self.dims)
        return u, valid


def _angles(c: np.ndarray) -> np.ndarray:
    """Arc cosine over pi of cosines cut to -1 and 1; NaN, which stands for null as well, counts as 1, as in SQL."""
    return np.arccos(np.fmax(-1.0, np.fmin(1.0, c))) / np.pi


def rounded(x: np.ndarray, places: int = 6) -> np.ndarray:
    """x as Spark's round() has it (half up in decimals): by a product where that is beyond doubt, by its digits where it is close to a half. Minus zero is zero."""
    scaled = x * 10.0**places
    out = np.rint(scaled) / 10.0**places + 0.0
    close = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-7)
    for i in close:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0
    return out


def similarities(vectors: DataFrame, queries: DataFrame, places: int | None = None) -> DataFrame:
    """query_id, vec_id, cosine, abs_cosine, angular and shifted of a bounded set of query vectors against all, rounded to `places` decimals on request. A pass over the vectors, a matrix product for each piece of a batch."""
    asked = Queries(queries)
    shared = vectors.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, q_valid = shared.value.ids, shared.value.q, shared.value.valid
        q_abs, step = np.abs(q), max(1, PAIRS // max(1, len(ids)))
        for batch in batches:
            own, (u, valid) = batch.column(0).to_numpy(), shared.value.units(batch.column(1))
            for at in range(0, len(own) if len(ids) else 0, step):
                x, near = u[at : at + step], own[at : at + step]
                c, absolute = (x @ q.T).ravel(), (np.abs(x) @ q_abs.T).ravel()
                told = [np.tile(ids, len(near)), np.repeat(near, len(ids)), c, absolute, 1 - _angles(c), (c + 1) / 2]
                if places is not None:
                    told[2:] = [rounded(v, places) for v in told[2:]]
                apart, missing = (near[:, None] != ids).ravel(), ~np.logical_and.outer(valid[at : at + step], q_valid).ravel()
                if not apart.all():
                    told, missing = [v[apart] for v in told], missing[apart]
                arrays = [pa.array(v, mask=missing if i in (2, 3, 5) and missing.any() else None) for i, v in enumerate(told)]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "cosine", "abs_cosine", "angular", "shifted"])

    return asked.dealt(vectors).mapInArrow(run, "query_id long, vec_id long, cosine double, abs_cosine double, angular double, shifted double")


def medoids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """label, vec_id, mean_similarity: the member most similar to its cluster on average (itself included). The mean of cosines is the product with the mean vector, so members never meet in pairs."""
    own = vectors.select("vec_id", F.col(label).alias("label"), unit(doubles(F.col("embedding"))).alias("u"))
    mean = own.select("label", F.posexplode("u").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m"))  # one row for each dimension
    scored = own.join(centre, "label").withColumn("mean_similarity", F.round(dot(F.col("u"), F.col("m")), 9))
    best = scored.groupBy("label").agg(F.min(F.struct((-F.col("mean_similarity")).alias("s"), "vec_id")).alias("b"))
    return best.select("label", "b.vec_id", (-F.col("b.s")).alias("mean_similarity"))


def sizes(assigned: DataFrame, *by: str) -> DataFrame:
    return assigned.where("label is not null").groupBy(*by, "label").agg(F.count("*").alias("size"))


def ranked(sized: DataFrame, *by: str) -> DataFrame:
    """sized with rank by falling size within `by`; equal sizes follow the label."""
    return sized.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("size"), "label")))


def envelope(assigned: DataFrame) -> DataFrame:
    """rank, size: the largest size of each rank over all k."""
    return ranked(sizes(assigned, "k"), "k").groupBy("rank").agg(F.max("size").alias("size"))


def slope(points: DataFrame, low: int, high: int, *by: str) -> DataFrame:
    """Log-log line through the points whose rank is in the window: slope, intercept, anchor, n; null under three points."""
    inside = points.where(F.col("rank").between(low, high) & (F.col("size") > 0))
    x, y = F.log10(F.col("rank").cast("double")), F.log10(F.col("size").cast("double"))
    got = inside.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))
    enough = F.col("n") >= 3
    return got.withColumn("slope", F.when(enough, F.col("slope"))).withColumn("intercept", F.when(enough, F.col("intercept"))).withColumn("anchor", F.pow(F.lit(10.0), F.col("intercept")))


def power_law(sized: DataFrame) -> DataFrame:
    """n, alpha, bic_power_law, bic_exponential and delta_bic of a column of sizes above zero."""
    least = sized.where("size > 0").agg((F.min("size") - 0.5).alias("xmin"))
    r = sized.where("size > 0").crossJoin(F.broadcast(least)).agg(F.count("*").alias("n"), F.first("xmin").alias("xmin"), F.sum(F.log(F.col("size") / F.col("xmin"))).alias("s"), F.sum(F.log("size")).alias("logs"), F.avg("size").alias("mean"))
    r = r.withColumn("alpha", F.when((F.col("n") >= 3) & (F.col("s") > 0), 1 + F.col("n") / F.col("s")))
    bic = -2 * (F.col("n") * F.log(F.col("alpha") - 1) + F.col("n") * (F.col("alpha") - 1) * F.log("xmin") - F.col("alpha") * F.col("logs")) + F.log("n")
    other = -2 * F.col("n") * (-F.log("mean") - 1) + F.log("n")
    return r.select("n", "alpha", bic.alias("bic_power_law"), other.alias("bic_exponential"), (other - bic).alias("delta_bic"))


def contingency(a: DataFrame, b: DataFrame, key: str = "vec_id") -> DataFrame:
    """la, lb, n of two labelings (key, label)."""
    joined = a.select(key, F.col("label").alias("la")).join(b.select(key, F.col("label").alias("lb")), key)
    return joined.groupBy("la", "lb").agg(F.count("*").alias("n"))


def agreement(table: DataFrame, *by: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) from la, lb, n."""

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    def entropy(n: Column) -> Column:
        return n * F.log(n)

    cells = table.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum(entropy(F.col("n"))).alias("e"), F.sum("n").alias("n"))
    sides = []
    for side in ("la", "lb"):
        margin = table.groupBy(*by, side).agg(F.sum("n").alias("m"))
        sides.append(margin.groupBy(*by).agg(F.sum(pairs(F.col("m"))).alias(f"p_{side}"), F.sum(entropy(F.col("m"))).alias(f"e_{side}")))
    whole = cells
    for s in sides:
        whole = whole.join(s, list(by)) if by else whole.crossJoin(s)  # one row each
    expected = F.col("p_la") * F.col("p_lb") / pairs(F.col("n"))
    most = (F.col("p_la") + F.col("p_lb")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected))
    h_a, h_b = F.log("n") - F.col("e_la") / F.col("n"), F.log("n") - F.col("e_lb") / F.col("n")
    mutual = F.log("n") + (F.col("e") - F.col("e_la") - F.col("e_lb")) / F.col("n")
    nmi = F.when(h_a + h_b <= 1e-12, 1.0).otherwise(mutual / ((h_a + h_b) / 2))
    return whole.select(*by, ari.alias("ari"), nmi.alias("nmi"))


def log_factorial(n: Column) -> Column:
    """ln n! of whole numbers: a table below 16, Stirling's series beyond."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < 16, F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), F.least(n, F.lit(15)).cast("int") + 1)).otherwise(series)


def adjusted_information(table: DataFrame) -> DataFrame:
    """ami: adjusted mutual information (arithmetic mean) of la, lb, n; one where both sides are a single cluster.

    The expected information is summed over pairs of distinct cluster sizes and the overlaps that lie within six root
    sizes of the mean, beyond which Hoeffding's bound leaves less than 1e-30 of the probability.
    """
    total = table.agg(F.sum("n").alias("t"))
    sides = [table.groupBy(s).agg(F.sum("n").alias("m")) for s in ("la", "lb")]
    sized = [m.groupBy(F.col("m").alias(a)).agg(F.count("*").alias(f"n{a}")) for m, a in zip(sides, "ab", strict=True)]
    pairs = sized[0].crossJoin(sized[1]).crossJoin(F.broadcast(total))  # distinct sizes of clusters, and one row
    a, b, t, n = (F.col(c) for c in ("a", "b", "t", "o"))
    mean, room = a * b / t, 6 * F.sqrt(F.least(a, b).cast("double")) + 1
    low = F.greatest(F.lit(1).cast("long"), a + b - t, F.floor(mean - room))
    high = F.least(a, b, F.ceil(mean + room))
    f = log_factorial
    chance = F.exp(f(a) + f(b) + f(t - a) + f(t - b) - f(t) - f(n) - f(a - n) - f(b - n) - f(t - a - b + n))
    overlaps = pairs.where(low <= high).withColumn("o", F.explode(F.sequence(low, high)))
    expected = overlaps.agg(F.coalesce(F.sum(F.col("na") * F.col("nb") * n / t * F.log(t * n / (a * b)) * chance), F.lit(0.0)).alias("emi"))

    def spread(rows: DataFrame, c: str, name: str) -> DataFrame:
        return rows.agg(F.sum(F.col(c) * F.log(c)).alias(name))

    whole = total.crossJoin(expected).crossJoin(spread(table, "n", "e")).crossJoin(spread(sides[0], "m", "ea")).crossJoin(spread(sides[1], "m", "eb"))  # one row each
    h_a, h_b = F.log("t") - F.col("ea") / t, F.log("t") - F.col("eb") / t
    mutual = F.log("t") + (F.col("e") - F.col("ea") - F.col("eb")) / t
    return whole.select(F.when(h_a + h_b <= 1e-12, 1.0).otherwise((mutual - F.col("emi")) / ((h_a + h_b) / 2 - F.col("emi"))).alias("ami"))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the one-to-one matching of largest total gain, by shortest augmenting paths."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    rows, columns = cost.shape
    u, v, owner = np.zeros(rows), np.zeros(columns), np.full(columns, -1)
    for start in range(rows):
        least, back, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, last, far = start, -1, 0.0
        while True:
            slack = np.where(done, np.inf, far + cost[row] - u[row] - v)
            better = slack < least
            least[better], back[better] = slack[better], last
            last = int(np.where(done, np.inf, least).argmin())
            far = least[last]
            done[last] = True
            if owner[last] < 0:
                break
            row = owner[last]
        u[start] += far
        inner = done.copy()
        inner[last] = False
        u[owner[inner]] += far - least[inner]
        v[done] -= far - least[done]
        while last >= 0:
            before = back[last]
            owner[last] = owner[before] if before >= 0 else start
            last = before
    pairs = [(int(owner[c]), c) for c in range(columns) if owner[c] >= 0]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def assigned(table: DataFrame) -> DataFrame:
    """la, lb, n, jaccard of the one-to-one matching of largest total overlap; a pair without overlap is left out. The contingency of two clusterings is bounded by their numbers of clusters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="la", columns="lb", values="n").fillna(0).sort_index().sort_index(axis=1)
        x = wide.to_numpy(np.float64)
        found = [(wide.index[i], wide.columns[j], x[i, j], x[i, j] / (x[i].sum() + x[:, j].sum() - x[i, j])) for i, j in assignment(x) if x[i, j] > 0]
        return pd.DataFrame(found, columns=["la", "lb", "n", "jaccard"])

    return table.select("la", "lb", "n").groupBy().applyInPandas(run, "la int, lb int, n long, jaccard double")


def matched(table: DataFrame) -> DataFrame:
    """la, lb, n, jaccard of clusters that are each other's best match by Jaccard; ties follow the labels."""
    a, b = Window.partitionBy("la"), Window.partitionBy("lb")
    j = F.col("n") / (F.sum("n").over(a) + F.sum("n").over(b) - F.col("n"))
    scored = table.withColumn("jaccard", j)
    best = scored.withColumn("ra", F.row_number().over(a.orderBy(F.desc("jaccard"), "lb"))).withColumn("rb", F.row_number().over(b.orderBy(F.desc("jaccard"), "la")))
    return best.where("ra = 1 and rb = 1").select("la", "lb", "n", "jaccard")


def match_summary(table: DataFrame) -> DataFrame:
    """pairs, mean and median Jaccard, share of them from a half on, and correlations of sizes and of their ranks over the matched clusters of la, lb, n."""
    sides = [table.groupBy(s).agg(F.sum("n").alias(f"m_{s}")) for s in ("la", "lb")]
    pairs = matched(table).join(sides[0], "la").join(sides[1], "lb")
    for c in ("m_la", "m_lb"):  # as many rows as clusters
        pairs = pairs.withColumn(f"r_{c}", F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2)
    j = F.col("jaccard")
    return pairs.agg(
        F.count("*").alias("pairs"), F.avg(j).alias("jaccard_mean"), F.percentile(j, 0.5).alias("jaccard_median"), F.avg((j >= 0.5).cast("double")).alias("half"),
        F.corr(F.col("m_la").cast("double"), F.col("m_lb").cast("double")).alias("pearson"), F.corr("r_m_la", "r_m_lb").alias("spearman"),
    )


def in_cluster_order(assigned: DataFrame, most: int) -> DataFrame:
    """place, vec_id, label of the first rows by falling cluster size, then label, then id."""
    first = assigned.join(F.broadcast(sizes(assigned)), "label").orderBy(F.desc("size"), "label", "vec_id").limit(most)  # a row for each cluster
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "label", "vec_id")) - 1).select("place", "vec_id", "label")


def running(each: DataFrame, value: str) -> DataFrame:
    """iter, mean, std over the iterations so far (a row for each iteration)."""
    w = Window.orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("iter", F.avg(value).over(w).alias("mean"), F.stddev_pop(value).over(w).alias("std"))


def fragmentation(table: DataFrame) -> DataFrame:
    """la, fragmentation: exponential of the entropy of a cluster over the other labeling."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("la"))
    return table.withColumn("p", p).groupBy("la").agg(F.exp(-F.sum(F.col("p") * F.log("p"))).alias("fragmentation"))


def sampled(rows: DataFrame, share: float, seeds: list[int], key: str = "vec_id") -> DataFrame:
    """iter and key of a sample without replacement for each seed: exactly the share of the rows (rounded down), those of least md5 of seed and key.

    Rows are counted by the first four digits of the md5; only the span in which the sample ends is put in order.
    """
    h = F.md5(F.concat(F.col("iter").cast("string"), F.lit(":"), F.col(key).cast("string")).cast("binary"))
    drawn = rows.select(key, F.explode(F.array(*map(F.lit, seeds))).alias("iter")).withColumn("h", h).withColumn("span", F.substring("h", 1, 4))
    counts = drawn.groupBy("iter", "span").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("iter")
    before = F.sum("n").over(whole.orderBy("span")) - F.col("n")
    want = F.floor(F.lit(share) * F.sum("n").over(whole))
    spans = counts.select("iter", "span", "n", before.alias("before"), want.alias("want")).where("before < want")  # at most 16^4 rows a seed
    kept = drawn.join(F.broadcast(spans), ["iter", "span"])
    inside = kept.where("before + n <= want").select("iter", key)
    edge = kept.where("before + n > want").withColumn("place", F.row_number().over(Window.partitionBy("iter", "span").orderBy("h", key)))
    return inside.union(edge.where("place <= want - before").select("iter", key))


def nearest_of(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    """vec_id, label, medoid, similarity: the nearest representative of each vector. chosen: label and vec_id, one row a cluster."""
    u = unit(doubles(F.col("embedding")))
    best = vectors.join(F.broadcast(chosen.select("vec_id", F.col("label").alias("own"))), "vec_id").select(F.col("vec_id").alias("medoid"), "own", u.alias("m"))
    together = best.agg(F.collect_list(F.struct("own", "medoid", "m")).alias("all"))  # a row for each cluster
    near = F.transform("all", lambda e: F.struct((-F.round(dot(F.col("u"), e["m"]), 9)).alias("s"), e["own"].alias("label"), e["medoid"].alias("medoid")))
    found = vectors.select("vec_id", u.alias("u")).crossJoin(F.broadcast(together)).select("vec_id", F.array_min(near).alias("b"))  # one row
    return found.select("vec_id", "b.label", "b.medoid", (-F.col("b.s")).alias("similarity"))


def silhouette(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """vec_id, silhouette over angular distances of a bounded set of queries (vec_id, label, embedding) against all vectors; zero for a cluster of one. A task sums the distances of its vectors by label, so pairs never leave it."""
    asked = Queries(queries)
    shared = vectors.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, owns = shared.value.ids, shared.value.q, shared.value.labels
        sums: dict = {}  # by label: total and number for each query

        def told() -> Iterator[pa.RecordBatch]:
            for label, (total, n) in sums.items():
                on = n > 0
                columns = [pa.array(ids[on]), owns.filter(pa.array(on)), pa.array([label] * int(on.sum()), pa.int64()), pa.array(total[on]), pa.array(n[on])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "own", "label", "total", "n"])
            sums.clear()

        step = max(1, PAIRS // max(1, len(ids)))
        for batch in batches if len(ids) else ():
            own, (u, _) = batch.column(0).to_numpy(), shared.value.units(batch.column(2))
            labels = np.array([-1 if x is None else x for x in batch.column(1).to_pylist()], np.int64)
            nulls = ~batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            order = np.lexsort((labels, nulls))
            for at in range(0, len(order), step):
                rows = order[at : at + step]
                d, n = _angles(u[rows] @ q.T), np.ones(len(rows), np.int64)
                x, y = labels[rows], nulls[rows]
                heads = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                total, n = np.add.reduceat(d, heads, axis=0), np.repeat(np.diff(np.r_[heads, len(rows)])[:, None], len(ids), axis=1)
                group = np.searchsorted(heads, np.arange(len(rows)), "right") - 1
                for i in np.flatnonzero(np.isin(own[rows], ids)):  # a query is not its own neighbour
                    same = ids == own[rows[i]]
                    total[group[i], same] -= d[i, same]
                    n[group[i], same] -= 1
                for i, h in enumerate(heads):
                    label = None if y[h] else int(x[h])
                    old = sums.get(label)
                    sums[label] = (total[i], n[i]) if old is None else (old[0] + total[i], old[1] + n[i])
                if len(sums) * len(ids) > SUMS:
                    yield from told()
        yield from told()

    parts = asked.dealt(vectors, F.col("label").cast("long").alias("label")).mapInArrow(run, "query_id long, own long, label long, total double, n long")
    by = parts.groupBy("query_id", "own", "label").agg((F.sum("total") / F.sum("n")).alias("d"))
    both = by.groupBy("query_id").agg(F.max(F.when(F.col("label") == F.col("own"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("own"), F.col("d"))).alias("b"))
    return both.select(F.col("query_id").alias("vec_id"), F.coalesce(F.when(F.greatest("a", "b") == 0, F.lit(float("nan"))).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def power_law_scan(sized: DataFrame) -> DataFrame:
    """xmin, n_tail, alpha, ks for each distinct size as the least of the tail. Only distinct sizes meet, with their counts."""
    distinct = sized.where("size > 0").groupBy("size").agg(F.count("*").alias("c"))
    pairs = distinct.select(F.col("size").alias("xmin")).join(distinct, F.col("size") >= F.col("xmin"))
    low = F.col("xmin") - 0.5
    fits = pairs.groupBy("xmin").agg(F.sum("c").alias("n_tail"), F.sum(F.col("c") * F.log(F.col("size") / low)).alias("s")).where("n_tail >= 3").withColumn("alpha", 1 + F.col("n_tail") / F.col("s"))
    seen = F.sum("c").over(Window.partitionBy("xmin").orderBy("size")) / F.col("n_tail")
    gap = F.abs(seen - (1 - F.pow((F.col("size") + 0.5) / low, 1 - F.col("alpha"))))
    return pairs.join(fits, "xmin").withColumn("gap", gap).groupBy("xmin", "n_tail", "alpha").agg(F.max("gap").alias("ks"))


def power_law_best(sized: DataFrame) -> DataFrame:
    """The scan's fit of least distance (ties: the least xmin) with sigma, and over its tail the BIC of a power law, a lognormal and an exponential, and which is least."""
    fit = power_law_scan(sized).withColumn("near", F.round("ks", 9)).orderBy("near", "xmin").limit(1).drop("near")
    tail = sized.crossJoin(F.broadcast(fit)).where("size >= xmin")  # one row
    log = F.log("size")
    sums = tail.groupBy("xmin", "n_tail", "alpha", "ks").agg(F.sum(log).alias("s"), F.var_pop(log).alias("v"), F.avg("size").alias("mean"))
    n, alpha = F.col("n_tail"), F.col("alpha")
    power = -2 * (n * F.log(alpha - 1) + n * (alpha - 1) * F.log(F.col("xmin") - 0.5) - alpha * F.col("s")) + F.log(n)
    lognormal = 2 * F.col("s") + n * F.log(2 * math.pi * F.col("v")) + n + 2 * F.log(n)
    exponential = 2 * n * (F.log("mean") + 1) + F.log(n)
    told = sums.select("xmin", "n_tail", "alpha", ((alpha - 1) / F.sqrt(n)).alias("sigma"), "ks", power.alias("bic_power_law"), lognormal.alias("bic_lognormal"), exponential.alias("bic_exponential"))
    bics = [F.struct(F.col(f"bic_{m}").alias("b"), F.lit(m).alias("m")) for m in ("power_law", "lognormal", "exponential")]
    return told.withColumn("best", F.array_min(F.array(*bics))["m"])
