"""Fingerprints: how documents spread over token buckets, class averages, divergences, features, evaluation, TF-IDF."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.tokens import bucket, without_accents, words

BUCKETS = 40
CLASSES = ["user", "assistant"]
MIN_TOKENS = 3
#: Leading hex digits of an md5 that part the rows of a label into spans.
SPAN_DIGITS = 3
#: Parts of a vocabulary that are ranked by themselves.
TERM_PARTS = 64


def turns(conversations: DataFrame) -> DataFrame:
    """doc, class, text, w (words) of turns by users and assistants; a turn with fewer than MIN_TOKENS words is no document."""
    own = conversations.where(F.col("role").isin(CLASSES)).select(F.concat_ws(":", "conv_id", "turn").alias("doc"), F.col("role").alias("class"), "text", words(F.col("text")).alias("w"))
    return own.where(F.size("w") >= MIN_TOKENS)


def usage(conversations: DataFrame) -> DataFrame:
    """doc, class, cluster, n of the tokens of turns()."""
    return turns(conversations).select("doc", "class", F.explode("w").alias("tok")).groupBy("doc", "class", bucket(F.col("tok"), BUCKETS).alias("cluster")).agg(F.count("*").alias("n"))


def fingerprints(used: DataFrame) -> DataFrame:
    """used with p, the share of the document's tokens."""
    return used.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("doc")))


def averages(prints: DataFrame) -> DataFrame:
    """class, cluster, p: mean shares over a class's documents, zeros included."""
    docs = prints.groupBy("class").agg(F.count_distinct("doc").alias("docs"))
    return prints.groupBy("class", "cluster").agg(F.sum("p").alias("s")).join(F.broadcast(docs), "class").select("class", "cluster", (F.col("s") / F.col("docs")).alias("p"))  # two rows


def side_by_side(mean: DataFrame) -> DataFrame:
    """cluster, h, a: both classes' values for every bucket, absent ones zero."""
    wide = mean.groupBy("cluster").agg(*[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("p"))), F.lit(0.0)).alias(n) for c, n in zip(CLASSES, ("h", "a"), strict=True)])
    every = mean.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("cluster"))
    return every.join(wide, "cluster", "left").select("cluster", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("a", F.lit(0.0)).alias("a"))


def divergences(wide: DataFrame, eps: float = 1e-10) -> DataFrame:
    """kl_ha, kl_ah, js, cosine, pearson of two smoothed distributions."""
    total = wide.agg(F.sum(F.col("h") + eps).alias("sh"), F.sum(F.col("a") + eps).alias("sa"))
    p = wide.crossJoin(F.broadcast(total)).select("h", "a", ((F.col("h") + eps) / F.col("sh")).alias("p"), ((F.col("a") + eps) / F.col("sa")).alias("q"))  # one row
    m = (F.col("p") + F.col("q")) / 2

    def kl(x, y):
        return F.sum(x * F.log(x / y))

    return p.agg(
        kl(F.col("p"), F.col("q")).alias("kl_ha"), kl(F.col("q"), F.col("p")).alias("kl_ah"), ((kl(F.col("p"), m) + kl(F.col("q"), m)) / 2).alias("js"),
        (F.sum(F.col("h") * F.col("a")) / (F.sqrt(F.sum(F.col("h") * F.col("h"))) * F.sqrt(F.sum(F.col("a") * F.col("a"))) + eps)).alias("cosine"), F.corr("h", "a").alias("pearson"),
    )


def chi_squared(counts: DataFrame) -> DataFrame:
    """statistic and dof of homogeneity from class, cluster, n over the buckets that occur (bounded: classes x buckets); corrected for continuity at one degree of freedom."""
    rows, columns, whole = counts.groupBy("class").agg(F.sum("n").alias("r")), counts.groupBy("cluster").agg(F.sum("n").alias("c")), counts.agg(F.sum("n").alias("t"))
    cells = rows.crossJoin(columns).crossJoin(whole).join(counts, ["class", "cluster"], "left").withColumn("e", F.col("r") * F.col("c") / F.col("t"))
    off = F.abs(F.coalesce("n", F.lit(0)) - F.col("e"))
    dof = (F.count_distinct("cluster") - 1) * (F.count_distinct("class") - 1)
    both = cells.agg(F.sum(off * off / F.col("e")).alias("plain"), F.sum(F.pow(off - F.least(off, F.lit(0.5)), 2) / F.col("e")).alias("corrected"), dof.alias("dof"))
    return both.select(F.when(F.col("dof") == 1, F.col("corrected")).otherwise(F.col("plain")).alias("statistic"), "dof")


def chi_squared_tail(x: float, dof: int) -> float:
    """Probability that a chi-squared variable exceeds x: the upper incomplete gamma function by its recurrence in the shape."""
    if x <= 0 or dof <= 0:
        return 1.0
    half = x / 2
    shape, total = (1.0, math.exp(-half)) if dof % 2 == 0 else (0.5, math.erfc(math.sqrt(half)))
    while shape < dof / 2:
        total += math.exp(shape * math.log(half) - half - math.lgamma(shape + 1))
        shape += 1
    return min(1.0, total)


def with_tail(tested: DataFrame) -> DataFrame:
    """tested (statistic and dof, a row for each test) with p_value."""
    tail = F.udf(lambda x, dof: None if x is None else chi_squared_tail(x, dof), "double")  # a row for each test
    return tested.withColumn("p_value", tail(F.col("statistic").cast("double"), F.col("dof").cast("int")))


def ablated(prints: DataFrame, dropped: DataFrame) -> DataFrame:
    """doc, class, cluster, p without the clusters of `dropped` (a bounded list), the rest of each document scaled to one by its counts, which add up to the same number in any order; documents with nothing left have no row."""
    rest = prints.join(F.broadcast(dropped.select("cluster")), "cluster", "left_anti")
    return rest.select("doc", "class", "cluster", (F.col("n") / F.sum("n").over(Window.partitionBy("doc"))).alias("p"))


def surface(prints: DataFrame) -> DataFrame:
    """doc, class, entropy, active, peak of each document."""
    return prints.groupBy("doc", "class").agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))).alias("entropy"), F.count("*").alias("active"), F.max("p").alias("peak"))


def folds(rows: DataFrame, key: str, label: str, k: int, seeds: list[int]) -> DataFrame:
    """key, label, seed, fold: within each label rows are dealt to k folds in the order of an md5.

    Places are counted within spans of the md5 first and shifted by the rows of the spans before, so that no task orders a whole label.
    """
    h = F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col(key).cast("string")).cast("binary"))
    seeded = rows.select(key, label, F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    spanned = seeded.withColumn("h", h).withColumn("span", F.substring("h", 1, SPAN_DIGITS))
    sizes = spanned.groupBy("seed", label, "span").agg(F.count("*").alias("size"))
    before = sizes.select("seed", F.col(label).alias("of"), "span", (F.sum("size").over(Window.partitionBy("seed", label).orderBy("span")) - F.col("size")).alias("before"))
    same = (spanned["seed"] == before["seed"]) & spanned[label].eqNullSafe(before["of"]) & (spanned["span"] == before["span"])
    joined = spanned.join(F.broadcast(before), same).select(spanned["*"], "before")  # at most 16^SPAN_DIGITS rows a label and seed
    place = F.row_number().over(Window.partitionBy("seed", label, "span").orderBy("h", key)) - 1 + F.col("before")
    return joined.select(key, label, "seed", (place % k).cast("int").alias("fold"))


def confusion(rows: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """tp, fp, tn, fn, mcc and balanced_accuracy; zero where a denominator is."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return scored(rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (("tp", t & p), ("fp", ~t & p), ("tn", ~t & ~p), ("fn", t & ~p))]))


def scored(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, tn, fn) with mcc and balanced_accuracy."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(under > 0, (tp * tn - fp * fn) / under).otherwise(0.0)
    recall = [F.when(x + y > 0, x / (x + y)).otherwise(0.0) for x, y in ((tp, fn), (tn, fp))]
    return counts.withColumns({"mcc": mcc, "balanced_accuracy": (recall[0] + recall[1]) / 2})


def robustness_flag(full, surface_only, single):
    """surface-dominated before one-cluster-led before distributed."""
    return F.when(full - surface_only <= 0.05, "surface-dominated").when(single >= 0.95 * full, "one-cluster-led").otherwise("distributed")


def tfidf(docs: DataFrame, terms: int) -> DataFrame:
    """doc_id, tok, weight: sublinear tf, smooth idf, rows of length one, over the commonest terms."""
    tf = docs.select("doc_id", F.explode(words(F.col("text"))).alias("tok")).groupBy("doc_id", "tok").agg(F.count("*").alias("n"))
    vocabulary = tf.groupBy("tok").agg(F.sum("n").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "tok").limit(terms)
    total = docs.agg(F.count("*").alias("docs"))
    known = tf.join(F.broadcast(vocabulary), "tok").crossJoin(F.broadcast(total))  # `terms` rows, and one
    w = known.withColumn("w", (1 + F.log("n")) * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    return w.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))).select("doc_id", "tok", "weight")


def term_counts(docs: DataFrame) -> DataFrame:
    """doc, y (1: assistant), tok, n of turns(): words without accents. Rows of a document share a partition."""
    y = (F.col("class") == "assistant").cast("int").alias("y")
    return docs.repartition("doc").select("doc", y, F.explode(words(without_accents(F.col("text")))).alias("tok")).groupBy("doc", "y", "tok").agg(F.count("*").alias("n"))


def fold_terms(counts: DataFrame, dealt: DataFrame, k: int, terms: int) -> DataFrame:
    """seed, held, tok, place, idf: the commonest terms of the folds that are not held out and their smooth idf.

    Totals without a fold come from one aggregation by seed and term; the terms are ranked within parts of the vocabulary
    first, so that the last ranking sees at most terms x TERM_PARTS rows of a model.
    """
    out = [F.struct(F.lit(f).alias("held"), F.sum(F.when(F.col("fold") != f, F.col("n"))).alias("all"), F.count_if(F.col("fold") != f).alias("df")) for f in range(k)]
    totals = counts.join(dealt.select("doc", "y", "seed", "fold"), ["doc", "y"]).groupBy("seed", "tok").agg(F.array(*out).alias("o")).select("seed", "tok", F.inline("o")).where("df > 0")
    held = F.explode(F.array(*map(F.lit, range(k)))).alias("held")
    sizes = dealt.select("seed", "fold", held).where("fold <> held").groupBy("seed", "held").agg(F.count("*").alias("docs"))  # a row for each model
    order = [F.desc("all"), F.col("tok")]
    part = F.pmod(F.xxhash64("tok"), F.lit(TERM_PARTS))
    some = totals.withColumn("r", F.row_number().over(Window.partitionBy("seed", "held", part).orderBy(*order))).where(F.col("r") <= terms)
    kept = some.withColumn("place", F.row_number().over(Window.partitionBy("seed", "held").orderBy(*order)) - 1).where(F.col("place") < terms)
    return kept.join(F.broadcast(sizes), ["seed", "held"]).select("seed", "held", "tok", "place", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
