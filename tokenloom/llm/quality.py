"""Quality classifier (operator 6): document evidence joined with host and path posteriors by hierarchical empirical Bayes.

 1. A logistic model over FEATURES of the whole text is fitted on a bounded sample of the labelled rows
    (MAX_LABELLED, chosen by a hash of the id) and gives each document a log-likelihood ratio: its evidence.
 2. Over all documents, the classifier's probabilities are added up by site (host, path). A host's posterior mean
    shrinks towards the global rate, a path's towards its host's. How much is read off the data: the strength of
    each prior is the beta law's whose variance is what the rates vary beyond chance (method of moments).
 3. A document's score is the logistic of its evidence plus the log odds of its path's posterior, from which the
    document's own share is left out. It is kept if the score is at least THRESHOLD.

Sites are pre-aggregated before any shuffle, so a host with a third of all rows is a few sums. Posteriors come back
to the documents by a broadcast of at most MAX_BROADCAST_SITES sites, else by a join that splits skewed hosts.

Edge cases: null and empty texts have all features zero; null site columns are sites of their own; null labels do
not count and a row labelled twice is good only if it always is; without labels of both classes the evidence is
zero and everything is kept; repeated rows count each time; an empty table gives no rows; columns named like the
results are replaced, others are kept.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise, set_aside, utf8, with_computed

MAX_LABELLED = 20_000
MAX_BROADCAST_SITES = 200_000
THRESHOLD = 0.5
#: Bound of one document's log-likelihood ratio: a text unlike any labelled one is no surer than that.
MOST_EVIDENCE = 12.0
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 1e5
RESULTS = ["evidence", "host_posterior", "path_posterior", "score", "kept"]
FEATURES = ["log_words", "word_length", "upper", "digits", "punctuation", "symbols", "pipes", "exclamations", "marked_ends", "distinct_words", "repeated_lines", "line_length", "shouted", "repeated_marks"]

KEEP = {name: bytes(b for b in range(256) if not test(b)) for name, test in {
    "upper": lambda b: 65 <= b <= 90, "digits": lambda b: 48 <= b <= 57, "punctuation": lambda b: b in b".,;:?'\"()-",
    "symbols": lambda b: b in b"#$%&*+=<>@[]\\^_`{}~/", "pipes": lambda b: b == 124, "exclamations": lambda b: b == 33,
}.items()}
MARKS = (b"!!", b"##", b"$$", b"%%", b"&&", b"**", b"| ", b"..")


def features(text: object) -> list[float]:
    """Numbers of FEATURES of one text, most of them between 0 and 1."""
    raw = utf8(text)
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    count = {k: len(raw.translate(None, drop)) / size for k, drop in KEEP.items()}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = b"".join([w[-1:] for w in words])
    starts = b"".join([w[:1] for w in words])
    return [
        math.log(n), math.log(size / n), count["upper"], count["digits"], count["punctuation"], count["symbols"], count["pipes"], count["exclamations"],
        len(ends.translate(None, KEEP["symbols"])) / n, len(set(words)) / n, 1 - len(set(lines)) / len(lines), math.log(n / len(lines)),
        len(starts.translate(None, KEEP["upper"])) / n, sum(map(raw.count, MARKS)) / n,
    ]


def _with_evidence(docs: DataFrame, weights: np.ndarray | None, bias: float, keep: list[str]) -> DataFrame:
    """keep columns of docs, and evidence."""

    def start():
        def compute(texts: list) -> list:
            if weights is None:
                return [[0.0] * len(texts)]
            found = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)) @ weights + bias
            return [np.clip(found, -MOST_EVIDENCE, MOST_EVIDENCE)]

        return compute

    base = docs.select(*dict.fromkeys([*keep, "text"]))
    return with_computed(base, ["text"], "evidence double", start, without=() if "text" in keep else ("text",))


def fit_evidence(docs: DataFrame, labels: DataFrame, label: str) -> tuple[np.ndarray | None, float]:
    """Weights and bias of the log-likelihood ratio of label 1 against 0; docs: doc_id, text."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    sample = materialise(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # at most MAX_LABELLED rows

    def start():
        return lambda texts: [[features(t) for t in texts]]

    table = materialise(with_computed(rows.select("text", F.col("y").cast("double").alias("y")), ["text"], "x array<double>", start, without=("text",)))
    seen = {r["y"]: r["n"] for r in table.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return None, 0.0
    model = LogisticRegression(featuresCol="v", labelCol="y", regParam=1e-3, maxIter=60).fit(table.withColumn("v", array_to_vector("x")))
    return model.coefficients.toArray(), float(model.intercept) - math.log(seen[1.0] / seen[0.0])


def strength(groups: DataFrame, rate: str) -> float:
    """Strength of the beta prior around the column rate, given groups with n documents and good: their summed probabilities."""
    r = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("j"), F.sum(F.col(rate) * F.col("n")).alias("m"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(rate), 2)).alias("s"), F.sum(F.col(rate) * (1 - F.col(rate))).alias("chance"),
    ).first()
    if not r["n"]:
        return WEAKEST
    mean = r["m"] / r["n"]
    beyond = (r["s"] - r["chance"]) / r["n"]
    return min(STRONGEST, max(WEAKEST, mean * (1 - mean) / beyond - 1)) if beyond > 0 else STRONGEST


def site_posteriors(rows: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """(_host, _path, _n, _good, _host_posterior) of each site and the strength of a host's prior over its paths. rows: host, path, p."""
    sites = materialise(rows.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    whole = sites.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (whole["good"] or 0.0) / whole["n"] if whole["n"] else 0.5
    hosts = sites.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("rate", F.lit(rate))
    k_host = strength(hosts, "rate")
    hosts = hosts.select(F.col("_host").alias("_h"), ((F.col("good") + k_host * F.col("rate")) / (F.col("n") + k_host)).alias("_host_posterior"))
    joined = materialise(sites.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h"))
    k_path = strength(joined, "_host_posterior")
    return joined.withColumnsRenamed({"n": "_n", "good": "_good"}), k_path


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", host: str = "source", path: str = "lang") -> DataFrame:
    """docs with evidence, host_posterior, path_posterior, score and kept."""
    base, back = set_aside(docs.drop(*RESULTS), ["_host", "_path", "_n", "_good", "_host_posterior"])
    host, path = ({c: new for new, c in back.items()}.get(n, n) for n in (host, path))
    weights, bias = fit_evidence(base, labels.select("doc_id", label), label)
    prior = labels.where(F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    prior = min(0.999, max(0.001, prior if prior is not None and weights is not None else 0.9))
    odds = math.log(prior / (1 - prior))

    def logistic(x):
        return 1 / (1 + F.exp(-x))

    own = logistic(F.col("evidence") + odds)
    seen = _with_evidence(base, weights, bias, [host, path]).select(host, path, own.alias("p"))
    sites, k_path = site_posteriors(seen, host, path)
    if sites.limit(MAX_BROADCAST_SITES + 1).count() <= MAX_BROADCAST_SITES:
        sites = F.broadcast(sites)
    scored = _with_evidence(base, weights, bias, base.columns)
    scored = scored.join(sites, F.col(host).eqNullSafe(F.col("_host")) & F.col(path).eqNullSafe(F.col("_path")), "left")
    rate = (F.col("_good") - own + k_path * F.col("_host_posterior")) / (F.col("_n") - 1 + k_path)
    rate = F.least(F.lit(0.999), F.greatest(F.lit(0.001), rate))
    scored = scored.withColumn("host_posterior", F.col("_host_posterior")).withColumn("path_posterior", rate)
    scored = scored.withColumn("score", logistic(F.col("evidence") + F.log(F.col("path_posterior") / (1 - F.col("path_posterior")))))
    return scored.withColumn("kept", F.col("score") >= THRESHOLD).select(*base.columns, *RESULTS).withColumnsRenamed(back)


def without_poor(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """docs, all columns as they are, that are kept."""
    base, back = set_aside(docs, RESULTS)
    return score_documents(base, labels, label).where("kept").select(*base.columns).withColumnsRenamed(back)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score and kept of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    return score_documents(slim, labels).select("doc_id", *RESULTS)
