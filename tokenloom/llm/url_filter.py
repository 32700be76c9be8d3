"""URL filters (operator 4): rules by host and path, and gradient-boosted trees on lexical features for the rest.

Native: features, suffix statistics and rules are DataFrame functions; the trees are pyspark.ml's.

Features of a url: lengths of url, host and path, depth, digit ratio, character entropy, number of parameters,
hyphens and labels of the host, and suffix statistics: how often the last one, two and three labels of the host
are labelled bad, shrunk towards the rate of the shorter suffix. They leave out the url's own fold (a hash of the
url), in training and in judging alike, so no url sees its own label and the trees learn how far a suffix can be
trusted. Statistics cover all labelled urls; the trees are fitted on at most about MAX_LABELLED distinct ones (a hash
decides), each weighted by its number of rows.

The labelled urls of the query are the pages themselves, by the verdicts of the rules: blocked ones are bad, all others
are presumed good, as is usual where there is a block list alone. The trees carry the list to the pages of which the
rules say nothing: those that look like blocked ones are blocked.

Edge cases: a null url or one without :// has empty host and path and fits no rule; the trees judge it by the
features of its text; without urls of both labels everything that no rule fits is allowed; repeated rows are judged
alike; equal urls are one training row; columns named like the results are replaced, names that begin with _url_ are
reserved, all other columns are kept.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise

# The rules (verdict, rule) of the query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

MAX_LABELLED = 40_000
FOLDS = 16
#: Sites (host and fold) whose suffix statistics may be broadcast to the pages.
MAX_BROADCAST_SITES = 200_000
#: Pseudo-counts with which a suffix leans on the next shorter one.
SHRINK = 8.0
THRESHOLD = 0.5
TREES, DEPTH = 20, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ["length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels"]
SUFFIXES = ["_url_suffix1", "_url_suffix2", "_url_suffix3"]


def _rest(url: Column) -> Column:
    """What follows the first ://, empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits. A rule is host, then a path from its first slash."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        own_host, _, own_path = text.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit("/" + own_path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))

    def share(c: Column) -> Column:
        p = (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
        return F.when(p > 0, -p * F.log(p)).otherwise(0.0)

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
        "entropy": F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda s, c: s + share(c)),
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
    }


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit(""))), F.lit(FOLDS)).cast("int")


def suffix_rates(sites: DataFrame, labelled: DataFrame) -> DataFrame:
    """sites (host, fold) with SUFFIXES: what the other folds know. labelled: host, fold, n, bad (sums over its urls)."""
    total = labelled.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = F.lit(((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0))
    out = sites
    for k, name in enumerate(SUFFIXES, 1):
        sums = labelled.groupBy(_suffix(F.col("host"), k).alias("s"), "fold").agg(F.sum("n").alias("m"), F.sum("bad").alias("b"))
        whole = sums.groupBy("s").agg(F.sum("m").alias("n"), F.sum("b").alias("bad"))
        out = out.withColumn("s", _suffix(F.col("host"), k)).join(whole, "s", "left").join(sums, ["s", "fold"], "left")
        n, bad = (F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)) for x, y in (("n", "m"), ("bad", "b")))
        out = out.withColumn(name, (bad + SHRINK * rate) / (n + SHRINK)).drop("s", "n", "bad", "m", "b")
        rate = F.col(name)
    return out


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url", seed: int = 5) -> DataFrame:
    """pages with host, path, rule, score (probability of a bad url) and verdict. labelled: url, label (1: bad, 0: good)."""
    known = labelled.where("label in (0, 1)").groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.max("label").alias("label"), F.count("*").alias("weight"))
    known = materialise(known.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "fold": fold_of(F.col("url"))}))
    sums = materialise(known.groupBy("host", "fold").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("bad")))
    base = pages.drop("host", "path", "rule", "score", "verdict")
    rows = base.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_url_verdict": verdict})
    classes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return rows.withColumn("score", F.lit(0.0)).withColumn("verdict", F.coalesce("_url_verdict", F.lit("allow"))).drop("_url_verdict")
    # about half of the sample for each label
    odds = {y: min(1.0, MAX_LABELLED / 2 / n) for y, n in classes.items()}
    luck = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(luck < F.when(F.col("label") == 1, odds[1]).otherwise(odds[0]))
    sample = sample.withColumn("weight", F.col("weight") / F.when(F.col("label") == 1, odds[1]).otherwise(odds[0]))
    training = sample.join(suffix_rates(sums.select("host", "fold"), sums), ["host", "fold"]).withColumns(lexical_features(F.col("url"), F.col("host"), F.col("path")))
    assembler = VectorAssembler(inputCols=LEXICAL + SUFFIXES, outputCol="features")
    training = materialise(assembler.transform(training.select("label", F.col("weight").cast("double"), *LEXICAL, *SUFFIXES)).select("features", F.col("label").cast("double"), "weight").repartition(8))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, labelCol="label", weightCol="weight", seed=seed, cacheNodeIds=False).fit(training)
    rows = rows.withColumn("_url_fold", fold_of(F.col(url)))
    sites = materialise(suffix_rates(rows.select("host", F.col("_url_fold").alias("fold")).distinct(), sums).withColumnsRenamed({"host": "_url_host", "fold": "_url_site_fold"}))
    if sites.limit(MAX_BROADCAST_SITES + 1).count() <= MAX_BROADCAST_SITES:
        sites = F.broadcast(sites)
    # beyond that the join is on host and fold, so even a host of most pages is many keys
    joined = rows.join(sites, (F.col("host") == F.col("_url_host")) & (F.col("_url_fold") == F.col("_url_site_fold")), "left")
    featured = joined.withColumns({f"_url_{k}": v for k, v in lexical_features(F.col(url), F.col("host"), F.col("path")).items()})
    fitted = VectorAssembler(inputCols=[f"_url_{k}" for k in LEXICAL] + SUFFIXES, outputCol="_url_features").transform(featured)
    scored = model.setFeaturesCol("_url_features").setPredictionCol("_url_prediction").setProbabilityCol("_url_probability").setRawPredictionCol("_url_raw").transform(fitted)
    scored = scored.withColumn("score", vector_to_array("_url_probability")[1])
    return scored.withColumn("verdict", F.coalesce("_url_verdict", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))).select(*base.columns, "host", "path", "rule", "score", "verdict")


def url_report(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict (and score) of every page."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    _, verdict = rule_of(host_of(F.col("url")), path_of(F.col("url")), RULES)
    labelled = slim.select("url", F.when(verdict == "block", 1).otherwise(0).alias("label"))
    return judge_urls(slim, labelled).select("page_id", "host", "path", "rule", "verdict", "score")
