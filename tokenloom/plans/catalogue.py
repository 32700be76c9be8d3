"""Registry of the engine's queries; their SQL is in plans.oracles. Every query runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.tokens import bucket, without_accents, words
from tokenloom.functions.vectors import doubles
from tokenloom.operators import clusters, corpus, density, expression, fingerprints, lanczos, linkage, mixtures, models, selection, spectral, stability, taxonomy
from tokenloom.plans.oracles import ORACLES
from tokenloom.sources import arrays
from tokenloom.sources.shared import shared_folder, written
from tokenloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SEEDS = [0, 1, 2, 3, 4]


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that engines that add in another order agree; minus zero is zero."""
    return df.select(*[(F.round(f.name, 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def query(*names: str):
    """Registers a function of tables under its own name; tables come in the order named."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: _rounded(f(*[table(spark, folder, n) for n in names]))
        return f

    return register


# Corpus


@query("documents")
def doc_prediction_lengths(docs):
    return corpus.lengths(docs)


@query("documents")
def tokenize_positions(docs):
    return corpus.positions(docs)


@query("documents")
def flat_index_starts(docs):
    return corpus.flat_starts(docs).select("doc_id", "start")


@query("documents")
def flat_index_lookup(docs):
    return corpus.every_nth(docs, 97)


@query("documents")
def induction_tokens(docs):
    return corpus.induction(docs)


@query("documents")
def token_nll_per_doc(docs):
    return corpus.document_losses(docs)


@query("documents")
def non_induction_zero_loss(docs):
    return corpus.eligible(docs, 1.0)


@query("documents")
def systematic_sample(docs):
    return corpus.systematic(corpus.eligible(docs, 1.0), 50)


# Similarity and clusters


def similarity_search(spark: SparkSession, folder: str) -> DataFrame:
    """Rounded where it is made: Spark's round() goes by the digits of each number, and took most of the time."""
    vectors = table(spark, folder, "embeddings")
    return clusters.similarities(vectors, vectors.where("vec_id % 100 = 0"), 6)


QUERIES["similarity_search"] = similarity_search


@query("embeddings")
def nearest_representative(vectors):
    return clusters.nearest_seed(vectors, [100]).drop("k")


@query("embeddings")
def assignment_quality(vectors):
    near = clusters.nearest_seed(vectors, [100])
    s = F.col("similarity")
    return near.agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("least"), F.max(s).alias("most"), F.avg((s < 0.1).cast("double")).alias("weak"), F.avg((s > 0.3).cast("double")).alias("strong"), F.percentile(s, 0.5).alias("median"))


@query("embeddings")
def cluster_medoids(vectors):
    return clusters.medoids(vectors)


@query("embeddings")
def cluster_sizes(vectors):
    return clusters.sizes(clusters.nearest_seed(vectors), "k")


@query("embeddings")
def rank_frequency_per_k(vectors):
    return clusters.ranked(clusters.sizes(clusters.nearest_seed(vectors), "k"), "k")


@query("embeddings")
def envelope_curve(vectors):
    return clusters.envelope(clusters.nearest_seed(vectors))


@query("embeddings")
def envelope_slope_seed_sweep(vectors):
    return clusters.slope(clusters.envelope(clusters.nearest_seed(vectors)), 5, 100).select("slope", "n")


@query("embeddings")
def slope_intercept_anchor(vectors):
    return clusters.slope(clusters.envelope(clusters.nearest_seed(vectors)), 1, 100)


@query("embeddings")
def slope_fallback_window(vectors):
    points = clusters.ranked(clusters.sizes(clusters.nearest_seed(vectors), "k"), "k")
    near, whole = clusters.slope(points, 10, 400, "k").select("k", F.col("slope").alias("near")), clusters.slope(points, 1, 10**9, "k").select("k", F.col("slope").alias("whole"))
    return whole.join(near, "k", "left").select("k", F.coalesce("near", "whole").alias("slope"))


def _sweep(vectors: DataFrame) -> DataFrame:
    """Clusterings of three configurations: seeds from three offsets."""
    parts = [clusters.nearest_seed(vectors, offset=o).withColumn("cfg", F.lit(o)) for o in (0, 100, 200)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("embeddings")
def best_config_by_delta(vectors):
    points = clusters.ranked(clusters.sizes(_sweep(vectors), "cfg", "k"), "cfg", "k").groupBy("cfg", "rank").agg(F.max("size").alias("size"))
    found = clusters.slope(points, 5, 100, "cfg").withColumn("delta", F.abs(F.col("slope") - clusters.TARGET))
    best = found.agg(F.min(F.struct(F.coalesce(F.round("delta", 9), F.lit(float("inf"))).alias("delta"), "cfg", "slope")).alias("b"))
    return best.select("b.cfg", "b.slope", "b.delta")


@query("embeddings")
def most_active_config(vectors):
    active = _sweep(vectors).where("k = 100").groupBy("cfg").agg(F.count_distinct("label").alias("active"))
    return active.agg(F.min(F.struct((-F.col("active")).alias("m"), "cfg")).alias("b")).select("b.cfg", (-F.col("b.m")).alias("active"))


@query("embeddings")
def slope_heatmap_pivot(vectors):
    points = clusters.ranked(clusters.sizes(_sweep(vectors), "cfg", "k"), "cfg", "k")
    wide = clusters.slope(points, 1, 100, "cfg", "k").groupBy("cfg").pivot("k", [20, 50, 100]).agg(F.first("slope"))
    return wide.select("cfg", *[F.col(str(k)).alias(f"k{k}") for k in (20, 50, 100)])


@query("orders")
def power_law_fit(orders):
    return clusters.power_law(orders.groupBy("o_custkey").agg(F.count("*").alias("size")))


def _two(vectors: DataFrame) -> DataFrame:
    a, b = (clusters.nearest_seed(vectors, [20], o) for o in (0, 100))
    return clusters.contingency(a, b)


@query("embeddings")
def contingency(vectors):
    return _two(vectors)


@query("embeddings")
def ari_nmi(vectors):
    return clusters.agreement(_two(vectors))


@query("embeddings")
def adjusted_mutual_information(vectors):
    return clusters.adjusted_information(_two(vectors))


@query("embeddings")
def optimal_cluster_match(vectors):
    return clusters.assigned(_two(vectors))


@query("embeddings")
def cluster_match_jaccard(vectors):
    return clusters.matched(_two(vectors))


@query("embeddings")
def match_summary(vectors):
    return clusters.match_summary(_two(vectors))


@query("embeddings")
def random_baseline(vectors):
    """Agreement of the labels with labels dealt by a hash."""
    dealt = vectors.select("vec_id", bucket(F.col("vec_id").cast("string"), 10).alias("label"))
    return clusters.agreement(clusters.contingency(vectors, dealt))


@query("embeddings")
def cluster_ordered_top500(vectors):
    return clusters.in_cluster_order(vectors.select("vec_id", "label"), 500)


@query("embeddings")
def submatrix_slice(vectors):
    """Cosines among the first 50 vectors in the order of clusters."""
    ids = clusters.in_cluster_order(vectors.select("vec_id", "label"), 50).select("vec_id")
    some = vectors.join(F.broadcast(ids), "vec_id", "left_semi")
    return clusters.similarities(some, some).where("query_id < vec_id").select("query_id", "vec_id", "cosine")


@query("embeddings")
def similarity_bands(vectors):
    """Vectors by fifths of the similarity to their nearest seed."""
    band = F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.col("similarity") * 5))).cast("int")
    return clusters.nearest_seed(vectors, [100]).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("embeddings")
def similarity_percentiles(vectors):
    near = clusters.nearest_seed(vectors, [100])
    return near.agg(*[F.percentile("similarity", q / 100).alias(f"p{q}") for q in (5, 25, 50, 75, 95)])


@query("embeddings")
def cluster_fragmentation(vectors):
    return clusters.fragmentation(_two(vectors))


@query("embeddings")
def bootstrap_sample(vectors):
    return clusters.sampled(vectors, 0.8, list(range(10)))


def _bootstrapped(vectors: DataFrame) -> DataFrame:
    near = clusters.nearest_seed(vectors, [20]).select("vec_id", F.col("label").alias("la"))
    cells = clusters.sampled(vectors, 0.8, list(range(10))).join(near, "vec_id").join(vectors.select("vec_id", F.col("label").alias("lb")), "vec_id")
    return clusters.agreement(cells.groupBy("iter", "la", "lb").agg(F.count("*").alias("n")), "iter")


@query("embeddings")
def bootstrap_agreement(vectors):
    each = _bootstrapped(vectors)
    return each.agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in ("ari", "nmi") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("least", F.min), ("most", F.max))])


@query("embeddings")
def running_bootstrap(vectors):
    return clusters.running(_bootstrapped(vectors), "ari")


@query("embeddings")
def resume_remaining(vectors):
    wanted = vectors.sparkSession.range(10).select(F.col("id").cast("int").alias("iter"))
    done = clusters.sampled(vectors, 0.01, list(range(10))).select("iter").distinct().where("iter % 2 = 0")
    return wanted.join(done, "iter", "left_anti")


# Taxonomy


def _tokens(docs: DataFrame) -> DataFrame:
    return taxonomy.counted(docs, "source")


@query("documents")
def token_categories(docs):
    return taxonomy.category_sizes(_tokens(docs))


@query("documents")
def dominant_category(docs):
    return taxonomy.dominant(_tokens(docs))


@query("documents")
def top_tokens_per_cluster(docs):
    return taxonomy.top_tokens(_tokens(docs))


@query("documents")
def category_shares(docs):
    return taxonomy.shares(taxonomy.category_sizes(_tokens(docs)))


@query("documents")
def content_bearing_pct(docs):
    return taxonomy.content_bearing(taxonomy.dominant(_tokens(docs)))


@query("documents")
def paper_quanta_counts(docs):
    tokens = _tokens(docs)
    return taxonomy.special_clusters(taxonomy.dominant(tokens), taxonomy.top_tokens(tokens))


def _by_lang(docs: DataFrame) -> DataFrame:
    tokens = taxonomy.counted(docs, "lang")
    return taxonomy.aligned(*[taxonomy.category_sizes(tokens.where(F.col("cluster") == x)) for x in ("en", "fr")])


@query("documents")
def category_full_outer_align(docs):
    return _by_lang(docs)


@query("documents")
def cross_split_pearson(docs):
    return _by_lang(docs).agg(F.corr(F.col("left_n").cast("double"), F.col("right_n").cast("double")).alias("pearson"))


@query("documents", "embeddings")
def category_lookup_unknown(docs, vectors):
    names = taxonomy.dominant(_tokens(docs)).select(F.regexp_extract("cluster", r"\d+", 0).cast("int").alias("cluster"), "category")
    return taxonomy.looked_up(clusters.sizes(clusters.nearest_seed(vectors, [50])).select(F.col("label").alias("cluster"), "size"), names)


# Fingerprints and evaluation


@query("conversations")
def doc_fingerprint(rows):
    return fingerprints.fingerprints(fingerprints.usage(rows))


@query("conversations")
def average_fingerprint(rows):
    return fingerprints.averages(fingerprints.fingerprints(fingerprints.usage(rows)))


@query("conversations")
def class_counts(rows):
    return fingerprints.usage(rows).groupBy("class", "cluster").agg(F.sum("n").alias("n"))


@query("conversations")
def active_counts(rows):
    return fingerprints.usage(rows).groupBy("class").agg(F.count_distinct("cluster").alias("active"), F.count_distinct("doc").alias("docs"), F.sum("n").alias("tokens"))


@query("conversations")
def divergences(rows):
    return fingerprints.divergences(fingerprints.side_by_side(fingerprints.averages(fingerprints.fingerprints(fingerprints.usage(rows)))))


@query("conversations")
def top_differing(rows):
    wide = fingerprints.side_by_side(fingerprints.averages(fingerprints.fingerprints(fingerprints.usage(rows))))
    return wide.withColumn("diff", F.round(F.col("h") - F.col("a"), 9)).orderBy(F.desc(F.abs("diff")), "cluster").limit(15)


@query("conversations")
def chi_squared_homogeneity(rows):
    return fingerprints.chi_squared(fingerprints.usage(rows).groupBy("class", "cluster").agg(F.sum("n").alias("n")))


@query("conversations")
def chi_squared_p_value(rows):
    return fingerprints.with_tail(fingerprints.chi_squared(fingerprints.usage(rows).groupBy("class", "cluster").agg(F.sum("n").alias("n"))))


@query("conversations")
def fingerprint_ablation(rows):
    """Fingerprints without the cluster whose class averages differ most."""
    prints = fingerprints.fingerprints(fingerprints.usage(rows))
    best = fingerprints.side_by_side(fingerprints.averages(prints)).orderBy(F.desc(F.abs(F.round(F.col("h") - F.col("a"), 9))), "cluster").limit(1)
    return fingerprints.ablated(prints, best)


@query("conversations")
def capped_tokens(rows):
    return corpus.capped(rows, "assistant", 6000)


@query("documents")
def prompt_draw(docs):
    return corpus.drawn_prompts(docs, 600, 10)


@query("conversations")
def surface_features(rows):
    return fingerprints.surface(fingerprints.fingerprints(fingerprints.usage(rows)))


@query("labels")
def stratified_folds(labels):
    return fingerprints.folds(labels, "doc_id", "quality", 5, SEEDS)


@query("labels", "documents")
def confusion_per_fold(labels, docs):
    """A threshold on length against quality, by seed and fold."""
    dealt = fingerprints.folds(labels, "doc_id", "quality", 5, SEEDS).join(docs.select("doc_id", (F.char_length("text") > 1500).cast("int").alias("predicted")), "doc_id")
    return fingerprints.confusion(dealt, "quality", "predicted", "seed", "fold")


@query("labels", "documents")
def robustness_flags(labels, docs):
    """Three predictors of quality compared by the order of the rules."""
    own = labels.join(docs.select("doc_id", "text", "lang"), "doc_id")
    marks = {"full": ~F.col("text").rlike(r"\$\$\$|%%%| \| "), "surface": F.char_length("text") > 200, "single": ~F.contains("text", F.lit("%%%"))}
    rows = own.select("lang", "quality", F.explode(F.create_map(*[x for k, v in marks.items() for x in (F.lit(k), v.cast("int"))])).alias("what", "predicted"))
    wide = fingerprints.confusion(rows, "quality", "predicted", "lang", "what").groupBy("lang").pivot("what", ["full", "single", "surface"]).agg(F.first(F.round("mcc", 9)))
    return wide.withColumn("flag", fingerprints.robustness_flag(F.col("full"), F.col("surface"), F.col("single")))


@query("documents")
def tfidf_weights(docs):
    return fingerprints.tfidf(docs, 10_000)


@query("conversations")
def bag_of_words_terms(rows):
    """What each training fold of the bag-of-words baseline learns: its terms and their idf."""
    counts = fingerprints.term_counts(fingerprints.turns(rows))
    return fingerprints.fold_terms(counts, fingerprints.folds(counts.select("doc", "y").distinct(), "doc", "y", 5, SEEDS), 5, 10_000)


@query("documents")
def accent_stripped_terms(docs):
    terms = docs.select("doc_id", F.explode(F.array_distinct(words(without_accents(F.col("text"))))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


@query("embeddings")
def silhouette_search(vectors):
    return clusters.silhouette(vectors, vectors.where("vec_id % 100 = 0"))


@query("orders")
def power_law_xmin_scan(orders):
    return clusters.power_law_scan(orders.groupBy("o_custkey").agg(F.count("*").alias("size")))


@query("orders")
def power_law_best(orders):
    return clusters.power_law_best(orders.groupBy("o_custkey").agg(F.count("*").alias("size")))


# Filters, lookups and orders


@query("conversations")
def generated_region(rows):
    tokens = rows.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(words(F.col("text"))).alias("pos", "tok"))
    return selection.generated_region(tokens, 10).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("part")
def parameter_names(parts):
    kept = selection.named_without(parts, "p_name", ["red", "widget"])
    return kept.agg(F.count("*").alias("names"), F.sum("p_size").alias("size"))


@query("embeddings")
def noise_dropped_sizes(vectors):
    near = clusters.nearest_seed(vectors, [100]).withColumn("label", F.when(F.col("similarity") < 0.3, -1).otherwise(F.col("label")))
    return selection.without_noise(near, "label").groupBy("label").agg(F.count("*").alias("size"))


@query("embeddings")
def lively_clusterings(vectors):
    return clusters.sizes(selection.lively(clusters.nearest_seed(vectors, [2, 3, 5, 10]), 5, "k"), "k")


@query("embeddings")
def capped_k_list(vectors):
    return clusters.sizes(clusters.nearest_seed(vectors).where("k <= 20"), "k").agg(F.max("k").alias("greatest_k"), F.min("k").alias("least_k"), F.count_distinct("k").alias("ks"))


@query("embeddings")
def successful_iterations(vectors):
    """Of twelve iterations asked for, those with a result."""
    wanted = vectors.sparkSession.range(12).select(F.col("id").cast("int").alias("iter"))
    return wanted.join(_bootstrapped(vectors), "iter", "left").where("ari is not null").select("iter", "ari", "nmi")


@query("conversations")
def differences_nulled(rows):
    wide = fingerprints.side_by_side(fingerprints.averages(fingerprints.fingerprints(fingerprints.usage(rows))))
    return wide.select("cluster", selection.nulled(F.round(F.col("h") - F.col("a"), 9), 0.001).alias("diff"))


@query("conversations")
def clusters_by_frequency(rows):
    wide = fingerprints.side_by_side(fingerprints.averages(fingerprints.fingerprints(fingerprints.usage(rows))))
    return wide.select("cluster", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("h", 9)), "cluster")).alias("place"))  # one row a bucket


@query("documents", "events")
def flat_index_join(docs, events):
    """Where given flat indexes lie: the events' numbers, seven apart."""
    return corpus.looked_up(events.select((F.col("event_id") * 7).alias("flat")), docs)


@query("embeddings")
def nearest_medoid(vectors):
    return clusters.nearest_of(vectors, clusters.medoids(vectors).select("label", "vec_id"))


@query("documents")
def synonyms_folded(docs):
    name = selection.folded(F.col("lang"), {"de": "german", "fr": "french"})
    return docs.groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query("documents")
def colours_found(docs):
    colour = selection.found(F.upper(F.col("lang")), {"en": "blue", "es": "red"}, "grey")
    return docs.groupBy(colour.alias("colour")).agg(F.count("*").alias("n"))


@query("part")
def method_slugs(parts):
    name = selection.slug(F.regexp_replace("p_brand", "#", "-"))
    return parts.groupBy(name.alias("slug"), selection.without_prefix(name, "brand_").alias("rest")).agg(F.count("*").alias("n"))


@query("embeddings")
def flattened_slopes(vectors):
    """Slopes by configuration as keys and formatted numbers of a report."""
    points = clusters.ranked(clusters.sizes(_sweep(vectors), "cfg", "k"), "cfg", "k")
    found = clusters.slope(points, 1, 100, "cfg", "k").where("slope is not null")
    return found.select(selection.flat_key(offset=F.col("cfg"), k=F.col("k")).alias("key"), selection.signed(F.round("slope", 6)).alias("slope"))


@query("embeddings")
def reference_line(vectors):
    curve = clusters.envelope(clusters.nearest_seed(vectors))
    return selection.reference_line(curve.select("rank"), clusters.slope(curve, 1, 100).select("slope", "anchor"))


@query("embeddings")
def best_config_clusters(vectors):
    """Cluster sizes of the recorded best configuration at k = 100."""
    sweep = _sweep(vectors).where("k = 100")
    active = sweep.groupBy("cfg").agg(F.count_distinct("label").alias("active"))
    best = active.agg(F.min(F.struct((-F.col("active")).alias("m"), "cfg")).alias("b")).select("b.cfg")
    return clusters.sizes(sweep.join(F.broadcast(best), "cfg"), "cfg")


@query("documents")
def vocabulary_decode(docs):
    """Documents read back from the numbers of their tokens in the whole vocabulary; empty ones are empty."""
    tokens = corpus.positions(docs)
    known = written(selection.whole_vocabulary(tokens))
    ids = written(tokens.join(known.select("id", "tok"), "tok").select("doc_id", "pos", "id"))
    back = selection.decoded(ids, known)
    return docs.select("doc_id").join(back, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("documents")
def categories_by_size(docs):
    sized = selection.by_size(taxonomy.dominant(_tokens(docs)))
    share = [F.round(100 * F.col(c) / F.sum(c).over(Window.partitionBy()), 2).alias(f"{c}_pct") for c in ("clusters", "tokens")]
    return sized.select("*", *share)


@query("documents")
def categories_common(docs):
    """Categories of the tokens of two languages: one pass for both, whose few rows are written before they are compared."""
    sizes = written(taxonomy.category_sizes(taxonomy.counted(docs.where(F.col("lang").isin("en", "de")), "lang"), "cluster"))
    left, right = (sizes.where(F.col("cluster") == x).select("category") for x in ("en", "de"))
    return left.intersect(right).withColumn("where", F.lit("both")).union(left.union(right).distinct().withColumn("where", F.lit("any")))


@query("embeddings")
def top_matched_pairs(vectors):
    return clusters.matched(_two(vectors)).withColumn("jaccard", F.round("jaccard", 9)).orderBy(F.desc("jaccard"), "la").limit(15)


@query("embeddings")
def silhouette_mean(vectors):
    return clusters.silhouette(vectors, vectors.where("vec_id % 100 = 0")).agg(F.avg("silhouette").alias("mean"), F.count("*").alias("n"))


# Fitted models: no SQL; tests hold them against plain versions and planted data


def _prints(rows: DataFrame) -> DataFrame:
    return models.wide(fingerprints.fingerprints(fingerprints.usage(rows)))


@query("conversations")
def logistic_cv(rows):
    return models.cross_validated(_prints(rows))


@query("conversations")
def logistic_seed_summary(rows):
    """Mean and deviation over five seeds, 25 fits."""
    return models.seed_summary(models.cross_validated(_prints(rows), 5, [0, 1, 2, 3, 4]))


@query("conversations")
def bag_of_words_cv(rows):
    return models.bag_of_words(fingerprints.turns(rows), 5, 0)


@query("conversations")
def permutation_baseline(rows):
    return models.cross_validated(models.permuted(_prints(rows)))


@query("conversations")
def l1_selection(rows):
    return models.l1_selected(_prints(rows).cache(), [0.1, 0.178, 0.316, 1.0])


@query("embeddings")
def pca_variance(vectors):
    _, shares = models.projected(vectors, 20)
    total = 0.0
    rows = [(n + 1, float(v), total := total + float(v)) for n, v in enumerate(shares)]
    return vectors.sparkSession.createDataFrame(rows, "axis int, share double, cumulative double")


@query("embeddings")
def gmm_diagnostics(vectors):
    return models.mixture_summary(models.mixture(vectors))


@query("embeddings")
def ssc_omp_graph(vectors):
    return models.graph_stats(models.affinity(models.self_expression(vectors, "omp", 5)), vectors.count())


@query("embeddings")
def ssc_lasso_graph(vectors):
    return models.graph_stats(models.affinity(models.self_expression(vectors, "lasso", 0.01)), vectors.count())


@query("conversations")
def single_quantum_sweep(rows):
    return models.single_cluster_sweep(fingerprints.fingerprints(fingerprints.usage(rows)))


@query("embeddings")
def spectral_angular(vectors):
    return clusters.contingency(spectral.spectral(vectors, 10), vectors)


@query("embeddings")
def spectral_absolute(vectors):
    return clusters.contingency(spectral.spectral(vectors, 10, "absolute"), vectors)


@query("embeddings")
def ssc_power_iteration(vectors):
    return spectral.power_iteration(models.affinity(models.self_expression(vectors, "omp", 5)), 10)


@query("embeddings")
def complete_linkage(vectors):
    return spectral.complete_linkage(vectors, [10, 20, 50, 100, 200, 400])


@query("embeddings")
def linkage_bootstrap(vectors):
    return clusters.agreement(spectral.linkage_bootstrap(vectors, 20), "iter")


@query("embeddings")
def ssc_lasso_clusters(vectors):
    return clusters.contingency(expression.expression_clusters(vectors, "lasso", 20, 0.001, [10])[0], vectors)


@query("embeddings")
def ssc_omp_clusters(vectors):
    return clusters.contingency(expression.expression_clusters(vectors, "omp", 20, 5, [10])[0], vectors)


@query("embeddings")
def ssc_sweep(vectors):
    """Axes by alpha, and axes by number of rows, each over all k."""
    return expression.sweep(vectors, [("lasso", 10, 0.001), ("lasso", 20, 0.001), ("lasso", 20, 0.01), ("omp", 20, 5), ("omp", 20, 10)], [5, 10, 20])


@query("embeddings")
def spectral_landmark_error(vectors):
    """Agreement of the clustering over landmarks with that of the whole affinity, whose eigenvectors have the residual told."""
    exact, residual = lanczos.exact_spectral(vectors, [10])
    return clusters.agreement(clusters.contingency(exact, spectral.spectral(vectors, 10))).withColumn("residual", F.lit(residual))


@query("embeddings")
def complete_linkage_exact(vectors):
    return linkage.complete_linkage(vectors, [10, 20, 50, 100, 200, 400])


@query("embeddings")
def density_clusters(vectors):
    """HDBSCAN's labels of all vectors, null for noise, and how firmly each belongs."""
    return density.density_clusters(vectors)


@query("embeddings")
def gmm_diagonal(vectors):
    return mixtures.diagonal_summary(written(expression.similarity_axes(vectors, 50)[0]))


@query("embeddings")
def recluster_bootstrap(vectors):
    """Spectral and sparse self-expression clusters fitted again on exact samples of four fifths of all rows."""
    base = f"{shared_folder(vectors.sparkSession)}/study-{uuid.uuid4().hex}"
    fits = {
        "spectral": lambda v: spectral.spectral(v, 10),
        "omp": lambda v: expression.expression_clusters(v, "omp", 20, 5, [10])[0],
    }
    steps = [stability.reclustered(vectors, name, fit, 2, 0.8, f"{base}-{name}", {"k": 10}) for name, fit in fits.items()]
    return stability.summary(steps[0].union(steps[1]))


# Stored arrays: written as files of the format, read back by its data source


def _stored(df: DataFrame, form: str, **options) -> DataFrame:
    spark = df.sparkSession
    arrays.register(spark)
    path = f"{shared_folder(spark)}/{form}-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).mode("append").save(path)
    return spark.read.format(form).options(**options).load(path)


@query("embeddings")
def stored_matrix(vectors):
    """Vectors in order of their ids as rows of NPY files."""
    ordered = vectors.where("embedding is not null").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    rows = _stored(ordered.select(doubles(F.col("embedding")).alias("v")), "npy_rows")
    return rows.select("row", F.size("value").alias("dims"), F.aggregate("value", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("embeddings")
def stored_labels(vectors):
    """Labels in order of their ids as members of NPZ files, found under the second of two names."""
    ordered = vectors.where("label is not null").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    return _stored(ordered.select("label"), "npz_member", members="label,cluster_labels").select("row", F.col("value").alias("label"))


@query("documents")
def stored_lengths(docs):
    """Lengths of documents as Arrow files."""
    return _stored(corpus.lengths(docs), "arrow_ipc")


@query("embeddings")
def softmax_nll(vectors):
    """A stored table of losses of two models, whose logits are the vectors at two scales and whose targets are the labels; the sharper model's rows."""

    def scaled(by: float):
        return F.transform(doubles(F.col("embedding")), lambda x: x * by)

    models_of = [F.struct(F.lit(name).alias("model"), scaled(by).alias("logits")) for name, by in (("plain", 1.0), ("sharp", 8.0))]
    rows = vectors.select("vec_id", F.col("label").alias("target"), F.inline(F.array(*models_of)))
    losses = written(corpus.softmax_losses(rows).select("vec_id", "model", "loss"))
    return corpus.of_model(losses, "sharp")
