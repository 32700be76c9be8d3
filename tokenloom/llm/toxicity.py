"""Toxicity (operator 10): nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

 1. Equal texts of labelled training rows are folded into one example; at most MAX_POSITIVE and MAX_NEGATIVE of them
    (a hash of the text decides) are the index. Its vocabulary is every word of these examples.
 2. Weight of a word in a text: (1 + ln tf) * max(0, ln((N - df + 0.5) / (df + 0.5))), df counted over all N documents;
    words that half of the documents hold weigh nothing. Vectors have length one.
 3. Examples that use alike words (k-means on the driver, over the sample) stand in blocks of BLOCK rows. Postings are by word
    and block; each word knows its largest weight in each block. The DENSE_WORDS commonest words of the sample are
    columns of a matrix instead, and many texts' products with them are taken at once. A text's bound for a block is the
    largest of these products in it and the product of the other words with their largest weights; blocks are opened in
    order of their bounds until no block can hold one of the NEIGHBOURS nearest, which are therefore exact.
 4. The nearest examples vote with their cosines: NEIGHBOURS of them, or one in VOTERS of the sample where that is more. A
    logistic curve, fitted to the votes that the examples get from all other
    examples, each weighted by the rows it stands for, turns the share of toxic votes into a calibrated probability. The
    share of toxic rows rises more steeply than one logistic curve over all votes, so the fit is a local one: votes count
    by their nearness to the vote at which the curve says THRESHOLD, where predictions are decided.
 5. Votes of different kinds of text lie at different heights: among texts of one language, say, a share of 0.4 may be
    plainly toxic and be common among clean texts of another. From LEVEL_EXAMPLES on, the curve has the level of the
    neighbourhood as its second input: the mean, by cosines, of the votes that the voters themselves get from all other examples.

Edge cases: null and empty texts, and texts without a weighted word of the index, have no neighbour and get the share
of toxic rows; labels that are null do not count, a text labelled twice counts as toxic if it is so once; equal cosines are taken
in the order of the index; without labels every score is one half; repeated rows score alike; extra columns are kept
unless their names are those of the results, which replace them.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tokenloom.llm.common import alnum_words, bound_batches, crc_remainder, materialise, pieces, set_aside, with_computed

#: Bounds of the labelled sample, neighbours that vote, rows of a block and the cut of a prediction.
MAX_POSITIVE, MAX_NEGATIVE = 2_000, 4_000
NEIGHBOURS = 30
BLOCK = 128
THRESHOLD = 0.7
#: Commonest words of the sample, whose weights form a matrix.
DENSE_WORDS = 512
#: Blocks opened at first, and steps and common words of the k-means that puts alike examples into the same blocks.
FIRST_BLOCKS, CLUSTER_STEPS, CLUSTER_WORDS = 16, 8, 512
#: One in so many examples votes, NEIGHBOURS at least; examples from which on the level of a neighbourhood is an input.
VOTERS, LEVEL_EXAMPLES = 30, 500
#: Added to both sides of a vote before its log odds.
SMOOTH = 0.02
#: Standard deviation, in log odds of votes, of the weights of the local fit; examples that it must rest on; its rounds.
NEAR, NEAR_EXAMPLES, NEAR_ROUNDS = 0.5, 50, 12
RESULTS = "score double, predicted int, evidence array<struct<doc_id:long,toxic:int,cosine:double>>"


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column) -> DataFrame:
    """At most MAX_POSITIVE and MAX_NEGATIVE examples (h, a hash of the text, doc_id, text, y, weight), one for each distinct labelled text; weight: labelled rows of the class for each one that they stand for."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(training)
    named = rows.select("doc_id", F.sha2("text", 256).alias("h")).join(marked, "doc_id")
    texts = materialise(named.groupBy("h").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    parts = []
    for y, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE)):
        own = texts.where(F.col("y") == y)
        chosen = own.orderBy("h").limit(most)
        total, taken = own.agg(F.sum("n")).first()[0] or 0, chosen.agg(F.sum("n")).first()[0] or 0
        parts.append(chosen.withColumn("weight", F.col("n") * F.lit(total / taken if taken else 1.0)))
    sample = parts[0].union(parts[1]).select("h", "y", "doc_id", "weight")
    found = rows.withColumn("h", F.sha2("text", 256)).join(F.broadcast(sample), ["h", "doc_id"])  # at most MAX_POSITIVE + MAX_NEGATIVE rows
    return found.dropDuplicates(["h"]).select("h", "doc_id", "text", "y", "weight")


def _in_one_task(sample: DataFrame, make) -> bytes:
    """What make() gives for the bounded sample as an Arrow table in the order of h, as bytes; the texts stay on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches([*batches], schema=to_arrow_schema(kind))
        yield pa.RecordBatch.from_arrays([pa.array([make(whole.sort_by("h"))], pa.binary())], names=["made"])

    kind = sample.schema
    return bytes(sample.coalesce(1).mapInArrow(run, "made binary").first()["made"])


def _words(examples: pa.Table) -> bytes:
    """All words of the examples, sorted and packed."""
    return zlib.compress(b" ".join(sorted({w for t in examples["text"].to_pylist() for w in alnum_words(t)})), 1)


def document_frequencies(docs: DataFrame, packed: bytes) -> tuple[np.ndarray, int]:
    """Documents that hold each of the packed words, and the number of documents: one sum for each task and word."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(zlib.decompress(shared.value).split())}
        total, n = np.zeros(len(known), np.int64), 0
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            n += len(texts)
            held = [i for t in texts for i in map(known.get, set(alnum_words(t))) if i is not None]
            total += np.bincount(held, minlength=len(known)) if held else 0
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, t].astype(np.int32)), pa.array(np.r_[n, total[t]])], names=["t", "n"])

    counted = docs.select("text").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the sample has words
    t, n = counted["t"].to_numpy(), counted["n"].to_numpy()
    out = np.zeros(int(t.max(initial=-1)) + 1, np.int64)
    out[t[t >= 0]] = n[t >= 0]
    return out, int(n[t < 0].sum())


def inverse_frequency(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.maximum(0.0, np.log((n_docs - df + 0.5) / (df + 0.5)))


class BlockMaxIndex:
    """Unit vectors of the examples as postings by word and block, with each word's largest weight in each block. It is made from texts in one task and answers where it has been unpickled."""

    def __init__(self, texts: list, words: list[bytes], idf: np.ndarray):
        self.words, self.idf, self.block_rows = words, idf, BLOCK
        self.known = {w: i for i, w in enumerate(words)}
        found = [self.counts(t) for t in texts]
        self.order = self._alike([(at, self.weights(at, tf)) for at, tf in found])
        found = [found[i] for i in self.order]
        self.n, self.blocks = len(found), max(1, -(-len(found) // BLOCK))
        self.norm = np.array([max(1e-300, np.sqrt((self.raw(at, tf) ** 2).sum())) for at, tf in found])
        word = np.concatenate([np.empty(0, np.int64), *[at for at, _ in found]])
        tf = np.concatenate([np.empty(0, np.int32), *[tf for _, tf in found]]).astype(np.int32)
        row = np.repeat(np.arange(self.n, dtype=np.int32), [len(at) for at, _ in found])
        order = np.lexsort((row, word))
        #: all postings, by word and row
        self.postings = np.searchsorted(word[order], np.arange(len(words) + 1)).astype(np.int32), row[order], tf[order]

    def __getstate__(self) -> dict:
        """What a task needs to build the index: words, their frequencies, and numbers of the postings."""
        return {k: self.__dict__[k] for k in ("idf", "block_rows", "order", "n", "blocks", "norm", "postings")} | {"words": zlib.compress(b" ".join(self.words), 1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.known = {w: i for i, w in enumerate(zlib.decompress(state["words"]).split())}
        first, row, tf = self.postings
        del self.postings, self.words  # the numbers below stand for them
        word = np.repeat(np.arange(len(self.known), dtype=np.int32), np.diff(first))
        weight = self.raw(word, tf) / self.norm[row]
        common = np.argsort(-np.diff(first), kind="stable")[:DENSE_WORDS]
        self.column = np.full(len(self.known), -1, np.int16)
        self.column[common] = np.arange(len(common))
        use = self.column[word] >= 0
        self.dense = np.zeros((self.blocks * self.block_rows, len(common)))
        self.dense[row[use], self.column[word[use]]] = weight[use]
        word, self.row, self.weight = word[~use], row[~use], weight[~use]
        #: cells: postings of one word in one block; where each word's cells and each cell's postings start
        block = self.row // self.block_rows
        new = np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])] if len(word) else np.empty(0, bool)
        start = np.flatnonzero(new)
        self.first = np.r_[start, len(word)].astype(np.int32)
        self.block = block[start]
        self.largest = np.maximum.reduceat(self.weight, start) if len(start) else np.empty(0)
        self.cells = np.searchsorted(word[start], np.arange(len(self.known) + 1)).astype(np.int32)

    def counts(self, text: object) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the text's words, sorted, and how often each occurs; words that weigh nothing are left out."""
        counts = Counter([i for i in map(self.known.get, alnum_words(text)) if i is not None])
        at, tf = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
        use = self.idf[at] > 0
        at, tf = at[use], tf[use]
        order = np.argsort(at)
        return at[order], tf[order]

    def raw(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return (1 + np.log(tf)) * self.idf[at]

    def weights(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """A text's vector of length one."""
        w = self.raw(at, tf)
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def _alike(self, found: list) -> np.ndarray:
        """An order of the examples in which those with alike common words stand together."""
        common = np.argsort(-np.bincount(np.concatenate([np.empty(0, np.int64), *[at for at, _ in found]]), minlength=len(self.words)), kind="stable")[:CLUSTER_WORDS]
        place = np.full(len(self.words), -1)
        place[common] = np.arange(len(common))
        x = np.zeros((len(found), len(common) + 1))
        for i, (at, w) in enumerate(found):
            use = place[at] >= 0
            x[i, place[at[use]]] = w[use]
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
        centres = x[:: max(1, BLOCK)].copy()
        label = np.zeros(len(x), np.int64)
        for _ in range(CLUSTER_STEPS if len(x) else 0):
            label = (x @ centres.T).argmax(axis=1)
            for c in range(len(centres)):
                if (label == c).any():
                    centres[c] = x[label == c].mean(axis=0)
            centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-12)
        # clusters whose centres are alike stand side by side
        beside = np.argsort(np.argsort(centres @ centres[0])) if len(x) else np.empty(0, np.int64)
        return np.lexsort((np.arange(len(x)), label, beside[label])) if len(x) else np.empty(0, np.int64)

    def nearest(self, texts: list, k: int, without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text: rows and cosines of the k examples of largest positive cosine, exact; without: a row for each text that is not asked."""
        found = [(at, self.weights(at, tf)) for at, tf in map(self.counts, texts)]
        common = np.zeros((len(found), self.dense.shape[1]))
        for i, (at, q) in enumerate(found):
            column = self.column[at]
            common[i, column[column >= 0]] = q[column >= 0]
        scores = common @ self.dense.T
        tops = scores.reshape(len(found), self.blocks, self.block_rows).max(axis=2)
        for i, (at, q) in enumerate(found):
            rest = self.column[at] < 0
            yield self._nearest(at[rest], q[rest], scores[i], tops[i], k, without[i] if without else -1)

    def _nearest(self, at: np.ndarray, q: np.ndarray, score: np.ndarray, top: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest, given the products of the common words and their largest in each block."""
        cell, size = _ranges(self.cells[at], self.cells[at + 1])
        part, block = np.repeat(q, size), self.block[cell]
        bound = top + np.bincount(block, self.largest[cell] * part, self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rows, cosines, opened, floor = np.empty(0, np.int64), np.empty(0), 0, -1.0
        while opened < len(order):
            # a block stays closed if its bound is below the k-th cosine found by more than rounding
            open_ = order[opened : max(FIRST_BLOCKS, 2 * opened)]
            open_ = open_[bound[open_] >= floor - 1e-9]
            if not len(open_):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[open_] = True
            use = chosen[block]
            post, size = _ranges(self.first[cell[use]], self.first[cell[use] + 1])
            if len(post):
                score += np.bincount(self.row[post], self.weight[post] * np.repeat(part[use], size), len(score))
            opened += len(open_)
            new = (open_[:, None] * self.block_rows + np.arange(self.block_rows)).ravel()
            new = new[(score[new] >= max(floor, 1e-300)) & (new != without)]
            rows, cosines = np.r_[rows, new], np.r_[cosines, score[new]]
            best = np.lexsort((rows, -cosines))[:k]
            rows, cosines = rows[best], cosines[best]
            floor = cosines[-1] if len(rows) == k else -1.0
        return rows, cosines


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after another, and the ranges' sizes."""
    size = (end - start).astype(np.int64)
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum()), size


def log_odds(p):
    return np.log(p / (1 - p))


def prior(y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Start and slope of a curve that says the share of toxic rows whatever the vote."""
    share = (weight[y == 1].sum() + 0.5) / (weight.sum() + 1)
    return float(log_odds(share)), 0.0


def smoothed(votes):
    """Log odds of votes."""
    return log_odds((votes + SMOOTH) / (1 + 2 * SMOOTH))


def calibrated(votes: np.ndarray, y: np.ndarray, weight: np.ndarray, start: float, level: np.ndarray | None = None) -> tuple[float, ...]:
    """Start and slope of the logistic curve fitted to the share of toxic votes that each example gets from the others (negative: no neighbour); with level, its slope as well."""
    use = votes >= 0
    none = (start, 0.0) if level is None else (start, 0.0, 0.0)
    if len(set(y[use].tolist())) < 2:
        return none
    x = np.c_[np.ones(use.sum()), smoothed(votes[use])]
    x = x if level is None else np.c_[x, level[use]]
    y, weight = y[use], weight[use]
    beta = _logistic(x, y, weight, np.array(none))
    if not beta[1] > 0:
        return none
    for _ in range(NEAR_ROUNDS):
        near = weight * np.exp(-0.5 * ((x @ beta - log_odds(THRESHOLD)) / beta[1] / NEAR) ** 2)
        # too few examples near the threshold, or all of one class there: the curve stays
        if near.sum() ** 2 <= NEAR_EXAMPLES * (near**2).sum() or not 0.02 < near[y == 1].sum() / near.sum() < 0.98:
            break
        local = _logistic(x, y, near, beta)
        if not (np.isfinite(local).all() and local[1] > 0):
            break
        beta = local
    return tuple(beta.tolist())


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Start and slopes of most weighted likelihood, by Newton steps from beta."""
    w, beta = weight / weight.sum(), beta.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - 1e-5 * np.r_[0, beta[1:]]
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-9, np.full(len(beta) - 1, 1e-5)]), gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return beta


class Model:
    """The index, its labels and the curve from votes to probabilities."""

    def __init__(self, index: BlockMaxIndex, ids: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.index, self.ids, self.y = index, ids[index.order], y[index.order]
        self.start, self.slope = prior(y, weight)
        self.share = float(1 / (1 + np.exp(-self.start))) if len(y) else 0.5

    @property
    def voters(self) -> int:
        return max(NEIGHBOURS, self.index.n // VOTERS)

    def vote(self, rows: np.ndarray, cosine: np.ndarray) -> float:
        return float((cosine * self.y[rows]).sum() / cosine.sum()) if len(rows) else -1.0

    def score(self, rows: np.ndarray, cosine: np.ndarray) -> float:
        if not len(rows):
            return self.share
        says = self.start + self.slope * smoothed(self.vote(rows, cosine))
        if self.level:
            says += self.level * level_of(self.own[rows], cosine)
        return float(1 / (1 + np.exp(-says)))


def level_of(own: np.ndarray, cosine: np.ndarray) -> float:
    """Level of a neighbourhood: mean of the voters' own votes, in log odds, by cosines."""
    return float((cosine * own).sum() / cosine.sum())


def load(fitted: tuple) -> Model:
    """The model of fit()'s answer, on the driver or in a task."""
    shared, curve, own = fitted
    model = pickle.loads(shared.value)
    model.start, model.slope, model.level = (*curve, 0.0)[:3]
    model.own = None if own is None else own[model.index.order]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str, training: Column | None):
    """What load() takes: a broadcast of the packed index, the curve, and the examples' own votes in log odds. training: rows whose labels may be learned from, in terms of doc_id. The driver holds labels and weights of the sample, document frequencies of its words and the packed index, no texts."""
    spark = docs.sparkSession
    bound_batches(spark)
    training = F.lit(True) if training is None else F.coalesce(training, F.lit(True))
    sample = materialise(labelled_sample(docs, labels.select("doc_id", label), label, training))
    packed = _in_one_task(sample.select("h", "text"), _words)
    df, n_docs = document_frequencies(docs, packed)
    known = spark.sparkContext.broadcast((packed, df, n_docs))

    def build(examples: pa.Table) -> bytes:
        packed, df, n_docs = known.value
        words = zlib.decompress(packed).split()
        df = np.r_[df, np.zeros(len(words) - len(df), np.int64)]
        index = BlockMaxIndex(examples["text"].to_pylist(), words, inverse_frequency(df, n_docs))
        return pickle.dumps(Model(index, examples["doc_id"].to_numpy(), examples["y"].to_numpy().astype(np.int64), examples["weight"].to_numpy()))

    made = _in_one_task(sample, build)
    known.destroy()
    rows = sample.select("h", "y", "weight").orderBy("h").toArrow()
    y, weight = rows["y"].to_numpy().astype(np.int64), rows["weight"].to_numpy()
    curve = prior(y, weight)
    shared = spark.sparkContext.broadcast(made)
    del made
    if len(set(y.tolist())) < 2:
        return shared, curve, None
    number = spark.sparkContext.broadcast({h: n for n, h in enumerate(rows["h"].to_pylist())})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load((shared, curve, None))
        place = np.argsort(model.index.order)
        for batch in pieces(batches):
            numbers = [number.value[h] for h in batch.column("h").to_pylist()]
            near = [*model.index.nearest(batch.column("text").to_pylist(), model.voters, place[numbers].tolist())]
            votes = [model.vote(*x) for x in near]
            voters = [model.index.order[r].astype(np.int32).tobytes() for r, _ in near]
            cosines = [c.astype(np.float32).tobytes() for _, c in near]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(votes, pa.float64()), pa.array(voters, pa.binary()), pa.array(cosines, pa.binary())], names=["n", "vote", "voters", "cosines"])

    # voters of each example: a VOTERS-th of the sample's square, some 10 MB at most
    found = sample.select("h", "text").repartition(max(1, min(12, len(y) // 100))).mapInArrow(ask, "n long, vote double, voters binary, cosines binary").toArrow()
    votes, level = np.empty(len(y)), np.zeros(len(y))
    votes[found["n"].to_numpy()] = found["vote"].to_numpy()
    if len(y) < LEVEL_EXAMPLES or not (votes >= 0).any():
        return shared, calibrated(votes, y, weight, curve[0]), None
    own = smoothed(np.maximum(votes, 0))
    own[votes < 0] = own[votes >= 0].mean()
    for n, voters, cosines in zip(*(found[c].to_pylist() for c in ("n", "voters", "cosines")), strict=True):
        if voters:
            level[n] = level_of(own[np.frombuffer(voters, np.int32)], np.frombuffer(cosines, np.float32).astype(float))
    return shared, calibrated(votes, y, weight, curve[0], level), own


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", training: Column | None = None, without: tuple[str, ...] = (), evidence: bool = True) -> DataFrame:
    """docs (but the columns named in without) with score, predicted and, where it is asked for, evidence: the NEIGHBOURS nearest examples, their labels and cosines."""
    fitted = fit(docs, labels, label, training)

    def start():
        model = load(fitted)

        def compute(texts: list) -> list:
            near = [*model.index.nearest(texts, model.voters)]
            scores = [model.score(*x) for x in near]
            told = []
            if evidence:
                first = [(rows[:NEIGHBOURS], cosine[:NEIGHBOURS]) for rows, cosine in near]
                rows, cosine = (np.concatenate(x) for x in zip(*first, strict=True))
                ends = np.cumsum([0, *[len(r) for r, _ in first]]).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(model.ids[rows], pa.int64()), pa.array(model.y[rows].astype(np.int32)), pa.array(cosine)], names=["doc_id", "toxic", "cosine"])
                told = [pa.ListArray.from_arrays(pa.array(ends), each).cast(told_type)]
            return [scores, [int(s >= THRESHOLD) for s in scores], *told]

        return compute

    told_type = to_arrow_schema(T.StructType.fromDDL(RESULTS)).field("evidence").type
    results = RESULTS if evidence else ", ".join(RESULTS.split(", ")[:2])
    return with_computed(docs, ["text"], results, start, without)


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", training: Column | None = None) -> DataFrame:
    """docs, all columns, whose score is below THRESHOLD."""
    base, back = set_aside(docs, ["score", "predicted"])
    scored = score_documents(base, labels, label, training, evidence=False).where("predicted = 0").drop("score", "predicted")
    return scored.withColumnsRenamed(back).select(*docs.columns)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document; labels of rows whose crc32(doc_id as text) mod 3 is 1 are not learned from."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_documents(slim, labels, training=crc_remainder("doc_id", 3) != 1, without=("text",))
    return scored.select("doc_id", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
