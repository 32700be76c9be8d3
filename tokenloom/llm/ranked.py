"""Ranked lexical search (operator 11) over a bit-sliced impact index.

A block of documents is indexed as bitmaps: for each term and each bit of its impact, the documents of the block whose
impact has that bit. Scores of a query are added for all documents of the block at once by bitwise carry arithmetic,
and the best are found from the most significant slice of the sums downwards. A task keeps the best of its blocks
alone, so rows that are exchanged follow the number of tasks, not of documents.

Two passes over the documents: the first sums up counts (documents, terms, documents that hold a queried term), the
second indexes and searches. Queries come in slices of bounded size; each slice takes two passes.

A term is a run of ASCII letters, digits and other characters beyond ASCII, of which only A-Z are lower-cased. Its
impact in a document is w * ((1000000000 * tf) div (1000 * tf + 8 * m)), w = floor(1000 * ln((2 N + 2) / (2 df + 1))),
m = 25 + (75 n N) div L, in whole numbers but for w.

Edge cases: null and empty texts, and texts without a term, count for nothing and are never found; queries without a
known term find nothing; equal scores go by ascending doc_id, a null one first; repeated rows are documents of their
own; rows of one item_id and different texts are queries of their own, and equal rows are one; extra columns are left
out; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import alnum_words, bound_batches, pieces

#: Terms of the queries that one pass takes (a single longer query still goes in one), terms of the queries that are added up
#: together, and documents of a block.
SLICE_TERMS, GROUP_TERMS, BLOCK = 200_000, 8_192, 2_048
WORDS = BLOCK // 64


def slices_of(queries: DataFrame) -> Iterator[list[tuple[object, str, list[bytes]]]]:
    """Slices of (item_id, text's number, terms), ordered by id; one at a time."""
    held, size = [], 0
    for n, r in enumerate(queries.where("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator()):
        terms = alnum_words(r["text"])
        if held and size + len(terms) > SLICE_TERMS:
            yield held
            held, size = [], 0
        if terms:
            held.append((r["item_id"], n, terms))
            size += len(terms)
    if held:
        yield held


def counted(docs: DataFrame, terms) -> tuple[int, int, dict[bytes, int]]:
    """N, L and the number of documents that hold each of the terms (a broadcast set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held, n, total = terms.value, Counter(), 0, 0
        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                words = alnum_words(text)
                if words:
                    n += 1
                    total += len(words)
                    held.update(wanted.intersection(words))
        rows = [(None, n, total), *((t, c, 0) for t, c in held.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["term", "n", "total"])

    sums = docs.select("text").mapInArrow(run, "term binary, n long, total long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = {None if r["term"] is None else bytes(r["term"]): (r["n"], r["total"]) for r in sums.collect()}  # at most a row for each queried term
    n, total = found.pop(None, (0, 0))
    return n, total, {t: c for t, (c, _) in found.items()}


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Slices:
    """Bitmaps of a block: bits[s, t] holds the documents whose impact of term t has bit s."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int):
        depth = int(impact.max()).bit_length()
        order = np.lexsort((doc, term))
        term, doc, impact = term[order], doc[order], impact[order]
        place = term * (BLOCK // 8) + (doc >> 3)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        bits = ((impact[None] >> np.arange(depth)[:, None]) & 1).astype(np.uint8) << (doc & 7).astype(np.uint8)
        flat = np.zeros((depth, terms * BLOCK // 8), np.uint8)
        flat[:, place[first]] = np.bitwise_or.reduceat(bits, first, axis=1)
        self.bits = flat.view("<u8").reshape(depth, terms, WORDS)


def added(total: list[np.ndarray], bits: np.ndarray, rows: int) -> None:
    """Adds a number (its slices) to the first rows of the sums, slice by slice with a carry."""
    carry = None
    for s in range(max(len(total), len(bits)) + 1):
        if s >= len(bits) and carry is None:
            return
        if s == len(total):
            if s >= len(bits) and not carry.any():
                return
            total.append(np.zeros_like(total[0]) if total else np.zeros((rows, WORDS), np.uint64))
        a = total[s][:rows]
        if s < len(bits):
            b = bits[s]
            half = a ^ b
            both = a & b
            if carry is None:
                total[s][:rows], carry = half, both
            else:
                total[s][:rows], carry = half ^ carry, both | (half & carry)
        else:
            total[s][:rows], carry = a ^ carry, a & carry
            if not carry.any():
                return


def best(total: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, score) of each row's k highest sums above zero, from the most significant slice down; equal sums by document."""
    rows = len(total[0])
    sure = np.zeros((rows, WORDS), np.uint64)
    open_ = np.bitwise_or.reduce(total)
    for s in reversed(range(len(total))):
        one = open_ & total[s]
        many = np.bitwise_count(sure | one).sum(axis=1, dtype=np.int64)[:, None]
        sure = np.where(many <= k, sure | one, sure)
        open_ = np.where(many >= k, one, open_ & ~one)
        open_ = np.where(many == k, 0, open_)
    room = k - np.bitwise_count(sure).sum(axis=1, dtype=np.int64)
    ties = np.unpackbits(open_.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(bool)
    ties &= np.cumsum(ties, axis=1) <= room[:, None]
    row, doc = np.nonzero(ties | np.unpackbits(sure.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(bool))
    score = np.zeros(len(row), np.int64)
    for s, bits in enumerate(total):
        score |= ((bits[row, doc >> 6] >> (doc & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << s
    return row, doc, score


class Searcher:
    """The queries of a slice, in groups of at most GROUP_TERMS terms or one query."""

    def __init__(self, items: list, known: dict[bytes, int], weights: list[int], n: int, total: int):
        self.weights, self.n, self.total = np.array(weights, np.int64), n, total
        self.groups: list[list[tuple[int, list[int]]]] = [[]]
        size = 0
        for at, (_, _, terms) in enumerate(items):
            own = [known[t] for t in terms if t in known]
            if own:
                if size and size + len(own) > GROUP_TERMS:
                    self.groups.append([])
                    size = 0
                self.groups[-1].append((at, own))
                size += len(own)
        self.tops: dict[int, list] = {}

    def block(self, docs: list[tuple[object, int, dict[int, int]]], k: int) -> None:
        """Indexes a block of documents (id, number of terms, occurrences by queried term) and searches it."""
        docs.sort(key=lambda d: (d[0] is not None, d[0] or 0))
        sizes = [len(d[2]) for d in docs]
        term, tf = (np.fromiter(chain.from_iterable(f(d[2]) for d in docs), np.int64, sum(sizes)) for f in (dict.keys, dict.values))
        doc = np.repeat(np.arange(len(docs)), sizes)
        m = np.array([100 - 75 + (75 * d[1] * self.n) // self.total for d in docs], np.int64)
        impact = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        some = impact > 0
        term, doc, impact = term[some], doc[some], impact[some]
        for group in self.groups:
            used = np.unique(np.fromiter((t for _, own in group for t in own), np.int64))
            sums: list[np.ndarray] = []
            order = group
            for first in range(0, len(used), GROUP_TERMS):  # more than one part in a group of one query alone
                place = np.full(len(self.weights), -1)
                place[used[first : first + GROUP_TERMS]] = np.arange(len(used[first : first + GROUP_TERMS]))
                mine = place[term] >= 0
                if not mine.any():
                    continue
                bits = Slices(place[term[mine]], doc[mine], impact[mine], len(used[first : first + GROUP_TERMS])).bits
                there = np.zeros(len(self.weights), bool)
                there[term[mine]] = True
                lists = [(at, place[[t for t in own if there[t]]]) for at, own in group]
                lists = order = sorted((x for x in lists if len(x[1])), key=lambda x: -len(x[1]))
                for step in range(len(lists[0][1])):
                    column = [own[step] for _, own in lists if len(own) > step]
                    if sums:
                        added(sums, bits[:, column], len(column))
                    else:
                        sums = list(bits[:, column])
            if sums:
                for row, d, score in zip(*(x.tolist() for x in best(sums, k)), strict=True):
                    self.offer(order[row][0], score, docs[d][0], k)

    def offer(self, item: int, score: int, doc_id: object, k: int) -> None:
        entry = (score, doc_id is None, -(doc_id or 0))
        top = self.tops.setdefault(item, [])
        if len(top) < k:
            heapq.heappush(top, entry)
        elif entry > top[0]:
            heapq.heapreplace(top, entry)


def _found(docs: DataFrame, items: list, k: int) -> DataFrame:
    """item_id, query, score, doc_id: each task's k best documents of each query of a slice."""
    context = docs.sparkSession.sparkContext
    n, total, held = counted(docs, context.broadcast({t for _, _, terms in items for t in terms}))
    known = {t: at for at, t in enumerate(sorted(held))}
    shared = context.broadcast(pickle.dumps((items, known, [weight(n, held[t]) for t in sorted(held)], n, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known, weights, n, total = pickle.loads(shared.value)
        searcher, block = Searcher(items, known, weights, n, total), []
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                counts = Counter(words)
                held = {known[t]: counts[t] for t in known.keys() & counts.keys()}
                if held:
                    block.append((doc_id, len(words), held))
                if len(block) == BLOCK:
                    searcher.block(block, k)
                    block = []
        if block:
            searcher.block(block, k)
        rows = [(at, score, None if null else -minus) for at, top in searcher.tops.items() for score, null, minus in top]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["at", "score", "doc_id"])

    ids = docs.sparkSession.createDataFrame([(at, x, q) for at, (x, q, _) in enumerate(items)], "at int, item_id long, query int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "at int, score long, doc_id long")
    return found.join(F.broadcast(ids), "at").drop("at")  # a row for each query of a slice


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, query (number of the query's text, for rows that share an id), rank, doc_id, score: the k best documents of each query. docs: doc_id, text; queries: item_id, text."""
    bound_batches(docs.sparkSession)
    found = None
    for items in slices_of(queries.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        part = _found(docs, items, k)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "score long, doc_id long, item_id long, query int")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "query", "rank", "doc_id", "score")


def search_report(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ten best documents."""
    return search(docs, queries).select("item_id", "rank", "doc_id", "score")


#: The same ranking in DuckDB: term weights, document sizes and scores as joins.
SQL = """
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
doc_terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, upper, lower), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents, letters),
item_terms AS (SELECT item_id, unnest(regexp_extract_all(translate(text, upper, lower), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark, letters),
tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::HUGEINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
scores AS (
  SELECT item_id, tf.doc_id, sum(w * ((1000000000 * tf)::HUGEINT // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM item_terms JOIN tf USING (term) JOIN weights USING (term) JOIN sizes ON sizes.doc_id = tf.doc_id, whole
  GROUP BY item_id, tf.doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
