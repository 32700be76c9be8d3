"""Language-model scoring (operator 5): a hierarchical Pitman-Yor model whose context restaurants are seated by Gibbs sampling.

Every word is a context with a restaurant of its own, and all of these share one parent, the restaurant of words, whose
base is uniform over the V words of the training side and one more outcome, any other word. A document starts in the
context of no word. With c customers and t tables of word w in context u, C and T the context's sums, d a
discount and s the strength,

    p(w | u) = (c - d t + (s + d T) p0(w)) / (s + C),    p0(w) = (c0 - d0 t0 + (s + d0 T0) / (V + 1)) / (s + C0),

where c0 is the number of tables that serve w in all contexts. The V + 1 probabilities of a context add up to one.

How it runs
 1. Tasks cut their documents into blocks of BLOCK_BYTES and count each block's distinct word pairs, so that even the commonest pair
    is one entry of a block. Entries go to a bucket by their context; a context is spread over a sixteenth of all
    buckets, so no word's followers fill one. Words travel as 48-bit hashes.
 2. Buckets of pairs add up their counts, and tell the buckets of words which words they hold. There are as many
    buckets of each kind as the corpus has BUCKET_BYTES, so a task's load is the same at every size.
 3. A Gibbs round: buckets of words seat the words' customers and send p0, C and T of each word to the buckets of
    pairs; these take the customers of every pair that occurs twice or more from their tables and seat them again,
    and send the new numbers of tables back. A pair of up to MOVES customers moves them one by one, as many moves as
    customers; of a larger one all customers leave at once and are seated again by an exact draw (seat_whole), so no
    customer of a frequent pair stays where a first guess has put it. Words in their own restaurant move alike. Within a
    round p0 and T stand still, which is what lets the buckets run side by side.
 4. After BURN_IN rounds every round is a sample. A pair's probability is the mean of the samples' predictive
    probabilities; each block gets back those of its pairs and adds up their logarithms by document.

Probabilities travel in single precision (a relative error below 1e-7 each); sums are taken in double precision.

Edge cases: null and empty texts are one end token; a null key belongs to the training side; repeated rows count
each time; with an empty table or no training rows probabilities come from the uniform base alone; a context never seen
gives p0; other columns than the key are left out of the result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import bound_batches, crc_remainder, materialise, pieces, spaced_words

BLOCK_BYTES = 16 << 20
#: Text bytes of the corpus for each bucket of pairs and each bucket of words.
BUCKET_BYTES = 32 << 20
BURN_IN, SAMPLES = 1, 2
#: Customers of a dish up to which they move one by one; of larger dishes all move at once.
MOVES = 12
#: Customers of a dish up to which the exact draw lists its whole law; beyond, an urn is drawn and tested.
LISTED = 400
STRENGTH = 1.0
WORD_BITS = (1 << 48) - 1
#: Context of a document's first word; no word holds a newline.
START = b"\n"


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), 1) if len(a) else b""


def unpack(blob: bytes | None, kind) -> np.ndarray:
    if not blob:
        return np.empty(0, kind)
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_words(h: np.ndarray) -> bytes:
    """Sorted 48-bit hashes."""
    return zstandard.compress(np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes(), 1) if len(h) else b""


def unpack_words(blob: bytes | None) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. np.unique without counts hashes them, which takes many times as long where most are distinct."""
    a = np.sort(a)
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def bucket_of_pair(names: np.ndarray, u: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each pair of places among the names: a context's followers lie in a sixteenth of all buckets."""
    g = (names % np.uint64(buckets))[u] + ((names >> np.uint64(8)) % np.uint64(-(-buckets // 16)))[w]
    return np.where(g < buckets, g, g - np.uint64(buckets))


def discount_of(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def reseat(c: np.ndarray, t: np.ndarray, sizes: np.ndarray, rate: np.ndarray, discount: float, moves: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One round of Gibbs moves: customers of each dish leave their table and are seated again, up to so many a dish.

    c: customers, t: tables, sizes: customers at each table, dish after dish; rate: a new table's weight against a
    table of n customers, whose weight is n - discount. Gives t and sizes after the round.
    """
    order = np.argsort(-np.minimum(c, moves), kind="stable")
    back = np.empty(len(c), np.int64)
    back[order] = np.arange(len(c))
    first = np.cumsum(np.r_[0, t])[:-1]
    c, n, rate = c[order].astype(np.int64), t[order].astype(np.int64), rate[order]
    room = np.minimum(c, n + moves)
    start = np.r_[0, np.cumsum(room)]
    slots = np.zeros(start[-1], np.int64)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    slots[np.repeat(start[:-1], n) + inside] = sizes[np.repeat(first[order], n) + inside]
    used = n.copy()
    for m in range(moves):
        live = int(np.searchsorted(-np.minimum(c, moves), -m, "left"))  # dishes of more than m customers come first
        if not live:
            break
        end, s, own = start[live], start[:live], slots[: start[live]]
        before = np.r_[0, np.cumsum(own)]
        k = np.searchsorted(before, before[s] + rng.integers(0, c[:live]), "right") - 1
        own[k] -= 1
        gone = own[k] == 0
        left = n[:live] - gone
        new = rng.random(live) * (rate[:live] + c[:live] - 1 - discount * left) < rate[:live]
        weight = np.r_[0.0, np.cumsum(np.maximum(own - discount, 0.0) * (own > 0))]
        e = start[1 : live + 1]
        to = np.searchsorted(weight, weight[s] + rng.random(live) * (weight[e] - weight[s]), "right") - 1
        to = np.clip(to, s, e - 1)
        new |= own[to] == 0  # nobody else is there
        to = np.where(new, np.where(gone, k, np.minimum(s + used[:live], e - 1)), to)
        used[:live] += new & ~gone & (used[:live] < room[:live])
        # a dish without a free place uses one that was left empty
        full = np.flatnonzero(new & (own[to] > 0))
        for d in full.tolist():
            to[d] = s[d] + int(np.flatnonzero(own[s[d] : e[d]] == 0)[0])
        own[to] += 1
        n[:live] = left + new
        slots[:end] = own
    owner = np.repeat(np.arange(len(c)), room)
    keep = slots > 0
    owner, slots = owner[keep], slots[keep]
    final = np.lexsort((np.arange(len(owner)), order[owner]))
    return n[back].astype(np.int64), slots[final]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers (Stirling's series, shifted by seven)."""
    y = x + 7
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


@functools.lru_cache(maxsize=4)
def _log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: weight of all seatings of n customers (row) at t tables (column)."""
    out = np.full((LISTED + 1, LISTED + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(LISTED):
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 2] = out[n, : n + 1]
        out[n + 1, 1 : n + 1] = np.logaddexp(out[n + 1, 1 : n + 1], out[n, 1 : n + 1] + np.log(n - discount * t))
    return out


def seat_whole(c: np.ndarray, rate: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after all of its c customers have left and have been seated again: an exact draw.

    A dish's seating weighs rate for each table and (1 - d)(2 - d)..(n - 1 - d) for each table of n customers, so t tables
    have the weight rate^t S(c, t) with generalised Stirling numbers S. Up to LISTED customers this law is listed.
    Beyond, _urn draws from it.
    """
    out, low = np.minimum(c, 1).astype(np.int64), np.log(rate)
    listed = np.flatnonzero((c > 1) & (c <= LISTED))
    for at in np.split(listed[np.argsort(c[listed], kind="stable")], np.flatnonzero(np.diff(np.sort(c[listed]))) + 1):
        if len(at):
            n = int(c[at[0]])
            law = low[at][:, None] * np.arange(1, n + 1) + _log_stirling(discount)[n, 1 : n + 1]
            law = np.cumsum(np.exp(law - law.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + np.minimum(n - 1, (law <= (rng.random(len(at)) * law[:, -1])[:, None]).sum(axis=1))
    long = np.flatnonzero(c > LISTED)
    if len(long):
        out[long] = _urn(c[long].astype(float), rate[long], discount, rng)
    return out


def _urn(c: np.ndarray, rate: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Exact draws of t with weight rate^t S(c, t).

    Customers enter a Pitman-Yor urn of some strength a, where t tables have the weight (a + d)(a + 2d)..(a + (t - 1)d) S(c, t);
    the quotient rate^t / ((a + d)..(a + (t - 1)d)) has one peak and is the chance, up to a factor, with which a seating is
    taken; others are drawn again. The waiting time for the next table is geometric with a beta chance, so a draw takes
    as many steps as there are tables, however many customers. The strength only decides how often a draw is taken;
    it is the best one that a search finds.
    """

    def strength(u: np.ndarray) -> np.ndarray:
        return (rate + discount) / (1 + np.exp(-u)) - discount

    def highest(a: np.ndarray) -> np.ndarray:
        """Logarithm of the quotient at its peak."""
        top = np.clip(np.floor((rate - a) / discount) + 1, 1, c)
        return top * np.log(rate) - (top - 1) * math.log(discount) - log_gamma(a / discount + top) + log_gamma(a / discount + 1)

    def cost(u: np.ndarray) -> np.ndarray:
        """Logarithm of how many seatings are drawn for one that is taken, up to a constant."""
        a = strength(u)
        return log_gamma(a + c) - log_gamma(a + 1) + highest(a)

    # strengths from nearly -d, where many tables have the peak, to nearly rate, where one has it
    low, step = np.full(len(c), -8.0), (np.log((rate + discount) / (0.25 * discount)) + 8) / 24
    best, at = cost(low), low.copy()
    for n in range(1, 25):
        now = cost(low + n * step)
        at, best = np.where(now < best, low + n * step, at), np.minimum(best, now)
    for _ in range(8):
        step = step / 2
        for side in (at - step, at + step):
            now = cost(side)
            at, best = np.where(now < best, side, at), np.minimum(best, now)
    theta = strength(at)
    peak = highest(theta)
    out, open_ = np.zeros(len(c), np.int64), np.arange(len(c))
    while len(open_):
        who = np.repeat(open_, max(1, min(16, 20_000 // len(open_))))
        t, n, high = np.ones(len(who)), np.ones(len(who)), np.log(rate[who])
        least = peak[who] + np.log(1 - rng.random(len(who)))
        live = np.arange(len(who))
        while len(live):
            w, k = who[live], t[live]
            chance = rng.beta(theta[w] + discount * k, n[live] - discount * k)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                wait = np.floor(np.log(1 - rng.random(len(live))) / np.log1p(-chance))
            at = n[live] + 1 + np.where(chance > 0, wait, np.inf)
            opens = at <= c[w]
            live, w, k = live[opens], w[opens], k[opens]
            n[live], t[live] = at[opens], k + 1
            high[live] += np.log(rate[w] / (theta[w] + discount * k))
            # past the peak a quotient only falls: a seating that is refused by now stays refused
            live = live[(high[live] >= least[live]) | (rate[w] >= theta[w] + discount * k)]
        taken = np.flatnonzero(high >= least)
        found, first = np.unique(who[taken], return_index=True)
        out[found] = t[taken[first]]
        open_ = np.setdiff1d(open_, found, assume_unique=True)
    return out


def start_seating(c: np.ndarray, rate: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables and sizes to start a chain from: about as many tables as customers who come one by one open, shares by a Dirichlet law."""
    t = np.minimum(c, 1 + rng.poisson(rate * np.log((rate + c) / (rate + 1)))).astype(np.int64) * (c > 0)
    first = np.cumsum(t) - t
    share = rng.gamma(1 - discount, size=int(t.sum())) + 1e-12
    dish = np.repeat(np.arange(len(c)), t)
    total = np.r_[0.0, np.cumsum(share)]
    inside = np.clip((total[1:] - total[first[dish]]) / np.bincount(dish, share, len(c))[dish], 0, 1)
    until = np.floor((c - t)[dish] * inside + 0.5).astype(np.int64)
    until[first[t > 0] + t[t > 0] - 1] = (c - t)[t > 0]
    sizes = np.diff(until, prepend=0)
    sizes[first[t > 0]] = until[first[t > 0]]
    return t, sizes + 1


def follow(c: np.ndarray, t: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables and sizes after dishes have got c customers: those too many go at random, those who come join tables in proportion to their sizes."""
    dish = np.repeat(np.arange(len(c)), t)
    had = np.bincount(dish, sizes, len(c)).astype(np.int64)
    table = np.repeat(np.arange(len(sizes)), np.where((had > c)[dish], sizes, 0))  # a row for each customer of the dishes that shrink
    if len(table):
        mine = dish[table]
        order = np.lexsort((rng.random(len(table)), mine))
        rank = np.arange(len(table)) - np.searchsorted(mine, mine)
        sizes = sizes - np.bincount(table[order][rank < (had - c)[mine]], minlength=len(sizes))
    more = np.maximum(0, c - had) * (t > 0)
    if more.any():
        before = np.r_[0, np.cumsum(sizes)]
        first = np.cumsum(t) - t
        who = np.repeat(np.arange(len(c)), more)
        pick = before[first[who]] + rng.integers(0, np.maximum(1, had[who]))
        sizes = sizes + np.bincount(np.searchsorted(before, pick, "right") - 1, minlength=len(sizes))
    new = np.flatnonzero((t == 0) & (c > 0))
    keep = sizes > 0
    dish, sizes = np.r_[dish[keep], new], np.r_[sizes[keep], c[new]]
    order = np.argsort(dish, kind="stable")
    return np.bincount(dish, minlength=len(c)).astype(np.int64), sizes[order]


class Block:
    """Documents of one block as word numbers."""

    def __init__(self):
        self.index, self.keys, self.held, self.tokens, self.size = _Index(), [], [], [], 0
        self.start = self.index[START]

    def add(self, key: int | None, held: bool, text: object) -> None:
        words = spaced_words(text)
        words.append(b"")
        self.keys.append(key)
        self.held.append(held)
        self.tokens.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        self.size += len(text) if isinstance(text, str) else 0

    def keys_of_pairs(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's pair as one number, in the order of buckets, contexts and words; sorted hashes of the words; tokens of each document."""
        names = np.fromiter((xxhash.xxh64_intdigest(w) & WORD_BITS for w in self.index), np.uint64, len(self.index))
        order = np.argsort(names)
        rank = np.empty(len(names), np.uint64)
        rank[order] = np.arange(len(names), dtype=np.uint64)
        names = names[order]
        lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        word = rank[np.concatenate(self.tokens)]
        before = np.r_[rank[self.start], word[:-1]]
        before[np.cumsum(lengths) - lengths] = rank[self.start]
        g = bucket_of_pair(names, before, word, buckets)
        if buckets > 1 << 16:  # a block's own buckets are fewer
            g = np.unique(g, return_inverse=True)[1].astype(np.uint64)
        return g << np.uint64(48) | before << np.uint64(24) | word, names, lengths

    def pairs(self, buckets: int):
        """Bucket, context, word and training count of each distinct pair, sorted."""
        key, names, lengths = self.keys_of_pairs(buckets)
        training = np.repeat(~np.array(self.held, bool), lengths)
        learned, count = np.unique(key[training], return_counts=True)
        key = distinct(key)
        n = np.zeros(len(key), np.int64)
        n[np.searchsorted(key, learned)] = count
        low = np.uint64((1 << 24) - 1)
        u, w = key >> np.uint64(24) & low, key & low
        return bucket_of_pair(names, u, w, buckets), names[u], names[w], n

    def places(self, buckets: int) -> tuple[np.ndarray, int, np.ndarray]:
        """Each token's place among the sorted pairs, their number, and tokens of each document."""
        key, _, lengths = self.keys_of_pairs(buckets)
        pairs, at = np.unique(key, return_inverse=True)
        return at.astype(np.int32), len(pairs), lengths


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """Blocks of a task's rows (key, held, text) and their numbers."""
    number = TaskContext.get().partitionId() << 32
    block = Block()
    for batch in pieces(batches):
        for key, held, text in zip(*(batch.column(c).to_pylist() for c in ("key", "held", "text")), strict=True):
            block.add(key, held, text)
            if block.size >= BLOCK_BYTES:
                yield number, block
                number, block = number + 1, Block()
    if block.keys:
        yield number, block


def count_pairs(rows: DataFrame, buckets: int) -> DataFrame:
    """Each block's distinct pairs by bucket: contexts with the number of their followers, the distinct followers, places in these, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches):
            g, u, w, n = block.pairs(buckets)
            bounds = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                context, followers = np.unique(u[a:b], return_counts=True)
                words, at = np.unique(w[a:b], return_inverse=True)
                out.append((number, int(g[a]), pack_words(context), pack(followers.astype(np.int32)), pack_words(words), pack(at.astype(np.int32)), pack(n[a:b].astype(np.int32))))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["block", "g", "u", "nu", "w", "at", "n"])

    return rows.mapInArrow(run, "block long, g int, u binary, nu binary, w binary, at binary, n binary")


PAIRS = "kind string, g int, block long, b int, one binary, two binary, three binary, four binary"


def _merge(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """One bucket of pairs: p: its pairs (numbers of context and word among its words, counts); m: places of each block's pairs; r: its words for each bucket of words, with the sums of counts and tables as word and as context."""
    pdf = pdf.sort_values("block")
    contexts, followers = ([unpack_words(x) for x in pdf[name]] for name in ("u", "w"))
    words = distinct(np.concatenate([*contexts, *followers]))
    keys = []  # a pair as one number, its words by their places
    for u, nu, w, at in zip(contexts, pdf["nu"], followers, pdf["at"], strict=True):
        key = np.repeat(np.searchsorted(words, u).astype(np.uint64) << np.uint64(32), unpack(nu, np.int32))
        key |= np.searchsorted(words, w).astype(np.uint64)[unpack(at, np.int32)]
        keys.append(key)
    sizes = [len(x) for x in keys]
    key = np.concatenate(keys)
    del keys, contexts, followers
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    at = np.empty(len(key), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    key = key[new]
    del order, new
    count = np.bincount(at, np.concatenate([unpack(n, np.int32) for n in pdf["n"]]), len(key)).astype(np.int64)
    g = int(pdf["g"].iloc[0])
    own = words % np.uint64(buckets)
    sort = np.argsort(own, kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[sort] = np.arange(len(words), dtype=np.int32)
    words, own = words[sort], own[sort]
    iu, iw = rank[key >> np.uint64(32)], rank[key & np.uint64((1 << 32) - 1)]
    del key
    rows = [("p", g, None, None, pack(iu), pack(iw), pack(count), None)]
    for block, a, n in zip(pdf["block"].tolist(), np.cumsum(sizes) - sizes, sizes, strict=True):
        rows.append(("m", g, block, None, pack(np.diff(at[a : a + n], prepend=np.int32(0))), None, None, None))
    rows += _tell(g, words, own, *_sums(iu, iw, count, (count > 0).astype(np.int64), len(words)))
    return pd.DataFrame(rows, columns=["kind", "g", "block", "b", "one", "two", "three", "four"]).astype({"block": "Int64", "b": "Int32"})


def _sums(iu, iw, count, tables, n: int) -> list[np.ndarray]:
    """Customers and tables of each word as follower, then as context."""
    return [np.bincount(i, x, n).astype(np.int64) for i in (iw, iu) for x in (count, tables)]


def _tell(g: int, words: np.ndarray, own: np.ndarray, *sums: np.ndarray) -> list[tuple]:
    bounds = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
    return [("r", g, None, int(own[a]), pack_words(words[a:b]), pack(np.r_[sums[0][a:b], sums[1][a:b]]), pack(np.r_[sums[2][a:b], sums[3][a:b]]), None) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


WORDS = "b int, c binary, c0 binary, cc binary, tc binary, t0 binary, sizes binary, g array<int>, at array<binary>"


def _words(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket of words: counts, tables as follower (c0), customers and tables as context, and which of them each bucket of pairs holds."""
    pdf = pdf.sort_values("g")
    lists = [unpack_words(x) for x in pdf["one"]]
    words, at = np.unique(np.concatenate(lists), return_inverse=True)
    ends = np.cumsum([len(x) for x in lists])
    at = np.split(at.astype(np.int32), ends[:-1])
    total = np.zeros((4, len(words)), np.int64)
    for i, two, three in zip(at, pdf["two"], pdf["three"], strict=True):
        for k, blob in ((0, two), (2, three)):
            total[k : k + 2, i] += unpack(blob, np.int64).reshape(2, -1)
    t0 = np.minimum(total[1], 1)
    return pd.DataFrame([(pdf["b"].iloc[0], *map(pack, total), pack(t0), pack(total[1][(total[1] > 0) & (total[1] <= MOVES)]), pdf["g"].tolist(), [pack(np.diff(i, prepend=np.int32(0))) for i in at])], columns=["b", "c", "c0", "cc", "tc", "t0", "sizes", "g", "at"])


class Parent:
    """Law of the restaurant of words: outcomes, customers, tables, discount."""

    def __init__(self, vocabulary: int, customers: int, tables: int, discount: float):
        self.vocabulary, self.customers, self.tables, self.discount = vocabulary, customers, tables, discount

    def rate(self) -> float:
        return (STRENGTH + self.discount * self.tables) / (self.vocabulary + 1)

    def probability(self, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        return (c0 - self.discount * t0 + self.rate()) / (STRENGTH + self.customers)


def _totals(words: DataFrame) -> pd.Series:
    """Tokens, vocabulary, customers, tables and words of one or two customers of the restaurant of words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, c0, t0 in zip(pdf["c"], pdf["c0"], pdf["t0"], strict=True):
                c, c0 = unpack(c, np.int64), unpack(c0, np.int64)
                yield pd.DataFrame({"k": range(6), "n": [c.sum(), (c > 0).sum(), c0.sum(), unpack(t0, np.int64).sum(), (c0 == 1).sum(), (c0 == 2).sum()]})

    found = dict(words.select("c", "c0", "t0").mapInPandas(run, "k int, n long").groupBy("k").agg(F.sum("n")).collect())
    return [found.get(k, 0) or 0 for k in range(6)]


def _answers(words: DataFrame, parent: Parent) -> DataFrame:
    """p0, customers and tables as context, and count of each word that a bucket of pairs holds, by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for r in whole.itertuples(index=False):
                c0, t0, c, cc, tc = (unpack(x, np.int64) for x in (r.c0, r.t0, r.c, r.cc, r.tc))
                p0 = parent.probability(c0, t0).astype(np.float32)
                for g, at in zip(r.g, r.at, strict=True):
                    at = np.cumsum(unpack(at, np.int32))
                    yield pd.DataFrame({"g": [g], "b": [r.b], "p0": [pack(p0[at])], "cc": [pack(cc[at])], "tc": [pack(tc[at])], "c": [pack(c[at])]})

    return words.mapInPandas(run, "g int, b int, p0 binary, cc binary, tc binary, c binary")


def _asked(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """p0, cc, tc and c of all words of a bucket of pairs, in its order, and each word's bucket."""
    pdf = pdf.sort_values("b")
    parts = [[unpack(x, k) for x in pdf[name]] for name, k in (("p0", np.float32), ("cc", np.int64), ("tc", np.int64), ("c", np.int64))]
    own = np.repeat(pdf["b"].to_numpy(), [len(x) for x in parts[0]])
    p0, cc, tc, c = (np.concatenate(x) for x in parts)
    return p0.astype(np.float64), cc, tc, c, own


SEATS = "kind string, g int, b int, one binary, two binary, three binary"


def _round(pairs: pd.DataFrame, answers: pd.DataFrame, seats: pd.DataFrame | None, discount: float, seed: list[int]) -> pd.DataFrame:
    """Gibbs moves in one bucket of pairs. s: tables of pairs that occur twice or more, sizes of the tables of those of up to MOVES customers; t: tables of each word as follower and as context, for each bucket of words."""
    p0, _, tc, _, own = _asked(answers)
    iu, iw, count = (unpack(pairs[k].iloc[0], kind) for k, kind in (("one", np.int32), ("two", np.int32), ("three", np.int64)))
    many = np.flatnonzero(count > 1)
    c, g = count[many], int(pairs["g"].iloc[0])
    rate, rng = (STRENGTH + discount * tc[iu[many]]) * p0[iw[many]], np.random.default_rng([*seed, g])
    few = c <= MOVES
    if seats is None:
        own_t, sizes = start_seating(c[few], rate[few], discount, rng)
    else:
        own_t, sizes = unpack(seats["one"].iloc[0], np.int64)[few], unpack(seats["two"].iloc[0], np.int64)
    t = seat_whole(np.where(few, 0, c), rate, discount, rng)
    t[few], sizes = reseat(c[few], own_t, sizes, rate[few], discount, MOVES, rng)
    tables = (count > 0).astype(np.int64)
    tables[many] = t
    rows = [("s", g, None, pack(t), pack(sizes), None)]
    bounds = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
    follower, context = np.bincount(iw, tables, len(own)).astype(np.int64), np.bincount(iu, tables, len(own)).astype(np.int64)
    rows += [("t", g, int(own[a]), pack(follower[a:b]), pack(context[a:b]), None) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return pd.DataFrame(rows, columns=["kind", "g", "b", "one", "two", "three"]).astype({"b": "Int32"})


def _seat_words(words: pd.DataFrame, told: pd.DataFrame, parent: Parent, seed: list[int]) -> pd.DataFrame:
    """A bucket of words after a round: tables as follower and as context added up again, its own customers seated anew."""
    r = words.iloc[0]
    c0, tc = (np.zeros(len(unpack(r["c"], np.int64)), np.int64) for _ in range(2))
    by_g = {g: (one, two) for g, one, two in told[["g", "one", "two"]].itertuples(index=False)}
    for g, at in zip(r["g"], r["at"], strict=True):
        at = np.cumsum(unpack(at, np.int32))
        one, two = by_g[g]
        c0[at] += unpack(one, np.int64)
        tc[at] += unpack(two, np.int64)
    rng = np.random.default_rng([*seed, int(r["b"])])
    rate = np.full(len(c0), parent.rate())
    # sizes are kept for words of up to MOVES customers; one that has had more starts at one table
    few = np.where(c0 <= MOVES, c0, 0)
    t, sizes = follow(few, np.where(unpack(r["c0"], np.int64) <= MOVES, unpack(r["t0"], np.int64), 0), unpack(r["sizes"], np.int64), rng)
    t, sizes = reseat(few, t, sizes, rate, parent.discount, MOVES, rng)
    t0 = t + seat_whole(c0 - few, rate, parent.discount, rng)
    return pd.DataFrame([(r["b"], r["c"], pack(c0), r["cc"], pack(tc), pack(t0), pack(sizes), r["g"], r["at"])], columns=["b", "c", "c0", "cc", "tc", "t0", "sizes", "g", "at"])


def _round_with(discount: float, seed: list[int]):
    def run(state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        seats = state[state["is_seat"] == 1]
        return _round(state[state["is_seat"] == 0], answers, seats if len(seats) else None, discount, seed)

    return run


def _seat_with(parent: Parent, seed: list[int]):
    return lambda words, told: _seat_words(words, told, parent, seed)


def predictive(count, tables, p0, cc, tc, discount: float) -> np.ndarray:
    return (count - discount * tables + (STRENGTH + discount * tc) * p0) / (STRENGTH + cc)


def score_documents(docs: DataFrame, key: str, held_out: Column) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability of the whole text) of each document; learns from the rows that are not held out."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(size / BUCKET_BYTES))
    merged = materialise(count_pairs(rows, buckets).groupBy("g").applyInPandas(lambda pdf: _merge(pdf, buckets), PAIRS), "kind")
    pairs = merged.where("kind = 'p'").select("g", "one", "two", "three")

    def ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["three"]:
                n = unpack(blob, np.int64)
                yield pd.DataFrame({"a": [(n == 1).sum()], "b": [(n == 2).sum()]})

    seen = pairs.select("three").mapInPandas(ones, "a long, b long").agg(F.sum("a"), F.sum("b")).first()
    discount = discount_of(seen[0] or 0, seen[1] or 0)
    words = materialise(merged.where("kind = 'r'").select("g", "b", "one", "two", "three").groupBy("b").applyInPandas(_words, WORDS))
    tokens, vocabulary, customers, tables, once, twice = _totals(words)
    parent = Parent(vocabulary, customers, tables, discount_of(once, twice))
    samples, seats = [], None
    for n in range(BURN_IN + SAMPLES):
        asked = _answers(words, parent)
        two = asked.drop("c").withColumn("c", F.lit(b""))
        state = pairs.select("g", F.lit(0).alias("is_seat"), "one", "two", "three")
        if seats is not None:
            state = state.union(seats.select("g", F.lit(1), "one", "two", "three"))
        made = state.groupBy("g").cogroup(two.groupBy("g")).applyInPandas(_round_with(discount, [5, n]), SEATS)
        made = materialise(made, "kind")
        seats = made.where("kind = 's'")
        told = made.where("kind = 't'").select("g", "b", "one", "two")
        words = materialise(words.groupBy("b").cogroup(told.groupBy("b")).applyInPandas(_seat_with(parent, [6, n]), WORDS))
        _, _, customers, tables, _, _ = _totals(words)
        parent = Parent(vocabulary, customers, tables, parent.discount)
        if n >= BURN_IN:
            samples.append((_answers(words, parent), seats))

    kinds = "kind string, sample int, b int, block long, one binary, two binary, three binary, four binary"
    nothing = F.lit(None).cast("binary")
    parts = merged.where("kind <> 'r'").select("g", "kind", F.lit(0).alias("sample"), F.lit(0).alias("b"), "block", "one", "two", "three", nothing.alias("four"))
    for n, (answers, state) in enumerate(samples):
        count = F.col("c") if n == 0 else nothing
        parts = parts.union(answers.select("g", F.lit("a"), F.lit(n), "b", F.lit(None).cast("long"), "p0", "cc", "tc", count))
        parts = parts.union(state.select("g", F.lit("s"), F.lit(n), F.lit(0), F.lit(None).cast("long"), "one", nothing, nothing, nothing))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[pdf["kind"] == "p"].iloc[0]
        iu, iw, count = unpack(p["one"], np.int32), unpack(p["two"], np.int32), unpack(p["three"], np.int64)
        many, mean, c = np.flatnonzero(count > 1), 0.0, None
        for n in range(SAMPLES):
            own = pdf[pdf["sample"] == n]
            p0, cc, tc, known, _ = _asked(own[own["kind"] == "a"].rename(columns={"one": "p0", "two": "cc", "three": "tc", "four": "c"}))
            c = known if n == 0 else c
            seated = (count > 0).astype(np.int64)
            seated[many] = unpack(own[own["kind"] == "s"]["one"].iloc[0], np.int64)
            mean = mean + predictive(count, seated, p0[iw], cc[iu], tc[iu], discount) / SAMPLES
        score, c = np.log10(mean).astype(np.float32), c[iw]
        out = []
        for block, at in pdf[pdf["kind"] == "m"][["block", "one"]].itertuples(index=False):
            at = np.cumsum(unpack(at, np.int32))
            out.append((int(block), int(pdf["g"].iloc[0]), pack(score[at]), pack(c[at])))
        return pd.DataFrame(out, columns=["block", "g", "score", "c"])

    answers = parts.groupBy("g").applyInPandas(answer, "block long, g int, score binary, c binary")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches):
            at, n_pairs, lengths = block.places(buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([n_pairs]), pa.array([pack(at)], pa.binary()), pa.array([pack(lengths)], pa.binary()), pa.array([block.keys], pa.list_(pa.int64())), pa.array([block.held], pa.list_(pa.bool_()))],
                names=["block", "n_pairs", "at", "lengths", "keys", "held"],
            )

    blocks = rows.mapInArrow(numbered, "block long, n_pairs long, at binary, lengths binary, keys array<long>, held array<boolean>")
    base = math.log10(tokens + vocabulary + 1)

    def add_up(block: pa.Table, parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("g")
        score = np.concatenate([unpack(x, np.float32) for x in parts["score"].to_pylist()]).astype(np.float64)
        c = np.concatenate([unpack(x, np.int64) for x in parts["c"].to_pylist()])
        if block["n_pairs"].to_pylist() != [len(score)]:
            raise RuntimeError("a block's documents have changed since its pairs were counted; write the input as a table first")
        at, lengths = unpack(block["at"][0].as_py(), np.int32), unpack(block["lengths"][0].as_py(), np.int64)
        starts = np.cumsum(lengths) - lengths
        known, own, total = (np.add.reduceat(x[at], starts) for x in ((c > 0).astype(np.int64), np.log10(c + 1.0) - base, score))
        columns = [block["keys"].combine_chunks().flatten(), block["held"].combine_chunks().flatten(), lengths, known, np.full(len(lengths), tokens, np.int64), own, total]
        return pa.table(columns, names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.withColumnRenamed("key", key)


def language_model_report(docs: DataFrame) -> DataFrame:
    """Scores of all documents; those whose crc32(doc_id as text) mod 7 is 2 are held out."""
    return score_documents(docs, "doc_id", crc_remainder("doc_id", 7) == 2)
