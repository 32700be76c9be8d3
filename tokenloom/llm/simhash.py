"""SimHash near-duplicates (operator 7): pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint's 64 bits fall into six blocks. Two fingerprints that differ in three bits or fewer agree in at
least three blocks, so they share one of the 20 keys made of three blocks (32 bits or more each). Equal
fingerprints are folded first; each distinct one goes to its 20 keys, and the fingerprints of one key are
compared inside sorted runs of a partition. A run longer than HOT_RUN is not compared at once: its members are
dealt again by the same rule over the bits that the key leaves open, which bounds a run by the 2^17 values
of 17 bits. Runs give spanning trees, never all pairs; components() joins the trees.

Edge cases: null texts and texts without words have fingerprint zero and link like any other; a text of fewer
words than a shingle is one shingle; repeated shingles count each time; a document with null id takes part, and
component_id is the least non-null id of its component (null if there is none); repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise, spaced_words, with_computed
from tokenloom.llm.components import components, forest

SEED = 42
MAX_BITS = 3
#: Widths of the six blocks, and a run's length from which its members are dealt again.
BLOCKS = (11, 11, 11, 11, 10, 10)
HOT_RUN = 4096


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bits set in more than half of the shingles' XXH64 values, as an unsigned number; zero without words."""
    if not words:
        return 0
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(whole[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int32) * 2 > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs without text, with fp: the fingerprint as a signed long."""

    def start():
        return lambda texts: [np.array([fingerprint(spaced_words(t), shingle) for t in texts], np.uint64).view(np.int64)]

    return with_computed(docs, ["text"], "fp long", start, without=("text",))


def _masks(widths: list[tuple[int, int]]) -> list[int]:
    """A mask for each choice of half of the blocks, given as (lowest bit, width)."""
    return [sum(((1 << w) - 1) << at for at, w in chosen) for chosen in combinations(widths, len(widths) // 2)]


def _spans(open_bits: list[int]) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(open_bits), 6)]


_bits = np.cumsum([0, *BLOCKS])
MASKS = np.array(_masks([(int(a), w) for a, w in zip(_bits[:-1], BLOCKS, strict=True)]), np.uint64)


def _second_masks(first: int) -> np.ndarray:
    """first's mask with each half of six blocks of the bits that it leaves open."""
    blocks = _spans([b for b in range(64) if not first >> b & 1])
    return np.array([first | sum(1 << int(b) for block in chosen for b in block) for chosen in combinations(blocks, 3)], np.uint64)


SECOND = np.stack([_second_masks(int(m)) for m in MASKS])


def tree(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the fingerprints that link, breadth first: (child, parent) fingerprints."""
    rest, queue, child, parent = fps, [], [], []
    while len(rest) or queue:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        x = queue.pop()
        if len(rest):
            near = np.bitwise_count(rest ^ x) <= MAX_BITS
            if near.any():
                found = rest[near]
                child.append(found)
                parent.append(np.full(len(found), x))
                queue += list(found)
                rest = rest[~near]
    return (np.concatenate(child), np.concatenate(parent)) if child else (fps[:0], fps[:0])


def _edges(key: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
    """Tree edges within runs of equal keys; rows are sorted by key."""
    a, b = [], []
    bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.array([0])
    sizes = np.diff(bounds)
    for k in np.flatnonzero(sizes > 16):
        c, p = tree(fps[bounds[k] : bounds[k + 1]])
        a.append(c)
        b.append(p)
    short = np.repeat(sizes <= 16, sizes)
    left, right = [], []
    for step in range(1, int(min(16, max([1, *sizes])))):
        same = np.flatnonzero((key[step:] == key[:-step]) & short[step:])
        near = same[np.bitwise_count(fps[same] ^ fps[same + step]) <= MAX_BITS]
        left.append(near)
        right.append(near + step)
    if left and sum(map(len, left)):
        label = forest(np.concatenate(left), np.concatenate(right), len(fps))
        moved = np.flatnonzero(label != np.arange(len(fps)))
        a.append(fps[moved])
        b.append(fps[label[moved]])
    a = np.concatenate([*a, np.empty(0, np.uint64)]).astype(np.uint64)
    b = np.concatenate([*b, np.empty(0, np.uint64)]).astype(np.uint64)
    return pd.DataFrame({"choice": np.full(len(a), -1, np.int16), "a": a.view(np.int64), "b": b.view(np.int64)})


def _again(choice: int, fps: np.ndarray) -> pd.DataFrame:
    """The members of a hot run with their 20 finer keys: b is the masked fingerprint, choice tells both choices of blocks."""
    masks = SECOND[choice]
    return pd.DataFrame({"choice": np.repeat(choice * 20 + np.arange(20), len(fps)).astype(np.int16), "a": np.tile(fps, 20).view(np.int64), "b": (fps[None, :] & masks[:, None]).ravel().view(np.int64)})


def _compare(last: bool):
    """Makes a function that streams rows (choice, b: masked, a: fingerprint) sorted by choice and b; gives edges (choice -1) and, unless last, rows to deal again."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        choice, masked, fps = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        hot: tuple[int, int] | None = None
        for pdf in batches:
            choice = np.r_[choice, pdf["choice"].to_numpy(np.int64)]
            masked = np.r_[masked, pdf["b"].to_numpy(np.int64).view(np.uint64)]
            fps = np.r_[fps, pdf["a"].to_numpy(np.int64).view(np.uint64)]
            if hot:  # the rows that go on with a run already found to be long
                more = (choice == hot[0]) & (masked == np.uint64(hot[1]))
                if more.any():
                    yield _again(hot[0], fps[more])
                if more.all():
                    choice, masked, fps = choice[:0], masked[:0], fps[:0]
                    continue
                choice, masked, fps, hot = choice[~more], masked[~more], fps[~more], None
            change = np.flatnonzero((choice[1:] != choice[:-1]) | (masked[1:] != masked[:-1])) + 1
            bounds = np.r_[0, change, len(choice)]
            if not last:
                long = np.flatnonzero(np.diff(bounds) > HOT_RUN)
                keep = np.ones(len(choice), bool)
                for k in long:
                    s, e = bounds[k], bounds[k + 1]
                    yield _again(int(choice[s]), fps[s:e])
                    keep[s:e] = False
                    if e == len(choice):
                        hot = (int(choice[s]), int(masked[s]))
                cut = bounds[-1] if hot else bounds[-2]
            else:
                keep, cut = np.ones(len(choice), bool), bounds[-2]
            use = keep[:cut]
            run_no = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            yield _edges(run_no[:cut][use], fps[:cut][use])
            choice, masked, fps = choice[cut:], masked[cut:], fps[cut:]
        yield _edges(np.zeros(len(fps), np.int64), fps)

    return stream


ROWS = "choice short, a long, b long"


def link_edges(fps: DataFrame) -> DataFrame:
    """Tree edges (a, b) that connect distinct fingerprints (column fp) exactly as their links of at most three bits do."""
    masks = F.array(*[F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(int(m.astype(np.int64)))).alias("b")) for i, m in enumerate(MASKS)])
    keyed = fps.select(F.col("fp").alias("a"), F.explode(masks).alias("k")).select("k.choice", "a", "k.b")

    def dealt(rows: DataFrame, last: bool) -> DataFrame:
        return rows.repartition("choice", "b").sortWithinPartitions("choice", "b", "a").mapInPandas(_compare(last), ROWS)

    first = materialise(dealt(keyed, False))
    second = dealt(first.where("choice >= 0"), True) if not first.where("choice >= 0").isEmpty() else first.limit(0)
    return first.where("choice < 0").union(second.where("choice < 0")).select("a", "b")


def _grouped(marked: DataFrame, key: str) -> DataFrame:
    """marked (key, fp and more) with component (a fingerprint of the group) and component_id (its least key)."""
    folded = materialise(marked.groupBy("fp").agg(F.min(key).alias("least")))
    joined = components(link_edges(folded)).select(F.col("id").alias("fp"), "component")
    placed = folded.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(placed.join(least, "component").select("fp", "component", "component_id"), "fp")


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """key, fp and component_id (the least key of the component) of every document."""
    return _grouped(materialise(fingerprints(docs.select(key, "text"), shingle)), key).select(key, "fp", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = near_duplicate_groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
