"""Benchmark decontamination (operator 2) with a generalised suffix automaton over test items.

The automaton of all normalised items is built once on the driver from the benchmark table, shipped to the
tasks, and every document's words stream through it in one pass that tracks the longest suffix which also
occurs in an item. Where that length reaches a window, the words of the window are hit.

A benchmark is a fixed set of test items; its size is checked: above MAX_AUTOMATON_WORDS words it is cut into
slices of whole items, read from the benchmark table one at a time, and each takes a pass of its own over the
documents, so neither the driver nor a broadcast holds more than one slice's automaton. A task builds it once.

Edge cases: null or empty documents have no words and no hits; items without words match nothing; an item of
fewer words than a window is one window; equal items and repeated rows count by item_id, once each; an item
whose id is null marks words but is not listed; an empty benchmark leaves every document clean; decontaminate()
keeps all columns of docs, those named like find_spans' results too (names that begin with _own_, _span_, _spans,
_items, _cut_text, _stays or _was_hit are reserved).
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import alnum_words, materialise, utf8, with_computed

WINDOW = 10
#: Words of items in one automaton: about 300 bytes of memory each.
MAX_AUTOMATON_WORDS = 400_000
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of words, with the items in which each window ends."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = [[]]
        self.ids = [i for i, _ in items]
        whole: list[tuple[int, int]] = []
        for n, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w)
                while len(ends) < len(self.length):
                    ends.append([])
                ends[last].append(n)
            if 0 < len(words) < window:
                whole.append((last, n))
        # items that end at a state also end at the states its suffix links lead to
        order = np.argsort(self.length, kind="stable")[::-1]
        items_at = [set(e) for e in ends]
        for s in order.tolist():
            if self.link[s] > 0 and self.length[self.link[s]] >= window:
                items_at[self.link[s]] |= items_at[s]
        #: state -> items with a full window that ends here, where the longest suffix is long enough
        self.full = [tuple(items_at[s]) if self.length[s] >= window else () for s in range(len(self.length))]
        #: state -> (length, item) of short items that are a suffix of the state's words
        short: dict[int, list[tuple[int, int]]] = {}
        for s, n in whole:
            short.setdefault(s, []).append((self.length[s], n))
        # a short item's state is reached over suffix links from longer matches
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        lengths = {n: len(words) for n, (_, words) in enumerate(items)}
        own = {s: tuple((lengths[n], n) for _, n in found) for s, found in short.items()}
        for s in order[::-1].tolist():
            self.short[s] = own.get(s, ()) + (self.short[self.link[s]] if self.link[s] >= 0 else ())

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # another item has led here
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(first word, word after the last, items) of each window that occurs."""
        nxt, link, length, full, short, window = self.next, self.link, self.length, self.full, self.short, self.window
        root = nxt[0]
        state = size = 0
        for at, w in enumerate(words, 1):
            if not state:
                state = root.get(w, 0)
                size = 1 if state else 0
            else:
                to = nxt[state].get(w)
                while to is None and state:
                    state = link[state]
                    size = length[state]
                    to = nxt[state].get(w)
                if to is None:
                    continue
                state = to
                size += 1
            if size >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                yield at - window, at, full[s]
            if short[state]:
                for n, item in short[state]:
                    if n <= size:
                        yield at - n, at, (item,)


def slices_of(benchmark: DataFrame) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Slices of (item_id, words), each of at most MAX_AUTOMATON_WORDS words or one item, ordered by id; one at a time."""
    items: list[tuple[str | None, list[bytes]]] = []
    held = 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        words = alnum_words(r["text"])
        if not words:
            continue
        if items and held + len(words) > MAX_AUTOMATON_WORDS:
            yield items
            items, held = [], 0
        items.append((r["item_id"], words))
        held += len(words)
    if items:
        yield items


FIELDS = "n_words long, hits array<struct<first:int,past:int>>, item_ids array<string>"


def _pass(docs: DataFrame, items: list[tuple[str | None, list[bytes]]], window: int, without: tuple[str, ...] = ()):
    """docs with FIELDS for one slice of the benchmark, and the broadcast that the tasks read."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(SuffixAutomaton(items, window)))

    def start():
        automaton = pickle.loads(shared.value)  # once a task

        def compute(texts: list) -> list:
            counts, hits, ids = [], [], []
            for text in texts:
                words = alnum_words(text)
                spans, found = [], set()
                for first, past, at in automaton.matches(words):
                    spans.append((first, past))
                    found.update(at)
                counts.append(len(words))
                hits.append([{"first": a, "past": b} for a, b in joined(spans)])
                ids.append(sorted({automaton.ids[i] for i in found} - {None}))
            return [counts, hits, ids]

        return compute

    return with_computed(docs, ["text"], FIELDS, start, without), shared


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, hits array<struct<first, past>> (disjoint, in words) and item_ids, sorted; columns of these names are replaced.

    A benchmark of one slice takes one pass. Of more slices each takes a pass of its own over the numbered documents
    that leaves only documents with hits, in the shared folder; its automaton is then dropped from all executors.
    """
    slices = slices_of(benchmark)
    first, second = next(slices, []), next(slices, None)
    if second is None:
        return _pass(docs, first, window)[0]
    numbered = materialise(docs.drop("n_words", "hits", "item_ids").withColumn("_span_row", F.monotonically_increasing_id()))
    found = None
    for items in chain([first, second], slices):
        rows, shared = _pass(numbered.select("_span_row", "text"), items, window, without=("text",))
        part = materialise(rows.where(F.size("hits") > 0).drop("n_words"))
        shared.destroy()
        found = part if found is None else found.union(part)
    gathered = found.groupBy("_span_row").agg(F.flatten(F.collect_list("hits")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("_items"))
    together = numbered.join(gathered, "_span_row", "left").drop("_span_row")

    def start():
        def compute(texts: list, spans: list, items: list) -> list:
            own = [joined([(s["first"], s["past"]) for s in x or []]) for x in spans]
            return [[len(alnum_words(t)) for t in texts], [[{"first": a, "past": b} for a, b in x] for x in own], [x or [] for x in items]]

        return compute

    return with_computed(together, ["text", "_spans", "_items"], FIELDS, start, without=("_spans", "_items"))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint sorted spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw = utf8(text)
    at = [m.span() for m in WORD.finditer(raw)]
    out, last = [], 0
    for first, past in spans:
        out.append(raw[last : at[first][0]])
        last = at[past - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs without contaminated words: hit spans (longer than no window) are cut out of the text, and a document of which they cover more than max_coverage goes. n_chars, where there is one, follows the text."""
    columns = docs.columns
    clash = {c: f"_own_{c}" for c in columns if c in ("n_words", "hits", "item_ids")}
    found = find_spans(docs.withColumnsRenamed(clash), benchmark, window)

    def start():
        def compute(texts: list, hits: list, lengths: list) -> list:
            out, keep = [], []
            for text, found, n in zip(texts, hits, lengths, strict=True):
                spans = [(s["first"], s["past"]) for s in found]
                hit = sum(b - a for a, b in spans)
                keep.append(hit <= max_coverage * n)
                out.append(without_spans(text, spans) if hit and keep[-1] else text)
            return [out, keep, [bool(x) for x in hits]]

        return compute

    cut = with_computed(found, ["text", "hits", "n_words"], "_cut_text string, _stays boolean, _was_hit boolean", start, without=("hits", "n_words", "item_ids"))
    clean = cut.where("_stays").withColumn("text", F.col("_cut_text")).withColumnsRenamed({v: k for k, v in clash.items()})
    if "n_chars" in columns:
        clean = clean.withColumn("n_chars", F.when(F.col("_was_hit"), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*columns)
