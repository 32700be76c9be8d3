"""Operator 11 against a plain ranking."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tokenloom.llm import ranked


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    own = [(d, Counter(terms_of(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = defaultdict(list)
    for item, text in items:
        scores = []
        for d, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out[item, text] = [(d, -s) for s, _, _, d in sorted(scores, key=lambda x: x[:3])[:k]]
    return {k: v for k, v in out.items() if v}


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        assert r["rank"] == len(out[r["item_id"], r["query"]]) + 1
        out[r["item_id"], r["query"]].append((r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize("group, slices", [(8192, 200_000), (7, 40)])
def test_search_equals_plain(spark, monkeypatch, group, slices):
    monkeypatch.setattr(ranked, "GROUP_TERMS", group)
    monkeypatch.setattr(ranked, "SLICE_TERMS", slices)
    draw = random.Random(1)
    words = ["a", "B", "été", "x1", "漢字", *(f"w{i}" for i in range(40))]

    def text(n):
        return " ".join(draw.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n)) + draw.choice(["", ".", " - ;"])

    docs = [(i, text(draw.randint(0, 30))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (2**60, docs[8][1]), (5, docs[9][1]), (400, None), (401, ""), (402, "?!"), (403, text(5000))]
    items = [(i, text(draw.randint(1, 12))) for i in range(12)] + [(50, docs[7][1]), (51, "unheard words"), (52, None), (53, text(60)), (54, "a " * 30)]
    # queries are numbered in the order of id and text, nulls left out
    numbers = {x: n for n, x in enumerate(x for x in items if x[1] is not None)}
    rows = spark.createDataFrame([(*d, "clash", 0) for d in docs], "doc_id long, text string, score string, rank int").repartition(5)
    queries = spark.createDataFrame([(*x, "clash") for x in [*items, items[0]]], "item_id long, text string, doc_id string")
    got = found(ranked.search(rows, queries))
    want = {(item, numbers[item, text]): v for (item, text), v in plain(docs, items).items()}
    assert {k: [s for _, s in v] for k, v in got.items()} == {k: [s for _, s in v] for k, v in want.items()}
    assert got == want


def test_blocks_that_fill(spark, monkeypatch):
    docs = [(i, f"word{i % 3} common") for i in range(ranked.BLOCK * 2 + 5)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "word1"), (2, "common"), (3, "word2 word0")], "item_id long, text string")
    got = found(ranked.search(rows, queries, 4))
    assert got[1, 0] == plain(docs, [(1, "word1")], 4)[1, "word1"] and [d for d, _ in got[1, 0]] == [1, 4, 7, 10]
    assert [d for d, _ in got[3, 2]] == [0, 2, 3, 5]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs.limit(0), queries).count() == 0
    assert ranked.search(docs, queries.limit(0)).count() == 0
    assert ranked.search_report(docs, queries).columns == ["item_id", "rank", "doc_id", "score"]


def test_sums_and_best_of_slices():
    rng = np.random.default_rng(2)
    numbers = rng.integers(0, 50, size=(6, 3, ranked.BLOCK))  # addends, rows, documents
    sums = None
    for part in numbers:
        row, doc = np.nonzero(part)
        bits = ranked.Slices(row, doc, part[row, doc], 3).bits
        if sums is None:
            sums = list(bits.copy())
        else:
            ranked.added(sums, bits, 3)
    total = numbers.sum(axis=0)
    row, doc, score = ranked.best(sums, 25)
    for r in range(3):
        want = sorted(range(ranked.BLOCK), key=lambda d: (-total[r, d], d))[:25]
        assert sorted(doc[row == r].tolist()) == sorted(want)
    assert (score == total[row, doc]).all()
