"""Operator 7 against brute force."""

import numpy as np
import pytest
import xxhash

from tokenloom.llm import simhash
from tokenloom.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    label = list(range(len(ids)))
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    rank = {i: r for r, i in enumerate(order)}
    label = [rank[i] for i in range(len(ids))]
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [ids[order[x]] for x in label]


def test_edges_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(25):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    want = plain_components(list(range(len(fps))), fps)
    rows = spark.createDataFrame([(int(np.array(x, np.uint64).view(np.int64)),) for x in fps], "fp long")
    at = {int(np.array(x, np.uint64).view(np.int64)): i for i, x in enumerate(fps)}
    for hot in (4096, 3):
        monkeypatch.setattr(simhash, "HOT_RUN", hot)
        edges = simhash.link_edges(rows).collect()
        label = list(range(len(fps)))

        def root(i, label=label):
            while label[i] != i:
                i = label[i]
            return i

        for e in edges:
            a, b = sorted((root(at[e["a"]]), root(at[e["b"]])))
            label[b] = a
        assert [root(i) for i in range(len(fps))] == want


def test_report_with_odd_rows(spark):
    text = "Eins zwei drei vier fünf sechs sieben acht neun zehn"
    rows = [(5, text, "x"), (3, text.replace("Eins", "EINS").lower(), "x"), (9, None, None), (7, "", ""), (8, "ein Wort", "y"), (5, text, "x"), (None, "ganz anders als alle die anderen Texte hier", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicate_report(docs).collect()), key=str)
    fps = {t: f"{plain_fingerprint(t):016x}" for _, t, _ in rows}
    assert got == sorted([(5, fps[text], 3), (5, fps[text], 3), (3, fps[text], 3), (9, "0" * 16, 7), (7, "0" * 16, 7), (8, fps["ein Wort"], 8), (None, fps[rows[-1][1]], None)], key=str)
    assert simhash.near_duplicate_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "two"])
def test_components(spark, shape):
    edges = {"path": [(i, i + 1) for i in range(20)], "star": [(0, i) for i in range(1, 30)], "two": [(1, 2), (5, 4), (4, 9), (7, 7)]}[shape]
    got = {(r["id"], r["component"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {"path": {(i, 0) for i in range(21)}, "star": {(i, 0) for i in range(30)}, "two": {(1, 1), (2, 1), (4, 4), (5, 4), (9, 4)}}[shape]
    assert got == want
