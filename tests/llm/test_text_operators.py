"""Operators 2, 5, 9 and 10 against plain versions, the tokenizers library and held-out rows."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from tokenloom.llm import bpe, decontaminate, language_model, near_copies, quality, simhash, toxicity
from tokenloom.llm.queries import vocabulary_path

ODD = ["", None, "Ein Wort", "naïve ÀÉ  ﬁ ǅ Σίσυφος ΟΔΟΣ", "x<|endoftext|>y <|startoftext|>", "a\u00a0b\x1fc\u2028d\u0085e", "don't WON'T it's we'll", "𝔘𝔫𝔦 😀😀 👩‍👩‍👧", "1234567 3.14", "e\u0301 o\u0308", "!!!??? ---", "aaaa" * 300, "İstanbul ß ẞ"]


def test_bpe_equals_tokenizers(spark):
    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = [*ODD, *real[:80], " ".join(real[:40])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, token_ids string")
    for r in bpe.token_digests(docs, path).collect():
        ids = library.encode((([*texts, texts[3]][r["doc_id"]]) or ""), add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids), [*texts, texts[3]][r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe.encode_documents(docs, path)
    assert coded.columns == ["doc_id", "text", "token_ids", "decoded"]
    assert coded.limit(0).count() == 0 and bpe.token_digests(docs.limit(0), path).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(text, items, window):
    words = words_of(text)
    hit, found = set(), set()
    for item, its in items:
        own = words_of(its)
        size = min(window, len(own))
        for a in range(max(0, len(own) - size + 1) if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[a : a + size]:
                    hit |= set(range(at, at + size))
                    found.add(item)
    ids = sorted(str(i) for i in found if i is not None)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("slice_words", [400_000, 30])
def test_contamination_equals_brute_force(spark, monkeypatch, slice_words):
    monkeypatch.setattr(decontaminate, "MAX_AUTOMATON_WORDS", slice_words)
    rng = np.random.default_rng(5)
    some = ["a", "b", "c", "Ä", "d1"]
    items = [(i, " ".join(rng.choice(some, rng.integers(0, 14)))) for i in range(25)] + [(90, "A, b! c"), (91, "a b c"), (92, None), (93, "--"), (None, "d1 d1"), (90, "A, b! c")]
    docs = [(i, " ".join(rng.choice(some, rng.integers(0, 120)))) for i in range(40)] + [(None, None), (100, ""), (101, items[3][1]), (101, items[3][1]), (102, "a-b_c" * 500)]
    table = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (4, 10):
        got = sorted(([r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]] for r in decontaminate.contamination_report(table, bench, window).collect()), key=str)
        assert got == sorted(([i, *plain_contamination(t, items, window)] for i, t in docs), key=str)
    assert decontaminate.contamination_report(table.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination_report(table, bench.limit(0)).collect())


def test_spans_are_cut(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rest = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"Before it, ONE two-three {item[14:]} after. {rest}", 9, "x"), (2, item, 5, "x"), (3, rest, 7, "x"), (None, None, None, None)], "doc_id long, text string, n_chars long, n_words string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3, None} and got[3]["text"] == rest and got[3]["n_chars"] == 7
    assert got[1]["text"] == f"Before it,  after. {rest}" and got[1]["n_chars"] == len(got[1]["text"])


def test_language_model(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    shares = np.arange(1, 201.0) ** -1.1
    docs = [(i, " ".join(rng.choice(words, rng.integers(5, 60), p=shares / shares.sum())) + (f" rare{i}" if i % 3 else "")) for i in range(300)] + [(None, None), (301, ""), (301, ""), (302, "W1 w1\x0bW2\xa0x")]
    table = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, score string")
    got = language_model.language_model_report(table).collect()
    assert len(got) == len(docs)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}

    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), "<end>"]

    counts = Counter(w for i, t in docs if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held[i], len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in docs), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 for r in got)
    assert language_model.language_model_report(table.limit(0)).count() == 0


def test_language_model_held_out_perplexity(spark):
    """Better than add-one on held-out documents with many rare words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = [r for r in language_model.language_model_report(docs).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in out)
    assert 10 ** (-sum(r["score"] for r in out) / tokens) < 0.7 * 10 ** (-sum(r["base_score"] for r in out) / tokens)


def test_model_probabilities_add_up(spark):
    """In every context the probabilities of the training vocabulary and the event of any other word add up to one."""
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(words[: i % 12 + 1])) for i in range(50)], "doc_id long, text string")
    outcomes = [*words, "unseen"]
    asked = ["", *outcomes, *[f"{u} {w}" for u in outcomes for w in outcomes]]
    probes = docs.union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(asked)], "doc_id long, text string"))
    p = {asked[r["doc_id"] - 1000]: 10 ** r["score"] for r in language_model.score_documents(probes, "doc_id", probes["doc_id"] >= 1000).collect() if r["doc_id"] >= 1000}
    # x: one over the probability of the end in each context, which each context's sum of one determines
    ratio = np.array([[p[f"{u} {w}"] / p[u] for w in outcomes] for u in outcomes])
    x = np.linalg.solve(np.eye(len(outcomes)) - ratio, np.ones(len(outcomes)))
    assert x.min() > 1 and abs(p[""] + sum(p[w] * v for w, v in zip(outcomes, x, strict=True)) - 1) < 1e-5


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(7)
    plain, rude = [f"word{i}" for i in range(300)], [f"rude{i}" for i in range(10)]
    docs, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.3
        text = list(rng.choice(plain, 30)) + (list(rng.choice(rude, 8, replace=False)) if toxic else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text), "c"))
        labels.append((i, int(toxic)))
    docs += [(None, None, None), (1000, "", ""), (1001, "RUDE1 rude2 rude3!", ""), (1001, "RUDE1 rude2 rude3!", "")]
    labels += [(3, None), (None, 1), (2000, 1)]
    table, marks = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_report(table, marks).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    truth = dict(labels)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 200 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    clean = toxicity.without_toxic(table, marks)
    assert clean.columns == table.columns
    assert not {1001} & {r["doc_id"] for r in clean.collect()} and {None, 1000} <= {r["doc_id"] for r in clean.collect()}
    assert toxicity.toxicity_report(table.limit(0), marks).count() == 0
    assert {r["score"] for r in toxicity.toxicity_report(table, marks.limit(0)).collect()} == {0.5}


def test_toxicity_in_texts_of_two_kinds(spark):
    """Votes of one kind of text lie lower than those of the other: its toxic rows are found all the same, held out, and no clean ones."""
    rng = np.random.default_rng(23)
    docs, labels = [], []
    for i in range(2400):
        toxic, other = rng.random() < 0.3, rng.random() < 0.3
        kind, rude, n = ("b", 30, 4) if other else ("a", 10, 5)
        common, rare = 1 / np.arange(1, 301), rng.integers(0, 3000, 20)
        text = [f"{kind}{w}" for w in rng.choice(300, 60, p=common / common.sum())] + [f"{kind}rare{w}" for w in rare]
        text += [f"{kind}rude{w}" for w in rng.choice(rude, n, replace=False)] if toxic else []
        docs.append((i, " ".join(rng.permutation(text))))
        labels.append((i, int(toxic)))
    got = toxicity.toxicity_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    truth = dict(labels)
    for kind in "ab":
        own = [r for r in got if f"{kind}0 " in docs[r["doc_id"]][1]]
        assert np.mean([r["predicted"] for r in own if truth[r["doc_id"]]]) > 0.65
        assert np.mean([r["predicted"] for r in own if not truth[r["doc_id"]]]) < 0.04


def tfidf(counts, df, n):
    v = {w: (1 + math.log(k)) * max(0.0, math.log((n - df[w] + 0.5) / (df[w] + 0.5))) for w, k in counts.items() if w in df}
    length = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / length for w, x in v.items() if x > 0} if length else {}


@pytest.mark.parametrize("block,first", [(128, 4), (16, 1)])
def test_toxicity_equals_brute_force(spark, monkeypatch, block, first):
    """Neighbours, their cosines and the votes of every document against all pairs of plain TF-IDF vectors."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", first)
    rng = np.random.default_rng(11)
    groups = [[f"wort{g}x{i}" for i in range(120)] for g in range(3)]
    docs = [(i, " ".join(rng.choice(groups[i % 3], rng.integers(5, 40))) + (f" einzig{i % 170}" if i % 3 else "")) for i in range(300)]
    labels = [(i, int(rng.random() < 0.3)) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", None)
    model = toxicity.load(model)
    got = {r["doc_id"]: r for r in toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    counts = [Counter(t.split()) for _, t in docs]
    held = {w for i, _ in labels for w in counts[i]}
    df = {w: sum(w in c for c in counts) for w in held}
    vectors = [tfidf(c, df, len(docs)) for c in counts]
    truth = dict(labels)
    for i, v in enumerate(vectors):
        cosine = {j: sum(x * vectors[j].get(w, 0.0) for w, x in v.items()) for j, _ in labels}
        best = sorted((c for c in cosine.values() if c > 0), reverse=True)[: toxicity.NEIGHBOURS]
        told = got[i]["evidence"]
        assert np.allclose([e["cosine"] for e in told], best) and np.allclose([cosine[e["doc_id"]] for e in told], best)
        assert all(e["toxic"] == truth[e["doc_id"]] for e in told) and len({e["doc_id"] for e in told}) == len(told)
        vote = sum(e["cosine"] for e in told if e["toxic"]) / sum(best)
        want = 1 / (1 + math.exp(-model.start - model.slope * math.log((vote + toxicity.SMOOTH) / (1 - vote + toxicity.SMOOTH))))
        assert abs(got[i]["score"] - want) < 1e-9
    assert len({r["score"] for r in got.values()}) > 100


def test_curve_is_right_where_predictions_are_decided():
    """The share of toxic examples rises steeply between votes of 0.2 and 0.36, as it does at sf0.1; a curve over all votes is too flat for it."""
    rng = np.random.default_rng(17)
    votes = np.r_[rng.beta(2, 17, 5000), rng.beta(3, 5, 900)]
    share = np.interp(votes, [0, 0.1, 0.2, 0.26, 0.29, 0.34, 0.55], [0.01, 0.03, 0.15, 0.36, 0.69, 0.94, 1.0])
    y, weight = (rng.random(len(votes)) < share).astype(np.int64), rng.uniform(0.5, 1.5, len(votes))
    start, slope = toxicity.calibrated(votes, y, weight, -2.0)
    says = 1 / (1 + np.exp(-start - slope * toxicity.log_odds((votes + toxicity.SMOOTH) / (1 + 2 * toxicity.SMOOTH))))
    cut = votes[says >= toxicity.THRESHOLD].min()
    assert 0.27 < cut < 0.32  # the true share is 0.7 at 0.29
    assert abs((says - share)[(votes > 0.2) & (votes < 0.4)]).mean() < 0.08
    assert toxicity.calibrated(votes, np.zeros_like(y), weight, -2.0) == (-2.0, 0.0)


def test_toxicity_scores_are_calibrated(spark):
    """Held out, scores near p go with a share of toxic rows near p; copies of one text are one example."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = [(r["score"], r["toxic"]) for r in toxicity.toxicity_report(docs, labels).where("held_out").join(labels, "doc_id").collect()]
    for low, high in ((0, 0.1), (0.1, 0.5), (0.5, 1)):
        own = [(s, y) for s, y in rows if low <= s < high]
        assert len(own) > 30 and abs(np.mean([s for s, _ in own]) - np.mean([y for _, y in own])) < 0.12
    assert sum(s >= 0.7 for s, _ in rows) > 50 and np.mean([y for s, y in rows if s >= 0.7]) > 0.9
    many = spark.createDataFrame([(i, "same text here") for i in range(50)] + [(60, "other words"), (61, "more other words")], "doc_id long, text string")
    sample = toxicity.labelled_sample(many, many.selectExpr("doc_id", "int(doc_id > 55) toxic"), "toxic", many["doc_id"] >= 0).collect()
    assert sorted((r["text"], r["y"], r["weight"]) for r in sample) == [("more other words", 1, 1.0), ("other words", 1, 1.0), ("same text here", 0, 50.0)]


def test_a_block_counts_its_pairs_by_sorting():
    """Distinct pairs and counts against plain counting, in little more time than their keys take to make."""
    rng = np.random.default_rng(31)
    block, want, every = language_model.Block(), Counter(), set()
    for i in range(400):
        words = [b"%d" % x for x in np.minimum(rng.zipf(1.2, 4000), 10**9)]
        block.add(i, i % 7 == 2, b" ".join(words).decode())
        follow = [*zip([language_model.START, *words], [*words, b""], strict=True)]
        every.update(follow)
        want.update(follow if i % 7 != 2 else [])
    name = {w: language_model.xxhash.xxh64_intdigest(w) & language_model.WORD_BITS for w in block.index}
    g, u, w, n = block.pairs(37)
    assert dict(zip(zip(u.tolist(), w.tolist(), strict=True), n.tolist(), strict=True)) == {(name[a], name[b]): want[a, b] for a, b in every}
    assert (np.diff(g.astype(np.int64)) >= 0).all() and (g == (u % 37 + (w >> 8) % 3) % 37).all()

    def least(f):
        took = []
        for _ in range(4):
            start = time.process_time()
            f(37)
            took.append(time.process_time() - start)
        return min(took)

    assert least(block.pairs) < 2.5 * least(block.keys_of_pairs)


def stirling(c, d):
    """Generalised Stirling numbers: weights of the ways to seat c customers at t tables."""
    row = {0: 1.0}
    for n in range(c):
        row = {t: row.get(t - 1, 0.0) + row.get(t, 0.0) * (n - d * t) for t in range(n + 2)}
    return row


def test_gibbs_moves_reach_the_posterior():
    """Tables of many equal dishes after some rounds against the exact law."""
    rng = np.random.default_rng(12)
    for c, rate, d in ((2, 0.7, 0.5), (5, 1.3, 0.3), (9, 0.2, 0.8)):
        n = 6000
        t, sizes = np.ones(n, np.int64), np.full(n, c)
        for _ in range(6):
            t, sizes = language_model.reseat(np.full(n, c), t, sizes, np.full(n, rate), d, 12, rng)
            assert (np.add.reduceat(sizes, np.cumsum(t) - t) == c).all() and sizes.min() > 0
        law = stirling(c, d)
        weight = np.array([law.get(k, 0.0) * rate**k for k in range(1, c + 1)])
        assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - weight / weight.sum()).max() < 0.025
    t, sizes = language_model.start_seating(np.array([1, 50, 7, 1000]), np.array([0.1, 5.0, 1e-9, 40.0]), 0.5, rng)
    assert (np.add.reduceat(sizes, np.cumsum(t) - t) == [1, 50, 7, 1000]).all() and sizes.min() > 0 and t[2] == 1 and t[3] > 50
    after, sizes = language_model.follow(np.array([3, 20, 0, 1500]), t, sizes, rng)
    assert np.bincount(np.repeat(np.arange(4), after), sizes, 4).tolist() == [3, 20, 0, 1500] and sizes.min() > 0


def test_a_round_seats_every_customer():
    """Dishes of many customers follow the exact law after one round, wherever they have been: all their customers move."""
    n, pack = 1500, language_model.pack
    for c, d in ((60, 0.6), (900, 0.5)):
        pairs = pd.DataFrame({"g": [0], "one": [pack(np.full(n, n, np.int32))], "two": [pack(np.arange(n, dtype=np.int32))], "three": [pack(np.full(n, c))]})
        told = {"p0": np.full(n + 1, 0.01, np.float32), "cc": np.full(n + 1, c * n), "tc": np.full(n + 1, 400), "c": np.full(n + 1, c)}
        answers = pd.DataFrame({"g": [0], "b": [0]} | {k: [pack(x)] for k, x in told.items()})
        rate = (1 + d * 400) * 0.01
        row = np.array([1.0])  # weights of t tables, scaled
        for k in range(c):
            row = np.r_[0.0, row] + np.r_[row * (k - d * np.arange(len(row))), 0.0]
            row /= row.sum()
        law = row * rate ** np.arange(c + 1.0)
        law /= law.sum()
        for t in (1, c):
            sizes = np.full(n, c) if t == 1 else np.ones(n * c, np.int64)
            seats = pd.DataFrame({"one": [pack(np.full(n, t))], "two": [pack(sizes if c <= language_model.MOVES else sizes[:0])]})
            made = language_model._round(pairs, answers, seats, d, [1, t])
            got = language_model.unpack(made[made["kind"] == "s"]["one"].iloc[0], np.int64)
            assert abs(np.bincount(got, minlength=c + 1) / n - law).max() < 0.05
            assert abs(got.mean() - law @ np.arange(c + 1)) < 0.3
    rng = np.random.default_rng(4)
    assert language_model.seat_whole(np.array([0, 1, 2, 10**7]), np.array([1.0, 1.0, 1e-12, 1e-9]), 0.5, rng).tolist() == [0, 1, 1, 1]
    parent = language_model.Parent(3, 700, 300, 0.5)
    at = pack(np.array([0, 1, 1], np.int32))
    words = pd.DataFrame([(0, *[pack(np.array([9, 9, 9]))] * 4, pack(np.array([2, 1, 5])), pack(np.array([4, 5, 9])), [0], [at])], columns=["b", "c", "c0", "cc", "tc", "t0", "sizes", "g", "at"])
    for c0 in ([9, 40, 0], [3, 600, 12]):  # words cross MOVES both ways
        told = pd.DataFrame({"g": [0], "one": [pack(np.array(c0))], "two": [pack(np.array([1, 1, 1]))]})
        if c0[0] == 9:
            words["sizes"] = [pack(np.array([4, 5, 9, 1, 2, 3, 2, 1]))]
        words = language_model._seat_words(words, told, parent, [1, 2])
        t0, sizes = (language_model.unpack(words[k].iloc[0], np.int64) for k in ("t0", "sizes"))
        few = np.array(c0) <= language_model.MOVES
        assert sizes.sum() == np.array(c0)[few].sum() and len(sizes) == t0[few].sum() and ((t0 > 0) == (np.array(c0) > 0)).all()


def plain_sampler(docs, held, samples, burn, seed):
    """Scores by a plain sampler that seats one customer at a time in explicit restaurants."""
    rng = np.random.default_rng(seed)
    cut = [[*t.split(), ""] for t in docs]
    pairs = Counter((u, w) for t, h in zip(cut, held, strict=True) if not h for u, w in zip(["<s>", *t], t, strict=False))
    vocabulary = len({w for _, w in pairs})
    low, high = ({}, {})  # restaurants: dish -> sizes of its tables

    def discount(counts):
        return language_model.discount_of(sum(n == 1 for n in counts), sum(n == 2 for n in counts))

    d1, d0 = discount(pairs.values()), discount(Counter(w for _, w in pairs).values())
    for (u, w), n in pairs.items():
        low.setdefault(u, {})[w] = [n]
    for _, w in pairs:
        high.setdefault(w, [0])[0] += 1

    def p0(w):
        own = high.get(w, [])
        tables = sum(map(len, high.values()))
        return (sum(own) - d0 * len(own) + (1 + d0 * tables) / (vocabulary + 1)) / (1 + sum(map(sum, high.values())))

    def leave(sizes):
        k = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    def sit(sizes, d, rate):
        weights = np.array([n - d for n in sizes] + [rate])
        k = rng.choice(len(weights), p=weights / weights.sum())
        if k == len(sizes):
            sizes.append(1)
            return True
        sizes[k] += 1
        return False

    def move(w):
        leave(high[w])
        sit(high[w], d0, (1 + d0 * sum(map(len, high.values()))) / (vocabulary + 1))

    total = np.zeros(len(docs))
    probability = [[0.0] * len(t) for t in cut]
    for n in range(burn + samples):
        for (u, w), c in pairs.items():
            for _ in range(c if c > 1 else 0):
                if leave(low[u][w]):
                    leave(high[w])
                if sit(low[u][w], d1, (1 + d1 * sum(map(len, low[u].values()))) * p0(w)):
                    sit(high.setdefault(w, []), d0, (1 + d0 * sum(map(len, high.values()))) / (vocabulary + 1))
        for w in list(high):
            move(w)
        if n >= burn:
            for i, t in enumerate(cut):
                for k, (u, w) in enumerate(zip(["<s>", *t], t, strict=False)):
                    own = low.get(u, {})
                    tables, customers = sum(map(len, own.values())), sum(map(sum, own.values()))
                    mine = own.get(w, [])
                    probability[i][k] += (sum(mine) - d1 * len(mine) + (1 + d1 * tables) * p0(w)) / (1 + customers) / samples
    for i, p in enumerate(probability):
        total[i] = sum(map(math.log10, p))
    return total


def test_scores_equal_a_plain_sampler(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BURN_IN", 8)
    monkeypatch.setattr(language_model, "SAMPLES", 8)
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(15)]
    shares = np.arange(1, 16.0) ** -1.2
    docs = [" ".join(rng.choice(words, rng.integers(3, 12), p=shares / shares.sum())) for _ in range(40)] + ["w1 neu w2"]
    held = [i % 5 == 4 or i == 40 for i in range(41)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in language_model.score_documents(table, "doc_id", (table["doc_id"] % 5 == 4) | (table["doc_id"] == 40)).collect()}
    want = plain_sampler(docs, held, 30, 10, 14)
    gap = np.array([got[i] - want[i] for i in range(41)])
    lengths = np.array([len(t.split()) + 1 for t in docs])
    assert np.abs(gap / lengths).max() < 0.05 and abs(gap.sum() / lengths.sum()) < 0.01


def test_repeated_documents_score_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("length(text) > 200").dropDuplicates(["text"]).limit(400)
    twice = docs.union(docs.where("doc_id % 10 = 3").selectExpr("doc_id + 100000", "text"))
    rows = language_model.score_documents(twice, "doc_id", twice["doc_id"] < 0).collect()
    again = {r["doc_id"] - 100000 for r in rows if r["doc_id"] >= 100000}
    one, two = ([r["score"] / r["n_tokens"] for r in rows if r["doc_id"] < 100000 and (r["doc_id"] in again) == x] for x in (False, True))
    assert np.mean(np.array(two)[:, None] > np.array(one)[None]) > 0.8


BIG = 2**53


def test_long_ids_beside_nulls(spark):
    """Ids beyond 2^53 in one batch with a null id come back as they are."""
    texts = ["one two three four", "eins zwei drei", "uno dos tres"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in zip((BIG + 1, None, BIG + 3), texts, strict=True)], "doc_id long, text string, lang string, source string").coalesce(1)
    labels = spark.createDataFrame([(BIG + 1, 1, 1), (BIG + 3, 0, 0)], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([(1, "nothing")], "item_id long, text string")
    frames = [
        decontaminate.contamination_report(docs, bench), decontaminate.decontaminate(docs, bench), bpe.token_digests(docs, vocabulary_path()), bpe.encode_documents(docs, vocabulary_path()),
        language_model.language_model_report(docs), toxicity.toxicity_report(docs, labels), quality.quality_report(docs, labels), simhash.near_duplicate_report(docs), near_copies.keep_one(docs),
    ]
    for frame in frames:
        assert {r["doc_id"] for r in frame.collect()} == {BIG + 1, None, BIG + 3}
    evidence = [e["doc_id"] for r in toxicity.score_documents(docs, labels).collect() for e in r["evidence"]]
    assert set(evidence) <= {BIG + 1, BIG + 3}


def test_clashing_names_are_kept(spark):
    docs = spark.createDataFrame([(i, f"some plain words {i} here", "en", "s", 9, "own", 1.5, "e", True, 4, 3) for i in range(30)], "doc_id long, text string, lang string, source string, n_words int, hits string, score double, evidence string, kept boolean, at int, predicted int")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(30)], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([(1, "nothing")], "item_id long, text string")
    for frame in (decontaminate.decontaminate(docs, bench), near_copies.keep_one(docs), toxicity.without_toxic(docs, labels)):
        assert frame.columns == docs.columns
        for r in frame.collect():
            assert (r["n_words"], r["hits"], r["score"], r["evidence"], r["kept"], r["at"], r["predicted"]) == (9, "own", 1.5, "e", True, 4, 3)
    assert set(docs.columns) <= set(toxicity.score_documents(docs, labels).columns) | {"text"}
