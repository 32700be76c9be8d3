"""The pipeline's stages against plain versions, each on its own input, and on odd rows."""

import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tokenloom.llm import near_copies, quality, toxicity
from tokenloom.llm.common import materialise, table
from tokenloom.llm.queries import vocabulary_path

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_clean(text, windows, short):
    """The text without its hit words, or None if they are more than half."""
    found = list(WORD.finditer(low(text)))
    words = [m[0] for m in found]
    hit = set()
    for at in range(len(words)):
        if tuple(words[at : at + 10]) in windows:
            hit |= set(range(at, at + 10))
        for s in short:
            if tuple(words[at : at + len(s)]) == s:
                hit |= set(range(at, at + len(s)))
    if 2 * len(hit) > len(words):
        return None
    out, last, at = "", 0, 0
    while at < len(words):
        if at in hit:
            end = at
            while end + 1 in hit:
                end += 1
            out += text[last : found[at].start()]
            last, at = found[end].end(), end
        at += 1
    return out + (text or "")[last:] if hit else text


def plain_shingles(text):
    words = low(text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_leaders(ids, texts, similarity=0.8):
    """Least ids of the groups that five-word Jaccard similarities of all pairs make."""
    sets = [plain_shingles(t) for t in texts]
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return sorted(min(g) for g in groups.values())


def test_near_copies_against_all_pairs(spark):
    """Nearly every pair of similarity 0.8 or more is found, none below it, long runs of one block too."""
    rng = np.random.default_rng(15)
    words = [f"w{i}" for i in range(3000)]
    texts, base = [], [list(rng.choice(words, 120)) for _ in range(60)]
    for b in base:
        for changes in (0, 1, 1, 2, 4, 9):
            t = list(b)
            for at in rng.choice(len(t), changes, replace=False):
                t[at] = str(rng.choice(words))
            texts.append(" ".join(t))
    hot = list(rng.choice(words, 200))
    for _ in range(120):
        t = list(hot)
        t[rng.integers(200)] = str(rng.choice(words))
        texts.append(" ".join(t))
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(order, texts, strict=True)], "doc_id long, text string")
    got = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    want = set(plain_leaders(order.tolist(), texts))
    gone = len(texts) - len(want)
    assert len(got) >= len(want) and len(texts) - len(got) >= 0.97 * gone
    assert len({r["doc_id"] for r in near_copies.keep_one(docs.where("doc_id < 0")).collect()}) == 0


def test_pairs_near_the_similarity(spark):
    """Of isolated pairs of similarity 0.80 to 0.85 at least 0.93 are found, of those of 0.70 to 0.80 none."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5000)]
    texts, want, below = [], 0, 0
    while want < 250 or below < 60:
        one = list(rng.choice(words, 200))
        two = list(one)
        for at in rng.choice(200, 4 if want < 250 else 7, replace=False):
            two[at] = "changed"
        x, y = plain_shingles(" ".join(one)), plain_shingles(" ".join(two))
        s = len(x & y) / len(x | y)
        if not (0.8 <= s <= 0.85 and want < 250 or 0.7 <= s < 0.8 and below < 60):
            continue
        want, below = want + (s >= 0.8), below + (s < 0.8)
        texts += [(len(texts), " ".join(one), s), (len(texts) + 1, " ".join(two), s)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, s double")
    got = near_copies.keep_one(docs).selectExpr("s >= 0.8 AS near").groupBy("near").count().collect()
    left = {r["near"]: r["count"] for r in got}
    assert 2 * want - left[True] >= 0.93 * want
    assert left[False] == 2 * below


def test_chain_and_hot_family(spark):
    """A large family whose members lie about the similarity, beside loose ones that share its blocks, loses next to no group."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(5000)]
    base, texts = list(rng.choice(words, 150)), []
    for n in range(300):
        t = list(base)
        for at in rng.choice(150, 1 + n % 4, replace=False):
            t[at] = str(rng.choice(words))
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    want = set(plain_leaders(list(range(len(texts))), texts))
    assert want <= got and len(got) - len(want) <= 0.02 * len(texts)


def test_pigeonhole_keys_promise_three_bits():
    """SimHashes that differ in three bits or fewer share a key; those of unrelated texts share none; bits follow the similarity."""
    rng = np.random.default_rng(21)
    for _ in range(200):
        x = rng.integers(0, 1 << 63, dtype=np.uint64)
        y = x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64))
        z = rng.integers(0, 1 << 63, dtype=np.uint64)
        keys = [set(near_copies.pigeonhole_keys(k).tolist()) for k in (x, y, z)]
        assert keys[0] & keys[1] and not keys[0] & keys[2] and len(keys[0]) == 20
    words = [f"w{i}" for i in range(5000)]
    apart = []
    for _ in range(100):
        one = list(rng.choice(words, 200))
        two = [*one[:180], *rng.choice(words, 20)]  # 176 of 216 shingles are shared: 0.815
        apart.append(int(np.bitwise_count(near_copies.simhash_words(near_copies.shingle_hashes(" ".join(one))) ^ near_copies.simhash_words(near_copies.shingle_hashes(" ".join(two)))).sum()))
        assert set(near_copies.pigeonhole_keys(near_copies.simhash_words(near_copies.shingle_hashes(" ".join(one)))[0]).tolist()) <= {k % 2**64 for k in near_copies.fingerprint(" ".join(one))[1]}
    assert 15 < np.mean(apart) < 22 and max(apart) <= near_copies.SIMHASH_BITS


def test_each_stage(spark):
    docs = table(spark, FOLDER, "documents").cache()
    columns = docs.columns
    labels = table(spark, FOLDER, "labels")
    kept = materialise(corpus_pipeline.quality_stage(spark, docs, FOLDER))
    want = {r["doc_id"] for r in quality.score_documents(docs, labels).collect() if r["score"] >= 0.5}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == columns
    civil = materialise(corpus_pipeline.toxicity_stage(spark, kept, FOLDER))
    assert {r["doc_id"] for r in civil.collect()} == {r["doc_id"] for r in toxicity.score_documents(kept, labels).collect() if r["score"] < 0.7}
    one = materialise(corpus_pipeline.near_duplicate_stage(spark, civil, FOLDER))
    rows = civil.collect()
    ids = [r["doc_id"] for r in rows]
    assert sorted(r["doc_id"] for r in one.collect()) == plain_leaders(ids, [r["text"] for r in rows])
    clean = materialise(corpus_pipeline.decontamination_stage(spark, one, FOLDER))
    items = [WORD.findall(low(r["text"])) for r in table(spark, FOLDER, "benchmark").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    short = {tuple(w) for w in items if 0 < len(w) < 10}
    told = {r["doc_id"]: plain_clean(r["text"], windows, short) for r in one.collect()}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {k: v for k, v in told.items() if v is not None}
    library = Tokenizer.from_file(vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in whole} == set(texts)
    for r in whole[:60]:
        assert r["token_ids"] == library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids


def test_one_row_of_each_group(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, 1), (3, text.upper(), 2), (3, text.upper(), 3), (None, text, 4), (None, "quite another text of its own", 5), (None, "quite another text of its own", 6), (7, None, 7), (8, "", 8), (9, "x " * 50000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, text.upper()), (None, rows[4][1]), (7, None), (9, "x " * 50000)], key=str)
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_stages_take_empty_and_odd_tables(spark):
    docs = table(spark, FOLDER, "documents")
    odd = docs.limit(20).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0)], docs.schema))
    for rows in (docs.limit(0), odd):
        now = rows
        for _, stage in corpus_pipeline.STAGES:
            now = materialise(stage(spark, now, FOLDER))
        assert now.count() <= rows.count()


def test_clashing_names(spark):
    """Columns that have the names of results or of inner columns come back as they were."""
    names = ["score", "Kept", "evidence", "predicted", "_own0_score", "_own_score", "_host", "_path", "_n", "_good", "_host_posterior", "host_posterior"]
    docs, labels = table(spark, FOLDER, "documents").limit(60), table(spark, FOLDER, "labels")
    wide = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    for stage, plain in ((quality.without_poor, quality.score_documents(docs, labels).where("kept")), (toxicity.without_toxic, toxicity.score_documents(docs, labels).where("predicted = 0"))):
        got = stage(wide, labels)
        assert got.columns == wide.columns
        rows = got.collect()
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in plain.collect()}
    assert quality.score_documents(wide, labels).select("_host", "_good").first()["_good"].startswith("_good")


def test_last_stage_decodes(spark):
    docs = table(spark, FOLDER, "documents").limit(30)
    library = Tokenizer.from_file(vocabulary_path())
    for r in corpus_pipeline.encoding_stage(spark, docs, FOLDER).collect():
        assert r["decoded"] == library.decode(r["token_ids"], skip_special_tokens=False)
