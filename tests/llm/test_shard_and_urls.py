"""Operators 1 and 4: invariants, the law of the drawn matrix, rules against brute force, held-out urls."""

import re
import zlib
from collections import Counter

import numpy as np

from tokenloom.llm import shard, url_filter
from tokenloom.llm.common import materialise


def test_every_row_once_in_even_gapless_shards(spark, monkeypatch):
    monkeypatch.setattr(shard, "BLOCK_ROWS", 7)
    texts = ["same text"] * 40 + [f"text {i} ä" for i in range(57)] + ["", None, "x" * 5000]
    rows = [(None if i == 3 else i // 2, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, other int")
    got = shard.sharding_report(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert {r["law"] for r in got} == {"rows"} and all(r["grown_shard"] is None for r in got)
    again = shard.assign_shards(docs, 3)
    assert again.columns == ["doc_id", "text", "other", "shard", "slot"] and again.count() == len(rows)


def test_matrix_is_hypergeometric():
    counts = np.array([30, 0, 50, 20])
    drawn = np.array([shard.communication_matrix(counts, 4, s) for s in range(3000)])
    assert (drawn.sum(axis=2) == counts).all() and (drawn.sum(axis=1) == shard.shard_sizes(100, 4)).all()
    mean = counts[:, None] * 25 / 100  # numpy's own sampler draws from the same law
    variance = mean * (1 - 25 / 100) * (100 - counts[:, None]) / 99
    assert np.abs(drawn.mean(axis=0) - mean).max() < 0.2
    assert np.abs(drawn.var(axis=0) - variance).max() < 0.5


def test_uniform_places(spark):
    rows = spark.range(64).withColumnRenamed("id", "doc_id")
    seen = Counter()
    for seed in range(12):
        seen.update((r["doc_id"] < 32, r["shard"]) for r in shard.assign_shards(rows, 2, seed).collect())
    assert abs(seen[True, 0] - 192) < 60  # 384 draws of one half


def test_small_tables(spark):
    assert shard.sharding_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r["slot"] for r in shard.sharding_report(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [0]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r[1].split("/", 1)[0] or host.endswith("." + r[1].split("/", 1)[0])) and path.startswith("/" + r[1].split("/", 1)[1])]
    best = max(fits, key=lambda r: len(r[1]), default=(None, None))
    return best[1], best[0]


URLS = [
    "http://a.example.net/en/1", "http://a.example.net/fr/1", "http://EXAMPLE.NET/en/", "http://example.net/en", "http://xnet/", "http://net/x", "https://b.example.com/de/3?x=1&y=2#f", "https://example.com/DE/3",
    "ftp://Ä.org/fr/x", "http://org/fr/", "http://org?/fr/", "no scheme/en/", "", None, "a://b://c/d", "http://u:p@h.net:80/", "http://x.net", "http://long.example/" + "a" * 20000,
]


def test_hosts_paths_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash", None) for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, html string")
    got = {r["page_id"]: r for r in url_filter.url_report(pages).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate([*URLS, *URLS]):
        host, path = plain(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= url_filter.THRESHOLD else "allow"))
    assert url_filter.url_report(pages.limit(0)).count() == 0


def test_trees_find_bad_hosts_held_out(spark):
    rng = np.random.default_rng(1)
    good, bad = [f"site{i}.example.com" for i in range(30)], [f"cheap-{w}-{i}.example.com" for i, w in enumerate(["pills", "spam", "casino", "ads"] * 3)]
    urls = [(f"http://{h}/en/{rng.integers(9999)}{'?a=1&b=2' if b and rng.random() < 0.7 else ''}", b) for hosts, b in ((good, 0), (bad, 1)) for h in hosts for _ in range(20)]
    known = spark.createDataFrame([u for i, u in enumerate(urls) if i % 4], "url string, label int")
    asked = spark.createDataFrame([u for i, u in enumerate(urls) if not i % 4], "url string, truth int")
    got = url_filter.judge_urls(asked, known).collect()
    right = np.mean([(r["verdict"] == "block") == bool(r["truth"]) for r in got])
    assert len(got) == len(urls) // 4 and right > 0.95


def test_report_deals_texts(spark, monkeypatch):
    """The rows that go to shards hold all columns, and sizes and checksums are those of the texts in the shards."""
    dealt = []
    deal = shard.assign_shards

    def keep(rows, *args):
        dealt.append(materialise(deal(rows, *args)))
        return dealt[-1]

    monkeypatch.setattr(shard, "assign_shards", keep)
    docs = spark.createDataFrame([(i, f"Text {i} ä" * i if i % 7 else None, "de") for i in range(60)], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in shard.sharding_report(docs).collect()}
    rows = [(r["doc_id"], (r["text"] or "").encode(), r["lang"], r["shard"], r["slot"]) for r in dealt[0].collect()]
    assert got == {(i, len(t) + 1, zlib.crc32(t), s, n) for i, t, _, s, n in rows} and {x[2] for x in rows} == {"de"}


def test_large_counts_are_drawn():
    """Beyond 10^9 rows, too: sums hold and cells lie near their means."""
    counts = np.full(40, 250_000_000)
    drawn = shard.communication_matrix(counts, 16, 3)
    assert (drawn.sum(axis=1) == counts).all() and (drawn.sum(axis=0) == 625_000_000).all()
    spread = np.sqrt(250e6 * 1 / 16 * 15 / 16)
    assert np.abs((drawn - 250e6 / 16) / spread).max() < 5 and np.std((drawn - 250e6 / 16) / spread) > 0.8


def test_suffix_rates_leave_out_the_own_fold(spark):
    labelled = [("a.b.com", 0, 4, 4), ("a.b.com", 1, 2, 0), ("c.com", 1, 10, 1), ("d.org", 2, 5, 0)]
    sums = spark.createDataFrame(labelled, "host string, fold int, n long, bad long")
    asked = spark.createDataFrame([("a.b.com", 0), ("a.b.com", 1), ("new.com", 3), (None, 0)], "host string, fold int")
    s = url_filter.SHRINK
    for r in url_filter.suffix_rates(asked, sums).collect():
        rate = (5 + 0.5) / (21 + 1)
        for k, name in enumerate(url_filter.SUFFIXES, 1):
            own = [(n, b) for h, f, n, b in labelled if r["host"] and h.split(".")[-k:] == r["host"].split(".")[-k:] and f != r["fold"]]
            rate = (sum(b for _, b in own) + s * rate) / (sum(n for n, _ in own) + s)
            assert abs(r[name] - rate) < 1e-12


def test_lexical_features_equal_plain(spark):
    rows = spark.createDataFrame([(u,) for u in URLS if u is not None and len(u) < 1000], "url string")
    h, p = url_filter.host_of(rows["url"]), url_filter.path_of(rows["url"])
    for r in rows.select("url", *[c.alias(k) for k, c in url_filter.lexical_features(rows["url"], h, p).items()]).collect():
        host, path = plain(r["url"])
        n = max(1, len(r["url"]))
        query = re.search(r"\?([^#]*)", r["url"])
        want = {
            "length": len(r["url"]), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "digit_ratio": sum(c in "0123456789" for c in r["url"]) / n,
            "entropy": -sum(c / n * np.log(c / n) for c in Counter(r["url"]).values()), "parameters": len(query[1].split("&")) if query and query[1] else 0, "hyphens": host.count("-"), "labels": host.count(".") + 1,
        }
        assert all(abs(r[k] - v) < 1e-9 for k, v in want.items()), r


def test_extra_columns_and_hot_host(spark):
    """Names of inner columns may come as extra columns; a host of most pages is judged like the others, also without a broadcast."""
    rows = [(i, f"http://hot.example.com/{'de' if i % 3 else 'en'}/{i}", 1, "x", "s") for i in range(300)] + [(1000 + i, f"http://h{i}.example.org/en/{i}", 2, "y", "t") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, suffix1 int, fold string, s string")
    _, verdict = url_filter.rule_of(url_filter.host_of(pages["url"]), url_filter.path_of(pages["url"]), url_filter.RULES)
    labelled = pages.select("url", (verdict == "block").cast("int").alias("label")).na.fill(0)
    one = url_filter.judge_urls(pages, labelled)
    assert one.columns == [*pages.columns, "host", "path", "rule", "score", "verdict"]
    got = {tuple(r) for r in one.collect()}
    assert {x[:5] for x in got} == set(rows)


def test_rows_move_alike_at_every_size(spark):
    """The join that moves the rows has one form, so what a small table costs tells what a large one does."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        plan = shard.sharding_report(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"SortMergeJoin \[_shuffle_n", plan) and not re.search(r"BroadcastHashJoin \[_shuffle_n", plan)
