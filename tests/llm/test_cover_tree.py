"""Operator 8 against brute force, and the pipeline's stages."""

import numpy as np
import pytest

from tokenloom.llm import cover_tree


def plain(ids, vectors, cosine):
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    width = max([len(v) for v, u in zip(vectors, usable, strict=True) if u], default=1)
    x = np.zeros((len(ids), width))
    for i, v in enumerate(vectors):
        if usable[i]:
            x[i, : len(v)] = np.array(v, float) / np.linalg.norm(v)
    near = (x @ x.T >= cosine) & np.outer(usable, usable)
    np.fill_diagonal(near, False)
    reach = np.linalg.matrix_power((near | np.eye(len(ids), dtype=bool)).astype(float), 64) > 0
    return [(ids[i], int(near[i].sum()), min(ids[j] for j in np.flatnonzero(reach[i])), ids[i] == min(ids[j] for j in np.flatnonzero(reach[i]))) for i in range(len(ids))]


@pytest.mark.parametrize("block,nodes", [(2048, 64), (16, 5)])
@pytest.mark.parametrize("kind", ["clusters", "sphere"])
def test_equals_brute_force(spark, monkeypatch, block, nodes, kind):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "FAN", nodes)
    rng = np.random.default_rng(9)
    if kind == "clusters":
        centres = rng.normal(size=(8, 6))
        rows = [(centres[rng.integers(8)] * rng.uniform(0.1, 9) + rng.normal(size=6) * 0.12).tolist() for _ in range(90)]
    else:
        rows = rng.normal(size=(90, 3)).tolist()
    rows += [rows[0]] * 30 + [None, [], [0.0] * 6, [1.0, None, 2.0], [float("nan")] * 6, [float("inf"), 1.0], rows[1][:2], [1e200, 1e200], [1.0, 1.0, 0.0], [-0.0, 3.0], [0.0, 3.0]]
    ids = [int(i) for i in rng.permutation(len(rows))]
    table = spark.createDataFrame([(i, v, "c", 1) for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>, kept string, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.embedding_report(table).collect())
    assert got == sorted(plain(ids, [[1.0, 1.0] if v == [1e200, 1e200] else v for v in rows], 0.95))
    assert cover_tree.embedding_report(table.limit(0)).count() == 0


def test_null_ids_and_extra_columns(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.01], 2), (None, None, 3)], "vec_id long, embedding array<float>, n_links int")
    got = cover_tree.near_duplicates(table.withColumnRenamed("n_links", "label"))
    assert got.columns == ["vec_id", "embedding", "label", "n_links", "component_id", "kept"]
    assert {(r["label"], r["n_links"], r["component_id"]) for r in got.collect()} == {(1, 1, 4), (2, 1, 4), (3, 0, None)}


def test_long_ids_beside_nulls_and_reserved_names(spark):
    big = 2**53
    rows = [(big + 1, [1.0, 0.0], 7, 1), (None, [0.0, 1.0], 8, 2), (big + 3, [1.0, 0.001], 9, 3), (big + 5, [-1.0, 0.0], 1, 4), (big + 6, None, 1, 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, least long, node long")
    got = cover_tree.near_duplicates(table)
    assert got.columns == ["vec_id", "embedding", "least", "node", "n_links", "component_id", "kept"]
    assert {(r["vec_id"], r["least"], r["node"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == {
        (big + 1, 7, 1, 1, big + 1, True), (None, 8, 2, 0, None, False), (big + 3, 9, 3, 1, big + 1, False), (big + 5, 1, 4, 0, big + 5, True), (big + 6, 1, 5, 0, big + 6, True)
    }


def test_work_follows_the_input(spark, monkeypatch):
    """Vectors in tight groups: those that travel to comparisons grow in proportion to their number."""
    monkeypatch.setattr(cover_tree, "BLOCK", 64)
    monkeypatch.setattr(cover_tree, "SAMPLE", 64)
    shipped = []
    plain_pairs = cover_tree.near_pairs
    acc = spark.sparkContext.accumulator(0)

    def counted(x, y, cosine, same):
        acc.add(len(x) if same else len(x) + len(y))
        return plain_pairs(x, y, cosine, same)

    monkeypatch.setattr(cover_tree, "near_pairs", counted)
    rng = np.random.default_rng(4)
    for n in (400, 1600):
        centres = rng.normal(size=(n // 10, 32))
        rows = np.repeat(centres, 10, axis=0) + rng.normal(size=(n, 32)) * 0.02
        table = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
        before = acc.value
        got = cover_tree.embedding_report(table).collect()
        shipped.append(acc.value - before)
        assert all(r["n_links"] >= 9 and r["component_id"] // 10 == r["vec_id"] // 10 for r in got)
    assert shipped[1] < 6 * shipped[0] and shipped[0] <= 4 * 400


def test_tree_levels():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.CoverTree(x, 0.08)
    radius = 2.0
    for level in range(1, len(tree.sizes)):
        radius /= 2
        own = tree.centres[: tree.sizes[level]]
        gap = np.linalg.norm(own[:, None] - own[None], axis=2)
        np.fill_diagonal(gap, 9)
        assert gap.min() > radius - 1e-3  # centres keep apart
        assert (np.linalg.norm(own - tree.centres[tree.up[level]], axis=1) <= 2 * radius + 1e-3).all()
    assert (np.linalg.norm(x - tree.centres[tree.leaf], axis=1) <= tree.cover[-1][tree.leaf]).all()
    assert max(tree.cover[-1]) <= 0.08
    near, other = tree.near(tree, 0.1)
    assert set(tree.leaf) <= set(near) and set(tree.leaf) <= set(other)
