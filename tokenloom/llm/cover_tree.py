"""Embedding near-duplicates (operator 8): exact threshold pairs by a dual traversal of a cover tree.

 1. Usable vectors are scaled to length one; equal ones are folded, so copies are one point with a count.
 2. Upper levels, distributed: a node of more than BLOCK vectors is split. A bounded sample of it (SAMPLE, by a hash) gives
    child centres, the farthest vector next until the radius is halved or FAN is reached, and every vector goes to the
    nearest. Covering radii are the largest distances found over all vectors, so bounds hold whatever the
    sample was. This goes on until no node is too large; nodes and their radii are tables.
 3. Pairs of nodes are a table as well: it starts with the root and itself, and each level joins the children of both,
    dropping pairs whose centres are farther apart than both covering radii and the threshold together.
 4. Small nodes of one parent are packed into blocks. In a block a task builds the lower levels: nested centres that keep
    apart by radii halving down to a quarter of the threshold's chord.
 5. Two blocks that hold a pair of nodes left from step 3 send their trees, not their vectors, to a task that
    goes on with the traversal down to the lowest nodes. Vectors travel only for lowest nodes that are left; their
    products are taken in single precision, and what comes near the threshold is decided in double precision.
 6. A task returns link counts and a spanning forest of its links, never all pairs; components() joins the forests.

Cosine 0.95 is a chord of sqrt(2 - 2 * 0.95). Pruning is as good as the data are clustered: among directions that
fill a high-dimensional sphere all bounds of upper levels overlap, and then the trees of all blocks meet.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; shorter vectors are compared as if zeros followed; a row with null id takes part, component_id is the
least non-null id (null if none); repeated rows count as vectors of their own; an empty table gives no rows; extra
columns are kept by near_duplicates unless their names are those of the results or begin with _tree_.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import discard, materialise, pieces
from tokenloom.llm.components import components, forest

#: Vectors of a node that is split no further, children of a split, and the sample that chooses them.
BLOCK, FAN, SAMPLE = 2048, 64, 1024
#: Room for children's numbers in a node's, and levels that fit into a long.
STEP, MAX_DEPTH = 128, 8
#: Bytes of the centres of a level that may be broadcast.
MAX_BROADCAST = 64 << 20
TILE = 1024
#: Room for rounding in bounds and in single precision products.
SLACK = 1e-5
RESULTS = ["n_links", "component_id", "kept"]


def unit_rows(raw: list, width: int) -> np.ndarray:
    """Vectors of length one, zeros behind shorter ones."""
    out = np.zeros((len(raw), width))
    for n, v in enumerate(raw):
        out[n, : len(v)] = v
    if len(out):
        out /= np.abs(out).max(axis=1, keepdims=True)  # no overflow in the squares
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out


def farthest_first(x: np.ndarray, radius: float, most: int) -> tuple[list[int], float]:
    """Rows of x that keep apart by the radius, each the farthest from those before, and how far the rest is from them; at most so many."""
    order, gap = [0], 1 - x @ x[0]
    while len(order) < most and 2 * gap.max() > radius * radius:
        order.append(int(gap.argmax()))
        gap = np.minimum(gap, 1 - x @ x[order[-1]])
    return order, float(np.sqrt(max(0.0, 2 * gap.max())))


class CoverTree:
    """Lower levels of one block: centres[:sizes[l]] is level l, up[l][i] the centre of level l-1 that covers centre i of level l, cover[l][i] the largest distance to a vector below."""

    def __init__(self, x: np.ndarray, finest: float):
        gram = x.astype(np.float32) @ x.astype(np.float32).T
        order, self.sizes, self.up = [0], [1], [np.zeros(1, np.int64)]
        like, near = gram[0].copy(), np.zeros(len(x), np.int64)
        radius = 2.0
        while radius > finest:
            radius /= 2
            before = near.copy()
            while len(order) < len(x):
                new = int(like.argmin())
                if 2 - 2 * like[new] <= radius * radius:
                    break
                closer = gram[new] > like
                near[closer] = len(order)
                like = np.maximum(like, gram[new])
                like[new] = 4
                order.append(new)
            self.up.append(np.array([before[c] if k >= self.sizes[-1] else k for k, c in enumerate(order)], np.int64))
            self.sizes.append(len(order))
        near[order] = np.arange(len(order))
        self.centres, self.leaf = x[order].astype(np.float32), near
        self.cover, anc = [], near
        for level in range(len(self.sizes) - 1, -1, -1):
            far = np.zeros(self.sizes[level])
            np.maximum.at(far, anc, np.linalg.norm(x - x[order][anc], axis=1))
            self.cover.insert(0, far + SLACK)
            anc = self.up[level][anc]

        # levels that a traversal visits: those at least twice as large as the last one, and the lowest
        self.visited, last = [(0, self.up[0])], 0
        for level in range(1, len(self.sizes)):
            if self.sizes[level] >= 2 * self.sizes[last] or level == len(self.sizes) - 1:
                anc = np.arange(self.sizes[level])
                for below in range(level, last, -1):
                    anc = self.up[below][anc]
                self.visited.append((level, anc))
                last = level

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("centres", "cover", "visited")}

    def near(self, other: CoverTree, chord: float) -> tuple[np.ndarray, np.ndarray]:
        """Lowest nodes of this tree and of the other that have a partner there within the chord of both covering radii."""
        keep, mine, theirs = np.ones((1, 1), bool), list(self.visited), list(other.visited)
        for step in range(max(len(mine), len(theirs))):  # the shallower tree stays at its lowest level
            level, a = mine[step] if step < len(mine) else (mine[-1][0], np.arange(keep.shape[0]))
            beside, b = theirs[step] if step < len(theirs) else (theirs[-1][0], np.arange(keep.shape[1]))
            rows, columns = np.flatnonzero(keep.any(axis=1)[a]), np.flatnonzero(keep.any(axis=0)[b])
            at = np.zeros((len(a), len(b)), bool)
            for part in np.array_split(rows, max(1, len(rows) // TILE)):
                if len(part) and len(columns):
                    reach = self.cover[level][part].astype(np.float32)[:, None] + (other.cover[beside][columns] + chord + 1e-3).astype(np.float32)[None]
                    np.multiply(reach, reach, out=reach)
                    near = 2 - 2 * (self.centres[part] @ other.centres[columns].T) <= reach
                    at[np.ix_(part, columns)] = near & keep[np.ix_(a[part], b[columns])]
            keep = at
        return np.flatnonzero(keep.any(axis=1)), np.flatnonzero(keep.any(axis=0))


def _vectors(blobs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(-1, width)


def near_pairs(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y whose product reaches cosine; with same, y is x and each pair comes once."""
    left, right = [], []
    part = y.astype(np.float32).T.copy()
    for at in range(0, len(x), TILE):
        a, b = np.nonzero(x[at : at + TILE].astype(np.float32) @ part >= np.float32(cosine - SLACK))
        a = a + at
        if same:
            a, b = a[a < b], b[a < b]
        sure = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], y[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.empty(0)]) >= cosine
        left.append(a[sure])
        right.append(b[sure])
    empty = np.empty(0, np.int64)
    return np.concatenate([*left, empty]).astype(np.int64), np.concatenate([*right, empty]).astype(np.int64)


def near_duplicates(rows: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding", seed: int = 11) -> DataFrame:
    """rows with n_links, component_id and kept (key = component_id)."""
    spark = rows.sparkSession
    base = rows.drop(*RESULTS)
    v = F.transform(vector, lambda e: e.cast("double"))
    usable = F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    # a vector's identity: its text without signs of zero
    named = base.withColumn("_tree_v", F.when(usable, F.transform(v, lambda e: e + F.lit(0.0)))).withColumn("_tree_h", F.when(F.col("_tree_v").isNotNull(), F.sha2(F.to_json(F.struct("_tree_v")), 256)))
    slim = named.where("_tree_h is not null").select(F.col(key).cast("long").alias("id"), F.col("_tree_v").alias("v"), F.col("_tree_h").alias("h"))
    folded = materialise(slim.groupBy("h", "v").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("point", F.monotonically_increasing_id()))
    width = folded.agg(F.max(F.size("v"))).first()[0]
    kept = F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)).alias("kept")
    alone = named.where("_tree_h is null").select(*base.columns, F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id")).select("*", kept)
    if not width:
        return alone
    links = folded.select("point", F.col("h").alias("_tree_h")).join(_links(folded, width, cosine, seed), "point").select("_tree_h", F.col("links").alias("_tree_links"), F.col("least").alias("_tree_least"))
    out = named.where("_tree_h is not null").join(links, "_tree_h").select(*base.columns, F.col("_tree_links").cast("long").alias("n_links"), F.col("_tree_least").alias("component_id"))
    return out.select("*", kept).union(alone)


def _placed(folded: DataFrame, width: int) -> DataFrame:
    """point, n and x (unit vector, packed) of each folded vector, all in node 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2000):
            x = unit_rows(batch.column("v").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("n"), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), pa.array(np.zeros(len(x), np.int64))], names=["point", "n", "x", "node"])

    return folded.select("point", "n", "v").mapInArrow(run, "point long, n long, x binary, node long")


def _split(placed: DataFrame, big: DataFrame, width: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """placed with the vectors of the nodes in big (node, size) moved to children, and the children: node, parent, centre, radius, size."""

    def choose(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(pdf.sort_values("point")["x"], width)
        most = int(min(FAN, max(2, -(-4 * pdf["size"].iloc[0] // BLOCK))))
        order, _ = farthest_first(x, 0.0, most)
        whole = np.linalg.norm(x - x[0], axis=1).max() / 2
        apart, _ = farthest_first(x, whole, most)
        order = apart if len(apart) > 1 else order
        return pd.DataFrame({"node": [key[0]], "centres": [x[order].astype("<f8").tobytes()]})

    luck = F.pmod(F.xxhash64("point", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = placed.join(F.broadcast(big), "node").where(luck < F.lit(float(SAMPLE)) / F.col("size"))
    centres = materialise(sample.select("node", "size", "point", "x").groupBy("node").applyInPandas(choose, "node long, centres binary"))
    size = centres.agg(F.sum(F.octet_length("centres"))).first()[0] or 0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2000):
            node = batch.column("node").to_numpy().copy()
            x = _vectors(batch.column("x").to_pylist(), width)
            point = batch.column("point").to_numpy()
            blobs = batch.column("centres").to_pylist()
            distance = np.full(len(node), -1.0)
            child = np.zeros(len(node), np.int64)
            for own in np.unique(node):
                at = np.flatnonzero(node == own)
                if blobs[at[0]] is None:
                    continue
                c = _vectors([blobs[at[0]]], width)
                like = x[at] @ c.T
                pick = like.argmax(axis=1)
                if np.abs(c - c[0]).max() < 1e-7:  # no telling apart: dealt by their numbers
                    pick = point[at] % len(c)
                child[at] = pick + 1
                distance[at] = np.linalg.norm(x[at] - c[pick], axis=1)
            node = np.where(child > 0, node * STEP + child, node)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("point", "n", "x")], pa.array(node), pa.array(distance)], names=["point", "n", "x", "node", "distance"])

    joined = placed.join(F.broadcast(centres) if size <= MAX_BROADCAST else centres, "node", "left")
    moved = materialise(joined.select("point", "n", "x", "node", "centres").mapInArrow(assign, "point long, n long, x binary, node long, distance double"))
    radii = moved.where("distance >= 0").groupBy("node").agg(F.max("distance").alias("radius"), F.count("*").alias("size"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parent, blob in zip(batch.column("node").to_pylist(), batch.column("centres").to_pylist(), strict=True):
                c = _vectors([blob], width)
                yield pa.RecordBatch.from_arrays([pa.array(parent * STEP + 1 + np.arange(len(c))), pa.array(np.full(len(c), parent)), pa.array(c.tolist(), pa.list_(pa.float64()))], names=["node", "parent", "centre"])

    children = centres.mapInArrow(unpack, "node long, parent long, centre array<double>").join(radii, "node")
    return moved.drop("distance"), materialise(children)


def _tree_rows(pdf: pd.DataFrame, width: int, finest: float) -> pd.DataFrame:
    """One block: point, n, x and leaf of its vectors, and a row with the tree."""
    pdf = pdf.sort_values("point")
    tree = CoverTree(_vectors(pdf["x"], width), finest)
    out = pdf[["block", "point", "n", "x"]].assign(leaf=tree.leaf.astype(np.int32), tree=None)
    last = pd.DataFrame({"block": [pdf["block"].iloc[0]], "point": [-1], "n": [0], "x": [b""], "leaf": np.array([-1], np.int32), "tree": [pickle.dumps(tree)]})
    return pd.concat([out, last])


def _links(folded: DataFrame, width: int, cosine: float, seed: int) -> DataFrame:
    """point, links (rows linked with one row of this vector) and least (id of the component) of each folded vector."""
    spark = folded.sparkSession
    chord = float(np.sqrt(2 - 2 * cosine))
    placed = materialise(_placed(folded, width))
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for depth in range(MAX_DEPTH):
        sizes = placed.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
        if sizes.isEmpty():
            break
        before = placed
        placed, children = _split(placed, sizes, width, seed + depth)
        discard(before)
        kids = children.select("parent", "node", "centre", "radius")

        def side(name: str, kids=kids) -> DataFrame:
            return kids.select(F.col("parent").alias(name), F.col("node").alias(f"{name}_node"), F.col("centre").alias(f"{name}_centre"), F.col("radius").alias(f"{name}_radius"))

        # a node that was not split stands for itself; without a centre at hand its pairs stay
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        product = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * product))
        open_ = F.coalesce(far <= F.col("a_radius") + F.col("b_radius") + F.lit(chord + SLACK), F.lit(True))
        kept = both.where(open_).select(F.coalesce("a_node", "a").alias("a"), F.coalesce("b_node", "b").alias("b"))
        pairs = materialise(kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # nodes of one parent are packed into blocks of about BLOCK vectors
    sizes = placed.groupBy("node").agg(F.count("*").alias("size"))
    order = Window.partitionBy(F.expr(f"node div {STEP}")).orderBy("node")
    packed = sizes.withColumn("pack", F.floor((F.sum("size").over(order) - F.col("size")) / F.lit(BLOCK)))
    blocks = materialise(packed.withColumn("block", F.min("node").over(Window.partitionBy(F.expr(f"node div {STEP}"), "pack"))).select("node", "block"))
    meet = pairs.join(blocks.select(F.col("node").alias("a"), F.col("block").alias("x")), "a").join(blocks.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")
    meet = meet.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(blocks.select("block", "block")).distinct()
    built = materialise(placed.join(blocks, "node").select("block", "point", "n", "x").groupBy("block").applyInPandas(lambda pdf: _tree_rows(pdf, width, chord / 4), "block long, point long, n long, x binary, leaf int, tree binary"))
    discard(placed)
    trees = built.where("leaf < 0").select("block", "tree")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4):
            found = [pickle.loads(x).near(pickle.loads(y), chord) for x, y in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True)]
            leaves = [pa.array([f[i].tolist() for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *leaves], names=["a", "b", "la", "lb"])

    asked = meet.join(trees.select(F.col("block").alias("a"), F.col("tree").alias("one")), "a").join(trees.select(F.col("block").alias("b"), F.col("tree").alias("two")), "b")
    left = materialise(asked.select("a", "b", "one", "two").mapInArrow(traverse, "a long, b long, la array<int>, lb array<int>").where(F.size("la") > 0))
    wanted = left.select("a", "b", F.col("a").alias("block"), F.explode("la").alias("leaf")).union(left.where("a <> b").select("a", "b", F.col("b").alias("block"), F.explode("lb").alias("leaf")))
    dealt = built.where("leaf >= 0").select("block", "leaf", "point", "n", "x").join(wanted, ["block", "leaf"])

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = key
        pdf = pdf.sort_values("point")
        x, y = pdf[pdf["block"] == one], pdf[pdf["block"] == two]
        same = one == two
        a, b = near_pairs(_vectors(x["x"], width), _vectors(y["x"], width), cosine, same)
        points = np.r_[x["point"].to_numpy(), [] if same else y["point"].to_numpy()].astype(np.int64)
        counts = np.r_[x["n"].to_numpy(), [] if same else y["n"].to_numpy()].astype(np.int64)
        b = b if same else b + len(x)
        links = np.bincount(a, counts[b], len(points)) + np.bincount(b, counts[a], len(points)) if len(a) else np.zeros(len(points))
        label = forest(a, b, len(points))
        hit = np.flatnonzero(links)
        return pd.DataFrame({"point": points[hit], "links": links[hit].astype(np.int64), "to": points[label[hit]]})

    made = materialise(dealt.groupBy("a", "b").applyInPandas(compare, "point long, links long, to long"))
    linked = made.groupBy("point").agg(F.sum("links").alias("links"))
    joined = components(made.select(F.col("point").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "point")
    whole = folded.select("least", "n", "point").join(linked, "point", "left").join(joined, "point", "left").withColumn("component", F.coalesce("component", "point"))
    least = whole.groupBy("component").agg(F.min("least").alias("_least"))
    return whole.drop("least").join(least, "component").select("point", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.col("_least").alias("least"))


def embedding_report(rows: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    return near_duplicates(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), cosine)
