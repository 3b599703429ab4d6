"""Exact near-duplicate vectors by a dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, connected_components, keep

#: Vectors of a leaf block at most (give or take the spread of a hash): the unit of work, and of memory.
BLOCK = 2048
#: Rows from which the centres at the top of the trees are drawn. They only shape the tree: covering radii are measured on all rows.
CENTRE_ROWS = 4096
_SLACK = 1e-9


def net(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy cover: indices of centres more than `radius` apart, and for each point its centre's place among them."""
    owner, centres = np.full(len(points), -1), []
    for i in range(len(points)):
        if owner[i] < 0:
            near = np.flatnonzero((owner < 0) & (_distance(points, points[i : i + 1])[:, 0] <= radius))
            owner[near] = len(centres)
            owner[i] = len(centres)
            centres.append(i)
    return np.array(centres, np.int64), owner


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _nearest_first(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """net() of points whose pairs within the radius are known."""
    owner, centres = np.full(len(near), -1), []
    for i in range(len(near)):
        if owner[i] < 0:
            owner[near[i] & (owner < 0)] = len(centres)
            centres.append(i)
    return np.array(centres, np.int64), owner


class Tree:
    """Nested levels with halving radii over unit vectors: each level's nodes are points, each covers its children.

    levels[i] = (points, parent place in the level above, covering radius of all that lies below). Radii go down from one
    at which a single node covers all to `smallest`, each half of the one above; the leaves are the points. No level is
    left out, whatever the points.
    """

    def __init__(self, x: np.ndarray, smallest: float):
        n = len(x)
        chain, radius = [], smallest
        points, apart = np.arange(n), _distance(x, x)
        np.fill_diagonal(apart, 0.0)
        while len(points) > 1:
            centres, owner = _nearest_first(apart <= radius)
            chain.append((points, owner))
            points, apart = points[centres], apart[np.ix_(centres, centres)]
            radius *= 2
        chain.append((points, np.zeros(len(points), np.int64)))
        self.levels = []
        for points, owner in chain:
            self.levels.append([points, owner, None])
        at = np.arange(n)
        for i, (points, owner) in enumerate(chain):
            cover = np.zeros(len(points))
            np.maximum.at(cover, at, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x, x[points[at]]))))
            self.levels[i][2] = cover
            at = owner[at]
        self.levels.reverse()


def dual_traversal(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of x, j of y) whose cosine reaches the threshold; for same, of one set, i < j.

    Both trees are descended together. A pair of nodes survives if the distance of its points may still come down to
    the threshold within both covering radii; children of pairs that don't survive are never looked at.
    """
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    a = Tree(x, reach)
    b = a if same else Tree(y, reach)
    alive = np.ones((1, 1), bool)
    for level in range(max(len(a.levels), len(b.levels))):
        pa, ua, ra = a.levels[min(level, len(a.levels) - 1)]
        pb, ub, rb = b.levels[min(level, len(b.levels) - 1)]
        if level == 0:
            alive = np.ones((len(pa), len(pb)), bool)
        else:
            if level < len(a.levels):
                alive = alive[ua]
            if level < len(b.levels):
                alive = alive[:, ub]
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows) or not len(cols):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, other = np.zeros_like(alive), y[pb[cols]]
        for k in range(0, len(rows), 512):
            at = np.ix_(rows[k : k + 512], cols)
            left[at] = alive[at] & (_distance(x[pa[rows[k : k + 512]]], other) <= ra[rows[k : k + 512]][:, None] + rb[cols][None, :] + reach + _SLACK)
        alive = left
    pa, pb = a.levels[-1][0], b.levels[-1][0]
    i, j = np.nonzero(alive)
    i, j = pa[i], pb[j]
    if same:
        i, j = i[i < j], j[i < j]
    hit = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
    return i[hit], j[hit]


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index linked to each, by repeated halving of paths."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(vectors: DataFrame, cosine: float = 0.98, block: int = BLOCK, centre_rows: int = CENTRE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Vectors -> (vec_id, n_links, component_id, kept): links are pairs of equal label with cosine >= threshold, in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
    nothing. Vectors of different length never link. Equal vectors of a label are one node with a count. Repeated ids
    are vectors of their own that share the id. Further columns are ignored.

    Tree: above the blocks, labels with many rows have centres drawn from at most centre_rows rows; a row belongs to
    its nearest centre, and cells larger than a block are dealt into several by hash. Each block has its measured
    covering radius. Block pairs of a label survive if their centres may be close enough; every surviving pair is a
    task of bounded size in which the trees below are traversed together. Tasks give, for each vector, the number of
    links and one edge to the smallest vector it is linked with there, never pairs.
    """
    spark, scratch = vectors.sparkSession, Scratch()
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite)
    good = F.coalesce(usable & (largest > 0), F.lit(False))
    nodes, _ = keep(raw.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))

    counts = nodes.groupBy("label").agg(F.count("*").alias("rows"))
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(centre_rows)
    top: dict = {}
    for label, rows, vs in drawn.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("node", "v"))).alias("vs")).join(counts, "label").select("label", "rows", "vs").collect():
        want = min(len(vs), -(-rows // block))
        by_length: dict[int, list] = {}
        for x in vs:
            by_length.setdefault(len(x["v"]), []).append(x["v"])
        for length, own in by_length.items():
            unit = np.stack([_unit(x) for x in own])
            radius = 2.0
            while True:
                centres, _ = net(unit, radius)
                if len(centres) >= want or radius < 0.3:
                    break
                radius /= 2
            top[label, length] = unit[centres[:want]]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            unit = [_unit(v) for v in pdf.v]
            cell, far = np.zeros(len(pdf), np.int64), np.full(len(pdf), 2.0)
            for key, at in pd.Series(range(len(pdf))).groupby([pdf.label.to_numpy(), np.array([len(v) for v in unit])]).indices.items():
                if (c := top.get((key[0], key[1]))) is not None:
                    d = _distance(np.stack([unit[i] for i in at]), c)
                    cell[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pd.DataFrame({"label": pdf.label, "len": [len(v) for v in unit], "cell": cell, "far": far, "node": pdf.node, "n": pdf.n, "u": unit})

    kind = nodes.schema["label"].dataType.simpleString()
    placed = scratch(nodes.mapInPandas(assign, f"label {kind}, len long, cell long, far double, node long, n long, u array<double>"))
    cells = placed.groupBy("label", "len", "cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius"))
    blocks = cells.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / block) - 1)))
    blocks = scratch(blocks.withColumn("block", F.xxhash64("label", "len", "cell", "part")))
    centre = spark.createDataFrame([(k[0], k[1], i, c.tolist()) for k, cs in top.items() for i, c in enumerate(cs)], f"label {kind}, len long, cell long, c array<double>")
    blocks = blocks.join(centre, ["label", "len", "cell"], "left")
    left = blocks.select("label", "len", F.col("block").alias("a"), F.col("radius").alias("ra"), F.col("c").alias("ca"), F.struct("cell", "part").alias("ka"))
    right = blocks.select("label", "len", F.col("block").alias("b"), F.col("radius").alias("rb"), F.col("c").alias("cb"), F.struct("cell", "part").alias("kb"))
    dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot))
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    pairs = left.join(right, ["label", "len"]).where("ka <= kb").where(F.coalesce(apart <= F.col("ra") + F.col("rb") + reach + _SLACK, F.lit(True)))
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    width = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rows") / block))
    members = placed.join(cells.drop("radius"), ["label", "len", "cell"]).select(F.xxhash64("label", "len", "cell", F.pmod(F.xxhash64("node"), width)).alias("block"), "node", "n", "u")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = key
        pdf = pdf.sort_values("node", kind="stable")
        one, two = pdf[pdf.block == a], pdf[pdf.block == b]
        x = np.stack(one.u.to_numpy()) if len(one) else np.zeros((0, 1))
        y = x if a == b else np.stack(two.u.to_numpy()) if len(two) else np.zeros((0, 1))
        if not len(x) or not len(y):
            return pd.DataFrame({"node": [], "links": [], "low": []}).astype("int64")
        i, j = dual_traversal(x, y, cosine, a == b)
        ids, n = (one.node.to_numpy(), one.n.to_numpy()) if a == b else (np.concatenate([one.node, two.node]), np.concatenate([one.n, two.n]))
        j = j if a == b else j + len(x)
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        links = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        low = ids[order][_local_roots(len(ids), place[i], place[j])][place]
        at = np.flatnonzero(links)
        return pd.DataFrame({"node": ids[at], "links": links[at].astype(np.int64), "low": low[at]})

    found = scratch(members.join(ends, "block").groupBy("a", "b").applyInPandas(compare, "node long, links long, low long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    per_node = nodes.join(links, "node", "left").join(classes, "node", "left").select("label", "v", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    per_node = per_node.select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.col("links") + F.col("n") - 1).alias("n_links"), F.col("component").alias("component_id"))
    per_node, _ = keep(per_node)
    scratch.clear()
    rows = raw.withColumn("label", F.when(good, F.col("label"))).withColumn("v", F.when(good, F.col("v")))
    done = rows.join(per_node, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    done = done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _unit(v) -> np.ndarray:
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)
