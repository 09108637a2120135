"""Embedding near-duplicates by dual traversal of cover trees.

The top of the tree is shared: vectors fall to the nearest of a bounded number of centres, which lie in the order of a cover tree of
their own; runs of neighbouring cells make blocks, and a pair of blocks whose cells' covering radii keep them apart is never sent. Inside a
block nested nets of halving radii (1, 1/2, 1/4, 1/8 on the unit sphere) go on: every node's centre is one of its vectors, and nodes are
runs of rows. A pair of nodes is dropped when its centres lie further apart than both covering radii and the threshold distance; it is taken whole when all
its vectors must link; else its children are compared, down to the vectors. Bounds are taken on single-precision products with a margin for
their rounding; what lies inside the margin is decided in double precision. Links are counted where they are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunespark.llm.common import discard, materialize
from tunespark.llm.components import connected_components

RADII = (1.0, 0.5, 0.25, 0.125)
#: Vectors and bytes of doubles in a block at most; blocks that a table of some size is cut into at least; rows that make one block at most.
BLOCK, BLOCK_BYTES, BLOCKS, SMALL = 32_768, 32 << 20, 8, 512
#: Shared centres, and bytes of them, at most; beyond that a cell holds several blocks.
MOST_CENTRES, CENTRE_BYTES = 4096, 16 << 20
#: Rows of a tile of products; children compared one by one at most, more by a product of their own.
TILE, FEW = 256, 1024
#: Nodes of a level by which the work of starting there is judged; products that opening one pair of nodes costs.
SOME, OPENING = 512, 40
#: Whole vectors are compared at once where heads leave more than one pair of nodes in so many open; pairs that are compared one by one at a time.
OPEN, MOST = 128, 1 << 16
#: A table of block pairs counted at no more rows than this (24 MB) is broadcast.
BROADCAST_PAIRS = 1_000_000


def unit(column: pa.Array | np.ndarray) -> np.ndarray:
    """Vectors at length 1 in double precision, scaled by their largest component first so that no square overflows."""
    x = column if isinstance(column, np.ndarray) else column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def margin(dims: int) -> float:
    """What a single-precision product of unit vectors can be off by."""
    return 1e-6 + 1.2e-7 * dims


def net(x: np.ndarray, radius: float) -> np.ndarray:
    """The row that covers each row: greedy centres further than radius apart, in the order of rows; the first row is a centre."""
    near = np.float32(1 - radius * radius / 2)
    owner, todo = np.zeros(len(x), np.int64), np.arange(len(x))
    while todo.size:
        some = todo[:TILE]
        before = np.tril(x[some] @ x[some].T >= near, -1)
        centre = ~before.any(1)
        for i in np.flatnonzero(~centre).tolist():
            centre[i] = not (before[i] & centre).any()
        centres = some[centre]
        product = x[todo] @ x[centres].T
        own = product.argmax(1)
        covered = product[np.arange(len(todo)), own] >= near
        covered |= todo == centres[own]
        owner[todo[covered]] = centres[own[covered]]
        todo = todo[~covered]
    return owner


def tree(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of the rows, and for each level the first place of each node in it; a node's centre is its first row."""
    groups, starts = [np.arange(len(x))], []
    for radius in RADII:
        made = []
        for rows in groups:
            if len(rows) == 1:
                made.append(rows)
                continue
            own = net(x[rows], radius)
            order = np.lexsort((own != np.arange(len(rows)), own))
            made += np.split(rows[order], np.flatnonzero(np.diff(own[order])) + 1)
        groups = made
        sizes = np.fromiter(map(len, groups), np.int64, len(groups))
        starts.append((np.cumsum(sizes) - sizes).astype(np.int32))
    return np.concatenate(groups), starts


def main_axes(x: np.ndarray) -> np.ndarray | None:
    """The directions, three for eight dimensions, that hold most of these unit vectors; none where a product of all dimensions is cheap or the directions are dear."""
    dims = x.shape[1]
    if not 32 <= dims <= 2048:
        return None
    return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, -(3 * dims // 8) :])


def head(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors along the axes, with the length of what is left as one more component: no product of two vectors is above that of their heads."""
    along = x @ axes
    rest = np.sqrt(np.maximum(0, 1 - (along * along).sum(1, keepdims=True)) + 1e-12)
    return np.hstack([along, rest]).astype(np.float32)


def hits(product: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the products that reach least, in order; eight are looked at at once, as hardly any do."""
    flat = (product >= np.float32(least)).ravel()
    n = len(flat) // 8 * 8
    some = (np.flatnonzero(flat[:n].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(np.concatenate([some[flat[some]], n + np.flatnonzero(flat[n:])]), product.shape[1])


class Tree:
    """A block's vectors in the order of their tree, with the nodes' first rows and covering radii by level; rows are the last level."""

    def __init__(self, x: np.ndarray, rep: np.ndarray, weight: np.ndarray, starts: list[np.ndarray], axes: np.ndarray | None = None):
        self.x, self.single, self.rep, self.weight = x, x.astype(np.float32), rep, weight
        self.head = None if axes is None else head(x, axes)
        n = len(x)
        self.first = [s.astype(np.int64) for s in starts] + [np.arange(n)]
        self.end = [np.append(s[1:], n) for s in self.first]
        self.radius = []
        for first, end in zip(self.first, self.end, strict=True):
            if len(first) == n:
                self.radius.append(np.zeros(n))
                continue
            gap = x - x[np.repeat(first, end - first)]
            self.radius.append(np.sqrt(np.maximum.reduceat((gap * gap).sum(1), first)) + 1e-9)
        #: where each node's children begin and end on the level below
        self.child = [(np.searchsorted(low, f), np.searchsorted(low, e)) for f, e, low in zip(self.first, self.end, self.first[1:], strict=False)]
        self.total = np.concatenate([[0], np.cumsum(weight)])

    def classes(self, level: int) -> list[np.ndarray]:
        """The nodes of a level by their radius: vectors by themselves first, then by halving radii."""
        edges = [1e-8, *reversed(RADII)]
        of = np.searchsorted(edges, self.radius[level])
        return [np.flatnonzero(of == k) for k in range(len(edges) + 1)]


def first_level(a: Tree, b: Tree, least, most) -> int:
    """The level to start from: where the products of all its pairs and what opening pairs from there on costs are least, judged by SOME nodes of either side.

    Wide nodes of vectors without structure stay open in nearly all pairs, and opening those costs far more than comparing all vectors at once.
    """
    pairs, opened = [], []
    for k in range(len(RADII) + 1):
        i, j = (np.linspace(0, len(t.first[k]) - 1, min(SOME, len(t.first[k]))).astype(np.int64) for t in (a, b))
        pairs.append(len(a.first[k]) * len(b.first[k]))
        if k == len(RADII):
            break
        product, radii = a.single[a.first[k][i]] @ b.single[b.first[k][j]].T, a.radius[k][i][:, None] + b.radius[k][j]
        open_ = (product >= least(radii)) & (product < most(radii))
        if a is b:
            np.fill_diagonal(open_, False)
        (na, nb) = (t.child[k][1][x] - t.child[k][0][x] for t, x in ((a, i), (b, j)))
        opened.append(pairs[k] * float(na @ open_ @ nb) / open_.size)
    return int(np.argmin([pairs[k] + OPENING * sum(opened[k:]) for k in range(len(pairs))]))


class Links:
    """Links of two blocks: how many each vector has, and the smallest id that it reaches by them."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.same = a, b, a is b
        self.shift = 0 if self.same else len(a.x)
        self.count = np.zeros(self.shift + len(b.x), np.int64)
        self.root = np.arange(len(self.count))

    def flatten(self) -> None:
        while ((up := self.root[self.root]) != self.root).any():
            self.root = up

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while i.size:
            self.flatten()
            x, y = self.root[i], self.root[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))

    def add(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        """All vectors of the nodes i of a link with all of the nodes j of b."""
        a, b = self.a, self.b
        fa, ea, fb, eb = a.first[level][i], a.end[level][i], b.first[level][j], b.end[level][j]
        wa, wb = a.total[ea] - a.total[fa], b.total[eb] - b.total[fb]
        own = (i == j) if self.same else np.zeros(len(i), bool)
        rows = _ranges(fa, ea - fa)
        np.add.at(self.count, rows, np.repeat(wb, ea - fa) - np.where(np.repeat(own, ea - fa), a.weight[rows], 0))
        self.unite(rows, np.repeat(fb + self.shift, ea - fa))
        rows = _ranges(fb[~own], (eb - fb)[~own])
        np.add.at(self.count, rows + self.shift, np.repeat(wa[~own], (eb - fb)[~own]))
        self.unite(np.repeat(fa[~own], (eb - fb)[~own]), rows + self.shift)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rep, links, least) of the vectors that have a link here."""
        rep = self.a.rep if self.same else np.concatenate([self.a.rep, self.b.rep])
        self.flatten()
        least = rep.copy()
        np.minimum.at(least, self.root, rep)
        has = np.flatnonzero(self.count)
        return rep[has], self.count[has], least[self.root[has]]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ...: size[i] numbers of each, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def dual(a: Tree, b: Tree, cosine: float) -> Links:
    """The links of two blocks, or of a block with itself."""
    links = Links(a, b)
    reach, slack, last = math.sqrt(max(0.0, 2 - 2 * cosine)), margin(a.x.shape[1]), len(RADII)

    def least(radii):
        """The least product that leaves open whether nodes of these radii together hold a link."""
        return 1 - np.minimum(radii + reach, 2.0) ** 2 / 2 - slack

    def most(radii):
        """The product from which all vectors of nodes of these radii together link."""
        return np.where(reach > radii, 1 - (reach - radii) ** 2 / 2 + slack, np.inf)

    def settle(level: int, i: np.ndarray, j: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of nodes still open; those that link whole are counted."""
        if links.same:
            keep = i < j if level == last else i <= j
            i, j, product = i[keep], j[keep], product[keep]
        radii = a.radius[level][i] + b.radius[level][j]
        whole = product >= most(radii)
        if whole.any():
            links.add(level, i[whole], j[whole])
        open_ = ~whole & (product >= least(radii))
        return i[open_], j[open_]

    def descend(level: int, i: np.ndarray, j: np.ndarray) -> None:
        if not i.size:
            return
        if level == last:
            sure = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= cosine
            links.add(level, i[sure], j[sure])
            return
        (la, ha), (lb, hb) = ((t.child[level][0][k], t.child[level][1][k]) for t, k in ((a, i), (b, j)))
        na, nb = ha - la, hb - lb
        many = na * nb > FEW
        xa, xb = a.first[level + 1], b.first[level + 1]
        for k in np.flatnonzero(many).tolist():
            right = b.single[xb[lb[k] : hb[k]]]
            widest = b.radius[level + 1][lb[k] : hb[k]].max()
            for start in range(int(la[k]), int(ha[k]), TILE):
                rows = np.arange(start, min(start + TILE, int(ha[k])))
                product = a.single[xa[rows]] @ right.T
                x, y = hits(product, least(a.radius[level + 1][rows].max() + widest))
                descend(level + 1, *settle(level + 1, rows[x], lb[k] + y, product[x, y]))
        few = np.flatnonzero(~many)
        sizes = np.cumsum((na * nb)[few])
        for part in np.split(few, np.searchsorted(sizes, np.arange(1 << 18, sizes[-1] if sizes.size else 0, 1 << 18))):
            if part.size:
                n = (na * nb)[part]
                k = np.repeat(part, n)
                at = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                x, y = la[k] + at // nb[k], lb[k] + at % nb[k]
                product = np.einsum("ij,ij->i", a.single[xa[x]], b.single[xb[y]])
                descend(level + 1, *settle(level + 1, x, y, product))

    top = first_level(a, b, least, most)
    of_a, of_b = a.classes(top), b.classes(top)
    for p, left in enumerate(of_a):
        for q, right in enumerate(of_b):
            if not left.size or not right.size or (links.same and q < p):
                continue
            xb = b.single[b.first[top][right]]
            hb = None if a.head is None or b.head is None else b.head[b.first[top][right]]
            widest = b.radius[top][right].max()
            for start in range(0, len(left), TILE):
                rows = left[start : start + TILE]
                skip = start if links.same and p == q else 0
                xa, enough = a.single[a.first[top][rows]], least(a.radius[top][rows].max() + widest)
                if hb is not None:
                    x, y = hits(a.head[a.first[top][rows]] @ hb[skip:].T, enough)
                    if OPEN * len(x) > len(rows) * (len(right) - skip):
                        hb = None  # heads keep too few of these nodes apart: this tile and the next ones take whole vectors
                    else:
                        got = np.concatenate([np.einsum("ij,ij->i", xa[x[k : k + MOST]], xb[skip + y[k : k + MOST]]) for k in range(0, max(1, len(x)), MOST)])
                        near = got >= np.float32(enough)
                        x, y, got = x[near], y[near], got[near]
                if hb is None:
                    product = xa @ xb[skip:].T
                    x, y = hits(product, enough)
                    got = product[x, y]
                i, j = rows[x], right[skip:][y]
                if links.same and p != q:
                    i, j = np.minimum(i, j), np.maximum(i, j)
                descend(top, *settle(top, i, j, got))
    return links


def _layout(counts: dict[int, int], block: int) -> tuple[dict[int, tuple[int, int]], int]:
    """First block and number of blocks of each cell, in order: small neighbours share a block, a large cell has several; and the blocks in all."""
    out, made, filled = {}, 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if n > block:
            made += 1 if filled else 0
            parts = -(-n // block)
            out[cell] = (made, parts)
            made, filled = made + parts, 0
            continue
        if filled + n > block:
            made, filled = made + 1, 0
        out[cell] = (made, 1)
        filled += n
    return out, made + (1 if filled else 0)


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do vectors of different length.
    Equal vectors are collapsed before the search and count as many links as they are. A null vec_id has a null component unless its vector occurs under an id;
    vectors that occur under null ids alone aren't compared. Repeated rows give repeated rows. Columns other than vec_id and embedding are not read.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = rows.where(sound)
    points = materialize(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).where("rep is not null"), "points")
    alone = lambda df: df.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    by_size = {r["dims"]: r["n"] for r in points.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).collect()}
    if not by_size:
        return alone(rows)

    centres: dict[int, np.ndarray] = {}
    target: dict[int, int] = {}
    for dims, n in by_size.items():
        most = max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))
        target[dims] = block or (n if n <= SMALL else max(1, min(most, -(-n // BLOCKS))))
        wanted = max(1, min(MOST_CENTRES, CENTRE_BYTES // (8 * dims), n, 4 * -(-n // target[dims])))
        drawn = points.where(F.size("embedding") == dims).orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("embedding").toArrow()
        x = unit(drawn.column("embedding").combine_chunks())
        centres[dims] = x[tree(x.astype(np.float32))[0]]
    shared = spark.sparkContext.broadcast(centres)
    axes = spark.sparkContext.broadcast({dims: main_axes(x) for dims, x in centres.items()})

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 2048):
                batch = whole.slice(start, 2048)
                size = pa.compute.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False).astype(np.int32)
                cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
                for dims in np.unique(size).tolist():
                    own = np.flatnonzero(size == dims)
                    product = unit(batch.column("embedding").take(pa.array(own))) @ shared.value[dims].T
                    cell[own] = product.argmax(1)
                    far[own] = np.sqrt(np.maximum(0, 2 - 2 * product.max(1)) + 1e-12)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(cell), pa.array(far)], names=["rep", "weight", "embedding", "dims", "cell", "far"])

    celled = materialize(points.select("rep", "weight", "embedding").mapInArrow(cells, f"rep bigint, weight bigint, embedding {kind}, dims int, cell int, far double"), "cells")
    stats = celled.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    places, spans, made = [], {}, 0
    for dims in sorted(by_size):
        own = {r["cell"]: (r["n"], r["far"]) for r in stats if r["dims"] == dims}
        layout, n = _layout({c: v[0] for c, v in own.items()}, target[dims])
        ids = sorted(layout)
        spans[dims] = (np.array(ids), np.array([own[c][1] for c in ids]), np.array([layout[c][0] + made for c in ids]), np.array([layout[c][1] for c in ids]), made, made + n)
        places += [(dims, c, layout[c][0] + made, layout[c][1]) for c in ids]
        made += n
    placed = spark.createDataFrame(places, "dims int, cell int, start int, parts int")
    dealt = celled.join(F.broadcast(placed), ["dims", "cell"]).select("rep", "weight", "embedding", (F.col("start") + F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts"))).cast("int").alias("block"))

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("embedding").combine_chunks()
        order, starts = tree(unit(column).astype(np.float32))
        raw = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)[order]
        ids, weight = (table.column(c).to_numpy()[order].astype(np.int64) for c in ("rep", "weight"))
        return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([len(order)]), "raw": [raw.tobytes()], "rep": [ids.tobytes()], "weight": [weight.tobytes()], "starts": pa.array([[s.tobytes() for s in starts]], pa.list_(pa.binary()))})

    # one row a block: its vectors, ids, weights and node starts as packed bytes
    packed = "block int, n bigint, raw binary, rep binary, weight binary, starts array<binary>"
    tasks = min(made, 4096)
    trees = materialize(dealt.repartition(tasks, "block").groupBy("block").applyInArrow(build, packed), "trees")
    where = spark.sparkContext.broadcast(spans)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine in batch.column("id").to_pylist():
                dims, (ids, far, start, parts, _, end) = next((d, s) for d, s in where.value.items() if s[4] <= mine < s[5])
                own = (start <= mine) & (mine < start + parts)
                apart = np.sqrt(np.maximum(0, 2 - 2 * shared.value[dims][ids[own]] @ shared.value[dims][ids].T) + 1e-12)
                open_ = np.flatnonzero((apart <= far[own][:, None] + far[None, :] + reach + 1e-6).any(0))
                other = np.unique(np.append(_ranges(start[open_], parts[open_]), mine))
                other = other[other >= mine].astype(np.int32)
                low = np.full(len(other), mine, np.int32)
                twice = other != mine
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([low, other[twice]])), pa.array(np.concatenate([low, low[twice]])), pa.array(np.concatenate([other, other[twice]]))], names=["block", "low", "high"])

    pairs = materialize(spark.range(made).mapInArrow(partners, "block int, low int, high int"), "pairs")
    n_pairs = pairs.count()
    sent = trees.join(F.broadcast(pairs) if n_pairs <= BROADCAST_PAIRS else pairs, "block")
    element = np.float32 if kind == "array<float>" else np.float64

    def compare(table: pa.Table) -> pa.Table:
        sides = []
        for r in table.to_pylist():
            ids, weight = (np.frombuffer(r[c], np.int64) for c in ("rep", "weight"))
            x = unit(np.frombuffer(r["raw"], element).reshape(r["n"], -1))
            sides.append(Tree(x, ids, weight, [np.frombuffer(s, np.int32) for s in r["starts"]], axes.value[x.shape[1]]))
        out = dual(sides[0], sides[-1], cosine).rows()
        return pa.table({"rep": pa.array(out[0]), "links": pa.array(out[1]), "least": pa.array(out[2])})

    found = materialize(sent.repartition(max(1, min(n_pairs, 8192)), "low", "high").groupBy("low", "high").applyInArrow(compare, "rep bigint, links bigint, least bigint"), "linked")
    discard(celled, trees, pairs)
    joined = connected_components(found.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = points.join(links, "rep", "left").join(joined.withColumnRenamed("u", "rep"), "rep", "left")
    own = classes.select("embedding", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("least"))
    # fewer than 1,000 vectors can be as common as a thousandth of the rows: they are broadcast, so that no common vector's rows meet in one task
    common = F.col("weight") > max(1000, good.count() // 1000)
    heavy = own.where(common).select("embedding", F.col("n").alias("n_h"), F.col("least").alias("least_h"))
    out = good.join(F.broadcast(heavy), "embedding", "left")
    rest = out.where("n_h is null").select("vec_id", "embedding").join(own.where(~common).drop("weight"), "embedding", "left")
    out = rest.select("vec_id", "n", "least").unionByName(out.where("n_h is not null").select("vec_id", F.col("n_h").alias("n"), F.col("least_h").alias("least")))
    component = F.coalesce("least", "vec_id")
    linked = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    return linked.unionByName(alone(rows.where(~sound)))
