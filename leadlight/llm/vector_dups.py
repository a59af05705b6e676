"""Near duplicates among vectors of one label, by a join on low-dimensional blocks.

Unit vectors with a cosine of at least t lie within a squared distance of 2 - 2t. They are rotated at random and cut into blocks
of BLOCK components; each block gets the share of that budget that its components have of all. If every block of a pair were
above its share the sum would be above the budget, so a linked pair is within its share in one block at least. For each
block a tree of cells over its few coordinates finds all pairs within the share: a vector is at home in one cell and a
guest in those cells before it that its share reaches, and pairs meet at home. A pair is judged in the first block in which it is
within its share, so it is judged once, by its exact cosine.

Equal vectors of a label are one node with a number of copies. Cells with many nodes are cut into chunks that meet in tasks of
their own, which give every node its number of links and one edge, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlight.llm.common import discard, materialize
from leadlight.llm.neardup import components

#: Components of a block; rows (by hash) from which the trees are made; cells of a tree at most; rows compared at a time.
BLOCK, SAMPLE, CELLS, STEP = 8, 8192, 512, 512
#: Crowded cells that may be broadcast; beyond that they are joined by shuffle.
BROADCAST = 100_000


@dataclass
class Node:
    """A node of a tree: a cell, or a cut of one coordinate."""

    cell: int = -1
    axis: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


def rotation(dims: int) -> np.ndarray:
    """An orthogonal matrix, always the same one for a number of dimensions."""
    return np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))[0]


def blocks(dims: int) -> list[tuple[int, int]]:
    return [(i, min(i + BLOCK, dims)) for i in range(0, dims, BLOCK)]


def budgets(dims: int, least: float) -> np.ndarray:
    """Each block's share of the squared distance, a little higher for rounding."""
    whole = (2 - 2 * least) * (1 + 1e-9) + 1e-12
    return np.array([whole * (b - a) / dims for a, b in blocks(dims)])


def rotated(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """unit @ turn, term by term, so that a row has the same result in whatever matrix it stands."""
    out = np.zeros((len(unit), turn.shape[1]))
    for k in range(len(turn)):
        out += unit[:, k, None] * turn[k]
    return out


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, added up in the same order for every row."""
    out = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        out += rows[:, k] * rows[:, k]
    return np.sqrt(out)


def grow(points: np.ndarray, radius: float, cells: int, least: int) -> tuple[Node, int]:
    """A tree of at most ``cells`` cells over sample points; cuts are where the fewest points are guests beyond them.

    A cell stays whole below 2 * least points, or where a cut would leave most of them on both sides.
    """
    made = 0

    def cut(points: np.ndarray, cells: int) -> Node:
        nonlocal made
        best = None
        if cells > 1 and len(points) >= 2 * least:
            for axis in range(points.shape[1]):
                at = float(np.median(points[:, axis]))
                low = int((points[:, axis] <= at).sum())
                guests = int(((points[:, axis] > at) & (points[:, axis] <= at + radius)).sum())
                if 0 < low < len(points) and guests < 0.4 * (len(points) - low) and (best is None or guests < best[0]):
                    best = guests, axis, at
        if best is None:
            made += 1
            return Node(cell=made - 1)
        _, axis, at = best
        left = points[:, axis] <= at
        return Node(axis=axis, at=at, low=cut(points[left], cells // 2), high=cut(points[~left], cells - cells // 2))

    return cut(points, cells), made


def visits(node: Node, points: np.ndarray, radius: float, home: np.ndarray, guest: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, rows at home, guests) of the cells that have any."""
    if not len(home) and not len(guest):
        return
    if node.low is None:
        yield node.cell, home, guest
        return
    at_home, as_guest = points[home, node.axis], points[guest, node.axis]
    above = at_home > node.at
    near = home[above & (at_home <= node.at + radius)]
    yield from visits(node.low, points, radius, home[~above], np.concatenate([guest[as_guest <= node.at + radius], near]))
    yield from visits(node.high, points, radius, home[above], guest[as_guest > node.at - radius])


def merge(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Joins the classes of the rows of each pair; ``root`` has the smallest row of every row's class."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return
        p, q = p[apart], q[apart]
        np.minimum.at(root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (root[root] != root).any():
            root[:] = root[root]


def links_within(vectors: np.ndarray, home: np.ndarray, chunk: np.ndarray, weight: np.ndarray, block: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a cell its linked copies, and the smallest row of its class, by the pairs judged in this block.

    Pairs of two guests are not met here; with two chunks only pairs of one and the other are.
    """
    dims, n = vectors.shape[1], len(vectors)
    turn, share, spans = rotation(dims), budgets(dims, least), blocks(dims)
    long = lengths(vectors)
    unit = vectors / long[:, None]
    points = rotated(unit, turn[:, slice(*spans[block])])
    squares = (points**2).sum(1)
    first, second = (np.flatnonzero(chunk == c) for c in (chunk.min(), chunk.max()))
    count, root, whole = np.zeros(n, np.int64), np.arange(n), None
    for start in range(0, len(first), STEP):
        some = first[start : start + STEP]
        far = squares[some, None] + squares[second] - 2 * points[some] @ points[second].T
        x, y = np.nonzero((far <= share[block] + 1e-9) & (home[some, None] | home[second]))
        p, q = some[x], second[y]
        if chunk.min() == chunk.max():
            p, q = p[p < q], q[p < q]
        if len(p) and whole is None:
            whole = rotated(unit, turn)
        for at in range(0, len(p), 1 << 14):
            a, b = p[at : at + (1 << 14)], q[at : at + (1 << 14)]
            within = []
            for lo, hi in spans[: block + 1]:
                d = np.zeros(len(a))
                for k in range(lo, hi):
                    d += (whole[a, k] - whole[b, k]) ** 2
                within.append(d)
            good = within[block] <= share[block]
            for earlier in range(block):
                good &= within[earlier] > share[earlier]
            a, b = a[good], b[good]
            linked = (vectors[a] * vectors[b]).sum(1) / (long[a] * long[b]) >= least
            a, b = a[linked], b[linked]
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])
            merge(root, a, b)
    return count, root


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _links(nodes: DataFrame, dims: int, most: int, least: float, crowd: int) -> DataFrame:
    """(a, a_least, b, b_least, n) of linked nodes: a's linked copies in one task, and a node of its class there."""
    sample = _sample(nodes, dims)
    spans, share, turn = blocks(dims), budgets(dims, least), rotation(dims)
    wanted = int(min(CELLS, max(1, 2 * most // crowd)))
    at = rotated(sample / lengths(sample)[:, None], turn)
    trees = [grow(at[:, slice(*span)], float(np.sqrt(r)), wanted, 8)[0] for span, r in zip(spans, share, strict=True)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                rows = _matrix(part.column(3))
                points = rotated(rows / lengths(rows)[:, None], turn)
                for number, (tree, span, r) in enumerate(zip(trees, spans, share, strict=True)):
                    cells, takes, homes = [], [], []
                    for cell, home, guest in visits(tree, points[:, slice(*span)], float(np.sqrt(r)) * (1 + 1e-9) + 1e-9, np.arange(len(rows)), np.zeros(0, np.int64)):
                        takes += [home, guest]
                        cells.append(np.full(len(home) + len(guest), number * CELLS + cell, np.int32))
                        homes.append(np.arange(len(home) + len(guest)) < len(home))
                    out = part.take(pa.array(np.concatenate(takes)))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes))], [*out.schema.names, "cell", "home"])

    kind, label = dict(nodes.dtypes)["v"], dict(nodes.dtypes)["label"]
    sent = nodes.select("node", "least", "n", "v", "label")
    placed = sent.mapInArrow(place, f"node long, least long, n long, v {kind}, label {label}, cell int, home boolean")
    crowded = materialize(placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / crowd).cast("int").alias("chunks")).where("chunks > 1"), "crowded")
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST else crowded.hint("merge")
    cut = placed.join(crowded, ["label", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = cut.select("label", "cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "home", "node", "least", "n", "v")

    def compare(cell: pa.Table) -> pa.Table:
        column = {name: cell.column(name).combine_chunks() for name in cell.column_names}
        node, ids, weight, chunk, home = (column[name].to_numpy(zero_copy_only=False) for name in ("node", "least", "n", "chunk", "home"))
        linked = other = count = np.zeros(0, np.int64)
        if column["i"][0] == column["j"][0] or chunk.min() < chunk.max():  # else the other chunk has no row
            count, root = links_within(_matrix(column["v"]), home.astype(bool), chunk, weight, column["cell"][0].as_py() // CELLS, least)
            linked = np.flatnonzero(count)
            other, count = root[linked], count[linked]
        return pa.table([pa.array(x, pa.int64()) for x in (node[linked], ids[linked], node[other], ids[other], count)], names=["a", "a_least", "b", "b_least", "n"])

    return dealt.groupBy("label", "cell", "i", "j").applyInArrow(compare, "a long, a_least long, b long, b_least long, n long")


def _sample(nodes: DataFrame, dims: int) -> np.ndarray:
    taken = nodes.select("h", "node", "v").orderBy("h", "node").limit(SAMPLE).collect()
    return np.array([r["v"] for r in taken], np.float64).reshape(len(taken), dims)


def vector_classes(vectors: DataFrame, least: float = 0.98, crowd: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Columns (<id>, n_links, component_id long, kept boolean) of every row: its linked rows, the smallest id it reaches by links.

    Rows link if their labels are equal and not null and their cosine in double precision is at least ``least`` (above 0,
    below 1). A vector that is null, empty, zero, or holds null or non-finite components links with nothing, nor do vectors of
    different sizes, nor those whose squared length is not a finite positive double. Repeated rows, and different rows with one id,
    are vectors of their own and count each other. Rows without an id take no part; they have no component and are kept. Other
    columns are not read; an empty table gives an empty result. ``crowd`` is the number of rows of a cell from which it is cut.

    At most SAMPLE vectors come to the driver; trees made from them place every row, and the result does not depend on them.
    """
    if not 0 < least < 1:
        raise ValueError("least must be above 0 and below 1")
    spark, element = vectors.sparkSession, "float" if dict(vectors.dtypes)[vector_column] == "array<float>" else "double"
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(f"array<{element}>").alias("v"), F.col(label_column).alias("label"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & (squares > 0) & (squares < float("inf")), F.lit(False))
    rows = rows.withColumn("h", F.when(fit, F.xxhash64("label", "v")))
    nodes = rows.where("h is not null").groupBy("h", "label", "v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.groupBy(F.size("v").alias("dims"), "label").agg(F.count("*").alias("n")).groupBy("dims").agg(F.max("n").alias("most"))
    found = spark.createDataFrame([], "a long, a_least long, b long, b_least long, n long")
    for r in sizes.where("most > 1").orderBy("dims").collect():
        found = found.unionByName(_links(nodes.where(F.size("v") == r["dims"]), r["dims"], r["most"], least, crowd))
    links = materialize(found, "links")
    roots = components(links.select(F.struct(F.col("a_least").alias("id"), F.col("a").alias("node")).alias("a"), F.struct(F.col("b_least").alias("id"), F.col("b").alias("node")).alias("b")))
    reached = roots.select("node.node", F.col("root.id").alias("component_id"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    known = nodes.join(counts, "node", "left").join(reached, "node", "left")
    known = materialize(known.select("h", "label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "known")
    discard(links)
    discard(nodes)
    out = rows.join(known, ["h", "label", "v"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
