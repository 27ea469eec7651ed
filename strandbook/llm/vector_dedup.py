"""Near-duplicate vectors by an inverted multi-index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbook.llm.common import checkpointed, connected_components, either_way, ship
from strandbook.llm.vectors import by_length, matrix, sample, with_direction

#: Rows of one block of comparisons: vectors that live in a cell, and vectors that visit it.
RESIDENTS, VISITORS = 4_096, 8_192


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centres; empty ones move to the rows that are worst served."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        d = apart(x, centres)
        near = d.argmin(1)
        sums = np.stack([np.bincount(near, x[:, c], len(centres)) for c in range(x.shape[1])], 1)
        count = np.bincount(near, minlength=len(centres))
        worst = np.argsort(-d.min(1))[:(count == 0).sum()]
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        centres[np.flatnonzero(count == 0)[:len(worst)]] = x[worst]
    return centres


class MultiIndex:
    """Codebooks of both halves; their product is the grid of cells."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.cut = first, second, first.shape[1]

    def traverse(self, x: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` nearest cells of each row, nearest first.

        The two halves' centres are sorted by distance and cells are taken in
        order of the sum. The cell of ranks (i, j) has (i + 1) * (j + 1) - 1 cells
        before it in any case, so only ranks with a product up to ``most`` are looked at.
        """
        d1, d2 = apart(x[:, :self.cut], self.first), apart(x[:, self.cut:], self.second)
        most = min(most, d1.shape[1] * d2.shape[1])
        o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        ranks = np.array([(i, j) for i in range(min(most, d1.shape[1])) for j in range(min(most // (i + 1), d2.shape[1]))])
        total = s1[:, ranks[:, 0]] + s2[:, ranks[:, 1]]
        best = np.argsort(total, 1, kind="stable")[:, :most]
        return o1[np.arange(len(x))[:, None], ranks[best, 0]] * len(self.second) + o2[np.arange(len(x))[:, None], ranks[best, 1]]


def fit(x: np.ndarray, cosine: float, recall: float, centres: int, seed: int) -> tuple[MultiIndex, int]:
    """The index, and how many cells to visit for the target recall.

    Measured on the sample: every vector is paired with one at exactly the
    threshold, in a random direction, the hardest case that still links.
    """
    x = unit(x)
    cut = x.shape[1] // 2 or 1
    index = MultiIndex(codebook(x[:, :cut], centres, seed), codebook(x[:, cut:], centres, seed + 1) if x.shape[1] > cut else np.zeros((1, 0)))
    rng = np.random.default_rng(seed + 2)
    x = x[rng.permutation(len(x))[:4_000]]
    aside = rng.standard_normal(x.shape)
    aside -= np.einsum("ij,ij->i", aside, x)[:, None] * x
    norm = np.sqrt(np.einsum("ij,ij->i", aside, aside))
    partner = np.where(norm[:, None] > 1e-9, cosine * x + math.sqrt(1 - cosine**2) * aside / np.maximum(norm, 1e-9)[:, None], x)
    home = index.traverse(partner, 1)[:, 0]
    most = len(index.first) * len(index.second)
    visits = 1
    while visits < most:
        # A pair is found if either side visits the other's cell.
        there = (index.traverse(x, visits) == home[:, None]).any(1)
        back = (index.traverse(partner, visits) == index.traverse(x, 1)).any(1)
        if (there | back).mean() >= recall:
            break
        visits = min(most, visits * 2 if visits < 8 else visits + visits // 4)
    return index, visits


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links (i, j), for all of 0..n-1."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, was[i], low)
        np.minimum.at(root, was[j], low)
        root = root[root]
        if (root == was).all():
            break
    return root


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.98, seed: int = 17) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors`` (vec_id, embedding).

    Vectors link when their cosine, in double precision, is at least ``cosine``.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest vec_id that links reach, ``kept`` says that it is the row's own.

    Equal vectors are one class from the start and are never paired. Independent
    codebooks for the two halves, fitted on a bounded sample (SAMPLE distinct
    vectors), form a grid of cells. Each vector lives in its nearest cell and
    visits as many cells, nearest first, as the target recall needs; in each cell
    visitors are compared with residents. A pair that meets twice is counted in
    one place. Crowded cells are dealt out over several blocks of bounded size,
    which send back sums and spanning links, not pairs.

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing, and vectors of different lengths not with each other:
    n_links 0, component_id their own. Rows with null vec_id have a null component
    and kept false. Rows that repeat a vec_id are rows of their own, each by its
    vector. Empty tables give no rows; other columns are not read.
    """
    ship(vectors.sparkSession)
    rows = checkpointed(with_direction(vectors))
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for own in by_length(rows.filter("usable")):
        alone = alone.unionByName(_linked(own, cosine, recall, seed))
    return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(rows: DataFrame, cosine: float, recall: float, seed: int) -> DataFrame:
    """vec_id, n_links, component_id of usable rows of one length. A class of equal vectors goes by their hash, ``rep``."""
    spark = rows.sparkSession
    kind = rows.schema["embedding"].dataType.simpleString()
    classes = checkpointed(rows.groupBy("h").agg(F.col("h").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    n = classes.count()
    centres = int(min(1_024, max(4, round(math.sqrt(n) / 8))))
    index, visits = fit(sample(classes), cosine, recall, centres, seed)
    shared = spark.sparkContext.broadcast(index)

    def place(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                cells = shared.value.traverse(unit(matrix(part.column("embedding"))), visits).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("copies"), part.column("embedding"), pa.array(cells[:, 0]), pa.array(list(cells), pa.list_(pa.int32()))],
                    ["rep", "copies", "embedding", "home", "visits"])

    placed = checkpointed(classes.select("rep", "copies", "embedding").mapInArrow(place, f"rep long, copies long, embedding {kind}, home int, visits array<int>"))
    residents = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("here"))
    visitors = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("coming"))
    sizes = residents.join(visitors, "cell").select(
        "cell", F.ceil(F.col("here") / RESIDENTS).cast("int").alias("rs"), F.ceil(F.col("coming") / VISITORS).cast("int").alias("ps"))
    sizes = either_way(checkpointed(sizes))
    slot = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    here = placed.withColumn("cell", F.col("home")).join(sizes, "cell").select(
        "cell", slot("rs").alias("r"), F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), F.lit(True).alias("lives"), "rep", "copies", "embedding", "home", "visits")
    there = placed.withColumn("cell", F.explode("visits")).join(sizes, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)).alias("r"), slot("ps").alias("p"), F.lit(False).alias("lives"), "rep", "copies", "embedding", "home", F.lit(None).cast("array<int>").alias("visits"))

    def compare(block: pa.Table) -> pa.Table:
        lives = block.column("lives").to_numpy()
        y, x = block.filter(pa.array(lives)), block.filter(pa.array(~lives))
        found_i, found_j = [], []
        if y.num_rows and x.num_rows:
            vy, vx = unit(matrix(y.column("embedding"))), unit(matrix(x.column("embedding")))
            ry, rx = y.column("rep").to_numpy(), x.column("rep").to_numpy()
            back = matrix(y.column("visits")).astype(np.int64)
            hx = x.column("home").to_numpy()
            for lo in range(0, len(rx), 512):
                i, j = np.nonzero(vx[lo:lo + 512] @ vy.T >= cosine)
                i += lo
                # Where y visits x's cell too, the smaller one's visit counts.
                twice = (back[j] == hx[i][:, None]).any(1)
                ok = np.where(twice, rx[i] < ry[j], rx[i] != ry[j])
                found_i.append(i[ok])
                found_j.append(j[ok])
        i, j = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_i, found_j))
        nodes = np.unique(np.concatenate([x.column("rep").to_numpy()[i], y.column("rep").to_numpy()[j]])) if len(i) else np.zeros(0, np.int64)
        if len(i):
            a, b = np.searchsorted(nodes, x.column("rep").to_numpy()[i]), np.searchsorted(nodes, y.column("rep").to_numpy()[j])
            links = np.bincount(a, y.column("copies").to_numpy()[j], len(nodes)) + np.bincount(b, x.column("copies").to_numpy()[i], len(nodes))
            root = nodes[_roots(len(nodes), a, b)]
        else:
            links, root = np.zeros(0), nodes
        return pa.table({"rep": pa.array(nodes, pa.int64()), "links": pa.array(links.astype(np.int64)), "root": pa.array(root, pa.int64())})

    found = checkpointed(here.unionByName(there).groupBy("cell", "r", "p").applyInArrow(compare, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    known = classes.select("h", "rep", "least", "copies").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select("h", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    return rows.select("vec_id", "h").join(known, "h").select("vec_id", "n_links", "component_id")
