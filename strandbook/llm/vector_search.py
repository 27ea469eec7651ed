"""Approximate nearest neighbours: stable projections, kd-trees and a chi-square stopping test."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandbook.llm.common import checkpointed, ship
from strandbook.llm.vectors import by_length, matrix, sample, with_direction

#: Distinct vectors of a region, and queries that one task takes to it, at most about.
REGION, QUERIES = 8_192, 4_096
LEAF = 64


def chi_square_quantile(p: float, m: int) -> float:
    """Of an even number of degrees of freedom, where the distribution is a finite sum."""
    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(m // 2))

    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def kd_boxes(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree: halves at the median of the widest side until ``leaf`` rows are left."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        x = points[rows]
        side = int(np.argmax(x.max(0) - x.min(0)))
        order = np.argpartition(x[:, side], len(rows) // 2)
        todo += [rows[order[len(rows) // 2:]], rows[order[:len(rows) // 2]]]
    return out


def kd_splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """The (side, value) of every inner node of a full kd-tree, as a heap; equal values go right."""
    out: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for x in level:
            side = int(np.argmax(x.max(0) - x.min(0))) if len(x) else 0
            value = float(np.median(x[:, side])) if len(x) else 0.0
            out.append((side, value))
            right = x[:, side] >= value if len(x) else np.zeros(0, bool)
            below += [x[~right], x[right]]
        level = below
    return out


def region_of(points: np.ndarray, splits: list[tuple[int, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    side, value = np.array([s for s, _ in splits] or [0]), np.array([v for _, v in splits] or [0.0])
    for _ in range(depth):
        node = 2 * node + 1 + (points[np.arange(len(points)), side[node]] >= value[node])
    return node - (2**depth - 1)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of q to boxes; infinite for empty ones (low > high)."""
    out = np.zeros((len(q), len(low)))
    for c in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[:, c] - q[:, c, None], q[:, c, None] - high[:, c]), 0)
        out += gap * gap
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, dims: int = 8, confidence: float = 0.95, seed: int = 5) -> DataFrame:
    """The ``k`` rows with the largest inner product for each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows but the query's own. Ties go to the smaller vec_id; ``score`` is in
    double precision on the original vectors.

    One more coordinate makes all vectors equally long, so that the largest inner
    product is the smallest distance. Seeded Gaussian (2-stable) projections to
    ``dims`` dimensions are dealt to regions by the top of a kd-tree, which a
    bounded sample fixes; all rows are indexed. Each region's task builds the
    rest of the tree. Projected neighbours are taken leaf by leaf, nearest
    first, and verified on whole vectors, until the chi-square test holds:
    a vector nearer than the k-th found would, with probability ``confidence``,
    have had a projection nearer than the next leaf. A query first visits its
    home region; its k-th distance there tells which other regions the test
    does not yet rule out, and it visits those next.

    Equal vectors are one class: it is searched once, and only its k + 1 smallest
    ids can ever be among the k nearest. Null, empty and zero vectors and those
    with null or non-finite components are neither queries nor candidates, and
    vectors of different lengths are not each other's. Rows that repeat a vec_id
    are candidates of their own, but not for queries of that id; a query id that
    repeats with several vectors has the ranks of each. If there are fewer
    candidates than k, all are returned. Empty tables give no rows; other columns
    are not read.
    """
    ship(vectors.sparkSession)
    rows = checkpointed(with_direction(vectors).filter("usable"))
    found = [_nearest(own, k, every, dims, confidence, seed) for own in by_length(rows)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, k: int, every: int, dims: int, confidence: float, seed: int) -> DataFrame:
    """nearest() of usable rows of one length."""
    spark = rows.sparkSession
    kind = rows.schema["embedding"].dataType.simpleString()
    first = Window.partitionBy("h").orderBy("vec_id")
    classes = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    classes = checkpointed(classes.groupBy("h").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")))
    asked = rows.filter(F.col("vec_id") % every == 0)
    n = classes.count()
    longest = classes.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    picked = sample(classes)
    axes = np.random.default_rng(seed).standard_normal((picked.shape[1] + 1, dims))

    def project(x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0))
        return np.column_stack([x, more]) @ axes

    depth = max(0, math.ceil(math.log2(n / REGION)))
    splits = kd_splits(project(picked, False), depth)
    factor = chi_square_quantile(confidence, dims)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                at = region_of(project(matrix(batch.column("embedding")), False), splits, depth)
                yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("embedding"), pa.array(at.astype(np.int32))], ["ids", "embedding", "region"])

    placed = checkpointed(classes.select("ids", "embedding").mapInArrow(deal, "ids array<long>, embedding " + kind + ", region int"))

    def bounds(batches):
        for batch in batches:
            p, at = project(matrix(batch.column("embedding")), False) if batch.num_rows else np.zeros((0, dims)), batch.column("region").to_numpy()
            for r in np.unique(at):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([p[at == r].min(0).tolist()]), pa.array([p[at == r].max(0).tolist()])], ["region", "low", "high"])

    by_side = [f(F.col(w)[c]).alias(f"{w}{c}") for w, f in (("low", F.min), ("high", F.max)) for c in range(dims)]
    boxes = placed.select("region", "embedding").mapInArrow(bounds, "region int, low array<double>, high array<double>").groupBy("region").agg(*by_side).orderBy("region").collect()  # a row for each region
    names = np.array([b.region for b in boxes], np.int32)
    low, high = (np.array([[b[f"{w}{c}"] for c in range(dims)] for b in boxes]) for w in ("low", "high"))
    queries = checkpointed(asked.groupBy("h").agg(F.first("embedding").alias("embedding")))
    asked_n = queries.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A region is sent once for each chunk of queries: no more chunks than keep all tasks busy, but none too large.
    chunks = max(1, min(-(-asked_n // 64), max(-(-asked_n // QUERIES), -(-2 * parts // len(names)))))
    chunk = F.pmod(F.col("h"), F.lit(chunks)).cast("int")

    def route(batches, home: bool):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = box_distance(project(matrix(batch.column("embedding")), True), low, high)
            nearest_box = d.argmin(1)
            if home:
                go = [names[[b]] for b in nearest_box]
            else:
                open_ = d <= batch.column("kth").to_numpy()[:, None] * factor
                open_[np.arange(len(d)), nearest_box] = False
                go = [names[o] for o in open_]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "embedding", "kth")), pa.array(go, pa.list_(pa.int32()))], ["h", "embedding", "kth", "go"])

    def search(block: pa.Table) -> pa.Table:
        asks = block.column("ids").is_null().to_numpy()
        q, x = block.filter(pa.array(asks)), block.filter(pa.array(~asks))
        out: list[tuple] = []
        if q.num_rows and x.num_rows:
            vx, vq = matrix(x.column("embedding")), matrix(q.column("embedding"))
            ids = x.column("ids").to_pylist()
            least, count = np.array([i[0] for i in ids]), np.array([len(i) for i in ids])
            px = project(vx, False)
            leaves = kd_boxes(px, LEAF)
            d = box_distance(project(vq, True), np.stack([px[r].min(0) for r in leaves]), np.stack([px[r].max(0) for r in leaves]))
            order = np.argsort(d, 1)
            length = np.einsum("ij,ij->i", vq, vq)
            for i, (h, kth) in enumerate(zip(q.column("h").to_pylist(), q.column("kth").to_pylist(), strict=True)):
                rows_, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
                while at < len(leaves):
                    stop = kth * factor
                    take = order[i, at:at + step]
                    take = take[d[i, take] <= stop]
                    if not len(take):
                        break
                    more = np.concatenate([leaves[t] for t in take])
                    rows_, scores = np.concatenate([rows_, more]), np.concatenate([scores, vx[more] @ vq[i]])
                    best = np.lexsort([least[rows_], -scores])
                    enough = int(np.searchsorted(np.cumsum(count[rows_[best]]), k + 1)) + 1
                    rows_, scores = rows_[best[:enough]], scores[best[:enough]]
                    if count[rows_].sum() >= k + 1:
                        kth = min(kth, length[i] + longest - 2 * scores[-1])
                    at, step = at + step, step * 2
                out += [(h, v, s, kth) for r, s in zip(rows_.tolist(), scores.tolist(), strict=True) for v in ids[r]]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["h", "vec_id", "score", "kth"])

    routed_schema = f"h long, embedding {kind}, kth double, go array<int>"
    found_schema = "h long, vec_id long, score double, kth double"
    nobody = [F.lit(None).cast(t).alias(c) for c, t in (("h", "long"), ("kth", "double"))]

    def visit(q: DataFrame, home: bool) -> DataFrame:
        coming = q.select("h", "embedding", "kth").mapInArrow(lambda b: route(b, home), routed_schema)
        coming = checkpointed(coming.withColumn("region", F.explode("go")).withColumn("chunk", chunk).select("region", "chunk", "h", "embedding", "kth"))
        meetings = coming.select("region", "chunk").distinct()  # a region's rows go where its queries are
        lying = placed.join(meetings, "region").select("region", "chunk", *nobody, "ids", "embedding")
        coming = coming.select("region", "chunk", "h", "kth", F.lit(None).cast("array<long>").alias("ids"), "embedding")
        return checkpointed(lying.unionByName(coming).groupBy("region", "chunk").applyInArrow(search, found_schema))

    began = visit(queries.withColumn("kth", F.lit(1e300)), True)
    reached = began.groupBy("h").agg(F.min("kth").alias("kth"))
    found = began
    if len(names) > 1:
        found = began.unionByName(visit(queries.join(reached, "h", "left").withColumn("kth", F.coalesce("kth", F.lit(1e300))), False))
    best = Window.partitionBy("h").orderBy(F.desc("score"), "vec_id")
    top = found.select("h", "vec_id", "score").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    pairs = asked.select(F.col("vec_id").alias("query_id"), "h").distinct().join(top, "h").filter("query_id != vec_id")
    final = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
