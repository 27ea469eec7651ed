"""Hard negatives: an exact nearest-neighbour join over Voronoi cells, whose bounds say which candidates which anchors may need."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbook.llm.common import checkpointed, ship

#: Anchors of a cell, about, and cells at most; anchors and candidates that meet in one task, at most about.
PER_CELL, CELLS = 256, 1_024
ANCHORS, CANDIDATES = 1_024, 16_384
#: Labels are dealt to so many buckets when candidates are routed; labels themselves are compared where they meet.
BUCKETS = 64
#: Rows that are held against all groups at once.
ROUTED = 1_000
#: A hundredfold score must fit a long.
MOST = 2.0**55


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v array<int>, norm2) of the rows that take part; rows that repeat id, label and vector count once."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & (F.size(x) > 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.when(fine, F.transform(x, lambda c: F.floor(c * float(scale)))).alias("v"))
    rows = rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    kept = rows.filter("vec_id is not null and label is not null and v is not null").filter(F.col("norm2") < MOST)
    return kept.withColumn("v", F.col("v").cast("array<int>")).dropDuplicates(["vec_id", "label", "v"])


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows, as a matrix in double precision, of the vectors of each length."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[starts[at, None] + np.arange(d)].astype(np.float64)


class Cells:
    """Pivots, and distances to them where one more coordinate makes all candidates as long as the longest.

    Then the nearer of two candidates to an anchor, whose own further coordinate is
    0, is the one with the larger inner product. Pivots of another length count as
    filled up with zeros, which changes no distance between vectors of one length.
    """

    def __init__(self, pivots: list[list[int]], most: float):
        self.most = most
        self.at = np.zeros((len(pivots), max((len(p) for p in pivots), default=0)))
        for k, p in enumerate(pivots):
            self.at[k, :len(p)] = p
        self.norm2 = np.einsum("ij,ij->i", self.at, self.at)
        self.more = np.sqrt(np.maximum(most - self.norm2, 0))
        #: Bounds are loosened by more than rounding can make of them.
        self.slack = 1e-6 * np.sqrt(most) + 1e-9

    def distances(self, vectors: pa.Array, candidates: bool) -> np.ndarray:
        """Of each vector to each pivot."""
        out = np.zeros((len(vectors), len(self.at)))
        for at, x in by_length(vectors):
            d = min(x.shape[1], self.at.shape[1])
            dot, norm2 = x[:, :d] @ self.at[:, :d].T, np.einsum("ij,ij->i", x, x)
            if candidates:
                dot += np.sqrt(np.maximum(self.most - norm2, 0))[:, None] * self.more
                norm2 = np.full(len(x), self.most)
            out[at] = norm2[:, None] + self.most - 2 * dot
        return np.sqrt(np.maximum(out, 0))


class Groups:
    """Anchors' groups, a row each: ``bucket`` of labels (-1: all), ``cell``, radius around its pivot, and how near and how far what they need may lie."""

    def __init__(self, cells: Cells, rows: list) -> None:
        self.cells = cells
        self.bucket, self.cell = (np.array([r[c] for r in rows], np.int64) for c in ("bucket", "cell"))
        self.radius, self.near, self.far = (np.array([r[c] for r in rows], np.float64) for c in ("radius", "near", "far"))
        self.of = {b: np.flatnonzero((self.bucket == b) | (self.bucket < 0)) for b in range(BUCKETS)}
        self.first = np.zeros(len(rows), np.int64)
        self.blocks = np.ones(len(rows), np.int64)

    def deal(self, candidates: np.ndarray) -> None:
        """Splits what a group meets into blocks of about CANDIDATES; meetings are numbered through."""
        self.blocks = np.maximum(1, -(-candidates // CANDIDATES))
        self.first = np.cumsum(self.blocks) - self.blocks

    def served(self, vectors: pa.Array, buckets: np.ndarray, home: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(place, groups) of each candidate: those of its own cell, or all of which its distance from their pivot does not rule out that they need it."""
        for lo in range(0, len(vectors), ROUTED):
            far, own = self.cells.distances(vectors.slice(lo, ROUTED), True), buckets[lo:lo + ROUTED]
            for b in np.unique(own):
                rows, groups = np.flatnonzero(own == b), self.of[int(b)]
                if home:
                    serves = far[rows].argmin(1)[:, None] == self.cell[groups]
                else:
                    d = far[np.ix_(rows, self.cell[groups])]
                    serves = (d - self.radius[groups] <= self.far[groups] + self.cells.slack) & (d + self.radius[groups] >= self.near[groups] - self.cells.slack)
                for row, s in zip(rows, serves, strict=True):
                    if s.any():
                        yield lo + int(row), groups[s]


def top(scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best ids of some rows, larger scores first, ties by id; a row's ids ascend, so k rows by their first id hold them."""
    best = rows[np.lexsort((ids[starts[rows]], -scores[rows]))[:k]]
    own = np.repeat(best, counts[best])
    at = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts[best]) - counts[best], counts[best])
    order = np.lexsort((ids[at], -scores[own]))[:k]
    return own[order], ids[at][order], scores[own[order]]


def meetings(block: pa.Table, most: float) -> Iterator[tuple[dict, np.ndarray, np.ndarray, pa.Table, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(anchor, scores of all candidates, whether their labels are its own, candidates, their ids) for vectors of each length that meet."""
    is_anchor = np.asarray(block.column("ids").is_null())
    both = [block.filter(pa.array(mask)).combine_chunks() for mask in (is_anchor, ~is_anchor)]
    if not (both[0].num_rows and both[1].num_rows):
        return
    anchors, candidates = ({x.shape[1]: (t.take(pa.array(at)), x) for at, x in by_length(t.column("v").combine_chunks())} for t in both)
    for d in anchors.keys() & candidates.keys():
        (asks, a), (have, x) = anchors[d], candidates[d]
        lists = have.column("ids").combine_chunks()
        offsets = np.asarray(lists.offsets)
        ids = (lists.values.to_numpy(zero_copy_only=False), offsets[:-1], np.diff(offsets))
        labels = np.asarray(have.column("label"))
        exact = (lambda m: m) if most < 2.0**53 else (lambda m: m.astype(np.int64))  # whole numbers below 2**53 add up exactly
        a, x = exact(a), exact(x)
        for lo in range(0, len(a), 64):
            scores = (a[lo:lo + 64] @ x.T).astype(np.int64)
            for ask, s in zip(asks.slice(lo, 64).to_pylist(), scores, strict=True):
                yield ask, s, labels == ask["label"], have, ids


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, seed: int = 3) -> DataFrame:
    """Hard negatives for the anchors' positives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has vec_id, embedding and label. Components are multiplied by
    ``scale`` and floored; scores are integer inner products, larger ones come
    first, ties by smaller vec_id. Anchors are the rows whose vec_id is divisible by
    ``every``; a positive is one of the first ``positives`` other rows of the same
    label, and its negatives are the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. The result is exact.

    One more coordinate turns inner products into distances. Pivots, a bounded
    seeded sample, part the space into Voronoi cells; the anchors of a cell (and, for
    positives, of a bucket of labels) are a group. Each anchor first meets its own
    cell, which bounds how far its positives lie; then a candidate is sent to each
    group whose radius and bound do not rule it out, and groups join exactly with
    what they got, in blocks of anchors and of candidates. The positives' scores
    then bound how near and how far negatives lie, and candidates are sent anew.

    Equal vectors of one label are one class, of which only the smallest ids can be
    in a result; anchors in it are searched once. Rows with a null id, label or
    vector, an empty vector, or a null or non-finite component take no part, nor do
    those whose squared length after scaling is 2**55 or more, as scores could pass a
    long. Zero vectors score 0. Vectors of different lengths do not meet. Rows that
    repeat id, label and vector count once; rows that repeat only the id are rows of
    their own. Fewer positives or negatives than asked for give fewer rows, an empty
    table none; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    keep = max(positives + 1, negatives)
    rows = scaled(vectors, scale).withColumn("h", F.xxhash64("label", "v"))
    first = Window.partitionBy("h", "label", "v").orderBy("vec_id")
    rows = checkpointed(rows)
    classes = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= keep)
    classes = classes.groupBy("h", "label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("norm2").alias("norm2"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    anchors = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "h", "label", "v")
    anchors = checkpointed(anchors.join(classes.select("h", "label", "v", "cid", "norm2"), ["h", "label", "v"]))
    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")
    asked = anchors.select("cid", "label", "v", "norm2").dropDuplicates(["cid"]).withColumn("bucket", bucket)
    candidates = classes.select("cid", "label", "v", "ids").withColumn("bucket", bucket)
    most = classes.agg(F.max("norm2")).first()[0] or 0.0
    wanted = min(CELLS, max(1, -(-asked.count() // PER_CELL)))
    cells = Cells([r.v for r in classes.select("v", F.xxhash64(F.lit(seed), "h").alias("o"), "cid").orderBy("o", "cid").limit(wanted).collect()], most)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = cells.distances(batch.column("v"), False)
                own = [*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))]
                yield pa.RecordBatch.from_arrays(own, [*batch.schema.names, "cell", "radius"])

    columns = "cid long, label long, v array<int>, norm2 double, bucket int"
    asked = checkpointed(asked.mapInArrow(placed, columns + ", cell int, radius double"))

    def meet(asking: DataFrame, by_label: bool, home: bool, kernel: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """Sends candidates to the groups of ``asking`` (cid, label, v, bucket, cell, radius, near, far, asks) and joins them there.

        The table of groups has a row for at most ANCHORS anchors, or for a cell and a
        bucket of labels.
        """
        asking = asking.withColumn("bucket", F.col("bucket") if by_label else F.lit(-1))
        key = ["bucket", "cell"]
        chunks = asking.groupBy(*key).agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("chunks"))
        asking = checkpointed(asking.join(F.broadcast(chunks), key).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")))  # a row for each cell and bucket
        table = asking.groupBy(*key, "chunk").agg(F.max("radius").alias("radius"), F.min("near").alias("near"), F.max("far").alias("far")).orderBy(*key, "chunk").collect()
        groups = Groups(cells, table)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(table), np.int64)
            for batch in batches:
                for _, to in groups.served(batch.column("v"), np.asarray(batch.column("bucket")), home):
                    n[to] += 1
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["g", "n"])

        met = np.zeros(len(table), np.int64)
        for r in candidates.select("v", "bucket").mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
            met[r.g] = r.n
        groups.deal(met)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, to = [], []
                cids = np.asarray(batch.column("cid"))
                for row, own in groups.served(batch.column("v"), np.asarray(batch.column("bucket")), home):
                    at.append(row)
                    to.append(groups.first[own] + cids[row] % groups.blocks[own])
                chosen = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(chosen.column(c) for c in ("cid", "label", "v", "ids")), pa.array(to, pa.list_(pa.int64()))], ["cid", "label", "v", "ids", "to"])

        sent = candidates.mapInArrow(send, "cid long, label long, v array<int>, ids array<long>, to array<long>").select(
            F.explode("to").alias("meeting"), "cid", "label", "v", "ids", F.lit(None).cast("array<long>").alias("asks"))
        spans = spark.createDataFrame([(r.bucket, r.cell, r.chunk, int(groups.first[k]), int(groups.first[k] + groups.blocks[k] - 1)) for k, r in enumerate(table)],
                                      "bucket int, cell int, chunk int, first long, last long")
        coming = asking.join(F.broadcast(spans), [*key, "chunk"]).select(  # a row for each group
            F.explode(F.sequence("first", "last")).alias("meeting"), "cid", "label", "v", F.lit(None).cast("array<long>").alias("ids"), "asks")
        return sent.unionByName(coming).groupBy("meeting").applyInArrow(kernel, schema)

    def positives_of(block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for ask, scores, same, have, ids in meetings(block, most):
            own, found, s = top(scores, np.flatnonzero(same), *ids, positives + 1)
            out += zip([ask["cid"]] * len(own), found.tolist(), np.asarray(have.column("cid"))[own].tolist(), s.tolist(), strict=True)
        return pa.table([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 4, ["cid", "vec_id", "other", "score"])

    def negatives_of(block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for ask, scores, same, _, ids in meetings(block, most):
            for p in ask["asks"]:
                fits = np.flatnonzero(~same & (100 * scores >= low * p) & (100 * scores <= high * p))
                _, found, s = top(scores, fits, *ids, negatives)
                out += zip([ask["cid"]] * len(found), [p] * len(found), found.tolist(), s.tolist(), strict=True)
        return pa.table([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 4, ["cid", "positive_score", "vec_id", "score"])

    def ranked(found: DataFrame, by: list[str], ties: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), *ties)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def away(score: Column) -> Column:
        """The distance of a candidate with that score from the anchor."""
        return F.sqrt(F.greatest(F.col("norm2") + F.lit(most) - 2 * score.cast("double"), F.lit(0.0)))

    positive_schema = "cid long, vec_id long, other long, score long"
    nothing, no_asks = F.lit(float("inf")), F.lit(None).cast("array<long>")
    at_home = meet(asked.withColumns({"near": F.lit(0.0), "far": nothing, "asks": no_asks}), True, True, positives_of, positive_schema)
    last = ranked(at_home, ["cid"], ["vec_id", "other"], positives + 1).filter(F.col("rank") == positives + 1).select("cid", "score")
    bounded = asked.join(last, "cid", "left").withColumn("far", F.coalesce(away(F.col("score")), nothing)).drop("score")
    found = meet(bounded.withColumns({"near": F.lit(0.0), "asks": no_asks}), True, False, positives_of, positive_schema)
    nearest = checkpointed(ranked(found, ["cid"], ["vec_id", "other"], positives + 1))
    # A negative score has no negatives: low * score is above high * score then.
    asks = nearest.filter("score >= 0").groupBy("cid").agg(F.sort_array(F.collect_set("score")).alias("asks"))
    limits = {"near": away(F.array_max("asks") * high / 100), "far": away(F.array_min("asks") * low / 100)}
    against = meet(asked.join(asks, "cid").withColumns(limits), False, False, negatives_of, "cid long, positive_score long, vec_id long, score long")
    hard = ranked(against, ["cid", "positive_score"], ["vec_id"], negatives)
    others = anchors.select("anchor_id", "cid").join(nearest.drop("rank"), "cid").filter("not (vec_id = anchor_id and other = cid)")
    chosen = ranked(others, ["anchor_id", "cid"], ["vec_id", "other"], positives).select("anchor_id", "cid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return chosen.join(hard, ["cid", "positive_score"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
