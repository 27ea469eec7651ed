"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandbook.llm.common import lean, ship
from strandbook.llm.shingles import KINDS, NUMBERS, runs, slices, text_bytes

#: Word vectors: hash buckets of words, dimensions, non-zero entries of an index vector, words to either side.
BUCKETS, DIMS, ENTRIES, REACH = 4_096, 32, 4, 2
#: Labelled rows that the network is fitted on, at most.
LABELLED = 20_000
#: Words that are summed up or pooled at once.
PIECE = 65_536
#: Numbers that a pooled text has beside its mean vectors.
SHAPE = 3


def index_vectors(seed: int) -> np.ndarray:
    """A sparse ternary index vector for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMS), np.int8)
    place = rng.random((BUCKETS, DIMS)).argsort(1)[:, :ENTRIES]
    out[np.arange(BUCKETS)[:, None], place] = rng.choice([-1, 1], (BUCKETS, ENTRIES))
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all tokens (runs of letters and digits, runs of signs) of all texts, and each text's number of tokens."""
    hashes, counts = runs(*text_bytes(texts), KINDS, NUMBERS)
    return (hashes % np.uint64(BUCKETS)).astype(np.uint16), counts


def add_contexts(rows: np.ndarray, t: np.ndarray, counts: np.ndarray, index: np.ndarray) -> None:
    """Adds to each token's row the index vectors of the tokens within REACH of it in the same text, a bounded piece at a time."""
    owner = np.repeat(np.arange(len(counts)), counts)
    for lo in range(0, len(t), PIECE):
        first = max(lo - REACH, 0)
        hi = min(lo + PIECE, len(t))
        own, vectors = owner[first:hi + REACH], index[t[first:hi + REACH]]
        near = np.zeros_like(vectors)
        for k in range(1, REACH + 1):
            same = (own[k:] == own[:-k]).astype(np.int8)[:, None]
            near[:-k] += vectors[k:] * same
            near[k:] += vectors[:-k] * same
        near, part = near[lo - first:hi - first], t[lo:hi]
        order = np.argsort(part, kind="stable")
        part = part[order]
        begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rows[part[begin]] += np.add.reduceat(near[order], begin, axis=0, dtype=np.int32)


def context_vectors(docs: DataFrame, seed: int) -> np.ndarray:
    """For each bucket, the sum of its neighbours' index vectors over all texts: BUCKETS x DIMS whole numbers.

    Each task sums up its own texts; only the sums, of fixed size, reach the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, index = np.zeros((BUCKETS, DIMS), np.int64), index_vectors(seed)
        for batch in slices(batches, 0):
            add_contexts(rows, *tokens(batch.column(0)), index)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(np.ascontiguousarray(rows[used, c])) for c in range(DIMS))], ["bucket", *names])

    names = [f"c{c}" for c in range(DIMS)]
    parts = docs.select("text").mapInArrow(lean(run), "bucket int, " + ", ".join(f"{n} long" for n in names))
    sums = parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((BUCKETS, DIMS))
    out[sums.column("bucket").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names], 1) if sums.num_rows else 0
    return out


def word_vectors(context: np.ndarray, seed: int) -> np.ndarray:
    """Unit context vectors without the direction that all words share, beside the words' own index vectors."""
    def unit(x: np.ndarray) -> np.ndarray:
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.where(n > 0, x / np.maximum(n, 1e-12), 0.0)

    u = unit(context)
    used = u.any(1)
    u[used] -= u[used].mean(0) if used.any() else 0
    return np.column_stack([unit(u), index_vectors(seed) / np.sqrt(ENTRIES)]).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Each text's mean word vector, and SHAPE numbers: how long each half of the sum is for so many words, and how many they are.

    Words that repeat make the sum longer than different ones do. A text without
    words has a mean of zeros. A long text is pooled piece by piece.
    """
    t, counts = tokens(texts)
    mean = np.zeros((len(counts), vectors.shape[1]))
    owner = np.repeat(np.arange(len(counts)), counts)
    for lo in range(0, len(t), PIECE):
        own = owner[lo:lo + PIECE]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        mean[own[begin]] += np.add.reduceat(vectors[t[lo:lo + PIECE]], begin, axis=0, dtype=np.float32)
    n = np.maximum(counts, 1)
    mean /= n[:, None]
    lengths = [np.log((half * half).sum(1) * n + 0.01) for half in (mean[:, :DIMS], mean[:, DIMS:])]
    return np.column_stack([mean, *lengths, np.log(n)])


@dataclass
class Network:
    """Two layers and a temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int, hidden: int = 16, rounds: int = 400, rate: float = 0.02, decay: float = 1e-4) -> Network:
    """Adam on the log loss of four fifths of the rows; the other fifth sets the temperature."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    net = Network(x.mean(0) if len(x) else np.zeros(d), np.maximum(x.std(0), 1e-3) if len(x) else np.ones(d), rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), np.zeros(hidden), 0.0)
    if not len(x) or y.min() == y.max():  # nothing to tell apart
        net.b2 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return net
    order = rng.permutation(len(x))
    aside, own = order[:len(x) // 5], order[len(x) // 5:]
    z, t = (x[own] - net.shift) / net.scale, y[own]
    m, v = [0.0] * 4, [0.0] * 4
    for k in range(1, rounds + 1):
        h = np.tanh(z @ net.w1 + net.b1)
        e = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40))) - t) / len(t)
        back = np.outer(e, net.w2) * (1 - h * h)
        grads = [z.T @ back + decay * net.w1, back.sum(0), h.T @ e + decay * net.w2, e.sum()]
        step = []
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            step.append(rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8))
        net.w1, net.b1, net.w2, net.b2 = net.w1 - step[0], net.b1 - step[1], net.w2 - step[2], float(net.b2 - step[3])
    if len(aside):
        logit, t = net.logits(x[aside]), y[aside]
        loss = lambda temperature: np.logaddexp(0, np.where(t == 1, -logit, logit) / temperature).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))
    return net


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 4, is 2. Null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, seed: int = 3, most: int = LABELLED) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts, and the network from at most ``most`` labelled ones.

    ``labels`` has doc_id and quality (0 or 1; other values are ignored, and of
    contradicting labels 0 counts). If more are labelled, a seeded choice is taken.
    """
    ship(docs.sparkSession)
    vectors = word_vectors(context_vectors(docs, seed), seed)
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
    )
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = pooled(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(lean(run), f"doc_id {kind}, quality int, x array<double>")
    rows = rows.orderBy("doc_id", "x").limit(most).toArrow()  # at most ``most`` rows of 2 * DIMS + SHAPE numbers
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, vectors.shape[1] + SHAPE))
    return vectors, fit(x, rows.column("quality").to_numpy().astype(np.float64), seed)


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """``docs`` with ``score``: how likely the whole text is of label 1. A column of that name is replaced."""
    ship(docs.sparkSession)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            scores = shared.value[1].scores(pooled(batch.column(at), shared.value[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, seed: int = 3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where score >= ``threshold``).

    The score depends on the text alone. Null and empty texts, which have no
    words, get the score of the zero vector. Repeated rows get equal scores.
    Without labels of both kinds the score is one constant. Empty tables give no rows.
    """
    vectors, network = train(docs, labels, seed)
    return score(docs, vectors, network).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
