"""Words and word shingles as 64-bit hashes, for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
#: Distinct odd multipliers, one for each place in a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
WHITE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
#: Of each byte: 0 white space, 1 part of a word (letters, digits, _ and all of other scripts), 2 a sign.
KINDS = np.array([0 if c in WHITE else 1 if c >= 128 or chr(c).isalnum() or c == 95 else 2 for c in range(256)], np.uint8)
PLAIN = (KINDS > 0).astype(np.uint8)
#: Of each byte: a number that stands for it in a run's hash; none for white space.
NUMBERS = np.random.default_rng(17).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
NUMBERS[WHITE] = 0
FOLDED = NUMBERS.copy()
FOLDED[65:91] = FOLDED[97:123]  # A-Z as a-z
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Runs that are hashed at once.
RUNS_AT_ONCE = 200_000
POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(4095, FACTOR)])


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finaliser)."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts behind one another, and the n + 1 places where they begin and end. Null texts are empty."""
    texts = pc.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0]:edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return data, edges - edges[0]


def runs(data: np.ndarray, edges: np.ndarray, kinds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of one kind of bytes but white space, in order, and each text's number of them."""
    k = kinds[data]
    begins = np.ones(len(k), bool)
    begins[1:] = k[1:] != k[:-1]
    begins[edges[:-1][edges[:-1] < len(k)]] = True
    begins &= k != 0
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(edges) - 1, np.int64)
    edge = np.append(starts, len(k))
    hashes = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), RUNS_AT_ONCE):
        hi = min(lo + RUNS_AT_ONCE, len(starts))
        own, length = starts[lo:hi], np.diff(edge[lo:hi + 1])
        powers, longest = POWERS, int(length.max())
        if longest > len(powers):
            powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(longest - 1, FACTOR)])
        values = powers[np.arange(own[0], edge[hi]) - np.repeat(own, length)]
        values *= numbers[data[own[0]:edge[hi]]]  # white space behind a run adds nothing
        hashes[lo:hi] = mixed(np.add.reduceat(values, own - own[0]))
    return hashes, np.diff(np.searchsorted(starts, edges))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (what white space parts, A-Z in lower case) of all texts, and each text's number of words."""
    return runs(*text_bytes(texts), PLAIN, FOLDED)


def shingled(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in order of place, and each text's number of them.

    A text of n >= 5 words has n - 4; a shorter one has its whole sequence as one.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    full = np.zeros(max(len(words) - WIDTH + 1, 0), np.uint64)
    for k in range(WIDTH):
        full += words[k:len(full) + k] * PLACES[k]
    own = np.where(counts >= WIDTH, counts - WIDTH + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), own)
    place = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own)
    out = np.zeros(len(owner), np.uint64)
    long = counts[owner] >= WIDTH
    out[long] = full[place[long]]
    for at in np.flatnonzero(~long):
        n = int(counts[owner[at]])
        out[at] = (words[place[at]:place[at] + n] * PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)
    return mixed(out), own


def slices(batches: Iterator[pa.RecordBatch], text_column: int, most_bytes: int = 2_000_000, most_rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``most_bytes`` of text."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_column)), 0), dtype=np.int64)
        lo, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > lo and (held + n > most_bytes or i - lo >= most_rows):
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += n
        if batch.num_rows > lo:
            yield batch.slice(lo)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
