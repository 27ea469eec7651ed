"""Near-duplicate passages across documents, by compact windows of token min-hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbook.llm.common import WORD, checkpointed, either_way, lean, meetings, ship, shuffle_width, sized, written
from strandbook.llm.shingles import WIDTH, mixed, shingled, signed, slices, word_hashes

WINDOW_ROWS_PER_TASK = 1_000_000
#: Windows that a task groups at once before they are shuffled, and bytes of text that it cuts into shingles at once.
GROUPED_AT_ONCE, BYTES_AT_ONCE = 300_000, 1_000_000
#: Shingles in a row that seed a near passage, seeds in a row that make a run, and words that two runs may lie apart.
SEED, SEEDS, GAP = 8, 4, 24
FACTOR, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def compact_windows(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, ties: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compact windows (left, centre, right) of at least ``least`` places of each segment [lo, hi).

    The Cartesian trees of all segments are walked level by level: a segment's
    minimum is its centre, every subsequence that holds the centre shares that
    min-hash, and the parts beside it are the next level's segments. ``ties``
    gets all places of the segments' minima, of which only one is a centre.
    """
    out = []
    while len(lo):
        wide = hi - lo >= least
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            break
        edges = np.stack([lo, hi], 1).ravel()
        open_end = edges[-1] == len(values)
        low = np.minimum.reduceat(np.append(values, np.uint64(2**64 - 1)) if open_end else values, edges)[::2]
        owner = np.repeat(np.arange(len(lo)), hi - lo)
        at = np.repeat(lo, hi - lo) + np.arange(len(owner)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        equal = np.flatnonzero(values[at] == low[owner])
        if ties is not None:
            ties.append(at[equal])
        begin = np.flatnonzero(np.r_[True, owner[equal[1:]] != owner[equal[:-1]]])
        hit = at[equal[begin + np.diff(np.r_[begin, len(equal)]) // 2]]  # the middle one of equal minima keeps the tree low
        out.append((lo, hit, hi - 1))
        lo, hi = np.concatenate([lo, hit + 1]), np.concatenate([hit, hi])
        order = np.argsort(lo, kind="stable")  # reduceat wants ascending segments
        lo, hi = lo[order], hi[order]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _running_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for every i; shorter at the end."""
    done, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        done[:-step] = np.minimum(done[:-step], done[step:]) if step else done[:-step]
        have += step
    return done


def text_key(text: str = "text") -> Column:
    """Tells the texts of one doc_id apart."""
    return F.hash(text)


WINDOW = ["signature", "before", "after", "doc_id", "text_key", "place"]
LINK = ["a", "a_key", "b", "b_key", "in_b", "lo", "hi"]
ROW = [*WINDOW, *LINK[2:]]
ROW_SCHEMA = "signature long, before int, after int, doc_id long, text_key int, place int, b long, b_key int, in_b boolean, lo int, hi int"


def _linked(signature: np.ndarray, side: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray, reach: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Links of the windows that share a signature and a side with an earlier text: LINK columns, and the rows that they cover.

    The first text of such a group is linked to each of the others. A link has
    the stretches of places in both texts; places within ``reach`` of each other make one.
    """
    rows = np.flatnonzero(side)
    order = rows[np.argsort(signature[rows], kind="stable")]
    s = signature[order]  # most signatures are one text's alone
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:].copy()
    order = order[same]
    order = order[np.lexsort([place[order], key[order], doc[order], side[order], signature[order]])]
    if not len(order):
        return [], order
    s, w, d, k, p = signature[order], side[order], doc[order], key[order], place[order]
    group = np.r_[True, (s[1:] != s[:-1]) | (w[1:] != w[:-1])]
    text = group | np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])]
    stretch = text | np.r_[True, np.diff(p) > reach]
    begin = np.flatnonzero(stretch)
    lo, hi = p[begin], p[np.r_[begin[1:], len(p)] - 1]
    lead = np.maximum.accumulate(np.where(group, np.arange(len(p)), 0))  # the row of the group's first text
    leads = (d == d[lead]) & (k == k[lead])
    of_group = np.cumsum(group) - 1
    later = begin[~leads[begin]]
    if not len(later):
        return [], order[:0]
    own = [d[lead[later]], k[lead[later]], d[later], k[later], np.ones(len(later), bool), lo[~leads[begin]], hi[~leads[begin]]]
    # The leading text's stretches, once for each other text of the group.
    first = begin[leads[begin]]
    others = np.flatnonzero(text & ~leads)
    at = np.searchsorted(of_group[first], of_group[others], "left")
    many = np.searchsorted(of_group[first], of_group[others], "right") - at
    x = np.repeat(others, many)
    y = np.repeat(at - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(x))
    theirs = [d[lead[x]], k[lead[x]], d[x], k[x], np.zeros(len(x), bool), lo[leads[begin]][y], hi[leads[begin]][y]]
    return [np.concatenate(z) for z in zip(own, theirs, strict=True)], order[~leads]


def _link_batch(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Links as rows of ROW, each once."""
    found = [x for x in found if x]
    if found:
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]
        a, a_key, b, b_key, in_b, lo, hi = (c[new] for c in columns)
        no = pa.nulls(len(a), pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(a), pa.int64()), no, no, pa.array(a), pa.array(a_key.astype(np.int32)), no, pa.array(b), pa.array(b_key.astype(np.int32)), pa.array(in_b),
            pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ROW)


def _windows(docs: DataFrame, least: int, hashes: int) -> DataFrame:
    """Rows of ROW: windows (WINDOW columns), one for each place of a compact window's minimum, and links of windows that a task holds itself.

    ``signature`` is the window's min-hashed shingle. ``before`` and ``after``
    sum up the shingles on either side of it (0: too few): a passage of the least
    length reaches at least half its length to one side, and there two near
    halves' min-hashes agree. Of equal minima each is a row, as which of them is
    the centre depends on the text around the passage. Windows of a task that
    share a signature and a side are linked to the first text among them, and
    only that one's windows go on to the shuffle, so that no passage is shuffled
    by all documents that have it.
    """
    half = least // 2
    near, far = half // 2, half - half // 2

    def grouped(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        signature, before, after, doc, key, place = (np.concatenate(x) for x in zip(*held, strict=True))
        found = []
        for side in (before, after):
            links, covered = _linked(signature, side, doc, key, place, least)
            found.append(links)
            side[covered] = 0
        yield from _link_batch(found)
        left = (before != 0) | (after != 0)
        if left.any():
            n = int(left.sum())
            no = pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[left]) for x in (signature, before, after, doc, key, place)), pa.nulls(n, pa.int64()), no, pa.nulls(n, pa.bool_()), no, no], ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in slices(batches, 2, BYTES_AT_ONCE):
            values, own = shingled(*word_hashes(batch.column(2)))
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            end = np.cumsum(own)
            start = end - own
            if not len(values):
                continue
            owner = np.repeat(np.arange(len(own)), own)
            lone = mixed(values, 101)
            a, b = _running_min(lone, near), _running_min(lone, far)

            def side(begin_near: np.ndarray, begin_far: np.ndarray, ok: np.ndarray) -> np.ndarray:
                x = np.zeros(len(ok), np.int32)
                x[ok] = (mixed(a[begin_near[ok]], 1) ^ mixed(b[begin_far[ok]], 2)).astype(np.uint32).view(np.int32) | 1
                return x

            for k in range(hashes):
                h = mixed(values, 11 + k)
                ties: list[np.ndarray] = []
                compact_windows(h, start, end, least, ties)
                c = np.unique(np.concatenate(ties)) if ties else np.zeros(0, np.int64)
                s, e = start[owner[c]], end[owner[c]]
                before = side(c - near, c - near - far, c - near - far >= s)
                after = side(np.minimum(c + 1, len(h) - 1), np.minimum(c + 1 + near, len(h) - 1), c + near + far < e)
                some = (before != 0) | (after != 0)
                c, before, after = c[some], before[some], after[some]
                held.append([signed(mixed(values[c], 1000 + k)), before, after, ids[owner[c]], keys[owner[c]], (c - start[owner[c]]).astype(np.int32)])
                many += len(c)
            if many > GROUPED_AT_ONCE:
                yield from grouped(held)
                held, many = [], 0
        if many:
            yield from grouped(held)

    return docs.select("doc_id", "text_key", "text").mapInArrow(lean(run), ROW_SCHEMA)


def _links(rows: DataFrame, least: int, width: int) -> DataFrame:
    """(hub, member, a, a_key, b, b_key, stretches): pairs of texts a before b whose windows share a signature and a side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.select(WINDOW) for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            signature, before, after, doc, key, place = (t.column(c).to_numpy() for c in WINDOW)
            yield from _link_batch([_linked(signature, side, doc, key, place, least)[0] for side in (before, after)])

    far = rows.filter("signature is not null").select(*WINDOW).repartition(width, "signature").mapInArrow(lean(run), ROW_SCHEMA)
    links = far.unionByName(rows.filter("signature is null")).select(F.col("doc_id").alias("a"), F.col("text_key").alias("a_key"), *LINK[2:])
    return links.groupBy("a", "a_key", "b", "b_key").agg(F.collect_set(F.struct("in_b", "lo", "hi")).alias("stretches"))


def grams(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` values in a row, one for each place where they begin."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, FACTOR, np.uint64)])
    down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - width, INVERSE, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(values * up, dtype=np.uint64)]
    return mixed((sums[width:] - sums[:n - width + 1]) * down)


class Passage:
    """A text's shingles, and its hashes of as many as the least passage has and of as many as seed a near one."""

    def __init__(self, shingles: np.ndarray, least: int):
        self.shingles = shingles
        self.whole, self.seeds = grams(shingles, least), grams(shingles, min(SEED, least))
        self.sorted_whole = np.unique(self.whole)
        order = np.argsort(self.seeds, kind="stable")
        seeds = self.seeds[order]
        begin = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1]]) if len(seeds) else np.zeros(0, np.int64)
        self.known, self.first = seeds[begin], order[begin]
        self.last = order[np.r_[begin[1:], len(seeds)] - 1] if len(seeds) else order

    def has(self, grams_: np.ndarray) -> np.ndarray:
        if not len(self.sorted_whole):
            return np.zeros(len(grams_), bool)
        return self.sorted_whole[np.minimum(np.searchsorted(self.sorted_whole, grams_), len(self.sorted_whole) - 1)] == grams_


def spread(places: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` places lie in [p, p + width) for one of ``places``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, np.minimum(places + width, n), -1)
    return np.cumsum(steps[:-1]) > 0


def _chains(runs: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Runs (start, start, shingles) with small gaps in both texts, each linked to the longest chain that it goes on; those that nothing goes on."""
    score, back, inner = [], [], [False] * len(runs)
    for k, (i, j, n) in enumerate(runs):
        best, link = 0, -1
        for r in range(k - 1, -1, -1):
            p, q, m = runs[r]
            if j - q - m > GAP:
                break
            if p < i and -SEED <= i - p - m <= GAP and score[r] > best:
                best, link = score[r], r
        score.append(n + best)
        back.append(link)
        if link >= 0:
            inner[link] = True
    for k in range(len(runs)):
        if not inner[k]:
            chain, r = [], k
            while r >= 0:
                chain.append(runs[r])
                r = back[r]
            yield chain[::-1]


def near_passages(x: Passage, y: Passage, least: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """Near-equal stretches of two texts' shingles (start, end, start, end), made of several runs.

    Each seed of y is taken at the first, then at the last of its places in x.
    Seeds in a row make runs, and runs with small gaps make chains. A chain counts
    if both sides have ``least`` shingles and their sets' Jaccard similarity
    suffices; else it loses its shorter outer runs until it does.
    """
    if not len(x.known) or not len(y.seeds):
        return []
    at = np.minimum(np.searchsorted(x.known, y.seeds), len(x.known) - 1)
    j = np.flatnonzero(x.known[at] == y.seeds)
    out = []
    for places in (x.first, x.last):
        i = places[at[j]]
        if not len(j) or places is x.last and (i == x.first[at[j]]).all():
            break
        begin = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1)])
        many = np.diff(np.r_[begin, len(j)])
        long = many >= SEEDS
        begin, many = begin[long], many[long] + min(SEED, least) - 1
        if len(begin) < 2:
            continue
        for chain in _chains(list(zip(i[begin].tolist(), j[begin].tolist(), many.tolist(), strict=True))):
            lo, hi = 0, len(chain)
            while hi - lo > 1:
                a, c, _ = chain[lo]
                b, d = max(p + n for p, _, n in chain[lo:hi]), max(q + n for _, q, n in chain[lo:hi])
                if min(b - a, d - c) < least:
                    break
                u, v = np.unique(x.shingles[a:b]), np.unique(y.shingles[c:d])
                common = len(np.intersect1d(u, v, assume_unique=True))
                if common >= similarity * (len(u) + len(v) - common):
                    out.append((a, b, c, d))
                    break
                if chain[lo][2] < chain[hi - 1][2]:
                    lo += 1
                else:
                    hi -= 1
    return out


def shared_words(x: Passage, y: Passage, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which words of each text lie in a passage that both share: exactly and ``least`` shingles long at least, or nearly."""
    n, m = len(x.shingles) + WIDTH - 1, len(y.shingles) + WIDTH - 1
    in_x = spread(np.flatnonzero(y.has(x.whole)), n, least + WIDTH - 1)
    in_y = spread(np.flatnonzero(x.has(y.whole)), m, least + WIDTH - 1)
    if not (in_x.all() and in_y.all()):
        for a, b, c, d in near_passages(x, y, least, similarity):
            in_x[a:b + WIDTH - 1] = True
            in_y[c:d + WIDTH - 1] = True
    return in_x, in_y


def spans_of(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of true begin and end."""
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    return edge[::2], edge[1::2]


FOUND = ["doc_id", "text_key", "first_doc_id", "repeated", "start_word", "end_word", "gram"]


def _verified(pairs: DataFrame, n: int, texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """Rows of FOUND: the passages that pairs really share, and the hashes of least passages (gram) near their windows that only one of both has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, lead, own, covered, told, near = None, None, None, None, None, None

        def rows(doc: int, key: int, first: int, repeated: bool, words: np.ndarray) -> list[tuple]:
            return [(doc, key, first, repeated, s, e, None) for s, e in zip(*(z.tolist() for z in spans_of(words)), strict=True)]

        def lone(doc: int, key: int, hashes: np.ndarray, places: np.ndarray) -> list[tuple]:
            return [(doc, key, None, None, None, None, g) for g in signed(np.unique(hashes[places])).tolist()]

        def ended() -> list[tuple]:
            if lead is None:
                return []
            return rows(*own, own[0], False, covered) + lone(*own, lead.whole, np.flatnonzero(told[:len(lead.whole)]))

        for batch in slices(batches, 3, BYTES_AT_ONCE):
            values, counts = shingled(*word_hashes(batch.column(3)))
            end = np.cumsum(counts)
            columns = [batch.column(c).to_pylist() for c in ("hub", "block", "member", "a", "a_key", "b", "b_key", "stretches")]
            out: list[tuple] = []
            for k, (key, block, member, a, a_key, b, b_key, stretches) in enumerate(zip(*columns, strict=True)):
                if a is not None:  # what belongs to the text that follows
                    near = (a, a_key, b, b_key, stretches)
                    continue
                text = Passage(values[end[k] - counts[k]:end[k]], least)
                if member is None:
                    if (key, block) != hub:
                        out += ended()
                        hub, lead, own = (key, block), text, None
                        covered, told = np.zeros(len(text.shingles) + WIDTH - 1, bool), np.zeros(len(text.shingles), bool)
                    continue
                if (key, block) != hub:
                    continue
                a, a_key, b, b_key, stretches = near
                own = (a, a_key)
                in_x, in_y = shared_words(lead, text, least, similarity)
                covered |= in_x
                out += rows(b, b_key, a, True, in_y)
                near_x, near_y = np.zeros(len(lead.whole), bool), np.zeros(len(text.whole), bool)
                for x in stretches or ():
                    (near_y if x["in_b"] else near_x)[max(x["lo"] - least + 1, 0):x["hi"] + 1] = True
                told[:len(near_x)] |= near_x & ~text.has(lead.whole)
                out += lone(b, b_key, text.whole, np.flatnonzero(near_y & ~lead.has(text.whole)))
            arrays = zip(*out, strict=True) if out else [[]] * len(FOUND)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(arrays, kinds, strict=True)], FOUND)
        if lead is not None and (out := ended()):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], FOUND)

    met = meetings(pairs, n, texts, -(-n // 20_000))
    return met.mapInArrow(lean(run), "doc_id long, text_key int, first_doc_id long, repeated boolean, start_word long, end_word long, gram long")


def repeated_passages(docs: DataFrame, least_words: int = 50, similarity: float = 0.75, hashes: int = 4) -> DataFrame:
    """Passages of at least ``least_words`` words that repeat in another document.

    One row for each passage: ``doc_id``, ``text_key`` (tells texts of one id
    apart), ``start_word``, ``end_word`` (exclusive), ``n_words``,
    ``first_doc_id`` (smallest document that it was held against) and
    ``repeated``: false on the earlier side of a match, true where an earlier
    document (smaller doc_id) has the passage. Overlapping passages of a document
    are merged, those that are repeated apart from those that are not.

    Equal texts are one class: its smallest doc_id stands for it, and the others
    repeat it as a whole if long enough. For the rest, subsequences of 5-word
    shingles are grouped by ``hashes`` min-hashes into compact windows. Windows
    with an equal signature and equal min-hashes on one side of it are linked to
    the first text among them, so a passage in n documents makes n - 1 pairs.
    Each pair's whole texts are then compared: exact passages by the hashes of all
    their least stretches, near ones by runs of shingles whose sets are similar
    enough. An exactly repeated passage always shares a window, whatever the
    seeds. Where a linked pair does not share all that lies around a window, the
    stretches that only one of both has are grouped by their own hashes, and
    those with an equal one are compared too; so every word of an exact repeat of
    any earlier document is found. Near repeats are found where a single window
    agrees with the first text's.

    Null doc_ids take no part; null and empty texts have no passages. Texts of one
    doc_id are held against each other as any others are; repeated rows count
    once. Empty tables give no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    least = least_words - WIDTH + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    key = ["text_hash", "text_check", "text_bytes"]
    hashed = docs.withColumns({"text_hash": F.xxhash64("text"), "text_check": F.crc32(F.col("text").cast("binary")), "text_bytes": F.octet_length("text")})
    classes = hashed.groupBy(*key).agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies")).filter("copies > 1")
    classes = either_way(checkpointed(classes))
    n_words = F.regexp_count("text", F.lit(WORD)).cast("long")
    known = ["doc_id", text_key().alias("text_key")]
    copies = checkpointed(hashed.join(classes, key).filter("doc_id != first_doc_id").select(*known, "first_doc_id", n_words.alias("n")).distinct())
    alone = docs.withColumn("text_key", text_key())
    alone = alone.join(either_way(copies.select("doc_id", "text_key")), ["doc_id", "text_key"], "left_anti")
    texts = alone.select(F.xxhash64("doc_id", "text_key").alias("key"), "text")
    width = shuffle_width(docs, docs.count() * 24 * hashes, WINDOW_ROWS_PER_TASK)
    ends = {"hub": F.xxhash64("a", "a_key"), "member": F.xxhash64("b", "b_key")}
    pairs, n = sized(_links(_windows(alone, least, hashes), least, width).withColumns(ends), 20_000)
    found = written(_verified(pairs, n, texts, least, similarity))
    lone = found.filter("gram is not null").select("gram", "doc_id", "text_key")
    text = F.struct("doc_id", "text_key")
    first = lone.groupBy("gram").agg(F.min(text).alias("first"), F.max(text).alias("last")).filter("first != last").drop("last")
    again = lone.join(first, "gram").select(F.col("first.doc_id").alias("a"), F.col("first.text_key").alias("a_key"), F.col("doc_id").alias("b"), F.col("text_key").alias("b_key"))
    again = again.filter("a != b or a_key != b_key").distinct().withColumns(ends | {"stretches": F.lit(None).cast(pairs.schema["stretches"].dataType)})
    more, n = sized(again.join(pairs.select("hub", "member"), ["hub", "member"], "left_anti").select(*pairs.columns), 20_000)
    if n:
        found = found.unionByName(written(_verified(more, n, texts, least, similarity)))
    spans = found.filter("gram is null").drop("gram").distinct()
    repeats = copies.filter(F.col("n") >= least_words)
    whole = repeats.select("doc_id", "text_key", "first_doc_id", F.lit(True).alias("repeated"), F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"))
    origin = repeats.groupBy("first_doc_id", "text_key").agg(F.max("n").alias("end_word"))
    origin = origin.select(F.col("first_doc_id").alias("doc_id"), "text_key", "first_doc_id", F.lit(False).alias("repeated"), F.lit(0).cast("long").alias("start_word"), "end_word")
    spans = spans.unionByName(whole).unionByName(origin)
    inside = Window.partitionBy("doc_id", "text_key", "repeated").orderBy("start_word", "end_word", "first_doc_id")
    reach = F.max("end_word").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start_word") < reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "text_key", "repeated", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_doc_id").alias("first_doc_id"))
    return merged.select("doc_id", "text_key", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id", "repeated")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, end) and the white space behind each."""
    places = [m.start() for m in re.finditer(WORD, text)] + [len(text)]
    out, at = [], 0
    for s, e in sorted(spans):
        s, e = max(s, at), min(e, len(places) - 1)
        if s < e:
            out.append(text[places[at] if at else 0:places[s]])
            at = e
    return "".join([*out, text[places[at] if at else 0:]]).rstrip() if at else text


def without_repeats(docs: DataFrame, least_words: int = 50, similarity: float = 0.75, hashes: int = 4) -> DataFrame:
    """``docs`` without repeated passages: each stays in the earliest document that has it.

    ``text`` loses the passages' words, ``n_chars`` (where present) counts what
    is left, and documents of which no word is left go. Each text of a repeated
    doc_id loses its own passages only; rows without doc_id or text stay as they
    are, and rows that repeat an id and a text stay both. All columns stay.
    """
    spans = repeated_passages(docs, least_words, similarity, hashes).filter("repeated")
    key, cuts_, text_ = "_id_of_cuts", "_cuts", "_key_of_cuts"
    cuts = spans.groupBy(F.col("doc_id").alias(key), F.col("text_key").alias(text_)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cuts_))
    cuts = checkpointed(cuts)
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            cut = batch.column(cuts_).to_pylist()
            texts = [
                t if not c or t is None else without_spans(t, [(x["start_word"], x["end_word"]) for x in c])
                for t, c in zip(batch.column("text").to_pylist(), cut, strict=True)
            ]
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                counts = [len(t) if c and t is not None else n for t, c, n in zip(texts, cut, batch.column("n_chars").to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(counts, batch.column("n_chars").type)
            keep = [not c or bool(t.split()) for t, c in zip(texts, cut, strict=True)]
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(keep, pa.bool_()))

    keyed = docs.withColumns({key: F.col("doc_id").cast("long"), text_: text_key()})
    return keyed.join(either_way(cuts), [key, text_], "left").select(*names, cuts_).mapInArrow(lean(run), schema)
