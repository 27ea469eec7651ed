"""Exact Jaccard self-join of documents over word shingles, by set-relation skipping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandbook.llm.common import checkpointed, connected_components, either_way, lean, meetings, ship, shuffle_width, sized
from strandbook.llm.shingles import shingled, signed, slices, word_hashes

#: Frequent shingles that are put last in the order; any order gives right results.
ORDERED = 400_000
#: Shingles that a task counts at once to find those that are frequent.
COUNTED_AT_ONCE = 1_000_000
#: Index lists up to this length are joined block by block at once; longer ones go by leaders first.
SHORT_LIST = 8
#: Documents of a frequent shingle whose index entries go to one task, about.
HOT_LIST = 50_000
#: Sets of a long list that one task holds against one another or against as many others.
LIST_BLOCK = 4_096
PREFIX_ROWS_PER_TASK, OPEN_ROWS_PER_TASK = 1_000_000, 50_000
#: Bits of a set's parity map, at least; two maps' difference bounds the sets' difference from below.
LEAST_BITS = 1_024
#: Rounds in which a set meets one other in each of a few lists, before all that are still apart meet in all lists.
ROUNDS, LISTS_A_TURN = 3, 4


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of such sizes that meets the threshold."""
    return -(-percent * (na + nb) // (100 + percent))


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingles in ascending order."""
    hashes, own = shingled(*word_hashes(texts))
    return [np.unique(x) for x in np.split(hashes, np.cumsum(own)[:-1])] if len(own) else []


def signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0


def parity_map(s: np.ndarray) -> bytes:
    """One bit for each hash bucket: whether an odd number of the set falls there. Larger sets have larger maps."""
    bits = max(LEAST_BITS, 1 << (2 * len(s)).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Buckets in which two maps differ: no more than the sets' elements that only one of them has."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    length = min(len(u), len(v))
    return int(np.bitwise_count(_folded(u[None, :], length) ^ _folded(v[None, :], length)).sum())


def _summaries(docs: DataFrame) -> DataFrame:
    """A row (kind 0) for each document: n, sig; and rows (kind 1) of shingles that several documents of a task have, with counts."""

    names = ["kind", "doc_id", "text_key", "n", "sig"]

    def shared(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.sort(np.concatenate(held))
        begin = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        times = np.diff(np.r_[begin, len(every)])
        every, times = every[begin[times > 1]], times[times > 1]
        if len(every):
            none = pa.nulls(len(every), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(every), np.int8)), none, none, pa.array(times), pa.array(signed(every))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in slices(batches, 2):
            sets = sets_of(batch.column(2))
            sig = np.array([signature(s) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(len(sets), np.int8)), batch.column(0), batch.column(1),
                pa.array(np.fromiter(map(len, sets), np.int64, len(sets))), pa.array(signed(sig))], names)
            held += sets
            many += sum(map(len, sets))
            if many > COUNTED_AT_ONCE:
                yield from shared(held)
                held, many = [], 0
        if held:
            yield from shared(held)

    return docs.select("doc_id", "text_key", "text").mapInArrow(lean(run), "kind tinyint, doc_id long, text_key long, n long, sig long")


def _prefixes(docs: DataFrame, frequent: np.ndarray, times: np.ndarray, percent: int) -> DataFrame:
    """The index entries (shingle, deal, sig, n, place) of every distinct set's prefix.

    Rare shingles come first: the order is by hash, with ``frequent`` (rarest
    first) behind all others. Two sets that meet the threshold share a shingle
    of both prefixes. ``deal`` parts the entries of a shingle that very many
    documents have.
    """
    order = np.argsort(frequent)
    deals = np.maximum(-(-times // HOT_LIST), 1)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.int64), deals[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (often, rank, parts) = set(), shared.value
        low = np.zeros(1 << 22, bool)  # most shingles are not frequent, and need no search
        low[(often & np.uint64(len(low) - 1)).astype(np.int64)] = True
        for batch in slices(batches, 0):
            out: list[tuple[np.ndarray, np.ndarray, int, int]] = []
            for s in sets_of(batch.column(0)):
                sig = signature(s)
                if not len(s) or sig in seen:
                    continue
                if len(seen) < 1_000_000:  # what is forgotten is only sent again
                    seen.add(sig)
                n = len(s)
                most = n - -(-percent * n // 100) + 1
                deal = np.zeros(most, np.int32)
                maybe = np.flatnonzero(low[(s & np.uint64(len(low) - 1)).astype(np.int64)])
                if len(maybe):
                    at = np.minimum(np.searchsorted(often, s[maybe]), len(often) - 1)
                    hot = often[at] == s[maybe]
                    maybe, at = maybe[hot], at[hot]
                    by_rank = np.argsort(rank[at])
                    s = np.concatenate([np.delete(s, maybe), s[maybe[by_rank]]])
                    late = at[by_rank][:max(most - (n - len(maybe)), 0)]
                    deal[most - len(late):] = np.where(parts[late] > 1, 1 + (sig >> 32) % parts[late], 0)
                out.append((s[:most], deal, sig, n))
            if out:
                sizes = np.array([len(p) for p, _, _, _ in out])
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(np.concatenate([p for p, _, _, _ in out]))),
                    pa.array(np.concatenate([d for _, d, _, _ in out])),
                    pa.array(signed(np.repeat(np.array([x for _, _, x, _ in out], np.uint64), sizes))),
                    pa.array(np.repeat(np.array([x for _, _, _, x in out], np.int32), sizes)),
                    pa.array(place.astype(np.int32))], ["shingle", "deal", "sig", "n", "place"])

    return docs.select("text").mapInArrow(lean(run), "shingle long, deal int, sig long, n int, place int")


def _whole(batches: Iterator[pa.RecordBatch], *sort: str) -> dict[str, np.ndarray] | None:
    """A task's rows, sorted, as arrays."""
    t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if t is None or not t.num_rows:
        return None
    cols = {c: t.column(c).to_numpy() for c in t.column_names}
    order = np.lexsort([cols[c] for c in reversed(sort)])
    return {c: x[order] for c, x in cols.items()}


def _passes(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries i and j of one list can be the first shingle that two linked sets share: by sizes, then by places."""
    return np.minimum(n[i] - place[i], n[j] - place[j]) >= needed(n[i].astype(np.int64), n[j].astype(np.int64), percent)


LISTED = ["hub", "member", "shingle", "n", "place"]


def _lists(entries: DataFrame, percent: int, width: int) -> DataFrame:
    """Candidate pairs (hub, member) from the index lists, and the entries (hub, null, shingle, n, place) of long lists.

    A list is sorted by size. In a short list all blocks of sizes that the
    threshold allows are joined, the others skipped, and so are places from which
    too little is left. In a long list the first set leads the block of sizes up
    to its limit, then the next first set leads the next block; only pairs with
    leaders are made, so a list makes fewer pairs than it has entries. A dealt
    list counts as long and makes its leaders part by part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = _whole(batches, "shingle", "deal", "n", "sig")
        if cols is None:
            return
        shingle, deal, sig, n, place = (cols[c] for c in ("shingle", "deal", "sig", "n", "place"))
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (sig[1:] != sig[:-1])  # the same set from several tasks
        shingle, deal, sig, n, place = shingle[new], deal[new], sig[new], n[new], place[new]
        starts = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (deal[1:] != deal[:-1])])
        sizes = np.diff(np.r_[starts, len(shingle)])
        whole = deal[starts] == 0
        pairs = []
        for size in range(2, SHORT_LIST + 1):
            at = starts[(sizes == size) & whole]
            for i in range(size):
                for j in range(i + 1, size):
                    ok = _passes(n, place, at + i, at + j, percent)
                    pairs.append((at[ok] + i, at[ok] + j))
        long = np.flatnonzero((sizes > SHORT_LIST) | ~whole)
        for k in long:
            lo, hi = starts[k], starts[k] + sizes[k]
            while lo < hi - 1:
                end = lo + np.searchsorted(n[lo:hi], n[lo] * 100 // percent, side="right")
                members = np.arange(lo + 1, end)
                pairs.append((np.full(len(members), lo), members))
                lo = end
        if pairs:
            both = np.unique(np.stack([sig[np.concatenate([x for x, _ in pairs])], sig[np.concatenate([x for _, x in pairs])]], 1), axis=0)
            none = pa.nulls(len(both), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64()), none, none], LISTED)
        if len(long):
            rows = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in long])
            yield pa.RecordBatch.from_arrays([pa.array(sig[rows]), pa.nulls(len(rows), pa.int64()), pa.array(shingle[rows]), pa.array(n[rows]), pa.array(place[rows])], LISTED)

    return entries.repartition(width, "shingle", "deal").mapInArrow(lean(run), "hub long, member long, shingle long, n int, place int")


def _folded(maps: np.ndarray, length: int) -> np.ndarray:
    """Parity maps (rows of 64-bit words) folded to ``length`` words, which keeps the parities."""
    while maps.shape[1] > length:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _across(entries: DataFrame, percent: int, width: int, turn: int) -> DataFrame:
    """Candidate pairs (hub, member, n_hub, n_member) of lists' blocks, of sets that no link has joined yet (column ``component``).

    Pairs that their sizes, places or parity maps rule out are left out. In a
    numbered turn each set meets only the first other one that is left, in an
    order that each number deals anew; a few such turns join most of what
    belongs together. In turn 0 all pairs that are left are made.
    """
    names = ["hub", "member", "n_hub", "n_member"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = _whole(batches, "shingle", "one", "other", *(["deal"] if turn else []), "n", "sig")
        if cols is None:
            return
        sig, n, place, part, side = (cols[c] for c in ("sig", "n", "place", "component", "side"))
        starts = np.flatnonzero(np.r_[True, np.any([cols[c][1:] != cols[c][:-1] for c in ("shingle", "one", "other")], axis=0)])
        found = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(sig)], strict=True):
            if (part[lo:hi] == part[lo]).all():
                continue
            raw = [np.frombuffer(m, np.uint64)[1:] for m in cols["map"][lo:hi]]
            sizes = np.array([len(m) for m in raw])
            by_size = {length: (np.flatnonzero(sizes >= length), _stack(raw, sizes, length)) for length in np.unique(sizes).tolist()}
            for i in range(hi - lo - 1):
                j = np.arange(i + 1, hi - lo) if turn else np.arange(i + 1, np.searchsorted(n[lo:hi], n[lo + i] * 100 // percent, side="right"))
                j = j[(part[lo + j] != part[lo + i]) & ((cols["one"][lo] == cols["other"][lo]) | (side[lo + j] != side[lo + i]))]
                j = j[_passes(n[lo:hi], place[lo:hi], np.full(len(j), i), j, percent)]
                if not len(j):
                    continue
                apart = np.empty(len(j), np.int64)
                for length in np.unique(np.minimum(sizes[j], sizes[i])).tolist():
                    own, maps = by_size[length]
                    which = np.flatnonzero(np.minimum(sizes[j], sizes[i]) == length)
                    apart[which] = np.bitwise_count(maps[np.searchsorted(own, j[which])] ^ maps[np.searchsorted(own, i)]).sum(1, dtype=np.int64)
                both = n[lo + j].astype(np.int64) + n[lo + i]
                j = j[(both - apart) // 2 >= needed(n[lo + j].astype(np.int64), np.int64(n[lo + i]), percent)]
                j = j[:1] if turn else j
                found.append(np.stack([np.full(len(j), lo + i), lo + j]))
        if found:
            i, j = np.concatenate(found, 1)
            swap = (n[i] > n[j]) | ((n[i] == n[j]) & (sig[i] > sig[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            _, once = np.unique(np.stack([sig[i], sig[j]], 1), axis=0, return_index=True)
            i, j = i[once], j[once]
            yield pa.RecordBatch.from_arrays([pa.array(sig[i]), pa.array(sig[j]), pa.array(n[i].astype(np.int64)), pa.array(n[j].astype(np.int64))], names)

    entries = entries.withColumn("deal", F.xxhash64("sig", F.lit(turn)))
    return entries.repartition(width, "shingle", "one", "other").mapInArrow(lean(run), ", ".join(f"{c} long" for c in names)).distinct()


def _stack(raw: list[np.ndarray], sizes: np.ndarray, length: int) -> np.ndarray:
    """All maps of at least ``length`` words, folded to it."""
    out = [_folded(raw[k][None, :], length) for k in np.flatnonzero(sizes >= length)]
    return np.concatenate(out)


def _counted(pairs: DataFrame, n: int, texts: DataFrame) -> DataFrame:
    """(hub, member, n_hub, n_member, common) of ``n`` pairs, exactly, from both whole texts.

    Texts travel, not sets: they compress to less than half of the hashes' size.
    """
    names = ["hub", "member", "n_hub", "n_member", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, lead = None, np.zeros(0, np.uint64)
        for batch in slices(batches, 3):
            out = []
            sets = sets_of(batch.column(3))
            for key, member, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets, strict=True):
                if member is None:
                    hub, lead = key, s
                elif key == hub:
                    out.append((key, member, len(lead), len(s), len(np.intersect1d(lead, s, assume_unique=True))))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    return meetings(pairs.select("hub", "member"), n, texts, -(-n // 20_000)).mapInArrow(lean(run), ", ".join(f"{c} long" for c in names))


def _near(pairs: DataFrame, n: int, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, member) whose sizes and parity maps allow the threshold. ``maps``: key, n, map."""
    names = ["hub", "member"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, lead, many = None, b"", 0
        for batch in batches:
            out = []
            for key, member, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                size, own = int.from_bytes(packed[:8], "little"), packed[8:]
                if member is None:
                    hub, lead, many = key, own, size
                elif key == hub and (size + many - differing(lead, own)) // 2 >= needed(size, many, percent):
                    out.append((key, member))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 2)], names)

    return meetings(pairs.select(*names), n, maps.select("key", F.col("map").alias("text")), -(-n // 50_000)).mapInArrow(lean(run), "hub long, member long").distinct()


def _answered(pairs: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with ``answer`` where a highly similar set's computed answers settle it: true if linked, false if not.

    For a set x with linked leader l, and any z that was counted with l:
    common(l, z) - (n_l - common(x, l)) <= common(x, z) <= common(l, z) + (n_x - common(x, l)).
    """
    both = lambda d: d.select(F.col("hub").alias("x"), F.col("member").alias("z"), F.col("n_hub").alias("n_x"), F.col("n_member").alias("n_z"), "common").unionByName(
        d.select(F.col("member").alias("x"), F.col("hub").alias("z"), F.col("n_member").alias("n_x"), F.col("n_hub").alias("n_z"), "common"))
    told = both(counted)
    linked = told.filter(f"common * {100 + percent} >= {percent} * (n_x + n_z)")
    leaders = linked.groupBy("x").agg(F.max(F.struct("common", F.col("z").alias("lead"), F.col("n_z").alias("n_lead"))).alias("best"))
    leaders = leaders.select("x", F.col("best.lead").alias("lead"), (F.col("best.n_lead") - F.col("best.common")).alias("less"), F.col("best.common").alias("own"))
    answers = told.select(F.col("x").alias("lead"), "z", F.col("common").alias("lead_common"))
    asked = pairs.select("hub", "member", F.col("hub").alias("x"), F.col("member").alias("z"), F.col("n_hub").alias("n_x"), F.col("n_member").alias("n_z"))
    asked = asked.unionByName(pairs.select("hub", "member", F.col("member").alias("x"), F.col("hub").alias("z"), F.col("n_member").alias("n_x"), F.col("n_hub").alias("n_z")))
    bounds = asked.join(leaders, "x").join(answers, ["lead", "z"]).select(
        "hub", "member", (F.col("lead_common") - F.col("less")).alias("low"), (F.col("lead_common") + F.col("n_x") - F.col("own")).alias("high"))
    bounds = bounds.groupBy("hub", "member").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    least = f"ceil({percent} * (n_hub + n_member) / {100 + percent}.0)"
    answer = F.when(F.expr(f"low >= {least}"), True).when(F.expr(f"high < {least}"), False)
    return pairs.join(bounds, ["hub", "member"], "left").withColumn("answer", answer).select("hub", "member", "n_hub", "n_member", "answer")


def _opened(long: DataFrame, components: DataFrame) -> DataFrame:
    """The entries of those long lists in which links have not joined all sets, with ``component`` and the list's length."""
    placed = long.join(components.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    lists = placed.groupBy("shingle").agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high"))
    lists = checkpointed(lists.filter("low != high").select("shingle", "many"))
    return placed.join(either_way(lists), "shingle")


def _few_lists(entries: DataFrame, turn: int) -> DataFrame:
    """Of each set's entries those of a few lists, chosen by a hash of the list alone, so that similar sets choose alike."""
    least = Window.partitionBy("sig").orderBy(F.xxhash64("shingle", F.lit(turn)), "shingle")  # a set's own entries
    return entries.withColumn("_place", F.row_number().over(least)).filter(F.col("_place") <= LISTS_A_TURN).drop("_place")


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n, sig) of all documents, and (sig, component) of all sets; see jaccard_components()."""
    told = checkpointed(_summaries(docs))
    rows = told.filter("kind = 0").drop("kind")
    frequent = told.filter("kind = 1").groupBy("sig").agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "sig").limit(ORDERED).toArrow()  # bounded by ORDERED
    times = frequent.column("times").to_numpy()[::-1].copy()
    frequent = frequent.column("sig").to_numpy()[::-1].copy().view(np.uint64)
    usable = rows.filter("n > 0 and doc_id is not null")
    classes = checkpointed(usable.groupBy("sig").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n").alias("n")).select("sig", "n", "first.*"))
    known = docs.filter("doc_id is not null")
    entries = _prefixes(known, frequent, times, percent)
    expected = classes.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100.0) + 1"))).first()[0] or 0
    listed = checkpointed(_lists(entries, percent, shuffle_width(docs, int(expected), PREFIX_ROWS_PER_TASK)))

    # A text twice under one id would be held against itself by each of its rows.
    twice = not usable.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()

    def texts(sigs: DataFrame) -> DataFrame:
        """One text (key: sig) for each of ``sigs``."""
        own = classes.join(sigs, "sig", "left_semi").select("doc_id", "text_key", F.col("sig").alias("key"))
        own = known.join(either_way(checkpointed(own)), ["doc_id", "text_key"]).select("key", "text")
        return own.dropDuplicates(["key"]) if twice else own

    def counted_pairs(pairs: DataFrame, n: int) -> DataFrame:
        ends = pairs.select(F.explode(F.array("hub", "member")).alias("sig")).distinct()
        return checkpointed(_counted(pairs, n, texts(ends))).coalesce(max(1, n // 100_000))

    def edge(d: DataFrame) -> DataFrame:
        return d.select(F.col("hub").alias("src"), F.col("member").alias("dst"))

    linked = f"common * {100 + percent} >= {percent} * (n_hub + n_member)"
    candidates, n = sized(listed.filter("member is not null").select("hub", "member").distinct(), 100_000)
    ends = candidates.select(F.explode(F.array("hub", "member")).alias("sig")).distinct()
    candidates, n = sized(_near(candidates, n, checkpointed(_maps(texts(ends))), percent), 100_000)
    counted = counted_pairs(candidates, n)
    components = checkpointed(connected_components(edge(counted.filter(linked)))).coalesce(max(1, n // 200_000))
    open_, left = sized(_opened(listed.filter("member is null").select(F.col("hub").alias("sig"), "shingle", "n", "place"), components), OPEN_ROWS_PER_TASK)
    if left:
        maps = checkpointed(_maps(texts(open_.select("sig").distinct()))).withColumnRenamed("key", "sig")
    for turn in (*range(1, ROUNDS + 1), 0):
        if not left:
            break
        blocks = F.ceil(F.col("many") / LIST_BLOCK).cast("int")
        own = F.pmod(F.xxhash64("sig", F.lit("block")), blocks).cast("int")
        entries = _few_lists(open_, turn) if turn else open_
        entries = entries.withColumns({"blocks": blocks, "side": own}).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        entries = entries.withColumns({"one": F.least("side", "met"), "other": F.greatest("side", "met")}).join(maps, "sig")
        width = shuffle_width(docs, left, OPEN_ROWS_PER_TASK) if left > OPEN_ROWS_PER_TASK else max(1, left // 5_000)
        across = _across(entries.select("shingle", "one", "other", "side", "sig", "n", "place", "component", "map"), percent, width, turn)
        fresh, n = sized(across.join(counted.select("hub", "member"), ["hub", "member"], "left_anti"), 100_000)
        if not n:
            if turn:
                continue
            break
        settled, _ = sized(_answered(fresh, counted, percent), 100_000)
        rest, n = sized(settled.filter("answer is null").drop("answer"), 100_000)
        more = edge(settled.filter("answer"))
        if n:
            now = counted_pairs(rest, n)
            counted = counted.unionByName(now)
            more = more.unionByName(edge(now.filter(linked)))
        star = components.filter("node != component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
        components = checkpointed(connected_components(star.unionByName(more)))
        if turn:
            open_, left = sized(_opened(open_.select("sig", "shingle", "n", "place"), components), OPEN_ROWS_PER_TASK)
    parts = classes.select("sig", "doc_id").join(components.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = parts.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows, parts.join(least, "component").select("sig", "component_id")


def _maps(texts: DataFrame) -> DataFrame:
    """(key, map): the size of each text's set in eight bytes, and its parity map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            packed = [len(s).to_bytes(8, "little") + parity_map(s) for s in sets_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["key", "map"])

    return texts.mapInArrow(lean(run), "key long, map binary")


def _placed(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_key, n, component_id of every row."""
    ship(docs.sparkSession)
    rows, parts = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")), percent)
    found = rows.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(parts, "sig", "left")
    own = F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))
    return found.select("doc_id", "text_key", "n", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs`` (doc_id long, text).

    Two documents link when 100 * intersection >= ``percent`` * union of their
    sets of 5-word shingles; ``component_id`` is the smallest doc_id that links
    reach. The result is exact (up to equal 64-bit hashes).

    Equal sets are one class from the start. Index lists of the sets' prefixes
    give candidate pairs (blocks skipped by size and place), which are counted on
    the whole sets; long lists are first joined with their leaders only. What
    links have then joined needs no more pairs. The sets of long lists that are
    still apart meet in blocks: parity maps rule most pairs out, the answers of
    linked leaders settle others either way, and the rest is counted.

    Documents without words (or null) have n_shingles 0 and are components of
    their own. Null doc_ids link with nothing and have a null component. Repeated
    rows stay. Empty tables give no rows; other columns are not read.
    """
    return _placed(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def without_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component of near copies, the one with the smallest doc_id.

    Rows are told apart by doc_id and text: of several texts of the smallest id
    one stays (by a hash of the text), of rows that repeat both one stays, and
    another component's text of the same id stays too. Rows without doc_id or
    without words all stay. An empty table gives no rows; all columns pass through.
    """
    placed = checkpointed(_placed(docs, percent).filter("n > 0 and doc_id is not null"))
    first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("kept"))
    marked = placed.groupBy("doc_id", "text_key").agg(F.first("component_id").alias("component_id"), F.count("*").alias("times")).join(first, "component_id")
    same = (F.col("kept.doc_id") == F.col("doc_id")) & (F.col("kept.text_key") == F.col("text_key"))
    marked = checkpointed(marked.select("doc_id", "text_key", same.alias("stays"), "times").filter("not stays or times > 1"))
    left, right = "_id_of_copies", "_key_of_copies"
    keyed = docs.withColumns({left: F.col("doc_id").cast("long"), right: F.xxhash64("text")})
    gone = marked.select(F.col("doc_id").alias(left), F.col("text_key").alias(right))
    kept = keyed.join(either_way(gone), [left, right], "left_anti")
    twice = marked.filter("stays").select(F.col("doc_id").alias(left), F.col("text_key").alias(right))
    once = keyed.join(either_way(twice), [left, right], "left_semi").dropDuplicates([left, right])
    return kept.unionByName(once).select(*docs.columns)
