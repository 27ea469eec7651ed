"""WARC archives, hard negatives and spelling variants against plain versions."""

import gzip
import hashlib
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import edits, hard_negatives, spellings
from compare import assert_same
from conftest import SF
from pyspark.sql import functions as F

from strandbook.llm import negatives, queries, spelling, warc

# ---- WARC


def pages_like(spark):
    long = "".join(chr(random.Random(4).randrange(32, 0x24F)) for _ in range(60_000))
    hostile = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n0\r\n\r\n" * 5
    rows = [
        (7, "http://a/7", "x" * 100), (3, "http://a/3", "x" * 100), (9, None, "x" * 100), (None, "http://a/none", "x" * 100), (4, "http://a/4", "y" * 99), (5, "http://a/5", "y" * 99),
        (10, "http://a/ 10\r\nX: y", long), (11, "http://a/11", long), (12, "http://a/12", long[:40_000]), (12, "http://a/12", long[:40_000]), (13, "http://a/13", hostile),
        (14, "http://a/14", None), (15, "http://a/15", ""), (16, "http://a/16", "ä" * 50), (17, "http://a/17", "ä" * 50), (18, "http://a/18", "z" * 100), (18, "http://b/18", "z" * 100), (None, None, "lone" * 50)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)


def expected_index(rows):
    out, first = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min((first.get(b, (True, None)), (i is None, i)), key=lambda x: (x[0], x[1] if x[1] is not None else 0))
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first[b][1] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b][1] if again else None, None))
    return sorted(out, key=str)


def index_of(spark, path):
    got = warc.capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem").collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("segment", [65_536, 1_000])
def test_warc_round_trip(spark, tmp_path, segment):
    rows, pages = pages_like(spark)
    warc.write_warc(pages, str(tmp_path / "w"), segment=segment)
    assert index_of(spark, str(tmp_path / "w")) == expected_index(rows)
    captures = {(r.page_id, r.record_type): r for r in warc.read_captures(spark, str(tmp_path / "w")).collect()}
    assert bytes(captures[13, "response"].payload).decode() == rows[10][2]
    assert captures[10, "response"].url == "http://a/%2010%0D%0AX:%20y" and captures[14, "response"].payload == b""


def test_warc_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert index_of(spark, str(tmp_path / "w")) == []


def record(kind, block, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>"} | {k.replace("_", "-"): v for k, v in more.items()}
    return fields["WARC-Record-ID"], warc.framed(fields, block) + b"\r\n\r\n"


def test_warc_segments_in_any_file_and_order(spark, tmp_path):
    body = bytes(range(256)) * 40
    block = b"HTTP/1.1 200 OK\r\ntransfer-encoding:\r\n Chunked\r\n\r\n" + warc.chunked(body, 700)[:-2] + b"Trailer: 1\r\n\r\n"
    cut = [block[at:at + 900] for at in range(0, len(block), 900)]
    origin, first = record("response", cut[0], WARC_Segment_Number="1", WARC_Page_ID="5")

    def part(k, total=None):
        return record("continuation", cut[k - 1], WARC_Segment_Origin_ID=origin, WARC_Segment_Number=str(k), **({"WARC_Segment_Total_Length": total} if total else {}))[1]

    parts = [part(k) for k in range(2, len(cut))] + [part(len(cut), str(len(block)))]
    random.Random(1).shuffle(parts)
    info = record("warcinfo", b"software: none\r\n")[1]
    plain = record("response", b"HTTP/1.1 200 OK\r\n\r\nwhole", WARC_Page_ID="6")[1]

    def index(*files):
        folder = tmp_path / uuid.uuid4().hex
        folder.mkdir()
        for k, data in enumerate(files):
            (folder / f"{k}.warc").write_bytes(data)
        return {r.page_id: r for r in warc.capture_index(spark, str(folder)).collect()}

    member = lambda *records: b"".join(gzip.compress(r) for r in records)
    whole = index(info + parts[0] + parts[1], member(*parts[2:5], first), plain + b"".join(parts[5:]) + parts[0])  # one copy of a part twice
    assert (whole[5].payload_digest, whole[5].problem) == (hashlib.sha256(body).hexdigest(), None) and whole[6].payload_bytes == 5 and set(whole) == {5, 6}
    assert index(first, *parts[1:])[5].problem == ("a segment is missing" if b"Total-Length" not in parts[0] else "the last segment is missing")
    last = next(p for p in parts if b"Total-Length" in p)
    assert index(first, *(p for p in parts if p is not last))[5].problem == "the last segment is missing"
    wrong = part(len(cut), str(len(block) + 1))
    assert index(first, wrong, *(p for p in parts if p is not last))[5].problem == "the total length differs"
    other = record("continuation", b"?" * 900, WARC_Segment_Origin_ID=origin, WARC_Segment_Number="2")[1]
    assert index(first, other, *parts)[5].problem == "copies of a segment differ"


def test_warc_broken_archives(spark, tmp_path):
    good = record("response", b"HTTP/1.1 200 OK\r\n\r\nfine", WARC_Page_ID="1")[1]
    digest = record("response", b"HTTP/1.1 200 OK\r\n\r\nfine", WARC_Page_ID="2", WARC_Payload_Digest="sha256:00")[1]
    chunk = record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc\r\n0\r\n\r\n", WARC_Page_ID="3")[1]
    lone = record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Page_ID="4", WARC_Refers_To="<urn:uuid:none>")[1]
    short = record("response", b"HTTP/1.1 200 OK\r\n\r\ncut short", WARC_Page_ID="5")[1]
    (tmp_path / "a.warc").write_bytes(b"junk\r\nmore junk\r\n" + good + digest + chunk + lone + short[:-9])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good.replace(b"ID: 1", b"ID: 6"))[:-5])
    got = {(r.page_id, r.problem) for r in warc.capture_index(spark, str(tmp_path)).collect()}
    assert {(None, "no record begins here"), (1, None), (2, "the digest differs"), (3, "a chunk has another length"), (4, "its response is missing"), (5, "record is cut short"), (None, "archive is broken")} <= got


def test_unchunked():
    for n in (0, 1, 8192, 8193, 30_000):
        data = random.Random(n).randbytes(n)
        assert warc.unchunked(warc.chunked(data)) == (data, None)
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == (b"abc", None)
    assert warc.unchunked(b"-3\r\nabc\r\n0\r\n\r\n")[1] == warc.unchunked(b"")[1] == "a chunk has no size"


# ---- hard negatives


def vectors_like(n=900, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    rows = []
    for i in range(n):
        v = centres[i % 12] + 0.4 * rng.standard_normal(d)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))))
    for i in range(0, n, 3):  # a third are copies of one vector
        rows[i] = (i, rows[1][1], rows[i][2])
    rows += [(1000, None, 1), (1010, [float("nan")] * d, 1), (1020, [None] + [1.0] * (d - 1), 1), (1030, rows[1][1], None), (1040, [], 1), (1050, [0.0] * d, 2), (1060, [0.0] * d, 3), (1070, [1.0, 2.0], 1),
             (1080, [2.0, 1.0], 1), (1090, [1.0, 1.0], 2), (1100, [-1.0] * d, 99), (1110, [float("inf")] * d, 0), (30, rows[30][1], rows[30][2]), (1120, [1e30] * d, 1)]
    return rows


@pytest.mark.parametrize(("per_cell", "anchors", "candidates"), [(256, 1024, 16384), (8, 1024, 16384), (4, 3, 20)])
def test_hard_negatives(spark, monkeypatch, per_cell, anchors, candidates):
    for name, value in (("PER_CELL", per_cell), ("ANCHORS", anchors), ("CANDIDATES", candidates)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors_like()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x")).repartition(4)
    got = sorted(map(tuple, negatives.mine(df, every=10).collect()))
    want = hard_negatives([r for r in rows if r[0] != 1120], every=10)
    assert len(want) > 1000 and got == want


def test_hard_negatives_long_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in 3e4 * rng.standard_normal(8)], i % 3) for i in range(200)]  # scores beyond 2**53 are summed as longs
    rows = [(i, [x * 7 for x in v], l) for i, v, l in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fit = [(i, v, l) for i, v, l in rows if sum(np.floor(256 * np.array(v)) ** 2) < 2.0**55]
    got = sorted(map(tuple, negatives.mine(df, every=10).collect()))
    assert got == hard_negatives(fit, every=10) and any(abs(r[4]) > 2**53 for r in got)


def test_hard_negatives_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(none).count() == 0
    few = spark.createDataFrame([(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(few).count() == 0  # no other label
    assert negatives.mine(few.unionByName(spark.createDataFrame([(2, [0.9, 0.0], 2)], few.schema))).count() == 1


# ---- spelling


def test_edits():
    assert edits("abcdef", "abcdeg") and edits("abcdef", "abcdefg") and edits("bcdef", "abcdef") and not edits("abcdef", "badcef") and not edits("abc", "abc")


def test_variants(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdeö") for _ in range(rng.randint(6, 9))) for _ in range(150)} | {"aaaaaa", "aaaaaaa", "ababab", "bababa", "aaaaab", "banana", "bananna", "x" * 3_000, "x" * 3_001}
    counts = Counter()
    for w in sorted(words):
        counts[w] += rng.choice([5, 5, 6, 30, 200, 1000])
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1:], w[:k] + "q" + w[k:], w[:k] + "z" + w[k + 1:]])
            counts[v] += rng.choice([1, 4, 5, 9, 40])
    df = spark.createDataFrame(sorted(counts.items()), "word string, n int").selectExpr("explode(array_repeat(word, n)) AS word", "1 AS n")
    df = df.unionByName(spark.createDataFrame([(None, 1)] * 9, "word string, n int"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}
    want = spellings({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert got == want
    assert sum(f is not None and r != f for f, r, *_ in want.values()) > 0  # chains of more than one form


def test_variants_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "word string")).count() == 0
    assert spelling.variants(spark.createDataFrame([("abcdef",)] * 5, "word string")).collect() == [("abcdef", None, "abcdef", 5, 0, None)]
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string"), least_chars=3)


def test_occurrences(spark):
    docs = spark.createDataFrame([(1, "Größe ÄBC's x÷y9Zed"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.word for r in spelling.occurrences(docs).orderBy("word").collect()] == sorted(["größe", "Äbc", "s", "x÷y", "zed"])


# ---- the queries


@pytest.mark.parametrize("name", ["op11_warc", "op12_negatives"])
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, SF)


def test_op13_query(spark):
    import re

    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    want = spellings({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_spelling(spark, SF).collect()}
    assert got == want and any(f for f, *_ in want.values())
