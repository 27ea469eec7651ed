"""WARC archives: pages written as records, read back, segments put together, chunked bodies decoded, revisits resolved."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbook.llm.common import checkpointed, either_way, lean, ship

#: Bytes of a record's block, beyond which it is cut into segments, and of a chunk of a body.
SEGMENT, CHUNK = 65_536, 8_192
#: Archive files hold at most so many pieces of about so many bytes, before compression.
PIECES, PIECE = 64, 1_000_000
#: Bytes of blocks that a task hands on at once.
HANDED_ON = 4_000_000
#: Equal payloads of so many bytes are stored once.
LEAST_REVISIT = 100
NEWLINE, END = b"\r\n", b"\r\n\r\n"
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "fields map<string,string>, block binary, problem string"


# ---- writing


def with_firsts(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, first): of a payload of at least ``least`` bytes that several rows have, ``first`` is the row with the smallest page_id.

    Counted by digest before anything is shuffled; the table of repeated digests is
    broadcast only if it has been counted to be small.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    order = F.struct(F.col("page_id").isNull().alias("without"), "page_id", "url")
    firsts = own.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first.page_id", "first.url")
    firsts = checkpointed(firsts.select("digest", F.struct("page_id", "url").alias("first")))
    return own.join(either_way(firsts), "digest", "left").select("page_id", "url", "payload", "digest", "first")


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """Depends on the page's id, its url and its payload alone, so that a revisit can name its response before that is written."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{url}|{digest}'.encode()).digest())}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[at:at + size] for at in range(0, len(payload), size))]
    return b"".join([*parts, b"0", END])


def framed(fields: dict[str, str], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return b"".join([VERSION, NEWLINE, head.encode(), b"Content-Length: %d" % len(block), END, block])


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, first: dict | None, date: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """A page's response with its continuations, or its revisit if another page is ``first`` with the payload."""
    again = first is not None and first["page_id"] != page_id
    name = record_id(page_id, url, digest)
    fields = {"WARC-Type": "revisit" if again else "response", "WARC-Record-ID": name, "WARC-Date": date}
    if url is not None:  # a url must not end a line
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if page_id is not None:
        fields["WARC-Page-ID"] = str(page_id)
    fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
    if again:
        yield framed(fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first["page_id"], first["url"], digest)}, head + END)
        return
    block = head + b"\r\nTransfer-Encoding: chunked" + END + chunked(payload)
    if len(block) <= segment:
        yield framed(fields, block)
        return
    yield framed(fields | {"WARC-Segment-Number": "1"}, block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        part = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(page_id, name, f"{digest}-{number}"), "WARC-Date": date, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": str(number)}
        if "WARC-Target-URI" in fields:
            part["WARC-Target-URI"] = fields["WARC-Target-URI"]
        yield framed(part | ({"WARC-Segment-Total-Length": str(len(block))} if at + segment >= len(block) else {}), block[at:at + segment])


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", segment: int = SEGMENT, least_revisit: int = LEAST_REVISIT) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) into archives under ``path``, which must be new; the caller deletes them.

    Of rows with equal payloads of at least ``least_revisit`` bytes, those with the
    smallest page_id (rows without one come last) are responses, all others
    revisits of these; smaller payloads are responses. Null html is an empty
    payload, a null url or page_id leaves its field out; rows that repeat are
    written each; other columns are not read; an empty table gives archives without
    records. Bodies are chunked, and blocks of more than ``segment`` bytes go on in
    continuation records.

    Spark's text writer puts the records down, two line ends behind each, wherever
    Spark can write. A file holds at most PIECES pieces of about PIECE bytes, so
    that one task can read it; each is one gzip stream of many records.
    """
    ship(pages.sparkSession)

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                for record in page_records(*row, date, segment):
                    held.append(record)
                    size += len(record)
                    if size >= PIECE:
                        yield pa.RecordBatch.from_pydict({"piece": pa.array([END.join(held)], pa.binary())})
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"piece": pa.array([END.join(held)], pa.binary())})

    pieces = with_firsts(pages, least_revisit).mapInArrow(lean(frame), "piece binary")
    # A cast from bytes to text keeps the bytes as they are, and the writer puts them down so.
    pieces.select(F.col("piece").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", PIECES).option("compression", "gzip").text(path)


# ---- reading


def header_fields(lines: list[bytes]) -> dict[str, str]:
    """Named fields, names in lower case; a line that begins with white space goes on with the field before it."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] = f"{out[name]} {line.decode('utf-8', 'replace').strip()}".strip()
        else:
            key, _, value = line.decode("utf-8", "replace").partition(":")
            name = key.strip().lower()
            out[name] = value.strip()
    return out


def archive_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """The records of an archive, plain or gzip (one member or one for each record): fields, block, and what is wrong.

    Blocks are taken by their length, whatever they hold. What stands between
    records and is none is one row with a problem; reading goes on with the next
    line that begins a record.
    """
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    lost = False
    try:
        while line := stream.readline():
            if not line.strip(b"\r\n"):
                continue
            if not line.startswith(b"WARC/"):
                if not lost:
                    yield {}, b"", "no record begins here"
                lost = True
                continue
            lost, lines = False, []
            while (line := stream.readline()).strip(b"\r\n"):
                lines.append(line.rstrip(b"\r\n"))
            fields = header_fields(lines)
            if not fields.get("content-length", "").isdecimal():
                yield fields, b"", "no content length"
                continue
            length = int(fields["content-length"])
            block = stream.read(length)
            yield fields, block, None if len(block) == length else "record is cut short"
    except (EOFError, OSError, zlib.error):
        yield {}, b"", "archive is broken"


def read_records(spark: SparkSession, path: str, segments: bool | None = None) -> DataFrame:
    """All records under ``path``: ``fields`` (names in lower case), ``block``, ``problem``; only segments, or only others, if asked for.

    A file is read by one task, so it must stay below 2 GB.
    """
    ship(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array([list(f.items()) for f in columns[0]], pa.map_(pa.string(), pa.string())), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.string())], ["fields", "block", "problem"])

        for batch in batches:
            for content in batch.column("content"):
                for record in archive_records(content.as_py()):
                    if segments is not None and ("warc-segment-number" in record[0]) != segments:
                        continue
                    held.append(record)
                    size += len(record[1])
                    if size >= HANDED_ON or len(held) >= 2_000:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lean(parse), RECORD)


def reassembled(parts: DataFrame) -> DataFrame:
    """Records from their segments: grouped by the origin's id, ordered by number, checked against the total length.

    A segment that archives hold several times counts once, if its copies agree; a
    record is given as often as its first segment is there. Problems: a missing
    segment, copies that differ, a missing or another total length.
    """
    f = F.col("fields")
    number = f["warc-segment-number"].try_cast("int")
    named = parts.select(F.coalesce(f["warc-segment-origin-id"], f["warc-record-id"]).alias("origin"), number.alias("number"), f["warc-segment-total-length"].try_cast("long").alias("total"), "fields", "block", "problem")
    # By origin alone, so that what is grouped by origin and number is already where it belongs.
    numbered = named.repartition("origin").groupBy("origin", "number").agg(
        F.min("block").alias("block"), (F.min("block") != F.max("block")).alias("differ"), F.count("*").alias("copies"), F.max("total").alias("total"),
        F.min_by("fields", F.map_keys("fields")).alias("fields"), F.max("problem").alias("problem"))
    whole = numbered.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", F.col("block").cast("string").alias("block")))).alias("blocks"), F.count("*").alias("n"), F.max("number").alias("last"), F.min("number").alias("least"),
        F.bool_or("differ").alias("differ"), F.max("total").alias("total"), F.sum(F.octet_length("block")).alias("length"), F.max("problem").alias("problem"),
        F.max(F.when(F.col("number") == 1, F.col("copies"))).alias("copies"), F.min_by("fields", "number").alias("fields"))
    wrong = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("differ"), "copies of a segment differ").when(F.col("total").isNull(), "the last segment is missing")
        .when((F.col("least") != 1) | (F.col("n") != F.col("last")), "a segment is missing").when(F.col("length") != F.col("total"), "the total length differs"))
    block = F.array_join(F.transform("blocks", lambda b: b["block"]), "").cast("binary")
    return whole.select("fields", block.alias("block"), wrong.alias("problem"), F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("copies", F.lit(1)), F.lit(1)).cast("int"))).alias("_copy")).drop("_copy")


def unchunked(body: bytes) -> tuple[bytes, str | None]:
    """A body without its chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(NEWLINE, at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(;.*)?", body[at:end] if end >= 0 else b"", re.S)
        if not size:
            return b"".join(out), "a chunk has no size"
        n, at = int(size[1], 16), end + 2
        if not n:
            return b"".join(out), None
        if body[at + n:at + n + 2] != NEWLINE:
            return b"".join([*out, body[at:at + n]]), "a chunk has another length"
        out.append(body[at:at + n])
        at += n + 2


def http_payload(block: bytes) -> tuple[bytes, str | None]:
    """What an HTTP response carries, and what is wrong with its framing."""
    head, end, body = block.partition(END)
    if not end:
        return b"", "the HTTP header does not end"
    coded = header_fields(head.split(NEWLINE)[1:]).get("transfer-encoding", "")
    return unchunked(body) if "chunked" in coded.lower() else (body, None)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits under ``path``: ``record_id, record_type, page_id, url, refers_to_id, told_digest, payload, problem``.

    Whole records are decoded where they are read; segments alone are shuffled, by
    their origin, so the archives are read twice. Records of other types are left
    out, but not what could not be read as a record at all.
    """
    records = read_records(spark, path, segments=False).unionByName(reassembled(read_records(spark, path, segments=True)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, problems = [], []
            for block, known in zip(batch.column("block"), batch.column("problem").to_pylist(), strict=True):
                payload, problem = http_payload(block.as_py()) if known is None else (None, known)
                payloads.append(payload)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([batch.column("fields"), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())], ["fields", "payload", "problem"])

    f = F.col("fields")
    kind = f["warc-type"]
    http = records.filter(kind.isin("response", "revisit") | F.col("problem").isNotNull())
    return http.mapInArrow(lean(decode), "fields map<string,string>, payload binary, problem string").select(
        f["warc-record-id"].alias("record_id"), kind.alias("record_type"), f["warc-page-id"].try_cast("long").alias("page_id"), f["warc-target-uri"].alias("url"),
        f["warc-refers-to"].alias("refers_to_id"), F.regexp_extract(f["warc-payload-digest"], "^sha256:(.*)$", 1).alias("told_digest"), F.when(kind == "response", F.col("payload")).alias("payload"), "problem")


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """Each capture under ``path`` and its full payload's size and digest: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, problem``.

    A revisit has these of the response that it refers to, and ``refers_to`` is that
    one's page_id. Digests are of what was read. Problems, null where there is none:
    whatever the records and their framing show, a digest that is not the one told,
    a response that is not in the archives.
    """
    c = read_captures(spark, path)
    problem = F.coalesce("problem", F.when((F.col("told_digest") != "") & (F.col("payload_digest") != F.col("told_digest")), "the digest differs"))
    rows = c.withColumn("payload_digest", F.sha2("payload", 256)).select(
        "record_id", "record_type", "page_id", "url", "refers_to_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", problem.alias("problem"))
    rows = checkpointed(rows)
    again: Column = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    revisits, others = rows.filter(again).drop("payload_bytes", "payload_digest"), rows.filter(~again)
    wanted = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()
    targets = others.join(either_way(checkpointed(wanted)), "record_id", "left_semi").groupBy("record_id").agg(
        F.min(F.struct(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")).alias("t")).select(F.col("record_id").alias("refers_to_id"), "t.*")
    missing = F.when(F.col("payload_digest").isNull(), "its response is missing")
    resolved = revisits.join(either_way(checkpointed(targets)), "refers_to_id", "left").withColumn("problem", F.coalesce("problem", missing))
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    return others.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(resolved.select(columns))
