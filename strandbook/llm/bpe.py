"""Byte-level BPE with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandbook.llm.common import lean, ship
from strandbook.llm.shingles import slices

#: The white space that ``\s`` means in the pre-split pattern (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Texts longer than this are split before they are encoded.
LONG = 32_768
#: White space runs of this length are encoded without the pattern, whose look-ahead would exhaust the stack on them.
RUN = 4_096
BORDER, RUNS = regex.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])"), regex.compile(f"[{SPACE}]{{{RUN},}}")


def encoding(path: str, pattern: str):
    """The rank file's encoding. Each task loads it, as a worker that outlives its task would hold it for ever."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str) -> Iterator[tuple[str, bool]]:
    """Cuts a text where no match of the pattern reaches across: before white space that follows something else.

    Yields (part, whether the part is a single match). A long white space run
    that something follows is one match without its last character, and one with
    it at the end of the text.
    """
    at = 0
    for run in [*RUNS.finditer(text), None]:
        end = run.start() if run else len(text)
        while end - at > LONG:
            border = BORDER.search(text, at + LONG // 2, end)
            if not border:
                break
            yield text[at:border.start()], False
            at = border.start()
        if at < end:
            yield text[at:end], False
        if run:
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start():at], True


def encode(text: str, enc) -> list[int]:
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, single in safe_parts(text):
        ids += enc._core_bpe.encode_single_piece(part.encode()) if single else enc.encode_ordinary(part)
    return ids


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, *, id_column: str = "doc_id", text: str = "text", with_ids: bool = True, digests: bool = False) -> DataFrame:
    """Token ids of every whole text, and their raw-byte decoding.

    Returns the id and ``n_tokens``; ``ids`` (array<int>) and ``decoded``
    (binary) where ``with_ids``; ``ids_sha256`` (of the decimal ids joined by one
    space) and ``decoded_sha256`` where ``digests``. Special tokens are ordinary
    text. Null texts count as empty, repeated rows stay, an empty table gives no
    rows; other columns are not read. ``ranks_path`` must exist on every executor.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long" + ", ids array<int>, decoded binary" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for part in slices(batches, 1, 1_000_000):
            ids = [encode(x or "", enc) for x in part.column(1).to_pylist()]
            raw = [enc.decode_bytes(x) for x in ids]
            columns = {id_column: part.column(0), "n_tokens": pa.array(map(len, ids), pa.int64())}
            if with_ids:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(raw, pa.binary())}
            if digests:
                columns |= {
                    "ids_sha256": pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                }
            yield pa.RecordBatch.from_pydict(columns)

    ship(docs.sparkSession)
    return docs.select(id_column, text).mapInArrow(lean(run), schema)
