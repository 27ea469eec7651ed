"""Lines by byte ranges are those of whole files."""

import json
import random
from datetime import datetime

import pytest

from strandbook.sources import ranged, transcript
from strandbook.sources.lines import read_lines


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("ranged files")
    rng = random.Random(3)
    texts = {
        "plain.jsonl": "".join(json.dumps({"n": k, "t": "ä€" * rng.randrange(9)}, ensure_ascii=False) + "\n" for k in range(60)),
        "no end.jsonl": '{"a": 1}\n\n\r\n \t\n{"b": 2}\r\n{broken\n{"c": "x"}', "long.jsonl": json.dumps({"x": "y" * 3_000}) + "\n" + "{}\n" * 5 + json.dumps({"z": "w" * 700}), "empty.jsonl": "", "blank.jsonl": "\n" * 40,
        "deep/er.jsonl": "  {\"q\": 1}  \n{}\n", "other.txt": "{}\n",
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(text.encode())
    return root


@pytest.mark.parametrize("size", [3, 64, 1_000, 1 << 20])
def test_ranges_equal_whole_files(spark, folder, size):
    files = "no*.jsonl" if size == 3 else "*.jsonl"
    told = lambda df: sorted((r.path, r.line_no, r.line, r.v is None) for r in df.collect())
    whole = told(read_lines(spark, str(folder), files))
    assert told(read_lines(spark, str(folder), files, range_bytes=size)) == whole and len(whole) >= 4


def test_shares_change_nothing(spark, folder):
    cut = [sorted(map(tuple, ranged.numbered_lines(spark, str(folder), "*.jsonl", range_bytes=500, share_bytes=share).collect())) for share in (1, 1_200, 1 << 20)]
    assert cut[0] == cut[1] == cut[2] and len(cut[0]) > 100
    tasks = [ranged.numbered_lines(spark, str(folder), "*.jsonl", range_bytes=500, share_bytes=share).rdd.getNumPartitions() for share in (1, 1 << 20)]
    assert tasks[0] > 10 and tasks[1] == 1


def test_white_space_of_all_kinds_is_stripped(spark, folder):
    lines = [r for r in read_lines(spark, str(folder), "*.jsonl").collect() if "no%20end" in r.path or "deep" in r.path]
    assert sorted((r.line_no, r.line, r.v is None) for r in lines) == [(0, '{"a": 1}', False), (0, '{"q": 1}', False), (1, "{}", False), (4, '{"b": 2}', False), (5, "{broken", True), (6, '{"c": "x"}', False)]


def test_old_files_and_none(spark, folder, tmp_path):
    assert read_lines(spark, str(folder), "*.jsonl", modified_after=datetime(2100, 1, 1), range_bytes=64).count() == 0
    assert read_lines(spark, str(tmp_path), "*.jsonl", range_bytes=64).count() == 0
    assert read_lines(spark, [str(folder / "plain.jsonl"), str(folder / "deep")], range_bytes=64).count() == 62


def test_a_transcript_in_ranges_gives_the_same_events(spark, tmp_path):
    lines = [{"type": "user", "timestamp": f"2026-01-02T10:00:{k:02d}.000Z", "sessionId": "s", "message": {"content": f"do {k}"}} for k in range(50)]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    whole, cut = transcript.read_transcripts(spark, str(tmp_path)), transcript.read_transcripts(spark, str(tmp_path), range_bytes=300)
    for a, b in ((whole.events, cut.events), (whole.headers, cut.headers), (whole.quality, cut.quality)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_the_driver_holds_spans_not_ranges(tmp_path):
    """A row for each file and task, however short a range is (before: one for each range)."""
    for name in "ab":
        (tmp_path / name).write_bytes(b"{}\n" * 1_000_000)
    options = {"roots": json.dumps([str(tmp_path)]), "rangebytes": "100", "sharebytes": str(1 << 20)}
    parts = ranged.RangeReader(options).partitions()
    spans = [s for p in parts for s in p.spans]
    assert len(parts) == 6 and len(spans) == 7 and not any(s.alone for s in spans)
    assert sum(s.end - s.start for s in spans) == 6_000_000 and all((s.end - s.start) % 100 == 0 for s in spans)


@pytest.mark.parametrize("share", [9_000, 70_000, 1 << 20])
def test_spans_of_a_file_of_short_and_long_lines(spark, tmp_path, share):
    rng = random.Random(5)
    lines = [json.dumps({"k": k, "x": "ä" * rng.choice([0, 3, 400, 9_000])}, ensure_ascii=False) for k in range(80)]
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    got = sorted((r.line_no, r.line) for r in ranged.numbered_lines(spark, str(tmp_path), range_bytes=100, share_bytes=share).collect())
    assert [n for n, _ in got] == list(range(80)) and [t.rstrip("\n") for _, t in got] == lines
