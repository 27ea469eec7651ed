"""Jaccard join, passages, mixing, sharding, BPE, chats, pages against plain versions, with the awkward rows."""

import hashlib
import random
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from brute import WORD, jaccard, repeated_words, words
from conftest import SF
from pyspark.sql import functions as F

from strandbook.llm import bpe, chat, common, html_text, jaccard_join, mixing, passages, queries, sharding, shingles

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0):
    """Near copies at all similarities, a common line, shared passages, copies, and rows that are empty in every way."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    out, line = [], " ".join(word() for _ in range(12))
    shared = [" ".join(word() for _ in range(rng.randint(50, 80))) for _ in range(4)]
    base = [[word() for _ in range(rng.choice([6, 30, 120, 400]))] for _ in range(25)]
    for b in base:
        for _ in range(rng.choice([1, 3, 14])):
            w = list(b)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w) + (f"\n{line}" if rng.random() < 0.5 else ""))
    for k in range(40):
        out.append(" ".join(word() for _ in range(rng.randint(10, 150))) + f" {rng.choice(shared)} " + " ".join(word() for _ in range(rng.randint(0, 90))))
    out += [out[3]] * 30 + ["one two", "ONE Two", "  ", "", None, "a", "A", " ".join(["same"] * 3000), " ".join(["same"] * 2990)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame([(d, t, "en", ["b", "a", None][d % 3], len(t or "")) for d, t in rows], DOC).repartition(7)


def test_jaccard_join_is_exact(docs):
    rows, df = docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == jaccard(rows)


def test_jaccard_join_of_long_lists(spark, monkeypatch):
    """Lists of a common line are long here, and leaders must not hide links."""
    rng = random.Random(5)
    line = " ".join(f"common{i}" for i in range(16))
    rows = []
    for i in range(150):
        own = [f"w{i // 3}x{k}" for k in range(rng.choice([1, 2, 5, 60]))]
        rows.append((i, line + " " + " ".join(own)))
    monkeypatch.setattr(jaccard_join, "ORDERED", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == jaccard(rows)


def test_jaccard_join_edges(spark, docs):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e f"), (4, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(-1, 2, None), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 2, 1), (4, 2, 1)]
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0
    kept = jaccard_join.without_copies(docs[1])
    assert kept.columns == docs[1].columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in jaccard(docs[0]).items() if c == d)


def test_copies_go_by_row(spark):
    """Ids that repeat: another text of a copy's id stays, a repeated row stays once, rows without words or id all stay."""
    a, b = "a b c d e f g h i j k", "one two three four five six seven"
    rows = [(1, a, 0), (1, a, 1), (2, a.upper(), 2), (2, b, 3), (5, b, 4), (3, None, 5), (3, None, 6), (4, " ", 7), (None, a, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted((r.doc_id or -1, (r.text or "").strip()) for r in jaccard_join.without_copies(df).collect())
    assert got == sorted([(1, a), (2, b), (3, ""), (3, ""), (4, ""), (-1, a)])


def test_jaccard_join_of_a_cloud_in_blocks(spark, monkeypatch):
    """Variants of one text, few of which link to any one of them, in lists that are dealt and met in blocks."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(f"x{rng.randrange(9)}" if rng.random() < 0.045 else w for w in base)) for i in range(160)]
    monkeypatch.setattr(jaccard_join, "HOT_LIST", 20)
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    monkeypatch.setattr(common, "BLOCK", 10)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == jaccard(rows)
    assert 1 < len({c for _, c in got.values()}) < 150


def test_passages_find_every_exact_repeat(docs):
    rows, df = docs
    expected, got = repeated_words(rows), {}
    for r in passages.repeated_passages(df).filter("repeated").collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert all(expected[d] <= got.get(d, set()) for d in expected)
    texts = dict(rows)
    for d in got:  # nothing is marked that is not at least nearly somewhere else
        assert len(got[d]) >= 50 and any(e != d and len(set(words(texts[d])) & set(words(t))) > 20 or t == texts[d] for e, t in rows)


def test_shared_passages_of_places_that_repeat():
    """The later text has the passage twice, after a piece of itself, or around a frequent line; the earlier one has it once."""
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    text = lambda t: passages.Passage(shingles.shingled(*shingles.word_hashes(pa.array([" ".join(t)])))[0], 46)
    covered = lambda x, y: set(passages.shared_words(text(x), text(y), 46, 0.75)[1].nonzero()[0].tolist())
    p, line = some(60), some(24)
    first = some(30) + p + some(30)
    assert covered(first, p + some(40) + p) == {*range(60), *range(100, 160)}
    assert covered(first, p[:30] + some(40) + p) >= {*range(70, 130)}
    around = p[:20] + line + p[20:]
    assert covered(some(9) + around, line + some(40) + line + some(40) + around) >= {*range(128, 212)}
    pieces = [some(9) + p[k:k + 6] for k in range(0, 54, 6)]  # more open chains than eight
    assert covered(sum(pieces, []) + p, p + sum(pieces[::-1], [])) >= {*range(60)}


def test_windows_of_a_passage_that_repeats_its_words(spark):
    """A refrain that also stands outside the passage in one of the texts moves the centre there, not the keys."""
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(100):
        refrain = some(7)
        p = (refrain * 8)[:50]
        rows += [(2 * k, " ".join(some(30) + p + some(30))), (2 * k + 1, " ".join(some(20) + refrain * rng.randint(1, 6) + some(rng.randint(1, 9)) + p + some(40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (df.coalesce(1), df.repartition(7)):
        pairs = {(r.a, r.b) for r in passages._links(passages._windows(df.withColumn("text_key", passages.text_key()), 46, 1), 46, 4).collect()}
        assert pairs >= {(2 * k, 2 * k + 1) for k in range(100)}


def test_near_passages():
    """Passages with a few edits are found as a whole, others are left alone."""
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    text = lambda t: passages.Passage(shingles.shingled(*shingles.word_hashes(pa.array([" ".join(t)])))[0], 46)
    covered = lambda x, y: set(passages.shared_words(text(x), text(y), 46, 0.75)[1].nonzero()[0].tolist())
    p = some(90)
    near = p[:45] + ["edit"] + p[46:]
    assert covered(some(20) + p + some(20), some(50) + near + some(9)) == {*range(50, 140)}
    far = [w if k % 9 else "edit" for k, w in enumerate(p)]
    assert covered(some(20) + p + some(20), some(50) + far + some(9)) == set()
    assert covered(some(300), some(300)) == set()


def test_passages_of_variants_that_the_first_lacks(spark):
    """All share a line of 35 words, which no two texts are compared over twice; later ones share what the first does not have."""
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, tails = some(35), [some(60) for _ in range(6)]
    rows = [(k, " ".join(some(40) + line + (some(50) if k < 3 else tails[k % 6]) + some(30))) for k in range(40)]
    rows += [(100, " ".join(tails[5] + some(9))), (3, " ".join(some(60)))]
    for parts in (1, 9):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {}
        for r in passages.repeated_passages(df).filter("repeated").collect():
            got.setdefault((r.doc_id, r.text_key), set()).update(range(r.start_word, r.end_word))
        assert sorted(d for d, _ in got) == [*range(9, 40), 100]
        assert all(v >= ({*range(60)} if d == 100 else {*range(40, 135)}) for (d, _), v in got.items())


def test_passages_of_rows_that_share_an_id(spark):
    rng = random.Random(6)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p, q, other = some(60), some(70), some(30)
    rows = [(1, p), (2, f"{p} {other}"), (2, q), (2, q), (3, None), (None, p), (4, ""), (5, p)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cuts", F.lit("kept"))
    left = sorted((r.doc_id or -1, r.text or "", r.cuts) for r in passages.without_repeats(df).collect())
    assert left == sorted([(-1, p, "kept"), (1, p, "kept"), (2, other, "kept"), (2, q, "kept"), (2, q, "kept"), (3, "", "kept"), (4, "", "kept")])


def test_passages_removed_once(docs):
    rows, df = docs
    left = [(r.doc_id, r.text) for r in passages.without_repeats(df).collect()]
    assert sum(map(len, repeated_words(left).values())) <= 0.02 * sum(map(len, repeated_words(rows).values()))
    was, now = dict(rows), dict(left)
    every = {tuple(words(t)[k:k + 50]) for t in was.values() for k in range(len(words(t)) - 49)}
    kept = {tuple(words(t)[k:k + 50]) for t in now.values() for k in range(len(words(t)) - 49)}
    assert len(kept) > 0.5 * len(every)
    untouched = [d for d in was if d not in {r.doc_id for r in passages.repeated_passages(df).filter("repeated").collect()}]
    assert all(now[d] == was[d] for d in untouched)
    assert passages.without_repeats(df.limit(0)).count() == 0


def test_spans():
    text = "a b  c\nd e"
    assert passages.without_spans(text, [(1, 3)]) == "a d e"
    assert passages.without_spans(text, [(0, 2), (4, 9)]) == "c\nd"
    assert passages.without_spans(text, [(0, 5)]) == "" and passages.without_spans(text, []) == text


@pytest.mark.parametrize("seed", range(5))
def test_compact_windows_cover_every_subsequence_once(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    values = rng.integers(0, 12 if seed % 2 else 10**9, 60).astype(np.uint64)
    lo, hi = np.array([0, 25]), np.array([25, 60])
    l, c, r = passages.compact_windows(values, lo, hi, 7)
    for a, b in zip(lo, hi, strict=True):
        for i in range(a, b):
            for j in range(i + 6, b):
                cover = (l <= i) & (i <= c) & (c <= j) & (j <= r)
                assert cover.sum() == 1 and values[c[cover][0]] == values[i:j + 1].min()


def test_mixing(docs):
    rows, df = docs
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    size = {d: len(WORD.findall(t or "")) for d, t in rows}
    total, by = sum(size.values()), {}
    for r in out:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r["size"]
    assert all(t == round(target) and own == n for t, own, target, n in by.values())
    assert sum(v[2] for v in by.values()) == pytest.approx(1.5 * total)
    # Water-filling by hand: a weighs 3, b 1, null 2.
    want, cap, w = {}, {s: 2 * v[1] for s, v in by.items()}, {"a": 3, "b": 1, None: 2}
    left = 1.5 * total
    open_ = set(cap)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > cap[s]}
        if not full:
            break
        left -= sum(cap[s] for s in full)
        want |= {s: cap[s] for s in full}
        open_ -= full
    want |= share if open_ else {}
    assert {s: v[2] for s, v in by.items()} == pytest.approx(want)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_mixing_edges(spark):
    same = spark.createDataFrame([(1, "a b c d", "s")] * 5 + [(None, None, None)], "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    out = mixing.mix(same, share=1.5)
    assert sum(r.taken for r in out.collect()) == 30 and out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert mixing.mix(same.limit(0)).count() == 0


def test_sharding(spark, docs):
    rows, df = docs
    out = sharding.shard(df, 6).collect()
    size = {d: len((t or "").encode()) + 8 for d, t in rows}
    assert all(r["size"] == size[r.doc_id] and r.text_crc32 == zlib.crc32((dict(rows)[r.doc_id] or "").encode()) for r in out)
    shards = {}
    for r in out:
        shards.setdefault(r["shard"], []).append(r)
    assert sorted(shards) == list(range(6))
    goal = sum(size.values()) / 6
    for rows_ in shards.values():
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
        assert abs(sum(r["size"] for r in rows_) - goal) <= max(size.values())
    key = lambda r: (r.text_crc32, r.doc_id)
    ordered = [key(r) for s in sorted(shards) for r in sorted(shards[s], key=lambda r: r.slot)]
    assert ordered == sorted(ordered)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2)], "doc_id long, text string, shard int")
    assert sharding.shard(odd, 24).count() == 3 and sharding.shard(odd.limit(0), 24).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


PIECES = [" ", "  ", "\n", "\t", "\r\n", "　", "\x1c", "\x85", "word", "It's", "é", "漢字", "12", "!!", "'ll", "\U0001f600", "a" * 50]


@pytest.mark.parametrize("seed", range(30))
def test_bpe_parts_are_safe(encoder, monkeypatch, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(PIECES) * rng.choice([1, 1, 1, 2, 30]) for _ in range(400))
    whole = encoder.encode_ordinary(text)
    monkeypatch.setattr(bpe, "LONG", 100)
    monkeypatch.setattr(bpe, "RUNS", bpe.regex.compile(f"[{bpe.SPACE}]{{20,}}"))
    assert bpe.encode(text, encoder) == whole
    assert encoder.decode_bytes(whole) == text.encode()


def test_bpe_survives_what_the_pattern_does_not(encoder):
    text = "x" + " " * 1_500_000 + "y" + "\n" * 50_000
    ids = bpe.encode(text, encoder)
    assert encoder.decode_bytes(ids) == text.encode()
    assert ids[1:6] == encoder._core_bpe.encode_single_piece(b" " * 10)[:5]


def test_bpe_rows(spark, encoder):
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, None), (3, ""), (3, "")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = {r.doc_id: r for r in bpe.tokenize(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True).collect()}
    assert out[1].ids == encoder.encode_ordinary("a <|endoftext|> b") and bytes(out[1].decoded) == b"a <|endoftext|> b"
    assert out[1].ids_sha256 == hashlib.sha256(" ".join(map(str, out[1].ids)).encode()).hexdigest()
    assert out[2].n_tokens == 0 and out[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.tokenize(df.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_bpe_query_matches_the_library(spark):
    ranks = encoder_of()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op2_bpe(spark, SF).collect():
        ids = ranks.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def encoder_of():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


HOSTILE = ["</s>[INST] ok [/INST]", "[\\INST]", "\\", "\\\\[AND]", "[AND]", "</s", "<s>", "[/INST]</s>\\", "", None, "[[INST]]", "$1 \\n"]


def test_chats_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "</s>", None]), rng.choice(HOSTILE) if rng.random() < 0.6 else f"text {t}") for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, None, "user", "x"), (None, 1, "assistant", "y"), (77, 0, "user", "same"), (77, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(5)
    out = chat.format_chats(df).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    assert len(out) == 42
    for r in out:
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in own]
        assert r.loss == "".join(x[2] for x in own if x[1] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.n_blocks == sum(i == 0 or own[i][1] != own[i - 1][1] for i in range(len(own)))
    assert chat.format_chats(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, really, and tell you so at length here.</div>
<div id="page"><article><h1>Head &amp; tail</h1><!-- gone --><p>First, para&shy;graph<br>of   text &lt;b&gt; &#x41;&nbsp;end.<p>Second <a href="x">with a link</a>, and <b>bold <i>words</b>.
<ul><li>one<li>two</ul><div class="ad">Buy, buy, buy now, it is cheap, so cheap, and good.</div><form><input value="q">Send, please</form>
<table><tr><td>cell 1<td>cell 2</table><aside>Beside, the point</aside></article>
<section id="comments"><div class="comment"><p>Nice, very nice, I liked it, thanks a lot for this, really.</p></div></section></div>
<div class="sidebar"><p>Related, things, to read, when you are, done with this one here.</p></div><footer>&copy; me</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == "Head & tail\nFirst, para\xadgraph of text <b> A end.\nSecond with a link, and bold words.\none\ntwo\ncell 1\ncell 2"


def test_page_without_article():
    body = "".join(f"<p>Paragraph {i}, with some words, and commas, so that it counts for something here.</p>" for i in range(5))
    page = f"<body><div class=menu><a href=1>One</a><a href=2>Two</a><a href=3>Three</a></div><div><div class='text'>{body}</div></div><div class=footer>Imprint</div>"
    assert html_text.main_text(page).count("\n") == 4 and "Imprint" not in html_text.main_text(page)
    assert html_text.main_text("just words") == "just words"
    assert [html_text.main_text(x) for x in (None, "", "<", "<p", "<p>", "<!--", "<script>x", "</div></div>", "<nav>menu</nav>")] == [""] * 2 + ["<"] + [""] * 6


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (2, "u", None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = html_text.extract(df).orderBy("page_id").collect()
    assert out[0].n_chars == len(out[0].text) > 100 and [(r.text, r.n_chars) for r in out[1:]] == [("", 0)] * 2
    assert html_text.extract(df.limit(0)).count() == 0


def test_pages_against_a_plain_reader(spark):
    from brute import articles

    got = queries.op3_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(got) > 0 and all(r.text == articles(r.html) and r.n_chars == len(r.text) for r in got)


def test_blocks_and_names():
    text = html_text.main_text
    assert text('<p>Hello, one <span class="ad">x</span> world and <svg/> more</p>') == "Hello, one world and more"
    assert text('<p>E = <math><mi>m</mi></math> c</p><p class="share-price">Price 3</p><p class="byline">By me</p>') == "E = m c\nPrice 3\nBy me"
    long = "A sentence, with commas, that goes on for long enough to be one of an article's, as it is."
    page = f"""<html><head><meta charset=utf-8><title>t</title><body class="no-sidebar"><div class="site-header"><a href=/>Home</a></div>
      <div class="with-sidebar"><div class="article-header"><h1>Title</h1></div><div class="elementor-widget"><p>{long}</p></div><h2>Sub</h2><ul><li>one</ul><p>{long}</div>
      <div class="sidebar"><p>{long}</p></div><div id="comments"><p>{long}</p><p>{long}</p><p>{long}</p></div><form><p>Name <input></p></form>"""
    assert text(page) == f"Title\n{long}\nSub\none\n{long}"
    assert text(f"<div class='ad'><p>{long}</p></div><h1>T</h1><div><p>{long}<div class=promo>buy</div></div><footer>{long}") == f"T\n{long}"
    assert text("<p>a < b &amp;&lt; c</p><!-- no --><p>d<br>e <b>f</p>") == "a < b &< c\nd e f"
    assert text("<p title='x>hello</p>") == "hello" and text("<p>cut <a href=") == "cut" and text(None) == text("") == ""


def test_names_within_lines_and_of_sections():
    text = html_text.main_text
    line = "We saw the {} and {} and {} there, and it was good to see all of them again."
    marked = line.format("<span class='banner'>long banner</span>", "<b class=notice>the notice</b>", "<code class='nav'>nav()</code>")
    assert text(f"<article><p>{marked}</p></article>") == line.format("long banner", "the notice", "nav()")
    long = "A sentence, with commas, that goes on for long enough to be one of an article's, as it is."
    kept = "".join(f"<{tag} class='{name}'><p>{name} {long}</p></{tag}>" for tag, name in (("section", "social-impact"), ("div", "share-price"), ("div", "comments-policy")))
    gone = "".join(f"<div class='{name}'><p>{long}</p></div>" for name in ("comments-area", "ad-slot-2", "related-posts")) + "<div class='share-knobs'><a href=/>a</a></div>"
    assert text(f"<article><p>{long}</p>{kept}{gone}</article>") == "\n".join([long, f"social-impact {long}", f"share-price {long}", f"comments-policy {long}"])


def test_any_depth():
    long = "A sentence, with commas, that goes on for long enough to be one of an article's, as it is."
    for n in (5, 600, 5_000):
        page = "<div>" * n + f"<nav>MENU menu</nav><footer>FOOT</footer><article><p>{long}</p><ul><li>one<li>two</ul></article>" + "</div>" * n + f"<footer>{long}</footer>"
        assert html_text.main_text(page) == f"{long}\none\ntwo"


def test_pages_whose_article_is_not_marked():
    import re

    import pyarrow.parquet as pq
    from brute import articles

    pages = pq.read_table(f"{SF}/pages.parquet", columns=["html"]).column(0).to_pylist()
    plain = [(p, re.sub(r"<(/?)article\b", r"<\1div", p, flags=re.I)) for p in pages if p and "<article" in p.lower()]
    assert len(plain) > 20 and all(html_text.main_text(q) == articles(p) for p, q in plain)


@pytest.mark.parametrize("piece", ['<li><ul>', '<dt><div>', '<span hidden>', 'a="b" ', "<div>", "<li>x<ul>", "<span class=ad>", "</p>", "<", "<p a='\"", "<td>x", "<!--"])
def test_hostile_pages_take_one_pass(piece):
    import time

    began = time.time()
    html_text.main_text("<p>hello</p><div " + piece * (1_000_000 // len(piece)))
    assert time.time() - began < 20


def test_shards_against_plain_sums(docs):
    """Every row's shard and slot, from one sorted list."""
    rows, df = docs
    sized = sorted((zlib.crc32((t or "").encode()), d, len((t or "").encode()) + 8) for d, t in rows)
    total = sum(s for _, _, s in sized)
    before, expected, slots = 0, {}, {}
    for crc, d, size in sized:
        shard = min(5, (2 * before + size) * 6 // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        expected[d] = (size, crc, shard, slots[shard])
        before += size
    assert {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard(df, 6).collect()} == expected
