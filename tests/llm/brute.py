"""Plain versions of the corpus operators, for small fixtures only."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def shingles(text):
    w = words(text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard(docs, percent=75):
    """{doc_id: (n_shingles, component)}"""
    sets = {d: shingles(t) for d, t in docs}
    held = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    pairs = {(a, b) for l in held.values() for a in l for b in l if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    parts = components(sets, links)
    return {d: (len(sets[d]), parts[d]) for d in sets}


def repeated_words(docs, least=50):
    """{doc_id: places of words inside an exact repeat of an earlier document's passage}"""
    first, out = {}, defaultdict(set)
    for d, t in sorted(docs):
        w = words(t)
        for k in range(len(w) - least + 1):
            if first.setdefault(tuple(w[k:k + least]), d) != d:
                out[d].update(range(k, k + least))
    return out


def articles(page):
    """The blocks of a page's article element, by the standard library's parser."""
    from html.parser import HTMLParser

    blocks, held = [], []

    def flush():
        if words_ := " ".join("".join(held).split()):
            blocks.append(words_)
        held.clear()

    class Reader(HTMLParser):
        inside = skipped = 0

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.skipped += tag in ("script", "style", "title")
            if tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "article", "blockquote", "table", "tr", "td", "pre"):
                flush()
            held.append(" " if tag == "br" else "")

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "article", "blockquote", "table", "tr", "td", "pre"):
                flush()
            self.inside -= tag == "article"
            self.skipped -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if self.inside and not self.skipped:
                held.append(data)

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    return "\n".join(blocks)


def edits(a, b):
    """Whether exactly one inserted, deleted or replaced code point parts two words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1:] == b[k + 1:]
    short, long = sorted((a, b), key=len)
    return short[k:] == long[k + 1:]


def spellings(counts, ratio=5):
    """{word: (form, root, n, n_near, form_n)}"""
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def hard_negatives(rows, every=100, k=5, low=80, high=100, scale=256):
    """Rows of the result for (vec_id, vector, label)."""
    from math import floor, isfinite

    rows = {(i, tuple(floor(scale * float(x)) for x in v), l) for i, v, l in rows if l is not None and v and all(x is not None and isfinite(x) for x in v)}
    out = []
    for i, v, l in rows:
        if i % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))
        own = sorted((-score(w), j) for j, w, m in rows if m == l and (j, w, m) != (i, v, l) and len(w) == len(v))[:k]
        other = sorted((-score(w), j) for j, w, m in rows if m != l and len(w) == len(v))
        for p, positive in own:
            hits = [(s, j) for s, j in other if low * -p <= 100 * -s <= high * -p][:k]
            out += [(i, positive, r, j, -p, -s) for r, (s, j) in enumerate(hits, 1)]
    return sorted(out)
