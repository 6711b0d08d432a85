"""Operators against brute force."""

import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF
from ticktide.llm import (
    chat_format,
    common,
    components,
    html_text,
    line_dedup,
    packing,
    quality_rules,
    sharding,
    simhash,
    token_file,
    tokens,
)
from ticktide.llm import sentencepiece_sampling as sps


def unpack(ids: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


ODD = ["", " ", "\n", " a", "a ", "a  b", "a\n\nb", "a \n b", "\na", "a\n", "  a\n\n\n b\t c", "x\x1cy z", "it's we'll 12 3a",
       "a <|endoftext|> c", "<|endoftext|><|endoftext|>", "x<|startoftext|>y\n <|endoftext|>\n\n z", "<|ENDOFTEXT|> <|endoftext|", "a <|endoftext|>", "ẞ ÀÉ Σας İx", "a ́b", "\n b", " \nb", "日本 語　x", "a\x85 b", "#$ %% b's 's", "a .", "ªº ĲǅΣ", "ﬁ ①a"]


@pytest.mark.parametrize("specials_are_text", [False, True])
@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_tokens_equal_the_library(texts, name, drops, specials_are_text):
    own, library = tokens.Encoder(tokens.public_path(name), drops, specials_are_text), Tokenizer.from_file(tokens.public_path(name))
    if specials_are_text:  # else the library is as its file makes it
        library.encode_special_tokens = True
    rnd = random.Random(3)
    parts = [*" \n\ta1'é.　\x1c<|s,Ω", "<|endoftext|>", "<|startoftext|>"]
    odd = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    for text in [*ODD, *odd, *(t for _, t in texts)]:
        assert unpack(own.encode(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_reduction_is_optimal_on_small_instances():
    rnd = random.Random(1)

    def fewest(sizes, cap):
        best = [len(sizes)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + sizes[k] <= cap and bins[i] not in bins[:i]:
                    go(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
            go(k + 1, [*bins, sizes[k]])

        go(0, [])
        return best[0]

    for _ in range(150):
        cap = rnd.choice([10, 20, 50])
        sizes = sorted((rnd.randint(1, cap) for _ in range(rnd.randint(1, 10))), reverse=True)
        fixed, rest = packing.reduce(dict(Counter(sizes)), cap)
        left = [s for s, n in rest.items() for _ in range(n)]
        # what dominance fixes costs nothing: the best packing of the rest completes a best packing
        assert sum(p.times for p in fixed) + fewest(sorted(left, reverse=True), cap) == fewest(sizes, cap)
        used = Counter()
        for p in packing.plan(dict(Counter(sizes)), cap):
            assert sum(s * k for s, k in p.items) <= cap
            for s, k in p.items:
                used[s] += k * p.times
        assert used == Counter(sizes)


def test_packing_query(spark, texts):
    out = packing.query(spark, SF).collect()
    library = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    total = 0
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(pieces[doc_id], key=lambda r: r.piece)):
            part = ids[r.start : r.start + r.length]
            assert (r.piece, r.start, len(part)) == (k, at, r.length) and r.length <= packing.CAP
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= packing.CAP
    assert len(sequences) <= math.ceil(total / packing.CAP) + 2


def test_triples_cover():
    assert len(simhash.triples()) == 20
    assert all(any(set(t) <= set(q) for t in simhash.triples()) for q in itertools.combinations(range(8), 4))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 4).tolist():
            a, b = root(i), root(i + 1 + j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(fps))}


@pytest.mark.parametrize(("block", "large"), [(4096, 65536), (7, 65536), (7, 7)])
def test_simhash_groups(spark, block, large, monkeypatch):
    rng = np.random.default_rng(5)
    fps = []
    for base in rng.integers(0, 2**64, 30, dtype=np.uint64):
        for _ in range(30):
            x = int(base)
            for k in rng.choice(64, rng.integers(0, 9), replace=False):
                x ^= 1 << int(k)
            fps.append(x)
    fps = np.array(fps, dtype=np.uint64)
    rows = list(enumerate(fps.view(np.int64).tolist()))
    monkeypatch.setattr(simhash.links, "__defaults__", (block, large))
    marked = common.written(spark.createDataFrame(rows, "doc_id long, fp long"), "marked")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(marked).collect()}
    assert got == brute_components(fps)


def test_simhash_counts_shared_bytes():
    """The lists give the pairs with 4 equal positional bytes or more, no others; a large posting costs about its size."""
    import time

    rng = np.random.default_rng(8)
    fps = rng.integers(0, 3, (300, 8)).astype(np.uint8).view(np.uint64).reshape(-1)
    index = simhash.Lists(fps)
    for k in range(len(fps)):
        equal = (fps.view(np.uint8).reshape(-1, 8) == fps[k : k + 1].view(np.uint8)).sum(axis=1)
        assert index.shared(k).tolist() == np.flatnonzero(equal >= 4).tolist()
    near = np.unique(np.uint64(2**63 + 12345) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (70_000, 3), dtype=np.uint64), axis=1))
    began = time.time()
    found = list(simhash.links_within(near, np.arange(len(near))))
    assert len(found) == len(near) - 1 and time.time() - began < 60


def test_a_hub_is_joined_where_its_links_are(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    rows = [(0, i) for i in range(1, 400)] + [(500 + i, 501 + i) for i in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 400)} | {501 + i: 500 for i in range(40)}


def test_simhash_query(spark, texts):
    import xxhash

    def brute(text):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    out = {r.doc_id: r for r in simhash.query(spark, SF).collect()}
    want = np.array([brute(t or "") for _, t in texts], dtype=np.uint64)
    groups = brute_components(want)
    for i, (doc_id, _) in enumerate(texts):
        assert out[doc_id].fingerprint == f"{int(want[i]):016x}"
        assert out[doc_id].component_id == texts[groups[i]][0]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 100], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got and all(c == max(1, (i - 1) // 100 * 100 + 1) for i, c in got.items())


def test_token_blocks():
    rng = np.random.default_rng(0)
    import io

    for n in (0, 1, 511, 512, 513, 70_000):
        ids = np.where(rng.random(n) < 0.03, rng.integers(0, 2**32, n), rng.zipf(1.3, n) % 49_000).astype(np.uint32)
        cuts = [0, *sorted(rng.integers(0, n + 1, 4).tolist()), n]
        stream = io.BytesIO()
        writer = token_file.FileWriter(stream)
        for k in range(5):
            writer.add(None if k == 2 else k, ids[cuts[k] : cuts[k + 1]].tobytes())
        writer.close()
        back = list(token_file.parse(stream.getvalue()))
        assert b"".join(x[3] for x in back) == ids.tobytes() and [x[0] for x in back] == [0, 1, None, 3, 4]
        broken = bytearray(stream.getvalue())
        broken[7] ^= 1
        with pytest.raises(ValueError):
            list(token_file.parse(bytes(broken)))


def test_token_file_query(spark, texts):
    out = {r.doc_id: r for r in token_file.query(spark, SF).collect()}
    library, at = Tokenizer.from_file(tokens.public_path("word_bpe_49k.json")), 0
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        r = out[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_rebalancing():
    rng = np.random.default_rng(1)
    even = sharding.even_map(8)
    for weight in (rng.gamma(60, 3000, 4096), np.where(rng.random(4096) < 0.2, rng.integers(1, 30_000, 4096), 0)):
        weight = weight.astype(np.int64)
        after = sharding.rebalanced(even, weight, 8)
        load = np.bincount(after, weights=weight, minlength=8)
        assert load.max() - load.min() <= 0.001 * load.mean()
        assert (after != even).mean() < 0.2  # an edit, not a new map


def test_sharding_query(spark, texts):
    out = {r.doc_id: r for r in sharding.query(spark, SF).collect()}
    load, places = Counter(), {}
    for doc_id, text in texts:
        data = (text or "").encode()
        r = out[doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(load) <= set(range(8))
    assert max(load.values()) - min(load.values()) <= max(0.02 * max(load.values()), max(r.size for r in out.values()))


def test_common_lines_go(spark):
    shared = "this line stands on every page of the host " * 3
    own = "a b c d e f g h i j k l m n o p q r s t u v w x y z "
    rows = [(i, shared + "\n" + " ".join(f"{w}{i}x{k}" for k in range(3) for w in own.split()), "h") for i in range(40)]
    rows += [(100 + i, (shared + "\n") * 3 + f"only{i} this", "h") for i in range(3)]
    rows += [(200, shared + "\n" + own * 3, "other"), *((300 + i, rows[0][1], "h") for i in range(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.id: r for r in quality_rules.quality_rules(docs).collect()}
    assert out[0].removed_lines == 0 and out[1].removed_lines == 1 and out[1].kept and out[200].removed_lines == 0
    assert out[101].depleted and not out[101].kept
    assert out[300].removed_words == 27 and out[300].kept  # copies count as one document
    text = {r.doc_id: r.text for r in quality_rules.without_common_lines(docs).collect()}
    assert text[1] == rows[1][1].split("\n")[1] and text[200] == rows[43][1] and text[101] == "only1 this"


def test_patience_alignment():
    line = {c: i for i, c in enumerate("abcdefgh")}

    def run(early, late, low=1):
        e, x = ({k: line[c] for k, c in enumerate(s) if c in line} for s in (early, late))
        return "".join(late[k] for k in sorted(line_dedup.doomed(e, x, dict.fromkeys(x, 1), low)))

    assert run("abcd", "abcd") == "abcd"
    assert run("abcd", "xabycd", 2) == "abcd"
    assert run("abcd", "dcba", 2) == ""
    assert run("aabb", "aabb", 4) == "aabb"
    assert run("abcabc", "abc") == "abc"
    assert run("abcd", "axbxcxd", 2) == ""


def test_line_dedup_blocks(spark):
    p = [f"{w} " * 12 + "end" for w in "abcdefgh"]
    long = "passage " * 60
    rows = [(1, "\n".join(p[:4])), (2, "x one\n" + "\n".join(p[:2]) + "\n\n" + p[2] + "\ny two"), (3, "\n".join(p[:4])),
            (4, "short\nline"), (5, "short\nline"), (6, p[5] + "\n" + p[6]), (7, p[6] + "\n" + p[5])]
    rows += [(10 + i, f"own {i}\n{long}\nown {i} too") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs, rare=3).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "x one\n\ny two" and out[3].text == ""
    assert out[2].removed_lines == [1, 2, 4] and out[2].removed_words == 39
    assert all(out[i].removed_lines == [] for i in (1, 4, 5, 6, 7, 10))
    assert all(out[i].text == f"own {i - 10}\nown {i - 10} too" for i in range(11, 60))


def test_runs_of_short_frequent_lines(spark):
    notice = "one two three\nfour five six\nseven eight nine\nten eleven twelve\na b c\nd e f\ng h i"
    rows = [(i, f"own {i}\n{notice}\nown {i} too") for i in range(30)] + [(90, "a b c\nx\nd e f"), (91, "four five six")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), rare=3).collect()}
    assert out[0] == rows[0][1] and out[90] == rows[30][1] and out[91] == rows[31][1]
    assert all(out[i] == f"own {i}\nown {i} too" for i in range(1, 30))


def all_pairs(rows, low=line_dedup.MIN_WORDS):
    """Places that go from each document when every pair is aligned."""
    docs = {i: {k: line for k, line in enumerate(x for x in text.split("\n") if x.strip())} for i, text in rows}
    names = {line: k for k, line in enumerate(dict.fromkeys(x for d in docs.values() for x in d.values()))}
    ids, out = sorted(docs), {i: set() for i in docs}
    for k, late in enumerate(ids):
        for early in ids[:k]:
            both = set(docs[early].values()) & set(docs[late].values())
            e, x = ({k: names[line] for k, line in docs[i].items() if line in both} for i in (early, late))
            out[late] |= line_dedup.doomed(e, x, {k: len(docs[late][k].split()) for k in x}, low)
    return {i: sorted(ranks) for i, ranks in out.items()}


def test_line_dedup_equals_all_pairs(spark):
    a, b, c = (f"{w} " * 20 for w in "abc")
    crossed = [(1, f"{b}\n{a}"), (2, f"{a}\n{b}"), (3, f"{a}\n{b}")]
    others = [(11, f"{c}\nown"), (12, "short\nother"), (13, f"{c}\nshort"), (14, f"{c}\nshort")]
    rnd = random.Random(7)
    pool = [f"{w}{k} " * n for k, n in enumerate((3, 6, 9, 12, 20, 25)) for w in "xyz"]
    mixed = [(100 + i, "\n".join(rnd.choices(pool, k=rnd.randint(2, 9)))) for i in range(60)]
    for rows, rare in ((crossed, 1000), (others, 1), (mixed, 1), (mixed, 1000)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        out = {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(docs, rare=rare).collect()}
        assert out == all_pairs(rows)
    assert all_pairs(crossed)[3] == [0, 1] and all_pairs(others)[14] == [0, 1]


def test_line_dedup_with_hot_lines(spark, monkeypatch):
    """A line, a run and an early document that most others share are broadcast, with the same result."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    notice, rnd = "\n".join(f"{w} " * 7 for w in ("one", "two", "three", "four")), random.Random(9)
    pool = [f"{w}{k} " * n for k, n in enumerate((3, 12, 25)) for w in "xyz"]
    rows = [(i, "\n".join([*rnd.choices(pool, k=3), notice][:: rnd.choice((1, -1))])) for i in range(150)]
    out = {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == all_pairs(rows)


def test_html_layout():
    page = """<html><head><title>T</title><style>p{}</style></head><body><h1>Head</h1><p>One <b>two</b>
 three<p>Next<br>line &amp; more<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul><div hidden>no</div><div style="display: none">no<p>no</div>
<table><tr><th>Name<th>Value<tr><td>alpha<td>1<tr><td>b<td>22</table><pre>
 k  = 1
   z</pre><script>var t="</p>";</script>tail < 3<!-- c --><details><summary>S</summary>no</details></body></html>"""
    assert html_text.page_text(page) == (
        "Head\n\nOne two three\n\nNext\nline & more\n\n- a\n- b\n  1. x\n  2. y\n- c\n\n"
        "Name   Value\nalpha  1\nb      22\n\n k  = 1\n   z\n\ntail < 3\nS"
    )
    assert html_text.page_text("<div>" * 20_000 + "deep") == "deep"
    assert html_text.page_text("a<b") == "a" and html_text.page_text("<td>x") == "x"
    assert html_text.page_text('<p title="a>b">q</p><svg><text>s</text></svg>') == "q\n\ns"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><p>Hello", "Hello"),
        ("<head><meta charset=x>\n<script>s</script> Hello <b>you</b>", "Hello you"),
        ("<head><template><p>no</template><style>s</style>&#32;</head><body>Hello", "Hello"),
        ("<head><link rel=x><body><p>Hello", "Hello"),
        ("<p title=it's>I don't know<br>", "I don't know"),
        ("<p it's title = 'a > b' class=\"c > d\" x=>one</p don't><p data-a=\"1\"hidden>no</p>two it's", "one\n\ntwo it's"),
        ("<p it'hidden =\"x\">shown", "shown"),
    ],
)
def test_html_left_out_heads_and_loose_quotes(page, want):
    assert html_text.page_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('x<p title="a>hello <b>x</b>', "x"),  # the value takes the rest of the page with it
        ("<p title='a>b'>c</p title='>'>d", "c\n\nd"),
        ('<div style="visibility:hidden">no<p style="visibility: visible">yes<b style="visibility:hidden">no</b></div>', "yes"),
        ('<div style="display:none">no<p style="visibility:visible;display:block">no</div>a', "a"),
        ('<p style="display:none;display:block">shown</p>', "shown"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>x<td rowspan=0>to end<td>y<tr><td>1<td>2<tr><td>3<td>4</table>", "x  to end  y\n1          2\n3          4"),
        ("<table><tr><th colspan=2>a long head<th>z<tr><td>1<td>2<td>3</table>", "a long head  z\n1  2         3"),
        ("a<dialog>closed</dialog><dialog open>open</dialog>", "a\nopen"),
        ("x<textarea>\na\n  b &lt;</textarea>y", "x a\n  b < y"),
        ("<tr><td>loose<td>cells", "loose cells"),
        ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
        ("a<!-->b<!--->c<!-- x --!>d<!x>e<?y>f</>g</ z>h", "abcdefgh"),
        ("&#00000000000065;&#99999999999;&#x1F600;" + "&#" + "9" * 5000 + ";&amp;lt;", "A\ufffd\U0001F600\ufffd&lt;"),
        ("<b>x<p>y</b>z</p>", "x\n\nyz"),
        ("1 < 2 <3 <", "1 < 2 <3 <"),
        ("a<br/>b<p/>c", "a\nb\n\nc"),
    ],
)
def test_html_scanner_and_layout(page, want):
    assert html_text.page_text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 90_000 + "</span>" * 90_000, '<a "' * 250_000, "<a b='" * 150_000, "<!--" * 250_000, "</" * 500_000, "<" * 10**6,
        "<ul><li>x" * 110_000, "<table><tr><td>x" * 60_000, "<p><table>" + "<div>" * 190_000, "<blockquote>x" * 70_000,
        "<table>" + "<tr>" * 3 + "<td rowspan=9999 colspan=999>x" * 30_000 + "<tr><td>y" * 30_000,
        "<table><tr>" + "<td>" * 100_000 + "x\n" * 10 + "<pre>" + "y\n" * 200_000, "<table><tr><td>" + "w" * 500_000 + "<tr><td>a<td>b" * 30_000,
        "&" * 10**6, "&#" + "1" * 10**6, "<script>" + "</scrip" * 140_000, "<b><p>x</b>" * 90_000, "<select><option>x" * 60_000,
        "".join(f"<td rowspan={k % 9000 + 2}>x" for k in range(20_000)).join(["<table><tr>", "<tr><td>y" * 40_000]),
    ],
)
def test_html_hostile_pages_take_linear_time(page):
    import time

    began = time.time()
    text = html_text.page_text(page)
    assert time.time() - began < 6 and len(text) < 50 * len(page)  # 1 MB; under 2 s on an idle machine


def plain_words(page):
    """Visible words by the standard library's parser, for pages without nested hidden parts."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.hidden, self.out = [], []

        def handle_starttag(self, tag, attrs):
            if tag in ("head", "script", "style", "template", "noscript", "title"):
                self.hidden.append(tag)
            if tag not in ("a", "b", "i", "em", "span"):
                self.out.append(" ")

        def handle_endtag(self, tag):
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            if tag not in ("a", "b", "i", "em", "span"):
                self.out.append(" ")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    parser = Words()
    parser.feed(page)
    parser.close()
    return "".join(parser.out).split()


def test_html_query_equals_a_plain_renderer(spark):
    """Every page: no word is lost, none is added, and their order is kept."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = {r.page_id: r.text for r in html_text.query(spark, SF).collect()}
    assert out.keys() == pages.keys()
    for i, page in pages.items():
        got = [w for line in out[i].split("\n") for w in line.removeprefix("- ").split()]
        assert got == plain_words(page or ""), i


def every_segmentation(lattice, model, text):
    voc = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    s, out = sps.normalised(text), []

    def go(i, ids, w):
        if i == len(s):
            out.append((tuple(ids), w))
            return
        for j in range(i + 1, min(len(s), i + 16) + 1):
            if s[i:j] in voc:
                go(j, [*ids, voc[s[i:j]]], w + lattice.weight[voc[s[i:j]]])
        if s[i] not in voc:
            parts = [int(lattice.byte_id[x]) for x in s[i].encode()]
            go(i + 1, ids + parts, w + lattice.weight[parts[0]] * len(parts))

    go(0, [], 0.0)
    z = np.logaddexp.reduce([w for _, w in out])
    return {ids: math.exp(w - z) for ids, w in out}


@pytest.mark.parametrize("text", ["ab, c", "the①x\n", "a  b", "x\x00y.", "", "don't_x²."])
def test_sampling_without_replacement(text):
    import sentencepiece

    path, n = tokens.public_path("piece_bpe_32k.model"), 6000
    lattice, model = sps.lattice_of(path, 1.0), sentencepiece.SentencePieceProcessor(model_file=path)
    p = every_segmentation(lattice, model, text)
    drawn = {}
    for d, _, edges, lp, value, inclusion in sps.samples(lattice, [text] * n, np.arange(n, dtype=np.uint64), 3):
        ids = tuple(lattice.ids(edges).tolist())
        assert math.exp(lp) == pytest.approx(p[ids], rel=1e-6) and 0 <= inclusion <= 1
        assert sps.decode_ids(lattice, np.array(ids, int)) == text
        drawn.setdefault(d, []).append((ids, value, inclusion))
    assert all(len({i for i, _, _ in x}) == len(x) == min(3, len(p)) for x in drawn.values())
    assert all(a[1] > b[1] for x in drawn.values() for a, b in itertools.pairwise(x))
    first = Counter(x[0][0] for x in drawn.values())
    assert max(abs(first[i] / n - q) for i, q in p.items()) < 0.03
    if len(p) > 1:
        second = Counter(x[1][0] for x in drawn.values())
        want = {i: sum(p[j] * p[i] / (1 - p[j]) for j in p if j != i) for i in p}
        assert max(abs(second[i] / n - q) for i, q in want.items()) < 0.03


def test_draws_do_not_depend_on_batches(texts):
    path = tokens.public_path("piece_bpe_32k.model")
    some, keys = [t for _, t in texts[:20]], np.arange(20, dtype=np.uint64)
    lattice = sps.Lattice(path)
    whole = [(d, r, lattice.ids(e).tobytes()) for d, r, e, *_ in sps.samples(lattice, some, keys, 3)]
    alone = [(d, r, lattice.ids(e).tobytes()) for d in range(20) for _, r, e, *_ in sps.samples(lattice, some[d : d + 1], keys[d : d + 1], 3)]
    assert sorted(whole) == sorted(alone)


def test_repeated_words_are_parted_once(monkeypatch):
    scanned = []

    class Counting:
        def findall(self, text):
            scanned.append(len(text))
            return units.findall(text)

    units = sps._UNITS
    monkeypatch.setattr(sps, "_UNITS", Counting())
    some = [f"the lattice of {n % 7} words, parted once." for n in range(500)]
    rows = list(sps.samples(sps.Lattice(tokens.public_path("piece_bpe_32k.model")), some, np.arange(500, dtype=np.uint64), 2))
    assert {d for d, *_ in rows} == set(range(500)) and sum(scanned) < 100


def test_units_of_words_are_those_of_whole_texts():
    odd = ["a b", "a  b", " a", "a ", " ", "", None, "a▁ b", "a ▁b", "▁", "x.\n y!!\n\n z", "a \nb", "\n", "don't_x² a²", "\ud800 a", "the the, the"]
    lattice = sps.Lattice(tokens.public_path("piece_bpe_32k.model"))
    for some in (odd, odd[::-1], [t for t in odd if t != "\ud800 a"], ["a b c"], [], [None]):
        found = lattice.nodes(some)
        assert len(found) == len(some)
        for text, nodes in zip(some, found):
            want = [lattice.begin.data[lattice.units[u]] for u in sps._UNITS.findall(sps.normalised(text))]
            assert nodes.tolist() == want


def test_sampling_query_returns_ids_and_texts(spark, texts):
    rows = sps.query(spark, SF).collect()
    lattice, text = sps.lattice_of(tokens.public_path("piece_bpe_32k.model"), 1.0), dict(texts)
    assert {r.doc_id for r in rows} == set(text)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.n_pieces and zlib.crc32(r.ids) == r.ids_crc32
        assert r.text == sps.decode_ids(lattice, ids) and zlib.crc32(r.text.encode()) == r.text_crc32
        assert r.text == (text[r.doc_id] or "").replace("\u2581", " ")


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 5.0, "assistant", "good"), (1, 3, 1, 1.0, "assistant", "bad"),
            (1, 4, 3, 9.0, "user", "deep"), (1, 9, 77, 1.0, "user", "orphan"), (2, 1, None, 0.0, "user", "solo")]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    paths = {}
    for r in chat_format.best_paths(messages, 2).collect():
        paths.setdefault((r.tree, r.path, r.rank), []).append((r.place, r.node))
    got = {k: [n for _, n in sorted(v)] for k, v in paths.items()}
    assert got == {(1, 4, 1): [1, 3, 4], (1, 2, 2): [1, 2], (1, 9, 1): [9], (2, 1, 1): [1]}
    loop = spark.createDataFrame([(1, 1, 2, 0.0, "u", ""), (1, 2, 1, 0.0, "u", "")], messages.schema)
    with pytest.raises(ValueError, match="ancestor"):
        chat_format.best_paths(loop).collect()


def test_chat_query(spark):
    out = {r.conv_id: r for r in chat_format.query(spark, SF).collect()}
    convs = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert out.keys() == convs.keys()
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert out[c].n_turns == len(turns) and out[c].loss_chars == len(loss)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
