import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tokenweir.llm import common, decontam, html, huffman, linededup, minhash, packing, quality, queries, sharding, tokencount, tokens, toxicity
from tokenweir.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the quick brown fox jumps over the lazy dog near the old river bank today"
# null text and id, empty and blank texts, ties, repeated rows, a long text, odd characters
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, f"{LINE}\n{LINE}"), (7, f"{LINE}\n{LINE}"), (7, f"{LINE}\n{LINE}"), (7, "another text under one id"),
    (None, LINE), (None, None), (8, LINE.replace("fox", "cat")), (9, " ".join(f"w{i}" for i in range(30_000))), (10, "x" * 60_000), (11, "né à <|endoftext|> \x00 \x1c 中文 😀 don't"), (12, LINE.upper()),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), "c", 1, 2, 3, 4, 5, "q") for i, t in ODD]
    # extra columns whose names operators use inside, and one with a dot
    return spark.createDataFrame(rows, SCHEMA + ", gone string, n_words int, key int, size int, n_lines int, line int, `a.b` string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(name, spark, data, duck, same):
    same(queries.QUERIES[name](spark, data), duck.execute(queries.ORACLES[name]).df())


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def grouped(texts):
    """Brute force: components of all linked pairs."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    of, ids = {k: k for k in sets}, sorted(sets)
    meets = defaultdict(set)
    for k, s in sets.items():
        for g in s:
            meets[g].add(k)

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for x in ids:
        for y in sorted(set().union(*(meets[g] for g in sets[x])) if sets[x] else ()):
            both = len(sets[x] & sets[y])
            if x < y and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                of[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_minhash_equals_brute_force(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op1_minhash_dedup(docs).collect()}
    assert got == grouped(texts)


def test_minhash_large_groups(spark):
    """Families around a base with edits of all sizes: buckets that stay open after the first pivot."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(90)]
    extra = [f"e{i}" for i in range(12)]
    made = {}
    for k in range(160):
        w = list(base) + (extra if k % 3 == 0 else [])
        for at in rng.choice(90, rng.integers(0, 9), replace=False):
            w[at] = f"r{rng.integers(0, 40)}"
        if k % 7 == 0:
            w = w[: len(w) - int(rng.integers(0, 25))]
        made[k] = " ".join(w)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op1_minhash_dedup(df).collect()}
    assert got == grouped(made)


def test_minhash_texts_of_one_id(spark):
    """Texts that share a doc_id are one node with several sets, in large open buckets, too."""
    rng = np.random.default_rng(9)
    base, rows = [f"b{i}" for i in range(60)], []
    for k in range(120):
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 9), replace=False):
            w[at] = f"r{rng.integers(0, 30)}"
        rows.append((k % 100, " ".join(w)))
    sets = [(i, shingle_set(t)) for i, t in rows]
    of = {i: i for i, _ in rows}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                a, b = find(i), find(j)
                of[max(a, b)] = min(a, b)
    got = {(r["doc_id"], r["component_id"]) for r in minhash.op1_minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, find(i)) for i in of}


def test_signature_estimates_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    from tokenweir.llm.common import mix

    rows, h = np.repeat([0, 1], 1000), np.concatenate([np.sort(mix(a)), np.sort(mix(b))])
    sig = minhash.signatures(rows, h, 2, 128)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.12
    small = minhash.signatures(np.array([0, 0]), mix(np.array([3, 9], np.uint64)), 1, 128)
    assert (small >> np.uint64(56) < 128).all()


def test_minhash_odd_rows(odd, none):
    got = minhash.op1_minhash_dedup(odd).collect()
    assert len(got) == len(ODD) and minhash.op1_minhash_dedup(none).count() == 0
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by[1] == {(1, True)} and by[5] == {(4, False)} and by[7] == {(6, False)} and by[None] == {(None, True)}
    assert minhash.keep_one(odd).columns == odd.columns


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(60)]
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for few in (0, 100_000):  # rounds over the cluster, and one task
        got = [(r["id"], r["component"]) for r in components(df, few).collect()]
        assert sorted(got) == sorted((k, find(k)) for k in of)
        assert components(df.limit(0), few).count() == 0


def gone_lines(rows):
    """Brute force over all pairs of lines."""
    lines = []
    for i, text in rows:
        for p, raw in enumerate((text or "").split("\n") if text is not None else []):
            w = re.sub(r"[\x20\x09\x0B-\x0D]+", " ", raw.translate(LOWER)).strip(" ").split(" ")
            if w != [""]:
                lines.append((i, p, w))

    def near(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < linededup.NEAR_WORDS:
            return False
        front = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        back = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
        return front + back >= max(len(a), len(b)) - 1

    lines.sort(key=lambda x: x[:2])
    return {(i, p) for k, (i, p, w) in enumerate(lines) if any(near(w, v) for _, _, v in lines[:k])}


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        own = []
        for _ in range(4):
            w = [f"a{k}" for k in range(int(rng.integers(5, 20)))]
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(0, len(w)))
                w[at : at + int(rng.integers(0, 2))] = [f"z{rng.integers(0, 3)}"] * int(rng.integers(0, 2))
            own.append(" ".join(w))
        rows.append((i, "\n".join(own)))
    long = [f"q{k}" for k in range(700)]
    rows += [(100, " ".join(long)), (101, " ".join(long[:400] + ["new"] + long[400:])), (102, " ".join(long[:69] + long[70:])), (103, " ".join(long[:1] + long[3:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["d"], r["p"]) for r in linededup.repeated_lines(df).collect()} == gone_lines(rows)


def test_line_dedup_takes_exact_repeats_of_any_length(spark):
    rows = [(3, "Subscribe now\n\nthe first part\nall of it"), (1, "a b\nsubscribe  NOW\n"), (2, "A\tb\nc"), (4, "one two three four five six\nsix words that are near by far"), (5, "one two three four six\nsix words that are near by now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_lines", "2 AS `a.b`")
    gone = {(r["d"], r["p"]) for r in linededup.repeated_lines(df).collect()}
    assert gone == gone_lines(rows) == {(2, 0), (3, 0), (5, 1)}  # a line of five words is no near one
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "a.b", "n_lines", "n_removed"] and {r["doc_id"]: r["text"] for r in out.collect()}[3] == "\nthe first part\nall of it"
    assert {(r["d"], r["p"]) for r in linededup.repeated_lines(df, 5).collect()} == {(2, 0), (3, 0), (5, 0), (5, 1)}


def test_line_dedup_odd_rows(odd, none):
    got = defaultdict(list)
    for r in linededup.op2_line_dedup(odd).collect():
        got[r["doc_id"]].append((r["n_lines"], r["n_removed"], r["text"]))
    assert got[1] == [(0, 0, None)] and got[2] == [(1, 0, "")]
    assert sorted(got[None], key=str) == [(0, 0, None), (1, 0, LINE)]  # a null id comes first
    assert got[6] == [(2, 2, "")] and got[8] == [(1, 1, "")] and got[12] == [(1, 1, "")] and (2, 2, "") in got[7]
    assert linededup.op2_line_dedup(none).count() == 0


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_html_lines():
    got = html.lines(page('<nav><ul><li>Menu</li></ul></nav><script>var t="</p>";</script><div class="ad">Buy</div><article><h1>Hi &amp; ho</h1><p><b>one<br>two<p>thr&eacute;e  x</p></article><div id="comments">bad</div><footer>f</footer>'))
    assert [t for t, w in got if w == html.CONTENT] == ["Hi & ho", "one two", "thrée x"]
    assert {t for t, w in got if w != html.CONTENT} == {"Menu", "Buy", "bad", "f"}


def test_html_differencing(spark):
    frame = "<div>Home About Contact</div>{}<div>All rights reserved by the site</div>"
    pages = [(k, f"http://h.example.com/a/{k}", page(frame.format(f"<div>Story number {k} is y{'x' * k} long</div><p>Its second part {k}</p>"))) for k in range(6)]
    pages += [(10, "http://one.example.com/", page("<div>alone</div>")), (11, None, None), (12, "http://h.example.com/a/9", ""), (13, "http://t.example.com/", "<article><p>cut off &am"), (14, "http://t.example.com/2", "<article><p>tail <a href")]
    got = {r["page_id"]: r["text"] for r in html.op3_html_extraction(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()}
    for k in range(6):
        assert got[k] == f"Story number {k} is y{'x' * k} long\n\nIts second part {k}"
    assert got[10] == "alone" and got[11] == "" and got[12] == "" and got[13] == "cut off &am" and got[14] == "tail"


def test_html_copies_keep_their_text(spark):
    pages = [(k, f"http://c.example.com/{k}", page("<div>The whole story of the day</div><div>in two parts</div>")) for k in range(3)]
    assert {r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == {"The whole story of the day\n\nin two parts"}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_differencing_decides_beside_and_inside_articles():
    """Plain frame lines inside of main go; a body beside a teaser article stays; repeated articles stay whole."""
    inside = [html.lines(f"<main><div>Home and all topics</div><p>Story {k} is {'x' * (k + 40)} long</p><div>Read more of us</div></main>") for k in range(4)]
    assert html.main_text(inside[0], inside[1:]) == f"Story 0 is {'x' * 40} long"
    assert "Home and all topics" in html.main_text(inside[0], inside[1:2])  # one neighbour does not decide inside
    teaser = [html.lines(f"<div>Site name</div><div>Body {k} is {'y' * (k + 60)} long</div><article><p>See our shop</p></article>") for k in range(4)]
    assert html.main_text(teaser[0], teaser[1:]) == f"Body 0 is {'y' * 60} long"
    copies = [html.lines(f"<div>Version {k}</div><article><p>The whole story of the day</p><p>in two parts</p></article>") for k in range(4)]
    assert html.main_text(copies[0], copies[1:]) == "Version 0\n\nThe whole story of the day\n\nin two parts"
    alone = html.lines("<div>Site name</div><article><p>The whole story of the day</p></article>")
    assert html.main_text(alone, []) == "The whole story of the day"


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
@settings(max_examples=150, deadline=None)
def test_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(html.common(a, b)) == best[-1][-1]


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
@settings(max_examples=100, deadline=None)
def test_cut_alignments_are_as_long(a, b):
    whole, table = len(html.common(a, b)), html.TABLE
    html.TABLE = 8
    try:
        assert len(html.common(a, b)) == whole
    finally:
        html.TABLE = table


@pytest.mark.parametrize("n", [500, 3000])
def test_long_pages_lose_their_whole_frame(n):
    """Repeated frame lines go from pages of any length; an early line with a late partner blocks nothing."""
    listing = lambda k: [("Late" if k else "Early", html.OUTSIDE), *[(t, html.OUTSIDE) for i in range(n) for t in (f"post {k} {i} {'z' * 20}", "Reply")], ("Early" if k else "Late", html.OUTSIDE)]
    assert "Reply" not in html.main_text(listing(0), [listing(1)]).split("\n\n")
    a, b = [-1, *range(n), *range(n)], [*range(n), *range(n), -1]
    assert html.common(a, b) == set(range(1, 2 * n + 1))


def plain_alignment(a, b):
    """Places in a of a longest common subsequence, by the whole table; of equal ways the one that ``html.common`` takes: fronts and
    ends of equal lines first, then from the end, a step in b where it loses nothing."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    i, j = len(a), len(b)
    while i > low and j > low and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    out = {*range(low), *range(i, len(a))}
    x = [k for k in range(low, i) if a[k] in b[low:j]]
    y = [v for v in b[low:j] if v in [a[k] for k in x]]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p, k in enumerate(x):
        for q, v in enumerate(y):
            best[p + 1][q + 1] = best[p][q] + 1 if a[k] == v else max(best[p][q + 1], best[p + 1][q])
    p, q = len(x), len(y)
    while p and q:
        if a[x[p - 1]] == y[q - 1]:
            out.add(x[p - 1])
            p, q = p - 1, q - 1
        elif best[p][q - 1] == best[p][q]:
            q -= 1
        else:
            p -= 1
    return out


@pytest.mark.parametrize("plain", [False, True])
def test_html_equals_brute_force_over_pages(spark, data, plain):
    """All pages, as they are and with plain elements for all that tells a frame, where the differences between pages decide."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    if plain:
        rows = [(i, u, re.sub(r"<(/?)(nav|article|footer|h1)\b[^>]*>", r"<\1div>", h or "").replace(' class="ad"', "")) for i, u, h in rows]
        rows = [(i, u, h.replace("<body>", f"<body><p>Welcome to {(u or '').split('/')[2]} and all of its many pages</p>")) for i, u, h in rows]
    places = {}
    for i, u, _ in rows:
        bare = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", u or "")
        places[i] = (bare.split("/", 1)[0].lower(), re.sub(r"[?#].*$", "", re.sub(r"^[^/]*", "", bare)), i, u)
    parsed = {i: html.lines(h or "") for i, _, h in rows}
    order, want = sorted(places.values()), {}
    for k, (host, _, i, _) in enumerate(order):
        near = [parsed[o[2]] for d in (-2, -1, 1, 2) if 0 <= k + d < len(order) for o in [order[k + d]] if o[0] == host]
        page = parsed[i]
        own = [t for t, w in page if w != html.FRAMED]
        at = [n for n, (_, w) in enumerate(page) if w != html.FRAMED]
        others = {tuple(t for t, w in n if w != html.FRAMED) for n in near} - {tuple(own), ()}
        met = [{at[m] for m in plain_alignment(own, list(o))} for o in others]
        shared = set().union(*(m for m in met if sum(len(page[n][0]) for n in m) <= html.COPY * sum(map(len, own))))
        every = set.intersection(*met) if len(met) > 1 else set()
        inside, outside = ({n for n, (_, w) in enumerate(page) if w == c} for c in (html.CONTENT, html.OUTSIDE))
        left, size = outside - shared - every, lambda x, page=page: sum(len(page[n][0]) for n in x)
        if not (inside <= every and size(inside) > size(left)):
            inside = inside - every
        if not others and size(inside) > size(outside):
            left = set()
        want[i] = "\n\n".join(t for n, (t, _) in enumerate(page) if n in inside | left)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for blocks in (1, 8, 400):
        assert {r["page_id"]: r["text"] for r in html.extract(df, blocks).collect()} == want
    if plain:  # frames that no element marks go by the differences alone
        hosts = Counter(o[0] for o in order)
        assert all("and all of its many pages" not in want[o[2]] for o in order if hosts[o[0]] > 2 and len(want[o[2]]) > 500)


def test_large_frames_go_and_blocks_do_not_matter(spark):
    """A frame of most of the text goes if several differing pages have it; every page has its neighbours, however pages are dealt out."""
    frame = "<div>Home and a very long menu of all the topics that this site has ever had</div><div>{}</div><div>All rights reserved by the owners of the site and by no others</div>"
    pages = [(k, f"http://h.example.com/a/{k:02}", page(frame.format(f"Note {k}"))) for k in range(20)] + [(50, None, None), (None, "http://z.example.com/", "<p>last</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {k: f"Note {k}" for k in range(20)} | {50: "", None: "last"}
    for blocks in (1, 7, 40):
        got = html.extract(df, blocks).collect()
        assert len(got) == len(pages) and {r["page_id"]: r["text"] for r in got} == want


def test_token_counts_equal_brute_force(docs, texts, odd, none):
    model = tokencount.Unigram(tokens.vocabulary_file("piece_bpe_32k.model"))

    def brute(word):
        m, best = tokencount.MARK + word, [(0.0, 0)]
        for e in range(1, len(m) + 1):
            n = len(m[e - 1].encode())
            c = [(best[e - 1][0] + n * model.byte, -(best[e - 1][1] + n))]
            c += [(model.score[m[b:e]] + best[b][0], -(best[b][1] + 1)) for b in range(max(0, e - model.longest), e) if m[b:e] in model.score]
            s, k = max(c)
            best.append((s, -k))
        return best[-1][1]

    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in tokencount.op4_token_counts(docs).collect()}
    seen = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for x in w:
            seen.setdefault(x, None) or seen.__setitem__(x, brute(x))
        assert got[k] == (len(w), sum(seen[x] for x in w))
    assert {r["n_tokens"] for r in tokencount.count_tokens(odd).where("doc_id in (1, 2, 3)").collect()} == {0}
    assert tokencount.count_tokens(odd).count() == len(ODD) and tokencount.count_tokens(none).count() == 0


def test_sharding_laws(docs, odd, none):
    for law in ("rows", "bytes"):
        got = sharding.shard_documents(docs, 16, law).toPandas()
        assert len(got) == docs.count() and got.doc_id.is_unique
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        if law == "rows":
            assert got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    got = sharding.op5_sharding(odd).toPandas()
    assert len(got) == len(ODD) and set(got.groupby("shard").size()) == {1}
    assert got[got.doc_id == 1]["size"].iloc[0] == 1 and got[got.doc_id == 4].text_crc32.iloc[0] == zlib.crc32(b"one")
    assert sharding.op5_sharding(none).count() == 0


def test_sharding_equals_a_walk(docs):
    """Each key by itself around the ring: the first shard clockwise from its place that has room."""
    nodes = {}
    for shard in range(16):
        for v in range(sharding.VIRTUAL_NODES):
            nodes.setdefault(int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % sharding.PLACES, shard)
    ring, n = sorted(nodes), docs.count()
    room = [n // 16 + (s < n % 16) for s in range(16)]
    place, order = F.pmod(F.xxhash64("doc_id"), F.lit(sharding.PLACES)), F.xxhash64("doc_id", F.lit(1))
    want = {}
    for r in sorted(docs.select(place.alias("place"), order.alias("order"), "doc_id").collect()):
        k = bisect_left(ring, r["place"])
        while not room[nodes[ring[k % len(ring)]]]:
            k += 1
        want[r["doc_id"]] = nodes[ring[k % len(ring)]]
        room[want[r["doc_id"]]] -= 1
    assert {r["doc_id"]: r["shard"] for r in sharding.op5_sharding(docs).collect()} == want


def test_sharding_moves_little(docs):
    one, two = (sharding.shard_documents(docs, n, "bytes", 0.25).toPandas().set_index("doc_id").shard for n in (16, 17))
    assert (one != two.loc[one.index]).mean() < 0.45


def brute_ids(name, stretch, rows, end):
    t = tokens.Encoder(tokens.vocabulary_file(name), stretch).tokenizer
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in rows], add_special_tokens=False)]


def test_packing_pieces(docs, texts, odd, none):
    for df, rows in ((docs, list(texts.items())), (odd.where("doc_id is not null and doc_id <> 7"), [(i, t) for i, t in ODD if i not in (None, 7)])):
        want = dict(zip([i for i, _ in rows], brute_ids("byte_bpe_50k.json", tokens.BYTE_LEVEL, [t for _, t in rows], 0), strict=True))
        got = packing.op6_packing(df).toPandas()
        for k, g in got.sort_values("start").groupby("doc_id"):
            assert list(g.start) == list(np.cumsum([0, *g.length])[:-1]) and g.length.sum() == len(want[k]) and set(g.doc_tokens) == {len(want[k])}
            assert all(zlib.crc32(np.array(want[k][s : s + n], "<u4").tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))
        assert set(got.doc_id) == set(want)
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g.length.sum() <= 1024 and list(g.offset) == list(np.cumsum([0, *g.length])[:-1])
        if df is docs:
            assert got.sequence_id.nunique() * 1024 / got.length.sum() < 1.02
    assert packing.op6_packing(odd).select("doc_id").distinct().count() == len({i for i, _ in ODD}) and packing.op6_packing(none).count() == 0


def test_packing_pads_little_in_small_partitions(docs):
    got = packing.op6_packing(docs.repartition(60)).toPandas()
    assert got.sequence_id.nunique() * 1024 / got.length.sum() < 1.02 and got.groupby("sequence_id").length.sum().max() <= 1024
    assert not got.duplicated(["sequence_id", "offset"]).any() and len(got.drop_duplicates(["doc_id", "start"])) == len(got)


@given(st.lists(st.integers(1, 128), min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_differencing(sizes):
    parts = packing.pack(sizes)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 1024 for p in parts) and len(parts) <= -(-sum(sizes) // 1024) + 2


PARTS = [*"ab Z1,.'\n\t\x1c\x85\xa0\u2000\u3000éÉ\u0301Σß中²½İ<|>\x00Ⅷ😀", "<|endoftext|>", "'s", "  ", "don't", "e\u0301"]


@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_stretches_encode_as_whole_texts(text):
    for name, stretch in (("byte_bpe_50k.json", tokens.BYTE_LEVEL), ("word_bpe_49k.json", tokens.WORD_LEVEL)):
        enc = tokens.encoder(tokens.vocabulary_file(name), stretch)
        ids, n = enc.encode([text, "x " + text])
        want = [e.ids for e in enc.tokenizer.encode_batch([text, "x " + text], add_special_tokens=False)]
        assert ids.tolist() == want[0] + want[1] and n.tolist() == [len(want[0]), len(want[1])]


def test_stretches_of_a_run_are_looked_up_once():
    class Counted(tokens.Places):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    texts = ["the cat, (12) \u00e9t\u00e9 don't\n" * 3000, "", "a\u00d7b 1\u00e9 (\u00c9t\u00e9) \u0130x \u024f\u0250 ##", " \u3000 the\u00a0cat ", "of <|endoftext|> the", "the"]
    for name, stretch in (("byte_bpe_50k.json", tokens.BYTE_LEVEL), ("word_bpe_49k.json", tokens.WORD_LEVEL)):
        looked, enc = [], tokens.Encoder(tokens.vocabulary_file(name), stretch)
        enc.place = Counted()
        ids, n = enc.encode(texts)
        want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
        assert len(looked) == len(set(looked)) < 60


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "_KEPT", 30)
    enc = tokens.Encoder(tokens.vocabulary_file("byte_bpe_50k.json"), tokens.BYTE_LEVEL)
    for k in range(20):
        text = " ".join(f"alpha{k}x{i % 7} the" for i in range(30))
        assert enc.encode([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_shrinks_between_tasks(monkeypatch):
    monkeypatch.setattr(tokens, "_BETWEEN", 20)
    enc = tokens.Encoder(tokens.vocabulary_file("byte_bpe_50k.json"), tokens.BYTE_LEVEL)
    for k in range(5):
        text = " ".join(f"alpha{k}x{i % 7} the née {i}" for i in range(60))
        for _ in range(2):
            assert enc.encode([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(enc.place) > 20
        enc.shrink()
        assert 0 < len(enc.place) <= 20 and b" the" in enc.place


@pytest.mark.parametrize("step", [minhash._signed, minhash._sets, packing._pieces(tokens.vocabulary_file("byte_bpe_50k.json"), 1024, 128, 128), decontam._clean([decontam.Block(["a"], [LINE], 10)])])
def test_workers_give_memory_back(monkeypatch, step):
    calls, give = [], common.release
    monkeypatch.setattr(common, "release", lambda: calls.append(give()))
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(tokens, "_BETWEEN", 50)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [" ".join(f"w{k * i}" for i in range(2000)) for k in range(40)]})
    assert len(list(step(iter([batch])))) > 0 and len(calls) == 1
    assert len(common._POWERS[0]) == 1 and all(len(e.place) <= 50 for e in tokens._ENCODERS.values())
    broken_off = step(iter([batch, batch]))
    next(broken_off)
    broken_off.close()
    assert len(calls) == 2


@pytest.mark.parametrize("f", [lambda s, d: minhash.near_duplicates(d), lambda s, d: packing.pack_documents(d), lambda s, d: decontam.remove_contaminated(d, s.createDataFrame([("a", LINE)], "item_id string, text string"))])
def test_texts_come_in_bounded_batches(spark, f):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    wide = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 15000) AS text")
    f(spark, wide)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    got = wide.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 200 and max(r["size"] for r in got) <= common.CHUNK_BYTES + 100_000


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60), st.integers(6, 12))
@settings(max_examples=60, deadline=None)
def test_code_lengths(counts, limit):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[counts > 0]
    assert (lengths[counts == 0] == 0).all() and (used <= limit).all()
    if len(used) > 1:
        assert abs((0.5**used).sum() - 1) < 1e-12


def test_code_lengths_are_best():
    counts = np.array([40, 30, 20, 10, 5, 5, 1])
    import heapq

    heap, k, cost = [(int(c), i) for i, c in enumerate(counts)], 100, 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost, k = cost + a[0] + b[0], k + 1
        heapq.heappush(heap, (a[0] + b[0], k))
    assert (huffman.code_lengths(counts, 18) * counts).sum() == cost


def test_block_round_trip():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 5000), 40_000)
    book = huffman.Codebook(*(lambda lengths: (np.flatnonzero(lengths), lengths[np.flatnonzero(lengths)]))(huffman.code_lengths(np.bincount(ids), 18)))
    sizes = np.array([0, 1, 4000, 999])
    payload = huffman.encode_block([5, None, 7, -8], sizes, ids, *book.encoder())
    empty, one = (huffman.encode_block(d, np.array(s, np.int64), np.array(x, np.int64), *book.encoder()) for d, s, x in (([], [], []), ([9], [1], ids[:1])))
    for group in ([payload], [empty, payload, one, payload], [one, empty]):
        for raw, (docs, n, back) in zip(group, huffman.decode_blocks(group, book.decoder(), book.bits), strict=True):
            want = {payload: ([5, None, 7, -8], sizes.tolist(), ids.tolist()), empty: ([], [], []), one: ([9], [1], ids[:1].tolist())}[raw]
            assert (docs, n.tolist(), back.tolist()) == want
    with pytest.raises(ValueError):
        huffman.decode_blocks([b"nope" + payload[4:]], book.decoder(), book.bits)


def test_token_binary_round_trip(docs, texts, odd, none):
    got = huffman.op7_token_binary(docs).toPandas().sort_values("doc_id")
    want = brute_ids("word_bpe_49k.json", tokens.WORD_LEVEL, [texts[k] for k in sorted(texts)], 2)
    assert list(got.start) == list(np.cumsum([0, *map(len, want)])[:-1]) and list(got.n_tokens) == list(map(len, want))
    assert list(got.ids_crc32) == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    got = huffman.op7_token_binary(odd).toPandas().sort_values("start")
    assert len(got) == len(ODD) and got.doc_id.isna().iloc[:2].all() and got.doc_id.iloc[2:].is_monotonic_increasing
    assert huffman.op7_token_binary(none).count() == 0


def test_quality_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in quality.op8_quality_rules(odd).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[9]["n_words"] == 30_000 and got[10]["word_chars"] == 60_000 and got[6]["n_dup_lines"] == 1 and got[6]["n_repeat_words"] == 30
    assert quality.filter_documents(odd).columns == odd.columns and quality.op8_quality_rules(none).count() == 0


def test_quality_follows_labels(spark):
    base = "/root/testdata/sf0.01"
    got = quality.op8_quality_rules(spark.read.parquet(f"{base}/documents.parquet")).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id")
    rows = Counter((r["quality"], r["kept"]) for r in got.where("not base_failed").collect())
    assert rows[1, False] == 0 and rows[0, True] == 0


def test_decontamination_blocks_and_odd_rows(spark, odd, none, docs, data):
    items = spark.createDataFrame([(1, LINE), (2, "one"), (3, None), (4, ""), (None, LINE), (5, "over the LAZY")], "item_id long, text string")
    got = defaultdict(list)
    for r in decontam.op9_decontamination(odd, items).collect():
        got[r["doc_id"]].append(r)
    assert got[1][0]["n_words"] == 0 and not got[1][0]["contaminated"] and got[1][0]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[4][0]["n_hit"] == 1 and got[4][0]["items_sha256"] == hashlib.sha256(b"2").hexdigest()
    assert got[12][0]["n_hit"] == 15 and got[12][0]["items_sha256"] == hashlib.sha256(b"1,5").hexdigest()
    assert got[8][0]["n_hit"] == 11 and got[8][0]["n_items"] == 2
    assert decontam.op9_decontamination(none, items).count() == 0 and decontam.op9_decontamination(odd, items.limit(0)).where("contaminated").count() == 0
    kept = decontam.remove_contaminated(odd, items)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} & {4, 5, 6, 8, 12} == set()
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    one, many = (sorted(map(str, decontam.contamination(docs, bench, limit=n).select("doc_id", "n_words", "n_hit", "items").collect())) for n in (1 << 22, 3000))
    assert one == many


def test_decontamination_judges_each_row(odd, spark, monkeypatch):
    """Null and repeated ids are rows of their own, for one block of the benchmark and for several."""
    items = spark.createDataFrame([(1, LINE), (2, "two"), (3, "nothing of this kind")], "item_id long, text string")
    monkeypatch.setattr(decontam, "AT_ONCE", 2)
    for limit in (1 << 22, 1):  # a single pass, and two
        found = decontam.contamination(odd, items, limit=limit).collect()
        assert sorted((str(r["doc_id"]), r["n_hit"]) for r in found if r["doc_id"] in (None, 7)) == [("7", 0), ("7", 30), ("7", 30), ("None", 0), ("None", 15)]
        assert len(found) == len(ODD)
        kept = decontam.remove_contaminated(odd, items, limit=limit)
        assert kept.columns == odd.columns
        assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect() if r["doc_id"] in (None, 7)) == [("7", "another text under one id"), ("None", None)]


def test_suffix_array_order():
    rng = np.random.default_rng(4)
    x = np.append(rng.integers(1, 4, 60), 0)
    order = decontam.suffix_array(x, np.arange(60), 64)
    suffixes = [tuple(x[k:]) for k in order]
    assert suffixes == sorted(suffixes)


def test_union_of_spans(spark):
    rng = np.random.default_rng(6)
    rows = [[(int(a), int(a + n)) for a, n in zip(rng.integers(0, 30, k), rng.integers(1, 6, k), strict=True)] for k in (0, 1, 2, 5, 12)]
    df = spark.createDataFrame([(k, [x for p in r for x in p]) for k, r in enumerate(rows)], "k int, spans array<long>")
    for r in df.withColumn("u", decontam.union(F.col("spans"))).collect():
        hit = sorted({x for a, b in rows[r["k"]] for x in range(a, b)})
        assert [x for a, b in zip(r["u"][::2], r["u"][1::2], strict=True) for x in range(a, b)] == hit


def test_longest_match(spark):
    items = spark.createDataFrame([(1, " ".join(f"k{i}" for i in range(40)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(f"k{i}" for i in range(5, 30)) + " b")], "doc_id long, text string")
    r = decontam.contamination(docs, items).first()
    assert r["longest_match"] == 25 and r["spans"] == [1, 26] and r["n_hit"] == 25


def clause_scores(g, text):
    return [x[0] for x in g.clauses([*toxicity._TOKEN.findall(text.lower()), "."])]


def test_grammar_states():
    g = toxicity.Grammar({"idiot": 3.0, "mor*": 1.0, "moron*": 2.0})
    plain, denied, quoted, aimed, after = (clause_scores(g, t) for t in ("an idiot here", "not an idiot", "it said idiot", "you idiot", "idiot, said nobody. an idiot you"))
    assert plain == [3.0] and denied == [3.0 * toxicity.DENIED_FACTOR] and aimed[0] == 3.0 * toxicity.AIMED_FACTOR and after[1] == aimed[0]
    assert quoted == [3.0 * toxicity.REPORTED_FACTOR] == clause_scores(g, "the \u201cidiot\u201d there") == clause_scores(g, "\u201ca b. idiot. c\u201d")
    assert clause_scores(g, "\u201ca b.\u201d an idiot") == [3.0]
    assert g.weight("moronic") == 2.0 and g.weight("mo") == 0.0 and not any(g.features(""))


def test_grammar_threats():
    g = toxicity.Grammar({"idiot": 3.0})
    threat = lambda t: g.features(t)[5]
    assert threat("i will kill you") > threat("kill you") > 0 == threat("we kill time") == threat("die Frau sagt, sie hat die Blumen")
    assert threat("you will die") > 0 and threat("ich werde dich töten") > 0 and threat("i will never kill you") < threat("i will kill you")
    quote = "she said \u201ci will kill you\u201d"
    assert 0 < threat(quote) < threat("i will kill you") and clause_scores(g, "we, the idiot") == [3.0]


def test_grammar_is_the_product_of_its_parts():
    """Each path of the composed automaton is that of its five parts."""
    parts = (toxicity.INSULTED, toxicity.THREATENING, toxicity.AIMED, toxicity.DENIED, toxicity.REPORTED)
    rng, state, own = np.random.default_rng(3), 0, [0] * 5
    for symbol in rng.integers(0, toxicity.END + 1, 3000):
        state, own = toxicity.NEXT[state][symbol], [p.step(x, symbol) for p, x in zip(parts, own, strict=True)]
        assert toxicity.STATES[state] == tuple(own)


def test_states_change_scores(spark):
    """With the same words, where they stand decides: aimed insults are learned as toxic, denied ones as clean."""
    rng = np.random.default_rng(7)
    rows, marks = [], []
    for k in range(1, 1500):
        toxic = int(rng.integers(0, 2))
        parts = ["you are an idiot", "the weather is not bad"] if toxic else ["you are not an idiot", "the weather is bad"]
        rows.append((k, ". ".join(parts[:: 1 if rng.integers(0, 2) else -1])))
        marks.append((k, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    link = toxicity.fit_link(np.array([toxicity.Grammar({"idiot": 3.0}).features(t) for _, t in rows]), np.array([t for _, t in marks], float))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, {"idiot": 3.0}, link).collect()}
    assert all((got[k] >= 0.5) == bool(t) for k, t in marks) and labels.count() == len(marks)


def test_toxicity_ties_and_repeated_rows(spark):
    rows = [(k, "you idiot" if k % 2 else "a calm day") for k in range(400)] + [(1, "you idiot")] * 3
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(5, 0)], "doc_id long, toxic int")
    got = toxicity.op10_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == 403 and {(r["doc_id"] % 2, r["predicted"]) for r in got} == {(0, 0), (1, 1)}


def test_toxicity_learns(spark, odd, none):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = toxicity.op10_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert set(got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5)) == {0}
    right = got[got.predicted == 1].toxic
    assert right.mean() > 0.9 and right.sum() / got.toxic.sum() > 0.85 and got.score.between(0, 1).all()
    few = toxicity.op10_toxicity(odd, labels.limit(0)).collect()
    assert len(few) == len(ODD) and all(r["score"] < 0.5 for r in few) and toxicity.op10_toxicity(none, labels).count() == 0


def test_stages_leave_other_results_alone(spark, data, docs):
    """A result that is held lazily lives through the pipeline; what the stages wrote is gone when the next one starts."""
    held = minhash.op1_minhash_dedup(docs)
    n = corpus_pipeline.run(spark, data).count()
    first = list(corpus_pipeline._WRITTEN)
    assert n > 0 and held.count() == docs.count()
    corpus_pipeline.STAGES[0][1](spark, docs, data)
    assert not set(first) & set(corpus_pipeline._WRITTEN)


def test_pipeline(spark, data, texts):
    """Each stage against a brute-force version of it."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in seen.select("doc_id", "text").collect()}
        path = f"{spark.conf.get('spark.checkpoint.dir', '/tmp')}/pipeline-test-{name}"
        stage(spark, seen, data).write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        if name == "packing":
            want = dict(zip(before, brute_ids("byte_bpe_50k.json", tokens.BYTE_LEVEL, before.values(), 0), strict=True))
            assert {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {k: len(v) for k, v in want.items()}
            break
        now = {r["doc_id"]: r["text"] for r in after.select("doc_id", "text").collect()}
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality.op8_quality_rules(docs).where("kept").collect()}
            assert set(now) == kept
        elif name == "line_dedup":
            gone = gone_lines(sorted(before.items()))
            want = {k: "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone) for k, t in before.items()}
            assert now == {k: t for k, t in want.items() if t.strip() or t == before[k]}
        elif name == "near_duplicates":
            assert set(now) == {k for k, (_, c) in grouped(before).items() if c == k}
        else:
            hit = {r["doc_id"] for r in decontam.contamination(seen, spark.read.parquet(f"{data}/benchmark.parquet")).where("n_hit > 0").collect()}
            assert set(now) == set(before) - hit
        assert after.columns == docs.columns
        seen = after
    assert corpus_pipeline.run(spark, data).select("doc_id").distinct().count() == len(before)


def test_stages_on_odd_rows(spark, data, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, data)
        got.collect()
        assert stage(spark, none, data).count() == 0
        if name != "packing":
            assert got.columns == odd.columns
