import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenweir.llm import divergence, html, importance, ppm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the quick brown fox jumps over the lazy dog near the old river bank today"
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "one", "en", "b"), (4, "one", "en", "b"), (5, LINE, "en", "a"), (5, "another text", "de", "a"),
    (None, LINE, "en", "a"), (None, None, None, None), (6, " ".join(f"w{i % 700}" for i in range(30_000)), "en", "c"), (7, "x" * 60_000, "fr", "a"), (8, "né à \x00 \x1c 中文 😀 don't", "fr", "b"), (9, LINE.upper(), "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, source, len(t or ""), "c", 1, 2, 3, 4, "q") for i, t, lang, source in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", term string, n int, chunk int, place int, weight int, `a.b` string")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def low(text):
    return (text or "").encode().lower()


# --- source divergence


def brute_divergence(rows, min_docs):
    """All arithmetic in whole numbers, over every term and pair."""
    own, within, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = [w.decode() for w in re.findall(rb"[a-z\x80-\xff]+", low(text))]
        own[lang or "", source or ""].update(words)
        within[lang or ""].update(words)
        seen[lang or ""].update(set(words))
    out = set()
    for (lang, source), counts in own.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = share(counts), share(within[lang])
        pairs = []
        for (other_lang, other), c in own.items():
            if other_lang == lang and other != source:
                r = share(c)
                pairs.append((other, sum(gap(p[t], r[t]) for t in kept)))
        terms = [(t, gap(p[t], q[t])) for t in kept if counts[t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, divergence.TOP)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])}
    return out


def ranked(docs, min_docs, **sizes):
    from pyspark.sql import Window

    pairs, terms = divergence.divergences(docs, min_docs, **sizes)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    with_rank = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    rows = with_rank(pairs, "pair").unionByName(with_rank(terms, "term").where(F.col("rank") <= divergence.TOP))
    return {tuple(r) for r in rows.collect()}


@pytest.mark.parametrize("tile", [2, 256])
def test_divergence_equals_brute_force(spark, odd, tile):
    """In one block of sources and in many; with chunks of few terms; heavy and light terms, hot sources, groups without terms."""
    assert ranked(odd, 1, tile=tile, chunk=60) == brute_divergence(ODD, 1)
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"t{chr(97 + int(x) % 26)}{chr(97 + int(x) // 26 % 26)}" for x in rng.zipf(1.3, 30) % 400), "en", f"s{int(rng.integers(0, 9)) if k % 3 else 0}") for k in range(150)]
    rows += [(k, None, "en", "empty") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert ranked(df, 5, tile=tile, chunk=60) == brute_divergence(rows, 5)


def test_divergence_odd_rows(odd):
    got = divergence.op11_divergence(odd).collect()
    assert {(r["lang"], r["source"]) for r in got} >= {("en", "a"), ("en", ""), ("", "a"), ("", "")}
    assert {r["value"] for r in got if r["part"] == "pair"} == {0}  # no term is in ten documents
    assert divergence.op11_divergence(odd.limit(0)).count() == 0


def test_tiles_of_any_size_give_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    side = lambda n: (rng.integers(0, 12, 40), rng.integers(0, n, 40))
    terms = []
    for n in (4, 5):
        term, place = (np.array(x) for x in zip(*sorted(set(zip(*side(n), strict=True))), strict=True))
        terms.append((term, place, rng.integers(5, 900, len(term)), rng.integers(1, 5, n)))
    absent = divergence._gap(terms[0][3][:, None], terms[1][3][None, :])
    every = np.arange(12)
    want = divergence._heavy(every, *terms, absent)
    assert (divergence._light(*terms, absent) == want).all()
    monkeypatch.setattr(divergence, "_CELLS", 3)
    assert (divergence._heavy(every, *terms, absent) == want).all() and (divergence._light(*terms, absent) == want).all()


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = b"alpha beta gamma " * 30 + b"x" * 100
    want = divergence._TERM.findall(text)
    monkeypatch.setattr("tokenweir.llm.common.PIECE", 7)
    found = list(divergence.pieces(text, divergence._BREAK))
    assert len(found) > 20 and b"".join(found) == text and [w for p in found for w in divergence._TERM.findall(p)] == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**52), st.integers(0, 2**52), st.integers(1, 10**6))
def test_shares_are_exact(n, more, kept):
    total = n + more
    got = divergence._share(np.array([n]), np.array([total + 2 * kept]))[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


# --- importance resampling


def brute_resample(rows, target, size, buckets, percent, least, seed):
    def grams(text):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", low(text))
        return len(w), Counter(zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, size + 1) for i in range(len(w) - n + 1))

    own = [(i, *grams(t)) for i, t in rows]
    s, t = sum((c for _, _, c in own), Counter()), sum((grams(x)[1] for x in target), Counter())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, n, c in own:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for k, r in enumerate(fit):
        r.append(k + 1 if k < percent * len(fit) // 100 else None)
    return sorted(map(str, (r if len(r) == 6 else [*r, None] for r in out)))


@pytest.mark.parametrize("size,buckets", [(1, 10_000), (2, 70_000), (3, 97)])
def test_resampling_equals_brute_force(docs, odd, spark, data, size, buckets):
    target = spark.read.parquet(f"{data}/benchmark.parquet")
    goal = [r["text"] for r in target.collect()]
    for df, percent in ((docs, 10), (odd, 60)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = importance.resample(df, target, size, buckets, percent, 5).collect()
        assert sorted(str(list(r)) for r in got) == brute_resample(rows, goal, size, buckets, percent, 5, importance.SEED)


def test_resampling_of_nothing(odd, spark, data):
    target = spark.read.parquet(f"{data}/benchmark.parquet")
    assert importance.op12_importance(odd.limit(0), target).count() == 0
    got = importance.op12_importance(odd, target.limit(0)).collect()
    assert len(got) == len(ODD) and all(r["weight"] == 0 for r in got if not r["n_features"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), min_size=1, max_size=6), st.integers(1, 4))
def test_suffix_runs(texts, size):
    ids = np.array([w for t in texts for w in t], np.int64)
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    order, prefix = importance.suffixes(ids, ends, size)
    tails = [tuple(ids[at : min(at + size, ends[at])]) for at in order]
    assert tails == sorted(tails)
    for k in range(1, len(tails)):
        same = 0
        while same < min(len(tails[k]), len(tails[k - 1])) and tails[k][same] == tails[k - 1][same]:
            same += 1
        assert prefix[k] == same


def test_runs_of_any_size_give_the_same(docs, monkeypatch):
    batch = docs.select("doc_id", "text").toArrow().combine_chunks().to_batches()
    run = importance._featured(2, 10_000)
    one = sorted(map(str, (r for b in run(iter(batch)) for r in b.to_pylist())))
    monkeypatch.setattr(importance, "RUN_BYTES", 1)
    monkeypatch.setattr("tokenweir.llm.common.PIECE", 50)
    assert sorted(map(str, (r for b in run(iter(batch)) for r in b.to_pylist()))) == one


# --- language model


class Brute:
    """Prediction by partial matching from its definition: a byte at a time, with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            data = b"\n" * order + t + b"\n"
            for at in range(order, len(data)):
                for k in range(order + 1):
                    self.after[data[at - k : at]][data[at]] += 1

    def cost(self, context, byte):
        out, gone = 0.0, set()
        for k in range(self.order, -1, -1):
            own = self.after.get(context[len(context) - k :])
            if own is None:
                continue
            left = {b: n for b, n in own.items() if b not in gone}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if byte in left:
                return out + math.log10(left[byte] / total)
            out += math.log10(len(left) / total)
            gone |= set(left)
        return out - math.log10(ppm.SYMBOLS - len(gone))

    def score(self, text):
        data = b"\n" * self.order + text + b"\n"
        return sum(self.cost(data[at - self.order : at], data[at]) for at in range(self.order, len(data)))


def brute_scores(rows, order):
    tokens = [(i, re.findall(rb"[^\x20\x09-\x0D]+", low(t))) for i, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows]
    model = Brute([b" ".join(w) for (_, w), h in zip(tokens, held, strict=True) if not h], order)
    counts = Counter(w for (_, ws), h in zip(tokens, held, strict=True) if not h for w in [*ws, b"\n"])
    n, kinds = counts.total(), len(counts)
    out = []
    for (i, ws), h in zip(tokens, held, strict=True):
        own = [counts[w] for w in [*ws, b"\n"]]
        out.append((i, h, len(own), sum(c > 0 for c in own), n, sum(math.log10((c + 0.5) / (n + 0.5 * (kinds + 1))) for c in own), model.score(b" ".join(ws))))
    return sorted(out, key=str)


def equal(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("order", [0, 2, 5])
def test_scores_equal_brute_force(odd, order):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    equal(ppm.score(odd, ppm.is_held(F.col("doc_id")), order).collect(), brute_scores(rows, order))


def test_scores_of_documents(docs):
    some = docs.where("n_chars < 700")
    rows = [(r["doc_id"], r["text"]) for r in some.select("doc_id", "text").collect()]
    equal(ppm.op13_language_model(some).collect(), brute_scores(rows, ppm.ORDER))


@pytest.mark.parametrize("order", [0, 1, 5])
def test_slices_give_the_same_leaves(monkeypatch, order):
    texts = [b"", b"one", b" \n ", b"The quick  brown\tfox " * 20, b"x" * 50, b"a b c d e f g h", b"y" * 9, b"z" * 18]
    bodies = [ppm.normal(t) for t in texts]
    assert bodies[3] == b" ".join([b"the quick brown fox"] * 20)
    whole = [np.concatenate(x) for x in zip(*ppm.leaves(bodies, order), strict=True)]
    tokens = [[w for part in ppm.tokens_of(b) for w in part] for b in bodies]
    assert (np.bincount(whole[1]) == [len(b) + 1 for b in bodies]).all() and tokens == [[*b.split(), b"\n"] for b in bodies]
    monkeypatch.setattr(ppm, "SLICE", 9)
    monkeypatch.setattr("tokenweir.llm.common.PIECE", 4)
    cut = [np.concatenate(x) for x in zip(*ppm.leaves(bodies, order), strict=True)]
    assert (cut[0] == whole[0]).all() and (cut[1] == whole[1]).all() and [ppm.normal(t) for t in texts] == bodies
    assert [[w for part in ppm.tokens_of(b) for w in part] for b in bodies] == tokens


def test_chunks_hold_their_texts(monkeypatch):
    """However a partition is cut: every text once, and sums of leaves and tokens that do not depend on the cuts."""
    ids, texts = [1, 2, None, 4, 5], ["a b a", None, "", "c" * 30, "a b a"]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([False, True, False, False, True]), pa.array(texts, pa.string())], ["doc_id", "held", "text"])
    sums = []
    for size in (1, 12, 1 << 20):
        monkeypatch.setattr(ppm, "CHUNK_BYTES", size)
        rows = [r for b in ppm._listed(3)(iter([batch])) for r in b.to_pylist()]
        assert [i for r in rows if r["texts"] is not None for i in r["doc_ids"]] == ids and len({r["chunk"] for r in rows}) == sum(r["texts"] is not None for r in rows)
        own = Counter()
        for r in rows:
            if r["texts"] is None:
                own[None if r["token"] is not None else r["leaf"], r["token"]] += r["n"]
        sums.append(own)
    assert sums[0] == sums[1] == sums[2] and sums[0][None, b"a"] == 2 and sums[0][None, b"\n"] == 3


def test_memory_of_a_chunk(monkeypatch, spark):
    """Rows go to Spark in small batches, and neither leaves nor tokens of a task grow with what its texts hold."""
    letters = np.random.default_rng(7).integers(97, 123, (6000, 1000), np.uint8)
    letters[:, ::9] = 32
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000), pa.int64()), pa.array([k % 5 == 1 for k in range(6000)]), pa.array([x.tobytes().decode() for x in letters])], ["doc_id", "held", "text"])
    tracemalloc.start()
    sizes = [(len(b), b.nbytes, len(b.column("texts").drop_null())) for b in ppm._listed(5)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(n for n, *_ in sizes) <= ppm.ROWS and max(n for _, n, text in sizes if not text) < 8 << 20
    assert peak < 250 << 20, peak
    for name in ("LEAVES", "TOKENS"):
        monkeypatch.setattr(ppm, "WAITING", 10_000)
        with monkeypatch.context() as patch:
            patch.setattr(ppm, name, 50_000)
            patch.setattr(ppm, "SLICE", 1 << 14)
            chunks = Counter()
            ids = []
            for b in ppm._listed(5)(iter([batch.slice(0, 1000)])):
                chunks.update(b.filter(b.column("token" if name == "TOKENS" else "leaf").is_valid()).column("chunk").to_pylist())
                ids += [i for own in b.column("doc_ids").drop_null().to_pylist() for i in own]
            assert ids == list(range(1000)) and len(chunks) > 1 and max(chunks.values()) < 400_000
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        ppm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_probabilities_sum_to_one():
    model = Brute([b"abracadabra", b"abc abd"], 3)
    symbols = [b for b in range(256) if b not in (9, 11, 12, 13)]
    for context in (b"\n\n\n", b"abr", b"xab", b"qqq", b"abc"):
        assert sum(10 ** model.cost(context, b) for b in symbols) == pytest.approx(1)


def test_scores_of_nothing(odd, spark):
    assert ppm.op13_language_model(odd.limit(0)).count() == 0
    alone = ppm.score(odd.where("doc_id = 4"), F.lit(True)).collect()
    assert len(alone) == 2 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(-4 * math.log10(ppm.SYMBOLS)) for r in alone)
    with pytest.raises(ValueError, match="bytes"):
        ppm.score(odd, F.lit(True), 7)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**48), min_size=1, max_size=300))
def test_lookup(keys):
    own = np.array(sorted(keys), np.int64)
    find = ppm.Lookup(own, own * 2)
    assert (find(own[::-1]) == own[::-1] * 2).all()


# --- main text: what is an article's stays


def test_articles_keep_what_they_share():
    """A sentence that all articles of a host hold stays in its place; plain lines at the ends of all of them go."""
    said = "The river rose again on the third day of the flood"
    pages = [html.lines(f"<main><div>Home and all topics</div><p>Story {k} begins {'x' * (k + 30)}</p><p>{said}</p><p>Story {k} ends {'y' * (k + 30)}</p><div>Read more of us</div></main>") for k in range(6)]
    for k in range(6):
        text = html.main_text(pages[k], [pages[i] for i in (k - 2, k - 1, k + 1, k + 2) if 0 <= i < 6])
        assert text == f"Story {k} begins {'x' * (k + 30)}\n\n{said}\n\nStory {k} ends {'y' * (k + 30)}"


@pytest.mark.parametrize("name,frame", [("related-work", False), ("share-prices", False), ("ad-hoc", False), ("commentary", False), ("header-image-of-the-day", False), ("ad", True), ("site-footer", True), ("footer-links", True), ("nav__item", True), ("ads-300x250", True), ("related-posts", True), ("main comments", True), ("Cookie-Banner", True)])
def test_names_of_frames_are_whole(name, frame):
    for kind in ("class", "id"):
        got = html.lines(f'<article><p>One</p><div {kind}="{name}">Two</div></article>')
        assert dict(got) == {"One": html.CONTENT, "Two": html.FRAMED if frame else html.CONTENT}


def texts_of(markup):
    """The parser alone, held against blocks found by splitting well-formed markup at its block elements."""
    import html as entities

    flat = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", markup, flags=re.S)
    parts = re.split(r"</?(?:html|body|article|main|nav|footer|aside|div|p|ul|li|h1|h2|section)\b[^>]*>", flat)
    return [t for t in (" ".join(entities.unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"</?(?:a|b|i|em|span|strong)\b[^>]*>", "", p))).split()) for p in parts) if t]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.sampled_from(["one", "t&eacute;xt &amp; more", "<b>bold</b> <i>word</i>", "a<br>b", "  ", "<script>x('<p>')</script>", "<!-- <p>no</p> -->", "&#20013;"]), lambda inner: st.tuples(st.sampled_from(["div", "section", "main", "article", "ul"]), st.lists(inner, max_size=4)).map(lambda x: f"<{x[0]}>" + "".join(x[1]) + f"</{x[0]}>"), max_leaves=12))
def test_parser_finds_the_blocks(markup):
    assert [t for t, _ in html.lines(f"<html><body>{markup}</body></html>")] == texts_of(f"<html><body>{markup}</body></html>")
