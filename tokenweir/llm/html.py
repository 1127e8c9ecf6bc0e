"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines, one for each block of its markup. Pages are sorted by host, path and id, and each is paired
with its nearest neighbours there: NEIGHBOURS pages before and after it of the same host. The lines of a pair are aligned by
their longest common subsequence; lines that both pages share are the site's frame and are deleted.

A line outside of the page's article and main elements goes when one neighbour has it, too. A line inside them goes when
every neighbour that differs from the page has it, there are two at least, and only such lines stand between it and an end of
those elements: single lines recur in articles by chance, and articles of a site share sentences.
Sites repeat whole articles: where nothing would be left of the article and main elements and they hold more text than is
left outside of them, they are a copy and stay. A neighbour that shares most of the page's text beside its frame
elements may be a copy or have the same large frame: of it only those lines count that every other differing neighbour has. Lines in elements that are never content (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments, by element, role or class) go with or without a neighbour. A page with no
neighbour to tell its frame is cut to its article and main elements if they hold most of its text.

Defined cases: null and empty html give an empty text of 0 characters; a page without a block gives an empty text; a tag that
never ends is dropped, as is an entity that names nothing kept as it stands; a null url is a host of its own; rows of one
page_id are pages of their own; extra columns are ignored. Pages are dealt to blocks by ranges of their keys; a block also
gets the pages next to it on both sides, so what a page is compared with does not depend on the blocks.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import accumulate, takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEIGHBOURS = 2
#: Blocks of pages for each shuffle partition, and keys looked at for each block.
DEALT = 6
SAMPLED = 8
#: Part of a page's text that a neighbour must share to be taken for a copy.
COPY = 0.8
#: Bits of an alignment table that is held at once; a larger one is cut in two, without a loss.
TABLE = 1 << 24

# HTML elements and class words, by what they hold.
NO_TEXT = "script style noscript template svg math iframe object embed canvas audio video map head title select option datalist textarea".split()
FRAME = "nav footer aside form button dialog menu".split()
BLOCKS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
FRAME_WORDS = "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
#: What may follow such a word in a name that is still one of a frame: "footer-links", but not "related-work" or "share-prices".
PART_WORDS = "area articles bar block body bottom box button buttons center col column container content end group icon icons info inner item items label layer left line link links list logo main message outer overlay panel posts primary right row secondary section slot start stories strip tabs text tile title top trail unit wrap wrapper zone".split()
ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(?=[a-zA-Z/])[^<]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[-_:.]+")
_BLANK = re.compile(r"\s+")
_NO_TEXT, _FRAME, _BLOCKS, _VOID, _FRAME_WORDS, _PART_WORDS, _ROLES = map(frozenset, (NO_TEXT, FRAME, BLOCKS, VOID, FRAME_WORDS, PART_WORDS, ROLES))
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title")}

CONTENT, OUTSIDE, FRAMED = 0, 1, 2


def _names_frame(name: str) -> bool:
    """Whether a class or an id is that of a frame: its last word says what it is, but for words of parts and numbers behind it."""
    words = [w for w in _PARTS.split(name.lower()) if w]
    while len(words) > 1 and (words[-1] in _PART_WORDS or not words[-1].isalpha()):
        words.pop()
    return bool(words) and words[-1].rstrip("0123456789") in _FRAME_WORDS


def _framed(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element never holds content. A header inside an article holds its title."""
    if tag in _FRAME or tag == "header" and not inside:
        return True
    if not attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and any(map(_names_frame, value.split())):
            return True
    return False


def lines(html: str) -> list[tuple[str, int]]:
    """The blocks of a page, in page order, with where each stands: in the article or main element, outside of it, or in a frame element."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, frame, article or main
    frames = mains = 0

    def close() -> None:
        if text:
            whole = _BLANK.sub(" ", entities.unescape("".join(text))).strip()
            if whole:
                out.append((whole, FRAMED if frames else CONTENT if mains else OUTSIDE))
            text.clear()

    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCKS:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(s[1] or s[2] for s in stack[k:]) or tag in _BLOCKS:
                        close()
                    for _, frame, main in stack[k:]:
                        frames -= frame
                        mains -= main
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "nav", "aside", "footer", "header", "body") and tag not in ("html", "body"):
                    break  # a stray end does not close what holds it
            continue
        if tag in _NO_TEXT and tag not in ("head", "map", "math", "select"):
            end = _RAW_END.get(tag)
            if end is not None:
                m = end.search(html, at)
                at = m.end() if m else len(html)
            continue
        if tag in _BLOCKS:
            close()
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):  # an open one ends here
                same = {"p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, (tag,))
                if stack and stack[-1][0] in same:
                    _, frame, main = stack.pop()
                    frames -= frame
                    mains -= main
        elif tag == "br":
            text.append(" ")
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCKS:
            continue
        frame, main = _framed(tag, m[3], mains > 0) or tag in ("head", "select"), tag in ("article", "main")
        if frame:
            close()
        stack.append((tag, frame, main))
        frames += frame
        mains += main
    close()
    return out


def common(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, at every length."""
    out: set[int] = set()
    low, top = 0, min(len(a), len(b))
    while low < top and a[low] == b[low]:
        out.add(low)
        low += 1
    i, j = len(a), len(b)
    while i > low and j > low and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
        out.add(i)
    known = set(b[low:j])
    x = [k for k in range(low, i) if a[k] in known]  # lines of one page alone are in no common subsequence
    known = {a[k] for k in x}
    y = [v for v in b[low:j] if v in known]
    todo = [(0, len(x), 0, len(y))]
    xs = [a[k] for k in x]
    while todo:
        p, q, u, v = todo.pop()
        if p == q or u == v:
            continue
        if (q - p) * (v - u) <= TABLE or q - p == 1:
            out |= {x[p + k] for k in _aligned(xs[p:q], y[u:v])}
            continue
        # Hirschberg: the halves of x meet y where their common subsequences are longest together
        mid = (p + q) // 2
        front = _lengths(xs[p:mid], y[u:v])
        back = _lengths(xs[mid:q][::-1], y[u:v][::-1])[::-1]
        at = u + max(range(len(front)), key=lambda k: front[k] + back[k])
        todo += [(p, mid, u, at), (mid, q, at, v)]
    return out


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """For each line of x, the row of the alignment table as bits: a 0 at k where the length grows from the first k to k + 1 lines of y."""
    places: dict[int, int] = {}
    for k, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << k
    full = row = (1 << len(y)) - 1
    for v in x:
        met = row & places.get(v, 0)
        row = (row + met | row - met) & full
        yield row


def _lengths(x: list[int], y: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of x with the first 0, 1, ... lines of y."""
    row = deque(_rows(x, y), maxlen=1).pop()
    return list(accumulate((bit == "0" for bit in reversed(f"{row:0{len(y)}b}")), initial=0))


def _aligned(x: list[int], y: list[int]) -> list[int]:
    """Places in x of a longest common subsequence, from the whole table."""
    rows = list(_rows(x, y))
    out, p, q = [], len(x), len(y)
    while p and q:
        if x[p - 1] == y[q - 1]:
            out.append(p - 1)
            p, q = p - 1, q - 1
        elif rows[p - 1] >> q - 1 & 1:
            q -= 1
        else:
            p -= 1
    return out


def main_text(page: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]]) -> str:
    """The lines of a page that are left once shared lines and frame elements are gone."""
    places = [k for k, (_, where) in enumerate(page) if where != FRAMED]
    keys = [hash(page[k][0]) for k in places]
    total = sum(len(page[k][0]) for k in places)
    shared: set[int] = set()
    every: set[int] | None = None
    own = _body(page)
    others = {_body(other) for other in neighbours} - {own, ()}  # equal pages count once, copies of this page not at all
    for other in others:
        met = {places[k] for k in common(keys, [hash(t) for t in other])}
        if sum(len(page[k][0]) for k in met) <= COPY * total:
            shared |= met
        every = met if every is None else every & met
    inside = {k for k, (_, where) in enumerate(page) if where == CONTENT}
    outside = {k for k, (_, where) in enumerate(page) if where == OUTSIDE}
    size = lambda at: sum(len(page[k][0]) for k in at)
    frame = every if every is not None and len(others) > 1 else set()
    left = outside - shared - frame
    # inside of an article a frame stands at its ends; what neighbours share in its middle is theirs as well
    order = sorted(inside)
    ends = {*takewhile(frame.__contains__, order), *takewhile(frame.__contains__, reversed(order))}
    frame = frame - inside | ends
    if inside <= frame and size(inside) > size(left):
        frame = frame - inside
    if not others and size(inside) > size(outside):
        left = set()
    keep = (inside - frame) | left
    return "\n\n".join(t for k, (t, _) in enumerate(page) if k in keep)


def _body(page: list[tuple[str, int]]) -> tuple[str, ...]:
    """The lines that stand in no frame element."""
    return tuple(t for t, where in page if where != FRAMED)


def _key(host: str, path: str, page_id: int | None, url: str | None) -> tuple:
    """A page's place in the order of pages, as Spark sorts it."""
    return host, path, page_id is not None, page_id or 0, url is not None, url or ""


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    return [_key(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "page_id", "url")), strict=True)]


def _dealt(bounds: list[tuple], more: dict[tuple, list[int]]):
    """Rows with their block, and again (``own`` false) for each block that they stand next to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, block, own = [], [], []
            for k, key in enumerate(_keys(batch)):
                to = [bisect_right(bounds, key), *more.get(key, ())]
                at += [k] * len(to)
                block += to
                own += [True] + [False] * (len(to) - 1)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block, pa.int32()), pa.array(own, pa.bool_())], [*batch.schema.names, "block", "own"])

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last NEIGHBOURS rows of each block."""
    first: list[pa.RecordBatch] = []
    last: deque[pa.RecordBatch] = deque(maxlen=NEIGHBOURS)
    now = None
    for batch in batches:
        for k, block in enumerate(batch.column("block").to_pylist()):
            if block != now:
                yield from [*first, *last]
                first, now = [], block
                last.clear()
            if len(first) < NEIGHBOURS:
                first.append(batch.slice(k, 1))
            else:
                last.append(batch.slice(k, 1))
    yield from [*first, *last]


def _beside(ends: list[tuple[int, tuple]]) -> dict[tuple, list[int]]:
    """For each key that stands next to a block, the blocks; from the ends (block, key) of all blocks."""
    ends = sorted(ends)
    out: dict[tuple, set[int]] = defaultdict(set)
    for block in {b for b, _ in ends}:
        low, high = bisect_right(ends, block - 1, key=lambda e: e[0]), bisect_right(ends, block, key=lambda e: e[0])
        for _, key in ends[max(0, low - NEIGHBOURS) : low] + ends[high : high + NEIGHBOURS]:
            out[key].add(block)
    return {key: sorted(blocks) for key, blocks in out.items()}


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    window: deque[tuple] = deque()  # (page_id, url, host, lines, own), with up to NEIGHBOURS done pages in front
    done, now = 0, None

    def finish(k: int) -> list[tuple]:
        page_id, url, host, page, own = window[k]
        if not own:
            return []
        near = [window[i][3] for i in range(max(0, k - NEIGHBOURS), min(len(window), k + NEIGHBOURS + 1)) if i != k and window[i][2] == host]
        text = main_text(page, near)
        return [(page_id, url, text, len(text))]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])

    for batch in batches:
        out = []
        for page_id, url, host, raw, block, own in zip(*(batch.column(c) for c in ("page_id", "url", "host", "html", "block", "own")), strict=True):
            if block.as_py() != now:
                out += [r for k in range(done, len(window)) for r in finish(k)]
                window.clear()
                done, now = 0, block.as_py()
            window.append((page_id.as_py(), url.as_py(), host.as_py(), lines(raw.as_py() or ""), own.as_py()))
            if len(window) - done > NEIGHBOURS:
                out += finish(done)
                done += 1
                if done > NEIGHBOURS:
                    window.popleft()
                    done -= 1
            if len(out) >= 500:
                yield rows(out)
                out = []
        yield rows(out)
    yield rows([r for k in range(done, len(window)) for r in finish(k)])


def host_and_path(url: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return F.lower(F.substring_index(bare, "/", 1)), F.regexp_replace(F.regexp_replace(bare, r"^[^/]*", ""), r"[?#].*$", "")


def extract(pages: DataFrame, blocks: int | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page. Blocks of pages in a row are found from the keys alone, SAMPLED of them for
    each block; then one shuffle deals the pages out. A large host takes several blocks."""
    host, path = host_and_path(F.col("url"))
    keyed = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"))
    light, kinds = keyed.drop("html"), "page_id long, url string, host string, path string"
    blocks = blocks or DEALT * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = min(1.0, SAMPLED * blocks / max(1, light.count()))
    found = sorted({_key(r["host"], r["path"], r["page_id"], r["url"]) for r in light.sample(part, 1).toLocalIterator()})
    bounds = sorted({found[k * len(found) // blocks] for k in range(1, blocks)}) if found else []
    order = ("block", "host", "path", "page_id", "url")
    placed = light.mapInArrow(_dealt(bounds, {}), kinds + ", block int, own boolean").repartition("block").sortWithinPartitions(*order)
    ends = placed.mapInArrow(_ends, placed.schema).collect()
    more = _beside([(r["block"], _key(r["host"], r["path"], r["page_id"], r["url"])) for r in ends])
    near = keyed.mapInArrow(_dealt(bounds, more), "page_id long, url string, html string, host string, path string, block int, own boolean")
    near = near.repartition("block").sortWithinPartitions(*order)
    return near.select("page_id", "url", "host", "html", "block", "own").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(pages: DataFrame) -> DataFrame:
    return extract(pages)
