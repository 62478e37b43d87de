"""Main text of web pages: differencing against the page with the nearest URL, and page structure.

A page is cut into blocks, its lines. Pages of a host are ordered by URL path, and neighbours that are
equal or nearly equal (NEAR percent of the longer one's text in shared lines) make a run. Each run is
paired with the page before or after it, whichever shares the longer path prefix with the run's end
there; every page's lines are aligned with that page's by longest common subsequence, and shared lines
are deleted. So all copies of a run get the same text, and near copies don't delete what they have in
common. A page of the run that is nearly equal to the partner too takes the other side's. Where a host
is one single run nothing tells boilerplate from text, and differencing deletes nothing.

Structure protects and completes. A line inside an article (main, where there is no article) is
protected: articles quote each other, and copies of a whole article share all. What differencing has
left of menus, headers, footers, sidebars, forms and elements whose class, id or role names such a part
is deleted after it, as is what stands outside a page's article: such lines may differ on every page.
Inside an article names decide less: SURE words of a class or role delete, those of an id only where it
holds nothing but HINTS; the other HINTS, and ids with further words, only take the protection away, so
that differencing decides. An id never speaks against a heading.

Where menus, adverts and the like differ from page to page, sharing can't tell them, and structure
alone gives the text. n_decided counts the lines that nothing but differencing deleted.

Neighbours are found without putting a host in one task: URLs are cut into ranges by a bounded sample
and each range is ordered by itself. The outermost pages of a range and those beside its outermost
runs (four line lists a range) are folded on the driver into what each range has to know of the ones
beside it, so that runs and pairing don't depend on the cuts. One pass forward finds the pages before
the runs, one backward those after; each holds a few pages at a time. Only line hashes and lengths
are shuffled.

Behaviour: null or empty html gives an empty text; a null URL is the empty URL; character references
are decoded once; br is white space inside a block; white space is what Python's split() takes for
it. A page of any length is processed whole, in time that grows with its length; repeated rows repeat
their result; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import slices, start
from stratapack.session import materialize

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
SPECIAL = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CUT = re.compile(r"[^a-z0-9]+")

#: Elements whose content is never read.
RAW = frozenset("script style noscript template iframe textarea title object canvas audio video select".split())
#: Elements that hold no article text, and those of them that an article may have as its own.
OUT = frozenset("nav footer aside form header dialog menu button head fieldset".split())
OWN = frozenset({"header"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that begin and end a block; containers are kept on the stack, leaves end by the next block.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th hr pre caption summary figcaption address option".split())
CONTAINERS = frozenset("html body div section article main nav footer aside form header dialog menu button head fieldset ul ol dl table thead tbody tfoot blockquote figure details center".split())
#: Words of a class, id or role that mark such parts.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login paywall sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist reply replies "
    "respond disqus discussion share sharing social related recommended recommendations teaser widget widgets pagination pager skip search searchbox complementary contentinfo tooltip hidden".split()
)
HEADER_HINTS = frozenset({"header", "head", "top"})
#: Those that mean nothing else, inside an article as well.
SURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsored cookie cookies consent gdpr newsletter paywall sidebar nav navbar navigation breadcrumb breadcrumbs "
    "comments commentlist respond disqus sharing share social teaser pagination hidden".split()
)
EXCLUDED, ARTICLE, MAIN, DOUBTED = 1, 2, 4, 8
#: Percent of the longer page's text that shared lines make up in nearly equal pages.
NEAR = 80


def _hinted(attrs: str, inside: bool, name: str) -> int:
    """EXCLUDED or DOUBTED if an element's attributes mark it as none of the article's text, else 0."""
    out = 0
    for m in ATTRIBUTE.finditer(attrs):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            words = set(CUT.split(value))
            if not inside:
                if words & HINTS or (name != "article" and words & HEADER_HINTS):
                    return EXCLUDED
            elif words & SURE and (key != "id" or (words <= HINTS and name not in HEADINGS)):
                return EXCLUDED
            elif words & HINTS and name not in HEADINGS:
                out = DOUBTED
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return EXCLUDED
    return out


class Tags:
    """Finds where a tag ends: at the first ">" outside quotes; if quotes don't close, at the first one at all.

    Places from which no end was found are remembered, so that all searches together take linear time.
    """

    def __init__(self, html: str):
        self.html, self.last, self.dead = html, html.rfind(">"), set()

    def end(self, at: int) -> int:
        """The place of the ">" of the tag whose name or mark begins here; -1 if there is none."""
        if at > self.last:
            return -1
        seen, x = [], at
        while m := SPECIAL.search(self.html, x):
            x = m.start()
            if m.group() == ">":
                return x
            seen.append(x)
            close = -1 if x in self.dead else self.html.find(m.group(), x + 1)
            if close < 0:
                break
            x = close + 1
        self.dead.update(seen)
        return self.html.find(">", at)


def blocks_of(html: str) -> list[tuple[int, str]]:
    """A page's blocks in order: (state bits, text)."""
    out: list[tuple[int, str]] = []
    buf: list[str] = []
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}  # how often each name is on the stack
    state = leaf = 0  # of the innermost container; of the open leaf
    at, n, tags = 0, len(html), Tags(html)
    closers: dict[str, re.Pattern] = {}

    def flush() -> None:
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                out.append((state | leaf, text))
            buf.clear()

    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            buf.append(unescape(html[at:]))
            break
        if begin > at:
            buf.append(unescape(html[at:begin]))
        mark = html[begin + 1 : begin + 2]
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = end + 3 if end >= 0 else n
            continue
        m = NAME.match(html, begin + 1)
        if m is None or (end := tags.end(m.end())) < 0:
            end = html.find(">", begin) if mark and mark in "!?/" and begin < tags.last else -1
            if m is not None or end < 0:
                buf.append("<")  # no tag
                at = begin + 1
            else:
                at = end + 1
            continue
        at, attrs = end + 1, html[m.end() : end]
        closing, name = m.group().startswith("/"), m.group().lstrip("/").lower()
        if name in LEAVES:
            flush()
            leaf = 0 if closing or not attrs else _hinted(attrs, bool(state & ARTICLE), name)
        elif name == "br":
            buf.append(" ")
        elif name in RAW:
            if not closing and not attrs.endswith("/"):
                closer = closers.setdefault(name, re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE)).search(html, at)
                end = html.find(">", closer.end()) if closer else -1
                at = end + 1 if end >= 0 else n
                if name != "title":
                    buf.append(" ")
        elif name in CONTAINERS:
            flush()
            leaf = 0
            if closing:
                while held.get(name):
                    top, state = stack.pop()
                    held[top] -= 1
                    if top == name:
                        break
            else:
                stack.append((name, state))
                held[name] = held.get(name, 0) + 1
                inside = bool(state & ARTICLE)
                if name in OUT and not (inside and name in OWN):
                    state |= EXCLUDED
                elif name not in ("html", "body", "main") and attrs:
                    state |= _hinted(attrs, inside, name)
                if name == "article":
                    state |= ARTICLE
                elif name == "main" or (attrs and 'role="main"' in attrs):
                    state |= MAIN
    flush()
    return out


def lines_of(html: str | None) -> tuple[list[str], list[int]]:
    """A page's lines, and which kind each is: 2 protected, 1 text unless it is shared, 0 not text."""
    found = blocks_of(html) if html else []
    present = 0
    for s, _ in found:
        if not s & EXCLUDED:
            present |= s
    kinds = []
    for s, _ in found:
        if s & EXCLUDED:
            kinds.append(0)
        elif s & ARTICLE or (s & MAIN and not present & ARTICLE):
            kinds.append(1 if s & DOUBTED else 2)
        elif s & MAIN or not present & (ARTICLE | MAIN):
            kinds.append(1)
        else:
            kinds.append(0)
    return [t for _, t in found], kinds


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places of a on a longest common subsequence with b (Hunt and Szymanski: increasing runs of matches)."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)  # falling, so that a line of a is used once per run
    ends: list[int] = []
    links: list[tuple[int, object]] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k] = j
                links[k] = link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _row_key() -> Column:
    return F.xxhash64("page_id", "url", "html")


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def line_table(spark: SparkSession, pages: DataFrame, buckets: int, sample_rows: int) -> DataFrame:
    """key, bucket, host, path, hashes of all lines, their lengths (0 for what is not text), places of the unprotected ones."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(host.alias("host"), path.alias("path"), F.xxhash64("page_id", "url").alias("h"))
    n = urls.count()
    share = min(1.0, sample_rows / max(n, 1))
    some = urls.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("h").limit(sample_rows).select("host", "path").collect()
    points = sorted({(r["host"], r["path"]) for r in some})
    bounds = [points[i * len(points) // buckets] for i in range(1, buckets) if points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            hashes, sizes, unsure = [], [], []
            for h in b.column("html").to_pylist():
                lines, kinds = lines_of(h)
                hashes.append([_hash(x) for x in lines])
                sizes.append([len(x) if k else 0 for x, k in zip(lines, kinds, strict=True)])
                unsure.append([i for i, k in enumerate(kinds) if k < 2])
            at = [bisect.bisect_right(bounds, p) for p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            cols = {c: b.column(c) for c in ("key", "host", "path")}
            cols |= {"bucket": pa.array(at, pa.int32()), "hashes": pa.array(hashes, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(cols | {"sizes": pa.array(sizes, pa.list_(pa.int32())), "unsure": pa.array(unsure, pa.list_(pa.int32()))})

    d = pages.select(_row_key().alias("key"), host.alias("host"), path.alias("path"), "html")
    return materialize(spark, d.mapInArrow(run, "key long, host string, path string, bucket int, hashes array<long>, sizes array<int>, unsure array<int>"), "lines")


class Page:
    """A page as its neighbours see it."""

    __slots__ = ("_bag", "hashes", "host", "path", "sizes")

    def __init__(self, host: str, path: str, hashes: np.ndarray, sizes: np.ndarray):
        self.host, self.path, self.hashes, self.sizes, self._bag = host, path, hashes, sizes, None

    def bag(self) -> tuple[dict[int, int], int]:
        """Characters of text in each line, all its repetitions together, and in all lines."""
        if self._bag is None:
            lines: dict[int, int] = {}
            for h, n in zip(self.hashes.tolist(), self.sizes.tolist(), strict=True):
                if n:
                    lines[h] = lines.get(h, 0) + n
            self._bag = lines, sum(lines.values())
        return self._bag

    def same(self, other: Page) -> bool:
        return np.array_equal(self.hashes, other.hashes)

    def near(self, other: Page) -> bool:
        """Equal or nearly equal."""
        if self.same(other):
            return True
        (a, n), (b, m) = self.bag(), other.bag()
        if 100 * min(n, m) < NEAR * max(n, m) or not n:
            return False
        return 100 * sum(min(c, b[h]) for h, c in a.items() if h in b) >= NEAR * max(n, m)


class Runs:
    """Walks pages in order, in either direction: the last page, and its run's partner behind it."""

    def __init__(self, last: Page | None = None, partner: Page | None = None, prefix: int = 0):
        self.last, self.partner, self.prefix = last, partner, prefix

    def step(self, page: Page) -> bool:
        """Whether the page begins a run."""
        last, self.last = self.last, page
        if last is not None and last.host == page.host and last.near(page):
            return False
        self.partner = last if last is not None and last.host == page.host else None
        self.prefix = _prefix(self.partner.path, page.path) if self.partner else 0
        return True


def _pages(b: pa.RecordBatch) -> Iterator[tuple[int, Page]]:
    """(bucket, page) of each row."""
    hashes, sizes = b.column("hashes"), b.column("sizes")
    flat, lengths, ends = hashes.values.to_numpy(), sizes.values.to_numpy(), hashes.offsets.to_numpy()
    begins = sizes.offsets.to_numpy()
    rows = zip(b.column("bucket").to_pylist(), b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)
    for i, (bucket, host, path) in enumerate(rows):
        yield bucket, Page(host, path, flat[ends[i] : ends[i + 1]].copy(), lengths[begins[i] : begins[i + 1]].copy())


EDGE = "struct<host: string, path: string, hashes: binary, sizes: binary>"


def _packed(p: Page | None) -> dict | None:
    return p and {"host": p.host, "path": p.path, "hashes": p.hashes.astype(np.int64).tobytes(), "sizes": p.sizes.astype(np.int32).tobytes()}


def _unpacked(r) -> Page | None:
    return r and Page(r["host"], r["path"], np.frombuffer(r["hashes"], np.int64), np.frombuffer(r["sizes"], np.int32))


def _edges(lines: DataFrame) -> list[dict]:
    """Per range in order: its first and last page, whether it is one run, the partners inside it of its first and last run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, runs, first, after = [], None, Runs(), None, None
        whole, inner = True, 0  # one run so far; runs begun

        def close() -> None:
            if now is not None:
                before = None if whole else runs.partner
                rows.append({"bucket": now, "first": _packed(first), "last": _packed(runs.last), "whole": whole, "before": _packed(before), "after": _packed(after), "ahead": 0 if whole else runs.prefix, "behind": inner})

        for b in batches:
            for bucket, page in _pages(b):
                if bucket != now:
                    close()
                    now, runs, first, after, whole, inner = bucket, Runs(), page, None, True, 0
                    runs.step(page)
                    continue
                previous = runs.last
                if runs.step(page):
                    if whole and runs.partner is not None:
                        after, inner = page, _prefix(page.path, previous.path)
                    whole = False
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("first", _EDGE), ("last", _EDGE), ("whole", pa.bool_()), ("before", _EDGE), ("after", _EDGE), ("ahead", pa.int32()), ("behind", pa.int32())]))

    found = lines.select("bucket", "host", "path", "key", "hashes", "sizes").repartition("bucket").sortWithinPartitions("bucket", "host", "path", "key")
    found = found.mapInArrow(run, f"bucket int, first {EDGE}, last {EDGE}, whole boolean, before {EDGE}, after {EDGE}, ahead int, behind int")
    rows = sorted((r.asDict() for r in found.collect()), key=lambda r: r["bucket"])
    return [r | {c: _unpacked(r[c]) for c in ("first", "last", "before", "after")} for r in rows]


_EDGE = pa.struct([("host", pa.string()), ("path", pa.string()), ("hashes", pa.binary()), ("sizes", pa.binary())])


def _carried(edges: list[dict], back: bool) -> dict[int, tuple]:
    """What the walk of each range starts from: the last page before it, that page's run's partner, their prefix."""
    near, far, partner, prefix = ("last", "first", "after", "behind") if back else ("first", "last", "before", "ahead")
    out, runs = {}, Runs()
    for e in reversed(edges) if back else edges:
        out[e["bucket"]] = (runs.last, runs.partner, runs.prefix)
        runs.step(e[near])
        if e["whole"]:
            runs.last = e[far]
        else:
            runs = Runs(e[far], e[partner], e[prefix])
    return out


def _partners(lines: DataFrame, carried: dict[int, tuple], back: bool) -> DataFrame:
    """key, prefix, places: the unprotected lines that a page shares with the partner behind its run, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs, done, hit = None, Runs(), None, None
        for b in batches:
            keys, prefixes, places = [], [], []
            rows = zip(b.column("key").to_pylist(), b.column("unsure").to_pylist(), _pages(b), strict=True)
            for key, unsure, (bucket, page) in rows:
                if bucket != now:
                    now, runs, done = bucket, Runs(*carried[bucket]), None
                begins = runs.step(page)
                partner = runs.partner
                if not unsure or partner is None:
                    continue
                if begins or done is None or done[1] != unsure or not done[0].same(page):  # copies repeat their result
                    hit = None if page.near(partner) else sorted(set(common_lines(page.hashes.tolist(), partner.hashes.tolist())) & set(unsure))
                    done = page, unsure
                if hit is not None:
                    keys.append(key)
                    prefixes.append(runs.prefix)
                    places.append(hit)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "prefix": pa.array(prefixes, pa.int32()), "places": pa.array(places, pa.list_(pa.int32()))})

    order = [F.col(c).desc() if back else F.col(c) for c in ("bucket", "host", "path", "key")]
    rows = lines.select("bucket", "host", "path", "key", "hashes", "sizes", "unsure").repartition("bucket").sortWithinPartitions(*order)
    return rows.mapInArrow(run, "key long, prefix int, places array<int>").withColumn("side", F.lit(0 if back else 1))


def shared_lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """key, places: the unprotected lines of a page that its run's partner has as well."""
    lines = lines.where(F.size("hashes") > 0)
    edges = _edges(lines)
    both = _partners(lines, _carried(edges, False), False).unionByName(_partners(lines, _carried(edges, True), True))
    nearest = F.max_by("places", F.struct("prefix", "side"))  # of equals the page before
    return materialize(spark, both.groupBy("key").agg(nearest.alias("places")).where(F.size("places") > 0), "shared")


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905 - up to the shorter
        if x != y:
            break
        n += 1
    return n


def extract(spark: SparkSession, pages: DataFrame, buckets: int = 256, sample_rows: int = 20_000) -> DataFrame:
    """Per page: page_id, url, text, n_chars, and how its lines were told: n_shared were deleted for being on
    the partner page, n_decided of them are lines that structure would have kept, n_structure were deleted
    by structure alone, n_lines are the text."""
    start(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    shared = shared_lines(spark, line_table(spark, pages, buckets, sample_rows))
    d = pages.withColumn("key", _row_key()).join(shared, "key", "left").select("page_id", "url", "html", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts, told = [], []
            for h, gone in zip(b.column("html").to_pylist(), b.column("places").to_pylist(), strict=True):
                lines, kinds = lines_of(h)
                drop = set(gone or ())
                kept = [t for i, (t, k) in enumerate(zip(lines, kinds, strict=True)) if k and i not in drop]
                texts.append("\n".join(kept))
                told.append((len(drop), sum(kinds[i] > 0 for i in drop), len(lines) - len(drop) - len(kept), len(kept)))
            counts = [pa.array(c, pa.int32()) for c in zip(*told, strict=True)]
            lengths = pa.array(np.array([len(t) for t in texts], np.int64))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), lengths, *counts], names=["page_id", "url", "text", "n_chars", "n_shared", "n_decided", "n_structure", "n_lines"])

    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared int, n_decided int, n_structure int, n_lines int")
