"""Main text: page shapes by hand, alignment against a plain dynamic program, pairing over all cuts."""

import random
import time

import pytest

from stratapack.llm import html


def text(page):
    lines, kinds = html.lines_of(page)
    return "\n".join(t for t, k in zip(lines, kinds) if k)


def test_article_page():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/">Home</a></ul></nav>'
        '<header><h1>Site</h1></header><!-- <p>gone</p> --><div class="ad">Buy</div><article class="post"><header><h1>A &amp; <i>B</i></h1></header><p><b>One  two<br>three<br><p>Four&nbsp;five &lt;tag&gt;</p>'
        '<div class="share-links">Tweet</div><aside>Side</aside><form><input><p>Mail</p></form><table><tr><td>x</td><td>y</td></tr></table><pre>k\n  l</pre><section id="comments"><p>Nice!</p></section></article>'
        '<article class="comment"><p>Reader</p></article><div class="cookie-notice">Cookies</div><footer>&copy; site</footer></body></html>'
    )
    assert text(page) == "A & B\nOne two three\nFour five <tag>\nx\ny\nk l"


def test_odd_pages():
    assert text(None) == text("") == text("<p></p>") == ""
    assert text("plain < text & more") == "plain < text & more"
    assert text("<main><p>a</p><nav>n</nav></main><p>out</p>") == "a"
    assert text('<div>a<p title="x > y">b</div>c') == "a\nb\nc"
    assert text("<article><p>a<script>never closed") == "a"
    assert text('<article><p>a<img alt="unclosed>b</p>') in ("a\nb", "a b", "ab")
    assert text("<article>" + "<p>word</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_names_inside_articles():
    """Words of ids and weak words of classes don't delete article text by themselves."""
    page = (
        '<article><h2 id="discussion">Discussion</h2><p>a</p><h2 id="comments">On comments</h2><p>b</p><section id="related-work"><p>c</p></section><p class="notice">d</p>'
        '<div class="search-results"><p>e</p></div><section id="social-contract"><p>f</p></section><p>g<svg><text>h</text></svg><math><mi>x</mi></math></p>'
        '<div class="sidebar"><p>s</p></div><div id="comments"><p>Reader</p></div><div class="comments"><p>Reader</p></div></article>'
    )
    assert text(page) == "Discussion\na\nOn comments\nb\nc\nd\ne\nf\nghx"


@pytest.mark.parametrize("unit", ['<x "', "<x '", "<", "</", "<!", "<a b='\"", '<p "\'>', "<div>", "<script ", "<script>", "<div></p></article>", "<!--", "&amp", "</script"])
def test_hostile_markup_in_linear_time(unit):
    began = time.perf_counter()
    html.lines_of(unit * (500_000 // len(unit)))
    assert time.perf_counter() - began < 10


def test_alignment():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html.common_lines(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))
        at = 0
        for i in got:  # a subsequence of b too
            at = b.index(a[i], at) + 1


def page(i, body):
    return f"<body><div><p>Welcome</p></div><div><h1>Title {i}</h1><p>{body}</p></div><div><p>All rights reserved</p></div></body>"


def test_differencing(spark):
    rows = [(i, f"http://a.example/x/{i:03d}", page(i, f"body {i}"), "q") for i in range(60)]
    rows += [(100, "http://b.example/x/1", page(0, "alone"), "q"), (200, None, None, "q"), (201, "http://c.example/", page(1, "copy"), "q"), (202, "http://c.example/z", page(1, "copy"), "q"), (3, rows[3][1], rows[3][2], "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = {i: f"Title {i}\nbody {i}" for i in range(60)} | {100: "Welcome\nTitle 0\nalone\nAll rights reserved", 200: "", 201: "Welcome\nTitle 1\ncopy\nAll rights reserved"}
    want[202] = want[201]
    for buckets in (1, 7, 256):
        got = html.extract(spark, df, buckets=buckets).collect()
        assert len(got) == len(rows)
        assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(spark, df.limit(0)).count() == 0


def test_text_in_articles_stays(spark):
    shared = "<article><h1>Same</h1><p>quoted by many</p></article>"
    df = spark.createDataFrame([(1, "http://a.example/1", shared + "<p>x</p>"), (2, "http://a.example/2", shared + "<p>y</p>")], "page_id long, url string, html string")
    assert [r["text"] for r in html.extract(spark, df).collect()] == ["Same\nquoted by many"] * 2


def test_differencing_decides(spark):
    """A line in an article under a weak name goes if the partner has it, stays if not; outside articles sharing decides as well."""
    rows = [(i, f"http://a.example/{i}", f'<article><p>text {i}</p><p class="notice">{"Sale ends soon" if i < 4 else "Bridge closed"}</p></article><p>{"foot" if i % 2 else i}</p>') for i in range(5)]
    rows += [(9, "http://b.example/1", "<p>head</p><p>nine</p>"), (10, "http://b.example/2", "<p>head</p><p>and ten</p>")]
    got = {r["page_id"]: r for r in html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["text"] for i in range(5)] == ["text 0", "text 1", "text 2", "text 3", "text 4\nBridge closed"]
    assert [(got[i]["n_shared"], got[i]["n_decided"], got[i]["n_structure"], got[i]["n_lines"]) for i in (0, 4)] == [(1, 1, 1, 1), (0, 0, 1, 2)]
    assert (got[9]["text"], got[10]["text"]) == ("nine", "and ten") and got[9]["n_decided"] == 1


def brute_text(rows):
    """Runs and partners straight from the definition, host by host; text per row number."""

    def near(a, b):
        if a[0] == b[0]:
            return True
        bags = [[t for t, k in zip(*x) if k] for x in (a, b)]
        n = [sum(map(len, x)) for x in bags]
        shared = sum(min(bags[0].count(t), bags[1].count(t)) * len(t) for t in set(bags[0]))
        return min(n) > 0 and 100 * shared >= 80 * max(n)

    pages = sorted(rows, key=lambda r: (r["host"], r["path"], r["key"]))
    pages = [r | {"lines": html.lines_of(r["html"])} for r in pages]
    runs = []
    for p in (p for p in pages if p["lines"][0]):
        if runs and runs[-1][-1]["host"] == p["host"] and near(runs[-1][-1]["lines"], p["lines"]):
            runs[-1].append(p)
        else:
            runs.append([p])
    out = {}
    for i, run in enumerate(runs):
        sides = []
        if i and runs[i - 1][0]["host"] == run[0]["host"]:
            sides.append((html._prefix(runs[i - 1][-1]["path"], run[0]["path"]), 1, runs[i - 1][-1]["lines"]))
        if i + 1 < len(runs) and runs[i + 1][0]["host"] == run[0]["host"]:
            sides.append((html._prefix(runs[i + 1][0]["path"], run[-1]["path"]), 0, runs[i + 1][0]["lines"]))
        for p in run:
            lines, kinds = p["lines"]
            mine = [s for s in sides if not near(s[2], p["lines"])]
            drop = set(html.common_lines(lines, max(mine, key=lambda s: s[:2])[2][0])) if mine else ()
            out[p["page_id"]] = "\n".join(t for j, (t, k) in enumerate(zip(lines, kinds)) if k and not (k == 1 and j in drop))
    return out


def test_copies_and_near_copies(spark):
    """Runs of equal and nearly equal pages get one result, wherever ranges cut them."""
    main = "".join(f"<p>paragraph {i} of the long main text</p>" for i in range(9))
    same = page(1, "x").replace("<p>x</p>", main)
    near = [page(1, "x").replace("<p>x</p>", f"{main}<p>visit {i}</p>") for i in range(5)]
    other = page(2, "something else entirely, and long enough to differ")
    rows = [(i, f"http://a.example/p/{i:02d}?s={i}", same, None) for i in range(12)] + [(20, "http://a.example/z", other, None)]
    rows += [(30 + i, f"http://b.example/p?s={i}", h, None) for i, h in enumerate([same] * 4)] + [(40, "http://b.example/q", None, None), (41, "http://b.example/r", other, None)]
    rows += [(50 + i, f"http://c.example/p{i}", h, None) for i, h in enumerate(near)] + [(60, "http://c.example/z", other, None)]
    rows += [(70 + i, f"http://d.example/p{i}", h, None) for i, h in enumerate(near)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    body = "\n".join(f"paragraph {i} of the long main text" for i in range(9))
    for buckets in (1, 5, 256):
        got = {r["page_id"]: r["text"] for r in html.extract(spark, df, buckets=buckets).collect()}
        assert {got[i] for i in [*range(12), *range(30, 34)]} == {f"Title 1\n{body}"}
        assert [got[50 + i] for i in range(5)] == [f"Title 1\n{body}\nvisit {i}" for i in range(5)]
        assert got[60] == got[20] == "Title 2\nsomething else entirely, and long enough to differ"
        assert all(got[70 + i] == f"Welcome\nTitle 1\n{body}\nvisit {i}\nAll rights reserved" for i in range(5))


def test_runs_against_definition(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        texts = [f"{'own' if rng.random() < 0.5 else 'shared'} line {rng.randrange(3)} {'word ' * rng.randrange(6)}" for _ in range(rng.randrange(5))]
        parts = ["head of all pages", *(texts if rng.random() < 0.6 or not rows else rng.choice(rows)[3]), "foot of all"]
        if rng.random() < 0.1:
            parts.append(f"stamp {i}")
        body = "".join(f"<p>{t}</p>" for t in parts)
        kind = rng.random()
        page_html = None if kind < 0.05 else f"<article>{body}</article>" if kind < 0.15 else f"<nav><p>menu {i % 3}</p></nav>{body}"
        rows.append((i, f"http://h{rng.randrange(3)}.example/{rng.choice('ab')}/{rng.randrange(40)}", page_html, texts))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    host, path = html.host_and_path(df["url"])
    want = brute_text([r.asDict() for r in df.select("page_id", "html", host.alias("host"), path.alias("path"), html._row_key().alias("key")).collect()])
    for buckets in (1, 9, 64):
        got = {r["page_id"]: r["text"] for r in html.extract(spark, df, buckets=buckets).collect()}
        assert got == {i: want.get(i, "") for i in range(300)}
