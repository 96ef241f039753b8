import random

from tessera.llm.html_extract import extract
from tessera.llm.html_tree import Page, align, parse_skeleton


def _texts(html):
    p = Page(html)
    return [(b.text, b.marked, b.article) for b in p.blocks]


def test_blocks():
    html = ('<html><body><div class="cookie-notice">We use <b>cookies</b></div><header><h1>Site</h1></header><main>'
            '<h1>T &amp; x</h1><p>a<p>b <em>c</em>\n d<br>e<ul><li>1<li>2</ul><form><input>q</form><section id=comments>'
            '<article class=comment>nope</article></section><aside>side</aside><p>f<span class="ad">buy</span> g</main>'
            '<div>tail</div><!-- x --><script>y</scr')
    assert _texts(html) == [
        ("We use cookies", True, False), ("Site", True, False), ("T & x", False, True), ("a", False, True),
        ("b c d e", False, True), ("1", False, True), ("2", False, True), ("q", True, True), ("nope", True, False),
        ("side", True, True), ("f", False, True), ("buy", True, True), ("g", False, True), ("tail", False, False)]


def test_odd_markup():
    assert _texts("") == [] and _texts("plain &lt;text&gt;")[0][0] == "plain <text>"
    assert [t for t, _, _ in _texts("<p>a<b>b<p>c</b></p><p>1 < 2<p title=it's>d<!-- open")] == ["ab", "c", "1 < 2", "d"]
    assert [t for t, _, _ in _texts("<table><tr><td>x<td>y<tr><td>z</table>")] == ["x", "y", "z"]
    assert _texts("<p>x</p><scr") == [("x", False, False)]
    assert len(_texts("<p>w </p>" * 20_000)) == 20_000


def test_alignment():
    a, b = "page(body(nav#,div.x(p#),footer#))", "page(body(div.y#,nav#,div.x(h2#,p#),footer#))"
    assert align(a, a) == list(range(6))
    slots = align(a, b)
    assert slots[:3] == [0, 1, 3] and slots[3:] == [4, 6, 7]
    assert align("page(q#)", "page(r#)")[1] < 0


def _plain_worth(page, reference):
    """Simple tree matching, recursively and cell by cell."""
    la, ka, _ = parse_skeleton(page)
    lb, kb, _ = parse_skeleton(reference)

    def size(a, b):
        if la[a] != lb[b]:
            return 0
        m = [[0] * (len(kb[b]) + 1) for _ in range(len(ka[a]) + 1)]
        for i, u in enumerate(ka[a]):
            for j, v in enumerate(kb[b]):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + size(u, v))
        return 1 + m[-1][-1]
    return size(0, 0)


def test_alignment_is_optimal():
    rnd = random.Random(6)

    def tree(depth):
        label = rnd.choice("abc")
        kids = [tree(depth - 1) for _ in range(rnd.randint(0, 4))] if depth else []
        return label + (f"({','.join(kids)})" if kids else "")
    for _ in range(200):
        a, b = f"page({tree(3)},{tree(3)})", f"page({tree(3)},{tree(2)},{tree(3)})"
        slots, (la, ka, _), (lb, kb, _) = align(a, b), parse_skeleton(a), parse_skeleton(b)
        pairs = {i: s for i, s in enumerate(slots) if s >= 0}
        assert len(pairs) == _plain_worth(a, b) and len(set(pairs.values())) == len(pairs)
        assert all(la[i] == lb[s] for i, s in pairs.items())
        for i, s in pairs.items():  # parents are paired, and order is kept
            own = [(c, pairs[c]) for c in ka[i] if c in pairs]
            assert all(p in kb[s] for _, p in own) and [p for _, p in own] == sorted(p for _, p in own)


def test_deep_and_wide_pages(spark):
    import time
    deep = "<div>" * 5000 + "<p>bottom</p>" + "</div>" * 5000
    page = Page(deep)
    assert len(page.numbered) == 5002 and align(page.skeleton, page.skeleton) == list(range(5002))
    other = Page("<div>" * 4000 + "<ul><li>x</ul>")
    assert len(align(page.skeleton, other.skeleton)) == 5002
    wide = ["".join(f"<h2>h{i}</h2><p>{i}</p>" for i in range(n)) for n in (5000, 4000)]
    rnd = random.Random(2)
    mixed = "".join(rnd.choice(["<h2>a</h2>", "<p>b</p>", "<h3>c</h3>"]) for _ in range(6000))
    start = time.time()
    for x, y in ((wide[0], wide[1]), (wide[0], mixed)):
        assert len(align(Page(x).skeleton, Page(y).skeleton)) == len(Page(x).numbered)
    assert time.time() - start < 10
    got = _got(spark, [(1, "http://a.example", deep), (2, "http://a.example", wide[0]), (3, "http://a.example", mixed)])
    assert got[1, "http://a.example"][0] == "bottom" and got[2, "http://a.example"][0].startswith("h0\n\n0\n\nh1")


def test_names_inside_an_article():
    kept = ["related-work", "notice-period", "social-history", "search-results", "commentary", "navigation-history"]
    gone = ["ad", "ads", "comments", "comment-list", "cookie-notice", "share-buttons", "newsletter-signup box", "related"]
    for name in kept:
        assert _texts(f"<article><p>a</p><div class='{name}'>b</div></article>")[1] == ("b", False, True), name
    for name in gone:
        assert _texts(f"<article><p>a</p><div class='{name}'>b</div></article>")[1][1], name
    assert _texts("<article><p>a</p><section id=social-history><h2>b</h2></section></article>")[1] == ("b", False, True)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "mine", 3, "h")], "page_id long, url string, html string, text string, key int, host string")
    assert extract(df, ["page_id"]).first() == (1, "x", 1)


def _got(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(df, ["page_id", "url"]).collect()}


def test_constant_texts_are_template(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for i in range(30):
        own = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(6)) for _ in range(1 + i % 3)]
        extra = "<div class='z'><p>now and then</p></div>" if i % 5 == 0 else ""
        html = (f"<body><div class=top><p>Welcome to our site</p></div>{extra}<div class=body>"
                + "".join(f"<p>{x}</p>" for x in own) + "<p>Read more below</p></div><div>All rights reserved</div></body>")
        rows.append((i, "http://h.example/x", html))
        want[i] = "\n\n".join((["now and then"] if extra else []) + own)
    got = {k[0]: v[0] for k, v in _got(spark, rows).items()}
    assert {k: v.replace("now and then\n\n", "") for k, v in got.items()} == {
        k: v.replace("now and then\n\n", "") for k, v in want.items()}


def test_articles_copies_and_edges(spark):
    page = "<body><nav>menu</nav><article><h1>T</h1><p>same text</p></article><footer>f</footer>"
    rows = [(i, "https://copies.example/a", page) for i in range(20)]  # copies make no template
    rows += [(50, None, None), (51, "", ""), (52, "no url", "<p>x"), (52, "no url", "<p>x"), (None, "u", "<nav>m</nav>"),
             (53, "https://long.example", "<article>" + "<p>w x</p>" * 30_000)]
    got = _got(spark, rows)
    assert all(got[i, "https://copies.example/a"] == ("T\n\nsame text", 12) for i in range(20))
    assert got[50, None] == got[51, ""] == got[None, "u"] == ("", 0) and got[52, "no url"] == ("x", 1)
    assert got[53, "https://long.example"][1] == 30_000 * 5 - 2
    assert extract(spark.createDataFrame([], "page_id long, url string, html string"), ["page_id", "url"]).count() == 0


def test_given_pages(spark):
    """Everything within <article>, nothing else, on the given pages."""
    import re
    from html import unescape
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(df, ["page_id", "url"]).collect()}
    for r in df.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", " ", x)).split())
                 for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)
