import html
import random
import re

import pytest

from clickspark.llm import extraction as ex
from clickspark.llm.queries import op2_main_text
from tests.conftest import SF_SMALL


def sentence(rng, n=12):
    return " ".join(rng.choices(["vale", "mora", "tilo", "ren", "sapa", "dorun", "kel", "ümi"], k=n)).capitalize() + "."


def page(rng, title=None, paragraphs=None, body="div class='post-body x1'"):
    """An article without article tags, in the template of one host."""
    title, paragraphs = title or sentence(rng, 5), paragraphs or [sentence(rng, 15) for _ in range(rng.randrange(2, 6))]
    tag = body.split()[0]
    source = (f"<html><head><title>{title} | Daily</title><style>p{{}}</style></head><body class=ad-free>"
              f"<header><h1>The Daily</h1></header><nav><a href=/>Home</a> <a href=/x>{sentence(rng, 2)}</a></nav>"
              f"<div class='cookieNotice'>We use cookies {sentence(rng)}</div><div id=wrap><{body}><h2>{title}</h2>"
              + "".join(f"<p>{p}" for p in paragraphs) + "<div>Share this story with all of your friends and relatives today.</div>"
              f"</{tag}><div class='comments'><p>{sentence(rng, 20)}</p></div></div><aside><p>{sentence(rng, 30)}</p></aside>"
              f"<form><label>Search</label></form><footer>© {sentence(rng)}</footer><script>var x = '<p>no</p>';</script></body></html>")
    return source, " ".join([title, *paragraphs])


def test_wrapper_finds_the_article_and_drops_the_template():
    rng = random.Random(1)
    pages = [page(rng) for _ in range(8)]
    root, template = ex.induce([p for p, _ in pages])
    assert root.split("\x00")[-1] == "div.post" and len(template) == 1
    for source, text in pages + [page(rng) for _ in range(20)]:
        assert ex.main_text(source, root, frozenset(template)) == text


def test_near_copies_do_not_become_template():
    rng = random.Random(2)
    shared = [sentence(rng, 30) for _ in range(6)]
    pages = [page(rng, "One story", [*shared, sentence(rng, 8)], "article") for _ in range(16)]
    root, template = ex.induce([p for p, _ in pages])
    for source, text in pages:
        assert ex.main_text(source, root, frozenset(template)).startswith(text)


@pytest.mark.parametrize(("own", "constant"), [(1, 2), (2, 3), (1, 6)])
@pytest.mark.parametrize("headings", [True, False])
def test_pages_with_more_template_than_article_are_no_copies(own, constant, headings):
    rng = random.Random(own * 10 + constant)
    notices = [sentence(rng, 20) for _ in range(constant)]
    articles = [[*([sentence(rng, 6)] if headings else []), *(sentence(rng, 20) for _ in range(own))] for _ in range(16)]
    pages = ["<body><div class=post>" + (f"<h2>{a[0]}</h2>" if headings else "") + "".join(f"<p>{t}" for t in (*a[headings:], *notices)) + "</div>" for a in articles]
    root, template = ex.induce(pages)
    assert len(template) == constant
    assert [ex.main_text(p, root, frozenset(template)) for p in pages] == [" ".join(a) for a in articles]


def test_alignment_is_the_largest_simple_tree_matching():
    def matched(a, b):
        if isinstance(a, str) or isinstance(b, str):
            return int(isinstance(a, str) and isinstance(b, str))
        if a.key != b.key:
            return 0
        m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children, 1):
            for j, y in enumerate(b.children, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + matched(x, y))
        return 1 + m[-1][-1]

    def grow(rng, depth):
        node = ex.Node("div", "div." + rng.choice("ab"), False)
        for _ in range(rng.randrange(4) if depth else 0):
            node.children.append(grow(rng, depth - 1) if rng.random() < 0.6 else rng.choice("xyz"))
        return node

    rng = random.Random(3)
    for _ in range(200):
        a, b = grow(rng, 3), grow(rng, 3)
        pairs = ex.align(a, b)
        if not all(isinstance(c, str) for c in (*a.children, *b.children)):
            assert len(pairs) == matched(a, b)
        assert len({id(x) for x, _ in pairs if isinstance(x, ex.Node)}) == sum(isinstance(x, ex.Node) for x, _ in pairs)


def test_the_ends_of_very_long_pages_are_aligned():
    rng = random.Random(10)
    long = ["<div>" + "<p>Start" + "".join(f"<p>{sentence(rng, 6)}" for _ in range(n)) + "<p>The end" for n in (600, 500, 550, 620)]
    template = ex.induce(long)[1]
    path = ("#", "div", "p")
    assert {ex.mark_of(path, "Start"), ex.mark_of(path, "The end")} <= set(template)


def test_long_pages_are_aligned_like_short_ones(monkeypatch):
    rng = random.Random(11)

    def grow(depth):
        node = ex.Node("div", "div." + rng.choice("ab"), rng.random() < 0.1)
        for _ in range(rng.randrange(5) if depth else 0):
            node.children.append(grow(depth - 1) if rng.random() < 0.7 else rng.choice("xyz"))
        return node

    trees = [(grow(3), grow(3)) for _ in range(200)]
    whole = [len(ex.align(a, b)) for a, b in trees]
    monkeypatch.setattr(ex, "_CELLS", 2)
    assert [len(ex.align(a, b)) for a, b in trees] == whole


def test_six_hundred_paragraphs_and_subheadings():
    rng = random.Random(12)
    kinds = [[rng.choice(("p", "h3", "ul")) for _ in range(600)] for _ in range(2)]
    nodes = []
    for row in kinds:
        top = ex.Node("div", "div", False)
        for i, kind in enumerate(row):
            child = ex.Node(kind, kind, False)
            child.children = [f"{i} of {id(row)}"]
            top.children.append(child)
        nodes.append(top)
    best = [0] * 601
    for a in kinds[0]:
        row = [0]
        for j, b in enumerate(kinds[1]):
            row.append(max(row[-1], best[j + 1], best[j] + 2 * (a == b)))
        best = row
    pairs = ex.align(*nodes)
    assert len(pairs) == 1 + best[-1]
    places = [(nodes[0].children.index(a), nodes[1].children.index(b)) for a, b in pairs[1:] if isinstance(a, ex.Node)]
    assert all(i < k and j < m for (i, j), (k, m) in zip(places, places[1:]))


def test_texts_stand_where_their_element_stands():
    rng = random.Random(13)
    notice, pages = sentence(rng, 20), []
    for _ in range(6):
        pages.append(f"<body><div class=post>{notice}<p>{sentence(rng, 20)}<p>{sentence(rng, 20)}</div>")
    assert ex.induce(pages)[1] == [ex.mark_of(("#", "body", "div.post"), notice)]


@pytest.mark.parametrize(("source", "text"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<b>b</b>c<br>d\n\t e</p>f", "abc d e f"),
    ("<article><p>x &lt;b&gt; &#233;&eacute; &am &copy 2<p>y</article>", "x <b> éé &am © 2 y"), ("a < b <3 c", "a < b <3 c"),
    ("<p>one<!-- <p>no --> two<!-- open", "one two"), ("<script>x<p>y", ""), ("<article>a<nav>n</nav><div class='ad'>z</div>b</article>c", "a b"),
    ("<div class=side-bar>q</div><p hidden>r</p><p style='display: none'>s</p><p>t", "q t"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<main><header><h1>T</h1></header><p>u</p></main><header>no</header>", "T u"),
    ("<article class='comment'>c</article><article>a long one</article><article>b</article>", "a long one b"), ("<p title='a>b'>v</p>", "v"),
    ("<a href='x", ""), ("<" * 1000, "<" * 1000), ("<textarea>no</textarea><p>w", "w"), ("<P>UP</P><NAV>x</NAV>", "UP"), ("x</p>y</br>z", "x y z"),
])
def test_single_pages(source, text):
    assert ex.main_text(source) == text


@pytest.mark.parametrize("opening", ["<div class='content has-sidebar'>", "<div id=layout-no-sidebar>", "<div class='post comments-open'>",
                                     "<section class=search-results>", "<article class='post no-comments'>", "<form>"])
def test_names_do_not_drop_the_article(opening):
    close = f"</{re.match('<([a-z]+)', opening)[1]}>"
    rng = random.Random(9)
    own = [[sentence(rng, 5), sentence(rng, 20), sentence(rng, 20)] for _ in range(6)]
    pages = [f"<body><nav>{sentence(rng, 90)}</nav>{opening}<h2>{a[0]}</h2><p>{a[1]}<p>{a[2]}<div class=share>Share</div>{close}<div class=comments>{sentence(rng, 20)}</div>" for a in own]
    root, template = ex.induce(pages)
    for page_, a in zip(pages, own, strict=True):
        assert ex.main_text(page_) == ex.main_text(page_, root, frozenset(template)) == " ".join(a)
    assert ex.main_text(f"<body><h1>T</h1><p>short</p><div class=comments>{sentence(rng, 60)}</div>") == "T short"


def test_deep_and_long_pages():
    assert ex.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    long = "".join(f"<p>w{i}" for i in range(60_000))
    assert ex.main_text(long) == " ".join(f"w{i}" for i in range(60_000))
    worded = long.replace("w", "a word of a rather long paragraph that differs ")
    root, template = ex.induce([worded, worded.replace("word", "verb"), "<p>x"])
    assert template == [] and ex.main_text(worded, root).count("paragraph") == 60_000


def plain(source):
    """The one template of the synthetic pages, read with patterns."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    inner = re.sub(r"<[a-zA-Z/][^>]*>", lambda m: " " if re.match(r"</?(p|h1|br)", m[0]) else "", inner)
    return " ".join(html.unescape(inner).split())


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = op2_main_text(spark, SF_SMALL).collect()
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in rows} == {(i, p.url, plain(p.html), len(plain(p.html))) for i, p in pages.items()}
    assert len(rows) == len(pages)


def test_hosts_nulls_repeats_and_empty(spark):
    rng = random.Random(5)
    pages = [page(rng) for _ in range(30)]
    rows = [(i, f"https://u@Daily.example:80/{i}", p) for i, (p, _) in enumerate(pages)] + [(None, None, "<p>x"), (3, "no url", None), (4, "http://one.example/", "<p>🙂 y")]
    rows += rows[:2]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(3)
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in ex.extract_text(table).collect()), key=str)
    known = {p: t for p, t in pages} | {"<p>x": "x", None: "", "<p>🙂 y": "🙂 y"}
    assert got == sorted(((i or 0, u or "", known[h], len(known[h])) for i, u, h in rows), key=str)
    assert ex.extract_text(table.limit(0)).collect() == []


def extracted(spark, hosts):
    """{html: text} of the table that holds the pages of every host."""
    rows = [(f"http://{h}.example/{i}", p) for h, pages in hosts.items() for i, p in enumerate(pages)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    got = ex.extract_text(table).collect()
    assert len(got) == len(rows)
    return {rows[r.page_id][1]: r.text for r in got}


def test_wrappers_come_from_all_pages_and_for_every_layout(spark):
    rng = random.Random(6)
    notices = [sentence(rng, 20) for _ in range(6)]

    def some(n, start, end, own):
        articles = [[sentence(rng, 6), sentence(rng, 20), sentence(rng, 25)] for _ in range(n)]
        return {f"<title>{a[0]}</title><body>{start}<h2>{a[0]}</h2><p>{a[1]}<p>{a[2]}" + "".join(f"<p>{t}" for t in own) + end: " ".join(a) for a in articles}

    copies = some(12, "<div class=post>", "</div>", notices[:1])
    few = some(3, "<div class=post>", "</div>", notices[1:2])
    large = some(60, "<div class=post>", "</div>", notices[2:3])
    rare = some(8, "<section class=story><div class=inner>", "</div></section>", notices[3:])
    got = extracted(spark, {"copies": [p for p in copies for _ in range(20)], "few": [*few], "large": [*large, *rare]})
    assert got == copies | few | large | rare


def test_every_article_element_is_kept(spark):
    rng = random.Random(14)
    pages = {}
    for _ in range(10):
        a = [sentence(rng, 20) for _ in range(5)]
        pages[f"<title>{a[0]}</title><body><nav>Home</nav><article><h2>{a[0]}</h2><p>{a[1]}<p>{a[2]}</article><article><p>{a[3]}<p>{a[4]}</article>"] = " ".join(a)
    assert extracted(spark, {"two": [*pages]}) == pages
    assert [ex.main_text(p) for p in pages] == [*pages.values()]


def test_hosts_whose_pages_share_title_and_headings(spark):
    rng = random.Random(15)
    head, notices = "<title>The Daily</title><body><h1>The Daily</h1>", [sentence(rng, 20) for _ in range(3)]

    def some(n, own, constant):
        articles = [[sentence(rng, 20) for _ in range(own)] for _ in range(n)]
        return {f"{head}<div class=post>" + "".join(f"<p>{t}" for t in (*a, *constant)) + "</div>": " ".join(a) for a in articles}

    plain_host, hot = some(30, 2, notices[:1]), some(12, 3, notices[1:])
    # the versions of one article are no different pages: what they share stays
    story = [sentence(rng, 20) for _ in range(5)]
    versions = {f"{head}<div class=post>" + "".join(f"<p>{t}" for t in (*story, extra)) + "</div>": " ".join(["The Daily", *story, extra])
                for extra in (sentence(rng, 20) for _ in range(9))}
    got = extracted(spark, {"plain": [*plain_host], "hot": [p for p in hot for _ in range(15)], "versions": [*versions]})
    assert got == plain_host | hot | versions
