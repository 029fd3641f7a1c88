"""Style-tree extraction: the parser on broken markup, texts of whole pages, and removal by entropy."""

import re

from docloom.llm import pages as P


def texts(page, removed=()):
    return P.article(page, set(removed)).split("\n")


def test_markup():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{a>b}</style><script>var t="</p>";</script></head><body class="ad">
    <nav><ul><li><a href="/x">x</a></li></ul></nav><!-- c <p>no</p> --><header>top</header><div class="ad big">buy</div><div class="note"><form>f</form></div>
    <article><header><h1>A &amp;  B&eacute;\n</h1></header><p><b>one<br>two<p>three <i>in</i>line &lt;x&gt; <a title="a>b">link</a></p>
    <ul><li>four<li>five</ul><div id="comments"><p>reader</p></div><table><tr><td>six<td>seven</table><p hidden>gone<p>5 < 6 &#228; &am</article><aside>s</aside><footer>&copy;</footer></body></html>"""
    # Names of elements are no verdict here: what they tell is weighed in the tree.
    assert texts(page) == ["buy", "A & Bé", "one two", "three inline <x> link", "four", "five", "reader", "six", "seven", "5 < 6 ä &am"]
    assert texts("") == [""] and texts("plain  text") == ["plain text"]
    assert texts("<article><p>cut <b") == ["cut"] and texts("<article><p>cut <a href='x") == ["cut"] and texts("<article><p>it's <a title=it's>ok</a> <!-- open") == ["it's ok"]
    assert texts("<article><p>a<span hidden>no <b>no</b></span>c <a class='reply'>d</a> <i class='ad'>e</i>") == ["ac d e"]
    assert len(P.blocks("<div>" * 30000 + "deep" + "</div>" * 30000)[0]) == 1
    assert texts("<div class='x y'><p>a</p></div><p>b</p>", ["#/div.x.y"]) == ["b"]


def test_tables_pages(spark):
    """On the generated pages the article is all that stands between <article> and its end."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in P.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    import html

    for r in rows:
        inner = re.split("</article>|<footer", r.html.split("<article>", 1)[1])[0]
        inner = re.sub(r"<[^>]*\Z", "", inner)
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(x for x in want if x) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def site(n, host="h.com", first=0):
    """Pages without telling markup: one branch repeats a few texts, the other doesn't."""
    return [(i + first, f"http://{host}/{i}", f"<body><div class='q'><p>common {i % 3}</p></div><div class='r'><p>own {i} {host}</p><p>more {i}</p></div>") for i in range(n)]


def test_removal_by_entropy(spark, monkeypatch):
    rows = [*site(300), *site(2, "small.com", 1000), (900, None, "<p>x</p>"), (901, "http://h.com/", None), (None, "http://h.com/", site(1)[0][2])]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = {r.page_id: r.text for r in P.extract(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"own {i} h.com\nmore {i}" for i in range(2, 300)) and got[900] == "x" and got[901] == ""
    monkeypatch.setattr(P, "SENT", -1)
    assert {r.page_id: r.text for r in P.extract(pages).collect()} == got


def test_empty(spark):
    assert P.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_copies_of_an_article_count_once(spark):
    """A third of a host's pages copy one article; no <article>, and the boilerplate still goes."""
    page = lambda i, text: (i, "http://h.com/%d" % i, f"<body><div class='q'><p>common {i % 3}</p></div><div class='content'><p>{text}</p><p>more {text}</p></div>")
    rows = [page(3 * i, "copied") for i in range(200)] + [page(1000 + i, f"own {i}") for i in range(400)]
    # Over all hosts too: many hosts of one page each, all with that article.
    rows += [(2000 + i, f"http://h{i}.com/", page(0, "copied")[2]) for i in range(600)] + [(3000, "http://last.com/", page(0, "own last")[2])]
    got = {r.page_id: r.text for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[3 * i] == "copied\nmore copied" for i in range(200))
    assert all(got[1000 + i] == f"own {i}\nmore own {i}" for i in range(400))
    assert "own last\nmore own last" in got[3000] and all("copied\nmore copied" in got[2000 + i] for i in range(600))


def test_importance_decides_inside_article(spark):
    """What all pages repeat inside <article> goes; an article that a third copies, and one that a third nearly copies, stay."""
    page = lambda i, text: (i, "http://h.com/%d" % i, f"<body><article><div class='q'><p>common</p></div><div class='r'><p>{text}</p><p>more {text}</p></div></article>")
    texts_of = {i: "copied" if i < 100 else f"own {i}" for i in range(300)}
    near = [(1000 + i, "http://n.com/%d" % i, f"<body><article><p>near</p><p>one {i}</p><p>near too</p></article>" if i < 100 else f"<body><article><p>a {i}</p><p>b {i}</p><p>c {i}</p></article>") for i in range(300)]
    got = {r.page_id: r.text for r in P.extract(spark.createDataFrame([*(page(i, t) for i, t in texts_of.items()), *near], "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{t}\nmore {t}" for i, t in texts_of.items())
    assert all(got[1000 + i] == (f"near\none {i}\nnear too" if i < 100 else f"a {i}\nb {i}\nc {i}") for i in range(300))


def test_pages_without_telling_markup(spark):
    """No tag or name tells anything: a menu whose links differ from page to page, boilerplate that repeats, an article."""
    page = lambda i: f"<div class='qa'><p><a href='/a'>link {i} a</a></p><p><a href='/b'>link {i} b</a> !</p></div><div class='qb'><p>same {i % 2}</p></div><div class='qc'><p>own {i} <a href='/'>see</a> and more words</p><p>end {i}</p></div>"
    rows = [(i, f"http://h.com/{i}", f"<body>{page(i)}</body>") for i in range(300)]
    # A hinting name with unlike texts stays in an article and goes where its texts repeat at all.
    rows += [(1000 + i, f"http://k.com/{i}", f"<body><div class='related'><p>more {i // 3}</p></div><article><p>art {i}</p><div class='widget'><p>figure {i}</p></div></article></body>") for i in range(300)]
    got = {r.page_id: r.text for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own {i} see and more words\nend {i}" for i in range(300))
    assert all(got[1000 + i] == f"art {i}\nfigure {i}" for i in range(300))


def test_importance_against_a_plain_tree(spark, monkeypatch):
    """Presentation, content and importance of every branch of every host, by loops over pages."""
    import math
    import random
    from collections import Counter, defaultdict

    rng, rows = random.Random(4), []
    for i in range(160):
        kinds = "".join(f"<div class='{rng.choice(chr(113) + chr(114) + chr(115))}'><p>{rng.choice(('t', 'u'))} {rng.randrange(6)}</p>{'<span><a>go %d</a></span>' % rng.randrange(4) if rng.random() < 0.5 else ''}<ul><li>x {rng.randrange(50)}</li></ul></div>" for _ in range(rng.randrange(1, 4)))
        rows.append((f"h{i % 3}.com", f"<body>{kinds}</body>"))
    # Pages of a host with equal texts are one.
    one = {(h, tuple((e.path, linked, t) for e, t, linked in P.blocks(p)[0])): p for h, p in sorted(rows, reverse=True)}
    trees = defaultdict(list)
    for (h, _), p in one.items():
        trees[h].append(P.blocks(p))
    want = {}
    for h, pages in trees.items():
        found = [({e.path for e in es}, {(e.path, e.children) for e in es}, {(e.path, linked, t) for e, t, linked in ts}) for ts, es in pages]
        m = Counter(p for f in found for p in f[0])
        children, texts = Counter(x for f in found for x in f[1]), Counter(x for f in found for x in f[2])
        for path, n_pages in m.items():
            base = math.log(max(2, n_pages))
            presentation = min(1.0, sum(-n / n_pages * math.log(n / n_pages) / base for (p, _), n in children.items() if p == path))
            below = [(math.log(n) / math.log(max(2, m[p])), linked, n) for (p, linked, _), n in texts.items() if p == path or p.startswith(path + "/")]
            if total := sum(n for *_, n in below):
                lost = sum((P.LINKED + (1 - P.LINKED) * x if linked else x) * n for x, linked, n in below)
                want[h, path] = n_pages, (1 - P.GAMMA) * presentation + P.GAMMA * (1 - lost / total)
    distinct = P.distinct_pages(spark.createDataFrame(rows, "host string, html string").repartition(3))
    got = {(r.host, r.path): (r.m, r.importance) for r in P.importance(P.evidence(distinct, ["host"]), ["host"]).collect()}
    assert got.keys() == want.keys() and len(got) > 30
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-9) for k in want)
    few = sorted(map(tuple, P.removals(spark.createDataFrame(rows, "host string, html string")).collect()))
    monkeypatch.setattr(P, "SENT", -1)
    assert few and sorted(map(tuple, P.removals(spark.createDataFrame(rows, "host string, html string")).collect())) == few


def test_nothing_is_cut_in_the_tree(spark):
    """Twenty levels down, boilerplate and article are told apart; so are ninth names, and children beyond any number."""
    deep = lambda i, a, b: "<div>" * 20 + f"<p class='q'>{a}</p><section>{b}</section>" + "</div>" * 20
    rows = [(i, f"http://h.com/{i}", f"<body>{deep(i, 'common', f'own {i}')}</body>") for i in range(300)]
    names = "k b c d e f g h"
    rows += [(1000 + i, f"http://n.com/{i}", f"<body><div class='{names} y'><p>common</p></div><div class='{names} z'><p>own {i}</p></div></body>") for i in range(300)]
    got = {r.page_id: r.text for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own {i}" and got[1000 + i] == f"own {i}" for i in range(300))
    long = lambda end: P.blocks("<body>" + "<p>a</p><i>b</i><div>c</div>" * 500 + end)[1]
    assert next(e.children for e in long("<p>z") if e.tag == "body") != next(e.children for e in long("<ul>z") if e.tag == "body")
    text = " ".join(f"w{i}" for i in range(400_000))
    assert P.article(f"<article><p>{text}</p></article>", set()) == text


def test_attributes():
    """Only whole attributes count, and only their own values."""
    for kept in ("style='overflow:hidden'", 'style="overflow:hidden"', "aria-hidden=false", 'aria-hidden="false"', "data-hidden", "data-id='comment-free'", "title='a hidden role=menu'", "data-role=menu"):
        assert texts(f"<article {kept}><p>whole</p></article>") == ["whole"], kept
        assert "!" not in P.blocks(f"<div {kept}><p>whole</p></div>")[1][1].path, kept
    for gone in ("hidden", "HIDDEN=''", "class=x hidden", "role=navigation", 'title="a>b" role = "menu"'):
        assert texts(f"<article><div {gone}><p>no</p></div><p>yes</p></article>") == ["yes"], gone


def named(host, first, n, middle, article="article"):
    rows = []
    for i in range(n):
        rows.append((first + i, f"http://{host}/{i}", f"<body><{article}><p>start {i}</p>{middle.format(i=i)}<p>end {i}</p></{article}></body>"))
    return rows


def test_names_are_weighed(spark):
    """One word of a name decides nothing; a name that is one for an advert or comments does, though its texts differ everywhere."""
    kept = ["<div class='notice-of-award'><p>won {i}</p></div>", "<section id='promo-code-law'><p>law {i}</p></section>", "<div class='ad-hoc network'><p>net {i}</p></div>", "<div data-id='comment-free'><p>free {i}</p></div>", "<p>see <a class='reply'>reply {i}</a> there</p>", "<div style='overflow:hidden'><p>style {i}</p></div>"]
    gone = ["<div class='ad'><p>buy {i}</p></div>", "<div id='comments'><p>reader {i}</p></div>", "<div class='big cookie-notice'><p>cookie {i}</p></div>", "<div class='left-sidebar x'><p>side {i}</p></div>"]
    rows = [r for k, m in enumerate(kept + gone) for tag in ("article", "div") for r in named(f"h{k}{tag}.com", 10_000 * k + 5_000 * (tag == "div"), 60, m, tag)]
    got = {r.page_id: r.text for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for k, m in enumerate(kept + gone):
        for i in (0, 7, 59):
            for at in (0, 5_000):
                middle = "\n".join(texts(m.format(i=i))) if m in kept else None
                assert got[10_000 * k + at + i].split("\n") == [f"start {i}", *([middle] if middle else []), f"end {i}"], (m, at)


def test_deep_branches_with_children(spark):
    """Twenty levels down a branch goes with the blocks in it, and its neighbours stay; the same at any depth that is told apart."""
    for depth in (3, 20, 60):
        page = lambda i: "<body>" + "<div>" * depth + f"<section><div><p>same {i % 2}</p></div><p>same too</p></section><div class='c'><p>own {i}</p><ul><li>item {i}</li></ul></div>" + "</div>" * depth  # noqa: B023, E731
        rows = [(i, f"http://h.com/{i}", page(i)) for i in range(200)]
        got = {r.page_id: r.text for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert all(got[i] == f"own {i}\nitem {i}" for i in range(200)), depth
    branch, child = (next(e for e in P.blocks("<div>" * 30 + "<section><p>x")[1] if e.tag == tag) for tag in ("section", "p"))
    assert child.path.startswith(branch.path + "/")


def test_the_tree_alone(spark, monkeypatch):
    """With every list of noise emptied (but for scripts and the like), importance finds the article of at least 0.95 of the pages."""
    import html

    markup = frozenset("head script style noscript template title svg math".split())
    for name, value in (("NOISE", markup), ("NOISE_ROLES", frozenset()), ("NOISE_WORDS", frozenset()), ("HINTS", frozenset())):
        monkeypatch.setattr(P, name, value)
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    host = lambda r: r.url.split("://", 1)[1].split("/")[0].lower()
    # The pages are read here, since the emptied lists hold in this process alone; the trees are built by Spark.
    found = spark.createDataFrame([(host(r), *P.found_in(r.html)) for r in rows], f"host string, print long, {P.FOUND}")
    monkeypatch.setattr(P, "distinct_pages", lambda _: found)
    removed = {}
    for r in P.removals(found).collect():
        removed.setdefault(r.host, set()).add(r.path)
    equal = changed = 0
    for r in rows:
        inner = re.sub(r"<[^>]*\Z", "", re.split("</article>|<footer", r.html.split("<article>", 1)[1])[0])
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)) if x)
        equal += P.article(r.html, removed.get(host(r), set())) == want
        changed += P.article(r.html, set()) != P.article(r.html, removed.get(host(r), set()))
    assert equal >= 0.95 * len(rows) and changed >= 0.95 * len(rows)
