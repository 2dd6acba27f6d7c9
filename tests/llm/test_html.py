"""Extraction against hand-written pages, tree matching against plain recursion."""

import html as plain_html
import random
import re

import pytest

import __spark_entry__ as entry
from mercato.llm import html as op

SCHEMA = "page_id long, url string, html string, text string, Host int"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<p>a<b>b</b>c<br>d", "abc d"),
    ("<article><h1>T</h1><p>x &amp;amp; y&nbsp;z &#8364;</p></article><footer>f</footer>", "T x &amp; y z €"),
    ("<body><nav><ul><li>m</ul></nav><div class='ad big'>buy</div><div id=main><p>one</div><form>q</form><aside>s</aside>", "one"),
    ("<article><header><h1>T</h1></header><p>x</p><div class='comments'><p>me!</p></div><footer>by</footer></article>", "T x"),
    ("<header>site</header><main>in<!-- no --><script>if (a<b) '</p>'</script><style>p{}</style></main>out", "in"),
    ("<div class=ad>never closed<article><p>kept</p></article>", "kept"), ("<p>a < b and c > d</p>", "a < b and c > d"),
    ("<article>a<div role=navigation>n</div><p hidden>h</p><p style='display: none'>i</p>b</article>", "a b"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a b c"),
    ("<p title='x > y'>q</p>", "q"), ("<p class=\"broken>q</p>", "q"), ("<script>never closed <p>x", ""), ("x<!-- never closed <p>y", "x"),
    ("<article><p>lead <a href=/x>link</a>.</p></article>", "lead link."), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
])
def test_main_text(page, text):
    assert op.main_text(page) == text


def test_very_long_pages():
    assert op.main_text("<p>word " * 40_000).count("word") == 40_000
    assert op.main_text("<" * 100_000) and op.main_text("<a " * 50_000) is not None


def slow_match(a, b):
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + slow_match(x, y))
    return 1 + m[-1][-1]


def grown(rng, depth):
    node = op.Node(rng.choice("abc"))
    if depth:
        node.kids = [grown(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return node


@pytest.mark.parametrize("seed", range(60))
def test_simple_tree_matching(seed):
    rng = random.Random(seed)
    a, b = grown(rng, 4), grown(rng, 4)
    b.label = b.tag = a.tag
    pairs = []
    size = op.match(a, b, pairs)
    assert size == slow_match(a, b) == len(pairs)
    assert all(x.label == y.label for x, y in pairs)
    assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def site(n, host, seed):
    """Pages with constant lines that no tag gives away, at places that move with the number of paragraphs."""
    rng = random.Random(seed)
    pages, texts = [], []
    for i in range(n):
        words = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 30)))
        parts = [words() for _ in range(rng.randint(1, 6))]
        pages.append(f"<div class=top><p>Welcome to {host}</p></div><div class=story>" + "".join(f"<p>{p}</p>" for p in parts)
                     + f"</div><div class=end><p>All rights by {host}</p></div>")
        texts.append(" ".join(parts))
    return [(f"https://{host}/{i}", p, t) for i, (p, t) in enumerate(zip(pages, texts))]


def test_constant_blocks_are_template(spark):
    found = site(30, "a.org", 1) + site(12, "B.net", 2)
    few = site(3, "few.org", 3)
    rows = [(i, u, p, "", 0) for i, (u, p, _) in enumerate(found + few)]
    got = {r["page_id"]: r for r in op.extract(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    for i, (_, _, text) in enumerate(found):
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text)
    for i, (_, page, _) in enumerate(few, len(found)):
        assert got[i]["text"] == op.main_text(page)


def test_copies_are_no_template(spark):
    rows = [(i, f"http://c.org/{i}", "<article><h1>Same</h1><p>text of all copies</p></article>", "", 0) for i in range(40)]
    got = op.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["text"] for r in got} == {"Same text of all copies"}


def texts_of(spark, pages):
    rows = [(i, u, p, "", 0) for i, (u, p) in enumerate(pages)]
    found = {r["page_id"]: r["text"] for r in op.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    return [found[i] for i in range(len(rows))]


def varied(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))


def test_long_boilerplate_is_template(spark):
    rng = random.Random(5)
    legal, teasers, stories = varied(rng, 80), varied(rng, 60), [varied(rng, rng.randint(2, 9)) for _ in range(20)]
    pages = [(f"http://long.org/{i}", f"<div><p>{legal}</p></div><div><p>{s}</p></div><div><p>{teasers}</p></div>") for i, s in enumerate(stories)]
    assert texts_of(spark, pages) == stories


def test_near_copies_are_no_template(spark):
    rng = random.Random(6)
    lead, story = varied(rng, 30).split(), varied(rng, 60)
    pages = [(f"http://near.org/{i}", f"<p>{' '.join([*lead[:i], 'other', *lead[i + 1:]])}</p><p>{story}</p><p>{i} 7</p>") for i in range(20)]
    assert all(story in t for t in texts_of(spark, pages))


def test_each_layout_has_a_template(spark):
    rng = random.Random(7)
    stories = [[varied(rng, rng.randint(5, 20)) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    tops, ends = [varied(rng, 6) for _ in range(3)], [varied(rng, 12) for _ in range(3)]
    pages = []
    for i, story in enumerate(stories):
        k, inner = i % 3, "".join(f"<p>{p}</p>" for p in story)
        pages.append((f"http://mixed.org/{i}", f"<body><div class=top{k}><p>{tops[k]}</p></div><div class=in{k}>{inner}</div><section><i>{ends[k]}</i></section>"))
    assert texts_of(spark, pages) == [" ".join(s) for s in stories]


def test_empty_pages_are_no_reference(spark):
    pages = [(u, p) for u, p, _ in site(20, "gaps.org", 8)]
    blank = ["", " ", "<p></p>", "<body><nav>menu</nav></body>", "<!-- -->", "\n", "<br>", "<div> </div>"] + [f"<i id={i}></i>" for i in range(60)]
    found = texts_of(spark, [(f"http://gaps.org/blank{i}", p) for i, p in enumerate(blank)] + [(u.replace("https", "http"), p) for u, p in pages])
    assert found == [op.main_text(p) for p in blank] + [t for *_, t in site(20, "gaps.org", 8)]


def test_small_hosts_have_templates(spark):
    small, copies = site(4, "small.org", 9), site(3, "twice.org", 10)
    again = [(f"{u}?{k}", p, t) for u, p, t in copies for k in range(9)]
    found = texts_of(spark, [(u, p) for u, p, _ in small + again])
    assert found == [t for *_, t in small] + [op.main_text(p) for _, p, _ in again]


def test_odd_rows(spark):
    rows = [(1, None, "<p>x", None, None), (None, "http://h/1", None, "", 0), (2, "no host", "", "", 0), (1, None, "<p>x", None, None)]
    got = op.extract(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r["page_id"], r["text"]) for r in got.collect()), key=repr) == [(1, "x"), (1, "x"), (2, ""), (None, "")]
    assert op.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in entry.queries()["op4_wrapper_induction"](spark, sf_dir).collect()}
    for page, text in pages.items():
        inner = re.search(r"<article>(.*)</article>", text, re.S)[1]
        blocks = [" ".join(plain_html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert got[page] == " ".join(b for b in blocks if b)


@pytest.mark.parametrize("levels", [10, 145, 147, 160, 400])
def test_deep_elements_end_where_they_end(levels):
    down, up = "<div>" * levels, "</div>" * levels
    aside = '<div class="sidebar">menu a<div class="menu">menu b</div><div>c</div></div>'
    for page in (f"{down}{aside}{up}<p>real text</p>", f"{down}<p>real</p>{aside}{up}<p>text</p>", f'<div class="nav">{down}menu{up}</div><p>real text</p>'):
        assert op.main_text(page) == "real text"


@pytest.mark.parametrize("page, text", [
    ('<article><h1>T</h1><div class="elementor-widget elementor-widget-text"><p>Body.</p></div></article>', "T Body."),
    ('<main><div class="post social-science"><p>Body.</p></div></main>', "Body."),
    ('<article><p>A.</p><div class="share-buttons">Share</div><div id="ad-slot-2">Buy</div><div class="x widget">W</div><p>B.</p></article>', "A. B."),
    ('<div class="site-widget">W</div><article><p>A.</p><div class="comments-list">C</div></article>', "A."),
])
def test_class_words_within_the_article(page, text):
    assert op.main_text(page) == text
