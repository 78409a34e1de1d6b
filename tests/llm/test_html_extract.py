import random
import tracemalloc

import pytest

from webframe.llm import html_extract
from webframe.llm.html_extract import Node, align, content_blocks, extract_text, host_of


def text(source):
    return "\n".join(t for _, t in content_blocks(source)[1])


@pytest.mark.parametrize(
    "source,want",
    [
        ("<article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three</article>", "A & B\nOne two.\nThree"),
        ("<nav>x</nav><header>y</header><div class='ad box'>z</div><p>text</p><footer>f</footer>", "text"),
        ("<main><header><h1>T</h1></header><p>a<script>var t='</p>'</script>b</p><form>q</form><aside>r</aside></main>tail", "T\nab"),
        ("<div>a<div class=comments><p>c</p></div>b</div><p hidden>h</p><div role=navigation>n</div>", "a\nb"),
        ("<p>a <i>b</i>c</p>d<!-- x > y --><ul><li>e<li>f</ul>", "a bc\nd\ne\nf"),
        ("<article class='post-sidebar'>ok &copy; &#233;&#xe9; &unknown; 1 < 2</article>", "ok © éé &unknown; 1 < 2"),
        ("<title>t</title><style>p{}</style>plain", "plain"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p>open <b", "open <b"), ("", ""), ("<", "<"), ("<p></p>  ", ""), ("</p>x</div>y", "xy"),
        ("<!DOCTYPE html><html><body><article><p>cut off in the mid", "cut off in the mid"),
    ],
)
def test_blocks(source, want):
    assert text(source) == want


def tree(spec):
    node = Node(spec[0], False, False)
    node.children = [tree(c) for c in spec[1:]]
    return node


def heaviest(a, b):
    """Size of the largest mapping, tried in full."""
    if a.tag != b.tag:
        return 0

    def lists(x, y):
        if not x or not y:
            return 0
        return max(lists(x[1:], y), lists(x, y[1:]), (heaviest(x[0], y[0]) + lists(x[1:], y[1:])) if x[0].tag == y[0].tag else 0)

    return 1 + lists(a.children, b.children)


def test_alignment_is_the_largest():
    a = tree(("d", ("p",), ("d", ("p",), ("u", ("l",), ("l",))), ("p",), ("h",)))
    b = tree(("d", ("h",), ("d", ("u", ("l",))), ("p",), ("p",), ("h",)))
    assert len(align(a, b)) == heaviest(a, b) == 6


def size(tree):
    return 1 + sum(map(size, tree.children))


@pytest.mark.parametrize("seed", range(6))
def test_random_alignments_are_the_largest(seed):
    rng = random.Random(seed)

    def grown(depth):
        return (rng.choice("pdu"), *(grown(depth - 1) for _ in range(rng.randrange(0, 4) if depth else 0)))

    for _ in range(60):
        a, b = tree(("r", *grown(2)[1:])), tree(("r", *grown(2)[1:]))
        mapped = align(a, b)
        assert len(mapped) == heaviest(a, b)
        assert len({id(n) for n in mapped.values()}) == len(mapped)


def test_texts_weigh():
    a = content_blocks("<div><p>one</p><p>two</p><p>three</p></div>")[0]
    b = content_blocks("<div><p>new</p><p>one</p><p>two</p><p>other</p></div>")[0]
    texts = {n.blocks[0]: align(a, b)[id(n)].blocks[0] for n in a.children[0].children}
    assert texts == {"one": "one", "two": "two", "three": "other"}


@pytest.mark.parametrize("kind", ["leaves", "inner"])
def test_wide_pages_take_little_memory(kind):
    """Two lists of very many different blocks; memory is that of the pages and of single rows."""
    n = 50_000 if kind == "leaves" else 4_000
    shown = (lambda k, t: f"<p>{t} {k}</p>") if kind == "leaves" else (lambda k, t: f"<ul><li>{t} {k}</li><li>same</li></ul>")
    a, b = ("<div>" + "".join(shown(k, t) for k in range(0, n, step)) + "</div>" for t, step in (("text", 1), ("text", 40)))
    a, b = content_blocks(a)[0], content_blocks(b)[0]
    tracemalloc.start()
    mapped = align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    per_node = 300 if kind == "leaves" else 1500
    assert peak < per_node * (size(a) + size(b)) + 30e6
    lists = [(x, mapped[id(x)]) for x in a.children[0].children if id(x) in mapped]
    assert len(lists) == len(b.children[0].children) == -(-n // 40)
    told = [x.blocks or x.children[0].blocks for x, _ in lists]
    assert told == [y.blocks or y.children[0].blocks for _, y in lists]


@pytest.mark.parametrize("seed", range(4))
def test_wide_pages_map_like_narrow_ones(seed, monkeypatch):
    """Weights by kinds of subtrees are those of the single pairs, whatever texts the pages share."""
    rng = random.Random(seed)

    def grown(depth, words):
        inside = "".join(grown(depth - 1, words) for _ in range(rng.randrange(0, 5) if depth else 0))
        tag = rng.choice(["div", "ul", "section"])
        return f"<{tag}>{rng.choice(words)}{inside}</{tag}>"

    for n in (2, 5, 40):
        words = ["", *(f"w{k}" for k in range(n))]
        for _ in range(40):
            a, b = (content_blocks("".join(grown(3, words) for _ in range(rng.randrange(1, 6))))[0] for _ in "ab")
            maps = []
            for wide, rare in ((1 << 60, 8), (-1, 8), (-1, 0.6)):
                monkeypatch.setattr(html_extract, "WIDE", wide)
                monkeypatch.setattr(html_extract, "RARE", rare)
                maps.append({k: id(y) for k, y in align(a, b).items()})
            assert maps[0] == maps[1] == maps[2]


def test_items_of_wide_lists_map_with_what_is_below_them():
    """Items of different shape share the texts of their first paragraphs; lists of every length map them."""
    for n in (3, 600):
        a, b = (
            content_blocks("<div>" + "".join(f"<section><p>title {k}</p>{more * '<p>x</p>'}</section>" for k in range(n)) + "</div>")[0]
            for more in (1, 2)
        )
        mapped = align(a, b)
        assert len(mapped) == 2 + 3 * n


@pytest.mark.parametrize(
    "source,want",
    [
        ("<article><p>the text</p></article><section id='comments'><h3>2 replies</h3><article class='comment-body'><p>first!</p></article></section>", "the text"),
        ("<main><p>the text</p><section id=comments><article><p>a comment that is longer than the text</p></article></section></main>", "the text"),
        ("<div class='sidebar'><article class=teaser><p>teaser</p></article></div><article><p>the text of it</p></article>", "the text of it"),
        ("<article><p>text</p><div class='related-posts'><article><p>see also, long long long</p></article></div></article>", "text"),
        ("<p>text</p><ol class='comment-list'><li>c</ol><div class='comments-area'>d</div><div class='ad-container'>e</div><div id='ad-slot-3'>f</div>", "text"),
        ("<div class='site-header'>a</div><div class='main-navigation'>b</div><p>text</p><div class='newsletter-form'>c</div><div class='siteFooter'>d</div>", "text"),
        ("<div class='sidebar-wrapper'><article><p>only article</p></article></div><p>out", "only article"),
        ("<main><div class='left-menu'><article><p>in a menu by name</p></article></div><p>about</main>", "in a menu by name\nabout"),
        ("<article class='comment'><p>no article here</p></article><p>the text", "the text"),
        ("<article class='post sidebar'><p>an article</p></article>", "an article"),
        ("<div class='comments'><p>nothing but comments on this page, and more of them than text</p></div><p>text", "text"),
    ],
)
def test_comments_adverts_and_footers_go(source, want):
    assert text(source) == want


def test_few_pages_of_a_host(spark):
    """Votes of four pages reach no share, so nothing of theirs is template; those of five do."""
    def page(host, k):
        return f"<div><p>Welcome to our site</p></div><div><p>Body {k} of {host}</p></div>"

    rows = [(10 * n + k, f"http://h{n}.com/{k}", page(n, k)) for n in range(1, 7) for k in range(n)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {10 * n + k: ("" if n > 4 else "Welcome to our site\n") + f"Body {k} of {n}" for n in range(1, 7) for k in range(n)}


def test_deep_pages_do_not_recurse():
    deep = "<div>" * 3000 + "x"
    root, blocks = content_blocks(deep)
    assert len(align(root, content_blocks(deep)[0])) == 3001 and blocks[0][1] == "x"


def test_hosts(evaluate):
    urls = ["http://A.example.com/x?y", "https://u@b.c:80", "//d/e", "nothing", None, "http:///x"]
    assert evaluate([(u,) for u in urls], ["u"], lambda: host_of("u")) == ["a.example.com", "b.c", "d", "", "", ""]


def test_constant_nodes_are_template(spark):
    def page(k, extra=""):
        return f"<div><p>Welcome to our site</p></div><div><h2>Title {k}</h2><p>Body of page {k}{extra}</p></div><div><p>Call us</p></div>"

    rows = [(k, f"http://a.com/{k}", page(k, " more" * k), "old", "b") for k in range(8)]
    rows += [(20 + k, "http://b.com/", "<div><p>Same article text</p></div>", "old", "b") for k in range(9)]
    rows += [(40, None, page(1), "o", "b"), (41, "http://a.com/x", None, "o", "b"), (42, "http://a.com/y", "", "o", "b"), (43, "http://a.com/z", "<p>" + "long " * 50000, "o", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, blocks string")
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "blocks", "text"]
    out = {r.page_id: r.text for r in got.collect()}
    assert len(out) == len(rows)
    assert [out[k] for k in range(8)] == [f"Title {k}\nBody of page {k}{' more' * k}" for k in range(8)]
    assert {out[20 + k] for k in range(9)} == {"Same article text"}
    assert out[40].startswith("Welcome") and out[41] == "" and out[42] == "" and len(out[43]) == 5 * 50000 - 1
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "source,want",
    [
        ("<div class='site no-sidebar'><p>text</p></div><p>more", "text\nmore"),
        ("<div class='content-sidebar-wrap'><article><p>text</p></article></div>", "text"),
        ("<div id=page class=has-menu><p>text</p></div>", "text"),
        ("<div class=popup><div class=widget><main><p>text<div class=sidebar>s</div></main></div><p>out</div>", "text"),
        ("<div class=social><p>most of the text of the page</p><div class='cookie-banner'>ok</div></div><p>rest", "most of the text of the page\nrest"),
        ("<main><p>text</p><div class=comments>much more than the text of the page</div></main>", "text"),
        ("<div class='share nav-menu'>x</div><div class=header>y</div><div hidden><main>z</main></div><p>the text", "the text"),
    ],
)
def test_names_do_not_drop_the_article(source, want):
    assert text(source) == want


def test_template_that_the_smallest_pages_lack(spark):
    def page(k, tail=""):
        return f"<div><p>Welcome to our site</p></div><div><h2>Title {k}</h2><p>Body {k}{' more' * k}</p></div>{tail}"

    tail = "<section><div><p>Call us</p></div></section>"
    rows = [(k, "http://a.com/x", page(k, tail if k > 14 else "")) for k in range(20)] + [(99, "http://a.com/y", "<p>gone")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    out = {r.page_id: r.text for r in got}
    assert [out[k] for k in range(20)] == [f"Title {k}\nBody {k}{' more' * k}" for k in range(20)] and out[99] == "gone"
