import os
import random
import re
import time

import pytest

from codetally.llm.html_extraction import BONUS, blocks_of, extract, main_text
from codetally.llm.queries import QUERIES

LONG = "A paragraph of the story, with commas, and enough words to be told from a menu. It goes on for a while, and on."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("<script>var t='</p>'", ""),
        (f"<body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Be.</p><ul><li>one<li>two</ul></article><footer>&copy; me</footer>", f"Title\n{LONG}\nBe.\none\ntwo"),
        ("<article><p>a &amp; b&nbsp;&lt;c&gt; &eacute;&#233;\n\t d</p></article>", "a & b <c> éé d"),
        ("<article><p>one <b>bold</b>er <i>t</i>ext<br>next</p></article>", "one bolder text next"),
        ("<article><p>x</p><div class='ad'>buy</div><div class='share-buttons'>share</div><aside>by the way</aside><form>Name <input></form><p>y</p></article>", "x\ny"),
        ("<article><p>x</p><section id='comments'><article><p>I think so too, and more.</p></article></section></article>", "x"),
        ("<article><p>x</p><!-- <p>hidden</p> --><style>p{}</style><noscript>on</noscript><p hidden>h</p><p>y", "x\ny"),
        ("<article><p><b>never closed<br><p>next</p></article><p>after</p>", "never closed\nnext"),
        ("<main><p>" + LONG + "</p></main><p>outside of it, which is also long, and punctuated, as it were.</p>", LONG),
        ("<article><p>cut &am", "cut &am"), ("<article><p>cut</p><a href='x", "cut"), ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>x <svg width=1/> y</p><p>{LONG}</p></article>", f"x y\n{LONG}"),
        (f"<article><p>x <math/> y</p><p>{LONG}</p></article>", f"x y\n{LONG}"),
        (f"<article><p>x</p><object data=a><p>{LONG}</p></article>", f"x\n{LONG}"),
        ("<article><p>so <math><msup><mi>a</mi><mn>2</mn></msup><mspace/></math> is</p></article>", "so a2 is"),
        (f"<body><form action=a><input><select><option>one</select><article><h1>T</h1><p>{LONG}</p></article><button>go</button></form>", f"T\n{LONG}"),
        (f"<article><p>{LONG}</p><form>Your name, please <input></form></article>", LONG),
    ],
)
def test_nothing_is_cut_after_an_element(page, text):
    assert main_text(page) == text


def test_without_a_marked_article():
    page = (
        "<body class='has-sidebar'><header><h1>Site</h1></header><div id='menu'><a href=x>One</a> <a href=y>Two</a></div>"
        f"<div class='story'><h2>Headline</h2><p>{LONG}</p><p>Short.</p><ul><li>an item</li></ul><p>{LONG}</p></div>"
        "<div><a href=1>Some other story</a> <a href=2>And one more</a></div><div class='sidebar'><p>" + LONG + "</p></div><footer>(c)</footer>"
    )
    assert main_text(page) == f"Headline\n{LONG}\nShort.\nan item\n{LONG}"


def test_teasers_beside_the_article_are_dropped():
    page = f"<article><h1>T</h1>{f'<p>{LONG}</p>' * 5}</article><article><h2>Another</h2><p>Read more</p></article>"
    assert main_text(page) == "\n".join(["T"] + [LONG] * 5)


def test_long_and_broken_pages_take_linear_time():
    start = time.time()
    for page in ("<div>" * 50000 + "x", "<" * 50000, "<a '" * 20000, "<p>x" * 50000, "<li>x" * 20000, "<script>" * 20000, "</b>" * 50000, "<b>" * 50000):
        main_text(page)
    assert time.time() - start < 60


def test_query(spark, tables):
    pages = spark.createDataFrame([(1, "u", None, 5), (2, None, "<article><p>café \U0001f600</p></article>", 5), (None, "u", "", 5)], "page_id long, url string, html string, n_chars int")
    rows = QUERIES["op4_html_extraction"](spark, tables(pages=pages)).collect()
    assert sorted(rows, key=str) == sorted([(1, "u", "", 0), (2, None, "café \U0001f600", 6), (None, "u", "", 0)], key=str)
    assert extract(pages.limit(0)).count() == 0


PARAGRAPHS = "".join(f"<p>{LONG}</p>" for _ in range(6))


def test_a_marked_card_does_not_replace_the_text():
    card = "<article><p>A related story, briefly.</p></article>"
    for page in (f"<body><div class=text>{PARAGRAPHS}</div>{card}</body>", f"<body>{card}<div class=text>{PARAGRAPHS}</div></body>"):
        assert main_text(page) == "\n".join([LONG] * 6)


def test_several_marked_parts_stay():
    posts = "".join(f"<article><h2>Post {i}</h2>{f'<p>{LONG}</p>' * n}</article>" for i, n in enumerate((8, 2, 2)))
    assert main_text(f"<body>{posts}</body>").count(LONG) == 12


@pytest.mark.parametrize(
    "part", ["<h2 id='related-work'>Related work</h2>", f"<section id='social-impact'><p>{LONG}</p></section>", "<figure><figcaption>A caption, as it is.</figcaption></figure>", f"<p class='comment'>{LONG}</p>"]
)
def test_parts_of_the_article_are_not_dropped_by_a_word(part):
    wanted = re.sub("<[^>]*>", "", part)
    assert wanted in main_text(f"<article><h1>T</h1>{PARAGRAPHS}{part}<p>{LONG}</p></article>").split("\n")


@pytest.mark.parametrize("name", ["comments", "comments-area", "ad slot-1", "sidebar-left", "related-posts", "cookie-notice"])
def test_what_the_contract_names_is_dropped(name):
    assert main_text(f"<article>{PARAGRAPHS}<div class='{name}'><p>{LONG} Not this.</p></div></article>") == "\n".join([LONG] * 6)


def brute_content(page):
    """The content of a page by the rules as they are stated, block after block."""
    blocks, marks = blocks_of(page)
    blocks = [(b, " ".join("".join(b.text).split())) for b in blocks]
    blocks = [(b, t) for b, t in blocks if t]
    plain = [max(0, len(t) - b.links) for b, t in blocks]

    def per_block(of, value):
        same = [(b.path, b.marked) == (of.path, of.marked) for b, _ in blocks]
        return sum(value(t, size) for (_, t), size, use in zip(blocks, plain, same) if use) / sum(same)

    lengths = [per_block(b, lambda t, size: size) for b, _ in blocks]
    points = [per_block(b, lambda t, size: len(re.findall("[.,;:!?]", t)) if size else 0) for b, _ in blocks]
    smooth = lambda xs: [xs[max(0, i - 1)] / 4 + x / 2 + xs[min(len(xs) - 1, i + 1)] / 4 for i, x in enumerate(xs)]
    fused = [x * (1 + y) for x, y in zip(smooth(lengths), smooth(points))]
    kind = "article" if any(marks.get(b.marked) == "article" for b, _ in blocks) else "main"
    inside = [marks.get(b.marked) == kind for b, _ in blocks]
    if sum(f for f, i in zip(fused, inside) if i) <= sum(fused) / 2:
        inside = [False] * len(blocks)
    fused = [BONUS * f if i else f for f, i in zip(fused, inside)]
    mean = sum(f * size for f, size in zip(fused, plain)) / max(1, sum(plain))
    enough = [f >= mean / 2 for f in fused]
    linked = [1 - size / len(t) > 0.6 for (_, t), size in zip(blocks, plain)]
    own = [e and not li for e, li in zip(enough, linked)]
    chosen = [o or i and any(p and q and c.where == b.where for (c, _), p, q in zip(blocks, own, inside)) for (b, _), o, i in zip(blocks, own, inside)]
    for i, (b, _) in enumerate(blocks):
        before = [j for j in range(i) if own[j] or chosen[j] and inside[j]]
        after = [j for j in range(i + 1, len(blocks)) if own[j] or chosen[j] and inside[j]]
        if before and after and blocks[before[-1]][0].where == blocks[after[0]][0].where == b.where:
            chosen[i] = True
    for i in range(len(blocks) - 2, -1, -1):
        if blocks[i][0].heading and chosen[i + 1] and blocks[i][0].where == blocks[i + 1][0].where:
            chosen[i] = True
    return "\n".join(t for (_, t), use, e, li in zip(blocks, chosen, enough, linked) if use and (e or not li))


def random_page(rng):
    words = "story town and, of weather. friends! old the".split()

    def text(n):
        return " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))

    def part(depth):
        kind = rng.choice(["p", "p", "p", "h2", "li", "a", "div", "article", "main", "ul", "section"])
        if kind == "a":
            return f"<div><a href=x>{text(6)}</a> {text(2)}</div>"
        if kind in ("p", "h2", "li") or depth > 3:
            return f"<{kind}>{text(60 if kind == 'p' else 8)}</{kind}>"
        return f"<{kind}>{''.join(part(depth + 1) for _ in range(rng.randint(1, 5)))}</{kind}>"

    return "<body>" + "".join(part(0) for _ in range(rng.randint(1, 8))) + "</body>"


def test_content_like_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        page = random_page(rng)
        assert main_text(page) == brute_content(page)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables not present")
def test_ratios_alone_find_the_article(spark):
    """Without leaving anything out by name, the given pages give the same text on 95 in 100."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert sum(main_text(p) == main_text(p, by_name=False) for p in pages) >= 0.95 * len(pages)


def test_repeated_rows_and_a_column_of_the_result_s_name(spark):
    rows = spark.createDataFrame([("<article><p>x, y.</p></article>", "old", 1)] * 3, "html string, main_text string, n int")
    assert [(r.main_text, r.n) for r in extract(rows).collect()] == [("x, y.", 1)] * 3
