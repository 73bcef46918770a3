import re
import time
from html import unescape

import numpy as np
import pytest

from probatio.llm import html_tree
from probatio.llm.html_tree import Node, main_text

PARAGRAPHS = [f"Paragraph {k} of the story, long enough to be counted, with commas, and with an end." for k in range(5)]
STORY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TALK = "".join(f"<p>Reply {k}, which is a remark, not the story, however long it gets, really.</p>" for k in range(12))


@pytest.mark.parametrize(
    "opened",
    [
        "<div class='content with-sidebar'>", "<div id=page class='site side-nav'>", "<div class='post-content social-share'>", "<div class='with-sidebar'><article>",
        "<div class='page-with-sidebar'>", "<div class='with-sidebar'><div class='has-nav'>", "<main><div class='with-sidebar'><article>",
    ],
)
def test_unlikely_words_do_not_cut_the_article(opened):
    page = f"<body><div class='menu'><p>Home, news, sport, and more of the same.</p></div>{opened}{STORY}</body>"
    assert main_text(page).split("\n") == PARAGRAPHS


@pytest.mark.parametrize("cut", ["<div id=comments>", "<div class='comment-list'><article class='comment-body'>", "<div class='related'><article>", "<div class='post-comments'>"])
def test_unlikely_parts_are_still_cut(cut):
    talk = TALK if "<article>" not in cut else TALK[:160]
    assert main_text(f"<body><article>{STORY}</article>{cut}{talk}</body>").split("\n") == PARAGRAPHS
    assert main_text(f"<body><div class='with-sidebar'><article>{STORY}</article>{cut}{talk}</div></body>").split("\n") == PARAGRAPHS


@pytest.mark.parametrize("tag", ["article", "main"])
def test_the_article_is_kept_whole(tag):
    long = "".join(f"<p>{'One, two, ' * 5}{'x' * 240} {k}.</p>" for k in range(5))
    rest = "<h3>Head</h3><blockquote>Said</blockquote><ul><li>item</li></ul><table><tr><td>cell</td></tr></table>loose <b>text</b><section><p>A short paragraph that closes the article, as such do here</p></section>"
    got = main_text(f"<body><{tag}><section>{long}</section>{rest}</{tag}><div><p>Of no concern at all, to anyone, anywhere</p></div></body>").split("\n")
    assert len(got) == 11 and got[5:] == ["Head", "Said", "item", "cell", "loose text", "A short paragraph that closes the article, as such do here"]


def test_text_beside_the_container_reads_as_prose():
    page = f"<body><div class=x>Loose words, with <b>bold</b> ones, end here.<div>{STORY}</div><span>by</span></div></body>"
    assert main_text(page).split("\n") == ["Loose words, with bold ones, end here.", *PARAGRAPHS]
    assert main_text(f"<body><font>{STORY}</font></body>").split("\n") == PARAGRAPHS


SHORT = ["<h2>Two</h2>", "<p>Short words.</p>"]
SIDE = "<div class='sidebar'><p>Most read of the week, and more of it, and even more than that, in full.</p></div>"
MENU = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
FOOT = "<footer><p>Imprint, terms, and the like, of a house that prints, for those who read it.</p></footer>"
LAYOUTS = {
    "article": f"{MENU}<article>%s</article>{FOOT}",
    "main": f"{MENU}<main>%s</main>{SIDE}{FOOT}",
    "role main": f"{MENU}<div role=main id=main>%s</div>{SIDE}",
    "bootstrap columns": f"<div class='container'><div class='row'><div class='col-md-8 content'>%s</div><div class='col-md-4'>{SIDE}</div></div></div>",
    "bootstrap hidden-xs": f"{MENU}<div class='page hidden-xs'>%s</div>",
    "bootstrap visible": f"{MENU}<div class='container-fluid d-none d-md-block'><div class='row'><div class='col-12'>%s</div></div></div>",
    "has-sidebar main": f"{MENU}<div class='has-sidebar main'>%s</div>{SIDE}",
    "nav-open body": f"<div class='nav-open'><div class='wrap'>{MENU}<article>%s</article></div></div>",
    "with-sidebar": f"<div class='with-sidebar'><div class='content'>%s</div>{SIDE}</div>",
    "social-share": f"<div class='post-content social-share'>%s</div>{FOOT}",
    "entry": f"<div id=wrapper><div class='entry'>%s</div><div id=comments><p>First, says one, of many, who have read it to the end.</p></div></div>",
    "nested article": f"<main><div class='grid'><div><article>%s</article></div>{SIDE}</div></main>",
    "deep": "<div>" * 90 + "%s" + "</div>" * 90 + FOOT,
    "deep article": "<div>" * 300 + "<article>%s</article>" + "</div>" * 300,
    "font": "<center><font>%s</font></center>",
    "upper case": "<BODY><DIV CLASS=CONTENT>%s</DIV></BODY>",
    "unclosed div": f"{MENU}<div class=content>%s",
    "unclosed article": f"{MENU}<article>%s",
    "stray ends": "</p></div></b><div class=content>%s</div></section></i>",
    "form beside": "<form><label>Name</label><input name=a><p>Fill in all of it, please, before you go, and send it.</p></form><div class=post>%s</div>",
    "dialog": "<dialog open><p>We use cookies, as all do, and would like to have your consent.</p></dialog><div class=story>%s</div>",
    "cookie notice": "<div class='cookie-notice'><p>We use cookies, as all do, and would like to have your consent.</p></div><article>%s</article>",
    "aria-hidden": "<div aria-hidden=true><p>Out of sight, out of mind, or so they say, of such text here.</p></div><article>%s</article>",
    "display none": "<div style='display: none'><p>Out of sight, out of mind, or so they say, of such text.</p></div><article>%s</article>",
    "quoted sign": "<div class=content data-x='a > b' title=\"<p>no</p>\">%s</div>",
    "stray quotes": "<div class=content\" id=it's>%s</div>",
    "comment": "<!-- <article><p>Not this one, it is a comment, and nothing but a comment.</p></article> --><article>%s</article>",
    "script": "<script>var a = '<p>Neither this, nor that, nor anything else in a script.</p>';</script><article>%s</article>",
    "breadcrumbs": "<ol class=breadcrumb><li><a href=/>Start</a></li><li><a href=/x>Here</a></li></ol><section class=article-body>%s</section>",
    "pager": "<div class=article>%s</div><div class=pagination><a href=2>2</a> <a href=3>3</a> pages of it, and more to come, as ever</div>",
    "related": "<article>%s</article><div class=related><article><p>Another one, shorter.</p></article></div>",
    "adverts": "<div class='ad-slot ad'><p>Buy this, or that, or anything at all, as long as you buy it.</p></div><div class=text>%s</div>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    body = LAYOUTS[layout]
    page = body % STORY if body.startswith("<BODY>") else f"<html><head><title>T</title></head><body>{body % STORY}</body></html>"
    assert main_text(page).split("\n") == PARAGRAPHS


@pytest.mark.parametrize("layout", ["article", "main", "role main", "bootstrap columns", "has-sidebar main", "entry", "deep"])
def test_short_parts_stay(layout):
    """Two sections, a short one between headings, a formula and a label."""
    inner = f"<section>{STORY}</section><h2>Two</h2><section><p>Short words.</p></section><h3>Three</h3><div><p>For <math><mi>x</mi></math>, see <label>Table 1</label>.</p></div><section>{STORY}</section>"
    got = main_text(f"<body>{LAYOUTS[layout] % inner}</body>").split("\n")
    assert got == [*PARAGRAPHS, "Two", "Short words.", "Three", "For x, see Table 1.", *PARAGRAPHS]


@pytest.mark.parametrize(
    "page",
    [
        "<a " + "\"\"" * 10_000, "<a x=" + "\"'" * 10_000 + f"><article>{STORY}</article>", "<a" * 500_000, "<a x=\"" * 170_000 + ">", "<title>" * 140_000, "</script " * 110_000,
        "<div>" * 60_000 + "</p>" * 60_000, "<i><div>" + "<b>" * 60_000 + "</i>" * 60_000, "<b>" * 60_000 + "<div></div>" * 30_000, "<b>" * 40_000 + "<li></li>" * 40_000,
        "<div>" * 20_000 + f"<p>{PARAGRAPHS[0]}</p>" * 5_000, "<!--" * 200_000, "<![CDATA[" * 100_000, "< " * 400_000, "&" * 500_000, "<table><tr><td>" * 40_000, "<div class='" + "a " * 400_000 + "'>",
        "<header>" * 50_000, "<div class=side>" * 30_000, "<a" + " " * 900_000, "<a b" + "=" * 900_000,
    ],
    ids=range(21),
)
def test_time_is_linear_in_the_page(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 6


def test_unclosed_quotes_do_not_lose_the_page():
    assert main_text(f"<body><a href=\"x>link</a><article>{STORY}</article>").split("\n")[-5:] == PARAGRAPHS


def _random_page(draw) -> str:
    def part(depth: int) -> str:
        tag = draw.choice(["div", "section", "p", "ul", "blockquote", "article"], p=[0.35, 0.1, 0.35, 0.1, 0.05, 0.05])
        words = " ".join(draw.choice(["word", "and,", "long", "text", "<a href=x>link to it</a>", "<b>bold</b>"], int(draw.integers(1, 60))))
        if tag == "p" or depth > 5:
            return f"<p>{words}</p>"
        if tag == "ul":
            return f"<ul><li>{words}</li><li>{words}</li></ul>"
        name = draw.choice(["", " class=content", " class=x"])
        return f"<{tag}{name}>{''.join(part(depth + 1) for _ in range(draw.integers(1, 4)))}</{tag}>"

    return f"<body>{''.join(part(0) for _ in range(draw.integers(1, 5)))}</body>"


def _brute_scores(root: Node) -> dict[int, float]:
    """Every paragraph's points added to every ancestor, one by one."""

    def walk(node):
        yield node
        for x in node.children:
            if isinstance(x, Node):
                yield from walk(x)

    def texts(node, linked=False, blocks=True):
        for x in node.children:
            if isinstance(x, str):
                yield x, linked
            elif blocks or x.tag not in html_tree.BLOCK:
                yield from texts(x, linked or x.tag == "a", blocks)

    def density(node):
        both = [(len(x.strip()), linked or node.tag == "a") for x, linked in texts(node)]
        return sum(n for n, linked in both if linked) / max(1, sum(n for n, _ in both))

    out: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for node in walk(root):
        own = " ".join("".join(x for x, _ in texts(node, blocks=False)).split())
        if node.tag not in html_tree.PARAGRAPHS or len(own) < 25:
            continue
        points = (1 + own.count(",") + min(len(own) // 100, 3)) * (1 - density(node))
        up, share = node.parent, 1.0
        while up is not root:
            nodes[id(up)] = up
            out[id(up)] = out.get(id(up), 0.0) + points * share
            up, share = up.parent, share / 2
    bonus = {"article": 25, "main": 25, "div": 5, "section": 5}
    return {k: (v + 25 * nodes[k].likely + bonus.get(nodes[k].tag, 0)) * (1 - density(nodes[k])) for k, v in out.items()}


def test_scores_equal_brute_force():
    draw = np.random.default_rng(11)
    seen = 0
    for _ in range(150):
        root = html_tree.parse(_random_page(draw))
        html_tree.prune(root)
        sizes = html_tree._sizes(root)
        got = {id(x): w for x, w in html_tree.worths(root, lambda x: sizes[id(x)][1] / max(1, sizes[id(x)][0]))}
        want = _brute_scores(root)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
        seen += len(got)
    assert seen > 300


def _brute_text(page: str) -> str:
    """The article of a page of the tables: cut out, split at its block tags, stripped of the others."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:p|h1|h2|ul|li|div|section)>", inner)]
    return "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    from probatio.llm.registry import QUERIES

    folder = f"/root/testdata/{sf}"
    want = {r["page_id"]: _brute_text(r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op8_html_extraction"](spark, folder).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(want)


def test_nulls_empty_tables_and_clashing_names(spark):
    from probatio.llm.op08_html import extract

    schema = "page_id long, url string, html string, id string, text string"
    rows = [(1, None, None, "a", "b"), (None, "u", "", None, None), (2, "v", f"<article>{STORY}</article>", "c", "d"), (2, "v", f"<article>{STORY}</article>", "c", "d")]
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    story = "\n".join(PARAGRAPHS)
    assert got == [(0, "", 0), (1, "", 0), (2, story, len(story)), (2, story, len(story))]
    assert extract(spark.createDataFrame([], schema)).count() == 0
