"""A forgiving HTML parser and the scoring of its tree.

Paragraph-like blocks earn points (one, one for each comma, one for each 100
characters up to three). A block's points pass to its parent in full, to the
grandparent by half and are halved at each level further up, and each
candidate's sum is discounted by its link density. The best container is kept with those
siblings that score well, read as prose or lie between such. Parts that are
never article text are cut before scoring: by tag, by role, and by the words of
class and id. The words do not cut what may hold the article itself, see
``exempt``.

Parsing and scoring take time linear in the page, whatever its markup: tags are
scanned by attribute without going back, and points pass up level by level.
"""

from __future__ import annotations

import heapq
import re
from html import unescape

#: A comment, section or declaration, or the start of a tag (see ``tag_end``).
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: The rest of a tag: quotes count behind an equals sign only, and nothing is tried twice.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "frame", "keygen"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "head",
}
DROPPED = RAW | {
    "nav", "footer", "aside", "form", "button", "select", "option", "input", "fieldset", "svg", "canvas", "embed", "applet", "audio", "video", "map",
    "menu", "dialog", "head", "datalist", "progress", "meter", "search",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar", "tablist", "status"}
#: Words of class and id that mark what is not the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adslot|adbox|sponsor(?:ed|s)?|promo(?:tion|ted|s)?|banner|nav|navbar|navigation|menu|menus|breadcrumbs?|"
    r"sidebar|side|rail|aside|footer|foot|masthead|topbar|site-?header|page-?header|comments?|commentlist|comment-?(?:list|section|thread)|disqus|replies|reply|respond|discussion|"
    r"cookies?|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|"
    r"widget|widgets|pagination|pager|toolbar|tools|hidden|skip|disclaimer|outbrain|taboola|form)(?:$|[\s_-]|\d)",
    re.I,
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|page|post|story|text|blog)(?:$|[\s_-])", re.I)
#: An open tag of the key closes an open one of the values.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "thead": {"tr", "td", "th", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"},
}
#: Where an implied end tag stops looking.
SCOPE = {"ul", "ol", "dl", "table", "html", "body", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "blockquote", "td", "th", "figure"}
SPACE = re.compile("[ \\t\\n\\r\\f\\v\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "div", "section", "article", "main"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
MIN_TEXT = 25
#: Link density from which a block among kept ones is a list of links.
LINKS = 0.25


class Node:
    __slots__ = ("children", "likely", "mark", "parent", "score", "tag", "unlikely")

    def __init__(self, tag: str, parent: Node | None = None, mark: str = "", likely: int = 0, unlikely: bool = False):
        self.tag, self.parent, self.mark, self.likely, self.unlikely = tag, parent, mark, likely, unlikely
        self.children: list = []
        self.score = 0.0


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


class _Open:
    """The open elements: where blocks lie among them, and how many of a tag are open, below the nearest block or at all."""

    def __init__(self, root: Node):
        self.stack, self.block_at, self.blocks, self.inline = [root], [0], {}, [{}]

    def push(self, node: Node) -> None:
        if node.tag in BLOCK:
            self.block_at.append(len(self.stack))
            self.blocks[node.tag] = self.blocks.get(node.tag, 0) + 1
            self.inline.append({})
        else:
            self.inline[-1][node.tag] = self.inline[-1].get(node.tag, 0) + 1
        self.stack.append(node)

    def close(self, at: int) -> None:
        """Close the element at this place and all that are open in it."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            if tag in BLOCK:
                self.block_at.pop()
                self.inline.pop()
                self.blocks[tag] -= 1
            else:
                self.inline[-1][tag] -= 1

    def nearest(self, tags, stop=()) -> int:
        """Place of the nearest open block of ``tags`` before one of ``stop``; 0 if there is none."""
        if any(self.blocks.get(t) for t in tags):
            for at in reversed(self.block_at):
                if self.stack[at].tag in tags:
                    return at
                if self.stack[at].tag in stop:
                    break
        return 0

    def end(self, tag: str) -> None:
        """An end tag; an inline one does not close a block around it."""
        if tag in BLOCK:
            if at := self.nearest((tag,)):
                self.close(at)
        elif self.inline[-1].get(tag):
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self.close(at)

    def begin(self, tag: str) -> None:
        """What a start tag closes: a block ends an open paragraph, and the inline elements in it."""
        if tag in BLOCK and self.stack[self.block_at[-1]].tag == "p":
            self.close(self.block_at[-1])
        if tag not in CLOSES:
            return
        if tag in ("option", "optgroup"):
            if self.stack[-1].tag in CLOSES[tag]:
                self.close(len(self.stack) - 1)
            return
        while at := self.nearest(CLOSES[tag], SCOPE):
            self.close(at)
            if tag not in ("tr", "tbody", "thead", "tfoot") or self.stack[-1].tag not in CLOSES[tag]:
                break


class _Tags:
    """Ends of tags and of raw text in one page, each searched for in vain once at most."""

    def __init__(self, html: str):
        self.html, self.quotes, self.endless = html, True, set()

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; -1 if it never does.

        Where a quote is never closed, tags end at their first ">" from there on.
        """
        if self.quotes:
            if found := REST.match(self.html, at):
                return found.end()
            self.quotes = False
        return self.html.find(">", at) + 1 or -1

    def raw_end(self, tag: str, at: int) -> tuple[int, int]:
        """Start and end of the end tag of raw text; (-1, -1) if there is none."""
        if tag not in self.endless:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.html, at)
            if found and (end := self.html.find(">", found.end())) >= 0:
                return found.start(), end + 1
            self.endless.add(tag)
        return -1, -1


def parse(html: str) -> Node:
    """A tree of Nodes and strings; what is dropped has ``mark`` "x", what its words speak against "w"."""
    root = Node("#root")
    opened, tags = _Open(root), _Tags(html)
    stack = opened.stack
    at, n = 0, len(html)

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(unescape(piece) if "&" in piece else piece)

    while at < n:
        found = TOKEN.search(html, at)
        if not found:
            text(html[at:])
            break
        tag = found[2]
        end = tags.tag_end(found.end()) if tag else found.end()
        if end < 0:
            text(html[at:])
            break
        text(html[at : found.start()])
        at = end
        if not tag:
            if found[0].startswith("<![CDATA["):
                text(found[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "br":
                stack[-1].children.append(" ")
            else:
                opened.end(tag)
            continue
        rest = html[found.end() : end - 1]
        closed = rest.endswith("/")
        if tag in VOID:
            if tag == "hr":
                stack[-1].children.append(Node("hr", stack[-1]))
            elif tag == "br":
                stack[-1].children.append(" ")
            continue
        if tag in RAW:
            end = tags.raw_end(tag, at)[1]
            at = end if end >= 0 else at if tag == "title" else n
            continue
        opened.begin(tag)
        mark, likely, unlikely = "", 0, False
        if rest and not rest.isspace():
            own = _attributes(rest)
            words = f"{own.get('class', '')} {own.get('id', '')}"
            if own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
                mark = "x"
            elif words != " " and tag not in ("html", "body"):
                likely = 1 if LIKELY.search(words) else 0
                unlikely = bool(UNLIKELY.search(words))
                if unlikely and tag not in ("article", "main"):
                    # A name of its own that only speaks for the article outweighs the others; both together give no points.
                    mark, likely = "" if any(LIKELY.search(w) and not UNLIKELY.search(w) for w in words.split()) else "w", 0
        if tag in DROPPED:
            mark = "x"
        node = Node(tag, stack[-1], mark, likely, unlikely)
        stack[-1].children.append(node)
        if not closed or tag not in ("svg", "math"):
            opened.push(node)
    return root


def exempt(root: Node) -> None:
    """Take the mark "w" from what may hold the article, so that it is scored.

    That is a part with an article or main larger than any outside marked parts,
    or with most of the page's text if no likely part outside has a tenth of it.
    """
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting.extend(x for x in node.children if isinstance(x, Node) and x.mark != "x")
    if not any(x.mark for x in order):
        return
    # Characters of each part, of its largest article or main, and of what is outside marked parts below it.
    chars, anchor, clean = {}, {}, {}
    for node in reversed(order):
        below = [x for x in node.children if isinstance(x, Node) and x.mark != "x"]
        own = sum(len(x.strip()) for x in node.children if isinstance(x, str))
        chars[id(node)] = own + sum(chars[id(x)] for x in below)
        clean[id(node)] = own + sum(clean[id(x)] for x in below if not x.mark)
        anchor[id(node)] = max((anchor[id(x)] for x in below), default=0)
        if node.tag in ("article", "main") and not node.unlikely:
            anchor[id(node)] = chars[id(node)]
    place = {id(x): k for k, x in enumerate(order)}
    articles = likely = 0
    marked: list = []
    fresh = root
    while True:
        waiting = [fresh]
        while waiting:
            node = waiting.pop()
            if node.tag in ("article", "main") and not node.unlikely:
                articles = max(articles, clean[id(node)])
            if node.tag in ("article", "main") or node.likely or (node is fresh and node is not root):
                likely = max(likely, clean[id(node)])
            for x in node.children:
                if isinstance(x, Node) and x.mark == "w":
                    heapq.heappush(marked, (-chars[id(x)], place[id(x)], x))
                elif isinstance(x, Node) and not x.mark:
                    waiting.append(x)
        while marked:
            fresh = heapq.heappop(marked)[-1]
            if anchor[id(fresh)] > articles or (2 * chars[id(fresh)] > chars[id(root)] > 10 * likely):
                fresh.mark = ""
                break
        else:
            return


def prune(root: Node) -> None:
    """Cut dropped parts, iteratively; a page header goes unless it is the article's own."""
    exempt(root)
    waiting = [(root, False)]
    while waiting:
        node, inside = waiting.pop()
        inside = inside or node.tag in ("article", "main")
        kept = []
        for x in node.children:
            if isinstance(x, Node):
                if x.mark or (x.tag == "header" and not inside):
                    kept.append(" ")
                    continue
                waiting.append((x, inside))
            kept.append(x)
        node.children = kept


def blocks(root: Node) -> list[str]:
    """Texts of the blocks below ``root``, in page order."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        if now:
            done = SPACE.sub(" ", "".join(now)).strip(" ")
            if done:
                out.append(done)
            now.clear()

    waiting: list = [root]
    while waiting:
        x = waiting.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag in BLOCK:
            end()
            waiting.append(None)
            waiting.extend(reversed(x.children))
        else:
            waiting.extend(reversed(x.children))
    end()
    return out


def _sizes(root: Node) -> dict[int, tuple[int, int]]:
    """Characters and linked characters below each node."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting.extend(x for x in node.children if isinstance(x, Node))
    out: dict[int, tuple[int, int]] = {}
    for node in reversed(order):
        chars = linked = 0
        for x in node.children:
            if isinstance(x, Node):
                c, k = out[id(x)]
                chars, linked = chars + c, linked + k
            else:
                chars += len(x.strip())
        out[id(node)] = (chars, chars if node.tag == "a" else linked)
    return out


def _own_text(node: Node) -> str:
    """The node's text outside blocks below it."""
    out, waiting = [], list(reversed(node.children))
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in BLOCK:
            waiting.extend(reversed(x.children))
    return "".join(out)


def _whole(top: Node) -> Node:
    """The outermost article around ``top``, else the nearest main, else ``top``."""
    article = main = None
    up: Node | None = top
    while up is not None:
        if up.tag == "article":
            article = up
        elif up.tag == "main" and main is None:
            main = up
        up = up.parent
    return article or main or top


def _grouped(node: Node, scored: dict[int, Node]) -> list[Node]:
    """The block or scored children of ``node``, and each run of text and inline elements between them as one node."""
    out: list[Node] = []
    run: Node | None = None
    for x in node.children:
        if isinstance(x, Node) and (x.tag in BLOCK or id(x) in scored):
            run = None
            out.append(x)
            continue
        if run is None:
            run = Node("#text", node)
            out.append(run)
        run.children.append(x)
    return out


def worths(root: Node, density) -> list[tuple[Node, float]]:
    """Each candidate and its discounted score, outer ones before inner ones."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting.extend(x for x in node.children if isinstance(x, Node))
    # Points that reach each node from below: of paragraphs right in it, and half of what reached its children.
    reached = {id(x): 0.0 for x in order}
    scored: dict[int, Node] = {}
    for node in reversed(order):
        if node is root:
            break
        up = node.parent
        passed = reached[id(node)] / 2
        if node.tag in PARAGRAPHS:
            text = SPACE.sub(" ", _own_text(node)).strip()
            if len(text) >= MIN_TEXT:
                passed += (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - density(node))
                scored[id(up)] = up
        if id(node) in scored:
            node.score = reached[id(node)] + 25 * node.likely + (25 if node.tag in ("article", "main") else 5 if node.tag in ("div", "section") else 0)
            scored[id(up)] = up
        reached[id(up)] += passed
    return [(x, x.score * (1 - density(x))) for x in order if id(x) in scored and x is not root]


def main_container(root: Node) -> list[Node]:
    """The best-scoring container and the siblings that belong to it."""
    sizes = _sizes(root)

    def density(node: Node) -> float:
        chars, linked = sizes[id(node)]
        return linked / chars if chars else 0.0

    found = worths(root, density)
    if not found:
        return [root]
    worth = {id(x): w for x, w in found}
    scored = {id(x): x for x, _ in found}
    top = max((x for x, _ in found), key=lambda x: worth[id(x)])
    floor = max(10.0, 0.2 * worth[id(top)])
    top = _whole(top)
    if top.parent is None:
        return [top]
    group = _grouped(top.parent, scored | {id(top): top})
    alone = top.tag in ("article", "main")
    kept = []
    for x in group:
        if x.tag == "#text":
            sizes |= _sizes(x)
        use = x is top or (x.tag == "article" and top.tag == "article") or (not alone and top.tag != "body" and worth.get(id(x), 0) >= floor)
        if not use and x.tag in ("p", "#text") and not alone:
            text = SPACE.sub(" ", _own_text(x)).strip()
            use = (len(text) > 80 and density(x) < LINKS) or bool(text and density(x) == 0 and re.search(r"\.( |$)", text))
        kept.append(use or (x.tag in ("h1", "h2") and not alone))
    if not alone:
        # What lies between kept siblings belongs to them, as do headings right before one.
        first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        for k in range(first + 1, last):
            kept[k] = kept[k] or density(group[k]) < LINKS
        while first and group[first - 1].tag in HEADINGS:
            first -= 1
            kept[first] = True
    return [x for x, use in zip(group, kept, strict=True) if use]


def main_text(html: str | None) -> str:
    """The page's article: blocks joined by line breaks, empty if none."""
    root = parse(html or "")
    prune(root)
    return "\n".join(b for x in main_container(root) for b in blocks(x))
