"""Main text of HTML pages by composite text density.

A tolerant parser builds the tree (unclosed paragraphs and list items are closed by what follows; the bodies of scripts and styles are skipped; drawings, formulas
and templates are parsed and dropped, and those left open end at the first HTML block or, templates, with the element around them; no library is needed). It reads a page once:
what is nested deeper than DEPTH is put beside the element at that depth. Elements that are no article text by their kind (menus, forms, footers, scripts, hidden ones) leave first.

Every other node has a density: characters for each tag, lowered where a node's characters or tags are links, against the body's share of linked characters. Class names, ids and roles that tell of
boilerplate multiply the densities in their subtree by WEIGHT; they never remove a subtree that is dense all the same. The sum of the densities of a node's child blocks is highest for the node whose children
are the paragraphs; that subtree is the main text (markup within a line doesn't divide a text, so it isn't summed). The smallest density on its
path from the body, the body's own included, is the threshold: while blocks beside it reach that, the subtree is widened to the node above; blocks beside the path that reach it belong to the text too, with the headings right before
them, and blocks within the text that don't reach it leave if they are marked or mostly links. No element is taken for its name.
Pages are independent rows: one Arrow pass, memory bounded by a batch.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements nested deeper are put beside the one at this depth.
DEPTH = 512
#: Factor of the densities in subtrees that are marked as boilerplate.
WEIGHT = 0.1
#: Share of the body's characters for each tag that a block of unmarked text reaches, if the page's main text is to be sought there.
REACH = 0.4
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style noscript template iframe svg math object canvas audio video select textarea button title".split())
_RAW = frozenset("script style noscript iframe textarea title".split())
_FOREIGN = frozenset(("svg", "math"))
#: Elements of drawings and formulas that hold HTML.
_HTML_IN = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: HTML elements that end a drawing or formula that was left open.
_BREAKS_OUT = frozenset("article aside b big blockquote body br center code dd div dl dt em embed figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr i img li main menu nav ol p pre ruby s section small span strong strike sub sup table tt u ul var".split())
_DROPPED = frozenset("nav footer aside form menu dialog".split()) | _SKIPPED
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_CLOSES = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in _CLOSES.items()}
#: Words of class names, ids and roles that mark boilerplate.
_BOILERPLATE = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "comment comments commentlist disqus respond reply replies cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations widget toolbar pagination pager copyright disclaimer contentinfo complementary search skip".split()
)
#: Words that make a label with one of those: search-form, site-footer, post-comments.
_PARTS = frozenset(
    "form box bar list section container wrapper wrap area block blocks link links item items inner outer top bottom left right main site page global primary secondary header post posts article articles "
    "entry user users reader story content body text title col column panel region zone slot unit row group btn button buttons icon icons the js ui".split()
)
_INSIDE = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())


class _Node:
    __slots__ = ("name", "parent", "kids", "chars", "linked", "tags", "links", "dropped", "foreign", "block", "weight", "marked", "density", "sum", "depth")

    def __init__(self, name: str, parent: _Node | None, dropped: bool, marked: bool = False):
        self.name, self.parent, self.dropped, self.marked = name, parent, dropped, marked
        self.kids: list[_Node | str] = []
        self.chars = self.linked = self.tags = self.links = 0
        self.density = self.sum = 0.0
        self.block = name in _BLOCKS
        self.foreign = name in _FOREIGN or parent is not None and parent.foreign and parent.name not in _HTML_IN
        self.weight, self.depth = (WEIGHT if marked else 1.0), 0
        if parent is not None:
            self.weight *= parent.weight
            self.depth = parent.depth + 1
            parent.kids.append(self)


def _kind(name: str, more: str, inside: bool) -> tuple[bool, bool]:
    """(dropped, marked as boilerplate) for an element."""
    if name in _DROPPED or name == "header" and not inside:
        return True, False
    marked = False
    if more and name not in ("html", "body", "article", "main"):
        for key, value in _NAMED.findall(more):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return True, False
            if key in ("class", "id", "role"):
                marked |= any(map(_marks, value.split())) or value == "header" and not inside
    return False, marked


def _marks(label: str) -> bool:
    """Whether a class, id or role names boilerplate, by all of its words: search and search-form do, search-and-rescue doesn't."""
    words = [w for w in _WORDS.findall(label) if not w.isdigit()]
    return any(w in _BOILERPLATE for w in words) and all(w in _BOILERPLATE or w in _PARTS for w in words)


def _tokens(page: str):
    """(text, None, None) and (None, tag name with its slash, rest of the tag), in one pass: an unclosed quote or tag is looked for once."""
    at, text, end = 0, 0, len(page)
    last = page.rfind(">")
    open_quote = -1  # no tag before it is read with quotes
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        m = _NAME.match(page, lt + 1) if lt < last else None
        if m is None:
            comment = page.startswith("<!--", lt)
            if not comment and (lt > last or page[lt + 1] not in "!?"):
                at = lt + 1
                continue
            if lt > text:
                yield html.unescape(page[text:lt]), None, None
            if comment:
                stop = page.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
            elif page.startswith("<![CDATA[", lt) and (stop := page.find("]]>", lt)) >= 0:
                yield page[lt + 9 : stop], None, None
                at = stop + 3
            else:
                at = page.find(">", lt) + 1
            text = at
            continue
        if lt > text:
            yield html.unescape(page[text:lt]), None, None
        close = m.end()
        while lt >= open_quote and page[close] != ">":
            stop = _STOP.search(page, close)
            close = stop.start()
            if page[close] == ">":
                break
            other = page.find(page[close], close + 1)
            if other < 0 or other > last:
                open_quote = close + 1
                break
            close = other + 1
        if page[close] != ">":
            close = page.find(">", m.end())
        yield None, m[1] + m[2].lower(), page[m.end() : close]
        at = text = close + 1
        name = m[2].lower()
        if name in _RAW and not m[1]:
            skip = yield None, None, None  # the parser says whether the element is skipped
            if skip:
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = text = stop.end() if stop else end
    if text < end:
        yield html.unescape(page[text:]), None, None


def parse(page: str) -> _Node:
    """The tree of a page; text is in the kids as strings, decoded node by node, white space as in the source."""
    root = node = _Node("html", None, False)
    scopes: list[dict[str, int]] = [{}]  # open elements by name, in each article or main
    beyond: dict[str, int] = {}  # elements below DEPTH that are still open

    def leave(x: _Node) -> _Node:
        if x.name in _INSIDE:
            scopes.pop()
        scopes[-1][x.name] -= 1
        return x.parent

    def up_to(x: _Node) -> _Node:
        """Close all elements within x."""
        nonlocal node
        while node is not x:
            node = leave(node)
        return node

    tokens = _tokens(page)
    reply = None
    while True:
        try:
            data, name, more = tokens.send(reply)
        except StopIteration:
            return root
        reply = None
        if data is not None:
            node.kids.append(data)
            continue
        if name is None:
            reply = raw
            # the generator goes on from the skipped element; its next item comes with this reply
            continue
        raw = False
        if name[0] == "/":
            name = name[1:]
            if beyond.get(name):
                beyond[name] -= 1
                continue
            free = name in ("html", "body", "main", "article")
            if not (any(s.get(name) for s in scopes) if free else scopes[-1].get(name)) and node.name != name:
                continue
            up = node
            while up is not None and up.name != name:
                up = up.parent
            if up is not None and up.parent is not None:
                up_to(up)
                node = leave(node)
            continue
        if name in _BREAKS_OUT and node.name not in _HTML_IN:
            while node.foreign and node.name not in _HTML_IN:
                node = leave(node)
        if name in ("html", "body", "head"):
            if name == "body":
                up_to(root)
                beyond.clear()
                node = _Node("body", node, False)
                scopes[-1]["body"] = scopes[-1].get("body", 0) + 1
            continue
        if name in _BLOCKS and scopes[-1].get("p"):
            up = node
            while up is not None and up.name not in ("p", "td", "th", "li", "div", "article", "body", "html", "section", "blockquote", "button"):
                up = up.parent
            if up is not None and up.name == "p":
                up_to(up)
                node = leave(node)
        if name in _CLOSES:
            closed, scope = _CLOSES[name]
            up, last = node, None
            while up is not None and up.name not in scope:
                if up.name in closed:
                    last = up
                up = up.parent
            if last is not None and up is not None:
                up_to(last)
                node = leave(node)
        new = _Node(name, node, *_kind(name, more, len(scopes) > 1))
        closed = more.endswith("/")
        raw = name in _RAW and not (closed and new.foreign)
        if raw or name in _VOID or closed:
            continue
        if new.depth > DEPTH:
            node.kids.pop()
            beyond[name] = beyond.get(name, 0) + 1
            continue
        node = new
        scopes[-1][name] = scopes[-1].get(name, 0) + 1
        if name in _INSIDE:
            scopes.append({})


def _kids(x: _Node) -> list[_Node]:
    return [k for k in x.kids if isinstance(k, _Node) and not k.dropped]


def _measure(node: _Node) -> list[_Node]:
    """Characters, linked characters, tags, links, density and sum of each node that isn't dropped; iterative, for deep pages. The nodes."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += _kids(x)
    for x in reversed(order):
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(" ".join(k.split()))
            elif not k.dropped:
                x.chars += k.chars
                x.linked += k.linked
                x.tags += k.tags + 1
                x.links += k.links + (k.name == "a")
                x.block |= k.block
        if x.name == "a":
            x.linked = x.chars
    body = order[0]
    share = body.linked / body.chars if body.chars else 0.0
    for x in order:
        x.density = _density(x.chars, x.linked, x.tags, x.links, share)
    for x in order:
        x.sum = sum(k.density * k.weight for k in _kids(x) if k.block and k.name != "body")
    return order


def _density(chars: int, linked: int, tags: int, links: int, share: float) -> float:
    """Characters for each tag, link-adjusted: linked characters and link tags lower it, the more so the fewer links the body has."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - linked, 1) * linked + share * chars + math.e)
    return chars / max(tags, 1) * math.log(chars / max(linked, 1) * max(tags, 1) / max(links, 1) + 1) / base


def _reaches(node: _Node, least: float, weight: float) -> bool:
    return not node.dropped and node.chars > 0 and node.density * node.weight / weight >= least and node.linked * 2 < node.chars


def _best(nodes: list[_Node]) -> _Node:
    """The subtree of maximum density sum among the unmarked; among all, if no unmarked block in it has REACH of the body's characters for each tag."""
    body = next((x for x in reversed(nodes) if x.name == "body"), nodes[0])
    rate = lambda x: x.chars / max(x.tags, 1)
    counted = lambda x: [(k.density, rate(k)) for k in _kids(x) if k.block and k.weight == 1.0 and k.linked * 2 < k.chars and k.name != "body" and _own(k)]
    free = [(counted(x), x) for x in nodes if x.weight == 1.0 and x.linked * 2 < x.chars]
    found = max((f for f in free if f[0]), key=lambda f: (sum(d for d, _ in f[0]), f[1].chars), default=None)
    return found[1] if found is not None and max(r for _, r in found[0]) >= REACH * rate(body) else max(nodes, key=lambda x: (x.sum, x.chars))


def _own(node: _Node) -> bool:
    """Whether some text in it is in no marked subtree."""
    todo = [node]
    while todo:
        x = todo.pop()
        if any(isinstance(k, str) and not k.isspace() for k in x.kids):
            return True
        todo += [k for k in _kids(x) if k.weight == 1.0]
    return False


def _select(nodes: list[_Node]) -> tuple[list[_Node], float]:
    """(the main text's subtrees in page order, the threshold)."""
    root = nodes[0]
    best = _best(nodes)
    body = next((x for x in reversed(nodes) if x.name == "body"), root)
    path = _path(best, body)
    if path is None:  # the text is outside the body
        body, path = root, _path(best, root)
    if best.sum == 0.0 or not path:
        plain = _Node("", None, False)
        plain.kids = [k for k in body.kids if isinstance(k, str) or not (k.block and k.links > 1 and k.linked * 2 > k.chars)]
        plain.weight = body.weight
        return [plain if best.sum else body], body.density
    least = min(x.density for x in [*path, body])
    on, start = set(map(id, path)), best
    for x in path[1:]:
        if any(isinstance(k, str) and not k.isspace() or isinstance(k, _Node) and id(k) not in on and k.block and _reaches(k, least, best.weight) for k in x.kids):
            start = x
    todo = [start]
    while todo:  # lists of links between the blocks
        for k in _kids(todo.pop()):
            if k.block and k.links > 1 and k.linked * 2 > k.chars and k.density < least:
                k.dropped = True
            else:
                todo.append(k)
    return _beside(start, body, least), least


def _path(node: _Node, body: _Node) -> list[_Node] | None:
    """node and the nodes above it, below the body; None if it is outside."""
    out = []
    while node is not None and node is not body:
        out.append(node)
        node = node.parent
    return out if node is body else None


def _beside(start: _Node, body: _Node, least: float) -> list[_Node]:
    """start and all blocks beside its path from the body that reach the path's threshold, in page order."""
    path = _path(start, body)
    share = body.linked / body.chars
    out = [start]
    for k, above in enumerate([*path[1:], body]):
        before: list[_Node] = []
        after: list[_Node] = []
        side, heads = before, []
        for x in above.kids:
            if x is path[k]:
                before += heads
                side, heads = after, []
            elif isinstance(x, str):
                n = len(" ".join(x.split()))
                if n and _density(n, 0, 0, 0, share) >= least:
                    text = _Node("", None, False)
                    text.kids.append(x)
                    side += [*heads, text]
                heads = heads if not n else []
            elif _reaches(x, least, start.weight):
                side += [*heads, x]
                heads = []
            elif x.name in _HEADINGS and not x.dropped and not x.marked:
                heads.append(x)
            elif x.chars and not x.dropped:
                heads = []
        out = [*before, *out, *after]
    return out


def _text(node: _Node, least: float) -> str:
    """Blocks in page order, each with white space made one space, joined by one space; without marked subtrees under the threshold."""
    parts: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.dropped and (x is node or not x.marked or x.density * x.weight / node.weight >= least):
            gap = x.name in _BLOCKS or x.name == "br"
            if gap:
                parts.append("\n")
                todo.append("\n")
            todo += reversed(x.kids)
    return " ".join("".join(parts).split())


def main_text(page: str | None) -> str:
    """The main text of one page; empty if there is none."""
    if not page:
        return ""
    chosen, least = _select(_measure(parse(page)))
    return " ".join(t for t in (_text(x, least) for x in chosen) if t)


def _run(batches):
    for b in batches:
        out = [main_text(x) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def html_extraction(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null or empty html, and pages without main text: empty text, 0. Character references are decoded as browsers do (those cut off too);
    all white space, no-break spaces included, counts as white space. Ids and urls may be null or repeat. Other columns are ignored. No
    rows: no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(spark.read.parquet(f"{sf_dir}/pages.parquet"))
