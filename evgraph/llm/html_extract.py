"""Main text of web pages by wrapper induction.

The wrapper of a host is learned from all its pages: simple tree matching pairs the nodes of each page's
tree with those of a reference page. Groups of pages are counted each by itself, and the counts of a host's groups
are added up. A node that holds the same text on most pages is template; a slot's text varies. The region in which most of the varying text lies is where the content is,
unless a page marks its article. Every page of the host is then aligned with the reference, and gives the text of
its nodes that lie in the region and are not template. Element types that never hold content (navigation,
forms, scripts) are left out at once; words in class, id and role count only for boxes that hold no article.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.llm.common import HOT_SHARE, materialize, read_table, row_hash

#: Different pages of a group, at least if a host has more than one; fewer, but LEAST_PAGES, if they have more characters.
GROUP_PAGES, GROUP_CHARS, LEAST_PAGES = 512, 16 << 20, 24
GROUP_SEED = 11
#: Surveys of groups that one task joins.
JOINED = 64
#: Copies of a page that are given out at once; pages with more may be common ones.
COPIES = 64
#: A node is template if its text is the same on so many pages and on such a share of them.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.6
#: Pages are near-equal if their whole texts, or their texts without what is common, share so many shingles of 3 words.
NEAR_EQUAL, NEAR_REST = 0.95, 0.5
#: Pages are of like structure if they share so many paths; a page with fewer of a wrapper's paths than LEAST_LAYOUT is on its own.
LIKE_LAYOUT, LEAST_LAYOUT = 0.6, 0.3
#: The region is the smallest box with such a share of the varying text; marked articles count if they hold at least MARKED_SHARE.
REGION_SHARE, MARKED_SHARE = 0.7, 0.2
#: Trees are aligned to this depth and with tables of so many cells in all; what lies beyond stays content of the node above.
MATCH_DEPTH, MATCH_CELLS = 100, 60_000
#: Columns of a table of sets at once.
FEATURES = 1 << 14

# The element types of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset(
    "head nav footer aside form script style noscript template iframe object embed svg canvas audio video button select "
    "textarea input label fieldset dialog menu title noembed noframes xmp map".split()
)
#: An element's end tag may be missing; these start tags imply it.
CLOSED_BY = {
    "p": BLOCK - {"br", "body", "html", "head", "option", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
#: Words that mark a box which isn't content, as the last word of a class, id or role without words for boxes; not after a modifier.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner promo promotion promoted sponsor sponsored sidebar sidebars "
    "menu menubar nav navbar navigation breadcrumb breadcrumbs topbar header masthead footer foot cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments "
    "commentlist respond reply replies disqus related recommended pagination pager toolbar widget widgets search "
    "copyright legal disclaimer complementary contentinfo".split()
)
BOXES = frozenset(
    "area bar block body bottom box button buttons card col column container content group holder inner item items left link links list "
    "outer panel posts right row section slot text top unit wrap wrapper zone".split()
)
#: Of these words, the ones that mark adverts and comments wherever they stand; inside an article the others need a second sign.
SURE_MARKS = frozenset(
    "ad ads adv advert advertisement adsense banner promo promoted sponsored comment comments commentlist disqus respond replies".split()
)
MODIFIERS = frozenset("can has hide is no not show with without".split())
#: Element types that words can mark; paragraphs, headings and the like never go for a word.
MARKED_TAGS = frozenset("article center div dl details figure iframe ins ol section span table ul".split())
REGION_TAGS = frozenset("#root html body article center div main section table tbody td tr form".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    marks: tuple = ()
    hidden: bool = False
    parts: list = field(default_factory=list)
    """Nodes and strings in page order."""
    size: int = 1
    shape: int = 0
    """Number of its structure; nodes of equal structure have equal numbers."""
    digest: int = 0
    """Hash of its tags and all its text, 0 without any text."""
    holds: bool = False
    """Whether it is or holds an article or a main part; those in marked boxes count if there are no others."""
    within: bool = False
    """Whether it lies below an article or a main part."""
    linked: bool = False
    """Whether more than half of its text is in links."""

    def children(self) -> list[Node]:
        return [x for x in self.parts if type(x) is not str]


_shapes: dict = {}


def preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        if node.parts:
            stack.extend([x for x in reversed(node.parts) if type(x) is not str])
    return out


def measured(root: Node) -> Node:
    """The tree with ``size``, ``shape``, ``digest`` and ``holds`` set anew."""
    for node in reversed(preorder(root)):
        size, shape, texts, holds = 1, [node.tag], [node.tag], node.tag in ("article", "main")
        for x in node.parts:
            if type(x) is str:
                texts.append(x.strip())
            else:
                size += x.size
                shape.append(x.shape)
                texts.append(x.digest)
                holds = holds or x.holds
        node.size, node.holds = size, holds
        node.shape = _shapes.setdefault(tuple(shape), len(_shapes))
        node.digest = hash(tuple(texts)) if any(texts[1:]) else 0
    return root


def _attributes(node: Node, source: str) -> None:
    words: list[str] = []
    for name, *values in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name in ("class", "id", "role"):
            words += "".join(values).lower().split()
        elif name == "hidden" or (name == "aria-hidden" and "".join(values).lower() == "true"):
            node.hidden = True
    node.marks = tuple(words)


def parse(source: str) -> Node:
    """A lenient tree of a page; what is open at the end is closed there. Time grows with the length of the page."""
    root = Node("#root")
    stack, opened, at, length = [root], Counter(), 0, len(source)
    text_from, quoted, last_close = 0, True, source.rfind(">")

    def cut(i: int) -> None:
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    while (at := source.find("<", at)) >= 0:
        begin, after = at, source[at + 1 : at + 2]
        ending = after == "/"
        if after in ("!", "?") and after:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                at = end + 3 if end >= 0 else length
            elif source.startswith("<![CDATA[", at) and (end := source.find("]]>", at)) >= 0:
                at = end + 3
            elif at < last_close:
                at = source.find(">", at) + 1
            else:
                break
            name = None
        else:
            name = _NAME.match(source, at + 1 + ending)
            if not name or at > last_close:
                at += 1
                continue
            rest = _REST.match(source, name.end()) if quoted else None
            if quoted and not rest:
                quoted = False  # a quote is left open: from here on tags end at the next bracket
            close = rest.end() if rest else source.find(">", name.end()) + 1
            if not close:
                at += 1
                continue
            attributes, at = source[name.end() : close - 1], close
        if begin > text_from:
            stack[-1].parts.append(source[text_from:begin])
        text_from = at
        if not name:
            continue
        tag = name[0].lower()
        if ending:
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if stack[i].tag in ("td", "th", "table", "article") and tag not in BLOCK:
                        break
            elif tag == "p":
                stack[-1].parts.append(Node("p"))
            continue
        if tag in BLOCK:
            # formatting left open inside a paragraph does not keep it open
            i = len(stack) - 1
            while i > 0 and stack[i].tag not in CLOSED_BY and stack[i].tag not in BLOCK:
                i -= 1
            if i > 0 and tag in CLOSED_BY.get(stack[i].tag, ()):
                cut(i)
        node = Node(tag)
        if attributes and not attributes.isspace():
            _attributes(node, attributes)
        stack[-1].parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if tag in ("title", "textarea"):
                node.parts.append(source[at : close.start() if close else length])
            text_from = at = close.end() if close else length
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if length > text_from:
        stack[-1].parts.append(source[text_from:])
    return root


def prune(root: Node) -> Node:
    """The tree without elements that never are content. A form or header that holds the article stays."""
    for node in reversed(preorder(root)):
        node.holds = node.tag in ("article", "main") or any([k.holds for k in node.children()])
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        parts: list = []
        for x in node.parts:
            if not isinstance(x, str):
                never = x.tag in NEVER or (x.tag == "header" and not inside)
                if x.hidden or (never and not (x.holds and x.tag in ("form", "fieldset", "header"))):
                    x = " " if x.tag in BLOCK else ""
                else:
                    stack.append((x, inside))
            parts.append(x)
        node.parts = parts
    measured(root)
    if root.holds:
        nodes = preorder(root)
        for node in nodes:
            node.holds = False
        if not _hold(root, nodes):
            measured(root)
        _note_inner(nodes)
    return root


def _note_inner(nodes: list[Node]) -> None:
    """Set ``within`` and ``linked`` of the nodes of a tree, given in page order."""
    for node in nodes:
        below = node.within or node.tag in ("article", "main")
        for kid in node.children():
            kid.within = below
    letters: dict[int, tuple[int, int]] = {}
    for node in reversed(nodes):
        kids = [letters[id(k)] for k in node.children()]
        text = len(_own_text(node)) + sum(t for t, _ in kids)
        in_links = text if node.tag == "a" else sum(a for _, a in kids)
        letters[id(node)] = text, in_links
        node.linked = 2 * in_links > text


def _hold(root: Node, nodes: list[Node]) -> bool:
    """Set ``holds`` for what lies around articles outside marked boxes."""
    found = {id(x) for x in outermost(root, lambda n: n.tag in ("article", "main"))}
    for node in reversed(nodes):
        node.holds = id(node) in found or any(k.holds for k in node.children())
    return root.holds


def is_mark(token: str, known: frozenset = MARKS) -> bool:
    words = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
    if not words or words[0] in MODIFIERS:
        return False
    while len(words) > 1 and words[-1] in BOXES:
        words.pop()
    return words[-1] in known


def is_marked_box(node: Node, inside: bool, constant: set[int] = frozenset()) -> bool:
    """Whether words of a box tell that it isn't content; a box that holds an article never is, nor a header inside one.

    Below an article or main part, words for adverts and comments suffice; boxes with other words go only if they
    are ``constant`` (of template alone) or links for the greater part.
    """
    if not node.marks or node.tag not in MARKED_TAGS or (node.holds and node.tag != "article"):
        return False
    known = MARKS if not node.within or node.linked or id(node) in constant else SURE_MARKS
    return any(is_mark(t, known) and not (inside and ("header" in t or "masthead" in t)) for t in node.marks)


def outermost(root: Node, test) -> list[Node]:
    """The nodes in page order that pass a test, without what lies below them or in marked boxes."""
    out, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        if is_marked_box(node, inside):
            continue
        if test(node):
            out.append(node)
        else:
            inside = inside or node.tag in ("article", "main")
            stack.extend((x, inside) for x in reversed(node.children()))
    return out


def marked_parts(root: Node) -> list[Node]:
    """The nodes that a page marks as its article, else as its main part."""
    return outermost(root, lambda n: n.tag == "article") or outermost(root, lambda n: n.tag == "main" or "main" in n.marks)


def blocks(roots: list[Node], gone: set[int] = frozenset(), constant: set[int] = frozenset()) -> list[str]:
    """Text of each block in page order, white space as one space, trimmed; empty ones, marked boxes and nodes that are gone left out.

    ``constant`` are nodes that hold nothing but template.
    """
    out, run = [], []

    def close() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [*reversed(roots)]
    top = {id(r) for r in roots}
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            run.append(part)
        elif part is None:
            close()
        else:
            if part.tag in BLOCK or id(part) in top:
                close()
                stack.append(None)
            if id(part) in top or not is_marked_box(part, True, constant):
                silent = id(part) in gone
                stack.extend("" if silent and isinstance(x, str) else x for x in reversed(part.parts))
    close()
    return out


def match_trees(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest order-preserving pairing of equal tags, top down.

    Children that are equal with all their text, and alone so in both lists, are paired first: the longest chain of them that is in one
    order, in n log n, however long the lists. Between two of these, children of equal structure at both ends are paired directly, which
    loses nothing; the table of the dynamic programme covers the rest. Beyond MATCH_CELLS cells of such tables in all, that rest is paired
    in one pass in order of the tags. Nodes below MATCH_DEPTH are not paired.
    """
    weights: dict[tuple[int, int], int] = {}
    cells = 0

    def ends(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
        n, head, tail = min(len(xs), len(ys)), 0, 0
        while head < n and xs[head].shape == ys[head].shape:
            head += 1
        while tail < n - head and xs[-1 - tail].shape == ys[-1 - tail].shape:
            tail += 1
        return head, tail

    def table(xs: list[Node], ys: list[Node], depth: int) -> list[list[int]] | None:
        nonlocal cells
        cells += len(xs) * len(ys)
        if cells > MATCH_CELLS:
            return None
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            above, row = rows[-1], [0]
            for j, y in enumerate(ys):
                best = above[j + 1] if above[j + 1] > row[j] else row[j]
                if x.tag == y.tag and (w := above[j] + weight(x, y, depth)) > best:
                    best = w
                row.append(best)
            rows.append(row)
        return rows

    def weight(x: Node, y: Node, depth: int) -> int:
        if x.shape == y.shape:
            return x.size
        if x.size == 1 or y.size == 1 or depth >= MATCH_DEPTH:
            return 1
        key = (id(x), id(y))
        if key not in weights:
            xs, ys = x.children(), y.children()
            head, tail = ends(xs, ys)
            rows = table(xs[head : len(xs) - tail], ys[head : len(ys) - tail], depth + 1)
            pairs = sum(k.size for k in xs[:head]) + sum(k.size for k in xs[len(xs) - tail :])
            weights[key] = 1 + pairs + (rows[-1][-1] if rows else 0)
        return weights[key]

    def between(xs: list[Node], ys: list[Node], depth: int) -> list[tuple[Node, Node]]:
        rows = table(xs, ys, depth)
        out, i, j = [], len(xs), len(ys)
        if rows is None:
            j = 0
            for x in xs:
                k = next((k for k in range(j, min(j + 8, len(ys))) if ys[k].tag == x.tag), None)
                if k is not None:
                    out.append((x, ys[k]))
                    j = k + 1
            return out
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
        return out

    def anchors(xs: list[Node], ys: list[Node]) -> list[tuple[int, int]]:
        """Places of the equal children to be paired, in order."""
        if not ({x.digest for x in xs} & {y.digest for y in ys}) - {0}:
            return []
        seen_x, seen_y = Counter(x.digest for x in xs), Counter(y.digest for y in ys)
        place = {y.digest: j for j, y in enumerate(ys) if y.digest and seen_y[y.digest] == 1}
        ends_at: list[int] = []  # least last place of a chain of each length
        last: list[int] = []  # the candidate that gives it
        found: list[tuple[int, int, int]] = []
        for i, x in enumerate(xs):
            j = place.get(x.digest)
            if j is not None and seen_x[x.digest] == 1:
                k = bisect_left(ends_at, j)
                ends_at[k : k + 1], last[k : k + 1] = [j], [len(found)]
                found.append((i, j, last[k - 1] if k else -1))
        chain, at = [], last[-1] if last else -1
        while at >= 0:
            i, j, at = found[at]
            chain.append((i, j))
        return chain[::-1]

    pairs: list[tuple[Node, Node]] = []
    stack = [(a, b, 0)] if a.tag == b.tag else []
    while stack:
        x, y, depth = stack.pop()
        pairs.append((x, y))
        xs, ys = x.children(), y.children()
        if not xs or not ys or depth >= MATCH_DEPTH:
            continue
        i = j = 0
        for at, to in [*anchors(xs, ys), (len(xs), len(ys))]:
            p, q = xs[i:at], ys[j:to]
            head, tail = ends(p, q)
            found = [*zip(p[:head], q[:head]), *zip(p[len(p) - tail :], q[len(q) - tail :]), *zip(xs[at : at + 1], ys[to : to + 1])]
            if head + tail < min(len(p), len(q)):
                found += between(p[head : len(p) - tail], q[head : len(q) - tail], depth + 1)
            stack.extend((*pair, depth + 1) for pair in found)
            i, j = at + 1, to + 1
    return pairs


def _constant(root: Node, template: set[int]) -> set[int]:
    """The marked boxes inside articles and main parts whose texts are all among the nodes that are ``template``."""
    nodes = preorder(root)
    if not any(n.within and n.marks for n in nodes):
        return set()
    varied: set[int] = set()
    for node in reversed(nodes):
        if (_own_text(node) and id(node) not in template) or any(id(k) in varied for k in node.children()):
            varied.add(id(node))
    return {id(n) for n in nodes if n.within and n.marks and id(n) not in varied}


def _own_text(node: Node) -> str:
    return " ".join("".join(x for x in node.parts if isinstance(x, str)).split())


def _shingles(blocks_: list[str]) -> np.ndarray:
    """Hashes of all runs of three words, each once."""
    words = " ".join(blocks_).split()
    if len(words) < 3:
        return np.array([hash(tuple(words))])
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    return np.unique((hashes[:-2] * 3 + hashes[1:-1]) * 5 + hashes[2:])


def _overlaps(sets: list) -> np.ndarray:
    """Jaccard similarity of each two sets, given as arrays or sets of numbers; 1 for two empty ones."""
    sizes = np.array([len(s) for s in sets])
    _, at, seen = np.unique(np.concatenate([np.fromiter(s, np.int64, len(s)) for s in sets]), return_inverse=True, return_counts=True)
    shared_ones = seen[at] > 1
    row, at = np.repeat(np.arange(len(sets)), sizes)[shared_ones], (np.cumsum(seen > 1) - 1)[at[shared_ones]]
    shared = np.zeros((len(sets), len(sets)))
    for low in range(0, int(at.max(initial=-1)) + 1, FEATURES):  # features by blocks, so that memory is bounded
        here = (at >= low) & (at < low + FEATURES)
        table = np.zeros((len(sets), int(at[here].max()) - low + 1), np.float32)
        table[row[here], at[here] - low] = 1
        shared += table @ table.T
    np.fill_diagonal(shared, sizes)
    return np.where((union := sizes[:, None] + sizes - shared) > 0, shared / np.maximum(union, 1), 1.0)


def _near(sets: list[np.ndarray], share: float) -> np.ndarray:
    """Whether each two sets have ``share`` in common; only sets that hold so much of what others hold are compared."""
    left, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    while len(left):
        _, at, seen = np.unique(np.concatenate([sets[i] for i in left]), return_inverse=True, return_counts=True)
        elsewhere = np.add.reduceat((seen[at] > 1).astype(np.int64), np.r_[0, np.cumsum(sizes[left])[:-1]])
        kept = left[elsewhere >= share * sizes[left]]
        if len(kept) == len(left):
            break
        left = kept
    near = np.eye(len(sets), dtype=bool)
    if len(left):
        near[np.ix_(left, left)] |= _overlaps([sets[i] for i in left]) >= share
    return near


def _clusters(near: np.ndarray) -> np.ndarray:
    """For each row the smallest row that can be reached by links."""
    root = np.arange(len(near))
    while True:
        low = np.where(near, root, len(near)).min(axis=1)
        if (low == root).all():
            return root
        root = low


def _paths(root: Node) -> frozenset:
    """Tags and marks (those without numbers) on the way from the root to each node."""
    out, stack = set(), [(root, 0)]
    while stack:
        node, above = stack.pop()
        here = hash((above, node.tag, *(m for m in node.marks if m.isalpha())))
        out.add(here)
        stack.extend((x, here) for x in node.children())
    return frozenset(out)


@dataclass
class Evidence:
    """What pages tell of the nodes of a reference tree, in page order.

    ``pages`` are counted, near-equal ones once in a group; ``differ`` is how many of them surely differ: those of one group, or the references of several.
    ``texts`` is the commonest text of a node, ``counts`` the pages that have it there, and ``most`` how many of these surely differ. ``mass`` is the length of all text that lies there outside links and marked boxes, ``same`` that
    of the commonest text.
    """

    reference: Node
    pages: int
    differ: int
    texts: list[str]
    counts: list[int]
    most: list[int]
    same: list[int]
    mass: list[int]


@dataclass
class Wrapper:
    """What pages of one structure share: a reference tree, its nodes that are template with their text, and its regions."""

    reference: Node
    paths: frozenset
    template: dict[int, str]
    regions: set[int]


def _near_copies(texts: list[list[str]]) -> np.ndarray:
    """For the blocks of each page the first page that it is nearly equal to, itself if there is none before it."""
    least = max(TEMPLATE_PAGES, TEMPLATE_SHARE * len(texts))
    common = {x for x, n in Counter(x for text in texts for x in set(text)).items() if n >= least}
    near = _near([_shingles([x for x in text if x not in common]) for text in texts], NEAR_REST)
    return _clusters(near | _near([_shingles(t) for t in texts], NEAR_EQUAL) if common else near)


def observe(trees: list[Node], texts: list[list[str]]) -> Evidence:
    """The evidence of a group of pages with their blocks, whose texts differ; the largest is the reference."""
    reference = max(trees, key=lambda t: t.size)
    place = {id(x): i for i, x in enumerate(preorder(reference))}
    copies = _near_copies(texts).tolist()
    holders: list[dict[str, set[int]]] = [{} for _ in place]
    landed: list[Counter] = [Counter() for _ in place]
    mass = [0] * len(place)
    for tree, copy in zip(trees, copies):
        ours_of = {id(theirs): place[id(ours)] for ours, theirs in match_trees(reference, tree)}
        stack = [(tree, 0, False, True)]
        while stack:
            node, at, inside, counted = stack.pop()
            own = ours_of.get(id(node))
            at = at if own is None else own
            counted = counted and node.tag != "a" and not is_marked_box(node, inside)
            if text := _own_text(node):
                if counted:
                    mass[at] += len(text)
                if own is not None:
                    holders[own].setdefault(text, set()).add(copy)
                    landed[own][text] += len(text) * counted
            inside = inside or node.tag in ("article", "main")
            stack.extend((x, at, inside, counted) for x in node.children())
    found = [max(((len(pages), text) for text, pages in of.items()), default=(0, "")) for of in holders]
    counts, pages = [n for n, _ in found], len(set(copies))
    return Evidence(reference, pages, pages, [t for _, t in found], counts, counts, [c[t] for c, (_, t) in zip(landed, found)], mass)


def merged(found: list[Evidence]) -> Evidence:
    """The evidence of several groups of pages, on the largest of their references."""
    if len(found) == 1:
        return found[0]
    reference = max((e.reference for e in found), key=lambda t: t.size)
    place = {id(x): i for i, x in enumerate(preorder(reference))}
    texts: list[dict[str, tuple[int, int, int]]] = [{} for _ in place]
    holders: list[dict[str, set[int]]] = [{} for _ in place]
    mass = [0] * len(place)
    copies = _near_copies([blocks([e.reference]) for e in found]).tolist()
    for e, copy in zip(found, copies):
        ours_of = {id(theirs): place[id(ours)] for ours, theirs in match_trees(reference, e.reference)}
        stack, i = [(e.reference, 0)], 0
        while stack:
            node, at = stack.pop()
            own = ours_of.get(id(node))
            at = at if own is None else own
            mass[at] += e.mass[i]
            if own is not None and e.texts[i]:
                n, most, same = texts[own].get(e.texts[i], (0, 0, 0))
                references = holders[own].setdefault(e.texts[i], set())
                references.add(copy)
                texts[own][e.texts[i]] = n + e.counts[i], max(most, e.most[i], len(references)), same + e.same[i]
            stack.extend((x, at) for x in reversed(node.children()))
            i += 1
    best = [max(((*of[t], t) for t in of), default=(0, 0, 0, "")) for of in texts]
    counts, most, same, commonest = map(list, zip(*best))
    differ = max(len(set(copies)), *(e.differ for e in found))
    return Evidence(reference, sum(e.pages for e in found), differ, commonest, counts, most, same, mass)


def wrapper_of(e: Evidence) -> Wrapper:
    """Template is what most of the pages have, TEMPLATE_PAGES of them that surely differ."""
    nodes, least = preorder(e.reference), TEMPLATE_SHARE * e.pages
    is_template = [n >= least and most >= TEMPLATE_PAGES for n, most in zip(e.counts, e.most)]
    template = {id(node): text for node, text, yes in zip(nodes, e.texts, is_template) if yes}
    mass = {id(node): m - same * yes for node, m, same, yes in zip(nodes, e.mass, e.same, is_template)}
    return Wrapper(e.reference, _paths(e.reference), template, {id(x) for x in _regions(e.reference, nodes, mass, e.differ)})


def _regions(reference: Node, nodes: list[Node], mass: dict[int, int], pages: int) -> list[Node]:
    """Where the varying text of the pages lies on the reference, given its amount for each node."""
    for node in reversed(nodes):
        mass[id(node)] += sum(mass[id(k)] for k in node.children())
    total, marked = mass[id(reference)], marked_parts(reference)
    if marked and (pages < TEMPLATE_PAGES or sum(mass[id(m)] for m in marked) >= MARKED_SHARE * total):
        return [m for m in marked if mass[id(m)]] or marked
    if pages < TEMPLATE_PAGES or not total:
        return [reference]
    node = reference
    while (inner := next((k for k in node.children() if k.tag in REGION_TAGS and mass[id(k)] >= REGION_SHARE * total), None)) is not None:
        node = inner
    # a heading before the region belongs to it, if it varies
    place = {id(x): i for i, x in enumerate(nodes)}
    titles = [x for x in outermost(reference, lambda n: n.tag == "h1") if mass[id(x)] and place[id(x)] < place[id(node)]]
    return [*titles, node]


def survey(trees: list[Node]) -> list[Evidence]:
    """Evidence of all pages of a group together, then that of each structure among them if there are several."""
    alike: dict[tuple, Node] = {}
    for tree in trees:
        alike.setdefault(tuple(blocks([tree])), tree)
    found = [_paths(tree) for tree in alike.values()]
    seen = Counter(x for s in found for x in s)
    kept = [frozenset(x for x in s if seen[x] >= TEMPLATE_PAGES) for s in found]
    number = {s: i for i, s in enumerate(dict.fromkeys(kept))}
    roots = _clusters(_overlaps([*number]) >= LIKE_LAYOUT)
    groups: dict[int, list[tuple]] = {}
    for page, s in zip(((tree, [*text]) for text, tree in alike.items()), kept):
        groups.setdefault(int(roots[number[s]]), []).append(page)
    layouts = [*groups.values()] if len(groups) > 1 else []
    return [observe(*map(list, zip(*pages))) for pages in ([*zip(alike.values(), map(list, alike))], *layouts)]


def join_surveys(surveys: list[list[Evidence]]) -> list[Evidence]:
    """One survey of the pages of all groups. A structure shares enough paths with the first of its kind; kinds of TEMPLATE_PAGES are kept."""
    kinds: list[tuple[frozenset, list[Evidence]]] = []
    for e in (e for found in surveys for e in found[1:] or found):
        paths = _paths(e.reference)
        kind = next((k for k in kinds if len(k[0] & paths) >= LIKE_LAYOUT * len(k[0] | paths)), None)
        if kind is None:
            kinds.append(kind := (paths, []))
        kind[1].append(e)
    layouts = [merged(k) for _, k in kinds] if len(kinds) > 1 else []
    return [merged([found[0] for found in surveys]), *(e for e in layouts if e.pages >= TEMPLATE_PAGES)]


class HostWrapper:
    """Learned from the pages of a host: one wrapper for all of them, and one for each structure among them."""

    def __init__(self, found: list[Evidence]):
        self.whole, *layouts = map(wrapper_of, found)
        self.layouts = layouts or [self.whole]

    def main_text(self, tree: Node) -> str:
        paths = _paths(tree)
        own = max(self.layouts, key=lambda w: len(w.paths & paths) / len(w.paths | paths))
        if len(own.paths & paths) < LEAST_LAYOUT * len(paths):
            own = wrapper_of(observe([tree], [blocks([tree])]))
        gone, roots = set(), []
        for wrapper in {id(self.whole): self.whole, id(own): own}.values():
            for ours, theirs in match_trees(wrapper.reference, tree):
                if wrapper.template and wrapper.template.get(id(ours)) == _own_text(theirs):
                    gone.add(id(theirs))
                if wrapper is own and id(ours) in wrapper.regions:
                    roots.append(theirs)
        marked = marked_parts(tree)
        if marked and not any(r.tag in REGION_TAGS and r.tag != "article" and not r.holds for r in roots):
            # the page's own marks, without marked parts that are template from end to end
            varying = [m for m in marked if any(_own_text(x) and id(x) not in gone for x in preorder(m))]
            roots = varying or marked
        chosen = {id(r) for r in roots} or {id(tree)}
        roots = outermost(tree, lambda n: id(n) in chosen) or [tree]
        constant = _constant(tree, gone)
        own_marks = {id(m) for m in marked}
        if all(r.tag == "article" or id(r) in own_marks for r in roots):
            gone = frozenset()
        return " ".join(blocks(roots, gone, constant) or ([] if marked else blocks([tree], gone, constant)))


def tree_of(source: str | None) -> Node:
    return prune(parse(source or ""))


def main_texts(pages: list[str | None]) -> list[str]:
    """Main text of each page of one host, with the wrapper of all of them. Of a marked article or main part
    nothing is template but boxes whose words mark them too."""
    trees = [tree_of(source) for source in pages]
    wrapper = HostWrapper(survey(trees)) if trees else None
    return [wrapper.main_text(tree) for tree in trees]


TEXTS = "page_id long, url string, common boolean, page long, host string, text string"
COUNTED = "pages long, differ long, texts array<string>, counts array<long>, most array<long>, same array<long>, mass array<long>"
SURVEY = f"host string, number long, place int, html string, {COUNTED}"
_NUMBERS = pa.list_(pa.int64())
_SURVEY = pa.schema(
    [("host", pa.string()), ("number", pa.int64()), ("place", pa.int32()), ("html", pa.string()), ("pages", pa.int64()), ("differ", pa.int64()),
     ("texts", pa.list_(pa.string())), ("counts", _NUMBERS), ("most", _NUMBERS), ("same", _NUMBERS), ("mass", _NUMBERS)]
)


def _different(pages: pa.Table) -> list[str | None]:
    """The different pages of a group, in an order that follows from them."""
    found = dict(zip(pages["html"].to_pylist(), pages["page"].to_pylist()))
    return sorted(found, key=lambda source: (found[source], source or ""))


def _survey_rows(host: str, number: int, found: list[Evidence], sources: dict[int, str]) -> pa.Table:
    rows = [
        {"host": host, "number": number, "place": i, "html": sources[id(e.reference)], "pages": e.pages, "differ": e.differ, "texts": e.texts,
         "counts": e.counts, "most": e.most, "same": e.same, "mass": e.mass}
        for i, e in enumerate(found)
    ]
    return pa.Table.from_pylist(rows, _SURVEY)


def _surveys(rows: pa.Table) -> tuple[list[list[Evidence]], dict[int, str]]:
    """The surveys in rows, in order of their groups, and the sources of their references."""
    out: dict[int, list[Evidence]] = {}
    sources = {}
    for r in sorted(rows.to_pylist(), key=lambda r: (r["number"], r["place"])):
        tree = tree_of(r["html"])
        sources[id(tree)] = r["html"]
        out.setdefault(r["number"], []).append(Evidence(tree, *(r[c] for c in ("pages", "differ", "texts", "counts", "most", "same", "mass"))))
    return [*out.values()], sources


def _survey_group(key: tuple, pages: pa.Table) -> pa.Table:
    """A group of a host with several => its survey, in which a text that stands on one page only of many is left out."""
    if pages["groups"][0].as_py() == 1:
        return _SURVEY.empty_table()
    _shapes.clear()
    sources = _different(pages)
    trees = [tree_of(source) for source in sources]
    found = survey(trees)
    for e in found:
        e.texts = [t if n > 1 or e.pages <= TEMPLATE_PAGES else "" for t, n in zip(e.texts, e.counts)]
    return _survey_rows(key[0].as_py(), key[1].as_py(), found, {id(t): s or "" for t, s in zip(trees, sources)})


def _join_groups(key: tuple, rows: pa.Table) -> pa.Table:
    """The surveys of JOINED groups of a host => one."""
    _shapes.clear()
    surveys, sources = _surveys(rows)
    return _survey_rows(key[0].as_py(), key[1].as_py(), join_surveys(surveys), sources)


def _extract(key: tuple, pages: pa.Table, rows: pa.Table) -> pa.Table:
    """A group of pages, and its host's survey unless it is the only group => ids, hash and text of each page.

    Equal pages are extracted once.
    """
    _shapes.clear()
    sources = _different(pages)
    if rows.num_rows:
        wrapper = HostWrapper(_surveys(rows)[0][0])
        texts = {source: wrapper.main_text(tree_of(source)) for source in sources}
    else:
        trees = [tree_of(source) for source in sources]
        wrapper = HostWrapper(survey(trees)) if trees else None
        texts = {source: wrapper.main_text(tree) for source, tree in zip(sources, trees)}
    found = pa.array([texts[source] for source in pages["html"].to_pylist()], pa.string())
    return pages.select(["page_id", "url", "common", "page", "host"]).append_column("text", found)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` => one row per page: ``page_id``, ``url`` and ``text``.

    A host's wrapper is learned from all its different pages, and applied to all. Those of a large host are dealt by a seeded hash into
    groups of GROUP_PAGES or more; each group counts its pages against a reference of its own, the counts of JOINED groups, then of JOINED of
    these and so on, are added up, and each group gets the host's wrapper. So a host of any size spreads over tasks and the result depends on the rows alone. Near-equal pages are
    counted once in a group. Copies of a page are extracted once; a page that holds at
    least one row in HOT_SHARE stands in its group once, and its rows get their text by a join. A null page or one without content
    has the empty text; null urls are a host of their own. Repeated rows are extracted each for itself. Extra columns are
    ignored, and an empty table gives an empty result.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    place = F.xxhash64(F.lit(GROUP_SEED), row_hash("html"))
    keyed = pages.select(host.alias("host"), place.alias("page"), "html", F.col("page_id").cast("long").alias("page_id"), "url")
    count = F.count(F.lit(1))
    copies = keyed.groupBy("host", "page").agg(count.alias("n"), F.max(F.coalesce(F.length("html"), F.lit(0))).alias("chars"))
    copies = materialize(copies, "page-copies")
    by_size = F.greatest(count / GROUP_PAGES, F.least(F.sum("chars") / GROUP_CHARS, count / LEAST_PAGES))
    hosts = copies.groupBy("host").agg(F.floor(by_size).alias("groups")).where("groups > 1")
    hosts = materialize(hosts, "large-hosts")
    total = copies.agg(F.sum("n")).first()[0] or 0
    # at most HOT_SHARE pages, whatever the input
    common = copies.where((F.col("n") > COPIES) & (F.col("n") * HOT_SHARE >= total)).select("host", "page")
    common = materialize(common.withColumn("common", F.lit(True)), "common-pages")
    some = not common.isEmpty()
    nobody = {"page_id": F.lit(None).cast("long"), "url": F.lit(None).cast("string")}
    if some:
        once = keyed.join(F.broadcast(common), ["host", "page"]).groupBy("host", "page", "common").agg(F.first("html").alias("html"))
        rest = keyed.join(F.broadcast(common), ["host", "page"], "left_anti").withColumn("common", F.lit(False))
        dealt = rest.unionByName(once.withColumns(nobody))
    else:
        dealt = keyed.withColumn("common", F.lit(False))
    groups = F.coalesce("groups", F.lit(1).cast("long"))
    dealt = dealt.join(hosts, "host", "left").withColumns({"groups": groups, "number": F.pmod("page", groups)})
    # read twice, by the surveys and the extraction, but shuffled once
    dealt = dealt.select("host", "number", "groups", "page", "html", "page_id", "url", "common").repartition("host", "number").groupBy("host", "number")
    of_hosts, left = dealt.applyInArrow(_survey_group, SURVEY), hosts.agg(F.max("groups")).first()[0] or 0
    while left > 1:
        block = F.floor(F.col("number") / JOINED).alias("block")
        of_hosts, left = of_hosts.groupBy("host", block).applyInArrow(_join_groups, SURVEY), -(-left // JOINED)
    of_hosts = of_hosts.drop("number")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("number")
    lent = of_hosts.join(hosts, "host").select("host", numbers, *[c for c in of_hosts.columns if c != "host"])
    found = dealt.cogroup(lent.groupBy("host", "number")).applyInArrow(_extract, TEXTS)
    if not some:
        return found.select("page_id", "url", "text")
    found = materialize(found, "page-texts")
    of_common = keyed.select("host", "page", "page_id", "url").join(found.where("common").select("host", "page", "text"), ["host", "page"])
    return found.where("NOT common").select("page_id", "url", "text").unionByName(of_common.select("page_id", "url", "text"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(read_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
