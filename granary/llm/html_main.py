"""Main-text extraction from web pages by wrapper inference (operator 5).

A page is a tree of block elements with texts in them. Each page gives a union-free regular expression over its blocks: runs of
equal sibling groups become a repeated group. The expressions of a host are aligned one after the other: groups that both
have are merged, groups that one lacks become optional, and neighbours that come to be equal become a repeated group. Texts are
aligned by their place, the path of labels that leads to them: a text that LITERAL of the host's pages (LEAST_PAGES at least, equal
pages counted once) have at the same place is a literal of the template and no content; at all other places there are slots. Both are grouped
aggregates. The expressions of equal shape are merged once, and hosts are merged in two streaming levels, so a host with a
third of all pages neither meets in one task nor is gathered.

The host's wrapper says where the article is: the outermost article elements, else main ones; without such, from the page down
the container that holds DOMINANT of the text of all slots (links do not count), as long as there is one; where two hold about as much,
words of their names decide. The slots below it give the page's text, without the template's literals, if neither markup nor a name
declares that it is the article (in a declared one, what pages share is a part of their articles), and without elements that by
their name, role or whole class say that they are menus, footers, notices, adverts, forms, comments and the like. A page on which
the wrapper's path is missing is read by the same rules on its own. All nodes on the path give text, in the order of the page, at
any depth; the expressions themselves are cut at LEVELS levels, below which all text counts to the last.

Edge cases: null and empty html give the empty text; a null url is the host of no name; markup that is not closed or nested
wrongly is closed as browsers do; repeated rows are extracted each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow
from .exact_dedup import attach

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^>"']++|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*>?|<[!?/][^>]*>?|[^<]+|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr caption ul video audio object canvas svg button label noscript iframe template script style textarea title".split())
#: An opening tag of the key ends an open element of the values, up to the nearest element of SCOPE.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"caption"}, "body": {"head"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html", "td", "th", "blockquote", "nav", "aside", "form", "select"}
CLOSES_P = BLOCK - {"option", "optgroup", "button", "label", "script", "style", "template", "noscript", "html", "head", "body", "svg", "object", "canvas", "audio", "video", "iframe", "title", "textarea", "select"}
DROPPED = set("nav header footer aside form script style noscript template iframe svg button select textarea dialog head title object canvas menu search audio video optgroup option fieldset legend label".split())
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
#: A class or id is dropped if one of its words is of the first set and all others are of one of both.
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer header masthead cookie cookies consent notice notices gdpr newsletter subscribe subscription signup share sharing social comment comments disqus replies reply "
    "discussion related recommended recommendations popup modal overlay login search widget widgets toolbar pager pagination copyright alert toast paywall".split()
)
FILLING_WORDS = set("slot box list bar block wrapper wrap container section area unit post posts article articles page site blog main entry content links link buttons button top bottom left right inner outer form item items row col column group panel body thread count title text js id the".split())
ARTICLE_WORDS = set("article content post entry story main articlebody".split())
CONTAINERS = {"#page", "html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td", "details", "figure", "li", "ul", "ol", "dl", "dd"}
#: A text is a literal on so many pages and this share of the host's; a container is entered with this share of the slots' text.
LEAST_PAGES, LITERAL, DOMINANT, TIE = 4, 0.5, 0.5, 0.8
#: Levels of an expression; groups of a node, beyond which there is one repeated group for each label; cells of an alignment table.
LEVELS, MOST_GROUPS, CELLS = 150, 64, 250_000
WORD = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"([a-z])([A-Z])")


def place(parent: int, label: str) -> int:
    """Hash of a path of labels."""
    return xxhash.xxh64_intdigest(label, parent & 0xFFFFFFFFFFFFFFFF)


def says_dropped(names: list[list[str]]) -> bool:
    return any(DROPPED_WORDS.intersection(n) and all(w in DROPPED_WORDS or w in FILLING_WORDS or w.isdigit() for w in n) for n in names)


class Node:
    """A block element: its label is its name and its classes and id without numbers; parts are texts and nodes in order, and 1 and 0 where
    a link begins and ends."""

    __slots__ = ("at", "dropped", "label", "name", "parts")

    def __init__(self, name: str, attributes: dict[str, str], parent: int = 0, inside: bool = False):
        self.name = name
        self.parts: list = []
        self.dropped = name in DROPPED and not (name == "header" and inside)
        self.label = name
        if attributes:
            names = [WORD.findall(CAMEL.sub(r"\1 \2", t).lower()) for t in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
            role = attributes.get("role", "").lower()
            hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            self.dropped |= role in DROPPED_ROLES or hidden or says_dropped(names)
            words = {"-".join(n) for n in names if n and not any(w.isdigit() for w in n)}
            if role == "main" or attributes.get("itemprop", "").lower() == "articlebody":
                words.add("articlebody")
            if words:
                self.label = ".".join([name, *sorted(words)[:4]])
        if self.dropped:
            self.label += ".-"
        self.at = place(parent, self.label)


def attributes_of(tag: str) -> dict[str, str]:
    body = tag[NAME.match(tag).end() :].rstrip("/>")
    return {k.lower(): entities.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(body)} if "=" in body or body.strip() else {}


def parse(source: str) -> Node:
    """The tree of a page. Inline elements leave their text where it stands; <br> is a space."""
    root = Node("#page", {})
    stack = [root]
    count: dict[str, int] = {}

    def close(i: int) -> None:
        for n in stack[i:]:
            count[n.name] -= 1
        del stack[i:]

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.match(source, at)
        token = m.group()
        at = m.end()
        if token[0] != "<" or len(token) < 2:
            stack[-1].parts.append(token)
            continue
        found = NAME.match(token)
        if not found:
            continue
        name = found.group(1).lower()
        if token[1] == "/":
            if name == "a":
                stack[-1].parts.append(0)
            elif name in BLOCK and count.get(name):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        close(i)
                        break
                    if name == "p" and stack[i].name in SCOPE:
                        break
            continue
        if name in RAW:
            ended = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
            at = ended.end() if ended else end
            continue
        if name == "br":
            stack[-1].parts.append(" ")
        elif name == "a":
            stack[-1].parts.append(1)
        if name not in BLOCK:
            continue
        if name in CLOSES_P and count.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in SCOPE:
                    break
        ends = ENDS.get(name)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends:
                    close(i)
                elif stack[i].name in SCOPE:
                    break
        node = Node(name, attributes_of(token), stack[-1].at, bool(count.get("article") or count.get("main")))
        stack[-1].parts.append(node)
        if name not in VOID:
            stack.append(node)
            count[name] = count.get(name, 0) + 1
    return root


# A wrapper is [label, has a text slot, groups]; a group is [least, most, wrappers], least 0 or 1, most 1 or 2 (many).


def key(group: list) -> tuple:
    return tuple(w[0] for w in group[2])


def merged(a: list, b: list) -> list:
    """The wrapper that holds for both."""
    left, right = a[2], b[2]
    if [key(g) for g in left] == [key(g) for g in right]:
        groups = [[min(g[0], h[0]), max(g[1], h[1]), [merged(x, y) for x, y in zip(g[2], h[2], strict=True)]] for g, h in zip(left, right, strict=True)]
        return [a[0], a[1] or b[1], groups]
    n, m = len(left), len(right)
    kl, kr = [key(g) for g in left], [key(g) for g in right]
    if n * m > CELLS:
        return [a[0], a[1] or b[1], loosened(left + right)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if kl[i] == kr[j] else max(best[i + 1][j], best[i][j + 1])
    groups, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and kl[i] == kr[j]:
            groups.append([min(left[i][0], right[j][0]), max(left[i][1], right[j][1]), [merged(x, y) for x, y in zip(left[i][2], right[j][2], strict=True)]])
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            groups.append([0, *left[i][1:]])
            i += 1
        else:
            groups.append([0, *right[j][1:]])
            j += 1
    groups = repeated(groups)
    return [a[0], a[1] or b[1], loosened(groups) if len(groups) > MOST_GROUPS else groups]


def loosened(groups: list) -> list:
    """One optional repeated group for each label, which holds for any order of them: bounds a wrapper by its labels."""
    held: dict[str, list] = {}
    for w in (w for g in groups for w in g[2]):
        held[w[0]] = merged(held[w[0]], w) if w[0] in held else w
    return [[0, 2, [w]] for w in held.values()]


def repeated(groups: list) -> list:
    """Equal neighbours, alone or in rows of up to six groups, become repeated groups."""
    for width in range(1, 7):
        if len(groups) < 2 * width:
            break
        keys = [key(g) for g in groups]
        if not any(x == y for x, y in zip(keys, keys[width:], strict=False)):
            continue
        out: list = []
        i = 0
        while i < len(groups):
            row = groups[i : i + width]
            rows = [row]
            labels = [key(g) for g in row]
            while len(row) == width and [key(g) for g in groups[i + width * len(rows) : i + width * (len(rows) + 1)]] == labels:
                rows.append(groups[i + width * len(rows) : i + width * (len(rows) + 1)])
            if len(rows) > 1 and (width == 1 or all(g[:2] == [1, 1] for r in rows for g in r)):
                wrappers = [w for g in rows[0] for w in g[2]]
                for r in rows[1:]:
                    wrappers = [merged(x, y) for x, y in zip(wrappers, (w for g in r for w in g[2]), strict=True)]
                out.append([max(g[0] for r in rows for g in r) if width == 1 else 1, 2, wrappers])
                i += width * len(rows)
            else:
                out.append(groups[i])
                i += 1
        groups = out
    return groups


def wrapper_of(node: Node, levels: int = LEVELS) -> list:
    own = any(isinstance(p, str) and not p.isspace() for p in node.parts)
    if node.dropped or not levels:
        return [node.label, True, []]
    groups = repeated([[1, 1, [wrapper_of(p, levels - 1)]] for p in node.parts if isinstance(p, Node)])
    return [node.label, own, loosened(groups) if len(groups) > MOST_GROUPS else groups]


def expression(w: list) -> str:
    """A wrapper as text: <label ... >, # for a text slot, ( )? ( )+ ( )* for groups."""
    mark = {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}
    inner = "".join(("(" + "".join(map(expression, g[2])) + ")" + mark[g[0], g[1]]) if g[:2] != [1, 1] or len(g[2]) > 1 else expression(g[2][0]) for g in w[2])
    return f"<{w[0]}{' #' if w[1] else ''}{' ' + inner if inner else ''}>"


def rank(label: str) -> int:
    """How surely markup says that a label is the article's: 2 an article, 1 the main part, 0 not."""
    name, *words = label.split(".")
    return 0 if "-" in words else 2 if name == "article" else 1 if name == "main" or "articlebody" in words else 0


def article_path(w: list, mass: dict[int, int]) -> list[str]:
    """The labels from the page down to the article; mass: characters in slots by place."""
    best, queue = (0, []), [(w, [w[0]])]
    while queue:
        node, path = queue.pop(0)
        if rank(node[0]) > best[0]:
            best = (rank(node[0]), path)
        if not node[0].endswith(".-"):
            queue += [(c, [*path, c[0]]) for g in node[2] for c in g[2]]
    return best[1] or dominant_path(w, mass)


def dominant_path(w: list, mass: dict[int, int]) -> list[str]:
    path, nodes, at = [w[0]], [w], place(0, w[0])
    while True:
        children: dict[str, list[list]] = {}
        for c in (c for n in nodes for g in n[2] for c in g[2]):
            children.setdefault(c[0], []).append(c)
        held = {label: total_mass(c, place(at, label), mass) for label, c in children.items() if not label.endswith(".-")}
        whole = mass.get(at, 0) + sum(held.values())
        enter = {k: v for k, v in held.items() if k.split(".")[0] in CONTAINERS and v >= DOMINANT * whole > 0}
        near = [k for k, v in held.items() if enter and k.split(".")[0] in CONTAINERS and v >= TIE * max(enter.values())]
        if not near:
            return path
        label = max(near, key=lambda k: (any(ARTICLE_WORDS.intersection(x.split("-")) for x in k.split(".")[1:]), held[k]))
        path.append(label)
        nodes, at = children[label], place(at, label)


def total_mass(nodes: list[list], at: int, mass: dict[int, int]) -> int:
    """Characters in slots of nodes of one label and all below them that is not dropped."""
    children: dict[str, list[list]] = {}
    for c in (c for n in nodes for g in n[2] for c in g[2] if not c[0].endswith(".-")):
        children.setdefault(c[0], []).append(c)
    return mass.get(at, 0) + sum(total_mass(c, place(at, label), mass) for label, c in children.items())


def declared(path: list[str]) -> bool:
    """Whether markup or a name says that this is the article: what all pages have in it is then a part of it."""
    return bool(path) and (rank(path[-1]) > 0 or any(ARTICLE_WORDS.intersection(x.split("-")) for x in path[-1].split(".")[1:]))


def along(root: Node, path: list[str]) -> list[Node]:
    found = [root]
    for label in path[1:]:
        found = [p for n in found for p in n.parts if isinstance(p, Node) and p.label == label]
    return found if path else []


def blocks(node: Node) -> Iterator[tuple[int, str, int]]:
    """Place, text and characters outside links of each block of text that is not dropped, in order; at any depth."""
    stack, held, linked, plain = [(node, iter(node.parts))], [], 0, 0

    def text() -> str:
        nonlocal plain
        out = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        return out

    while stack:
        top, parts = stack[-1]
        for p in parts:
            if isinstance(p, str):
                held.append(p)
                plain += 0 if linked else len(p)
            elif isinstance(p, int):
                linked = p
            else:
                if t := text():
                    yield top.at, t, min(plain, len(t))
                plain = 0
                if not p.dropped:
                    stack.append((p, iter(p.parts)))
                    break
        else:
            if t := text():
                yield top.at, t, min(plain, len(t))
            plain = linked = 0
            stack.pop()


def token(at: int, text: str) -> int:
    """A text at a place."""
    return signed(xxhash.xxh64_intdigest(text, at))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masses(root: Node) -> dict[int, int]:
    out: dict[int, int] = {}
    for at, _, plain in blocks(root):
        out[at] = out.get(at, 0) + plain
    return out


def main_text(source: str | None, path: list[str], literals: Iterable[int] = ()) -> str:
    root = parse(source or "")
    found = along(root, path)
    if not found:
        path = article_path(wrapper_of(root), masses(root))
        found = along(root, path) or [root]
    literals = frozenset() if declared(path) else frozenset(literals)
    return "\n".join(t for n in found for at, t, _ in blocks(n) if not literals or token(at, t) not in literals)


def with_host(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)))


PAGE = "host string, page long, wrapper string, tokens array<long>, places array<long>, chars array<int>"


def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its expression, and its distinct texts: token, place and characters outside links."""
    for b in batches:
        rows = []
        for h, source in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True):
            root = parse(source)
            own: dict[int, tuple[int, int]] = {}
            for at, t, plain in blocks(root):
                own.setdefault(token(at, t), (signed(at), plain))
            key = xxhash.xxh64_intdigest(np.array(list(own), dtype=np.int64).tobytes())
            rows.append((h, signed(key), json.dumps(wrapper_of(root), separators=(",", ":")), list(own), [p for p, _ in own.values()], [n for _, n in own.values()]))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["host", "page", "wrapper", "tokens", "places", "chars"])


def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of rows sorted by host; holds one wrapper at a time."""
    host = held = None
    for b in batches:
        for h, w in zip(b["host"].to_pylist(), b["wrapper"].to_pylist(), strict=True):
            if h != host:
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(held, separators=(",", ":"))])], ["host", "wrapper"])
                host, held = h, json.loads(w)
            else:
                held = merged(held, json.loads(w))
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(held, separators=(",", ":"))])], ["host", "wrapper"])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), mass (characters in slots by place), literals (tokens of the template) of every host."""
    found = cut(in_arrow(with_host(pages).select("host", "html"), shapes, PAGE), "shapes")
    distinct = found.select("host", "wrapper").distinct()
    parts = distinct.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(64)))
    parts = in_arrow(parts.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").select("host", "wrapper"), merging, "host string, wrapper string")
    merged_hosts = in_arrow(parts.repartition("host").sortWithinPartitions("host", "wrapper"), merging, "host string, wrapper string")
    # Equal pages are one; what they say is said once.
    once = found.groupBy("host", "page").agg(*(F.first(c).alias(c) for c in ("tokens", "places", "chars")))
    said = once.select("host", F.explode(F.arrays_zip("tokens", "places", "chars")).alias("x"))
    said = cut(said.groupBy("host", F.col("x.tokens").alias("token")).agg(F.first("x.places").alias("place"), F.sum("x.chars").alias("chars"), F.count("*").alias("n")), "texts")
    pages_of = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    literal = said.where(F.col("n") >= LEAST_PAGES).join(pages_of, "host").where(F.col("n") >= LITERAL * F.col("pages")).select("host", "token", "place", "chars")
    # A page of average size has at most so many of them as it has texts, times 1 / LITERAL.
    literals = literal.groupBy("host").agg(F.collect_list("token").alias("literals"))
    mass = said.groupBy("host", "place").agg(F.sum("chars").alias("chars")).unionByName(literal.select("host", "place", (-F.col("chars")).alias("chars")))
    mass = mass.groupBy("host", "place").agg(F.sum("chars").alias("chars")).where("chars > 0")
    mass = mass.groupBy("host").agg(F.collect_list("place").alias("places"), F.collect_list("chars").alias("chars"))
    return merged_hosts.join(mass, "host", "left").join(literals, "host", "left").join(pages_of, "host")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, places, chars in zip(b["wrapper"].to_pylist(), b["places"].to_pylist(), b["chars"].to_pylist(), strict=True):
                mass = {p & 0xFFFFFFFFFFFFFFFF: n for p, n in zip(places or [], chars or [], strict=True)}
                out.append(article_path(json.loads(w), mass))
            yield pa.RecordBatch.from_arrays([b["host"], pa.array(out, pa.list_(pa.string())), b["literals"], b["pages"]], ["host", "path", "literals", "pages"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(s, p or [], x or []) for s, p, x in zip(b["html"].to_pylist(), b["path"].to_pylist(), b["literals"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(got, pa.string())], ["page_id", "url", "text"])

    hosts = cut(in_arrow(wrappers(pages), paths, "host string, path array<string>, literals array<long>, pages long"), "wrappers")
    rows = attach(with_host(pages), hosts, "host", "pages", "left").select("page_id", "url", "html", "path", "literals")
    return in_arrow(rows, texts, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
