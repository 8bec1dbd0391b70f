"""Main-text extraction by consensus host paths.

Pass one parses each page, scores its containers by the text of their blocks less
the text of links, and names the best one by its generalised path: tags and sorted
classes from the body down, digits as '#'. Spark counts the votes of a host's pages
for each path. Pass two extracts again: from the containers on the host's most voted
path that the page has, or from its own best container where no winner occurs.

Names of classes make an element a suspect. One whose whole name says what it is
(comments, cookie notice, sidebar) goes whatever its size, as long as any text is left;
so do doubtful ones beside an article or main element that is no suspect itself. Other
suspects are left out of a container while the rest of it still holds a tenth of their
text, so a doubtful name never empties the element that holds the article; where the name
only speaks of something else in part (a list of tags), most of the text has to be links
besides. An article or main element is never dropped with a suspect around it, unless
another one stands outside. Elements that are no part of any article by their tag
(navigation, footers, asides, scripts, buttons) or that are hidden always go.

Parsing takes time and memory in proportion to the page, whatever its depth: elements
know their parent and carry a 64-bit hash of their path. Null, empty and text-only pages,
unclosed tags, quotes and comments, and pages without a host (a null or odd URL) are all
handled; an empty result is the empty string. Repeated rows are extracted alike and vote
once each. Hosts that hold a third of all pages are counted by partial aggregation and
joined by broadcast below a checked size, else by a join whose large side Spark can split.
"""
from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, map_arrow, staged

#: Share of a host's pages whose vote a path needs.
WIN_SHARE = 0.2
#: Share of a suspect's text that the rest of its container has to hold.
REST_SHARE = 0.1
#: What a kept suspect's text counts for, and the share of the best container's score that makes its like part of the text.
SUSPECT_WEIGHT, ALIKE_SHARE = 0.2, 0.15
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
CLASS = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CLASS_ONLY = re.compile(r"""(?:^|[\s"'])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
DROPPED = frozenset("nav footer aside button dialog menu canvas audio video map".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul aside dialog caption".split())
CONTAINER = frozenset("body article main section div td center".split())
PARAGRAPH_ENDS = CONTAINER | frozenset("ul ol table th li blockquote".split())
LISTS = frozenset("ul ol dl menu table".split())
ITEMS = {"li": "li", "dt": "dd", "dd": "dd", "td": "td", "th": "td", "tr": "tr"}
#: Words of class, id and role values that mark what is not the article.
UNWANTED = frozenset("ad ads advert adverts advertisement sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs header footer sidebar side aside cookie cookies consent notice banner popup modal comment comments respond disqus form login signup subscribe newsletter share sharing social related recommended widget masthead toolbar pagination pager tags skip reply replies complementary contentinfo".split())
#: Those of them that mark a part whatever general word follows.
SURE = frozenset("reply replies ad ads advert adverts advertisement sponsor sponsored promo share sharing social related recommended nav navbar navigation breadcrumb breadcrumbs sidebar cookie cookies consent comment comments disqus newsletter pagination pager popup modal login signup subscribe masthead".split())
GENERAL = frozenset("list box wrap wrapper container area block section bar item items inner outer panel group holder row column link links module unit slot zone thread".split())
#: Words that turn a name into a statement about something else, and ends of names of the article itself.
TURNED = frozenset("with no has have without not non hide is show".split())
WANTED = frozenset("content article body text story main prose".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WEAK, STRONG, CERTAIN = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "order", "name", "key", "block", "box", "cage", "paragraph", "items", "inside", "linked", "dropped", "suspect", "doubted", "text", "links", "score")

    def __init__(self, tag: str, parent: Node | None, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.text = self.links = self.suspect = 0
        self.score = 0.0


@lru_cache(4096)
def parts_of(token: str) -> tuple[str, ...]:
    """Words of a name in lower case; a compound of a sure and a general word (commentlist) is two."""
    out = []
    for p in PARTS.findall(token):
        p = p.lower()
        cut = next((k for k in range(2, len(p) - 1) if p[:k] in SURE and p[k:] in GENERAL), 0) if p not in UNWANTED else 0
        out += [p[:cut], p[cut:]] if cut else [p]
    return tuple(out)


def suspicion(names: str) -> int:
    """How surely the words of class, id and role values mark something other than the article."""
    level = wanted = 0
    for token in names.split():
        parts = parts_of(token)
        if not parts or not TURNED.isdisjoint(parts):
            continue
        if parts[0] in SURE and all(p in UNWANTED or p in GENERAL or p in WANTED for p in parts):
            level = CERTAIN
            continue
        wanted |= parts[-1] in WANTED
        if UNWANTED.isdisjoint(parts):
            continue
        whole = all(p in UNWANTED or p in GENERAL for p in parts)
        level = max(level, (CERTAIN if whole and not SURE.isdisjoint(parts) else STRONG if parts[-1] in UNWANTED else WEAK))
    return min(level, WEAK) if wanted else level


def judge(node: Node, attributes: str) -> None:
    """Set whether an element is left out, or a suspect; the header of an article is kept, for its title."""
    tag, header = node.tag, node.tag == "header" and node.parent.inside
    node.dropped = node.parent.dropped or tag in DROPPED or bool(attributes) and HIDDEN.search(attributes) is not None
    if tag == "main" or header:
        return
    if tag in ("form", "header"):
        node.suspect = STRONG
    elif attributes and (found := CLASS.findall(attributes)):
        node.suspect = suspicion(" ".join([a or b or c for a, b, c in found]))
        if tag == "article" and node.suspect < CERTAIN:
            node.suspect = 0


def element(tag: str, attributes: str, parent: Node, order: int, depth: int) -> Node:
    node = Node(tag, parent, order)
    node.inside = parent.inside or tag in ("article", "main")
    judge(node, attributes)
    node.doubted = parent.doubted or node.suspect >= STRONG
    node.cage = parent if parent.suspect else parent.cage
    block = tag in BLOCK
    node.block, node.box = node if block else parent.block, node if tag in CONTAINER else parent.box
    node.linked = tag == "a" or parent.linked and not block
    node.paragraph = depth if tag == "p" else -1 if tag in PARAGRAPH_ENDS else parent.paragraph
    if tag in LISTS:
        node.items = {}
    elif tag in ITEMS:
        node.items = {k: v for k, v in parent.items.items() if tag != "tr" or k != "td"} | {ITEMS[tag]: depth}
    else:
        node.items = parent.items
    if block:
        c = CLASS_ONLY.search(attributes) if attributes else None
        names = ".".join(sorted((c[1] or c[2] or c[3] or "").lower().split())) if c else ""
        node.name = f"{tag}.{re.sub('[0-9]+', '#', names).replace('>', '_')}" if names else tag
        node.key = xxhash.xxh3_64_intdigest(node.name, parent.key)
    else:
        node.name, node.key = "", parent.key
    return node


@lru_cache(4096)
def key_of(path: str) -> int:
    key = 0
    for name in path.split(">"):
        key = xxhash.xxh3_64_intdigest(name, key)
    return key


def path_of(node: Node) -> str:
    names = []
    while node is not None:
        if node.name:
            names.append(node.name)
        node = node.parent
    return ">".join(reversed(names))


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Elements in page order, and the text blocks that are kept: holder, text and characters of links."""
    root = Node("body", None, 0)
    root.name, root.key = "body", key_of("body")
    root.block = root.box = root.cage = root
    root.paragraph, root.items, root.inside, root.linked, root.dropped, root.doubted = -1, {}, False, False, False, False
    nodes, stack, blocks, parts, opened = [root], [root], [], [], Counter()
    in_links, low, quoted = 0, None, True
    at, n, last = 0, len(html), html.rfind(">")

    def flush():
        nonlocal in_links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append((stack[-1].block, text, min(in_links, len(text))))
        in_links = 0

    def close(k):
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def put(i, j):
        nonlocal in_links
        if j > i and not stack[-1].dropped:
            parts.append(html[i:j])
            if stack[-1].linked:
                in_links += j - i

    start = 0
    while True:
        found = html.find("<", at)
        if found < 0 or found > last:  # no tag closes any more; an open comment runs to the end
            comment = html.find("<!--", found) if found >= 0 else -1
            put(start, n if comment < 0 else comment)
            break
        mark = html[found + 1 : found + 2]
        if mark == "!" or mark == "?":
            put(start, found)
            if html.startswith("<!--", found):
                end = html.find("-->", found + 4)
                start = at = n if end < 0 else end + 3
            else:
                start = at = html.find(">", found) + 1
            continue
        m = TAG.match(html, found) if quoted else BARE_TAG.match(html, found)
        if not m and quoted and BARE_TAG.match(html, found):
            # No tag from here on closes outside its quotes: from now on they count for nothing.
            quoted, m = False, BARE_TAG.match(html, found)
        if not m:
            at = found + 1
            continue
        put(start, found)
        start = at = m.end()
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                if any(x.tag in BLOCK for x in stack[k:]):
                    flush()
                close(k)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                if low is None:
                    low = html.lower()
                    if len(low) != n:  # a letter whose lower case is longer
                        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in html)
                end = low.find(f"</{tag}", at)
                start = at = n if end < 0 else end  # the end tag itself closes nothing
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag == "br":
            if not stack[-1].dropped:
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if (k := stack[-1].paragraph) > 0:
                close(k)
            if tag in ITEMS and (k := stack[-1].items.get(ITEMS[tag], 0)) > 0:
                close(k)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        node = element(tag, attributes, stack[-1], len(nodes), len(stack))
        nodes.append(node)
        stack.append(node)
        opened[tag] += 1
    flush()
    for holder, text, links in blocks:
        holder.text += len(text)
        holder.links += links
    for node in reversed(nodes[1:]):
        node.parent.text += node.text
        node.parent.links += node.links
    return nodes, blocks


def left_out(nodes: list[Node], tops: set[int]) -> list[bool]:
    """Which elements are outside the containers `tops` or go with a suspect inside them."""
    inside, out = [False] * len(nodes), [True] * len(nodes)
    held = defaultdict(list)
    top_of: list[int] = [0] * len(nodes)
    for x in nodes:
        k = x.order
        if k in tops:
            inside[k], top_of[k] = True, k
        elif k:
            inside[k], top_of[k] = inside[x.parent.order], top_of[x.parent.order]
            if inside[k] and x.suspect and x.text:
                held[x.cage.order if x.cage.suspect and inside[x.cage.order] and x.cage.order not in tops else top_of[k]].append(k)
    # An article that no suspect holds stands for the page; without one, what holds an article stays.
    articles = [x for x in nodes if x.tag in ("article", "main") and x.suspect < CERTAIN and x.text and not x.dropped and inside[x.order]]
    sound, holders = any(not x.doubted for x in articles), set()
    if not sound:
        for x in articles:
            while x is not None and x.order not in holders:
                holders.add(x.order)
                x = x.parent
    gone, todo = set(), list(tops)
    while todo:
        cage = todo.pop()
        rest = nodes[cage].text
        for k in sorted(held[cage], key=lambda k: (nodes[k].suspect != CERTAIN, nodes[k].text)):
            x = nodes[k]
            sure = x.suspect == CERTAIN or x.suspect == STRONG and sound and not x.inside
            doubtful = x.suspect == STRONG or 2 * x.links > x.text
            if k not in holders and (sure and rest > x.text or doubtful and rest - x.text >= REST_SHARE * x.text):
                gone.add(k)
                rest -= x.text
            else:
                todo.append(k)
    for x in nodes:
        k = x.order
        out[k] = not inside[k] or k in gone or k not in tops and out[x.parent.order]
    return out


def best_container(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> Node:
    """The container with the highest score: text of its own blocks, half of that of containers inside it.

    Where its like beside it hold text too, as sections do, what holds them all is the container.
    """
    out = left_out(nodes, {0})
    weight = [1.0] * len(nodes)
    for x in nodes:
        x.score = 0.0
        if x.order:
            weight[x.order] = weight[x.parent.order] * (SUSPECT_WEIGHT if x.suspect >= STRONG else 1.0)
    for holder, text, links in blocks:
        if not out[holder.order]:
            holder.box.score += (len(text) - 2.0 * links) * weight[holder.order]
    boxes = [x for x in nodes if x.box is x and not out[x.order] and not x.dropped]
    for x in reversed(boxes[1:]):
        named = x.tag in ("article", "main")
        x.score *= 1.25 if named else 1.0
        x.parent.box.score += (0.4 if named else 0.5) * x.score
    best = max(boxes, key=lambda x: (x.score, -x.order))
    alike = defaultdict(float)
    for x in boxes[1:]:
        alike[x.parent.order, x.key] += max(0.0, x.score)
    while best.parent is not None and best.tag not in ("article", "main", "td") and alike[best.parent.order, best.key] >= (1 + ALIKE_SHARE) * best.score > 0:
        best = best.parent.box
    return best


def texts_in(nodes: list[Node], blocks: list[tuple[Node, str, int]], chosen: set[int]) -> str:
    out = left_out(nodes, chosen)
    return "\n\n".join([text for holder, text, _ in blocks if not out[holder.order]])


def extract(html: str, winners: list[str]) -> tuple[str, str]:
    """Main text of a page and the path it came from: the first winner that holds text, else the page's own best."""
    nodes, blocks = parse(html)
    for path in winners:
        key = key_of(path)
        chosen = {x.order for x in nodes if x.key == key and x.box is x and not x.dropped}
        if chosen and (text := texts_in(nodes, blocks, chosen)):
            return text, path
    best = best_container(nodes, blocks)
    return texts_in(nodes, blocks, {best.order}), path_of(best)


def pages_by_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): on how many pages of the host each path is the best container's."""

    def run(batches):
        for b in batches:
            paths = []
            for t in b.column("html"):
                nodes, blocks = parse(t.as_py())
                paths.append(path_of(best_container(nodes, blocks)) if blocks else None)  # a page without text has no vote
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    return map_arrow(pages_by_host(pages).select("host", "html"), run, "host string, path string").filter("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))


def winning_paths(votes: DataFrame, share: float = WIN_SHARE) -> DataFrame:
    """(host, winners): the paths with at least the share of their host's votes, most votes first; 1 / share of them at most."""
    all_votes = F.sum("votes").over(Window.partitionBy("host"))
    return votes.withColumn("all", all_votes).filter(F.col("votes") >= share * F.col("all")).groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path")))["path"].alias("winners"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path of every page."""
    winners = staged(winning_paths(host_votes(pages)), "winners")
    size = winners.select(F.sum(F.length("host") + F.length(F.concat_ws("", "winners")) + 64)).first()[0] or 0
    source = pages_by_host(pages).join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners, "host", "left").select("page_id", "url", "html", "winners")

    def run(batches):
        for b in batches:
            found = [extract(h.as_py(), w.as_py() or []) for h, w in zip(b.column("html"), b.column("winners"))]
            text = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([p for _, p in found], pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    return map_arrow(source, run, "page_id long, url string, text string, n_chars long, path string")
