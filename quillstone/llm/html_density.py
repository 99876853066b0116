"""Main text of a web page by composite text density.

The page becomes a tree of elements.  Every node has characters C and tags T, and of these
link characters LC and link tags LT (¬LC the rest).  Its density is

    C/T * log(C/LC * T/LT) / log(ln(C/¬LC * LC + LCb/Cb * C + e))

with zero divisors as one and b for the body; links and tags lower it.  Of the sums over each
node's children the largest marks the core of the article.  The smallest density between it
and the body is the threshold: what hangs beside that path and reaches it belongs to the
article, and so do headings of the first two levels.  An ``article`` (or else ``main``) element
around the core is kept whole, and the path is that from it to the body.  As density grows with
size, an ``article`` beside the path and what stands in a ``main`` around it belong to the
article too if less than half their text is in links.

Elements that are never article text (scripts, menus, asides and the like) are left out before
anything is counted, and so are forms and elements with a class, id or role that is one of the
``NOISE`` words as a whole, but no headings and none that holds most of the page's text.  They
stand in the tree like any other, so their end follows the same rules.  Blocks are separated by
block-level elements; white space in a block is one space, blocks are joined by a newline.

One page is one small Python task inside an Arrow batch; Spark spreads the pages.

Cases: null and empty pages give the empty text, and so do pages without a body or text;
unclosed and stray tags, comments and attributes follow the usual recovery (a block closes an
open paragraph, an end tag closes what is open inside it); nothing is cut at any length;
repeated pages repeat; null ids and urls pass through.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""", re.S)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg xmp".split())
NEVER = frozenset("nav footer aside button select menu dialog head object audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = frozenset("ul ol dl table body html article section div".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer masthead menu menubar modal nav navbar navigation newsletter notice overlay pager pagination popup promo "
    "promoted promotion related replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
KEPT = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MOST = 0.8  # an element with this share of the text is the page, whatever its name, class or id


class Page:
    """Nodes of one page in document order, with their counts and pieces of text."""

    def __init__(self, html: str):
        self.name, self.parent, self.end = ["html"], [-1], [0]
        self.chars, self.links = [0], [0]
        self.mark = [0]  # 1: left out unless it holds most of the text, 2: left out
        self.pieces: list[tuple[int, int, str]] = []  # node, block, text
        self._read(html)
        self.out = self._left_out()

    def _read(self, html: str) -> None:
        stack, at, block, anchors = [0], 0, 0, 0
        while True:
            m = TOKEN.search(html, at)
            start = m.start() if m else len(html)
            if start > at:
                raw = html[at:start]
                text = unescape(raw) if "&" in raw else raw
                node = stack[-1]
                n = len(" ".join(text.split()))
                self.chars[node] += n
                if anchors:
                    self.links[node] += n
                self.pieces.append((node, block, text))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if name not in INLINE:
                block += 1
            elif name == "br":
                self.pieces.append((stack[-1], block, " "))
            if closing:
                if name in {self.name[i] for i in stack[1:]}:
                    while True:
                        i = stack.pop()
                        self.end[i] = len(self.name)
                        anchors -= self.name[i] == "a"
                        if self.name[i] == name:
                            break
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
                continue
            if name in ("html", "body") and name in self.name:
                continue
            if name in CLOSES_P:
                self._close(stack, ("p",))
            if name in SAME:
                self._close(stack, SAME[name])
            i = len(self.name)
            self.name.append(name)
            self.parent.append(stack[-1])
            self.end.append(i + 1)
            self.chars.append(0)
            self.links.append(0)
            stray = name == "header" and not any(self.name[k] in ("article", "main") for k in stack)
            self.mark.append(2 if name in NEVER or stray else self._noise(name, rest))
            if name not in VOID and not rest.endswith("/"):
                stack.append(i)
                anchors += name == "a"
        for i in stack:
            self.end[i] = len(self.name)

    def _close(self, stack: list[int], names: tuple[str, ...]) -> None:
        """Close the innermost open element of ``names``, if no list, table or section stands between."""
        for k in range(len(stack) - 1, 0, -1):
            if self.name[stack[k]] in names:
                for i in stack[k:]:
                    self.end[i] = len(self.name)
                del stack[k:]
                return
            if self.name[stack[k]] in FENCE:
                return

    @staticmethod
    def _noise(name: str, rest: str) -> int:
        if name in KEPT:
            return 0
        if re.search(r"\shidden(\s|=|/|$)|aria-hidden\s*=\s*[\"']?true", rest, re.I):
            return 2
        if name in HEADINGS:
            return 0
        return int(name == "form" or any(not NOISE.isdisjoint(v.lower().strip("\"'").split()) for v in MARKS.findall(rest)))

    def _left_out(self) -> list[bool]:
        """For each node whether it or an element around it is left out."""
        hard = [m == 2 for m in self.mark]
        for i in range(1, len(hard)):
            hard[i] |= hard[self.parent[i]]
        held = [0 if h else c for h, c in zip(hard, self.chars)]
        for i in range(len(held) - 1, 0, -1):
            held[self.parent[i]] += held[i]
        out = [h or m == 1 and c < MOST * held[0] for h, m, c in zip(hard, self.mark, held)]
        for i in range(1, len(out)):
            out[i] |= out[self.parent[i]]
        return out

    def densities(self) -> tuple[list[float], list[float]]:
        """Density of each node and the sum over its children."""
        n = len(self.name)
        chars, links = ([0 if o else x for o, x in zip(self.out, xs)] for xs in (self.chars, self.links))
        tags, link_tags = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if self.out[i]:
                continue
            up = self.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (self.name[i] == "a")
        self.plain = [2 * l < c for l, c in zip(links, chars)]  # holds text, and less than half of it in links
        body = self.name.index("body") if "body" in self.name else 0
        share = links[body] / max(chars[body], 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, t = chars[i], max(tags[i], 1)
            if c:
                lc, lt, plain = max(links[i], 1), max(link_tags[i], 1), max(c - links[i], 1)
                base = math.log(math.log(c / plain * links[i] + share * c + math.e) + 1e-9)
                ratio = math.log(max(c / lc * t / lt, 1.0))
                # without links the logarithm's base tends to one; such a node keeps its plain density times the ratio
                density[i] = c / t * (ratio / max(base, 1.0))
            if i:
                sums[self.parent[i]] += density[i]
        return density, sums

    def chosen(self) -> list[tuple[int, int]]:
        """Node ranges that hold the article, in page order."""
        density, sums = self.densities()
        body = self.name.index("body") if "body" in self.name else 0
        core = max(range(body, self.end[body]), key=lambda i: (sums[i], -i))
        path = [core]
        while path[-1] != body:
            path.append(self.parent[path[-1]])
        threshold = min(density[i] for i in path)
        named = [i for i in path if self.name[i] == "article"] or [i for i in path if self.name[i] == "main"]
        if named:  # its core is kept whole, and what hangs beside the way from there to the body is judged
            core = named[-1]
            path = path[path.index(core) :]
        on_path = set(path)
        in_main = {i for k, i in enumerate(path) if any(self.name[j] == "main" for j in path[k:])}
        kept = [(core, self.end[core])]
        for i in range(body + 1, self.end[body]):
            if i not in on_path and self.parent[i] in on_path and self.parent[i] != core:
                told = self.plain[i] and (self.name[i] == "article" or self.parent[i] in in_main)
                if density[i] >= threshold or told or self.name[i] in ("h1", "h2"):
                    kept.append((i, self.end[i]))
        return sorted(kept)

    def text(self) -> str:
        ranges = self.chosen()
        blocks: dict[int, list[str]] = {}
        for node, block, piece in self.pieces:
            if not self.out[node] and any(a <= node < b for a, b in ranges):
                blocks.setdefault(block, []).append(piece)
        lines = (" ".join("".join(p).split()) for p in blocks.values())
        return "\n".join(x for x in lines if x)


def main_text(html: str) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """Per row: ``page_id, url, text, n_chars``."""

    def start():
        def handle(batch):
            texts = [main_text(h) for h in batch.column("_html").to_pylist()]
            return pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

        return handle

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("_html"))
    return map_rows(rows, start, "page_id long, url string, text string, n_chars long")
