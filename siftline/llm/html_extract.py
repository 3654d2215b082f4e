"""HTML extraction by tag-path ratios.

A page becomes its text blocks in order, each with its path of tags from the root. For every path, text length and punctuation are summed and
divided by the number of blocks (tag-path ratios); both ratios are smoothed over the neighbouring blocks and fused by their product, and a path's score is the mean
of its blocks. The share of its text that is links lowers it, and so do names of classes, ids and roles that say what an element usually is (menu, advert, comment) on the
way. Paths whose score reaches a share of the page's running text (the mean of fused ratios by length) are running text: their lengths, summed up the tree, lead
to the content node: an article or main element where there is one; else, from the root downwards, the last container that holds all running text with no heading beside it that comes first.

In the content node a path is left out if its score falls short and something speaks against it: a name on the way below the node, or, without article or main, that it
consists of links. Plain paths stay there, however short. Elements that HTML itself sets apart (navigation, headers, footers, asides, forms, scripts) and hidden ones never count. A name
on an element that holds most of the running text says nothing (a wrapper of the whole page may be called after its sidebar), unless it names comments.
Time is linear in the page: paths and elements are numbered trees, and all sums go up them once.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of elements in HTML and usual words of class names.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "datalist", "label", "fieldset", "svg", "math", "canvas", "object", "audio", "video", "map", "dialog", "menu", "input"} | RAW
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "picture", "source", "map", "area"}
CONTAINERS = {"html", "body", "section", "div", "td", "table", "tbody", "tr", "center"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "details", "figcaption"}
#: By what a name on the way multiplies a path's score.
COMMENTS, BESIDE, OFTEN_BESIDE = 0.02, 0.05, 0.4
_NAMES = {
    COMMENTS: r"comments?|commentary|disqus|replies|reply|respond",
    BESIDE: r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|masthead|topbar|footer|copyright|disclaimer|social|related|recommended|trending|search|toolbar|pagination|pager|skip",
    OFTEN_BESIDE: r"side|aside|rail|widget|header|foot|legal|share|sharing|form|toc|tags",
}
SAYS = [(factor, re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)) for factor, words in _NAMES.items()]
ROLES_NO = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "note"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_PUNCTUATION = re.compile(r"[.,;:!?¿¡。，、；：！？…]")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
THRESHOLD, LINKS = 0.25, 0.8


class Page:
    """Blocks of text in order, and the numbered trees of paths and elements; 0 is the root of both, and what is within has a greater number."""

    def __init__(self, page: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.steps: list[str] = [""]
        self.above: list[int] = [0]
        self.tags: list[str] = [""]
        self.factors: list[float] = [1.0]
        #: path, element, text, characters of links
        self.blocks: list[tuple[int, int, str, int]] = []
        self._read(page)

    def path(self, parent: int, step: str) -> int:
        number = self.paths.setdefault((parent, step), len(self.steps))
        if number == len(self.steps):
            self.steps.append(step)
        return number

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, path, element, ruled out
        solid = [0]  # where in the stack the elements are that aren't inline
        opened: Counter = Counter()
        parts: list[str] = []
        place, linked = stack[0], 0

        def cut(depth: int) -> None:
            for tag, *_ in stack[depth:]:
                opened[tag] -= 1
            del stack[depth:]
            while solid[-1] >= depth:
                solid.pop()

        def last(tags: set[str], until: set[str] = frozenset()) -> int | None:
            """The innermost open element of tags, if none of until is further in."""
            if not any(opened[t] > 0 for t in tags):
                return None
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in tags or stack[k][0] in until), 0)
            return depth if stack[depth][0] in tags else None

        def flush() -> None:
            nonlocal linked
            if parts:
                if (text := " ".join(_html.unescape("".join(parts)).split())) and not place[3]:
                    self.blocks.append((place[1], place[2], text, min(linked, len(text))))
                parts.clear()
                linked = 0

        def write(text: str) -> None:
            nonlocal place, linked
            if not text:
                return
            if not parts:
                if text.isspace():
                    return
                place = stack[-1]
            elif stack[-1][3] and not place[3]:
                return  # an inline element that is ruled out
            parts.append(text)
            if opened["a"] > 0:
                linked += len(text)

        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if not m:
                write(page[at:])
                break
            write(page[at : m.start()])
            at = m.end()
            closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                if m[0].startswith("<![CDATA["):
                    write(_html.escape(m[0][9:].removesuffix("]]>"), quote=False))
                continue
            tag = tag.lower()
            if tag not in INLINE:
                flush()
            elif tag == "br":
                write(" ")
            if closing:
                if opened[tag] > 0 and (tag not in INLINE or solid[-1] < len(stack) - 1):
                    depth = next((k for k in range(len(stack) - 1, solid[-1] if tag in INLINE else 0, -1) if stack[k][0] == tag), 0)
                    if depth:
                        cut(depth)
                continue
            if tag in VOID:
                continue
            if tag in ENDS_P:
                if stack[solid[-1]][0] == "p":
                    cut(solid[-1])
            elif tag in CLOSED_BY and (depth := last(CLOSED_BY[tag], {"ul", "ol", "dl", "table"})):
                cut(depth)
            own = {(a[0] or a[4]).lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(rest)} if rest.strip("/ \t\r\n") else {}
            said, role = f"{own.get('class', '')} {own.get('id', '')}".strip(), own.get("role", "").lower()
            out = tag in NEVER or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
            factor = min((f for f, words in SAYS if words.search(said)), default=1.0) if said else 1.0
            if role in ROLES_NO:
                factor = min(factor, BESIDE)
            if tag == "header" and factor >= OFTEN_BESIDE and opened["article"] > 0:
                out, factor = False, 1.0  # an article's own header has its title
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                flush()
                continue
            if rest.rstrip().endswith("/") and tag in {"svg", "path", "use"}:
                continue
            _, path, element, ruled_out = stack[-1]
            if tag not in INLINE:
                solid.append(len(stack))
                path = self.path(path, f"{tag}.{said.split()[0]}" if said else tag)
                self.above.append(element)
                self.tags.append("article" if role in {"main", "article"} or own.get("itemprop") == "articleBody" else tag)
                self.factors.append(1.0 if tag in {"html", "body", "main", "article"} and factor > COMMENTS else factor)
                element = len(self.tags) - 1
            stack.append((tag, path, element, ruled_out or out))
            opened[tag] += 1
        flush()


def fused_ratios(page: Page) -> np.ndarray:
    """For each block: its path's text length a block, times its path's punctuation a block, each smoothed over three neighbouring blocks (so little that a few words beside a long text stay few)."""
    path = np.array([b[0] for b in page.blocks])
    sums = np.array([(1, len(b[2]), len(_PUNCTUATION.findall(b[2])) + 0.0) for b in page.blocks])
    count, chars, marks = (np.bincount(path, c) for c in sums.T)
    ratios = np.column_stack([chars[path] / count[path], (marks[path] + 0.5) / count[path]])
    padded = np.pad(ratios, ((1, 1), (0, 0)), mode="edge")
    smooth = (padded[:-2] + 6 * padded[1:-1] + padded[2:]) / 8
    return np.sqrt(smooth[:, 0] * smooth[:, 1])


def path_scores(page: Page) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each block: its path's mean fused ratio, its path's share of links; and the score that running text has to reach."""
    path, chars, links = (np.array([f(b) for b in page.blocks]) for f in (lambda b: b[0], lambda b: len(b[2]), lambda b: b[3]))
    fused = fused_ratios(page)
    score = (np.bincount(path, fused) / np.maximum(np.bincount(path), 1))[path]
    linked = (np.bincount(path, links) / np.maximum(np.bincount(path, chars), 1))[path]
    return score, linked, THRESHOLD * float(fused @ chars / chars.sum())


def _up(page: Page, values: np.ndarray) -> np.ndarray:
    """Sums of values of blocks over each element and all within it."""
    sums = np.bincount([b[1] for b in page.blocks], values, minlength=len(page.tags)).tolist()
    for k in range(len(sums) - 1, 0, -1):
        sums[page.above[k]] += sums[k]
    return np.array(sums)


def _down(page: Page, top: set[int]) -> np.ndarray:
    """Which elements are top or within."""
    inside = [0 in top] * len(page.tags)
    for k in range(1, len(inside)):
        inside[k] = k in top or inside[page.above[k]]
    return np.array(inside)


def content_nodes(page: Page, weight: np.ndarray) -> tuple[set[int], bool]:
    """The elements that hold the content, and whether they are article or main elements. weight: running text of each block."""
    sums = _up(page, weight)
    total, marked = sums[0], [k for k, tag in enumerate(page.tags) if tag in {"article", "main"} and sums[k] > 0]
    if marked:
        most = max(sums[k] for k in marked)
        node = max(marked, key=lambda k: (sums[k] >= 0.5 * most, page.tags[k] == "article", sums[k], -k))
        if page.tags[node] == "article":
            within, around = _down(page, {node}), set()
            k = node
            while k:
                around.add(k := page.above[k])
            others = {k for k in marked if page.tags[k] == "article" and k not in around and not within[k]}
            held = _down(page, others)
            apart = {k for k in others if not held[page.above[k]]}  # those that no other one holds
            if apart and sums[node] < 0.5 * (sums[node] + sum(sums[k] for k in apart)):
                return {node, *apart}, True
        return {node}, True
    element = [b[1] for b in page.blocks]
    children: dict[int, list[int]] = {}
    for k in range(1, len(sums)):
        if sums[k] > 0:
            children.setdefault(page.above[k], []).append(k)
    first_heading: dict[int, int] = {}
    first_block: dict[int, int] = {}
    for at in range(len(element) - 1, -1, -1):
        own = element[at]
        first_block[own] = at
        if page.tags[own] in HEADINGS:
            first_heading[own] = at
    for k in range(len(sums) - 1, 0, -1):
        for first in (first_heading, first_block):
            if k in first:
                first[page.above[k]] = min(first[k], first.get(page.above[k], first[k]))
    node = 0
    while total and len(ways := children.get(node, [])) == 1 and sums[ways[0]] >= total and page.tags[ways[0]] in CONTAINERS and first_heading.get(node, len(element)) >= first_block[ways[0]]:
        node = ways[0]
    return {node}, False


def main_text(html: str) -> str:
    page = Page(html)
    if not page.blocks:
        return ""
    element, chars = np.array([b[1] for b in page.blocks]), np.array([len(b[2]) for b in page.blocks], dtype=float)
    score, linked, least = path_scores(page)
    running = _up(page, np.where(score * (1 - linked) >= least, chars, 0.0))
    named = [1.0 if COMMENTS < f and 2 * r > running[0] else f for f, r in zip(page.factors, running, strict=True)]
    product = named[:]
    for k in range(1, len(product)):
        product[k] *= product[page.above[k]]
    product = np.array(product)
    nodes, marked = content_nodes(page, np.where(score * (1 - linked) * product[element] >= least, chars, 0.0))
    below = named[:]
    for k in range(1, len(below)):
        below[k] = 1.0 if k in nodes else below[k] * below[page.above[k]]
    below = np.array(below)[element]
    doubtful = (below < 1) | ((linked > LINKS) & (not marked))
    keep = _down(page, nodes)[element] & ~(doubtful & (score * (1 - linked) * below < least))
    return "\n\n".join(b[2] for b, k in zip(page.blocks, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text (blocks joined by two line feeds; empty if none) and n_chars of every row. Null html: empty. Null keys stay null, repeated rows are each returned, other columns are ignored."""

    def emit(batches: Iterator) -> Iterator:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(emit, "page_id long, url string, text string, n_chars long")
