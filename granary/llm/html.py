"""Main text of web pages by line-block distribution.

Markup is stripped; each block element gives one line with a weight, its characters that are not in links. What stands
in menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles gives an empty line, as do
boxes of links (related, share and the like) of which more than half is links. Weights are summed over sliding windows of
lines. The text begins where the sum surges to a share of the page's largest one, and ends where it dives to nothing; the
lines between are kept, and those right before a surge back to the last empty line: titles and bylines.

Article and main elements are judged by the same windows. One whose largest window is a fair share of the page's largest
is believed: all its lines are kept, and a line outside only where a quarter of the text there surges as the densest lines
inside do, or right before it within the same main element. One that is not, a teaser, is no part of the text. Without a
believed element a page is read by surges and dives alone.

Class names drop an element only if they name furniture and nothing else (`comment-list`, not `menu-review`).

Results in special cases: null and empty html, and pages without text, give an empty text of 0 characters; unclosed
and crossed tags are closed by what encloses them; equal pages give equal texts; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.common import prepare

#: Lines in a window, the share of the largest sum that is a surge, and that makes an article or main element believed.
WINDOW = 3
SURGE = 0.15
MARKED = 1 / 16

token = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>][^\s>]*|["'])?)*)>""", re.S)
attribute = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
DROPPED = frozenset("nav footer aside form head select button dialog menu fieldset label input option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | DROPPED
#: Where an end tag is left out, these begin anew.
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
#: Parts of class names and ids: of furniture, of boxes that may be, and of what says nothing about it.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice notices popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager"
    " footer masthead topbar comment comments commentlist disqus respond replies reply signup login skiplink".split()
)
BOXES = frozenset("alert promo promotion rail widget share sharing social related recommended recommendations stories newsletter subscribe subscription search tags toolbar copyright legal disclaimer".split())
NEUTRAL = frozenset(
    "list main bar box wrap wrapper container section area block item items inner outer top bottom left right primary secondary site page global side panel link links slot unit zone text header group form row col column inline native sticky"
    " fixed mobile desktop wide small large thread feed article post entry user reader skip to the id js is has more".split()
)
_parts = re.compile(r"[a-z]+|\d+").findall
roles = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


def named(value: str) -> tuple[bool, bool]:
    """Whether a class or id names furniture, and whether it names a box that may be: one part does, and the others say nothing else."""
    furniture = box = False
    for name in value.lower().split():
        parts = [p for p in _parts(name) if not p.isdigit()]
        if all(p in FURNITURE or p in NEUTRAL for p in parts):
            furniture = furniture or any(p in FURNITURE for p in parts)
        elif all(p in FURNITURE or p in NEUTRAL or p in BOXES for p in parts):
            box = True
    return furniture, box


def _drops(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate with all it holds, and whether it is if it holds links."""
    if tag in DROPPED:
        return True, False
    if tag == "header" and not in_article:
        return True, False
    if tag in ("html", "body", "main", "article") or not attributes:
        return False, False
    maybe = False
    for name, value in attribute.findall(attributes):
        value = value.strip("\"'").lower()
        name = name.lower()
        if name in ("class", "id"):
            furniture, box = named(value)
            if furniture:
                return True, False
            maybe = maybe or box
        elif name == "role" and value in roles or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
    return False, maybe


def lines_of(html: str) -> list[tuple[str, int, int, int]]:
    """(text, characters that are not links, number of the outermost article, number of the main element; 0: in none) of each block in page order; boilerplate is an empty line."""
    out: list[tuple[str, int, int, int]] = []
    words: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, drops, article, main, place of a box's first line (-1: no box)
    opened: Counter = Counter()
    dropped = articles = mains = links = 0
    article_no = main_no = 0

    def flush(empty: bool = False) -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(words)).split())
        if text or empty:
            out.append((text, max(0, len(text) - linked), article_no if articles else 0, main_no if mains else 0))
        words.clear()
        linked = 0

    def pop() -> str:
        nonlocal dropped, articles, mains, links
        tag, drops, article, main, box = stack.pop()
        opened[tag] -= 1
        if (tag in BLOCK or box >= 0) and not dropped:
            flush()
        if box >= 0:
            own = out[box:]
            if 2 * sum(size for _, size, _, _ in own) < sum(len(text) for text, _, _, _ in own):  # more links than text
                out[box:] = [("", 0, article_no if articles else 0, main_no if mains else 0)]
        dropped -= drops
        articles -= article
        mains -= main
        links -= tag == "a"
        if drops and not dropped:
            flush(empty=True)
        return tag

    at, n, lower = 0, len(html), None
    while at < n:
        k = html.find("<", at)
        if k < 0:
            k = n
        if k > at and not dropped:
            piece = html[at:k]
            words.append(piece)
            if links:
                linked += len(entities.unescape(piece).strip())
        if k == n:
            break
        m = token.match(html, k)
        if not m:
            if not dropped:
                words.append("<")
            at = k + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if html.startswith("<![CDATA[", k) and not dropped:
                words.append(entities.escape(m[0][9:-3]))
            continue
        if m[1]:
            if opened[tag] > 0:
                while pop() != tag:
                    pass
            elif tag in BLOCK and not dropped:
                flush()
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                lower = html.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at)
                close = html.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else n
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr", "img") and not dropped:
                words.append(" " if tag != "wbr" else "")
                if tag == "hr":
                    flush()
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in SELF_ENDING:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth][0] in BLOCK and stack[depth][0] not in SELF_ENDING:
                    break
        elif tag in BLOCK and opened["p"] > 0:  # a block ends an open paragraph
            depth = len(stack) - 1
            while stack[depth][0] not in BLOCK:
                depth -= 1
            if stack[depth][0] == "p":
                while len(stack) > depth:
                    pop()
        if tag in BLOCK and not dropped:
            flush()
        drops, maybe = _drops(tag, m[3], articles > 0 or mains > 0)
        article, main, box = tag == "article" and not dropped, tag == "main" and not dropped, maybe and not dropped
        if box and tag not in BLOCK:
            flush()
        article_no += article and not articles
        main_no += main and not mains
        stack.append((tag, drops, article, main, len(out) if box else -1))
        opened[tag] += 1
        dropped += drops
        articles += article
        mains += main
        links += tag == "a"
    while stack:
        pop()
    flush()
    return out


def spans(weights: list[float], surge: float, dive: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """The stretches from a surge to the dive after it: a window of lines sums to `surge` or more, and the text goes on until one sums to less than `dive`. A stretch begins with a line that has a weight."""
    n = len(weights)
    total, upto = [0.0], 0.0
    for w in weights:
        upto += w
        total.append(upto)
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    out, i = [], 0
    while i < n:
        if weights[i] and sums[i] >= surge:
            j = i
            while j < n and sums[j] >= dive:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def _sums(weights: list[float]) -> list[float]:
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def _believed(weights: list[float], sizes: list[int], marks: list[int], largest: float) -> set[int]:
    """The numbers of the elements whose own lines have a window of a fair share of the page's largest."""
    own: dict[int, list[float]] = {}
    for w, size, k in zip(weights, sizes, marks, strict=True):
        if k:
            own.setdefault(k, []).append(max(w, size / 4))  # its lists of links are a part of it, and say less
    return {k for k, w in own.items() if max(_sums(w)) > 0 and max(_sums(w)) >= MARKED * largest}


def _before(lines: list[tuple[str, int, int, int]], start: int, same: list[bool]) -> list[int]:
    """The lines right before `start`, back to the last empty or different one."""
    i = start
    while i > 0 and lines[i - 1][0] and same[i - 1]:
        i -= 1
    return list(range(i, start))


def extract(html: str | None) -> str:
    if not html:
        return ""
    lines = lines_of(html)
    sizes = [len(text) for text, _, _, _ in lines]
    # A line of links is no text by itself.
    weights = [size if 2 * size > n else 0 for (_, size, _, _), n in zip(lines, sizes, strict=True)]
    largest = max(_sums(weights), default=0)
    articles, mains = ([line[k] for line in lines] for k in (2, 3))
    good = _believed(weights, sizes, articles, largest)
    inside = [k in good for k in articles]
    held = {m for m, own in zip(mains, inside, strict=True) if own and m}  # main elements with a believed article are what surrounds it
    rest = [0 if a or m in held else m for a, m in zip(articles, mains, strict=True)]
    main = _believed(weights, sizes, rest, largest)
    inside = [own or m in main for own, m in zip(inside, rest, strict=True)]
    teaser = [bool(a) and not own for a, own in zip(articles, inside, strict=True)]
    if any(inside):
        # Each line inside weighs enough for a surge; outside, a quarter of the text has to surge as the densest lines inside do.
        dense = max(_sums([max(line[1], 1) if own and line[0] else 0 for line, own in zip(lines, inside, strict=True)]))
        found = {i for i, own in enumerate(inside) if own}
        for a, b in spans([0 if own or t else w / 4 for w, own, t in zip(weights, inside, teaser, strict=True)], dense, dense):
            found.update(i for i in range(a, b) if not inside[i] and not teaser[i])
        for i in sorted(found):
            if inside[i] and (i == 0 or not inside[i - 1]) and mains[i] in held:
                found.update(_before(lines, i, [m == mains[i] and not t for m, t in zip(mains, teaser, strict=True)]))
    else:
        own = [0 if t else w for w, t in zip(weights, teaser, strict=True)]
        found = set()
        for a, b in spans(own, SURGE * largest, 1) if largest else []:
            part = [*_before(lines, a, [bool(w) for w in own]), *range(a, b)]
            # Of lines of links one that text surrounds stays; several are a menu.
            found.update(i for i in part if own[i] or lines[i][0] and not teaser[i] and a < i < b - 1 and own[i - 1] and own[i + 1])
    return "\n\n".join(lines[i][0] for i in sorted(found) if lines[i][0])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, 500):
                part = b.slice(x, 500)
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
