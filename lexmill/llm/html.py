"""Main text of web pages by tag-path ratios.

Each text node counts toward its root-to-leaf tag path: characters outside links, punctuation marks and nodes. Per path
the two ratios (characters and punctuation per node) are fused to one value. Along the page the blocks' values are
smoothed over neighbours, the more the longer the beginning that their paths share, and a path's smoothed value is the
mean over its blocks. Paths of at least THRESHOLD of the greatest value are the core.

The content's root is the deepest beginning of paths that holds nearly all of the core's value. Paths below it are
content as well, such as short headings, lists and captions, unless links make up most of their text or a step below the
root bears a name of what is not the article; such paths are content only as core, and paths elsewhere only from
ELSEWHERE of the greatest value. An article or main element around the root takes its place, and a title that stands
right beside the root is content. Where the core lies in several elements right under the body, the body is the root,
of which containers without any core are no part.

A step of a path is the tag; containers add their classes. Names (classes, ids, roles) that sites give to what is not
the article lower a path's value to PENALTY of it; a compound name counts by its last noun, so the analysis of a
``legal-analysis`` is article. Since values are only compared inside a page and names only count below the root, a name
around the whole article says nothing. A form that holds under HALF of the page's text counts as named so, a larger one
wraps the page. Elements that hold no article text by their tag (scripts, navigation, footers, asides) take no part.

Defined cases: null or empty html gives an empty text; unclosed tags end where HTML lets them end, and of elements that
are skipped as a whole only script and style take the rest of the page when unclosed; a "<" that begins no tag is text;
elements nested deeper than DEEP share the path of the one at DEEP; other columns and repeated rows are left alone; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.common import lean

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:![^>]*|\?[^>]*)>|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
# Elements by their meaning in HTML, and parts of names that sites give to what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg select canvas annotation annotation-xml".split())
CODE = {"script", "style"}  # without an end, all that follows is theirs
NOT_ARTICLE = RAW | set("head nav footer aside button dialog menu".split())
INLINE = set(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark object q s samp small span strike strong sub sup time tt u var "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split()
)
CLOSES_P = set("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = set("article div main section td".split())
OTHER_NAMES = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs toc pagination pager footer topbar share sharing social related recommended widget comment comments disqus reply replies respond contentinfo complementary copyright legal disclaimer".split()
)
WHOLE_NAMES = set("alert meta search side skip tags".split())  # only as they stand
#: Nouns that end a name without telling what the element is.
PLACES = set("area bar block body box button buttons container content group holder inner item items link links list outer panel post posts region row section slot title top unit wrap wrapper zone".split())
HEAD_NAMES = {"header", "masthead", "banner"}  # of the site, or of the article
TOLD = {"no", "not", "has", "with", "without", "is", "enabled", "disabled"}  # a name with such a part tells what else the page has
#: Weights of a block and its neighbours; value left to named paths; share of the greatest value that makes core, and
#: that makes content outside the root; share of the core's value below the content's root.
SMOOTHING, PENALTY, THRESHOLD, ELSEWHERE, HELD, HALF, DEEP = (0.25, 0.5, 0.25), 0.05, 0.4, 0.6, 0.9, 0.5, 100


class Block:
    """Text between two borders of block elements: its pieces and the path of each, with counts, and its elements."""

    __slots__ = ("parts", "counts", "path")

    def __init__(self, path: tuple):
        self.parts, self.counts, self.path = [], [0, 0, 0], path


def noun_of(name: str) -> str:
    """The part of a compound name that tells what it names."""
    parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
    while len(parts) > 1 and parts[-1] in PLACES:
        parts.pop()
    return parts[-1] if parts else ""


def marks_of(attributes: str) -> tuple[str, bool, bool]:
    """The classes, and whether a name is one of what is not the article, or of a head."""
    classes, other, head = "", False, False
    for kind, *value in NAMED.findall(attributes):
        for token in " ".join(value).lower().split():
            parts = re.split(r"[-_]+", token)
            if TOLD.isdisjoint(parts):
                other |= token in WHOLE_NAMES or noun_of(token) in OTHER_NAMES
                head |= token in HEAD_NAMES
        if kind.lower() == "class":
            classes += "".join("." + x for x in sorted(" ".join(value).lower().split()))
    return classes, other and not head, head


def blocks(page: str) -> list[Block]:
    """The text outside elements that never hold article text by their tag, in page order.

    A path is a tuple of steps (tag with classes, whether named as something else, whether a head) below the body.
    """
    out: list[Block] = []
    stack: list[str] = []  # open elements
    steps: list[tuple] = []  # of those that aren't inline
    hides: list[bool] = []
    hidden, inner_link, at, fresh = 0, 0, 0, True

    def text(raw: str) -> None:
        nonlocal fresh
        if hidden or not raw:
            return
        piece = entities.unescape(raw)
        stripped = piece.strip()
        if fresh:
            if not stripped:
                return
            out.append(Block(tuple(x for x in steps[:DEEP] if x[0] not in ("html", "body"))))
            fresh = False
        block = out[-1]
        block.parts.append(piece)
        if stripped:
            block.counts[0] += 0 if inner_link else len(stripped)
            block.counts[1] += len(PUNCTUATION.findall(stripped))
            block.counts[2] += len(stripped)

    def pop() -> None:
        nonlocal hidden, inner_link, fresh
        name = stack.pop()
        hidden -= hides.pop()
        inner_link -= name == "a"
        if name not in INLINE:
            steps.pop()
            fresh = True

    def close(names: set[str], scope: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i] in scope:
                return

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            close({name}, set() if name in CLOSES_P else {"table", "article", "body"} - {name})
            fresh |= name not in INLINE
            continue
        if name == "br":
            text(" ")
            continue
        if name in VOID or m[3].endswith("/"):
            fresh |= name not in VOID or name == "hr"
            continue
        if name in CLOSES_P:
            close({"p"}, {"div", "td", "th", "li", "section", "article", "table", "button"})
        if name in CLOSED_BY_OWN:
            close(CLOSED_BY_OWN[name], {"ul", "ol", "dl", "table", "select"})
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size if name in CODE else at
            continue
        if name not in INLINE:
            fresh = True
            classes, other, head = marks_of(m[3]) if m[3] and name not in ("html", "body") else ("", False, False)
            steps.append((name + classes * (name in CONTAINERS), other, head or name == "header"))
        stack.append(name)
        hides.append(name in NOT_ARTICLE)
        hidden += name in NOT_ARTICLE
        inner_link += name == "a"
    return out


def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def with_forms(found: list[Block]) -> list[Block]:
    """The blocks with the steps of small forms named as something else."""
    chars: dict[tuple, int] = {}
    whole = sum(b.counts[0] for b in found)
    for b in found:
        for depth, step in enumerate(b.path, 1):
            if step[0] == "form":
                chars[b.path[:depth]] = chars.get(b.path[:depth], 0) + b.counts[0]
    small = {p for p, n in chars.items() if n < HALF * whole}
    for b in found:
        if small:
            b.path = tuple((name, other or b.path[: i + 1] in small, head) for i, (name, other, head) in enumerate(b.path))
    return found


def path_values(found: list[Block]) -> dict[tuple, float]:
    """The fused, smoothed value of each path."""
    sums: dict[tuple, list[int]] = {}
    for b in found:
        own = sums.setdefault(b.path, [0, 0, 0])
        own[0], own[1], own[2] = own[0] + b.counts[0], own[1] + b.counts[1], own[2] + 1
    fused = {}
    for path, (chars, marks, nodes) in sums.items():
        fused[path] = float(np.sqrt(chars / nodes * (1 + marks / nodes)))
    share = {path: PENALTY if any(other or head for _, other, head in path) else 1.0 for path in fused}
    smoothed: dict[tuple, list[float]] = {}
    side, own = SMOOTHING[0], SMOOTHING[1]
    for i, b in enumerate(found):
        total, weight = own * fused[b.path], own
        for j in (i - 1, i + 1):
            if 0 <= j < len(found):
                near = found[j].path
                w = side * (1 + _shared(b.path, near)) / (1 + max(len(b.path), len(near)))
                total, weight = total + w * share[near] * fused[near], weight + w
        smoothed.setdefault(b.path, []).append(total / weight)
    return {path: share[path] * sum(v) / len(v) for path, v in smoothed.items()}


def content_paths(found: list[Block]) -> set[tuple]:
    """The paths whose blocks are the page's content."""
    values = path_values(found)
    most = max(values.values(), default=0.0)
    core = {p for p, v in values.items() if v >= THRESHOLD * most}
    mass: dict[tuple, float] = {}
    chars: dict[tuple, int] = {}
    linked: dict[tuple, int] = {}
    for b in found:
        chars[b.path] = chars.get(b.path, 0) + b.counts[2]
        linked[b.path] = linked.get(b.path, 0) + b.counts[2] - b.counts[0]
    for p in core:
        own = values[p] * (chars[p] - linked[p])
        for depth in range(len(p)):  # below the block's own element nothing is a root
            mass[p[:depth]] = mass.get(p[:depth], 0.0) + own
    whole = sum(values[p] * (chars[p] - linked[p]) for p in core)
    root = max((p for p, m in mass.items() if m >= HELD * whole), key=len, default=())
    for kind in ("main", "article"):  # such an element around the root is the root
        for depth in range(len(root), 0, -1):
            if root[depth - 1][0].split(".")[0] == kind:
                root = root[:depth]
                break
    if not root:  # the page itself, but for its containers without any core
        tops = {p[:1] for p in core}
        within = {p for p in values if p[:1] in tops or (p and p[0][0].split(".")[0] not in (*CONTAINERS, "header", "form"))}
        return core | {p for p in within if not any(other or head for _, other, head in p) and 3 * linked[p] <= 2 * chars[p]}
    clean = lambda steps: not any(other for _, other, _ in steps)
    below = {p for p in values if p[: len(root)] == root and clean(p[len(root) :]) and 3 * linked[p] <= 2 * chars[p]}
    first = next((i for i, b in enumerate(found) if b.path in below), 0)
    around = root[:-1]
    beside = (b.path for b in found[:first] if b.path and b.path[: len(around)] == around)
    titles = {p for p in beside if p[-1][0] in ("h1", "h2") and clean(p[len(around) :]) and (around or not any(head for *_, head in p))}
    return {p for p in core if p[: len(root)] == root or values[p] >= ELSEWHERE * most} | below | titles


def main_text(page: str | None) -> str:
    found = with_forms(blocks(page or ""))
    kept = content_paths(found)
    return "\n".join(" ".join("".join(b.parts).split()) for b in found if b.path in kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages(page_id, url, html)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
