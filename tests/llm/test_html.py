"""Main text: paths decide, and the plain statement of the method gives the same on whole pages."""

import html as entities
import math
import random
import re

import pytest

from lexmill.llm import html
from lexmill.session import table

P = "Some words of the article, quite a few of them, so that it reads like prose. And another sentence follows here, with a comma."
ART = f"<h1>The title of it</h1><p>{P}</p><h2>Short head</h2><ul><li>one</li><li>two</li></ul><p>{P}</p><p>Short.</p>"
TEXT = f"The title of it\n{P}\nShort head\none\ntwo\n{P}\nShort."


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout no-sidebar'><article>{ART}</article></div><div class='sidebar'><p>{P}</p></div>",
        f"<div id='main-content' class='with-menu'>{ART}</div><footer>{P}</footer>",
        f"<div class='content meta'>{ART}</div>",
        f"<header><h1>The site</h1></header><div class='post'>{ART}<div class='share'>Share, or not.</div></div><div class='comments'><p>{P}{P}</p></div>",
        f"<main><div class='entry-header'><h1>The title of it</h1></div><section>{ART.split('</h1>')[1]}</section><section class='related'><p>{P}</p></section></main>",
        f"<div class='post'><header class='post-header'><h1>The title of it</h1></header><div class='body'>{ART.split('</h1>')[1]}</div></div>",
        f"<nav>{P}</nav><div>{ART}<div class='ad'>Buy, now.</div></div><aside>{P}</aside><form>{P}</form>",
    ],
)
def test_articles_stay_whole_and_nothing_else(page):
    assert html.main_text(f"<html><body>{page}</body></html>") == TEXT


def test_a_sign_that_begins_no_tag_is_text():
    assert html.main_text(f"<div><p>if a<b then {P}</p><p>1 < 2 &amp; 3 > 2</p></div>") == f"if a<b then {P}\n1 < 2 & 3 > 2"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<form id='aspnetForm'><div id='page'>{ART}</div></form><div>Short, outside.</div>", TEXT),
        (f"<form id='f'><table><tr><td>{P}</td></tr><tr><td>{P}</td></tr></table></form>", f"{P}\n{P}"),
        (f"<article><div class='legal-analysis'><p>{P}</p></div><p>{P}</p></article>", f"{P}\n{P}"),
        (f"<main><p>{P}</p><div class='reply-all-chapter'><p>{P}</p></div><div class='comment-list'><p>{P}</p></div></main>", f"{P}\n{P}"),
        (f"<div><p>Area <math><mi>a</mi><mo>=</mo><msup><mi>r</mi><mn>2</mn></msup><annotation>a=r^2</annotation></math> holds.</p><p>{P}</p></div>", f"Area a=r2 holds.\n{P}"),
        (f"<p>{P}</p><p>short.</p><ul><li>item one</li></ul><h2>Head</h2><p>{P}</p><div><p>Some menu</p></div>", f"{P}\nshort.\nitem one\nHead\n{P}"),
        (f"<article>{ART}<form class='login'><p>Your name, please.</p><input></form></article>", TEXT),
    ],
)
def test_what_only_looks_like_something_else_stays(page, text):
    assert html.main_text(f"<html><body>{page}</body></html>") == text == by_hand(f"<html><body>{page}</body></html>")


def test_deep_nesting_is_flat_work():
    page = "<div>" * 5_000 + "".join(f"<p>{P}</p></div>" for _ in range(5_000))
    assert html.main_text(page).count(P) == 5_000


def test_without_the_ratios_the_result_is_another(monkeypatch, spark, small):
    pages = [r.html for r in table(spark, small, "pages").select("html").collect()]
    with_ratios = [html.main_text(h) for h in pages]
    monkeypatch.setattr(html, "path_values", lambda found: dict.fromkeys((b.path for b in found), 1.0))
    assert sum(html.main_text(h) != x for h, x in zip(pages, with_ratios, strict=True)) > 0.9 * len(pages)


class Plain:
    def __init__(self, path):
        self.parts, self.path, self.chars, self.marks, self.all = [], path, 0, 0, 0

    @property
    def counts(self):
        return [self.chars, self.marks, self.all]


def read_by_hand(page):
    """The blocks of a well-formed page, by a tokeniser of its own: a flat list of signs and texts, and what is open at each."""
    skipped = set("script style noscript template textarea iframe svg select canvas annotation annotation-xml head nav footer aside button dialog menu".split())
    plain = html.INLINE | (skipped - set("head nav footer aside button dialog menu".split()))
    out, opened, broken = [], [], True
    page = re.sub(r"<(script|style|noscript|template|textarea|iframe|svg|select|canvas|annotation)\\b.*?</\\1\\s*>".replace("\\\\", "\\"), "", page, flags=re.S | re.I)
    for sign in re.findall(r"<!--.*?-->|<[!?][^>]*>|</?[A-Za-z][^<>]*>|[^<]+|<", page, re.S):
        if sign.startswith(("<!", "<?")):
            continue
        tag = re.fullmatch(r"<(/?)([A-Za-z][^\s/>]*)(.*?)(/?)>", sign, re.S)
        if not tag:
            if any(name in skipped for name, _ in opened):
                continue
            told = entities.unescape(sign)
            if broken and told.strip():
                path = [step for name, step in opened if name not in plain and name not in ("html", "body")]
                out.append(Plain(tuple(path[: html.DEEP])))
                broken = False
            if not broken:
                out[-1].parts.append(told)
                n = len(told.strip())
                out[-1].all += n
                out[-1].chars += 0 if any(name == "a" for name, _ in opened) else n
                out[-1].marks += sum(c in ".,;:!?…。、，！？；：" for c in told.strip())
            continue
        name = tag[2].lower()
        if name == "br":
            if not broken and not any(n in skipped for n, _ in opened):
                out[-1].parts.append(" ")
        elif tag[1]:
            broken |= name not in plain
            while opened and opened.pop()[0] != name:
                pass
        elif name in html.VOID or tag[4]:
            broken |= name == "hr"
        else:
            broken |= name not in plain
            classes, other, head = html.marks_of(tag[3])
            opened.append((name, (name + (classes if name in html.CONTAINERS else ""), other, head or name == "header")))
    return out


def forms_by_hand(found):
    whole = sum(b.chars for b in found)
    paths = [b.path for b in found]
    for b in found:
        held = lambda top: sum(x.chars for x, p in zip(found, paths, strict=True) if p[: len(top)] == top)
        b.path = tuple((n, o or (n == "form" and held(b.path[: i + 1]) < 0.5 * whole), h) for i, (n, o, h) in enumerate(b.path))
    return found


def by_hand(page):
    """The method, stated plainly: every block looks at every other."""
    found = forms_by_hand(read_by_hand(page or ""))
    named = lambda steps, k: any(s[k] for s in steps)
    share = lambda b: html.PENALTY if named(b.path, 1) or named(b.path, 2) else 1.0
    same = lambda b: [x for x in found if x.path == b.path]
    begins = lambda p, q: sum(all(x == y for x, y in zip(p[:k], q[:k], strict=True)) for k in range(1, min(len(p), len(q)) + 1))
    chars = lambda b: sum(x.counts[0] for x in same(b)) / len(same(b))
    fused = lambda b: math.sqrt(chars(b) * (1 + sum(x.counts[1] for x in same(b)) / len(same(b))))
    smooth = []
    for i, b in enumerate(found):
        near = [found[j] for j in (i - 1, i + 1) if 0 <= j < len(found)]
        w = [0.25 * (1 + begins(b.path, x.path)) / (1 + max(len(b.path), len(x.path))) for x in near]
        smooth.append((0.5 * fused(b) + sum(a * fused(x) * share(x) for a, x in zip(w, near, strict=True))) / (0.5 + sum(w)))
    value = [share(b) * sum(s for s, x in zip(smooth, found, strict=True) if x.path == b.path) / len(same(b)) for b in found]
    core = [v >= 0.4 * max(value) * (1 - 1e-12) for v in value]
    mass = lambda p: sum(v * b.counts[0] for v, k, b in zip(value, core, found, strict=True) if k and (not p or len(b.path) > len(p)) and b.path[: len(p)] == p)
    roots = [b.path[:d] for b in found for d in range(len(b.path)) if mass(b.path[:d]) >= 0.9 * mass(()) * (1 - 1e-12)]
    root = max(roots, key=len, default=())
    for kind in ("main", "article"):
        around = [d for d in range(1, len(root) + 1) if root[d - 1][0].split(".")[0] == kind]
        root = root[: max(around)] if around else root
    links = lambda b: 3 * sum(x.counts[2] - x.counts[0] for x in same(b)) <= 2 * sum(x.counts[2] for x in same(b))
    tops = {b.path[:1] for b, k in zip(found, core, strict=True) if k}
    loose = [not root and (b.path[:1] in tops or (b.path and b.path[0][0].split(".")[0] not in ("article", "div", "main", "section", "td", "header", "form"))) and not named(b.path, 1) and not named(b.path, 2) and links(b) for b in found]
    below = [bool(root) and b.path[: len(root)] == root and not named(b.path[len(root) :], 1) and 3 * sum(x.counts[2] - x.counts[0] for x in same(b)) <= 2 * sum(x.counts[2] for x in same(b)) for b in found]
    first, above = below.index(True) if True in below else 0, root[:-1]
    titles = {b.path for b in found[:first] if root and b.path and b.path[: len(above)] == above and b.path[-1][0] in ("h1", "h2") and not named(b.path[len(above) :], 1) and (above or not named(b.path, 2))}
    core = [k and (not root or b.path[: len(root)] == root or v >= 0.6 * max(value)) for k, v, b in zip(core, value, found, strict=True)]
    kept = [k or w or o or b.path in titles for k, w, o, b in zip(core, below, loose, found, strict=True)]
    return "\n".join(" ".join("".join(b.parts).split()) for k, b in zip(kept, found, strict=True) if k)


def test_whole_pages_equal_the_plain_statement(spark, small):
    rows = table(spark, small, "pages").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in html.extract_main_text(table(spark, small, "pages")).collect()}
    assert got == {r.page_id: by_hand(r.html) for r in rows}


def test_random_pages_equal_the_plain_statement():
    r = random.Random(3)

    def element(depth):
        if depth == 0 or r.random() < 0.4:
            text = " ".join(r.choice(["word", "and", "long,", "stop.", "<a>link text</a>", "<b>bold</b>", "&amp;"]) for _ in range(r.choice([1, 3, 8, 30])))
            return f"<{(t := r.choice(['p', 'li', 'h1', 'h2', 'td', 'span']))}>{text}</{t}>"
        t = r.choice(["div", "section", "article", "main", "ul", "header", "nav", "form"])
        name = r.choice(["", "", " class=ad", " class='post x'", " id=comments", " class=header", " class=has-menu", " class=legal-analysis", " class=comment-list"])
        return f"<{t}{name}>" + "".join(element(depth - 1) for _ in range(r.randrange(1, 6))) + f"</{t}>"

    for _ in range(300):
        page = "<html><body>" + "".join(element(3) for _ in range(r.randrange(1, 5))) + "</body></html>"
        assert html.main_text(page) == by_hand(page), page


def test_a_very_long_page():
    page = f"<div><nav>{P * 1000}</nav><article>" + f"<p>{P}</p>" * 20_000 + "</article></div>"
    assert html.main_text(page) == "\n".join([P] * 20_000)
