"""HTML extraction by line-block distribution.

``extract`` adds the main text of a page. Method: markup is stripped into lines, one
for each block of text; a line weighs as much as it has text outside links. The weights are summed over windows of
``WINDOW`` lines; where the sum passes a threshold (``SHARE`` of the page's highest, at
most ``ENOUGH`` characters) the text surges, where it falls below it dives. The text from a surge to
its dive is kept, if it weighs ``SHARE`` of the heaviest such run. Windows reach from an element (``SECTIONS``) into those around
it and in it, not into others beside it, and a light line doesn't dive in the element in which the text
before or after it surged, or between two surges around it. Where the lines in articles are trusted (below), articles are one story:
windows reach over their parts, nothing of them dives once any of it surges, and the share is that of all of them.

Tags and names only take weight away. Lines of boilerplate elements (``SKIPPED`` tags, ``ROLES``, hidden ones, classes or ids that are made of ``NAMES``
and ``NEUTRAL`` words alone) weigh nothing and are in no run; but an element that holds most of the text of the page's
articles, or is named only and holds most of the page's text (or is a form that does), weighs what it weighs (a discussion only if there is next to nothing
else). If the lines in ``article`` and ``main`` outweigh what surges outside them, those outside weigh ``OUTSIDE`` of what they did.

Character references are decoded, white space in a block becomes one space, blocks
are joined by an empty line; nothing else is changed, and no page is cut off.

Defined results: null and empty pages have an empty text, and so have those that hold
nothing but boilerplate; plain text without markup is one block. A boilerplate
element without its end tag reaches to the next block. Scripts, styles and comments
without an end reach to the end of the page. Columns of the input stay, but for one
with the name of the output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SHARE, ENOUGH, OUTSIDE = 3, 0.2, 80, 0.25
#: Elements whose text isn't shown or isn't prose.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object")
SKIPPED = {"nav", "footer", "aside", "form", "head", "header", "menu", "button", "select", "dialog", "canvas", "audio", "video", "datalist", "fieldset", "label", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status"}
NAMES = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "commentlist", "consent", "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus", "footer", "gdpr", "header", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "paywall", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related",
    "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola",
    "toolbar", "topbar", "widget",
}
#: Words that stand beside a name without making it another: top-ad, related-posts, comments-area.
NEUTRAL = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "container", "content", "div", "form", "global", "google", "group", "holder", "inner", "item", "items", "js", "left", "link", "links", "list",
    "main", "mobile", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "side", "site", "slot", "stories", "story", "sub", "the", "title", "top", "unit", "wrap", "wrapper",
}
#: Names that a page's own text isn't taken for if there is any other.
DISCUSSION = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond"}
#: Headers in an article belong to it.
OF_PAGE = {"header"}
WHOLE = {"html", "body", "article", "main"}
#: Elements that part a page into sections.
SECTIONS = {"div", "section", "article", "main", "td", "th"}
#: Tags that may stand around a whole page.
AROUND = {"form", "fieldset"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that the next block ends.
OPEN_ENDED = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^<>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>'\"]++|\"[^\"]*+\"|'[^']*+'|['\"])*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_WORD = re.compile(r"[a-z]+")


class Section(NamedTuple):
    """An element as the places of its tags, and those of the element around it."""

    start: int
    end: int
    outer: tuple[int, int]

    def holds(self, other: Section) -> bool:
        return self.start <= other.start and other.end <= self.end


class Line(NamedTuple):
    text: str
    weight: float
    section: Section
    in_article: bool  # or in main
    in_story: bool  # in an article proper


def _hidden(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's tag or attributes make it boilerplate."""
    if name in WHOLE:
        return False
    if name in SKIPPED:
        return not (in_article and name in OF_PAGE)
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" and name not in INLINE:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _names(name: str, attributes: str, in_article: bool) -> set[str]:
    """The boilerplate names in an element's classes and id, of those that are made of such names and neutral words alone."""
    out: set[str] = set()
    if name in WHOLE or not attributes or attributes.isspace():
        return out
    for key, value in _ATTRIBUTE.findall(attributes):
        if key.lower() not in ("class", "id"):
            continue
        for one in value.strip("\"'").lower().split():
            words = _WORD.findall(one)
            joined = NAMES.intersection(map(str.__add__, words, words[1:]))  # side-bar is sidebar
            if joined:
                words = [w for w in words if not any(w in x for x in joined)] + [*joined]
            found = NAMES.intersection(words)
            if found and all(w in NAMES or w in NEUTRAL for w in words) and (found - OF_PAGE or not in_article):
                out |= found
    return out


def _weights(tokens: list, closed: dict[int, int]) -> tuple[list[int], list[int]]:
    """Running sums of the text outside links up to each token: of all, and of what is in articles."""
    every, inside, total, own, articles, links = [], [], 0, 0, 0, 0
    for i, (before, name, is_end, _) in enumerate(tokens):
        if before and not links:
            n = len(before.strip())
            total += n
            own += n if articles else 0
        every.append(total)
        inside.append(own)
        if name in ("article", "main"):
            if is_end or i in closed:
                articles = max(0, articles + (-1 if is_end else 1))
        elif name == "a":
            links = 0 if is_end else 1
    return every, inside


def lines(html: str) -> list[Line]:
    """The lines of a page; blank ones stand for boilerplate."""
    tokens, at = [], 0  # (text before, name, is end, attributes)
    for m in _TOKEN.finditer(html):
        tokens.append((html[at : m.start()], (m["name"] or "").lower(), bool(m["end"]), m["attrs"] or ""))
        at = m.end()
    tokens.append((html[at:], "", False, ""))
    ends: dict[str, list[int]] = {}
    closed: dict[int, int] = {}  # start tag -> end tag
    for i, (_, name, is_end, _) in enumerate(tokens):
        if name and name not in VOID:
            if not is_end:
                ends.setdefault(name, []).append(i)
            elif ends.get(name):
                closed[ends[name].pop()] = i
    every, inside = _weights(tokens, closed)
    page = Section(-1, len(tokens), (-1, -1))
    sections = [page]
    out: list[Line] = []
    line: list[str] = []
    weight = articles = stories = links = 0
    skip_to = -1  # up to this token all is boilerplate
    skip_block = False  # up to the next block

    def flush() -> None:
        nonlocal weight
        if text := " ".join("".join(line).split()):
            out.append(Line(text, weight, sections[-1], articles > 0, stories > 0))
        line.clear()
        weight = 0

    def bulk(sums: list[int], i: int, to: int) -> bool:
        return 2 * (sums[to] - sums[i]) > sums[-1]

    for i, (before, name, is_end, attributes) in enumerate(tokens):
        if before and i > skip_to and not skip_block:
            text = unescape(before)
            line.append(text)
            if not links:
                weight += len(text.strip())
        if not name:
            continue
        if name not in INLINE:
            if i > skip_to:
                flush()
            skip_block = False
        elif name == "br":
            line.append(" ")
        while sections[-1].end <= i:
            sections.pop()
        if i <= skip_to:
            continue
        if name in ("article", "main"):
            articles = max(0, articles + (-1 if is_end else 1))
            if name == "article":
                stories = max(0, stories + (-1 if is_end else 1))
        elif name == "a":
            links = 0 if is_end else 1
        if is_end or name in VOID:
            continue
        hidden, names = _hidden(name, attributes, articles > 0), _names(name, attributes, articles > 0)
        if hidden or names:
            whole = i in closed and not (name in OPEN_ENDED and _next_block(tokens, i) < closed[i])
            to = closed[i] if whole else min(_next_block(tokens, i), len(tokens) - 1)
            held = bulk(inside, i, to) and not articles or (name in AROUND or not hidden) and bulk(every, i, to)
            if not held or names & DISCUSSION and every[-1] - (every[to] - every[i]) >= ENOUGH:
                if whole:
                    skip_to = to
                else:
                    skip_block = True
                out.append(Line("", 0, sections[-1], articles > 0, stories > 0))
                continue
        if name in SECTIONS and i in closed:
            sections.append(Section(i, closed[i], sections[-1][:2]))
    flush()
    return out


def _next_block(tokens: list, i: int) -> int:
    return next((k for k in range(i + 1, len(tokens)) if tokens[k][1] and tokens[k][1] not in INLINE), len(tokens))


def main_text(html: str | None) -> str:
    found, trusted = lines(html or ""), False
    if any(x.in_article and x.text for x in found):
        outside = [x._replace(text="", weight=0) if x.in_article else x for x in found]
        if sum(x.weight for x in found if x.in_article) >= sum(found[i].weight for i in kept(outside)):
            found, trusted = [x if x.in_article else x._replace(weight=OUTSIDE * x.weight) for x in found], True
    return "\n\n".join(found[i].text for i in kept(found, trusted))


def _related(a: Section, b: Section) -> bool:
    return a is b or a.holds(b) or b.holds(a)


def kept(found: list[Line], trusted: bool = False) -> list[int]:
    """Places of the lines from each surge to its dive, without the light runs. trusted: whether articles are one story, whatever parts they have."""
    half = WINDOW // 2
    one = lambda x, y: trusted and x.in_story and y.in_story
    sums = [sum(x.weight for x in found[max(0, i - half) : i + half + 1] if x.weight and (_related(x.section, y.section) or one(x, y))) for i, y in enumerate(found)]
    threshold = min(ENOUGH, SHARE * max(sums, default=0))
    surges = [i for i, (x, s) in enumerate(zip(found, sums, strict=True)) if x.weight and s >= threshold]
    story = trusted and any(found[i].in_story for i in surges)
    on = set(surges)
    at = 0  # of the next surge
    for i, line in enumerate(found):
        while at < len(surges) and surges[at] <= i:
            at += 1
        if i not in on and line.text:
            before, after = (found[surges[k]].section if 0 <= k < len(surges) else None for k in (at - 1, at))
            here = line.section
            beside = {before and before[:2], after and after[:2]}
            around = before and after and (before.holds(here) and after.holds(here) or before.outer == here.outer == after.outer)
            if around or line.weight and here[:2] in beside or story and line.in_story:
                on.add(i)
    runs: list[list[int]] = [[]]  # the first is the story's
    last = -1  # line with a text
    for i, line in enumerate(found):
        if i in on:
            if story and line.in_story:
                runs[0].append(i)
            elif len(runs) > 1 and last == runs[-1][-1] and (_related(found[last].section, line.section) or found[last].section.outer == line.section.outer):
                runs[-1].append(i)
            else:
                runs.append([i])
        if line.text:
            last = i
    weights = [sum(found[i].weight for i in run) for run in runs]
    return sorted(i for run, weight in zip(runs, weights, strict=True) if weight >= SHARE * max(weights) for i in run)


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py()) for page in batch], pa.string())

    return df.withColumn(out, of(F.col(html)))
