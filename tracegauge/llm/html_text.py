"""Main text of web pages by consensus of their hosts.

A page is read into blocks of text, each with its container: the path of tags and classes from the root,
in generalised form (digits become 0, positions are left out). Containers of a page are scored by
the text they hold outside links; the best one is widened to the boxes around it in which it makes up most of
the text. Every page votes for its container; votes are added up by host and the path with the most pages
wins. Each page is then extracted again with its host's winning path, with headings and paragraphs that
stand beside it in the body. A page without that path (or without a host) falls back to its own container.
Where the winner holds less than half as much as a page's own container, and two pages of the host or more
voted for that, the page gets the text of both.

Defined results: null or empty html gives an empty text. A null or unparsable url is no host. Repeated rows
vote and are extracted once each. Unclosed tags, stray end tags, comments and pages that break off
in a tag are read as browsers read them. Other columns are ignored. Block text keeps its words as they
are: character references are decoded, white space becomes one space, blocks are joined by a newline.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.llm.common import stored

#: Elements whose content is never text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "xmp", "noembed", "noframes"}
#: Elements that are page furniture.
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset", "label", "option"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a line of text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Elements that a following block element closes when they are open in the same container.
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
#: Words in a class or id that mark menus, notices, adverts, comments and the like.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|alert|alerts|advert\w*|adbox|banner|breadcrumbs?|footer|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pager|pagination|popup|promo\w*|related|share|sharing|sidebar|sidebars|side|signup|skip|social|sponsor\w*|subscribe|subscription|toolbar|topbar|widget\w*)(?:[\s_-]|$)",
    re.I,
)
#: The same for comments and consent, which are furniture even where they are most of a page.
NEVER_TEXT = re.compile(r"(?:^|[\s_-])(?:comments?\d*|commentlist|commentform|cookies?|consent|disqus|gdpr|replies|reply|respond)(?:[\s_-]|$)", re.I)
#: Tags that end an <svg> they stand in.
_OUT_OF_SVG = re.compile(r"</svg\s*>|<foreignobject\b|<(?:p|div|h[1-6]|ul|ol|dl|table|pre|blockquote|span|img|body)(?=[\s/>])", re.I)
#: A header above the article; inside it a header is part of the text.
HEADER = re.compile(r"(?:^|[\s_-])header(?:[\s_-]|$)", re.I)
#: Roles with the same meaning.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|\Z)""", re.I)
_MAIN = re.compile(r"/(?:article|main)(?:[./]|$)")
#: The body, and headings and paragraphs directly in it.
_TOP = re.compile(r"(?:/html(?:\.[^/]*)?)?(?:/body(?:\.[^/]*)?)?")
_BESIDE = re.compile(_TOP.pattern + r"/(?:h[1-6]|p)(?:\.[^/]*)?")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "path", "skip", "link", "named")

    def __init__(self, tag: str, path: str, skip: bool, link: bool, named: tuple[int, ...] = ()) -> None:
        #: ``named`` has a number for each element around the text whose class or id marks furniture.
        self.tag, self.path, self.skip, self.link, self.named = tag, path, skip, link, named


def _child(parent: Node, tag: str, attributes: str, number: int) -> Node:
    if tag in INLINE and not (parent.skip or attributes):
        return Node(tag, parent.path, False, parent.link or tag == "a", parent.named)
    marked, skip, names, main = False, parent.skip or tag in RAW or tag in ASIDE, "", bool(_MAIN.search(parent.path))
    if attributes and not skip:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                if tag not in ("body", "html", "article", "main"):
                    skip = skip or bool(NEVER_TEXT.search(value))
                    marked = marked or bool(FURNITURE.search(value) or (not main and HEADER.search(value)))
                if key == "class":
                    names = "." + ".".join(sorted(_DIGITS.sub("0", value).split()))
            elif key == "role":
                skip = skip or value.lower() in ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                skip = True
    if tag == "header" and not main:
        skip = True
    if tag in INLINE:
        return Node(tag, parent.path, skip or marked, parent.link or tag == "a", parent.named)
    return Node(tag, f"{parent.path}/{tag}{names}", skip, parent.link or tag == "a", (*parent.named, number) if marked else parent.named)


def _without_named(found: list[tuple[str, str, int]], around: list[tuple[int, ...]]) -> list[tuple[str, str, int]]:
    """The blocks outside elements that are furniture by name. One with most of the page's text outside links is not."""
    if not any(around):
        return found
    total, held = 0, {}
    for (_, text, linked), named in zip(found, around):
        total += len(text) - linked
        for number in named:
            held[number] = held.get(number, 0) + len(text) - linked
    return [block for block, named in zip(found, around) if all(2 * held[number] > total for number in named)]


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(path of the block, text, characters in links) of each block outside furniture, in page order."""
    out: list[tuple[str, str, int]] = []
    around: list[tuple[int, ...]] = []
    stack, parts, linked, place, named = [Node("", "", False, False)], [], 0, "", ()

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((place, text, linked))
                around.append(named)
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal place, linked, named
        top = stack[-1]
        if not raw or top.skip:
            return
        if not parts:
            if raw.isspace():
                return
            place, named = top.path, top.named
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if top.link:
            linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[4] == "":  # broken off inside a tag: no tag
            break
        if tag == "br" or tag == "wbr":
            if tag == "br" and parts:
                parts.append(" ")
            continue
        if tag not in INLINE and tag not in RAW:
            end_block()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag in INLINE and stack[depth].tag not in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and tag not in RAW and len(stack) > 1:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth].tag
                if open_tag == "p" or (open_tag in SELF_CLOSING and open_tag == tag):
                    del stack[depth:]
                    break
                if open_tag not in INLINE:
                    break
        node = _child(stack[-1], tag, m[3], m.start())
        if tag == "svg":
            if not m[3].endswith("/") or re.search(r"=\s*[^\s\"']+/$", m[3]):
                end = _OUT_OF_SVG.search(page, at)
                if end and end[0].lower() == "<foreignobject":
                    end = re.compile(r"</svg\s*>", re.I).search(page, at)
                at = n if end is None else end.end() if end[0][1] == "/" else end.start()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if not m[3].endswith("/") or tag not in ("path", "use"):
            stack.append(node)
    end_block()
    return _without_named(out, around)


def best_container(found: list[tuple[str, str, int]]) -> tuple[str, float] | None:
    """The generalised container of a page with the highest score, and the score.

    Every block adds its characters outside links to its nearest containers, fully to the element that
    holds the block and a little less to each one above, so that the smallest container that holds all of
    the main text wins. Elements named article or main count more."""
    scores: dict[str, float] = {}
    for path, text, linked in found:
        worth, parts = max(0.0, len(text) - 2.0 * linked), path.split("/")
        for depth in range(len(parts) - 1, 0, -1):
            container = "/".join(parts[:depth])
            scores[container] = scores.get(container, 0.0) + worth * 0.9 ** (len(parts) - 1 - depth)
    if not scores:
        return None
    named = lambda c: 2.0 if c and _MAIN.search(c[c.rindex("/") :]) else 1.0
    best = max(scores, key=lambda c: (scores[c] * named(c), -len(c), c))
    best = _widened(found, best)
    return best, scores.get(best, 0.0)


def _worth(found: list[tuple[str, str, int]], container: str) -> int:
    inside = container + "/"
    return sum(max(0, len(text) - 2 * linked) for path, text, linked in found if path.startswith(inside) or path == container)


def _widened(found: list[tuple[str, str, int]], best: str) -> str:
    """The outermost box around ``best``, below the body, that adds text to it and of which it has at least half."""
    own, wide, held, outer = _worth(found, best), best, _worth(found, best), best
    while outer.count("/") > 1 and not _TOP.fullmatch(outer):
        outer = outer[: outer.rindex("/")]
        if not outer or _TOP.fullmatch(outer):
            break
        worth = _worth(found, outer)
        if 2 * own < worth:
            break
        if worth > held:
            wide, held = outer, worth
    return wide


def text_under(found: list[tuple[str, str, int]], container: str, *others: str) -> str:
    """The blocks in the containers, in page order, and headings and paragraphs beside them in the body."""
    containers = (container, *others)
    inside = tuple(c + "/" for c in containers)
    held = [path.startswith(inside) or path in containers for path, _, _ in found]
    if not any(held):
        return ""
    return "\n".join(text for (path, text, linked), own in zip(found, held) if own or (2 * linked < len(text) and _BESIDE.fullmatch(path)))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and the ``container`` used, for every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]+)", 1))).withColumn("host", F.when(F.col("host") != "", F.col("host")))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, weights = [], [], []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best = best_container(blocks(text))
                if best:
                    hosts.append(host)
                    paths.append(best[0])
                    weights.append(best[1])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.float64())], ["host", "path", "weight"])

    votes = rows.filter(F.col("host").isNotNull() & F.col("html").isNotNull()).select("host", "html").mapInArrow(vote, "host string, path string, weight double")
    tally = votes.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), F.desc("weight"), "path"))
    ranked = tally.withColumn("rank", rank).filter("rank = 1 or pages > 1")
    others = F.collect_set(F.when(F.col("rank") > 1, F.col("path"))).alias("others")
    winners = stored(ranked.groupBy("host").agg(F.max(F.when(F.col("rank") == 1, F.col("path"))).alias("winner"), others), "winners")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, used = [], []
            for text, winner, others in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                found = blocks(text) if text else []
                own = text_under(found, winner) if winner is not None else ""
                if not own or others:
                    best = best_container(found)
                    if best and not own:
                        winner, own = best[0], text_under(found, best[0])
                    elif best and best[0] in others and 2 * _worth(found, winner) < _worth(found, best[0]):
                        winner, own = best[0], text_under(found, winner, best[0])
                texts.append(own)
                used.append(winner if own else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(used, pa.string())], ["page_id", "url", "text", "n_chars", "container"])

    id_type = rows.schema["page_id"].dataType.simpleString()
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "winner", "others").mapInArrow(read, f"page_id {id_type}, url string, text string, n_chars long, container string")
