"""Main text of web pages by deducing each site's template.

The tokens of a page are its elements, told apart by their path, and its blocks
of text with their path. Over the pages of one host every token has an
occurrence vector, its number in each page. Tokens with equal vectors are one
equivalence class. A large class in most pages, whose tokens have one order and
nesting in all of them, is part of the template. The slots are what the template
leaves open between its tokens; those with prose make up the article, and texts
of the template are left out, also inside it.

Vectors are never gathered: two sums over the pages, of counts times a hash of
the page, are equal if the vectors are. So the largest host is aggregated like
any other, and pages are read, but not shuffled, unless the hosts' templates
grow too large for Spark to broadcast.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import slices

# Elements of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
CONTAINERS = {"article", "body", "center", "div", "main", "section", "table", "tbody", "td", "tr"}
ASIDE = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "embed", "footer", "form", "head", "iframe", "input",
    "label", "menu", "nav", "noscript", "object", "option", "script", "select", "style", "svg", "template", "textarea",
    "title", "video", "xmp",
}
# Words of class, id and role that hint at parts around an article.
SIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "disclaimer", "footer", "gdpr", "header", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination",
    "paywall", "popup", "promo", "promoted", "promotion", "related", "search", "share", "sharing", "sidebar", "signup",
    "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
REPLY_WORDS = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond", "responses"}
# Words of both sets that alone name parts of articles too.
AMBIGUOUS = {
    "banner", "complementary", "disclaimer", "discussion", "header", "menu", "notice", "promotion", "related", "replies",
    "reply", "responses", "search",
}
# Elements that an opening tag of the key ends, if they are open and nothing of ``_SCOPE`` lies between.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXT_BLOCKS = {"p", *_HEADINGS}
_SCOPE = {"ul", "ol", "dl", "table", "body", "article", "section", "div", "main", "select"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"(?i)\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_HIDDEN = re.compile(r"(?i)(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)")
_WORDS = re.compile(r"[a-z]+")

SHARE = 0.6
MOST = 0.5
MIN_PAGES = 2
MIN_CLASS = 3
MIN_TEXT = 4
SLOT_SHARE = 0.1
MAX_DEPTH = 200


def _role(tag: str, attributes: str, inside_article: bool) -> tuple[str, bool, int]:
    """Name of an element in paths, whether what it holds is outside of the article, and what its words hint.

    The hint is 2 if a whole class, id or role is made of words for parts around an article, 1 if it holds one.
    """
    name, hint = tag, 0
    if attributes and "=" in attributes:
        for key, value in _NAMED.findall(attributes):
            split = _WORDS.findall(value.lower())
            if split and key.lower() != "role" and name == tag:
                name = f"{tag}.{'-'.join(split[:3])}"
            for whole in value.lower().strip("\"'").split():
                parts = _WORDS.findall(whole)
                n = sum(w in SIDE_WORDS or w in REPLY_WORDS for w in parts)
                if n:
                    sure = n == len(parts) and not (inside_article and n == 1 and AMBIGUOUS.intersection(parts))
                    hint = max(hint, 1 + sure)
    if tag in ("html", "body"):
        return tag, False, 0
    if tag in ("article", "main"):
        return name, False, 0
    if tag == "header":
        return name, not inside_article, 0
    if tag in _TEXT_BLOCKS or inside_article and (hint == 1 or tag == "section"):
        hint = 0
    return name, tag in ASIDE or bool(attributes and _HIDDEN.search(attributes)), hint


@dataclass(slots=True)
class Element:
    """An element with its place among the page's events, the characters of text below it, and what its words hint."""

    path: str
    outer: int
    hint: int
    begin: int
    end: int = 0
    chars: int = 0
    article: bool = False
    dropped: bool = False


class Block(NamedTuple):
    path: str
    text: str
    element: int
    place: int
    links: int


def parsed(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks and elements outside of menus and the like, in the order of the page.

    A path names the block elements around a text, from the outermost one.
    Words of class, id and role are hints. An element that they name is left
    out unless it holds an article or most of the page's text.
    """
    blocks: list[Block] = []
    elements: list[Element] = [Element("", -1, 0, 0)]
    # Open elements: tag, path of the block elements up to it, whether it is aside, number of the block element.
    stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]
    text: list[str] = []
    at, size = 0, len(page)
    articles = place = linked = links = 0

    def end_block() -> None:
        nonlocal place, links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                place += 1
                blocks.append(Block(stack[-1][1], joined, stack[-1][3], place, min(links, len(joined))))
        links = 0

    def close(index: int) -> None:
        nonlocal articles, place, linked
        if any(stack[i][3] != stack[i - 1][3] and elements[stack[i][3]].hint for i in range(index, len(stack))):
            end_block()
        for i in range(len(stack) - 1, index - 1, -1):
            tag, _, _, number = stack[i]
            articles -= tag in ("article", "main")
            linked -= tag == "a"
            if number != stack[i - 1][3]:
                place += 1
                elements[number].end = place
        del stack[index:]

    def put(piece: str) -> None:
        nonlocal links
        if not stack[-1][2]:
            text.append(piece)
            if linked:
                links += len(piece)

    while at < size:
        begin = page.find("<", at)
        found = _TAG.match(page, begin) if begin >= 0 else None
        if found is None:
            stop = size if begin < 0 else begin + 1
            put(page[at:stop])
            at = stop
            continue
        if begin > at:
            put(page[at:begin])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        block = tag in BLOCKS
        if closing:
            for index in range(len(stack) - 1, 0, -1):
                if stack[index][0] == tag:
                    if block:
                        end_block()
                    close(index)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br" or tag in ("td", "th"):
            text.append(" ")
        if block:
            end_block()
            if tag not in ("html", "body"):
                _end_open(stack, _TEXT_BLOCKS, close)
        if tag in _ENDS:
            _end_open(stack, _ENDS[tag], close)
        if tag in VOID:
            continue
        if len(stack) > MAX_DEPTH and not block:
            continue
        name, aside, hint = _role(tag, attributes, articles > 0)
        outer = stack[-1]
        path, number = outer[1], outer[3]
        if (block or tag in CONTAINERS) and len(stack) <= MAX_DEPTH:
            path = f"{path}/{name}"
            if hint:
                end_block()
            aside = aside or outer[2]
            if not aside:
                place += 1
                number = len(elements)
                elements.append(Element(path, outer[3], hint, place))
        else:
            # Text of an inline element is part of a block, so its words decide at once.
            aside = aside or hint == 2 or outer[2]
        if tag in ("article", "main"):
            articles += 1
            up = number
            while up > 0 and not aside:
                elements[up].article = True
                up = elements[up].outer
        linked += tag == "a"
        stack.append((tag, path, aside, number))
    end_block()
    close(1)
    return _without_sides(blocks, elements)


def _without_sides(blocks: list[Block], elements: list[Element]) -> tuple[list[Block], list[Element]]:
    """Without the elements that their words name as parts around an article, and what lies in them."""
    total = 0
    for block in blocks:
        total += len(block.text)
        up = block.element
        while up >= 0:
            elements[up].chars += len(block.text)
            up = elements[up].outer
    any_article = elements[0].article or any(e.article for e in elements)
    for element in elements[1:]:
        side = element.hint and not element.article
        if side and not (element.hint == 2 and any_article):
            side = 2 * element.chars <= total
        element.dropped = bool(side) or elements[element.outer].dropped
    return [b for b in blocks if not elements[b.element].dropped], elements


def blocks_of(page: str) -> tuple[list[tuple[str, str]], Counter[str]]:
    """The blocks ``(path, text)`` of a page's own parts, and the number of elements of each path."""
    blocks, elements = parsed(page)
    return [(b.path, b.text) for b in blocks], Counter(e.path for e in elements[1:] if not e.dropped)


def _end_open(stack: list[tuple[str, str, bool, int]], ended: set[str], close) -> None:
    """End the innermost open element of ``ended`` within the present scope."""
    for index in range(len(stack) - 1, 0, -1):
        tag = stack[index][0]
        if tag in ended:
            close(index)
            return
        if tag in _SCOPE:
            return


def prefixes(path: str) -> Iterator[str]:
    at = path.find("/", 1)
    while at > 0:
        yield path[:at]
        at = path.find("/", at + 1)
    if path:
        yield path


def _last_tag(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def text_mark(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))


def page_tokens(page: str) -> list[tuple[str, str, int]]:
    """``(path, text, count)`` of a page: elements (text empty) and blocks, whose text is given by its hash."""
    blocks, elements = parsed(page)
    tokens = Counter((e.path, "") for e in elements[1:] if not e.dropped)
    tokens.update((b.path, text_mark(b.text)) for b in blocks)
    return [(path, text, n) for (path, text), n in tokens.items()]


def class_places(page: str, tokens: dict[tuple[str, str], int]) -> list[tuple[str, str, int, int, int, int]]:
    """``(path, text, begin, end, chars, links)`` of a page's ``tokens``, which are given with their class.

    begin and end are the token's numbers among the begins and ends of its
    class; chars and links count the open text between an element's ends and
    those of the next tokens in it, that is its slots.
    """
    blocks, elements = parsed(page)
    found: dict[tuple[str, str], tuple[int, int]] = {}
    for element in elements[1:]:
        if not element.dropped and (element.path, "") in tokens:
            found[element.path, ""] = element.begin, element.end
    chars, links = Counter(), Counter()
    for block in blocks:
        key = (block.path, text_mark(block.text))
        if key in tokens:
            found[key] = block.place, block.place
            continue
        at = next((p for p in reversed([*prefixes(block.path)]) if (p, "") in found), None)
        if at is not None:
            chars[at] += len(block.text)
            links[at] += block.links
    events: dict[int, set[int]] = {}
    for key, ends in found.items():
        events.setdefault(tokens[key], set()).update(ends)
    rank = {c: {place: i for i, place in enumerate(sorted(places))} for c, places in events.items()}
    rows = []
    for key, (begin, end) in found.items():
        own = rank[tokens[key]]
        path, text = key
        rows.append((path, text, own[begin], own[end], 0 if text else chars[path], 0 if text else links[path]))
    return rows


def template_of(tokens: list[dict], share: float, slot_share: float) -> tuple[str | None, list[tuple[str, str]]]:
    """``(container, fixed)`` from a host's valid tokens and the open text in the slots of each element.

    The slots of an article hold prose and at least ``slot_share`` of the text.
    The container is the article or main element around the largest of them if
    it has ``share`` of the text, else the innermost element around them all.
    """
    paths = {t["path"] for t in tokens if not t["text"] and t["valid"]}
    chars, links = Counter(), Counter()
    for token in tokens:
        at = next((p for p in reversed([*prefixes(token["path"])]) if p in paths), "")
        chars[at] += token["chars"]
        links[at] += token["links"]
    total = chars.total()
    fixed = [(t["path"], t["text"]) for t in tokens if t["text"] and t["valid"]]
    slots = [p for p, n in chars.items() if n and n >= slot_share * total and 2 * links[p] <= n]
    if not slots:
        return None, fixed
    main = max(slots, key=lambda p: (chars[p], p))
    around = [p for p in reversed([*prefixes(main)]) if p in paths and _last_tag(p) in CONTAINERS]
    for path in around:
        inside = sum(n for p, n in chars.items() if (p + "/").startswith(path + "/"))
        if _last_tag(path) in ("article", "main") and inside >= share * total:
            return path, fixed
    for path in around:
        if all((p + "/").startswith(path + "/") for p in slots):
            return path, fixed
    return None, fixed


def with_prose_around(container: str, blocks: list[tuple[str, str]], seen: Counter[str]) -> str:
    """The container, or a single one around it that adds nothing but headings and paragraphs of its own.

    A title, lead or closing paragraph beside a content element belongs to the
    article. An article element is left for a ``main`` alone, and no element for
    ``body``: what stands there belongs to the site.
    """
    while True:
        outer, _, _ = container.rpartition("/")
        tag, own = _last_tag(outer), _last_tag(container)
        if tag not in CONTAINERS or tag == "body" or seen[outer] != 1 or own == "main" or own == "article" and tag != "main":
            return container
        added = [p for p, _ in blocks if p.startswith(outer + "/") and not (p + "/").startswith(container + "/")]
        apart = any(p == outer for p, _ in blocks)
        if apart or not added or any(p.rpartition("/")[0] != outer or _last_tag(p) not in _TEXT_BLOCKS for p in added):
            return container
        container = outer


def main_text(page: str, container: str | None, fixed: set[tuple[str, str]] | frozenset = frozenset()) -> str:
    """The blocks in the container without the template's own texts, joined by line ends.

    If those texts are most of the container, the page is one of several copies and keeps them.
    """
    blocks, seen = blocks_of(page)
    if container is None or container not in seen:
        container = own_container(blocks, seen)
    # Headings stay: articles of one host share them ("Introduction") without their being the site's.
    own = [_last_tag(p) in _HEADINGS or (p, text_mark(t)) not in fixed for p, t in blocks] if fixed else None
    if container:
        container = with_prose_around(container, blocks, seen)
        inside = [i for i, (path, _) in enumerate(blocks) if path == container or path.startswith(container + "/")]
        if inside:
            kept = [i for i in inside if own is None or own[i]]
            if 2 * sum(len(blocks[i][1]) for i in kept) < sum(len(blocks[i][1]) for i in inside):
                kept = inside
            return "\n".join(blocks[i][1] for i in kept)
    return "\n".join(text for i, (_, text) in enumerate(blocks) if own is None or own[i])


def own_container(blocks: list[tuple[str, str]], seen: Counter[str]) -> str:
    """The innermost single container with most of the text, from one page alone."""
    below: Counter[str] = Counter()
    for path, text in blocks:
        for prefix in prefixes(path):
            below[prefix] += len(text)
    total = sum(len(text) for _, text in blocks)
    good = [p for p, n in seen.items() if n == 1 and _last_tag(p) in CONTAINERS and below[p] >= SHARE * total and total]
    return max(good, key=lambda p: (_last_tag(p) in ("article", "main"), p.count("/")), default="")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


TOKENS = "host string, mark_a long, mark_b long, path string, text string, n long"
PLACES = "host string, path string, text string, first int, last int, chars long, links long"


def host_classes(pages: DataFrame, most: float = MOST, min_pages: int = MIN_PAGES, min_class: int = MIN_CLASS) -> DataFrame:
    """``(host, tokens)``: tokens of large classes, those in at least ``most`` of the host's pages, once in each."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            columns: list[list] = [[] for _ in range(6)]
            for host, a, b, page in zip(*(batch.column(n).to_pylist() for n in ("host", "mark_a", "mark_b", "html"))):
                for row in page_tokens(page or ""):
                    for column, value in zip(columns, (host, a, b, *row)):
                        column.append(value)
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["host", "mark_a", "mark_b", "path", "text", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def mark(seed: int) -> Column:
        return F.pmod(F.xxhash64("page_id", "url", F.lit(seed)), F.lit(1 << 24))

    named = pages.select(host_of(F.col("url")).alias("host"), mark(1).alias("mark_a"), mark(2).alias("mark_b"), "html")
    named = named.where("host <> ''")
    sizes = named.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    vectors = (
        named.mapInArrow(tokens, TOKENS)
        .groupBy("host", "path", "text")
        .agg(
            F.count(F.lit(1)).alias("df"),
            F.sum(F.col("n") * F.col("mark_a")).alias("va"),
            F.sum(F.col("n") * F.col("mark_b")).alias("vb"),
            F.max("n").alias("most"),
        )
        .where(f"most = 1 AND df >= {min_pages}")
    )
    frequent = vectors.join(sizes, "host").where(F.col("df") >= most * F.col("pages"))
    classes = frequent.groupBy("host", "va", "vb", "df").agg(F.collect_list(F.struct("path", "text")).alias("tokens"))
    return classes.where(F.size("tokens") >= min_class).groupBy("host").agg(F.collect_list("tokens").alias("classes"))


def host_templates(
    pages: DataFrame,
    most: float = MOST,
    min_pages: int = MIN_PAGES,
    share: float = SHARE,
    min_class: int = MIN_CLASS,
    slot_share: float = SLOT_SHARE,
    min_text: int = MIN_TEXT,
) -> DataFrame:
    """``(host, container, fixed)``: the article's place in each host's template, and the template's own texts.

    A class is the tokens with one vector. It takes part if it has at least
    ``min_class`` tokens, in at least ``most`` of the host's pages and at least
    ``min_pages``, once in each. A token stays in its class if its begin and
    end have the same place among those of the class in every page, so what is
    left has one order and nesting; it must still be ``min_class`` tokens. Texts
    are fixed from ``min_text`` pages on, as fewer may just be copies.
    """
    known = written(host_classes(pages, most, min_pages, min_class), "classes")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            columns: list[list] = [[] for _ in range(7)]
            for host, page, classes in zip(*(batch.column(n).to_pylist() for n in ("host", "html", "classes"))):
                tokens = {(t["path"], t["text"]): i for i, own in enumerate(classes) for t in own}
                for row in class_places(page or "", tokens):
                    for column, value in zip(columns, (host, *row)):
                        column.append(value)
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            names = ["host", "path", "text", "first", "last", "chars", "links"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").join(known, "host")
    placed = (
        rows.mapInArrow(places, PLACES)
        .groupBy("host", "path", "text")
        .agg(
            F.count(F.lit(1)).alias("df"),
            ((F.min("first") == F.max("first")) & (F.min("last") == F.max("last"))).alias("valid"),
            F.sum("chars").alias("chars"),
            F.sum("links").alias("links"),
        )
        .groupBy("host")
        .agg(F.collect_list(F.struct("path", "text", "df", "valid", "chars", "links")).alias("tokens"))
    )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            out = []
            for host, tokens, classes in zip(*(batch.column(n).to_pylist() for n in ("host", "tokens", "classes"))):
                left = {(t["path"], t["text"]) for t in tokens if t["valid"]}
                large = [own for own in classes if sum((t["path"], t["text"]) in left for t in own) >= min_class]
                stay = left.intersection((t["path"], t["text"]) for own in large for t in own)
                for token in tokens:
                    token["valid"] = (token["path"], token["text"]) in stay and (not token["text"] or token["df"] >= min_text)
                container, fixed = template_of(tokens, share, slot_share)
                out.append({"host": host, "container": container, "fixed": [{"path": p, "text": t} for p, t in fixed]})
            yield pa.RecordBatch.from_pylist(out, TEMPLATE_ARROW)

    return placed.join(known, "host").mapInArrow(settle, TEMPLATE)


TEMPLATE = "host string, container string, fixed array<struct<path: string, text: string>>"
TEMPLATE_ARROW = pa.schema(
    [
        ("host", pa.string()),
        ("container", pa.string()),
        ("fixed", pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))),
    ]
)
RESULT = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row of ``pages``: the article's text.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    markup and reader comments are left out. Character references are decoded,
    white space inside a block becomes one space, and the blocks are joined by
    one line end in the order of the page. Nothing else is dropped but texts that
    the host's template repeats; headings inside the article stay, however many
    pages have them. A title, lead or closing paragraph beside the element that
    holds most of the text belongs to the article.

    A page whose layout is not its host's, or whose host is unknown or has no
    common template, is cut by its own elements alone. Null or empty html, or a
    page without an article, gives an empty text. Each row gives one row, also
    if page_id or url is null or repeated; other columns take no part.
    """
    known = written(host_templates(pages), "templates")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host")
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            names = ("html", "container", "fixed")
            texts = []
            for page, container, fixed in zip(*(batch.column(n).to_pylist() for n in names)):
                texts.append(main_text(page or "", container, {(f["path"], f["text"]) for f in fixed or ()}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.join(known, "host", "left").mapInArrow(extract, RESULT)
