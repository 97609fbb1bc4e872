"""Text blocks of a page's HTML and the element subtrees that hold them."""

from __future__ import annotations

import html as references
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import accumulate

import xxhash

#: A tag's quoted values may hold its end sign; so many pieces of a tag are looked at before it ends at the next one.
_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'){0,400}+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden|aria-label|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|\Z))""", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content is not markup (up to the end tag) or never shown.
RAW = frozenset("script style textarea title xmp noscript template iframe object svg math canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: An opening tag of the key closes open elements of these names.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
#: Lists and tables, which these do not reach out of.
LISTS = frozenset("ul ol dl table select".split())
#: The search for a paragraph to close ends here.
SCOPES = frozenset("html body table ul ol dl div section article main td th select blockquote nav aside header footer form".split())
#: End tags of inline elements, paragraphs and cells do not reach out of these.
WALLS = SCOPES - {"div", "section", "header"}
HELD = INLINE | {"p", "li", "td", "th", "tr"}
NOT_TEXT = frozenset("head select button datalist dialog audio video map".split())
#: Elements that a class or id may mark as something beside the article.
CONTAINERS = frozenset("div section aside ul ol dl table figure details center fieldset header".split())

# Element names, roles and words of class or id that mark what is not the article.
BOILERPLATE_TAGS = frozenset("nav aside footer form menu".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead
    footer sidebar sidebars aside widget widgets related recommended recommendations teaser teasers
    share sharing social cookie cookies consent gdpr notice notices notification banner popup modal overlay
    newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies
    skip sitemap copyright legal disclaimer""".split()
)
HEADER_WORDS = frozenset("header head top".split())
#: Whole classes or ids that mark a part of an article.
INNER_CLASSES = frozenset(
    """ad ads advert adverts advertisement advertising adslot sponsored promo newsletter subscribe signup
    share sharing share-buttons social-share social-links related related-posts related-articles recommended
    comment comments comment-list commentlist comment-section disqus disqus_thread respond cookie-notice cookie-banner""".split()
)
#: Last words of a class or id that mark what readers wrote, and of one that marks an article element that names another page's.
COMMENT_WORDS = frozenset("comment comments commentlist replies".split())
CARD_WORDS = frozenset("card cards tile tiles teaser teasers preview previews snippet related promo sponsored ad advert".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)}


#: What an element's name and attributes say: nothing, that it is not the article, that a
#: class or id suggests so, or that readers wrote it.
PLAIN, OUT, MAYBE, COMMENT = 0, 1, 2, 3


def _last_words(named: str) -> set[str]:
    """The last word of each class or id: of "user-comments" it is "comments"."""
    split = (_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) for x in named.split())
    return {words[-1] for words in split if words}


def _mark(tag: str, raw: str, in_article: bool) -> int:
    if tag in BOILERPLATE_TAGS or (tag == "header" and not in_article):
        return OUT
    if not raw:
        return PLAIN
    found = _attributes(raw)
    if not found:
        return PLAIN
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return OUT
    if found.get("role", "").lower() in BOILERPLATE_ROLES:
        return OUT
    named = f"{found.get('class', '')} {found.get('id', '')}"
    if tag in CONTAINERS or tag == "article":
        last = _last_words(named)
        if not COMMENT_WORDS.isdisjoint(last):
            return COMMENT
        if tag == "article" and not CARD_WORDS.isdisjoint(last):
            return MAYBE
    if in_article:
        return MAYBE if (tag in CONTAINERS or tag == "article") and not INNER_CLASSES.isdisjoint(named.lower().split()) else PLAIN
    words = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower())
    if tag not in ("html", "body", "main") and not BOILERPLATE_WORDS.isdisjoint(words):
        return MAYBE
    return MAYBE if tag in ("div", "section") and not HEADER_WORDS.isdisjoint(words) else PLAIN


class Open:
    __slots__ = ("tag", "first", "mark", "parts", "link_chars", "chars", "links", "spanned")

    def __init__(self, tag: str, first: int, mark: int):
        self.tag, self.first, self.mark = tag, first, mark
        self.parts: list[str] = []
        self.link_chars = self.chars = self.links = 0
        self.spanned = -1


@dataclass
class Page:
    """All text blocks in page order, whether names and attributes leave each in, and subtrees as (hash, first block, end block).

    The last bit of a subtree's hash is free, the one before says whether it is in an article or main element.
    """

    blocks: list[str] = field(default_factory=list)
    kept: list[bool] = field(default_factory=list)
    spans: list[tuple[int, int, int]] = field(default_factory=list)


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(source: str | None) -> Page:
    """Blocks of a page, the hashes of its subtrees and what names and attributes say of each block.

    Character references are decoded, white space inside a block is one space.
    Scripts, styles, comments and controls have no text. A subtree's hash is that of
    its element names and blocks, made from those of the elements inside. Broken
    markup never raises: unclosed elements end with their parent. The time is in
    proportion to the page, however deep its elements are nested.

    A block is left out if it is in a navigation, aside, footer, form, hidden element
    or one of such a role, or in a header that is not an article's; if a class or id of a container
    or article element ends in a word for readers' comments, unless it holds the article or all there is; or if it is
    not in the page's root. That is the main element, or the articles in it if they have half of its
    text or more; or the articles of the page, if there is no main element with text or one
    of them outside of it has more. Articles that readers wrote, or whose class says that they
    are cards of other pages, are none. Two signs are weaker: a class or id
    word (in an article, a whole class of a container, but not of a paragraph) and,
    outside of both elements, a list or container of three links or more that are over 60 % of its
    text. They leave a subtree out that has at most half of the page's text left
    by the other rules, and are not heeded if they would leave nothing.
    """
    page = Page()
    if not source:
        return page
    blocks = page.blocks
    stack: list[Open] = []
    outer: list[Open] = [Open("", 0, PLAIN)]  # open block elements
    at_tag: dict[str, list[int]] = defaultdict(list)  # depths of open elements of a name
    scopes, walls, lists = [-1], [-1], [-1]
    parts: list[str] = []
    levels: list[tuple[int, bool]] = []  # of each block: number of the article it is in, and whether in main
    out: list[bool] = []
    maybe: list[tuple[int, int]] = []
    comments: list[tuple[int, int]] = []
    silent = dropped = articles = article = 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", references.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                blocks.append(text)
                levels.append((article if articles else 0, bool(at_tag["main"])))
                out.append(dropped > 0)
                outer[-1].parts.append(text)
                outer[-1].chars += len(text)

    def add(text: str) -> None:
        if not silent:
            parts.append(text)
            if at_tag["a"]:
                outer[-1].link_chars += len(text)

    def close() -> None:
        nonlocal silent, dropped, articles
        top, depth = stack[-1], len(stack) - 1
        block = top.tag not in INLINE
        if block:
            flush()
        stack.pop()
        at_tag[top.tag].pop()
        for marks in (scopes, walls, lists):
            if marks[-1] == depth:
                marks.pop()
        silent -= top.tag in NOT_TEXT or (top.mark == OUT and not block)
        if top.tag == "a":
            outer[-1].links += 1
        if not block:
            return
        dropped -= top.mark == OUT
        articles -= top.tag == "article" and top.mark == PLAIN
        outer.pop()
        up, last = outer[-1], len(blocks)
        if last > top.first:
            own = hash_of("\n".join((top.tag, *top.parts)))
            up.parts.append(f"<{own:x}>")
            inside = top.first << 32 | last
            if top.spanned != inside and top.tag not in ("html", "body", "article", "main"):
                page.spans.append((own & ~3 | 2 * bool(at_tag["article"] or at_tag["main"]), top.first, last))
            up.spanned = inside
            linked = top.links >= 3 and top.link_chars > 0.6 * top.chars and (top.tag in CONTAINERS or top.tag == "p") and not at_tag["article"] and not at_tag["main"]
            if top.mark == MAYBE or linked:
                maybe.append((top.first, last))
            if top.mark == COMMENT:
                comments.append((top.first, last))
        up.chars += top.chars
        up.link_chars += top.link_chars
        up.links += top.links

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            close()

    at, n, ended = 0, len(source), source.rfind(">")
    while at < n:
        if at > ended:  # no tag ends any more
            add(source[at:].partition("<!--")[0])
            break
        m = _TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        ending, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])  # the latter: a quote that never ends
        if tag is None:
            continue
        tag = tag.lower()
        if ending:
            if tag == "br":
                add(" ")
            elif at_tag[tag]:
                if tag not in HELD or at_tag[tag][-1] >= walls[-1]:
                    close_to(at_tag[tag][-1])
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at) if not raw.endswith("/") else None
            at = end.end() if end else (at if raw.endswith("/") else n)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        block = tag not in INLINE
        if block:
            if tag in CLOSES:
                first = [x[k] for x in map(at_tag.__getitem__, CLOSES[tag]) if (k := bisect_right(x, lists[-1])) < len(x)]
                if first:
                    close_to(min(first))
            if at_tag["p"] and at_tag["p"][-1] > scopes[-1]:
                close_to(at_tag["p"][-1])
            flush()
        mark = _mark(tag, raw, articles > 0) if block or raw else PLAIN
        if mark in (MAYBE, COMMENT) and not block:
            mark = PLAIN
        top = Open(tag, len(blocks), mark)
        for marks, names in ((scopes, SCOPES), (walls, WALLS), (lists, LISTS)):
            if tag in names:
                marks.append(len(stack))
        at_tag[tag].append(len(stack))
        stack.append(top)
        if block:
            outer.append(top)
            dropped += mark == OUT
            if tag == "article" and mark == PLAIN:
                article += not articles
                articles += 1
        silent += tag in NOT_TEXT or (mark == OUT and not block)
    flush()
    close_to(0)
    page.kept = _kept(blocks, levels, out, maybe, comments)
    return page


def _covered(n: int, ranges: list[tuple[int, int]]) -> list[bool]:
    depth = [0] * (n + 1)
    for first, end in ranges:
        depth[first] += 1
        depth[end] -= 1
    return [d > 0 for d in accumulate(depth[:n])]


def _in_root(sizes: list[int], levels: list[tuple[int, bool]]) -> list[bool]:
    """Which blocks are in the element that has the page's text; sizes are 0 for blocks that are left out."""
    main = sum(n for n, (_, inside) in zip(sizes, levels) if inside)
    within = sum(n for n, (article, inside) in zip(sizes, levels) if inside and article)
    apart: dict[int, int] = defaultdict(int)
    for n, (article, inside) in zip(sizes, levels):
        if article and not inside:
            apart[article] += n
    if max(apart.values(), default=0) > main:
        return [article > 0 for article, _ in levels]
    if main:
        return [inside and (article > 0 or 2 * within < main) for article, inside in levels]
    return [True] * len(levels)


def _kept(blocks: list[str], levels: list[tuple[int, bool]], out: list[bool], maybe: list[tuple[int, int]], comments: list[tuple[int, int]]) -> list[bool]:
    """Which blocks the marks leave in."""
    sizes = [0 if gone else len(b) for b, gone in zip(blocks, out)]
    # what holds an article or the main element is not what readers wrote about it, unless it is the smaller part of the page
    upto, articles, mains = ([0, *accumulate(x)] for x in (sizes, (a > 0 for a, _ in levels), (m for _, m in levels)))
    holds = lambda first, end: any(not x and of[end] > of[first] for x, of in zip(levels[first], (articles, mains)))
    told = [(first, end) for first, end in comments if not holds(first, end) or 2 * (upto[end] - upto[first]) <= upto[-1]]
    theirs = _covered(len(blocks), told)
    if any(n and not t for n, t in zip(sizes, theirs)):
        sizes = [0 if t else n for n, t in zip(sizes, theirs)]
    root = _in_root(sizes, levels)
    kept = [n > 0 and inside for n, inside in zip(sizes, root)]
    if maybe:
        upto = [0, *accumulate(n if k else 0 for n, k in zip(sizes, kept))]
        beside = _covered(len(blocks), [(first, end) for first, end in maybe if 2 * (upto[end] - upto[first]) <= upto[-1]])
        left = [k and not b for k, b in zip(kept, beside)]
        if any(left):
            return left
    return kept
