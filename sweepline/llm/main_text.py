"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities.

A page is cut into flat blocks: text between block-level tags, with references decoded and white space as one space. Each block has its
number of words and its link density (words inside links / words), those of the block before and after, whether it is a heading, and the
role of what encloses it: 0 none, 1 an element named like content, 2 an article or main element, -1 an element that by its tag, role or
class is menu, header, footer, sidebar, notice, advert, form or reader comments. A decision tree (Gini, binary splits) trained on
``LABELLED`` says which blocks are main text; they are joined in page order by one line feed.

Never text: comments, declarations, and what is inside script, style, template, noscript, head and similar elements. ``<br>`` is white
space. An element left open ends with the element around it; a stray end tag ends nothing; a ``<`` that opens no tag is text. An ``article`` or
``main`` element inside a header, menu or form counts as main text again, inside a sidebar, footer, advert, notice or
comment list it doesn't.

A null or empty page gives an empty text. Each page is one row throughout; nothing is grouped, so repeated ids and hot keys don't matter,
and a long page is read once, in time proportional to its length. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_slices, map_batches, table

# Names of HTML elements.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
UNSEEN = frozenset("script style template noscript head title iframe object svg canvas math audio video map textarea select datalist noframes".split())
#: Content without tags.
RAW = frozenset("script style title textarea iframe noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A new one ends an open one of its group.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Roles of elements. An article inside a SOFT one is main text, inside a HARD one not.
SOFT, HARD = -1, -2
TAG_ROLE = {"nav": SOFT, "header": SOFT, "form": SOFT, "menu": SOFT, "search": SOFT, "footer": HARD, "aside": HARD, "dialog": HARD, "button": HARD}
ARIA_ROLE = {"navigation": SOFT, "banner": SOFT, "search": SOFT, "menu": SOFT, "menubar": SOFT, "toolbar": SOFT, "form": SOFT, "contentinfo": HARD, "complementary": HARD, "dialog": HARD, "alertdialog": HARD, "alert": HARD}
#: Words of a class or id; a word also counts if it starts with one of those ending in ``*``.
SOFT_WORDS = "nav navbar navigation menu* header masthead topbar banner* breadcrumb* toolbar sidebar* side rail column-side login signin signup register search form widget* skip".split()
HARD_WORDS = (
    "footer* ad ads adbox adslot adunit adsbygoogle advert* sponsor* promo* dfp outbrain taboola cookie* consent* gdpr notice* notification* alert* popup* popover modal*"
    " overlay lightbox interstitial paywall newsletter* subscri* comment* disqus respond replies reply feedback share sharing social* related* recommend*"
    " trending popular teaser* pagination pager copyright legal disclaimer tagcloud tags hidden cta donat* recirc* readmore announce* infobar discussion responses".split()
)
CONTENT_WORDS = "article* content main post story entry text body prose".split()


def _matcher(words: list[str]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(re.escape(w[:-1]) + r"\w*" if w.endswith("*") else re.escape(w) for w in words) + r")\b")


SOFT_NAME, HARD_NAME, CONTENT_NAME = map(_matcher, (SOFT_WORDS, HARD_WORDS, CONTENT_WORDS))
#: A tag up to its end; a quote without an end is part of a name. Repetitions are possessive, so a match takes linear time.
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+|=)*+)>""")
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/"']|$)""", re.I)
#: Characters of a tag that are looked at; a longer one ends at the first ``>``.
LONGEST_TAG = 1 << 16
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_APART = re.compile(r"[^a-z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def role_of(tag: str, attributes: str) -> int:
    """2 article, 1 content, 0 none, SOFT or HARD boilerplate."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _INVISIBLE.search(found.get("style", "")):
        return HARD
    if tag in ("html", "body"):
        return 0
    names = _APART.sub(" ", _CAMEL.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").lower())
    aria = found.get("role", "").lower()
    strong = tag in ("article", "main") or aria in ("main", "article")
    if HARD_NAME.search(names) and not (strong and not re.search(r"\b(?:comments?|ad|ads|advert\w*|sponsor\w*|promo\w*|teaser|related|recommend\w*|reply)\b(?! (?:open|closed|on|off|free|enabled|disabled))", names)):
        return HARD
    if strong:
        return 2
    by_tag = min(TAG_ROLE.get(tag, 0), ARIA_ROLE.get(aria, 0))
    if by_tag:
        return by_tag
    if SOFT_NAME.search(names):
        return SOFT
    return 1 if CONTENT_NAME.search(names) else 0


def inside(outer: int, own: int, tag: str) -> int:
    """The role of what stands in an element of role ``own`` within one of role ``outer``."""
    if outer == HARD or own == 0:
        return outer
    if own == 2:
        return 2
    if tag == "header" and outer == 2:  # an article's own heading
        return 2
    if own < 0:
        return own
    return outer if outer < 0 else max(outer, own)


Block = tuple[str, int, int, int, bool]


def blocks_of(page: str) -> list[Block]:
    """(text, words, words in links, role, heading) of a page's text blocks, in order."""
    out: list[Block] = []
    pieces: list[str] = []
    link_pieces: list[str] = []
    stack: list[tuple[str, int]] = []
    links, heading, unseen, at, size = 0, 0, 0, 0, len(page)

    def close_block() -> None:
        if pieces:
            words = "".join(pieces).split()
            if words:
                role = stack[-1][1] if stack else 0
                out.append((" ".join(words), len(words), min(len(words), len(" ".join(link_pieces).split())), role, heading > 0))
            pieces.clear()
            link_pieces.clear()

    def text(raw: str) -> None:
        if unseen or not raw:
            return
        raw = entities.unescape(raw) if "&" in raw else raw
        pieces.append(raw)
        if links:
            link_pieces.append(raw)

    def pop_to(place: int) -> None:
        nonlocal unseen, heading
        while len(stack) > place:
            tag, _ = stack.pop()
            unseen -= tag in UNSEEN
            heading -= tag in HEADINGS

    def last_block() -> int:
        place = len(stack) - 1
        while place >= 0 and stack[place][0] not in BLOCK:
            place -= 1
        return place

    start = 0  # of the text not yet taken
    while (at := page.find("<", at)) >= 0:
        nxt = page[at + 1 : at + 2]
        if nxt in "!?" and nxt:
            text(page[start:at])
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4) if not page.startswith(("<!-->", "<!--->"), at) else page.find(">", at) - 2
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            start = at
            continue
        if not (nxt.isascii() and nxt.isalpha() or nxt == "/" and page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha()):
            at += 1  # not a tag: text
            continue
        text(page[start:at])
        found = TAG.match(page, at, at + LONGEST_TAG)
        if found:
            tag, attributes, end = found[1].lower(), found[2], found.end()
        else:
            stop = page.find(">", at)
            end = size if stop < 0 else stop + 1
            name = re.match(r"</?([a-zA-Z][^\s/>]*)", page[at : at + 64])
            tag, attributes = name[1].lower(), page[at + len(name[0]) : min(end - 1, at + LONGEST_TAG)]
        at = start = end
        if nxt == "/":
            if tag in BLOCK:
                close_block()
            if tag == "a":
                links = max(0, links - 1)
            for place in range(len(stack) - 1, max(-1, len(stack) - 256), -1):
                if stack[place][0] == tag:
                    if tag not in BLOCK and any(stack[i][0] in BLOCK for i in range(place + 1, len(stack))):
                        break  # an inline end tag doesn't end blocks
                    if tag not in BLOCK and stack[place][1] != (stack[place - 1][1] if place else 0):
                        close_block()
                    pop_to(place)
                    break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            close_block()
            links = 0
            if stack and (stack[-1][0] == "head" or (last := last_block()) >= 0 and stack[last][0] == "p"):
                pop_to(len(stack) - 1 if stack[-1][0] == "head" else last)
            while (last := last_block()) >= 0 and stack[last][0] in ENDS.get(tag, ()):
                pop_to(last)
        if tag in VOID:
            continue
        if tag == "body" and unseen:  # a head left open
            pop_to(0)
        if tag == "a":
            links = 1
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        outer = stack[-1][1] if stack else 0
        role = inside(outer, role_of(tag, attributes), tag)
        if tag in BLOCK or tag in UNSEEN or role != outer:
            if role != outer and tag not in BLOCK:
                close_block()
            stack.append((tag, role))
            unseen += tag in UNSEEN
            heading += tag in HEADINGS
        if tag in RAW:
            lowered = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = start = lowered.start() if lowered else size
    text(page[start:])
    close_block()
    return out


#: Small labelled table: pages as blocks (role, heading, words, words in links, 1 for main text).
LABELLED: list[list[tuple[int, int, int, int, int]]] = [
    # an article element between menu, advert and footer; short and one-word paragraphs
    [(-1, 0, 1, 1, 0), (-1, 0, 1, 1, 0), (-1, 0, 2, 2, 0), (-1, 0, 9, 0, 0), (2, 1, 9, 0, 1), (2, 0, 22, 0, 1), (2, 0, 68, 2, 1), (2, 0, 1, 0, 1), (2, 0, 5, 0, 1), (2, 0, 140, 0, 1), (-1, 0, 11, 0, 0)],
    # an article with a link line, a list and a quotation of its own
    [(-1, 0, 30, 0, 0), (2, 1, 6, 0, 1), (2, 0, 4, 1, 1), (2, 0, 41, 6, 1), (2, 0, 3, 3, 1), (2, 0, 8, 2, 1), (2, 0, 7, 0, 1), (2, 0, 55, 1, 1), (-1, 1, 1, 0, 0), (-1, 0, 38, 0, 0), (-1, 0, 70, 2, 0), (-1, 0, 6, 0, 0)],
    # reader comments and a long notice, longer than the article itself
    [(-1, 0, 64, 1, 0), (-1, 0, 2, 0, 0), (2, 1, 5, 0, 1), (2, 0, 18, 0, 1), (2, 0, 12, 0, 1), (-1, 0, 80, 0, 0), (-1, 0, 95, 0, 0), (-1, 0, 51, 4, 0)],
    # an element named like content, with a menu inside it
    [(0, 0, 1, 1, 0), (0, 0, 1, 1, 0), (1, 0, 2, 2, 0), (1, 0, 3, 3, 0), (1, 1, 7, 0, 1), (1, 0, 33, 1, 1), (1, 0, 4, 0, 1), (1, 0, 61, 3, 1), (1, 0, 27, 0, 1), (1, 0, 4, 4, 0), (1, 0, 3, 3, 0), (0, 0, 5, 4, 0)],
    # plain divisions: menus of links, a heading, paragraphs, short lines between long ones, a footer
    [(0, 0, 1, 1, 0), (0, 0, 2, 2, 0), (0, 0, 1, 1, 0), (0, 0, 3, 3, 0), (0, 1, 8, 0, 1), (0, 0, 46, 2, 1), (0, 0, 6, 0, 1), (0, 0, 73, 0, 1), (0, 0, 31, 4, 1), (0, 0, 4, 4, 0), (0, 0, 2, 2, 0), (0, 0, 7, 0, 0)],
    [(0, 0, 4, 4, 0), (0, 0, 5, 5, 0), (0, 0, 3, 0, 0), (0, 0, 2, 2, 0), (0, 1, 6, 0, 1), (0, 0, 24, 0, 1), (0, 0, 19, 1, 1), (0, 0, 88, 5, 1), (0, 0, 12, 0, 1), (0, 0, 3, 3, 0), (0, 0, 6, 5, 0), (0, 0, 4, 1, 0)],
    # tables of links and lone short lines without long text near them
    [(0, 0, 2, 2, 0), (0, 0, 12, 12, 0), (0, 0, 15, 14, 0), (0, 0, 11, 10, 0), (0, 0, 3, 0, 0), (0, 0, 14, 13, 0), (0, 0, 2, 0, 0), (0, 0, 1, 1, 0), (0, 0, 5, 0, 0), (0, 0, 2, 2, 0)],
    # menus, share lines, related links and a footer of links, each next to long paragraphs of the article
    [(-1, 0, 3, 3, 0), (-1, 0, 2, 2, 0), (2, 1, 7, 0, 1), (2, 0, 90, 0, 1), (-1, 0, 4, 4, 0), (2, 0, 75, 0, 1), (2, 0, 6, 6, 1), (2, 0, 66, 1, 1), (-1, 0, 5, 5, 0), (-1, 0, 9, 9, 0), (-1, 0, 12, 6, 0)],
    [(-1, 0, 40, 2, 0), (-1, 0, 3, 3, 0), (1, 1, 5, 0, 1), (1, 0, 84, 2, 1), (1, 0, 2, 2, 0), (1, 0, 58, 0, 1), (-1, 0, 3, 2, 0), (-1, 0, 33, 30, 0), (-1, 1, 2, 0, 0), (-1, 0, 57, 0, 0)],
    [(2, 0, 120, 3, 1), (2, 0, 9, 8, 1), (2, 0, 2, 2, 1), (2, 0, 44, 0, 1), (-1, 0, 8, 7, 0), (0, 0, 6, 6, 0), (0, 0, 2, 2, 0)],
    [(0, 0, 3, 3, 0), (0, 1, 5, 0, 1), (0, 0, 77, 1, 1), (0, 0, 40, 0, 1), (0, 0, 5, 5, 0), (0, 0, 9, 9, 0), (0, 0, 3, 3, 0)],
    # plain divisions whose short lines stand between long paragraphs; short lines that don't
    [(0, 0, 2, 2, 0), (0, 0, 3, 0, 0), (0, 1, 3, 0, 1), (0, 0, 63, 1, 1), (0, 0, 2, 0, 1), (0, 0, 52, 0, 1), (0, 0, 1, 0, 1), (0, 0, 39, 0, 1), (0, 0, 3, 0, 0)],
    [(0, 0, 1, 0, 0), (0, 0, 2, 1, 0), (0, 0, 4, 0, 0), (0, 1, 4, 0, 1), (0, 0, 34, 0, 1), (0, 0, 3, 0, 1), (0, 0, 29, 0, 1), (0, 0, 2, 0, 0), (0, 0, 4, 3, 0)],
    # articles of short lines: lists, verse, an interview; links to sources stay
    [(0, 0, 2, 2, 0), (2, 1, 3, 0, 1), (2, 0, 1, 0, 1), (2, 0, 2, 0, 1), (2, 0, 4, 0, 1), (2, 0, 3, 3, 1), (2, 0, 2, 0, 1), (2, 0, 1, 1, 1), (2, 0, 1, 0, 1), (0, 0, 2, 0, 0)],
    [(-1, 0, 2, 2, 0), (2, 0, 2, 0, 1), (2, 0, 6, 0, 1), (2, 0, 2, 0, 1), (2, 0, 3, 1, 1), (2, 0, 1, 0, 1), (2, 0, 4, 4, 1), (2, 0, 5, 2, 1), (2, 0, 2, 0, 1), (-1, 0, 3, 0, 0)],
    [(-1, 0, 17, 0, 0), (2, 0, 1, 0, 1), (2, 0, 30, 0, 1), (2, 0, 1, 0, 1), (-1, 0, 2, 0, 0), (2, 0, 2, 0, 1), (-1, 0, 25, 0, 0), (2, 0, 3, 0, 1), (2, 0, 2, 2, 1), (-1, 0, 1, 0, 0), (-1, 0, 60, 0, 0)],
    [(2, 1, 2, 0, 1), (2, 0, 3, 0, 1), (2, 0, 2, 0, 1)],
    # text alone
    [(0, 0, 25, 0, 1), (0, 0, 31, 0, 1), (0, 0, 17, 0, 1)],
    [(0, 1, 4, 0, 1), (0, 0, 21, 2, 1)],
    [(0, 0, 14, 0, 1)],
    [(2, 0, 3, 0, 1)],
    [(1, 0, 16, 0, 1)],
    [(-1, 1, 3, 0, 0), (-1, 0, 120, 0, 0), (-1, 0, 45, 0, 0)],
]
FEATURES = ("role", "heading", "words", "density", "words_before", "density_before", "words_after", "density_after")


def features(role: np.ndarray, heading: np.ndarray, words: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """A row for each block of a page: itself and its neighbours (no words before the first and after the last)."""
    density = linked / np.maximum(words, 1)
    before = lambda x: np.concatenate([[0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0]])
    return np.column_stack([np.maximum(role, -1), heading, words, density, before(words), before(density), after(words), after(density)]).astype(float)


#: (feature, threshold, node if smaller or equal, node if larger), or the share of main text.
Tree = tuple | float


def train(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """A binary tree by Gini impurity; thresholds lie between neighbouring values, the first best split wins."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (len(y) * share * (1 - share) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            n = left.sum()
            if min(n, len(y) - n) < least:
                continue
            a, b = y[left].mean(), y[~left].mean()
            impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            if impurity < best[0]:
                best = (impurity, f, float(t))
    _, f, t = best
    if f is None:
        return share
    left = x[:, f] <= t
    return (f, t, train(x[left], y[left], depth - 1, least), train(x[~left], y[~left], depth - 1, least))


def decide(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Share of main text in the leaf of each row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, small, large = tree
    left, out = x[:, f] <= t, np.empty(len(x))
    out[left], out[~left] = decide(small, x[left]), decide(large, x[~left])
    return out


def trained() -> Tree:
    pages = [np.array(page) for page in LABELLED]
    return train(np.concatenate([features(*p[:, :4].T) for p in pages]), np.concatenate([p[:, 4] for p in pages]))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks_of(page) if page else []
    if not found:
        return ""
    texts, words, linked, role, heading = zip(*found)
    main = decide(tree, features(*(np.array(c) for c in (role, heading, words, linked)))) >= 0.5
    return "\n".join(t for t, m in zip(texts, main) if m)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    tree = trained()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in arrow_slices(batches, "html"):
            texts = [main_text(page.as_py(), tree) for page in batch.column("html")]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.select("page_id", "url", "html"), read, "page_id long, url string, text string, n_chars long")


def op12_main_text(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
