"""Main text of web pages by composite text density.

The page becomes a tree in one pass over its tags (implied ends, void and raw-text
elements are honoured; a truncated page is closed at its end). Elements that by name
or class are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments do not count. A class or id does not exclude an element around
the article, one with most of the page's text outside links, or a heading; words that
may be a topic (legal, related, discussion, search, header) exclude no prose inside an
article, or section of a page without one; names as ``no-sidebar``, ``has-header``,
``layout-with-sidebar`` and ``comments-open`` mean nothing. For every other node the density is its
characters per tag, adjusted by the share of links in it and in the body; a node's
density sum adds its children's. The node with the largest density sum is found, the
least density on its path to the body is the threshold. From that node the path is
climbed as long as what it adds is not mostly links and, at the body, no branch is
below the threshold. Where that fails, the branches are judged one by one: those at or
above the threshold, headings, paragraphs and the like that are not mostly links, and
what lies between two kept blocks stay; of other branches, the parts at or above the
threshold. An article element ends the climb (sibling articles at or above the threshold
stay), and a wrapper of one article counts as that article. The whole text of what was
kept is returned, lists of links too, except those that stand before any other text
outside an article (the page's menu).

Blocks are separated by block-level tags and line breaks; character references are
decoded, white space in a block becomes one blank.

Defined cases: a null or empty page, or one without text, gives an empty text; text
without any tag is the body itself; repeated pages are extracted one by one; extra
columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
                  "tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br body html caption option optgroup legend tbody td tfoot th thead tr summary figcaption".split())
IMPLIED_END = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
               "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
               "tbody": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tfoot tr td th", ("table",))}
PROSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre ul ol dl table figure figcaption address details".split())
NOISE_TAGS = frozenset("nav header footer aside form script style noscript template button select textarea input label iframe object embed svg "
                       "canvas audio video head title menu dialog fieldset search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
                        "notice notices alert popup modal overlay sidebar aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs "
                        "header masthead topbar footer footers copyright legal comment comments disqus reply replies responses respond discussion share sharing "
                        "social newsletter subscribe subscription signup login search related recommended pagination pager toolbar skip form".split())

# Words of NOISE_WORDS that may also name a part of an article.
TOPIC_WORDS = frozenset("header legal related discussion search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NEGATIONS = frozenset("no not non without with has have hide hides".split())
LAYOUT_WORDS = frozenset("layout".split())
STATE_WORDS = frozenset("open opened closed enabled disabled on off".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(>|\Z)|<[!?/][^>]*+>""", re.S)
# The same where quotes do not count: from a tag on that its quotes never let end.
_PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(>)|<[!?/][^>]*+>", re.S)
INLINE = frozenset(("a", "b", "i", "span", "em", "strong"))
BARRIERS = ("td", "th", "table", "article", "section", "main", "div")
_CLASSES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _class_words(attributes: str) -> tuple[set[str], bool]:
    """Noise words of the class and id, and whether one of them is a whole name. Words
    after no-, has-, with- ..., in a layout's name or with a state (comments-open) say
    nothing about the element itself."""
    found, whole = set(), False
    for m in _CLASSES.finditer(attributes):
        if m[1].lower() == "role":
            continue
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = [x.lower() for x in _NAME_PARTS.split(name) if x]
            if parts and (LAYOUT_WORDS.intersection(parts) or parts[-1] in STATE_WORDS):
                continue
            parts = parts[:next((k for k, x in enumerate(parts) if x in NEGATIONS), len(parts))]
            found |= NOISE_WORDS.intersection(parts)
            whole = whole or bool(parts) and NOISE_WORDS.issuperset(parts)
    return found, whole


def _is_noise(tag: str, attributes: str) -> bool:
    if tag in NOISE_TAGS:
        return True
    if tag in ("body", "html", "main", "article") or not attributes:
        return False
    return any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").strip().lower() in NOISE_ROLES for m in _CLASSES.finditer(attributes))


class Tree:
    """Nodes in page order: a parent always stands before its children."""

    def __init__(self, page: str):
        self.parent, self.tag, self.noise, self.pieces = [-1], ["body"], [False], []
        self.named: dict[int, tuple[set[str], bool]] = {}
        self.open: dict[str, list[int]] = {}  # places on the stack by name
        stack, at, end, tag, last = [0], 0, len(page), _TAG, page.rfind(">")
        while at < end:
            if at > last:  # no tag ends any more; what opens a comment still does
                self._text(stack[-1], page[at:].partition("<!--")[0])
                break
            m = tag.search(page, at)
            if m and m[2] and not m[4]:
                tag = _PLAIN_TAG
                m = tag.search(page, at)
            if not m:
                self._text(stack[-1], page[at:])
                break
            if m.start() > at:
                self._text(stack[-1], page[at:m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                self._close(stack, name)
                continue
            if name in ("html", "body"):
                continue
            self._imply(stack, name)
            node = len(self.parent)
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.noise.append(self.noise[stack[-1]] or _is_noise(name, m[3]))
            if m[3] and not self.noise[node] and name not in HEADINGS and name not in ("main", "article") and (words := _class_words(m[3]))[0]:
                self.named[node] = words
            if name in BLOCK:
                self.pieces.append((node, None))
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
                at = close.start() if close else end
                self._push(stack, node)
            elif name not in VOID and (not m[3].endswith("/") or name in BLOCK or name in INLINE):  # HTML ignores the slash of a normal element
                self._push(stack, node)
        if self.named:
            self._exclude()

    def _exclude(self) -> None:
        """Elements whose class or id is a noise word are noise, unless they hold the main text."""
        n = len(self.parent)
        chars, link_chars, most, holds, within, link = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            within[i] = within[p] or self.tag[i] in ("article", "main") and not self.noise[i]
            link[i] = link[p] or self.tag[i] == "a"
        for node, text in self.pieces:
            if text is not None:
                k = len(" ".join(text.split()))
                chars[node] += k
                link_chars[node] += k * link[node]
        for i in range(n - 1, -1, -1):
            if self.tag[i] in ("article", "main") and not self.noise[i] and chars[i] > link_chars[i]:
                holds[i], most[i] = True, max(most[i], chars[i] - link_chars[i])
            if i:
                p = self.parent[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                holds[p], most[p] = holds[p] or holds[i], max(most[p], most[i])
        prose = [c - x for c, x in zip(chars, link_chars)]
        for i in range(1, n):
            self.noise[i] = self.noise[i] or self.noise[self.parent[i]]
            if self.noise[i] or i not in self.named:
                continue
            words, whole = self.named[i]
            if holds[i] and 10 * most[i] >= most[0]:
                continue  # around the article
            if words <= TOPIC_WORDS and 2 * prose[i] >= chars[i] > 0 and (within[i] or self.tag[i] == "section" and not holds[0]):
                continue  # a part of the article by its topic
            # A name that is noise words alone must hold nearly all, any other most of the page's text.
            if prose[i] * 10 > prose[0] * (9 if whole else 5) and (holds[i] or 10 * most[0] < prose[i]):
                continue
            self.noise[i] = True
        self.pieces = [(node, text) for node, text in self.pieces if text is None or not self.noise[node]]

    def _text(self, node: int, text: str) -> None:
        if not self.noise[node]:
            self.pieces.append((node, html.unescape(text)))

    def _push(self, stack: list[int], node: int) -> None:
        self.open.setdefault(self.tag[node], []).append(len(stack))
        stack.append(node)

    def _cut(self, stack: list[int], at: int) -> None:
        """Take the elements from ``at`` on off the stack."""
        for node in reversed(stack[at:]):
            self.open[self.tag[node]].pop()
        del stack[at:]

    def _highest(self, names) -> int:
        """Place on the stack of the innermost open element of these names, 0 if none."""
        return max((at[-1] for x in names if (at := self.open.get(x))), default=0)

    def _close(self, stack: list[int], name: str) -> None:
        at = self._highest((name,))
        # an end that matches nothing is ignored, and an inline one does not close the blocks around it
        if not at or name not in BLOCK and self._highest(BARRIERS) > at:
            return
        if name in BLOCK:
            self.pieces.append((stack[at], None))
        self._cut(stack, at)

    def _imply(self, stack: list[int], name: str) -> None:
        if name in CLOSES_P:
            self._close_up_to(stack, ("p",), ("table", "td", "th", "button", "article", "section", "div", "li", "blockquote"))
        if name in IMPLIED_END:
            ends, scope = IMPLIED_END[name]
            self._close_up_to(stack, ends.split(), scope)

    def _close_up_to(self, stack: list[int], names, scope) -> None:
        """Close the elements of these names that are inside the innermost one of the scope."""
        inside = self._highest([x for x in scope if x not in names])
        first = [at[k] for x in names if (at := self.open.get(x)) and (k := bisect.bisect_right(at, inside)) < len(at)]
        if first:
            self._cut(stack, min(first))


def densities(tree: Tree) -> tuple[list[float], list[float], list[int], list[int]]:
    """Link-adjusted density, density sum, characters and link characters per node."""
    n = len(tree.parent)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
    for node, text in tree.pieces:
        if text is not None:
            k = len(" ".join(text.split()))
            chars[node] += k
            if in_link[node]:
                link_chars[node] += k
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        if not tree.noise[i]:
            tags[p] += tags[i] + (tree.tag[i] not in VOID)
            link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    share = link_chars[0] / chars[0] if chars[0] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c, lc, t, lt = chars[i], link_chars[i], max(tags[i], 1), max(link_tags[i], 1)
        if c and not tree.noise[i]:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            density[i] = c / t * (math.log(max(c / max(lc, 1) * t / lt, 1.0)) / max(math.log(base), 1.0) if lc else 1.0)
    for i in range(1, n):
        total[tree.parent[i]] += density[i]
    return density, total, chars, link_chars


def main_nodes(tree: Tree, density: list[float], total: list[float], chars: list[int], link_chars: list[int]) -> tuple[list[int], set[int]]:
    """Roots of the main text, and the pieces of text between them that are in no root."""
    best = max(range(len(total)), key=lambda i: (total[i], chars[i], -i))
    # A body or wrapper around one article is that article.
    n, named = len(total), [t in ("article", "main") for t in tree.tag]
    nested, under = [False] * n, [False] * n
    for i in range(1, n):
        p = tree.parent[i]
        nested[i], under[i] = nested[p] or named[p], under[p] or p == best
    outer = [i for i in range(1, n) if named[i] and not nested[i] and not tree.noise[i] and chars[i]]
    largest = max(outer, key=lambda i: chars[i], default=0)
    if outer and under[largest] and 2 * chars[largest] >= chars[best] and 2 * chars[largest] >= sum(chars[i] for i in outer):
        best = largest
    path = [best]
    while path[-1]:
        path.append(tree.parent[path[-1]])
    threshold = min((density[i] for i in path if density[i] > 0), default=0.0)
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        if chars[i] and not tree.noise[i]:
            children.setdefault(tree.parent[i], []).append(i)

    def prose(i: int) -> bool:
        return 2 * link_chars[i] <= chars[i]

    roots, parted, light = [best], set(), []
    for below, above in zip(path, path[1:]):
        beside = [i for i in children.get(above, ()) if i != below]
        if named[below]:  # ends the climb; an article split over sibling articles is all of them
            roots += [i for i in beside if tree.tag[i] == tree.tag[below] == "article" and prose(i) and density[i] >= threshold]
            break
        added, links = chars[above] - chars[below], link_chars[above] - link_chars[below]
        if roots == [below] and 2 * links <= added and (above or all(density[i] >= threshold for i in beside)):
            roots = [above]
            continue
        parted.add(above)
        while beside:
            i = beside.pop()
            if prose(i) and (density[i] >= threshold or tree.tag[i] in PROSE and tree.parent[i] == above):
                roots.append(i)
            elif tree.parent[i] == above and (prose(i) or tree.tag[i] in PROSE or tree.tag[i] not in BLOCK):
                light.append(i)
            else:
                beside += children.get(i, ())
    if not parted:
        return roots, set()
    # What lies between two kept blocks belongs to them.
    inside, owner = [False] * n, [-1] * n
    for i in roots:
        inside[i] = True
    for i in light:
        owner[i] = i
    for i in range(1, n):
        if tree.parent[i] >= 0:
            inside[i] = inside[i] or inside[tree.parent[i]]
            owner[i] = owner[i] if owner[i] >= 0 else owner[tree.parent[i]]
    loose = {k: len(" ".join(text.split())) for k, (node, text) in enumerate(tree.pieces) if text and node in parted}
    kept = [k for k, (node, text) in enumerate(tree.pieces) if text and inside[node] or loose.get(k, 0) >= max(threshold, 1)]
    between = range(kept[0], kept[-1] + 1)
    found = {owner[tree.pieces[k][0]] for k in between if tree.pieces[k][1]}
    return roots + [i for i in light if i in found], {k for k in loose if k in between}


def extract(page: str | None) -> str:
    """The main text of a whole page."""
    if not page:
        return ""
    tree = Tree(page)
    density, total, chars, link_chars = densities(tree)
    roots, loose = main_nodes(tree, density, total, chars, link_chars)
    n = len(tree.parent)
    inside, links_only = [False] * n, [False] * n
    for i in roots:
        inside[i] = True
    # Outside an article a list of links before any other text is the page's menu.
    started = any(tree.tag[i] in ("article", "main") for i in roots)
    own = {node for node, text in tree.pieces if text and not text.isspace()}
    for i in range(1, n):
        p = tree.parent[i]
        inside[i] = inside[i] or inside[p]
        links_only[i] = links_only[p] or (not started and tree.tag[i] in ("ul", "ol", "dl") and chars[i] > 0 and link_chars[i] == chars[i])
        started = started or inside[i] and i in own and not links_only[i]
    blocks, now = [], []

    def end_block():
        if line := " ".join("".join(now).split()):
            blocks.append(line)
        now.clear()

    for k, (node, text) in enumerate(tree.pieces):
        if text is None:
            end_block()
        elif (inside[node] or k in loose) and not links_only[node]:
            now.append(text)
    end_block()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
