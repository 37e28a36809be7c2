"""Main text of web pages by composite text density.

Every DOM node has characters C, tags T, link characters LC and link tags LT (of its subtree).  Its density is
``C/T * log_b(C/LC * T/LT)`` with ``b = ln(C/(C-LC) * LC + LCbody/Cbody * C + e)``, so link lists are pushed down.  The
subtree whose children's densities have the largest sum is the seed (inline elements belong to their block); the least
density on its path up to the body is the threshold.  The seed and every other subtree that reaches the threshold are
content.  Where these make up most of the text of the nearest node around them, below the body, all of that node is
content; around the seed an ``article`` or ``main`` element needs half of its text for that.  Headings beside content
belong to it.

Menus, forms, asides and hidden elements are left out wherever they stand.  Words of class, id and role (adverts, comments
and the like) and lists of links leave a subtree out only beside the seed and such regions; inside them only marks on what is mostly
links, or a class or id that is wholly the name of an advert or of comments.  A subtree with more than half of the page's
text that isn't links is only left out if the mark is its whole class or id, and not if less than a fifth of the text
would be left; if it still would be, no mark counts.

Blocks are the block-level elements; white space in them becomes one space, they are joined by a line feed in page
order.  Null and empty pages give an empty text.  Broken markup (unclosed or stray tags, cut-off pages) is read as
browsers do in the usual cases.  Time is in proportion to the page, however long or deep it is.  Equal sums go to the
first node of the page.  Repeated rows are extracted each; an empty table gives an empty result; only the columns asked
for and the html are read, whatever others are called.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from math import e, log

from pyspark.sql import DataFrame

from kvlake.llm.common import arrow_map

# Fixed values of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: An opening tag closes the nearest of these, if it stands above any of those.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TOP = {"#root", "html", "body"}
#: Share of a region's text that must be kept for the whole region to be content.
MOST = 0.8
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements and words of class, id and role that mark what is not the article.
NOT_TEXT = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "input", "menu", "dialog", "svg", "canvas", "object", "embed", "audio", "video", "map", "math"}
NOT_WORDS = {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "sidebar", "aside", "widget",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "alertdialog", "dialog", "modal", "popup", "overlay", "toolbar", "share", "sharing", "social", "related", "recommended",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "masthead", "contentinfo", "complementary", "skip", "teaser",
}
#: Those that leave a part out of an article too, where they are a whole class or id.
NOT_INSIDE = {"ad", "ads", "adv", "advert", "advertisement", "adverts", "advertising", "sponsored", "comments", "commentlist", "disqus"}

_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARKS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_ENDS = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """A DOM in arrays: parents come before their children."""

    def __init__(self, html: str):
        self.tag, self.parent, self.out, self.mark = ["#root"], [-1], [False], [0]
        #: Places in the stack of open elements: of each tag, and of all that aren't inline.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.items: list[tuple[int, str | None]] = []
        self._below_of: dict[int, list[int]] = {}
        self._read(html)
        self._measure()

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            self._close_within(stack, {"p"}, {"div", "section", "article", "td", "th", "li", "blockquote", "body", "main", "table", "button"})
        if tag in SIBLINGS:
            self._close_within(stack, *SIBLINGS[tag])
        node = len(self.tag)
        out = tag in NOT_TEXT or tag == "header" and not (self.places["article"] or self.places["main"])
        mark = 0
        if attributes and not out:
            marks = [m[1].strip("\"'") for m in _MARKS.findall(attributes)]
            # 1: a word of a name, 2: a whole name, 3: a whole name that counts inside the article as well.
            if tag not in ("html", "body", "article", "main") and any(not NOT_WORDS.isdisjoint(_WORDS.findall(_CAMEL.sub(" ", m).lower())) for m in marks):
                names = {name for m in marks for name in m.lower().split()}
                mark = 1 if names.isdisjoint(NOT_WORDS) else 2 if names.isdisjoint(NOT_INSIDE) else 3
            out = bool(_HIDDEN.search(attributes))
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.out.append(out)
        self.mark.append(mark)
        self.items.append((node, None))
        if tag not in VOID:
            self.places[tag].append(len(stack))
            if tag not in INLINE:
                self.blocks.append(len(stack))
            stack.append(node)

    def _cut(self, stack: list[int], at: int) -> None:
        """Close all elements from a place in the stack on."""
        for node in reversed(stack[at:]):
            tag = self.tag[node]
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
        del stack[at:]

    def _close_within(self, stack: list[int], tags: set[str], walls: set[str]) -> None:
        """Close the nearest open element of these tags, if no wall stands nearer."""
        near = max((self.places[t][-1] for t in tags if self.places[t]), default=0)
        if near and near > max((self.places[t][-1] for t in walls if self.places[t]), default=0):
            self._cut(stack, near)

    def _read(self, html: str) -> None:
        stack, at, n = [0], 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.items.append((stack[-1], html[at:lt]))
            if lt == n:
                return
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), lt):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            closing = html.startswith("</", lt)
            name = _NAME.match(html, lt + 1 + closing)
            if not name:
                end = html.find(">", lt) if closing else lt
                if not closing:
                    self.items.append((stack[-1], "<"))
                at = n if end < 0 else end + 1
                continue
            tail = _ATTRIBUTES.match(html, name.end())
            end = tail.end() if tail else html.find(">", name.end()) + 1
            if not end:
                return
            tag = name[0].lower()
            at = end
            if closing:
                place = self.places[tag][-1] if self.places[tag] else 0
                # The end of an inline element reaches no further than the block around it.
                if place and (tag not in INLINE or not self.blocks or place > self.blocks[-1]):
                    self._cut(stack, place)
                elif tag == "p":
                    self.items.append((stack[-1], None))
                continue
            if tag in RAW:
                close = _ENDS[tag].search(html, at)
                end = n if not close else html.find(">", close.end()) + 1 or n
                at = end
                continue
            self._open(stack, tag, html[name.end() : end - 1])

    def _measure(self) -> None:
        n = len(self.tag)
        own = [0] * n
        for node, text in self.items:
            if text:
                own[node] += len("".join(text.split()))
        chars, tags, link_chars, link_tags = own, [1] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if self.tag[i] == "a":
                link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
            p = self.parent[i]
            chars[p] += chars[i]
            tags[p] += tags[i]
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i]
        share = link_chars[0] / chars[0] if chars[0] else 0.0
        self.density = [0.0] * n
        self.chars, self.link_chars = chars, link_chars
        for i in range(n - 1, -1, -1):
            if c := chars[i]:
                lc, lt = max(link_chars[i], 1), max(link_tags[i], 1)
                base = log(c / max(c - lc, 1) * lc + share * c + e)
                self.density[i] = c / tags[i] * max(log(c / lc * tags[i] / lt), 0.0) / log(base)

    def _below(self, marked: list[bool]) -> list[bool]:
        """Marked nodes and all that stand in them."""
        gone = list(marked)
        for i in range(1, len(gone)):
            gone[i] = gone[i] or gone[self.parent[i]]
        return gone

    def _left_out(self) -> list[bool]:
        """What is left out beside the content, by its element or its marks."""
        plain = [c - lc for c, lc in zip(self.chars, self.link_chars, strict=True)]
        left = lambda gone: plain[0] - sum(plain[i] for i in range(1, len(gone)) if gone[i] and not gone[self.parent[i]])
        out = self._below(self.out)
        total = left(out)
        if not any(self.mark):
            return out
        # All whole names, then only small subtrees, then no marks.
        for whole in (2, 4):
            gone = self._below([o or m >= whole or m > 0 and 2 * c <= total for o, m, c in zip(out, self.mark, plain, strict=True)])
            if 5 * left(gone) >= total and (total or any(c and not g for c, g in zip(self.chars, gone, strict=True))):
                return gone
        return out

    def content(self) -> list[bool]:
        """Which nodes belong to the main text; ``seed`` and ``threshold`` are left behind."""
        n = len(self.tag)
        left_out = self._left_out()
        # Lists and tables that are mostly links are menus without a mark.
        gone = self._below([g or self.tag[i] in ("ul", "ol", "table") and self.link_chars[i] > 0.6 * self.chars[i] > 0 for i, g in enumerate(left_out)])
        alive = [i for i in range(n) if not gone[i] and self.chars[i]]
        if not alive:
            return [False] * n
        sums = [0.0] * n
        for i in range(1, n):
            # Inline elements are part of their block.
            if not left_out[i] and self.tag[i] not in INLINE:
                sums[self.parent[i]] += self.density[i]
        self.seed = seed = max(alive, key=lambda i: (sums[i], self.density[i] if not sums[i] else 0.0, -i))
        path, node = [], seed
        while node > 0:
            path.append(node)
            node = self.parent[node]
        self.threshold = min((self.density[i] for i in path), default=0.0)
        above = set(path)
        kept = {seed} | {i for i in alive if i and self.density[i] >= self.threshold and i not in above and self.tag[i] not in INLINE}
        wide = {seed} | self._regions(kept, gone, path)
        kept |= wide
        if wide := {i for i in wide if self.tag[i] not in TOP}:
            # Inside the content, marks count less and lists of links belong to it.
            within = [False] * n
            for i in range(1, n):
                within[i] = i in wide or within[self.parent[i]]
            out = self._below([self.out[i] or within[i] and i not in wide and (self.mark[i] == 3 or self.mark[i] > 0 and 2 * self.link_chars[i] > self.chars[i]) for i in range(n)])
            gone = [out[i] if within[i] else g for i, g in enumerate(gone)]
        beside = {self.parent[i] for i in kept}
        kept |= {i for i in alive if self.tag[i] in HEADINGS and (p := self.parent[i] if self.tag[self.parent[i]] not in ("header", "hgroup") else self.parent[self.parent[i]]) >= 0 and p in beside}
        inside = [False] * n
        for i in range(n):
            inside[i] = not gone[i] and (i in kept or i > 0 and inside[self.parent[i]])
        return inside

    def _regions(self, kept: set[int], gone: list[bool], path: list[int]) -> set[int]:
        """Nodes around kept ones that are content as a whole, since kept text makes up most of theirs.

        These are, in each branch below the body, the nearest node around all that is kept in it, from MOST of its text on,
        and an ``article`` or ``main`` around the seed, from half of it on.
        """
        n = len(self.tag)
        held, count, text, lost = [False] * n, [0] * n, [0] * n, [0] * n
        for i in range(n):
            held[i] = i in kept or i > 0 and held[self.parent[i]]
        plain = [c - lc for c, lc in zip(self.chars, self.link_chars, strict=True)]
        for i in range(n - 1, -1, -1):
            p = self.parent[i]
            if gone[i]:
                lost[i] = plain[i]
            if held[i] and not (i and held[p]):
                count[i], text[i] = 1, plain[i] - lost[i]
            if i:
                lost[p] += lost[i]
                count[p] += count[i]
                text[p] += text[i]
        all_text = [c - x for c, x in zip(plain, lost, strict=True)]  # what is left out counts neither way
        found = set()
        for i in range(1, n):
            if count[i] > 1 and self.tag[self.parent[i]] in TOP and self.tag[i] not in TOP:
                node, inner = i, i
                while inner is not None:
                    node, inner = inner, next((c for c in self._children(inner) if count[c] == count[i]), None)
                if text[node] >= MOST * all_text[node]:
                    found.add(node)
        found |= {i for i in path if self.tag[i] in ("article", "main") and 2 * text[i] >= all_text[i]}
        return found

    def _children(self, node: int) -> list[int]:
        if not self._below_of:
            for i in range(1, len(self.tag)):
                self._below_of.setdefault(self.parent[i], []).append(i)
        return self._below_of.get(node, [])

    def text(self) -> str:
        inside = self.content()
        block = list(range(len(self.tag)))
        for i in range(1, len(block)):
            if self.tag[i] in INLINE:
                block[i] = block[self.parent[i]]
        blocks: list[list[str]] = [[]]
        last = -1
        for node, text in self.items:
            if text is None and self.tag[node] == "br":
                blocks[-1].append(" ")
            if block[node] != last or text is None and self.tag[node] not in INLINE:
                blocks.append([])
                last = block[node]
            if text and inside[node]:
                blocks[-1].append(text)
        lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
        return "\n".join(line for line in lines if line)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract_pages(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The ``keep`` columns of every page, its text and n_chars (code points)."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return arrow_map(pages.select(*keep, html_col), run, schema)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    from kvlake.llm.common import table

    return extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])
