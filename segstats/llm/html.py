"""Main text of web pages by composite text density.

A page becomes a tree of its block elements; elements that are never main text
(by their name or role, or hidden) are in it as well, end like any others, and
count as absent afterwards.  So do forms and elements with certain whole words in
class or id, unless they hold the main node of the tree that has them all, text
in a <main>, or most of the text.  Every other node has the characters per tag of its subtree, adjusted for the
share of linked characters and link tags.  The densest node sets a threshold:
the least density on its way to the body.  From the body down, each node at or
above the threshold gives the subtree with the largest sum of child densities;
the smallest block around these is the article.

Defined results: null or empty html, and a page without text, give the empty
text; unclosed and misnested elements are closed where the next block needs it;
a tag cut off by the end of the page is dropped; repeated rows are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: names of HTML elements and usual words of class names
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
NEVER = frozenset("""aside button canvas dialog embed footer form head iframe input label legend menu nav noscript object optgroup option script search select style svg
 template textarea title video audio""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_MAIN = frozenset("""ad ads adbox adsense advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
 disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo
 promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets""".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# ---- end of fixed values

_IN_HEAD = frozenset("base head html link meta noscript script style svg template title".split())
_SIBLINGS = {"a": {"a"}, "button": {"button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|iframe|template|svg(?!(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>))(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z/!?][^>]*\Z",
    re.DOTALL | re.IGNORECASE)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


KEPT, DOUBTED, NEVER_MAIN = 0, 1, 2
#: Words in class or id by which an <article> is a reader's comment.
OF_READERS = {"comment", "comments"}


def _left_out(name: str, attributes: str, inside_main: bool) -> int:
    """Whether an element is never main text, or DOUBTED: a form, or one with words in class or id that may be about its neighbours."""
    if (name in NEVER and name != "form") or (name == "header" and not inside_main):
        return NEVER_MAIN
    out = DOUBTED if name == "form" else KEPT
    if not attributes or name in ("html", "body", "main"):
        return out
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES - {"form"}):
            return NEVER_MAIN
        if key == "role" and value.lower() == "form":
            out = DOUBTED
        if key in ("class", "id"):
            words = {w.lower() for w in _PARTS.findall(value)}
            if name == "article":
                words &= OF_READERS
            if words & NOT_MAIN and not (name in ("h1", "header") and inside_main and words & NOT_MAIN <= {"header"}):
                out = DOUBTED
    return out


class Page:
    """Block elements of a page with their own text, in page order."""

    def __init__(self, html: str):
        self.parent, self.name = [-1], ["body"]
        self.texts: list[tuple[int, str]] = []  # a run of text and the node it stands in
        self.chars, self.links, self.tags, self.link_tags = [0], [0], [0], [0]
        self.out = [KEPT]
        open_: list[int] = [0]
        self.where: dict[str, list[int]] = {"body": [0]}  # places of each name in open_
        blocks = [0]  # places of blocks in open_
        inline: set[str] = set()  # names of left-out elements that are no blocks; these are nodes too
        anchors = 0
        outside: dict[int, int] = {}  # open links around a left-out element
        run: list[str] = []
        linked = 0
        at = 0

        def close_run() -> None:
            nonlocal linked
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                node = open_[-1]
                self.texts.append((node, text))
                self.chars[node] += len(text)
                self.links[node] += min(linked, len(text))
            linked = 0

        def add_text(raw: str) -> None:
            nonlocal linked
            if raw:
                text = unescape(raw)
                if self.name[open_[-1]] == "head" and text.strip():
                    close(len(open_) - 1)
                run.append(text)
                if anchors:
                    linked += len(text.strip())

        def close(upto: int) -> None:
            nonlocal anchors
            close_run()
            for node in reversed(open_[upto:]):
                anchors = outside.get(node, anchors)
                self.where[self.name[node]].pop()
            del open_[upto:]
            while blocks[-1] >= upto:
                blocks.pop()

        for m in _TOKEN.finditer(html):
            add_text(html[at : m.start()])
            at = m.end()
            name = (m[3] or m[6] or "").lower()
            if not name:
                continue
            if m[2] or m[5]:
                found = 0
                if name in BLOCKS or name in inline:
                    found = self._last(name)
                if found:
                    close(found)
                elif name == "a":
                    anchors = max(0, anchors - 1)
                elif name == "p":
                    close_run()
                continue
            attributes = m[4] or m[7] or ""
            if self.name[open_[-1]] == "head" and name not in _IN_HEAD:
                close(len(open_) - 1)
            if name in VOID:
                if name == "br":
                    run.append(" ")
                elif name == "hr":
                    close_run()
                self.tags[open_[-1]] += name not in ("br", "wbr")
                continue
            inside_main = self._last("article", "main") > 0
            out = _left_out(name, attributes, inside_main)
            if out and attributes.rstrip().endswith("/"):
                close_run()
                continue
            if name in BLOCKS or name in inline:
                if name in BLOCKS and self.name[open_[blocks[-1]]] == "p":
                    close(blocks[-1])
                sibling = self._last(*_SIBLINGS.get(name, ()))
                if sibling > self._last(*_SCOPES.get(name, ())):
                    close(sibling)
            if name in BLOCKS and name != "body" or out or name in inline and self._last(name):
                close_run()
                self.parent.append(open_[-1])
                self.name.append(name)
                self.out.append(out)
                for counts in (self.chars, self.links, self.tags, self.link_tags):
                    counts.append(0)
                open_.append(len(self.name) - 1)
                self.where.setdefault(name, []).append(len(open_) - 1)
                if out:
                    outside[open_[-1]] = anchors
                if name in BLOCKS:
                    blocks.append(len(open_) - 1)
                    anchors = 0
                else:
                    inline.add(name)
            elif name == "a":
                anchors += 1
                self.link_tags[open_[-1]] += 1
                self.tags[open_[-1]] += 1
        add_text(html[at:])
        close_run()

    def _last(self, *names: str) -> int:
        """Place of the innermost open element with one of the names; 0 without any."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def left_out(self) -> list[bool]:
        """For every node whether it is in a left-out element.

        Doubted elements stay if they hold the main node of all that is not
        NEVER_MAIN, text in a <main>, or most of the text; but not beside a
        <main> with text, nor without blocks of their own where an <article> or
        <main> outside has text.  If nothing else is left, the one with the
        most text stays.
        """
        n = len(self.out)
        gone = [o == NEVER_MAIN for o in self.out]
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.parent[i]]
        doubted = [i for i in range(n) if self.out[i] == DOUBTED and not gone[i]]
        if not doubted:
            return gone
        chars = [0 if g else c for g, c in zip(gone, self.chars)]
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        inside = [False] * n  # of a doubted element
        in_main = [name == "main" for name in self.name]
        for i in range(1, n):
            inside[i] = self.out[i] == DOUBTED or inside[self.parent[i]]
            in_main[i] = in_main[i] or in_main[self.parent[i]]
        over_main = [name == "main" and c > 0 for name, c in zip(self.name, chars)]
        for i in range(n - 1, 0, -1):
            over_main[self.parent[i]] = over_main[self.parent[i]] or over_main[i]
        mains = {i for i in range(n) if over_main[i]}
        marked = any(self.name[i] in ("article", "main") and chars[i] and not inside[i] for i in range(n))
        blocks = set(self.parent)
        main_path = set(self.path(self.main_node(gone)))
        holds = mains | {i for i in doubted if (i in main_path or 2 * chars[i] > chars[0]) and (not mains or in_main[i]) and (not marked or i in blocks)}

        def without() -> list[bool]:
            out = list(gone)
            for i in range(1, n):
                out[i] = out[i] or out[self.parent[i]] or (self.out[i] == DOUBTED and i not in holds)
            return out

        left = without()
        if chars[0] and not any(c for c, g in zip(self.chars, left) if not g):
            holds.update(self.path(max(doubted, key=lambda i: (chars[i], i))))
            left = without()
        return left

    def densities(self, gone: list[bool]) -> tuple[list[float], list[float]]:
        """Composite density of every node, and the sum over its children (a leaf: its own); nodes that are ``gone`` count as absent."""
        n = len(self.name)
        c, lc, t, lt = list(self.chars), list(self.links), list(self.tags), list(self.link_tags)
        for i in range(n - 1, 0, -1):
            if gone[i]:
                continue
            p = self.parent[i]
            c[p] += c[i]
            lc[p] += lc[i]
            t[p] += t[i] + 1
            lt[p] += lt[i]
        body = lc[0] / max(1, c[0])
        density = []
        for i in range(n):
            if gone[i] or not c[i]:
                density.append(0.0)
                continue
            base = math.log(c[i] / max(1, c[i] - lc[i]) * lc[i] + body * c[i] + math.e)  # above 1 in a page with links
            ratio = c[i] / max(1, lc[i]) * max(1, t[i]) / max(1, lt[i])
            density.append(max(0.0, c[i] / max(1, t[i]) * math.log(ratio) / (math.log(base) if body else 1.0)))
        sums = [0.0] * n
        has_child = [False] * n
        for i in range(1, n):
            if gone[i]:
                continue
            sums[self.parent[i]] += density[i]
            has_child[self.parent[i]] = True
        return density, [s if h else d for s, h, d in zip(sums, has_child, density)]

    def path(self, node: int) -> list[int]:
        out = [node]
        while out[-1]:
            out.append(self.parent[out[-1]])
        return out

    def main_node(self, gone: list[bool]) -> int:
        """Root of the article."""
        density, sums = self.densities(gone)
        n = len(density)
        if n == 1:
            return 0
        densest = max(range(1, n), key=lambda i: (density[i], -i))
        threshold = min(density[i] for i in self.path(densest))
        best = list(range(n))  # the node of the largest sum in each subtree
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if (sums[best[i]], -best[i]) > (sums[best[p]], -best[p]):
                best[p] = best[i]
        chosen, reached = [], [False] * n
        for i in range(n):
            reached[i] = density[i] >= threshold and (i == 0 or reached[self.parent[i]])
            if reached[i] and sums[best[i]] > 0:
                chosen.append(best[i])
        # Nodes are numbered in page order, so what is around the first and the last is around all.
        around = set(self.path(min(chosen))) & set(self.path(max(chosen))) if chosen else {0}
        root = max(around)  # parents come before their children
        holder = [i for i in self.path(root) if self.name[i] in ("article", "main")]
        return holder[-1] if holder else root

    def text(self) -> str:
        gone = self.left_out()
        root = self.main_node(gone)
        inside = [i == root for i in range(len(self.name))]
        for i in range(root + 1, len(self.name)):
            inside[i] = inside[self.parent[i]] and not gone[i]
        return "\n".join(t for node, t in self.texts if inside[node])


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
