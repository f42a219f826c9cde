"""Main text of web pages by consensus of the pages of a host.

Each page's containers are scored by the share of the page's running text they hold, how clean that text is and how
deep they lie. The best of each page vote for their generalised tag-class path; votes are summed per host in Spark, and
every page is read again at the path that won on its host. A page without that path, or with no text there, is read at
its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are told by tag, role, class
and id and left out everywhere. Words in a class or id count on blocks only, and inside an article or main not on headings,
paragraphs, lists' items and cells, nor where the name has words of its own (``social-history``): marks in code, links and
sections on such things are text. What only a word or a form tag tells is kept where it wraps the page's largest article
or main, or over half of the running text of a page without these (not by a name of such words alone): layouts name wrappers by what is in them
(``has-sidebar``, ``no-comments``). A header inside the article keeps its headings.

Defined results: missing or empty html gives an empty text; missing urls vote together as one host; unclosed tags end
with the element around them, unclosed scripts and comments with the page; a page without any container is read as
one; repeated rows vote as often as they occur and each gives its row."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import escape, unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarte.llm.common import join_small, longs, stage

LONGEST = 4000  #: characters of a path; elements nested deeper belong to the container around them
TOP = 1  #: containers of a page that get its vote

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg canvas audio video xmp".split())
SHOWN = frozenset({"xmp"})  #: read as they are written, and shown
SKIP = frozenset("nav footer aside form button select option menu dialog label fieldset head datalist".split()) | (RAW - SHOWN)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary"
    " table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article body center div main section td".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an element that an opening tag closes when it is still open below the nearest element of the second set
CLOSES = {
    "p": ({"p"}, {"div", "article", "section", "main", "body", "li", "td", "blockquote"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "title"}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
DROPPED = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer header masthead topbar banner cookie cookies"
    " consent gdpr notice notices alert ad ads adv advert adverts advertisement advertising adsense sponsor sponsored"
    " promo promotion comment comments disqus respond reply replies share sharing social related recommended newsletter"
    " subscribe subscription signup login popup modal overlay toolbar widget pagination pager search skip hidden".split()
)
#: blocks of running text and their parts, which no word in their name leaves out of an article
PROSE = HEADING | frozenset("p pre blockquote li dt dd td th tr caption figcaption".split())
#: words beside those above that say nothing of what an element holds
PLAIN = frozenset(
    "area bar block blocks body bottom box btn button buttons column container content col count entry feed form group header heading icon icons"
    " inline inner item items left link links list main message messages module msg outer panel post posts region right row section"
    " slot small story stories text thread tile title top unit view wrap wrapper article articles a an and the by for in js ui".split()
)
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
#: what is left out by a word or as a form but may wrap the content: with other words in its name, with none, of comments
WRAPPERS = ("wrap", "holds", "comments")
CONTENT = frozenset("article content entry post story main text body".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PART = re.compile(r"[a-z]+|\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)|^//([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = HOST.match((url or "").strip())
    return ((m[1] or m[2] or "") if m else "").lower()


def dropped(tag: str, attrs: str, in_article: bool) -> tuple[bool, str, str]:
    """Whether an element is left out with all it holds, as what it can be a wrapper for all that, and its step of the
    generalised path."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attrs)} if attrs else {}
    classes = found.get("class", "").split()
    step = ".".join([tag, *sorted({re.sub(r"\d+", "0", c.lower()) for c in classes})])
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    if hidden or found.get("role", "").lower() in DROPPED_ROLES:
        return True, "", step
    if tag == "form":
        return True, "wrap", step
    if tag in SKIP or tag == "header" and not in_article:
        return True, "", step
    if not found or tag in ("body", "html", "article", "main"):
        return False, "", step
    if tag not in BLOCK or in_article and tag in PROSE:
        return False, "", step
    for name in (*classes, found.get("id", "")):
        words = set(PART.findall(CAMEL.sub(" ", name).lower()))
        if in_article and any(w.isalpha() for w in words - DROPPED - PLAIN):
            continue  # a name of more than these words says what the article is about
        if words & DROPPED and not (words & CONTENT and words & DROPPED <= {"header"}):
            return True, "wrap" if any(w.isalpha() for w in words - DROPPED) else "comments" if words & COMMENTS else "holds", step
    return False, "", step


class Page:
    """Blocks of a page in order, each with the container it lies in, and the containers as a tree."""

    def __init__(self, html: str) -> None:
        self.begin()
        self.read(html, frozenset())
        wrappers = self.wrappers()
        if wrappers:
            self.begin()
            self.read(html, wrappers)

    def begin(self) -> None:
        self.paths = [""]  # of containers; 0 is the page itself
        self.parents = [-1]
        self.tags = [""]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self.waste = [0]  # characters left out directly below each container
        self.words: list[str] = []
        self.linked = 0
        self.running = 0  # characters outside links, and outside what is left out for more than a word
        #: possible wrappers, articles and mains: kind, start, end, running text before it and up to its end
        self.watched: list[list] = []

    def wrappers(self) -> frozenset[int]:
        """Starts of elements that a word or a form tag tells to leave out though the page's content is in them."""
        if not any(w[0] in WRAPPERS for w in self.watched):
            return frozenset()
        aside = [w for w in self.watched if w[0] == "comments" and 2 * (w[4] - w[3]) <= self.running]
        largest = []
        for tag in ("article", "main"):
            held = [w for w in self.watched if w[0] == tag and w[4] > w[3]]
            held = [w for w in held if not any(a[1] < w[1] and w[2] <= a[2] for a in aside)]
            if held:
                largest.append(max(held, key=lambda w: (w[4] - w[3], -w[1])))
        kept = set()
        for kind, start, end, before, after in self.watched:
            if kind not in WRAPPERS:
                continue
            inside = any(start < w[1] and w[2] <= end for w in largest)
            if inside or kind == "wrap" and not largest and 2 * (after - before) > self.running:
                kept.add(start)
        return frozenset(kept)

    def close_block(self, container: int) -> None:
        text = " ".join(unescape("".join(self.words)).split()) if self.words else ""
        if text:
            self.blocks.append((container, text, self.linked))
        self.words, self.linked = [], 0

    def read(self, html: str, wrappers: frozenset[int]) -> None:
        # tag, container, path, left out, only headings, left out for more than a word, place among the watched
        stack: list[tuple[str, int, str, bool, bool, bool, int]] = []
        open_: Counter[str] = Counter()  # elements on the stack by tag

        def cut(k: int) -> None:
            for s in stack[k:]:
                open_[s[0]] -= 1
                if s[6] >= 0:
                    self.watched[s[6]][2::2] = [at, self.running]
            del stack[k:]

        container, path, out, headings, hard, at = 0, "", False, False, False, 0
        # beyond the last end of a tag there is only text, or a comment that nothing closes
        tail = html.rfind(">") + 1
        gone = html.find("<!--", tail)
        html = html if gone < 0 else html[:gone]
        while True:
            m = TOKEN.search(html, at, tail) if at < tail else None
            if at < (m.start() if m else len(html)):
                text = html[at : m.start() if m else len(html)]
                if not hard and not open_["a"]:
                    self.running += len(text.strip())
                if out or (headings and not any(open_[h] for h in HEADING)):
                    self.waste[container] += len(text)
                else:
                    self.words.append(text)
                    if open_["a"]:
                        self.linked += len(text.strip())
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:  # closing
                if tag == "br" or tag == "p" and not open_["p"]:
                    self.words.append(" ")
                for k in range(len(stack) - 1 if open_[tag] else -1, -1, -1):
                    if stack[k][0] == tag:
                        if any(s[0] in BLOCK for s in stack[k:]):
                            self.close_block(container)
                        cut(k)
                        break
                    if stack[k][0] in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "body", "html"):
                        break
            else:
                attrs = m[3] or m[6] or ""
                if tag in ENDS_P or tag in CLOSES:
                    which, until = CLOSES.get(tag, (set(), set()))
                    if tag in ENDS_P and tag != "li":
                        which, until = which | {"p"}, until or CLOSES["p"][1]
                    for k in range(len(stack) - 1 if any(open_[w] for w in which) else -1, -1, -1):
                        if stack[k][0] in which:
                            self.close_block(container)
                            cut(k)
                            break
                        if stack[k][0] in until:
                            break
                if tag in BLOCK:
                    self.close_block(stack[-1][1] if stack else 0)
                elif tag in ("br", "img"):
                    self.words.append(" ")
                if tag in VOID or attrs.rstrip().endswith("/") and tag in RAW:
                    container, path, out, headings, hard = stack[-1][1:6] if stack else (0, "", False, False, False)
                    continue
                container, path, out, headings, hard = stack[-1][1:6] if stack else (0, "", False, False, False)
                left_out, wrap, step = dropped(tag, attrs, bool(open_["article"] or open_["main"]))
                if wrap and m.start() in wrappers:
                    left_out = False
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    if tag in SHOWN and not out:
                        self.words.append(escape(html[at : end.start() if end else len(html)]))
                    at = end.end() if end else len(html)
                    continue
                near = len(path) < LONGEST
                if tag in BLOCK and near:
                    path = f"{path}>{step}" if path else step
                out = out or left_out
                hard = hard or (left_out and not wrap)
                kind = wrap or (tag if tag in ("article", "main") else "")
                if kind:
                    self.watched.append([kind, m.start(), len(html), self.running, self.running])
                headings = headings or tag == "header"
                if tag in CONTAINER and not out and near:
                    self.paths.append(path)
                    self.parents.append(container)
                    self.tags.append(tag)
                    self.waste.append(0)
                    container = len(self.paths) - 1
                stack.append((tag, container, path, out, headings, hard, len(self.watched) - 1 if kind else -1))
                open_[tag] += 1
            container, path, out, headings, hard = stack[-1][1:6] if stack else (0, "", False, False, False)
        self.close_block(container)
        at = len(html)
        cut(0)

    def scored(self) -> list[tuple[float, int]]:
        """Containers with running text, best first."""
        n = len(self.paths)
        good, every = [0.0] * n, [float(w) for w in self.waste]
        for c, text, linked in self.blocks:
            every[c] += len(text)
            good[c] += max(0, len(text) - 2 * linked)
        for c in range(n - 1, 0, -1):
            good[self.parents[c]] += good[c]
            every[self.parents[c]] += every[c]
        depth = [0] * n
        found = []
        for c in range(n):
            depth[c] = depth[self.parents[c]] + 1 if c else 0
            if good[c] > 0:
                score = good[c] / good[0] * (good[c] / every[c]) * (1 + 0.1 * min(depth[c], 10))
                score *= 1.3 if self.tags[c] in ("article", "main") else 1.0
                found.append((score, c))
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def text(self, path: str | None) -> str:
        """Blocks in containers at a path; those of the best container without one."""
        chosen = {c for c, p in enumerate(self.paths) if p == path} if path is not None else set()
        got = self.within(chosen)
        if not got:
            best = self.scored()
            got = self.within({best[0][1]}) if best else [t for _, t, _ in self.blocks]
        return "\n".join(got)

    def within(self, chosen: set[int]) -> list[str]:
        inside = [False] * len(self.paths)
        for c in range(len(inside)):
            inside[c] = c in chosen or c > 0 and inside[self.parents[c]]
        return [t for c, t, _ in self.blocks if inside[c]]


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, scores = [], [], []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html or "")
            weight = math.log1p(sum(len(t) for _, t, _ in page.blocks))
            for score, c in page.scored()[:TOP]:
                hosts.append(host_of(url))
                paths.append(page.paths[c])
                scores.append(round(score * weight * 1e6))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), longs(scores)], names=["host", "path", "score"]
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """The path that wins on each host."""
    cast = pages.select("url", "html").mapInArrow(votes, "host string, path string, score long")
    summed = cast.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("score", "path")).alias("path"))


HOST_SQL = r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars of the main text."""
    paths = stage(host_paths(pages))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST_SQL, 1))
    rows = join_small(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host")), paths, "host")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)
            text = [Page(html).text(path) if html else "" for html, path in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), longs([len(t) for t in text])],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.select("page_id", "url", "html", "path").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
