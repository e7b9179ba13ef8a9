"""Main text of web pages by consensus host paths.

Each page's containers are scored and its best one votes with its generalised path (tags and classes, digits dropped).
Spark counts the votes of each host, and what the host's pages say about each path: how much of their text lies there, and
how much of it is the same on many of them. A page is then extracted again without the paths that its host knows as no part
of an article, by its own path if that won, else by the first of its host's winning paths that it has.

Containers are a tree, numbered as they open; a path is a 64-bit hash of its parent's and its own label. So a page takes
time in proportion to its length, however deep it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm._common import written

#: How HTML elements behave, and names that mark what is not the article.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "select", "object", "canvas", "title"}
CONTAINERS = {"html", "head", "body", "main", "article", "section", "div", "aside", "nav", "header", "footer", "form", "table", "ul", "ol", "dl", "fieldset", "figure", "details", "dialog", "menu", "button"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
WHOLE = {"html", "body", "main", "article"}
PARTS = {"ul", "ol", "dl", "menu", "table", "figure"}
NEVER = {"head", "nav", "footer", "aside", "form", "menu", "button", "dialog", "fieldset"}
NOISE_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "replies", "reply", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
LONG_WORDS = {w for w in NOISE_WORDS if len(w) > 4}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}

#: Possessive, and with a bound on a tag's quoted parts, so that broken markup is read in about one go: a tag whose quotes
#: don't close ends at its first `>`, one that never ends takes the rest.
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]{0,65536}+"|'[^']{0,65536}+'){0,200}+|[^>]*+)(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: How sure a container is no part of the article: by a part of its class or id, by a whole one, by its tag or role, by being hidden.
HINTED, NAMED, FIRM, HIDDEN = 1, 2, 3, 4
#: A path wins if it has this share of its host's votes: so at most five paths win, whatever the number of pages.
WIN_SHARE = 0.2
#: A hinted container is no part of the article if it holds less than this share of the worth; of the host's pages together
#: where this share of them has its path.
LEAST_WORTH, KNOWN_SHARE = 0.5, 0.05
#: A text is repeated if at least so many different pages of the host and this share of them have it under the same path; a
#: path outside articles is no part of them if this share of its characters is repeated.
LEAST_PAGES, PAGE_SHARE, REPEATED_SHARE = 3, 0.3, 0.9
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def _named(value: str) -> int:
    """NAMED if a class or id is a noise word, HINTED if one of its words is or begins with one of five letters or more."""
    found = 0
    for token in value.split():
        if token.lower() in NOISE_WORDS:
            return NAMED
        for part in NAME_PART.findall(token):
            word = part.lower()
            if word in NOISE_WORDS or any(word.startswith(w) for w in LONG_WORDS):
                found = HINTED
    return found


def _label(tag: str, attributes: str) -> tuple[str, int]:
    """A container's generalised name, and how its name or attributes mark it as no part of an article (0: not)."""
    noise = FIRM if tag in NEVER else 0
    if not attributes or attributes.isspace():
        return tag, noise
    classes: list[str] = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if tag not in WHOLE:
                noise = max(noise, _named(value))
            if name == "class":
                classes += [re.sub(r"[^A-Za-z_-]", "", c) for c in value.split()]
        elif name == "role":
            if tag not in WHOLE and value.lower() in NOISE_ROLES:
                noise = max(noise, FIRM)
        elif tag in ("html", "body"):
            continue
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            noise = HIDDEN
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            noise = HIDDEN
    return ".".join([tag, *sorted({c for c in classes if c})]), noise


class Page:
    """A page's containers, by number in the order in which they open (0 is the page), and its blocks."""

    def __init__(self, html: str | None):
        self.parent, self.tag, self.key = [0], [""], [0]
        #: own mark of each container, what it is marked by above hints, whether it lies in an article or main, holds an h1
        self.mark, self.noise, self.article, self.headed = [0], [0], [False], [False]
        #: (container, text, characters inside links)
        self.blocks: list[tuple[int, str, int]] = []
        if html:
            self._read(html)

    def _open(self, now: int, tag: str, attributes: str) -> int:
        label, mark = _label(tag, attributes)
        # an article's own header holds its headline
        if tag == "header" and not self.article[now]:
            mark = max(mark, FIRM)
        # whatever the containers around it are called, main is no noise
        noise = 0 if tag == "main" and self.noise[now] == NAMED else self.noise[now]
        self.parent.append(now)
        self.tag.append(tag)
        self.key.append(xxhash.xxh64_intdigest(label, self.key[now] & (2**64 - 1)) - 2**63)
        self.mark.append(mark)
        self.noise.append(max(noise, mark) if mark > HINTED else noise)
        self.article.append(self.article[now] or tag in ("article", "main"))
        self.headed.append(False)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        now, open_, words = 0, Counter(), []
        in_link, linked, at = False, 0, 0

        def flush() -> None:
            nonlocal linked, in_link
            if words:
                text = " ".join(unescape("".join(words)).split())
                if text:
                    self.blocks.append((now, text, min(linked, len(text))))
                words.clear()
            # a link that isn't closed ends with its block
            linked, in_link = 0, False

        while True:
            found = TOKEN.search(html, at)
            piece = html[at : found.start() if found else len(html)]
            if piece:
                words.append(piece)
                if in_link:
                    linked += len(piece)
            if not found:
                break
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                if tag == "a":
                    in_link = False
                elif tag not in INLINE:
                    flush()
                    if open_[tag]:
                        while True:
                            last, now = self.tag[now], self.parent[now]
                            open_[last] -= 1
                            if last == tag:
                                break
            elif tag in INLINE:
                in_link = in_link or tag == "a"
            elif tag == "br":
                words.append("\n")
            else:
                flush()
                if tag in RAW:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                elif tag == "h1":
                    up = now
                    while up and not self.headed[up]:
                        self.headed[up] = True
                        up = self.parent[up]
                elif tag in CONTAINERS and not found[3].endswith("/"):
                    now = self._open(now, tag, found[3])
                    open_[tag] += 1
        flush()

    def worth(self, blocks: list[tuple[int, str, int]]) -> list[int]:
        """The worth of each container with all that is in it."""
        out = [0] * len(self.tag)
        for node, text, linked in blocks:
            out[node] += _worth(text, linked)
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += out[node]
        return out

    def hinted(self) -> list[tuple[int, int, int]]:
        """(key, worth, worth of the page) of containers outside surer noise that a part of their name hints at; not those with an h1."""
        clean = [b for b in self.blocks if not self.noise[b[0]]]
        worth = self.worth(clean)
        return [(self.key[k], worth[k], worth[0]) for k in range(1, len(self.tag)) if self.mark[k] == HINTED and not self.noise[k] and not self.headed[k]]

    def clean(self, dropped: frozenset = frozenset(), kept: frozenset = frozenset()) -> list[tuple[int, str, int]]:
        """Blocks outside noise. Paths in `dropped` and hinted containers without enough worth are noise, those in `kept` aren't.

        Where nothing outside noise has worth, blocks in the least sure noise that has some come too; on a page
        without worth at all, all blocks outside noise, else all that aren't hidden.
        """
        worth = self.worth([b for b in self.blocks if not self.noise[b[0]]])
        noise = list(self.noise)
        for k in range(1, len(noise)):
            above = noise[self.parent[k]]
            own = HINTED if self.key[k] in dropped or (self.mark[k] == HINTED and not self.headed[k] and self.key[k] not in kept and worth[k] < LEAST_WORTH * worth[0]) else 0
            noise[k] = max(noise[k], own, above if above == HINTED and self.tag[k] != "main" else 0)
        for most in (0, HINTED, NAMED, FIRM, HIDDEN):
            some = [b for b in self.blocks if noise[b[0]] <= most]
            if any(_worth(text, linked) for _, text, linked in some):
                return some
        for most in (0, NAMED, FIRM):
            if some := [b for b in self.blocks if noise[b[0]] <= most]:
                return some
        return []

    def best(self, blocks: list[tuple[int, str, int]]) -> tuple[int, int] | None:
        """The deepest container that holds all worth of the blocks, and the worth. Lists, tables and figures are parts of
        an article and never it: the container around them is taken, and the article around what is in one."""
        worth = self.worth(blocks)
        if not worth[0]:
            return None
        chain = [max(k for k, x in enumerate(worth) if x == worth[0])]
        while chain[-1]:
            chain.append(self.parent[chain[-1]])
        chain.reverse()
        end = next((k for k, n in enumerate(chain) if self.tag[n] in PARTS), len(chain))
        end = next((k + 1 for k in range(end - 1, -1, -1) if self.tag[chain[k]] == "article"), end)
        return chain[end - 1], worth[0]

    def text(self, paths: list[int], dropped: frozenset = frozenset(), kept: frozenset = frozenset()) -> str:
        """The blocks under the page's own best container if its path is one of `paths`, else under the first of these
        that has worth on the page, else under its own; all of a page without worth."""
        blocks = self.clean(dropped, kept)
        best = self.best(blocks)
        if not best:
            return " ".join(text for _, text, _ in blocks)
        own = self.key[best[0]]
        for path in [*([own] if own in paths else []), *paths, own]:
            inside = [False] * len(self.tag)
            for k in range(len(inside)):
                inside[k] = self.key[k] == path or (k > 0 and inside[self.parent[k]])
            some = [b for b in blocks if inside[b[0]]]
            if any(_worth(text, linked) for _, text, linked in some):
                return " ".join(text for _, text, _ in some)
        return ""


def blocks(html: str | None) -> list[tuple[int, str, int]]:
    """The blocks of a page in order, without those in noise: (path of containers, text, characters inside links)."""
    page = Page(html)
    return [(page.key[node], text, linked) for node, text, linked in page.clean()]


def _worth(text: str, linked: int) -> int:
    """A block's worth: its text outside links and its sentences; none for lists of links."""
    return max(0, len(text) - 2 * linked) + 20 * len(re.findall(r"[.!?](?:\s|$)", text)) * (linked == 0)


def host_rules(pages: DataFrame) -> DataFrame:
    """(host, paths, dropped, kept): the winning paths of each host, most votes first, and what its pages together say about others.

    Rows grow with the hosts only; each list is bounded: a path is on it only for a share of the host's pages. Pages
    that are equal block by block count once where repeated text is looked for.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html)
                clean = page.clean()
                if best := page.best(clean):
                    rows.append((host, "vote", page.key[best[0]], best[1], 0, 0, 0))
                rows += [(host, "hint", key, worth, all_, 0, 0) for key, worth, all_ in page.hinted()]
                whole = xxhash.xxh3_64_intdigest("\n".join(t for _, t, _ in page.blocks)) - 2**63
                for node, text, _ in page.blocks:
                    if not page.noise[node] and not page.article[node] and page.tag[node] not in WHOLE and node:
                        rows.append((host, "text", page.key[node], len(text), 0, xxhash.xxh3_64_intdigest(text) - 2**63, whole))
            kinds = (pa.string(), pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["host", "what", "path", "size", "total", "text", "page"])

    facts = written(with_host(pages).select("host", "html").mapInArrow(seen, "host string, what string, path long, size long, total long, text long, page long"), "pages")
    of_host = Window.partitionBy("host")

    votes = facts.where("what = 'vote'").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("size").alias("score"))
    votes = votes.withColumn("all", F.sum("votes").over(of_host)).where(F.col("votes") >= WIN_SHARE * F.col("all"))
    ranked = F.sort_array(F.collect_list(F.struct(-F.col("votes"), -F.col("score"), "path")))
    won = votes.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"), F.first("all").alias("voters"))

    hints = facts.where("what = 'hint'").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("total").alias("total"))
    small = F.col("size") < LEAST_WORTH * F.col("total")
    hints = hints.join(won.select("host", "voters"), "host").where(F.col("n") >= KNOWN_SHARE * F.col("voters")).select("host", "path", small.alias("drop"))

    texts = facts.where("what = 'text'").groupBy("host", "path", "text", "page").agg(F.max("size").alias("size")).groupBy("host", "path", "text").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    distinct = facts.where("what = 'text'").select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    texts = texts.join(distinct, "host").withColumn("again", (F.col("n") >= LEAST_PAGES) & (F.col("n") >= PAGE_SHARE * F.col("pages")))
    chars = F.col("n") * F.col("size")
    said = texts.groupBy("host", "path").agg(F.sum(chars).alias("chars"), F.sum(F.when(F.col("again"), chars).otherwise(0)).alias("again"), F.first("pages").alias("pages"))
    # a path that holds most of the host's text is its articles, whatever repeats in it
    said = said.withColumn("all", F.sum("chars").over(of_host)).where((F.col("again") >= REPEATED_SHARE * F.col("chars")) & (F.col("again") > 0) & (F.col("chars") < LEAST_WORTH * F.col("all")))
    known = hints.unionByName(said.select("host", "path", F.lit(True).alias("drop")))
    known = known.groupBy("host").agg(F.collect_set(F.when(F.col("drop"), F.col("path"))).alias("dropped"), F.collect_set(F.when(~F.col("drop"), F.col("path"))).alias("kept"))
    return won.drop("voters").join(known, "host", "full")


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.coalesce(F.regexp_extract(F.lower("url"), HOST, 1), F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text, as do pages without text. Pages whose url is null or has no host vote
    together. Every row gives a row, repeated ones and those with a null page_id too; no rows give none; other columns
    are ignored. Pages may be of any length and depth. The hosts' rules are a written table, so its size is known when
    the join is planned: it is broadcast only under Spark's threshold.
    """
    rules = written(host_rules(pages), "hosts").withColumnRenamed("host", "rule_host")
    joined = with_host(pages.select("page_id", "url", "html")).join(rules, F.col("host") == F.col("rule_host"), "left")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(k).to_pylist() for k in range(2, 6)]
            texts = [Page(h).text(p or [], frozenset(d or []), frozenset(k or [])) for h, p, d, k in zip(*given, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "paths", "dropped", "kept").mapInArrow(again, f"page_id {kind}, url string, text string, n_chars long")
