"""HTML main text by consensus on host paths.

First, in every page each container is scored by the text that stands in its own
blocks, less what is in links, plus half of what its inner containers have.  The
page votes for its best container's generalised path: tags and classes from the
root, digits as ``#``.  Spark counts the votes by host, and the path with most
weight wins.  Then each page's text is taken from the containers on its host's
winning path, or from its own best one where none is on it.

Menus, headers, footers, side bars, notices, adverts, forms and comments are
left out by tag, by role, and by a class or id that says nothing else: all its
words name such a part or a mere place or shape.  Where other words stand beside
(``share-price``), or within an article words for its text (``notice-text``) or
nothing but what a text can be about (``promo``, ``copyright``), the name is a
doubt only and the host's pages vote on it too:
elements on that path are left out if most of their text is in links, or if all
have the same text there in three different articles or more; pages with one
text, doubtful elements included, are copies of one article.  Headings in an article's own header
stay.  Where all this leaves a page without text, its classes and ids are not
heeded.

Paths are chained digests, so a page takes time and memory in proportion to its
length however deep it is.

The winners are a row per host (and its doubtful paths); up to ``HOSTS`` of them go to every task, beyond
that they are joined to the pages by host.

Defined cases: a null or empty html, and one without text in any container, give
the empty string; a url without a host, or null, votes with those alike; repeated
rows and copies of an article count once where texts are compared, vote each on
paths, and get equal texts; unclosed and stray tags never fail.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .common import Scratch

HOSTS = 200_000
#: Different articles with an element of one path and one text that is no article's.
REPEATED = 3

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr br img".split()
)
CONTAINERS = frozenset("html body article main section div td blockquote center".split())
#: What a start tag closes, up to the nearest of the second kind.
CLOSES = {
    "p": (frozenset(["p"]), frozenset("article aside blockquote body div footer form header html li main nav section td".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Block tags before which an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())

# What never belongs to an article.
LEFT_OUT_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea iframe svg canvas object embed menu dialog title noembed noframes xmp math audio video datalist".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies sidebar sidebars widget widgets breadcrumb breadcrumbs menu menus nav navbar navigation "
    "pagination pager footer footers header headers masthead toolbar skip hidden search copyright".split()
)
# Words that name a place, a shape or whose part it is.
PLAIN_WORDS = frozenset(
    "wrapper wrap container box bar block blocks list item items section area inner outer left right top bottom middle center main site page user users reader readers global primary secondary slot slots unit units "
    "link links button buttons post posts article articles stories story panel column col row group holder zone region rail large small mobile desktop sticky fixed floating inline body content text form thread count "
    "js the of for and us our more icon icons image images google dfp".split()
)
# Of the words above, those that an article's own text can be about, and those that may name its text.
TOPIC_WORDS = frozenset("banner copyright header headers hidden notice overlay promo promotion recommended related replies reply respond search share sharing skip social subscription toolbar".split())
TEXT_WORDS = frozenset("article articles body content form post posts stories story text".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Longer words that hold one of these mean the same.
_LEFT_OUT_PART = re.compile(r"(?:advert|breadcrumb|cookie|footer|masthead|navbar|newsletter|sidebar|sponsor)|(?:ads|banner|comments|footer|menu|navbar|navigation|sidebar)\Z")
#: Classes that say of a page what stands beside its text.
_LAYOUT = re.compile(r"(?:has|is|no|show|with|without)[-_]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and "=" in text or text.strip(" /"):
        for k, a, b, c in _ATTRIBUTE.findall(text):
            out.setdefault(k.lower(), unescape(a or b or c))
    return out


_KEPT, _DOUBTFUL, _OUT = range(3)


def _named(attributes: dict[str, str], in_article: bool) -> int:
    """What class and id say of an element."""
    worst = _KEPT
    plain = PLAIN_WORDS - TEXT_WORDS if in_article else PLAIN_WORDS
    for name in " ".join(attributes[k] for k in ("class", "id") if k in attributes).split():
        if _LAYOUT.match(name.lower()):
            continue
        words = [w.lower() for w in _WORD.findall(name)]
        out = [(w in LEFT_OUT_WORDS or _LEFT_OUT_PART.match(w) or _LEFT_OUT_PART.search(w)) and not (in_article and w == "header") for w in words]
        if any(out):
            alone = all(o or w in plain for o, w in zip(out, words, strict=True))
            topic = in_article and all(w in TOPIC_WORDS for w in words)
            worst = max(worst, _OUT if alone and not topic else _DOUBTFUL)
    return worst


def _judged(tag: str, attributes: dict[str, str], in_article: bool, by_name: bool) -> int:
    if tag in LEFT_OUT_TAGS or tag == "header" and not in_article:
        return _OUT
    if not attributes or tag in ("html", "body"):
        return _KEPT
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in LEFT_OUT_ROLES:
        return _OUT
    if "style" in attributes and _HIDDEN.search(attributes["style"].lower()):
        return _OUT
    if not by_name or tag in ("article", "main") or re.fullmatch("h[1-6]", tag):
        return _KEPT
    return _named(attributes, in_article)


def _step(tag: str, attributes: dict[str, str]) -> str:
    names = sorted(set(re.sub(r"\d+", "#", attributes.get("class", "")).split()))
    return ".".join([tag, *names])


def _chained(digest: bytes, step: str) -> bytes:
    return blake2b(digest + step.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class _Open:
    """The open elements of a page, and where those of each name stand."""

    def __init__(self) -> None:
        self.stack: list[tuple] = []  # tag, node, left out, in an article
        self.of: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, *rest) -> None:
        self.of.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, *rest))

    def last(self, names) -> int:
        return max((self.of[x][-1] for x in names if self.of.get(x)), default=-1)

    def cut(self, k: int) -> list[tuple]:
        """Closes the elements from the k-th on."""
        gone = self.stack[k:]
        for tag, *_ in gone:
            self.of[tag].pop()
        del self.stack[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()
        return gone


class Page:
    """The blocks of a page, each with its node, and the nodes: containers, and elements of doubtful names."""

    def __init__(self, html: str, by_name: bool = True) -> None:
        self.html, self.by_name = html, by_name
        #: Of each node: digest of its path, the node around it, its step, its tag, whether it is doubtful.
        self.digests: list[bytes] = [b""]
        self.around: list[int] = [-1]
        self.steps: list[str] = [""]
        self.tags: list[str] = [""]
        self.doubts: list[bool] = [False]
        #: (text, characters in links, node), in page order.
        self.blocks: list[tuple[str, int, int]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        open_ = _Open()
        node, out, article = 0, False, False
        pieces: list[str] = []
        links = link_depth = 0
        at, n = 0, len(html)

        def flush():
            nonlocal links
            if pieces:
                text = _SPACE.sub(" ", unescape("".join(pieces))).strip()
                if text:
                    self.blocks.append((text, min(links, len(text)), node))
                pieces.clear()
            links = 0

        def close(k: int) -> None:
            nonlocal node, out, article, link_depth
            if open_.blocks and open_.blocks[-1] >= k or any(x[1] != node for x in open_.stack[k - 1 : k]):
                flush()
            link_depth -= sum(x[0] == "a" for x in open_.cut(k))
            node, out, article = open_.stack[-1][1:] if open_.stack else (0, False, False)

        while at < n:
            m = _TAG.search(html, at)
            text = html[at : m.start() if m else n]
            if text and not out:
                pieces.append(text)
                if link_depth:
                    links += len(text.strip())
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:  # an end tag
                k = open_.last((tag,))
                if k < 0:
                    if tag not in INLINE:
                        flush()
                elif tag not in INLINE or not open_.blocks or open_.blocks[-1] < k:  # a stray inline end tag closes no block
                    close(k)
                continue
            if tag in CLOSES or tag in ENDS_P:
                ends, stop = CLOSES["p"] if tag in ENDS_P else CLOSES[tag]
                k = open_.last(ends)
                if k >= 0 and k > open_.last(stop - ends):
                    close(k)
            if tag == "br":
                if not out:
                    pieces.append(" ")
                continue
            if tag not in INLINE:
                flush()
            if tag in VOID:
                continue
            attributes = _attributes(m[3] or m[6] or "")
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else n
            verdict = _OUT if out else _judged(tag, attributes, article, self.by_name)
            now = node
            if verdict == _DOUBTFUL or tag in CONTAINERS and verdict == _KEPT:
                if verdict == _DOUBTFUL:
                    flush()
                step = _step(tag, attributes)
                self.digests.append(_chained(self.digests[node], step))
                self.around.append(node)
                self.steps.append(step)
                self.tags.append(tag)
                self.doubts.append(verdict == _DOUBTFUL)
                now = len(self.steps) - 1
            open_.push(tag, now, verdict == _OUT, article or tag in ("article", "main"))
            node, out, article = open_.stack[-1][1:]
            link_depth += tag == "a"
        flush()

    def path(self, k: int) -> str:
        steps = []
        while k > 0:
            steps.append(self.steps[k])
            k = self.around[k]
        return "".join(">" + x for x in reversed(steps))

    def _without(self, gone) -> list[bool]:
        """Of each node, whether it lies in a doubtful one that is left out."""
        out = [False] * len(self.steps)
        for k in range(1, len(out)):
            out[k] = out[self.around[k]] or self.doubts[k] and self.digests[k] in gone
        return out

    def best(self, gone=frozenset()) -> tuple[int, float]:
        """(node, score) of the container of the highest score; doubtful text counts half."""
        out = self._without(gone)
        own = [0.0] * len(self.steps)
        doubt = self.doubts[:]
        for k in range(1, len(own)):
            doubt[k] = doubt[k] or doubt[self.around[k]]
        for text, links, node in self.blocks:
            if not out[node]:
                own[node] += max(0, len(text) - 2 * links) * (0.5 if doubt[node] else 1)
        score = own[:]
        for k in range(len(own) - 1, 0, -1):  # a node comes after the one around it
            score[self.around[k]] += (1 if self.tags[k] not in CONTAINERS else 0.5) * score[k]
        for k, tag in enumerate(self.tags):
            if tag in ("article", "main"):
                score[k] *= 2
            elif k and tag not in CONTAINERS:
                score[k] = 0
        k = top = max(range(len(score)), key=lambda k: (score[k], -k))
        found = {"main": k, "article": k}
        while top > 0:  # text within an article belongs to all of it
            if self.tags[top] in found:
                found[self.tags[top]] = top
            top = self.around[top]
        top = found["article"] if self.tags[found["article"]] == "article" else found["main"]
        return top, max(score[k], score[top])

    def doubtful(self) -> list[tuple[bytes, int, int, str]]:
        """(digest, characters, those in links, text) of each doubtful element."""
        held: dict[int, list] = {k: [0, 0, []] for k, d in enumerate(self.doubts) if d}
        if not held:
            return []
        inner = [k if d else -1 for k, d in enumerate(self.doubts)]  # the nearest doubtful node
        for k in range(1, len(inner)):
            inner[k] = inner[k] if inner[k] >= 0 else inner[self.around[k]]
        for text, links, node in self.blocks:
            if inner[node] >= 0:
                cell = held[inner[node]]
                cell[0] += len(text)
                cell[1] += links
                cell[2].append(text)
        return [(self.digests[k], n, links, "\n".join(texts)) for k, (n, links, texts) in held.items() if n]

    def text(self, digest: bytes | None, gone=frozenset()) -> str:
        """The text in the containers on the path of this digest, or else in the best one, without the doubtful elements in ``gone``."""
        inside = [bool(digest) and d == digest for d in self.digests]
        if not any(inside):
            inside[self.best(gone)[0]] = True
        out = self._without(gone)
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.around[k]]
        found = "\n\n".join(t for t, _, c in self.blocks if inside[c] and not out[c])
        if found:
            return found
        if digest:
            return self.text(None, gone)
        if gone:
            return self.text(None)
        return Page(self.html, False).text(None) if self.by_name else ""


def _host():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


VOTES = "host string, digest binary, path string, score double, n long, links long, text long, page long"


def _number(text: str) -> int:
    return int.from_bytes(_chained(b"", text)[:8], "little", signed=True)


def votes(pages: DataFrame) -> DataFrame:
    """A row for each page's best container (with its path and score) and for each doubtful element."""

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, "html"):
                found = []
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    page = Page(html or "")
                    k, score = page.best()
                    if k and score > 0:
                        found.append((host, page.digests[k], page.path(k), score, None, None, None, None))
                    if doubtful := page.doubtful():
                        whole = _number(page.text(None))
                        found += [(host, digest, None, None, n, links, _number(text), whole) for digest, n, links, text in doubtful]
                cells = zip(*found, strict=True) if found else [()] * 8
                kinds = (pa.string(), pa.binary(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["host", "digest", "path", "score", "n", "links", "text", "page"])

    return pages.select(_host().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, VOTES)


def winners(pages: DataFrame) -> DataFrame:
    """(host, path, digest, gone): the path of most weight, of equal ones the first, and the doubtful paths that are left out."""
    # A page's weight grows slowly with its text, so that no long page outvotes many.
    by = votes(pages).groupBy("host", "digest").agg(
        F.min("path").alias("path"),
        F.sum(F.floor(F.log2(F.col("score") + 2))).alias("weight"),
        F.countDistinct("page").alias("times"),
        F.sum("n").alias("n"),
        F.sum("links").alias("links"),
        (F.min("text") == F.max("text")).alias("same"),
    )
    out = (F.col("links") * 2 > F.col("n")) | (F.col("same") & (F.col("times") >= REPEATED))
    best = F.min(F.when(F.col("path").isNotNull(), F.struct((-F.col("weight")).alias("w"), "path", "digest"))).alias("x")
    return by.groupBy("host").agg(best, F.collect_list(F.when(out, F.col("digest"))).alias("gone")).select("host", "x.path", "x.digest", "gone")


def main_text(pages: DataFrame, hosts: int = HOSTS) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    spark = pages.sparkSession
    won = Scratch(spark).keep(winners(pages).select("host", "digest", "gone"))
    size = won.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("gone")).first()
    few = size.hosts + size.gone <= hosts
    shared = spark.sparkContext.broadcast({r.host: (r.digest and bytes(r.digest), frozenset(map(bytes, r.gone))) for r in won.collect()} if few else None)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), _host().alias("_host"))
    if few:
        rows = rows.withColumns({"_path": F.lit(None).cast("binary"), "_gone": F.lit(None).cast("array<binary>")})
    else:
        rows = rows.join(won.toDF("_host", "_path", "_gone"), "_host", "left").select("page_id", "url", "html", "_host", "_path", "_gone")

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, "html"):
                html, host, digest, gone = (part.column(k).to_pylist() for k in range(2, 6))
                if shared.value is not None:
                    found = [shared.value.get(h, (None, frozenset())) for h in host]
                else:
                    found = [(d, frozenset(g or ())) for d, g in zip(digest, gone, strict=True)]
                texts = [Page(x or "").text(*f) for x, f in zip(html, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = T.StructType([*rows.select("page_id", "url").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)
