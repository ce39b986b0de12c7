"""Main text of HTML pages: the maximum-scoring contiguous part, where words score positive and tags negative.

A page is a row of tags and texts. A word scores 1; a tag scores the weight of its class names, or of its name if it has none, and
an end tag that of the tag that it ends. Words in a head, script, style or the like score nothing. One pass over the running sums finds the
contiguous part of the greatest score. Elements whose class, or whose name for what stands beside a text, weighs CUT or less are cut: their
words score nothing, and they are left out where they stand inside the best part (a sidebar between two paragraphs).

Weights are learned from labelled pages: those with one <article> element, which marks what is wanted. (The tag itself weighs
nothing, so pages without it are read alike.) Each weight begins at START; wherever the best part of a labelled page
is not the labelled one (but for what is cut), though words outside were raised to OUTSIDE and words inside lowered to INSIDE, tags that the part should not
have crossed lose, and tags that it should have crossed gain, up to LEAST. Tags that no labelled part shows weigh no more than
HTML gives reason for. At most SAMPLE pages of SAMPLE_BYTES bytes are learned from, those with the least hash; equal pages
count once. All pages are read whole.

Defined results: character references are decoded; white space inside a block becomes one space, blocks are joined by one; inline tags
do not part words. NULL, empty pages and those without words outside of boilerplate give the empty text. Comments, scripts, styles and titles
that never end go to the end of the page, as in browsers; an element that never ends hides nothing. Of equal scores the first
part counts, and of those the shortest. Repeated pages give repeated rows. A very long page is a slice of its own. An empty table gives no rows;
without a labelled page the weights are the initial ones. Other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, read

SAMPLE, SAMPLE_BYTES = 400, 65_536
#: A tag's weight before anything is learned, the step of a change, the most that a tag may weigh, and how often all pages are gone through.
START, STEP, LEAST, ROUNDS = -0.5, 0.5, -0.05, 60
#: What a word counts while learning, outside and inside of the labelled part.
OUTSIDE, INSIDE = 3.0, 0.5
#: Elements whose tags weigh so little or less are not part of a text; the weight of those that HTML calls so.
CUT, BOILERPLATE = -4.0, -8.0

#: Names that HTML defines (fixed values): text that is never shown, inline text, and what stands beside a main text.
RAW = frozenset(("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"))
HIDDEN = RAW | frozenset(("head", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "datalist"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BESIDE = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "header"))
#: Class names that say the same (fixed values).
SAID = frozenset(("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "footer", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "share", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget"))
#: Marks a labelled text.
LABEL = "article"

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)>")
_CLASS = re.compile(r"(?<![^\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}


class Part(NamedTuple):
    """A text (name empty) or a tag of a page."""

    name: str
    end: bool
    text: str
    features: tuple[str, ...]


def features_of(name: str, attributes: str) -> tuple[str, ...]:
    """What a tag's weight hangs on: its class names, or its name. The labelled element has nothing."""
    if "=" in attributes:
        said = [w for m in _CLASS.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())]
        if said:
            return tuple(dict.fromkeys(f".{w}" for w in said))
    return () if name == LABEL else (name,)


class Page:
    """A page's tags and texts, and which tags belong together."""

    def __init__(self, html: str | None) -> None:
        self.parts: list[Part] = []
        html = html or ""
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.say(html[at:])
                break
            if lt > at:
                self.say(html[at:lt])
            at = self.tag(html, lt)
        self.mate = self.mated()
        self.words = np.array([0 if p.name else len(p.text.split()) for p in self.parts], np.float64)
        hidden = self.inside(lambda p: p.name in HIDDEN)
        self.words[hidden] = 0

    def say(self, text: str) -> None:
        self.parts.append(Part("", False, unescape(text) if "&" in text else text, ()))

    def tag(self, html: str, lt: int) -> int:
        """Reads what begins at a <; where it ends."""
        m = _TAG.match(html, lt)
        if m:
            name, end = m[2].lower(), bool(m[1])
            self.parts.append(Part(name, end, "", () if end else features_of(name, m[3])))
            if name in RAW and not end:
                close = _RAW_END[name].search(html, m.end())
                if close:
                    self.parts.append(Part(name, True, "", ()))
                return close.end() if close else len(html)
            return m.end()
        if html.startswith("<!--", lt):
            to = html.find("-->", lt + 2)
            return to + 3 if to >= 0 else len(html)
        if html[lt + 1 : lt + 2] in ("!", "?", "/") or html[lt + 1 : lt + 2].isascii() and html[lt + 1 : lt + 2].isalpha():
            to = html.find(">", lt)  # a declaration, or a tag that never ends
            return to + 1 if to >= 0 else len(html)
        self.say("<")
        return lt + 1

    def mated(self) -> list[int]:
        """The other tag of each tag's element, or -1: an end tag belongs to the last open tag of its name."""
        mate = [-1] * len(self.parts)
        open_by: dict[str, list[int]] = {}
        for i, p in enumerate(self.parts):
            if not p.name or p.name in VOID:
                continue
            if not p.end:
                open_by.setdefault(p.name, []).append(i)
                continue
            stack = open_by.get(p.name)
            if stack:
                mate[i], mate[stack[-1]] = stack[-1], i
                stack.pop()
        return mate

    def inside(self, wanted) -> np.ndarray:  # noqa: ANN001
        """Which parts stand inside an element, begin and end found, whose begin is wanted."""
        depth = np.zeros(len(self.parts) + 1, np.int64)
        for i, p in enumerate(self.parts):
            if p.name and not p.end and self.mate[i] > i and wanted(p):
                depth[i] += 1
                depth[self.mate[i] + 1] -= 1
        return np.cumsum(depth)[:-1] > 0

    def features(self) -> list[tuple[str, ...]]:
        """An end tag has those of the tag that it ends, or its name."""
        return [p.features if not p.end else self.parts[self.mate[i]].features if self.mate[i] >= 0 else () if p.name == LABEL else (p.name,) for i, p in enumerate(self.parts)]

    def label(self) -> tuple[int, int] | None:
        """The parts between the tags of the one labelled element."""
        at = [i for i, p in enumerate(self.parts) if p.name == LABEL and not p.end]
        if len(at) != 1 or self.mate[at[0]] < 0:
            return None
        return at[0] + 1, self.mate[at[0]]

    def text(self, begin: int, end: int, cut: np.ndarray) -> str:
        out: list[str] = []
        for i in range(begin, end):
            p = self.parts[i]
            if not p.name:
                if not cut[i]:
                    out.append(p.text)
            elif p.name not in INLINE:
                out.append(" ")
        return " ".join("".join(out).split())


def best_part(scores: np.ndarray) -> tuple[int, int]:
    """The contiguous part of the greatest sum above 0: begin and end. One scan; the first of equals, and the shortest."""
    if not len(scores):
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    least = np.minimum.accumulate(sums)
    gain = sums[1:] - least[:-1]
    end = int(gain.argmax())
    if gain[end] <= 1e-9:
        return 0, 0
    # The last of the least sums before it: nothing that adds nothing is taken along.
    begin = end - int((sums[end::-1] <= least[end] + 1e-9).argmax())
    return begin, end + 1


def reason(feature: str) -> float:
    """The weight of what no labelled page shows."""
    if feature.startswith("."):
        return BOILERPLATE if feature[1:] in SAID else START / 2
    if feature in BESIDE:
        return BOILERPLATE
    return LEAST if feature in INLINE else START / 2


class Weights:
    def __init__(self, learned: dict[str, float]) -> None:
        self.learned = learned

    def of(self, features: tuple[str, ...]) -> float:
        """The least weight of a tag's features."""
        return min((self.learned[f] if f in self.learned else reason(f) for f in features), default=0.0)

    def cuts(self, part: Part) -> bool:
        """Whether an element is not part of a text: what its classes or a name for what stands beside a text weigh."""
        return part.name in HIDDEN or any((f[0] == "." or f in BESIDE) and self.of((f,)) <= CUT for f in part.features)

    def best(self, page: Page, features: list[tuple[str, ...]], words: np.ndarray) -> tuple[int, int, np.ndarray]:
        """Begin and end of the best part, and what is cut out of it."""
        seen: dict[tuple[str, ...], float] = {}
        tags = np.array([seen[f] if f in seen else seen.setdefault(f, self.of(f)) for f in features], np.float64)
        cut = page.inside(self.cuts)
        return *best_part(tags + np.where(cut, 0.0, words)), cut

    def extract(self, html: str | None) -> str:
        page = Page(html)
        if not len(page.parts):
            return ""
        return page.text(*self.best(page, page.features(), page.words))


def learned_from(pages: list[str]) -> Weights:
    """Corrects weights until the best part of each labelled page is its labelled one, in the order given."""
    read_pages = []
    for html in pages:
        page = Page(html)
        label = page.label()
        if label and page.words[label[0] : label[1]].sum():
            inside = np.zeros(len(page.parts), bool)
            inside[label[0] : label[1]] = True
            read_pages.append((page, inside, page.features()))
    weights = Weights({f: LEAST if f in INLINE else START for _, _, features in read_pages for x in features for f in x})
    for _ in range(ROUNDS):
        wrong = 0
        for page, inside, features in read_pages:
            words = page.words * np.where(inside, INSIDE, OUTSIDE)
            begin, end, cut = weights.best(page, features, words)
            found = np.zeros(len(inside), bool)
            found[begin:end] = True
            if not page.words[(found != inside) & ~(cut & ~inside)].any():
                continue
            wrong += 1
            # Each tag that was crossed and should not have been counts for its weakest feature, and the other way round.
            change: Counter[str] = Counter()
            for i in np.flatnonzero(found != inside).tolist():
                for f in features[i]:
                    change[f] += 1 if inside[i] else -1
            for f, n in change.items():
                if n:
                    weights.learned[f] = min(LEAST, weights.learned[f] + (STEP if n > 0 else -STEP))
        if not wrong:
            break
    shown = {f for _, inside, features in read_pages for i in np.flatnonzero(inside).tolist() for f in features[i]}
    weights.learned = {f: w if f in shown else min(w, reason(f)) for f, w in weights.learned.items()}
    return weights


def learn(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from at most `sample` labelled pages."""
    some = F.col(html).rlike(f"(?i)<{LABEL}[\\s>]") & (F.octet_length(F.encode(html, "UTF-8")) <= SAMPLE_BYTES)
    labelled = pages.where(some).select(F.col(html).alias("html"), F.xxhash64(html).alias("h"))
    n = labelled.count()
    if not n:
        return Weights({})
    # One scan more: about four times the pages needed, by hash; equal pages are one before they move.
    few = labelled.where(F.pmod("h", F.lit(1 << 40)) < F.lit(int(min(1.0, 4.0 * sample / n) * (1 << 40)))).groupBy("h").agg(F.min("html").alias("html"))
    return learned_from([r.html for r in few.orderBy("h").limit(sample).collect()])


def extract(pages: DataFrame, weights: Weights, key: str = "page_id", url: str | None = "url", html: str = "html") -> DataFrame:
    """key, url (if named), text, n_chars of each page."""
    sent = pages.sparkSession.sparkContext.broadcast(weights.learned)  # a number for each tag and class name of at most SAMPLE pages
    carried = [key] if url is None else [key, url]
    named = {c: f"_c{i}" for i, c in enumerate(carried)}
    kinds = ", ".join(f"{named[c]} {pages.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Weights(sent.value)
        for part in gathered(batches, "_html"):
            texts = [reader.extract(x) for x in part.column("_html").to_pylist()]
            out = [part.column(named[c]) for c in carried]
            yield pa.RecordBatch.from_arrays([*out, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*named.values(), "text", "n_chars"])

    found = pages.select(*[F.col(c).alias(named[c]) for c in carried], F.col(html).alias("_html")).mapInArrow(run, f"{kinds}, text string, n_chars long")
    return found.withColumnsRenamed({v: k for k, v in named.items()})


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
