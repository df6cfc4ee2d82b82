"""HTML main text by a maximum-scoring subsequence.

A page is read once into a sequence of words and tags. Words score positive, tags negative, with weights from labelled
pages; words of links score little. The contiguous region with the largest sum (found by one linear scan) is the
content, and its blocks are the text: a list of links before or after it, or a notice in a plain ``div``, stays outside because it
scores badly, whatever it is called.

Labels. A labelled page is one whose content region is known: pages with exactly one ``article`` element label
themselves in ``fit``; callers with their own labels pass (html, first character, last character). A tag's weight is the
log-odds of standing inside the region, a word's that of its container, and names in class, id or role get the log-odds of the words
directly in such containers; from counts over at most ``SAMPLE_PAGES`` pages (a documented bound, chosen by hash) of
at most ``LONGEST_LABELLED`` characters. Containers and tags never seen keep priors; for names there is a short list of priors.

Inside the region two things are left out, and cost little to cross: what HTML itself says is no content (scripts, styles, forms,
menus, asides, footers), and containers whose own name has clearly negative evidence (adverts, notices, reader comments). A name
never hides the page: it does not count for an element that holds the article, the main element or a first heading, names are
taken whole (``has-sidebar`` is no sidebar), and an article, a main element or a container with clearly positive evidence is content
again inside one without. Blocks are joined by one line feed in page order; white space inside a block becomes one
space; character references are decoded.

Defined results: null and empty html give an empty text; a page without positive region gives an empty text; an
unclosed tag at the end of a cut page is dropped, unclosed elements end with their parent; repeated rows give
repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Pages that ``fit`` reads at most.
SAMPLE_PAGES = 400
#: Longer pages are no labelled pages; they are extracted whole like all others.
LONGEST_LABELLED = 200_000

#: What HTML's elements are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold no content (a header inside an article holds its heading).
CHROME_TAGS = frozenset("nav aside footer header form script style noscript template iframe title head button select option textarea menu dialog svg object canvas".split())
#: Priors for names never seen in training: what they say by themselves, and words that say nothing beside them.
CHROME_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice popup modal overlay sidebar widget nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead topbar toolbar pagination pager comment comments commentlist reply replies disqus share sharing newsletter subscribe signup login".split())
NEUTRAL_NAMES = frozenset("site page left right top bottom list box area container wrapper block inner section item bar slot unit global primary secondary".split())
#: A log-odds beyond this is clear evidence.
CLEAR = 2.5
#: Opening one of these ends an open p, as HTML has it.
_ENDS_P = BLOCKS - {"body", "html", "head", "title", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend", "summary"}

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|([^<]+|<)", re.S)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[^\s\"']+")
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    """``holds``: whether it holds the article, the main element or a first heading; ``html``: no content by its tag or its parent's."""

    tag: str
    names: tuple[str, ...]
    parent: int
    html: bool
    holds: bool = False


@dataclass
class Item:
    """A tag or a run of text and the element where it stands (a tag: its own; -1: none)."""

    tag: str  # "" for text, "/p" for the end of a p
    element: int
    text: str
    at: int
    block: bool


@dataclass
class Page:
    items: list[Item]
    elements: list[Element]


def names_of(attributes: str) -> tuple[str, ...]:
    """The names in class, id and role, whole."""
    return tuple(sorted({n for m in _MARK.findall(attributes) for n in _NAME.findall(m.lower())})) if attributes else ()


def read(page: str) -> Page:
    """The page as tags and runs of text, with where each stands."""
    out: list[Item] = []
    elements: list[Element] = []
    stack: list[int] = []
    pos, n = 0, len(page)
    while pos < n:
        m = _PIECE.match(page, pos)
        if m is None:
            break
        start, pos = pos, m.end()
        if m.group(5) is not None:
            out.append(Item("", stack[-1] if stack else -1, m.group(5), start, False))
            continue
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if not m.group(4):
            break  # a tag cut off at the end of the page
        if m.group(1):
            for i in range(len(stack) - 1, -1, -1):
                if elements[stack[i]].tag == tag:
                    out.append(Item("/" + tag, stack[i], "", start, tag in BLOCKS))
                    del stack[i:]
                    break
            continue
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if elements[stack[i]].tag == "p":
                    del stack[i:]
                    break
                if elements[stack[i]].tag in BLOCKS:
                    break
        elif tag in ("li", "option", "dd", "dt", "tr", "td", "th") and stack and elements[stack[-1]].tag == tag:
            stack.pop()
        heading = tag == "header" and any(elements[i].tag == "article" for i in stack)
        own = len(elements)
        elements.append(Element(tag, names_of(m.group(3)), stack[-1] if stack else -1, tag in CHROME_TAGS and not heading or bool(stack and elements[stack[-1]].html)))
        if tag in ("article", "main", "h1") and not elements[own].html:
            for i in stack:
                elements[i].holds = True
        out.append(Item(tag, own, "", start, tag in BLOCKS))
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, pos)
            if end is None:
                pos = n
            else:
                close = page.find(">", end.start())
                pos = n if close < 0 else close + 1
                out.append(Item("/" + tag, own, "", end.start(), tag in BLOCKS))
        elif tag not in VOID:
            stack.append(own)
    return Page(out, elements)


@dataclass
class Weights:
    """Score of a tag by name, of a word by its container, evidence of names; priors for the rest."""

    tags: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    names: dict[str, float] = field(default_factory=dict)
    tag_prior: float = -0.3
    #: What is left out of the text costs this to cross, once for a run of it, whatever it holds.
    chrome_prior: float = -0.2
    word_prior: float = 1.0
    #: Words of a link, where no label says otherwise.
    link_prior: float = 0.1

    def evidence(self, name: str) -> float:
        """Log-odds that a container of this name holds content."""
        if name in self.names:
            return self.names[name]
        parts = set(name.replace("_", "-").split("-"))
        return -CLEAR if parts & CHROME_NAMES and parts <= CHROME_NAMES | NEUTRAL_NAMES else 0.0

    def chrome(self, page: Page) -> list[bool]:
        """For every element whether what stands in it is left out."""
        out: list[bool] = []
        for e in page.elements:
            known = [self.evidence(n) for n in e.names]
            bad, good = min(known, default=0.0) <= -CLEAR, max(known, default=0.0) >= CLEAR
            if e.html:
                out.append(True)
            elif bad and not good and not e.holds and e.tag not in ("html", "body", "main"):
                out.append(True)
            elif good or e.tag in ("article", "main"):
                out.append(False)
            else:
                out.append(e.parent >= 0 and out[e.parent])
        return out

    def scores(self, page: Page, chrome: list[bool] | None = None) -> list[float]:
        chrome = self.chrome(page) if chrome is None else chrome
        out, crossing = [], False
        for x in page.items:
            if x.element >= 0 and chrome[x.element]:
                out.append(0.0 if crossing else self.chrome_prior)
                crossing = True
            elif x.tag:
                out.append(self.tags.get(x.tag, self.tag_prior))
                crossing = False
            else:
                n, place = len(x.text.split()), page.elements[x.element].tag if x.element >= 0 else ""
                out.append(n * self.words.get(place, self.link_prior if place == "a" else self.word_prior))
                crossing = crossing and not n
        return out


def own_region(page: str) -> tuple[int, int] | None:
    """The inside of the page's article element, if it has exactly one."""
    opened = [m.end() for m in re.finditer(r"<article\b[^>]*>", page, re.I)]
    closed = [m.start() for m in re.finditer(r"</article\s*>", page, re.I)]
    return (opened[0], closed[0]) if len(opened) == 1 == len(closed) and opened[0] <= closed[0] else None


def learn(pages: list[tuple[str, int, int]]) -> Weights:
    """Weights from labelled pages (html, first character, last character of the content).

    Names are learned first, from the words directly in their containers; tags and words then from what is not left out: a list
    in a menu says nothing about one in an article. A name needs three pages.
    """
    read_pages = [(read(page), first, last) for page, first, last in pages]
    names, seen = {True: Counter(), False: Counter()}, Counter()
    for page, first, last in read_pages:
        here = set()
        for x in page.items:
            i = x.element
            while i >= 0 and not page.elements[i].names:
                i = page.elements[i].parent
            if not x.tag and i >= 0 and not page.elements[i].html and not page.elements[i].holds:
                for name in page.elements[i].names:
                    names[first <= x.at < last][name] += len(x.text.split())
                    here.add(name)
        seen.update(here)
    odds = lambda n, k: math.log((n[True][k] + 0.5) / (n[False][k] + 0.5))
    clip = lambda v, low, high: max(low, min(high, v))
    learned = Weights(names={k: clip(odds(names, k), -6.0, 6.0) for k in names[True] | names[False] if seen[k] >= 3})
    tags, words = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    for page, first, last in read_pages:
        chrome = learned.chrome(page)
        for x in page.items:
            if x.element >= 0 and chrome[x.element]:
                continue
            inside = first <= x.at < last
            if x.tag:
                tags[inside][x.tag] += 1
            else:
                words[inside][page.elements[x.element].tag if x.element >= 0 else ""] += len(x.text.split())
    return Weights(
        {k: clip(odds(tags, k) / 2 - 3, -6.0, -0.05) if odds(tags, k) < 2 else -0.05 for k in tags[True] | tags[False]},
        {k: clip(odds(words, k) / 3, 0.0, 1.0) for k in words[True] | words[False] if words[True][k] + words[False][k]},
        learned.names,
    )


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last-plus-one of the contiguous run with the largest sum; of equal sums the earliest, shortest."""
    best, run, begin, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, begin = 0.0, i
        run += s
        if run > best:
            best, found = run, (begin, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    seen = read(page)
    chrome = weights.chrome(seen)
    a, b = best_region(weights.scores(seen, chrome))
    blocks, run = [], []
    for x in seen.items[a:b]:
        if x.tag:
            if x.block:
                blocks.append("".join(run))
                run = []
            elif x.tag == "br":
                run.append(" ")
        elif x.element < 0 or not chrome[x.element]:
            run.append(x.text)
    blocks.append("".join(run))
    clean = (_SPACE.sub(" ", html.unescape(t)).strip() for t in blocks)
    return "\n".join(t for t in clean if t)


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES, longest: int = LONGEST_LABELLED) -> Weights:
    """Weights from at most ``sample`` self-labelled pages of at most ``longest`` characters, those with the smallest hashes."""
    page = F.col(html_col)
    labelled = pages.where(page.isNotNull() & (F.length(page) <= longest) & F.lower(page).contains("</article"))
    rows = labelled.select(F.xxhash64(html_col).alias("h"), page.alias("page"))
    # Thinned by hash before it is ordered, so that tasks send the driver a few times the sample, not one sample each.
    share = min(1.0, (2 * sample + 100) / max(1, labelled.count()))
    rows = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).distinct().orderBy("h", "page").limit(sample)
    found = []
    for r in rows.collect():
        if region := own_region(r["page"]):
            found.append((r["page"], *region))
    return learn(found)


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, from its whole html."""
    weights = weights or fit(pages, html_col)
    held = pages.sparkSession.sparkContext.broadcast(weights)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        w = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(x.as_py(), w) for x in part.column("html")]
                yield pa.record_batch(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
