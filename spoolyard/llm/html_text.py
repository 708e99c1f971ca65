"""Operator 6: main text of web pages as the best scoring contiguous run of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship

#: Elements whose content is no text of a page, up to their end tag (fixed values).
RAW = "script style noscript template textarea title iframe svg math canvas audio video object select".split()
#: Elements that words are told apart by: a word's context is the open ones of these, with their class and id words.
SECTIONS = frozenset(
    "nav header footer aside main article section div form figure figcaption table ul ol dl menu dialog fieldset blockquote details button head body".split()
)
#: Elements that break a line; all others stand within a block.
BLOCKS = SECTIONS | frozenset("html p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre hr br address center hgroup summary legend".split())
#: Elements that hold a page's content: what the class words of an element around them say against it does not count inside.
HOLDERS = ("<article>", "<main>")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

START = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
STOP = re.compile(r"[<>\"']")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PART = re.compile(r"[a-z]+")
#: Attributes of a tag: name, and its value in double, single or no quotes.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)


def hidden(attributes: str) -> bool:
    """Whether a tag's hidden or aria-hidden attribute, or display:none in its style, hides it; class names do not."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "hidden" and value not in ("false", "until-found") or name == "aria-hidden" and value == "true" or name == "style" and NOT_SHOWN.search(value):
            return True
    return False


def parts_of(token: str) -> list[str]:
    """The words of a class or id: its parts if all of them are words of PARTS, as in cookie-banner; else the whole, as in has-sidebar."""
    parts = PART.findall(token)
    return parts if parts and KNOWN.issuperset(parts) else [token]


def markup_of(page: str) -> Iterator[tuple[str, str, str, str]]:
    """Texts ("", "", "", text) and tags ("tag", "/" or "", name, attributes) of a page, in one pass over it.

    Comments, declarations and raw elements with their content are passed over; one that does not end goes to the page's end, as
    does a tag. "<" without a name behind it, and before another "<" outside of quotes, is text. A quote without a second one
    counts for nothing.
    """
    at, done = 0, 0
    last = {q: page.rfind(q) for q in "\"'"}
    while (at := page.find("<", at)) >= 0:
        begun = at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            tag, at = None, len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            cdata = page.startswith("<![CDATA[", at)
            end = page.find("]]>" if cdata else ">", at)
            tag, at = None, len(page) if end < 0 else end + (3 if cdata else 1)
        elif m := START.match(page, at):
            end = m.end()
            while (stop := STOP.search(page, end)) and stop[0] in last:
                end = page.find(stop[0], stop.end()) + 1 if stop.start() < last[stop[0]] else stop.end()
            if stop and stop[0] == "<":
                at = stop.start()
                continue
            tag, at = (m[1], m[2].lower(), page[m.end() : stop.start()]) if stop else None, stop.end() if stop else len(page)
            if tag and tag[1] in RAW_END and not tag[0]:
                if not tag[2].endswith("/"):
                    m = RAW_END[tag[1]].search(page, at)
                    at = m.end() if m else len(page)
                tag = None
        else:
            at += 1
            continue
        if begun > done:
            yield "", "", "", page[done:begun]
        done = at
        if tag:
            yield "tag", *tag
    if done < len(page):
        yield "", "", "", page[done:]


Context = tuple[tuple[str, ...], ...]


def tokens_of(page: str) -> Iterator[tuple[str, Context, str]]:
    """(kind, context, text) of a page in order: kind is "text", "tag" or "break" (a tag that ends a block).

    The context of a piece of text holds the features of each section element that is open there: "<name>", ".word" for
    each whole word of its class, id and role (but for the body's), "hidden" where markup hides it; and for a link ("a", or "a<ul>"
    in a list). A section's end tag closes it and what is open inside; an end tag without a start tag is passed over, so
    unclosed elements do no harm.
    """
    open_: list[tuple[str, tuple[str, ...]]] = []
    links, at = 0, 0
    context: Context = ()

    def seen() -> Context:
        link = "a<ul>" if open_ and open_[-1][0] in ("ul", "ol", "menu") else "a"
        # Of elements with the same features the innermost counts.
        return (*reversed(dict.fromkeys(features for _, features in reversed(open_))), *([(link,)] if links else []))

    for kind, closes, name, attributes in markup_of(page):
        if not kind:
            yield "text", context, attributes
            continue
        if name == "a":
            links = 0 if closes else 1
            context = seen()
        elif name in SECTIONS:
            if closes:
                if any(n == name for n, _ in open_):
                    while open_.pop()[0] != name:
                        pass
                    links = 0
            elif not attributes.endswith("/"):
                words = [f".{w}" for x in NAMES.findall(attributes) for token in "".join(x).lower().split() for w in parts_of(token)] if name != "body" else []
                words = list(dict.fromkeys(words))
                # The header of an article holds its headline, that of a page does not.
                inner = name == "header" and any(f"<{n}>" in HOLDERS for n, _ in open_)
                open_.append((name, ("<article><header>" if inner else f"<{name}>", *words, *(["hidden"] if hidden(attributes) else []))))
            context = seen()
        yield ("break" if name in BLOCKS else "tag"), context, name


#: Labelled pages that the weights are learned from: parts of a page as (content or not, markup). Content is marked 1.
PARTS = [
    (0, '<head><meta charset="utf-8"><link rel="x"></head>'),
    (0, '<header class="masthead banner"><a href="/">Home</a> The daily site</header>'),
    (0, '<nav class="menu navbar navigation"><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li><li><a href="/c">About us</a></li></ul></nav>'),
    (0, '<div id="menu" class="nav menu breadcrumb breadcrumbs"><ul><li><a href="/a">Start</a></li><li><a href="/b">Shop</a></li></ul></div>'),
    (0, '<div class="ad ads advert adverts advertisement banner sponsored promo promotion">Buy two of these, get one for free today.</div>'),
    (0, '<div class="cookie cookies consent notice banner gdpr popup modal overlay alert">We use cookies. Please accept them all.</div>'),
    (0, '<aside class="sidebar widget related recommended popular trending"><div class="widget"><ul><li><a href="/r">You may like this</a></li></ul> Most read of the week</div></aside>'),
    (0, '<div id="sidebar" class="sidebar widget related">More about it here.</div>'),
    (0, '<form class="search login signup subscribe newsletter"><input name="q"> Sign up for our letter <button>Send it</button></form>'),
    (0, '<div class="share social sharing follow tags toolbar pagination pager"><a href="/s">Share</a> <a href="/t">Tweet</a></div>'),
    (1, '<article class="post article entry content story body"><h1>A headline of the day</h1><p>{}</p><p>{}</p><ul><li>{}</li></ul><blockquote>{}</blockquote></article>'),
    (1, '<main id="main" class="main content"><section><h1>A longer headline here</h1><p>{}</p><h2>{}</h2><p>{}</p></section></main>'),
    (1, "<article><header><h1>{}</h1>By the desk</header><p>{}</p><p>{}</p><p>{}</p></article>"),
    (1, '<div class="content article text story body"><h2>What it is about</h2><p>{}</p><figure><figcaption>{}</figcaption></figure><table><tr><td>{}</td></tr></table></div>'),
    (1, "<div><div><p>{}</p></div><ol><li>{}</li></ol></div>"),
    (0, '<section id="comments" class="comments comment discussion respond disqus replies reply"><div class="comment">I do not agree with what was written here at all.</div><ul><li>Nor do I, said somebody else.</li></ul></section>'),
    (0, '<footer class="footer copyright legal disclaimer"><p>Copyright and all rights reserved by the company.</p><ul><li><a href="/i">Imprint</a></li></ul></footer>'),
    (0, '<div id="footer" class="footer copyright">All rights reserved.</div>'),
    (0, "<dialog>Are you sure?</dialog><menu>Open Save</menu><fieldset>Your name</fieldset><button>Press</button>"),
    (0, '<div hidden>Not to be seen by anyone</div><div style="display:none" class="hidden">Nor is this one</div>'),
]
#: The words of their classes, ids and roles.
KNOWN = frozenset(w for _, markup in PARTS for x in NAMES.findall(markup) for w in PART.findall("".join(x)))
FILL = 'It rained for most of the day and <a href="/t">the people</a> of the town stayed at home until the evening came.'


UNNAMED = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*')")


def labelled_pages(named: bool = True) -> list[list[tuple[int, str]]]:
    """Pages of labelled parts: every content part between all other parts, which stand before, after and twice. Not named are
    those whose elements have no classes, as in pages whose class names say nothing."""
    parts = [(label, markup if named else UNNAMED.sub("", markup)) for label, markup in PARTS]
    other = [p for p in parts if not p[0]]
    return [[*other[i:], *other[:i], (1, c[1].format(*[FILL] * 4)), *other] for c in parts if c[0] for i in range(0, len(other), 3)]


#: Weights of a tag that are tried; a word's is 1, as only their ratio matters.
TAGS = (-0.05, -0.1, -0.2, -0.4, -0.8, -1.6, -3.2)


def learn_weights(pages: list[list[tuple[int, str]]], unnamed: list[list[tuple[int, str]]] | None = None) -> dict[str, float]:
    """Weights from labelled pages: naive Bayes log odds of content for each feature of a word's context, and of the TAGS the one
    with which the fewest words of the pages, and of the unnamed ones, are on the wrong side; of equal ones the heaviest, which leaves
    most short blocks out."""
    found: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    words = [0.0, 0.0]
    for page in pages:
        for label, markup in page:
            for kind, context, text in tokens_of(markup):
                if kind == "text":
                    n = len(html.unescape(text).split())
                    words[label] += n
                    for f in {f for element in context for f in element}:
                        found[f][label] += n
    odds = lambda c: math.log((c[1] + 0.5) / (words[1] + 1)) - math.log((c[0] + 0.5) / (words[0] + 1))
    # A link by itself speaks for no content: pages have them everywhere.
    weights = {f: min(odds(c), 0.0) if f == "a" else odds(c) for f, c in found.items()} | {"word": 1.0}
    every = [("".join(m for _, m in page), " ".join(extract(m, weights | {"word": 1e6, "tag": 0.0}) for label, m in page if label)) for page in [*pages, *(unnamed or [])]]

    def wrong(tag: float) -> int:
        both = [(Counter(extract(page, weights | {"tag": tag}).split()), Counter(want.split())) for page, want in every]
        return sum((a - b).total() + (b - a).total() for a, b in both)

    return weights | {"tag": min(TAGS, key=lambda tag: (wrong(tag), tag))}


#: An element whose features weigh this much or less is no content, whatever stands around it.
CLEAR = -2.0


def word_score(context: Context, weights: dict[str, float]) -> float:
    """Score of a word: the plain word's weight and those of all features of its context; -1 where these are negative, or
    where one element speaks clearly against content, as an advert inside an article is an advert. Elements around the
    innermost article or main count only where they speak for content, are hidden, or are no content by their name alone."""
    sums = [sum(weights.get(f, 0.0) for f in element) for element in context]
    inner = max((i for i, element in enumerate(context) if element[0] in HOLDERS), default=0)
    sums = [x if i >= inner or "hidden" in element or weights.get(element[0], 0.0) <= CLEAR else max(0.0, x) for i, (x, element) in enumerate(zip(sums, context, strict=True))]
    total = weights["word"] + sum(sums)
    if total < 0 or any(x <= CLEAR for x, element in zip(sums, context, strict=True) if element[0][0] != "a"):
        return -1.0
    return max(0.1, total)


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The words of the best scoring contiguous run: one linear scan keeps the best run that ends here and the best of all.

    Words in one place have one score, so the scan goes by pieces of text. Inside the run, pieces that score below 0 are
    left out. Blocks are joined by one space, white space within them becomes one space.
    """
    if not page:
        return ""
    pieces: list[tuple[float, str | None]] = []
    scores: dict[Context, float] = {}
    run = best = 0.0
    start = 0
    span = (0, 0)
    tag = weights["tag"]
    for kind, context, text in tokens_of(page):
        if kind == "text":
            if context not in scores:
                scores[context] = word_score(context, weights)
            score = scores[context]
            text = html.unescape(text)
            gain = score * len(text.split())
        else:
            score, gain, text = 1.0, tag, " " if kind == "break" else None
        if run <= 0:
            run, start = 0.0, len(pieces)
        pieces.append((score, text))
        run += gain
        if run > best:
            best, span = run, (start, len(pieces))
    return " ".join("".join(t for score, t in pieces[slice(*span)] if t is not None and score > 0).split())


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (page_id, url, text, n_chars) for each row of pages, without a shuffle.

    Character references are decoded. Null and empty html, and pages without content, give the empty text; null ids
    and urls and repeated rows pass through; broken markup is read as far as it goes: unclosed elements and comments
    end with the page. Empty tables give no rows; further columns are not read.
    """
    ship(pages.sparkSession)
    weights = learn_weights(labelled_pages(), labelled_pages(named=False))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [extract(x, weights) for x in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": list(map(len, texts))})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


QUERIES = {"op6_html_text": op6_html_text}
ORACLES: dict = {}
