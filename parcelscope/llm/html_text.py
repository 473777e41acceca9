"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text. The tag path of a block lists the block elements above it, each with its class.
Per path the text length and the punctuation of its blocks are added up and divided by the number of blocks; both
ratios are smoothed over neighbouring blocks in page order, averaged per path again, multiplied, weighted by what the
path's elements say, and compared with a threshold relative to the spread over the page's paths. All blocks of the
paths above it are content and make up the text, wherever they lie. Shorter blocks (headings, short paragraphs, list
items) join them if content lies in the container they are in, or in their ``<article>``.

A path inside ``<article>`` or ``<main>`` counts twice. Words such as sidebar, comments or share in class or id, and
forms, speak against a path, less so beside words such as content or text; the path is content all the same if its
weighted ratio is at least half of the best ratio on the page without such words. Menus, page headers, footers, asides,
scripts, styles, and what is hidden or has the role of one of these are no candidates, unless they hold the article.

Defined results: a null or empty page, and one without text, gives an empty text; open and stray tags, tags cut off at
the end and comments that aren't closed are read as browsers do, roughly; a null id stays null; rows that repeat give
rows that repeat; only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNQUOTED_END = re.compile(r"=\s*[^\s\"'>]*/\Z")
HAS_MARKS = re.compile(r"class|id|role|hidden", re.I)

DEEPEST = 512
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg math object canvas audio video select xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike "
    "strong sub sup time tt u var".split()
)
BOILERPLATE = set("head nav menu footer aside button dialog".split())
DOUBTFUL = set("form fieldset".split())
CLOSES_PARAGRAPH = set(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
CLOSES_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CONTAINERS = set("article main section div body html td center".split())
MARKS = set(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription paywall sidebar menu "
    "nav navbar navigation navigations breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus "
    "replies respond reply related recommended recommendations share sharing social widget widgets toolbar pagination "
    "pager login signup register search".split()
)
LAYOUT = set("with has have no not layout page is js".split())
CONTENT = set("article body content editor entry main post story text".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
DOUBT, SLIGHT_DOUBT, IN_ARTICLE = 0.1, 0.6, 2.0
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


class _Element:
    __slots__ = ("name", "above", "boilerplate", "trust", "path", "holds_article", "state", "depth")

    def __init__(self, name: str, above: _Element | None, boilerplate: bool, trust: float, step: str):
        self.name, self.above, self.boilerplate, self.trust = name, above, boilerplate, trust
        self.path = (above.path if above else "") + step
        self.holds_article, self.state = False, None
        self.depth = above.depth + 1 if above else 0

    def line(self):
        at = self
        while at is not None:
            yield at
            at = at.above


@lru_cache(maxsize=1 << 14)
def _reading(name: str, attributes: str) -> tuple[bool, float, str]:
    """Whether name and attributes mark boilerplate, the trust its words leave, and the element's step in a tag path."""
    marked, doubtful, role, tokens = name in BOILERPLATE, name in DOUBTFUL, "", []
    for found in ATTRIBUTE.finditer(attributes):
        key = found[1].lower()
        value = found[2] or found[3] or found[4] or ""
        if key == "role":
            role = value.strip().lower()
        elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
            marked = True
        elif key in ("class", "id"):
            for each in value.split():
                parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", each).lower())
                if parts and parts[0] not in LAYOUT:  # has-sidebar and the like tell about the element, not what it is
                    tokens += parts
    marked = marked or role in ROLES
    trust = 1.0
    if doubtful or role == "form":
        trust = DOUBT
    elif not MARKS.isdisjoint(tokens):
        trust = DOUBT if CONTENT.isdisjoint(tokens) else SLIGHT_DOUBT
    step = "" if name in INLINE else "/" + ".".join([name, *sorted(set(tokens))])
    if name in ("html", "body", "article", "main"):
        return False, 1.0, step
    return marked, trust, step


def _element(name: str, attributes: str, above: _Element | None) -> _Element:
    marked, trust, step = _reading(name, attributes if HAS_MARKS.search(attributes) else "")
    if name == "header" and not marked:
        marked = above is None or not any(x.name in ("article", "main") for x in above.line())
    return _Element(name, above, marked, trust, step)


def blocks_of(page: str) -> list[tuple[_Element, str]]:
    """The page's blocks of text in order, each with its innermost element."""
    top = _element("html", "", None)
    blocks: list[tuple[_Element, str]] = []
    parts: list[str] = []
    holder = top

    def end_block() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((holder, text))
            parts = []

    def add(text: str, element: _Element) -> None:
        nonlocal holder
        if not parts:
            holder = element
        elif (element.boilerplate, element.trust) != (holder.boilerplate, holder.trust):
            end_block()
            holder = element
        parts.append(html.unescape(text) if "&" in text else text)

    def close(names: set[str], stop: set[str]) -> None:
        nonlocal current
        for x in current.line():
            if x.name in stop or x is top:
                return
            if x.name in names:
                current = x.above
                return

    current, at, size = top, 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            add(page[at:], current)
            break
        if found.start() > at:
            add(page[at : found.start()], current)
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name or found[0][-1] != ">":
            continue
        if found[1] or found[4]:
            if name not in INLINE:
                end_block()
            for x in current.line():
                if x.name == name and x is not top:
                    current = x.above
                    break
                if name in INLINE and x.name not in INLINE:
                    break
            continue
        attributes = found[3] or found[6] or ""
        if name in ("svg", "math") and attributes.endswith("/") and not UNQUOTED_END.search(attributes):
            continue
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = closing.end() if closing else size
            continue
        if name == "html":
            continue
        if name not in INLINE:
            end_block()
        if name in VOID:
            continue
        if name in CLOSES_PARAGRAPH:
            close({"p"}, CONTAINERS | BOILERPLATE | DOUBTFUL | {"table", "header", "blockquote", "li"})
        if name in CLOSES_SAME:
            close(*CLOSES_SAME[name])
        if name == "body" or name not in INLINE:  # formatting left open doesn't reach into new blocks
            while current.name in INLINE and not current.boilerplate and current.trust == 1:
                current = current.above
        if current.depth >= DEEPEST:
            continue
        current = _element(name, attributes, current)
        if name in ("article", "main"):
            for x in current.line():
                x.holds_article = True
    end_block()
    return blocks


WEIGHTS = np.exp(-0.5 * np.arange(-2, 3) ** 2.0) / np.exp(-0.5 * np.arange(-2, 3) ** 2.0).sum()


def _smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian weights over two neighbours on either side."""
    first, last = values[:1], values[-1:]
    return np.convolve(np.concatenate((first, first, values, last, last)), WEIGHTS, mode="valid")


def content_nodes(
    lengths: np.ndarray, marks: np.ndarray, paths: list, trust: np.ndarray, weights: np.ndarray, share: float = 0.5
) -> np.ndarray:
    """Which blocks lie on content paths, by length and punctuation per path; trust and weight are the path's own."""
    number = {each: at for at, each in enumerate(dict.fromkeys(paths))}
    path = np.array([number[each] for each in paths])
    count = np.bincount(path)

    def ratio(values: np.ndarray) -> np.ndarray:
        per_path = np.bincount(path, values) / count
        smoothed = _smooth(per_path[path])
        return np.bincount(path, smoothed) / count

    fused = ratio(lengths.astype(float)) * (1 + ratio(marks.astype(float))) * (np.bincount(path, trust * weights) / count)
    threshold = min(share * fused.std(), 0.5 * fused.max())
    doubted = np.bincount(path, trust) / count < 0.99
    best = fused[~doubted].max(initial=0.0)
    return ((fused >= threshold) & (~doubted | (fused >= 0.5 * best)))[path]


def _state(element: _Element) -> tuple[bool, float, bool]:
    """Whether the element is no candidate, the trust left by all words above its text, and whether an article holds it."""
    if element.state is None:
        out, trust, inside = _state(element.above) if element.above is not None else (False, 1.0, False)
        if not element.holds_article:
            out, trust = out or element.boilerplate, trust * element.trust
        element.state = out, trust, inside or element.name in ("article", "main")
    return element.state


def main_text(page: str | None) -> str:
    blocks = [(element, text) for element, text in blocks_of(page or "") if not _state(element)[0]]
    if not blocks:
        return ""
    lengths = np.array([len(text) for _, text in blocks])
    marks = np.array([len(PUNCTUATION.findall(text)) for _, text in blocks])
    trust = np.array([_state(element)[1] for element, _ in blocks])
    weights = np.array([IN_ARTICLE if _state(element)[2] else 1.0 for element, _ in blocks])
    paths = [(element.path, *_state(element)[1:]) for element, _ in blocks]
    chosen = content_nodes(lengths, marks, paths, trust, weights)
    above = {x for (element, _), is_content in zip(blocks, chosen) if is_content for x in element.line()}
    nearest = {_container(element) for (element, _), is_content in zip(blocks, chosen) if is_content}

    def joins(element: _Element) -> bool:
        if any(x.trust < 1 and not x.holds_article and x not in above for x in element.line()):
            return False
        if any(x.name == "article" and x in above for x in element.line()):
            return True
        container = _container(element)
        return container in (nearest if container.name in ("html", "body") else above)

    return " ".join(text for (element, text), is_content in zip(blocks, chosen) if is_content or joins(element))


def _container(element: _Element) -> _Element:
    """The innermost container that holds the element's text."""
    return next((x for x in element.line() if x.name in CONTAINERS), element)


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per page: id, url, main text and its number of code points."""
    id_type = pages.select(id_col).dtypes[0][1]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page) for page in batch["html"]]
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"],
                    "url": batch["url"],
                    "text": texts,
                    "n_chars": np.array([len(text) for text in texts], np.int64),
                }
            )

    read = pages.select(
        F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    found = read.mapInPandas(extract, "page_id string, url string, text string, n_chars long")
    return found.withColumn("page_id", F.col("page_id").cast(id_type))
