"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldtrail.llm.common import chunks

LINES = 3  # lines of a sliding window
SURGE = 0.5  # of the page's median window: text surges in a window at least that full, and dives in an empty one
PART = 5  # a stretch with less than this part of the largest one is not main text
MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
MARKS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp".split())
#: Elements that begin a new line.
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are not part of an article.
APART = frozenset("head nav footer aside form menu dialog button select search".split())
#: Words of class, id and role names that tell boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navigation navbar menu breadcrumb breadcrumbs sidebar "
    "widget widgets footer header masthead topbar toolbar cookie cookies consent gdpr notice notification alert modal popup overlay newsletter subscribe subscription "
    "signup social share sharing related recommended recommendations comment comments commentlist reply replies respond disqus login search pagination pager "
    "contentinfo complementary skip".split())
TALK = frozenset("comment comments commentlist reply replies respond disqus".split())
WORD = re.compile(r"[a-z]+")


class _Page:
    """Lines of one page, weighted by the length of their text; markup only lowers a weight, to zero in boilerplate and links."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.weights: list[int] = []
        self.stack: list[tuple[str, bool, bool]] = []  # name, apart, inside an article
        self.text: list[str] = []
        self.linked = self.links = 0
        self.loose = False  # in a paragraph that is boilerplate itself and may lack its end

    def flush(self) -> None:
        whole = " ".join(html.unescape("".join(self.text)).split())
        if whole:
            apart = self.loose or (bool(self.stack) and self.stack[-1][1])
            self.lines.append("" if apart else whole)
            self.weights.append(0 if apart or 2 * self.linked > len(whole) else len(whole))
        elif self.text or not self.lines or self.lines[-1]:
            self.lines.append("")
            self.weights.append(0)
        self.text, self.linked = [], 0

    def say(self, text: str) -> None:
        self.text.append(text)
        if self.links:
            self.linked += len(text)

    def start(self, name: str, rest: str) -> None:
        if name == "a":
            self.links += 1
        if name in BREAKS:
            self.flush()
            self.loose = False
        if name in VOID or rest.endswith("/") and name not in BREAKS:
            return
        inside = bool(self.stack) and self.stack[-1][2]
        names = {w for m in MARKS.finditer(rest) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())} if rest else set()
        apart = name in APART or name == "header" and not inside or bool(rest and HIDDEN.search(rest))
        if name in ("article", "main"):
            apart = apart or bool(names & TALK)
        elif name not in ("html", "body", "h1"):
            apart = apart or bool(names & (NAMES - {"header"} if inside else NAMES))
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "a", "b", "i", "em", "strong", "span"):
            if apart and name in BREAKS:
                self.loose = True
            elif apart:
                self.push(name, True, False)
            return
        if name in BREAKS:
            self.push(name, apart, name in ("article", "main") and not apart)

    def push(self, name: str, apart: bool, article: bool) -> None:
        above = self.stack[-1] if self.stack else ("", False, False)
        self.stack.append((name, apart or above[1], (article or above[2])))

    def end(self, name: str) -> None:
        if name == "a":
            self.links = max(0, self.links - 1)
        if name in BREAKS:
            self.flush()
            self.loose = False
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                if name not in BREAKS:
                    self.flush()
                del self.stack[k:]
                return


def page_lines(page: str) -> tuple[list[str], np.ndarray]:
    """Lines and their weights."""
    state, at = _Page(), 0
    while (m := MARKUP.search(page, at)) is not None:
        if m.start() > at:
            state.say(page[at:m.start()])
        at = max(m.end(), m.start() + 1)
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            state.end(name)
        elif name in RAW:
            if name in BREAKS:
                state.flush()
            shut = re.compile(f"</{re.escape(name)}[^>]*>?", re.I).search(page, at)
            at = shut.end() if shut else len(page)
        else:
            state.start(name, (m[3] or m[6] or "").strip())
    if at < len(page):
        state.say(page[at:])
    state.flush()
    return state.lines, np.array(state.weights, np.int64)


def stretches(weights: np.ndarray) -> list[tuple[int, int]]:
    """Lines (from, to) between a surge and a dive of the sums over ``LINES`` lines.

    The surge is taken from the page's own sums: a stretch reaches from one empty window to the next, and counts if a
    window in it reaches the surge and it holds a fair part of the largest stretch's text."""
    if not weights.any():
        return []
    sums = np.convolve(weights, np.ones(LINES, np.int64))  # of the window that ends at each line, LINES - 1 lines past the last
    surge = SURGE * float(np.median(sums[sums > 0]))
    low = np.concatenate([[True], sums == 0, [True]])
    begins, ends = np.flatnonzero(low[:-1] & ~low[1:]), np.flatnonzero(~low[:-1] & low[1:])
    found = [(int(a), int(min(b, len(weights)))) for a, b in zip(begins, ends) if sums[a:b].max() >= surge]
    text = [int(weights[a:b].sum()) for a, b in found]
    return [span for span, size in zip(found, text) if size * PART >= max(text)]


def main_text(page: str) -> str:
    """Lines with a weight between surge and dive points."""
    lines, weights = page_lines(page)
    return " ".join(lines[i] for a, b in stretches(weights) for i in range(a, b) if weights[i])


def extract_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", *carried: str) -> DataFrame:
    """(id, carried columns, text, n_chars) per page; a null, empty or text-free page gives an empty text.

    Lines are blocks of the page; scripts, styles, hidden parts and elements whose names tell boilerplate weigh nothing,
    and lines of links neither. Main text runs from a surge of the summed line lengths to a dive to none, the surge set by
    the page's own sums (``stretches``). Character references are decoded, white space becomes one blank, blocks are joined by one. Repeated rows and null ids come
    back as they are; a carried column named text or n_chars comes out with an underscore behind; no rows give no rows.
    """
    taken = ("text", "n_chars", "_html")
    keys = [f"{c}_" if c.lower() in taken else c for c in (id_column, *carried)]
    frame = pages.select(*[F.col(c).alias(k) for c, k in zip((id_column, *carried), keys)], F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_html"):
            texts = [main_text(x) for x in part.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != "_html")
    return frame.mapInArrow(run, f"{schema}, text string, n_chars bigint")
