"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataspan.llm.common import small_batches

#: Elements whose text is never shown.
UNSEEN = frozenset("script style noscript template title svg iframe object canvas audio video select datalist textarea".split())
#: Elements that stand beside an article; they can hold one only if they have several lines' worth of plain text.
ASIDE = frozenset("nav aside footer menu dialog".split())
FIELDS = frozenset("form button label legend fieldset input".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that hold other blocks; a line belongs to the innermost one.
HOLDERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr hr pre blockquote figcaption summary legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the values ends where one of the keys begins (within the same list or table).
ENDS = {t: frozenset(["p"]) for t in BLOCKS} | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "option": frozenset(["option"]), "body": frozenset(["head", "title"])}
FENCES = frozenset("ul ol dl table article main section div body".split())
#: Words of class, id and role that mark what stands beside an article.
BESIDE = frozenset("ad ads adv advert advertisement advertisements banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: What such evidence leaves of a block's ratio: of elements, and of named paragraphs, whose names say less; in an article ratios count for more.
BESIDE_WEIGHT, NAMED_WEIGHT, FIELD_WEIGHT, ARTICLE_WEIGHT = 0.02, 0.15, 0.1, 4.0
#: Smoothing width in lines; the part of the page's highest smoothed ratio (as a logarithm) that content exceeds; the least ratios of content, and of it beside an article.
SIGMA, LEVEL, LEAST, LEAST_ASIDE = 1.0, 0.6, 0.3, 4.0
_WORDS = str.maketrans({c: " " for c in "-_:/."})


class _Lines(HTMLParser):
    """Streams a page into lines: [holder, weight, beside, characters, characters in links, tags, text].

    A holder is an article, or outside of those the innermost element that holds blocks; an element with evidence makes a holder of its own.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.linked = self.tags = self.number = 0
        # open elements: tag, holder, weight, whether unseen, whether beside, whether in an article, whether a link
        self.open: list[tuple] = [("", 0, 1.0, False, False, False, False)]

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, holder, weight, _, aside, _, _ = self.open[-1]
            self.lines.append([holder, weight, aside, len(text), min(self.linked, len(text)), max(self.tags, 1), text])
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = ENDS.get(tag)
        if ends:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] in ends:
                    self.end(i)
                elif self.open[i][0] in FENCES and self.open[i][0] != "p":
                    break
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        _, holder, weight, unseen, aside, article, link = self.open[-1]
        if tag in ("article", "main"):
            self.number += 1
            self.open.append((tag, self.number, ARTICLE_WEIGHT, unseen, False, True, link))
            return
        factor = 1.0
        if tag in ASIDE or tag == "header" and not article:
            factor, aside = BESIDE_WEIGHT, True
        elif tag in FIELDS:
            factor = FIELD_WEIGHT
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true":
                unseen = True
            elif v and k in ("class", "id", "role") and tag not in ("html", "body") and not BESIDE.isdisjoint(v.lower().translate(_WORDS).split()):
                factor = min(factor, BESIDE_WEIGHT if tag in HOLDERS or tag in ("ul", "ol", "span", "a") else NAMED_WEIGHT)
        if factor < 1 or tag in HOLDERS and not article:
            self.number += 1
            holder = self.number
            if factor < 1 and tag not in BLOCKS:
                self.flush()  # an inline element with evidence is a line of its own
        self.open.append((tag, holder, weight * factor, unseen or tag in UNSEEN, aside, article, link or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.tags += 1

    def finish(self) -> None:
        super().close()
        self.flush()

    def end(self, i: int) -> None:
        if self.open[-1][1] != self.open[i - 1][1] or any(x[0] in BLOCKS for x in self.open[i:]):
            self.flush()
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.end(i)
                return
            if self.open[i][0] in ("article", "main") and tag not in ("body", "html", "article", "main"):
                return  # an end tag without its element does not end an article

    def handle_data(self, data: str) -> None:
        _, _, _, unseen, _, _, link = self.open[-1]
        if not unseen:
            self.parts.append(data)
            if link:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Convolution with a normalised Gaussian; the ends are padded with the end values."""
    r = int(3 * sigma) or 1
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, r, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str) -> str:
    """The article of one page.

    Lines are blocks in page order. A line's ratio is that of its characters outside links to its tags, times what the elements around it leave of it: names
    and tags of what stands beside an article only lower it. Logarithms of the ratios are smoothed over each holder's lines (an article, or outside of one an element that holds
    blocks). Lines over LEVEL of the page's highest smoothed value cluster into content: the holders that have one are content, and all their lines
    count, so that a short paragraph stays, but for those that are mostly links.
    """
    parser = _Lines()
    parser.feed(html)
    parser.finish()
    lines = parser.lines
    if not lines:
        return ""
    raw = np.array([np.log1p((n - linked) * weight / tags) for _, weight, _, n, linked, tags, _ in lines])
    holder = np.array([x[0] for x in lines])
    score = np.empty(len(lines))
    for h in set(holder.tolist()):
        own = np.flatnonzero(holder == h)
        score[own] = smoothed(raw[own])
    least = np.log1p(np.where([x[2] for x in lines], LEAST_ASIDE, LEAST))
    content = set(holder[(score >= LEVEL * score.max()) & (raw >= least)].tolist())
    return "\n".join(x[6] for x in lines if x[0] in content and 2 * x[4] <= x[3])


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page (page_id, url, html; other columns are ignored).

    Null or empty html gives the empty text; a page without content too. Each row is handled alone, so
    repeated rows repeat. Returns page_id, url, text, n_chars (code points).
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    small_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
