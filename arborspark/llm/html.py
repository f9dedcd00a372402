"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags.  Elements that never hold main
text (menus, forms, scripts, page headers and footers, sidebars, adverts,
notices, reader comments), by tag, role or class name, are left out.
Pass 1 classifies the blocks: long blocks rich in stop words are good, blocks
dense in links bad, and short or unclear blocks stay open.  Pass 2 gives an open
block the label of its nearest decided neighbours.  A marked article is evidence:
if it holds at least as much running text as the rest of the page (else the marks
are of teasers, whose open blocks are good between good ones only), blocks in it need fewer stop words to be
good, and are good where nothing near them is decided; open blocks outside need a
good block outside.  A link with stop words stays open in the article and is good
between good blocks.  A form that holds most of the page's good text is opened.

Each row is handled on its own, so nothing is shuffled.  Defined cases: null or
empty html gives the empty text; malformed markup is read as far as it goes, an
unclosed comment or script to the end of the page; repeated rows give repeated
results; other columns are not read.
"""

from __future__ import annotations

import html as charrefs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Frequent function words of the supported languages.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous "
    "als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im ist man mit nach nicht noch oder sich sie sind so über um und von war wie wird zu zum zur "
    "al como con del el ella en era es esta este fue ha hay la las lo los más me mi muy no o para pero por que se si sin sobre su sus también te un una y ya yo".split()
)

#: Elements whose text is never main text.
DROPPED = frozenset("applet aside audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input map menu nav noembed noframes noscript object option script select style svg template textarea title video".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Roots of foreign content, where "/>" closes an element.
FOREIGN = ("svg", "math")
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = frozenset(("p", "blockquote", "pre", *HEADINGS))

#: Words in class names, ids and roles of elements that are not main text.
DROPPED_NAMES = frozenset(
    "ad ads adslot adsbygoogle advert adverts advertisement advertisements advertising alert alertdialog banner breadcrumb breadcrumbs comment comments commentlist commenting complementary "
    "consent contentinfo cookie cookies copyright dialog disqus footer form gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination paywall popup promo promotion recommended related replies reply respond search share sharebar sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription "
    "tagcloud toolbar topbar widget widgets".split()
)
#: Class names of elements with main text, and words that end the name of a layout or a setting.
CONTENT_NAMES = frozenset("article content entry main post story".split())
SETTINGS = frozenset("active disabled enabled layout off on".split())
ARTICLE_NAMES = frozenset(("article-body", "article-content", "article-text", "articlebody", "entry-content", "main-content", "post-body", "post-content", "story-body"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile(r"[>\"'<]")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s>=/]|$)", re.I)


class _Block:
    __slots__ = ("parts", "linked", "main", "heading", "form")

    def __init__(self, main: bool, heading: bool, form: int):
        self.parts: list[str] = []
        self.linked, self.main, self.heading, self.form = 0, main, heading, form


class _Scope:
    """An open block element: name, whether its text is left out, whether it is in a marked article, the number of its form, and its open inline elements."""

    __slots__ = ("name", "drop", "main", "form", "inline", "count")

    def __init__(self, name: str, drop: bool, main: bool, form: int):
        self.name, self.drop, self.main, self.form = name, drop, main, form
        self.inline: list[tuple[str, bool]] = []
        self.count: dict[str, int] = {}

    def push(self, name: str, drop: bool) -> None:
        self.inline.append((name, self.drop))
        self.count[name] = self.count.get(name, 0) + 1
        self.drop = self.drop or drop

    def close(self, name: str) -> None:
        if self.count.get(name):
            while True:
                last, self.drop = self.inline.pop()
                self.count[last] -= 1
                if last == name:
                    return


def _named(names: str, tag: str = "div", text: bool = False) -> bool:
    """Whether a class name, id or role marks something other than main text.

    A name of one word always does; one of several by its first or last word,
    but not on an article or beside a name of main text, and not as a setting; on
    running text of a marked article (`text`) by its last word only.
    """
    found = names.split()
    whole = tag == "article" or any(n.lower() in CONTENT_NAMES for n in found)
    for name in found:
        words = [w.lower() for w in _NAME_WORDS.findall(name)]
        if tag == "form":  # that a form is called one says nothing
            words = [w for w in words if w != "form"]
        if not words or {"with", "has", "no", "without"} & set(words):
            continue
        if len(words) == 1:
            if words[0] in DROPPED_NAMES:
                return True
        elif not whole and words[-1] not in SETTINGS and (words[-1] in DROPPED_NAMES or (not text and words[0] in DROPPED_NAMES)):
            return True
    return False


class _Tags:
    """Ends of a page's tags: quoted values are read whole, however long.

    A tag that meets a `<` outside quotes, or a quote that nothing closes, ends
    at its first `>`.  Quotes at which such a tag was open are remembered, so no
    part of a page is read more than a few times.
    """

    def __init__(self, page: str):
        self.page, self.failed, self.unclosed = page, set(), {}  # unclosed: from where on no such quote follows

    def end(self, at: int) -> int:
        """The position after the tag whose name ends at `at`."""
        page, i, opened = self.page, at, []
        while stop := _STOP.search(page, i):
            c, i = stop[0], stop.end()
            if c == ">":
                return i
            if c == "<" or i in self.failed or i >= self.unclosed.get(c, len(page) + 1):
                break
            opened.append(i)
            close = page.find(c, i)
            if close < 0:
                self.unclosed[c] = min(i, self.unclosed.get(c, i))
                break
            i = close + 1
        self.failed.update(opened)
        return page.find(">", at) + 1 or len(page)


def blocks_of(page: str) -> list[tuple[str, float, bool, bool]]:
    """(text, share of it in links, inside a marked article, heading) of each block with text that is not left out."""
    done: list[_Block] = []
    scopes = [_Scope("", False, False, 0)]
    opened: dict[str, int] = {}  # block elements in scopes, by name
    now = _Block(False, False, 0)
    links = breaks = at = forms = 0
    tags = _Tags(page)

    def cut(heading: bool = False) -> None:
        nonlocal now
        if now.parts:
            done.append(now)
        now = _Block(scopes[-1].main, heading, scopes[-1].form)

    def add(text: str) -> None:
        nonlocal breaks
        if text and not scopes[-1].drop:
            text = charrefs.unescape(text) if "&" in text else text
            now.parts.append(text)
            if links:
                now.linked += len(text)
            if not text.isspace():
                breaks = 0

    def pop() -> None:
        opened[scopes.pop().name] -= 1

    while at < len(page):
        tag = _TAG.search(page, at)
        if not tag:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        at = tags.end(tag.end())
        closing, name, rest = tag[1], tag[2].lower(), page[tag.end() : at]
        if name == "br":
            breaks += 1
            now.parts.append(" ")
            if breaks > 1:
                cut()
            continue
        if name == "a":
            links = int(not closing and bool(_HREF.search(rest)))
        if closing:
            if name not in BLOCK:
                scopes[-1].close(name)
                continue
            while opened.get(name):
                last = scopes[-1].name
                pop()
                if last == name:
                    break
            cut()
            continue
        if name in VOID:
            if name == "hr":
                cut()
            continue
        scope = scopes[-1]
        drop, main = name in DROPPED and name != "form", scope.main
        if "=" in rest or "hidden" in rest:
            attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
            names = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
            if name not in ("html", "body", "main"):
                drop = drop or _named(names, name, main and (name in RUNNING or name not in BLOCK)) or bool(_HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", rest)))
                drop = drop or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            main = main or attributes.get("itemprop") == "articleBody" or attributes.get("role") in ("main", "article") or any(n.lower() in ARTICLE_NAMES for n in names.split())
        if name == "header" and not main:
            drop = True
        main = main or name in ("article", "main")
        if name in BLOCK:
            if name in ("p", *HEADINGS) and scope.name == "p":
                pop()
            if name == "li" and scope.name in ("li", "p"):
                pop()
            form = scopes[-1].form
            if name == "form" and not form:
                forms += 1
                form = forms
            scopes.append(_Scope(name, drop or scopes[-1].drop, main, form))
            opened[name] = opened.get(name, 0) + 1
            cut(name in HEADINGS)
        elif not (rest.endswith("/>") and (name in FOREIGN or any(scope.count.get(f) for f in FOREIGN))):
            scope.push(name, drop)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])|\Z", re.I).search(page, at)
            at = end.start()
    if now.parts:
        done.append(now)
    out, inside = [], []
    for b in done:
        text = " ".join("".join(b.parts).split())
        if text:
            out.append((text, min(1.0, b.linked / len(text)), b.main, b.heading))
            inside.append(b.form)
    return _opened(out, inside) if any(inside) else out


def _opened(blocks: list[tuple[str, float, bool, bool]], forms: list[int]) -> list[tuple[str, float, bool, bool]]:
    """The blocks without those of forms, but for a form that holds more of what pass 1 calls good than all the rest of the page."""
    good: dict[int, int] = {}
    for (text, link, _, heading), form in zip(blocks, forms, strict=True):
        if len(text) >= 140 and _first(text, link, heading, _stops(text)):
            good[form] = good.get(form, 0) + len(text)
    most = max(good, key=lambda f: good[f], default=0)
    whole = most if 2 * good.get(most, 0) > sum(good.values()) else 0
    return [b for b, form in zip(blocks, forms, strict=True) if form in (0, whole)]


def _stops(text: str) -> float:
    """The share of stop words."""
    words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def _first(text: str, link: float, heading: bool, stops: float) -> bool | None:
    """Pass 1: whether a block is main text, or None where that is open."""
    if link > 0.5 or (link > 0.25 and len(text) < 140):
        return False
    if not heading and stops >= 0.2 and len(text) >= 140:
        return True
    return None


def classify(blocks: list[tuple[str, float, bool, bool]]) -> list[bool]:
    """Whether each block is main text: pass 1 decides what it can, pass 2 settles the open blocks."""
    labels: list[bool | None] = []
    leaning: list[bool] = []
    shares: list[float] = []
    running = [0, 0]  # characters of running text outside and inside a marked article
    for text, link, main, heading in blocks:
        stops = _stops(text)
        label = _first(text, link, heading, stops)
        labels.append(label)
        leaning.append(heading or stops >= 0.1 or len(text) >= 140)
        shares.append(stops)
        if label is not False and not heading and leaning[-1]:
            running[main] += len(text)
    inside = [i for i, b in enumerate(blocks) if b[2]]
    if not inside or running[1] < running[0]:
        return _settle(labels, leaning, [b[2] for b in blocks])

    linked = [False] * len(blocks)
    for i in inside:
        text, link, _, heading = blocks[i]
        if labels[i] is False:
            linked[i] = link > 0.66 and len(text) < 140
            labels[i] = None if shares[i] >= 0.1 or not linked[i] else False
        elif not heading and shares[i] >= 0.1:
            labels[i] = True
    part = [labels[i] for i in inside]
    if not any(part):  # the mark decides
        part = [not linked[i] if label is None else label for i, label in zip(inside, part, strict=True)]
    out = [False] * len(blocks)
    for i, good in zip(inside, _settle(part, [leaning[i] for i in inside], [linked[i] for i in inside]), strict=True):
        out[i] = good
    rest = [i for i, b in enumerate(blocks) if not b[2]]
    if any(labels[i] for i in rest):
        for i, good in zip(rest, _settle([labels[i] for i in rest], [leaning[i] for i in rest]), strict=True):
            out[i] = good
    return out


def _settle(labels: list[bool | None], leaning: list[bool], doubted: list[bool] | None = None) -> list[bool]:
    """Pass 2: the labels with open blocks settled by their neighbours; a doubted one is good between good blocks only."""
    if not any(labels):  # nothing is certain: what leans to main text decides, else all that is open stays
        lean = any(le and label is None for le, label in zip(leaning, labels, strict=True))
        labels = [True if label is None and (le or not lean) else label for le, label in zip(leaning, labels, strict=True)]
        if not any(labels):
            return [False] * len(labels)
    decided = [i for i, label in enumerate(labels) if label is not None]
    out, j = [], 0
    for i, label in enumerate(labels):
        if label is None:
            while j < len(decided) and decided[j] < i:
                j += 1
            before = decided[j - 1] if j else None
            after = decided[j] if j < len(decided) else None
            if doubted and doubted[i]:
                label = before is not None and after is not None and labels[before] and labels[after]
            elif before is None or after is None:
                label = labels[after if before is None else before]
            elif labels[before] == labels[after] or i - before == after - i:
                label = labels[before] if labels[before] == labels[after] else leaning[i]
            else:
                label = labels[before if i - before < after - i else after]
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b[0] for b, good in zip(blocks, classify(blocks), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    schema = f"page_id {dict(rows.dtypes)['page_id']}, url string, text string"
    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
