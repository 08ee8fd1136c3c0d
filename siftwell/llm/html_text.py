"""HTML extraction by tag-path ratios.

Text nodes are grouped by their path of tags from the root. A path's ratios are
its text length and its punctuation marks for each of its nodes; along the page
they are smoothed by a Gaussian, fused to one value and compared with a
threshold. The nodes of the chosen paths tell which element holds the article;
its blocks are the text, without what markup names as a menu, advert, form,
notice, comment and so on. A name, class, id or role that says so doesn't count
where the element holds the article: see ``_misnamed``. What no page shows as
text (scripts, styles, hidden elements, the parts of forms) is left out wherever
it stands, inside a paragraph too.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import narrow_batches, table

# Names of HTML elements by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are never text of a page, and of these the ones whose contents aren't markup either.
NEVER = frozenset("head title script style noscript template iframe noembed noframes object svg math canvas audio video select option optgroup textarea button datalist map progress meter".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes")
#: Elements that stand in a head; any other ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements whose names say that they are no article.
ASIDES = frozenset("nav footer aside form menu dialog search".split())
INLINE = frozenset("abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag ends, if they are open within the nearest of the others.
ENDED_BY = {
    **dict.fromkeys(BLOCKS - {"body", "html", "li", "dd", "dt", "tr", "tbody", "tfoot", "thead", "caption"}, (frozenset(["p"]), frozenset("article aside blockquote body button dd div footer header li main nav section td th".split()))),
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
#: Words in class, id or role that name what isn't part of an article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dfp disqus dropdown feedback "
    "footer gdpr masthead menu menubar menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promos promoted promotion "
    "recommended related reply replies respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
HEADER_WORDS = frozenset(["header", "pageheader", "siteheader", "topbar"])
#: Of these, the words for what readers write.
READER_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: Of the words, those that a heading of an article may begin with too, as in id="search-algorithms", unless what follows names a part of a page.
TOPIC_WORDS = frozenset("banner menu menus navigation notice notices recommended related search share social widget widgets".split())
#: Words that an element within a block is left out for, if text stands before it in the block.
INLINE_WORDS = frozenset("ad ads adv advert advertisement adverts advertising dfp promo promos promoted share sharing social sponsor sponsored".split())
PAGE_PARTS = frozenset(
    "area article articles bar block body box button buttons column container content count entries feed field follow form group heading icon icons inner input item items left link links list "
    "main media more news now on page pages panel post posts products read reading result results right section sites stories story tags teaser text this title toggle top topics us via wrap wrapper".split()
)
PUNCTUATION = frozenset(".,;:!?…。，；：！？、؟،।¡¿")
SMOOTHING = (0.2741, 0.4518, 0.2741)
#: Share of the mean fused value that a path must reach, and share of the chosen text that the article's element holds.
THRESHOLD, HOLDS = 0.5, 0.8
#: Shares of the text beyond which an element holds the article, whatever its words or its name say; HOLDS where these name what readers write.
MOST, NAMED = 0.5, 0.7

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_CODE = re.compile(r"<\?(?:php\b|=)", re.IGNORECASE)
_UNENDED = re.compile(r"<[!?/a-z]", re.IGNORECASE)
#: Marked sections that end with ]]>.
_SECTION = re.compile(r"<!\[(?:temp|cdata|ignore|include|rcdata)(?![-_.a-z0-9])", re.IGNORECASE)


class _Page(HTMLParser):
    """Elements, as (tag, parent, aside, header, frame, doubt), and blocks of text below them.

    doubt is the share of the text that speaks against an element's name or words. A block is [element, path,
    parts], a part [element that marks it, texts, link characters]: the nearest one that is an aside or a header, if any.
    """

    CDATA_CONTENT_ELEMENTS = RAW

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list = [("", -1, False, False, False, 0)]
        self.open = [0]
        self.blocks: list = []
        self.paths: dict = {}
        self.pathed = [0]
        #: The nearest marked element of each open one, and whether it lies in one that is never text.
        self.marked, self.unseen = [0], [False]
        self.current = None
        self.links = 0
        #: Elements whose words may be those of a heading.
        self.topics: set = set()

    def _end_block(self) -> None:
        self.current = None

    def _end_head(self) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.elements[self.open[depth]][0] == "head":
                self._close_to(depth)
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")
        if self.unseen[-1] and tag not in IN_HEAD and "head" in {self.elements[i][0] for i in self.open[-1:]}:
            self._end_head()
        if tag in VOID:
            if tag in BLOCKS and not self.unseen[-1]:
                self._end_block()
            return
        ended = ENDED_BY.get(tag)
        if ended:
            for depth in range(len(self.open) - 1, 0, -1):
                name = self.elements[self.open[depth]][0]
                if name not in ended[0] and (name in ended[1] or name in NEVER):
                    break
                if name in ended[0]:
                    last = depth
                    while last > 1 and self.elements[self.open[last - 1]][0] in ended[0]:
                        last -= 1
                    self._close_to(last)
                    break
        unseen = self.unseen[-1] or tag in NEVER
        words: set = set()
        topical = True
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for token in value.split():
                    parts = [w.lower() for w in _WORDS.findall(token)]
                    words.update(parts)
                    if ASIDE_WORDS & set(parts):
                        topical = topical and len(parts) > 1 and parts[0] in TOPIC_WORDS and not (ASIDE_WORDS | PAGE_PARTS) & set(parts[1:])
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
                unseen = True
        if not unseen:
            if tag in BLOCKS:
                self._end_block()
            elif tag in ("td", "th"):
                self.handle_data(" ")
        frame = tag in ("html", "body", "main", "article") and not words & {"comment", "comments", "reply", "replies", "ad", "ads", "advert"}
        within = tag not in BLOCKS and self.current is not None
        aside = tag in ASIDES or (not frame and bool(words & (INLINE_WORDS if within else ASIDE_WORDS)))
        header = tag == "header" or (not frame and not within and tag not in HEADINGS and bool(words & HEADER_WORDS))
        doubt = 0
        if aside or header:
            doubt = HOLDS if words & READER_WORDS else NAMED if tag in ASIDES and tag != "form" or tag == "header" else MOST
        if doubt and topical and not header and tag not in ASIDES and not within:
            self.topics.add(len(self.elements))
        parent = self.open[-1]
        self.open.append(len(self.elements))
        path = self.pathed[-1]
        self.pathed.append(path if tag in INLINE else self.paths.setdefault((path, tag), len(self.paths) + 1))
        self.marked.append(len(self.elements) if aside or header else self.marked[-1])
        self.unseen.append(unseen)
        self.elements.append((tag, parent, aside, header, frame and tag in ("article", "main"), doubt))
        self.links += tag == "a"

    def parse_marked_section(self, i, report=1):
        """A section that ends with ]]>; any other <![ is, as in browsers, a comment up to the next >."""
        if _SECTION.match(self.rawdata, i):
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, report)

    def parse_pi(self, i):
        """<?php and <?= up to ?>, whatever they hold; any other <? up to the next >."""
        if _CODE.match(self.rawdata, i):
            end = self.rawdata.find("?>", i)
            return end + 2 if end >= 0 else -1
        return super().parse_pi(i)

    def handle_startendtag(self, tag, attrs):
        """A slash closes an element within svg and math alone."""
        foreign = tag in ("svg", "math") or self.unseen[-1] and any(self.elements[i][0] in ("svg", "math") for i in self.open)
        if not foreign:
            self.handle_starttag(tag, attrs)

    def close(self) -> None:
        """What is left begins with a comment, a tag or a declaration that the page doesn't end, and is none of its text."""
        if _UNENDED.match(self.rawdata) and not self.cdata_elem:
            self.rawdata = ""
        if self.cdata_elem:
            self.rawdata = ""
        super().close()

    def _close_to(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.links -= self.elements[i][0] == "a"
        if any(self.elements[i][0] in BLOCKS and not self.unseen[d] for d, i in enumerate(self.open[depth:], depth)):
            self._end_block()
        for stack in (self.open, self.pathed, self.marked, self.unseen):
            del stack[depth:]

    def handle_endtag(self, tag):
        if tag == "p" and not any(self.elements[i][0] == "p" for i in self.open):
            if not self.unseen[-1]:
                self._end_block()
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.elements[self.open[depth]][0]
            if name == tag:
                self._close_to(depth)
                return
            if name in BLOCKS and tag not in BLOCKS and tag not in NEVER:
                return

    def handle_data(self, data):
        if self.unseen[-1]:
            if not data.strip() or self.elements[self.open[-1]][0] != "head":
                return
            self._end_head()  # text ends a head
            if self.unseen[-1]:
                return
        if self.current is None:
            if not data.strip():
                return
            self.current = [self.open[-1], self.pathed[-1], []]
            self.blocks.append(self.current)
        parts, mark = self.current[2], self.marked[-1]
        if not parts or parts[-1][0] != mark:
            parts.append([mark, [], 0])
        parts[-1][1].append(data)
        if self.links:
            parts[-1][2] += len(data)

    def entries(self) -> list:
        """(element, path, text, link characters, block) of each part of a block; the element is the block's, or the one that marks the part."""
        out = []
        for k, (element, path, parts) in enumerate(self.blocks):
            for mark, texts, links in parts:
                text = _SPACE.sub(" ", "".join(texts)).strip()
                if text:
                    out.append((element if self._mark_of(element) == mark else mark, path, text, links, k))
        return out

    def _mark_of(self, element: int) -> int:
        while element and not (self.elements[element][2] or self.elements[element][3]):
            element = self.elements[element][1]
        return max(element, 0)


def _chosen(blocks: list) -> set:
    """The paths whose ratios reach the threshold."""
    sums: dict = {}
    for _, path, text, links, _ in blocks:
        n, length, marks, linked = sums.get(path, (0, 0, 0, 0))
        sums[path] = (n + 1, length + len(text), marks + sum(c in PUNCTUATION for c in text), linked + min(links, len(text)))
    ratio = {p: (length / n, marks / n * (1 - linked / length)) for p, (n, length, marks, linked) in sums.items()}

    def smoothed(k: int) -> list:
        values = [ratio[b[1]][k] for b in blocks]
        padded = [values[0], *values, values[-1]]
        return [sum(w * x for w, x in zip(SMOOTHING, padded[i : i + 3])) for i in range(len(values))]

    fused: dict = {}
    for (_, path, _, _, _), length, marks in zip(blocks, smoothed(0), smoothed(1)):
        fused.setdefault(path, []).append(length * (1 + marks))
    fused = {p: (sum(v) / len(v) * ratio[p][0] * (1 + ratio[p][1])) ** 0.5 for p, v in fused.items()}
    mean = sum(fused[b[1]] for b in blocks) / len(blocks)
    return {p for p, v in fused.items() if v >= THRESHOLD * mean}


def _sentences(text: str, links: int) -> bool:
    """Whether a block reads like a paragraph of an article."""
    return len(text) >= 40 and text[-1] in PUNCTUATION and links <= 0.5 * len(text)


def _misnamed(elements: list, texts: list) -> set:
    """Elements that hold the article though their words name something else, as in class="has-sidebar".

    texts: all blocks. An element that holds an article or main is one if these
    have more text than those outside it. If it holds none and none is outside it
    (but for those in other such elements), the paths decide: it must hold most of the text of the chosen paths, links
    aside. An element that its own name tells to be an aside, as nav does, needs more and a
    paragraph of sentences. What readers write is often longer than an article: elements named
    so need four times as much in both cases, and are judged last.
    """
    named = [i for i, e in enumerate(elements) if e[5]]
    if not named:
        return set()
    out: set = set()
    sure, reader = [False] * len(elements), [False] * len(elements)
    for i, (tag, parent, aside, head, _, doubt) in enumerate(elements):
        if i:
            sure[i] = sure[parent] or ((aside or head) and not doubt)
            reader[i] = reader[parent] or doubt == HOLDS
    texts = [b for b in texts if not sure[b[0]]]

    def framed(plain: bool) -> tuple[list, list]:
        """Text in articles and mains below each element, and in those that neither hold it nor lie in it.

        plain: of the latter only those that no element with a doubt parts from it.
        """
        whole, kids, outside = [0] * len(elements), [0] * len(elements), [0] * len(elements)
        for element, _, text, _, _ in texts:
            whole[element] += len(text)
        own = [0] * len(elements)
        for i in range(len(elements) - 1, 0, -1):
            _, parent, _, _, frame, doubt = elements[i]
            own[i] = whole[i] if frame else kids[i]
            if plain and doubt:
                own[i] = 0
            whole[parent] += whole[i]
            kids[parent] += own[i]
        for i in range(1, len(elements)):
            parent = elements[i][1]
            outside[i] = outside[parent] + kids[parent] - own[i]
        return kids, outside

    inside, outside = framed(False)
    out.update(i for i in named if inside[i] > elements[i][5] * (inside[i] + outside[i]))
    _, outside = framed(True)
    for doubt in (MOST, NAMED, HOLDS):
        open_ = [i for i in named if elements[i][5] == doubt and i not in out and not inside[i] and not outside[i]]
        if not open_:
            continue
        gone = [False] * len(elements)
        for i, e in enumerate(elements):
            if i:
                gone[i] = gone[e[1]] or (0 < e[5] < doubt and i not in out)
        rest = [b for b in texts if not gone[b[0]] and not (doubt < HOLDS and reader[b[0]])]
        if not rest:
            continue
        chosen, held, prose = _chosen(rest), [0] * len(elements), [False] * len(elements)
        for element, path, text, links, _ in rest:
            if path in chosen:
                held[element] += max(0, len(text) - links)
                prose[element] |= _sentences(text, links)
        for i in range(len(elements) - 1, 0, -1):
            held[elements[i][1]] += held[i]
            prose[elements[i][1]] |= prose[i]
        out.update(i for i in open_ if held[i] > doubt * held[0] and (prose[i] or not elements[i][0] in (*ASIDES, "header")))
    return out


def _prose(page: _Page, texts: list) -> set:
    """Of the elements whose words may be a heading's, those that hold sentences and hardly a link."""
    if not page.topics:
        return set()
    sums: dict = {i: [0, 0, 0] for i in page.topics}
    for element, _, text, links, _ in texts:
        i = element
        while i > 0:
            if i in sums:
                sums[i][0] += len(text)
                sums[i][1] += links
                sums[i][2] += len(text) >= 40 and text[-1] in PUNCTUATION
            i = page.elements[i][1]
    return {i for i, (n, links, sentences) in sums.items() if sentences and links <= 0.1 * n}


def main_text(html: str) -> str:
    """The article of a page: its blocks in order, one a line; empty if there is none."""
    page = _Page()
    page.feed(html)
    page.close()
    elements, texts = page.elements, page.entries()
    page.topics = _prose(page, texts)
    misnamed = _misnamed(elements, texts) | page.topics
    aside, header, framed = [False] * len(elements), [-1] * len(elements), [False] * len(elements)
    titled: set = set()
    for i, (tag, parent, own, head, _, _) in enumerate(elements):
        if i:
            aside[i] = own and i not in misnamed or aside[parent]
            header[i] = i if head and i not in misnamed else header[parent]
            framed[i] = framed[parent] or tag in ("article", "main")
            if tag == "h1" and header[i] >= 0 and framed[i]:
                titled.add(header[i])

    def heading(i: int) -> bool:
        while i > 0:
            if elements[i][0] in HEADINGS:
                return True
            i = elements[i][1]
        return False

    kept: dict = {}
    for element, path, text, links, k in texts:
        outside = header[element] >= 0 and not (header[element] in titled and heading(element))
        if not aside[element] and not outside:
            kept.setdefault(k, [0, set()])
            kept[k][0] += links
            kept[k][1].add(page._mark_of(element))
    blocks = []
    for k, (links, marks) in kept.items():
        element, path, parts = page.blocks[k]
        text = _SPACE.sub(" ", "".join("".join(texts_) for mark, texts_, _ in parts if mark in marks)).strip()
        if text:
            blocks.append((element, path, text, links, k))
    if not blocks:
        return ""
    chosen = _chosen(blocks)

    held: dict = {}
    sentences: dict = {}
    for element, path, text, links, _ in blocks:
        if path in chosen:
            i, own = element, _sentences(text, links)
            while i >= 0:
                held[i] = held.get(i, 0) + len(text)
                sentences[i] = sentences.get(i, 0) + own
                i = elements[i][1]
    inner: dict = {}
    for i in held:
        if i:
            inner.setdefault(elements[i][1], []).append(i)
    root, total = 0, held.get(0, 0)
    while elements[root][0] not in ("article", "main"):
        best = max(inner.get(root, ()), key=held.get, default=None)
        # Paragraphs beside it are the article's too.
        if best is None or held[best] < HOLDS * total or sentences[best] < sentences[root] or elements[best][0] in ("p", "td", "th", "li") or elements[best][0] not in BLOCKS:
            break
        root = best
    if elements[root][0] == "main":  # one article within it is closer
        best = max(inner.get(root, ()), key=held.get, default=None)
        if best is not None and elements[best][0] == "article" and held[best] >= HOLDS * total and sentences[best] == sentences[root]:
            root = best

    def below(i: int) -> bool:
        while i > root:
            i = elements[i][1]
        return i == root

    def paragraph(i: int) -> int:
        while i > 0 and elements[i][0] != "p":
            i = elements[i][1]
        return i

    # A paragraph that is one link belongs to the article if paragraphs of the chosen paths stand beside it.
    homes = {elements[p][1] for element, path, _, _, _ in blocks if path in chosen and (p := paragraph(element)) > 0}

    def listed(element: int, path: int, text: str, links: int, _: int) -> bool:
        """Whether a block is one of a list of links."""
        if path in chosen or links < 0.9 * len(text) or heading(element):
            return False
        p = paragraph(element)
        return not (p > 0 and elements[p][1] in homes)

    return "\n".join(block[2] for block in blocks if below(block[0]) and not listed(*block))


def extracted(pages: DataFrame) -> DataFrame:
    """pages with a column text (in place of one of that name): the article of the whole html.

    A null or empty html, and a page without an article, give an empty text. All
    other columns and all rows, repeated ones too, pass through.
    """
    pages = pages.drop("text")
    names = pages.columns
    at = names.index("html")

    def run(batches):
        for batch in narrow_batches(batches):
            texts = [main_text(h) if h else "" for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType(), False)]))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
