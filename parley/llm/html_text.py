"""The main text of a web page, by the maximum-scoring contiguous stretch.

A page is read as a sequence of tags and words. Words score positive, tags
negative; how much, by kind of word and by tag, is learned from labelled pages:
those that mark their article with exactly one ``article`` or ``main`` element,
inside which words and tags count as content. One linear scan finds the
contiguous stretch of the highest sum, the content region. A tag scores once for
a run of like siblings: the rows and cells of a table, the items of a list and the
paragraphs of a section are one change of structure, however many they are.

What a reader would not call article (menus, headers, footers, sidebars, notices,
adverts, forms, comments) is known by its element or by its class, id or role
and left out, as are scripts, styles and comments in the source; it takes no part
in the scan, so that a long box does not cut an article in two. Words of classes,
ids and roles that labelled pages have nearly always beside their article join the
fixed ones. Names and forms
are evidence for small elements only: one that holds more than half of the page's
plain words, in blocks of its own (a wrapper, or a page-wide form), is not left out for its name, and
inside an article neither is one of ``AMBIGUOUS`` names that has running text.

Null html is an empty page. A page without any words has an empty text, and so has
one whose words are all left out. Character
references are decoded before white space is turned into one space. Blocks follow
the order of the page. Of two stretches with the same sum the first is taken.
Repeated rows give repeated rows; an empty table gives an empty one; where no page
marks its article, fixed weights hold. A page is read in time linear in its length.
A tag whose quote never ends is over at the next ``>``; from then on all tags of
that page are. Only the columns asked for are returned, whatever others are called.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that start a block of their own, that hold no text, and that have no end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never article text.
OUTSIDE = frozenset(
    "head title script style noscript template nav footer aside button select textarea input iframe object svg canvas dialog menu "
    "audio video datalist noembed noframes xmp map".split()
)
#: Words in a class, id or role that name something other than the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login paywall nav navigation navbar menu menubar breadcrumb breadcrumbs "
    "pagination pager sidebar sidebars aside complementary contentinfo footer header masthead toolbar share sharing social related recommended "
    "recommendations comment comments commentlist disqus respond reply replies discussion widget widgets skip toc search form legal copyright "
    "remark remarks kommentar kommentare kommentarer commentaire commentaires comentario comentarios commento commenti reacties komentarz komentarze".split()
)
#: Of these, those that a section of an article may have by its topic.
AMBIGUOUS = frozenset("notice notices alert social share sharing related discussion respond reply replies search form legal copyright skip sponsor promotion consent gdpr".split())
#: Plain words that make an element of such a name running text, if it has no more in links.
RUNNING = 20
COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.S)
#: An attribute's value is quoted only where a quote follows the equals sign.
VALUE = r"""(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\f\r>"'][^ \t\n\f\r>]*+))"""
ATTRIBUTE = re.compile(rf"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+{VALUE})?+")
TAG = re.compile(rf"</?[a-zA-Z][^ \t\n\f\r/>]*+(?:[ \t\n\f\r/]++|{ATTRIBUTE.pattern})*+>")
PLAIN_TAG = re.compile(r"</?[a-zA-Z][^>]*+>|<[!?][^>]*+>")
NAME = re.compile(r"</?([a-zA-Z][^ \t\n\f\r/>]*)")
LABELS = frozenset(("class", "id", "role"))
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Bounds of what is learned: a word counts 0.1 to 4, a tag -2 to -0.1.
WORD_RANGE, TAG_RANGE = (0.1, 4.0), (-2.0, -0.1)
#: Elements within a block that have a weight of their own; all others share one.
INLINE = frozenset("a abbr b cite code del em font i ins kbd label mark picture q s samp small span strong sub sup td th time u var".split())
#: A name is learned from this log odds on, so at eight times as many elements beside the article; of such names this many at most.
OTHER, MOST_NAMES = -2.0, 4096


def label_words(tag: str) -> set[str]:
    """Words of an element's class, id and role."""
    found: set[str] = set()
    for name, *values in ATTRIBUTE.findall(tag, NAME.match(tag).end()):
        if name.lower() in LABELS:
            for label in html.unescape("".join(values)).split():
                parts = [p.lower() for p in PIECES.findall(label)]
                if parts and parts[0] not in ("has", "with", "no", "without", "not"):
                    found.update(parts)
    return found


def names_other(labels: set[str], name: str, weights: dict[str, float], inside_article: bool = False) -> set[str]:
    """Words of an element's labels that say that it is not the article; a header inside an article may hold its title."""
    if name in ("html", "body", "article", "main"):
        return set()
    return {p for p in labels if (p in NAMES or weights.get("name:" + p, 0.0) <= OTHER) and not (inside_article and p == "header")}


class Named:
    """Elements with a name or form that speaks against them, by the order in which they open."""

    def __init__(self):
        self.words = [0, 0, 0]  # of the page so far: plain ones, those in links; and its blocks
        self.open: list[tuple[int, int, int, bool]] = []  # words and blocks before, and whether the names are ambiguous inside an article
        self.held: dict[int, tuple[int, int, int]] = {}

    def begin(self, ambiguous: bool) -> int:
        self.open.append((*self.words, ambiguous))
        return len(self.open) - 1

    def end(self, k: int) -> None:
        plain, links, blocks, _ = self.open[k]
        self.held[k] = self.words[0] - plain, self.words[1] - links, self.words[2] - blocks

    def spared(self) -> frozenset[int]:
        """Those that are not left out: they hold most plain words of the page, or are running text of an article."""
        return frozenset(
            k
            for k, (plain, links, blocks) in self.held.items()
            if blocks and (2 * plain > self.words[0] or self.open[k][3] and plain >= max(RUNNING, links))
        )


#: (tag name or '' for text, text or '/' for an end tag or '=' for one like its sibling, inside a link, left out, inside article or main)
Item = tuple[str, str, bool, bool, bool]


def items(page: str, weights: dict[str, float], labels: Counter | None = None) -> list[Item]:
    """Tags and texts of a page; ``labels`` counts words of classes, ids and roles inside and beside marked elements, not of what holds these."""
    named = Named()
    parts = list(read_items(page, weights, named, frozenset(), labels))
    spared = named.spared()
    return list(read_items(page, weights, Named(), spared)) if spared else parts


def read_items(page: str, weights: dict[str, float], named: Named, spared: frozenset[int], labels: Counter | None = None) -> Iterator[Item]:
    at, text_from, n, last, whole = 0, 0, len(page), page.rfind(">"), True
    # Open elements: name, whether left out, whether by their kind, number among the named or -1, labels, marks before, whether inside a mark.
    stack: list[tuple[str, bool, bool, int, set[str], int, bool]] = []
    opened: Counter = Counter()
    blocks: list[int] = []  # places of open blocks in the stack
    siblings: list[str] = []  # for each depth, the last element that opened there below like parents
    out = never = begun = 0

    def drop(to: int) -> None:
        nonlocal out, never
        while len(stack) > to:
            name, left_out, by_kind, number, words, before, inside = stack.pop()
            out -= left_out
            never -= by_kind
            opened[name] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if number >= 0:
                named.end(number)
            if labels is not None and begun == before:
                labels.update(("name:" + w, inside) for w in words if len(w) <= 32)

    def marked() -> bool:
        return opened["article"] + opened["main"] > 0

    def text(stop: int) -> Iterator[Item]:
        if stop > text_from:
            piece = page[text_from:stop]
            if not never:
                named.words[opened["a"] > 0] += len(piece.split())
            yield "", piece, opened["a"] > 0, out > 0, marked()

    while (start := page.find("<", at)) >= 0:
        m = COMMENT.match(page, start)
        if not m and start < last:
            m = TAG.match(page, start) if whole else None
            if not m:
                m = PLAIN_TAG.match(page, start)
                whole = whole and not (m and page[start + 1] not in "!?")
        if not m:
            at = start + 1
            continue
        yield from text(start)
        at = text_from = m.end()
        tag = m.group()
        if tag[1] in "!?":
            continue
        name = NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if opened[name] or name in ("p", "br"):
                yield name, "/", opened["a"] > 0, out > 0, marked()
            if opened[name]:
                place = len(stack) - 1
                while stack[place][0] != name:  # all that is passed is closed
                    place -= 1
                drop(place)
            continue
        if name in BLOCKS and name not in ("html", "head", "body") and blocks and stack[blocks[-1]][0] == "p":  # a block ends an open paragraph
            drop(blocks[-1])
        if name == "body" and opened["head"]:
            place = len(stack) - 1
            while stack[place][0] != "head":
                place -= 1
            drop(place)
        if stack and stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd", "option"):
            drop(len(stack) - 1)
        inside = marked()
        by_kind = name in OUTSIDE or (name == "header" and not inside)
        words = set() if name in VOID else label_words(tag)
        others = set() if by_kind else names_other(words, name, weights, inside)
        number = named.begin(inside and name != "form" and others <= AMBIGUOUS) if others or name == "form" else -1
        if number < 0:
            named.words[2] += name in BLOCKS
        left_out = by_kind or number >= 0 and number not in spared
        like = ""
        if not (out or left_out):
            depth = len(stack)
            if depth < len(siblings) and siblings[depth] == name:
                like = "="
            else:
                del siblings[depth:]
                siblings.extend([""] * (depth - len(siblings)))
                siblings.append(name)
        yield name, like, opened["a"] > 0, out > 0 or left_out, inside
        if name in VOID or tag.endswith("/>") and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                yield "", page[at:stop], False, True, inside
            close = page.find(">", stop) if end else -1
            at = text_from = close + 1 if close >= 0 else n
            continue
        if name in BLOCKS:
            blocks.append(len(stack))
        stack.append((name, left_out, by_kind, number, words, begun, inside))
        begun += name in ("article", "main")
        opened[name] += 1
        out += left_out
        never += by_kind
    yield from text(n)
    drop(0)


def kind_of(name: str, text: str, link: bool) -> tuple[str, int]:
    """The kind of an item and how often it counts: an element once, where it opens unlike its sibling."""
    if name:
        return ("tag:" + (name if name in BLOCKS or name in VOID or name in INLINE else "inline")), text == ""
    return ("word:link" if link else "word:plain"), len(text.split())


def label_counts(page: str) -> Counter:
    """Kinds inside and outside the content of a labelled page; nothing for a page that does not mark exactly one."""
    counts: Counter = Counter()
    parts = items(page, {}, counts)
    if sum(1 for name, text, *_ in parts if name in ("article", "main") and text != "/") != 1:
        return Counter()
    for name, text, link, outside, inside in parts:
        if not outside:
            kind, times = kind_of(name, text, link)
            counts[kind, inside] += times
    return counts


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of content, smoothed; words stay positive, tags negative; names by themselves."""
    total = [max(1, sum(v for (k, i), v in counts.items() if i == side and not k.startswith("name:"))) for side in (False, True)]
    weights = {}
    for kind in {k for k, _ in counts} | {"word:plain", "word:link", "tag:inline"}:
        inside, outside = counts.get((kind, True), 0) + 1, counts.get((kind, False), 0) + 1
        if kind.startswith("name:"):
            weights[kind] = math.log(inside / outside)
            continue
        low, high = WORD_RANGE if kind.startswith("word:") else TAG_RANGE
        weights[kind] = min(high, max(low, math.log(inside / (total[1] + 1)) - math.log(outside / (total[0] + 1))))
    return weights


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First and behind-last index of the contiguous stretch of the highest sum; (0, 0) where none is positive."""
    best, here, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += s
        if here > best:
            best, found = here, (start, i + 1)
    return found


def main_text(page: str | None, weights: dict[str, float]) -> str:
    parts = [part for part in items(page or "", weights) if not part[3] or part[0]]
    scores = []
    for name, text, link, outside, _ in parts:
        kind, times = kind_of(name, text, link)
        scores.append(0.0 if outside else weights.get(kind, TAG_RANGE[1]) * times)
    first, last = best_stretch(scores)
    blocks, now = [], []

    def close() -> None:
        block = " ".join(html.unescape("".join(now)).split())
        if block:
            blocks.append(block)
        now.clear()

    for name, text, *_ in parts[first:last]:
        if name:
            if name in BLOCKS:
                close()
            elif name in ("br", "td", "th", "wbr"):
                now.append(" " if name != "wbr" else "")
        else:
            now.append(text)
    close()
    return "\n\n".join(blocks)


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Counts over all labelled pages. Element names are a fixed set; of names that speak against an element the ``MOST_NAMES`` most frequent come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for page in batch.column(0).to_pylist():
                counts.update(label_counts(page or ""))
            yield pa.RecordBatch.from_pydict(
                {"kind": [k for k, _ in counts], "inside": [v if i else 0 for (_, i), v in counts.items()], "beside": [0 if i else v for (_, i), v in counts.items()]},
                schema=pa.schema([("kind", pa.string()), ("inside", pa.int64()), ("beside", pa.int64())]),
            )

    counted = pages.select(F.col(f"`{html_col}`")).mapInArrow(count, "kind string, inside long, beside long")
    sums = counted.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("beside").alias("beside"))
    is_name = F.col("kind").startswith("name:")
    speaking = sums.filter(~is_name | (F.log((F.col("inside") + 1) / (F.col("beside") + 1)) <= OTHER))
    kinds = len(BLOCKS | VOID | INLINE) + 3
    rows = speaking.orderBy(is_name, F.desc("beside"), "kind").limit(kinds + MOST_NAMES).collect()
    return weights_from({(r["kind"], side): r["inside" if side else "beside"] for r in rows for side in (False, True)})


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``id_cols`` and text, n_chars for every row of ``pages``."""
    weights = learn_weights(pages, html_col)

    def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"],
            )

    rows = pages.select(*[F.col(f"`{c}`") for c in id_cols], F.col(f"`{html_col}`").alias("_page"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(read_pages, f"{kinds}, text string, n_chars long")
