"""The main text of a web page: the contiguous region where words outweigh tags.

A page is read as a sequence of tags and runs of words. A word scores one, a tag costs what pages with a marked article
have taught, and one linear scan finds the region of the greatest score. Parts of the page whose element says that
they are a menu, an advert, a form or the like have no words that score, and are left out where the region encloses them.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Labelled pages that the costs are learnt from: at most so many, none longer than so many characters.
TRAIN_PAGES, TRAIN_CHARS = 200, 100_000
ROUNDS, MARGIN = 8, 0.2
#: Characters that count as one word in text without blanks.
WORD_CHARS = 10
#: Characters of pages handled before a batch is handed on.
SLICE_CHARS = 1 << 22

# Elements of HTML by what they are.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr"}
LEFT_OUT = {"head", "nav", "aside", "footer", "header", "form", "button", "select", "datalist", "dialog", "menu", "template", "svg",
            "math", "object", "canvas", "audio", "video", "map", "fieldset"} | RAW
DARK = RAW | {"head", "template", "svg", "select", "object"}
ENDS_ALIKE = {"li", "dt", "dd", "td", "th", "tr", "option", "p"}
ARTICLE = {"article", "main"}
# Words of class, id and role that name parts of a page. The first kind holds whatever stands beside it.
NOT_TEXT = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
            "comment", "comments", "commentlist", "respond", "disqus", "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe",
            "signup", "login", "share", "sharing", "social", "popup", "modal", "breadcrumb", "breadcrumbs", "pagination", "pager"}
AROUND_TEXT = {"nav", "navbar", "navigation", "menu", "sidebar", "side", "aside", "widget", "widgets", "footer", "foot", "header",
               "masthead", "banner", "notice", "notices", "alert", "toolbar", "topbar", "search", "related", "recommended", "skip",
               "complementary", "contentinfo", "dialog", "copyright", "disclaimer"}
OF_TEXT = {"article", "body", "content", "entry", "main", "post", "story", "text", "with", "has", "page", "wrapper", "container", "layout"}

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/>])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_BODY = re.compile(r"""itemprop\s*=\s*["']?articleBody""", re.I)
_HAS_ARTICLE = re.compile(r"<article[\s>]|itemprop\s*=\s*[\"']?articleBody", re.I)
_STEP = re.compile("[>\"']")


@dataclass(frozen=True)
class Tag:
    name: str
    closes: bool
    #: Its element is no text; its marks say so; it is hidden.
    other: bool
    named: bool
    hidden: bool
    article: bool


def _tag(raw: str) -> Tag:
    found = _NAME.match(raw)
    name = found[2].lower()
    if found[1]:
        return Tag(name, True, False, False, False, False)
    marks = [w for m in _MARKS.finditer(raw) for w in (m[2] or m[3] or m[4] or "").lower().split()]
    parts = [set(re.split("[-_:]+", w)) for w in marks]
    named = any(p & NOT_TEXT or (p & AROUND_TEXT and not p & OF_TEXT) for p in parts)
    if name in ("html", "body", "main"):
        named = False
    elif name == "article":
        named = any(p & {"comment", "comments", "ad", "advert"} for p in parts)
    body = name in ARTICLE or bool(_BODY.search(raw))
    return Tag(name, False, name in LEFT_OUT, named, bool(_HIDDEN.search(raw)), body and not named)


@dataclass
class Page:
    """Steps of a page in order: (kind of tag, None) or (None, run of words as written)."""
    kinds: list[str | None] = field(default_factory=list)
    runs: list[str | None] = field(default_factory=list)
    breaks: list[bool] = field(default_factory=list)
    kept: list[bool] = field(default_factory=list)
    article: tuple[int, int] | None = None
    articles: int = 0


class Reader:
    """Reads pages into steps in time linear in their length; tags seen before are not parsed again."""

    def __init__(self) -> None:
        self.tags: dict[str, Tag] = {}

    def tag(self, raw: str) -> Tag:
        if raw not in self.tags:
            if len(self.tags) >= 10_000:
                self.tags.clear()
            if len(raw) > 1000:
                return _tag(raw)
            self.tags[raw] = _tag(raw)
        return self.tags[raw]

    def read(self, text: str, marked: bool = True, bare: bool = False) -> Page:
        """Steps of ``text``. Without ``marked`` articles are plain elements; ``bare`` also forgets what other parts are."""
        page = Page()
        ranked = "article" if _HAS_ARTICLE.search(text) else "main"
        stack: list[tuple[str, bool, bool, int]] = []
        opened: Counter[str] = Counter()
        dark = inside = 0
        gone: set[str] = set()

        def step(kind: str | None, run: str | None, splits: bool) -> None:
            page.kinds.append(kind), page.runs.append(run), page.breaks.append(splits), page.kept.append(not dark)

        def pop() -> tuple[str, bool, bool, int]:
            nonlocal dark, inside
            top = stack.pop()
            opened[top[0]] -= 1
            dark -= top[1]
            inside -= top[2]
            if top[2] and page.articles == 1 and not inside:
                page.article = top[3], len(page.kinds)
            return top

        def find(what: str, start: int) -> int:
            if what in gone:
                return -1
            at = text.find(what, start)
            if at < 0:
                gone.add(what)
            return at

        def tag_end(start: int) -> int:
            at = start
            while found := _STEP.search(text, at):
                if found[0] == ">":
                    return found.end()
                quoted = text[found.start() - 1] == "="
                shut = find(found[0], found.end()) if quoted else -1
                at = shut + 1 if shut >= 0 else found.end()
            return -1

        at, begun = 0, 0
        while True:
            start = find("<", at)
            follows = text[start + 1:start + 2] if start >= 0 else ""
            if start >= 0 and not (follows.isalpha() and follows.isascii() or follows in ("!", "?", "/") and follows):
                at = start + 1
                continue
            if start < 0:
                if begun < len(text):
                    step(None, text[begun:], False)
                break
            if start > begun:
                step(None, text[begun:start], False)
            if text.startswith("<!--", start):
                shut = find("-->", start + 4)
                at = begun = shut + 3 if shut >= 0 else len(text)
                continue
            name = _NAME.match(text, start)
            end = tag_end(start + 1) if name else find(">", start) + 1
            if end <= 0:
                end = len(text)
            at = begun = end
            if not name:
                continue
            seen = self.tag(text[start:end])
            word = seen.name
            splits = word not in INLINE
            kind = "div" if not marked and word in ARTICLE or bare and word in LEFT_OUT and word not in DARK else word
            if seen.closes:
                if opened[word] > 0:
                    while pop()[0] != word:
                        pass
                step(_kind(kind, True, inside), None, splits)
                continue
            if bare:
                left_out = word in DARK
            else:
                left_out = seen.named or seen.hidden or seen.other and not (word == "header" and inside)
            if splits and stack and stack[-1][0] == "p":
                pop()
            if word in ENDS_ALIKE and stack and stack[-1][0] == word:
                pop()
            article = seen.article and marked and not dark and not left_out and (word != "main" or ranked == "main")
            step(_kind(kind, False, inside), None, splits)
            if word in VOID or word in ("path", "use"):
                continue
            if splits or left_out:
                if article and not inside:
                    page.articles += 1
                stack.append((word, left_out, article, len(page.kinds)))
                opened[word] += 1
                dark += left_out
                inside += article
            if word in RAW:
                shut = re.compile(f"</{re.escape(word)}(?=[\\s/>])", re.I).search(text, end)
                at = begun = shut.start() if shut else len(text)
        while stack:
            pop()
        return page


def _kind(name: str, closes: bool, inside: int) -> str:
    return ("in " if inside else "out ") + ("/" if closes else "") + name


def words(run: str) -> int:
    return max(len(run.split()), len(run.strip()) // WORD_CHARS)


#: What a tag costs before anything is learnt: outside of a marked article, and within.
FIRST_COST = {"out": 1.0, "in": 0.0}


@dataclass
class Costs:
    """What each kind of tag costs, 0 or more; kinds not met in training have their first cost."""
    of: dict[str, float] = field(default_factory=dict)

    def cost(self, kind: str) -> float:
        return self.of.get(kind, FIRST_COST[kind.split(" ")[0]])

    def scores(self, page: Page) -> list[float]:
        known = {k: -self.cost(k) for k in set(page.kinds) if k}
        return [known[k] if k else words(r) if kept else 0 for k, r, kept in zip(page.kinds, page.runs, page.kept)]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous region of the greatest sum, the first and shortest of equals; empty if none is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def learn(pages: list[str]) -> Costs:
    """Costs for which the best region of labelled pages is their article, whether it is marked in the page or not.

    A page is labelled if it has just one article element. Each is read as it is, with the article unmarked, and with all
    other parts unmarked too. Where another region scores higher than the article, or not lower by a margin per word in
    which they differ, the costs are moved by as much as it takes (passive-aggressive steps).
    """
    reader, examples = Reader(), []
    for text in pages:
        first = reader.read(text)
        if first.article is None or first.articles != 1:
            continue
        variants = first, reader.read(text, marked=False), reader.read(text, marked=False, bare=True)
        for page in variants:
            a, b = first.article
            margins = [(-MARGIN if a <= i < b else MARGIN) * words(r) if k is None and kept else 0.0
                       for i, (k, r, kept) in enumerate(zip(page.kinds, page.runs, page.kept))]
            examples.append((page, first.article, margins))
    costs = Costs()
    for _ in range(ROUNDS):
        moved = False
        for page, (a, b), margins in examples:
            scores = [s + m for s, m in zip(costs.scores(page), margins)]
            x, y = best_region(scores)
            short = sum(scores[x:y]) - sum(scores[a:b])
            apart = Counter(k for k in page.kinds[x:y] if k)
            apart.subtract(k for k in page.kinds[a:b] if k)
            size = sum(n * n for n in apart.values())
            if short > 1e-9 and size:
                moved = True
                for kind, n in apart.items():
                    costs.of[kind] = max(0.0, costs.cost(kind) + n * short / size)
        if not moved:
            break
    return costs


def region_text(page: Page, bounds: tuple[int, int]) -> str:
    """Blocks of a region without the parts that are left out, one per line."""
    blocks, block = [], []
    for i in range(*bounds):
        if page.kinds[i] is not None:
            if page.breaks[i]:
                blocks.append("".join(block))
                block = []
            elif page.kinds[i].endswith(" br"):
                block.append(" ")
        elif page.kept[i]:
            block.append(page.runs[i])
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(references.unescape(x).split()) for x in blocks) if b)


def main_text(text: str | None, costs: Costs, reader: Reader | None = None) -> str:
    page = (reader or Reader()).read(text or "")
    return region_text(page, best_region(costs.scores(page)))


def labelled_pages(pages: DataFrame, html_col: str = "html", most: int = TRAIN_PAGES) -> list[str]:
    """At most ``most`` different pages of at most ``TRAIN_CHARS`` characters that have an article element, drawn by hash."""
    text = pages.select(F.col(html_col).alias("html")).filter(
        (F.length("html") <= TRAIN_CHARS) & (F.contains("html", F.lit("<article")) | F.contains("html", F.lit("<main"))))
    drawn = text.withColumn("h", F.xxhash64("html", F.lit(12))).select("h").distinct().orderBy("h").limit(most)
    rows = (text.withColumn("h", F.xxhash64("html", F.lit(12))).join(F.broadcast(drawn), "h", "left_semi")
            .groupBy("h").agg(F.min("html").alias("html")).orderBy("h"))
    return [r["html"] for r in rows.collect()]


def extract(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", html_col: str = "html",
            carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, the columns named in ``carry``, text, n_chars) for every row of ``pages``.

    The costs are learnt from the marked articles of ``labelled``, by default ``pages`` themselves; without any, every tag costs the
    same. Null and empty pages, and pages with no words outside menus and the like, have an empty text. Null ids and repeated
    rows are rows of their own; an empty table gives no rows; other columns are not read.
    """
    names = [f"_{i}" for i in range(len(carry))]
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), *(F.col(c).alias(n) for c, n in zip(carry, names)))
    costs = learn(labelled_pages(pages if labelled is None else labelled, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            start, held, texts = 0, 0, []
            for i, cell in enumerate(batch.column(1)):
                text = cell.as_py() or ""
                texts.append(main_text(text, costs, reader))
                held += len(text)
                if held >= SLICE_CHARS or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), *part.columns[2:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                        ["id", *names, "text", "n_chars"])
                    start, held, texts = i + 1, 0, []
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("id", *names))
    return rows.mapInArrow(run, f"{schema}, text string, n_chars bigint").toDF("id", *carry, "text", "n_chars")
