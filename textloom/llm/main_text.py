"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' shape.

A page is cut into blocks at block-level tags and line breaks. A block knows its number of words, its link density,
both of its neighbours, and the elements around it. The tree is trained here, on the small labelled table below;
its splits are chosen by Gini impurity, so the table alone defines the behaviour.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

# HTML elements by their part in a page.
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_UNSEEN = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select datalist".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FRAME = frozenset("nav header footer aside form menu dialog button fieldset".split())
_MAIN = frozenset("article main".split())
# Words in class, id and role that name what is not the article, and what is.
_FRAME_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus footer form gdpr header masthead menu menubar meta modal nav navbar navigation newsletter notice notices notification pagination popup privacy promo promoted related replies reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split())
# Those that also stand on what holds an article: there the text decides. And beginnings of joined words.
_WEAK_WORDS = frozenset("discussion header meta related reply replies search share sharing social sponsor tags widget".split())
_FRAME_BEGINNINGS = ("adbanner", "adblock", "adbox", "adslot", "adspace", "adunit", "advert", "comment", "cookie", "navbar", "navlist", "newsletter", "sidebar", "sponsor")
_MAIN_WORDS = frozenset("article articlebody content entry main maincontent post story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)>", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\t-\r\x1c-\x20\x85\xa0  -     　]+")

FEATURES = ("words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density", "framed", "article", "heading", "listed")  # framed: 0 no, 1 by a weak word alone, 2 yes
#: A block of prose has so many words at least and less of them in links.
PROSE_WORDS, PROSE_LINKS = 10, 0.3
#: A subtree in an article that a weak word frames is no frame if it holds so much prose, and mostly prose.
WEAK_PROSE, WEAK_SHARE = 15, 0.6
# The labelled table. Shapes of blocks (words, link density, framed, in an article, heading, list item) ...
_FRAMED = ((1, 1.0, 2, 0, 0, 1), (3, 0.0, 2, 0, 1, 0), (9, 0.0, 2, 0, 0, 0), (14, 0.3, 2, 0, 0, 0), (60, 0.0, 2, 0, 0, 0), (30, 0.3, 2, 1, 0, 0), (5, 0.0, 2, 1, 1, 0), (45, 0.0, 2, 1, 0, 0), (2, 1.0, 2, 1, 0, 1))
_WEAKLY = ((1, 1.0, 1, 0, 0, 1), (3, 0.0, 1, 0, 1, 0), (9, 0.0, 1, 0, 0, 0), (14, 0.3, 1, 0, 0, 0), (9, 0.5, 1, 1, 0, 0), (5, 0.0, 1, 1, 1, 0), (2, 1.0, 1, 1, 0, 1))
_WEAKLY_LONG = ((60, 0.0, 1, 0, 0, 0), (25, 0.0, 1, 0, 0, 0), (90, 0.1, 1, 0, 0, 0), (30, 0.0, 1, 1, 0, 0), (90, 0.1, 1, 1, 0, 0))
_ARTICLE = ((1, 0.0, 0, 1, 0, 0), (3, 0.0, 0, 1, 1, 0), (8, 0.0, 0, 1, 1, 0), (4, 0.0, 0, 1, 0, 1), (12, 0.4, 0, 1, 0, 1), (5, 1.0, 0, 1, 0, 0), (45, 0.1, 0, 1, 0, 0), (90, 0.0, 0, 1, 0, 0))
_LONG = ((90, 0.0, 0, 0, 0, 0), (35, 0.2, 0, 0, 0, 0), (15, 0.05, 0, 0, 0, 0), (20, 0.1, 0, 0, 0, 1))
_LINKS = ((1, 1.0, 0, 0, 0, 1), (3, 1.0, 0, 0, 0, 0), (8, 0.9, 0, 0, 0, 1), (20, 0.8, 0, 0, 0, 0), (40, 0.9, 0, 0, 0, 0))
_SHORT = ((2, 0.0, 0, 0, 0, 0), (6, 0.0, 0, 0, 1, 0), (4, 0.1, 0, 0, 0, 1))
# ... between neighbours (words and link density before, words and link density after) that are text, links or nothing.
_TEXT = ((0, 0.0, 0, 0.0), (60, 0.0, 45, 0.0), (40, 0.0, 3, 1.0), (3, 1.0, 50, 0.0), (8, 0.0, 8, 0.0))
_MENU = ((1, 1.0, 1, 1.0), (2, 1.0, 4, 0.9))


def _label(shapes, neighbours, main: int):
    return [((words, links, *around, *rest), main) for words, links, *rest in shapes for around in neighbours]


#: Rows of FEATURES and whether the block is main text: short texts between links are not, elsewhere they are.
LABELLED = [*_label(_FRAMED, _TEXT + _MENU, 0), *_label(_WEAKLY, _TEXT + _MENU, 0), *_label(_WEAKLY_LONG, _TEXT + _MENU, 1), *_label(_ARTICLE, _TEXT + _MENU, 1), *_label(_LONG, _TEXT + _MENU, 1), *_label(_LINKS, _TEXT + _MENU, 0), *_label(_SHORT, _TEXT, 1), *_label(_SHORT, _MENU, 0)]


class Tree:
    """A binary decision tree, grown until leaves are pure; ties go to the earlier feature and the lower threshold."""

    def __init__(self, rows=LABELLED):
        self.root = self._grow(np.array([r for r, _ in rows], float), np.array([y for _, y in rows]))

    def _grow(self, x: np.ndarray, y: np.ndarray):
        if len(set(y.tolist())) < 2:
            return int(y[0])
        best = None
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for threshold in (values[1:] + values[:-1]) / 2:
                left = x[:, feature] <= threshold
                impurity = sum(part.sum() * (p := y[part].mean()) * (1 - p) for part in (left, ~left))
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, feature, float(threshold), left
        if best is None:
            return int(y.mean() >= 0.5)
        _, feature, threshold, left = best
        return feature, threshold, self._grow(x[left], y[left]), self._grow(x[~left], y[~left])

    def __call__(self, row) -> int:
        node = self.root
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node


@functools.lru_cache(maxsize=1)
def tree() -> Tree:
    return Tree()


def _marks(name: str, attrs: str) -> tuple[bool, int, bool]:
    """(unseen, frame: 0 to 2, main) that an element sets for what it holds."""
    unseen, frame, main = name in _UNSEEN, 2 * (name in _FRAME), name in _MAIN
    if attrs and not attrs.isspace():
        words: set[str] = set()
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                unseen = True
            elif key in ("class", "id", "role"):
                words.update(_NAME.findall(value))
        if name not in ("body", "html"):
            framing = {w for w in words if w in _FRAME_WORDS or w == "nl" or w.startswith(_FRAME_BEGINNINGS)}
            if words & _MAIN_WORDS and framing <= _WEAK_WORDS:
                main = True
            elif framing and name not in _MAIN:
                frame = max(frame, 1 if framing <= _WEAK_WORDS else 2)
    return unseen, frame, main


class _Frames:
    """Elements that frame what they hold: each knows the one around it, and what prose it holds decides whether it stays a frame.

    A word in a class is a hint, no proof. Where a page has neither a marked article nor prose outside its frames, the first of those with much of it holds the article. A weakly framed
    subtree of an article that is mostly prose belongs to the article. Frames by their element alone always stay.
    """

    def __init__(self):
        self.level, self.by_word, self.around, self.in_article = [0], [False], [0], [False]

    def enter(self, level: int, by_word: bool, around: int, in_article: bool) -> int:
        for values, value in ((self.level, level), (self.by_word, by_word), (self.around, around), (self.in_article, in_article)):
            values.append(value)
        return len(self.level) - 1

    def _effective(self) -> list[int]:
        out = [0]
        for i in range(1, len(self.level)):
            out.append(max(self.level[i], out[self.around[i]]))
        return out

    def settled(self, found: list[tuple]) -> list[tuple[int, bool]]:
        """(level, whether it holds the article after all) of each frame, given the blocks (text, words, link density, frame, article, ...)."""
        holder = 0
        words, prose = [0] * len(self.level), [0] * len(self.level)
        for _, n, links, frame, *_ in found:
            words[frame] += n
            prose[frame] += n if n >= PROSE_WORDS and links < PROSE_LINKS else 0
        own = list(prose)
        for i in reversed(range(1, len(self.level))):  # what a weak frame holds belongs to the one around it too
            if self.level[i] < 2:
                prose[self.around[i]] += prose[i]
                words[self.around[i]] += words[i]
        before = self._effective()
        marked = any(article and before[frame] < 2 for _, _, _, frame, article, *_ in found)
        if not marked and sum(n for n, level in zip(own, before) if level < 2) < PROSE_WORDS:
            held = [i for i in range(1, len(self.level)) if self.level[i] == 2 and self.by_word[i] and before[self.around[i]] < 2 and prose[i] >= PROSE_WORDS]
            if held:
                most = max(prose[i] for i in held)
                holder = next(i for i in held if prose[i] * 4 >= most)
                self.level[holder] = 0
        for i in range(1, len(self.level)):
            if self.level[i] == 1 and self.in_article[i] and prose[i] >= WEAK_PROSE and prose[i] >= WEAK_SHARE * words[i]:
                self.level[i] = 0
        inside = [False]
        for i in range(1, len(self.level)):
            inside.append(i == holder or inside[self.around[i]])
        return list(zip(self._effective(), inside))


def blocks(page: str) -> list[tuple[str, int, float, bool, bool, bool, bool]]:
    """(text, words, link density, framed, in article, heading, list item) of each text block, in page order."""
    out: list = []
    text: list[str] = []
    linked: list[int] = [0]
    stack: list[tuple[str, tuple]] = []  # element, state before it
    opened: Counter[str] = Counter()
    frames = _Frames()
    state = (False, 0, False, False, False, False)  # unseen, innermost frame, article, heading, listed, linked

    def flush() -> None:
        joined = _SPACE.sub(" ", "".join(text)).strip(" ")
        if joined:
            words = joined.count(" ") + 1
            out.append((joined, words, min(1.0, linked[0] / words), *state[1:5]))
        text.clear()
        linked[0] = 0

    def add(raw: str) -> None:
        if raw and not state[0]:
            raw = entities.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if state[5]:
                linked[0] += len(raw.split())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            text.append(m[1] if not state[0] else "")
            continue
        name = m[3] or m[6]
        if not name:
            continue
        name = name.lower()
        if m[2] or m[5]:  # an end tag closes the nearest element of its name
            if name in _BLOCK:
                flush()
            while opened[name]:
                last, state = stack.pop()
                opened[last] -= 1
                if last == name:
                    break
            continue
        attrs = m[4] or m[7] or ""
        if name in _BLOCK:
            flush()
        if name in _VOID or attrs.endswith("/") and name not in _BLOCK and name not in _RAW:
            continue
        unseen, frame, main = _marks(name, attrs)
        if name == "p" or name == "li":  # these end an open one of their kind
            nearest = next((x for x, _ in reversed(stack) if x in _BLOCK), None)
            while nearest == name:
                last, state = stack.pop()
                opened[last] -= 1
                if last == name:
                    break
        stack.append((name, state))
        opened[name] += 1
        inner = frames.enter(frame, name not in _FRAME, state[1], state[2]) if frame else state[1]
        state = (state[0] or unseen, 0 if main and name in _MAIN and not state[2] else inner, state[2] or main, state[3] or name in ("h1", "h2", "h3", "h4", "h5", "h6"), state[4] or name == "li", state[5] or name == "a")
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
    flush()
    level = frames.settled(out)
    return [(text, words, links, level[frame][0], article or level[frame][1], *rest) for text, words, links, frame, article, *rest in out]


def extract(page: str) -> str:
    """The blocks that the tree takes for main text, in page order, joined by line feeds."""
    found = blocks(page)
    decide = tree()
    chosen = []
    for i, (text, words, density, *rest) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        if decide((words, density, *before, *after, *map(int, rest))):
            chosen.append(text)
    return "\n".join(chosen)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row. Null and empty pages give an empty text; nothing is capped, however long a page is.

    Repeated rows are rows like others, an empty table gives an empty one; other columns, whatever their names, are left out.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))

    def scan(batches):
        for batch in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([extract(x) for x in batch.column("html").to_pylist()], pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(scan, "page_id long, url string, text string")


def op5_html_main_text(spark, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
