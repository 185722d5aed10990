"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and words.  Each word has the probability that words of its place are content, by a logistic
model whose features are the elements around it, their class, id and role names, the length of its block and the share
of links in it.  The weights are learned from pages that mark their content with an ``article`` or ``main`` element, which
are never features themselves.  Each piece of content is also counted as it would stand in a list, a table, a division and so
on, and as a link, so that these shapes tell nothing and only what boilerplate alone has counts against a place.  Names
and elements that are boilerplate on most sites begin with weights below zero, which pages can change.

A word scores by its probability and a tag costs the more, the less its place is like content.  A linear scan finds the
contiguous run of the highest score; words in it whose own score is below zero (menus, forms, adverts, comments of
readers within an article) are left out.  What an element that holds most of the page's words is called tells nothing,
unless the name is a sure one.  References are decoded, white space inside a block becomes one space, and blocks are joined by
line feeds.

The model is fitted on at most ``SAMPLE`` labelled pages, chosen by a hash of page_id, each page's content and the rest
of it having the same weight.

Defined results: null or empty html, and a page without a scoring word, has an empty text; broken or unclosed markup is
read as far as it goes; rows that share a page_id are extracted each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000
#: How strongly weights are held to where they begin, the largest weight, and rounds of fitting.
HOLD, LARGEST, ROUNDS = 0.002, 8.0, 300
#: Features of one place that are counted at most, the nearest first; it is scored by all.
NEAREST = 24
#: What a tag costs anywhere, and a word in a place that is not content.
TAG, WORD = 0.05, 0.02
_OUT = "page_id long, url string, text string, n_chars long"
#: Elements that begin and end a block of text.
_BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption blockquote pre figure figcaption hr nav header footer aside form fieldset address details summary".split())
#: Elements without an end tag, elements whose content is not read, and elements that hold no prose on most sites.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style noscript template svg iframe object textarea title".split())
_BARE = frozenset("nav footer aside button select menu dialog audio video canvas".split())
#: Class, id and role names of boilerplate: sure as a whole name, to be weighed as a part of one.
_SURE = r"ad|ads|adv|advert\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|pager|pagination|footer|masthead|cookie\w*|consent|popup|modal|newsletter|subscribe|signup|login|sharing|comments?|commentlist|replies|respond|disqus|toolbar|copyright"
#: Names that articles use as well; they are weighed as a whole name or with a part that makes them plain.
_OPEN = r"banner|sidebar|side|header|notice|alert|share|social|related|recommend\w*|discussion|widget|search|legal|skip"
_SURE_NAMES = re.compile(rf"(?:^|\s)(?:{_SURE})(?:$|\s)", re.I)
_OPEN_NAMES = re.compile(
    rf"(?:^|[\s_-])(?:{_SURE})(?:$|[\s_-])|(?:^|\s)(?:(?:site|page|left|right|main|primary|secondary)[_-])?(?:{_OPEN})(?:[_-](?:buttons?|bar|box|area|links?|icons?|form|widget|list|posts|articles|nav))?(?:$|\s)", re.I
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What marks the content of a page; never a feature.
_MARKS = frozenset(("article", "main"))
#: Where weights begin: of any word, of elements, of names that are sure or open, of blocks by their number of words, and of blocks of links.
_START, _ELEMENTS = 0.5, {"p": 0.5, "a": -0.5, "header": -2.0, "form": -1.5} | dict.fromkeys(_HEADINGS, 0.5) | dict.fromkeys(_BARE, -8.0)
_SURE_START, _OPEN_START, _LINKS_START = -8.0, -1.5, -1.0
_LENGTHS = ((10, "long", 2.0), (4, "middle", 0.2), (0, "short", -0.3))
#: Places in which the same content may stand elsewhere.
_SHAPES = ({"e:p"}, {"e:ul", "e:li"}, {"e:div"}, {"e:table", "e:tr", "e:td"}, {"e:blockquote"}, {"e:section"}, {"e:p", "e:a"}, {"e:h2"})
_SHAPED = frozenset().union(*_SHAPES) | {"e:ol", "e:dl", "e:dd", "e:tbody", "e:span", "e:b", "e:i", "e:em", "e:strong"}
#: What an opening tag closes when it is still open.
_CLOSES = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
_NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
_STOP = re.compile(r"[>\"']")
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_ATTR = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PHRASING_END = _BLOCKS - {"html", "body"}


def _names(attrs: str, element: str) -> set[str]:
    """Class, id and role names of a tag, in lower case; headings are named after what they say, and tell nothing."""
    if not attrs or element in _HEADINGS:
        return set()
    return {x.lower() for name, a, b, c in _ATTR.findall(attrs) if name.lower() in ("class", "id", "role") for x in (a or b or c).split() if len(x) <= 64}


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of texts, starts and ends of elements, each character read once or twice.

    Comments, declarations and the content of raw elements are passed over.  Quotes hide the end of a tag; where a tag
    would run to the end of the page because of them, they mean nothing from there on.
    """
    n, at, last, quotes = len(page), 0, page.rfind(">"), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1
        elif not (m := _NAME.match(page, lt)):
            yield "text", "<", ""
            at = lt + 1
        else:
            k = _tag_end(page, m.end()) if quotes else page.find(">", m.end())
            if k < 0:
                quotes, k = False, page.find(">", m.end())
            name, at = m[1].lower(), k + 1
            yield ("end" if page[lt + 1] == "/" else "start"), name, page[m.end() : k]
            if name in _RAW and page[lt + 1] != "/" and page[k - 1] != "/":
                close = _RAW_ENDS[name].search(page, at)
                at = close.end() if close else n
                yield "end", name, ""


def _tag_end(page: str, at: int) -> int:
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


class Page:
    """The tokens of a page, each at a place; a place knows the place around it and the features that it adds.

    kinds, values, at: ``tag`` or ``text``, the name or the text, and the place, of each token.
    around, adds, inside: the outer place, the features that no place around it has, whether it is marked as content.
    block: for each token, its block's features (texts only).
    """

    def __init__(self, page: str) -> None:
        self.kinds, self.values, self.at = [], [], []
        self.around, self.adds, self.inside = [-1], [()], [False]
        self._read(page)
        self._weigh()

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, tuple[str, ...]]] = []  # name, place, features
        places = defaultdict(list)  # where in the stack each name is open
        held: Counter = Counter()
        for name in ("html", "body"):
            held[f"e:{name}"] = 1  # every word is inside these

        def cut(k: int) -> None:
            """Close what is open from a place of the stack on."""
            while len(stack) > k:
                name, _, features = stack.pop()
                places[name].pop()
                held.subtract(features)

        def close(names: frozenset[str], stop: frozenset[str]) -> None:
            """Close the innermost of some names, unless one of ``stop`` is open inside it."""
            inner = max((places[n][-1] for n in names if places[n]), default=-1)
            if inner >= 0 and inner > max((places[n][-1] for n in stop if places[n]), default=-1):
                cut(inner)

        for kind, name, attrs in markup(page):
            here = stack[-1][1] if stack else 0
            if kind == "text":
                self._put("text", name, here)
            elif kind == "end":
                self._put("tag", name, here)
                if places[name]:
                    cut(places[name][-1])
            else:
                if name in _PHRASING_END:
                    close(_PARAGRAPH, _HOLDS_PARAGRAPHS)
                if name in _CLOSES:
                    close(_CLOSES[name], _HOLDS_ITEMS)
                here = stack[-1][1] if stack else 0
                features = () if name in _MARKS else tuple({f"e:{name}", *(f"n:{n}" for n in _names(attrs, name))})
                fresh = tuple(f for f in features if not held[f])
                inside = self.inside[here] or name in _MARKS
                if fresh or inside != self.inside[here]:
                    self.around.append(here)
                    self.adds.append(fresh)
                    self.inside.append(inside)
                    here = len(self.around) - 1
                self._put("tag", name, here)
                if name not in _VOID and not attrs.endswith("/"):
                    places[name].append(len(stack))
                    stack.append((name, here, features))
                    held.update(features)

    def _put(self, kind: str, value: str, place: int) -> None:
        self.kinds.append(kind)
        self.values.append(value)
        self.at.append(place)

    def _weigh(self) -> None:
        """Words of blocks and places; then features that say nothing are dropped."""
        self.words = [len(v.split()) if k == "text" else 0 for k, v in zip(self.kinds, self.values, strict=True)]
        linked = [False] * len(self.around)
        for k in range(1, len(self.around)):
            linked[k] = linked[self.around[k]] or "e:a" in self.adds[k]
        held = [0] * len(self.around)
        self.block: list[tuple[str, ...]] = [()] * len(self.kinds)
        first, n, links = 0, 0, 0
        for k in range(len(self.kinds) + 1):
            if k == len(self.kinds) or (self.kinds[k] == "tag" and self.values[k] in _BLOCKS):
                length = next(f"l:{name}" for least, name, _ in _LENGTHS if n >= least)
                told = (length, "l:links") if 2 * links >= n > 0 else (length,)
                self.block[first:k] = [told] * (k - first)
                first, n, links = k + 1, 0, 0
            elif self.words[k]:
                n += self.words[k]
                links += self.words[k] * linked[self.at[k]]
                held[self.at[k]] += self.words[k]
        for k in range(len(held) - 1, 0, -1):
            held[self.around[k]] += held[k]
        for k in range(1, len(held)):
            if 2 * held[k] > held[0]:
                self.adds[k] = tuple(f for f in self.adds[k] if begins(f) <= _SURE_START)


_PARAGRAPH = frozenset({"p"})
_HOLDS_PARAGRAPHS = frozenset("table div article section li td".split())
_HOLDS_ITEMS = frozenset("ul ol dl table select".split())


def begins(feature: str) -> float:
    """The weight of a feature before any page is read."""
    kind, _, name = feature.partition(":")
    if kind == "e":
        return _ELEMENTS.get(name, 0.0)
    if kind == "n":
        return _SURE_START if _SURE_NAMES.search(name) else _OPEN_START if _OPEN_NAMES.search(name) else 0.0
    return _LINKS_START if name == "links" else next(w for _, n, w in _LENGTHS if n == name)


def count(text: str) -> Counter | None:
    """(features, inside): shares of a labelled page's content, and of the rest of it, that stand there; None without a mark.

    What is marked but stands in a place that most sites use for something else is no content.
    """
    page = Page(text)
    if not any(page.inside):
        return None
    chains: dict[int, tuple[str, ...]] = {}

    def chain(place: int) -> tuple[str, ...]:
        found: list[str] = []
        k = place
        while k > 0 and len(found) < NEAREST:
            found += page.adds[k]
            k = page.around[k]
        return tuple(found[:NEAREST])

    got: Counter = Counter()
    for k, n in enumerate(page.words):
        if n:
            place = page.at[k]
            if place not in chains:
                chains[place] = chain(place)
            features = frozenset((*chains[place], *page.block[k]))
            inside = page.inside[place] and _START + sum(map(begins, features)) >= 0
            got[" ".join(sorted(features)), inside] += n
    totals = {side: sum(n for (_, i), n in got.items() if i == side) for side in (True, False)}
    return Counter({key: n / totals[key[1]] for key, n in got.items()})


class Weights:
    """The logistic model: the weights of features, fitted to counts of places; without counts they stay where they begin."""

    def __init__(self, counts: Counter, prior: bool = True) -> None:
        self.prior = prior
        rows: dict[frozenset[str], list[float]] = defaultdict(lambda: [0.0, 0.0])
        for (features, inside), n in counts.items():
            own = frozenset(features.split())
            if not inside:
                rows[own][1] += n
                continue
            rows[own][0] += n / 2
            for shape in _SHAPES:  # the same content in other places
                rows[(own - _SHAPED) | shape][0] += n / (2 * len(_SHAPES))
        self.start, self.weight = _START if prior else 0.0, {}
        if rows:
            self._fit(rows)

    def begin(self, feature: str) -> float:
        return begins(feature) if self.prior else 0.0

    def _fit(self, rows: dict[frozenset[str], list[float]]) -> None:
        """Gradient steps with momentum on the mean log likelihood, both sides of it of the same weight."""
        names = sorted(set().union(*rows))
        number = {f: k for k, f in enumerate(names)}
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        which = np.array([number[f] for r in rows for f in sorted(r)], np.int64)
        sides = np.array(list(rows.values()))
        sides = sides / np.maximum(sides.sum(axis=0), 1e-12) / 2
        first = np.array([self.begin(f) for f in names])
        w, start, speed, start_speed = first.copy(), self.start, np.zeros(len(names)), 0.0
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-(start + np.bincount(of, w[which], len(rows)))))
            error = sides[:, 0] * (1 - p) - sides[:, 1] * p
            speed = 0.9 * speed + np.bincount(which, error[of], len(names)) - HOLD * (w - first)
            start_speed = 0.9 * start_speed + error.sum() - HOLD * (start - self.start)
            w, start = np.clip(w + 0.5 * speed, -LARGEST, LARGEST), start + 0.5 * start_speed
        self.start, self.weight = float(start), dict(zip(names, w.tolist(), strict=True))

    def of(self, feature: str) -> float:
        found = self.weight.get(feature)
        if found is None:
            found = self.weight[feature] = self.begin(feature)
        return found


class Uniform(Weights):
    """Every word is content: what the region is without learned weights."""

    def __init__(self) -> None:
        super().__init__(Counter(), prior=False)
        self.start = 6.0

    def of(self, feature: str) -> float:
        return 0.0


def scores(page: Page, weights: Weights) -> list[float]:
    """The score of each token."""
    sums = [weights.start] * len(page.around)
    for k in range(1, len(sums)):
        sums[k] = sums[page.around[k]] + sum(map(weights.of, page.adds[k]))
    out = []
    for k, (kind, place, n) in enumerate(zip(page.kinds, page.at, page.words, strict=True)):
        told = sums[place] if kind == "tag" else sums[place] + sum(map(weights.of, page.block[k]))
        p = 1 / (1 + np.exp(-min(max(told, -30.0), 30.0)))
        if kind == "tag":
            out.append(-TAG if p < 0.5 else -TAG - (1 - p))
        else:
            out.append(n * (2 * p - 1) if p >= 0.5 else -WORD * n)
    return out


def region(score: list[float]) -> tuple[int, int]:
    """First and end token of the best run, by one scan."""
    best, start, total, found = 0.0, 0, 0.0, (0, 0)
    for k, x in enumerate(score):
        total += x
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, found = total, (start, k + 1)
    return found


def extract(text: str, weights: Weights) -> str:
    """The main text of one page."""
    page = Page(text)
    score = scores(page, weights)
    lo, hi = region(score)
    edge = [k == "tag" and v in _BLOCKS for k, v in zip(page.kinds, page.values, strict=True)]
    # A region that begins or ends inside a block takes the block whole.
    while lo > 0 and not edge[lo] and not edge[lo - 1]:
        lo -= 1
    while hi < len(edge) and not edge[hi]:
        hi += 1
    blocks: list[list[str]] = [[]]
    for k in range(lo, hi):
        if page.kinds[k] == "text":
            if score[k] >= 0:
                blocks[-1].append(page.values[k])
        elif edge[k]:
            blocks.append([])
        elif page.values[k] == "br":
            blocks[-1].append(" ")
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from a bounded sample of labelled pages, each of which counts once however often it is there.

    Ids and hashes of pages are ranked; only the pages that they choose are shuffled.
    """
    marked = pages.filter(F.lower("html").rlike(r"<(article|main)\b")).select("page_id", F.xxhash64("html").alias("hash"), "html")
    chosen = marked.select(F.col("page_id").alias("id"), F.col("hash").alias("of")).distinct().orderBy(F.xxhash64("id"), "id", "of").limit(sample)
    rows = marked.join(F.broadcast(chosen), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of")), "left_semi")
    rows = rows.groupBy("page_id", "hash").agg(F.first("html").alias("html")).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(count(page or "") or {})
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.float64())], ["features", "inside", "n"])

    got = rows.mapInArrow(run, "features string, inside boolean, n double").groupBy("features", "inside").agg(F.sum("n").alias("n"))
    return Weights(Counter({(r["features"], r["inside"]): r["n"] for r in got.orderBy("features", "inside").collect()}))


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    weights = train(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = [extract(p, weights) if p else "" for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, _OUT)
