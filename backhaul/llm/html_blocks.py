"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags, in page order. Each block is
read as the hashed tags and class words on its path, its hashed words, its length and how much of it
is link text. Two LSTMs, one from either end of the page, carry what they read along, so every block
is judged in the light of the whole page; a logistic layer on both decides whether it is main text.

The labeller is trained on a bounded sample of the given pages. Its labels come from structure where
structure is plain (a container that is or is called an article, without menus, comments and the like),
and from rearranged copies of the sample in which the same blocks stand in other containers, since pages
name theirs differently.

Pages are scanned forward only: whatever is left open (tags, quotes, comments, elements), a page takes
time in proportion to its length.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.llm.words import LOWER, NOT_SPACE, buffers, hash_spans, slices, spans

SAMPLE = 240  # pages to learn from
HIDDEN, PATH, WORDS, NUMBERS = 16, 96, 32, 4
LONGEST_PAGE = 1 << 18  # bytes of a page to learn from
STEPS, BATCH, LONGEST = 260, 16, 80  # of training

# A whole tag whose quotes hold no angle brackets; others are followed by hand. No part gives back.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
_STOP = re.compile(r"[<>\"']")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_ZEROS = re.compile(r"&#0{4,}+(?=[0-9])")
_FAR = re.compile(r"&#[0-9]{8,}+;?")
_SPACES = re.compile(r"\s+")
# HTML elements by kind.
_RAW = {"script", "style", "template", "textarea", "iframe", "svg", "title", "annotation", "annotation-xml"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "noscript", "object", "math", "semantics",
    "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msup", "msub", "msubsup", "msqrt", "mroot", "mfenced",
    "mover", "munder", "munderover", "mspace", "mstyle", "mtable", "mtr", "mtd",
}
_EMPTY = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul",
}


# Words of containers that hold main text, and of those that hold something else.
MAIN = ["article", "main", "content", "post", "entry", "story", "body-text"]
OTHER = {
    "menu": ["nav", "menu", "navbar", "breadcrumb", "toolbar"],
    "header": ["header", "masthead", "topbar", "banner"],
    "footer": ["footer", "copyright", "legal"],
    "sidebar": ["aside", "sidebar", "related", "widget", "recommended"],
    "notice": ["cookie", "notice", "consent", "alert", "popup", "newsletter"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo"],
    "form": ["form", "search", "subscribe", "login", "signup"],
    "comments": ["comments", "comment", "discussion", "replies", "respond"],
    "social": ["share", "social", "tags", "meta"],
}
_NOT_MAIN = {w for words in OTHER.values() for w in words} - {"meta", "header", "legal"}
_SURE, _LIKELY = {"article", "main"}, {"content", "post", "entry", "story"}


# --- blocks ---------------------------------------------------------------------------------

# A path is a set of marks, as bits: the slots of its hashed words, and which of the lists have one.
_SURE_BIT, _LIKELY_BIT, _OTHER_BIT = (1 << PATH + i for i in range(3))


def marks(words: Iterable[str]) -> int:
    """Marks of the words of a path."""
    out = 0
    for w in words:
        out |= 1 << zlib.crc32(w.encode()) % PATH
        if w in _SURE:
            out |= _SURE_BIT
        elif w in _LIKELY:
            out |= _LIKELY_BIT
        elif w in _NOT_MAIN:
            out |= _OTHER_BIT
    return out


def _container_marks(tag: str, names: str) -> int:
    return marks((tag, *_WORD.findall(names.lower())))


_known_container = lru_cache(1 << 16)(_container_marks)


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^<>]*+>?", re.I)


def _tag_end(page: str, at: int, spent: set[str]) -> tuple[int, int]:
    """End of the attributes and of the tag that holds place `at`: a tag bracket outside quoted values.

    A tag that is still open where the next one begins ends there. `spent` are the quotes that do not
    occur any more; an open value of these is none.
    """
    while m := _STOP.search(page, at):
        at = m.end()
        if (c := m.group()) == ">":
            return m.start(), at
        if c == "<":
            return m.start(), m.start()
        value = m.start() - 1
        while page[value].isspace():
            value -= 1
        if page[value] == "=" and c not in spent:
            end = page.find(c, at)
            if end < 0:
                spent.add(c)
            else:
                at = end + 1
    return len(page), len(page)


def _plain_text(text: str) -> str:
    if "&" in text:
        # Longer numbers stand for no character, and Python reads them in no time that is bounded.
        text = _FAR.sub("\ufffd", _ZEROS.sub("&#", text))
        text = html.unescape(text)
    return _SPACES.sub(" ", text).strip()


def blocks(page: str) -> list[tuple[int, str, float]]:
    """Path marks, text and share of link text of every block of a page, in page order."""
    out: list[tuple[int, str, float]] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    text: list[str] = []
    spent: set[str] = set()
    path, at, linked, in_link = 0, 0, 0, False
    last = page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _plain_text("".join(text))
            if whole:
                out.append((path, whole, min(linked / len(whole), 1.0)))
        text.clear()
        linked = 0

    def take(start: int, end: int) -> None:
        nonlocal linked
        if end > start:
            text.append(page[start:end])
            if in_link:
                linked += end - start

    def close() -> None:
        nonlocal path
        tag, path = stack.pop()
        opened[tag] -= 1

    look = 0  # where the next tag may begin; what lies between `at` and there is text
    while (begin := page.find("<", look)) >= 0:
        whole = _TAG.match(page, begin) or _NAME.match(page, begin)
        if whole is None:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 2)
                end = len(page) if end < 0 else end + 3
            elif page[begin + 1 : begin + 2] in ("!", "?", "/") and begin + 1 < last:
                end = page.find(">", begin) + 1
            else:
                look = begin + 1
                continue
            take(at, begin)
            at = look = end
            continue
        take(at, begin)
        tag = whole.group(2).lower()
        if whole.re is _TAG:
            named, at = whole.group(3), whole.end()
        else:
            end, at = _tag_end(page, whole.end(), spent)
            named = page[whole.end() : end]
        look = at
        if whole.group(1):
            if tag == "a":
                in_link = False
            if tag in _INLINE or tag in _EMPTY:
                continue
            flush()
            if opened.get(tag):
                while stack[-1][0] != tag:
                    close()
                close()
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = True
        elif tag in _RAW:
            if not named.rstrip().endswith("/"):
                found = _raw_end(tag).search(page, at)
                at = look = found.end() if found else len(page)
        elif tag in _EMPTY:
            if tag == "hr":
                flush()
        elif tag not in _INLINE:
            flush()
            closes = _CLOSES.get(tag, {"p"} if tag in _ENDS_P else ())
            if stack and stack[-1][0] in closes:
                close()
            stack.append((tag, path))
            opened[tag] = opened.get(tag, 0) + 1
            names = " ".join(["".join(g) for g in _NAMED.findall(named)]) if "=" in named else ""
            short = len(tag) + len(names) <= 200
            path |= _known_container(tag, names) if short else _container_marks(tag, names)
    take(at, len(page))
    flush()
    return out


def plain_labels(paths: list[int], guess: bool = False) -> list[bool]:
    """Which blocks of a page are main text by its structure: those in a container that is or is called
    article or main or, on pages without, one with another such name, and in none of the others. With
    `guess`, on pages with neither, all that are in none of the others."""
    good = [not p & _OTHER_BIT for p in paths]
    for bit in (_SURE_BIT, _LIKELY_BIT):
        found = [g and bool(p & bit) for g, p in zip(good, paths)]
        if any(found):
            return found
    return good if guess else [False] * len(paths)


# --- features -------------------------------------------------------------------------------


def features(paths: list[int], texts: list[str], links: np.ndarray) -> np.ndarray:
    """Inputs of the labeller for blocks with the given path marks, texts and link shares."""
    n = len(texts)
    x = np.zeros((n, PATH + WORDS + NUMBERS), np.float32)
    slots = b"".join([(p & (1 << PATH) - 1).to_bytes(PATH // 8, "little") for p in paths])
    x[:, :PATH] = np.unpackbits(np.frombuffer(slots, np.uint8).reshape(n, PATH // 8), axis=1, bitorder="little")
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    begin, end, first = spans(LOWER[data], offsets, NOT_SPACE)
    row = np.repeat(np.arange(n), np.diff(first))
    slot = (hash_spans(LOWER[data], begin, end) % np.uint64(WORDS)).astype(np.int64)
    np.add.at(x, (row, PATH + slot), 1)
    count = np.maximum(np.diff(first), 1)[:, None]
    x[:, PATH : PATH + WORDS] /= count.astype(np.float32)
    x[:, PATH + WORDS : PATH + WORDS + NUMBERS] = np.column_stack(
        [np.ones(n), np.log1p(count[:, 0]) / 4, np.log1p(np.diff(offsets)) / 6, links]
    )
    return x


# --- network --------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Labeller:
    """Weights by name: for each direction inputs `x`, state `h` and bias `b`; output `o`."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 5) -> Labeller:
        draw = np.random.default_rng(seed)
        size = PATH + WORDS + NUMBERS
        weights = {"o": draw.normal(0, 0.1, 2 * HIDDEN + 1)}
        for way in ("forward", "backward"):
            weights[f"{way}.x"] = draw.normal(0, 0.15, (size, 4 * HIDDEN))
            weights[f"{way}.h"] = draw.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            weights[f"{way}.b"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        return cls(weights)

    def _items(self, way: str, first: np.ndarray):
        """Blocks at each step of a direction, pages longest first so that those left are a prefix."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        end, left = begin + size - 1, int((size > 0).sum())
        for t in range(int(size[0]) if len(size) else 0):
            while left and size[left - 1] <= t:
                left -= 1
            yield (begin[:left] + t) if way == "forward" else (end[:left] - t)

    def states(self, way: str, x: np.ndarray, first: np.ndarray, keep: list | None = None) -> np.ndarray:
        w = self.weights
        inputs = x @ w[f"{way}.x"] + w[f"{way}.b"]
        out = np.zeros((len(x), HIDDEN))
        h = c = None
        for items in self._items(way, first):
            n = len(items)
            if h is None:
                h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            h, c = h[:n], c[:n]
            gates = inputs[items] + h @ w[f"{way}.h"]
            f, i, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            before, last = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[items] = h
            if keep is not None:
                keep.append((items, f, i, o, g, before, squashed, last))
        return out

    def logits(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        o = self.weights["o"]
        both = [self.states(way, x, first) for way in ("forward", "backward")]
        return both[0] @ o[:HIDDEN] + both[1] @ o[HIDDEN:-1] + o[-1]

    def gradient(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradient by back-propagation through both chains."""
        w, o = self.weights, self.weights["o"]
        kept = {way: [] for way in ("forward", "backward")}
        state = {way: self.states(way, x, first, kept[way]) for way in kept}
        z = state["forward"] @ o[:HIDDEN] + state["backward"] @ o[HIDDEN:-1] + o[-1]
        p = _sigmoid(z)
        loss = -np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-12))
        dz = (p - labels) / len(labels)
        out = {"o": np.concatenate([state["forward"].T @ dz, state["backward"].T @ dz, [dz.sum()]])}
        for way, part in (("forward", o[:HIDDEN]), ("backward", o[HIDDEN:-1])):
            outer = dz[:, None] * part
            gates = np.zeros((len(x), 4 * HIDDEN))
            state_weights = np.zeros_like(w[f"{way}.h"])
            dh = dc = np.zeros((0, HIDDEN))
            for items, f, i, og, g, before, squashed, last in reversed(kept[way]):
                grow = len(items) - len(dh)
                dh = np.concatenate([dh, np.zeros((grow, HIDDEN))]) + outer[items]
                dc = np.concatenate([dc, np.zeros((grow, HIDDEN))]) + dh * og * (1 - squashed**2)
                d = np.concatenate(
                    [dc * before * f * (1 - f), dc * g * i * (1 - i), dh * squashed * og * (1 - og), dc * i * (1 - g**2)], 1
                )
                gates[items] = d
                state_weights += last.T @ d
                dh, dc = d @ w[f"{way}.h"].T, dc * f
            out[f"{way}.x"], out[f"{way}.h"], out[f"{way}.b"] = x.T @ gates, state_weights, gates.sum(0)
        return loss, out


# --- training -------------------------------------------------------------------------------

_ELEMENTS = {"article", "main", "nav", "header", "footer", "aside", "form"}

def _container(name: str, draw: np.random.Generator) -> tuple[str, ...]:
    if name in _ELEMENTS and draw.random() < 0.6:
        return (name,)
    return (str(draw.choice(["div", "section"])), *name.split("-"))


def rearranged(page: list[tuple[int, str, float]], spare: list[str], draw: np.random.Generator):
    """A copy of a page's main blocks in other containers, among other text: path marks, texts, link
    shares and labels."""
    body = ("html", "body")
    inner = _container(str(draw.choice(MAIN)), draw)
    leaves = ["p", "p", "p", "h2", "li", "blockquote", "pre"]
    main = []
    good = plain_labels([p for p, _, _ in page])
    for k, (_, text, link) in enumerate(b for b, g in zip(page, good) if g):
        leaf = "h1" if k == 0 and draw.random() < 0.7 else str(draw.choice(leaves)) if draw.random() < 0.3 else "p"
        main.append((marks((*body, *inner, leaf)), text, link, 1))
    before, after, inside = [], [], []
    for kind, names in OTHER.items():
        if draw.random() < 0.45:
            continue
        name = str(draw.choice(names))
        own = _container(name, draw)
        group = []
        for _ in range(int(draw.integers(1, 6))):
            text = spare[int(draw.integers(0, len(spare)))]
            if draw.random() < 0.6:
                text = " ".join(text.split()[: int(draw.integers(1, 12))]) or "x"
            leaf = str(draw.choice(["p", "li", "div", "span"]))
            link = float(draw.random() < (0.9 if kind in ("menu", "social") else 0.15))
            group.append((own, leaf, text, link))
        spot = draw.random()
        where = inside if spot < 0.25 else before if kind in ("menu", "header", "notice") or spot < 0.45 else after
        around = (*body, *inner) if where is inside else body
        where.append([(marks((*around, *own, leaf)), text, link, 0) for own, leaf, text, link in group])
    for group in inside:
        at = int(draw.integers(0, len(main) + 1))
        main[at:at] = group
    rows = [r for group in before for r in group] + main + [r for group in after for r in group]
    return rows


def train(pages: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Labeller | None:
    """Fit the labeller on at most `sample` pages of at most LONGEST_PAGE bytes, those with the lowest
    hash of page_id and html; repeated rows count once. None if none of them shows which blocks are
    main text, as in an empty table. The sample's pages come to the driver."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    own = own.where(F.octet_length("html").between(1, LONGEST_PAGE)).withColumn("key", F.xxhash64("page_id", "html"))
    chosen = own.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = own.join(F.broadcast(chosen), "key").dropDuplicates(["key"])
    parsed = [blocks(r.html) for r in sorted(rows.collect(), key=lambda r: r.key)]
    parsed = [page for page in parsed if any(plain_labels([b[0] for b in page]))]
    if not parsed:
        return None
    spare = [t for page in parsed for _, t, _ in page]
    draw = np.random.default_rng(11)
    net = Labeller.fresh()
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    for step in range(1, steps + 1):
        pick = [parsed[i] for i in draw.integers(0, len(parsed), BATCH)]
        batch = []
        for k, page in enumerate(pick):
            labels = plain_labels([p for p, _, _ in page])
            own = [(p, t, link, int(good)) for (p, t, link), good in zip(page, labels)]
            rows = own if k % 2 else rearranged(page, spare, draw)
            if len(rows) > LONGEST:  # a stretch of a long page, as a page
                at = int(draw.integers(0, len(rows) - LONGEST + 1))
                rows = rows[at : at + LONGEST]
            batch.append(rows)
        every = [r for rows in batch for r in rows]
        first = np.concatenate([[0], np.cumsum([len(rows) for rows in batch])])
        x = features([r[0] for r in every], [r[1] for r in every], np.array([r[2] for r in every]))
        _, slope = net.gradient(x.astype(float), first, np.array([r[3] for r in every], float))
        size = np.sqrt(sum((g**2).sum() for g in slope.values()))
        for k, g in slope.items():
            g = g / max(1.0, size)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g**2
            rate = 0.02 * (1 - 0.9 * step / steps)
            net.weights[k] = net.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


# --- extraction -----------------------------------------------------------------------------

def extract(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """One row per page: page_id, url, text (its main blocks in page order, one per line) and n_chars
    (code points).

    Character references are decoded, white space inside a block becomes one space. A null or blank
    page, or one without main blocks, has an empty text. Without a labeller the structure of each page
    decides. Repeated rows each get a row, an empty table gives none; pages of any length are read
    whole; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for whole in batches:
            for batch in slices(whole, "html", 1 << 20):
                found = [blocks(page) if page else [] for page in batch.column(2).to_pylist()]
                every = [b for page in found for b in page]
                first = np.concatenate([[0], np.cumsum([len(page) for page in found])])
                if net is None or not every:
                    good = [g for page in found for g in plain_labels([b[0] for b in page], guess=True)]
                else:
                    x = features([b[0] for b in every], [b[1] for b in every], np.array([b[2] for b in every]))
                    good = (net.logits(x, first) > 0).tolist()
                texts = [
                    "\n".join([every[k][1] for k in range(a, b) if good[k]])
                    for a, b in zip(first[:-1].tolist(), first[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
