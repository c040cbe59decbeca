"""HTML extraction: a recurrent labeller reads a page's leaf blocks and keeps those of the article.

A page is cut into leaf blocks, the texts between block-level tags. Each block is a vector of its tag path
(tags and class, id and role words of its ancestors, hashed), its hashed words, and a few shapes (length,
links, punctuation). A bidirectional LSTM in numpy reads the whole sequence of blocks, so that every
label depends on the document around it.

The labeller is trained here on about ``SAMPLE_PAGES`` pages chosen by hash, whose blocks are labelled by the
meaning of their containers (article, main, nav, footer, aside, form ...). To learn more containers than
the sample shows, blocks are also moved into other containers of the same meaning. Training is
deterministic.

Defined cases: a null or empty page, or one without article blocks, gives the empty text and 0 characters;
unclosed tags end where their container ends; raw elements and comments that never close run to the end of the
page; a ``<`` with no ``>`` behind it is text. Parsing takes time and memory in proportion to the page, whatever it
holds, and blocks become vectors ``CHUNK`` at a time. Repeated rows get equal results. Columns named like an output are replaced.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episode_mart.llm.common import chosen, with_columns

SAMPLE_PAGES = 200
PATHS, WORDS, SHAPES = 128, 64, 6
WIDTH = PATHS + WORDS + SHAPES
HIDDEN = 16
LONGEST_TRAINED = 48
BATCHES, BATCH = 260, 24
SEED = 11
CHUNK = 8192

RAW = ("script", "style", "noscript", "template", "iframe", "svg", "title", "textarea")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
          "var", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
# Containers by meaning, as tags and as class, id or role words.
ARTICLE = ("article", "main", "content", "post", "entry", "story")
OTHER = ("nav", "footer", "aside", "form", "header", "menu", "sidebar", "ad", "ads", "advert", "promo", "sponsored",
         "cookie", "notice", "banner", "consent", "breadcrumb", "comment", "comments", "reply", "respond", "login",
         "newsletter", "subscribe", "related", "share", "social", "button", "select", "dialog", "head", "navigation",
         "complementary", "contentinfo", "search", "popup", "modal", "widget", "masthead", "toolbar", "copyright")

_TAG = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
_DELIMITER = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")


class Path:
    """What is asked of a block's containers, carried from each container to those inside it."""

    __slots__ = ("bits", "last", "article", "heading", "nearest", "beyond_header")

    def __init__(self, names: tuple[str, ...] = (), outer: Path | None = None):
        if outer is None:
            self.bits, self.last, self.article, self.heading = 0, "", False, False
            self.nearest = self.beyond_header = None
        else:
            for slot in self.__slots__:
                setattr(self, slot, getattr(outer, slot))
        for name in names:
            self.bits |= 1 << _bucket(name) % PATHS
            self.last = name
            self.article |= name == "article"
            self.heading |= name == "h1"
            if name in OTHER:
                self.nearest = 0
                if name != "header":
                    self.beyond_header = 0
            elif name in ARTICLE:
                self.nearest = self.beyond_header = 1

    def meaning(self) -> int | None:
        """1 in an article, 0 elsewhere, by the nearest container of a meaning; an article's own header has none."""
        return self.beyond_header if self.article and self.heading else self.nearest


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class _Ends:
    """Where tags end: the first ``>`` outside quotes, or -1.

    Tags come in page order. The first delimiter behind a tag serves the tags before it too, and quotes that led
    to no end are remembered, so that no part of the page is read again and again.
    """

    def __init__(self, page: str):
        self.page, self.lost, self.known = page, set(), (0, -1)

    def _next(self, at: int) -> int:
        found = _DELIMITER.search(self.page, at)
        return found.start() if found else len(self.page)

    def of(self, at: int) -> int:
        if not self.known[0] <= at <= self.known[1]:
            self.known = at, self._next(at)
        place, passed = self.known[1], []
        while place < len(self.page) and place not in self.lost:
            if self.page[place] == ">":
                return place
            passed.append(place)
            closing = self.page.find(self.page[place], place + 1)
            if closing < 0:
                break
            place = self._next(closing + 1)
        self.lost.update(passed)
        return -1


def _tokens(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """(tag, whether it is an end tag, its attributes) and (null, false, text), in page order."""
    at, last, ends = 0, page.rfind(">"), _Ends(page)
    while at < len(page):
        start = page.find("<", at)
        if start < 0 or start > last:
            comment = page.find("<!--", at)
            yield None, False, page[at:] if comment < 0 else page[at:comment]
            return
        if start > at:
            yield None, False, page[at:start]
        if page.startswith("<!--", start):
            closing = page.find("-->", start + 4)
            if closing < 0:
                return
            at = closing + 3
            continue
        m = _TAG.match(page, start)
        if m is None:
            if page[start + 1:start + 2] in ("!", "?", "/"):
                at = page.index(">", start) + 1
            else:
                yield None, False, "<"
                at = start + 1
            continue
        tag, ending = m[1].lower(), page[start + 1] == "/"
        if tag in _RAW_END and not ending:
            closing = _RAW_END[tag].search(page, page.index(">", m.end()) + 1)
            if closing is None:
                return
            at = closing.end()
            continue
        closing = ends.of(m.end())
        if closing < 0:  # a quote that never closes: nothing is known of this tag
            at = page.index(">", start) + 1
            continue
        yield tag, ending, page[m.end():closing]
        at = closing + 1


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order: decoded, with single spaces, trimmed, none empty."""
    stack: list[tuple[str, Path]] = []
    is_open: Counter[str] = Counter()
    out: list[Block] = []
    pieces: list[str] = []
    linked, anchors, top = 0, 0, Path()

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(stack[-1][1] if stack else top, text, linked))
            pieces.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        is_open[tag] -= 1
        return tag

    for tag, ending, body in _tokens(page):
        if tag is None:
            pieces.append(body)
            if anchors:
                linked += len(body)
            continue
        if tag in INLINE:
            if tag == "a":
                anchors = max(0, anchors + (-1 if ending else 1))
            elif tag == "br":
                pieces.append(" ")
            continue
        close()
        anchors = 0
        if ending:
            if is_open[tag]:
                while pop() != tag:
                    pass
            continue
        if stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ())):
            pop()
        if tag not in VOID:
            names = [tag]
            for a in _ATTRIBUTE.finditer(body):
                names += _NAME.findall((a[1] or a[2] or a[3] or "").lower())
            stack.append((tag, Path(tuple(names), stack[-1][1] if stack else top)))
            is_open[tag] += 1
    close()
    return out


def meaning(block: Block) -> int:
    """1 for an article's block, by the nearest container that has a meaning; else by its shape."""
    found = block.path.meaning()
    if found is not None:
        return found
    return int(block.text.count(" ") >= 20 and 2 * block.linked < len(block.text) and block.path.last != "li")


_BUCKETS: dict[str, int] = {}


def _bucket(word: str) -> int:
    found = _BUCKETS.get(word)
    if found is None:
        if len(_BUCKETS) > 200_000:
            _BUCKETS.clear()
        found = _BUCKETS[word] = zlib.crc32(word.encode())
    return found


def vector(block: Block) -> np.ndarray:
    x = np.zeros(WIDTH, np.float32)
    x[:PATHS] = np.unpackbits(np.frombuffer(block.path.bits.to_bytes(PATHS // 8, "little"), np.uint8), bitorder="little")
    words = block.text.lower().split()
    x[PATHS:PATHS + WORDS] = np.bincount([_bucket(w) % WORDS for w in words], minlength=WORDS) / len(words)
    n = len(block.text)
    x[PATHS + WORDS:] = (np.log1p(len(words)) / 6, block.linked / n, sum(map(block.text.count, ".,;")) / len(words),
                         n / len(words) / 20, float(block.text[-1] in ".!?"), float(len(words) < 4))
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output per block. Inputs are (batch, time, WIDTH) with a mask."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.15, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1  # remember at first
            self.p[f"b{d}"] = bias
        self.p["out"] = rng.normal(0, 0.3, (2 * HIDDEN, 1)).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _run(self, x, mask, d: str, kept: list | None, state: list | None = None):
        """Hidden states in direction ``d``. ``state`` holds h and c from the steps before and is carried on."""
        batch, steps, _ = x.shape
        gates = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h, c = state or [np.zeros((batch, HIDDEN), np.float32) for _ in range(2)]
        out = np.zeros((batch, steps, HIDDEN), np.float32)
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            z = gates[:, t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g, on = np.tanh(z[:, 3 * HIDDEN:]), mask[:, t:t + 1]
            new = f * c + i * g
            if kept is not None:
                kept.append((t, i, f, o, g, c, new, h, on))
            c = on * new + (1 - on) * c
            h = on * (o * np.tanh(new)) + (1 - on) * h
            out[:, t] = h
        if state is not None:
            state[:] = h, c
        return out

    def long(self, blocks: list[Block], chunk: int = CHUNK) -> np.ndarray:
        """Probabilities of one page's blocks, of which ``chunk`` are vectors at a time; the states are carried on."""
        logits = np.full(len(blocks), self.p["bias"][0], np.float32)
        starts = range(0, len(blocks), chunk)
        for n, d in enumerate("fb"):
            state = [np.zeros((1, HIDDEN), np.float32) for _ in range(2)]
            for at in starts if d == "f" else reversed(starts):
                x, mask = padded([[vector(b) for b in blocks[at:at + chunk]]])
                h = self._run(x, mask, d, None, state)[0]
                logits[at:at + chunk] += (h @ self.p["out"][n * HIDDEN:(n + 1) * HIDDEN])[:, 0]
        return _sigmoid(logits)

    def probabilities(self, x, mask):
        h = np.concatenate([self._run(x, mask, d, None) for d in "fb"], axis=2)
        return _sigmoid((h @ self.p["out"] + self.p["bias"])[:, :, 0])

    def gradients(self, x, mask, y):
        kept = {"f": [], "b": []}
        h = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        p = _sigmoid((h @ self.p["out"] + self.p["bias"])[:, :, 0])
        error = ((p - y) * mask / mask.sum())[:, :, None]
        grads = {"out": np.einsum("bth,bto->ho", h, error), "bias": error.sum(axis=(0, 1))}
        back = error @ self.p["out"].T
        for n, d in enumerate("fb"):
            dx = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh_next = dc_next = np.zeros((x.shape[0], HIDDEN), np.float32)
            grads[f"h{d}"] = np.zeros_like(self.p[f"h{d}"])
            for t, i, f, o, g, c, new, before, on in reversed(kept[d]):
                dh = back[:, t, n * HIDDEN:(n + 1) * HIDDEN] + dh_next
                squashed = np.tanh(new)
                dc = on * (dh * o * (1 - squashed ** 2) + dc_next)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f),
                                     on * dh * squashed * o * (1 - o), dc * i * (1 - g ** 2)], axis=1)
                dx[:, t] = dz
                grads[f"h{d}"] += before.T @ dz
                dh_next = dz @ self.p[f"h{d}"].T + (1 - on) * dh
                dc_next = dc * f + (1 - on) * dc_next
            grads[f"x{d}"] = np.einsum("btx,btg->xg", x, dx)
            grads[f"b{d}"] = dx.sum(axis=(0, 1))
        return grads

    def fit(self, sequences: list[list[tuple[np.ndarray, int]]], seed: int = SEED) -> None:
        rng, mean, square = random.Random(seed), {}, {}
        for step in range(1, BATCHES + 1):
            chosen = [rng.choice(sequences) for _ in range(BATCH)]
            cut = []
            for s in chosen:
                at = rng.randrange(max(1, len(s) - LONGEST_TRAINED + 1))
                cut.append(s[at:at + LONGEST_TRAINED])
            x, mask = padded([[v for v, _ in s] for s in cut])
            y = np.zeros(mask.shape, np.float32)
            for k, s in enumerate(cut):
                y[k, :len(s)] = [label for _, label in s]
            for k, g in self.gradients(x, mask, y).items():
                mean[k] = 0.9 * mean.get(k, 0) + 0.1 * g
                square[k] = 0.99 * square.get(k, 0) + 0.01 * g * g
                rate = 0.02 if step < BATCHES * 0.7 else 0.005
                self.p[k] = (self.p[k] - rate * (mean[k] / (1 - 0.9 ** step))
                             / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)


def padded(sequences: list[list[np.ndarray]]):
    steps = max(map(len, sequences))
    x, mask = np.zeros((len(sequences), steps, WIDTH), np.float32), np.zeros((len(sequences), steps), np.float32)
    for k, s in enumerate(sequences):
        x[k, :len(s)] = s
        mask[k, :len(s)] = 1
    return x, mask


def _moved(blocks: list[Block], pool: list[Block], rng: random.Random) -> list[Block]:
    """The page with its article in another container of that meaning, and strange blocks in other containers."""
    place = rng.choice((("article",), ("main",), ("main", "article"), ("div", rng.choice(ARTICLE)),
                        ("section", rng.choice(ARTICLE)), ("div", "page", "div", rng.choice(ARTICLE))))
    out = []
    for b in blocks:
        if meaning(b):
            tag = b.path.last if b.path.last in ("h1", "h2", "p", "li", "blockquote", "td") else "p"
            out.append(Block(Path(("html", "body", *place, tag)), b.text, b.linked))
        else:
            out.append(b)
    for _ in range(rng.randrange(6)):
        at, run = rng.randrange(len(out) + 1), rng.randrange(1, 4)
        inside = place if rng.random() < 0.4 else ()
        around = rng.choice(((rng.choice(OTHER),), ("div", rng.choice(OTHER)), ("section", rng.choice(OTHER)),
                             (rng.choice(OTHER), "ul", "li")))
        tail = rng.choice((("p",), (), ("li",), ("h2",), ("label",)))
        picked = [rng.choice(pool) for _ in range(run)]
        out[at:at] = [Block(Path(("html", "body", *inside, *around, *tail)), b.text, b.linked) for b in picked]
    return out


def train(pages: list[str]) -> Labeller:
    """A labeller fitted on the given pages and their rearrangements."""
    labeller, rng = Labeller(), random.Random(SEED)
    parsed = [b for b in (blocks_of(p) for p in pages) if b]
    if parsed:
        pool = [b for blocks in parsed for b in blocks]
        made = parsed + [_moved(rng.choice(parsed), pool, rng) for _ in range(3 * len(parsed))]
        labeller.fit([[(vector(b), meaning(b)) for b in blocks] for blocks in made])
    return labeller


def learn(pages: DataFrame, column: str = "html", sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """Train on about ``sample_pages`` pages, chosen by the hash of their rows."""
    filled = pages.where(F.length(column) > 0)
    share = min(1.0, sample_pages / max(1, filled.count()))
    sample = filled.where(chosen(filled, F.lit(share))).select(F.col(column).alias("html"))
    return train(sorted(r["html"] for r in sample.collect()))


def _extracted(labeller: Labeller, pages: list[str]) -> list[tuple[str, int, int]]:
    """(text, blocks, kept blocks) of each page; pages of similar length share a batch of bounded size."""
    parsed = [blocks_of(p) for p in pages]
    out: list[tuple[str, int, int]] = [("", 0, 0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))
    while order:
        longest = len(parsed[order[-1]])
        group = [order.pop() for _ in range(min(len(order), max(1, CHUNK // longest)))]
        if longest > CHUNK:
            rows = [labeller.long(parsed[group[0]])]
        else:
            rows = labeller.probabilities(*padded([[vector(b) for b in parsed[i]] for i in group]))
        for i, row in zip(group, rows, strict=True):
            kept = [b.text for b, p in zip(parsed[i], row, strict=False) if p > 0.5]
            out[i] = ("\n".join(kept), len(parsed[i]), len(kept))
    return out


def extract(pages: DataFrame, labeller: Labeller, column: str = "html") -> DataFrame:
    """``pages`` with the article's ``text``, its code points ``n_chars``, ``n_blocks`` and ``n_kept``."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def compute():
        def of(values):
            found = _extracted(shared.value, [v or "" for v in values.to_pylist()])
            return [[f[0] for f in found], [len(f[0]) for f in found], [f[1] for f in found], [f[2] for f in found]]
        return of

    return with_columns(pages, column, [("text", "string"), ("n_chars", "long"), ("n_blocks", "long"),
                                        ("n_kept", "long")], compute)
