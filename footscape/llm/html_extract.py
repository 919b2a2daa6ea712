"""Main text of web pages: a recurrent labeller of blocks."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the labeller is trained on: at most so many, those whose ids hash lowest.
SAMPLE = 240
PATH_DIM, WORD_DIM, HIDDEN, EPOCHS, RATE, SEED = 96, 24, 16, 6, 0.01, 11
#: Pages labelled together; longer pages go in smaller runs.
BATCH_BLOCKS = 4096
#: Elements by HTML's own rules. Text of RAW and UNSHOWN is no text, but HTML reads only RAW ones to the end of
#: the page if they have no end; FOREIGN ones hold elements of another language, of which OWN_TEXT ones hold HTML again, and
#: those of BREAKS end it; INLINE elements don't end a block; VOID ones have no end; a new element of CLOSES' key ends an
#: open one of its values.
RAW, UNSHOWN = ("script", "style", "iframe", "textarea", "title"), ("template", "noscript", "select")
FOREIGN, OWN_TEXT = ("math", "svg"), frozenset("mi mo mn ms mtext foreignobject desc".split())
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INLINE = frozenset("math svg object a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_P_ENDS = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
CLOSES = {t: ("p",) for t in _P_ENDS} | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("td", "th", "tr", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: Words in an element's name, class, id or role that speak of something beside the article; they make
#: the weak labels and the training pages.
BESIDE = ("nav menu navbar breadcrumb breadcrumbs header masthead banner footer sidebar aside related widget notice cookie consent alert promo ad ads advert advertisement sponsor sponsored "
          "form search newsletter subscribe login comment comments reply replies respond discussion share social toolbar pagination pager tags disclaimer copyright popup modal complementary contentinfo navigation").split()
_SCAN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\s/>=]++(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+))?+|[\s/=])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in (*RAW, *UNSHOWN)}
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A leaf's text and the names, from the root down, of the elements that it stands in."""

    text: str
    path: tuple[str, ...]


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    """The element's name and the words of its class, id and role."""
    found = [tag]
    for _, a, b, c in _ATTR.findall(attrs) if attrs else ():
        found += [w for w in re.split(r"[^a-z0-9]+", html.unescape(a or b or c).lower()) if w]
    return tuple(found)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in its order. Only block elements end a block; character references are decoded and runs of
    white space become one space."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # name, names, whether it is of another language
    text: list[str] = []
    lead: list[str] = []  # path of the block that is being read

    def end_block() -> None:
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            out.append(Block(joined, tuple(lead)))
        text.clear()
        lead.clear()

    def add(raw: str) -> None:
        if raw:
            if not lead and not raw.isspace():
                lead.extend(n for _, names, _ in stack for n in names)
            text.append(html.unescape(raw) if "&" in raw else raw)

    at, n = 0, len(page)
    while at < n:
        m = _SCAN.search(page, at)
        if m is None:
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        foreign = bool(stack) and stack[-1][2] and stack[-1][0] not in OWN_TEXT
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag not in INLINE and not (foreign if k is None else stack[k][2]):
                end_block()
            if k is not None:
                del stack[k:]
            continue
        if foreign and tag in BREAKS:
            while stack and stack[-1][2] and stack[-1][0] not in OWN_TEXT:
                stack.pop()
            foreign = False
        alone = m[3].rstrip().endswith("/")
        if tag in _RAW_END:
            if not alone:
                close = _RAW_END[tag].search(page, at)
                if close or tag in RAW and not foreign:
                    at = close.end() if close else n
            if tag not in INLINE and not foreign:
                end_block()
            continue
        if foreign or tag in FOREIGN:
            if not alone:
                stack.append((tag, _names(tag, m[3]) if tag in FOREIGN else (), True))
            continue
        if tag == "br" or tag == "img":
            text.append(" ")
            continue
        if tag not in INLINE:
            end_block()
        ends = CLOSES.get(tag)
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][2] or stack[k][0] == "object" or stack[k][0] not in INLINE and stack[k][0] not in ("p", "li", "td", "th", "dd", "dt", "tr", "option"):
                    break
        if tag not in VOID:
            stack.append((tag, _names(tag, m[3]), False))
    add(page[at:])
    end_block()
    return out


_HASHES: dict[str, tuple[int, int]] = {}


def _slot(word: str) -> tuple[int, int]:
    s = _HASHES.get(word)
    if s is None:
        if len(_HASHES) > 1 << 18:
            _HASHES.clear()
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        s = _HASHES[word] = (h, 1 if h >> 31 else -1)
    return s


def features(page: list[Block]) -> np.ndarray:
    """Per block: hashed names of its tag path, its words hashed with signs, and its size."""
    x = np.zeros((len(page), PATH_DIM + WORD_DIM + 3), np.float32)
    for k, b in enumerate(page):
        for name in b.path:
            x[k, _slot(name)[0] % PATH_DIM] = 1
        words = b.text.lower().split(" ")
        h = np.array([_slot(w) for w in words])
        np.add.at(x[k], PATH_DIM + h[:, 0] % WORD_DIM, h[:, 1])
        x[k, PATH_DIM:PATH_DIM + WORD_DIM] /= len(words)
        x[k, -3:] = np.log1p(len(words)) / 4, np.log1p(len(b.text)) / 8, b.text[-1] in ".!?"
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Lstm:
    """One direction of a long short-term memory layer over padded sequences (time, page, feature)."""

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int):
        self.w = rng.normal(0, 0.2, (inputs + hidden, 4 * hidden)) * np.r_[np.full(inputs, 1.0), np.full(hidden, 0.5)][:, None]
        self.b = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
        self.hidden = hidden

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        t, p, _ = x.shape
        n = self.hidden
        h, c = np.zeros((p, n)), np.zeros((p, n))
        out, tape = np.zeros((t, p, n)), []
        for k in range(t):
            z = np.concatenate([x[k], h], 1)
            a = z @ self.w + self.b
            i, f, o, g = _sigmoid(a[:, :n]), _sigmoid(a[:, n:2 * n]), _sigmoid(a[:, 2 * n:3 * n]), np.tanh(a[:, 3 * n:])
            m = mask[k][:, None]
            before = c
            c = np.where(m, f * c + i * g, c)
            h = np.where(m, o * np.tanh(c), h)
            out[k] = h
            if keep:
                tape.append((z, i, f, o, g, before, c, m))
        return out, tape

    def backward(self, tape: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.hidden
        dw, db = np.zeros_like(self.w), np.zeros_like(self.b)
        dh, dc = np.zeros(dout.shape[1:]), np.zeros(dout.shape[1:])
        for k in range(len(tape) - 1, -1, -1):
            z, i, f, o, g, before, c, m = tape[k]
            dh = dh + dout[k]
            tc = np.tanh(c)
            dcell = dc + dh * o * (1 - tc**2)
            da = np.concatenate([dcell * g * i * (1 - i), dcell * before * f * (1 - f), dh * tc * o * (1 - o), dcell * i * (1 - g**2)], 1) * m
            dw += z.T @ da
            db += da.sum(0)
            dh, dc = np.where(m, (da @ self.w.T)[:, -n:], dh), np.where(m, dcell * f, dc)
        return dw, db


@dataclass
class Labeller:
    """Reads a page's blocks in both directions and says for each whether it belongs to the main text."""

    ahead: Lstm
    back: Lstm
    out: np.ndarray

    def _run(self, xs: list[np.ndarray], keep: bool = False):
        t = max(len(x) for x in xs)
        mask = np.arange(t)[:, None] < np.array([len(x) for x in xs])[None]
        x = np.zeros((t, len(xs), xs[0].shape[1]))
        for k, page in enumerate(xs):
            x[:len(page), k] = page
        flip = lambda a: np.stack([np.r_[a[:len(p), k][::-1], a[len(p):, k]] for k, p in enumerate(xs)], 1)
        h1, t1 = self.ahead.forward(x, mask, keep)
        h2, t2 = self.back.forward(flip(x), mask, keep)
        state = np.concatenate([h1, flip(h2), x, np.ones((*mask.shape, 1))], 2)
        return _sigmoid(state @ self.out), state, mask, t1, t2, flip

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        found = [np.zeros(len(p), bool) for p in pages]
        run: list[int] = []
        for j, k in enumerate(order):
            run.append(k)
            last = j + 1 == len(order)
            if last or (len(run) + 1) * len(pages[order[j + 1]]) > BATCH_BLOCKS:
                p = self._run([features(pages[r]) for r in run])[0]
                for col, r in enumerate(run):
                    found[r] = p[:len(pages[r]), col] > 0.5
                run = []
        return found


def train(pages: list[list[Block]], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Labeller:
    """Back-propagation through time with Adam over batches of pages."""
    rng = np.random.default_rng(seed)
    width = PATH_DIM + WORD_DIM + 3
    net = Labeller(Lstm(rng, width, HIDDEN), Lstm(rng, width, HIDDEN), rng.normal(0, 0.1, 2 * HIDDEN + width + 1))
    xs = [features(p) for p in pages]
    params = lambda: [net.ahead.w, net.ahead.b, net.back.w, net.back.b, net.out]
    m, v, step = [np.zeros_like(p) for p in params()], [np.zeros_like(p) for p in params()], 0
    for _ in range(epochs):
        order = sorted(rng.permutation(len(xs)), key=lambda k: len(xs[k]) // 8)
        runs = [order[k:k + 12] for k in range(0, len(order), 12)]
        rng.shuffle(runs)
        for run in runs:
            p, state, mask, t1, t2, flip = net._run([xs[k] for k in run], True)
            y = np.zeros(mask.shape)
            for col, k in enumerate(run):
                y[:len(labels[k]), col] = labels[k]
            d = (p - y) * mask / mask.sum()
            ds = d[:, :, None] * net.out
            g1 = net.ahead.backward(t1, ds[:, :, :HIDDEN])
            g2 = net.back.backward(t2, flip(ds[:, :, HIDDEN:2 * HIDDEN]))
            grads = [*g1, *g2, np.einsum("tp,tpn->n", d, state)]
            step += 1
            for k, (w, g) in enumerate(zip(params(), grads)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def weak_labels(page: list[Block]) -> np.ndarray:
    """Labels by names alone: a block is main text if no element around it speaks of something beside the article. A header
    within the article (its headline) is part of it."""
    beside = set(BESIDE)

    def main(path: tuple[str, ...]) -> bool:
        inner = path[path.index("article"):] if "article" in path else path
        return not any(n in beside and not (n == "header" and inner is not path) for n in (path if inner is path else (*path, *inner)) if not (n == "header" and "article" in path))

    return np.array([main(b.path) for b in page], bool)


def training_pages(pages: list[list[Block]], seed: int = SEED) -> tuple[list[list[Block]], list[np.ndarray]]:
    """The sample with its weak labels, and variants of each page: text of other pages put into elements beside the article, in
    many shapes, and the article put into other elements; so that the names, not one site's layout, are learned."""
    rng = np.random.default_rng(seed)
    xs, ys = list(pages), [weak_labels(p) for p in pages]
    pool = [b.text for p in pages for b in p] or ["text"]
    wrappers = [("article",), ("main",), ("div", "content"), ("div", "post", "body"), ("main", "article"), ("section", "story"), ("div", "entry", "content"), ("div", "container")]
    leaves = [("p",), ("div",), ("li",), ("h2",), ("span",), ("ul", "li", "a"), ("section", "p"), ("table", "tr", "td"), ("blockquote", "p"), ("h3",), ("pre",)]
    for p, y in zip(list(xs), list(ys)):
        wrap = wrappers[rng.integers(len(wrappers))]
        body = [(Block(b.text, ("html", "body", *wrap, *(leaves[rng.integers(len(leaves))] if rng.random() < 0.3 else b.path[-1:]))), True) for b, keep in zip(p, y) if keep]
        for _ in range(rng.integers(2, 7)):
            name = BESIDE[rng.integers(len(BESIDE))]
            outer = (name,) if rng.random() < 0.4 else (("div", "section", "aside", "ul", "form")[rng.integers(5)], name)
            inside = wrap if rng.random() < 0.4 and name != "header" else ()
            new = [(Block(pool[rng.integers(len(pool))], ("html", "body", *inside, *outer, *leaves[rng.integers(len(leaves))])), False) for _ in range(rng.integers(1, 5))]
            at = (0, len(body), rng.integers(len(body) + 1))[rng.integers(3)]
            body[at:at] = new
        if body:
            xs.append([b for b, _ in body])
            ys.append(np.array([k for _, k in body], bool))
    return xs, ys


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """Train on at most `sample` pages, one an id, chosen by the hash of their ids; of rows that repeat an id, the least."""
    ids = pages.filter(F.col("html").isNotNull() & F.col("page_id").isNotNull()).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect()
    read = [p for p in (blocks(r["html"]) for r in rows) if p]
    return train(*training_pages(read)) if read else train([[Block("text", ("article", "p"))]], [np.array([True])], epochs=1)


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of `pages` (page_id, url, html, ...).

    The text is that of the blocks which the labeller takes for main text, in page order, joined by two line
    feeds; it is empty for a null, empty or blockless page. Repeated rows repeat, other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for at in range(0, len(f), 200):
                read = [blocks(h) for h in f["html"].iloc[at:at + 200]]
                texts += ["\n\n".join(b.text for b, keep in zip(p, ks) if keep) for p, ks in zip(read, model.label(read))]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
