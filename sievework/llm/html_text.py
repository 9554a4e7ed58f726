"""HTML extraction: a recurrent network labels every block of a page as main text or not.

Method.  A page is cut into leaf blocks, the runs of text between tags that break lines.  A block's
input is the sum of vectors of its tag path (tag names, classes and ids, hashed), the mean of vectors of
its hashed words, its length and the share of it in links.  A bidirectional LSTM reads the page's blocks
in order, so that each is labelled with the whole document as context; it is trained here in numpy, by
backpropagation through time with Adam.  Labels for training come from the paths of a bounded sample of
pages: article, main and content elements against menus, headers, footers, asides, forms, adverts,
notices and comments.  Pages are also rewritten for training, with blocks of such kinds put in and
elements renamed, so that the network knows more layouts than the sample has.

Script, style, template and head elements and comments of the markup are never text, nor is what only
stands in for another (noscript, iframe, textarea).  A head ends at its end tag, or at the first tag or
text that can't be in one.  Text of math, svg, object, select and media elements is in blocks like others.  Character
references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
newlines in page order.  A page is read once from front to back: attributes by the rules of HTML (a quote counts behind
an equals sign alone), a tag that never ends is text, and a slash closes nothing but elements of svg and math.

Bound: ``TRAIN_PAGES`` pages, in parts of 200 blocks.  Of a sample with under ``FEW_PAGES`` pages that have
labelled elements, or none, made-up pages are learned too.  Defined results: a null or empty page gives an empty text, and so does one
whose blocks are all labelled otherwise; text outside any element is a block like others.  Unclosed and
mismatched tags close at the next tag that ends their parent.  Rows with a null id get results.  Repeated
rows get results alike.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import U, word_hashes, word_spans
from .supervised import as_buffer

TRAIN_PAGES = 400
#: With fewer labelled pages in the sample, made-up ones are added.
FEW_PAGES = 20
HIDDEN, EMBED = 8, 8
PATH_BITS, WORD_BITS = 11, 12
RESULT = "page_id long, url string, text string, n_chars long"

#: What begins markup; any other ``<`` is text.
MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: One attribute: a quote opens a value only behind the equals sign of a name.
ATTRIBUTE = re.compile(r"[\s/]*+=?[^\s/>=]*+(?:\s*+=\s*+(?:([\"'])|[^\s>]*+))?")
#: Names of a path that a block keeps at most, the innermost ones.
MOST_NAMES = 64
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SILENT = frozenset("script style noscript template head title textarea iframe".split())
#: All that a head can hold; anything else ends it.
IN_HEAD = frozenset("base link meta title style script noscript template head".split())
RAW = frozenset("script style noscript template title textarea iframe".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
FOREIGN = ("svg", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mpadded menclose semantics".split())
BLACK = frozenset("nav header footer aside form menu button dialog".split())
BLACK_NAMES = frozenset("ad ads advert advertisement adverts banner cookie cookies consent notice alert sidebar comment comments disqus menu nav navbar navigation footer header masthead breadcrumb breadcrumbs promo promotion sponsored related share sharing social newsletter subscribe popup modal widget login search pagination".split())
WHITE = frozenset(["article", "main"])
WHITE_NAMES = frozenset("article content main post entry story body-text".split())


class Block:
    __slots__ = ("text", "path", "linked", "label")

    def __init__(self, text: str, path: tuple[str, ...], linked: float, label: int) -> None:
        self.text, self.path, self.linked, self.label = text, path, linked, label


@lru_cache(maxsize=1 << 14)
def _says(name: str) -> tuple[int, int]:
    """Whether a tag, class or id speaks against main text, and for it."""
    parts = set(re.split(r"[^a-z0-9]+", name[1:]))
    tag = {name} if name[0].isalpha() else set()
    return int(bool(tag & BLACK or parts & BLACK_NAMES)), int(bool(tag & WHITE or parts & WHITE_NAMES))


def tag_end(page: str, at: int) -> int:
    """Where the tag ends whose attributes begin at a place; -1 if it doesn't.  A quote that nothing closes is a letter."""
    while True:
        m = ATTRIBUTE.match(page, at)
        at = m.end()
        if m[1]:
            shut = page.find(m[1], at)
            if shut < 0:
                return page.find(">", at) + 1 or -1
            at = shut + 1
        elif at >= len(page):
            return -1
        elif page[at] == ">":
            return at + 1


def markup(page: str, at: int) -> tuple[int, int, str, str, str] | None:
    """Start and end of the next markup, and of a tag its slash, name and attributes; None if only text is left.

    What begins a tag and never ends one is text, and so is all behind it.
    """
    m = MARKUP.search(page, at)
    if m is None:
        return None
    if m[2]:
        end = tag_end(page, m.end())
        return None if end < 0 else (m.start(), end, m[1], m[2].lower(), page[m.end() : end - 1])
    mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
    end = page.find(mark, m.start() + 2)
    if end < 0 and mark == ">":
        return None
    return m.start(), len(page) if end < 0 else end + len(mark), "", "", ""


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    held: dict[str, int] = {}
    open_: dict[str, int] = {}
    parts: list[str] = []
    links = total = 0
    silent = black = white = 0  # open elements that aren't text, and names that speak against main text and for it

    def flush() -> None:
        nonlocal links, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                path = tuple(held) if len(held) <= MOST_NAMES else tuple(islice(reversed(held), MOST_NAMES))[::-1]
                out.append(Block(text, path, links / max(1, total), 0 if black else 1 if white else -1))
        links = total = 0

    def pop() -> None:
        nonlocal silent, black, white
        tag, names = stack.pop()
        open_[tag] -= 1
        silent -= tag in SILENT
        for n in names:
            held[n] -= 1
            if not held[n]:
                del held[n]
                black, white = black - _says(n)[0], white - _says(n)[1]

    def end_head() -> None:
        while stack[-1][0] != "head":
            pop()
        pop()

    at, n = 0, len(page)
    while at < n:
        m = markup(page, at)
        piece = page[at : m[0] if m else n]
        if open_.get("head") and piece.strip():
            end_head()
        if piece and not silent:
            parts.append(piece)
            total += len(piece)
            links += len(piece) if open_.get("a") else 0
        if not m:
            break
        _, at, close, tag, rest = m
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if close:
            if open_.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if open_.get("head") and tag not in IN_HEAD:
            end_head()
        if tag in VOID:
            continue
        if rest.endswith("/") and (tag in FOREIGN or any(map(open_.get, FOREIGN))):  # elsewhere the slash means nothing
            continue
        if tag in ("p", "li", "tr", "td", "th", "option") and stack and stack[-1][0] in ({tag, "p"} | INLINE):
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in INLINE:
                k -= 1
            if k >= 0 and stack[k][0] in (tag, "p"):
                while len(stack) > k:
                    pop()
        names = [tag]
        if rest and "=" in rest:
            names += ["." + v.lower() for g in NAMES.findall(rest) for v in "".join(g).split()]
        stack.append((tag, names))
        open_[tag] = open_.get(tag, 0) + 1
        silent += tag in SILENT
        for v in names:
            held[v] = held.get(v, 0) + 1
            if held[v] == 1:
                black, white = black + _says(v)[0], white + _says(v)[1]
        if tag in RAW:
            shut = RAW_END[tag].search(page, at)
            end = tag_end(page, shut.end()) if shut else -1
            at = n if end < 0 else end
            pop()
    flush()
    return out


def vectors(pages: list[list[Block]]) -> dict[str, np.ndarray]:
    """Hashed features of all blocks of some pages in a row."""
    flat = [b for p in pages for b in p]
    known: dict[str, int] = {}
    path, owner = [], []
    for k, b in enumerate(flat):
        for v in b.path:
            if v not in known:
                known[v] = zlib.crc32(v.encode()) & ((1 << PATH_BITS) - 1)
            path.append(known[v])
            owner.append(k)
    buf, starts = as_buffer([b.text for b in flat])
    first, last, text = word_spans(buf, starts)
    words = (word_hashes(buf, first, last) >> U(64 - WORD_BITS)).astype(np.int64)
    size = np.diff(starts)
    extra = np.stack([np.log1p(size) / 8, np.array([b.linked for b in flat], float).reshape(-1), np.ones(len(flat))], axis=1) if flat else np.zeros((0, 3))
    return {"path": np.array(path, np.int64), "path_of": np.array(owner, np.int64), "word": words, "word_of": text, "extra": extra.astype(np.float32), "n": np.array([len(p) for p in pages])}


def _sums(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(owner):
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[heads]] = np.add.reduceat(rows, heads, axis=0)
    return out


def inputs(model: dict, v: dict) -> np.ndarray:
    n = len(v["extra"])
    times = np.maximum(np.bincount(v["word_of"], minlength=n), 1).astype(np.float32)
    return np.concatenate([_sums(model["path"][v["path"]], v["path_of"], n), _sums(model["word"][v["word"]], v["word_of"], n) / times[:, None], v["extra"]], axis=1)


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of steps x rows x inputs, from the first step to the last."""
    steps, rows, _ = x.shape
    h = c = np.zeros((rows, HIDDEN), np.float32)
    out = np.zeros((steps, rows, HIDDEN), np.float32)
    given = x @ wx + b
    for t in range(steps):
        g = given[t] + h @ wh
        gate = _sig(g[:, : 3 * HIDDEN])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
        a = np.tanh(g[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * a
        tanh = np.tanh(new)
        if keep is not None:
            keep.append((h, c, i, f, o, a, tanh, m))
        c = m * new + (1 - m) * c
        h = m * (o * tanh) + (1 - m) * h
        out[t] = h
    return out


def lstm_back(d: np.ndarray, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: list):
    """Gradients of the inputs and parameters, given those of the states."""
    dh = dc = np.zeros(d.shape[1:], np.float32)
    dx, dwh = np.zeros_like(x), np.zeros_like(wh)
    dg_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, a, tanh, m = keep[t]
        dh = dh + d[t]
        down, dcm = dh * m, dc * m
        do = down * tanh
        dn = down * o * (1 - tanh**2) + dcm
        dg = np.concatenate([dn * a * i * (1 - i), dn * c * f * (1 - f), do * o * (1 - o), dn * i * (1 - a**2)], axis=1)
        dg_all[t] = dg
        dwh += h.T @ dg
        dh = dh * (1 - m) + dg @ wh.T
        dc = dc * (1 - m) + dn * f
    dx = dg_all @ wx.T
    return dx, np.einsum("tni,tng->ig", x, dg_all), dwh, dg_all.sum((0, 1))


def _padded(x: np.ndarray, counts: np.ndarray):
    starts = np.cumsum(counts) - counts
    steps = int(counts.max())
    place = np.arange(steps)[:, None]
    mask = place < counts[None, :]
    return np.where(mask, starts[None, :] + place, 0), mask.astype(np.float32)


def forward(model: dict, x: np.ndarray, counts: np.ndarray, keep: bool = False):
    """Logits of all blocks in a row; with what backpropagation needs if kept."""
    at, mask = _padded(x, counts)
    seq = x[at] * mask[:, :, None]
    back = (seq[::-1], mask[::-1])
    memory: tuple[list, list] = ([], [])
    up = lstm(seq, mask, *(model[f"{k}0"] for k in ("wx", "wh", "b")), keep=memory[0] if keep else None)
    down = lstm(*back, *(model[f"{k}1"] for k in ("wx", "wh", "b")), keep=memory[1] if keep else None)[::-1]
    both = np.concatenate([up, down], axis=2)
    z = both @ model["w"] + model["c"]
    ok = mask > 0
    logits = np.zeros(len(x), np.float32)
    logits[at[ok]] = z[ok]
    return (logits, at, mask, seq, both, memory) if keep else logits


def label(model: dict, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block is main text; pages of like length are labelled together."""
    out: list = [np.zeros(0, bool)] * len(pages)
    todo = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    while todo:
        part, todo = todo[:64], todo[64:]
        v = vectors([pages[k] for k in part])
        z = forward(model, inputs(model, v), v["n"])
        for k, own in zip(part, np.split(z, np.cumsum(v["n"])[:-1]), strict=True):
            out[k] = own > 0
    return out


def rewritten(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """A training variant: elements renamed, and blocks of other kinds put in, outside and inside the main text."""
    names = [("article", "main"), ("article", "div", ".post"), ("article", "div", ".content"), ("article", "section", "div", ".entry"), ("article",)]
    swap = names[rng.integers(len(names))]
    out = [Block(b.text, tuple(w for v in b.path for w in (swap[1:] if v == "article" and len(swap) > 1 and b.label == 1 else (v,))), b.linked, b.label) for b in page]
    kinds = [("aside",), ("header",), ("form",), ("form", "label"), ("div", ".sidebar"), ("section", ".comments"), ("div", ".comment"), ("div", ".cookie-notice", ".cookie", ".notice"), ("div", ".ads"), ("div", ".advert"), ("div", ".banner"), ("div", ".related"), ("div", ".newsletter"), ("ul", "li", ".menu"), ("footer", "p"), ("nav", "a"), ("div", ".share"), ("div", ".popup")]
    texts = [b.text for b in page] or [""]
    for _ in range(int(rng.integers(1, 6))):
        kind = kinds[rng.integers(len(kinds))]
        at = int(rng.integers(len(out) + 1))
        inside = out[at - 1].path if at and rng.random() < 0.5 else ("html", "body")
        new = [Block(texts[rng.integers(len(texts))], (*inside, *kind, "p")[: 12], float(rng.random() < 0.3), 0) for _ in range(int(rng.integers(1, 4)))]
        out[at:at] = new
    return out


def invented(rng: np.random.Generator, many: int = 40) -> list[list[Block]]:
    """Made-up pages with labels, for samples that have hardly any: main text among menus, notices and asides."""
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 4000, n))
    around = [("nav", "ul", "li", "a"), ("header", "h2"), ("aside", "p"), ("footer", "p"), ("form", "label"), ("div", ".cookie-notice", ".notice", "p"), ("div", ".advert", "p"), ("section", ".comments", "div", ".comment", "p")]
    out = []
    for _ in range(many):
        page = [Block(word(int(rng.integers(1, 5))), ("html", "body", *around[k]), float(k == 0), 0) for k in rng.choice(2, int(rng.integers(1, 4)))]
        page.append(Block(word(6), ("html", "body", "article", "h1"), 0.0, 1))
        page += [Block(word(int(rng.integers(8, 60))), ("html", "body", "article", "p"), 0.0, 1) for _ in range(int(rng.integers(1, 9)))]
        page += [Block(word(int(rng.integers(2, 30))), ("html", "body", *around[k]), 0.0, 0) for k in rng.choice(np.arange(2, len(around)), int(rng.integers(1, 5)))]
        out.append(page)
    return out


def fit(pages: list[str], seed: int = 2, rounds: int = 8) -> dict:
    rng = np.random.default_rng(seed)
    plain = [p for p in map(blocks_of, pages) if any(b.label >= 0 for b in p)]
    if len(plain) < FEW_PAGES:
        plain += invented(rng)
    train = plain + [rewritten(p, rng) for p in plain] + [rewritten(p, rng) for p in plain]
    # long pages in parts, so that a batch stays small
    train = [p[k : k + 200] for p in train for k in range(0, len(p), 200)]
    normal = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    width = 2 * EMBED + 3
    model = {"path": normal(1 << PATH_BITS, EMBED), "word": normal(1 << WORD_BITS, EMBED) * 0.1, "w": normal(2 * HIDDEN), "c": np.zeros(1, np.float32)}
    for way in "01":
        model |= {f"wx{way}": normal(width, 4 * HIDDEN), f"wh{way}": normal(HIDDEN, 4 * HIDDEN), f"b{way}": np.zeros(4 * HIDDEN, np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step = 0
    for turn in range(rounds):
        order = sorted(rng.permutation(len(train)).tolist(), key=lambda k: len(train[k]) // 8)
        batches = [order[k : k + 32] for k in range(0, len(order), 32)]
        for b in rng.permutation(len(batches)):
            part = [train[k] for k in batches[b]]
            v = vectors(part)
            x = inputs(model, v)
            z, at, mask, seq, both, memory = forward(model, x, v["n"], True)
            y = np.array([blk.label for p in part for blk in p], np.float32)
            known = y >= 0
            d = np.where(known, _sig(z) - y, 0) / max(1, known.sum())
            dz = np.where(mask > 0, d[at], 0).astype(np.float32)
            g = {"w": np.einsum("tn,tnh->h", dz, both), "c": dz.sum(keepdims=True).reshape(1)}
            ds = dz[:, :, None] * model["w"]
            dx0, g["wx0"], g["wh0"], g["b0"] = lstm_back(ds[:, :, :HIDDEN], seq, model["wx0"], model["wh0"], memory[0])
            dx1, g["wx1"], g["wh1"], g["b1"] = lstm_back(ds[::-1, :, HIDDEN:], seq[::-1], model["wx1"], model["wh1"], memory[1])
            ok = mask > 0
            dx = np.zeros_like(x)
            dx[at[ok]] = (dx0 + dx1[::-1])[ok]
            times = np.maximum(np.bincount(v["word_of"], minlength=len(x)), 1)[:, None]
            g["path"], g["word"] = np.zeros_like(model["path"]), np.zeros_like(model["word"])
            np.add.at(g["path"], v["path"], dx[v["path_of"], :EMBED])
            np.add.at(g["word"], v["word"], (dx[:, EMBED : 2 * EMBED] / times)[v["word_of"]])
            step += 1
            for k, grad in g.items():
                m, s = moments[k]
                m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
                moments[k] = (m.astype(np.float32), s.astype(np.float32))
                model[k] = (model[k] - 0.02 / (1 + turn / 2) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    # the sample: the pages whose ids hash lowest
    known = pages.select(F.col(id_col).cast("long").alias("i"), F.col(html_col).alias("h")).where("i IS NOT NULL AND h <> ''")
    ids = [r["i"] for r in known.select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(train_pages).collect()]
    sample = known.where(F.col("i").isin(ids)).groupBy("i").agg(F.min("h").alias("h")).orderBy("i").collect() if ids else []  # ``train_pages`` pages
    model = fit([r["h"] for r in sample])
    shared = pages.sparkSession.sparkContext.broadcast(model)  # tables of 2**PATH_BITS and 2**WORD_BITS rows
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [blocks_of(h or "") for h in part.column(2).to_pylist()]
                texts = ["\n".join(b.text for b, ok in zip(p, keep, strict=True) if ok) for p, keep in zip(found, label(shared.value, found), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(extract, RESULT)


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
