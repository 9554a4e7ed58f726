"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words.

Method.  A word's input is a vector for its hash, the mean vector of its character n-grams' hashes, and
two numbers counted from the training rows: the log-odds of the word and the highest of its n-grams'.
Windows of ``WINDOW`` words, each starting ``STRIDE`` after the one before, so that all overlap, go
through a gated recurrent unit in each direction; attention weights their states to one vector, and a
linear layer gives the window's logit.  A text's logit is its highest window's.  Everything is trained
here in numpy, by backpropagation through time with Adam: of each training text the windows that the
counts or the net so far find most telling, and others of clean texts.  Texts kept back set the offset at
which 0.5 parts the classes best.

A word over ``STRETCH`` bytes, such as a sentence of a script without spaces, is cut into stretches of so
many, each beginning ``OVERLAP`` bytes before the end of the one before, and each counts as a word; so
every n-gram of it is an input.

The input products of the recurrent units are computed once for each distinct word of a chunk.

Bound: ``TRAIN_ROWS`` labelled rows of each class at most.

Defined results: a null, empty or wordless text scores next to 0.  Rows with a null
id are scored, with a null id, not held out.  Repeated rows are scored alike.  Without labels of both
classes all scores are 0, so nothing is rejected.  Other columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_chunks
from .bytehash import SPACE, U, byte_grams, mix, word_hashes, word_spans
from .supervised import as_buffer, held_out, training_rows

TRAIN_ROWS = 2500
WINDOW, STRIDE = 32, 24
HIDDEN, EMBED = 8, 8
WORD_BITS, GRAM_BITS = 16, 17
HASHED_BYTES = 1 << 20
#: Distinct words whose n-grams are taken at a time.
PART = 1 << 14
GRAMS = (4, 5)
#: Bytes of a word's stretch, and those it shares with the next: no n-gram is lost between them.
STRETCH, OVERLAP = 40, 8
RESULT = "doc_id long, score double, predicted int"

PARTING = SPACE.copy()
PARTING[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII capitals, and capitals of the UTF-8 pairs that begin with C3, made small."""
    out = LOWER[buf]
    if len(buf) > 1:
        pair = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[pair] += 32
    return out


def stretches(first: np.ndarray, last: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, those over STRETCH bytes cut into overlapping stretches."""
    step = STRETCH - OVERLAP
    each = np.maximum(1, -(-(last - first - OVERLAP) // step))
    start = np.repeat(first, each) + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * step
    return start, np.minimum(start + STRETCH, np.repeat(last, each)), np.repeat(of, each)


class Words:
    """The words of a chunk: which distinct word each is, its text, and the distinct words' hashes and n-grams."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray) -> None:
        buf = lowered(buf)
        # texts of a few bytes at a time: hashing takes many times the bytes it reads
        at, hashes, first, last, text = 0, [], [], [], []
        while at < len(starts) - 1 or not hashes:
            end = min(len(starts) - 1, max(at + 1, int(np.searchsorted(starts, starts[at] + HASHED_BYTES))))
            lo, hi = starts[at], starts[end]
            i, j, of = stretches(*word_spans(buf[lo:hi], starts[at : end + 1] - lo, PARTING))
            hashes.append(word_hashes(buf[lo:hi], i, j))
            first.append(i + lo)
            last.append(j + lo)
            text.append(of + at)
            at = end
        first, last, self.text = map(np.concatenate, (first, last, text))
        hashes, one, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        self.number = number.astype(np.int32)
        self.word = (hashes >> U(64 - WORD_BITS)).astype(np.int32)
        del hashes, number
        first, last = first[one], last[one]
        # n-grams of each word between two marks, of so many words at a time
        grams, sizes = [], []
        for k in range(0, max(1, len(first)), PART):
            i, j = first[k : k + PART], last[k : k + PART]
            letters = j - i
            size = np.maximum(letters + 2, min(GRAMS))
            at = np.concatenate([[0], np.cumsum(size)])
            own = np.zeros(int(at[-1]), np.uint8)
            place = np.arange(len(own)) - np.repeat(at[:-1], size)
            inner = (place > 0) & (place <= np.repeat(letters, size))
            own[inner] = buf[(np.repeat(i, size) + place - 1)[inner]]
            owner, found = [], []
            for n in GRAMS:
                h = byte_grams(own, n)
                fit_in = np.flatnonzero(place[: len(h)] + n <= np.repeat(size, size)[: len(h)])
                owner.append(np.repeat(np.arange(len(size)), size)[fit_in])
                found.append((mix(h[fit_in] + U(n)) >> U(64 - GRAM_BITS)).astype(np.int32))
            owner = np.concatenate(owner)
            grams.append(np.concatenate(found)[np.argsort(owner, kind="stable")])
            sizes.append(np.bincount(owner, minlength=len(size)))
        #: the n-grams of word k are grams[cuts[k] : cuts[k + 1]]; each word has one at least
        self.grams = np.concatenate(grams)
        self.cuts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        self.n_texts = len(starts) - 1

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows as distinct words' numbers, -1 behind a text's end, and the text of each; one at least a text."""
        counts = np.bincount(self.text, minlength=self.n_texts)
        each = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
        text = np.repeat(np.arange(self.n_texts), each)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
        start = (np.cumsum(counts) - counts)[text] + nth * STRIDE
        left = counts[text] - nth * STRIDE
        place = np.arange(WINDOW)[None, :]
        out = np.full((len(text), WINDOW), -1, np.int32)
        for k in range(0, len(text), PART):
            inside = place < left[k : k + PART, None]
            out[k : k + PART][inside] = self.number[(start[k : k + PART, None] + place)[inside]]
        return out, text


def _odds(count: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shrunken log-odds by feature; count: documents of class 0 and 1 with it."""
    rate = (count + 0.5) / (np.array([(y == 0).sum(), (y == 1).sum()])[:, None] + 1)
    seen = count.sum(0)
    return (np.clip(np.log(rate[1]) - np.log(rate[0]), -4, 6) * seen / (seen + 8)).astype(np.float32)


def inputs(model: dict, w: Words) -> np.ndarray:
    """The input vector of each distinct word, and after them zeros for the place behind a text."""
    n = len(w.word)
    x = np.zeros((n + 1, 2 * EMBED + 2), np.float32)
    x[:n, :EMBED] = model["word"][w.word]
    x[:n, -2] = model["word_odds"][w.word]
    for k in range(0, n, PART):
        m = min(n, k + PART)
        grams, heads = w.grams[w.cuts[k] : w.cuts[m]], w.cuts[k:m] - w.cuts[k]
        x[k:m, EMBED : 2 * EMBED] = np.add.reduceat(model["gram"][grams], heads, axis=0) / np.diff(w.cuts[k : m + 1])[:, None]
        x[k:m, -1] = np.maximum.reduceat(model["gram_odds"][grams], heads)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run(model: dict, given: np.ndarray, idx: np.ndarray, keep: bool = False):
    """Logits of windows; given: each word's input times the input weights, both directions; with the states if kept."""
    rows, steps = idx.shape
    mask = (idx >= 0).astype(np.float32)
    states = np.zeros((steps, rows, 2 * HIDDEN), np.float32)
    memory = []
    for way in range(2):
        u = model["u"][way]
        own = given[way]
        h = np.zeros((rows, HIDDEN), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            g = own[idx[:, t]]
            zr = sigmoid(g[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            step = mask[:, t, None] * z
            new = h + step * (c - h)
            if keep:
                memory.append((way, t, h, z, r, c))
            h = new
            states[t, :, way * HIDDEN : (way + 1) * HIDDEN] = h
    e = np.tanh(states @ model["va"])
    a = (e @ model["vb"]).T - 1e4 * (1 - mask)
    a = np.exp(a - a.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    pooled = np.einsum("nt,tnh->nh", a, states)
    logit = pooled @ model["w"] + model["b"]
    return (logit, states, e, a, pooled, mask, memory) if keep else logit


def project(model: dict, x: np.ndarray) -> list[np.ndarray]:
    return [x @ model["wx"][way] + model["bx"][way] for way in range(2)]


def gradients(model: dict, w: Words, x: np.ndarray, idx: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean logistic loss, by backpropagation through time."""
    given = project(model, x)
    logit, states, e, a, pooled, mask, memory = run(model, given, idx, True)
    d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    out = {"w": pooled.T @ d, "b": d.sum()}
    dp = d[:, None] * model["w"][None, :]
    ds = np.einsum("nt,nh->tnh", a, dp)
    da = np.einsum("nh,tnh->nt", dp, states)
    dl = a * (da - (a * da).sum(1, keepdims=True))
    out["vb"] = np.einsum("nt,tnk->k", dl, e)
    de = dl.T[:, :, None] * model["vb"][None, None, :] * (1 - e**2)
    out["va"] = np.einsum("tnh,tnk->hk", states, de)
    ds = ds + de @ model["va"].T
    dx = np.zeros_like(x)
    out["u"], out["wx"], out["bx"] = [np.zeros_like(v) for v in model["u"]], [], []
    dgiven = [np.zeros_like(g) for g in given]
    dh, now = None, None
    for way, t, h, z, r, c in reversed(memory):
        if way != now:
            dh, now = np.zeros((len(y), HIDDEN), np.float32), way
        dh = dh + ds[t, :, way * HIDDEN : (way + 1) * HIDDEN]
        m = mask[:, t, None]
        u = model["u"][way]
        dz = dh * m * (c - h) * z * (1 - z)
        dc = dh * m * z * (1 - c**2)
        back = dc @ u[:, 2 * HIDDEN :].T
        dr = back * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=1)
        out["u"][way][:, : 2 * HIDDEN] += h.T @ dzr
        out["u"][way][:, 2 * HIDDEN :] += (r * h).T @ dc
        np.add.at(dgiven[way], idx[:, t], np.concatenate([dzr, dc], axis=1))
        dh = dh * (1 - m * z) + back * r + dzr @ u[:, : 2 * HIDDEN].T
    for way in range(2):
        dgiven[way][-1] = 0
        out["wx"].append(x.T @ dgiven[way])
        out["bx"].append(dgiven[way].sum(0))
        dx += dgiven[way] @ model["wx"][way].T
    n = len(w.word)
    times = np.diff(w.cuts)
    out["word"], out["gram"] = np.zeros_like(model["word"]), np.zeros_like(model["gram"])
    np.add.at(out["word"], w.word, dx[:n, :EMBED])
    np.add.at(out["gram"], w.grams, np.repeat((dx[:n, EMBED : 2 * EMBED] / times[:, None]).astype(np.float32), times, axis=0))
    return out


def highest(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, text, logits)
    return out


def logits(model: dict, w: Words, batch: int = 4096) -> np.ndarray:
    """Each text's highest window's logit; without words there is nothing toxic."""
    given = project(model, inputs(model, w))
    idx, text = w.windows()
    out = highest(np.concatenate([run(model, given, idx[k : k + batch]) for k in range(0, len(idx), batch)]) if len(idx) else np.zeros(0), text, w.n_texts)
    out[np.bincount(w.text, minlength=w.n_texts) == 0] = -np.inf
    return out


def fit(texts: list[str], y: np.ndarray, seed: int = 5, steps: int = 400, batch: int = 128) -> dict | None:
    """The trained model; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    back = np.arange(len(texts)) % 6 == 5
    w = Words(*as_buffer(texts))
    idx, text = w.windows()
    idx[idx < 0] = len(w.word)
    use = ~back
    bounds = np.searchsorted(w.text, np.arange(len(texts) + 1))
    word_count, gram_count = np.zeros((2, 1 << WORD_BITS)), np.zeros((2, 1 << GRAM_BITS))
    for k in np.flatnonzero(use):
        mine = _some(w, np.unique(w.number[bounds[k] : bounds[k + 1]]))
        word_count[y[k]][np.unique(mine.word)] += 1
        gram_count[y[k]][np.unique(mine.grams)] += 1
    normal = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    width = 2 * EMBED + 2
    model = {
        "word": normal(1 << WORD_BITS, EMBED), "gram": normal(1 << GRAM_BITS, EMBED),
        "word_odds": _odds(word_count, y[use]), "gram_odds": _odds(gram_count, y[use]),
        "wx": [normal(width, 3 * HIDDEN) * 3 for _ in range(2)], "bx": [np.zeros(3 * HIDDEN, np.float32) for _ in range(2)],
        "u": [normal(HIDDEN, 3 * HIDDEN) * 2 for _ in range(2)], "va": normal(2 * HIDDEN, HIDDEN) * 3, "vb": normal(HIDDEN) * 3, "w": normal(2 * HIDDEN) * 3, "b": np.float32(0),
    }
    x = inputs(model, w)
    telling = x[:, -1] + x[:, -2]
    first = np.concatenate([telling[idx[k : k + 4096]].max(1) for k in range(0, len(idx), 4096)])
    moments: dict = {}
    step = 0

    def adam(name: str, value, grad, rate: float):
        m, v = moments.get(name, (np.zeros_like(grad), np.zeros_like(grad)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        moments[name] = (m, v)
        return value - (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def best(rank: np.ndarray, of_: np.ndarray, many: int) -> np.ndarray:
        order = np.lexsort((-rank, of_))
        nth = np.arange(len(order)) - np.searchsorted(of_[order], of_[order])
        return order[nth < many]

    rank = first
    while step < steps:
        pos = np.flatnonzero(use[text] & (y[text] == 1))
        neg = np.flatnonzero(use[text] & (y[text] == 0))
        chosen = np.concatenate([pos[best(rank[pos], text[pos], 1)], neg[best(rank[neg], text[neg], 1)], neg[best(rng.random(len(neg)), text[neg], 1)]])
        for at in np.array_split(rng.permutation(chosen), max(1, len(chosen) // batch)):
            # only the words of these windows take part
            part = idx[at]
            own, local = np.unique(part, return_inverse=True)
            sub = _some(w, own[own < len(w.word)])
            local = local.reshape(part.shape)
            local = np.where(part == len(w.word), -1, local)
            step += 1
            g = gradients(model, sub, inputs(model, sub), local, y[text[at]].astype(np.float32))
            rate = 0.01 * max(0.1, 1 - step / steps)
            for name in ("w", "b", "va", "vb"):
                model[name] = adam(name, model[name], np.asarray(g[name], np.float32), rate)
            for name in ("u", "wx", "bx"):
                for way in range(2):
                    model[name][way] = adam(f"{name}{way}", model[name][way], g[name][way], rate)
            for name, rows in (("word", np.unique(sub.word)), ("gram", np.unique(sub.grams))):
                model[name][rows] -= 0.5 * g[name][rows]
        given = project(model, inputs(model, w))
        rank = np.concatenate([run(model, given, np.where(idx[k : k + 4096] == len(w.word), -1, idx[k : k + 4096])) for k in range(0, len(idx), 4096)])
    score = highest(rank, text, len(texts))
    judge = back if len(set(y[back].tolist())) == 2 else np.ones(len(texts), bool)
    # the offset that parts the texts kept back best, halfway between two of their logits
    order = np.sort(score[judge])
    cut = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2])
    hits = [(2 * ((score[judge] >= c) & (y[judge] == 1)).sum() / max(1, (score[judge] >= c).sum() + (y[judge] == 1).sum()), c) for c in cut]
    top = max(h for h, _ in hits)
    good = [c for h, c in hits if h == top]
    model["cut"] = float(good[len(good) // 2])
    return model


def _some(w: Words, numbers: np.ndarray) -> Words:
    """The given distinct words alone."""
    out = object.__new__(Words)
    size = w.cuts[numbers + 1] - w.cuts[numbers]
    out.word = w.word[numbers]
    out.cuts = np.concatenate([[0], np.cumsum(size)])
    out.grams = w.grams[np.repeat(w.cuts[numbers] - out.cuts[:-1], size) + np.arange(out.cuts[-1])]
    return out


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier) and predicted."""
    rows = training_rows(docs, labels, label, train_rows, id_col, text_col)
    model = fit(rows["text"].tolist(), rows["y"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of 2**WORD_BITS and 2**GRAM_BITS rows
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for keys, buf, starts in text_chunks(batches, 1 << 20):
            p = np.zeros(len(keys)) if m is None else sigmoid(logits(m, Words(buf, starts)) - m["cut"])
            yield pa.RecordBatch.from_arrays([keys, pa.array(p.astype(np.float64)), pa.array((p >= threshold).astype(np.int32))], schema=schema)

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, RESULT)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    rows = training_rows(docs, labels, label, train_rows, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows["text"].tolist(), rows["y"].to_numpy()))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m is not None:
                pair = pa.RecordBatch.from_arrays([batch[id_col], batch[text_col]], names=["id", "text"])
                score = [sigmoid(logits(m, Words(buf, starts)) - m["cut"]) for _, buf, starts in text_chunks([pair], 1 << 20)]
                batch = batch.filter(pa.array(np.concatenate([*score, np.zeros(0)]) < threshold))
            yield batch

    return docs.mapInArrow(sift, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
