"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Method.  A text's features are indicators of hashed n-grams: words and pairs of words, last letters of
words, and n-grams of word shapes (case, length, last byte, and whether a word repeats the one before,
up to runs of sixteen).  Each is scaled by its class log-count ratio from the training rows, each text to
unit length, and a linear model is fitted for hinge loss by dual coordinate descent.  Margins of rows kept
back from the fit give Platt's two parameters, so a score is a probability.

Bound: ``TRAIN_ROWS`` labelled rows of each class at most.

Defined results: a null or empty text has no feature and gets the score of margin 0.  Rows with a null
id are scored, with a null id, not held out.  Repeated rows are scored alike.  Without labels of both
classes all scores are 1, so nothing is rejected.  Other columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_chunks
from .bytehash import U, mix, word_hashes, word_spans
from .supervised import as_buffer, held_out, training_rows

TRAIN_ROWS = 6000
BITS = 20
RESULT = "doc_id long, score double, predicted int"


def features(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs in order of texts."""
    first, last, text = word_spans(buf, starts)
    n = len(first)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = word_hashes(buf, first, last)
    size = last - first
    end, head = buf[last - 1].astype(np.uint64), buf[first].astype(np.uint64)
    letter = lambda b: ((b | U(32)) >= U(97)) & ((b | U(32)) <= U(122)) | (b >= U(128))
    kind = np.where(letter(end), U(0), end)
    upper = (head >= U(65)) & (head <= U(90))
    second = buf[np.minimum(first + 1, len(buf) - 1)].astype(np.uint64)
    loud = upper & (size > 1) & (second >= U(65)) & (second <= U(90))
    before = np.zeros(n, bool)
    before[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    place = np.arange(n)
    run = place - np.maximum.accumulate(np.where(before, 0, place)) + 1
    shape = mix(kind | upper.astype(np.uint64) << U(8) | loud.astype(np.uint64) << U(9) | np.minimum(size, 12).astype(np.uint64) << U(10))
    coarse = mix(kind | loud.astype(np.uint64) << U(9) | (letter(head)).astype(np.uint64) << U(10))
    tail = mix(buf[last - 1].astype(np.uint64) | buf[np.maximum(last - 2, first)].astype(np.uint64) << U(8) | buf[np.maximum(last - 3, first)].astype(np.uint64) << U(16) | U(1 << 40))
    near = text[1:] == text[:-1]
    parts = [
        (text, words),
        (text[1:][near], mix(words[:-1] * U(3) + words[1:])[near]),
        (text, tail),
        (text, shape),
        (text[1:][near], mix(coarse[:-1] * U(5) + coarse[1:])[near]),
        (text[1:][near], mix(shape[:-1] * U(7) + shape[1:])[near]),
        (text, mix(np.minimum(run, 16).astype(np.uint64) + U(1 << 50))),
    ]
    key = np.concatenate([(t.astype(np.uint64) << U(BITS)) | (h >> U(64 - BITS)) for t, h in parts])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> U(BITS)).astype(np.int64), (key & U((1 << BITS) - 1)).astype(np.int64)


def margins(buf: np.ndarray, starts: np.ndarray, weights: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    n = len(starts) - 1
    text, feature = features(buf, starts)
    length = np.sqrt(np.bincount(text, ratios[feature].astype(np.float64) ** 2, minlength=n))
    return np.bincount(text, weights[feature], minlength=n) / np.maximum(length, 1e-12)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dim: int, cost: float = 1.0, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of the linear hinge-loss model, one dual variable at a time; y: 1 or -1; a bias is feature dim - 1."""
    w = np.zeros(dim)
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            step = 1 - y[i] * float(w[rows[i]] @ values[i])
            new = min(max(alpha[i] + step / norm[i], 0.0), cost)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits margins to labels, by Newton's method."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margin**2).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-7:
            break
    return a, b


def fit(texts: list[str], y: np.ndarray) -> dict | None:
    """The model: weights times ratios by feature, ratios, offset and Platt's parameters; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    dim = 1 << BITS
    parts = []
    for lo in range(0, len(texts), 512):
        t, f = features(*as_buffer(texts[lo : lo + 512]))
        cuts = np.searchsorted(t, np.arange(min(512, len(texts) - lo) + 1))
        parts += [f[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    back = np.arange(len(texts)) % 5 == 4

    def model(use: np.ndarray):
        counts = []
        for c in (1, 0):
            own = [parts[i] for i in np.flatnonzero(use & (y == c))]
            seen = np.bincount(np.concatenate(own), minlength=dim) + 1.0 if own else np.ones(dim)
            counts.append(np.log(seen / (len(own) + 2)))
        ratios = counts[0] - counts[1]
        rows, values = [], []
        for i in np.flatnonzero(use):
            v = ratios[parts[i]]
            rows.append(np.append(parts[i], dim))
            values.append(np.append(v / max(np.sqrt(v @ v), 1e-12), 1.0))
        w = dual_descent(rows, values, np.where(y[use] == 1, 1.0, -1.0), dim + 1)
        return ratios, w[:dim] * ratios, w[dim]

    def margin(parts_, ratios, weights, offset):
        return np.array([weights[f].sum() / max(np.sqrt((ratios[f] ** 2).sum()), 1e-12) + offset for f in parts_])

    ratios, weights, offset = model(~back)
    a, b = platt(margin([parts[i] for i in np.flatnonzero(back)], ratios, weights, offset), y[back].astype(float)) if len(set(y[back].tolist())) == 2 else (4.0, 0.0)
    ratios, weights, offset = model(np.ones(len(texts), bool))
    return {"ratios": ratios.astype(np.float32), "weights": weights.astype(np.float32), "offset": offset, "a": a, "b": b}


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier) and predicted (1 from the threshold on)."""
    rows = training_rows(docs, labels, label, train_rows, id_col, text_col)
    model = fit(rows["text"].tolist(), rows["y"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 2**BITS numbers
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for keys, buf, starts in text_chunks(batches):
            if m is None:
                p = np.ones(len(keys))
            else:
                z = m["a"] * (margins(buf, starts, m["weights"], m["ratios"]) + m["offset"]) + m["b"]
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema=schema)

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, RESULT)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
