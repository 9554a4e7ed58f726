"""The trained models against plain forward passes, numeric gradients, and the optimum of the hinge-loss problem."""

import math

import numpy as np

from sievework.llm import html_text, quality, toxicity
from sievework.llm.supervised import as_buffer

sig = lambda v: 1 / (1 + math.exp(-v))


def gru_model(rng):
    from sievework.llm.toxicity import EMBED, GRAM_BITS, HIDDEN, WORD_BITS

    draw = lambda *s: (0.4 * rng.standard_normal(s)).astype(np.float32)
    width = 2 * EMBED + 2
    return {"word": draw(1 << WORD_BITS, EMBED), "gram": draw(1 << GRAM_BITS, EMBED), "word_odds": draw(1 << WORD_BITS), "gram_odds": draw(1 << GRAM_BITS), "wx": [draw(width, 3 * HIDDEN) for _ in range(2)], "bx": [draw(3 * HIDDEN) for _ in range(2)], "u": [draw(HIDDEN, 3 * HIDDEN) for _ in range(2)], "va": draw(2 * HIDDEN, HIDDEN), "vb": draw(HIDDEN), "w": draw(2 * HIDDEN), "b": np.float32(0.1)}


def plain_gru(m, x, places):
    """Logit of one window: places of its words in x, -1 behind its end."""
    h_size = toxicity.HIDDEN
    states = np.zeros((len(places), 2 * h_size))
    for way in range(2):
        h = np.zeros(h_size)
        for t in range(len(places)) if way == 0 else reversed(range(len(places))):
            if places[t] >= 0:
                g = x[places[t]] @ m["wx"][way] + m["bx"][way]
                u = m["u"][way]
                z = np.array([sig(v) for v in g[:h_size] + h @ u[:, :h_size]])
                r = np.array([sig(v) for v in g[h_size : 2 * h_size] + h @ u[:, h_size : 2 * h_size]])
                c = np.tanh(g[2 * h_size :] + (r * h) @ u[:, 2 * h_size :])
                h = (1 - z) * h + z * c
            states[t, way * h_size : (way + 1) * h_size] = h
    real = [t for t in range(len(places)) if places[t] >= 0]
    score = [float(np.tanh(states[t] @ m["va"]) @ m["vb"]) for t in real]
    weight = np.exp(np.array(score) - max(score))
    return float((weight / weight.sum()) @ states[real] @ m["w"] + m["b"])


def windows_of(texts):
    w = toxicity.Words(*as_buffer(texts))
    return w, w.windows()[0]


def test_gru_forward_and_gradients():
    rng = np.random.default_rng(2)
    m = gru_model(rng)
    w, idx = windows_of(["one two three one", "a longer text of some more words than two", "x y"])
    x = toxicity.inputs(m, w)
    got = toxicity.run(m, toxicity.project(m, x), idx)
    assert np.allclose(got, [plain_gru(m, x, row) for row in idx], atol=1e-4)
    y = np.array([1.0, 0.0, 1.0], np.float32)

    def loss():
        z = np.array([plain_gru(m, toxicity.inputs(m, w).astype(np.float64), row) for row in idx])
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = toxicity.gradients(m, w, x, idx, y)
    for name in ("w", "va", "vb", "u", "wx", "bx", "word", "gram"):
        for way in range(2) if name in ("u", "wx", "bx") else [None]:
            value, grad = (m[name], g[name]) if way is None else (m[name][way], g[name][way])
            at = np.argsort(-np.abs(grad).ravel())[:4]  # where it is largest
            for k in map(int, at):
                place = np.unravel_index(k, value.shape)
                was, step = value[place], 1e-2
                value[place] = was + step
                up = loss()
                value[place] = was - step
                down = loss()
                value[place] = was
                assert abs((up - down) / (2 * step) - grad[place]) < 0.02 * abs(grad[place]) + 2e-4, (name, way, place)
    was, m["b"] = m["b"], np.float32(m["b"] + 1e-2)
    up, m["b"] = loss(), np.float32(was - 1e-2)
    assert abs((up - loss()) / 2e-2 - g["b"]) < 1e-3


def test_windows_overlap_and_cover_every_word():
    w, idx = windows_of([" ".join(f"w{k}" for k in range(500)), "short"])
    own = idx[:-1]
    assert (own[:-1, toxicity.STRIDE :] == own[1:, : toxicity.WINDOW - toxicity.STRIDE])[own[1:, : toxicity.WINDOW - toxicity.STRIDE] >= 0].all()
    assert set(own[own >= 0].tolist()) == set(w.number[w.text == 0].tolist())


def plain_lstm(x, mask, wx, wh, b):
    n = html_text.HIDDEN
    out = np.zeros((*x.shape[:2], n))
    for row in range(x.shape[1]):
        h, c = np.zeros(n), np.zeros(n)
        for t in range(len(x)):
            if mask[t, row]:
                g = x[t, row] @ wx + h @ wh + b
                i, f, o = (np.array([sig(v) for v in g[k * n : (k + 1) * n]]) for k in range(3))
                c = f * c + i * np.tanh(g[3 * n :])
                h = o * np.tanh(c)
            out[t, row] = h
    return out


def test_lstm_forward_and_gradients():
    rng = np.random.default_rng(4)
    n = html_text.HIDDEN
    x, mask = rng.standard_normal((5, 3, 6)), (np.arange(5)[:, None] < np.array([5, 3, 1])).astype(np.float32)
    wx, wh, b, d = (0.5 * rng.standard_normal(s) for s in ((6, 4 * n), (n, 4 * n), (4 * n,), (5, 3, n)))
    keep: list = []
    got = html_text.lstm(x, mask, wx, wh, b, keep)
    assert np.allclose(got, plain_lstm(x, mask, wx, wh, b), atol=1e-5)
    grads = html_text.lstm_back(d, x, wx, wh, keep)
    for value, grad in zip((x, wx, wh, b), grads, strict=True):
        for k in map(int, rng.choice(value.size, 12, replace=False)):
            place = np.unravel_index(k, value.shape)
            was, step = value[place], 1e-4
            value[place] = was + step
            up = (plain_lstm(x, mask, wx, wh, b) * d).sum()
            value[place] = was - step
            down = (plain_lstm(x, mask, wx, wh, b) * d).sum()
            value[place] = was
            assert abs((up - down) / (2 * step) - grad[place]) < 1e-3 * max(1, abs(grad[place]))


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(6)
    dim, n, cost = 12, 80, 1.0
    rows = [np.sort(rng.choice(dim - 1, 5, replace=False)) for _ in range(n)]
    values = [rng.standard_normal(5) for _ in range(n)]
    y = np.where(rng.random(n) < 0.5, 1.0, -1.0)
    rows, values = [np.append(r, dim - 1) for r in rows], [np.append(v, 1.0) for v in values]
    full = np.zeros((n, dim))
    for k, (r, v) in enumerate(zip(rows, values, strict=True)):
        full[k, r] = v
    primal = lambda w: 0.5 * w @ w + cost * np.maximum(0, 1 - y * (full @ w)).sum()
    # the dual by plain projected gradient, whose value bounds every primal value from below
    alpha, q = np.zeros(n), (full * y[:, None]) @ (full * y[:, None]).T
    rate = 1 / np.linalg.eigvalsh(q).max()
    for _ in range(40_000):
        alpha = np.clip(alpha + rate * (1 - q @ alpha), 0, cost)
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    w = quality.dual_descent(rows, values, y, dim, cost, rounds=400)
    assert dual <= primal(w) + 1e-9 and primal(w) - dual < 1e-3 * dual
    assert primal(quality.dual_descent(rows, values, y, dim, cost)) - dual < 0.02 * dual  # after the rounds that fit() makes


def test_quality_scales_by_log_count_ratios():
    texts = ["good calm words here"] * 30 + ["bad loud NOISE here"] * 30
    y = np.array([1] * 30 + [0] * 30)
    model = quality.fit(texts, y)
    _, f = quality.features(*as_buffer(["calm"]))
    _, g = quality.features(*as_buffer(["NOISE"]))
    only = lambda a, b: np.setdiff1d(a, b)
    assert (model["ratios"][only(f, g)] >= 0).all() and (model["ratios"][only(g, f)] <= 0).all()
    counted = np.log((30 + 1) / 32) - np.log(1 / 32)
    assert np.isclose(np.abs(model["ratios"]).max(), counted, atol=1e-4)
