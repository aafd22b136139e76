"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

Symbols are the frequent words and the bands of rarer ones. The next symbol's class is predicted first (softmax over the
classes), then, for classes of frequent words, the word in its class. Documents run side by side, longest first, so that
the ones still going are always the first rows; the hidden state goes from window to window to the end of the document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Hidden units, steps of a window.
HIDDEN, WINDOW = 16, 48
#: States whose softmax is computed together.
SOFTMAX_ROWS = 8192
#: Documents that run side by side in training and scoring.
TRAIN_ROWS, SCORE_ROWS = 384, 4096
#: In training, a long document is learnt as segments of so many steps next to each other, each from an empty state.
SEGMENT = 960
LEARNING_RATE, CLIP = 0.01, 5.0


class Shape:
    """How symbols fall into classes: ``top`` words by frequency, as many classes as words in one; a class for each band."""

    def __init__(self, top: int, bands: int):
        self.top, self.bands = top, bands
        self.class_words = max(math.isqrt(max(top - 1, 0)) + 1, 1)
        self.word_classes = -(-top // self.class_words)
        self.classes, self.symbols = self.word_classes + bands, top + bands
        names = {
            "x": (self.symbols, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "bu": (3 * HIDDEN,),
            "c": (HIDDEN, self.classes), "bc": (self.classes,),
            "w": (self.word_classes, HIDDEN, self.class_words), "bw": (self.word_classes, self.class_words),
        }
        self.names, self.size, self.places = names, 0, {}
        for name, dims in names.items():
            n = int(np.prod(dims))
            self.places[name] = slice(self.size, self.size + n)
            self.size += n

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {k: flat[self.places[k]].reshape(dims) for k, dims in self.names.items()}

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.top, symbols // self.class_words, symbols - self.top + self.word_classes)

    def start(self, counts: np.ndarray) -> np.ndarray:
        """First weights: small seeded numbers, and biases that give the symbols' frequencies."""
        flat = np.random.Generator(np.random.PCG64(7)).normal(0, 0.1, self.size).astype(np.float32)
        v = self.views(flat)
        v["bu"][:] = 0
        v["bu"][HIDDEN : 2 * HIDDEN] = 1.0  # keep the state at first
        v["c"][:] *= 0.1
        v["w"][:] *= 0.1
        counts = counts.astype(np.float64) + 0.5
        per_class = np.bincount(self.class_of(np.arange(self.symbols)), counts, self.classes)
        v["bc"][:] = np.log(per_class / per_class.sum())
        v["bw"][:] = -30.0
        k = np.arange(self.top)
        v["bw"][k // self.class_words, k % self.class_words] = np.log(counts[: self.top] / per_class[k // self.class_words])
        return flat


def segments(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all documents' segments."""
    n = -(-lengths // SEGMENT)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(starts, n) + nth * SEGMENT
    return first, np.minimum(np.repeat(lengths, n) - nth * SEGMENT, SEGMENT)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _windows(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Symbols step by step, in windows; documents are longest first, and a step holds those that have it."""
    ends = -lengths
    for at in range(0, int(lengths[0]) if len(lengths) else 0, WINDOW):
        steps = []
        for t in range(at, min(at + WINDOW, int(lengths[0]))):
            n = int(np.searchsorted(ends, -t, side="left"))
            steps.append(symbols[starts[:n] + t])
        yield steps


def _run(v: dict[str, np.ndarray], h: np.ndarray, steps: list[np.ndarray], keep: bool):
    """States before each step, in one array; with ``keep``, also what backpropagation needs."""
    before, kept = [], []
    for s in steps:
        n = len(s)
        old = h[:n]
        before.append(old.copy())
        x = v["x"][s]
        g = old @ v["u"]
        g += v["bu"]
        rz = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        cand = r * g[:, 2 * HIDDEN :]
        cand += x[:, 2 * HIDDEN :]
        np.tanh(cand, out=cand)
        if keep:
            kept.append((rz, cand, g[:, 2 * HIDDEN :].copy()))
        h[:n] = cand + z * (old - cand)
    return before, kept


def _log_p(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each row's target; ``x`` is spent."""
    x -= x.max(axis=1, keepdims=True)
    found = x[np.arange(len(x)), target]
    return found - np.log(np.exp(x, out=x).sum(axis=1))


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def score(shape: Shape, flat: np.ndarray, offsets: np.ndarray, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-probability of every document's symbols; ``offsets`` are added to the class logits."""
    v = shape.views(flat)
    out = np.zeros(len(starts))
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), SCORE_ROWS):
        rows = order[at : at + SCORE_ROWS]
        h = np.zeros((len(rows), HIDDEN), np.float32)
        for steps in _windows(symbols, starts[rows], lengths[rows]):
            before, _ = _run(v, h, steps, False)
            states, target = np.concatenate(before), np.concatenate(steps)
            owner = np.concatenate([np.arange(len(s)) for s in steps])
            kind = shape.class_of(target)
            logp = np.empty(len(kind))
            for k in range(0, len(kind), SOFTMAX_ROWS):
                part = slice(k, k + SOFTMAX_ROWS)
                logp[part] = _log_p(states[part] @ v["c"] + (v["bc"] + offsets), kind[part])
            by_class = np.argsort(kind, kind="stable")
            edges = np.searchsorted(kind[by_class], np.arange(shape.word_classes + 1))
            for k in range(shape.word_classes):
                pick = by_class[edges[k] : edges[k + 1]]
                if len(pick):
                    logp[pick] += _log_p(states[pick] @ v["w"][k] + v["bw"][k], target[pick] % shape.class_words)
            out[rows] += np.bincount(owner, logp, len(rows))
    return out


def _gradient(shape: Shape, v: dict, g: dict, h: np.ndarray, steps: list[np.ndarray]) -> None:
    """Adds the window's gradient to ``g`` and moves the state ``h`` on."""
    before, kept = _run(v, h, steps, True)
    states, target = np.concatenate(before), np.concatenate(steps)
    n = len(target)
    kind = shape.class_of(target)
    d_states = np.empty_like(states)
    for k in range(0, n, SOFTMAX_ROWS):
        part = slice(k, k + SOFTMAX_ROWS)
        p = _softmax(states[part] @ v["c"] + v["bc"])
        p[np.arange(len(p)), kind[part]] -= 1
        g["c"] += states[part].T @ p
        g["bc"] += p.sum(axis=0)
        d_states[part] = p @ v["c"].T
    by_class = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[by_class], np.arange(shape.word_classes + 1))
    for k in range(shape.word_classes):
        pick = by_class[edges[k] : edges[k + 1]]
        if len(pick):
            q = _softmax(states[pick] @ v["w"][k] + v["bw"][k])
            q[np.arange(len(pick)), target[pick] % shape.class_words] -= 1
            g["w"][k] += states[pick].T @ q
            g["bw"][k] += q.sum(axis=0)
            d_states[pick] += q @ v["w"][k].T
    ends = np.cumsum([len(s) for s in steps])
    d_h = np.zeros_like(h)
    d_x = np.empty((n, 3 * HIDDEN), np.float32)
    d_g = np.empty((n, 3 * HIDDEN), np.float32)
    for t in range(len(steps) - 1, -1, -1):
        m = len(steps[t])
        part = slice(ends[t] - m, ends[t])
        old, (rz, cand, un) = before[t], kept[t]
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        d = d_h[:m]
        d_cand = d * (1 - z) * (1 - cand * cand)
        d_x[part, 2 * HIDDEN :] = d_cand
        d_x[part, :HIDDEN] = d_cand * un * r * (1 - r)
        d_x[part, HIDDEN : 2 * HIDDEN] = d * (old - cand) * z * (1 - z)
        d_g[part] = d_x[part]
        d_g[part, 2 * HIDDEN :] *= r
        d_h[:m] = d * z + d_g[part] @ v["u"].T + d_states[part]
    g["u"] += states.T @ d_g
    g["bu"] += d_g.sum(axis=0)
    order = np.argsort(target, kind="stable")
    seen, first = np.unique(target[order], return_index=True)
    g["x"][seen] += np.add.reduceat(d_x[order], first, axis=0)


def train(shape: Shape, flat: np.ndarray, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One pass over the documents from the given weights: Adam on truncated windows; returns the new weights."""
    flat = flat.copy()
    v, moment, square, turn = shape.views(flat), np.zeros_like(flat), np.zeros_like(flat), 0
    order = np.argsort(-lengths, kind="stable")
    together = min(TRAIN_ROWS, max(len(order) // 5, 16))  # few documents make some steps too
    for at in range(0, len(order), together):
        rows = order[at : at + together]
        h = np.zeros((len(rows), HIDDEN), np.float32)
        for steps in _windows(symbols, starts[rows], lengths[rows]):
            grad = np.zeros_like(flat)
            _gradient(shape, v, shape.views(grad), h, steps)
            grad /= sum(map(len, steps))
            norm = float(np.sqrt((grad * grad).sum()))
            if norm > CLIP:
                grad *= CLIP / norm
            turn += 1
            moment += 0.1 * (grad - moment)
            square += 0.01 * (grad * grad - square)
            flat -= LEARNING_RATE * (moment / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-6)
    return flat
