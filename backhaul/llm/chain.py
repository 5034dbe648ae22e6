"""A linear-chain conditional random field with two labels, over many sequences at once.

Scores of label 1 are relative to label 0. Sequences lie one after another in flat arrays; `first`
has the place of each one's first item and, at the end, the number of items.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    weights: np.ndarray  # of features, for label 1
    moves: np.ndarray  # 2 x 2, from label to label


def _steps(first: np.ndarray):
    """For each position in turn, the items there and the number of sequences so long.

    Sequences come longest first, so that those still running are a prefix.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    running = len(length)
    for t in range(int(length[0]) if len(length) else 0):
        while running and length[running - 1] <= t:
            running -= 1
        yield t, begin[:running] + t, running


def viterbi(chain: Chain, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The likeliest label of each item; of equal paths the one with more 0s at the end."""
    score = features @ chain.weights
    out = np.zeros(len(score), np.int8)
    back = np.zeros((len(score), 2), np.int8)
    steps = list(_steps(first))
    best = np.zeros((0, 2))
    final = np.zeros((len(first) - 1, 2))
    for t, items, n in steps:
        if t == 0:
            now = np.zeros((n, 2))
        else:
            final[n : len(best)] = best[n:]
            paths = best[:n, :, None] + chain.moves
            back[items] = paths.argmax(1)
            now = paths.max(1)
        now[:, 1] += score[items]
        best = now
    final[: len(best)] = best
    label = np.zeros(len(final), np.int8)
    started = 0
    for _, items, n in reversed(steps):
        label[started:n] = final[started:n].argmax(1)  # sequences that end here
        started = n
        out[items] = label[:n]
        label[:n] = back[items, label[:n]]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def gradient(chain: Chain, features: np.ndarray, labels: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels and its gradient by forward-backward sums."""
    emit = np.zeros((len(labels), 2))
    emit[:, 1] = features @ chain.weights
    steps = list(_steps(first))
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    for t, items, _ in steps:
        forward[items] = emit[items]
        if t:
            forward[items] += _log_sum(forward[items - 1][:, :, None] + chain.moves, 1)
    for t, items, _ in reversed(steps):
        if t:
            backward[items - 1] = _log_sum(chain.moves + (emit[items] + backward[items])[:, None, :], 2)
    size = np.diff(first)
    inner = np.ones(len(labels), bool)
    inner[first[:-1][size > 0]] = False
    at = np.flatnonzero(inner)
    seq = np.repeat(np.arange(len(size)), size)
    total = np.zeros(len(size))
    last = first[1:][size > 0] - 1
    total[size > 0] = _log_sum(forward[last], 1)
    share = np.exp(forward + backward - total[seq][:, None])[:, 1]
    pair = forward[at - 1][:, :, None] + chain.moves + (emit[at] + backward[at])[:, None, :]
    pair = np.exp(pair - total[seq[at]][:, None, None])
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    found = emit[np.arange(len(labels)), labels].sum() + (seen * chain.moves).sum()
    return found - total.sum(), features.T @ (labels - share), seen - pair.sum(0)


def fit(features: np.ndarray, labels: np.ndarray, first: np.ndarray, rounds: int = 80, rate: float = 0.25, decay: float = 1e-3) -> Chain:
    """Adam steps on the penalised mean log-likelihood; the same data give the same chain."""
    n = features.shape[1]
    x = np.zeros(n + 4)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        _, g, h = gradient(Chain(x[:n], x[n:].reshape(2, 2)), features, labels, first)
        step = np.concatenate([g, h.ravel()]) / max(1, len(labels)) - decay * x
        m, v = 0.9 * m + 0.1 * step, 0.99 * v + 0.01 * step**2
        x = x + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Chain(x[:n], x[n:].reshape(2, 2))
