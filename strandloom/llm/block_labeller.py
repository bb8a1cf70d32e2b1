"""A bidirectional LSTM over the blocks of a page, in numpy.

A block is a vector: the sum of the vectors of its hashed path elements (tags, and words
of class, id and role), the mean vector of its hashed words, and four plain
numbers. One LSTM reads the page's blocks forwards, one backwards, and a
logistic layer over both states says how likely each block is main text, so every
block is judged in the context of the whole page.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np

PATH_SLOTS, WORD_SLOTS = 2048, 1024
PATH_DIM, WORD_DIM, PLAIN, HIDDEN = 24, 8, 4, 16
INPUT = PATH_DIM + WORD_DIM + PLAIN
#: Padded cells that one pass handles.
CELLS = 60_000


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def path_codes(block: Block) -> list[int]:
    return [zlib.crc32(p.encode()) % PATH_SLOTS for p in block.path]


def word_codes(block: Block) -> list[int]:
    return [zlib.crc32(w.encode("utf-8", "replace")) % WORD_SLOTS for w in block.text.split()]


def plain(block: Block) -> list[float]:
    n = len(block.text)
    return [np.log1p(n) / 5, block.linked / max(n, 1), (block.text.count(".") + block.text.count(",")) * 10 / max(n, 1), 1.0]


class Page:
    """The codes of a page's blocks, flat, with owners."""

    def __init__(self, blocks: list[Block]):
        self.n = len(blocks)
        paths, words = [path_codes(b) for b in blocks], [word_codes(b) for b in blocks]
        self.path, self.path_of = self._flat(paths)
        self.word, self.word_of = self._flat(words)
        self.words = np.array([max(1, len(w)) for w in words], np.float32)
        self.plain = np.array([plain(b) for b in blocks], np.float32).reshape(-1, PLAIN)

    @staticmethod
    def _flat(lists):
        sizes = [len(x) for x in lists]
        return np.fromiter((i for x in lists for i in x), np.int64, sum(sizes)), np.repeat(np.arange(len(lists)), sizes)


def fresh_weights(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"path": rng.normal(0, 0.2, (PATH_SLOTS, PATH_DIM)), "word": rng.normal(0, 0.05, (WORD_SLOTS, WORD_DIM)), "out": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
    for side in ("f", "b"):
        w[f"x{side}"] = rng.normal(0, 0.3, (INPUT, 4 * HIDDEN))
        w[f"h{side}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        w[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])  # forget gates start open
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def inputs(pages: list[Page], w) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, input) vectors and their mask."""
    longest = max(p.n for p in pages)
    x = np.zeros((longest, len(pages), INPUT), np.float32)
    mask = np.zeros((longest, len(pages), 1), np.float32)
    for j, p in enumerate(pages):
        own = np.zeros((p.n, INPUT), np.float32)
        np.add.at(own[:, :PATH_DIM], p.path_of, w["path"][p.path])
        if len(p.word):
            sums = np.concatenate([np.zeros((1, WORD_DIM), np.float32), np.cumsum(w["word"][p.word], 0, dtype=np.float64).astype(np.float32)])
            ends = np.cumsum(np.bincount(p.word_of, minlength=p.n))
            own[:, PATH_DIM : PATH_DIM + WORD_DIM] = (sums[ends] - sums[np.append(0, ends[:-1])]) / p.words[:, None]
        own[:, -PLAIN:] = p.plain
        x[: p.n, j], mask[: p.n, j] = own, 1
    return x, mask


def _forward(x, mask, w, side, steps, trace=None):
    gates_x = x @ w[f"x{side}"] + w[f"c{side}"]
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    c = np.zeros_like(h)
    out = np.zeros((len(x), x.shape[1], HIDDEN), np.float32)
    for t in steps:
        z = gates_x[t] + h @ w[f"h{side}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
        g = np.tanh(z[:, 3 * HIDDEN :])
        new_c = f * c + i * g
        th = np.tanh(new_c)
        m = mask[t]
        if trace is not None:
            trace.append((t, h, c, i, f, o, g, th))
        c, h = m * new_c + (1 - m) * c, m * o * th + (1 - m) * h
        out[t] = h
    return out


def _backward(x, mask, w, side, trace, d_out, grads):
    dh, dc = (np.zeros((x.shape[1], HIDDEN), np.float32) for _ in range(2))
    d_gates = np.zeros((len(x), x.shape[1], 4 * HIDDEN), np.float32)
    for t, h, c, i, f, o, g, th in reversed(trace):
        m = mask[t]
        dh = dh + d_out[t]
        live_h, live_c = m * dh, m * dc
        d_cell = live_c + live_h * o * (1 - th**2)
        dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), live_h * th * o * (1 - o), d_cell * i * (1 - g**2)], 1)
        d_gates[t] = dz
        grads[f"h{side}"] += h.T @ dz
        dh = (1 - m) * dh + dz @ w[f"h{side}"].T
        dc = (1 - m) * dc + d_cell * f
    grads[f"x{side}"] += np.tensordot(x, d_gates, ((0, 1), (0, 1)))
    grads[f"c{side}"] += d_gates.sum((0, 1))
    return d_gates @ w[f"x{side}"].T


def scores(pages: list[Page], w) -> list[np.ndarray]:
    """How likely each block of each page is main text."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i].n), key=lambda i: pages[i].n)
    while order:
        count = max(1, min(len(order), CELLS // pages[order[-1]].n))  # the longest go together
        part, order = order[-count:], order[:-count]
        x, mask = inputs([pages[i] for i in part], w)
        states = np.concatenate([_forward(x, mask, w, "f", range(len(x))), _forward(x, mask, w, "b", range(len(x) - 1, -1, -1))], 2)
        p = _sigmoid(states @ w["out"] + w["bias"])[:, :, 0]
        for j, i in enumerate(part):
            out[i] = p[: pages[i].n, j]
    return out


def gradients(pages: list[Page], labels: list[np.ndarray], w) -> tuple[float, dict[str, np.ndarray]]:
    x, mask = inputs(pages, w)
    y = np.zeros(mask.shape, np.float32)
    for j, own in enumerate(labels):
        y[: len(own), j, 0] = own
    traces: dict[str, list] = {"f": [], "b": []}
    both = [_forward(x, mask, w, "f", range(len(x)), traces["f"]), _forward(x, mask, w, "b", range(len(x) - 1, -1, -1), traces["b"])]
    states = np.concatenate(both, 2)
    p = _sigmoid(states @ w["out"] + w["bias"])
    total = mask.sum()
    loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    dz = mask * (p - y) / total
    grads["out"] += np.tensordot(states, dz, ((0, 1), (0, 1)))
    grads["bias"] += dz.sum((0, 1))
    d_states = dz @ w["out"].T
    dx = _backward(x, mask, w, "f", traces["f"], d_states[:, :, :HIDDEN], grads) + _backward(x, mask, w, "b", traces["b"], d_states[:, :, HIDDEN:], grads)
    for j, page in enumerate(pages):
        np.add.at(grads["path"], page.path, dx[page.path_of, j, :PATH_DIM])
        np.add.at(grads["word"], page.word, dx[page.word_of, j, PATH_DIM : PATH_DIM + WORD_DIM] / page.words[page.word_of, None])
    return loss, grads


def trained(pages: list[Page], labels: list[np.ndarray], steps: int = 150, batch: int = 32, rate: float = 0.01, seed: int = 11) -> dict[str, np.ndarray]:
    """Some ``steps`` of Adam over shuffled batches, however many pages there are; the same pages give the same weights."""
    w, rng = fresh_weights(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    own = [i for i in range(len(pages)) if pages[i].n]
    while own and step < steps:
        rng.shuffle(own)
        for lo in range(0, len(own), batch):
            part = own[lo : lo + batch]
            _, grads = gradients([pages[i] for i in part], [labels[i] for i in part], w)
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w
