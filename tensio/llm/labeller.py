"""A bidirectional LSTM in numpy that labels every block of a page as main text or not.

A block's input is its tag path (hashed names of the open elements), its words (a hashed bag)
and a few measures.  Both directions read the whole page, so each label depends on all
blocks around it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from tensio.llm import words as W
from tensio.llm.html_blocks import Block, Path

PATH = 512
WORDS = 32
MEASURES = 6
WIDTH = PATH + WORDS + MEASURES
HIDDEN = 20


def _marks(names: set[str]) -> int:
    """Two places for each name, so that no name shares all of its places by chance, as bits."""
    out = 0
    for n in names:
        code = zlib.crc32(n.encode())
        out |= 1 << code % PATH | 1 << code // PATH % PATH
    return out


def _element_names(element: tuple[str, ...]) -> set[str]:
    return {element[0], *("." + w for w in element[1:])}


def _path_features(path: Path | tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Hashed names: every open element's tag and name words, the innermost once more as such."""
    marks = 0
    if isinstance(path, Path):
        node, new = path, []
        while node is not None and node.marks is None:
            new.append(node)
            node = node.parent
        for n in reversed(new):  # each element is hashed once, however many paths lead through it
            n.marks = _marks(_element_names(n.element)) | (n.parent.marks if n.parent else 0)
        marks = path.marks
    else:
        for element in path:
            marks |= _marks(_element_names(element))
    if len(path):
        last = path.element if isinstance(path, Path) else path[-1]
        marks |= _marks({"^" + n for n in last})
    bits = np.frombuffer(marks.to_bytes(-(-PATH // 8), "little"), np.uint8)
    return np.unpackbits(bits, count=PATH, bitorder="little").astype(np.float32)


def features(pages: list[list[Block]], cache: dict) -> np.ndarray:
    """One row per block of all pages; ``cache`` keeps the features of paths met before."""
    n = sum(map(len, pages))
    out = np.zeros((n, WIDTH), np.float32)
    flat = [b for page in pages for b in page]
    if not flat:
        return out
    if len(cache) > 20_000:
        cache.clear()
    for i, b in enumerate(flat):
        row = cache.get(b.path)
        if row is None:
            row = cache[b.path] = _path_features(b.path)
        out[i, :PATH] = row
    raw = [b.text.encode("utf-8", "replace") for b in flat]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    w = W.split(np.frombuffer(b"".join(raw), np.uint8), offsets, lower=True)
    bucket = (w.hashes() >> np.uint64(59)).astype(np.int64)
    bag = np.bincount(w.doc * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
    out[:, PATH : PATH + WORDS] = bag / np.maximum(w.counts, 1)[:, None]
    chars = np.array([len(b.text) for b in flat])
    tail = out[:, PATH + WORDS :]
    tail[:, 0] = np.log1p(w.counts) / 5
    tail[:, 1] = np.array([b.link_chars for b in flat]) / np.maximum(chars, 1)
    tail[:, 2] = chars / np.maximum(w.counts, 1) / 10
    tail[:, 3] = np.array([b.text[-1] in ".!?…" for b in flat])
    tail[:, 4] = np.array([len(b.path) for b in flat]) / 10
    tail[:, 5] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Pass:
    """What the backward step needs of one direction."""

    h: np.ndarray
    c: np.ndarray
    gates: np.ndarray


def _read(z: np.ndarray, wh: np.ndarray) -> Pass:
    """Run one direction over ``z (steps, pages, 4 * hidden)``."""
    steps, pages, wide = z.shape
    k = wide // 4
    h, c, gates = np.zeros((steps + 1, pages, k), np.float32), np.zeros((steps + 1, pages, k), np.float32), np.zeros_like(z)
    for t in range(steps):
        a = z[t] + h[t] @ wh
        gates[t, :, : 3 * k] = _sigmoid(a[:, : 3 * k])
        gates[t, :, 3 * k :] = np.tanh(a[:, 3 * k :])
        i, f, o, g = (gates[t, :, j * k : (j + 1) * k] for j in range(4))
        c[t + 1] = f * c[t] + i * g
        h[t + 1] = o * np.tanh(c[t + 1])
    return Pass(h, c, gates)


def _read_back(p: Pass, wh: np.ndarray, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of ``wh``."""
    steps, pages, k = dh_out.shape
    dz, dwh = np.zeros_like(p.gates), np.zeros_like(wh)
    dh, dc = np.zeros((pages, k), np.float32), np.zeros((pages, k), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (p.gates[t, :, j * k : (j + 1) * k] for j in range(4))
        dh = dh + dh_out[t]
        tc = np.tanh(p.c[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * p.c[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dwh += p.h[t].T @ dz[t]
        dh, dc = dz[t] @ wh.T, dc * f
    return dz, dwh


def _grid(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the flat blocks at each (step, page), read forward and backward, and which are real."""
    steps = int(sizes.max())
    first = np.cumsum(sizes) - sizes
    t = np.arange(steps)[:, None]
    real = t < sizes
    forward = np.where(real, first + t, 0)
    backward = np.where(real, first + sizes - 1 - t, 0)
    return forward, backward, real


def blank(seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters before training."""
    rng = np.random.default_rng(seed)
    k = HIDDEN
    out = {}
    for d in ("f", "b"):
        out["x" + d] = rng.normal(0, 0.15, (WIDTH, 4 * k)).astype(np.float32)
        out["h" + d] = rng.normal(0, 0.15, (k, 4 * k)).astype(np.float32)
        out["n" + d] = np.concatenate([np.zeros(k), np.ones(k), np.zeros(2 * k)]).astype(np.float32)
    out["w"] = rng.normal(0, 0.15, 2 * k).astype(np.float32)
    out["s"] = np.zeros(WIDTH, np.float32)  # the block's own features also reach its label directly
    out["o"] = np.zeros(1, np.float32)
    return out


def _forward(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray):
    grids = _grid(sizes)
    passes = []
    for d, rows in zip("fb", grids, strict=False):
        z = x @ p["x" + d] + p["n" + d]
        passes.append(_read(z[rows], p["h" + d]))
    both = np.zeros((len(x), 2 * HIDDEN), np.float32)
    real = grids[2]
    for j, rows in enumerate(grids[:2]):
        both[rows[real], j * HIDDEN : (j + 1) * HIDDEN] = passes[j].h[1:][real]
    return _sigmoid(both @ p["w"] + x @ p["s"] + p["o"]), both, passes, grids


def predict(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, together: int = 256) -> np.ndarray:
    """Probability of each block; pages of like length are read together."""
    out = np.zeros(len(x), np.float32)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and stop - start < together and (stop - start + 1) * int(sizes[order[stop]]) <= 16_384:
            stop += 1
        pages = order[start:stop]
        n = sizes[pages]
        rows = np.repeat(first[pages] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[rows] = _forward(p, x[rows], n)[0]
        start = stop
    return out


def train(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, steps: int = 640, batch: int = 32, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Fit by back-propagation through time (Adam, cross-entropy over all blocks)."""
    p = blank(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    first = np.cumsum(sizes) - sizes
    filled = np.flatnonzero(sizes > 0)
    rng, step = np.random.default_rng(seed), 0
    rounds = min(-(-steps * batch // max(len(filled), 1)), 200)  # about as many steps on a small table
    for r in range(rounds):
        # Pages of like length share a batch; batches come in a random order.
        order = filled[np.argsort(sizes[filled] + rng.random(len(filled)), kind="stable")]
        starts = np.arange(0, len(order), batch)
        for s in rng.permutation(starts):
            pages = order[s : s + batch]
            n = sizes[pages]
            rows = np.repeat(first[pages] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            xs, ys = x[rows], y[rows]
            prob, both, passes, grids = _forward(p, xs, n)
            d = (prob - ys) / len(ys)
            grad = {"w": both.T @ d, "s": xs.T @ d, "o": np.array([d.sum()], np.float32)}
            dboth = d[:, None] * p["w"]
            real = grids[2]
            for j, name in enumerate("fb"):
                dh = np.zeros((*real.shape, HIDDEN), np.float32)
                dh[real] = dboth[grids[j][real], j * HIDDEN : (j + 1) * HIDDEN]
                dz, dwh = _read_back(passes[j], p["h" + name], dh)
                flat = np.zeros((len(xs), 4 * HIDDEN), np.float32)
                flat[grids[j][real]] = dz[real]
                grad["x" + name], grad["n" + name], grad["h" + name] = xs.T @ flat, flat.sum(axis=0), dwh
            step += 1
            now = rate * (0.5 if r >= rounds // 2 else 1.0) * (0.4 if r >= 3 * rounds // 4 else 1.0)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p[k] = p[k] - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}
