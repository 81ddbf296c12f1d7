"""A bidirectional LSTM in numpy that labels the blocks of a page as article or not."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

from .common import word_hashes

PATH, WORD, MEASURES, HIDDEN = 512, 32, 8, 16
#: At most so many chains of elements are remembered from page to page.
CHAINS = 20_000


class Path:
    """A chain of open elements: one more (its tag, and words of its class and id) below `up`.

    Its vector hashes the tokens of the whole chain, or those in `known` if that is given
    at the root: a labeller knows nothing about names that it never saw. Chains form a
    tree, so a deep page holds each of its elements once.
    """

    __slots__ = ("up", "tokens", "depth", "below", "root", "size", "known", "_vector")

    def __init__(self, up: Path | None = None, tokens: tuple[str, ...] = (), known: frozenset[str] | None = None):
        self.up, self.tokens, self.below, self.size = up, tokens, {}, 0
        self.known = up.known if up else known
        self.depth = up.depth + 1 if up else 0
        self.root = up.root if up else self
        self._vector = None if up else np.zeros(PATH, np.float32)

    def child(self, tokens: tuple[str, ...]) -> Path:
        found = self.below.get(tokens)
        if found is None:
            found = Path(self, tokens)
            if self.root.size < CHAINS:
                self.below[tokens] = found
                self.root.size += 1
        return found

    def vector(self) -> np.ndarray:
        if self._vector is None:
            chain = [self]
            while chain[-1].up._vector is None:
                chain.append(chain[-1].up)
            out = chain[-1].up._vector.copy()
            for node in reversed(chain):
                if node is self:
                    self.up._vector = out.copy() if self.up._vector is None else self.up._vector
                for token in node.tokens:
                    if self.known is not None and token not in self.known:
                        continue
                    h = zlib.crc32(token.encode())
                    out[h % PATH] += 1.0 if h & 1 << 20 else -1.0
            self._vector = out
        return self._vector


@dataclass(frozen=True)
class Block:
    """A leaf: its text, the open elements around it, characters in links."""

    text: str
    path: Path
    linked: int = 0


@dataclass(frozen=True)
class Features:
    """Of a page's blocks: the paths, and a row each of hashed words and measures."""

    paths: list[Path]
    small: np.ndarray

    def __len__(self) -> int:
        return len(self.paths)


def features(pages: list[list[Block]]) -> list[Features]:
    blocks = [b for page in pages for b in page]
    small = np.zeros((len(blocks), WORD + MEASURES), np.float32)
    if blocks:
        raw = [b.text.encode() for b in blocks]
        offsets = np.cumsum([0, *map(len, raw)])
        hashes, bounds = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
        n = np.diff(bounds)
        slots = np.repeat(np.arange(len(blocks)) * WORD, n) + (hashes % np.uint64(WORD)).astype(np.int64)
        small[:, :WORD] = np.bincount(slots, minlength=len(blocks) * WORD).reshape(-1, WORD) / (1 + n)[:, None]
        chars = np.array([len(b.text) for b in blocks])
        marks = np.array([sum(map(b.text.count, ".,;:")) for b in blocks])
        place = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages])
        measures = (np.log1p(chars) / 8, np.log1p(n) / 6, [b.linked for b in blocks] / np.maximum(1, chars), marks / np.maximum(1, n), [b.text[-1:] in ".!?" for b in blocks], np.log1p([b.path.depth for b in blocks]) / 3, place, np.ones(len(blocks)))
        small[:, WORD:] = np.stack(measures, 1)
    ends = np.cumsum([len(p) for p in pages])
    return [Features([b.path for b in page], small[end - len(page) : end]) for page, end in zip(pages, ends, strict=True)]


def common_tokens(pages: list[list[Block]], least: int) -> frozenset[str]:
    """Tokens of paths that at least so many pages have."""
    counts: Counter[str] = Counter()
    for page in pages:
        own: set[str] = set()
        done: set[int] = set()
        for b in page:
            node = b.path
            while node.up and id(node) not in done:
                done.add(id(node))
                own.update(node.tokens)
                node = node.up
        counts.update(own)
    return frozenset(t for t, n in counts.items() if n >= least)


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of both directions: of paths, of small features, of hidden states, and of the output."""
    random = np.random.default_rng(seed)
    draw = lambda fan, *shape: (random.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
    wide = PATH + WORD + MEASURES
    return {
        "P": draw(wide, 2, PATH, 4 * HIDDEN),
        "S": draw(wide, 2, WORD + MEASURES, 4 * HIDDEN),
        "U": draw(HIDDEN, 2, HIDDEN, 4 * HIDDEN),
        "c": np.zeros((2, 1, 4 * HIDDEN), np.float32),
        "V": draw(2 * HIDDEN, 2 * HIDDEN, 1),
        "v": np.zeros(1, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Batch:
    """Pages side by side: their blocks in rows, and in a grid of (step, page) for either direction."""

    def __init__(self, pages: list[Features]):
        known: dict[int, int] = {}
        places = [known.setdefault(id(p), len(known)) for page in pages for p in page.paths]
        self.places = np.array(places, np.int64)
        first = np.unique(self.places, return_index=True)[1]
        flat = [p for page in pages for p in page.paths]
        self.paths = np.stack([flat[k].vector() for k in first]) if flat else np.zeros((0, PATH), np.float32)
        self.paths = np.sign(self.paths) * np.log2(1 + np.abs(self.paths))  # twelve nested elements of a kind say little more than two
        self.small = np.concatenate([p.small for p in pages])
        n = np.array([len(p) for p in pages])
        page = np.repeat(np.arange(len(pages)), n)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        self.shape = (int(n.max()), len(pages))
        self.at = np.stack([step, n[page] - 1 - step]) * len(pages) + page  # of each block, in either direction
        self.mask = np.zeros(self.shape[0] * self.shape[1], np.float32)
        self.mask[self.at[0]] = 1
        self.mask = self.mask.reshape(*self.shape, 1)

    def grid(self, rows: np.ndarray) -> np.ndarray:
        """(direction, block, features) to (step, direction, page, features)."""
        out = np.zeros((2, self.shape[0] * self.shape[1], rows.shape[2]), np.float32)
        for d in range(2):
            out[d, self.at[d]] = rows[d]
        return np.ascontiguousarray(out.reshape(2, *self.shape, -1).transpose(1, 0, 2, 3))

    def rows(self, grid: np.ndarray) -> np.ndarray:
        flat = grid.transpose(1, 0, 2, 3).reshape(2, self.shape[0] * self.shape[1], -1)
        return np.stack([flat[d, self.at[d]] for d in range(2)])

    def states(self, w: dict[str, np.ndarray], kept: list | None = None) -> np.ndarray:
        """Hidden states (direction, block, HIDDEN). kept: gets what the backward pass needs."""
        given = self.grid((self.paths @ w["P"])[:, self.places] + self.small @ w["S"] + w["c"])
        h = s = np.zeros((2, self.shape[1], HIDDEN), np.float32)
        out = np.empty((self.shape[0], 2, self.shape[1], HIDDEN), np.float32)
        for t in range(self.shape[0]):
            z = given[t] + h @ w["U"]
            gates, g, m = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :]), self.mask[t]
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            state = f * s + i * g
            held = np.tanh(state)
            if kept is not None:
                kept.append((h, s, i, f, o, g, held))
            h, s = h + m * (o * held - h), s + m * (state - s)
            out[t] = h
        return self.rows(out)

    def back(self, w: dict[str, np.ndarray], kept: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of P, S, U and c from those of the hidden states (direction, block, HIDDEN)."""
        grad, dU = self.grid(grad), np.zeros_like(w["U"])
        dz_all = np.empty((self.shape[0], 2, self.shape[1], 4 * HIDDEN), np.float32)
        dh = ds = np.zeros((2, self.shape[1], HIDDEN), np.float32)
        turned = w["U"].transpose(0, 2, 1)
        for t in range(self.shape[0] - 1, -1, -1):
            h, s, i, f, o, g, held = kept[t]
            m = self.mask[t]
            dh = dh + grad[t]
            to_state = m * (ds + dh * o * (1 - held * held))
            dz = np.concatenate([to_state * g * i * (1 - i), to_state * s * f * (1 - f), m * dh * held * o * (1 - o), to_state * i * (1 - g * g)], 2)
            dU += h.transpose(0, 2, 1) @ dz
            dz_all[t] = dz
            dh, ds = dz @ turned + (1 - m) * dh, to_state * f + (1 - m) * ds
        dz = self.rows(dz_all)
        order = np.argsort(self.places, kind="stable")
        heads = np.flatnonzero(np.diff(self.places[order], prepend=-1))
        by_path = np.add.reduceat(dz[:, order], heads, axis=1)
        return {"P": self.paths.T @ by_path, "S": self.small.T @ dz, "U": dU, "c": dz.sum(1, keepdims=True)}


def _probable(states: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    return _sigmoid(np.concatenate([states[0], states[1]], 1) @ w["V"] + w["v"])[:, 0]


def scores(pages: list[Features], weights: dict[str, np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
    """For each page the probability of every block to be article."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    left = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while left:
        n = 1
        while n < len(left) and (n + 1) * len(pages[left[n]]) <= cells:
            n += 1
        now, left = left[:n], left[n:]
        y = _probable(_Batch([pages[k] for k in now]).states(weights), weights)
        ends = np.cumsum([len(pages[k]) for k in now])
        for k, own in zip(now, np.split(y, ends[:-1]), strict=True):
            out[k] = own
    return out


def train(pages: list[Features], labels: list[np.ndarray], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights fitted to labelled pages by Adam on the cross entropy of each block."""
    weights, random = initial(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(w) for k, w in weights.items()} for _ in range(2))
    step, rates = 0, np.linspace(rate, rate / 10, epochs)
    for rate_now in rates:
        by_length = sorted(random.permutation([k for k in range(len(pages)) if len(pages[k])]), key=lambda k: len(pages[k]) // 8)
        for at in random.permutation(range(0, len(by_length), batch)):
            chosen = by_length[at : at + batch]
            held, kept = _Batch([pages[k] for k in chosen]), []
            y = np.concatenate([labels[k] for k in chosen])
            states = held.states(weights, kept)
            both = np.concatenate([states[0], states[1]], 1)
            d = ((_probable(states, weights) - y) / len(y))[:, None].astype(np.float32)
            back = d @ weights["V"].T
            grads = held.back(weights, kept, np.stack([back[:, :HIDDEN], back[:, HIDDEN:]])) | {"V": both.T @ d, "v": d.sum(0)}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                weights[k] = (weights[k] - rate_now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return weights
