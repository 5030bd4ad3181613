"""Draws of a seed's generator looked up by their place in its stream of bits, for many readers of the stream at once.

What numpy's generator draws hangs only on where in its stream it stands. So the draw at each place, and where it ends,
is made once by that generator, and readers with generators of the same seed are places in these tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Places beyond a table's end that its last draws may read.
SLACK = 512
#: A step of PCG64 (its multiplier).
STEP, MOST = 0x2360ED051FC65DA44385DF649FCCF645, (1 << 128) - 1


class Stream:
    """exponentials: those from a place on are `exponential[start[place]:]`, and the k-th stands at place `stands[start[place] + k]`.
    gammas: `gamma[place, kind]` takes `taken[place, kind]` places, where the kind is that of kinds(shapes)."""

    def __init__(self, seed: int) -> None:
        self.seed, self.size, self.run = seed, 0, 0

    def reach(self, size: int, run: int) -> Stream:
        """Tables over so many places at least, of exponentials that follow each other so many times at least."""
        if size <= self.size and run <= self.run:
            return self
        self.size, self.run = max(self.size, 1 << (size - 1).bit_length()), max(self.run, 1 << (run - 1).bit_length())
        raw = np.random.PCG64(self.seed).random_raw(self.size + SLACK + self.run)
        self.at = {r: i for i, r in enumerate(raw.tolist())}
        self.uniform = (raw >> np.uint64(11)) * 2.0**-53
        self.normal, self.normal_end = self._each(lambda g: g.standard_normal)
        value, end = self._each(lambda g: g.standard_exponential)
        chain, place = [], 0
        while place < self.size:
            chain.append(place)
            place = int(end[place])
        on = np.zeros(self.size, dtype=bool)
        on[chain] = True
        self.start = np.zeros(self.size, dtype=np.int64)
        self.start[chain] = np.arange(len(chain))
        parts, filled = [np.array(chain), np.full(self.run, self.size - 1)], len(chain) + self.run
        for off in np.flatnonzero(~on).tolist():  # passed over by the draws from the first place on
            detour, place = [], off
            while place < self.size and not on[place]:
                detour.append(place)
                place = int(end[place])
            rest = chain[self.start[place] :][: self.run] if place < self.size else []
            parts.append(np.array([*detour, *rest, *[self.size - 1] * (self.run - len(rest))]))
            self.start[off], filled = filled, filled + len(parts[-1])
        self.stands = np.concatenate(parts)
        self.exponential = value[self.stands]
        self.known: dict[float, int] = {}
        self.gamma, self.taken = np.empty((self.size, 0)), np.empty((self.size, 0), dtype=np.int16)
        return self

    def _each(self, kind: Callable[[np.random.Generator], Callable[[], float]]) -> tuple[np.ndarray, np.ndarray]:
        """The draw of each place and the place where it ends, by the generator itself."""
        bits = np.random.PCG64(self.seed)
        state, draw, raw = bits.state, kind(np.random.Generator(bits)), bits.random_raw
        own = state["state"]
        now, inc, values, ends = own["state"], own["inc"], [], []
        for _ in range(self.size):
            own["state"] = now
            bits.state = state
            values.append(draw())
            ends.append(self.at[raw()])
            now = (now * STEP + inc) & MOST
        return np.array(values), np.array(ends)

    def kinds(self, shapes: list[float]) -> np.ndarray:
        """The columns of gammas of these shapes; what a reader takes one after the other lies close together."""
        new = [x for x in shapes if x not in self.known]
        found = [self._gammas(x) for x in new]
        if found:
            self.gamma = np.column_stack((self.gamma, *(value for value, _ in found)))
            self.taken = np.column_stack((self.taken, *((end - np.arange(self.size)).astype(np.int16) for _, end in found)))
            self.known |= {x: len(self.known) + i for i, x in enumerate(new)}
        return np.array([self.known[x] for x in shapes])

    def _gammas(self, shape: float) -> tuple[np.ndarray, np.ndarray]:
        if shape > 1:
            value, end = self._squeezed(shape)
            if self._holds(shape, value, end):
                return value, end
        return self._each(lambda g: lambda: g.standard_gamma(shape))

    def _squeezed(self, shape: float) -> tuple[np.ndarray, np.ndarray]:
        """Gammas out of the normals and uniforms of the stream, as the generator makes them (Marsaglia and Tsang)."""
        b = shape - 1 / 3
        x, u = self.normal, self.uniform[self.normal_end]
        v = 1.0 + (1 / np.sqrt(9 * b)) * x
        negative, v = v <= 0, v * v * v
        value, end = b * v, np.where(negative, self.normal_end, self.normal_end + 1)
        with np.errstate(all="ignore"):
            again = negative | ~((u < 1.0 - 0.0331 * (x * x) * (x * x)) | (np.log(u) < 0.5 * x * x + b * (1.0 - v + np.log(v))))
        for i in np.flatnonzero(again)[::-1]:  # a place that is refused gives what the next one gives
            if end[i] < self.size:
                value[i], end[i] = value[end[i]], end[end[i]]
        return value, end

    def _holds(self, shape: float, value: np.ndarray, end: np.ndarray) -> bool:
        """Whether these are the generator's, by the draws from the first place on."""
        found, place = [], 0
        while place < min(self.size, 4096):
            found.append(value[place])
            place = int(end[place])
        return np.array_equal(found, np.random.default_rng(self.seed).standard_gamma(shape, len(found)))


@lru_cache(maxsize=1)
def stream(seed: int) -> Stream:
    return Stream(seed)
