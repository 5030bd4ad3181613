"""Average linkage over distances: one dendrogram by chains of nearest neighbours, cut at every number of clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Distances, or a function that makes them: what needs them twice then makes them anew and holds one matrix at a time.
Distances = np.ndarray | Callable[[], np.ndarray]


def dendrogram(d: Distances, sizes: np.ndarray | None = None) -> np.ndarray:
    """The n - 1 merges of average linkage over a distance matrix, by growing height: rows (a, b, height), where a and b are points of the two clusters.
    sizes: how many rows each point stands for, if it is a cluster itself.

    A chain goes from a cluster to its nearest and on, until two are nearest to each other; these merge. Average
    linkage never brings a merged cluster nearer to others than its parts were, so the chain before them stays valid.
    """
    dist = d() if callable(d) else np.array(d, dtype=float)
    n = len(dist)
    np.fill_diagonal(dist, np.inf)
    size, gone, merges, chain = np.ones(n) if sizes is None else sizes.astype(float), np.zeros(n, dtype=bool), [], []
    start = 0
    while len(merges) < n - 1:
        if not chain:
            while gone[start]:
                start += 1
            chain = [start]
        while True:
            row = dist[chain[-1]]
            nearest = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[nearest]:
                nearest = chain[-2]
                break
            chain.append(nearest)
        i, j = sorted((chain.pop(), chain.pop()))
        merges.append((i, j, dist[i, j]))
        row = (size[i] * dist[i] + size[j] * dist[j]) / (size[i] + size[j])
        dist[i], dist[:, i] = row, row
        dist[i, i] = np.inf
        dist[j], dist[:, j] = np.inf, np.inf
        size[i] += size[j]
        gone[j] = True
    out = np.array(merges, dtype=float).reshape(-1, 3)
    return out[np.argsort(out[:, 2], kind="stable")]


def cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels of the k clusters that are left before the last k - 1 merges, numbered by their first points."""
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in merges[: n - k, :2].astype(int):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def _parts(rows: np.ndarray) -> Iterator[np.ndarray]:
    """rows in parts of some hundred, so that what is held beside the matrices does not grow with their square."""
    yield from np.array_split(rows, max(1, len(rows) // 256))


def _sums(d: Distances, label: np.ndarray) -> np.ndarray:
    """Each point's distances summed by cluster; those that are made here give their place to the sums."""
    k = int(label.max()) + 1
    order = np.argsort(label, kind="stable")
    starts = np.searchsorted(label[order], np.arange(k))
    d, out = (own := d(), own[:, :k]) if callable(d) else (d, np.empty((len(d), k)))
    for part in _parts(np.arange(len(d))):
        out[part] = np.add.reduceat(d[part][:, order], starts, axis=1)
    return out


def silhouettes(d: Distances, merges: np.ndarray, low: int, high: int) -> dict[int, float]:
    """The mean silhouette of the cuts into low to high - 1 clusters.

    From the finest cut on, a merge changes only its members and the points whose nearest other cluster was one of
    the two: a merged cluster is never nearer than the nearer of its parts.
    """
    n = len(merges) + 1
    label = cut(merges, n, high - 1)
    sums = _sums(d, label)
    size = np.bincount(label).astype(float)
    rows, live = np.arange(n), np.ones(len(size), dtype=bool)
    nearest, b, s = np.zeros(n, dtype=int), np.zeros(n), np.zeros(n)

    def anew(changed: np.ndarray) -> None:
        """The nearest other clusters of points, and their silhouettes."""
        for which in _parts(changed):
            means = np.where(live, sums[which] / size, np.inf)
            means[np.arange(len(which)), label[which]] = np.inf
            nearest[which] = means.argmin(axis=1)
            b[which] = means[np.arange(len(which)), nearest[which]]
            own = size[label[which]]
            a = sums[which, label[which]] / np.maximum(own - 1, 1)
            s[which] = np.where(own > 1, (b[which] - a) / np.maximum(np.maximum(a, b[which]), 1e-12), 0.0)

    anew(rows)
    found = {}
    for at in range(n - (high - 1), n - low + 1):
        k = n - at
        found[k] = float(s.mean()) if 2 <= k < n else -1.0
        if k == low:
            break
        i, j = (label[int(p)] for p in merges[at, :2])
        changed = np.flatnonzero((label == i) | (label == j) | (nearest == i) | (nearest == j))
        sums[:, i] += sums[:, j]
        size[i] += size[j]
        live[j] = False
        label[label == j] = i
        anew(changed)
    return found


def best_cut(d: Distances, n: int | None = None) -> tuple[int, np.ndarray]:
    """The number of clusters with the best silhouette, of min(n, 3) to n / 2 (the smallest of equals), and its labels. n: the number of points, where d is a function."""
    n = len(d) if n is None else n
    if n <= 1:
        return n, np.zeros(n, dtype=int)
    low, high = min(n, 3), n // 2
    if high < low + 1:
        low, high = 2, 3
    merges = dendrogram(d)
    found = silhouettes(d, merges, low, high)
    k = max(sorted(found), key=lambda k: round(found[k], 10))
    return (k, cut(merges, n, k)) if found[k] > -1 else (0, np.zeros(n, dtype=int))
