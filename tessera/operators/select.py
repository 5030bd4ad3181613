"""Choice of sources for a topic: a 0/1 programme, solved exactly by branch and bound on the driver (one topic has at
most some hundred sources), with the rounds around it."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    ref: str
    cluster: int
    weight: float
    categories: tuple[str, ...] = ()
    book: str = ""
    author: str = ""
    primary: bool = False
    deprioritised: bool = False


def objective(chosen: list[Source], sources: list[Source], links: set[frozenset[str]]) -> float:
    """Weights less penalties: n a missing category, 5 n a second source of a book, n a second of an author, 5 n a linked pair, 5 n if any is deprioritised."""
    n = len(sources)
    refs = {s.ref for s in chosen}
    wanted = {c for s in sources for c in s.categories}
    have = {c for s in chosen for c in s.categories}
    again = lambda xs: sum(k - 1 for k in Counter(x for x in xs if x).values())
    value = sum(s.weight for s in chosen) - n * len(wanted - have)
    value -= 5 * n * again(s.book for s in chosen) + n * again(s.author for s in chosen)
    value -= 5 * n * sum(1 for pair in links if pair <= refs)
    return value - 5 * n * any(s.deprioritised for s in chosen)


def solve(sources: list[Source], links: set[frozenset[str]] | None = None, most: int = 20) -> list[Source]:
    """The best choice of at most one source a cluster, min(most, clusters) in all, primaries included.

    Branch and bound over the clusters, to the end. The bound takes off the penalties that no further choice avoids, and
    of partial choices that all later penalties treat alike only the best goes on.
    """
    links = links or set()
    by_cluster: dict[int, list[Source]] = defaultdict(list)
    for s in sources:
        by_cluster[s.cluster].append(s)
    order = sorted(by_cluster.values(), key=lambda xs: (not any(s.primary for s in xs), -max(s.weight for s in xs)))
    order = [[s for s in xs if s.primary] or xs for xs in order]
    n, total = len(sources), min(most, len(order))
    linked = {r for pair in links for r in pair}
    wanted = {c for s in sources for c in s.categories}
    tops: list[list[float]] = []  # from each cluster on: the sums of the 0, 1, 2 ... largest weights
    left: list[tuple[set, set, set, int, int]] = []  # books, authors and categories to come, clusters that offer no book or no author
    for i in range(len(order) + 1):
        rest = [s for xs in order[i:] for s in xs]
        best_of = sorted((max(s.weight for s in xs) for xs in order[i:]), reverse=True)[:total]
        tops.append([sum(best_of[:k]) for k in range(len(best_of) + 1)])
        free = [sum(any(not getattr(s, x) for s in xs) for xs in order[i:]) for x in ("book", "author")]
        left.append(({s.book for s in rest if s.book}, {s.author for s in rest if s.author}, {c for s in rest for c in s.categories}, *free))
    best: list = [float("-inf"), []]
    seen: dict[tuple, float] = {}

    def go(i: int, chosen: list[Source], value: float, books: frozenset, authors: frozenset, have: frozenset, low: bool, refs: frozenset) -> None:
        more = total - len(chosen)
        if not more:
            value -= n * len(wanted - have)
            if value > best[0] and not any(s.primary for xs in order[i:] for s in xs):
                best[:] = [value, list(chosen)]
            return
        key = (i, more, books, authors, have, low, refs)
        if seen.get(key, float("-inf")) >= value:
            return
        seen[key] = value
        for j in range(i, len(order) - more + 1):
            new_books, new_authors, cats, no_book, no_author = left[j]
            again = 5 * max(0, more - len(new_books - books) - no_book) + max(0, more - len(new_authors - authors) - no_author)
            if value + tops[j][more] - n * (again + len(wanted - have - cats)) <= best[0]:
                return
            nexts = []
            for k, s in enumerate(order[j]):
                cost = 5 * (s.book in books) + (s.author in authors) + 5 * (s.deprioritised and not low)
                cost += 5 * sum(1 for pair in links if s.ref in pair and pair <= refs | {s.ref})
                nexts.append((-(s.weight - n * cost + n * len(set(s.categories) - have)), k, value + s.weight - n * cost, s))
            for _, _, v, s in sorted(nexts, key=lambda x: x[:2]):
                go(j + 1, [*chosen, s], v, books | {s.book} - {""}, authors | {s.author} - {""}, have | set(s.categories), low or s.deprioritised, refs | {s.ref} & linked)
            if any(s.primary for s in order[j]):
                return

    go(0, [], 0.0, frozenset(), frozenset(), frozenset(), False, frozenset())
    return best[1]


def solve_in_rounds(sources: list[Source], interesting: Callable[[Source], bool], links: set[frozenset[str]] | None = None, rounds: int = 10) -> list[Source]:
    """Solves again with uninteresting sources pushed down until all chosen ones are interesting, or one pushed down had to be chosen again."""
    blocked: set[str] = set()
    options: list[tuple[int, list[Source]]] = []
    for _ in range(rounds):
        n = len(sources)
        now = [s if s.ref not in blocked else Source(s.ref, s.cluster, -10.0 * n, s.categories, s.book, s.author, s.primary, s.deprioritised) for s in sources]
        chosen = solve(now, links)
        bad = [s.ref for s in chosen if not interesting(s)]
        options.append((len(chosen) - len(bad), chosen))
        if not bad or blocked & set(bad):
            break
        blocked |= set(bad)
    return max(options, key=lambda o: o[0])[1]


@dataclass
class Weights:
    """Source weights by rank: n - place, and -10 n for blocked ones."""

    blocked: set[str] = field(default_factory=set)

    def of(self, refs: list[str]) -> dict[str, float]:
        n = len(refs)
        return {r: -10.0 * n if r in self.blocked else float(n - i) for i, r in enumerate(refs)}


def weighted(rows: DataFrame, topic: str, ref: str, blocked: str) -> DataFrame:
    """rows with weight: n less the place in the topic, from 0, and -10 n for blocked ones; n sources the topic has."""
    own = Window.partitionBy(topic)
    n, place = F.count("*").over(own), F.row_number().over(own.orderBy(ref)) - 1
    return rows.withColumn("weight", F.when(F.col(blocked), -10.0 * n).otherwise((n - place).cast("double")))
