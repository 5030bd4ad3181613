"""Parameter search: a tree-structured Parzen estimator proposes, successive halving spends.

A round's trials are rows that are evaluated side by side. All are scored on a share of the data, the better half on
twice that share, and so on to all of it. What has been scored so far is parted into a good and a bad share; new trials
are drawn around the good ones, and those that are likely among the good and unlikely among the bad are taken. The
driver holds trials only, as many as were asked for.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The share of trials that count as good, and the draws that one proposal is chosen from.
GOOD, DRAWS = 0.25, 24


@dataclass(frozen=True)
class Range:
    """low to high, both ends included; whole: integers; log: even in the logarithm."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def at(self, u: float) -> float:
        x = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.log else self.low + u * (self.high - self.low)
        return float(min(self.high, max(self.low, round(x)))) if self.whole else x

    def place(self, x: float) -> float:
        if self.high == self.low:
            return 0.0
        return (math.log(x) - math.log(self.low)) / (math.log(self.high) - math.log(self.low)) if self.log else (x - self.low) / (self.high - self.low)


@dataclass
class Trial:
    number: int
    values: dict[str, float]
    share: float = 0.0
    score: float = -math.inf


def _likely(u: float, centres: list[float], width: float) -> float:
    """Density of a mixture of normals around the centres and an even share over the range."""
    mass = sum(math.exp(-0.5 * ((u - c) / width) ** 2) for c in centres) / (width * math.sqrt(2 * math.pi))
    return (mass + 1) / (len(centres) + 1)


def propose(space: dict[str, Range], seen: list[Trial], n: int, rng: random.Random) -> list[dict[str, float]]:
    """n new settings: even draws as long as little is known, then the most promising of draws around good ones."""
    if len(seen) < 8:
        return [{k: r.at(rng.random()) for k, r in space.items()} for _ in range(n)]
    ordered = sorted(seen, key=lambda t: (-t.share, -t.score, t.number))  # scores on a larger share count first
    cut = max(2, math.ceil(GOOD * len(ordered)))
    good, bad = ordered[:cut], ordered[cut:]
    out = []
    for _ in range(n):
        best, chosen = -math.inf, None
        for _ in range(DRAWS):
            values, gain = {}, 0.0
            for k, r in space.items():
                a, b = ([r.place(t.values[k]) for t in part] for part in (good, bad))
                wa, wb = (max(0.05, len(p) ** -0.5 / 2) for p in (a, b))
                u = rng.random() if rng.random() < 1 / (len(a) + 1) else min(1.0, max(0.0, rng.gauss(rng.choice(a), wa)))
                values[k] = r.at(u)
                u = r.place(values[k])
                gain += math.log(_likely(u, a, wa)) - math.log(_likely(u, b, wb))
            if gain > best:
                best, chosen = gain, values
        out.append(chosen)
    return out


def search(spark: SparkSession, space: dict[str, Range], evaluate: Callable[[DataFrame, float], DataFrame], rounds: int = 4, trials: int = 16, least_share: float = 0.25, seed: int = 0) -> list[Trial]:
    """All trials, best first (of those scored on everything, the highest score, then the first).

    evaluate gets a table of trials (trial, one double a parameter) and the share of the data to use, and returns
    (trial, score). With one seed the trials are the same each time.
    """
    rng, seen = random.Random(seed), []
    schema = "trial int, " + ", ".join(f"`{k}` double" for k in space)
    for _ in range(rounds):
        new = [Trial(len(seen) + i, v) for i, v in enumerate(propose(space, seen, trials, rng))]
        share, live = least_share, new
        while True:
            table = spark.createDataFrame([(t.number, *t.values.values()) for t in live], schema)
            scores = {r["trial"]: r["score"] for r in evaluate(table, share).collect()}  # a row a trial
            for t in live:
                t.share, t.score = share, scores.get(t.number) or 0.0
            if share >= 1:
                break
            live = sorted(live, key=lambda t: (-t.score, t.number))[: max(1, len(live) // 2)]
            share = min(1.0, 2 * share)
        seen += new
    return sorted(seen, key=lambda t: (-t.share, -t.score, t.number))
