"""A hierarchical additive model of a value by factors, sampled by chains side by side.

value = intercept + one effect a factor + noise. A factor's effects are normal around zero with a deviation of their own
(half-normal), the noise's deviation is half-normal, the intercept normal around the mean; effects are told less their
factor's mean. The table is read once, for counts and sums by pairs of levels: all that the chains need. A chain is a
task: intercept and effects are drawn together from their normal distribution, deviations by slice sampling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranking

INTERCEPT, SIGMA = "intercept", "sigma"


@dataclass(frozen=True)
class Priors:
    """Scales of the half-normal deviations and of the intercept, in units of the value."""

    effect: float = 0.05
    noise: float = 0.02
    intercept: float = 0.1


@dataclass(frozen=True)
class Design:
    """What the chains need of the data: names of (factor, level), first the intercept; X'X, X'y and y'y; rows."""

    names: list[tuple[str, str]]
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: int


def design(rows: DataFrame, factors: list[str], value: str) -> Design:
    """One pass over rows; the driver gets a number for each pair of levels of the design's factors. Null levels are levels, rows without a value take no part."""
    own = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*[F.coalesce(F.col(f).cast("string"), F.lit("null")).alias(f) for f in factors], F.col(value).cast("double").alias("__y"))
    cells = own.groupBy(*factors).agg(F.count("*").alias("n"), F.sum("__y").alias("y"), F.sum(F.col("__y") * F.col("__y")).alias("yy"))
    at = F.array(F.struct(F.lit(INTERCEPT).alias("f"), F.lit("").alias("l")), *[F.struct(F.lit(f).alias("f"), F.col(f).alias("l")) for f in factors])
    pairs = cells.select("n", "y", "yy", F.explode(at).alias("a"), at.alias("all")).select("n", "y", "yy", "a", F.explode("all").alias("b"))
    found = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("yy").alias("yy")).collect()
    names = [(INTERCEPT, ""), *sorted({tuple(r["a"]) for r in found} - {(INTERCEPT, "")}, key=lambda k: (factors.index(k[0]), k[1]))]
    place = {k: i for i, k in enumerate(names)}
    xx, xy, yy, n = np.zeros((len(names), len(names))), np.zeros(len(names)), 0.0, 0
    for r in found:
        a, b = place[tuple(r["a"])], place[tuple(r["b"])]
        xx[a, b] = r["n"]
        if a == b:
            xy[a] = r["y"]
        if a == b == 0:
            yy, n = r["yy"], r["n"]
    return Design(names, xx, xy, yy, n)


def _slice(log_density, x: float, rng: np.random.Generator, width: float = 1.0) -> float:
    """One step of slice sampling in log space: stepping out, then shrinking."""
    f = lambda t: log_density(np.exp(t)) + t  # noqa: E731  with the change of variable
    t = np.log(x)
    level = f(t) - rng.exponential()
    low = t - width * rng.random()
    high = low + width
    for _ in range(50):
        if f(low) < level:
            break
        low -= width
    for _ in range(50):
        if f(high) < level:
            break
        high += width
    while True:
        new = low + (high - low) * rng.random()
        if f(new) >= level:
            return float(np.exp(new))
        low, high = (new, high) if new < t else (low, new)


def chain(d: Design, priors: Priors, draws: int, tune: int, seed: int) -> tuple[list[tuple[str, str]], np.ndarray]:
    """Names and draws x values: intercept, centred effects, deviations of factors ("tau") and of the noise."""
    rng = np.random.default_rng(seed)
    factor = np.array([f for f, _ in d.names])
    kinds = [f for f in dict.fromkeys(factor.tolist()) if f != INTERCEPT]
    own = [np.flatnonzero(factor == f) for f in kinds]
    mean = d.xy[0] / max(1, d.n)
    sigma, tau = priors.noise, np.full(len(kinds), priors.effect)
    names = [*d.names, *((f, "tau") for f in kinds), (SIGMA, "")]
    out = np.zeros((draws, len(names)))
    for step in range(tune + draws):
        precision = np.full(len(factor), 1 / priors.intercept**2)
        for t, at in zip(tau, own, strict=True):
            precision[at] = 1 / t**2
        a = d.xx / sigma**2 + np.diag(precision)
        b = d.xy / sigma**2
        b[0] += mean / priors.intercept**2
        root = np.linalg.cholesky(a)
        beta = np.linalg.solve(root.T, np.linalg.solve(root, b) + rng.standard_normal(len(b)))
        rest = max(1e-300, d.yy - 2 * beta @ d.xy + beta @ d.xx @ beta)
        sigma = _slice(lambda s, rest=rest: -d.n * np.log(s) - rest / (2 * s * s) - s * s / (2 * priors.noise**2), sigma, rng)
        for k, at in enumerate(own):
            squares = float((beta[at] ** 2).sum())
            tau[k] = _slice(lambda s, q=squares, m=len(at): -m * np.log(s) - q / (2 * s * s) - s * s / (2 * priors.effect**2), tau[k], rng)
        if step >= tune:
            told = beta.copy()
            for at in own:
                told[at] -= beta[at].mean()
                told[0] += beta[at].mean()
            out[step - tune] = [*told, *tau, sigma]
    return names, out


def sample(rows: DataFrame, factors: list[str], value: str, priors: Priors | None = None, chains: int = 4, draws: int = 2000, tune: int = 2000, seed: int = 42) -> DataFrame:
    """(factor, level, chain, draw, effect) of every chain."""
    d, priors = design(rows, factors, value), priors or Priors()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for k in df["id"]:
                names, found = chain(d, priors, draws, tune, seed + int(k))
                for j, (f, level) in enumerate(names):
                    yield pd.DataFrame({"factor": f, "level": level, "chain": int(k), "draw": np.arange(draws), "effect": found[:, j]})

    return rows.sparkSession.range(0, chains, 1, chains).mapInPandas(run, "factor string, level string, chain int, draw int, effect double")


def summary(draws: DataFrame) -> DataFrame:
    """(factor, level, mean, p_above, low_80 ... high_95, r_hat, ess) of sampled effects: shortest intervals, the ratio of
    variances between and within half chains, and the effective draws by means of batches."""
    keys = ["factor", "level"]
    known = ranking.effect_summary(draws, keys, "effect", 0.0)
    last = Window.partitionBy(*keys, "chain")
    halves = draws.withColumn("half", (2 * F.col("draw") > F.max("draw").over(last)).cast("int"))
    own = halves.groupBy(*keys, "chain", "half").agg(F.avg("effect").alias("m"), F.var_samp("effect").alias("v"), F.count("*").alias("n"))
    ratio = own.groupBy(*keys).agg(F.avg("v").alias("within"), F.var_samp("m").alias("between"), F.avg("n").alias("n"))
    r_hat = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between")) / F.col("within"))
    total = draws.groupBy(*keys).agg(F.var_samp("effect").alias("v"), F.count("*").alias("n"), F.max("draw").alias("most"))
    size = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("most") + 1.0)))
    means = draws.join(total, keys).groupBy(*keys, "chain", F.floor(F.col("draw") / size).alias("batch")).agg(F.avg("effect").alias("m"), F.first("v").alias("v"), F.first("n").alias("n"), F.first(size).alias("size"))
    ess = means.groupBy(*keys).agg(F.least(F.first("n").cast("double"), F.first("n") * F.first("v") / (F.first("size") * F.var_samp("m"))).alias("ess"))
    return known.join(ratio.select(*keys, r_hat.alias("r_hat")), keys).join(ess, keys)
