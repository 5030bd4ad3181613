"""Bayesian ranking from partial orders: Plackett-Luce sufficient statistics, a Gibbs sampler for many problems side by
side, pairwise information, spanning trees for choosing the next comparisons, and summaries of posterior draws."""

from __future__ import annotations

import math
import random
from collections import deque
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector
from ..session import dealt
from . import ordering
from .draws import SLACK, stream


def sufficient_statistics(rankings: DataFrame, latent: DataFrame | None = None, shape: float = 1.5, rate: float = 1.0, rows: int | None = None) -> DataFrame:
    """(problem, item, shape, rate) from rankings (problem, ranking, items) and latent times (ranking, stage, z; 1 each if
    absent): an item gains shape where it is placed but last, and rate for every stage where it still remains.
    rows: how many places there are about, if known; problems are then dealt into tasks of a bounded number."""
    placed = rankings.select("problem", "ranking", F.size("items").alias("n"), F.posexplode("items").alias("pos", "item"))
    gained = F.sum((F.col("pos") < F.col("n") - 1).cast("double")).alias("s")
    if latent is None:
        left = F.least(F.col("pos") + 1, F.col("n") - 1).cast("double")
        own = placed.select("problem", "item", "pos", "n")
        out = (own if rows is None else dealt(own, rows, "problem")).groupBy("problem", "item").agg(gained, F.sum(left).alias("r"))
    else:
        shapes = placed.groupBy("problem", "item").agg(gained)
        stages = placed.join(latent, "ranking").where("stage <= pos and stage < n - 1")
        rates = stages.groupBy("problem", "item").agg(F.sum("z").alias("r"))
        out = shapes.join(rates, ["problem", "item"], "left")
    return out.select("problem", "item", (F.col("s") + shape).alias("shape"), (F.coalesce("r", F.lit(0.0)) + rate).alias("rate"))


def gibbs(rankings: list[list[int]], n: int, draws: int = 80, burn_in: int = 80, thin: int = 2, shape: float = 1.5, rate: float = 1.0, seed: int = 0) -> np.ndarray:
    """Log skills [draws, n]; without rankings, draws of the prior."""
    return gibbs_side_by_side([(rankings, n)], draws, burn_in, thin, shape, rate, seed)[0]


def gibbs_side_by_side(problems: list[tuple[list[list[int]], int]], draws: int = 80, burn_in: int = 80, thin: int = 2, shape: float = 1.5, rate: float = 1.0, seed: int = 0) -> list[np.ndarray]:
    """gibbs() of each (rankings, n), all stepping together. Each has its own generator, and what that gives does not hang
    on the skills, so a problem's draws are the same whatever stands beside it, and whether they are looked up or drawn."""
    out: list[np.ndarray | None] = [np.log(np.random.default_rng(seed).gamma(shape, 1 / rate, (draws, n))) if not r else None for r, n in problems]
    steps = burn_in + thin * (draws - 1) + 1
    looked_up, drawn = [], []
    for i, (r, n) in enumerate(problems):
        if r:
            bits = steps * (2 * len(r) * max(map(len, r)) + 8 * n)
            (looked_up if bits <= STREAM_BITS and len(r) <= STREAM_SHAPES else drawn).append(i)
    for some, source in ((looked_up, _looked_up), (drawn, _drawn)):
        if some:
            scores = _stepped([problems[i] for i in some], source, steps, burn_in, thin, shape, rate, seed)
            for i, x in zip(some, scores, strict=True):
                out[i] = x
    return out


#: Bits of the stream, two times over, and shapes of gammas that a problem may need whose draws are looked up.
STREAM_BITS, STREAM_SHAPES = 1 << 18, 48
#: Draws of a step: the exponentials of all stages and the gammas of all items.
Step = Callable[[], tuple[np.ndarray, np.ndarray]]


def _drawn(seed: int, steps: int, cells: np.ndarray, owner: np.ndarray, cell: np.ndarray, counts: np.ndarray, wins: np.ndarray) -> Step:
    """Draws by a generator of each problem: of so many exponentials, those of the owners' cells are used, and counts gammas of shapes wins."""
    to, base = np.concatenate(([0], np.cumsum(cells))), np.concatenate(([0], np.cumsum(counts)))
    waiting, gammas, used = np.empty(to[-1]), np.empty(base[-1]), to[owner] + cell
    draw = [(g.standard_exponential, waiting[to[i] : to[i + 1]], g.standard_gamma, wins[base[i] : base[i + 1]], gammas[base[i] : base[i + 1]]) for i, g in enumerate(np.random.default_rng(seed) for _ in cells)]

    def step() -> tuple[np.ndarray, np.ndarray]:
        for wait, w, gamma, k, x in draw:
            wait(out=w)
            gamma(k, out=x)
        return waiting.take(used), gammas

    return step


def _looked_up(seed: int, steps: int, cells: np.ndarray, owner: np.ndarray, cell: np.ndarray, counts: np.ndarray, wins: np.ndarray) -> Step:
    """The draws of _drawn() out of the stream that all its generators share: a problem is a place there."""
    s = stream(seed).reach(int(steps * (1.1 * cells + 3 * counts + 4).max()) + SLACK, int(cells.max()) + 2)
    shapes, which = np.unique(wins, return_inverse=True)
    kind = s.kinds(shapes.tolist())[which]
    order = np.argsort(-counts, kind="stable")  # so that problems with a k-th item are the first ones
    base, n, most = (np.cumsum(counts) - counts)[order], counts[order], cells[order]
    have = [int(np.searchsorted(-n, -k)) for k in range(n[0])]
    slots = [base[:m] + k for k, m in enumerate(have)]
    kinds = [kind[x] for x in slots]
    place, gammas = np.zeros(len(n), dtype=np.int64), np.empty(int(counts.sum()))
    begins = np.empty(len(n), dtype=np.int64)

    def step() -> tuple[np.ndarray, np.ndarray]:
        nonlocal s
        if place.max() >= s.size - s.run - 16 * n[0] - SLACK:
            s = s.reach(2 * s.size, s.run)
            kind = s.kinds(shapes.tolist())[which]
            kinds[:] = [kind[x] for x in slots]
        begin = s.start.take(place)
        begins[order] = begin
        waiting = s.exponential.take(begins.take(owner) + cell)
        place[:] = s.stands.take(begin + most)
        gamma, taken, wide = s.gamma.ravel(), s.taken.ravel(), s.gamma.shape[1]
        for k, m in enumerate(have):
            at = place[:m] * wide + kinds[k]
            gammas[slots[k]] = gamma.take(at)
            place[:m] += taken.take(at)
        return waiting, gammas

    return step


def _stepped(own: list[tuple[list[list[int]], int]], source: Callable[..., Step], steps: int, burn_in: int, thin: int, shape: float, rate: float, seed: int) -> list[np.ndarray]:
    """Log skills of each problem. Places of rankings stand stage by stage, the longest rankings first, so that a step adds whole stages."""
    rows, counts = np.array([len(r) for r, _ in own]), np.array([n for _, n in own])
    size = np.array([len(x) for r, _ in own for x in r])
    wide = np.array([max(map(len, r)) for r, _ in own])
    base = np.concatenate(([0], np.cumsum(counts)))
    total, problem = int(base[-1]), np.repeat(np.arange(len(own)), rows)
    at = np.concatenate([np.asarray(x, dtype=np.int64) for r, _ in own for x in r]) + np.repeat(base[problem], size)  # ranking by ranking
    first = np.cumsum(size) - size
    wins = shape + np.bincount(np.delete(at, (first + size - 1)[size > 0]), minlength=total)[:total]
    order = np.argsort(-size, kind="stable")
    longest = size[order]
    have = [int(np.searchsorted(-longest, -k)) for k in range(int(longest[0]) + 2)]  # rankings with a k-th place
    ranked = np.concatenate([order[:m] for m in have])
    stage = np.repeat(np.arange(len(have)), have)
    where = first[ranked] + stage
    by_ranking = np.empty(len(at), dtype=np.int64)
    by_ranking[where] = np.arange(len(at))
    items, begin = at[where], np.concatenate(([0], np.cumsum(have)))
    more = np.concatenate([np.arange(b, b + m) for b, m in zip(begin, have[1:], strict=False)])  # places that are not their ranking's last
    cell = (np.arange(len(size)) - (np.cumsum(rows) - rows)[problem])[ranked] * wide[problem[ranked]] + stage
    step_draws = source(seed, steps, rows * wide, problem[ranked][more], cell[more], counts, wins)
    ends = np.concatenate(([0], np.cumsum(have[1:])))
    skill, passed, kept = np.ones(total), np.zeros(len(at)), []
    for step in range(steps):
        waiting, gammas = step_draws()
        left = skill.take(items)  # then the skills that remain at each stage
        for k in range(len(have) - 2, -1, -1):
            left[begin[k] : begin[k] + have[k + 1]] += left[begin[k + 1] : begin[k + 1] + have[k + 1]]
        waits = waiting / left.take(more)
        for k in range(len(have) - 1):
            b, m = begin[k], have[k + 1]
            if k:
                np.add(passed[begin[k - 1] : begin[k - 1] + m], waits[ends[k] : ends[k + 1]], out=passed[b : b + m])
                passed[b + m : b + have[k]] = passed[begin[k - 1] + m : begin[k - 1] + have[k]]
            else:
                passed[:m] = waits[:m]
        rates = rate + np.bincount(at, weights=passed.take(by_ranking), minlength=total)[:total]
        skill = gammas * (1 / rates)
        if step >= burn_in and (step - burn_in) % thin == 0:
            kept.append(np.log(skill))
    return np.split(np.array(kept).reshape(len(kept), total), base[1:-1], axis=1)


#: Places of rankings that a task samples together.
STEP_PLACES = 100_000


def posterior(rankings: DataFrame, items: DataFrame | None, draws: int = 80) -> DataFrame:
    """(problem, draw, item, score): a problem's sampler runs in one task, many problems side by side.
    items (problem, item) of the problems; without, those of their rankings, which are then read once only."""
    tasks = int(rankings.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, as sampling takes long for its bytes
    ranked = F.struct("ranking", "items").alias("r")
    if items is None:
        kind = {"problem": rankings.schema["problem"].dataType.simpleString(), "item": rankings.schema["items"].dataType.elementType.simpleString()}
        listed = rankings.select("problem", ranked).repartition(tasks, "problem").groupBy("problem").agg(F.array_sort(F.collect_list("r"))["items"].alias("rankings"))
        own = listed.select("problem", "rankings", F.array_sort(F.array_distinct(F.flatten("rankings"))).alias("items"))
    else:
        kind, named = {f.name: f.dataType.simpleString() for f in items.schema}, F.col("item").alias("i")
        both = rankings.select("problem", ranked, F.lit(None).cast(kind["item"]).alias("i")).unionByName(items.select("problem", F.lit(None).cast(rankings.select(ranked).schema["r"].dataType).alias("r"), named))
        own = both.repartition(tasks, "problem").groupBy("problem").agg(F.array_sort(F.collect_list("r"))["items"].alias("rankings"), F.array_sort(F.collect_list("i")).alias("items"))

    def sampled(problems: pa.Array, names: list[list], found: list[tuple[list[list[int]], int]], type_: pa.DataType) -> pa.RecordBatch:
        scores = gibbs_side_by_side(found, draws)
        item = pa.array([x for own in names for x in own], type=type_)
        each = np.repeat(np.arange(len(names)), [len(x) for x in names])
        of_item = pa.ListArray.from_arrays(np.arange(len(item) + 1, dtype=np.int32) * draws, np.concatenate([s.T.ravel() for s in scores]))
        return pa.RecordBatch.from_arrays([problems.take(pa.array(each)), item, of_item], names=["problem", "item", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            type_, start, room, names, found = b.schema.field("items").type.value_type, 0, 0, [], []
            for i in range(b.num_rows):
                own = b.column("items")[i].as_py()
                place = {x: k for k, x in enumerate(own)}
                ranked = [[place[x] for x in r] for r in b.column("rankings")[i].as_py()]
                more = len(ranked) * max(map(len, ranked), default=0) + len(own)
                if names and room + more > STEP_PLACES:
                    yield sampled(b.column("problem").slice(start, len(names)), names, found, type_)
                    start, room, names, found = i, 0, [], []
                names.append(own)
                found.append((ranked, len(own)))
                room += more
            if names:
                yield sampled(b.column("problem").slice(start, len(names)), names, found, type_)

    drawn = own.mapInArrow(run, f"problem {kind['problem']}, item {kind['item']}, scores array<double>")
    each = drawn.select("problem", "item", F.posexplode("scores").alias("draw", "score"))
    return each.select("problem", F.col("draw").cast("bigint").alias("draw"), "item", "score")


def pair_utilities(draws: DataFrame) -> DataFrame:
    """(problem, a, b, utility) for a < b: entropy of the mean chance that a beats b, less the mean entropy of the draws."""
    a = draws.select("problem", "draw", F.col("item").alias("a"), F.col("score").alias("x"))
    b = draws.select("problem", "draw", F.col("item").alias("b"), F.col("score").alias("y"))
    both = a.join(b, ["problem", "draw"]).where("a < b").withColumn("p", vector.logistic(F.col("x") - F.col("y")))
    return both.groupBy("problem", "a", "b").agg((vector.entropy(F.avg("p")) - F.avg(vector.entropy(F.col("p")))).alias("utility"))


def summary(draws: DataFrame) -> DataFrame:
    """(problem, item, mean, deviation, place)."""
    s = draws.groupBy("problem", "item").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("problem").orderBy(F.desc("mean"), "item")))


def best_share(draws: DataFrame) -> DataFrame:
    """(problem, item, share): in which share of the draws the item is the best; the first of equals."""
    w = Window.partitionBy("problem", "draw").orderBy(F.desc("score"), "item")
    top = draws.withColumn("n", F.row_number().over(w)).groupBy("problem", "item").agg(F.avg((F.col("n") == 1).cast("double")).alias("share"))
    return top


def densest_interval(values: DataFrame, keys: list[str], value: str, mass: float) -> DataFrame:
    """(keys, low, high): the narrowest interval that holds that share of each key's values; the lowest of equals."""
    w = Window.partitionBy(*keys).orderBy(value)
    n = F.count(value).over(Window.partitionBy(*keys))
    x = values.withColumn("__i", F.row_number().over(w)).withColumn("__n", n).withColumn("__k", F.greatest(F.lit(1), F.floor(F.col("__n") * mass)).cast("int"))
    high = x.select(*keys, (F.col("__i") - F.col("__k")).alias("__i"), F.col(value).alias("high"))
    both = x.select(*keys, "__i", F.col(value).alias("low")).join(high, [*keys, "__i"])
    return both.groupBy(*keys).agg(F.min(F.struct((F.col("high") - F.col("low")).alias("w"), "low", "high")).alias("b")).select(*keys, "b.low", "b.high")


def max_spanning_tree(utility: np.ndarray) -> list[tuple[int, int]]:
    """Kruskal's edges over a symmetric matrix, the first of equals."""
    n, root, out = len(utility), list(range(len(utility))), []

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in sorted(combinations(range(n), 2), key=lambda e: (-utility[e], e)):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def neighbourhoods(edges: list[tuple[int, int]], n: int, k: int) -> list[tuple[int, ...]]:
    """Distinct sets of the first k nodes that a breadth-first walk meets from every node."""
    near: list[list[int]] = [[] for _ in range(n)]
    for i, j in edges:
        near[i].append(j)
        near[j].append(i)
    out: dict[tuple[int, ...], None] = {}
    for start in range(n):
        seen, todo = [start], deque([start])
        while todo and len(seen) < k:
            for x in sorted(near[todo.popleft()]):
                if x not in seen and len(seen) < k:
                    seen.append(x)
                    todo.append(x)
        if len(seen) == k:
            out.setdefault(tuple(sorted(seen)))
    return list(out)


def tree_weight(nodes: tuple[int, ...], utility: np.ndarray) -> float:
    sub = utility[np.ix_(nodes, nodes)]
    return float(sum(sub[e] for e in max_spanning_tree(sub)))


def next_batch(utility: np.ndarray, k: int, size: int, overlap: int | None = None) -> list[tuple[int, ...]]:
    """Sets of k items to rank next: heaviest inner trees first, any two sharing at most overlap items."""
    overlap = k - 1 if overlap is None else overlap
    sets = sorted(neighbourhoods(max_spanning_tree(utility), len(utility), k), key=lambda s: -tree_weight(s, utility))
    out: list[tuple[int, ...]] = []
    for s in sets:
        if len(out) < size and all(len(set(s) & set(o)) <= overlap for o in out):
            out.append(s)
    return out


def warm_start(exposure: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The k least seen items, ties in hash order."""
    return exposure.orderBy("exposure", ordering.hash_order(F.col("item"), seed), "item").limit(k)


def rank_rows(scores: dict[str, float]) -> list[str]:
    """A deterministic stand-in for a listwise judge: by score, highest first."""
    return sorted(scores, key=lambda x: -scores[x])


def main_effects(rows: DataFrame, factors: list[str], value: str) -> DataFrame:
    """(factor, level, effect, n): additive effects in closed form, level means less the factor's mean of level means."""
    out = None
    for f in factors:
        m = rows.groupBy(F.col(f).cast("string").alias("level")).agg(F.avg(value).alias("m"), F.count("*").alias("n"))
        one = m.select(F.lit(f).alias("factor"), "level", (F.col("m") - F.avg("m").over(Window.partitionBy(F.lit(1)))).alias("effect"), "n")
        out = one if out is None else out.union(one)
    return out


def exposures(rankings: DataFrame, rows: int | None = None) -> DataFrame:
    """(problem, item, exposure, least): in how many rankings each item stood, and the problem's least.
    rows: how many places there are about, if known; problems are then dealt into tasks of a bounded number."""
    own = rankings.select("problem", F.explode("items").alias("item"))
    seen = (own if rows is None else dealt(own, rows, "problem")).groupBy("problem", "item").agg(F.count("*").alias("exposure"))
    return seen.withColumn("least", F.min("exposure").over(Window.partitionBy("problem")))


def dense_ranks(rows: DataFrame, score: str, name: str) -> DataFrame:
    """rows with a dense rank by falling score, null scores last; the distinct scores are put in order range by range."""
    ranks = ordering.placed(rows.select(F.col(score).alias("__score")).distinct(), [F.col("__score").desc_nulls_last()], name)
    return rows.join(ranks, F.col(score).eqNullSafe(F.col("__score"))).drop("__score")


def simulate(rows: DataFrame, seed: int) -> DataFrame:
    """rows (problem, item, score) with place: a ranking drawn item by item with weights e^score. A Gumbel variable from
    the hash of item, problem and seed on each score gives the same distribution by one sort."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("item").cast("string"), F.col("problem").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    drawn = rows.withColumn("__s", F.round(F.col("score") - F.ln(-F.ln((h + 1) / F.lit(4294967298.0))), 9))
    return drawn.withColumn("place", F.row_number().over(Window.partitionBy("problem").orderBy(F.desc("__s"), "item"))).drop("__s")


def landscape(spark, n: int) -> DataFrame:
    """(item, score) of n items: a falling line with a wave and small clusters."""
    x = F.col("id") / F.lit(max(n - 1, 1))
    score = 1.8 - 3.6 * x + 0.35 * F.sin(3.5 * F.pi() * x) + 0.18 * (F.col("id") % 4 - 1.5)
    return spark.range(n).select(F.col("id").alias("item"), score.alias("score"))


def effect_summary(values: DataFrame, keys: list[str], value: str, edge: float = 0.0) -> DataFrame:
    """(keys, mean, p_above, low_80, high_80, low_95, high_95) of each key's draws; keys with one draw have no intervals and are left out."""
    out = values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.avg((F.col(value) > edge).cast("double")).alias("p_above"))
    for mass in (80, 95):
        one = densest_interval(values, keys, value, mass / 100)
        out = out.join(one.withColumnRenamed("low", f"low_{mass}").withColumnRenamed("high", f"high_{mass}"), keys)
    return out


def set_of_rank(rank: int, n: int, k: int) -> list[int]:
    """The places of the set with that rank, from 0, among the k-sets of n places in dictionary order."""
    out, at = [], 0
    for left in range(k, 0, -1):
        while rank >= (skip := math.comb(n - at - 1, left - 1)):
            rank -= skip
            at += 1
        out.append(at)
        at += 1
    return out


def drawn_ranks(total: int, most: int, seed: str) -> list[int]:
    """All ranks below total, or most different ones of them, each choice as likely, in order; total may be of any size."""
    if total <= most:
        return list(range(total))
    draw, got = random.Random(seed), set()
    for j in range(total - most, total):
        t = draw.randrange(j + 1)
        got.add(j if t in got else t)
    return sorted(got)


def candidate_sets(items: DataFrame, k: int, most: int, seed: int = 0) -> DataFrame:
    """(problem, items): the sets of k different items of a problem, sorted: all if there are most at most, else most of them,
    drawn by the seed. A set is made from its rank among the problem's sets, so no others are made; a problem of fewer than k
    items has none, null items count as none, and a problem's items are one value of a row."""
    listed = items.groupBy("problem").agg(F.array_sort(F.collect_set("item")).alias("items")).where(F.size("items") >= k)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (problem, own) in enumerate(zip(b.column("problem").to_pylist(), b.column("items").to_pylist(), strict=True)):
                sets = [[own[j] for j in set_of_rank(r, len(own), k)] for r in drawn_ranks(math.comb(len(own), k), most, f"{seed}:{problem}")]
                yield pa.RecordBatch.from_arrays([b.column("problem").take(pa.array([i] * len(sets), type=pa.int64())), pa.array(sets, type=b.schema.field("items").type)], ["problem", "items"])

    return listed.mapInArrow(draw, listed.schema)
