"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most CAPACITY tokens; pieces are dealt into shards of bounded size. Each shard
is evolved on several islands (a task's row each): an individual is a set of bins, crossover injects whole
well-filled bins of one parent into the other, removes what then is double, lets displaced pieces take the places of
shorter ones where a bin gets fuller by that, and best-fits those left; after each epoch every island hands its elite to the next. Of each shard's best elite, the bins that
are not well filled are opened again and their pieces dealt into fewer shards, until one shard is left.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, rank_encode, tokens

CAPACITY = 1024
END_ID = 2
#: Pieces of a shard on average; individuals of an island; islands of a shard; epochs; crossovers an epoch.
SHARD, POPULATION, ISLANDS, EPOCHS, CROSSOVERS = 4096, 4, 2, 2, 6
#: Bins with at most this share of room left count as well filled.
SLACK = 0.02
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only more than capacity are cut, and the first piece takes the remainder."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then end_id.

    Null counts as empty text, which is the piece of end_id alone; null ids and extra columns are allowed.
    """
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encode.load(path)
        for whole in batches:
            for b in common.slices(whole, "text", rank_encode.SLICE_BYTES):
                rows, data = [], []
                found, at = enc.encode_column(b.column("text"))
                ids = np.insert(found, at[1:], end_id).astype("<u4").tobytes()
                at = (4 * (at + np.arange(len(at)))).tolist()
                for doc, x, y in zip(b.column("id").to_pylist(), at, at[1:], strict=False):
                    for k, (start, length) in enumerate(cut((y - x) // 4, capacity)):
                        own = ids[x + 4 * start : x + 4 * (start + length)]
                        rows.append((doc, k, start, length, zlib.crc32(own)))
                        data.append(own)
                cols = list(zip(*rows, strict=True)) or [()] * 5
                arrays = [pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(tokens.id_lists(data))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECE + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(common.freeing(run), schema)


class Bins:
    """Bins by free room; the fullest that still takes a length is found by the lowest set bit of a mask of rooms."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free, self.mask = capacity, [], [], 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, items: list[int], free: int) -> None:
        self._file(len(self.items), free)
        self.items.append(items)
        self.free.append(free)

    def _file(self, k: int, free: int) -> None:
        self.by_room[free].append(k)
        self.mask |= 1 << free

    def unfile(self, k: int) -> None:
        room = self.free[k]
        self.by_room[room].remove(k)
        if not self.by_room[room]:
            self.mask &= ~(1 << room)

    def best_fit(self, item: int, length: int) -> None:
        rooms = self.mask >> length
        if not rooms:
            self.add([item], self.capacity - length)
            return
        room = length + (rooms & -rooms).bit_length() - 1
        k = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        self.items[k].append(item)
        self.free[k] = room - length
        self._file(k, room - length)


def fitness(bins: Bins) -> tuple[int, float]:
    """Fewer bins are better; of as many, those whose fill is spread most unevenly."""
    return -len(bins.items), sum((bins.capacity - f) ** 2 for f in bins.free)


def fit_all(order: list[int], lengths: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    bins = bins or Bins(capacity)
    for i in order:
        bins.best_fit(i, lengths[i])
    return bins


def crossover(a: Bins, b: Bins, lengths: list[int], rng: random.Random) -> Bins:
    """Well-filled bins of b go into a whole; bins of a that hold one of their pieces are opened and the rest of them best-fitted."""
    slack = int(SLACK * a.capacity)
    good = [k for k, f in enumerate(b.free) if f <= slack]
    chosen = rng.sample(good, max(1, len(good) // 3)) if good else []
    child, taken, displaced = Bins(a.capacity), set(), []
    for k in chosen:
        child.add(list(b.items[k]), b.free[k])
        taken.update(b.items[k])
    weak = 4 * slack
    for items, free in zip(a.items, a.free, strict=True):
        if free <= weak and taken.isdisjoint(items):
            child.add(list(items), free)
        else:
            displaced.extend(i for i in items if i not in taken)
    return fit_all(replaced(child, displaced, lengths), lengths, a.capacity, child)


def replaced(bins: Bins, displaced: list[int], lengths: list[int]) -> list[int]:
    """What is displaced, longest first, after pieces of bins gave way to longer displaced ones: one for one, or two for one or two."""
    loose = sorted((lengths[i], i) for i in displaced)
    for k in range(len(bins.items)):
        free = bins.free[k]
        if not free or not loose:
            continue
        items = bins.items[k]
        best, swap = 0, None
        for out in [(i,) for i in items] + [(i, j) for at, i in enumerate(items) for j in items[:at]][:10]:
            gone = sum(lengths[i] for i in out)
            top = bisect_right(loose, (gone + free, 1 << 62)) - 1
            if top >= 0 and loose[top][0] - gone > best:
                best, swap = loose[top][0] - gone, (out, (top,))
            if len(out) == 2 and top >= 1:  # two for two: the longer one gives way step by step
                low, high = 0, top
                while low < high and best < free:
                    both = loose[low][0] + loose[high][0]
                    if both - gone > free:
                        high -= 1
                    else:
                        if both - gone > best:
                            best, swap = both - gone, (out, (low, high))
                        low += 1
            if best == free:
                break
        if swap:
            out, taken = swap
            new = [loose[t] for t in taken]
            for t in sorted(taken, reverse=True):
                loose.pop(t)
            bins.unfile(k)
            bins.items[k] = [i for i in items if i not in out] + [i for _, i in new]
            bins.free[k] = free - best
            bins._file(k, free - best)
            for i in out:
                insort(loose, (lengths[i], i))
    return [i for _, i in sorted(loose, key=lambda x: (-x[0], x[1]))]


def evolve(lengths: list[int], capacity: int, seeds: list[list[int]], seed: int) -> tuple[list[int], int]:
    """The bin of each piece in the best individual of one island, and how many were bred; seeds: assignments of immigrants and of the island's own elite.

    The first generation breeds always. After it, an island whose best has no more bins than its tokens fill stops.
    """
    rng = random.Random(seed)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    least = -(-sum(lengths) // capacity)
    people = [_of(assign, lengths, capacity) for assign in seeds]
    if not people:
        people.append(fit_all(order, lengths, capacity))
    for k in range(POPULATION - len(people)):
        noise = [lengths[i] * (1 + 0.05 * (k + 1) * rng.random()) for i in range(len(lengths))]
        people.append(fit_all(sorted(order, key=lambda i: -noise[i]), lengths, capacity))
    bred = 0
    for k in range(CROSSOVERS):
        if k and len(max(people, key=fitness).items) <= least:
            break
        a, b = rng.sample(people, 2)
        child = crossover(a, b, lengths, rng)
        bred += 1
        worst = min(range(len(people)), key=lambda k: fitness(people[k]))
        if fitness(child) > fitness(people[worst]):
            people[worst] = child
    best = max(people, key=fitness)
    assign = [0] * len(lengths)
    for k, items in enumerate(best.items):
        for i in items:
            assign[i] = k
    return assign, bred


def _of(assign: list[int], lengths: list[int], capacity: int) -> Bins:
    items: list[list[int]] = [[] for _ in range(max(assign, default=-1) + 1)]
    for i, k in enumerate(assign):
        items[k].append(i)
    bins = Bins(capacity)
    for own in items:
        bins.add(own, capacity - sum(lengths[i] for i in own))
    return bins


def _epoch(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = []
            for lengths, elites, shard, island in zip(df["lengths"], df["elites"], df["shard"], df["island"], strict=True):
                lengths = [int(x) for x in lengths]
                seeds = [[int(x) for x in e] for e in elites] if elites is not None else []
                found.append(np.array(evolve(lengths, capacity, seeds, hash((int(shard), int(island), len(seeds))))[0], dtype=np.int32))
            yield pd.DataFrame({"shard": df["shard"], "island": df["island"], "lengths": df["lengths"], "elite": found})

    return run


_STATE = "shard bigint, island int, lengths array<int>, elite array<int>"


def _chosen(capacity: int):
    """Each shard's best elite, with every piece's offset in its bin and the bin's fill."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for shard, lengths, elites in zip(df["shard"], df["lengths"], df["elites"], strict=True):
                lengths = np.array(lengths, dtype=np.int64)
                best = max((tuple(int(x) for x in e) for e in elites), key=lambda e: (fitness(_of(list(e), lengths.tolist(), capacity)), e))
                bins = np.array(best, dtype=np.int64)
                order = np.argsort(bins, kind="stable")
                upto = np.cumsum(lengths[order]) - lengths[order]
                first = np.searchsorted(bins[order], bins[order])
                offset = np.empty(len(bins), dtype=np.int64)
                offset[order] = upto - upto[first]
                out.append((shard, bins.astype(np.int32), offset.astype(np.int32), np.bincount(bins, weights=lengths)[bins].astype(np.int32)))
            yield pd.DataFrame(out, columns=["shard", "bins", "offsets", "fills"])

    return run


def _level(items: DataFrame, shards: int, capacity: int, scratch: common.Scratch) -> DataFrame:
    """(shard, at: struct of item, bin, offset, fill): each shard's pieces in the best elite of its islands."""
    numbered = items.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    dealt = scratch.stage(numbered.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", *[c for c in items.columns if c != "length"]))).alias("items")), "packing-shards")
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))
    none = F.lit(None).cast("array<array<int>>")
    lengths = F.transform("items", lambda x: x["length"].cast("int"))
    tasks = min(common.shuffle_partitions(items.sparkSession), shards * ISLANDS)
    state = dealt.select("shard", islands.alias("island"), lengths.alias("lengths"), none.alias("elites")).repartition(tasks)
    state = state.mapInPandas(_epoch(capacity), _STATE)
    for _ in range(EPOCHS - 1):  # each island's elite stays and goes to the next island
        to = F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")))
        moved = state.select("shard", to.alias("island"), "lengths", "elite")
        state = moved.groupBy("shard", "island").agg(F.first("lengths").alias("lengths"), F.collect_list("elite").alias("elites"))
        state = state.mapInPandas(_epoch(capacity), _STATE)
    elites = state.groupBy("shard").agg(F.first("lengths").alias("lengths"), F.collect_list("elite").alias("elites"))
    best = elites.mapInPandas(_chosen(capacity), "shard bigint, bins array<int>, offsets array<int>, fills array<int>")
    zipped = F.arrays_zip(F.col("items").alias("item"), F.col("bins").alias("bin"), F.col("offsets").alias("offset"), F.col("fills").alias("fill"))
    return dealt.join(best, "shard").select("shard", F.inline(zipped))


def pack(rows: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD) -> DataFrame:
    """rows with sequence_id and offset: each row's length (1 to capacity) lies gapless in its sequence of at most capacity.

    Repeated rows and null ids are packed like any others; an empty table gives an empty result. Up to twice
    shard_rows rows are one shard.
    """
    common.prepare(rows.sparkSession)
    columns, level, out, scratch = rows.columns, 0, None, common.Scratch()
    rest = scratch.stage(rows, "packing-pieces")
    n = rest.count()
    while True:
        shards = 1 if n <= 2 * shard_rows else -(-n // shard_rows)
        one = scratch.stage(_level(rest, shards, capacity, scratch), "packing-placed")
        seq = (F.lit(level).cast("bigint") * (1 << 56) + F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id")
        place = [*[F.col("item")[c].alias(c) for c in columns], seq, F.col("offset").cast("bigint").alias("offset")]
        full = F.col("fill") >= capacity - int(SLACK * capacity)
        part = (one if shards == 1 else one.where(full)).select(place)
        out = part if out is None else out.unionByName(part)
        if shards == 1:
            return scratch.result(out, "packing-done")
        rest = one.where(~full).select(*[F.col("item")[c].alias(c) for c in columns])
        left = rest.count()
        if left >= n:  # nothing is well filled: more rounds would not help
            return scratch.result(out.unionByName(one.where(~full).select(place)), "packing-done")
        n, level = left, level + 1


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, of pieces that keep their ids; null ids count as none, an empty table gives an empty one."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: F.coalesce(x["ids"], F.array().cast("array<int>")))).alias("ids"))
