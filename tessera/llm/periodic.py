"""Runs of consecutive words that repeat with a period, found by block matching.

A run of smallest period q and at least 4q words holds, in its first period, a block of B words that starts at a
multiple of B, where B is the power of two with B <= q < 2B, and the block comes again q words later. So for each
scale B the aligned blocks become keys of an Aho-Corasick automaton over word numbers, the automaton reads the
document, and occurrences of a block B to 2B - 1 words after it are seeds. A seed is extended word by word in both
directions, which decides exactly. Three or more seeds of one block form a progression whose step is the block's own
period; then only those whose stretch of that smaller period ends in the same way can be a run's, one for each stretch.

Before that, parts of a document that cannot hold a run of a scale are passed over: all but the last q + 3 words of
a run start a group of four words that comes again at most q words later. Word groups are compared by hash there, and
equal hashes of unequal groups only ever let more through.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words at least, and periods at least, of what counts as a run.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of True that are at least so long."""
    if np.count_nonzero(mask) < least:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def _again(keys: np.ndarray) -> np.ndarray:
    """For each place, how far on its key comes next; beyond the array where it does not."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    out = np.full(n, n + 1, dtype=np.int64)
    same = ordered[1:] == ordered[:-1]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def places(x: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(B, parts of x that may hold runs whose period is from B to 2B - 1), by growing B."""
    n = len(x)
    for b in (1, 2):
        if n < max(LEAST_WORDS, LEAST_PERIODS * b):
            return
        found = [(s, e + q) for q in range(b, 2 * b) if q < n for s, e in _stretches(x[q:] == x[:-q], max(LEAST_WORDS, LEAST_PERIODS * q) - q)]
        if found:
            yield b, _joined(found)
    if n < 4 * LEAST_PERIODS:
        return
    y = x.astype(np.uint64) + np.uint64(1)
    pairs = (y[:-1] * _MIX) ^ ((y[1:] + _MIX) * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs ^= pairs >> np.uint64(29)
    gap = _again((pairs[:-2] * _MIX) ^ ((pairs[2:] + _MIX) * np.uint64(0xD6E8FEB86659FD93)))
    if int(gap.min()) > n:
        return
    b = 4
    while LEAST_PERIODS * b <= n:
        found = [(s, min(n, e + 2 * b + 3)) for s, e in _stretches(gap < 2 * b, (LEAST_PERIODS - 1) * b - 3)]
        if found:
            yield b, _joined(found)
        b *= 2


def _joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(parts):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _extended(x: np.ndarray, at: int, d: int, upto: int) -> tuple[int, int]:
    """(start, end) of the longest stretch around [at, upto) whose words equal those d places on; its end counts those too."""
    n, left, right, step = len(x), at, upto, 32
    while right < n - d:
        m = min(step, n - d - right)
        off = np.flatnonzero(x[right : right + m] != x[right + d : right + d + m])
        if len(off):
            right += int(off[0])
            break
        right += m
        step *= 2
    step = 32
    while left > 0:
        m = min(step, left)
        off = np.flatnonzero(x[left - m : left] != x[left - m + d : left + d])
        if len(off):
            left -= m - 1 - int(off[-1])
            break
        left -= m
        step *= 2
    return left, right + d


def _primitive(x: np.ndarray, start: int, q: int) -> bool:
    """No shorter period divides q over the q words from start."""
    root = x[start : start + q]
    return not any(np.array_equal(root[: q - d], root[d:]) for d in _divisors(q))


def _divisors(q: int) -> list[int]:
    """q over each of its primes: a shorter period that divides q divides one of these."""
    out, left, p = [], q, 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p == 0:
            out.append(q // p)
            while left % p == 0:
                left //= p
        p += 1
    return out


def _occurrences(x: np.ndarray, parts: list[tuple[int, int]], b: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The aligned blocks of b words in the parts, as (place, number of content), and where each content occurs in the parts."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    blocks: list[tuple[int, int]] = []
    known: dict[bytes, int] = {}
    for s, e in parts:
        for at in range(-(-s // b) * b, e - b + 1, b):
            block = x[at : at + b]
            number = known.setdefault(block.tobytes(), len(known))
            if number == len(known) - 1:
                automaton.add_word(tuple(block.tolist()), number)
            blocks.append((at, number))
    where: list[list[int]] = [[] for _ in known]
    if known:
        automaton.make_automaton()
        for s, e in parts:
            for end, number in automaton.iter(tuple(x[s:e].tolist())):
                where[number].append(s + end - b + 1)
    return blocks, where


def runs(x: np.ndarray) -> list[Run]:
    """All runs over the word numbers x (int32), by start, then period."""
    found: set[Run] = set()
    covered: list[tuple[int, int]] = []  # of runs found; what lies within one has no run of another period of this length
    for b, parts in places(x):
        parts = [p for p in parts if not any(s <= p[0] and p[1] <= e for s, e in covered)]
        if not parts:
            continue
        blocks, where = _occurrences(x, parts, b)
        last: dict[int, int] = {}  # by distance, where the stretch that was extended last ends
        smaller: dict[int, tuple[int, int]] = {}  # by step, the stretch of that period that was extended last
        for at, number in blocks:
            own = where[number]
            lo, hi = bisect_left(own, at + b), bisect_left(own, at + 2 * b)
            if hi - lo < 3:
                distances = [o - at for o in own[lo:hi]]
            else:
                distances = _aligned(x, at, b, own[lo:hi], smaller)
            for d in distances:
                if last.get(d, -1) >= at + b + d:
                    continue
                start, end = _extended(x, at, d, at + b)
                last[d] = end
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * d) and _primitive(x, start, d):
                    found.add(Run(start, end - start, d))
        covered = _largest(found)
    return sorted(found, key=lambda r: (r.start, r.period))


def _largest(found: set[Run]) -> list[tuple[int, int]]:
    """The stretches of runs that no other run's stretch holds."""
    out: list[tuple[int, int]] = []
    for r in sorted(found, key=lambda r: (r.start, -r.length)):
        if not out or r.start + r.length > out[-1][1]:
            out.append((r.start, r.start + r.length))
    return out


def _aligned(x: np.ndarray, at: int, b: int, seeds: list[int], smaller: dict[int, tuple[int, int]]) -> list[int]:
    """Of three or more occurrences within b places, the distances that a run of period b or more can have.

    Their step p is the block's period. The block's stretch of period p ends within a run of a larger period, and the
    stretch around the block's copy must end as far on.
    """
    p = min(c - a for a, c in zip(seeds, seeds[1:], strict=False))
    own = _smaller(x, at, b, p, smaller)
    out: list[int] = []
    k = 0
    while k < len(seeds):
        start, end = _smaller(x, seeds[k], b, p, smaller)
        d = end - own[1]
        if (start, end) != own and b <= d < 2 * b and at + d in seeds:
            out.append(d)
        while k < len(seeds) and seeds[k] + b <= end:
            k += 1
    return out


def _smaller(x: np.ndarray, at: int, b: int, p: int, known: dict[int, tuple[int, int]]) -> tuple[int, int]:
    held = known.get(p)
    if held is None or not held[0] <= at <= at + b <= held[1]:
        held = known[p] = _extended(x, at, p, at + b - p)
    return held


def planted(words: list[bytes], doc_id: object) -> list[bytes]:
    """The document's words, from some place on repeated with a period if crc32 of the id as text says so (null: the empty text)."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for r in found:
        gone[r.start + r.period] += 1
        gone[r.start + r.length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def strongest(found: list[Run]) -> Run | None:
    """The run with the most periods, exactly; then the smallest start, then the smallest period."""
    best = None
    for r in found:
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


RESULT = "runs array<struct<start: bigint, length: bigint, period: bigint>>, best struct<start: bigint, length: bigint, period: bigint>, collapsed binary"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, digest: bool = False) -> DataFrame:
    """(id_col, runs, best, collapsed) of each row: all runs of its words, the strongest, and the text without the repeats.

    Words are separated by space and the five ASCII controls from tab to carriage return. Null texts count as empty
    and have no runs; then best is null and collapsed empty. Rows are judged one by one, so repeated rows and ids get
    a row each, and an empty table gives an empty one; extra columns are ignored. A text is held whole by one task,
    in memory and time that grow with it (the number of scales is the logarithm of its length).
    plant: repeat words as planted() says. digest: the SHA-256 of collapsed in its place.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {RESULT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            for part in common.slices(batch, text_col, 4_000_000):
                all_runs, best, texts = [], [], []
                ids = part.column(id_col)
                for doc_id, text in zip(ids.to_pylist(), common.text_bytes(part, text_col), strict=True):
                    words = text.split()  # of bytes: at exactly these separators
                    if plant:
                        words = planted(words, doc_id)
                    found = runs(numbered(words))
                    top = strongest(found)
                    kept = b" ".join(collapsed(words, found))
                    all_runs.append([r._asdict() for r in found])
                    best.append(top._asdict() if top else None)
                    texts.append(hashlib.sha256(kept).digest() if digest else kept)
                if types is None:
                    one = pa.struct([pa.field(k, pa.int64()) for k in Run._fields])
                    types = [ids.type, pa.list_(one), one, pa.binary()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(all_runs, types[1]), pa.array(best, types[2]), pa.array(texts, types[3])], names=[id_col, "runs", "best", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(common.freeing(run), schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of planted texts, one row per row of docs, as numbers and digests."""
    found = find(docs, id_col, text_col, plant=True, digest=True)
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.lower(F.hex("collapsed")).alias("collapsed_sha256"),
    )
