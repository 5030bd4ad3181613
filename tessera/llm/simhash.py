"""SimHash near-dedup with bit-sliced comparison.

Exact copies of a fingerprint form one class first. Candidates then meet in buckets whose key is a set of
the fingerprint's bits. For a small radius r the bits are dealt into m blocks and two fingerprints within r
agree in at least m - r of them, so no link is lost; for a wide radius the keys are many drawn bit sets.
Inside a bucket the bit planes are stored vertically (64 rows to a machine word), the distances of all rows
to the rows d places on are updated together with carry-save counters, and words are abandoned once all
their lanes exceed the radius or belong to one component already. Over-full buckets are split on further
bits, which stays exact, and what still is too large is compared chunk against chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 64
#: Rows that meet in one bucket before it is split on further bits.
BUCKET_ROWS = 16_384
#: Rows that one comparison takes at a time.
BATCH_ROWS = 65_536
#: Drawn bit sets and their least size, for a radius too wide for blocks: a pair whose bits differ by 15 %
#: (word sets that overlap by 0.8) shares none of them with probability 0.008.
TABLES, TABLE_BITS = 64, 16
#: Parts of one component's classes when they learn its smallest id.
SALTS = 32
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes, shingle: int) -> Iterable[bytes]:
    """Runs of that many words, joined by spaces, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.translate(common.LOWER_BYTES).split()
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))


def fingerprint(text: bytes, shingle: int, seed: int, words_out: int = 1) -> np.ndarray:
    """SimHash of a UTF-8 text as words_out unsigned 64-bit words; zero if the text has no word.

    Words are runs of bytes other than space and 0x09-0x0D after lower-casing A-Z. A text shorter than the
    shingle is one shingle. A bit is set if it is set in more than half of the shingles' hashes: XXH64 for
    the first 64 bits, mixed anew for each further 64.
    """
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, seed) for g in shingles(text, shingle)], dtype="<u8"), words_out)


def majority(hashes: np.ndarray, words_out: int) -> np.ndarray:
    """The bits set in more than half of the hashes; zero for none."""
    if not len(hashes):
        return np.zeros(words_out, dtype=np.uint64)
    out = np.empty(words_out, dtype="<u8")
    for k in range(words_out):
        bits = np.unpackbits(_mixed(hashes, k).view(np.uint8), bitorder="little").reshape(len(hashes), BITS)
        ones = np.add.reduce(bits, axis=0, dtype=np.uint32)
        out[k] = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    if not k:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def radius_for(similarity: float, bits: int) -> int:
    """Differing bits expected of two shingle sets with that Jaccard similarity, plus three standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def fingerprints(docs: DataFrame, shingle: int = 5, seed: int = 42, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, f1 ...: bigint, the fingerprint's bits) of every row; null text counts as empty, whose fingerprint is zero."""
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = common.text_bytes(b, "text")
            fps = np.array([fingerprint(t, shingle, seed, words) for t in texts], dtype=np.uint64).reshape(len(texts), words)
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), *(pa.array(fps[:, k].copy().view(np.int64)) for k in range(words))], ["id", *names])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(common.freeing(run), "id bigint, " + ", ".join(f"{n} bigint" for n in names))


def set_prints(rows: DataFrame, shingle: int, seed: int, words: int) -> DataFrame:
    """(id, own, cid, f0 ...) of rows (id, own, text): cid is the hash of the set of the text's shingles, over which the fingerprint is taken, each shingle once."""
    names = [f"f{k}" for k in range(words)]
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(np.array([digest(g, seed) for g in shingles(t, shingle)], dtype="<u8")) for t in common.text_bytes(b, "text")]
            fps = np.array([majority(g, words) for g in sets], dtype=np.uint64).reshape(len(sets), words)
            cids = np.array([digest(g.tobytes(), seed) for g in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("own"), pa.array(cids), *(pa.array(fps[:, k].copy().view(np.int64)) for k in range(words))], ["id", "own", "cid", *names])

    return rows.select("id", "own", "text").mapInArrow(common.freeing(run), "id bigint, own bigint, cid bigint, " + ", ".join(f"{n} bigint" for n in names))


class Forest:
    """Union-find over row numbers that keeps the links that merged something."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        differ = self.root[a] != self.root[b]
        if not differ.any():
            return
        for x, y in zip(a[differ].tolist(), b[differ].tolist(), strict=True):
            i, j = self._find(x), self._find(y)
            if i != j:
                self.root[max(i, j)] = min(i, j)
                self.links.append((x, y))
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes [64 k, words] of rows [n, k]: bit i of word w of plane p is bit p of row 64 w + i."""
    words = -(-len(fps) // 64)
    rows = np.zeros((words * 64, fps.shape[1]), dtype="<u8")
    rows[: len(fps)] = fps
    bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def close_lanes(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (bits of words) of valid whose row differs at most radius times from the row shift places on.

    Counters of carry-save form: count bits are planes themselves and start so that the carry out of the
    top one says "more than radius"; that carry is sticky. Words whose lanes are all over are abandoned.
    planes must end in enough zero words to read shift places on.
    """
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    word, bit = divmod(shift, 64)
    low, high = np.uint64(bit), np.uint64(64 - bit)
    alive = np.flatnonzero(valid)
    over = ~valid[alive]
    count = [np.full(len(alive), FULL if start >> k & 1 else 0, dtype=np.uint64) for k in range(width)]
    for p, plane in enumerate(planes):
        other = plane[alive + word] >> low
        if bit:
            other |= plane[alive + word + 1] << high
        carry = plane[alive] ^ other
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if p % 8 == 7:
            keep = over != FULL
            if keep.mean() < 0.7:
                alive, over, count = alive[keep], over[keep], [c[keep] for c in count]
            if not len(alive):
                break
    out = np.zeros(len(valid), dtype=np.uint64)
    out[alive] = ~over
    return out


def link_rows(fps: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """For rows [n, k] that lie bucket by bucket (sizes: rows of each), links [m, 2] of rows at most radius apart that span every bucket's components."""
    n = len(fps)
    forest = Forest(n)
    starts = np.cumsum(sizes) - sizes
    left_in = np.repeat(sizes + starts, sizes) - np.arange(n) - 1  # rows of the bucket after this one
    most, words = int(sizes.max(initial=1)), -(-n // 64)
    planes = planes_of(np.concatenate([fps, np.zeros((most + 128, fps.shape[1]), dtype=np.uint64)]))
    rows = np.arange(n)
    for shift in range(1, most):
        rows = rows[left_in[rows] >= shift]
        if shift % 64 == 0:  # buckets that are one component are done
            low = np.minimum.reduceat(forest.root, starts)
            one = low == np.maximum.reduceat(forest.root, starts)
            rows = rows[~np.repeat(one, sizes)[rows]]
        if not len(rows):
            break
        open_rows = rows[forest.root[rows] != forest.root[rows + shift]]
        if not len(open_rows):
            continue
        has = np.zeros(words * 64, dtype=np.uint8)
        has[open_rows] = 1
        lanes = close_lanes(planes, shift, np.packbits(has, bitorder="little").view("<u8"), radius)
        hit = np.flatnonzero(np.unpackbits(lanes.view(np.uint8), bitorder="little"))
        if len(hit):
            forest.union(hit, hit + shift)
    return np.array(forest.links, dtype=np.int64).reshape(-1, 2)


def _compare(radius: int, words: int):
    key = ["table", "key", "part"]

    def of(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(c).to_numpy() for c in key]
        ids = table.column("cid").to_numpy()
        fps = np.stack([table.column(f"f{k}").to_numpy().view(np.uint64) for k in range(words)], axis=1)
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        sizes = np.diff(np.concatenate([[0], cut, [len(ids)]]))
        keep = np.repeat(sizes, sizes) > 1
        ids, fps, sizes = ids[keep], fps[keep], sizes[sizes > 1]
        links = link_rows(fps, sizes, radius) if len(ids) else np.zeros((0, 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[links[:, 0]]), pa.array(ids[links[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(held)
            cols = [table.column(c).to_numpy() for c in key]
            last = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield of(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield of(pa.Table.from_batches(held))

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(bits: list[int], n: int) -> list[int]:
    """n masks that deal the bit numbers out in runs."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _masks(rows: int, radius: int) -> list[int]:
    """Masks of m - r of m blocks; m grows with the rows so that a bucket of unrelated rows stays small."""
    m = radius + 1
    while m < radius + 5 and rows > 64 * 2 ** (BITS * (m - radius) // m):
        m += 1
    return [sum(c) for c in combinations(_blocks(list(range(BITS)), m), m - radius)]


def _drawn(rows: int, words: int) -> list[list[int]]:
    """For each table a mask for each word of the fingerprint; the sets grow by a bit, and the tables by a fifth, for each doubling of the rows beyond 4 million."""
    more = max(0, math.ceil(math.log2(max(rows, 1) / 2**22)))
    rng = np.random.default_rng(1)
    out = []
    for _ in range(round(TABLES * 1.2**more)):
        bits = rng.choice(BITS * words, TABLE_BITS + more, replace=False).tolist()
        out.append([sum(1 << b % BITS for b in bits if b // BITS == k) for k in range(words)])
    return out


def _chunked(level: DataFrame, full: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows of over-full buckets, once for each other chunk of their bucket, so that every pair of chunks meets in one part."""
    hot = level.join(full, ["table", "key"])
    chunks = F.ceil(F.col("count") / bucket_rows)
    hot = hot.withColumn("n", chunks).withColumn("own", F.pmod(F.xxhash64("cid"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    return hot.withColumn("part", F.least("own", "other") * F.col("n") + F.greatest("own", "other")).drop("n", "own", "other", "count")


def candidate_rows(classes: DataFrame, rows: int, radius: int, words: int = 1, bucket_rows: int = BUCKET_ROWS, scratch: common.Scratch | None = None) -> DataFrame:
    """(table, key, part, cid, f0 ...): rows of equal table, key and part are to be compared."""
    prints, scratch = [f"f{k}" for k in range(words)], scratch or common.Scratch()
    zero = F.lit(0).cast("bigint")
    if words > 1:
        keys = [F.struct(F.lit(t).cast("bigint").alias("table"), F.xxhash64(*(F.col(f"f{k}").bitwiseAND(F.lit(_signed(m))) for k, m in enumerate(masks))).alias("key")) for t, masks in enumerate(_drawn(rows, words))]
        level = classes.select("cid", *prints, F.inline(F.array(*keys)))
        full = scratch.stage(level.groupBy("table", "key").count().where(F.col("count") > bucket_rows), "simhash-full")
        if full.isEmpty():
            return level.withColumn("part", zero)
        return level.join(full, ["table", "key"], "left_anti").withColumn("part", zero).unionByName(_chunked(level, full, bucket_rows))
    spread = lambda df, sets: df.withColumn("table", F.explode(sets)).select("table", F.col("f0").bitwiseAND(F.col("table")).alias("key"), "cid", "f0")
    masks = _masks(rows, radius)
    level = spread(classes.select("cid", "f0"), F.array(*[F.lit(_signed(m)) for m in masks]))
    done = None
    for depth in range(3):
        full = scratch.stage(level.groupBy("table", "key").count().where(F.col("count") > bucket_rows), "simhash-full")
        none = full.isEmpty()
        cold = (level if none else level.join(full, ["table", "key"], "left_anti")).withColumn("part", zero)
        done = cold if done is None else done.unionByName(cold)
        if none:
            return done
        if depth == 2:
            break
        finer = {m: [m | s for s in _blocks([b for b in range(BITS) if not m >> b & 1], radius + 1)] for m in masks}
        sets = F.create_map(*[x for m, subs in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))])
        level = spread(level.join(full, ["table", "key"]).select("cid", "f0", F.col("table").alias("wide")), sets[F.col("wide")]).distinct()
        masks = sorted({s for subs in finer.values() for s in subs})
    return done.unionByName(_chunked(level, full, bucket_rows))


def near_edges(classes: DataFrame, radius: int, words: int = 1, bucket_rows: int = BUCKET_ROWS, scratch: common.Scratch | None = None) -> DataFrame:
    """Links (a, b) between classes (cid, f0 ...) that span every component of "at most radius bits differ"; never all pairs of a group."""
    rows = candidate_rows(classes, classes.count(), radius, words, bucket_rows, scratch).repartition(common.shuffle_partitions(classes.sparkSession), "table", "key", "part")
    return rows.sortWithinPartitions("table", "key", "part", "f0", "cid").mapInArrow(common.freeing(_compare(radius, words)), "a bigint, b bigint")


def shingle_sets(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(cid, grams: the sorted distinct 32-bit hashes of the text's shingles) of rows (cid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(np.array([xxhash.xxh32_intdigest(g, seed) for g in shingles(t, shingle)], dtype=np.uint32)).view(np.int32) for t in common.text_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(own, type=pa.list_(pa.int32()))], ["cid", "grams"])

    return rows.select("cid", "text").mapInArrow(common.freeing(run), "cid bigint, grams array<int>")


def verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose shingle sets have at least that Jaccard similarity; two texts without shingles are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [(b.column(c).flatten().to_numpy(), b.column(c).offsets.to_numpy() - b.column(c).offsets[0].as_py()) for c in ("x", "y")]
            good = np.zeros(b.num_rows, dtype=bool)
            for k in range(b.num_rows):
                x, y = (flat[at[k] : at[k + 1]] for flat, at in sides)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = both >= similarity * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(good)), b.column("b").filter(pa.array(good))], ["a", "b"])

    both = links.join(sets.select(F.col("cid").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("grams").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(common.freeing(run), "a bigint, b bigint")


def near_groups(docs: DataFrame, radius: int | None = None, shingle: int = 5, seed: int = 42, words: int = 4, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, fingerprint: 16 hex digits a word, component_id: the smallest id reachable over links, own included).

    Documents link if their fingerprints of 64 x words bits differ at most radius times; without a radius, it is
    that of the similarity. With words = 1 no link is lost; wider ones use drawn bit sets (see TABLES).
    Documents without words have fingerprint zero and link like any others; null text counts as empty; an empty
    table gives an empty result; repeated rows come out as often as they went in; extra columns are ignored.
    """
    common.prepare(docs.sparkSession)
    radius = radius_for(similarity, BITS * words) if radius is None else radius
    names = [f"f{k}" for k in range(words)]
    cid = F.col("f0") if words == 1 else F.xxhash64(*names)
    scratch = common.Scratch()
    prints = scratch.stage(fingerprints(docs, shingle, seed, words, id_col, text_col).withColumn("cid", cid), "simhash-prints")
    classes = scratch.stage(prints.groupBy("cid", *names).agg(F.min("id").alias("least")), "simhash-classes")
    group = _groups(classes, near_edges(classes, radius, words, scratch=scratch), scratch).select("cid", "component_id")
    text = F.concat(*[F.lpad(F.lower(F.hex(n)), 16, "0") for n in names])
    return scratch.result(prints.join(group, "cid").select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id"), "simhash-groups")


def _groups(classes: DataFrame, links: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(cid, least, component_id) of classes (cid, least, ...): the least of all classes reachable over links (a, b).

    Classes without a link are their own; the others of a root are combined on the map side first, so that no
    task gets all classes of a large component."""
    roots = common.components(links, "simhash", scratch).withColumnRenamed("node", "cid")
    named = classes.select("cid", "least").join(roots, "cid", "left")
    alone = named.where("root is null").select("cid", "least", F.col("least").alias("component_id"))
    linked = named.where("root is not null")
    salt = F.pmod(F.xxhash64("cid"), F.lit(SALTS))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    dealt = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return alone.unionByName(linked.withColumn("salt", salt.cast("int")).join(dealt, ["root", "salt"]).select("cid", "least", "component_id"))


def near_dedup(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42, words: int = 4) -> DataFrame:
    """The documents without near copies, columns as they came.

    SimHash finds candidate links between fingerprints, and a link counts if the shingle sets have the Jaccard
    similarity. Of each component of linked texts one row stays, that of the smallest doc_id (of several, the one
    that comes first as JSON); a row of another text is not touched where its doc_id recurs. Null doc_ids come
    last; null texts count as empty, and all texts without words are one group. An empty table gives an empty one, and
    extra columns may have any names.
    """
    common.prepare(docs.sparkSession)
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), own.alias("own"), "text")
    scratch = common.Scratch()
    prints = scratch.stage(set_prints(rows, shingle, seed, words), "near-prints")
    names = [f"f{k}" for k in range(words)]
    place = F.struct(F.col("id").isNull().alias("none"), "id", "own")
    classes = scratch.stage(prints.groupBy("cid").agg(F.min(place).alias("least"), *[F.min(n).alias(n) for n in names]), "near-classes")
    links = scratch.stage(near_edges(classes.drop("least"), radius_for(similarity, BITS * words), words, scratch=scratch).distinct(), "near-links")
    used = links.select(F.col("a").alias("cid")).union(links.select("b")).distinct()
    picked = classes.join(used, "cid").select("cid", F.col("least.id").alias("doc"), F.col("least.own").alias("sha"))
    texts = rows.join(picked, F.col("id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("sha")))
    good = scratch.stage(verified(links, shingle_sets(texts, shingle, seed).dropDuplicates(["cid"]), similarity), "near-verified")
    judged = prints.join(_groups(classes, good, scratch).select("cid", "component_id"), "cid").select("id", "own", (place == F.col("component_id")).alias("kept"))
    doc, sha, last = common.unused(docs, "doc", "sha", "last")
    judged = scratch.result(judged, "near-judged").select(F.col("id").alias(doc), F.col("own").alias(sha), "kept")
    here = F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (own == F.col(sha))
    left = docs.join(judged.where(~F.col("kept")).drop("kept").distinct(), here, "left_anti")
    again = common.stage(judged.where("kept").groupBy(doc, sha).count().where("count > 1").drop("count"), "near-repeated")
    if again.isEmpty():
        return left
    row = F.struct(*docs.columns)
    one = left.join(again, here, "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias(last))
    return left.join(again, here, "left_anti").unionByName(one.select(f"{last}.*"))
