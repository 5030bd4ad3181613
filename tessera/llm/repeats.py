"""Removal of long repeated strings with a collection's suffix order, built column by column.

Strings of LENGTH bytes that occur twice are found in three steps.

Anchors. Of the 64-byte strings in each window of LENGTH bytes, the one whose hash is least (the leftmost of equals)
is the window's anchor. Windows in a row with one anchor form a read, some hundred bytes longer than a window. Equal
windows have equal anchors at equal places, so they lie in reads of one bucket (one anchor), at equal distances from
it. Reads whose anchor occurs once are done with; equal reads are combined and counted. Only anchors, digests and
places are shuffled for that.

Columns. The reads of a bucket that differ are laid side by side with their anchors aligned. From the last column to
the first, each round inserts one symbol of each read before its suffix: the new order of suffixes is the old one,
sorted stably by the symbols that stand before them (the column of the collection's Burrows-Wheeler transform), and
the common prefix of two neighbours with one symbol is one more than the least between them in the old order.
Suffixes need no comparing across columns, as equal windows stand in one column, so a round costs no more than its
reads, and the columns of transform and prefixes are read and written front to back. A window occurs again if its
suffix shares LENGTH symbols with a neighbour, or its read was counted twice.

Removal. Each document's windows that occur again are united, and the bytes they cover go.

A bucket with more reads than a task may hold is split: windows that start before the middle of its range share the
bytes around the one side of the anchor, the others those around the other side, and each half is dealt anew by those
bytes. Splitting ends at single windows, where only equal ones are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 400
#: Bytes of an anchor, and how many of them a window has.
GRAM = 64
#: Bytes whose windows are looked at together; a longer text is looked at in overlapping stretches.
STRETCH = 1 << 18
#: Reads of a bucket beyond which it is split, and reads built together.
BUCKET_READS, BATCH_READS = 16_384, 16_384
_PLACE = np.uint64((1 << 21) - 1)
_TABLE = np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place, by doubling."""
    h, m = _TABLE[data], 1
    for odd in _ODD:
        g = h[:-m] * odd
        g += h[m:]
        h, m = g, 2 * m
    h ^= h >> np.uint64(32)
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each width keys in a row."""
    m = 1
    while 2 * m <= width:
        keys = np.minimum(keys[:-m], keys[m:])
        m *= 2
    return keys if m == width else np.minimum(keys[: len(keys) - (width - m)], keys[width - m :])


def anchored(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(piece, start, size, anchor's place less start, anchor's hash) of each read, as arrays; pieces of STRETCH bytes or so in all."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(0, dtype=np.uint64),)
    if not len(sizes) or sizes.max() < length:
        return none
    h = _hashes(data)
    keys = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    place = (_least(keys, length - GRAM + 1) & _PLACE).astype(np.int64)
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    full = sizes >= length
    np.add.at(edge, starts[full], 1)
    np.add.at(edge, ends[full] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge[: len(place)]) > 0)
    at = place[windows]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1))))
    first = windows[new]
    last = windows[np.append(new[1:], len(windows)) - 1]
    piece = np.searchsorted(ends, first, side="right")
    return piece, first - starts[piece], last - first + length, at[new] - first, h[at[new]]


def text_key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


_READ = "anchor bigint, digest binary, key binary, id string, start bigint, size int, ahead int"


def _sketches(docs: DataFrame, length: int) -> DataFrame:
    """The reads of every text (_READ): anchor, digest of the read's bytes, digest of the text, its id as text, and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            texts = common.text_bytes(batch, "text")
            pieces, own = [], []
            held = 0

            def told() -> pa.RecordBatch | None:
                piece, start, size, ahead, anchor = anchored(pieces, length)
                if not len(piece):
                    return None
                at = np.array([o for _, o in own], dtype=np.int64)[piece] + start
                row = np.array([r for r, _ in own], dtype=np.int64)[piece]
                digests = [xxhash.xxh3_128_digest(pieces[p][a : a + n]) for p, a, n in zip(piece.tolist(), start.tolist(), size.tolist(), strict=True)]
                keys = {r: text_key(texts[r]) for r in set(row.tolist())}
                return pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(digests, pa.binary()), pa.array([keys[r] for r in row.tolist()], pa.binary()), ids.take(pa.array(row)), pa.array(at), pa.array(size.astype(np.int32)), pa.array(ahead.astype(np.int32))],
                    names=["anchor", "digest", "key", "id", "start", "size", "ahead"],
                )

            for r, text in enumerate(texts):
                for o in range(0, max(1, len(text) - length + 1), STRETCH):
                    piece = text[o : o + STRETCH + length - 1]
                    if len(piece) < length:
                        continue
                    if held and held + len(piece) > STRETCH:
                        if (out := told()) is not None:
                            yield out
                        pieces, own, held = [], [], 0
                    pieces.append(piece)
                    own.append((r, o))
                    held += len(piece)
            if (out := told()) is not None:
                yield out

    return docs.mapInArrow(common.freeing(run), _READ)


def _fetched(docs: DataFrame, reads: DataFrame) -> DataFrame:
    """(bucket, digest, n, text, ahead) of distinct reads: their bytes, from the text that stands for all that hold them."""
    wanted = reads.groupBy(F.col("rep.key").alias("k"), F.col("rep.id").alias("i")).agg(F.collect_list(F.struct("anchor", "digest", "n", "rep.start", "rep.size", "rep.ahead")).alias("wanted"))
    own = docs.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    joined = own.join(wanted, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i"))).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = common.text_bytes(batch.slice(k, 1), "text")[0]
                wanted = batch.column("wanted").slice(k, 1).flatten()
                field = {f.name: c for f, c in zip(wanted.type, wanted.flatten(), strict=True)}
                parts = [text[s : s + n] for s, n in zip(field["start"].to_pylist(), field["size"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([field["anchor"], field["digest"], field["n"], pa.array(parts, pa.binary()), field["ahead"]], names=["bucket", "digest", "n", "text", "ahead"])

    out = joined.mapInArrow(run, "bucket bigint, digest binary, n bigint, text binary, ahead int")
    return out.dropDuplicates(["bucket", "digest"])  # rows that repeat an id and its text


def repeated_windows(texts: list[bytes], ahead: np.ndarray, buckets: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each read, the (from, to) of its bytes in windows that occur again in its bucket. buckets ascend; reads of one are distinct."""
    m = len(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    before = int(ahead.max(initial=0))
    width = before + int((sizes - ahead).max(initial=0))
    columns = np.zeros((m, width), dtype=np.uint16)  # 0: no symbol; else the byte + 1
    for r, t in enumerate(texts):
        a = before - int(ahead[r])
        columns[r, a : a + len(t)] = np.frombuffer(t, dtype=np.uint8)
    live = np.arange(width)[None, :]
    a = (before - ahead)[:, None]
    columns += ((live >= a) & (live < a + sizes[:, None])).astype(np.uint16)
    columns = np.ascontiguousarray(columns.T)
    twice = counts > 1
    order, bucket = np.arange(m), (np.cumsum(np.concatenate(([0], buckets[1:] != buckets[:-1]))) << 9).astype(np.int64)
    prefix = np.zeros(m, dtype=np.int32)  # with the read before in the order
    found: list[tuple[np.ndarray, int]] = []
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order]
        key = bucket + symbol
        step = np.argsort(key, kind="stable")
        order, key = order[step], key[step]
        same = np.concatenate(([False], (key[1:] == key[:-1]) & ((key[1:] & 511) > 0)))
        least = prefix[step]
        apart = np.flatnonzero(same[1:] & (step[1:] != step[:-1] + 1)) + 1
        if len(apart):  # the least between two reads that others stood between
            pairs = np.stack((step[apart - 1] + 1, step[apart] + 1), axis=1).ravel()
            least[apart] = np.minimum.reduceat(np.append(prefix, 0), pairs)[::2]
        prefix = np.where(same, np.minimum(least + 1, length), 0).astype(np.int32)
        if c <= before:
            again = prefix >= length
            again[:-1] |= again[1:]
            hit = order[again]
            if len(hit):
                found.append((hit, c))
    starts: list[list[int]] = [[] for _ in range(m)]
    for hit, c in reversed(found):
        for r in hit.tolist():
            starts[r].append(c - before + int(ahead[r]))
    out = []
    for r in range(m):
        if twice[r]:
            out.append([(0, len(texts[r]))])
            continue
        own: list[tuple[int, int]] = []
        for s in starts[r]:
            if own and s <= own[-1][1]:
                own[-1] = own[-1][0], s + length
            else:
                own.append((s, s + length))
        out.append(own)
    return out


_SPAN = pa.list_(pa.struct([pa.field("from", pa.int64()), pa.field("to", pa.int64())]))


def _columnwise(reads: DataFrame, length: int) -> DataFrame:
    """(bucket, digest, spans) of the reads that hold windows that occur again; all reads of a bucket in one task, many buckets together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def told(rows: list[tuple]) -> pa.RecordBatch:
            bucket, digest, n, text, ahead = zip(*rows, strict=True)
            found = repeated_windows(list(text), np.array(ahead, dtype=np.int64), np.array(bucket, dtype=np.int64), np.array(n, dtype=np.int64), length)
            some = [k for k, f in enumerate(found) if f]
            spans = [[{"from": s, "to": e} for s, e in found[k]] for k in some]
            return pa.RecordBatch.from_arrays([pa.array([bucket[k] for k in some], pa.int64()), pa.array([digest[k] for k in some], pa.binary()), pa.array(spans, _SPAN)], names=["bucket", "digest", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "digest", "n", "text", "ahead")), strict=True):
                if len(rows) >= BATCH_READS and row[0] != rows[-1][0]:
                    yield told(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield told(rows)

    ordered = reads.select("bucket", "digest", "n", "text", "ahead").repartition("bucket").sortWithinPartitions("bucket", "digest")
    return ordered.mapInArrow(common.freeing(run), "bucket bigint, digest binary, spans array<struct<from: bigint, to: bigint>>")


_HALF = "anchor bigint, first binary, shift bigint, bucket bigint, digest binary, n bigint, text binary, ahead int, low int, high int"


def _halved(reads: DataFrame, length: int) -> DataFrame:
    """Reads of large buckets in halves: (anchor, first, shift) of where they come from, and bucket, digest, n, text, ahead, low, high anew.

    low, high: where the bucket's windows may start, counted from the anchor; those of a half share the bytes that its bucket is named after.
    """
    names = [c.split()[0] for c in _HALF.split(", ")]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, first, shift, bucket, n, text, ahead, low, high in zip(*(batch.column(c).to_pylist() for c in names if c != "digest"), strict=True):
                middle = (low + high) // 2
                for half, (lo, hi) in enumerate(((low, middle), (middle + 1, high))):
                    s, e = max(lo, -ahead), min(hi, len(text) - length - ahead)
                    if s > e:
                        continue
                    core = text[hi + ahead : lo + length + ahead]
                    part = text[s + ahead : e + length + ahead]
                    name = xxhash.xxh3_64_intdigest(core, (bucket * 2 + half) & (1 << 63) - 1)
                    out.append((anchor, first, shift + s + ahead, name - (1 << 63), xxhash.xxh3_128_digest(part), n, part, -s, lo, hi))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return reads.select(names).mapInArrow(run, _HALF)


def _of_origin(found: DataFrame, parts: DataFrame) -> DataFrame:
    """(anchor, digest, spans) of the reads that the parts come from."""
    own = parts.select(F.col("bucket").alias("b"), F.col("digest").alias("own"), "anchor", "first", "shift")
    moved = F.transform("spans", lambda s: F.struct((s["from"] + F.col("shift")).alias("from"), (s["to"] + F.col("shift")).alias("to")))
    return found.join(own, (F.col("bucket") == F.col("b")) & (F.col("digest") == F.col("own"))).select("anchor", F.col("first").alias("digest"), moved.alias("spans"))


def _judged(reads: DataFrame, length: int, bucket_reads: int, scratch: common.Scratch) -> DataFrame:
    """(anchor, digest, spans) of reads with windows that occur again; buckets of too many reads are halved until they fit."""
    sizes = reads.groupBy("bucket").agg(F.count("*").alias("reads")).where(F.col("reads") > bucket_reads).select("bucket")
    large, level = scratch.stage(sizes, "repeats-large"), 0
    if large.isEmpty():
        return _columnwise(reads, length).withColumnRenamed("bucket", "anchor")
    out = _columnwise(reads.join(large, "bucket", "left_anti"), length).withColumnRenamed("bucket", "anchor")
    start = [F.col("bucket").alias("anchor"), F.col("digest").alias("first"), F.lit(0).cast("bigint").alias("shift")]
    now = reads.join(large, "bucket", "left_semi").select(*start, "bucket", "digest", "n", "text", "ahead", F.lit(GRAM - length).alias("low"), F.lit(0).alias("high"))
    while not large.isEmpty():
        level += 1
        parts = scratch.stage(_halved(now, length), f"repeats-halves{level}", wide=True)
        sizes = parts.groupBy("bucket").agg(F.count_distinct("digest").alias("reads"), F.sum("n").alias("all"))
        sizes = scratch.stage(sizes.where("all > 1"), f"repeats-sizes{level}")
        large = sizes.where(F.col("reads") > bucket_reads).select("bucket")
        fits = parts.join(sizes.where(F.col("reads") <= bucket_reads).select("bucket"), "bucket", "left_semi")
        distinct = fits.groupBy("bucket", "digest").agg(F.sum("n").alias("n"), F.first("text").alias("text"), F.first("ahead").alias("ahead"))
        out = out.unionByName(scratch.stage(_of_origin(_columnwise(distinct, length), fits), f"repeats-found{level}"))
        now = parts.join(large, "bucket", "left_semi")
    return out


def _recurring(sketches: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The sketches whose anchor occurs twice or more, and mixed: whether reads of that anchor differ.

    The anchors are staged, so that both sides of the join are plain shuffles: then Spark splits the task of an anchor
    with a large share of the reads, which it does not if one side is aggregated in the same stage.
    """
    hashes = [F.xxhash64(F.lit(k), "digest") for k in range(2)]  # of 128 bits in all; the least digest itself would take a sort
    differ = [F.min(h) != F.max(h) for h in hashes]
    anchors = sketches.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("reads"), (differ[0] | differ[1]).alias("mixed"))
    often = scratch.stage(anchors.where("reads > 1").select("a", "mixed"), "repeats-often")
    return sketches.join(often, F.col("anchor") == F.col("a")).drop("a")


def spans(docs: DataFrame, length: int = LENGTH, bucket_reads: int = BUCKET_READS, scratch: common.Scratch | None = None) -> DataFrame:
    """(key, spans) of the texts of docs (id string, text) that hold strings of length bytes that start elsewhere too, key being the text's digest."""
    scratch = scratch or common.Scratch()
    sketches = scratch.stage(_sketches(docs, length), "repeats-anchors")
    again = scratch.stage(_recurring(sketches, scratch), "repeats-again")
    rep = F.min(F.struct("key", "id", "start", "size", "ahead")).alias("rep")
    reads = scratch.stage(again.groupBy("anchor", "digest", "mixed").agg(F.count("*").alias("n"), rep), "repeats-reads")
    texts = scratch.stage(_fetched(docs, reads.where("mixed")), "repeats-texts")
    found = _judged(texts, length, bucket_reads, scratch)
    alone = reads.where("not mixed").select("anchor", "digest", F.array(F.struct(F.lit(0).cast("bigint").alias("from"), F.col("rep.size").cast("bigint").alias("to"))).alias("spans"))
    all_spans = scratch.stage(found.unionByName(alone).select(F.col("anchor").alias("a"), F.col("digest").alias("d"), "spans"), "repeats-spans")
    placed = again.select("key", "start", "anchor", "digest").join(all_spans, (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("d")))
    placed = placed.select("key", F.explode("spans").alias("s"), "start").select("key", (F.col("start") + F.col("s.from")).alias("from"), (F.col("start") + F.col("s.to")).alias("to")).distinct()
    return placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))


_RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bucket_reads: int = BUCKET_READS, digest: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept) of each row: its text's UTF-8 bytes without those covered by a string of length bytes that also starts elsewhere.

    Elsewhere is another place of the same text or any other row, so of two equal rows both lose all from length bytes
    on. Null texts count as empty; texts under length bytes lose nothing; an empty table gives an empty one; null and
    repeated ids get a row each; extra columns are ignored. kept may cut UTF-8 sequences, so it is binary.
    A text is held whole by one task. digest: the SHA-256 of kept in its place.
    """
    kind, scratch = docs.schema[id_col].dataType.simpleString(), common.Scratch()
    own = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = own.select(F.col("doc").cast("string").alias("id"), "text")
    found = scratch.stage(spans(texts, length, bucket_reads, scratch).withColumnRenamed("key", "k"), "repeats-covered")
    keyed = own.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    joined = keyed.join(found, F.col("key") == F.col("k"), "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, text in enumerate(common.text_bytes(batch, "text")):
                own, at, gone, n = batch.column("spans")[k].as_py() or (), 0, 0, 0
                parts = []
                for s in own:
                    if s["to"] <= at:
                        continue
                    if not n or s["from"] > at:
                        parts.append(text[at : s["from"]])
                        n += 1
                        at = s["from"]
                    gone += s["to"] - at
                    at = s["to"]
                parts.append(text[at:])
                kept = b"".join(parts)
                out.append((len(text), gone, n, hashlib.sha256(kept).digest() if digest else kept))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    result = joined.mapInArrow(common.freeing(run), f"doc {kind}, {_RESULT}").withColumnRenamed("doc", id_col)
    return scratch.result(result, "repeats")
