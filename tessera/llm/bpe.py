"""Byte-level BPE encoding and decoding.

A piece is merged with a segment tree over the ranks of its adjacent pairs: a leaf holds rank and place of
the pair that starts there, an inner node the smaller of its children, so the root is the leftmost pair of
lowest rank; a merge changes at most three leaves, each in logarithmic time.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Fixed value: the pattern that cuts a text into pieces before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 62
#: Tree sizes of pieces that are merged many at a time (longer ones go one by one), and how many at a time.
SIZES, ROWS = (8, 16, 64), 4096
BATCH_TEXTS = 512


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes are themselves, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.byte_id = [0] * 256
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            self.rank[vocab[a] << 32 | vocab[b]] = r
            self.merged.append(vocab[a + b])
        order = sorted(self.rank)
        self.keys = np.array(order, dtype=np.int64)
        self.key_rank = np.array([self.rank[k] for k in order], dtype=np.int64)
        self.merged_ids = np.array(self.merged, dtype=np.int64)
        self.byte_ids = np.array(self.byte_id, dtype=np.int64)
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            known = all(c in symbols for c in token)
            self.bytes_of[i] = bytes(symbols[c] for c in token) if known else token.encode()
        self._find = regex.compile(PATTERN).findall
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n, rank = len(piece), self.rank
        ids = [self.byte_id[b] for b in piece]
        if n < 2:
            return ids
        size = 1 << max(0, (n - 2).bit_length())
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            r = rank.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = r << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), self.merged
        while (top := tree[1]) != NONE:
            i = top & 0xFFFFFFFF
            j = after[i]
            ids[i] = new = merged[top >> 32]
            ids[j] = -1
            k = after[i] = after[j]
            changed = []
            if k < n:
                before[k] = i
                r = rank.get(new << 32 | ids[k])
                changed.append((i, NONE if r is None else r << 32 | i))
            else:
                changed.append((i, NONE))
            if j < n - 1:
                changed.append((j, NONE))
            if i:
                h = before[i]
                r = rank.get(ids[h] << 32 | new)
                changed.append((h, NONE if r is None else r << 32 | h))
            for at, value in changed:
                at += size
                if tree[at] == value:
                    continue
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    if other < value:
                        value = other
                    at >>= 1
                    if tree[at] == value:
                        break
                    tree[at] = value
        return [x for x in ids if x >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of many pieces at once, each to bytes: the pieces' trees are rows of one array and step together."""
        out = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(next((s for s in SIZES if len(p) <= s), 0), []).append(i)
        for i in by_size.pop(0, []):
            out[i] = array("I", self.merge(pieces[i])).tobytes()
        for size, where in by_size.items():
            for at in range(0, len(where), ROWS):
                own = where[at : at + ROWS]
                for i, ids in zip(own, self._merge_rows([pieces[i] for i in own], size), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        rows = len(pieces)
        n = np.array([len(p) for p in pieces])
        ids = self.byte_ids[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, size)]
        col = np.arange(size)
        tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        tree[:, size : 2 * size - 1] = np.where((rank >= 0) & (col[:-1] < n[:, None] - 1), rank << 32 | col[:-1], NONE)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.tile(col + 1, (rows, 1))
        before = np.tile(col - 1, (rows, 1))
        live = col < n[:, None]
        flat_tree, width = tree.reshape(-1), 2 * size
        r = np.flatnonzero(tree[:, 1] != NONE)
        while len(r):
            top = tree[r, 1]
            i = top & 0xFFFFFFFF
            j = after[r, i]
            new = self.merged_ids[top >> 32]
            ids[r, i] = new
            live[r, j] = False
            k = after[r, j]
            after[r, i] = k
            right = k < n[r]
            before[r[right], k[right]] = i[right]
            own = self._ranks(new, ids[r, np.minimum(k, size - 1)])
            own = np.where(right & (own >= 0), own << 32 | i, NONE)
            h = before[r, i]
            left = h >= 0
            prev = self._ranks(ids[r, h], new)
            prev = np.where(prev >= 0, prev << 32 | h, NONE)
            base = r * width
            at = np.concatenate([base + size + i, base + size + j, (base + size + h)[left]])
            flat_tree[at] = np.concatenate([own, np.full(len(r), NONE), prev[left]])
            base = np.concatenate([base, base, base[left]])
            node = at - base
            for _ in range(size.bit_length() - 1):
                node >>= 1
                two = base + 2 * node
                flat_tree[base + node] = np.minimum(flat_tree[two], flat_tree[two + 1])
            r = r[tree[r, 1] != NONE]
        data = ids[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [data[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        if len(self.pieces) > tokens.CACHE_CHUNKS:
            self.pieces.clear()
        joined = "\n".join(chunks)
        if any(s in joined for s in self.special):
            return [self._with_special(c) if any(s in c for s in self.special) else self._plain([c])[0] for c in chunks]
        return self._plain(chunks)

    def _with_special(self, chunk: str) -> bytes:
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self._plain([x])[0] for x in self._cut.split(chunk) if x)

    def _plain(self, chunks: list[str]) -> list[bytes]:
        """Chunks of one piece are merged as they are; the pieces of the others are kept, as they recur in other chunks."""
        single, many = [], []
        for i, c in enumerate(chunks):
            (single if (c[1:] if c[:1] == " " else c).isalpha() else many).append(i)
        out = [b""] * len(chunks)
        for i, ids in zip(single, self.merge_many([chunks[i].encode() for i in single]), strict=True):
            out[i] = ids
        if many:
            parts = [self._find(chunks[i]) for i in many]
            new = list({p for own in parts for p in own}.difference(self.pieces))
            self.pieces.update(zip(new, self.merge_many([p.encode() for p in new]), strict=True))
            get = self.pieces.__getitem__
            for i, own in zip(many, parts, strict=True):
                out[i] = b"".join(map(get, own))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Bpe, tokens.ChunkEncoder]:
    """The vocabulary and its encoder, one per worker process."""
    bpe = Bpe(path)
    return bpe, tokens.ChunkEncoder(bpe.encode_chunks)


def forget(path: str) -> None:
    """Empties the worker's caches where they have grown beyond what the next task soon has again; the vocabulary stays."""
    bpe, enc = load(path)
    if len(bpe.pieces) + len(enc.cache) > tokens.CACHE_CHUNKS // 4:
        bpe.pieces.clear()
        enc.cache.clear()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids: array<int>) of each row's whole text; null counts as empty, which has no ids. Extra columns are ignored."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, enc = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                b = whole.slice(at, BATCH_TEXTS)
                ids = tokens.id_lists(enc.encode_many([t or "" for t in b.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column("id"), ids], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.freeing(run, lambda: forget(path)), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, text): the text that the ids stand for; bytes that are no UTF-8 become U+FFFD, null or no ids the empty text."""
    common.prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(load(path)[0].bytes_of, type=pa.large_binary())
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                b = whole.slice(at, BATCH_TEXTS)
                lists = b.column("ids").to_pylist() if b.column("ids").null_count else None
                ids = b.column("ids") if lists is None else pa.array([x or [] for x in lists], type=pa.list_(pa.int32()))
                flat = ids.flatten()
                took = table.take(flat) if len(flat) else pa.array([], type=pa.large_binary())
                ends = np.frombuffer(took.buffers()[1], dtype=np.int64, count=len(took) + 1) if len(took) else np.zeros(1, dtype=np.int64)
                data = took.buffers()[2].to_pybytes() if len(took) else b""
                at_token = np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
                cuts = ends[at_token].tolist()
                texts = [data[x:y].decode("utf-8", "replace") for x, y in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column("id"), ids, pa.array(texts, type=pa.string())], [id_col, "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(common.freeing(run), f"`{id_col}` {kind}, ids array<int>, text string")
