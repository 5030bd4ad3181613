"""Encoding of text columns with a vocabulary's merge ranks, for operators that need ids and not the merging itself.

A space followed by a non-space always starts a new piece in the vocabulary's splitting pattern, so a text without
runs of white space is cut at its spaces, each distinct word of a batch is encoded once, and the ids are gathered
by word number. All other texts are encoded whole. The ids are those of the tokenizers library.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

from . import bpe

#: Bytes of text that are best encoded together.
SLICE_BYTES = 8 << 20
#: RE2: a space before white space or at the end.
_RUN = r" (?:[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"


class RankEncoder:
    """Ids of text columns. The vocabulary's ids must rise with its merge ranks, which is checked."""

    def __init__(self, path: str):
        vocab = bpe.Bpe(path)
        if any(a >= b for a, b in zip(vocab.merged, vocab.merged[1:], strict=False)):
            raise ValueError(f"the ids of {path} do not follow its merge ranks")
        self.special = vocab.special
        ranks = {b: i for i, b in enumerate(vocab.bytes_of) if b and i not in set(self.special.values())}
        self._core = tiktoken.Encoding("ranks", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._size = np.array([len(b) for b in vocab.bytes_of], dtype=np.int64)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _plain(self, text: str) -> np.ndarray:
        return np.frombuffer(self._core.encode_to_tiktoken_buffer(text, set()), dtype="<u4") if text else np.zeros(0, dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text; special tokens in it are themselves."""
        parts = self._cut.split(text) if self._cut else [text]
        return np.concatenate([np.array([self.special[p]], dtype="<u4") if p in self.special else self._plain(p) for p in parts])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end); null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        odd = pc.match_substring_regex(texts, _RUN)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        whole = texts.filter(odd).to_pylist()
        cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        words, starts = cut.flatten(), cut.offsets.to_numpy()
        first = np.zeros(len(words), dtype=bool)
        first[starts[:-1]] = True
        later = words.filter(pa.array(~first)).dictionary_encode()
        known = later.dictionary.to_pylist()
        ids = self._plain("".join(f" {w}" for w in known))
        ends = np.cumsum([len(w) for w in later.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.int64) + np.arange(1, len(known) + 1)
        sizes = np.diff(np.searchsorted(np.cumsum(self._size[ids]), ends) + 1, prepend=0) if known else np.zeros(0, dtype=np.int64)
        alone = [self.encode(t) for t in whole]
        heads = [self._plain(w) for w in words.filter(pa.array(first)).to_pylist()]
        for k, own in zip(np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist(), alone, strict=True):
            heads[k] = own
        pool = np.concatenate([ids, *heads])
        sizes = np.concatenate([sizes, [len(h) for h in heads]]).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        number = np.empty(len(words), dtype=np.int64)
        number[~first] = later.indices.to_numpy()
        number[first] = len(known) + np.arange(len(heads))
        size = sizes[number]
        upto = np.cumsum(size)
        out = pool[np.repeat(begins[number] - (upto - size), size) + np.arange(upto[-1])]
        return out, np.concatenate([[0], upto[starts[1:] - 1]])


@lru_cache(maxsize=2)
def load(path: str) -> RankEncoder:
    """One encoder per worker process."""
    return RankEncoder(path)

