"""Encoding whole texts chunk by chunk with a bounded cache, for byte-level BPE vocabularies in the tokenizers library's JSON form.

A space that follows a non-space always starts a new piece in the vocabulary's splitting pattern, and so do a
single mark between a letter and white space or the text's end, and a single line break between non-spaces and
what follows it. A text can be cut there and each chunk encoded on its own, once; no special token may hold such a place.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

import numpy as np

#: Cached chunks before the cache starts anew; about 200 bytes each.
CACHE_CHUNKS = 400_000
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f" [{_SPACE}]")
_MARK = re.compile(r"(?<=[^\W\d_])([.,;:])(?=[ \n]|\Z)")
_BREAK = re.compile(f"(?<=[^{_SPACE}])\n(?=[^{_SPACE}])")
_CHUNKS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a vocabulary: in the folder TESSERA_TOKENIZERS names, or where the installed package of public tokenizers has it."""
    folder = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


class ChunkEncoder:
    """Encodes texts with a function that encodes many distinct chunks at once, each to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]]):
        self.encode_chunks = encode_chunks
        self.cache: dict[str, bytes] = {}  # a chunk that starts with a single space is kept without it, any other after NUL

    def encode_many(self, texts: list[str]) -> list[bytes]:
        cut = [self._parts(t) for t in texts]
        seen: set[str] = set()
        for parts in cut:
            seen.update(parts)
        new = list(seen.difference(self.cache))
        if len(self.cache) + len(new) > CACHE_CHUNKS:
            self.cache.clear()
            new = list(seen)
        chunks = [c[1:] if c[:1] == "\0" else " " + c for c in new]
        self.cache.update(zip(new, self.encode_chunks(chunks), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    @staticmethod
    def _parts(text: str) -> list[str]:
        if not text:
            return []
        if _RUN.search(text) or "\0" in text:
            return ["\0" + c for c in _CHUNKS.findall(text)]
        text = _MARK.sub(" \0\\1", text)
        if "\n" in text:
            text = _BREAK.sub(" \0\n \0", text)
        parts = text.split(" ")
        parts[0] = "\0" + parts[0]
        return parts


def id_lists(encoded: Iterable[bytes]):
    """A list<int32> Arrow array of encoded texts."""
    import pyarrow as pa

    encoded = list(encoded)
    offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    values = np.frombuffer(b"".join(encoded), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))
