"""Language-model scoring from a log-frequency Bloom filter.

Texts are read once: a block of some texts becomes a row with its distinct words' hashes and every token's word
number, and is staged. Each block sends its words, and the words that follow each of them, to the segments that the
hashes of the (first) words name, with their counts in training texts. A segment sums the counts, quantises a count c
to the level floor(log2 c) + 1, puts the n-gram into its Bloom filter once for each level up to its own, and then
answers every block by probes that ask level after level until one is missing. So the filter grows with the corpus,
and no machine holds more than a segment of it.

Model: a word's unigram chance is its quantised count plus one, over the sum for all training words and one for the
unknown word; after a word h it is (quantised bigram count + T x unigram chance) / (S + T), where S is the sum of the
quantised bigram counts of h and T the number of words seen after h, both taken from the levels put into the filter.
So the chances of all words after any word sum to one, but for false positives of the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits an insertion; probes a level.
BITS_EACH, PROBES = 12, 4
#: A segment's bits as planned; text of a block; tokens of a block from which a word counts as possibly hot.
SEGMENT_BYTES, BLOCK_BYTES, HEAVY = 4 << 20, 6 << 20, 64
END = xxhash.xxh64_intdigest(b"\n", 7)  # no word holds a line break
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD, _LOW40 = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 40) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment that each hash names; it rises with the hash."""
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _hashes(grams: np.ndarray, n: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First hash and step of each (n-gram, level)."""
    a = mix(grams + np.uint64(n * 0x632BE59BD9B4E019 + level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return a, mix(a ^ _M1) | np.uint64(1)


def _place(h: np.ndarray, width: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def level_of(c: np.ndarray) -> np.ndarray:
    """The level of each count: floor(log2 c) + 1, 0 for none."""
    return np.where(c > 0, np.frexp(c.astype(np.float64))[1], 0)


def twice_count(level: np.ndarray) -> np.ndarray:
    """Twice the middle of the counts of each level: 2, 5, 11, 23 ...; 0 for none."""
    return np.where(level > 0, 3 * (np.int64(1) << np.maximum(level, 1).astype(np.int64) - 1) - 1, 0)


def put(bits: np.ndarray, grams: np.ndarray, n: int, level: np.ndarray) -> None:
    """Sets the bits of each n-gram's levels up to its own."""
    for at in range(int(level.max(initial=0))):
        a, step = _hashes(grams[level > at], n, at)
        for k in range(PROBES):
            b = _place(a + np.uint64(k) * step, len(bits) * 8)
            np.bitwise_or.at(bits, b >> 3, (1 << (b & 7)).astype(np.uint8))


def probe(bits: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """Each n-gram's highest level, by repeated probes until one is missing; 0 if it is unseen."""
    out = np.zeros(len(grams), dtype=np.uint8)
    live, level = np.arange(len(grams)), 0
    while len(live) and level < 64:
        a, step = _hashes(grams[live], n, level)
        for k in range(PROBES):
            b = _place(a + np.uint64(k) * step, len(bits) * 8)
            hit = bits[b >> 3] >> (b & 7).astype(np.uint8) & 1 == 1
            live, a, step = live[hit], a[hit], step[hit]
        level += 1
        out[live] = level
    return out


def pack(a: np.ndarray) -> bytes:
    """Numbers as the narrowest unsigned kind that holds them all."""
    top = int(a.max(initial=0))
    return a.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if top < 1 << 8 * w)).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct word hashes, each token's word number, each text's number of tokens); every text ends in END."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = cut.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # leading white space gives empty ones
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
    coded = words.filter(real).dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()] + [END], dtype=np.uint64)
    hashes, number = np.unique(own, return_inverse=True)
    return hashes, np.insert(number[:-1][coded.indices.to_numpy()], before[1:], number[-1]).astype(np.uint32), np.diff(before) + 1


_BLOCK = "block bigint, ids array<{}>, held binary, lens binary, words binary, numbers binary, tokens bigint, heavy array<struct<w:bigint,c:bigint>>"


def blocks_of(rows: DataFrame, folds: int, held: int) -> DataFrame:
    """Rows (id, text) as blocks of at most BLOCK_BYTES of text, or of one longer text."""
    kind = rows.schema["id"].dataType.simpleString()
    pair = pa.struct([("w", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, waiting, size, done = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            ids = table.column("id").combine_chunks()
            words, numbers, lens = _tokens(table.column("text").combine_chunks().cast(pa.large_string()).fill_null(""))
            out = np.array([common.crc_mod(i, folds) == held for i in ids.to_pylist()])
            c = np.bincount(numbers[~np.repeat(out, lens)], minlength=len(words))
            heavy = [{"w": w, "c": n} for w, n in zip(words[c >= HEAVY].view(np.int64).tolist(), c[c >= HEAVY].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            cols = [pa.array([first + done]), lists, *(pa.array([x], pa.binary()) for x in (pack(out), pack(lens), words.tobytes(), pack(numbers)))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([len(numbers)]), pa.array([heavy], pa.list_(pair))], ["block", "ids", "held", "lens", "words", "numbers", "tokens", "heavy"])

        for whole in batches:
            for b in common.slices(whole, "text", BLOCK_BYTES):
                n = b.column("text").nbytes
                if waiting and size + n > BLOCK_BYTES:
                    yield flush()
                    size, done = 0, done + 1
                waiting.append(b)
                size += n
        if waiting:
            yield flush()

    return rows.mapInArrow(common.freeing(run), _BLOCK.format(kind))


class Block:
    """A block's words and bigrams, in the order in which segments are asked."""

    def __init__(self, row: dict, salts: dict[int, int]):
        self.ids = row["ids"]
        n = len(self.ids)
        self.held, self.lens = unpack(row["held"], n).astype(bool), unpack(row["lens"], n)
        self.words = np.frombuffer(row["words"], dtype=np.uint64)
        self.numbers = unpack(row["numbers"], int(self.lens.sum()))
        self.starts = np.cumsum(self.lens) - self.lens
        before = np.roll(self.numbers, 1)
        before[self.starts] = np.searchsorted(self.words, np.uint64(END))
        self.before = before
        self.hot = np.array([salts.get(w, 1) for w in self.words.view(np.int64).tolist()]) if salts else np.ones(len(self.words), dtype=np.int64)

    def bigrams(self, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (word before, word) as two numbers in one, and how often each stands in training texts, or each token's place among them."""
        pair = self.before << 32 | self.numbers
        if inverse:
            return np.unique(pair, return_inverse=True)
        key = np.sort(pair << 1 | np.repeat(self.held, self.lens))
        first = np.flatnonzero(np.concatenate([[True], key[1:] >> 1 != key[:-1] >> 1]))
        return key[first] >> 1, np.add.reduceat(1 - (key & 1), first)

    def split(self, pairs: np.ndarray, segments: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
        """(segment, salted, keys, words before, places of bigrams, key by key) of everything that is asked; followers of hot words go by salted keys."""
        ahead, word = pairs >> 32, pairs & 0xFFFFFFFF
        salt = np.zeros(len(pairs), dtype=np.int64)
        hot = np.flatnonzero(self.hot[ahead] > 1)
        salt[hot] = (mix(self.words[word[hot]]) % self.hot[ahead[hot]].astype(np.uint64)).astype(np.int64)
        plain, salted = np.flatnonzero(salt == 0), np.flatnonzero(salt)
        yield from self._cut(False, self.words, np.arange(len(self.words)), plain, ahead[plain], segments)
        if len(salted):
            key = mix(self.words[ahead[salted]] + salt[salted].astype(np.uint64) * _GOLD)
            keys, at, entry = np.unique(key, return_index=True, return_inverse=True)
            order = np.argsort(entry, kind="stable")
            yield from self._cut(True, keys, ahead[salted][at], salted[order], entry[order], segments)

    @staticmethod
    def _cut(salted: bool, keys: np.ndarray, base: np.ndarray, places: np.ndarray, entry: np.ndarray, segments: int):
        seg = segment_of(keys, segments)  # keys are sorted, so segments rise
        cuts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])).tolist()
        ends = np.searchsorted(entry, [*cuts[1:], len(keys)]).tolist()
        for a, b, x, y in zip(cuts, [*cuts[1:], len(keys)], [0, *ends], ends, strict=False):
            yield int(seg[a]), salted, keys[a:b], base[a:b], (places[x:y], np.bincount(entry[x:y] - a, minlength=b - a))


_ASK = "seg bigint, block bigint, salted boolean, keys binary, of binary, cs binary, ns binary, after binary, times binary"
_ANSWER = "block bigint, seg bigint, salted boolean, cs binary, levels binary, sums binary, kinds binary, pairs binary, n bigint, v bigint, mass bigint, hot array<struct<w:bigint,s:bigint,t:bigint>>"


def _asks(blocks: DataFrame, segments: int, salts: dict[int, int]) -> DataFrame:
    """One row for each block and segment: keys with counts and numbers of followers, and the followers (40 bits of each word's hash) with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                b = Block(row, salts)
                pairs, times = b.bigrams(False)
                c = np.bincount(b.numbers[~np.repeat(b.held, b.lens)], minlength=len(b.words))
                after = (b.words & _LOW40).view(np.uint8).reshape(-1, 8)[:, :5]
                rows = []
                for seg, salted, keys, base, (places, ns) in b.split(pairs, segments):
                    own = np.zeros(len(base), dtype=np.int64) if salted else c[base]
                    of = b.words[base].tobytes() if salted else b""
                    rows.append((seg, row["block"], salted, keys.tobytes(), of, pack(own), pack(ns), after[pairs[places] & 0xFFFFFFFF].tobytes(), pack(times[places])))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["seg", "block", "salted", "keys", "of", "cs", "ns", "after", "times"])

    return blocks.mapInArrow(common.freeing(run), _ASK)


def _answer(table: pa.Table) -> pa.Table:
    """A segment: its filter from all blocks' counts, the answers to each block, and a row (block -1) of its sums."""
    rows = table.select(["seg", "block", "salted", "keys", "of", "cs", "ns", "after", "times"]).to_pylist()
    keys = [np.frombuffer(r["keys"], dtype=np.uint64) for r in rows]
    size = [len(k) for k in keys]
    cs, ns = (np.concatenate([unpack(r[c], n) for r, n in zip(rows, size, strict=True)]) for c in ("cs", "ns"))
    known, own = np.unique(np.concatenate(keys), return_inverse=True)
    raw = np.frombuffer(b"".join(r["after"] for r in rows), dtype=np.uint8).reshape(-1, 5)
    after = np.zeros((len(raw), 8), dtype=np.uint8)
    after[:, :5] = raw
    many = [len(r["after"]) // 5 for r in rows]
    times = np.concatenate([unpack(r["times"], n) for r, n in zip(rows, many, strict=True)])
    gram = mix(known[np.repeat(own, ns)] * _GOLD + mix(after.view(np.uint64)[:, 0]))
    grams, at, place = np.unique(gram, return_index=True, return_inverse=True)
    entry = np.repeat(own, ns)[at]
    c1 = np.bincount(own, weights=cs, minlength=len(known)).astype(np.int64)
    c2 = np.bincount(place, weights=times, minlength=len(grams)).astype(np.int64)
    l1, l2 = level_of(c1), level_of(c2)
    bits = np.zeros(-(-max(64, int(l1.sum() + l2.sum()) * BITS_EACH) // 8), dtype=np.uint8)
    put(bits, known, 1, l1)
    put(bits, grams, 2, l2)
    found1, found2 = probe(bits, known, 1), probe(bits, grams, 2)[place]
    sums = np.bincount(entry, weights=twice_count(l2), minlength=len(known)).astype(np.int64)
    kinds = np.bincount(entry, weights=l2 > 0, minlength=len(known)).astype(np.int64)
    out, x, y, hot = [], 0, 0, {}
    for r, n, m in zip(rows, size, many, strict=True):
        mine = own[x : x + n]
        if r["salted"]:
            hot |= dict(zip(known[mine].tolist(), zip(np.frombuffer(r["of"], dtype=np.int64).tolist(), sums[mine].tolist(), kinds[mine].tolist(), strict=True), strict=True))
        out.append((r["block"], r["seg"], r["salted"], pack(c1[mine]), pack(found1[mine]), pack(sums[mine]), pack(kinds[mine]), pack(found2[y : y + m]), None, None, None, None))
        x, y = x + n, y + m
    out.append((-1, rows[0]["seg"], False, *[None] * 5, int(c1.sum()), int((c1 > 0).sum()), int(twice_count(l1).sum()), [dict(zip("wst", v, strict=True)) for v in hot.values()]))
    cell = pa.struct([("w", pa.int64()), ("s", pa.int64()), ("t", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 5, *[pa.int64()] * 3, pa.list_(cell)]
    names = ["block", "seg", "salted", "cs", "levels", "sums", "kinds", "pairs", "n", "v", "mass", "hot"]
    return pa.table([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def chances(uni: np.ndarray, pair: np.ndarray, sums: np.ndarray, kinds: np.ndarray, mass: int, vocabulary: int) -> np.ndarray:
    """Each token's probability: from twice the quantised counts of the word and of the bigram, twice the sum of those after the word before, and the number of words seen after it."""
    single = (uni + 2) / (mass + 2 * (vocabulary + 1))
    return np.where(sums > 0, (np.minimum(pair, sums) + 2 * kinds * single) / np.maximum(sums + 2 * kinds, 1), single)


def score_texts(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", limit: int = SEGMENT_BYTES) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text.

    Words are told apart by 64-bit hashes, followers of a word by 40 bits. Null and empty texts are one end; with no
    training text at all, each token has the probability 1; repeated rows stay; an empty table gives an empty result;
    extra columns are ignored. A segment of the filter has about limit bytes of bits; words so frequent that what
    follows them would fill a quarter of a segment have their followers dealt over several.
    """
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scratch = common.Scratch()
    blocks = scratch.stage(blocks_of(rows, folds, held), "lm-blocks", wide=True)
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    segments = max(1, -(-2 * tokens * BITS_EACH // (8 * limit)))
    share = max(1, 2 * tokens // (4 * segments))
    often = blocks.select(F.explode("heavy").alias("h")).groupBy("h.w").agg(F.sum("h.c").alias("c")).where(F.col("c") > share)
    salts = {r["w"]: -(-r["c"] // share) for r in often.collect()}  # at most tokens / share, so 2 x segments, rows
    answers = scratch.stage(_asks(blocks.drop("heavy"), segments, salts).groupBy("seg").applyInArrow(_answer, _ANSWER), "lm-answers", wide=True)
    r = answers.where("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "mass")]).first()
    total, vocabulary, mass = r["n"], r["v"], r["mass"]
    summed = answers.where("block = -1").select(F.explode("hot").alias("h")).groupBy("h.w").agg(F.sum("h.s").alias("s"), F.sum("h.t").alias("t"))
    hot = {r["w"]: (r["s"], r["t"]) for r in summed.collect()}  # no more rows than salts has
    kind = docs.schema[id_col].dataType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = (left.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        if not left.num_rows:
            return pa.table([pa.array([], type=t) for t in types], names=names)
        b = Block(left.to_pylist()[0], salts)
        said = {(r["seg"], r["salted"]): r for r in right.to_pylist()}
        pairs, place = b.bigrams(True)
        c, level, sums, kinds = (np.zeros(len(b.words), dtype=np.int64) for _ in range(4))
        found = np.zeros(len(pairs), dtype=np.int64)
        for seg, salted, keys, base, (places, _) in b.split(pairs, segments):
            r = said[seg, salted]
            found[places] = unpack(r["pairs"], len(places))
            if not salted:
                c[base], level[base], sums[base], kinds[base] = (unpack(r[k], len(keys)) for k in ("cs", "levels", "sums", "kinds"))
        for k in np.flatnonzero(b.hot > 1).tolist():
            s, t = hot.get(int(b.words[k].view(np.int64)), (0, 0))
            sums[k], kinds[k] = sums[k] + s, kinds[k] + t
        t, h = b.numbers, b.before
        base_log = np.log10((c + 1) / (total + vocabulary + 1))
        model = np.log10(chances(twice_count(level)[t], twice_count(found)[place], sums[h], kinds[h], mass, vocabulary))
        total_of = lambda x: np.add.reduceat(x, b.starts)
        cols = (b.ids, b.held, b.lens, total_of((c > 0).astype(np.int64)[t]), np.full(len(b.lens), total), total_of(base_log[t]), total_of(model))
        return pa.table([pa.array(x, type=t) for x, t in zip(cols, types, strict=True)], names=names)

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    mine = blocks.drop("heavy", "tokens").groupBy("block").cogroup(answers.where("block >= 0").drop("n", "v", "mass", "hot").groupBy("block"))
    return scratch.result(mine.applyInArrow(score, schema), "lm-scores")
