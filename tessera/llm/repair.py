"""Repair of conversations by lazy weighted determinisation.

The roles of a repaired conversation read (s?(ua)+)?: maybe a system turn, then user and assistant in turn. An
automaton of four states accepts that; editing rows (keep, rerole, delete, insert) gives its arcs costs. Read from the
last row to the first, the cheapest cost to finish from each of the four states is a vector. Less its smallest entry
(which is carried as cost), few vectors ever occur, so each becomes a state of a deterministic automaton when it is
first met, and its arcs are kept in a table: a conversation's cost is one look-up a row. The edits follow from the
front along arcs that are tight, that is, that lose nothing against the vectors, the least letter first.

Conversations of bounded size are sorted and scanned whole. Larger ones are cut into chunks of rows in order: a chunk
is scanned from each of the four unit vectors, which gives what it does to any vector; the chunks' few numbers are
put together from the last to the first and then, as states, from the first to the last, and each chunk writes its own part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A conversation beyond either is cut into chunks, and so many rows or bytes make a chunk.
WHOLE_ROWS, WHOLE_BYTES = 20_000, 16_000_000
CHUNK_ROWS, CHUNK_BYTES = 4_096, 4_000_000

# Fixed values of the contract: costs of edits, letters of roles.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = frozenset(["su", "ua", "au"])
SPACES = " \t\n\v\f\r"

FAR = 1 << 40
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Where a state goes when it reads a role.
READS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
ACCEPTS = (START, AFTER_A)
NAMES = {"u": "user", "a": "assistant"}
#: Row classes: for each initial (s, u, a, other) whole or truncated, and rows that must go.
INITIALS = "sua?"
GONE = 8

Vector = tuple[int, int, int, int]


def _inserted(v: list[int]) -> list[int]:
    """Costs when rows may also be inserted first."""
    moved = True
    while moved:
        moved = False
        for role in NAMES:
            for p, q in READS[role].items():
                if v[q] + INSERT < v[p]:
                    v[p] = v[q] + INSERT
                    moved = True
    return v


class Determinised:
    """Normalised cost vectors as states, met lazily; table[state][row class] = (state, cost)."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self.numbers: dict[Vector, int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self.state(_inserted([0 if p in ACCEPTS else FAR for p in range(4)]))[0]

    def state(self, v: list[int]) -> tuple[int, int]:
        """The state of a vector and what was taken off it."""
        low = min(v)
        key = tuple(min(FAR, c - low) if c < FAR else FAR for c in v)
        number = self.numbers.setdefault(key, len(self.vectors))
        if number == len(self.vectors):
            self.vectors.append(key)
            self.table.append([None] * (GONE + 1))
        return number, low

    def before(self, state: int, kind: int) -> tuple[int, int]:
        """The state before a row of this class, if state is the one after it, and the cost that comes with it."""
        known = self.table[state][kind]
        if known is None:
            v = self.vectors[state]
            known = self.table[state][kind] = self.state(_inserted([min(c + v[q] for c, _, q in self.arcs(p, kind)) for p in range(4)]))
        return known

    @staticmethod
    def arcs(p: int, kind: int) -> list[tuple[int, str, int]]:
        """(cost, letter, next state) of what can be done with a row of this class."""
        out = [(DELETE, "D", p)]
        if kind != GONE:
            cost, role = TRUNCATED * (kind & 1), INITIALS[kind >> 1]
            if role in READS and p in READS[role]:
                out.append((cost, "K", READS[role][p]))
            out += [(cost + REROLE, "R", READS[r][p]) for r in NAMES if p in READS[r]]
        return out

    def scan(self, kinds: list[int], state: int) -> tuple[list[int], int]:
        """The states before each row and after the last, and the cost taken off on the way, for rows in order."""
        states, cost, table = [state], 0, self.table
        for kind in reversed(kinds):
            state, more = table[state][kind] or self.before(state, kind)
            cost += more
            states.append(state)
        states.reverse()
        return states, cost

    def trace(self, p: int, kind: int, after: int) -> tuple[str, int]:
        """The letters of the least cheapest edits at a row (insertions before it first), and the state that follows."""
        known = self.traced.get((p, kind, after))
        if known is None:
            before, low = self.before(after, kind)
            v, w, letters, at = self.vectors[before], self.vectors[after], "", p
            while letters[-1:] in ("", "I"):
                tight = [(a, q) for c, a, q in self.arcs(at, kind) if v[at] + low == c + w[q]]
                tight += [("I", q) for r in NAMES if (q := READS[r].get(at)) is not None and v[at] == INSERT + v[q]]
                a, at = min(tight)
                letters += a
            known = self.traced[p, kind, after] = letters, at
        return known

    def finish(self, p: int) -> str:
        """The insertions after the last row."""
        v, letters = self.vectors[self.end], ""
        while not (p in ACCEPTS and v[p] == 0):
            p = next(q for r in NAMES if (q := READS[r].get(p)) is not None and v[p] == INSERT + v[q])
            letters += "I"
        return letters


def _role(p: int, letter: str, own: str) -> tuple[str, int]:
    """The repaired row's role, and the next state."""
    if letter == "K":
        return own, READS[own[:1]][p]
    r = "a" if p == AFTER_U else "u"
    return NAMES[r], READS[r][p]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) after the contract's damage; rows dropped stay as empty ones with times 0.

    Null roles and texts count as one space, and so do a null conv_id or turn in the drawn number.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(drawn <= 1, "").when(drawn == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(drawn == 4, "user").when(drawn == 0, "").otherwise(space("role"))
    times = F.when(drawn == 0, 0).when(drawn == 3, 2).otherwise(1).cast("bigint")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


@dataclass
class Rows:
    """Rows of one conversation in order, each with how often it stands there; times past the first are duplicates."""

    turns: list = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    seen: list[bool] = field(default_factory=list)  # whether role and text stood earlier
    size: int = 0

    def add(self, turn, role: str, text: str, times: int, seen: bool) -> None:
        for to, x in zip((self.turns, self.roles, self.texts, self.times, self.seen), (turn, role, text, times, seen), strict=True):
            to.append(x)
        self.size += len(text)


@dataclass
class Summary:
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    least: int | None = None
    most: int | None = None
    first: str = ""
    last: str = ""

    def then(self, o: Summary) -> Summary:
        """This one's rows followed by the other's. Turns ascend, so only the turn in the middle can be in both."""
        same = self.most is not None and self.most == o.least
        return Summary(
            self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated,
            self.illegal + o.illegal + (self.last + o.first not in LEGAL), self.turns + o.turns - same,
            o.least if self.least is None else self.least, self.most if o.most is None else o.most, self.first, o.last,
        )

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def judge(rows: Rows) -> tuple[list[int], Summary]:
    """The class of each row's first time, and the faults of all."""
    kinds, s, before = [], Summary(), None
    for role, text, times, seen in zip(rows.roles, rows.texts, rows.times, rows.seen, strict=True):
        initial, bare = role[:1] or "?", text.rstrip(SPACES)
        if before is not None:
            s.illegal += before + initial not in LEGAL
        s.illegal += times - 1  # no role follows itself
        before = initial
        if not bare:
            s.blank += times
            kinds.append(GONE)
            continue
        s.duplicate += times - 1
        if seen:
            s.duplicate += 1
            kinds.append(GONE)
            continue
        cut = bare[-1] not in ".!?"
        s.truncated += cut
        kinds.append(2 * (INITIALS.index(initial) if initial in "sua" else 3) + cut)
    known = {t for t in rows.turns if t is not None}
    s.turns, s.least, s.most = len(known), min(known, default=None), max(known, default=None)
    s.first, s.last = (rows.roles[0][:1] or "?", rows.roles[-1][:1] or "?") if rows.roles else ("", "")
    return kinds, s


def write(rows: Rows, kinds: list[int], states: list[int], machine: Determinised, p: int) -> tuple[str, list[str], int]:
    """The audit and the repaired rows from state p on, and the state that follows."""
    audit, out = [], []
    for i, kind in enumerate(kinds):
        letters, _ = machine.trace(p, kind, states[i + 1])
        for a in letters:
            if a != "D":
                role, p = _role(p, a, rows.roles[i])
                out.append(f"{role}:{'' if a == 'I' else rows.texts[i]}")
        audit.append(letters + "D" * (rows.times[i] - 1))
    return "".join(audit), out, p


def end_of(machine: Determinised, p: int) -> tuple[str, list[str]]:
    letters, out = machine.finish(p), []
    for a in letters:
        role, p = _role(p, a, "")
        out.append(f"{role}:")
    return letters, out


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def _values(s: Summary, cost: int, audit: str, sha: str) -> tuple:
    return s.gaps(), s.blank, s.duplicate, s.truncated, s.illegal, cost, audit, sha


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """(key, row) of sorted batches, where the key is the first column."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[:keys], row[keys:]


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _whole(rows: DataFrame, kind: str, arrow: pa.DataType) -> DataFrame:
    """Conversations of bounded size: all rows of one lie in a partition, in order."""

    def done(machine: Determinised, own: Rows) -> tuple:
        kinds, s = judge(own)
        states, cost = machine.scan(kinds, machine.end)
        audit, out, p = write(own, kinds, states, machine, START)
        more, last = end_of(machine, p)
        cost += machine.vectors[states[0]][START] + DELETE * (sum(own.times) - len(kinds))
        return _values(s, cost, audit + more, hashlib.sha256("\n".join(out + last).encode()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, own, known, out = Determinised(), None, Rows(), set(), []
        for key, (turn, role, text, times) in _groups(batches, 1):
            if key != now:
                if now is not None:
                    out.append((*now, *done(machine, own)))
                now, own, known = key, Rows(), set()
                if len(out) >= 2_000:
                    yield _table(out, ["conv_id", *_COLUMNS], [arrow, *_TYPES])
                    out = []
            if times:
                own.add(turn, role, text, times, (role, text) in known)
                known.add((role, text))
        if now is not None:
            out.append((*now, *done(machine, own)))
        if out:
            yield _table(out, ["conv_id", *_COLUMNS], [arrow, *_TYPES])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, {RESULT}")


_ROWS = "turns array<bigint>, roles array<string>, texts array<string>, times array<bigint>, seen array<boolean>"
_SUMMARY = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, least bigint, most bigint, first string, last string"


def _chunks(rows: DataFrame, kind: str, arrow: pa.DataType) -> DataFrame:
    """(conv_id, part, seq, rows) of large conversations: parts in order of ranges of rows, chunks in order within a part."""
    own = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    words = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    firsts = own.groupBy(F.col("conv_id").alias("c"), words.alias("words")).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    join = own["conv_id"].eqNullSafe(firsts["c"]) & (words == firsts["words"])
    marked = own.join(firsts, join, "left").select("conv_id", "turn", "role", "text", "times", F.coalesce(~F.col("first.at").eqNullSafe(F.col("turn")) & F.col("n").isNotNull(), F.lit(False)).alias("seen"))
    order_by = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = marked.repartitionByRange(common.shuffle_partitions(rows.sparkSession), *order_by).sortWithinPartitions(*order_by)
    types = [arrow, pa.int32(), pa.int32(), *(pa.list_(t) for t in (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()))]
    names = ["conv_id", "part", "seq", "turns", "roles", "texts", "times", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, held, seq = TaskContext.get().partitionId(), None, Rows(), 0
        line = lambda: _table([(*now, part, seq, held.turns, held.roles, held.texts, held.times, held.seen)], names, types)
        for key, row in _groups(batches, 1):
            if held.roles and (key != now or len(held.roles) >= CHUNK_ROWS or held.size >= CHUNK_BYTES):
                yield line()
                held, seq = Rows(), seq + 1
            now = key
            held.add(*row)
        if held.roles:
            yield line()

    return ordered.mapInArrow(run, f"conv_id {kind}, part int, seq int, {_ROWS}")


def _by_chunk(chunks: DataFrame, extra: list[str], f, schema: str, types: list[pa.DataType]) -> DataFrame:
    """f(rows, extra values) of each chunk, as columns of the schema beside conv_id, part and seq."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Determinised()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Rows(*row[3:8])
                yield _table([(*row[:3], *f(machine, own, *row[8:]))], ["conv_id", "part", "seq", *names], [batch.schema.field(0).type, pa.int32(), pa.int32(), *types])

    return chunks.select("conv_id", "part", "seq", "turns", "roles", "texts", "times", "seen", *extra).mapInArrow(run, f"conv_id {kind}, part int, seq int, {schema}")


def _folded(parts: DataFrame, ascending: bool, f, schema: str, types: list[pa.DataType]) -> DataFrame:
    """f's rows from the chunks' rows of each conversation, streamed in the order of chunks."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, state = Determinised(), None, None

        def told(rows: list[tuple], key: tuple) -> list[tuple]:
            return [(*key, *r) for r in rows]

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:1] != now:
                    if now is not None:
                        out += told(f(machine, state, None)[1], now)
                    now, state = row[:1], None
                state, rows = f(machine, state, row[1:])
                out += told(rows, now)
            yield _table(out, ["conv_id", *names], [batch.schema.field(0).type, *types])
            kept = batch.schema.field(0).type
        if now is not None:
            yield _table(told(f(machine, state, None)[1], now), ["conv_id", *names], [kept, *types])

    way = [F.asc(c) if ascending else F.desc(c) for c in ("part", "seq")]
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", *way).mapInArrow(run, f"conv_id {kind}, {schema}")


def _chunk_effect(machine: Determinised, own: Rows) -> tuple:
    """What a chunk does: costs from each state before it to each state after it, and its faults."""
    kinds, s = judge(own)
    effect, gone = [], DELETE * (sum(own.times) - len(kinds))
    for r in range(4):
        start, low = machine.state([0 if q == r else FAR for q in range(4)])
        states, cost = machine.scan(kinds, start)
        effect.append([min(FAR, c + low + cost + gone) for c in machine.vectors[states[0]]])
    return effect, *vars(s).values()


def _from_the_end(machine: Determinised, v: list[int] | None, row: tuple | None) -> tuple:
    """The vector after each chunk, less its smallest entry; at last the cost and the faults of all, as the row of part -1."""
    if row is None:
        return None, [(-1, -1, v[0][:1], *vars(v[1]).values())]
    v, later = v or (list(machine.vectors[machine.end]), None)
    part, seq, effect, *faults = row
    low, own = min(v), Summary(*faults)
    told = [(part, seq, [c - low for c in v], *([None] * len(vars(own))))]
    new = [min(FAR, *(effect[r][p] + v[r] for r in range(4))) for p in range(4)]
    return (new, own.then(later) if later else own), told


def _exits(machine: Determinised, own: Rows, after: list[int]) -> tuple:
    """The state after the chunk for each state before it (none: -1)."""
    kinds, _ = judge(own)
    states, _ = machine.scan(kinds, machine.state(after)[0])
    return ([write(own, kinds, states, machine, p)[2] if machine.vectors[states[0]][p] < FAR else -1 for p in range(4)],)


def _from_the_start(machine: Determinised, p: int | None, row: tuple | None) -> tuple:
    if row is None:
        return None, []
    p = START if p is None else p
    part, seq, exits = row
    return exits[p], [(part, seq, p)]


def _written(machine: Determinised, own: Rows, after: list[int], p: int) -> tuple:
    kinds, _ = judge(own)
    states, _ = machine.scan(kinds, machine.state(after)[0])
    audit, out, p = write(own, kinds, states, machine, p)
    return audit, "\n".join(out).encode() if out else None, p


def _put_together(machine: Determinised, held: tuple | None, row: tuple | None) -> tuple:
    """Audits and repaired rows of all chunks in order: the rows go into a running hash and are not held."""
    audit, sha, started, end = held or ([], hashlib.sha256(), False, START)
    if row is None:
        more, last = end_of(machine, end)
        for line in last:
            sha.update((b"\n" if started else b"") + line.encode())
            started = True
        return None, [("".join(audit) + more, sha.hexdigest())]
    _, _, own, lines, p = row
    audit.append(own)
    if lines is not None:
        sha.update((b"\n" if started else b"") + lines)
    return (audit, sha, started or lines is not None, p), []


def _large(rows: DataFrame, kind: str, arrow: pa.DataType, scratch: common.Scratch) -> DataFrame:
    ints, at = pa.list_(pa.int64()), ["part", "seq"]
    chunks = scratch.stage(_chunks(rows, kind, arrow), "repair-chunks", wide=True)
    summary = [pa.int64()] * 7 + [pa.string()] * 2
    effects = _by_chunk(chunks, [], _chunk_effect, f"effect array<array<bigint>>, {_SUMMARY}", [pa.list_(ints), *summary])
    told = scratch.stage(_folded(effects, False, _from_the_end, f"part int, seq int, after array<bigint>, {_SUMMARY}", [pa.int32(), pa.int32(), ints, *summary]), "repair-ends")
    afters = told.where("part >= 0").select("conv_id", *at, "after")

    def beside(more: DataFrame, chunks: DataFrame) -> DataFrame:
        more = more.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("seq").alias("s"), *[c for c in more.columns if c not in ("conv_id", *at)])
        return chunks.join(more, chunks["conv_id"].eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).drop("c", "p", "s")

    with_after = beside(afters, chunks)
    exits = _by_chunk(with_after, ["after"], _exits, "exits array<bigint>", [ints])
    entries = scratch.stage(_folded(exits, True, _from_the_start, "part int, seq int, entry int", [pa.int32()] * 3), "repair-entries")
    written = _by_chunk(beside(entries, with_after), ["after", "entry"], _written, "audit string, lines binary, p int", [pa.string(), pa.binary(), pa.int32()])
    texts = _folded(written, True, _put_together, "audit string, repaired_sha256 string", [pa.string(), pa.string()])
    totals = told.where("part = -1").select(F.col("conv_id").alias("c"), F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("after")[0].alias("cost"))
    return totals.join(texts, F.col("c").eqNullSafe(F.col("conv_id"))).select("conv_id", *_COLUMNS)


def repair(rows: DataFrame, whole_rows: int = WHOLE_ROWS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text, times): its faults, the cost of its cheapest repair, the edits and the repaired rows' SHA-256.

    Rows stand in the order of turns (nulls first); of equal turns, in the order of role and text. times says how often
    a row stands there; rows with times 0 are none, but their conversation gets its row: zeros, an empty audit and the
    empty text's hash. Null conversations are one; roles and texts must not be null. Equal rows count as duplicates
    after the first. An empty table gives an empty one; extra columns are ignored. Texts are held whole, and
    conversations up to whole_rows and whole_bytes; a larger one is cut into chunks, and only its audit, which is one
    value of the result, is held whole. Its repaired rows pass one task in order, since they share one hash.
    """
    kind, scratch = rows.schema["conv_id"].dataType.simpleString(), common.Scratch()
    arrow = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "times")
    sizes = rows.groupBy(F.col("conv_id").alias("c")).agg(F.sum("times").alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))
    large = scratch.stage(sizes.where((F.col("n") > whole_rows) | (F.col("bytes") > whole_bytes)).select("c"), "repair-large")
    if large.isEmpty():
        return _whole(rows, kind, arrow)
    same = rows["conv_id"].eqNullSafe(F.col("c"))
    parts = _large(rows.join(large, same, "left_semi").where("times > 0"), kind, arrow, scratch)
    return scratch.result(_whole(rows.join(large, same, "left_anti"), kind, arrow).unionByName(parts), "repair")
