"""Interval operators over references (book, start, end), both ends included; one that ends before it starts holds no place.

An interval's level is the least power of two of at least its length, so it touches two bins of that size at most,
however long it is. Two intervals meet at the level of the longer one: that one stands in the bins of its own level
only, the shorter one in the two that it touches at each level from its own up that occurs at all. They share a place
often when they share such a bin, so few pairs are looked at in vain, and no book lands in one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt

#: The smallest level of bins, as a power of two.
LEAST_LEVEL = 5
#: Places of a book whose references are put in order together at first.
STRETCH = 1024


def level(start: Column, end: Column) -> Column:
    """The power of two of the bins for intervals of this length."""
    return F.greatest(F.lit(LEAST_LEVEL), F.when(end > start, F.length(F.bin(end - start))).otherwise(0))


def _bin(place: Column) -> Column:
    return F.call_function("shiftright", place.cast("bigint"), F.col("level").cast("int"))


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    own = rows.where(F.col("end") >= F.col("start")).withColumn("__level", level(F.col("start"), F.col("end")))
    return own.select(*[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns], F.col("book"), F.col("__level"))


def _in_bins(rows: DataFrame, prefix: str, levels: Column) -> DataFrame:
    """A row for each bin that an interval touches at each of the levels."""
    at = rows.withColumn("level", F.explode(levels))
    bins = lambda c: _bin(F.col(f"{prefix}_{c}"))
    return at.withColumn("bin", F.explode(F.array_distinct(F.array(bins("start"), bins("end"))))).drop("__level")


def _meetings(left: DataFrame, right: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of tables whose rows of equal (book, level, bin) meet: left is as long or longer, then right is."""
    a, b = _prefixed(left, "a"), _prefixed(right, "b")
    sides = a.select(F.lit(0), "__level").union(b.select(F.lit(1), "__level")).distinct().collect()  # at most two a bit of a number
    of = [sorted(n for k, n in sides if k == side) for side in (0, 1)]
    own, at = F.array("__level"), lambda levels: F.array(*[F.lit(n) for n in levels])
    found = []
    if of[0] and of[1] and of[0][-1] >= of[1][0]:
        found.append((_in_bins(a, "a", own), _in_bins(b, "b", F.filter(at(of[0]), lambda x: x >= F.col("__level")))))
    if not found or of[1][-1] > of[0][0]:
        found.append((_in_bins(a, "a", F.filter(at(of[1] or [LEAST_LEVEL]), lambda x: x > F.col("__level"))), _in_bins(b, "b", own)))
    return found


_SHARED = "a_start <= b_end and b_start <= a_end"


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of the same book that share a place, once; columns a_... and b_..."""
    once = F.col("bin") == _bin(F.greatest("a_start", "b_start"))
    keys, both = ["book", "level", "bin"], None
    for a, b in _meetings(left, right):
        pairs = a.join(b, keys)
        both = pairs if both is None else both.unionByName(pairs)
    return both.where(_SHARED).where(once).drop(*keys)


def containment_join(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs where outer (a_...) holds all of inner (b_...)."""
    return overlap_join(outer, inner).where((F.col("a_start") <= F.col("b_start")) & (F.col("b_end") <= F.col("a_end")))


def without_overlap(rows: DataFrame, occupied: DataFrame, key: str = "ref") -> DataFrame:
    """Rows that overlap nothing occupied. Equal references are looked up once, and a row stops at the first hit."""
    places = ["book", "start", "end"]
    hits = None
    for a, b in _meetings(rows.select(*places).distinct(), occupied.select(*places).distinct()):
        hit = a.join(b.drop("b_book"), (a["book"] == b["book"]) & (a["level"] == b["level"]) & (a["bin"] == b["bin"]) & F.expr(_SHARED), "left_semi").select("a_book", "a_start", "a_end")
        hits = hit if hits is None else hits.unionByName(hit)
    hits = hits.distinct()
    return rows.join(hits, (rows["book"] == hits["a_book"]) & (rows["start"] == hits["a_start"]) & (rows["end"] == hits["a_end"]), "left_anti")


def drop_containing(rows: DataFrame, key: str = "ref") -> DataFrame:
    """Of nested references the smallest stay; of equal ones the first by key. Every row is compared, the last one too.

    Equal references are one row here. From the last start to the first, a reference holds another if one that starts
    no earlier ends no later, so a running least end decides: within stretches of a book, and then over the stretches."""
    places = ["book", "start", "end"]
    equal = rows.groupBy(*places).agg(F.min(key).alias("__key")).withColumn("__stretch", F.floor(F.col("start") / STRETCH))
    before = Window.partitionBy("book", "__stretch").orderBy(F.desc("start"), "end").rowsBetween(Window.unboundedPreceding, -1)
    marked = equal.withColumn("__least", F.min("end").over(before))
    later = Window.partitionBy("book").orderBy(F.desc("__stretch")).rowsBetween(Window.unboundedPreceding, -1)
    stretches = equal.groupBy("book", "__stretch").agg(F.min("end").alias("__end")).select("book", "__stretch", F.min("__end").over(later).alias("__later"))
    inside = F.coalesce(F.least("__least", "__later") <= F.col("end"), F.lit(False))
    kept = marked.join(stretches, ["book", "__stretch"]).where(~inside).select(*places, F.col("__key").alias(key))
    return rows.join(kept, [*places, key], "left_semi")


def merge_close(rows: DataFrame, gap: int = 2) -> DataFrame:
    """(book, start, end, n): references at most gap apart become one range. They are merged within stretches of each book
    first, so that only a stretch's ranges, not all of a book's references, are put in order in one place."""
    parts = rows.select("book", "start", "end", F.lit(1).cast("bigint").alias("n"), F.floor(F.col("start") / STRETCH).alias("__bin"))
    n = rows.count()
    return _merged(dealt(_merged(dealt(parts, n, "book", "__bin"), ["book", "__bin"], gap), n, "book"), ["book"], gap)


def _merged(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.coalesce((F.col("start") - reach > gap).cast("int"), F.lit(0)))
    marked = marked.withColumn("__i", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).select("book", "start", "end", "n")


def matched_controls(seeds: DataFrame, pool: DataFrame, n: int = 10) -> DataFrame:
    """Up to n rows of pool for each seed: equal category, another id, words within the band around the seed's.
    (id, category, words) on both sides. The order among matches is by length distance, then id.

    How far a seed must look is read off a table of lengths and their counts, and of each length only the n + 1 smallest
    ids can be among anyone's matches; so a seed meets few rows more than it keeps, however many share its band."""
    slack = F.greatest(F.lit(8), F.bround(F.col("words") * 0.15).cast("int"))
    s = seeds.select(F.col("id").alias("seed_id"), "category", F.col("words").alias("seed_words"), F.greatest(F.lit(1), F.col("words") - slack).alias("low"), (F.col("words") + slack).alias("high"))
    s = s.withColumn("band", F.explode(F.sequence(F.floor(F.col("low") / 32), F.floor(F.col("high") / 32))))
    counts = pool.groupBy("category", "words").agg(F.count("*").alias("rows")).withColumn("band", F.floor(F.col("words") / 32))
    near = s.join(counts, ["category", "band"]).where("words between low and high").withColumn("far", F.abs(F.col("words") - F.col("seed_words")))
    nearer = Window.partitionBy("seed_id").orderBy("far").rangeBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("nearer", F.coalesce(F.sum("rows").over(nearer), F.lit(0))).where(F.col("nearer") < n + 1)
    own = Window.partitionBy("category", "words").orderBy("id")
    first = pool.select("id", "category", "words").withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= n + 1).drop("__n")
    both = near.select("seed_id", "category", "seed_words", "words", "far").join(first, ["category", "words"]).where("id <> seed_id")
    w = Window.partitionBy("seed_id").orderBy("far", "id")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("seed_id", "id", "category", "seed_words", "words", "place")
