"""Joins and roll-ups of source gathering: links between references, alignment of lists, recall and curation scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import labels


def chunk_for_link(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(link, chunk_id): of each link (link, refs) the chunk (chunk_id, ref, cited: array) that has one of the refs and cites
    another; of several, the one of the first ref, then the first cited, then the smallest chunk_id."""
    ends = links.select("link", F.posexplode("refs").alias("i", "ref")).join(links.select("link", F.posexplode("refs").alias("j", "other")), "link").where("i <> j")
    cites = chunks.select("chunk_id", "ref", F.explode(F.array_distinct("cited")).alias("other"))
    hits = ends.join(cites, ["ref", "other"])
    return hits.groupBy("link").agg(F.min(F.struct("i", "j", "chunk_id"))["chunk_id"].alias("chunk_id"))


def opposite(links: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, other): the other end of every link (a, b) of each ref."""
    both = links.select(F.col("a").alias("ref"), F.col("b").alias("other")).union(links.select("b", "a"))
    return both.join(refs.select("ref").distinct(), "ref", "left_semi")


def in_order_of(rows: DataFrame, order: DataFrame, key: str = "ref", place: str = "place") -> DataFrame:
    """rows with rank, from 1: as their keys stand in order (key, place), the last place of a repeated key counting;
    rows whose key is not there come last, by their own place. Ranks are per bucket of places, offset by what lies before."""
    at = order.groupBy(key).agg(F.max(place).alias("__at"))
    placed = rows.join(at, key, "left").withColumn("__b", F.coalesce(F.floor(F.col("__at") / 4096), F.lit(1 << 52) + F.floor(F.col(place) / 4096)))
    sizes = placed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__b").orderBy(F.asc_nulls_last("__at"), place, key))
    return placed.join(before, "__b").withColumn("rank", (F.col("__before") + own).cast("bigint")).drop("__at", "__b", "__before")


def paired(left: DataFrame, right: DataFrame, key: str = "ref") -> DataFrame:
    """What zipping two lists that are sorted by key would give, as a join: (key, left_value, right_value), with null where a side lacks the key."""
    return left.select(key, F.col("value").alias("left_value")).join(right.select(key, F.col("value").alias("right_value")), key, "full")


def closest(rows: DataFrame, centres: DataFrame, most: float = 1.0) -> DataFrame:
    """(id, centre, distance): the centre (centre, v) nearest by cosine to each row (id, v), if nearer than most; the first of equals.

    Equal centres count once. Centres lie in blocks of bounded size and rows in lanes; a task multiplies a lane's rows by a
    block's centres and measures again, term by term, those that are nearest but for rounding. Ids may recur."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    double = lambda df: df.withColumn("v", F.transform("v", lambda x: x.cast("double"))).where(finite & F.exists("v", lambda x: x != 0))
    own = double(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v"))
    dealt = double(centres.select("centre", "v")).groupBy("v").agg(F.min("centre").alias("centre"))
    blocks = max(1, -(-centres.count() // BLOCK_CENTRES))
    lanes = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks, -(-rows.count() // LANE_ROWS))
    block, lane = F.pmod(F.xxhash64("centre"), F.lit(blocks)), F.pmod(F.xxhash64("row"), F.lit(lanes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    first = dealt.select(F.size("v").alias("width"), block.alias("block"), every(lanes).alias("lane"), F.lit(False).alias("later"), "centre", F.lit(None).cast("bigint").alias("row"), F.lit(None).alias("id"), "v")
    then = own.select(F.size("v").alias("width"), every(blocks).alias("block"), lane.alias("lane"), F.lit(True).alias("later"), F.lit(None).alias("centre"), "row", "id", "v")
    cell = ["width", "block", "lane"]
    met = first.unionByName(then).repartition(blocks * lanes, *cell).sortWithinPartitions(*cell, "later", "centre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            at = np.array([b.column(c).to_numpy() for c in cell] + [b.column("later").to_numpy(zero_copy_only=False)], dtype=np.int64)
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                if tuple(at[:3, s]) != now:
                    now, held = tuple(at[:3, s]), []
                for k in range(s, e, STEP_ROWS):
                    part = b.slice(k, min(STEP_ROWS, e - k))
                    v = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                    if not at[3, s]:
                        held.append((part.column("centre"), v))
                    elif held:
                        if len(held) > 1:
                            held = [(pa.concat_arrays([c for c, _ in held]), np.concatenate([x for _, x in held]))]
                        names, y = held[0]
                        row, col, far = _nearest(v, y)
                        row, col = pa.array(row), pa.array(col)
                        yield pa.RecordBatch.from_arrays([part.column("row").take(row), part.column("id").take(row), names.take(col), pa.array(far)], names=["row", "id", "centre", "distance"])

    kinds = {"id": rows.schema["id"].dataType.simpleString(), "centre": centres.schema["centre"].dataType.simpleString()}
    best = met.mapInArrow(run, f"row bigint, id {kinds['id']}, centre {kinds['centre']}, distance double")
    if blocks > 1:
        best = best.groupBy("row", "id").agg(F.min(F.struct("distance", "centre")).alias("b")).select("id", "b.centre", "b.distance")
    return best.where(F.col("distance") < most).select("id", "centre", "distance")


#: Centres of a block and rows of a lane in closest(), and rows of a step.
BLOCK_CENTRES, LANE_ROWS, STEP_ROWS = 4096, 65536, 512


def _nearest(x: np.ndarray, y: np.ndarray, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, distance): of each row of x the nearest of y by cosine, the first of equals. Sums go from the first component to the last."""
    long = lambda v: np.sqrt(np.cumsum(v * v, axis=1)[:, -1])
    nx, ny = long(x), long(y)
    with np.errstate(all="ignore"):
        like = (x / nx[:, None]) @ (y / ny[:, None]).T
        edge = np.fmax.reduce(like, axis=1) - slack
        row, col = np.nonzero((like >= edge[:, None]) | np.isnan(like))
        far = np.empty(len(row))
        for at in range(0, len(row), 1 << 16):
            r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
            below = nx[r] * ny[c]
            far[at : at + (1 << 16)] = 1 - np.where(below == 0, np.nan, np.cumsum(x[r] * y[c], axis=1)[:, -1] / below)
    known = ~np.isnan(far)
    row, col, far = row[known], col[known], far[known]
    order = np.lexsort((col, far, row))
    row, col, far = row[order], col[order], far[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    return row[first], col[first], far[first]


def example_scores(gold: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ref, n_gold, n_pred, tp, precision, recall, score) of each ref: gold labels count where the ref's candidates have them; score is F1."""
    rows = predicted.select("ref", F.array_distinct("slugs").alias("p")).join(gold.select("ref", F.col("slugs").alias("g")), "ref").join(candidates.select("ref", F.col("slugs").alias("c")), "ref")
    rows = rows.select("ref", "p", F.array_intersect("g", "c").alias("g"))
    tp = F.size(F.array_intersect("p", "g"))
    rows = rows.select("ref", F.size("g").alias("n_gold"), F.size("p").alias("n_pred"), tp.alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    rows = rows.withColumn("precision", ratio("tp", "n_pred")).withColumn("recall", ratio("tp", "n_gold"))
    return rows.withColumn("score", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def false_positives(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(slug, n): how often each label is predicted where gold lacks it."""
    rows = predicted.join(gold.select("ref", F.col("slugs").alias("g")), "ref")
    return rows.select(F.explode(F.array_except("slugs", "g")).alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))


def by_ref(rows: DataFrame) -> DataFrame:
    """(ref, slugs, text): all slugs of a ref in order of place, and the text of its last row."""
    slugs = F.transform(F.array_sort(F.collect_list(F.struct("place", "slug"))), lambda x: x["slug"])
    return rows.groupBy("ref").agg(slugs.alias("slugs"), F.max_by("text", "place").alias("text"))


def well_linked(links: DataFrame, good: list[str], least: int) -> DataFrame:
    """(topic, links): topics with at least so many links from good sources."""
    return links.where(F.col("source").isin(good)).groupBy("topic").agg(F.count("*").alias("links")).where(F.col("links") >= least)


def range_recall(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(topic, wanted, recalled, recall): of distinct ranges (topic, book, start, end), how many found ones touch a wanted place, over how many are wanted.
    Places are exploded and met by an equi-join, so no topic's ranges meet pairwise."""
    place = F.explode(F.sequence("start", "end")).alias("at")
    w, f = wanted.select("topic", "book", "start", "end").distinct(), found.select("topic", "book", "start", "end").distinct()
    places = w.select("topic", "book", place).distinct()
    hit = f.select("topic", "book", "start", "end", place).join(places, ["topic", "book", "at"], "left_semi").select("topic", "book", "start", "end").distinct()
    n, k = w.groupBy("topic").agg(F.count("*").alias("wanted")), hit.groupBy("topic").agg(F.count("*").alias("recalled"))
    both = n.join(k, "topic", "left").withColumn("recalled", F.coalesce("recalled", F.lit(0)))
    return both.withColumn("recall", F.coalesce(F.try_divide("recalled", "wanted"), F.lit(0.0)))


def curation_score(options: DataFrame) -> DataFrame:
    """(option, score) of options (option, ranked: array of refs, best first, chosen: array of struct(ref, interesting)): an interesting
    choice counts 1, another half of its rank's share; an option without choices scores null."""
    n = F.size("ranked")
    weight = lambda s: F.when(s["interesting"], 1.0).otherwise(0.5 * (n - F.array_position("ranked", s["ref"]) + 1) / n)
    total = F.aggregate(F.transform("chosen", weight), F.lit(0.0), lambda a, x: a + x)
    return options.select("option", F.try_divide(total, F.size("chosen")).alias("score"))


def put_first(rows: DataFrame, flag: Column, group: str, place: str) -> DataFrame:
    """rows with rank, from 1 within the group: flagged rows first, otherwise in their order."""
    w = Window.partitionBy(group).orderBy(F.when(flag, 0).otherwise(1), place)
    return rows.withColumn("rank", F.row_number().over(w))


def largest_cluster_first(rows: DataFrame) -> DataFrame:
    """(cluster, ref): every ref stays in the largest of its clusters (rows cluster, ref), of equals the smallest number; clusters left empty vanish."""
    size = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    sized = rows.select("cluster", "ref").distinct().join(size, "cluster")
    return sized.groupBy("ref").agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster"))["cluster"].alias("cluster")).select("cluster", "ref")


def joined_runs(rows: DataFrame, group: str, place: str, kind: str, text: str, joined: str, sep: str = "\n") -> DataFrame:
    """(group, run, kind, text, n): consecutive rows of the kind `joined` become one, other rows stay alone."""
    w = Window.partitionBy(group).orderBy(place)
    new = F.when((F.col(kind) == joined) & (F.lag(kind).over(w) == joined), 0).otherwise(1)
    runs = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text])
    return runs.groupBy(group, "run").agg(F.first(kind).alias(kind), F.array_join(parts, sep).alias(text), F.count("*").alias("n"))


def with_text_before(rows: DataFrame, group: str, place: str, kind: str, text: str, context: str) -> DataFrame:
    """rows other than `context` with before: the text of the row right before, if that is context."""
    w = Window.partitionBy(group).orderBy(place)
    before = F.when(F.lag(kind).over(w) == context, F.lag(text).over(w))
    return rows.withColumn("before", before).where(F.col(kind) != context)


def judged_order(rows: DataFrame, group: str, item: str, better: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, item, wins, rank): items of a group by how many others a pairwise judge prefers them to (a, b -> 1, 2 or 0), ties by item.
    For a judge that is consistent this is the order that a comparison sort gives. Groups are one topic's choices, some dozens."""
    a, b = rows.select(group, F.col(item).alias("a")), rows.select(group, F.col(item).alias("b"))
    pairs = a.join(b, group).where("a < b").withColumn("says", better(F.col("a"), F.col("b")))
    won = pairs.where("says = 1").select(group, F.col("a").alias(item)).union(pairs.where("says = 2").select(group, "b"))
    wins = rows.select(group, item).join(won.groupBy(group, item).agg(F.count("*").alias("wins")), [group, item], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
    return wins.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("wins"), item)))


def organised(options: DataFrame, gold: DataFrame) -> DataFrame:
    """(slug, refs, golds): each slug's options in order of place with a parallel list of gold titles, null where there is none."""
    both = options.join(gold.select("slug", "ref", F.col("title").alias("gold")), ["slug", "ref"], "left")
    listed = F.array_sort(F.collect_list(F.struct("place", "ref", "gold")))
    return both.groupBy("slug").agg(F.transform(listed, lambda x: x["ref"]).alias("refs"), F.transform(listed, lambda x: x["gold"]).alias("golds"))


def first_containing(hits: DataFrame, candidates: DataFrame, keep: str = "best") -> DataFrame:
    """(segment, hit, score): every hit (hit, book, start, end, score) goes to the first candidate (place, book, start, end, segment)
    that holds it; then each segment keeps its best hit (keep 'best': highest score, then first) or its first one (keep 'first').
    Equal ranges are met once: of candidates the first can count only, and hits of one range have the same candidate."""
    from . import intervals

    places = ["book", "start", "end"]
    outer = candidates.groupBy(*places).agg(F.min(F.struct("place", "segment")).alias("own"))
    pairs = intervals.containment_join(outer, hits.select(*places).distinct())
    held = pairs.groupBy(*[F.col(f"b_{c}").alias(c) for c in places]).agg(F.min("a_own").alias("own"))
    first = hits.join(held, places).groupBy("hit").agg(F.min("own")["segment"].alias("segment"), F.min("score").alias("score"))
    order = F.struct((-F.col("score")).alias("s"), "hit", "score") if keep == "best" else F.struct("hit", "score")
    return first.groupBy("segment").agg(F.min(order).alias("b")).select("segment", "b.hit", "b.score")


def resolution(rows: DataFrame, single: Column, contains: Column, start: Column, end: Column, size: Column) -> DataFrame:
    """rows with how a reference of `size` segments is resolved and to which range (1-based): one segment by itself; else only if it is
    confirmed to be held, to the picked range kept within bounds; all of four or more segments are no answer."""
    low = F.greatest(F.lit(1), F.least(start, size))
    high = F.greatest(low, F.least(end, size))
    how = F.when(single, "auto").when(~contains, "absent").when((high - low + 1 == size) & (size >= 4), "unresolved").when(high - low + 1 > 7, "refine").otherwise("picked")
    return rows.withColumn("how", how).withColumn("low", F.when(how == "auto", F.lit(1)).when(how.isin("picked", "refine"), low)).withColumn("high", F.when(how == "auto", F.lit(1)).when(how.isin("picked", "refine"), high))


def section_links(commentary: DataFrame, base: DataFrame) -> DataFrame:
    """(ref, base_ref): commentary (ref, title, section) meets the base text (title, section, base_ref) at its section; null where there is none."""
    return commentary.join(base.select("title", "section", "base_ref"), ["title", "section"], "left").select("ref", "base_ref")


def without_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known yet: bad titles, produced files, curated topics."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def children_missing(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(ref, slug): labels that have children, none of which the ref (ref, slug) has."""
    kids = rows.join(edges.select(F.col("parent").alias("slug"), "child"), "slug")
    own = rows.select("ref", F.col("slug").alias("child"), F.lit(1).alias("has"))
    return kids.join(own, ["ref", "child"], "left").groupBy("ref", "slug").agg(F.count("has").alias("n")).where("n = 0").select("ref", "slug")


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, slug): every label below each root, itself included, over edges (child, parent)."""
    start = roots.select(F.col("slug").alias("root"))
    below = start.join(labels.closure(edges), F.col("root") == F.col("parent")).select("root", F.col("child").alias("slug"))
    return start.select("root", F.col("root").alias("slug")).union(below).distinct()
