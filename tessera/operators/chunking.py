"""Three-pass chunking of sections into segments' chunks.

Segments whose embeddings are alike join; a segment that stays alone is split into sentences, which join in the same
way; what is too long still is cut at segments' ends or evenly. Embeddings come from a function of a batch of texts
and can be kept in a table, so that no text is embedded twice. The two passes that look for boundaries get numbers only, a
section's (or a segment's) at a time; all texts are handled by built-in expressions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage

Embedder = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Settings:
    """window: units that the next one is compared with. least, most: tokens of a chunk. tolerance: tokens by which the
    median chunk may lie outside when the threshold is looked for; adjustment: how far a step moves past the middle."""

    window: int = 5
    least: int = 200
    most: int = 500
    tolerance: int = 10
    adjustment: float = 0.01
    dynamic: bool = True
    threshold: float = 0.5
    tokens: Callable[[Column], Column] = text.word_count


def prepare(c: Column) -> Column:
    """HTML, points and marks off, white space made one."""
    return text.normalize_space(text.strip_marks(text.strip_html(c)))


def hashed_embedder(width: int = 128, words: int = 100_000) -> Embedder:
    """A stand-in for a model: words and their runs of three letters, each added with a sign to a place drawn by hash. The places of so many words are kept."""
    known: dict[str, np.ndarray] = {}

    def places(w: str) -> np.ndarray:
        found = known.get(w)
        if found is None:
            if len(known) >= words:
                known.clear()
            h = np.array([zlib.crc32(p.encode()) for p in (w, *(f"{w} "[i : i + 3] for i in range(len(w) - 1)))], dtype=np.int64)
            found = known[w] = h % width + width * (h >> 31)  # the second half counts down
        return found

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            own = [places(w) for w in t.lower().split()]
            n = np.bincount(np.concatenate(own), minlength=2 * width) if own else np.zeros(2 * width)
            v = (n[:width] - n[width:]).astype(float)
            length = np.linalg.norm(v)
            out.append((v / length if length else v).tolist())
        return out

    return embed


def embeddings(texts: DataFrame, embed: Embedder, cache: str, model: str, batch: int = 64) -> DataFrame:
    """(key, vector) of every distinct text of texts (text): those that the cache table lacks are embedded, batch by batch, and added to it."""
    spark = texts.sparkSession
    own = texts.select(text_key(F.col("text"), model).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    schema = "key string, vector array<double>"
    try:
        known = spark.read.schema(schema).parquet(cache)
        new = own.join(known, "key", "left_anti")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = embed(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(vectors, pa.list_(pa.float64()))], names=["key", "vector"])

    new.repartition(_tasks(texts)).mapInArrow(run, schema).write.mode("append").parquet(cache)
    return own.select("key").join(spark.read.schema(schema).parquet(cache).dropDuplicates(["key"]), "key")


def _with_vectors(units: DataFrame, embed: Embedder, batch: int = 64) -> DataFrame:
    """units (..., text) with vector in place of the text."""
    rest = [c for c in units.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = embed(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(vectors, pa.list_(pa.float64()))], names=[*rest, "vector"])

    schema = ", ".join(f"`{c}` {units.schema[c].dataType.simpleString()}" for c in rest)
    return units.repartition(_tasks(units)).mapInArrow(run, f"{schema}, vector array<double>")


def _tasks(rows: DataFrame) -> int:
    """Tasks for work that is dear beside its bytes; a number that is given is not lowered at run time."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_key(c: Column, model: str) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(model), c), 256)


def similarities(vectors: np.ndarray, window: int) -> np.ndarray:
    """For each unit but the first, the cosine between it and the mean of up to window units before it."""
    out = np.zeros(max(0, len(vectors) - 1))
    for i in range(1, len(vectors)):
        mean = vectors[max(0, i - window) : i].mean(axis=0)
        below = np.linalg.norm(mean) * np.linalg.norm(vectors[i])
        out[i - 1] = mean @ vectors[i] / below if below else 0.0
    return out


def runs_of(alike: np.ndarray, tokens: np.ndarray, threshold: float, s: Settings) -> list[tuple[int, bool, float | None]]:
    """(first unit, whether similarity began it, that similarity) of each run: a new one begins where likeness is below the
    threshold and the run has enough tokens, or where it would have too many."""
    out: list[tuple[int, bool, float | None]] = [(0, False, None)]
    room = int(tokens[0])
    for i in range(1, len(tokens)):
        low = alike[i - 1] < threshold and room >= s.least
        if low or room + tokens[i] > s.most:
            out.append((i, bool(low), float(alike[i - 1])))
            room = 0
        room += int(tokens[i])
    return out


def best_threshold(alike: np.ndarray, tokens: np.ndarray, s: Settings) -> float:
    """By halving the range of a deviation around the median similarity, a threshold whose median run has the wanted length."""
    if not s.dynamic or not len(alike):
        return s.threshold
    middle, spread = float(np.median(alike)), float(np.std(alike))
    low, high = max(0.0, middle - spread), min(1.0, middle + spread)
    at = middle
    while low <= high:
        at = (low + high) / 2
        cuts = [0, *(np.flatnonzero(alike < at) + 1).tolist()]
        median = float(np.median(np.add.reduceat(tokens, cuts)))
        if s.least - s.tolerance <= median <= s.most + s.tolerance:
            break
        if median < s.least:
            high = at - s.adjustment
        else:
            low = at + s.adjustment
    return at


def _bounded(units: DataFrame, by: list[str], s: Settings) -> DataFrame:
    """units (by ..., unit, tokens, vector) with run (numbered from 0), triggered and score of the run's start.

    Partitions are dealt by the first column and sorted, so a task goes through its groups one after the other.
    """
    plain = Settings(**{**vars(s), "tokens": None})  # what a task needs
    names = [*by, "unit", "run", "triggered", "score"]
    schema = ", ".join(f"`{c}` {units.schema[c].dataType.simpleString()}" for c in by) + ", unit int, run int, triggered boolean, score double"

    def told(table: pa.Table) -> pa.RecordBatch:
        flat = table.column("vector").combine_chunks()
        tokens, vectors = table.column("tokens").to_numpy(), flat.flatten().to_numpy().reshape(len(flat), -1)
        group = np.zeros(len(tokens), dtype=bool)
        group[0] = True
        for c in by:
            codes = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            group[1:] |= codes[1:] != codes[:-1]
        starts = [*np.flatnonzero(group).tolist(), len(tokens)]
        run, triggered, score = np.zeros(len(tokens), dtype=np.int32), [], []
        for a, b in zip(starts, starts[1:], strict=False):
            alike = similarities(vectors[a:b], plain.window)
            found = runs_of(alike, tokens[a:b], best_threshold(alike, tokens[a:b], plain), plain)
            run[a:b] = np.searchsorted([f for f, _, _ in found], np.arange(b - a), side="right") - 1
            triggered += [found[r][1] for r in run[a:b]]
            score += [found[r][2] for r in run[a:b]]
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in (*by, "unit")), pa.array(run), pa.array(triggered, pa.bool_()), pa.array(score, pa.float64())], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now])
            first = held.column(by[0]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            last = int(np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))[-1])  # the last section may go on
            if last:
                yield told(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield told(held)

    return units.select(*by, "unit", "tokens", "vector").repartition(_tasks(units), by[0]).sortWithinPartitions(*by, "unit").mapInArrow(each, schema)


def sentences_of(c: Column, lang: Column, s: Settings) -> Column:
    """The sentences of a segment by its language; one of too many tokens is split into clauses if it has several."""
    whole = text.split_by_language(c, lang)
    clauses = lambda x: F.when((s.tokens(x) > s.most) & (F.size(text.clause_split(x)) > 1), text.clause_split(x)).otherwise(F.array(x))
    parts = F.filter(F.flatten(F.transform(whole, clauses)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def chunk(rows: DataFrame, embed: Embedder | None = None, settings: Settings | None = None, section: str = "section", place: str = "place", segment: str = "text", cache: str | None = None, model: str = "hashed") -> DataFrame:
    """(section, chunk, first, last, kind, pass, tokens, triggered, score, text) of the chunks of each section.

    kind: multi_segment (pass 1), single_segment or intra_segment (pass 2), multi_segment_hard_max or hard_max_split
    (pass 3). Segments that are null or blank once prepared are left out, and so is a section of none but such. The
    language is that of a section's first five segments: Hebrew is split by rule, all others at the ends of sentences.
    Chunks keep all letters of the prepared segments in order. Segments of one place keep an order by text; sections
    may be null; extra columns are ignored; an empty table gives an empty one. cache: where vectors are kept, by model
    and text, for later calls; without it each call embeds its own texts.
    """
    s = settings or Settings()
    embed = embed or hashed_embedder()
    own = rows.select(F.col(section).alias("section"), F.col(place).alias("place"), prepare(F.coalesce(F.col(segment), F.lit(""))).alias("text")).where("text <> ''")
    order = Window.partitionBy("section").orderBy("place", "text")
    own = own.withColumn("unit", F.row_number().over(order) - 1)
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("unit") < 5, F.struct("unit", "text")))), lambda x: x["text"]), " ")
    langs = own.groupBy(F.col("section").alias("of")).agg(text.detect_language(first).alias("lang"))
    own = cut_lineage(own.join(langs, F.col("section").eqNullSafe(F.col("of"))).select("section", "unit", "place", "lang", "text", s.tokens(F.col("text")).cast("int").alias("tokens")), "chunk-segments")

    def runs(units: DataFrame, by: list[str]) -> DataFrame:
        if cache is None:
            return _bounded(_with_vectors(units.select(*by, "unit", "tokens", "text"), embed), by, s)
        known = embeddings(units.select("text"), embed, cache, model)
        return _bounded(units.withColumn("key", text_key(F.col("text"), model)).join(known, "key"), by, s)

    one = runs(own, ["section"]).withColumnsRenamed({"section": "of", "unit": "at"})
    marked = own.join(one, F.col("section").eqNullSafe(F.col("of")) & (F.col("unit") == F.col("at"))).drop("of", "at")
    marked = marked.withColumn("members", F.count("*").over(Window.partitionBy("section", "run")))
    marked = cut_lineage(marked.withColumn("whole", F.sum("tokens").over(Window.partitionBy("section", "run"))), "chunk-runs")

    # pass 1, and 3 for what is too long: segments fill a piece until the next one does not fit; those too long alone are cut
    many = marked.where("members > 1")
    up_to = F.sum("tokens").over(Window.partitionBy("section", "run").orderBy("unit"))
    many = many.withColumn("piece", F.when(F.col("whole") > s.most, F.floor((up_to - 1) / s.most)).otherwise(0).cast("int"))
    joined = many.groupBy("section", "run", "piece", "whole").agg(F.array_sort(F.collect_list(F.struct("unit", "place", "text"))).alias("parts"), F.first("triggered").alias("triggered"), F.first("score").alias("score"))
    long = F.col("whole") > s.most
    joined = joined.select("section", F.col("parts")[0]["unit"].alias("unit"), F.col("piece").alias("sub"), F.col("parts")[0]["place"].alias("first"), F.element_at("parts", -1)["place"].alias("last"), F.when(long, "multi_segment_hard_max").otherwise("multi_segment").alias("kind"), F.when(long, 3).otherwise(1).alias("pass"), "triggered", "score", F.array_join(F.col("parts.text"), " ").alias("text"))

    # pass 2
    alone = marked.where("members = 1").withColumn("sentences", sentences_of(F.col("text"), F.col("lang"), s))
    keep = ["section", "unit", "place", "triggered", "score"]
    single = alone.where(F.size("sentences") <= 1).select("section", "unit", F.lit(0).alias("sub"), F.col("place").alias("first"), F.col("place").alias("last"), F.lit("single_segment").alias("kind"), F.lit(2).alias("pass"), "triggered", "score", "text")
    split = cut_lineage(alone.where(F.size("sentences") > 1).select(F.col("section"), F.col("unit").alias("segment"), "place", F.posexplode("sentences").alias("unit", "text")).withColumn("tokens", s.tokens(F.col("text")).cast("int")), "chunk-sentences")
    two = runs(split, ["section", "segment"]).withColumnsRenamed({"section": "of", "segment": "in", "unit": "at"})
    inner = split.join(two, F.col("section").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("in")) & (F.col("unit") == F.col("at")))
    inner = inner.groupBy("section", "segment", "place", "run").agg(F.array_sort(F.collect_list(F.struct("unit", "text"))).alias("parts"), F.first("triggered").alias("triggered"), F.first("score").alias("score"))
    inner = inner.select("section", F.col("segment").alias("unit"), F.col("run").alias("sub"), F.col("place").alias("first"), F.col("place").alias("last"), F.lit("intra_segment").alias("kind"), F.lit(2).alias("pass"), "triggered", "score", F.array_join(F.col("parts.text"), " ").alias("text"))

    # pass 3 for single segments and pieces of them
    whole = joined.unionByName(single.select(joined.columns)).unionByName(inner.select(joined.columns)).withColumn("tokens", s.tokens(F.col("text")).cast("int"))
    over = F.col("tokens") > s.most
    cut = whole.select("*", F.posexplode(F.when(over, text.even_split(F.col("text"), s.most)).otherwise(F.array("text"))).alias("cut", "piece"))
    cut = cut.withColumn("text", F.when(over, F.col("piece")).otherwise(F.col("text"))).withColumn("kind", F.when(over & (F.col("kind") != "multi_segment_hard_max"), "hard_max_split").otherwise(F.col("kind"))).withColumn("pass", F.when(over, 3).otherwise(F.col("pass")))
    number = F.row_number().over(Window.partitionBy("section").orderBy("unit", "sub", "cut")) - 1
    return cut.select(F.col("section").alias(section), number.cast("bigint").alias("chunk"), "first", "last", "kind", "pass", s.tokens(F.col("text")).cast("int").alias("tokens"), "triggered", "score", "text")


def manifest(chunks: DataFrame, section: str = "section") -> DataFrame:
    """Chunks, words and kinds of each section."""
    return chunks.groupBy(section).agg(F.count("*").alias("chunks"), F.sum(text.word_count(F.col("text"))).alias("words"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def ref_chunks(n_col: Column, pos: Column, size: int = 80, slack: int = 10) -> Column:
    """Chunk of the reference at pos of n: up to size + slack all are the title chunk (-1); else the last `size` are, and those before are cut by size."""
    return F.when((n_col <= size + slack) | (pos >= n_col - size), -1).otherwise(F.floor(pos / size)).cast("int")


def with_footnotes(rows: DataFrame, ref: str, index: str, body: str, most: int) -> DataFrame:
    """(ref, index, kind, text): the footnotes of each segment leave its text and follow it as segments of their own, as many
    to one as have at most `most` words; a longer note is cut evenly. Segments of a ref are numbered anew."""
    kind = rows.schema[ref].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in df.sort_values(index)[body].fillna(""):
            notes = [text.split_footnotes(t[f["start"] : f["end"]]) for f in text.find_footnotes(t)]
            out.append(("main", text.without_footnotes(t)))
            group: list[str] = []
            for n in filter(None, notes):
                if group and sum(len(g.split()) for g in [*group, n]) > most:
                    out.append(("footnote", " ".join(group)))
                    group = []
                if len(n.split()) > most:
                    out.extend(("footnote", p) for p in _even(n, most))
                else:
                    group.append(n)
            if group:
                out.append(("footnote", " ".join(group)))
        return pd.DataFrame([(df[ref].iloc[0], i + 1, k, t) for i, (k, t) in enumerate(out)], columns=[ref, index, "kind", body])

    return rows.select(ref, index, body).groupBy(ref).applyInPandas(run, f"`{ref}` {kind}, `{index}` int, kind string, `{body}` string")


def boundaries(rows: DataFrame, section: str, split: str, chunk: str, semantic: str) -> DataFrame:
    """(section, split_number, chunk_number, semantic_boundary_after, final_boundary_after): a final boundary follows the last split of every chunk but the last."""
    w = Window.partitionBy(section).orderBy(split)
    number = F.dense_rank().over(Window.partitionBy(section).orderBy(chunk)).cast("bigint")
    final = F.coalesce(F.lead(chunk).over(w) != F.col(chunk), F.lit(False))
    return rows.select(section, F.col(split).alias("split_number"), number.alias("chunk_number"), F.col(semantic).alias("semantic_boundary_after"), final.alias("final_boundary_after"))
