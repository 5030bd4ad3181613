"""Exact search of stated queries over vectors, in blocks.

A task holds a block of queries and each one's best so far, and reads its share of the documents batch by batch; what
it sends on is one sorted list a query, whatever the number of batches. Queries of a bounded size are broadcast and
documents stay where they are. More queries are dealt into groups of that size as rows: documents are dealt to lanes,
each lane of a group meets all queries of the group, and neither side passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of query vectors that a task holds, and scores of a step.
QUERY_BYTES, STEP_SCORES = 32 << 20, 2_000_000


def scores(q: np.ndarray, d: np.ndarray, measure: str) -> np.ndarray:
    if measure == "euclidean":
        return -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (d * d).sum(1) - 2 * q @ d.T))
    product = q @ d.T
    if measure == "dot":
        return product
    if measure != "cosine":
        raise ValueError(f"unknown measure: {measure}")
    below = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1)
    return product / np.where(below == 0, 1.0, below)


class Best:
    """The k best documents of each query so far: highest score, then smallest id."""

    def __init__(self, queries: int, k: int):
        self.k, self.row, self.score, self.doc = k, np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
        self.edge = np.full(queries, -np.inf)  # what the k-th of a full list has

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        """score: queries x documents; -inf takes no part."""
        if score.shape[1] > 4 * self.k:  # the rest cannot be among the k best of these alone
            own = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1]
            row, col = np.nonzero((score >= np.maximum(self.edge, own)[:, None]) & (score > -np.inf))
        else:
            row, col = np.nonzero((score >= self.edge[:, None]) & (score > -np.inf))
        if not len(row):
            return
        row, value, doc = np.concatenate((self.row, row)), np.concatenate((self.score, score[row, col])), np.concatenate((self.doc, doc[col]))
        order = np.lexsort((doc, -value, row))
        row, value, doc = row[order], value[order], doc[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.score, self.doc = row[keep], value[keep], doc[keep]
        full = place[keep] == self.k - 1
        self.edge[self.row[full]] = self.score[full]


class TopK:
    """A task's work: top lists (kind 0), and with labels the best document of the query's own label (kind 1)."""

    schema = "query_id bigint, doc_id bigint, score double, kind int"

    def __init__(self, queries: dict[str, np.ndarray], k: int, measure: str, own_label: bool):
        self.q, self.measure, self.top = queries, measure, Best(len(queries["query_id"]), k)
        self.own = Best(len(queries["query_id"]), 1) if own_label else None

    def add(self, docs: dict[str, np.ndarray]) -> None:
        score = scores(self.q["vector"], docs["vector"], self.measure)
        self.top.add(score, docs["doc_id"])
        if self.own:
            score[self.q["label"][:, None] != docs["label"][None, :]] = -np.inf
            self.own.add(score, docs["doc_id"])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for kind, best in enumerate((self.top, self.own)):
            if best is not None and len(best.row):
                yield pa.RecordBatch.from_arrays([pa.array(self.q["query_id"][best.row]), pa.array(best.doc), pa.array(best.score), pa.array(np.full(len(best.row), kind, dtype=np.int32))], names=["query_id", "doc_id", "score", "kind"])


class Ahead:
    """A task's work: how many documents stand ahead of a query's target (columns best and edge: its id and score)."""

    schema = "query_id bigint, n bigint"

    def __init__(self, queries: dict[str, np.ndarray], measure: str):
        self.q, self.measure, self.n = queries, measure, np.zeros(len(queries["query_id"]), dtype=np.int64)

    def add(self, docs: dict[str, np.ndarray]) -> None:
        score, edge, own = scores(self.q["vector"], docs["vector"], self.measure), self.q["edge"][:, None], self.q["best"][:, None]
        same = np.abs(score - edge) <= 1e-12
        self.n += (np.where(same, docs["doc_id"] < own, score > edge) & (docs["doc_id"] != own)).sum(axis=1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(self.q["query_id"]), pa.array(self.n)], names=["query_id", "n"])


def _arrays(batch, names: list[str]) -> dict[str, np.ndarray]:
    out = {}
    for c in names:
        column = batch.column(c)
        if pa.types.is_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            out[c] = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
        else:
            out[c] = column.to_numpy(zero_copy_only=False)
    return out


def _steps(batch, names: list[str], queries: int) -> Iterator[dict[str, np.ndarray]]:
    step = max(1, STEP_SCORES // max(1, queries))
    for at in range(0, batch.num_rows, step):
        yield _arrays(batch.slice(at, step), names)


def scan(docs: DataFrame, queries: DataFrame, work: Callable[[dict[str, np.ndarray]], object], schema: str, query_bytes: int | None = None) -> DataFrame:
    """work's rows for every group of queries (query_id, vector, more numbers) and share of docs (doc_id, vector, more numbers)."""
    query_bytes = QUERY_BYTES if query_bytes is None else query_bytes
    doubles = lambda df: df.select([F.transform(c, lambda x: x.cast("double")).alias(c) if df.schema[c].dataType.typeName() == "array" else F.col(c) for c in df.columns])
    docs, queries = doubles(docs), doubles(queries)
    size = queries.agg(F.coalesce(F.sum(8 * F.size("vector") + 32), F.lit(0)).alias("n")).first()["n"]
    if size <= query_bytes:
        return _broadcast(docs, queries, work, schema)
    return _lanes(docs, queries, work, schema, -(-size // query_bytes))


def _broadcast(docs: DataFrame, queries: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Queries of a size that scan() has checked."""
    names = docs.columns
    rows = queries.collect()
    columns = {c: np.array([r[c] for r in rows]) for c in queries.columns}
    sent = docs.sparkSession.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows and len(sent.value["query_id"]):
                held = held or work(sent.value)
                for part in _steps(b, names, len(sent.value["query_id"])):
                    held.add(part)
        if held:
            yield from held.rows()

    return docs.mapInArrow(run, schema)


def _lanes(docs: DataFrame, queries: DataFrame, work: Callable, schema: str, groups: int) -> DataFrame:
    """Documents in lanes, queries in groups; each (group, lane) has its queries before its documents."""
    spark = docs.sparkSession
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_names, d_names = queries.columns, docs.columns
    own = queries.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), F.struct(*q_names).alias("q"), F.lit(None).alias("d"))
    all_docs = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).cast("int").alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(None).alias("q"), F.struct(*d_names).alias("d"))
    both = own.unionByName(all_docs).withColumn("later", F.col("d").isNotNull())
    dealt = both.repartition("group", "lane").sortWithinPartitions("group", "lane", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for b in batches:
            cell = b.column("group").to_numpy() * lanes + b.column("lane").to_numpy()
            kind = cell * 2 + b.column("later").to_numpy(zero_copy_only=False).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                if cell[s] != now:
                    if held:
                        yield from held.rows()
                    now, parts, held = cell[s], [], None
                part = b.slice(s, e - s)
                if kind[s] % 2 == 0:
                    parts.append(_arrays(pa.RecordBatch.from_struct_array(part.column("q")), q_names))
                elif parts:
                    held = held or work({c: np.concatenate([p[c] for p in parts]) for c in q_names})
                    for step in _steps(pa.RecordBatch.from_struct_array(part.column("d")), d_names, sum(len(p["query_id"]) for p in parts)):
                        held.add(step)
        if held:
            yield from held.rows()

    return dealt.mapInArrow(run, schema)


def top(docs: DataFrame, queries: DataFrame, k: int, measure: str = "cosine", own_label: bool = False, query_bytes: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, kind) as TopK gives them for each share of documents: at most k + 1 rows a query and task."""
    extra = ["label"] if own_label else []
    return scan(docs.select("doc_id", "vector", *extra), queries.select("query_id", "vector", *extra), lambda q: TopK(q, k, measure, own_label), TopK.schema, query_bytes)


def ahead(docs: DataFrame, targets: DataFrame, measure: str = "cosine", query_bytes: int | None = None) -> DataFrame:
    """(query_id, n): how many documents stand ahead of the target (query_id, vector, best, edge)."""
    found = scan(docs.select("doc_id", "vector"), targets.select("query_id", "vector", "best", "edge"), lambda q: Ahead(q, measure), Ahead.schema, query_bytes)
    return found.groupBy("query_id").agg(F.sum("n").alias("n"))
