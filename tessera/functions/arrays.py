"""Functions over arrays, maps and structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpack(c: Column, sep: str = "$") -> Column:
    """A delimited string as an array without empties."""
    return F.filter(F.split(c, f"[{sep}]"), lambda x: x != "")


def replace_ref(refs: Column, old: Column, new: Column) -> Column:
    return F.transform(refs, lambda x: F.when(x == old, new).otherwise(x))


def replace_span_ref(spans: Column, old: Column, new: Column, only: Column | None = None) -> Column:
    """spans with the ref old replaced, in all of them or in the one at place only (from 0)."""

    def put(s: Column, i: Column) -> Column:
        hit = (s["ref"] == old) if only is None else (s["ref"] == old) & (i == only)
        return F.when(hit, s.withField("ref", new)).otherwise(s)

    return F.transform(spans, put)


def span_for_ref(spans: Column, ref: Column) -> Column:
    """The citation of that ref, else the first citation, else null."""
    cited = F.filter(spans, lambda s: s["type"] == "citation")
    return F.coalesce(F.get(F.filter(cited, lambda s: s["ref"] == ref), F.lit(0)), F.get(cited, F.lit(0)))


def spans_in(spans: Column, refs: Column) -> Column:
    return F.filter(spans, lambda s: (s["type"] == "citation") & F.array_contains(refs, s["ref"]))


def clamp_slice(items: Column, start: Column, end: Column) -> Column:
    """Items start to end, counted from 1 and kept within the array."""
    low = F.greatest(F.lit(1), F.least(start, F.size(items)))
    high = F.greatest(low, F.least(end, F.size(items)))
    return F.slice(items, low, high - low + 1)


def project_labels(labels: Column, allowed: Column) -> Column:
    """Labels that are allowed, in order, repeats kept."""
    return F.filter(labels, lambda x: F.array_contains(allowed, x))


def final_labels(now: Column, add: Column, remove: Column) -> Column:
    return F.array_sort(F.array_except(F.array_union(now, add), remove))


def merge_maps(left: Column, right: Column) -> Column:
    """Both maps' entries; the right one wins."""
    only_left = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(only_left, right)


def count_without(a: str, b: str) -> Column:
    """How many items of a are not in b, repeats counting."""
    return F.size(F.filter(a, lambda x: ~F.array_contains(b, x)))


def span_key(span: Column) -> Column:
    return F.concat_ws(",", span["start"].cast("string"), span["end"].cast("string"), span["label"])


def doc_key(text: Column, ref: Column, spans: Column) -> Column:
    """Hash of a document by its text, ref and sorted spans (start, end, label)."""
    listed = F.array_join(F.transform(F.array_sort(spans), span_key), ";")
    return F.sha2(F.concat_ws("|", text, F.coalesce(ref, F.lit("")), listed), 256)


def map_label(label: Column, names: dict[str, str], strict: bool = False) -> Column:
    """The name of a label, null for unknown ones, which are an error if strict."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[label]
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown label: "), label))) if strict else known


def tree_nodes(rows: DataFrame, column: str, depth: int) -> DataFrame:
    """(root, node, depth) of all nodes of JSON trees {"slug", "children": [...]}, down to a depth."""
    schema = "struct<slug:string>"
    for _ in range(depth - 1):
        schema = f"struct<slug:string,children:array<{schema}>>"
    level = rows.select(F.from_json(column, schema).alias("x")).select(F.col("x.slug").alias("root"), "x")
    out = None
    for k in range(depth):
        one = level.select("root", F.col("x.slug").alias("node"), F.lit(k + 1).alias("depth"))
        out = one if out is None else out.union(one)
        if k + 1 < depth:
            level = level.select("root", F.explode("x.children").alias("x"))
    return out


def last_chunk_start(n: Column, size: int, slack: int) -> Column:
    """Where the last chunk of n items begins: at 0 if all fit into one with the slack, else size before the end."""
    return F.when(n <= size + slack, F.lit(0).cast("bigint")).otherwise(n - size)


def is_ref(c: Column, pattern: str) -> Column:
    """Whether a reference parses; null does not."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def any_of(categories: Column, wanted: list[str]) -> Column:
    """Whether one of the wanted categories is there; if none is wanted, all pass."""
    return F.arrays_overlap(categories, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def first_or_empty(c: Column) -> Column:
    return F.coalesce(F.get(c, F.lit(0)), F.lit(""))


def in_scope(rows: DataFrame, scope: str, judged: str = "judged") -> DataFrame:
    """The judged rows, the confounders, or all."""
    conditions = {"judged": F.col(judged), "confounder": ~F.col(judged), "all": F.lit(True)}
    if scope not in conditions:
        raise ValueError(f"unknown scope: {scope}")
    return rows.where(conditions[scope])
