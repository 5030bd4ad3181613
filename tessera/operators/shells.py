"""Shells around model calls: prompts by template, answers by tag, and what is decided with them. The model is a function
that is passed in; queries and tests use deterministic ones."""

from __future__ import annotations

import functools
import hashlib
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage
from . import generation

#: Prompts by task; {name} is a column. Answers are expected within the tag of the task's name.
TEMPLATES = {
    "uniqueness": "What is special about <a>{text}</a> beside <b>{others}</b>?",
    "context": "Give the context of <a>{text}</a> in {title}.",
    "summary": "Summarise <a>{text}</a> for {title}.",
    "contextualise": "Say in one line what comes before <a>{text}</a>: {before}",
    "commentary": "Summarise the commentary <a>{text}</a>.",
    "translation": "Translate from {lang}: <a>{text}</a>",
    "description": "Describe {title} from <a>{text}</a>.",
    "citations": "List the citations in <a>{text}</a>, parted by semicolons.",
    "entities": "Mark the entities in <a>{text}</a> with braces.",
    "questions": "Which questions does <a>{text}</a> answer?",
}


def prompt(task: str) -> Column:
    """The task's template with columns put in; null columns are empty."""
    if task not in TEMPLATES:
        raise ValueError(f"unknown task: {task}")
    parts: list[Column] = []
    rest = TEMPLATES[task]
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def run(rows: DataFrame, task: str, call: Callable[[str], str], parse: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with the answer of a task, parsed: what stands within its tag, null if the call failed or the tag is missing."""
    asked = generation.ask(rows.withColumn("__prompt", prompt(task)), "__prompt", call, "__answer")
    found = text.xml_tag(F.col("__answer"), task) if parse is None else parse(F.col("__answer"))
    return asked.withColumn(task, found).drop("__prompt", "__answer", "error")


def echo(task: str, change: Callable[[str], str] = str.upper) -> Callable[[str], str]:
    """A stand-in for a model: what stands within <a> in the prompt, changed, within the task's tag."""

    def call(asked: str) -> str:
        head, _, tail = asked.partition("<a>")
        return f"<{task}>{change(tail.partition('</a>')[0] if tail else head)}</{task}>"

    return call


def with_others(rows: DataFrame, topic: str, ref: str, body: str, name: str = "others") -> DataFrame:
    """rows with the other texts of their topic, by ref, joined by blanks. Every topic's texts are gathered once, not pair by pair."""
    listed = rows.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct(F.col(ref).alias("r"), F.col(body).alias("t")))).alias("__all"))
    others = F.filter("__all", lambda x: x["r"] != F.col(ref))
    return rows.join(listed, topic).withColumn(name, F.array_join(F.transform(others, lambda x: x["t"]), " ")).drop("__all")


def validated(rows: DataFrame, source: str, target: str, call: Callable[[str], str], again: Callable[[str], str]) -> DataFrame:
    """rows with target: the answer to source, or the second call's where the first comes back empty or unchanged."""
    once = generation.ask(rows, source, call, "__one").drop("error")
    bad = F.col("__one").isNull() | (F.trim("__one") == "") | (F.col("__one") == F.col(source))
    twice = generation.ask(once.where(bad), source, again, "__two").drop("error")
    return once.where(~bad).withColumn(target, F.col("__one")).drop("__one").unionByName(twice.withColumn(target, F.col("__two")).drop("__one", "__two"))


def cascade(rows: DataFrame, *strategies: Callable[[DataFrame], DataFrame], key: str, value: str) -> DataFrame:
    """(key, value): each strategy is only asked for the rows that those before left null."""
    left, done = rows, None
    for s in strategies:
        got = cut_lineage(s(left).select(key, value), "cascade")
        have = got.where(F.col(value).isNotNull())
        done = have if done is None else done.unionByName(have)
        left = left.join(have.select(key), key, "left_anti")
    return done.unionByName(left.select(key, F.lit(None).cast("string").alias(value)))


def grade_by_halves(refs: list[str], call: Callable[[list[str]], dict[str, int]], most_missing: int = 4) -> dict[str, int]:
    """Scores of refs by calls that may fail or leave some out: a call is good if it leaves out most_missing at most (those score 0);
    else each half is asked for itself, and a single ref that fails scores 0. What was not asked for is dropped."""
    if not refs:
        return {}
    try:
        said = call(refs)
        if sum(r not in said for r in refs) <= most_missing:
            return {r: max(0, min(4, int(said.get(r, 0)))) for r in refs}
    except Exception:  # noqa: S110  a failed call is asked again in halves
        pass
    if len(refs) == 1:
        return {refs[0]: 0}
    half = len(refs) // 2
    return grade_by_halves(refs[:half], call, most_missing) | grade_by_halves(refs[half:], call, most_missing)


def graded(rows: DataFrame, key: str, refs: str, call: Callable[[list[str]], dict[str, int]]) -> DataFrame:
    """(key, ref, score) of every ref of each row's list."""
    kind = rows.schema[key].dataType.simpleString()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = [(k, r, s) for k, own in zip(df[key], df[refs], strict=True) for r, s in grade_by_halves(list(own), call).items()]
            yield pd.DataFrame(out, columns=[key, "ref", "score"])

    return rows.select(key, refs).mapInPandas(each, f"`{key}` {kind}, ref string, score int")


def scored_sheets(rows: DataFrame, call: Callable[[list[str]], dict[str, int]], most_refs: int = 800) -> DataFrame:
    """(sheet, ref, percentage, status) of sheets (sheet, refs: array, original: own text): no refs is a failure without rows of refs; sheets
    without own text or with too many refs score 0 throughout; others get their scores as percentages of the sheet's sum."""
    none = rows.where(F.size("refs") == 0).select("sheet", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("percentage"), F.lit("failure").alias("status"))
    flat = (F.trim(F.coalesce("original", F.lit(""))) == "") | (F.size("refs") > most_refs)
    some = rows.where(F.size("refs") > 0)
    zero = some.where(flat).select("sheet", F.explode("refs").alias("ref"), F.lit(0.0).alias("percentage"), F.lit("equal").alias("status"))
    own = graded(some.where(~flat), "sheet", "refs", call)
    total = F.sum("score").over(Window.partitionBy("sheet"))
    share = F.bround(F.col("score") * 100.0 / F.when(total == 0, 1).otherwise(total), 2)
    return none.unionByName(zero).unionByName(own.select("sheet", "ref", share.alias("percentage"), F.lit("scored").alias("status")))


def expanded_context(rows: DataFrame, key: str, place: str, body: str, decide: Callable[[Column, Column], Column], steps: int = 3) -> DataFrame:
    """(key, place, first, last, steps): each text widened up to `steps` times to its left, right or both neighbours, as decide(first, last)
    says, until it says stop or the side is missing; both shrinks to the side that is there."""
    w = Window.partitionBy(key)
    out = rows.select(key, place, F.col(place).alias("first"), F.col(place).alias("last"), F.min(place).over(w).alias("__low"), F.max(place).over(w).alias("__high"), F.lit(0).alias("steps"), F.lit(True).alias("__on"))
    for _ in range(steps):
        says = decide(F.col("first"), F.col("last"))
        left = F.col("__on") & says.isin("left", "both") & (F.col("first") > F.col("__low"))
        right = F.col("__on") & says.isin("right", "both") & (F.col("last") < F.col("__high"))
        out = out.withColumn("__l", left).withColumn("__r", right)
        moved = F.col("__l") | F.col("__r")
        out = out.withColumn("first", F.col("first") - F.col("__l").cast("int")).withColumn("last", F.col("last") + F.col("__r").cast("int"))
        out = out.withColumn("steps", F.col("steps") + moved.cast("int")).withColumn("__on", moved)
    return out.select(key, place, "first", "last", "steps")


def chat_example(system: str, user: Column, assistant: Column) -> Column:
    """A line of a chat fine-tuning file."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.to_json(F.struct(F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", assistant)).alias("messages")))


def completion_example(asked: Column, answer: Column) -> Column:
    return F.to_json(F.struct(F.concat(asked, F.lit("\n\n###\n\n")).alias("prompt"), F.concat(F.lit(" "), answer, F.lit(" END")).alias("completion")))


def run_parallel(items: Iterable[Any], f: Callable[[Any], Any], workers: int = 8) -> list:
    """f of every item by a pool of threads, in order, without None. For calls on the driver; rows go through ask()."""
    with ThreadPoolExecutor(workers) as pool:
        return [x for x in pool.map(f, items) if x is not None]


def next_workers(workers: Column, clean: Column, limited: Column, low: int = 1, high: int = 6, after: int = 3) -> tuple[Column, Column]:
    """Workers and clean runs after one more run: one worker less after a rate limit, one more after so many clean runs."""
    up = (clean + 1 >= after) & (workers < high)
    return F.when(limited, F.greatest(workers - 1, F.lit(low))).when(up, workers + 1).otherwise(workers), F.when(limited | (clean + 1 >= after), 0).otherwise(clean + 1)


def adapted_workers(limits: Column, start: int = 4) -> Column:
    """The number of workers after each of a row of runs (array of boolean: was it limited)."""

    def step(acc: Column, limited: Column) -> Column:
        w, c = next_workers(acc["w"], acc["c"], limited)
        return F.struct(w.alias("w"), c.alias("c"), F.concat(acc["out"], F.array(w)).alias("out"))

    return F.aggregate(limits, F.struct(F.lit(start).alias("w"), F.lit(0).alias("c"), F.array().cast("array<int>").alias("out")), step)["out"]


def patient(call: Callable[[str], str], waits: tuple[float, ...] = (5.0, 600.0)) -> Callable[[str], str]:
    """call that waits and tries again after any failure, once for each of the waits."""

    @functools.wraps(call)
    def tried(asked: str) -> str:
        for wait in waits:
            try:
                return call(asked)
            except Exception:
                time.sleep(wait)
        return call(asked)

    return tried


def checkpointed(make: Callable[[], DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """What is stored at path, or else what make gives, after storing it there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Registry:
    """Implementations by name: predictors, queriers, rankers, clients for embeddings."""

    def __init__(self) -> None:
        self._made: dict[str, Callable[..., Any]] = {}

    def add(self, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def put(f: Callable[..., Any]) -> Callable[..., Any]:
            self._made[name] = f
            return f

        return put

    def make(self, name: str, *args: Any, **kwargs: Any) -> Any:
        if name not in self._made:
            raise ValueError(f"unknown name: {name}; there are {', '.join(sorted(self._made))}")
        return self._made[name](*args, **kwargs)


EMBEDDERS = Registry()


@EMBEDDERS.add("hash")
def hash_embedder(width: int = 16) -> Callable[[str], list[float]]:
    """A deterministic client: the bytes of the text's hash as numbers from -1 to 1."""
    return lambda t: [b / 127.5 - 1 for b in hashlib.sha256(t.encode()).digest()[:width]]


def embedded(rows: DataFrame, body: str, embed: Callable[[str], list[float]]) -> DataFrame:
    """rows with vector and error; a failed text has a null vector."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got, bad = [], []
            for t in df[body]:
                try:
                    got.append(embed(t))
                    bad.append(None)
                except Exception as e:  # the row keeps what went wrong
                    got.append(None)
                    bad.append(str(e))
            yield df.assign(vector=got, error=bad)

    return rows.mapInPandas(each, f"{schema}, vector array<double>, error string")
