"""Live services as tables: a data source that reads a paged HTTP service, in batch and as a stream, and clients for posts.

The service answers GET url?offset=O&limit=L with a JSON list of objects in a fixed order, and GET count_url with
{"count": N}. What it can filter by itself is said by name (filters); such conditions travel as column.op=value, of which op is
eq, gt, ge, lt, le or in (a JSON list), and every other condition is Spark's. Pages are dealt to tasks, and nothing but the
count passes the driver."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

OPS: dict[type[Filter], str] = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", In: "in"}
#: The types whose values the service and Spark compare alike.
FILTERABLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType)
#: Answers that are worth another call.
AGAIN = (429, 500, 502, 503, 504)


class ServiceError(RuntimeError):
    """A service that refuses, or that answers something else than was agreed."""


def call(url: str, body: Any = None, tries: int = 5, timeout: float = 30.0, wait: float = 0.5) -> Any:
    """The JSON that url answers to a GET, or to a POST of body as JSON. After 429, a server's error or a lost connection it is
    asked again, after the time that Retry-After names or else after waits that double; any other answer is raised at once."""
    data = None if body is None else json.dumps(body).encode()
    for k in range(tries):
        pause = wait * 2**k
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"} if data else {}), timeout=timeout) as got:
                return json.load(got)
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or k == tries - 1:
                raise ServiceError(f"{url}: {e.code} {e.reason}") from e
            said = e.headers.get("Retry-After") or ""
            pause = float(said) if said.isdigit() else pause
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if k == tries - 1:
                raise ServiceError(f"{url}: {e}") from e
        except json.JSONDecodeError as e:
            raise ServiceError(f"{url}: no JSON") from e
        time.sleep(pause)
    raise ServiceError(f"{url}: never asked")


def _with(url: str, more: dict[str, Any]) -> str:
    return f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(more)}" if more else url


def converted(value: Any, kind: T.DataType) -> Any:
    """A value of JSON as one of Spark's type; a value that does not fit is an error."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [converted(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {converted(k, kind.keyType): converted(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.StructType):
        return tuple(converted(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return datetime.fromisoformat(value)
    if isinstance(kind, T.DateType):
        return date.fromisoformat(value)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    if isinstance(kind, T.DoubleType | T.FloatType):
        return float(value)
    if isinstance(kind, T.BooleanType) != isinstance(value, bool):
        raise ServiceError(f"{value!r} is no {kind.simpleString()}")
    if isinstance(kind, T.IntegralType) and int(value) != value:
        raise ServiceError(f"{value!r} is no {kind.simpleString()}")
    return int(value) if isinstance(kind, T.IntegralType) else value


@dataclass
class Pages(InputPartition):
    """Pages first, first + step, ... of the rows from start up to end; slots are the seconds between two requests of a task."""

    first: int
    step: int
    start: int
    end: int
    since: float
    slot: float


class _Service:
    """What both readers share: the options, the count, the cut into pages and the reading of them."""

    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        known = {"url", "counturl", "pagesize", "tasks", "persecond", "filters", "tries", "timeout"}
        if "url" not in options or "counturl" not in options:
            raise ValueError("a service needs url and counturl")
        unknown = {k.lower() for k in options} - known - {"path"}
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        self.url, self.count_url = options["url"], options["counturl"]
        self.page, self.tasks = int(options.get("pagesize", 1000)), int(options.get("tasks", 8))
        self.rate = float(options.get("persecond", 0))
        self.filters = {c.strip() for c in options.get("filters", "").split(",") if c.strip()}
        self.call = partial(call, tries=int(options.get("tries", 5)), timeout=float(options.get("timeout", 30)))
        if self.page < 1 or self.tasks < 1 or self.rate < 0:
            raise ValueError("pagesize and tasks are at least 1, persecond at least 0")
        self.schema, self.asked = schema, {}

    def count(self) -> int:
        answer = self.call(_with(self.count_url, self.asked))
        if not isinstance(answer, dict) or not isinstance(answer.get("count"), int):
            raise ServiceError(f"{self.count_url}: no count")
        return answer["count"]

    def cut(self, start: int, end: int, after: float = 0.0) -> list[Pages]:
        """The pages of rows start to end, dealt in turn to tasks. Of a rate of r requests a second and n tasks, each task waits
        n / r seconds from one request to the next and begins i / r seconds late, so that in no n / r seconds there are more than
        n requests, whichever tasks run side by side; no clock or counter is shared."""
        step = max(1, min(self.tasks, -(-(end - start) // self.page)))
        slot = step / self.rate if self.rate else 0.0
        return [Pages(i, step, start, end, time.time() + after * slot, slot) for i in range(step)] if end > start else []

    def rows(self, part: Pages) -> Iterator[tuple]:
        """A page at a time. A page that is shorter or longer than the count said is an error, so that no row is lost unseen."""
        at = part.since + part.first * part.slot / part.step
        for low in range(part.start + part.first * self.page, part.end, part.step * self.page):
            n = min(self.page, part.end - low)
            if part.slot:
                time.sleep(max(0.0, at - time.time()))
                at = time.time() + part.slot
            got = self.call(_with(self.url, {**self.asked, "offset": low, "limit": n}))
            if not isinstance(got, list) or len(got) != n:
                raise ServiceError(f"{self.url}: {len(got) if isinstance(got, list) else 'no'} rows at {low} in place of {n}")
            for row in got:
                if not isinstance(row, dict):
                    raise ServiceError(f"{self.url}: a row at {low} is no object")
                yield tuple(converted(row.get(f.name), f.dataType) for f in self.schema.fields)


class ServiceReader(_Service, DataSourceReader):
    """One reading of what the service holds when the query is planned."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            column, op = ".".join(getattr(f, "attribute", ())), OPS.get(type(f))
            name = f"{column}.{op}"
            if op is None or column not in self.filters or not isinstance(kinds.get(column), FILTERABLE) or name in self.asked:
                yield f
            elif not isinstance(f, In):
                self.asked[name] = json.dumps(f.value)
            elif None in f.value:
                yield f
            else:
                self.asked[name] = json.dumps(list(f.value))

    def partitions(self) -> list[Pages]:
        return self.cut(0, self.count()) or [Pages(0, 1, 0, 0, 0.0, 0.0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.rows(partition)


class ServiceStreamReader(_Service, DataSourceStreamReader):
    """Rows as they are added at the end; the offset is how many were read. A batch holds what came since the last one, and its
    first requests wait for a slot after those of the batch before."""

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": self.count()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if end["rows"] < start["rows"]:
            raise ServiceError(f"{self.url}: {end['rows']} rows are left of {start['rows']} that were read")
        return self.cut(start["rows"], end["rows"], after=1.0)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.rows(partition)


class PagedService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def reader(self, schema: T.StructType) -> ServiceReader:
        return ServiceReader(dict(self.options), schema)

    def streamReader(self, schema: T.StructType) -> ServiceStreamReader:
        return ServiceStreamReader(dict(self.options), schema)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format paged_service known to a session and lets conditions be pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedService)
    return spark


def rows_of(spark: SparkSession, url: str, count_url: str, schema: str | T.StructType, filters: Iterable[str] = (), page: int = 1000, tasks: int = 8, per_second: float = 0.0, stream: bool = False) -> DataFrame:
    """The rows of a service, with at most per_second requests a second over all tasks (0: as fast as they come) besides retries.

    Fields that an object lacks are null, further fields are passed over; a service without rows gives an empty table. A lost
    task asks for its pages again. The service must keep its order while it is read.
    """
    made = (register(spark).readStream if stream else register(spark).read).format("paged_service").schema(schema)
    options = {"url": url, "counturl": count_url, "pagesize": page, "tasks": tasks, "persecond": per_second, "filters": ",".join(filters)}
    return made.options(**options).load()


def embedder(url: str, width: int | None = None, **how: Any) -> Callable[[list[str]], list[list[float]]]:
    """A client that posts {"texts": [...]} and gets {"vectors": [...]}, one for each text and all of one width; no texts are no
    call. It fits chunking's embedder, which hands over batches."""

    def embed(texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        got = call(url, {"texts": list(texts)}, **how)
        vectors = got.get("vectors") if isinstance(got, dict) else None
        if not isinstance(vectors, list) or len(vectors) != len(texts):
            raise ServiceError(f"{url}: not one vector for each of {len(texts)} texts")
        if len({len(v) for v in vectors} | ({width} if width else set())) != 1:
            raise ServiceError(f"{url}: vectors of several widths")
        return [[float(x) for x in v] for v in vectors]

    return embed


def query_embedder(url: str, width: int | None = None, **how: Any) -> Callable[[str], list[float]]:
    """The same for one text, as shells.embedded asks for it; a failure stays in the row's error."""
    many = embedder(url, width, **how)
    return lambda text: many([text])[0]


def answerer(url: str, model: str, **how: Any) -> Callable[[str], str]:
    """A client that posts {"model", "prompt"} and gets {"answer"}, for generation.ask and what rests on it."""

    def answer(prompt: str) -> str:
        got = call(url, {"model": model, "prompt": prompt}, **how)
        if not isinstance(got, dict) or not isinstance(got.get("answer"), str):
            raise ServiceError(f"{url}: no answer")
        return got["answer"]

    return answer
