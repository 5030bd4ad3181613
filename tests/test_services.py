"""The service source against a stub server on this machine that counts what it is asked."""

import json
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, generation, shells
from tessera.sources import services

SCHEMA = "id bigint, kind string, score double, tags array<string>, at timestamp"
TESTS = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "in": lambda a, b: a in b}


class Stub:
    """Rows that can be added to; fail holds status codes that the next calls answer with."""

    def __init__(self, rows):
        self.rows, self.asked, self.times, self.fail, self.short = rows, [], [], [], False
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def say(self, body, code=200):
                data = json.dumps(body).encode()
                self.send_response(code)
                if code == 429:
                    self.send_header("Retry-After", "0")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self):
                path, _, query = self.path.partition("?")
                given = dict(urllib.parse.parse_qsl(query))
                stub.asked.append((path, given))
                if stub.fail:
                    return self.say({}, stub.fail.pop())
                found = stub.rows
                for name, value in given.items():
                    if "." in name:
                        column, op = name.split(".")
                        found = [r for r in found if r.get(column) is not None and TESTS[op](r[column], json.loads(value))]
                if path == "/count":
                    return self.say({"count": len(found)})
                stub.times.append(time.time())
                low, n = int(given["offset"]), int(given["limit"])
                return self.say(found[low : low + n - stub.short])

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                if stub.fail:
                    return self.say({}, stub.fail.pop())
                if self.path == "/embed":
                    return self.say({"vectors": [[float(len(t)), 1.0] for t in body["texts"]]})
                return self.say({"answer": f"{body['model']}:{body['prompt'].upper()}"})

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def stub():
    rows = [{"id": i, "kind": "ab"[i % 2], "score": i / 2, "tags": [str(i)], "at": "2024-01-02T03:04:05"} for i in range(95)]
    rows[3] = {"id": 3, "extra": 1}
    s = Stub(rows)
    yield s
    s.server.shutdown()


def read(spark, stub, **how):
    return services.rows_of(spark, f"{stub.url}/rows", f"{stub.url}/count", SCHEMA, **{"page": 10, "tasks": 4, **how})


def test_all_rows_come_once_by_pages(spark, stub):
    got = sorted(read(spark, stub).collect(), key=lambda r: r["id"])
    assert [r["id"] for r in got] == list(range(95))
    assert got[3]["kind"] is None and got[4]["tags"] == ["4"] and got[4]["score"] == 2.0 and got[4]["at"].year == 2024
    offsets = sorted(int(g["offset"]) for p, g in stub.asked if p == "/rows")
    assert offsets == list(range(0, 95, 10))
    assert read(spark, stub).rdd.getNumPartitions() == 4


def test_named_conditions_reach_the_service_and_the_rest_stays(spark, stub):
    df = read(spark, stub, filters=["id", "kind"]).where((F.col("id") >= 10) & (F.col("id") < 50) & F.col("kind").isin("a", "z") & (F.col("score") > 10))
    assert sorted(r["id"] for r in df.collect()) == [i for i in range(10, 50) if i % 2 == 0 and i > 20]
    asked = [g for p, g in stub.asked if p == "/count"][-1]
    assert asked == {"id.ge": "10", "id.lt": "50", "kind.in": '["a", "z"]'}
    stub.asked.clear()
    assert read(spark, stub).where("id = 7").count() == 1
    assert all("id.eq" not in g for _, g in stub.asked)


def test_two_conditions_of_one_kind_and_nulls(spark, stub):
    df = read(spark, stub, filters=["id", "kind"])
    assert df.where("id > 5 and id > 90").count() == 4
    assert df.where("kind is null").count() == 1
    assert df.where("kind = 'it''s & so'").count() == 0
    assert df.where("kind in ('a', null)").count() == 48


def test_rate_holds_over_all_tasks(spark, stub):
    assert read(spark, stub, per_second=10.0).count() == 95
    times = sorted(stub.times)
    assert len(times) == 10
    # four tasks at ten a second: no more than four requests within 0.4 s, but for the time a request takes on its way
    assert all(later - earlier > 0.3 for earlier, later in zip(times, times[4:]))


def test_failures_are_asked_again_or_raised(spark, stub):
    stub.fail = [503, 429]
    assert read(spark, stub).count() == 95
    stub.fail = [404]
    with pytest.raises(Exception, match="404"):
        read(spark, stub).count()
    stub.fail, stub.short = [], True
    with pytest.raises(Exception, match="in place of"):
        read(spark, stub).count()


def test_empty_service_and_bad_options(spark, stub):
    stub.rows = []
    assert read(spark, stub).count() == 0
    with pytest.raises(Exception, match="url and counturl"):
        services.register(spark).read.format("paged_service").schema(SCHEMA).load().count()
    with pytest.raises(Exception, match="unknown options"):
        spark.read.format("paged_service").schema(SCHEMA).options(url="x", counturl="y", paegsize=3).load().count()


def test_values_that_do_not_fit_are_errors(spark, stub):
    stub.rows = [{"id": 1.5}]
    with pytest.raises(Exception, match="no bigint"):
        read(spark, stub).collect()
    stub.rows = [{"id": True}]
    with pytest.raises(Exception, match="no bigint"):
        read(spark, stub).collect()


def test_stream_goes_on_where_it_stopped(spark, stub, tmp_path):
    def run():
        q = read(spark, stub, stream=True).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(once=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r["id"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    assert run() == list(range(95))
    stub.rows = [*stub.rows, *({"id": i, "kind": "a"} for i in range(95, 120))]
    stub.asked.clear()
    assert run() == list(range(120))
    assert min(int(g["offset"]) for p, g in stub.asked if p == "/rows") == 95


def test_clients_of_embeddings_and_answers(spark, stub, tmp_path):
    rows = spark.createDataFrame([(1, "one"), (2, "three"), (3, None)], "id int, text string")
    stub.fail = [503]
    got = shells.embedded(rows.where("text is not null"), "text", services.query_embedder(f"{stub.url}/embed", 2, wait=0.01)).orderBy("id").collect()
    assert [r["vector"] for r in got] == [[3.0, 1.0], [5.0, 1.0]] and [r["error"] for r in got] == [None, None]
    bad = shells.embedded(rows.limit(1), "text", services.query_embedder(f"{stub.url}/embed", 3)).first()
    assert bad["vector"] is None and "widths" in bad["error"]
    assert services.embedder(f"{stub.url}/embed")([]) == []
    known = chunking.embeddings(rows.select("text").where("text is not null"), services.embedder(f"{stub.url}/embed"), f"file://{tmp_path}/cache", "stub")
    assert sorted(r["vector"][0] for r in known.collect()) == [3.0, 5.0]
    said = generation.ask(rows.where("id = 1"), "text", services.answerer(f"{stub.url}/ask", "m")).first()
    assert said["answer"] == "m:ONE" and said["error"] is None


def test_landed_answers_still_read(spark, tmp_path):
    from tessera.sources import readers

    rows = spark.createDataFrame([(1, '[{"refs": ["a", "b"]}]'), (2, '{"error": "none"}')], "k int, body string")
    assert [tuple(r) for r in readers.service_links(rows, "k", "body").collect()] == [(1, "a", "b")]
