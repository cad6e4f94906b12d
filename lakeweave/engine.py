"""The engine: SQL text in, DataFrames or rows out; plus submitting, streaming, explaining and stopping queries."""

from __future__ import annotations

import itertools
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .errors import QueryError
from .plans.planner import Planner
from .sql import parse_script
from .sql.tree import CreateTable

BATCH = 100


class Engine:
    """Queries over a catalog. fold_case: find columns regardless of case (names are case-sensitive otherwise)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fold_case: bool = False):
        self.spark, self.fold = spark, fold_case
        self.catalog = Catalog(spark, folder)
        self.submitted: dict[str, tuple[object, list, list]] = {}

    def _plan(self, statement) -> tuple[DataFrame, Planner]:
        planner = Planner(self.catalog, self.fold)
        rel, _ = planner.query(statement.query if isinstance(statement, CreateTable) else statement)
        return rel.output(), planner

    def _execute(self, statement) -> DataFrame:
        """A query's DataFrame; CREATE TABLE runs and gives one empty row."""
        frame, _ = self._plan(statement)
        if isinstance(statement, CreateTable):
            self.catalog.create(statement.parts, frame)
            return self.spark.range(1).select()
        return frame

    def sql(self, text: str) -> DataFrame:
        """Run all statements but take only the last one's result; a query stays lazy."""
        *before, last = parse_script(text)
        for statement in before:
            if isinstance(statement, CreateTable):
                self._execute(statement)
            else:
                self._plan(statement)
        return self._execute(last)

    def run(self, text: str) -> list[dict]:
        """The rows as dictionaries; of columns of one name the last stays."""
        return [dict(zip(row.__fields__, row)) if len(row) else {} for row in self.sql(text).collect()]

    def explain(self, text: str) -> dict:
        """Operators as nodes and edges, and Spark's plan, without running anything."""
        frame, planner = self._plan(parse_script(text)[-1])
        plan = frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return {"nodes": planner.nodes, "edges": planner.edges, "plan": plan}

    # Service
    def submit(self, text: str) -> dict:
        """Plan a query; its id names it in stream() and terminate()."""
        *before, last = parse_script(text)
        for statement in before:
            self._execute(statement)
        query_id = uuid.uuid4().hex
        frame, planner = self._plan(last)
        self.submitted[query_id] = (last, frame, planner)
        return {"query_id": query_id, "nodes": planner.nodes, "edges": planner.edges}

    def stream(self, query_id: str) -> Iterator[dict]:
        """Events of a submitted query, from QueryStart to QueryComplete or QueryError; rows come in batches."""
        if query_id not in self.submitted:
            raise QueryError(f"Query {query_id} not found")
        statement, frame, planner = self.submitted.pop(query_id)
        began, rows = time.time(), 0
        yield {"event": "QueryStart", "query_id": query_id}
        context = self.spark.sparkContext
        context.addJobTag(query_id)
        try:
            seen = Observation()
            frame = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
            if isinstance(statement, CreateTable):
                self.catalog.create(statement.parts, frame)
                rows = seen.get["rows"]
                yield {"event": "QueryMutationStatus", "status": f"CREATE {rows} in {time.time() - began:.2f}s"}
            else:
                yield {"event": "ResultSchema", "columns": frame.columns}
                source = frame.toLocalIterator()
                while batch := [list(r) for r in itertools.islice(source, BATCH)]:
                    rows += len(batch)
                    yield {"event": "ResultRows", "rows": batch}
            seconds = time.time() - began
            for node in planner.nodes:
                yield {"event": "OperatorStats", "id": node["id"], "name": node["name"], "state": "done", "elapsed_seconds": seconds}
            yield {"event": "QueryStats", "elapsed_seconds": seconds, "rows": rows, "rows_per_sec": rows / max(seconds, 1e-9)}
            yield {"event": "QueryComplete", "query_id": query_id}
        except Exception as problem:
            yield {"event": "QueryError", "query_id": query_id, "error": str(problem)}
        finally:
            context.removeJobTag(query_id)

    def terminate(self, query_id: str) -> None:
        """Stop the jobs of a query that stream() is running in another thread, and forget one not yet streamed."""
        self.submitted.pop(query_id, None)
        self.spark.sparkContext.cancelJobsWithTag(query_id)


def serve(engine: Engine, port: int = 8000) -> threading.Thread:
    """The service over HTTP: POST /query, GET /stream?query_id=, POST /explain, POST /terminate, GET /healthcheck."""
    import json
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def reply(self, value, code: int = 200) -> None:
            body = json.dumps(value, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            if url.path == "/healthcheck":
                return self.reply({"ok": True})
            if url.path != "/stream":
                return self.reply({"error": "not found"}, 404)
            query_id = parse_qs(url.query).get("query_id", [""])[0]
            if query_id not in engine.submitted:
                return self.reply({"error": f"Query {query_id} not found"}, 400)
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            for event in engine.stream(query_id):
                self.wfile.write(f"event: {event['event']}\ndata: {json.dumps(event, default=str)}\n\n".encode())
                self.wfile.flush()

        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                needs = {"/query": "sql", "/explain": "sql", "/terminate": "query_id"}.get(self.path)
                if needs is None:
                    return self.reply({"error": "not found"}, 404)
                if not isinstance(body, dict) or not isinstance(body.get(needs), str):
                    return self.reply({"error": f"`{needs}` is missing"}, 400)
                if self.path == "/query":
                    return self.reply(engine.submit(body["sql"]))
                if self.path == "/explain":
                    return self.reply(engine.explain(body["sql"]))
                engine.terminate(body["query_id"])
                self.reply({"ok": True})
            except (QueryError, ValueError) as problem:
                self.reply({"error": str(problem)}, 400)
            except Exception as problem:
                self.reply({"error": str(problem)}, 500)

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.server = server
    thread.start()
    return thread
