"""The HTTP interface: tables, queries, results, errors and system information."""

from __future__ import annotations

import json
import logging
import re
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from .engine import COMPLETED, FAILED, Engine
from .plans import request
from .plans.problems import Invalid, Malformed

INTERFACE_VERSION = "2.1.0"
VERSION = "1.0.0"
AUTHOR = "millrace"

log = logging.getLogger(__name__)
Answer = tuple[int, object]


class Service:
    """What each operation answers: a status and a JSON value (None: no body)."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.started = time.time()
        self.routes = [
            ("GET", r"/tables", self.tables), ("GET", r"/table/([^/]+)", self.table), ("DELETE", r"/table/([^/]+)", self.drop),
            ("PUT", r"/table", self.create), ("GET", r"/queries", self.queries), ("GET", r"/query/([^/]+)", self.query),
            ("POST", r"/query", self.submit), ("GET", r"/result/([^/]+)", self.result), ("GET", r"/error/([^/]+)", self.error),
            ("GET", r"/system/info", self.info), ("GET", r"/api/openapi\.json", self.specification),
        ]

    def answer(self, method: str, path: str, body: bytes) -> Answer:
        allowed = False
        path = path.rstrip("/") or "/"
        for verb, pattern, handler in self.routes:
            m = re.fullmatch(pattern, path)
            if m and verb == method:
                try:
                    return handler(*map(unquote, m.groups()), body=body)
                except Malformed as e:
                    return 400, str(e)
                except Invalid as e:
                    return 400, e.report()
            allowed = allowed or bool(m)
        return (405, None) if allowed else (404, None)

    def tables(self, body: bytes) -> Answer:
        return 200, [{"tableId": i, "name": n} for i, n in self.engine.catalog.tables()]

    def table(self, table_id: str, body: bytes) -> Answer:
        t = self.engine.catalog.by_id(table_id)
        if t is None:
            return 404, {"message": "Table not found"}
        return 200, {"name": t.name, "columns": [{"name": c, "type": k} for c, k in t.columns.items()]}

    def drop(self, table_id: str, body: bytes) -> Answer:
        if not self.engine.catalog.drop(table_id):
            return 404, {"message": "Table not found"}
        return 200, None

    def create(self, body: bytes) -> Answer:
        t = request.table(request.load(body))
        return 200, self.engine.catalog.create(t.name, [(c.name, c.type) for c in t.columns])

    def queries(self, body: bytes) -> Answer:
        return 200, [{"queryId": j.id, "status": j.state} for j in self.engine.jobs()]

    def query(self, job_id: str, body: bytes) -> Answer:
        job = self.engine.job(job_id)
        if job is None:
            return 404, {"message": "Query not found"}
        done = job.state == COMPLETED
        out = {"queryId": job.id, "status": job.state, "queryDefinition": job.definition}
        return 200, out | ({"isResultAvailable": True} if done else {})

    def submit(self, body: bytes) -> Answer:
        data = request.load(body)
        return 200, self.engine.submit(request.query(data), data["queryDefinition"])

    def result(self, job_id: str, body: bytes) -> Answer:
        limit, flush = request.result_options(body)
        job = self.engine.job(job_id)
        if job is None:
            return 404, {"message": "Query not found"}
        if job.is_copy:
            return 400, {"message": "COPY queries do not return a result set"}
        if job.state != COMPLETED:
            return 400, {"message": f"Query is in state {job.state}"}
        return 200, [self.engine.result(job_id, limit, flush)]

    def error(self, job_id: str, body: bytes) -> Answer:
        job = self.engine.job(job_id)
        if job is None:
            return 404, {"message": "Query not found"}
        if job.state != FAILED:
            return 400, {"message": "Query did not fail"}
        return 200, Invalid(*job.error).report()

    def specification(self, body: bytes) -> Answer:
        """An OpenAPI description of the operations."""
        paths: dict[str, dict] = {}
        for verb, pattern, handler in self.routes[:-1]:
            path = pattern.replace("([^/]+)", "{id}")
            about = {"operationId": handler.__name__, "responses": {"200": {"description": "done"}, "400": {"description": "not valid"}}}
            if "{id}" in path:
                about["parameters"] = [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}]
                about["responses"]["404"] = {"description": "not found"}
            if verb in ("PUT", "POST"):
                about["requestBody"] = {"required": True, "content": {"application/json": {"schema": {"type": "object"}}}}
            paths.setdefault(path, {})[verb.lower()] = about
        return 200, {"openapi": "3.0.3", "info": {"title": "millrace", "version": INTERFACE_VERSION}, "paths": paths}

    def page(self) -> str:
        """The operations for a reader, as HTML."""
        rows = [
            f"<tr><td>{verb.upper()}</td><td>{path}</td><td>{about['operationId']}</td></tr>"
            for path, verbs in self.specification(b"")[1]["paths"].items() for verb, about in verbs.items()
        ]
        table = "<table><tr><th>method</th><th>path</th><th>operation</th></tr>" + "".join(rows) + "</table>"
        return f'<!doctype html><title>millrace</title><h1>millrace {INTERFACE_VERSION}</h1>{table}<a href="/api/openapi.json">openapi.json</a>'

    def info(self, body: bytes) -> Answer:
        up = int(time.time() - self.started)
        return 200, {"author": AUTHOR, "version": VERSION, "interfaceVersion": INTERFACE_VERSION, "uptime": up}


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that isn't started yet; port 0 takes any free one."""
    service = Service(engine)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _serve(self) -> None:
            began = time.perf_counter()
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            path = urlsplit(self.path).path
            kind = "application/json"
            try:
                if (self.command, path.rstrip("/")) == ("GET", "/swagger"):
                    status, kind, data = 200, "text/html", service.page().encode()
                else:
                    status, value = service.answer(self.command, path, body)
                    data = b"" if value is None else json.dumps(value, ensure_ascii=False).encode() + b"\n"
            except Exception:
                log.exception("%s %s", self.command, path)
                status, data = 500, b'{"message": "internal error"}\n'
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=UTF-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)
            log.info("%s %s %d %.1f ms", self.command, path, status, 1000 * (time.perf_counter() - began))

        do_GET = do_PUT = do_POST = do_DELETE = _serve

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    """Serves an engine: python -m millrace.http_api FOLDER DATA_ROOT PORT"""
    import sys

    from pyspark.sql import SparkSession

    logging.basicConfig(level=logging.INFO)
    folder, root, port = sys.argv[1], sys.argv[2], int(sys.argv[3])
    server(Engine(SparkSession.builder.getOrCreate(), folder, root), "0.0.0.0", port).serve_forever()


if __name__ == "__main__":
    main()
