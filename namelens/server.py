"""A thin HTTP service over the engine: health, single and batch screening, list counts."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from namelens.operators.aggregates import batch_response
from namelens.operators.screening import prepare_watchlist, screen
from namelens.schema import DEFAULT_LISTS, DEFAULT_THRESHOLD, validate_threshold
from namelens.sources.store import WatchlistStore

#: Seconds that a connection may be silent.
TIMEOUT = 30
#: Bytes of a request's body at most.
MOST_BYTES = 1 << 20


class Service:
    """Answers requests; the prepared watchlist of each set of lists is kept until the store's version changes.

    A table that requests may still read is not dropped at once but left to the session's cleaner.
    """

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, WatchlistStore(spark, store)
        self._kept: dict[tuple, DataFrame] = {}
        self._version: object = None
        self._lock = threading.Lock()

    def _watchlist(self, lists) -> DataFrame:
        key = tuple(sorted(set(lists)))
        with self._lock:
            version = self.store.version()
            if version != self._version:
                self._version, self._kept = version, {}
            if key not in self._kept:
                self._kept[key] = prepare_watchlist(self.store.load(key)).cache()
            return self._kept[key]

    def _screen(self, names: list[str], body: dict) -> list[dict]:
        threshold = validate_threshold(body["threshold"] if body.get("threshold") is not None else DEFAULT_THRESHOLD)
        inputs = self.spark.createDataFrame(list(enumerate(names)), "input_id long, name string")
        found = screen(inputs, self._watchlist(body.get("lists") or DEFAULT_LISTS), threshold)
        rows = batch_response(inputs, found).orderBy("input_id").collect()
        return [{"matches": [m.asDict() for m in r.matches], "input_name": r.input_name, "count": r["count"]} for r in rows]

    def answer(self, method: str, path: str, body: dict | None) -> tuple[int, object]:
        """(status, answer) of a request."""
        began = time.monotonic()
        passed = lambda: int((time.monotonic() - began) * 1000)
        try:
            if (method, path) == ("GET", "/api/v1/health"):
                return 200, {"status": "ok"}
            if (method, path) == ("GET", "/api/v1/lists"):
                return 200, [{"id": r["list"], "name": r["list"], "count": r["count"]} for r in self.store.counts(DEFAULT_LISTS).collect()]
            if method == "GET" and path.startswith("/api/v1/lists/") and path.endswith("/count"):
                name = path.split("/")[4]
                return 200, {"list": name, "count": self.store.counts([name]).first()["count"]}
            if (method, path) == ("POST", "/api/v1/screen"):
                if not isinstance(body, dict) or not body.get("name"):
                    return 400, {"error": "name is required"}
                return 200, self._screen([body["name"]], body)[0] | {"screening_time_ms": passed()}
            if (method, path) == ("POST", "/api/v1/screen/batch"):
                if not isinstance(body, dict) or not body.get("names"):
                    return 400, {"error": "names is required"}
                results = self._screen(list(body["names"]), body)
                return 200, {"results": results, "total_matches": sum(r["count"] for r in results), "screening_time_ms": passed()}
        except (TypeError, ValueError) as e:
            return 400, {"error": str(e)}
        return 404, {"error": "not found"}


def serve(spark: SparkSession, store: str, port: int) -> None:
    """Serves until interrupted."""
    service = Service(spark, store)

    class Handler(BaseHTTPRequestHandler):
        timeout = TIMEOUT

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            for name, value in (("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type"), ("Content-Length", "0")):
                self.send_header(name, value)
            self.end_headers()

        def _reply(self, status: int, answer: object) -> None:
            data = json.dumps(answer, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._reply(*service.answer("GET", self.path, None))

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                return self._reply(400, {"error": "too large"})
            try:
                body = json.loads(self.rfile.read(size))
            except ValueError:
                return self._reply(400, {"error": "invalid JSON"})
            return self._reply(*service.answer("POST", self.path, body))

    server = ThreadingHTTPServer(("", port), Handler)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.shutdown()
    finally:
        server.server_close()
