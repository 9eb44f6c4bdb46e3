"""A small HTTP server over the log that a capture writes (Capture.into_log): /events as server-sent events, /health, /status.

It is an edge, not part of the engine: it reads the log batch by batch, in order of (batch, place), and holds a page of it at a time.
Batches are folders, so a poll reads only those behind the last one sent, and an event that comes late in its own time comes in a later batch
and is sent all the same.  A client that comes back with Last-Event-ID goes on behind that event; an id that the log doesn't have gets an error frame,
then the log from its beginning.  With `most_behind`, a client that many events behind is told how many it has missed and goes on nearer to the end;
without, each client gets each event.  With an API key all but /health ask for it.
"""

from __future__ import annotations

import hmac
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import json_of_event

#: Events that a client is sent from one read of the table.
PAGE = 1000


def allowed(headers, key: str | None) -> bool:
    """Whether a request carries the key, as a bearer token or X-Api-Key."""
    if not key:
        return True
    given = headers.get("X-Api-Key") or (headers.get("Authorization") or "").removeprefix("Bearer ")
    return hmac.compare_digest(given.encode(), key.encode())


class EventServer:
    def __init__(self, spark, path: str, status=lambda: {}, host: str = "127.0.0.1", port: int = 0, api_key: str | None = None, heartbeat_s: float = 30.0, poll_s: float = 0.5, most_behind: int | None = None):
        self.spark, self.path, self.status, self.api_key, self.heartbeat_s, self.poll_s, self.most_behind = spark, path, status, api_key, heartbeat_s, poll_s, most_behind
        self.closing, outer = threading.Event(), self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def do_GET(self):
                outer.handle(self)

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.server.daemon_threads = True
        self.port = self.server.server_address[1]

    def start(self) -> "EventServer":
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.closing.set()
        self.server.shutdown()
        self.server.server_close()

    def log(self, at: tuple[int, int] | None) -> DataFrame | None:
        """Events behind a place; None while there is no log."""
        try:
            events = self.spark.read.parquet(self.path)
        except AnalysisException:
            return None
        return events if at is None else events.filter((F.col("batch") > at[0]) | ((F.col("batch") == at[0]) & (F.col("place") > at[1])))

    def page(self, at: tuple[int, int] | None) -> list:
        """The next events behind a place, as (batch, place, id, JSON text)."""
        events = self.log(at)
        if events is None:
            return []
        return [tuple(r) for r in events.select("batch", "place", "id", json_of_event()).orderBy("batch", "place").limit(PAGE).collect()]

    def place(self, event_id: str) -> tuple[int, int] | None:
        """Where an event stands, the last time it does."""
        events = self.log(None)
        row = events.filter(F.col("id") == event_id).agg(F.max(F.struct("batch", "place")).alias("at")).first()["at"] if events is not None else None
        return row and tuple(row)

    def skipped(self, at: tuple[int, int] | None) -> tuple[int, tuple[int, int] | None]:
        """How many events a client at a place must leave out to be no more than `most_behind` behind, and where it goes on."""
        events = self.log(at)
        if self.most_behind is None or events is None:
            return 0, at
        sizes = sorted((r["batch"], r["n"]) for r in events.groupBy("batch").agg(F.count("*").alias("n")).collect())
        over = sum(n for _, n in sizes) - self.most_behind
        if over <= 0:
            return 0, at
        left = over
        for batch, n in sizes:
            if left <= n:
                first = at[1] + 1 if at is not None and at[0] == batch else 0
                return over, (batch, first + left - 1)
            left -= n
        return 0, at

    def handle(self, request) -> None:
        path = request.path.split("?")[0]
        if path != "/health" and not allowed(request.headers, self.api_key):
            return self._json(request, 401, {"error": "unauthorized"})
        if path in ("/health", "/status"):
            state = self.status()
            return self._json(request, 503 if state.get("status") == "down" else 200, {"status": state.get("status", "ok")} if path == "/health" else state)
        if path != "/events":
            return self._json(request, 404, {"error": "not found"})
        request.send_response(200)
        request.send_header("Content-Type", "text/event-stream")
        request.end_headers()
        try:
            asked = request.headers.get("Last-Event-ID")
            at = self.place(asked) if asked else None
            if asked and at is None:
                request.wfile.write(b'event: error\ndata: {"code":"unknown_event_id"}\n\n')
            self._stream(request.wfile, at)
        except (BrokenPipeError, ConnectionResetError):
            pass

    def _stream(self, out, at: tuple | None) -> None:
        beat = time.monotonic() + self.heartbeat_s
        while not self.closing.is_set():
            missed, at = self.skipped(at)
            if missed:
                out.write(b'event: error\ndata: {"code":"lagged","skipped":%d}\n\n' % missed)
            rows = self.page(at)
            for batch, place, id, text in rows:
                out.write(f"event: change\nid: {id}\ndata: {text}\n\n".encode())
                at = (batch, place)
            if time.monotonic() >= beat:
                out.write(b'event: heartbeat\ndata: {"ts_ms":%d}\n\n' % (time.time() * 1000))
                beat = time.monotonic() + self.heartbeat_s
            out.flush()
            if not rows:
                self.closing.wait(self.poll_s)
        out.write(b"event: shutdown\ndata: {}\n\n")
        out.flush()

    @staticmethod
    def _json(request, code: int, body: dict) -> None:
        text = json.dumps(body).encode()
        request.send_response(code)
        request.send_header("Content-Type", "application/json")
        request.send_header("Content-Length", str(len(text)))
        request.end_headers()
        request.wfile.write(text)
