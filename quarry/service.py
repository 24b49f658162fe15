"""The search over HTTP: a thin handler over the engine, one query at a time.

    POST /v1/search            {"query", "limit", "include_debug"}
    POST /search, /analogs     the same, with the older "top_k" (which comes before limit) and "use_hybrid" (search is always hybrid)
    GET  /health/live          200
    GET  /health/ready         200 with the index's name and size, or 503 with the reason
"""

from __future__ import annotations

import json
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quarry.functions.encode import Encoder
from quarry.plans import engine, index
from quarry.settings import Settings

PUBLIC = ("rank", "relevance_rating", "product", "match_reasons", "mismatches", "source_evidence", "score_breakdown")
#: Fields of a request: their type, whether null will do, and whether only the older endpoints know them.
REQUEST = {"query": (str, False, False), "limit": (int, False, False), "include_debug": (bool, False, False), "top_k": (int, True, True), "use_hybrid": (bool, False, True)}


class Invalid(ValueError):
    """A request that breaks the rules."""


def without_nulls(x):
    if isinstance(x, dict):
        return {k: without_nulls(v) for k, v in x.items() if v is not None}
    return [without_nulls(v) for v in x] if isinstance(x, list) else x


def request_of(body: bytes, s: Settings, *, legacy: bool) -> tuple[str, int, bool]:
    """(query, limit, include_debug); unknown fields, wrong types and values out of bounds are refused."""
    try:
        given = json.loads(body)
    except ValueError:
        raise Invalid("the body isn't JSON") from None
    if not isinstance(given, dict):
        raise Invalid("the body isn't an object")
    for name, value in given.items():
        kind, null, old = REQUEST.get(name, (None, False, False))
        if kind is None or old and not legacy:
            raise Invalid(f"unknown field: {name}")
        if not (value is None and null) and (not isinstance(value, kind) or kind is int and isinstance(value, bool)):
            raise Invalid(f"{name} must be {kind.__name__}")
    if "query" not in given:
        raise Invalid("query is missing")
    limit = given.get("limit", s.limit)
    for n in (limit, given.get("top_k") if given.get("top_k") is not None else limit):
        engine.validate(given["query"], n, s)
    return given["query"], given.get("top_k") or limit, given.get("include_debug", False)


class Service:
    """An open index behind the endpoints; ``handle`` is all of it but the sockets."""

    def __init__(self, spark, idx, encoder: Encoder, settings: Settings = Settings()):
        self.spark, self.idx, self.encoder, self.settings = spark, idx, encoder, settings

    def handle(self, method: str, path: str, body: bytes = b"") -> tuple[int, dict]:
        if (method, path) == ("GET", "/health/live"):
            return 200, {"status": "ok"}
        if (method, path) == ("GET", "/health/ready"):
            return self.ready()
        if method == "POST" and path in ("/v1/search", "/search", "/analogs"):
            if self.idx is None:
                return 503, {"detail": "Search engine is not ready"}
            try:
                query, limit, debug = request_of(body, self.settings, legacy=path != "/v1/search")
            except ValueError as e:
                return 422, {"detail": str(e)}
            return 200, self.search(query, limit, debug)
        return 404, {"detail": "Not Found"}

    def search(self, query: str, limit: int, debug: bool) -> dict:
        a = engine.answer(self.spark, query, self.idx, self.encoder, self.settings, limit=limit)
        out = {"request_id": str(uuid.uuid4()), "query": a.query, "count": len(a.results), "results": [{k: r[k] for k in PUBLIC} for r in a.results], "timing_ms": a.timing_ms}
        if debug:
            out["debug"] = {"processed_query": a.processed}
        return without_nulls(out)

    def ready(self) -> tuple[int, dict]:
        if self.idx is None:
            return 503, {"detail": "Search backend is not ready"}
        try:
            problems = index.readiness(self.idx, self.encoder, model=self.settings.model, revision=self.settings.revision)
        except Exception:  # noqa: BLE001  whatever keeps the index from being read
            return 503, {"detail": "Search backend is not ready"}
        meta = self.idx.meta
        details = {"runtime_model": self.settings.model, "runtime_revision": self.settings.revision, "runtime_dimension": self.encoder.dimension, "index_model": meta.embedding_model, "index_revision": meta.embedding_revision, "index_dimension": meta.embedding_dimension}
        if problems:
            return 503, {"status": "not_ready", "reason": problems[0].upper(), "details": details}
        return 200, {"status": "ok", "collection_alias": meta.collection_alias, "resolved_collection_name": meta.collection_name, "point_count": meta.document_count, "details": details}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server for the service; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, out = service.handle(self.command, self.path.split("?")[0], body)
            except Exception:  # noqa: BLE001  a failed query must not end the connection without an answer
                self.log_error("query failed")
                status, out = 500, {"detail": "Internal Server Error"}
            data = json.dumps(out, ensure_ascii=False, default=str).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
