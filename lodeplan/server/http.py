"""REST and JSON-RPC over HTTP with the standard library's server.

Sessions of the JSON-RPC door live in memory: an hour without use, or one too many, ends the oldest.
A session is its key's: to any other key it is as unknown as one that has ended.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote, urlsplit

from ..context import Context
from ..engine import Engine
from ..errors import EngineError, bad_request
from . import tools
from .auth import Keyring
from .rpc import PROTOCOLS, VERSION, Rpc

STATUS = {"permission_denied": 403, "not_found": 404, "already_exists": 409, "unsupported": 422, "limit_exceeded": 429, "storage_error": 500, "corruption": 500, "internal_error": 500}
SESSION_SECONDS, SESSIONS, BODY_BYTES = 3600, 10_000, 64 << 20
#: An idle event stream says something this often, so that proxies leave it open.
ALIVE_SECONDS = 15
_DB, _TABLE = r"/v1/databases/(?P<database>[^/]+)", r"/v1/databases/(?P<database>[^/]+)/tables/(?P<table>[^/]+)"
#: Method and path to a tool and how the body becomes its arguments; creation answers 201.
_ROUTES: list[tuple[str, str, str, int]] = [
    ("GET", r"/v1/databases", "database_list", 200), ("POST", r"/v1/databases", "database_create", 201), ("DELETE", _DB, "database_delete", 200),
    ("GET", _DB + "/tables", "table_list", 200), ("POST", _DB + "/tables", "table_create", 201), ("GET", _TABLE, "table_describe", 200),
    ("DELETE", _TABLE, "table_drop", 200), ("PATCH", _TABLE + "/schema", "schema_update", 200), ("POST", _TABLE + "/rows", "data_insert", 200),
    ("PUT", _TABLE + "/rows", "data_upsert", 200), ("POST", _TABLE + "/rows/get", "data_get", 200), ("POST", _TABLE + "/rows/delete", "data_delete", 200),
]


class Sessions:
    def __init__(self, clock: Callable[[], float] = time.monotonic):
        #: By name: when it was last used, and whose it is.
        self.clock, self.seen, self.lock = clock, {}, threading.Lock()

    def create(self, owner: str = "") -> str:
        with self.lock:
            now = self.clock()
            self.seen = {k: s for k, s in self.seen.items() if now - s[0] < SESSION_SECONDS}
            while len(self.seen) >= SESSIONS:
                del self.seen[min(self.seen, key=self.seen.get)]
            name = uuid.uuid4().hex
            self.seen[name] = now, owner
            return name

    def known(self, name: str | None, owner: str = "") -> bool:
        with self.lock:
            now = self.clock()
            used, whose = self.seen.get(name, (None, None))
            if used is None or whose != owner or now - used >= SESSION_SECONDS:
                return False
            self.seen[name] = now, owner
            return True

    def end(self, name: str | None) -> None:
        with self.lock:
            self.seen.pop(name, None)


@dataclass(frozen=True)
class Events:
    """A body that is an event stream: these messages, and then nothing until the server stops, if it stays open."""

    messages: tuple[dict, ...] = ()
    open: bool = False

    def encoded(self) -> bytes:
        return b"".join(b"event: message\ndata: " + json.dumps(m, ensure_ascii=False).encode() + b"\n\n" for m in self.messages)


def _streams(headers: dict[str, str]) -> bool:
    return "text/event-stream" in [part.split(";")[0].strip().lower() for part in headers.get("accept", "").split(",")]


class App:
    """Answers (status, headers, body) without a socket, so that it can be tested without one."""

    def __init__(self, engine: Engine, keys: Keyring, origins: tuple[str, ...] = ()):
        self.engine, self.keys, self.origins, self.rpc, self.sessions = engine, keys, origins, Rpc(engine), Sessions()
        self.stopping = threading.Event()

    def respond(self, method: str, target: str, headers: dict[str, str], body: bytes) -> tuple[int, dict[str, str], Any]:
        headers = {k.lower(): v for k, v in headers.items()}
        path = urlsplit(target).path.rstrip("/") or "/"
        try:
            if path in ("/mcp", "/v1/mcp"):
                return self._rpc(method, headers, body)
            if path == "/healthz" and method == "GET":
                return 200, {}, {"status": "ok", "version": VERSION, "natural_language": "rules"}
            if path == "/v1/tools" and method == "GET":
                return 200, {}, {"tools": tools.definitions()}
            return self._rest(method, path, self.keys.context(headers.get("authorization")), self._json(body))
        except EngineError as error:
            return STATUS.get(error.code, 400), {}, error.payload()

    @staticmethod
    def _json(body: bytes) -> dict:
        try:
            parsed = json.loads(body) if body.strip() else {}
        except ValueError as error:
            raise bad_request(f"the body is not JSON: {error}") from None
        if not isinstance(parsed, dict):
            raise bad_request("the body must be an object")
        return parsed

    def _rest(self, method: str, path: str, ctx: Context, body: dict) -> tuple[int, dict[str, str], Any]:
        allowed = []
        if m := re.fullmatch(_DB + "/(?P<what>query|explain)", path):
            if method == "POST":
                return 200, {}, self._ask(ctx.into(unquote(m["database"])), m["what"], body)
            allowed.append("POST")
        for verb, pattern, tool, status in _ROUTES:
            if m := re.fullmatch(pattern, path):
                if verb == method:
                    return status, {}, tools.call(self.engine, ctx, tool, body | {k: unquote(v) for k, v in m.groupdict().items()} | ({"database": body["name"]} if tool == "database_create" and "name" in body else {}))
                allowed.append(verb)
        if allowed:
            return 405, {"Allow": ", ".join(allowed)}, {"error": {"code": "bad_request", "message": f"{method} is not allowed here"}}
        raise EngineError("not_found", f"no route {path}")

    def _ask(self, ctx: Context, what: str, body: dict) -> dict:
        source = body.get("request") if body.get("request") is not None else body.get("plan")
        if source is None or body.get("request") is not None and body.get("plan") is not None:
            raise bad_request('pass either "request" or "plan"')
        return self.engine.explain(ctx, source) if what == "explain" else self.engine.query(ctx, source).to_json()

    def _rpc(self, method: str, headers: dict[str, str], body: bytes) -> tuple[int, dict[str, str], Any]:
        origin = headers.get("origin")
        cors = {"Access-Control-Allow-Origin": origin, "Vary": "Origin"} if origin else {}
        if origin and origin not in self.origins and urlsplit(origin).hostname not in ("localhost", "127.0.0.1", "::1"):
            return 403, {}, {"error": {"code": "permission_denied", "message": f"origin {origin} is not allowed"}}
        if method == "OPTIONS":
            return 204, cors | {"Access-Control-Allow-Methods": "POST, GET, DELETE, OPTIONS", "Access-Control-Allow-Headers": "authorization, content-type, accept, mcp-session-id, mcp-protocol-version", "Access-Control-Expose-Headers": "mcp-session-id"}, None
        ctx, session = self.keys.context(headers.get("authorization")), headers.get("mcp-session-id")
        version = headers.get("mcp-protocol-version")
        if version is not None and version not in PROTOCOLS:
            raise bad_request(f"protocol version {version!r} is not supported; use one of {', '.join(PROTOCOLS)}")
        owner = hashlib.sha256(headers["authorization"].strip().partition(" ")[2].strip().encode()).hexdigest()
        if session is not None and not self.sessions.known(session, owner):
            return 404, cors, {"error": {"code": "not_found", "message": "this session has ended; initialize again"}}
        if method == "DELETE":
            self.sessions.end(session)
            return 204, cors, None
        if method == "GET" and _streams(headers):
            return 200, cors, Events(open=True)
        if method != "POST":
            return 405, cors | {"Allow": "GET, POST, DELETE, OPTIONS"}, {"error": {"code": "bad_request", "message": "POST a message, or GET an event stream"}}
        try:
            message = json.loads(body)
        except ValueError as error:
            return 400, cors, Rpc._failed(None, -32700, f"invalid JSON-RPC: {error}")
        if isinstance(message, dict) and "method" not in message and ("result" in message or "error" in message):
            return 202, cors, None  # a client's answer; this server asks nothing
        answer = self.rpc.handle(message, ctx)
        if answer is None:
            return 202, cors, None
        if isinstance(message, dict) and message.get("method") == "initialize" and "result" in answer:
            cors = cors | {"Mcp-Session-Id": self.sessions.create(owner)}
        return 200, cors, Events((answer,)) if _streams(headers) else answer


def server(app: App, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _any(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > BODY_BYTES:
                status, headers, body = 413, {}, {"error": {"code": "limit_exceeded", "message": "the body is too large"}}
            else:
                status, headers, body = app.respond(self.command, self.path, dict(self.headers), self.rfile.read(size))
            events = isinstance(body, Events)
            data = b"" if body is None else body.encoded() if events else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            for name, value in headers.items():
                self.send_header(name, value)
            self.send_header("Content-Type", "text/event-stream" if events else "application/json")
            if events and body.open:
                self.send_header("Cache-Control", "no-cache")
            else:
                self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)
            if events and body.open:
                self.wfile.flush()
                with contextlib.suppress(OSError):  # the client has gone
                    while not app.stopping.wait(ALIVE_SECONDS):
                        self.wfile.write(b": idle\n\n")

        do_GET = do_POST = do_PUT = do_PATCH = do_DELETE = do_OPTIONS = _any

        def log_message(self, *args: Any) -> None:
            pass

    class Server(ThreadingHTTPServer):
        def shutdown(self) -> None:
            app.stopping.set()  # ends open event streams
            super().shutdown()

    return Server((host, port), Handler)
