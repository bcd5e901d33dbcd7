"""JSON-RPC for agents: initialize, ping, tools/list and tools/call, one message at a time or line by line."""

from __future__ import annotations

import json
from typing import Any, TextIO

from ..context import Context
from ..engine import Engine
from ..errors import EngineError
from . import tools

VERSION = "0.1.0"
PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE, INVALID, UNKNOWN, PARAMS = -32700, -32600, -32601, -32602
_ABOUT = (
    "An analytical table store for agents. Create databases and tables, insert rows, then ask with data_query: in plain language "
    "(request) or with a structured plan. English is read by fixed rules, not by a model; what can't be answered completely is "
    "refused. Every result shows the plan that ran. Start with table_list or schema_get."
)


def tool_result(payload: dict, failed: bool = False, text: str | None = None) -> dict:
    return {"content": [{"type": "text", "text": text or json.dumps(payload, indent=2, ensure_ascii=False)}], "isError": failed, "structuredContent": payload}


class Rpc:
    def __init__(self, engine: Engine):
        self.engine = engine

    def _initialize(self, params: dict, ctx: Context) -> dict:
        wanted = params.get("protocolVersion")
        return {"protocolVersion": wanted if wanted in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "lodeplan", "version": VERSION}, "instructions": _ABOUT}

    def _call(self, params: dict, ctx: Context) -> dict:
        name = params.get("name")
        if not isinstance(name, str):
            raise ValueError('tools/call needs a string "name"')
        try:
            return tool_result(tools.call(self.engine, ctx, name, params.get("arguments")))
        except EngineError as error:
            # a failed tool is a result, so that an agent reads it and tries again
            return tool_result(error.payload(), True, f"{error.message} ({error.code})")

    def handle(self, message: Any, ctx: Context) -> dict | None:
        """The answer to one message; None for a notification."""
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return self._failed(None, INVALID, "not a JSON-RPC request")
        if "id" not in message:
            return None
        number, params = message["id"], message.get("params") or {}
        if message.get("jsonrpc", "2.0") != "2.0":
            return self._failed(number, INVALID, f"unsupported jsonrpc version {message['jsonrpc']!r}")
        methods = {"initialize": self._initialize, "ping": lambda p, c: {}, "tools/list": lambda p, c: {"tools": tools.definitions()}, "tools/call": self._call}
        if message["method"] not in methods:
            return self._failed(number, UNKNOWN, f"method {message['method']!r} is not supported")
        try:
            return {"jsonrpc": "2.0", "id": number, "result": methods[message["method"]](params, ctx)}
        except ValueError as error:
            return self._failed(number, PARAMS, str(error))

    @staticmethod
    def _failed(number: Any, code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": text}}

    def line(self, text: str, ctx: Context) -> str | None:
        try:
            message = json.loads(text)
        except ValueError as error:
            return json.dumps(self._failed(None, PARSE, f"invalid JSON-RPC: {error}"))
        answer = self.handle(message, ctx)
        return None if answer is None else json.dumps(answer, ensure_ascii=False)

    def serve(self, source: TextIO, sink: TextIO, ctx: Context) -> None:
        """One message to a line, until the input ends."""
        for text in source:
            if text.strip() and (answer := self.line(text, ctx)) is not None:
                sink.write(answer + "\n")
                sink.flush()
