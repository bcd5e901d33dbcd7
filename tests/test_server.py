import io
import json
import threading
import time
import urllib.request

import pytest

from lodeplan.context import Context
from lodeplan.engine import Engine
from lodeplan.errors import EngineError
from lodeplan.server import tools
from lodeplan.server.auth import Key, Keyring
from lodeplan.server.http import App, Sessions, server
from lodeplan.server.rpc import Rpc

COLUMNS = [{"name": "id", "type": "int64", "nullable": False, "semantic_type": "id"}, {"name": "country", "type": "utf8", "semantic_type": "country"}, {"name": "value", "type": "float64", "semantic_type": "currency", "default_aggregation": "sum"}, {"name": "secret", "type": "utf8", "sensitive": True}]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine.open(spark, f"file://{tmp_path_factory.mktemp('server')}")


@pytest.fixture(scope="module")
def app(engine):
    keys = [Key("rw", "acme", scopes=frozenset(Context().scopes)), Key.from_json({"key": "ro", "tenant": "acme"})]
    return App(engine, Keyring(keys))


def send(app, method, path, body=None, key="rw", **headers):
    status, extra, out = app.respond(method, path, {"Authorization": f"Bearer {key}"} | {k.replace("_", "-"): v for k, v in headers.items()}, b"" if body is None else json.dumps(body).encode())
    return status, out, extra


def test_there_are_fourteen_tools():
    assert len(tools.NAMES) == 14 and {d["name"] for d in tools.definitions()} == set(tools.NAMES)
    assert all(d["inputSchema"]["additionalProperties"] is False for d in tools.definitions())


def test_the_story_over_tools(engine):
    ctx = Context("story")

    def call(name, **args):
        return tools.call(engine, ctx, name, args)

    with pytest.raises(EngineError, match="none yet"):
        call("table_list")
    call("database.create", database="crm")
    call("table_create", table="leads", columns=COLUMNS, primary_key=["id"])
    assert call("data_insert", table="leads", rows=[{"id": i, "country": "uk" if i % 2 else "de", "value": i} for i in range(10)])["rows_written"] == 10
    assert call("data_query", request="total value by country in leads")["interpretation"].startswith("reading leads")
    assert call("data_query", plan={"table": "leads", "order_by": [{"column": "id"}]}, limit=2)["rows"] == [{"id": 0, "country": "de", "value": 0.0}, {"id": 1, "country": "uk", "value": 1.0}]
    assert call("data_query", request="list leads", limit=3)["stats"]["truncated"] is True
    assert call("data_upsert", table="leads", rows=[{"id": 1, "value": 50}])["rows_written"] == 1
    assert call("data_get", table="leads", keys=[1, 77]) == {"rows": [{"id": 1, "country": None, "value": 50.0, "secret": None}], "found": 1, "requested": 2}
    assert call("data_delete", table="leads", keys=[1, 77]) == {"deleted": 1, "requested": 2}
    assert call("table_list")["tables"][0]["rows"] == 9
    assert "secret" not in call("schema_get")["context"] and call("schema_get", table="leads")["stats"]["rows"] == 9
    assert call("schema_update", table="leads", columns=[*COLUMNS, {"name": "tier", "type": "utf8"}])["version"] == 2
    assert call("table_describe", table="leads")["schema"]["primary_key"] == ["id"]
    for args, text in (({"table": "lead"}, "Tables in this database: leads"), ({}, "needs a string 'table'")):
        with pytest.raises(EngineError, match=text) as e:
            call("table_describe", **args)
        assert e.value.code == "bad_request"
    for args in ({}, {"request": "x", "plan": {}}):
        with pytest.raises(EngineError, match="pass"):
            call("data_query", **args)
    with pytest.raises(EngineError, match="cascade"):
        call("database_delete", database="crm")
    assert call("table_drop", table="leads") == {"dropped": "leads"}
    assert call("database_delete", database="crm", cascade=True) == {"deleted": "crm", "tables_deleted": 0}
    with pytest.raises(EngineError, match="was not found"):
        call("nothing")


def test_rpc_lines(engine):
    rpc, ctx = Rpc(engine), Context("rpc")
    lines = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}}, {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "database_list"}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "table_drop", "arguments": {"table": "x", "database": "nope"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "resources/list"}, {"jsonrpc": "1.0", "id": 6, "method": "ping"}, {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {}}, {"jsonrpc": "2.0", "id": "p", "method": "ping"},
    ]
    out = io.StringIO()
    rpc.serve(io.StringIO("\n".join(map(json.dumps, lines)) + "\n\n{\n"), out, ctx)
    a = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in a] == [1, 2, 3, 4, 5, 6, 7, "p", None]
    assert a[0]["result"]["protocolVersion"] == "2024-11-05" and len(a[1]["result"]["tools"]) == 14
    assert a[2]["result"]["structuredContent"] == {"databases": []} and a[2]["result"]["isError"] is False
    assert a[3]["result"]["isError"] is True and a[3]["result"]["structuredContent"]["error"]["code"] == "not_found"
    assert [a[k]["error"]["code"] for k in (4, 5, 6, 8)] == [-32601, -32600, -32602, -32700]


def test_rest(app):
    assert send(app, "GET", "/healthz", key="none")[0] == 200
    for key in ("wrong", ""):
        assert send(app, "GET", "/v1/databases", key=key)[0] == 403
    assert send(app, "POST", "/v1/databases", {"name": "shop"})[0] == 201
    assert send(app, "POST", "/v1/databases", {"name": "shop"})[0] == 409
    assert send(app, "POST", "/v1/databases", {"name": "Shop"})[0] == 400
    assert send(app, "POST", "/v1/databases/shop/tables", {"table": "leads", "columns": COLUMNS, "primary_key": ["id"]})[0] == 201
    at = "/v1/databases/shop/tables/leads"
    assert send(app, "POST", f"{at}/rows", {"rows": [{"id": 1, "country": "uk", "value": 2}, {"id": 2}]})[1]["rows_written"] == 2
    assert send(app, "POST", f"{at}/rows", {"rows": [{"id": 9}]}, key="ro")[0] == 403
    assert send(app, "PUT", f"{at}/rows", {"rows": [{"id": 2, "value": 3}]})[0] == 200
    assert send(app, "POST", f"{at}/rows/get", {"keys": [2]})[1]["rows"][0]["value"] == 3.0
    assert send(app, "POST", f"{at}/rows/delete", {"keys": [2]})[1]["deleted"] == 1
    assert send(app, "GET", at, key="ro")[1]["stats"]["rows"] == 1
    assert send(app, "PATCH", f"{at}/schema", {"columns": [*COLUMNS, {"name": "x", "type": "date"}]})[1]["version"] == 2
    assert send(app, "PATCH", f"{at}/schema", {"columns": COLUMNS})[0] == 422
    ask = "/v1/databases/shop/query"
    assert send(app, "POST", ask, {"request": "how many leads"}, key="ro")[1]["rows"] == [{"count": 1}]
    assert send(app, "POST", ask, {"plan": {"table": "nothing"}})[0] == 404
    assert send(app, "POST", ask, {"request": "leads joined with leads without orders"})[0] == 422
    assert send(app, "POST", ask, {})[0] == 400
    assert "scan leads" in send(app, "POST", "/v1/databases/shop/explain", {"plan": {"table": "leads"}})[1]["physical"]
    assert send(app, "PUT", ask)[0] == 405 and send(app, "GET", "/v1/nothing")[0] == 404
    assert app.respond("POST", ask, {"Authorization": "Bearer rw"}, b"{")[0] == 400
    assert send(app, "DELETE", "/v1/databases/shop")[0] == 400
    assert send(app, "DELETE", at)[0] == 200 and send(app, "DELETE", "/v1/databases/shop")[0] == 200


def test_rpc_over_http(app):
    status, out, headers = send(app, "POST", "/mcp", {"jsonrpc": "2.0", "id": 1, "method": "initialize"})
    session = headers["Mcp-Session-Id"]
    assert status == 200 and out["result"]["serverInfo"]["name"] == "lodeplan"
    assert send(app, "POST", "/v1/mcp", {"jsonrpc": "2.0", "method": "notifications/initialized"}, mcp_session_id=session)[0] == 202
    assert send(app, "POST", "/mcp", {"jsonrpc": "2.0", "id": 2, "method": "ping"}, mcp_session_id=session)[1]["result"] == {}
    assert send(app, "POST", "/mcp", {"jsonrpc": "2.0", "id": 2, "method": "ping"}, origin="https://evil.example")[0] == 403
    assert send(app, "OPTIONS", "/mcp", origin="http://localhost:3000")[0] == 204
    assert send(app, "GET", "/mcp")[0] == 405
    assert send(app, "DELETE", "/mcp", mcp_session_id=session)[0] == 204
    assert send(app, "POST", "/mcp", {"jsonrpc": "2.0", "id": 3, "method": "ping"}, mcp_session_id=session)[0] == 404


def test_sessions_are_their_keys(app):
    ping = {"jsonrpc": "2.0", "id": 2, "method": "ping"}
    session = send(app, "POST", "/mcp", {"jsonrpc": "2.0", "id": 1, "method": "initialize"})[2]["Mcp-Session-Id"]
    for method, body in (("POST", ping), ("DELETE", None)):
        assert send(app, method, "/mcp", body, key="ro", mcp_session_id=session)[0] == 404
        assert send(app, method, "/mcp", body, key="nobody", mcp_session_id=session)[0] == 403
    assert send(app, "POST", "/mcp", ping, mcp_session_id=session)[0] == 200


def test_protocol_versions(app):
    ping = {"jsonrpc": "2.0", "id": 2, "method": "ping"}
    assert send(app, "POST", "/mcp", ping, mcp_protocol_version="2025-06-18")[0] == 200
    assert send(app, "POST", "/mcp", ping, mcp_protocol_version="1999-01-01")[0] == 400


def test_answers_as_events(app):
    ask = {"jsonrpc": "2.0", "id": 1, "method": "tools/list"}
    status, out, _ = send(app, "POST", "/mcp", ask, accept="application/json, text/event-stream;q=0.9")
    event, data = out.encoded().decode().strip().split("\n")
    assert status == 200 and event == "event: message" and len(json.loads(data.removeprefix("data: "))["result"]["tools"]) == 14
    assert isinstance(send(app, "POST", "/mcp", ask, accept="application/json")[1], dict)
    assert send(app, "POST", "/mcp", {"jsonrpc": "2.0", "id": 7, "result": {}}, accept="text/event-stream")[:2] == (202, None)
    assert send(app, "GET", "/mcp", accept="text/event-stream", key="none")[0] == 403
    health = send(app, "GET", "/healthz", key="none")[1]
    assert health["status"] == "ok" and health["version"] and health["natural_language"]


def test_an_event_stream_lasts_until_the_server_stops(engine):
    http = server(App(engine, Keyring([Key("rw", "acme")])), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    request = urllib.request.Request(f"http://127.0.0.1:{http.server_port}/mcp", headers={"Authorization": "Bearer rw", "Accept": "text/event-stream"})
    with urllib.request.urlopen(request, timeout=30) as answer:
        assert answer.status == 200 and answer.headers["Content-Type"] == "text/event-stream"
        began = time.monotonic()
        threading.Timer(0.5, http.shutdown).start()
        assert answer.read() == b"" and 0.3 < time.monotonic() - began < 10
    http.server_close()


def test_sessions_end():
    now = [0.0]
    sessions = Sessions(lambda: now[0])
    a = sessions.create()
    now[0] = 3000
    assert sessions.known(a)
    now[0] = 6599
    assert sessions.known(a)
    now[0] = 10_300
    assert not sessions.known(a) and not sessions.known(None)


def test_a_real_socket(app):
    http = server(app, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/v1/tools") as answer:
            assert len(json.load(answer)["tools"]) == 14
    finally:
        http.shutdown()
        http.server_close()


def test_keys():
    assert Key.from_json({"key": "x"}).scopes == {"database:read", "schema:read"}
    with pytest.raises(EngineError):
        Key.from_json({"key": "x", "scopes": ["all"]})
    with pytest.raises(EngineError):
        Keyring([]).session()
    assert Keyring([Key("a", "t")]).session().tenant == "t"
