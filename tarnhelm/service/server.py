"""Query service: one SQL endpoint and five single-operator endpoints over sealed tables.

Answers are ``{"code", "msg", "data"}``.  Bodies may be JSON, forms or multipart forms.  Every
request carries a token, opened once; its budget pays for the operators.  ``/query`` takes
queries only: commands, unknown tables and functions that reach outside are refused before
anything runs, and each request has a session of its own, which leaves no view or setting behind.
Texts of the other endpoints are single expressions and pass the same test.

An answer holds every row of its result.  Over HTTP the rows pass through a temporary file, a
partition at a time, so the service's memory doesn't follow their number, and a result that
fails half way is an error.  With ``max_rows`` a larger result is refused (413), never cut.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import shutil
import tempfile
import threading
from collections.abc import Callable, Iterator
from email import message_from_bytes
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.operators import relational as R
from tarnhelm.plans.policy import GovernedFrame, KeyRegistry, PolicyContext, PolicyError, governed_sql
from tarnhelm.plans.sqlguard import QueryRefused, check
from tarnhelm.sources.sealed import read_sealed


class ApiError(Exception):
    """A request that can't be served; ``code`` goes into the envelope."""

    def __init__(self, code: int, msg: str):
        super().__init__(msg)
        self.code = code


def _plain(x):
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    if isinstance(x, decimal.Decimal):
        return str(x)
    return x.hex() if isinstance(x, (bytes, bytearray)) else str(x)


def _multipart(kind: str, raw: bytes) -> dict[str, str]:
    """The fields of a multipart form."""
    form = message_from_bytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + raw)
    if not form.is_multipart():
        raise ValueError("no parts")
    return {p.get_param("name", header="content-disposition"): p.get_payload(decode=True).decode() for p in form.get_payload()}


class QueryService:
    """``tables`` maps a name to the path of its sealed table."""

    def __init__(self, spark: SparkSession, registry: KeyRegistry, tables: dict[str, str], max_rows: int | None = None):
        self.spark, self.registry, self.max_rows = spark, registry, max_rows
        self.tables = {k.lower(): v for k, v in tables.items()}
        self._lock = threading.Lock()
        self._routes = {
            "/query": (self._query, ("st",)), "/filter": (self._filter, ("t", "st")), "/selector": (self._selector, ("t", "st")),
            "/sorter": (self._sorter, ("t", "st")), "/joiner": (self._joiner, ("t1", "t2", "st")),
            "/aggregator": (self._aggregator, ("t", "group_col", "agg_col", "func")),
        }

    def handle(self, path: str, params: dict, keep: Callable[[Iterator[dict]], object] = list) -> dict:
        """The envelope; ``keep`` makes its ``rows`` from a stream of all of them."""
        try:
            if path == "/":
                return {"code": 200, "msg": "ok", "data": {k: list(v[1]) + ["tk"] for k, v in self._routes.items()}}
            if path not in self._routes:
                raise ApiError(404, f"no endpoint {path}")
            frame = self.frame(path, params)
            policy = frame.policy
            df, trace = frame.prepare_result()
            return {"code": 200, "msg": "ok", "data": {"rows": keep(self._rows(df)), "budget": policy.budget, "trace": trace.rows()}}
        except ApiError as e:
            return {"code": e.code, "msg": str(e), "data": None}
        except QueryRefused as e:
            return {"code": 400, "msg": str(e), "data": None}
        except PolicyError as e:
            return {"code": 403, "msg": str(e), "data": None}
        except Exception as e:  # the engine's own message is the answer
            return {"code": 500, "msg": f"{type(e).__name__}: {str(e)[:500]}", "data": None}

    def frame(self, path: str, params: dict) -> GovernedFrame:
        """The governed frame that answers a request; nothing is computed yet."""
        run, needed = self._routes[path]
        if missing := [p for p in (*needed, "tk") if not params.get(p)]:
            raise ApiError(400, f"missing: {', '.join(missing)}")
        with self._lock:
            policy = self.registry.open(params["tk"])
            return run(policy, params, self.spark.newSession())

    def _rows(self, df: DataFrame) -> Iterator[dict]:
        for n, r in enumerate(df.toLocalIterator(prefetchPartitions=True), 1):
            if self.max_rows is not None and n > self.max_rows:
                raise ApiError(413, f"the result has more than {self.max_rows} rows")
            yield r.asDict(recursive=True)

    def _path(self, name: str) -> str:
        if name.lower() not in self.tables:
            raise ApiError(404, f"no table {name}")
        return self.tables[name.lower()]

    def _scan(self, policy: PolicyContext, name: str, session: SparkSession, *texts: str) -> GovernedFrame:
        """A table under the policy; ``texts`` are expressions about to be used on it."""
        path = self._path(name)
        for text in texts:
            if check(session, f"SELECT {text} FROM t") != {"t"}:
                raise QueryRefused("an expression reads no table")
        return policy.scan(session, path, name.lower())

    def _query(self, policy, p, session):
        names = sorted(check(session, p["st"]))
        frames = {n: read_sealed(session, self._path(n), policy.key, n) for n in names}
        return governed_sql(session, policy, p["st"], frames)

    def _filter(self, policy, p, session):
        return self._scan(policy, p["t"], session, p["st"]).filter(p["st"])

    def _selector(self, policy, p, session):
        return self._scan(policy, p["t"], session, p["st"]).select(*[c.strip() for c in p["st"].split(",")])

    def _sorter(self, policy, p, session):
        down = str(p.get("asc", "True")).lower() == "false"
        return self._scan(policy, p["t"], session).sort(F.col(p["st"]).desc() if down else F.col(p["st"]).asc())

    def _joiner(self, policy, p, session):
        left, right = self._scan(policy, p["t1"], session), self._scan(policy, p["t2"], session)
        return left.join(right, p["st"], p.get("mode") or "inner")

    def _aggregator(self, policy, p, session):
        frame = self._scan(policy, p["t"], session)
        node = policy.charge("aggregate", frame.node)
        return GovernedFrame(R.aggregate_by_name(frame.df, p["group_col"], p["agg_col"], p["func"]), policy, node)


def serve(service: QueryService, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Start serving on a thread; returns the server (its ``server_address`` has the port)."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body: dict) -> None:
            self._send(body["code"], json.dumps(body, default=_plain).encode())

        def _send(self, code: int, *parts) -> None:
            """Parts are bytes or files."""
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(sum(len(x) if isinstance(x, bytes) else x.seek(0, 2) for x in parts)))
            self.end_headers()
            for x in parts:
                if isinstance(x, bytes):
                    self.wfile.write(x)
                else:
                    x.seek(0)
                    shutil.copyfileobj(x, self.wfile)

        def _run(self, params: dict) -> None:
            with tempfile.TemporaryFile() as held:

                def keep(rows: Iterator[dict]) -> list:
                    for i, r in enumerate(rows):
                        held.write((", " if i else "").encode() + json.dumps(r, default=_plain).encode())
                    return []

                body = service.handle(self.path, params, keep)
                data = body["data"]
                if body["code"] != 200 or "rows" not in data:
                    return self._answer(body)
                rest = json.dumps({k: v for k, v in data.items() if k != "rows"}, default=_plain).encode()
                self._send(200, b'{"code": 200, "msg": %s, "data": {"rows": [' % json.dumps(body["msg"]).encode(), held, b"], " + rest[1:] + b"}")

        def do_GET(self):
            self._answer(service.handle(self.path, {}) if self.path == "/" else {"code": 405, "msg": "POST only", "data": None})

        def do_POST(self):
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            kind = self.headers.get_content_type()
            try:
                if kind == "application/json":
                    params = json.loads(raw or b"{}")
                elif kind == "multipart/form-data":
                    params = _multipart(self.headers["Content-Type"], raw)
                else:
                    params = dict(parse_qsl(raw.decode()))
            except ValueError:
                params = None
            self._run(params) if isinstance(params, dict) else self._answer({"code": 400, "msg": "the body can't be read", "data": None})

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
