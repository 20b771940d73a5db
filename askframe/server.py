"""A small HTTP front for a Composer, for trying requests: JSON in, JSON out, one session store, local by default.

GET /schema; POST /ask {"request", "previous"?}; POST /answer {"id", "option"}; POST /run {"result"}. A result's id is in each reply.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock

from .language.composer import Composer, Result
from .operators.analyze import PlanError

#: Results that are remembered, and bytes of a request that are read.
KEPT, MOST_BYTES = 1000, 1 << 20


class Desk:
    """What the HTTP handler does, without HTTP."""

    def __init__(self, composer: Composer):
        self.composer, self.results, self.lock = composer, OrderedDict(), Lock()

    def schema(self) -> dict:
        return {t.name: {"key": list(t.pk), "columns": {c.name: c.role for c in t.columns.values() if not c.hidden}} for t in self.composer.model.tables.values() if not t.hidden}

    def _kept(self, r: Result) -> dict:
        id_ = uuid.uuid4().hex[:12]
        self.results[id_] = r
        while len(self.results) > KEPT:
            self.results.popitem(last=False)
        asked = {"id": r.clarification.id, "question": r.clarification.question, "options": r.clarification.options} if r.clarification else None
        return {"result": id_, "outcome": r.outcome, "narrative": r.narrative, "confidence": r.confidence, "reason": r.reason, "warnings": r.warnings, "clarification": asked}

    def handle(self, path: str, body: dict) -> dict:
        with self.lock:
            match path:
                case "/ask":
                    return self._kept(self.composer.compose(body["request"], self.results[body["previous"]] if body.get("previous") else None))
                case "/answer":
                    return self._kept(self.composer.answer(body["id"], body["option"]))
                case "/run":
                    rows = self.composer.execute(self.results[body["result"]])
                    return {"columns": list(rows[0].__fields__) if rows else [], "rows": [list(r) for r in rows]}
        raise LookupError(path)


def serve(composer: Composer, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is not yet running: call serve_forever()."""
    desk = Desk(composer)

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, code: int, body: dict) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._reply(*((200, desk.schema()) if self.path == "/schema" else (404, {"error": "no such page"})))

        def do_POST(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > MOST_BYTES:
                    return self._reply(413, {"error": "too long"})
                self._reply(200, desk.handle(self.path, json.loads(self.rfile.read(size) or b"{}")))
            except PlanError as e:
                self._reply(422, {"error": str(e)})
            except (LookupError, TypeError, ValueError) as e:
                self._reply(400, {"error": f"{type(e).__name__}: {e}"})

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
