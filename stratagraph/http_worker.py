"""Control plane: jobs over HTTP. The engine does not depend on it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .plans.pipeline import VERSION
from .worker import JobRequest

RUN, HEALTH = "/api/index-jobs/run", "/health"


def _error(code: str, said: str | None, job: str | None = None, /, **details) -> dict:
    """An error's body; fields and details without a value are left out."""
    kept = {k: v for k, v in details.items() if v is not None}
    out = {"code": code, "message": said, "generatedAt": datetime.now(timezone.utc).isoformat(), "jobId": job, "details": kept}
    return {k: v for k, v in out.items() if v is not None}


def _failure(error: BaseException) -> dict:
    root = error
    while root.__cause__ is not None:
        root = root.__cause__
    out = {"exceptionType": type(error).__name__, "message": str(error)[:500]}
    return out if root is error else out | {"rootCauseType": type(root).__name__, "rootCauseMessage": str(root)[:500]}


#: Errors that are the request's own fault.
INVALID = ("ValueError", "JSONDecodeError", "NotADirectoryError", "FileNotFoundError")


def answer(method: str, path: str, body: str, run: Callable[[JobRequest], dict]) -> tuple[int, dict]:
    """(status, reply): 400 for a request that cannot be run, 500 for a malformed one or a failed job."""
    if path == HEALTH:
        return (200, {"status": "UP", "version": VERSION}) if method == "GET" else (405, _error("method_not_allowed", "only GET is supported here", allowedMethod="GET"))
    if path != RUN:
        return 404, _error("not_found", f"nothing is at {path}")
    if method != "POST":
        return 405, _error("method_not_allowed", "only POST is supported here", allowedMethod="POST")
    clock, request = time.perf_counter(), None
    elapsed = lambda: int(1000 * (time.perf_counter() - clock))
    asked = lambda: {} if request is None else {k: v for k, v in asdict(request).items() if k != "jobId"}
    try:
        request = JobRequest.read(body)
    except (ValueError, TypeError) as error:
        return 500, _error("job_failed", "the request cannot be read", **_failure(error), elapsedMs=elapsed())
    try:
        result = run(request)
    except ValueError as error:
        return 400, _error("invalid_request", str(error), request.jobId, **_failure(error), **asked(), elapsedMs=elapsed())
    except Exception as error:
        return 500, _error("job_failed", "the job failed", request.jobId, **_failure(error), **asked(), elapsedMs=elapsed())
    if result["status"] == "SUCCESS":
        return 200, {k: v for k, v in result.items() if v is not None}
    told = result.get("summary") or {}
    details = {"exceptionType": told.get("error"), "message": told.get("message"), "rootCauseType": told.get("rootCauseType"), "rootCauseMessage": told.get("rootCause")}
    if told.get("error") in INVALID:
        return 400, _error("invalid_request", told.get("message"), result.get("jobId"), **details, **asked(), elapsedMs=elapsed())
    return 500, _error("job_failed", "the job failed", result.get("jobId"), **details, **asked(), elapsedMs=elapsed())


def serve(port: int, run: Callable[[JobRequest], dict]) -> ThreadingHTTPServer:
    """A server that is bound but not yet running; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            status, reply = answer(self.command, self.path, body, run)
            raw = json.dumps(reply, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json;charset=UTF-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_DELETE = _do

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
