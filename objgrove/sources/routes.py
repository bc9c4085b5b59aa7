"""Requests by method, path and headers to a store's answers: a pure function, for any HTTP server to call."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import functions as F

from objgrove import instrument
from objgrove.sources import wire

ADVERTISED, UPLOAD, RECEIVE = "info/refs", "git-upload-pack", "git-receive-pack"


def target(path: str) -> tuple[str, str] | None:
    """(repository, service) of a path; a repository's name may have slashes, and is not empty."""
    for service in (ADVERTISED, UPLOAD, RECEIVE):
        if path.endswith("/" + service):
            repo = path[1 : -len(service) - 1]
            return (repo, service) if repo else None
    return None


def answer(store, method: str, path: str, headers: Mapping[str, str] | None = None, query: Mapping[str, str] | None = None, body: bytes = b"", now=None) -> tuple[int, str, bytes]:
    """(status, content type, body). What a client got wrong is 400 with the reason; anything else that fails is 500."""
    headers = {k.lower(): v for k, v in (headers or {}).items()}
    try:
        with instrument.phase("request"):
            out = _answer(store, method, path, headers, query or {}, body, now)
    except wire.ProtocolError as e:
        return 400, "text/plain", str(e).encode()
    except Exception as e:
        print(f"{method} {path}: {e}")
        return 500, "text/plain", b"internal server error"
    instrument.count("wire_bytes", len(out[2]))
    return out


def _answer(store, method, path, headers, query, body, now) -> tuple[int, str, bytes]:
    if (method, path) == ("GET", "/health"):
        return 200, "text/plain", b"ok"
    found, missing = target(path), (404, "text/plain", b"404 Not Found")
    if found is None:
        return missing
    repo, service = found
    if method == "GET" and service == ADVERTISED:
        asked = query.get("service")
        if asked == UPLOAD:
            if "version=2" not in [x.strip() for x in headers.get("git-protocol", "").split(":")]:
                raise wire.ProtocolError("only protocol version 2 is served; set protocol.version=2")
            return 200, f"application/x-{UPLOAD}-advertisement", wire.capability_advertisement()
        if asked == RECEIVE:
            refs = [(r["oid"], r["name"]) for r in store.of(store.repo_id(repo))["git_ref"].where("oid is not null").orderBy("name").collect()]
            return 200, f"application/x-{RECEIVE}-advertisement", wire.line(f"# service={RECEIVE}\n") + wire.FLUSH + wire.receive_advertisement(refs)
        return 403, "text/plain", f"unsupported service {json.dumps(asked)}".encode()
    if method == "POST" and service in (UPLOAD, RECEIVE):
        data = wire.request_body(body, headers.get("content-encoding"))
        out = store.fetch(repo, data) if service == UPLOAD else store.push(repo, data, F.current_timestamp() if now is None else now)
        return 200, f"application/x-{service}-result", out
    return missing
