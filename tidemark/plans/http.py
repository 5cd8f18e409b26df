"""The recommender over HTTP, by the standard library: the same routes and status codes for any client."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .serving import NotReady, OutOfRange, Recommender


def answer(service: Recommender, target: str) -> tuple[int, dict[str, object]]:
    """Status and body for the path and query of a GET request."""
    url = urlsplit(target)
    asked = {k: v[-1] for k, v in parse_qs(url.query).items()}
    try:
        if url.path == "/":
            return 200, {"routes": ["/health", "/recommend/{user_id}?k=", "/users/random?seed=", "/users/{user_id}/profile?n="]}
        if url.path == "/health":
            return 200, service.health()
        if url.path == "/users/random":
            return 200, {"user_id": service.sample_user(int(asked.get("seed", 0)))}
        if m := re.fullmatch(r"/recommend/(-?\d+)", url.path):
            return 200, service.recommend(int(m[1]), int(asked.get("k", 10)))
        if m := re.fullmatch(r"/users/(-?\d+)/profile", url.path):
            return 200, service.profile(int(m[1]), int(asked.get("n", 10)))
    except NotReady as error:
        return 503, {"error": str(error)}
    except (OutOfRange, ValueError) as error:
        return 422, {"error": str(error)}
    return 404, {"error": "no such route"}


def server(service: Recommender, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = answer(service, self.path)
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
