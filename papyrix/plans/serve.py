"""The exported timeline over HTTP, on the loopback interface only."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


def handler(json_path: str, html_path: str, hosts: set[str]):
    pages = {"/api/writing.json": (json_path, "application/json"), "/": (html_path, "text/html; charset=utf-8")}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            name = (self.headers.get("Host") or "").rsplit(":", 1)[0]
            if name not in hosts:
                return self.send_error(403)
            if self.path not in pages:
                return self.send_error(404)
            path, kind = pages[self.path]
            with open(path, "rb") as f:
                body = f.read()
            self.send_response(200)
            for k, v in (("Content-Type", kind), ("Content-Length", str(len(body))), ("Content-Security-Policy", "default-src 'self'; style-src 'self' 'unsafe-inline'")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    return Handler


def server(json_path: str, html_path: str, port: int = 0) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(json_path, html_path, {"127.0.0.1", "localhost"}))
