"""A small HTTP front: postings become files that a stream reads, queries are answered from an engine.

    POST /obs                        lines of observations (form field ``data``, text/plain, octets, or no type)
    GET or POST /collation/<name>?q= the answer to a query, as text
    GET /collation/                  the names of the rollups

A posting is written to the landing folder under a name that is not read, and renamed when it is complete, so a stream
(``sources.observations.stream_lines``) sees whole postings only; the file's time is the time of receipt of all its
lines. Lines that do not parse become dead letters there; a posting is never half accepted here.
"""

from __future__ import annotations

import uuid
from email.message import Message
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from tallyweir.plans.dialect import QueryError, parse
from tallyweir.plans.engine import Engine, UnknownRollup
from tallyweir.plans.spec import SpecError
from tallyweir.sources.files import Files

PLAIN = ("text/plain", "application/octet-stream")
FORM = "application/x-www-form-urlencoded"


class Refused(Exception):
    def __init__(self, status: int, text: str) -> None:
        super().__init__(text)
        self.status, self.text = status, text


def media_type(header: str | None) -> str:
    """The type of a Content-Type header, '' without one; a header that is none is refused."""
    if header is None or not header.strip():
        return ""
    kind = header.split(";")[0].strip().lower()
    if kind.count("/") != 1 or not all(kind.split("/")) or any(c in kind for c in ' ",='):
        raise Refused(400, "malformed content type")
    message = Message()
    message["Content-Type"] = header
    return message.get_content_type()


def posting(header: str | None, body: bytes) -> bytes:
    """The lines of a posting."""
    kind = media_type(header)
    if kind == FORM:
        data = parse_qs(body.decode("utf-8", "replace"), keep_blank_values=True).get("data", [""])[0]
        if not data:
            raise Refused(400, "no data")
        return data.encode()
    if kind and kind not in PLAIN:
        raise Refused(415, f"unsupported content type {kind}")
    return body


def land(files: Files, folder: str, lines: bytes) -> str:
    """Writes a posting to the landing folder, on any file system that the cluster shares; returns the file's path."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.txt"
    files.write(path, lines)
    return path


def answer(engine: Engine, path: str, q: str | None) -> str:
    """The text for a path under /collation/."""
    name = path.removeprefix("/collation/")
    if not name:
        return "".join(f"{n}\n" for n in engine.names())
    if "/" in name:
        raise Refused(404, "not found")
    try:
        parse(q or "", engine.strict)
        return engine.answer(name, q or "")
    except QueryError as e:
        raise Refused(400, str(e)) from e
    except UnknownRollup as e:
        raise Refused(404, f"no rollup {name}") from e
    except SpecError as e:
        raise Refused(400, str(e)) from e


def server(engine: Engine, spark: SparkSession, folder: str, host: str = "127.0.0.1", port: int = 2525) -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``; port 0 takes a free one."""
    files = Files(spark)

    class Handler(BaseHTTPRequestHandler):
        def _body(self) -> bytes:
            return self.rfile.read(int(self.headers.get("Content-Length") or 0))

        def _reply(self, status: int, text: str) -> None:
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Cache-Control", "no-cache, no-store, must-revalidate")
            self.end_headers()
            self.wfile.write(data)

        def _handle(self) -> None:
            url, method = urlsplit(self.path), self.command
            try:
                body = self._body()
                if url.path == "/obs":
                    if method != "POST":
                        raise Refused(405, "method not allowed")
                    land(files, folder, posting(self.headers.get("Content-Type"), body))
                    self._reply(200, "")
                elif url.path.startswith("/collation/"):
                    if method not in ("GET", "POST"):
                        raise Refused(405, "method not allowed")
                    fields = parse_qs(url.query)
                    if method == "POST" and media_type(self.headers.get("Content-Type")) == FORM:
                        fields = parse_qs(body.decode("utf-8", "replace")) | fields
                    self._reply(200, answer(engine, url.path, fields.get("q", [None])[0]))
                else:
                    raise Refused(404, "not found")
            except Refused as e:
                self._reply(e.status, e.text + "\n")

        do_GET = do_POST = do_PUT = do_DELETE = do_HEAD = _handle

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
