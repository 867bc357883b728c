"""The query surface over HTTP, as JSON, with the standard library's server.

Answers are whole: rows are sent as Spark hands them over, partition by
partition, and no frame is held or cut.  What a client posts (a document read, a
correction) makes a new landscape that later answers come from; ``on_change``
gets the changed table, to store it.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.api import Landscape, NotFound
from graphloom.session import cut


def answer(land: Landscape, path: str, query: dict[str, str]) -> dict[str, DataFrame] | DataFrame:
    """The frames of one route; KeyError for an unknown one."""
    parts = [unquote(p) for p in path.strip("/").split("/")]
    if parts[:1] != ["api"] or len(parts) < 2:
        raise KeyError(path)
    number = {k: int(v) for k, v in query.items() if k in ("limit", "days", "months")}
    match parts[1:]:
        case ["graph"]:
            kinds = {"max_nodes": int, "min_weight": int, "min_mentions": int, "min_confidence": float, "min_strength": float, "relations_only": lambda v: v in ("1", "true")}
            if not 1 <= int(query.get("max_nodes", 90)) <= 400:
                raise ValueError("max_nodes: 1 to 400")
            options = {{"type": "node_type"}.get(k, k): kinds.get(k, str)(v) for k, v in query.items()}
            nodes, edges = land.graph(**options)
            return {"nodes": nodes, "edges": edges}
        case ["search"]:
            return land.search(query["q"], number.get("limit", 20))
        case ["path"]:
            return land.path(query["from"], query["to"])
        case ["node", node]:
            return land.node(int(node))
        case ["node", node, "documents"]:
            return land.node_documents(int(node), number.get("limit", 50))
        case ["node", node, "adjacent"]:
            return land.adjacent(int(node), number.get("limit", 6))
        case ["document", content_hash]:
            return land.document(content_hash)
        case ["recent"]:
            return land.recent(query.get("since"), number.get("days", 7))
        case ["briefing"]:
            return land.briefing(number.get("days", 7), query.get("subfield"))
        case ["briefing", "narrative"] | ["hype"]:
            return land.narrative_inputs()
        case [("pulse" | "spikes" | "trajectory" | "history") as name]:
            return getattr(land, name)(*number.values())
        case [("tours" | "types" | "overview" | "trends" | "capabilities") as name]:
            return getattr(land, name)()
    raise KeyError(path)


def change(land: Landscape, path: str, sent: dict) -> tuple[Landscape, str]:
    """The landscape after one posted change, and the name of the table that changed; KeyError for an unknown route."""
    if path.strip("/") == "api/document/mark-read":
        hashes = sent["content_hash"] if isinstance(sent["content_hash"], list) else [sent["content_hash"]]
        spark = land.documents.sparkSession
        asked = spark.createDataFrame([(str(h),) for h in hashes], "content_hash string")
        absent = asked.join(land.documents, "content_hash", "left_anti").first()
        if absent:
            raise NotFound(absent["content_hash"])
        marked = cut(land.mark_read(asked, sent.get("at") or datetime.now(timezone.utc).isoformat(timespec="seconds")))
        return replace(land, tables={**land.tables, "documents": marked}), "documents"
    if path.strip("/") == "api/correct":
        corrections = cut(land.correct(sent["action"], sent["surface"], sent.get("canonical")))
        return land.resolved(corrections, land.tables.get("trusted")), "corrections"
    raise KeyError(path)


def body(found: dict[str, DataFrame] | DataFrame) -> Iterator[str]:
    """The JSON text of an answer, in pieces."""
    frames = found if isinstance(found, dict) else {"rows": found}
    for i, (name, df) in enumerate(frames.items()):
        yield ("," if i else "{") + json.dumps(name) + ":["
        for k, row in enumerate(df.select(F.to_json(F.struct("*")).alias("json")).toLocalIterator()):
            yield ("," if k else "") + row["json"]
        yield "]"
    yield "}" if frames else "{}"


def server(land: Landscape, port: int = 8000, host: str = "127.0.0.1", on_change: Callable[[str, DataFrame], None] | None = None) -> ThreadingHTTPServer:
    """A server of the landscape; one change at a time, answers meanwhile come from the landscape before it."""
    now, changing = [land], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802  the name the server looks for
            url = urlsplit(self.path)
            self.reply(lambda: body(answer(now[0], url.path, {k: v[-1] for k, v in parse_qs(url.query).items()})))

        def do_POST(self) -> None:  # noqa: N802
            def changed() -> Iterator[str]:
                sent = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if not isinstance(sent, dict):
                    raise TypeError("an object is expected")
                with changing:
                    after, name = change(now[0], urlsplit(self.path).path, sent)
                    if on_change:
                        on_change(name, after.tables[name])
                    now[0] = after
                return iter([json.dumps({"ok": True, "changed": name})])

            self.reply(changed)

        def reply(self, made: Callable[[], Iterator[str]]) -> None:
            try:
                pieces = made()
                status, first = 200, next(pieces)
            except (NotFound, KeyError) as e:
                status, first, pieces = 404, json.dumps({"detail": str(e)}), iter(())
            except (ValueError, TypeError) as e:
                status, first, pieces = 422, json.dumps({"detail": str(e)}), iter(())
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.end_headers()
            self.wfile.write(first.encode())
            for piece in pieces:
                self.wfile.write(piece.encode())

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
