"""A local review server: frames by place, images, and corrections appended to a log. Corrections change no counts."""

from __future__ import annotations

import json
import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from framewright.operators.review import KINDS, checked, page
from framewright.schemas import REVIEW
from framewright.sources.readers import index_lookup

LARGEST = 1_000_000


def accepted(spark: SparkSession, body: str, known: DataFrame) -> tuple[str | None, Row | None]:
    """What is wrong with a review (a JSON text), by the rule of review.checked(), and the record with its counts."""
    found = spark.createDataFrame([(body,)], "body string").select(F.from_json("body", REVIEW).alias("r")).where("r is not null").select("r.*")
    rows = checked(found, known.select("frame_id")).collect()
    return (rows[0].problem, rows[0]) if rows else ("no record", None)


def serve(spark: SparkSession, workspace: str, port: int, forever: bool = True) -> ThreadingHTTPServer:
    """Serves on the local machine only. Pages and frames are point queries on the indexes that prepare wrote, so that
    nothing of the inventory is held here; corrections, which people make, are."""
    pages, frames, records = (f"{workspace}/data/{x}" for x in ("pages", "frames_index", "index"))
    log, lock = Path(workspace) / "review/corrections.jsonl", threading.Lock()
    reviews = {r["frame_id"]: r for r in map(json.loads, log.read_text(encoding="utf-8").splitlines())} if log.exists() else {}

    def one(path: str, frame_id: str) -> dict | None:
        found = index_lookup(spark, path, "frame_id", frame_id).limit(1).toJSON().collect() if Path(path).exists() else []
        return json.loads(found[0]) if found else None

    class Handler(BaseHTTPRequestHandler):
        def reply(self, body: object, status: int = 200, kind: str = "application/json; charset=utf-8") -> None:
            data = body if isinstance(body, bytes) else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            for k, v in (("Content-Type", kind), ("Content-Length", str(len(data))), ("Cache-Control", "no-store"), ("X-Content-Type-Options", "nosniff")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            if url.path == "/":
                return self.reply(b"<!doctype html><title>Review</title><p>GET /api/frame?group=&amp;index=, GET /image?frame_id=, POST /api/review", kind="text/html; charset=utf-8")
            if url.path == "/api/frame":
                number = q.get("index", "0")
                found = page(spark, pages, q.get("group", ""), int(number)).toJSON().collect() if number.lstrip("-").isdigit() else []
                if not found:
                    return self.reply({"error": "no such group or place"}, 400)
                row = json.loads(found[0])
                at, total = row.pop("place"), row.pop("total")
                return self.reply({"row": row, "index": at, "total": total, "record": one(records, row["frame_id"]), "review": reviews.get(row["frame_id"])})
            if url.path == "/image" and (row := one(frames, q.get("frame_id", ""))):
                path = Path(urlparse(row["source_path"]).path)
                return self.reply(path.read_bytes(), kind="application/octet-stream") if path.exists() else self.reply({"error": "the image can't be read"}, 404)
            return self.reply({"error": "not found"}, 404)

        def do_POST(self) -> None:
            origin = self.headers.get("Origin")
            if origin and origin not in {f"http://{h}:{self.server.server_port}" for h in ("127.0.0.1", "localhost")}:
                return self.reply({"error": "only the local page may save"}, 403)
            if self.path != "/api/review":
                return self.reply({"error": "not found"}, 404)
            size = int(self.headers.get("Content-Length") or 0)
            if not 0 < size < LARGEST:
                return self.reply({"error": "size of the request"}, 400)
            body = self.rfile.read(size).decode("utf-8", "replace")
            try:
                record = json.loads(body)
            except ValueError:
                return self.reply({"error": "no JSON"}, 400)
            row = one(frames, str(record.get("frame_id"))) if isinstance(record, dict) else None
            wrong, judged = accepted(spark, body, spark.createDataFrame([(row["frame_id"],)] if row else [], "frame_id string")) if isinstance(record, dict) else ("no record", None)
            if wrong:
                return self.reply({"error": wrong}, 400)
            record |= {"saved_at": datetime.now(UTC).isoformat(), "source_path": row["source_path"], "source_sha256": row["source_sha256"]}
            record |= {f"{k}_count": judged[f"{k}_count"] for k in KINDS}
            with lock:
                log.parent.mkdir(parents=True, exist_ok=True)
                with log.open("a", encoding="utf-8") as f:
                    f.write(json.dumps(record, ensure_ascii=False) + "\n")
                reviews[record["frame_id"]] = record
            return self.reply({"saved": True})

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    if forever:
        server.serve_forever()
    return server
