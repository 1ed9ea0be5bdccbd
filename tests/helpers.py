import datetime as dt
import json

from postflow import schema

AS_OF = dt.datetime(2026, 1, 1)


def payloads(spark, rows):
    """rows: (source_ord, type, token, body) -> payload table (payload_ord 0)."""
    return spark.createDataFrame(
        [(o, 0, t, tok, AS_OF, body if isinstance(body, str) or body is None else json.dumps(body))
         for o, t, tok, body in rows], schema.PAYLOADS)


def sources(spark, rows):
    """rows: (source_ord, type, token, title, location, title_contains)."""
    return spark.createDataFrame(rows, schema.SOURCES)


def incoming(spark, rows):
    """rows: dicts with some incoming fields; the rest default."""
    out = []
    for i, r in enumerate(rows):
        base = {"source_ord": 0, "payload_ord": 0, "entry_ord": i, "source": "seek", "title": "t",
                "company": "c", "location": "l", "description": "d", "url": f"https://x/{i}"}
        base.update(r)
        if "job_board_id" not in r:
            import hashlib
            base["job_board_id"] = f"{base['source']}-" + hashlib.sha1((base["url"] or "").encode()).hexdigest()[:10]
        out.append(tuple(base[c] for c in schema.INCOMING_COLUMNS))
    return spark.createDataFrame(out, schema.INCOMING)


def postings(spark, rows):
    """rows: dicts with posting fields; the rest default."""
    out = []
    for i, r in enumerate(rows):
        base = {c: None for c in schema.POSTING_COLUMNS}
        base.update({"id": i + 1, "job_board_id": f"seek-{i:010d}", "title": f"t{i}", "company": "c",
                     "location": "l", "description": "d", "url": f"https://x/{i}", "date_scraped": AS_OF,
                     "status": "To Apply", "source": "seek"})
        base.update(r)
        out.append(tuple(base[c] for c in schema.POSTING_COLUMNS))
    return spark.createDataFrame(out, schema.POSTINGS)
