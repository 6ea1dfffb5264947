"""Views over HTTP as JSON, with the standard library's server."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from tidemark.plans import views
from tidemark.plans.store import Frames
from tidemark.sinks.export import records


class NotFound(Exception):
    """What a path names isn't there."""


def _some(rows: list[dict], what: str) -> list[dict]:
    if not rows:
        raise NotFound(f"no {what}")
    return rows


def _bundle(f: Frames, name: str, q: dict) -> list[dict]:
    if name not in views.BUNDLE:
        raise NotFound(f"no view {name!r}; there are {', '.join(views.BUNDLE)}")
    return records(views.build(f, name, q.get("period")))


def _nonaccruals(f: Frames, q: dict) -> dict:
    names = ("nonaccrual_trend", "nonaccrual_positions", "nonaccrual_by_industry", "nonaccrual_by_bdc")
    return {n.removeprefix("nonaccrual_"): records(views.build(f, n, q.get("period"))) for n in names}


def _quarterly(view):
    return lambda f, q: records(view(f, since=q.get("since", "2024-01-01")))


ROUTES = [
    (r"/api/bundle/meta", lambda f, q: records(views.export_meta(f, q.get("period")))[0]),
    (r"/api/bundle/positions/(?P<ticker>[^/]+)", lambda f, q, ticker: records(views.bdc_positions(f, q.get("period"), ticker))),
    (r"/api/bundle/(?P<name>\w+)", lambda f, q, name: _bundle(f, name, q)),
    (r"/api/overview", lambda f, q: records(views.overview(f, q.get("period")))[0]),
    (r"/api/periods", lambda f, q: [r["period_end"] for r in records(views.periods(f))]),
    (r"/api/bdcs", lambda f, q: records(views.bdc_summary(f, q.get("period")))),
    (r"/api/bdcs/(?P<ticker>[^/]+)/positions", lambda f, q, ticker: _some(records(views.bdc_positions(f, q.get("period"), ticker)), f"positions of {ticker}")),
    (r"/api/nonaccruals", _nonaccruals),
    (r"/api/marks/histogram", lambda f, q: records(views.mark_histogram(f, q.get("period"), float(q.get("bin_width", 2.5))))),
    (r"/api/marks/sectors", lambda f, q: records(views.sector_marks(f, quarters=int(q.get("quarters", 8))))),
    (r"/api/quarterly/marks", _quarterly(views.quarterly_bdc_marks)),
    (r"/api/quarterly/nonaccrual-marks", _quarterly(views.quarterly_nonaccrual_marks)),
    (r"/api/quarterly/nonaccrual-share", _quarterly(views.quarterly_nonaccrual_share)),
    (r"/api/maturities", lambda f, q: records(views.maturity_wall(f, q.get("period")))),
    (r"/api/markdowns", lambda f, q: records(views.biggest_markdowns(f, q.get("period"), int(q.get("limit", 100))))),
    (r"/api/deteriorating", lambda f, q: records(views.deteriorating(f, q.get("period"), int(q.get("limit", 100))))),
    (r"/api/disagreements", lambda f, q: records(views.disagreements(f, q.get("period"), max(2, int(q.get("min_holders", 2))), int(q.get("limit", 200))))),
    (r"/api/loans/(?P<key>[0-9a-f]+)", lambda f, q, key: _some(records(views.loan_history(f, loan_id=key)), "such loan")),
    (r"/api/issuers/(?P<key>[0-9a-f]+)", lambda f, q, key: _some(records(views.issuer_detail(f, issuer_id=key)), "such borrower")),
    (r"/api/search", lambda f, q: records(views.search_issuers(f, query=q.get("q", "")))),
]


def answer(f: Frames, target: str) -> tuple[int, object]:
    """(status, value) of a request's path and query."""
    parts = urlsplit(target)
    query = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    for pattern, route in ROUTES:
        if found := re.fullmatch(pattern, parts.path):
            try:
                return 200, route(f, query, **found.groupdict())
            except NotFound as e:
                return 404, {"detail": str(e)}
            except ValueError as e:
                return 422, {"detail": str(e)}
    return 404, {"detail": "no such path"}


def serve(f: Frames, host: str = "127.0.0.1", port: int = 8000) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, value = answer(f, self.path)
            body = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    ThreadingHTTPServer((host, port), Handler).serve_forever()
