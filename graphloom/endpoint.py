"""HTTP access: an endpoint over a session, and a client that SERVICE can use.

The endpoint answers GET and POST at any path, negotiates the result format,
describes itself where no query is given, and can pin queries to some graphs
and services by putting constraints before their prologue.
"""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from collections.abc import Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import GraphError, QueryFailed
from .terms import TERM_SQL, range_type
from .vocab import XSD

JSON, XML = "application/sparql-results+json", "application/sparql-results+xml"
TABLES = {JSON: "json", "application/json": "json", XML: "xml", "application/xml": "xml"}
DOCUMENTS = {"text/turtle": "turtle", "application/trig": "trig", "application/ld+json": "json-ld"}
_DESCRIPTION = """@prefix sd: <http://www.w3.org/ns/sparql-service-description#> . @prefix f: <http://www.w3.org/ns/formats/> .
[] a sd:Service ; sd:endpoint <{url}> ; sd:supportedLanguage sd:SPARQL11Query ; sd:feature sd:EmptyGraphs, sd:BasicFederatedQuery, sd:UnionDefaultGraph ;
 sd:resultFormat f:SPARQL_Results_JSON, f:SPARQL_Results_XML, f:Turtle, f:TriG, f:JSON-LD .
"""


def constrained(text: str, graphs: Iterable[str] | None, services: Iterable[str] | None) -> str:
    """The query behind constraints; an empty list allows nothing."""
    lines = []
    for kind, names in (("GRAPH", graphs), ("SERVICE", services)):
        if names is not None:
            lines.append(f"CONSTRAINT {kind} " + ", ".join(n if n in ("DEFAULT", "ALL") else f"<{n}>" for n in names or ["urn:none"]))
    return "\n".join([*lines, text])


def negotiated(accept: str, kinds: dict[str, str], default: str) -> str | None:
    """The media type with the largest weight among those offered."""
    wanted = []
    for k, part in enumerate(accept.split(",") if accept else []):
        name, *options = (x.strip() for x in part.split(";"))
        q = next((float(o[2:]) for o in options if o.startswith("q=")), 1.0)
        wanted.append((-q, k, name))
    for _, _, name in sorted(wanted):
        if name in kinds:
            return name
        if name in ("*/*", default.split("/")[0] + "/*"):
            return default
    return None if wanted else default


class Endpoint:
    """Serves ``session`` until :meth:`close`; ``url`` says where."""

    def __init__(self, session, host: str = "127.0.0.1", port: int = 0, graphs: Iterable[str] | None = None, services: Iterable[str] | None = None):
        self.session, self.graphs, self.services = session, graphs, services
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args) -> None:
                pass

            def do_GET(self) -> None:
                self.respond(parse_qs(urlsplit(self.path).query).get("query", [None])[0])

            def do_POST(self) -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
                kind = (self.headers.get("Content-Type") or "").split(";")[0].strip()
                if kind not in ("application/sparql-query", "application/x-www-form-urlencoded"):
                    self.send(415, "text/plain", "a query or a form is wanted")
                else:
                    self.respond(body if kind == "application/sparql-query" else parse_qs(body).get("query", [None])[0])

            def respond(self, text: str | None) -> None:
                try:
                    self.send(*outer.answer(text, self.headers.get("Accept") or ""))
                except GraphError as e:
                    self.send(400, "text/plain", f"{type(e).__name__}: {e}")
                except Exception as e:
                    self.send(500, "text/plain", type(e).__name__)

            def send(self, code: int, kind: str, body: str) -> None:
                data = body.encode()
                self.send_response(code)
                self.send_header("Content-Type", f"{kind}; charset=utf-8")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.url = f"http://{host}:{self.server.server_address[1]}/sparql/"
        self.thread = threading.Thread(target=self.server.serve_forever, daemon=True)
        self.thread.start()

    def answer(self, text: str | None, accept: str) -> tuple[int, str, str]:
        if text is None:
            return 200, "text/turtle", _DESCRIPTION.format(url=self.url)
        text = constrained(text, self.graphs, self.services)
        graph = self.session.parse(text).form in ("construct", "describe")
        kinds, default = (DOCUMENTS, "text/turtle") if graph else (TABLES, JSON)
        kind = negotiated(accept, kinds, default)
        if kind is None:
            return 406, "text/plain", "none of the wanted formats is offered"
        return 200, kind, self.session.serialize(text, kinds[kind])

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
        self.thread.join()


class Remote:
    """Client of an endpoint. Results come whole through the driver, as a document does."""

    def __init__(self, url: str, timeout: float = 60):
        self.url, self.timeout = url, timeout

    def document(self, text: str, accept: str = JSON) -> str:
        request = urllib.request.Request(self.url, urlencode({"query": text}).encode(), {"Accept": accept, "Content-Type": "application/x-www-form-urlencoded"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return r.read().decode()
        except urllib.error.HTTPError as e:
            raise QueryFailed(f"{self.url}: {e.code} {e.read().decode('utf-8', 'replace')[:300]}") from None
        except OSError as e:
            raise QueryFailed(f"{self.url}: {e}") from None

    def query(self, spark: SparkSession, text: str) -> DataFrame:
        """A table of lexical forms."""
        from .sources.results import from_json

        return from_json(spark, self.document(text))

    def terms(self, spark: SparkSession, text: str) -> DataFrame:
        """A table of term structs, unbound cells null."""
        try:
            doc = json.loads(self.document(text))
            names, rows = doc["head"]["vars"], doc["results"]["bindings"]
        except (ValueError, KeyError, TypeError) as e:
            raise QueryFailed(f"{self.url}: no result document: {e}") from None

        def term(b: dict) -> tuple:
            if b["type"] in ("uri", "bnode"):
                return "iri", b["value"], None
            if "xml:lang" in b:
                return "lang", b["value"], b["xml:lang"].lower()
            kind = range_type(b.get("datatype") or XSD + "string").kind
            return ("string" if kind == "iri" else kind), b["value"], None

        data = [tuple(term(r[n]) if n in r else None for n in names) for r in rows]
        if not names:
            return spark.range(1).select(F.lit(1).alias("unit")) if rows else spark.range(0).select(F.lit(1).alias("unit"))
        return spark.createDataFrame(data, ", ".join(f"`{n}` {TERM_SQL}" for n in names))
