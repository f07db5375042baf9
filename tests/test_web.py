"""Pages from a server on this machine that stands for public hosts: redirects, refusals, caps, batches and streams."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import local_web
import pytest

from strataq.sources import fetch, loaders
from strataq.streaming.operators import by_batch

ASKED: list[tuple[str, str]] = []


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        ASKED.append((self.headers["Host"], self.path))
        kind, body, to, code = "text/html; charset=utf-8", f"<html><head><title>Page {self.path}</title></head><body><p>Hello from {self.headers['Host']}</p></body></html>".encode(), None, 200
        if self.path.startswith("/to?"):
            code, to = 302, self.path[4:]
        elif self.path == "/lost":
            code = 301
        elif self.path == "/gone":
            code = 404
        elif self.path == "/note.md":
            kind, body = "text/markdown", b"# Note\n\nText."
        elif self.path == "/plain.txt":
            kind, body = "", b"just text"
        elif self.path == "/loop":
            code, to = 307, "/loop"
        elif self.path == "/large":
            body = b"x" * 5000
        self.send_response(code)
        if to:
            self.send_header("Location", to)
        if kind:
            self.send_header("Content-Type", kind)
        if self.path in ("/endless", "/slow"):  # no length is said
            self.end_headers()
            try:
                for _ in range(100):
                    self.wfile.write(b"y" * 100)
                    time.sleep(0.05 if self.path == "/slow" else 0)
            except OSError:
                pass
            return
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def web():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with open(local_web.PORT_FILE, "w") as f:
        json.dump({"port": server.server_address[1]}, f)
    yield local_web.LocalWeb()
    server.shutdown()
    os.remove(local_web.PORT_FILE)


LIMITS = fetch.FetchLimits(bytes=2000, seconds=3)


def test_a_page_and_its_redirects(web):
    assert fetch.fetch("http://site.test/a?b=1#c", LIMITS, web).content.startswith(b"<html>")
    page = fetch.fetch("http://site.test/to?http://other.test/note.md", LIMITS, web)
    assert (page.final_url, page.content_type, page.content) == ("http://other.test/note.md", "text/markdown", b"# Note\n\nText.")
    assert fetch.fetch("http://site.test/to?/x", LIMITS, web).final_url == "http://site.test/x"
    assert ("other.test", "/note.md") in ASKED


@pytest.mark.parametrize(("url", "why"), [
    ("http://inside.test/", "not public"), ("http://both.test/", "not public"), ("http://mapped.test/", "not public"), ("http://nowhere.test/", "no address"),
    ("http://127.0.0.1/", "not public"), ("http://[::1]/", "not public"), ("file:///etc/hostname", "not an http"), ("http:///x", "not an http"),
    ("http://site.test/to?http://inside.test/", "not public"), ("http://site.test/to?file:///etc/hostname", "not an http"),
    ("http://site.test/lost", "to nowhere"), ("http://site.test/loop", "more than 3"), ("http://site.test/gone", "404"), ("http://site.test/large", "too large"), ("http://site.test/endless", "too large"),
])
def test_what_is_refused(web, url, why):
    ASKED.clear()
    with pytest.raises(fetch.Refused, match=why):
        fetch.fetch(url, LIMITS, web)
    assert not any(host in ("inside.test", "both.test", "mapped.test") for host, _ in ASKED)  # refused before anything is sent


def test_a_slow_body_ends(web):
    with pytest.raises(fetch.Refused, match="too long"):
        fetch.fetch("http://site.test/slow", fetch.FetchLimits(bytes=10**6, seconds=1), web)


URLS = ["http://site.test/one", "http://site.test/note.md", "http://other.test/plain.txt", "http://site.test/to?http://other.test/two.html", "http://inside.test/", "http://site.test/gone", "nonsense", *(f"http://site.test/p{k}" for k in range(9))]


@pytest.fixture(scope="module")
def source(spark):
    fetch.register(spark)
    return {"urls": "\n".join(URLS), "network": "tests.local_web:LocalWeb", "bytes": "2000", "perHost": "2"}


def test_pages_as_a_data_source(spark, web, source):
    df = spark.read.format("strataq_pages").options(**source).load()
    got = {r.url: r for r in df.collect()}
    assert sorted(got) == sorted(URLS) and df.rdd.getNumPartitions() == 5  # two of site.test, one each of other, inside and nonsense
    assert {u for u, r in got.items() if r.error} == {"http://inside.test/", "http://site.test/gone", "nonsense"}
    assert got["http://site.test/to?http://other.test/two.html"].final_url == "http://other.test/two.html"
    assert bytes(got["http://site.test/note.md"].content) == b"# Note\n\nText."


def test_pages_as_a_stream(spark, web, source, tmp_path):
    stream = spark.readStream.format("strataq_pages").options(**source, urlsPerTrigger="5").load().select("url", "error")
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(by_batch(str(tmp_path / "out"))).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out") + "/batch=*")
    assert sorted(r.url for r in rows.collect()) == sorted(URLS) and rows.select("batch").distinct().count() == 4
    more = spark.readStream.format("strataq_pages").options(**source | {"urls": "\n".join([*URLS, "http://other.test/new"])}, urlsPerTrigger="100").load().select("url", "error")
    query = more.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(by_batch(str(tmp_path / "more"))).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.read.option("basePath", str(tmp_path / "more")).parquet(str(tmp_path / "more") + "/batch=*")
    assert [r.url for r in rows.collect()] == ["http://other.test/new"]  # a restart goes on


def test_fetched_and_loaded(spark, web):
    rows = spark.createDataFrame([(u,) for u in [*URLS, None]], "url string")
    got = {r.url: r for r in loaders.from_web(rows, LIMITS, "tests.local_web:LocalWeb").collect()}
    assert (got["http://site.test/one"].format, got["http://site.test/one"].title) == ("html", "Page /one") and "Hello from site.test" in got["http://site.test/one"].text
    assert (got["http://site.test/note.md"].format, got["http://site.test/note.md"].title) == ("markdown", "Note")
    assert (got["http://other.test/plain.txt"].format, got["http://other.test/plain.txt"].text) == ("text", "just text")
    assert got["http://site.test/to?http://other.test/two.html"].format == "html"
    assert "not public" in got["http://inside.test/"].error and got[None].error and len(got) == len(URLS) + 1
