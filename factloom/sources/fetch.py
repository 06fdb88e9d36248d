"""HTTP page source: off unless called; respects robots rules, a page limit and a pause.

Failures are rows with ``error``, never exceptions.  One request at a time per task; sites are dealt by
origin, so an origin is only visited by one task, over one connection as long as the server keeps it.
"""

from __future__ import annotations

import http.client
import time
import urllib.robotparser
from collections.abc import Iterator
from urllib.parse import SplitResult, quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

AGENT = "factloom/1.0 (published contact facts; respects robots.txt)"
MAX_BYTES, CHUNK, TIMEOUT = 5 << 20, 64 << 10, 15
REDIRECTS, MAX_REDIRECTS = (301, 302, 303, 307, 308), 10
#: What servers and networks may raise.
FAILURES = (OSError, ValueError, http.client.HTTPException)
FETCHED = "url string, final_url string, status_code int, html string, error string"


class Fetcher:
    """Fetches pages; rules are read once per origin."""

    def __init__(self, timeout: float = TIMEOUT, respect_robots: bool = True, pause: float = 0.0):
        self.timeout, self.respect_robots, self.pause = timeout, respect_robots, pause
        self.rules: dict[str, urllib.robotparser.RobotFileParser] = {}

        self.connections: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def _request(self, parts: SplitResult) -> http.client.HTTPResponse:
        """One request over the origin's connection; a kept one that the server has closed is opened anew."""
        origin = parts.scheme, parts.netloc
        path = quote(parts.path or "/", safe="/%:=&~+!$,;'@()*") + ("?" + quote(parts.query, safe="/%:=&?~+!$,;'@()*[]") if parts.query else "")
        for kept in (True, False):
            connection = self.connections.get(origin) if kept else None
            if kept and connection is None:
                continue
            if connection is None:
                kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
                connection = self.connections[origin] = kind(parts.netloc.rpartition("@")[2], timeout=self.timeout)
            try:
                connection.request("GET", path, headers={"User-Agent": AGENT, "Accept-Language": "es,en"})
                return connection.getresponse()
            except FAILURES:
                self._drop(origin)
                if not kept:
                    raise
        raise ConnectionError(parts.netloc)

    def _drop(self, origin: tuple[str, str]) -> None:
        if connection := self.connections.pop(origin, None):
            connection.close()

    def _done(self, parts: SplitResult, answer: http.client.HTTPResponse) -> None:
        """Keeps the connection if the answer's rest is short, else closes it."""
        try:
            if not answer.isclosed():
                answer.read(CHUNK)
            if not answer.isclosed():
                self._drop((parts.scheme, parts.netloc))
        except FAILURES:
            self._drop((parts.scheme, parts.netloc))

    def _answer(self, url: str) -> tuple[http.client.HTTPResponse, SplitResult]:
        """The answer behind the redirects, and where it came from."""
        for _ in range(MAX_REDIRECTS + 1):
            parts = urlsplit(url)
            if parts.scheme not in ("http", "https"):
                raise ValueError("only http and https")
            answer = self._request(parts)
            target = answer.headers.get("Location")
            if answer.status not in REDIRECTS or not target:
                return answer, parts
            self._done(parts, answer)
            url = urljoin(url, target)
        raise ValueError("too many redirects")

    def allowed(self, url: str) -> bool:
        """What robots.txt says; anything but a readable file allows."""
        parts = urlsplit(url)
        origin = f"{parts.scheme}://{parts.netloc}"
        if origin not in self.rules:
            rules = urllib.robotparser.RobotFileParser()
            try:
                answer, found = self._answer(origin + "/robots.txt")
                rules.parse(answer.read(MAX_BYTES).decode("utf-8", "replace").splitlines() if answer.status == 200 else [])
                self._done(found, answer)
            except FAILURES:
                rules.parse([])
            self.rules[origin] = rules
        return self.rules[origin].can_fetch(AGENT, url)

    def fetch(self, url: str) -> dict:
        row = {"url": url, "final_url": url, "status_code": None, "html": None, "error": None}
        try:
            if urlsplit(url).scheme not in ("http", "https"):
                return row | {"error": "only http and https"}
            if self.respect_robots and not self.allowed(url):
                return row | {"error": "robots.txt forbids it"}
            answer, found = self._answer(url)
            row |= {"status_code": answer.status} | self._page(answer, found)
            self._done(found, answer)
            return row
        except FAILURES as e:
            return row | {"error": str(e) or type(e).__name__}

    @staticmethod
    def _page(answer: http.client.HTTPResponse, found: SplitResult) -> dict:
        kind = answer.headers.get("Content-Type", "")
        if answer.status != 200:
            return {"error": f"HTTP {answer.status}"}
        if "text/html" not in kind and "application/xhtml" not in kind:
            return {"error": f"not HTML: {kind}"}
        body = bytearray()
        while chunk := answer.read(CHUNK):
            body += chunk
            if len(body) > MAX_BYTES:
                return {"error": "page too large"}
        if answer.length:
            raise http.client.IncompleteRead(bytes(body[:0]), answer.length)
        try:
            html = body.decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except LookupError:
            html = body.decode("utf-8", "replace")
        return {"final_url": found.geturl(), "html": html}


def fetched(urls: DataFrame, *, timeout: float = TIMEOUT, respect_robots: bool = True, pause: float = 1.0) -> DataFrame:
    """A page store of ``urls.url``.  Each URL costs a request: write the result before using it twice."""
    ship(urls.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = Fetcher(timeout, respect_robots, pause)
        for frame in frames:
            rows = []
            for url in frame["url"]:
                time.sleep(fetcher.pause)
                rows.append(fetcher.fetch(url))
            yield pd.DataFrame(rows, columns=["url", "final_url", "status_code", "html", "error"])

    by_origin = urls.selectExpr("url", "regexp_extract(url, '^[^/]*//[^/]*', 0) AS origin").repartition("origin").select("url")
    return by_origin.mapInPandas(run, FETCHED)
