"""Fetching pages from the web on executors: public addresses only, redirects checked again, sizes and times capped.

:func:`fetch_all` takes a table of urls of any size. ``spark.read.format("strataq_pages")`` and ``spark.readStream`` take a list of urls
as an option, once :func:`register` has named the source; its partitions are hosts, so that a host is asked by few tasks.
"""

from __future__ import annotations

import http.client
import importlib
import ipaddress
import socket
import ssl
import time
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "url string, final_url string, content_type string, content binary, error string"
#: Tasks that ask one host at the same time.
PER_HOST = 4


@dataclass(frozen=True)
class FetchLimits:
    redirects: int = 3
    bytes: int = 8 * 1024 * 1024
    seconds: float = 15.0


class Refused(ValueError):
    """A URL that may not be fetched, or an answer that may not be taken."""


class Page(NamedTuple):
    final_url: str
    content_type: str
    content: bytes


class Network:
    """Names and connections; tests and networks with names of their own put another one in its place."""

    def addresses(self, host: str, port: int) -> set[str]:
        return {info[4][0] for info in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)}

    def connect(self, address: str, port: int, seconds: float) -> socket.socket:
        return socket.create_connection((address, port), seconds)


def network_of(path: str | None) -> Network:
    """The network that ``module:name`` names, imported where it is used; by default the real one."""
    if not path:
        return Network()
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)()


def is_public(address: str) -> bool:
    ip = ipaddress.ip_address(address.split("%")[0])
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not ip.is_multicast


def public_address(host: str, port: int, network: Network = Network()) -> str:
    """An address of the host; refused if any of its addresses isn't public."""
    found = network.addresses(host, port)
    if not found:
        raise Refused(f"{host} has no address")
    if not all(map(is_public, found)):
        raise Refused(f"{host} is not public")
    return sorted(found)[0]


def fetch(url: str, limits: FetchLimits = FetchLimits(), network: Network = Network()) -> Page:
    """The page behind a URL. The address that was checked is the one connected to, at each redirect anew."""
    ends = time.monotonic() + limits.seconds
    for _ in range(limits.redirects + 1):
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise Refused(f"not an http(s) URL: {url}")
        port = parts.port or (443 if parts.scheme == "https" else 80)
        sock = network.connect(public_address(parts.hostname, port, network), port, limits.seconds)
        connection = http.client.HTTPConnection(parts.hostname, port, timeout=limits.seconds)
        connection.sock = sock
        try:
            if parts.scheme == "https":
                connection.sock = ssl.create_default_context().wrap_socket(sock, server_hostname=parts.hostname)
            connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"Host": parts.netloc.rpartition("@")[2], "User-Agent": "strataq"})
            reply = connection.getresponse()
            if 300 <= reply.status < 400:
                if not (to := reply.getheader("Location")):
                    raise Refused(f"a redirect to nowhere ({reply.status})")
                url = urljoin(url, to)
                continue
            if not 200 <= reply.status < 300:
                raise Refused(f"the server said {reply.status} {reply.reason}".strip())
            return Page(url, reply.getheader("Content-Type", ""), body_of(reply, limits.bytes, ends))
        finally:
            connection.close()
            sock.close()
    raise Refused(f"more than {limits.redirects} redirects")


def body_of(reply: http.client.HTTPResponse, most: int, ends: float) -> bytes:
    """The body, up to a size that is counted and not believed, and to a time."""
    if (reply.length or 0) > most:
        raise Refused("the body is too large")
    parts, size = [], 0
    while part := reply.read1(1 << 16):
        size += len(part)
        parts.append(part)
        if size > most:
            raise Refused("the body is too large")
        if time.monotonic() > ends:
            raise Refused("the body took too long")
    return b"".join(parts)


def fetched(urls: list[str], limits: FetchLimits, network: Network) -> Iterator[tuple]:
    """(url, final_url, content_type, content, error) of each; a failed page is a row, not a failed job."""
    for url in urls:
        try:
            yield (url, *fetch(url or "", limits, network), None)
        except (OSError, ValueError, http.client.HTTPException) as e:
            yield (url, None, None, None, (str(e) or type(e).__name__)[:500])


def fetch_all(urls: DataFrame, limits: FetchLimits = FetchLimits(), network: str | None = None, per_host: int = PER_HOST) -> DataFrame:
    """The pages of each row of ``url``. A host's urls are split among ``per_host`` tasks, however many it has."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network_of(network)
        for batch in batches:
            for row in fetched(batch.column("url").to_pylist(), limits, net):  # a page at a time is held
                kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], ["url", "final_url", "content_type", "content", "error"])

    host = F.lower(F.regexp_extract("url", r"^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return urls.select("url").repartition(host, F.pmod(F.xxhash64("url"), F.lit(per_host))).mapInArrow(load, SCHEMA)


class HostPart(InputPartition):
    """Urls of one host that one task asks for."""

    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


def host_parts(urls: list[str], per_host: int) -> list[HostPart]:
    by_host: dict[str, list[str]] = defaultdict(list)
    for url in urls:
        by_host[(urlsplit(url).hostname or "") if "://" in url else ""].append(url)
    return [HostPart(own[k::per_host]) for _, own in sorted(by_host.items()) for k in range(min(per_host, len(own)))]


class _Pages:
    def __init__(self, options: dict) -> None:
        self.urls = [line.strip() for line in options.get("urls", "").splitlines() if line.strip()]
        self.network, self.per_host = options.get("network"), int(options.get("perHost", PER_HOST))
        self.limits = FetchLimits(int(options.get("redirects", FetchLimits.redirects)), int(options.get("bytes", FetchLimits.bytes)), float(options.get("seconds", FetchLimits.seconds)))

    def read(self, part: HostPart) -> Iterator[tuple]:
        return fetched(part.urls, self.limits, network_of(self.network))


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[HostPart]:
        return host_parts(self.urls, self.per_host)


class PageStream(_Pages, DataSourceStreamReader):
    """The list in order, ``urlsPerTrigger`` of them in a micro-batch; an offset is a place in the list."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.step, self.at = int(options.get("urlsPerTrigger", "100")), 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.at + self.step, len(self.urls))
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[HostPart]:
        self.at = max(self.at, end["at"])  # after a restart
        return host_parts(self.urls[start["at"] : end["at"]], self.per_host)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """Options: ``urls`` (one a line), ``perHost``, ``redirects``, ``bytes``, ``seconds``, ``network``; streams: ``urlsPerTrigger``."""

    @classmethod
    def name(cls) -> str:
        return "strataq_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema: object) -> PageStream:
        return PageStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``strataq_pages`` a format of the session."""
    spark.dataSource.register(PageSource)
