"""Web pages: every hop of a fetch is checked before it is made; size and output are bounded."""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import urljoin, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.shared import importable
from corpusmill.sources.dispatch import address_blocked

MAX_REDIRECTS = 5
MAX_BODY_BYTES = 10 * 1024 * 1024
MAX_TEXT = 100_000


# What is put after a page that was cut.
CUT_BODY = "\n\n[Content truncated due to download size limit...]"
CUT_TEXT = "\n\n[Content truncated...]"


class BlockedError(ValueError):
    """The address must not be fetched."""


@dataclass(frozen=True)
class Response:
    status: int
    body: bytes
    location: str | None = None


def resolve(host: str, port: int) -> list[str]:
    return sorted({info[4][0] for info in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)})


def check(url: str, resolver: Callable[[str, int], list[str]] = resolve) -> list[str]:
    """The host's addresses; raises unless the scheme is http or https, the host has addresses and none is blocked."""
    parts = urlparse(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise BlockedError(f"not an http address with a host: {url}")
    addresses = resolver(parts.hostname, parts.port or (443 if parts.scheme == "https" else 80))
    if not addresses or any(map(address_blocked, addresses)):
        raise BlockedError(f"{parts.hostname} is at a blocked address" if addresses else f"{parts.hostname} has no address")
    return addresses


def open_url(url: str, most: int = MAX_BODY_BYTES, address: str | None = None) -> Response:
    """One request without following redirects; one byte more than ``most`` is read at most.

    With an ``address`` the connection goes there, and the name is not resolved again: what
    was checked is what is asked.
    """
    import http.client
    import ssl

    parts = urlparse(url)
    host = parts.hostname or ""
    if parts.scheme == "https":
        context = ssl.create_default_context()
        connection: http.client.HTTPConnection = http.client.HTTPSConnection(host, parts.port, timeout=30, context=context)
    else:
        context, connection = None, http.client.HTTPConnection(host, parts.port, timeout=30)
    try:
        if address is not None:
            plain = socket.create_connection((address, connection.port), 30)
            connection.sock = context.wrap_socket(plain, server_hostname=host) if context else plain
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": "corpusmill"})
        answer = connection.getresponse()
        return Response(answer.status, answer.read(most + 1), answer.getheader("Location"))
    finally:
        connection.close()


def fetch(url: str, opener: Callable[[str], Response] = open_url, resolver: Callable[[str, int], list[str]] = resolve, selector: str | None = None, max_length: int = MAX_TEXT, max_body_bytes: int = MAX_BODY_BYTES) -> str:
    """A page's text, through redirects that are each checked.

    With a ``selector`` the text of the elements that it names, else that of the page's main
    part.  Bodies beyond ``max_body_bytes`` and texts beyond ``max_length`` are cut and say so.
    """
    from corpusmill.sources.html import main_text, selected_text

    for _ in range(MAX_REDIRECTS + 1):
        addresses = check(url, resolver)
        answer = open_url(url, max_body_bytes, addresses[0]) if opener is open_url else opener(url)
        if answer.status in (301, 302, 303, 307, 308):
            if not answer.location:
                raise ValueError("a redirect without a target")
            url = urljoin(url, answer.location)
            continue
        if answer.status >= 400:
            raise ValueError(f"status {answer.status}")
        html = answer.body[:max_body_bytes].decode("utf-8", "replace") + (CUT_BODY if len(answer.body) > max_body_bytes else "")
        text = selected_text(html, selector) if selector else main_text(html)
        return text if len(text) <= max_length else text[:max_length] + CUT_TEXT
    raise ValueError("too many redirects")


def load_urls(urls: DataFrame, url: str = "url", opener: Callable[[str], Response] = open_url, resolver: Callable[[str, int], list[str]] = resolve, **limits: Any) -> DataFrame:
    """``urls`` with content and error: one call a row, each failure its own row's; ``limits`` are those of ``fetch``."""
    importable(urls.sparkSession)
    kept = urls.withColumns({"content": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    at, width = urls.columns.index(url), len(urls.columns)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in batches:
            texts, errors = [], []
            for address in batch.column(at).to_pylist():
                try:
                    texts.append(fetch(address or "", opener, resolver, **limits))
                    errors.append(None)
                except Exception as failure:  # noqa: BLE001 - reported in the row
                    texts.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=batch.schema.names)

    return kept.mapInArrow(run, kept.schema)
