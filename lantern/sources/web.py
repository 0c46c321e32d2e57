"""Files of other machines: requests with patience, hits, downloads that are whole, and the search for a usable file."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from .subtitles import decode, is_usable

#: Ranked hits of a query that are looked at.
PROBES = 5


@dataclass
class Page:
    status: int
    body: bytes = b""


Fetch = Callable[[str], Page]


def get(url: str, fetch: Fetch, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body behind a URL. Busy servers (429, 503) are asked again, after longer and longer waits."""
    page = Page(0)
    for attempt in range(attempts):
        page = fetch(url)
        if page.status == 200:
            return page.body
        if page.status not in (429, 503):
            break
        if attempt + 1 < attempts:
            sleep(2.0**attempt)
    raise OSError(f"status {page.status} of {url}")


def hits_of(body: str) -> list[dict]:
    """Hits of a search service: a JSON list, entries without a url left out."""
    try:
        found = json.loads(body)
    except ValueError:
        return []
    return [h for h in found if isinstance(h, dict) and h.get("url")] if isinstance(found, list) else []


def search(url: str, fetch: Fetch, ledger: list[tuple[str, int, str]], budget_left: int, **patience) -> list[dict]:
    """Hits of a search; each request is written to the ledger (url, status, body). Without budget nothing is asked."""
    if budget_left <= 0:
        return []
    try:
        body = get(url, fetch, **patience).decode("utf-8", "replace")
    except OSError as e:
        ledger.append((url, int("".join(c for c in str(e).split(" of ")[0] if c.isdigit()) or 0), ""))
        return []
    ledger.append((url, 200, body))
    return hits_of(body)


def save(parts: Iterable[bytes], to: str, good: Callable[[bytes], bool] = lambda _: True) -> bool:
    """Write parts beside their place and move them there whole; nothing stays of data that isn't good."""
    part = Path(f"{to}.part")
    part.parent.mkdir(parents=True, exist_ok=True)
    try:
        with part.open("wb") as f:
            for p in parts:
                f.write(p)
        if not good(part.read_bytes()):
            return False
        os.replace(part, to)
        return True
    finally:
        part.unlink(missing_ok=True)


def download(url: str, to: str, fetch: Fetch, least_cues: int = 150, **patience) -> bool:
    return save([get(url, fetch, **patience)], to, lambda data: is_usable(decode(data), least_cues))


def find(queries: list[str], ranked: Callable[[str], list[str]], probe: Callable[[str], bool], cached: str | None = None, put: Callable[[str | None], None] = lambda _: None) -> str | None:
    """The first usable file: of a cached pick, else of the best hits of each query in turn. The outcome is cached, a miss as None.

    A cached pick that has gone bad is dropped and looked for again, once.
    """
    if cached is not None:
        if probe(cached):
            return cached
        put(None)
    tried: set[str] = set()
    for query in queries:
        for url in ranked(query)[:PROBES]:
            if url not in tried:
                tried.add(url)
                if probe(url):
                    put(url)
                    return url
    put(None)
    return None
