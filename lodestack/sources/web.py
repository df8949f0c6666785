"""A stored web to crawl: what a fetch of a URL would answer (``operators.crawl.ANSWER``).

``url, status, content_type, content_length, location, page, fetched``; a live
fetcher only has to give the same columns for a frontier of URLs.
"""

from __future__ import annotations

import heapq
import time
import urllib.error
import urllib.request
from collections import defaultdict, deque
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import urls
from lodestack.session import make_importable

SCHEMA = "url string, status int, content_type string, content_length long, location string, page string, fetched timestamp"
MOVED = (301, 307, 308)


def from_pages(pages: DataFrame, url: str = "url", html: str = "html", fetched: str = "2024-01-01 00:00:00") -> DataFrame:
    """Stored pages as successful answers of that time."""
    return pages.select(
        F.col(url).alias("url"),
        F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        F.octet_length(F.col(html)).cast("long").alias("content_length"),
        F.lit(None).cast("string").alias("location"),
        F.col(html).alias("page"),
        F.lit(fetched).cast("timestamp").alias("fetched"),
    )


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


#: Answers in one batch of a live fetch.
BATCH = 64


def fetch(urls_: DataFrame, agent: str, timeout: float = 10.0, workers: int = 8, pause: float = 0.0) -> DataFrame:
    """Answers of the live web for ``urls_(url)``.

    Each URL is asked for its headers first; only one that answers 200 is then
    fetched, and the status of that fetch counts. Redirects are reported, not
    followed. A URL that cannot be reached has no row; one whose headers came
    and whose page did not has a row without a page.

    A host's URLs are in one task, which asks them one after another with
    ``pause`` seconds between; meanwhile it asks up to ``workers`` other hosts.
    """

    def ask(opener, url: str, method: str):
        request = urllib.request.Request(url, headers={"User-Agent": agent}, method=method)
        try:
            with opener.open(request, timeout=timeout) as r:
                return r.status, r.headers, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.headers, b""

    def answer(opener, url: str) -> tuple | None:
        try:
            status, headers, _ = ask(opener, url, "HEAD")
        except (OSError, ValueError):
            return None
        page = None
        if status == 200:
            try:
                status, got, raw = ask(opener, url, "GET")
                page = raw.decode(got.get_content_charset() or "utf-8", "replace") if status == 200 else None
            except (OSError, ValueError, LookupError):
                pass
        length = headers.get("Content-Length")
        size = int(length) if length and length.isdigit() else None
        target = headers.get("Location") if status in MOVED else None
        return url, status, headers.get("Content-Type"), size, target, page, datetime.now(timezone.utc)

    def made(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["url", "status", "content_type", "content_length", "location", "page", "fetched"])
        return out.astype({"status": "int32", "content_length": "Int64", "fetched": "datetime64[us, UTC]"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener, waiting = urllib.request.build_opener(_NoRedirect), defaultdict(deque)
        for batch in batches:
            for host, url in zip(batch["host"], batch["url"], strict=True):
                waiting[host].append(url)
        ready, asked, rows = [(0.0, k, host) for k, host in enumerate(waiting)], {}, []
        with ThreadPoolExecutor(workers) as pool:
            while ready or asked:
                while ready and len(asked) < workers and ready[0][0] <= time.monotonic():
                    _, k, host = heapq.heappop(ready)
                    asked[pool.submit(answer, opener, waiting[host].popleft())] = k, host
                if not asked:
                    time.sleep(max(0.0, ready[0][0] - time.monotonic()))
                    continue
                soon = max(0.0, ready[0][0] - time.monotonic()) if ready and len(asked) < workers else None
                for done in wait(asked, timeout=soon, return_when=FIRST_COMPLETED).done:
                    k, host = asked.pop(done)
                    if waiting[host]:
                        heapq.heappush(ready, (time.monotonic() + pause, k, host))
                    if (row := done.result()) is not None:
                        rows.append(row)
                if len(rows) >= BATCH:
                    yield made(rows)
                    rows = []
        yield made(rows)

    make_importable(urls_.sparkSession)
    hosted = urls_.select(urls.host(F.col("url")).alias("host"), "url")
    return hosted.repartition("host").sortWithinPartitions("host", "url").mapInPandas(run, SCHEMA)
