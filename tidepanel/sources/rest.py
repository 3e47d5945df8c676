"""A batch data source of JSON payloads over HTTP: retries, and a pause between requests."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Quota(Exception):
    """The service refuses for lack of quota; not to be retried."""


def fetch(url: str, attempts: int = 4, wait: float = 1.0, timeout: float = 30.0) -> str:
    """The body; waits twice as long after each failure, as told after 429; 402 is final."""
    for n in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if e.code == 402:
                raise Quota(url) from e
            pause = max(float(e.headers.get("Retry-After") or 0), 5 * wait) * (n + 1) if e.code == 429 else wait * 2**n
            last: Exception = e
        except OSError as e:
            pause, last = wait * 2**n, e
        if n + 1 < attempts:
            time.sleep(pause)
    raise last


class PayloadSource(DataSource):
    """format("payloads"): options ``url`` with {key}, ``keys`` as a JSON list, ``pause`` in seconds, ``batch`` keys a partition.

    Rows are (id, payload). One service allows one rate, so all keys are one partition, which waits
    ``pause`` between its requests; ``batch`` is for services that take several clients at once.
    """

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "id string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Keys(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.keys = options["url"], json.loads(options["keys"])
        self.pause, self.batch, self.wait = float(options.get("pause", "0.25")), int(options.get("batch", "0")), float(options.get("wait", "1"))

    def partitions(self) -> list[InputPartition]:
        size = self.batch or max(1, len(self.keys))
        return [_Keys(self.keys[i : i + size]) for i in range(0, len(self.keys), size)]

    def read(self, partition):
        for n, key in enumerate(partition.keys):
            if n:
                time.sleep(self.pause)
            yield key, fetch(self.url.replace("{key}", key), wait=self.wait)


def decoded(raw: bytes | None) -> str | None:
    """Text of bytes in the first of the usual encodings that fits; else with replacement signs."""
    if raw is None:
        return None
    for encoding in ("utf-8-sig", "big5", "cp950"):
        try:
            return bytes(raw).decode(encoding)
        except UnicodeDecodeError:
            continue
    return bytes(raw).decode("utf-8", "replace")
