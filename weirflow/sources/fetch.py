"""Bounded page-by-page acquisition over HTTP, ending in a DataFrame.

The transport is a callable from (url, headers, timeout) to (status, body), so that tests and
callers with their own client need no network; the default one is the standard library's.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.contracts import ContractError, Record, record, reject_code
from weirflow.operators import html

MAX_PAGES, MAX_SECONDS = 1000, 60

Transport = Callable[[str, Mapping[str, str], float], tuple[int, str]]


def over_http(url: str, headers: Mapping[str, str], timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, headers=dict(headers))
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8")


def safe_url(url: Any) -> str:
    parts = urlsplit(url) if isinstance(url, str) else None
    if parts is None or parts.scheme not in ("http", "https") or not parts.netloc or parts.username or parts.password:
        raise ContractError("an absolute http or https url without credentials is needed")
    return url


def with_query(url: str, name: str, value: Any) -> str:
    parts = urlsplit(url)
    query = {**dict(parse_qsl(parts.query, keep_blank_values=True)), name: str(value)}
    return urlunsplit(parts._replace(query=urlencode(query)))


def nested(value: Any, path: str | None, default: Any = None) -> Any:
    """What a dotted path leads to through objects."""
    for part in (path or "").split(".") if path else ():
        if not isinstance(value, Mapping) or part not in value:
            return default
        value = value[part]
    return value


def newer(candidate: Any, prior: Any) -> bool:
    """Whether a cursor is past another; values of unlike types compare as text."""
    if candidate is None or prior is None:
        return candidate is not None
    try:
        return candidate > prior
    except TypeError:
        return str(candidate) > str(prior)


@record
class Acquire(Record):
    url: str
    max_pages: int = 100
    timeout_seconds: float = 10.0
    headers: Any = ()
    pagination: Any = ()
    items_path: str | None = None
    item_selector: str | None = None
    fields: Any = ()
    cursor_field: str | None = None
    cursor_param: str = "since"
    start_value: Any = None

    def check(self):
        safe_url(self.url)
        self._whole("max_pages", 1, MAX_PAGES)
        t = self.timeout_seconds
        self._need(isinstance(t, (int, float)) and not isinstance(t, bool) and 0 < t <= MAX_SECONDS, "timeout_seconds must be above 0 and at most 60")
        for name in ("headers", "pagination", "fields"):
            self._set(name, dict(getattr(self, name) or {}))
            reject_code(getattr(self, name))
        self._need(all(isinstance(x, str) for kv in self.headers.items() for x in kv), "headers must be strings")
        self._need(self.pagination.get("kind", "none") in ("none", "link", "page", "cursor"), "pagination.kind must be none, link, page or cursor")


@dataclass(frozen=True)
class Acquired:
    records: tuple[dict, ...]
    pages: int
    cursor: Any

    def frame(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        """The records as a table; without a schema Spark infers one from the JSON of all of them."""
        lines = spark.sparkContext.parallelize([json.dumps(r) for r in self.records])
        return (spark.read if schema is None else spark.read.schema(schema)).json(lines)


def _next(p: Acquire, url: str, payload: Any, page: int, some: bool) -> str | None:
    rule = p.pagination
    kind = rule.get("kind", "none")
    if kind == "page":
        more = rule.get("has_more_field")
        if not some or (more and isinstance(payload, Mapping) and not nested(payload, more)):
            return None
        return with_query(url, rule.get("param", "page"), rule.get("start", 1) + page + 1)
    if kind == "cursor":
        cursor = nested(payload, rule.get("next_cursor_field", "next_cursor"))
        return None if cursor in (None, "") else with_query(url, rule.get("cursor_param", "cursor"), cursor)
    if kind == "link":
        if isinstance(payload, html.Page):
            found = payload.select(rule.get("next_selector", "a.next"))
            link = payload.attributes[found[0]].get("href") if found else None
        else:
            link = nested(payload, rule.get("next_field", "next"))
        return safe_url(urljoin(url, link)) if isinstance(link, str) and link else None
    return None


def acquire(params, state: dict | None = None, transport: Transport = over_http) -> Acquired:
    """Fetch pages until pagination ends. JSON by default, HTML with an ``item_selector``.

    With a ``cursor_field`` only records newer than the cursor in ``state`` (or
    ``start_value``) are kept, the cursor is sent with the first url, and the newest becomes
    the next one.
    """
    p = Acquire.of(params)
    prior = (state or {}).get(p.url, p.start_value) if p.cursor_field else None
    url = p.url if prior is None else with_query(p.url, p.cursor_param, prior)
    kept: list[dict] = []
    cursor, pages = prior, 0
    while url is not None and pages < p.max_pages:
        status, body = transport(url, p.headers, p.timeout_seconds)
        if not 200 <= status < 300:
            raise OSError(f"the server answered {status}")
        if p.item_selector is not None:
            payload: Any = html.Page(body)
            items = html.records(payload, p.item_selector, p.fields)
        else:
            try:
                payload = json.loads(body)
            except ValueError as e:
                raise ContractError("the answer is not JSON") from e
            items = nested(payload, p.items_path, payload)
            if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
                raise ContractError("items_path must lead to a list of objects")
        if p.cursor_field:
            items = [x for x in items if newer(x.get(p.cursor_field), prior)]
            for x in items:
                cursor = x[p.cursor_field] if newer(x[p.cursor_field], cursor) else cursor
        kept += items
        url = _next(p, url, payload, pages, bool(items))
        pages += 1
    if state is not None and p.cursor_field and cursor is not None:
        state[p.url] = cursor
    return Acquired(tuple(kept), pages, cursor)


def incremental(df: DataFrame, cursor_field: str, prior: Any = None) -> tuple[DataFrame, DataFrame]:
    """(rows newer than the prior cursor, one row with the next cursor), for tables already here.

    The comparison reaches the scan as a pushed filter.
    """
    c = F.col(cursor_field)
    at = F.lit(prior).cast(df.schema[cursor_field].dataType)
    fresh = df.where(c.isNotNull()) if prior is None else df.where(c > at)
    return fresh, fresh.agg(F.coalesce(F.max(c), at).alias("cursor"))
