"""Records out of HTML pages, by a small selector language.

A selector is parts separated by spaces, each a tag, ``.class``, ``#id`` or ``tag.class``;
a part looks at all nodes below those the part before found, so a node below two of them is
found twice. A field is ``text``, ``@attribute``, or a selector whose first match's text it
takes. A node's text is its own text first, then its children's, with whitespace collapsed.
A tag that is never closed stays open until one around it closes.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Mapping
from html.parser import HTMLParser
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.contracts import ContractError


#: Pages whose items a worker hands on at once.
PAGES = 500


class Page(HTMLParser):
    """A page as columns in document order: an element is a number, and all below it follow it.

    ``tag``, ``attributes`` and ``said`` (its own texts) are by element; ``past`` is the number
    after its last one below. Element 0 is the page itself.
    """

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = [""]
        self.attributes: list[dict[str, str]] = [{}]
        self.said: list[list[str]] = [[]]
        self.past: list[int] = [0]
        self._open = [0]
        self.feed(source)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        """Elements from this depth on end here."""
        for element in self._open[depth:]:
            self.past[element] = len(self.tag)
        del self._open[depth:]

    def handle_starttag(self, tag, attrs):
        self._open.append(len(self.tag))
        self.tag.append(tag)
        self.attributes.append({name: value or "" for name, value in attrs})
        self.said.append([])
        self.past.append(0)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self._end(len(self._open) - 1)

    def handle_endtag(self, tag):
        # the innermost open one of that name; an end without a start is nothing
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[depth]] == tag:
                return self._end(depth)

    def handle_data(self, data):
        self.said[self._open[-1]].append(data)

    def text(self, element: int) -> str:
        inside = chain.from_iterable(self.said[element : self.past[element]])
        return " ".join(" ".join(inside).split())

    def select(self, selector: str, within: int = 0) -> list[int]:
        """The elements that a selector finds below one, in the order of the parts' finds."""
        found = [within]
        for part in selector.split():
            hits = [e for e, ok in enumerate(map(self._test(part), range(len(self.tag)))) if ok]
            found = [e for above in found for e in hits[bisect_right(hits, above) : bisect_left(hits, self.past[above])]]
        return found

    def _test(self, part: str) -> Callable[[int], bool]:
        if part.startswith("#"):
            return lambda e: self.attributes[e].get("id") == part[1:]
        tag, _, name = part.partition(".")
        if not name:
            return lambda e: self.tag[e] == part
        return lambda e: tag in ("", self.tag[e]) and name in self.attributes[e].get("class", "").split()

    def field(self, element: int, rule: str) -> str | None:
        if rule.startswith("@"):
            return self.attributes[element].get(rule[1:])
        if rule == "text":
            return self.text(element)
        return next(map(self.text, self.select(rule, element)), None)


def records(source: str | Page, item_selector: str, fields: Mapping[str, str]) -> list[dict]:
    """The items of a page; without fields an item is its text."""
    page = source if isinstance(source, Page) else Page(source)
    rules = dict(fields) or {"text": "text"}
    return [{name: page.field(item, rule) for name, rule in rules.items()} for item in page.select(item_selector)]


def extract(pages: DataFrame, item_selector: str, fields: Mapping[str, str] | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, item, fields...): one row for each item of each page, numbered from 0.

    Parsing needs Python. A batch of Arrow rows is split, so that a worker holds the items of
    ``PAGES`` pages at once.
    """
    fields = dict(fields or {})
    if not item_selector or not all(isinstance(k, str) and isinstance(v, str) and k.isidentifier() for k, v in fields.items()):
        raise ContractError("items need a selector, and fields map names to selectors")
    names = list(fields) or ["text"]
    if {id_col, "item"} & set(names):
        raise ContractError("a field is named as another column of the result")

    def run(batches):
        import pandas as pd

        for whole in batches:
            for at in range(0, len(whole), PAGES):
                pdf = whole.iloc[at : at + PAGES]
                rows = [
                    (page, k, *item.values())
                    for page, source in zip(pdf["_page"], pdf["_html"], strict=True)
                    for k, item in enumerate(records(source or "", item_selector, fields))
                ]
                yield pd.DataFrame(rows, columns=["_page", "item", *names])

    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"_page {kind}, item int, " + ", ".join(f"`{n}` string" for n in names)
    out = pages.select(F.col(id_col).alias("_page"), F.col(html_col).alias("_html")).mapInPandas(run, schema)
    return out.withColumnRenamed("_page", id_col)


def to_json(rows: list[dict]) -> list[str]:
    return [json.dumps(r, sort_keys=True, ensure_ascii=False) for r in rows]
