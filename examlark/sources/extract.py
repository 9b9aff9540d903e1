"""Extractors: rows of a schema of their own out of each document, as a polymorphic table function.

An extractor is a class with a schema and a method ``rows``. ``table_function`` makes of several a Python UDTF whose result has, for each
call, the schema of the extractor that is named: ``SELECT d.id, t.* FROM docs d, LATERAL extract('links', d.html) t``. The name is a
constant, so that the schema is known when the query is analysed, and an unknown one is an error then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, col, lit, udtf


class Extractor:
    """What subclasses give: a schema (DDL), and the rows of one document. An error in one document is a row of its own if ``on_error`` makes one."""

    schema = ""

    def rows(self, content: str) -> Iterator[tuple]:
        raise NotImplementedError

    def on_error(self, error: Exception) -> Iterator[tuple]:
        raise error


class Links(Extractor, HTMLParser):
    """The targets of a page's links, in order; position counts from 1."""

    schema = "position int, href string, is_absolute boolean"

    def __init__(self) -> None:
        HTMLParser.__init__(self)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.found += [v or "" for k, v in attrs if tag == "a" and k == "href"]

    def rows(self, content: str) -> Iterator[tuple]:
        self.feed(content)
        self.close()
        for i, href in enumerate(self.found, 1):
            yield i, href, "://" in href


class Elements(Extractor, HTMLParser):
    """How often each element stands in a page, and how deep at most; void elements have no inside."""

    schema = "element string, n bigint, deepest int"
    #: Elements of HTML that are never closed.
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        HTMLParser.__init__(self)
        self.open: list[str] = []
        self.counts: dict[str, list[int]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        seen = self.counts.setdefault(tag, [0, 0])
        seen[0] += 1
        seen[1] = max(seen[1], len(self.open) + 1)
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def rows(self, content: str) -> Iterator[tuple]:
        self.feed(content)
        self.close()
        for tag, (n, deepest) in sorted(self.counts.items()):
            yield tag, n, deepest


class Paragraphs(Extractor):
    """The paragraphs of a text, its blocks between line breaks, with their words."""

    schema = "number int, words int, characters int"

    def rows(self, content: str) -> Iterator[tuple]:
        for i, p in enumerate((p for p in content.split("\n") if p.strip()), 1):
            yield i, len(re.findall(r"\S+", p)), len(p)


EXTRACTORS: dict[str, type[Extractor]] = {"links": Links, "elements": Elements, "paragraphs": Paragraphs}


def table_function(extractors: dict[str, type[Extractor]] | None = None):  # noqa: ANN201
    """A UDTF (name, content) over these extractors; null content has no rows."""
    known = EXTRACTORS if extractors is None else extractors
    schemas = {name: T._parse_datatype_string(e.schema) for name, e in known.items()}

    class Extract:
        @staticmethod
        def analyze(name: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
            if not name.isConstantExpression or name.value not in known:
                raise ValueError(f"an extractor's name is one of {sorted(known)}")
            return AnalyzeResult(schemas[name.value])

        def eval(self, name: str, content: str) -> Iterator[tuple]:
            if content is None:
                return
            one = known[name]()
            try:
                yield from one.rows(content)
            except Exception as e:
                yield from one.on_error(e)

    return udtf(Extract)


def extract(df: DataFrame, name: str, content: str, extractors: dict[str, type[Extractor]] | None = None) -> DataFrame:
    """df's columns, and for each row those of what the named extractor finds in its content; rows without any are left out."""
    return df.lateralJoin(table_function(extractors)(lit(name), col(f"`{content}`").outer()))


def register(spark: SparkSession, extractors: dict[str, type[Extractor]] | None = None, name: str = "extract") -> None:
    """For use in SQL."""
    spark.udtf.register(name, table_function(extractors))
