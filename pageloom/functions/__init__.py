"""Functions over one page, over columns, and in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache
from typing import Any
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.page import Page, compile_schema
from pageloom.plans.verdict import check, groups_of, node_identity, terminals
from pageloom.sources import encoding as enc
from pageloom.sources.encoding import detect_encoding, resolve_label

__all__ = ["absolute", "check", "detect_encoding", "detect_encoding_column", "extract", "extract_column", "extract_grouped", "node_identity", "register", "resolve_label", "terminals", "to_absolute", "Plan"]


def _list(queries: Any) -> list[str]:
    if isinstance(queries, (str, bytes, Mapping)) or not isinstance(queries, Iterable):
        raise TypeError("queries is a list of selectors")
    out = list(queries)
    if any(not isinstance(q, str) for q in out):
        raise TypeError("a selector is a string")
    return out


class Plan:
    """A schema compiled once: columns for flat selectors and row sets for (container, sub-fields)."""

    def __init__(self, flat: Any = (), groups: Any = None, strict: bool = True) -> None:
        self.flat = _list(flat)
        self.groups = [(c, fields) for _, c, fields in groups_of(groups)]
        self.schema = compile_schema(self.flat, self.groups, strict)

    def extract(self, html: bytes | str, encoding: str | None = None) -> list[list[str]]:
        return self.schema.apply(enc.text_of(html, enc.caller_label(encoding)))[0]

    def extract_grouped(self, html: bytes | str, encoding: str | None = None) -> tuple[list[list[str]], list]:
        return self.schema.apply(enc.text_of(html, enc.caller_label(encoding)))


@lru_cache(maxsize=256)
def compiled(selector: str) -> Plan:
    """One selector's plan, kept by the worker."""
    return Plan([selector])


def extract(html: bytes | str, queries: Any, encoding: str | None = None, *, strict: bool = True) -> list[list[str]]:
    """All values of each selector, in document order."""
    return Plan(queries, strict=strict).extract(html, encoding)


def extract_grouped(html: bytes | str, queries: Any, groups: Any, encoding: str | None = None, *, strict: bool = True) -> tuple[list[list[str]], list]:
    """(values of each selector, per group its rows of sub-field values)."""
    return Plan(queries, groups, strict).extract_grouped(html, encoding)


def extract_column(html: Column | str, selector: str, encoding: Column | str | None = None, strict: bool = True) -> Column:
    """All values of one selector as an array."""
    return Page(strict=strict).field_all("v", selector).parse(html, encoding).getField("v")


@F.arrow_udf(T.StringType())
def _detect(pages: pa.Array, labels: pa.Array) -> pa.Array:
    return pa.array([None if h is None else detect_encoding(h, c) for h, c in zip(pages.to_pylist(), labels.to_pylist())], pa.string())


def detect_encoding_column(html: Column | str, label: Column | str | None = None) -> Column:
    """Canonical name of each page's encoding; null for a null page."""
    html = F.col(html) if isinstance(html, str) else html
    return _detect(html, F.lit(None).cast("string") if label is None else F.col(label) if isinstance(label, str) else label)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _joined(links: pa.Array, bases: pa.Array) -> pa.Array:
    def one(base: str | None, link: str | None) -> str | None:
        if link is None or base is None:
            return link
        try:
            return urljoin(base, link.strip(" \t\n\f\r"))
        except ValueError:
            return link

    return pa.array([None if row is None else [one(base, link) for link in row] for row, base in zip(links.to_pylist(), bases.to_pylist())], pa.list_(pa.string()))


def absolute(links: Column | str, base: Column | str, many: bool = False) -> Column:
    """Links of a page made absolute by its address: a column of strings, or of arrays of them with ``many``. What can't be joined stays as it is."""
    links, base = (F.col(x) if isinstance(x, str) else x for x in (links, base))
    return _joined(links, base) if many else F.when(links.isNotNull(), F.get(_joined(F.array(links), base), F.lit(0)))


def to_absolute(base: Column | str, many: bool = False) -> Callable[[Column], Column]:
    """``absolute`` as a field's transformation; ``base`` is a column that is kept."""
    return lambda links: absolute(links, base, many)


def register(spark: SparkSession) -> None:
    """SQL functions: page_extract(html, selector), page_first(html, selector), detect_encoding(html, label), resolve_label(label),
    selector_supported(selector), and the table functions html_nodes(html), html_texts(html), scan_selectors(path, source)."""
    from pageloom.operators.relational import NODE_TYPE, TEXT_TYPE, node_rows, text_rows
    from pageloom.scan import SITE_TYPE, scan_source

    @F.arrow_udf("array<string>")
    def page_extract(pages: pa.Array, selectors: pa.Array) -> pa.Array:
        values = [None if q is None else compiled(q).extract(h or "")[0] for h, q in zip(pages.to_pylist(), selectors.to_pylist())]
        return pa.array(values, pa.list_(pa.string()))

    @F.arrow_udf("string")
    def page_first(pages: pa.Array, selectors: pa.Array) -> pa.Array:
        values = [None if q is None else next(iter(compiled(q).extract(h or "")[0]), None) for h, q in zip(pages.to_pylist(), selectors.to_pylist())]
        return pa.array(values, pa.string())

    @F.arrow_udf("string")
    def label(labels: pa.Array) -> pa.Array:
        return pa.array([resolve_label(x) for x in labels.to_pylist()], pa.string())

    @F.arrow_udf("boolean")
    def supported(selectors: pa.Array) -> pa.Array:
        return pa.array([None if q is None else check([q]).ok for q in selectors.to_pylist()], pa.bool_())

    for name, fn in (("page_extract", page_extract), ("page_first", page_first), ("detect_encoding", _detect), ("resolve_label", label), ("selector_supported", supported)):
        spark.udf.register(name, fn)

    @F.udtf(returnType=NODE_TYPE)
    class Nodes:
        def eval(self, html: str):  # noqa: ANN202
            yield from node_rows(html or "")

    @F.udtf(returnType=TEXT_TYPE)
    class Texts:
        def eval(self, html: str):  # noqa: ANN202
            yield from text_rows(html or "")

    @F.udtf(returnType=SITE_TYPE)
    class Sites:
        def eval(self, path: str, source: str):  # noqa: ANN202
            yield from (s.row() for s in scan_source(source or "", path or ""))

    spark.udtf.register("html_nodes", Nodes)
    spark.udtf.register("html_texts", Texts)
    spark.udtf.register("scan_selectors", Sites)

