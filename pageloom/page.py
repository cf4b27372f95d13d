"""Page schemas: named fields and groups, applied to one page or to a DataFrame of pages.

On a DataFrame the whole schema is one Arrow function from page to nested arrays, without an exchange; cardinality, joins and transformations
are Catalyst expressions on its result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators.fused import Schema
from pageloom.plans import verdict
from pageloom.plans.ir import Unsupported
from pageloom.sources.encoding import caller_label, column_label, text_of

Card = tuple[str, str]  # first, all or join; separator
_STRINGS = T.ArrayType(T.StringType(), False)


def compile_schema(columns: list[str], groups: list[tuple[str, list[tuple[str, str]]]], strict: bool = True, first_only: bool = False) -> Schema:
    """The compiled schema; with ``strict`` an error where anything in it is unsupported, else empty columns for that. ``first_only``: columns
    give their first value alone."""
    report = verdict.check([(q, q) for q in columns], [(f"group{k}", c, fields) for k, (c, fields) in enumerate(groups)])
    if strict:
        report.raise_for_status()
    elif report.over_budget:
        raise ValueError("too many selectors")

    def attempt(test: Callable, query: str) -> Any:
        try:
            return test(query)
        except (Unsupported, RecursionError):
            return None

    return Schema([attempt(verdict.flat, q) for q in columns], [(attempt(verdict.container, c), [(n, attempt(verdict.subfield, s)) for n, s in fields]) for c, fields in groups], first_only)


def _shape(values: list[str], card: Card) -> Any:
    kind, separator = card
    return (values[0] if values else None) if kind == "first" else values if kind == "all" else separator.join(values)


def _card(spec: Any) -> tuple[str, Card]:
    """A sub-field: a selector, or (selector, "all" | "first") or (selector, "join", separator)."""
    if isinstance(spec, str):
        return spec, ("first", "")
    selector, kind, *rest = spec
    if kind not in ("first", "all", "join") or (kind == "join") != bool(rest):
        raise ValueError(f"not a sub-field: {spec!r}")
    return selector, (kind, rest[0] if rest else "")


class Item:
    """One page's values."""

    def __init__(self, names: list[str], raw: list[list[str]], cards: list[Card], maps: list[tuple], groups: dict[str, Any]) -> None:
        self._raw, self._cards, self._maps, self._groups = dict(zip(names, raw)), dict(zip(names, cards)), dict(zip(names, maps)), groups

    def get(self, name: str) -> str | None:
        values = self._raw[name]
        return values[0] if values else None

    def get_all(self, name: str) -> list[str]:
        return list(self._raw[name])

    def value(self, name: str) -> Any:
        if name in self._groups:
            return self._groups[name]
        out = _shape(self._raw[name], self._cards[name])
        for fn in self._maps[name]:
            out = fn(out)
        return out

    def empty_fields(self) -> list[str]:
        return [n for n, v in self._raw.items() if not v] + [n for n, v in self._groups.items() if not v]

    def to_dict(self) -> dict[str, Any]:
        return {name: self.value(name) for name in (*self._raw, *self._groups)}

    def to_json(self, **options: Any) -> str:
        return json.dumps(self.to_dict(), **{"ensure_ascii": False, **options})

    def __iter__(self) -> Iterator[tuple[str, Any]]:
        return iter(self.to_dict().items())

    def __len__(self) -> int:
        return len(self._raw) + len(self._groups)


class Page:
    """Fields by ``field`` (first value or null), ``field_all`` (all values), ``field_join`` (one string), groups by ``many`` and ``one``.

    ``map`` is a function from Column to Column, applied to the shaped column; in ``extract`` it is called with the Python value.
    """

    def __init__(self, *, strict: bool = True) -> None:
        self.strict = strict
        self._fields: list[tuple[str, str, Card, tuple]] = []
        self._groups: list[tuple[str, str, list[tuple[str, str, Card]], bool]] = []
        self._compiled: Schema | None = None
        self._compiled_first: Schema | None = None

    def _new(self, name: str) -> None:
        if name in self.field_names():
            raise ValueError(f"there is a field {name!r} already")
        self._compiled = self._compiled_first = None

    def _add(self, name: str, selector: str, card: Card, fn: Any) -> "Page":
        self._new(name)
        if self.strict:
            verdict.check([(name, selector)]).raise_for_status()
        self._fields.append((name, selector, card, tuple(fn) if isinstance(fn, (list, tuple)) else (fn,) if fn else ()))
        return self

    def field(self, name: str, selector: str, *, map: Any = None) -> "Page":  # noqa: A002
        return self._add(name, selector, ("first", ""), map)

    def field_all(self, name: str, selector: str, *, map: Any = None) -> "Page":  # noqa: A002
        return self._add(name, selector, ("all", ""), map)

    def field_join(self, name: str, selector: str, separator: str = " ", *, map: Any = None) -> "Page":  # noqa: A002
        return self._add(name, selector, ("join", separator), map)

    def _group(self, name: str, container: str, subfields: Mapping[str, Any], one: bool) -> "Page":
        self._new(name)
        fields = [(n, *_card(spec)) for n, spec in subfields.items()]
        if self.strict:
            verdict.check(groups=[(name, container, [(n, s) for n, s, _ in fields])]).raise_for_status()
        self._groups.append((name, container, fields, one))
        return self

    def many(self, name: str, container: str, subfields: Mapping[str, Any]) -> "Page":
        return self._group(name, container, subfields, False)

    def one(self, name: str, container: str, subfields: Mapping[str, Any]) -> "Page":
        return self._group(name, container, subfields, True)

    def field_names(self) -> list[str]:
        return [f[0] for f in self._fields] + [g[0] for g in self._groups]

    def __len__(self) -> int:
        return len(self._fields) + len(self._groups)

    def check(self) -> verdict.SchemaReport:
        return verdict.check([(n, s) for n, s, _, _ in self._fields], [(n, c, [(k, s) for k, s, _ in fs]) for n, c, fs, _ in self._groups])

    def compiled(self) -> Schema:
        if self._compiled is None:
            self._compiled = compile_schema([s for _, s, _, _ in self._fields], [(c, [(n, s) for n, s, _ in fs]) for _, c, fs, _ in self._groups], self.strict)
        return self._compiled

    def compiled_first(self) -> Schema:
        """As ``compiled``, for the first value of each field if that is all that the fields take; else the same."""
        if self._groups or any(card[0] != "first" for _, _, card, _ in self._fields):
            return self.compiled()
        if self._compiled_first is None:
            self._compiled_first = compile_schema([s for _, s, _, _ in self._fields], [], self.strict, True)
        return self._compiled_first

    # one page

    def extract(self, html: bytes | str, encoding: str | None = None) -> Item:
        columns, groups = self.compiled().apply(text_of(html, caller_label(encoding)))
        shaped: dict[str, Any] = {}
        for (name, _, fields, one), rows in zip(self._groups, groups):
            out = [{n: _shape(v, card) for (n, _, card), v in zip(fields, row)} for row in rows]
            shaped[name] = (out[0] if out else None) if one else out
        return Item([f[0] for f in self._fields], columns, [f[2] for f in self._fields], [f[3] for f in self._fields], shaped)

    # DataFrames

    def raw_type(self) -> T.StructType:
        """What the parser gives: all values of each field."""
        fields = [T.StructField(n, _STRINGS, False) for n, *_ in self._fields]
        for name, _, subs, _ in self._groups:
            row = T.StructType([T.StructField(n, _STRINGS, False) for n, _, _ in subs])
            fields.append(T.StructField(name, T.ArrayType(row, False), False))
        return T.StructType(fields)

    def parse(self, html: Column | str, encoding: Column | str | None = None) -> Column:
        """A column of ``raw_type``. A null page has no matches; a label that nobody knows, or that stands beside a page of text, is passed over.
        Where all fields take their first value only that is given, and pages are read no further than it takes."""
        page, kind = self.compiled_first(), self.raw_type()
        names = [n for n, *_ in self._fields]
        groups = [(n, [s for s, _, _ in subs]) for n, _, subs, _ in self._groups]
        html = F.col(html) if isinstance(html, str) else html
        encoding = F.lit(None).cast("string") if encoding is None else F.col(encoding) if isinstance(encoding, str) else encoding

        @F.arrow_udf(kind)
        def run(pages: pa.Array, labels: pa.Array) -> pa.Array:
            return to_arrow([page.apply(text_of(h, None if isinstance(h, str) else column_label(c))) for h, c in zip(pages.to_pylist(), labels.to_pylist())], names, groups)

        return run(html, encoding)

    def select(self, df: DataFrame, html: str | Column = "html", encoding: str | Column | None = None, keep: list[str] | None = None) -> DataFrame:
        """``keep`` (by default all columns but the page's own) and a column for each field and group; names must differ."""
        keep = [c for c in df.columns if c != html] if keep is None else keep
        if both := {c.lower() for c in keep} & {n.lower() for n in self.field_names()}:
            raise ValueError(f"columns that are kept and fields have the same names: {sorted(both)}")
        page = "page"
        while page.lower() in {c.lower() for c in keep}:
            page += "_"
        held = df.select(*[F.col(_quoted(c)) for c in keep], self.parse(html, encoding).alias(page))
        out = [F.col(_quoted(c)) for c in keep]
        for name, _, card, maps in self._fields:
            column = shape(F.col(page).getField(name), card)
            for fn in maps:
                column = fn(column)
            out.append(column.alias(name))
        for name, _, subs, one in self._groups:
            rows = F.transform(F.col(page).getField(name), _row_of(subs))
            out.append((F.get(rows, F.lit(0)) if one else rows).alias(name))
        return held.select(*out)

    def to_json(self, df: DataFrame, html: str = "html", encoding: str | None = None, keep: list[str] | None = None) -> DataFrame:
        """``keep`` and one column ``item`` of JSON, nulls kept."""
        keep = [c for c in df.columns if c != html] if keep is None else keep
        found = self.select(df, html, encoding, keep)
        return found.select(*keep, F.to_json(F.struct(*self.field_names()), {"ignoreNullFields": "false"}).alias("item"))

    def empty(self) -> Column:
        """Over ``parse``'s column named ``page``: names of the fields and groups that matched nothing."""
        names = self.field_names()
        return F.filter(F.array(*[F.when(F.size(F.col("page").getField(n)) == 0, F.lit(n)) for n in names]), lambda x: x.isNotNull())


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shape(values: Column, card: Card) -> Column:
    kind, separator = card
    return F.get(values, F.lit(0)) if kind == "first" else values if kind == "all" else F.array_join(values, separator)


def _row_of(subs: list[tuple[str, str, Card]]) -> Callable[[Column], Column]:
    return lambda r: F.struct(*[shape(r.getField(n), card).alias(n) for n, _, card in subs])


def _lists(rows: list[list[str]]) -> pa.Array:
    ends, values = [0], []
    for row in rows:
        values += row
        ends.append(len(values))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.string()), type=pa.list_(pa.field("element", pa.string(), False)))


def to_arrow(found: list, names: list[str], groups: list[tuple[str, list[str]]]) -> pa.Array:
    arrays = [_lists([columns[k] for columns, _ in found]) for k in range(len(names))]
    fields = [pa.field(n, a.type, False) for n, a in zip(names, arrays)]
    for k, (name, subs) in enumerate(groups):
        rows = [g[k] for _, g in found]
        flat = [r for page in rows for r in page]
        offsets = [0]
        for page in rows:
            offsets.append(offsets[-1] + len(page))
        inner = [_lists([r[j] for r in flat]) for j in range(len(subs))]
        struct = pa.StructArray.from_arrays(inner, fields=[pa.field(n, a.type, False) for n, a in zip(subs, inner)])
        kind = pa.list_(pa.field("element", struct.type, False))
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct, type=kind))
        fields.append(pa.field(name, kind, False))
    return pa.StructArray.from_arrays(arrays, fields=fields)


def re_first(pattern: str) -> Callable[[Column], Column]:
    """A transformation: the first group (or the whole match) of a Java regular expression, null where nothing matches."""
    import re

    group = 1 if re.compile(pattern).groups else 0
    return lambda c: F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))
