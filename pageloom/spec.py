"""Page objects: schemas declared as classes, merged along their bases, compiled once per class."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as data_field, fields as data_fields, is_dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators.tree import FRAME, Tree, parse
from pageloom.page import Page, re_first
from pageloom.plans import verdict


@dataclass(frozen=True)
class Field:
    """A declared field. ``map`` functions take and give a Column; ``out`` replaces the class's processors for it."""

    selector: str
    all: bool = False
    join: str | None = None
    out: tuple | None = None
    cached: bool = False
    meta: dict = data_field(default_factory=dict)
    maps: tuple = ()
    type: Any = None
    node: bool | None = None  # None: neither as_node() nor as_value() was said

    def map(self, fn: Callable[[Column], Column]) -> "Field":
        return replace(self, maps=(*self.maps, fn))

    def re_first(self, pattern: str) -> "Field":
        if self.all:
            raise TypeError("re_first() takes one value, not a list")
        return self.map(re_first(pattern))

    def typed_as(self, kind: Any) -> "Field":
        """A note of the type that the field has; a Spark type is cast to."""
        return replace(self, type=kind)

    def as_node(self) -> "Field":
        """The element itself as a struct: tag, attributes, string, source. Further functions on it belong into ``out``."""
        if self.join is not None:
            raise TypeError("as_node() of joined text")
        if verdict.terminals(self.selector) != "outer":
            raise TypeError("as_node() takes a selector of elements")
        if verdict.node_identity(self.selector) == (None, True):
            raise TypeError("as_node() of what may be a part of the document's frame that the page left out, which has no source of its own: name the element")
        return replace(self, node=True)

    def as_value(self) -> "Field":
        """The element's source, as without as_node()."""
        return replace(self, node=False)


def field(selector: str, *, all: bool = False, join: str | None = None, out: list | None = None, cached: bool = False, meta: dict | None = None) -> Any:  # noqa: A002
    if all and join is not None:
        raise TypeError("a field is a list or joined, not both")
    return Field(selector, all, join, None if out is None else tuple(out), cached, meta or {})


class Many:
    """Rows, one for each container; ``item``: a dataclass whose fields name (and order) the columns."""

    one = False

    def __init__(self, container: str, *, item: type | None = None, **subs: Any) -> None:
        for name, sub in subs.items():
            if isinstance(sub, Field) and (sub.out is not None or sub.cached or sub.meta or sub.node):
                raise TypeError(f"{name}: out, cached, meta and as_node() aren't for fields of a group")
        if item is not None:
            if not is_dataclass(item):
                raise TypeError("item is a dataclass")
            names = [f.name for f in data_fields(item)]
            if missing := [n for n in subs if n not in names]:
                raise TypeError(f"{item.__name__} has no field {missing[0]!r}")
            subs = {n: subs[n] for n in names if n in subs}
        self.container, self.item, self.subs = container, item, subs

    def spec(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for name, sub in self.subs.items():
            if isinstance(sub, Field):
                out[name] = (sub.selector, "join", sub.join) if sub.join is not None else (sub.selector, "all" if sub.all else "first")
            else:
                out[name] = sub
        return out

    def maps(self) -> dict[str, tuple]:
        return {n: s.maps for n, s in self.subs.items() if isinstance(s, Field) and s.maps}


class One(Many):
    one = True


def _mapped(g: Many, maps: dict[str, tuple]) -> Callable[[Column], Column]:
    def build(r: Column) -> Column:
        values = []
        for n in g.spec():
            v = r.getField(n)
            for fn in maps.get(n, ()):
                v = fn(v)
            values.append(v.alias(n))
        return F.struct(*values)

    return build


NODE = T.StructType([T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("string", T.StringType()), T.StructField("source", T.StringType())])


_ARROW_NODE = pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("string", pa.string()), ("source", pa.string())])


def _node(source: str | None, tag: str | None = None) -> dict | None:
    """The element of a source slice: the one named ``tag``, which a part of the frame that the page left out doesn't begin with, or the first."""
    if source is None:
        return None
    t: Tree = parse(source if tag in FRAME else f"<html><body>{source}")
    found = (k for k, made in enumerate(t.made) if (t.tag[k] == tag if tag is not None else not made and t.tag[k] not in FRAME))
    i = next(found, None)
    return None if i is None else {"tag": t.tag[i], "attrs": list(t.attributes(i).items()), "string": t.string(i), "source": source}


def _node_column(tag: str | None, many: bool) -> Callable[[Column], Column]:
    """Sources to elements, a batch at a time."""
    if many:
        return F.arrow_udf(lambda rows: pa.array([None if r is None else [_node(s, tag) for s in r] for r in rows.to_pylist()], pa.list_(_ARROW_NODE)), T.ArrayType(NODE))
    return F.arrow_udf(lambda rows: pa.array([_node(s, tag) for s in rows.to_pylist()], _ARROW_NODE), NODE)


class PageObject:
    """Base of declared schemas. ``Processors`` may hold lists of Column functions by field name; a subclass's own come first."""

    _fields: dict[str, tuple[type, Field]] = {}
    _groups: dict[str, Many] = {}
    _page: Page

    def __init_subclass__(cls, strict: bool = True, **rest: Any) -> None:
        super().__init_subclass__(**rest)
        fields: dict[str, tuple[type, Field]] = {}
        groups: dict[str, Many] = {}
        for base in reversed(cls.__mro__):
            for name, value in vars(base).items():
                if isinstance(value, (Field, Many)):
                    fields.pop(name, None)
                    groups.pop(name, None)
                    if isinstance(value, Field):
                        fields[name] = (base, value)
                    else:
                        groups[name] = value
                elif not name.startswith("_"):
                    fields.pop(name, None)
                    groups.pop(name, None)
        cls._fields, cls._groups = fields, groups
        page = Page(strict=strict)
        for name, (base, f) in fields.items():
            processors = cls._processors(name, base, f)
            maps = (*f.maps, *processors)
            if f.node and f.maps:
                raise TypeError(f"{name}: what is done to an element behind as_node() belongs into out")
            if f.node is None and processors and verdict.terminals(f.selector) == "outer":
                raise TypeError(f"{name} selects an element and has processors: say as_node() or as_value(), or decline them with out=[]")
            if f.type is not None and isinstance(f.type, (T.DataType, str)):
                maps = (*maps, lambda c, kind=f.type: c.cast(kind))
            if f.node:
                maps = (_node_column(verdict.node_identity(f.selector)[0], f.all), *maps)
            if f.join is not None:
                page.field_join(name, f.selector, f.join, map=list(maps))
            elif f.all:
                page.field_all(name, f.selector, map=list(maps))
            else:
                page.field(name, f.selector, map=list(maps))
        for name, g in groups.items():
            (page.one if g.one else page.many)(name, g.container, g.spec())
        cls._page = page

    @classmethod
    def _processors(cls, name: str, base: type, f: Field) -> tuple:
        if f.out is not None:
            return f.out
        for owner in cls.__mro__[cls.__mro__.index(base) :]:
            held = vars(owner).get("Processors")
            if held is not None and hasattr(held, name):
                return tuple(getattr(held, name))
        return ()

    @classmethod
    def schema(cls) -> dict[str, Any]:
        return {"fields": [(n, f.selector) for n, (_, f) in cls._fields.items()], "groups": [(n, g.container, [(k, s[0] if isinstance(s, tuple) else s) for k, s in g.spec().items()]) for n, g in cls._groups.items()]}

    @classmethod
    def check(cls) -> verdict.SchemaReport:
        return cls._page.check()

    @classmethod
    def page_input(cls, df: DataFrame) -> tuple[str | Column, str | Column | None]:
        """The page's column and its encoding's; override it for other sources."""
        return ("body", "charset") if "body" in df.columns else ("html", None)

    @classmethod
    def select_from(cls, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        html, label = cls.page_input(df)
        keep = [c for c in df.columns if c not in (html, label)] if keep is None and isinstance(html, str) else keep
        out = cls._page.select(df, html, label, keep)
        for name, g in cls._groups.items():
            maps = g.maps()
            if maps:
                build = _mapped(g, maps)
                out = out.withColumn(name, F.when(F.col(name).isNotNull(), build(F.col(name))) if g.one else F.transform(F.col(name), build))
        for name, (_, f) in cls._fields.items():
            if f.meta:
                out = out.withMetadata(name, f.meta)
        return out

    @classmethod
    def to_item(cls, html: bytes | str, encoding: str | None = None) -> dict[str, Any]:
        """One page's raw values without Column transformations."""
        item = cls._page.extract(html, encoding)
        out: dict[str, Any] = {}
        for name, (_, f) in cls._fields.items():
            values = item.get_all(name)
            out[name] = f.join.join(values) if f.join is not None else values if f.all else item.get(name)
        return {**out, **{n: item.value(n) for n in cls._groups}}
