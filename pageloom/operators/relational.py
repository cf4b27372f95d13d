"""Pages as relations of elements and text nodes, and selectors as joins over them.

A combinator is a semi-join: on the parent's id, on the sibling before, or on the interval of ids that an ancestor spans. All joins are
within a page, on its key. ``Relational`` joins rows of nodes: pages are parsed and exchanged once, and the relations kept. ``Nested`` answers one
query: each page holds its two relations as arrays and they are joined in its row, so nothing is exchanged or kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators.tree import Tree, class_names, parse
from pageloom.plans import verdict
from pageloom.plans.ir import ADJACENT, CHILD, DESCENDANT, Attr, Compound, Member, Position, Query
from pageloom.sources.encoding import column_label, text_of

NODE_TYPE = (
    "id int, at int, parent int, last int, depth int, tag string, attrs array<struct<name:string,value:string>>, classes array<string>, "
    "child int, children int, kind int, kinds int, before int, source string, made boolean"
)
TEXT_TYPE = "at int, owner int, value string"
_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_SCHEMA = pa.schema([
    ("id", pa.int32()), ("at", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", _ATTRS), ("classes", pa.list_(pa.string())),
    ("child", pa.int32()), ("children", pa.int32()), ("kind", pa.int32()), ("kinds", pa.int32()), ("before", pa.int32()), ("source", pa.string()), ("made", pa.bool_()),
])


def node_rows(html: str, source: bool = True) -> Iterator[tuple]:
    t = parse(html)
    depth: list[int] = []
    for i, tag in enumerate(t.tag):
        up = t.parent[i]
        depth.append(depth[up] + 1 if up >= 0 else 0)
        attrs = t.attributes(i)
        classes = class_names(attrs.get("class", ""))
        yield (
            i, t.at[i], up, t.last[i], depth[i], tag, [{"name": n, "value": v} for n, v in attrs.items()], classes,
            t.child[i], t.siblings(i, False), t.kind[i], t.siblings(i, True), t.before[i], t.source(i) if source else None, t.made[i],
        )


def text_rows(html: str) -> Iterator[tuple]:
    t = parse(html)
    yield from zip(t.text_at, t.owner, t.value)


#: Rows of nodes that are sent at once; a page's own all go together.
ROWS = 5000


def _relation(df: DataFrame, key: str, html: str, encoding: str | None, kind: str, rows: object, schema: pa.Schema) -> DataFrame:
    chosen = df.select(F.col(key).alias("page"), F.col(html).alias("html"), (F.lit(None).cast("string") if encoding is None else F.col(encoding)).alias("label"))
    page_type = dict(chosen.dtypes)["page"]

    def send(pages: list, counts: list[int], found: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*found), schema)]
        return pa.RecordBatch.from_arrays([pa.array(pages).take(pa.array(np.repeat(np.arange(len(pages)), counts))), *arrays], ["page", *schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, counts, found = [], [], []
            for page, h, label in zip(batch.column("page"), batch.column("html").to_pylist(), batch.column("label").to_pylist()):
                before = len(found)
                found += rows(text_of(h, None if isinstance(h, str) else column_label(label)))  # type: ignore[operator]
                pages.append(page)
                counts.append(len(found) - before)
                if len(found) >= ROWS:
                    yield send(pages, counts, found)
                    pages, counts, found = [], [], []
            if found:
                yield send(pages, counts, found)

    return chosen.mapInArrow(run, f"page {page_type}, {kind}")


def html_nodes(df: DataFrame, key: str = "page_id", html: str = "html", encoding: str | None = None, source: bool = False) -> DataFrame:
    """One row per element: page, and ``NODE_TYPE``; an element's descendants have ids from id + 1 to last. ``source``: with its markup."""
    return _relation(df, key, html, encoding, NODE_TYPE, lambda h: node_rows(h, source), _SCHEMA)


def html_texts(df: DataFrame, key: str = "page_id", html: str = "html", encoding: str | None = None) -> DataFrame:
    """One row per text node: page, and ``TEXT_TYPE``."""
    return _relation(df, key, html, encoding, TEXT_TYPE, text_rows, pa.schema([("at", pa.int32()), ("owner", pa.int32()), ("value", pa.string())]))


def attribute(name: str, attrs: Column | None = None) -> Column:
    """An attribute's value, null where the element lacks it."""
    attrs = F.col("attrs") if attrs is None else attrs
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0)).getField("value")


def _folded(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _attr(a: Attr, own: Callable[[str], Column]) -> Column:
    v = own(a.name)
    value = a.value
    if not a.op:
        return v.isNotNull()
    if a.op in ("^=", "$=", "*=") and not value:
        return F.lit(False)
    want = F.lit(value)
    if a.fold:
        v, want = _folded(v), _folded(want)
    found = {
        "=": lambda: v == want, "^=": lambda: F.startswith(v, want), "$=": lambda: F.endswith(v, want), "*=": lambda: F.contains(v, want),
        "~=": lambda: F.array_contains(F.split(v, "[ \t\n\f\r]+"), want) if value else F.lit(False), "|=": lambda: (v == want) | F.startswith(v, F.concat(want, F.lit("-"))),
    }[a.op]()
    return F.coalesce(found, F.lit(False))


def _position(p: Position, at: Callable[[str], Column]) -> Column:
    here, all_ = (at("kind"), at("kinds")) if p.same else (at("child"), at("children"))
    if p.only:
        return all_ == 1
    x = all_ - here + 1 if p.back else here
    if p.a == 0:
        return x == p.b
    return ((x - p.b) % p.a == 0) & ((x - p.b) / p.a >= 0)


def local(c: Compound, at: Callable[[str], Column] = F.col, own: Callable[[str], Column] = attribute) -> Column:
    """The part of a compound that an element's own row decides. ``at`` and ``own`` give an element's columns and attributes."""
    tests = [F.lit(True)]
    if c.tag is not None:
        tests.append(at("tag") == c.tag)
    tests += [F.coalesce(own("id") == i, F.lit(False)) for i in c.ids]
    tests += [F.array_contains(at("classes"), k) for k in c.classes]
    tests += [_attr(a, own) for a in c.attrs]
    if c.position is not None:
        tests.append(_position(c.position, at))
    tests += [~local(n, at, own) for n in c.nots]
    tests += [reduce(lambda a, b: a | b, [local(m, at, own) for m in either]) for either in c.either]
    return reduce(lambda a, b: a & b, tests)


class Relational:
    """Selectors over the two relations of a set of pages.

    Pages are parsed once: both relations are kept, by page, until ``close`` (or ``spark.catalog.clearCache()``); what an executor held that is
    lost is parsed again. ``keep=False`` reads them anew for each use.
    """

    def __init__(self, nodes: DataFrame, texts: DataFrame, keep: bool = True) -> None:
        self.nodes, self.texts = (x.repartition("page").persist(StorageLevel.MEMORY_AND_DISK) for x in (nodes, texts)) if keep else (nodes, texts)

    def close(self) -> None:
        self.nodes.unpersist()
        self.texts.unpersist()

    def _strings(self, nodes: DataFrame) -> DataFrame:
        """page, id and the text of the element and its descendants in order."""
        n, t = nodes.select("page", "id", "last").alias("n"), self.texts.alias("t")
        inside = n.join(t, (F.col("n.page") == F.col("t.page")) & F.col("t.owner").between(F.col("n.id"), F.col("n.last")))
        ordered = F.array_sort(F.collect_list(F.struct("t.at", "t.value")))
        return inside.groupBy("n.page", "n.id").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "").alias("string"))

    def _compound(self, c: Compound) -> DataFrame:
        found = self.nodes.where(local(c))
        if c.has is not None:
            inner = self.nodes.where(reduce(lambda a, b: a | b, [local(m) for m in c.has.members])).select(F.col("page").alias("ip"), F.col("id").alias("ii"), F.col("parent").alias("iup"))
            on = F.col("iup") == F.col("id") if c.has.child else (F.col("ii") > F.col("id")) & (F.col("ii") <= F.col("last"))
            found = found.join(inner, (F.col("ip") == F.col("page")) & on, "left_semi")
        if c.text is not None:
            x = c.text
            if not x.direct:
                value = F.coalesce("string", F.lit(""))
                joined = found.join(self._strings(found), ["page", "id"], "left")
                found = joined.where(F.contains(value, F.lit(x.value)) if x.kind == "contains" else value == x.value).drop("string")
            elif x.kind == "equals":
                own = self.texts.where(F.col("value") == x.value).select(F.col("page").alias("ip"), "owner")
                found = found.join(own, (F.col("ip") == F.col("page")) & (F.col("owner") == F.col("id")), "left_semi")
            else:
                first = self.texts.groupBy(F.col("page").alias("ip"), "owner").agg(F.min_by("value", "at").alias("first"))
                joined = found.join(first, (F.col("ip") == F.col("page")) & (F.col("owner") == F.col("id")), "left")
                found = joined.where(F.contains(F.coalesce("first", F.lit("")), F.lit(x.value))).drop("ip", "owner", "first")
        return found.select(*self.nodes.columns)

    def elements(self, m: Member) -> DataFrame:
        """Elements that a member matches."""
        found = self._compound(m.compounds[0])
        if m.absolute:
            found = found.where("parent < 0")
        if m.strict:
            found = found.where("parent >= 0")
        for comb, c in zip(m.combs, m.compounds[1:]):
            left = found.select(F.col("page").alias("lp"), F.col("id").alias("li"), F.col("last").alias("ll"), F.col("parent").alias("lup"))
            if comb == CHILD:
                on = F.col("parent") == F.col("li")
            elif comb == ADJACENT:
                on = F.col("before") == F.col("li")
            elif comb == DESCENDANT:
                on = (F.col("id") > F.col("li")) & (F.col("id") <= F.col("ll"))
            else:
                on = (F.col("parent") == F.col("lup")) & (F.col("id") > F.col("li"))
            found = self._compound(c).join(left, (F.col("lp") == F.col("page")) & on, "left_semi")
        return found

    def _values(self, m: Member) -> DataFrame:
        """page, at, sub (order among an element's attributes), value."""
        found, t = self.elements(m), m.terminal
        if t.kind == "outer":
            return found.select("page", "at", F.lit(0).alias("sub"), F.col("source").alias("value"))
        own = found.select(F.col("page").alias("fp"), F.col("id").alias("fi"), F.col("last").alias("fl"))
        if t.kind == "text":
            on = F.col("owner").between(F.col("fi"), F.col("fl")) if t.subtree else F.col("owner") == F.col("fi")
            return self.texts.join(own, (F.col("fp") == F.col("page")) & on, "left_semi").select("page", "at", F.lit(0).alias("sub"), "value")
        if t.subtree:
            found = self.nodes.join(own, (F.col("fp") == F.col("page")) & F.col("id").between(F.col("fi"), F.col("fl")), "left_semi")
        place = F.array_position(F.transform("attrs", lambda a: a["name"]), t.name).cast("int")
        return found.select("page", "at", place.alias("sub"), attribute(t.name).alias("value")).where("value is not null")

    def values(self, query: str) -> DataFrame:
        """page, ord (from 0, in document order) and value of each node that a query selects, each node once."""
        q = verdict.flat(query)
        if q.members[0].terminal.scalar:
            return self._space(q.members[0])
        found = reduce(DataFrame.unionByName, [self._values(m) for m in q.members])
        if len(q.members) > 1:
            found = found.dropDuplicates(["page", "at", "sub"])
        rows = F.array_sort(F.collect_list(F.struct("at", "sub", "value")))
        return found.groupBy("page").agg(rows.alias("rows")).select("page", F.posexplode("rows").alias("ord", "row")).select("page", "ord", F.col("row.value").alias("value"))

    def _space(self, m: Member) -> DataFrame:
        every = self.nodes.select("page").distinct()
        if m.terminal.kind == "outer":
            first = self.elements(m).groupBy("page").agg(F.min("id").alias("id"), F.min_by("last", "id").alias("last"))
            got = first.join(self._strings(first), ["page", "id"]).select("page", F.col("string").alias("value"))
        else:
            got = self._values(m).groupBy("page").agg(F.min_by("value", F.struct("at", "sub")).alias("value"))
        clean = F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), "[ \t\r\n]+", " "))
        return every.join(got, "page", "left").select("page", F.lit(0).alias("ord"), clean.alias("value"))

    def groups(self, container: str, subfields: dict[str, str]) -> DataFrame:
        """page, row (container's number, from 0) and an array of values per sub-field; containers without values keep their row."""
        holder = self.elements(verdict.container(container)).select("page", "id", "last")
        out = holder.select("page", F.col("id").alias("__id"))
        for name, selector in subfields.items():
            m = verdict.subfield(selector)
            inner = self._scoped(holder, m).select(F.col("page").alias("vp"), "holder", "at", "sub", "value")
            rows = F.array_sort(F.collect_list(F.struct("at", "sub", "value")))
            per = inner.groupBy("vp", "holder").agg(F.transform(rows, lambda x: x["value"]).alias(name))
            out = out.join(per, (out["page"] == per["vp"]) & (out["__id"] == per["holder"]), "left").drop("vp", "holder")
        empty = F.array().cast("array<string>")
        rows = F.array_sort(F.collect_list(F.struct("__id", *[F.coalesce(n, empty).alias(n) for n in subfields])))
        return out.groupBy("page").agg(rows.alias("rows")).select("page", F.posexplode("rows").alias("row", "r")).select("page", "row", *[F.col("r").getField(n).alias(n) for n in subfields])

    def _scoped(self, holder: DataFrame, m: Member) -> DataFrame:
        """page, holder and values of a member whose elements lie in a holder."""
        h = holder.select(F.col("page").alias("hp"), F.col("id").alias("holder"), F.col("last").alias("hl"))
        low = F.col("id") > F.col("holder") if m.strict else F.col("id") >= F.col("holder")
        found = self._compound(m.compounds[0]).join(h, (F.col("hp") == F.col("page")) & low & (F.col("id") <= F.col("hl"))).drop("hp", "hl")
        for comb, c in zip(m.combs, m.compounds[1:]):
            left = found.select(F.col("page").alias("lp"), F.col("id").alias("li"), F.col("last").alias("ll"), "holder").distinct()
            on = F.col("parent") == F.col("li") if comb == CHILD else (F.col("id") > F.col("li")) & (F.col("id") <= F.col("ll"))
            found = self._compound(c).join(left, (F.col("lp") == F.col("page")) & on).drop("lp", "li", "ll").dropDuplicates(["page", "id", "holder"])
        t = m.terminal
        if t.kind == "outer":
            return found.select("page", "holder", "at", F.lit(0).alias("sub"), F.col("source").alias("value"))
        own = found.select(F.col("page").alias("fp"), F.col("id").alias("fi"), F.col("last").alias("fl"), "holder")
        if t.kind == "text":
            on = F.col("owner").between(F.col("fi"), F.col("fl")) if t.subtree else F.col("owner") == F.col("fi")
            return self.texts.join(own, (F.col("fp") == F.col("page")) & on).select("page", "holder", "at", F.lit(0).alias("sub"), "value").distinct()
        if t.subtree:
            found = self.nodes.join(own, (F.col("fp") == F.col("page")) & F.col("id").between(F.col("fi"), F.col("fl"))).dropDuplicates(["page", "id", "holder"])
        place = F.array_position(F.transform("attrs", lambda a: a["name"]), t.name).cast("int")
        return found.select("page", "holder", "at", place.alias("sub"), attribute(t.name).alias("value")).where("value is not null")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class _Needs:
    """What queries ask of nodes: columns, attributes, and whether of texts."""

    def __init__(self, members: list[Member]) -> None:
        self.columns, self.attributes, self.texts = {"id", "at", "parent", "last"}, {}, False
        #: Tags of elements of which the markup is asked for; None: of any.
        self.sources: set[str | None] = set()
        #: Tags of the elements that compounds may match; "" stands for those with attributes, None for any.
        self.tags: set[str | None] = set()
        for m in members:
            for c in m.compounds:
                self._compound(c)
                self._kept(c)
                for inner in c.has.members if c.has is not None else ():
                    self._kept(inner)
            if m.terminal.kind == "attr" and m.terminal.subtree:
                self.tags.add("")
            if m.terminal.scalar:
                self.tags.add(None)
            if ADJACENT in m.combs:
                self.columns.add("before")
            if m.terminal.kind == "attr":
                self.attributes[m.terminal.name] = None
            elif m.terminal.kind == "text" or m.terminal.scalar:
                self.texts = True
            else:
                self.columns.add("source")
                self.sources.add(m.compounds[-1].tag)

    def _kept(self, c: Compound) -> None:
        self.tags.add(c.tag if c.tag is not None else "" if c.classes or c.ids or c.attrs else None)

    def _compound(self, c: Compound) -> None:
        self.columns |= {"tag"} if c.tag is not None else set()
        self.columns |= {"classes"} if c.classes else set()
        if c.position is not None:
            self.columns |= ({"kind", "kinds"} if c.position.same else {"child", "children"})
        self.attributes |= dict.fromkeys([a.name for a in c.attrs] + ["id"] * bool(c.ids))
        self.texts |= c.text is not None
        for inner in (*c.nots, *(m for either in c.either for m in either), *(c.has.members if c.has is not None else ())):
            self._compound(inner)


_INT = (T.IntegerType(), pa.int32())
#: Of elements of a tree, what its shape decides, by the columns of ``NODE_TYPE``.
_COLUMNS: dict[str, tuple[T.DataType, pa.DataType, Callable[[Tree, list[int]], list]]] = {
    "id": (*_INT, lambda t, ids: ids),
    "at": (*_INT, lambda t, ids: [t.at[i] for i in ids]),
    "parent": (*_INT, lambda t, ids: [t.parent[i] for i in ids]),
    "last": (*_INT, lambda t, ids: [t.last[i] for i in ids]),
    "before": (*_INT, lambda t, ids: [t.before[i] for i in ids]),
    "child": (*_INT, lambda t, ids: [t.child[i] for i in ids]),
    "children": (*_INT, lambda t, ids: [t.siblings(i, False) for i in ids]),
    "kind": (*_INT, lambda t, ids: [t.kind[i] for i in ids]),
    "kinds": (*_INT, lambda t, ids: [t.siblings(i, True) for i in ids]),
    "tag": (T.StringType(), pa.string(), lambda t, ids: [t.tag[i] for i in ids]),
}
_CLASSES = (T.ArrayType(T.StringType(), False), pa.list_(pa.field("element", pa.string(), False)), lambda t, ids: [class_names(t.attributes(i).get("class", "")) for i in ids])


def _places(t: Tree, tags: frozenset[str | None], names: tuple[str, ...]) -> list[list[int]]:
    """Ids of the elements with the tags ("": with attributes; None: all), and the columns of these names for them; kept with the tree's shape."""
    memo = t.memo()
    key = (tags, names)
    if (found := memo.get(key)) is None:
        if None in tags:
            ids = list(range(len(t.tag)))
        else:
            ids = sorted({i for tag in tags if tag for i in t.by_tag(tag)} | (set(t.attributed()) if "" in tags else set()))
        found = memo[key] = [ids, *[_COLUMNS[n][2](t, ids) for n in names]]
    return found


def _array(values: list[pa.Array], fields: list[pa.Field], ends: list[int]) -> pa.Array:
    rows = pa.StructArray.from_arrays(values, fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=pa.list_(pa.field("element", rows.type, False)))


class Nested:
    """Selectors over pages that hold their nodes and texts as arrays. Joins are loops within a page's row; the only work that grows with the
    number of pages is that of each page."""

    def __init__(self, df: DataFrame, key: str = "page_id", html: str = "html", encoding: str | None = None) -> None:
        self.df, self.key, self.html, self.encoding = df, F.col(key), F.col(html), F.lit(None).cast("string") if encoding is None else F.col(encoding)
        self.nodes, self.texts = F.col("tree.nodes"), F.col("tree.texts")
        self._names: dict[str, int] = {}

    def _pages(self, members: list[Member]) -> DataFrame:
        """page and tree: the columns of its nodes, and its texts, that the members need."""
        needs = _Needs(members)
        self._names = {name: k for k, name in enumerate(needs.attributes)}
        tags, names = frozenset(needs.tags), tuple(n for n in _COLUMNS if n in needs.columns)
        columns = [(n, *_COLUMNS[n]) for n in names]
        if "classes" in needs.columns:
            columns.append(("classes", *_CLASSES))
        for name, k in self._names.items():
            columns.append((f"a{k}", T.StringType(), pa.string(), lambda t, ids, name=name: [t.attributes(i).get(name) for i in ids]))
            if len(self._names) > 1:
                columns.append((f"p{k}", *_INT, lambda t, ids, name=name: [list(own).index(name) if name in (own := t.attributes(i)) else None for i in ids]))
        if "source" in needs.columns:
            sources = needs.sources
            columns.append(("source", T.StringType(), pa.string(), lambda t, ids: [t.source(i) if t.tag[i] in sources or None in sources else None for i in ids]))
        node = T.StructType([T.StructField(n, kind) for n, kind, _, _ in columns])
        text = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("owner", T.IntegerType()), T.StructField("value", T.StringType())])
        kind = T.StructType([T.StructField("nodes", T.ArrayType(node, False), False), T.StructField("texts", T.ArrayType(text, False), False)])
        fields = [pa.field(n, k) for n, _, k, _ in columns]
        text_fields = [pa.field("at", pa.int32()), pa.field("owner", pa.int32()), pa.field("value", pa.string())]
        fills, with_texts = [fill for *_, fill in columns[len(names) :]], needs.texts

        @F.arrow_udf(kind)
        def run(pages: pa.Array, labels: pa.Array) -> pa.Array:
            held: list[list] = [[] for _ in fields]
            said: list[list] = [[], [], []]
            node_ends, text_ends = [0], [0]
            for h, label in zip(pages.to_pylist(), labels.to_pylist()):
                t = parse(text_of(h, None if isinstance(h, str) else column_label(label)))
                ids, *own = _places(t, tags, names)
                for column, part in zip(held, own):
                    column.extend(part)
                for column, fill in zip(held[len(names) :], fills):
                    column.extend(fill(t, ids))
                if with_texts:
                    for column, part in zip(said, (t.text_at, t.owner, t.value)):
                        column.extend(part)
                node_ends.append(len(held[0]))
                text_ends.append(len(said[0]))
            arrays = [_array([pa.array(c, f.type) for c, f in zip(columns_, fields_)], fields_, ends) for columns_, fields_, ends in ((held, fields, node_ends), (said, text_fields, text_ends))]
            return pa.StructArray.from_arrays(arrays, fields=[pa.field(n, a.type, False) for n, a in zip(("nodes", "texts"), arrays)])

        return self.df.select(self.key.alias("page"), run(self.html, self.encoding).alias("tree"))

    def _own(self, n: Column) -> Callable[[str], Column]:
        return lambda name: n.getField(f"a{self._names[name]}")

    def _local(self, c: Compound, n: Column) -> Column:
        return local(c, n.getField, self._own(n))

    def _string(self, n: Column) -> Column:
        """The text of an element and its descendants in order."""
        inside = F.filter(self.texts, lambda t: (t["owner"] >= n["id"]) & (t["owner"] <= n["last"]))
        return F.array_join(F.transform(inside, lambda t: t["value"]), "")

    def _text(self, c: Compound, n: Column) -> Column:
        x = c.text
        if not x.direct:
            return F.contains(self._string(n), F.lit(x.value)) if x.kind == "contains" else self._string(n) == x.value
        if x.kind == "equals":
            return F.exists(self.texts, lambda t: (t["owner"] == n["id"]) & (t["value"] == x.value))
        first = F.get(F.filter(self.texts, lambda t: t["owner"] == n["id"]), F.lit(0)).getField("value")
        return F.contains(F.coalesce(first, F.lit("")), F.lit(x.value))

    def _compound(self, c: Compound, joined: Callable[[Column], Column]) -> Column:
        """Elements that match a compound and are joined with what lies before it."""

        def among(has: Callable[[Column], Column]) -> Column:
            test = lambda n: self._local(c, n) & joined(n) & has(n)
            return F.filter(self.nodes, (lambda n: test(n) & self._text(c, n)) if c.text is not None else test)

        if c.has is None:
            return among(lambda n: F.lit(True))
        inner = F.filter(self.nodes, lambda n: reduce(lambda a, b: a | b, [self._local(m, n) for m in c.has.members]))
        if c.has.child:
            return _let(F.transform(inner, lambda x: x["parent"]), lambda ups: among(lambda n: F.array_contains(ups, n["id"])))
        return _let(F.transform(inner, lambda x: x["id"]), lambda ids: among(lambda n: F.exists(ids, lambda i: (i > n["id"]) & (i <= n["last"]))))

    def _elements(self, m: Member, scope: Column | None = None) -> Column:
        """Elements that a member matches, in order; within ``scope``, an element, if there is one."""

        def begins(n: Column) -> Column:
            tests = [F.lit(True)]
            if m.absolute:
                tests.append(n["parent"] < 0)
            if scope is not None:
                tests += [n["id"] > scope["id"] if m.strict else n["id"] >= scope["id"], n["id"] <= scope["last"]]
            elif m.strict:
                tests.append(n["parent"] >= 0)
            return reduce(lambda a, b: a & b, tests)

        def step(found: Column, comb: str, c: Compound) -> Column:
            if comb in (CHILD, ADJACENT):
                to = "parent" if comb == CHILD else "before"
                return _let(F.transform(found, lambda x: x["id"]), lambda ids: self._compound(c, lambda n: F.array_contains(ids, n[to])))
            if comb == DESCENDANT:
                return _let(found, lambda left: self._compound(c, lambda n: F.exists(left, lambda x: (x["id"] < n["id"]) & (n["id"] <= x["last"]))))
            return _let(found, lambda left: self._compound(c, lambda n: F.exists(left, lambda x: (x["parent"] == n["parent"]) & (x["id"] < n["id"]))))

        found = self._compound(m.compounds[0], begins)
        for comb, c in zip(m.combs, m.compounds[1:]):
            found = step(found, comb, c)
        return found

    def _values(self, m: Member, scope: Column | None = None) -> Column:
        """at, sub (order among an element's attributes) and value of what a member selects, in order."""
        found, t = self._elements(m, scope), m.terminal
        row = lambda at, sub, value: F.struct(at.alias("at"), sub.cast("int").alias("sub"), value.alias("value"))
        if t.kind == "outer":
            return F.transform(found, lambda n: row(n["at"], F.lit(0), n["source"]))
        inside = lambda left, i: F.exists(left, lambda x: (x["id"] <= i) & (i <= x["last"]))
        if t.kind == "text":
            if t.subtree:
                own = _let(found, lambda left: F.filter(self.texts, lambda x: inside(left, x["owner"])))
            else:
                own = _let(F.transform(found, lambda x: x["id"]), lambda ids: F.filter(self.texts, lambda x: F.array_contains(ids, x["owner"])))
            return F.transform(own, lambda x: row(x["at"], F.lit(0), x["value"]))
        if t.subtree:
            found = _let(found, lambda left: F.filter(self.nodes, lambda n: inside(left, n["id"])))
        place = (lambda n: n.getField(f"p{self._names[t.name]}")) if len(self._names) > 1 else (lambda n: F.lit(0))
        return F.transform(F.filter(found, lambda n: self._own(n)(t.name).isNotNull()), lambda n: row(n["at"], place(n), self._own(n)(t.name)))

    def values(self, query: str) -> DataFrame:
        """As ``Relational.values``: page, ord and value."""
        q: Query = verdict.flat(query)
        pages = self._pages(list(q.members))
        if q.members[0].terminal.scalar:
            return self._space(pages, q.members[0])
        if len(q.members) == 1:
            rows = self._values(q.members[0])
        else:
            rows = F.sort_array(F.array_distinct(F.concat(*[self._values(m) for m in q.members])))
        return pages.select("page", F.posexplode(rows).alias("ord", "row")).select("page", "ord", F.col("row.value").alias("value"))

    def _space(self, pages: DataFrame, m: Member) -> DataFrame:
        first = F.get(F.transform(F.slice(self._elements(m), 1, 1), self._string), F.lit(0)) if m.terminal.kind == "outer" else F.get(self._values(m), F.lit(0)).getField("value")
        clean = F.trim(F.regexp_replace(F.coalesce(first, F.lit("")), "[ \t\r\n]+", " "))
        return pages.where(F.size(self.nodes) > 0).select("page", F.lit(0).alias("ord"), clean.alias("value"))

    def groups(self, container: str, subfields: dict[str, str]) -> DataFrame:
        """As ``Relational.groups``: page, row and an array of values per sub-field."""
        holder, members = verdict.container(container), {n: verdict.subfield(s) for n, s in subfields.items()}
        pages = self._pages([holder, *members.values()])
        row = lambda h: F.struct(*[F.transform(self._values(m, h), lambda x: x["value"]).alias(n) for n, m in members.items()])
        rows = F.transform(self._elements(holder), row)
        return pages.select("page", F.posexplode(rows).alias("row", "r")).select("page", "row", *[F.col("r").getField(n).alias(n) for n in subfields])
