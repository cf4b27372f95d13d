"""Which queries run: the one place that decides it, for execution and audit alike."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pageloom.plans import css, xpath
from pageloom.plans.ir import ADJACENT, CHILD, DESCENDANT, GENERAL, Member, Query, Unsupported

MAX_MEMBERS, MAX_SIBLINGS = 128, 64
SIBLINGS = (ADJACENT, GENERAL)


class UnsupportedSelector(ValueError):
    """A schema holds selectors that can't be answered faithfully."""


def parse(query: str) -> Query:
    text = query.strip()
    if xpath.is_xpath(text):
        return Query(query, xpath.compile(text), True)
    return Query(query, css.compile(query))


def _single(m: Member) -> None:
    """Refuses shapes in which a test that is decided late can't be combined."""
    late = [i for i, c in enumerate(m.compounds) if c.late]
    if not late:
        return
    if len(late) > 1:
        raise Unsupported("more than one element with :has(), a test of text or a position from the end")
    if m.terminal.scalar:
        raise Unsupported("normalize-space() of such an element is unsupported")
    i = late[0]
    c = m.compounds[i]
    back = c.position is not None and c.position.late
    borders = [k for k, comb in enumerate(m.combs) if comb in SIBLINGS]
    if borders:
        if len(borders) > 1 or borders[0] != i or back:
            raise Unsupported("a sibling combinator beside :has(), a test of text or a position from the end")
        return
    if i < len(m.compounds) - 1:
        if m.combs[i] != DESCENDANT:
            raise Unsupported("a child step behind :has(), a test of text or a position from the end; use a descendant step")
    elif back and m.terminal.kind == "outer":
        raise Unsupported("a position from the end needs a value (::text, ::attr())")


def flat(query: str) -> Query:
    q = parse(query)
    outer = sum(m.terminal.kind == "outer" for m in q.members)
    if outer not in (0, len(q.members)):
        raise Unsupported("a group that mixes elements and values")
    if len(q.members) == 1:
        _single(q.members[0])
        return q
    tested = False
    for m in q.members:
        late = [c for c in m.compounds if c.late]
        if any(c.has or c.position and c.position.late for c in late):
            raise Unsupported(":has() or a position from the end in a group")
        if late:
            tested = True
            if len(late) > 1 or not m.compounds[-1].late or any(comb in SIBLINGS for comb in m.combs):
                raise Unsupported("a test of text in a group must be on the element whose value is taken")
    if tested:
        kinds = {(m.terminal.kind, m.terminal.name) for m in q.members}
        if len(kinds) > 1 or outer or any(m.terminal.subtree for m in q.members):
            raise Unsupported("a group with a test of text takes its elements' own values of one kind")
    return q


def _one(query: str) -> Member:
    q = parse(query)
    if len(q.members) != 1 or q.members[0].terminal.scalar:
        raise Unsupported("a group's selector is a single one")
    if any(c.late for c in q.members[0].compounds):
        raise Unsupported("selector needs a test that is decided when the element ends, which groups don't support")
    return q.members[0]


def container(query: str) -> Member:
    m = _one(query)
    if m.terminal.kind != "outer":
        raise Unsupported("a container is an element, not a value")
    return m


def subfield(query: str) -> Member:
    m = _one(query)
    if any(c in SIBLINGS for c in m.combs):
        raise Unsupported("a sibling combinator inside a group's field is unsupported")
    return m


def terminals(query: str) -> str | None:
    """text, attr, outer, normalize-space; None where unsupported or mixed."""
    try:
        q = flat(query)
    except Unsupported:
        return None
    kinds = {"normalize-space" if m.terminal.scalar else m.terminal.kind for m in q.members}
    return kinds.pop() if len(kinds) == 1 else None


def node_identity(query: str) -> tuple[str | None, bool]:
    """(tag that every result has or None, whether a result may be a part of the document's frame that the page left out); (None, True), which
    promises nothing, for a query that isn't supported."""
    try:
        q = flat(query)
    except (Unsupported, RecursionError):
        return None, True
    tags = {m.compounds[-1].tag for m in q.members}
    tag = tags.pop() if len(tags) == 1 else None
    return tag, any(m.compounds[-1].tag in (None, "html", "head", "body") and not (m.compounds[-1].attrs or m.compounds[-1].ids or m.compounds[-1].classes) for m in q.members)


@dataclass(frozen=True)
class FieldReport:
    name: str
    selector: str
    supported: bool
    reason: str | None = None

    def __str__(self) -> str:
        return f"ok           {self.name}: {self.selector}" if self.supported else f"unsupported  {self.name}: {self.selector} ({self.reason})"


@dataclass(frozen=True)
class GroupReport:
    name: str
    container: FieldReport
    subfields: list[FieldReport] = field(default_factory=list)

    def unsupported(self) -> list[FieldReport]:
        return [f for f in (self.container, *self.subfields) if not f.supported]


@dataclass(frozen=True)
class SchemaReport:
    fields: list[FieldReport]
    groups: list[GroupReport]
    members: int
    max_members: int
    sib_bits: int
    max_sib_bits: int

    @property
    def over_budget(self) -> bool:
        return self.members > self.max_members or self.sib_bits > self.max_sib_bits

    @property
    def unsupported(self) -> list[FieldReport]:
        return [*(f for f in self.fields if not f.supported), *(f for g in self.groups for f in g.unsupported())]

    @property
    def ok(self) -> bool:
        return not self.over_budget and not self.unsupported

    def raise_for_status(self) -> "SchemaReport":
        if bad := self.unsupported:
            raise UnsupportedSelector("; ".join(map(str, bad)))
        if self.over_budget:
            raise ValueError(f"{self.members} selectors and {self.sib_bits} sibling steps; at most {self.max_members} and {self.max_sib_bits}")
        return self

    def rows(self) -> list[tuple]:
        """(group, name, selector, supported, reason) of everything in the schema."""
        out = [(None, f.name, f.selector, f.supported, f.reason) for f in self.fields]
        return out + [(g.name, f.name, f.selector, f.supported, f.reason) for g in self.groups for f in (g.container, *g.subfields)]

    def __str__(self) -> str:
        return "\n".join(str(f) for f in (*self.fields, *(f for g in self.groups for f in (g.container, *g.subfields))))


def _named(queries: object) -> list[tuple[str, str]]:
    if queries is None:
        return []
    if isinstance(queries, str):
        raise TypeError("queries is a mapping, a list of selectors or a list of (name, selector), not a string")
    if isinstance(queries, Mapping):
        items: Iterable = queries.items()
    else:
        items = [(q, q) if isinstance(q, str) else q for q in queries]
    out = []
    for item in items:
        if not (isinstance(item, (tuple, list)) and len(item) == 2 and isinstance(item[0], str)):
            raise TypeError(f"not a name and a selector: {item!r}")
        name, selector = item
        if isinstance(selector, (tuple, list)):
            selector = selector[0]
        if not isinstance(selector, str):
            raise TypeError(f"not a selector: {selector!r}")
        out.append((name, selector))
    return out


def groups_of(groups: object) -> list[tuple[str, str, list[tuple[str, str]]]]:
    if groups is None:
        return []
    items = [(name, *body) for name, body in groups.items()] if isinstance(groups, Mapping) else list(groups)
    out = []
    for k, item in enumerate(items):
        if isinstance(item, str) or not 2 <= len(item) <= 3:
            raise TypeError(f"not a container and its fields: {item!r}")
        name, holder, fields = item if len(item) == 3 else (f"group{k}", *item)
        if not isinstance(holder, str):
            raise TypeError(f"not a container: {holder!r}")
        out.append((name, holder, _named(fields)))
    return out


def _siblings(m: Member) -> int:
    return sum(c in SIBLINGS for c in m.combs)


def check(queries: object = None, groups: object = None) -> SchemaReport:
    """A report of what in a schema runs; nothing is read."""
    fields, held, members, siblings = [], [], 0, 0

    def verdict(name: str, selector: str, test: object) -> FieldReport:
        nonlocal members, siblings
        try:
            found = test(selector)
        except Unsupported as error:
            members += 1
            return FieldReport(name, selector, False, str(error))
        except RecursionError:
            members += 1
            return FieldReport(name, selector, False, "nested too deeply")
        own = found.members if isinstance(found, Query) else (found,)
        members += len(own)
        siblings += sum(map(_siblings, own))
        return FieldReport(name, selector, True)

    for name, selector in _named(queries):
        fields.append(verdict(name, selector, flat))
    for name, holder, subs in groups_of(groups):
        held.append(GroupReport(name, verdict("<container>", holder, container), [verdict(n, s, subfield) for n, s in subs]))
    return SchemaReport(fields, held, members, MAX_MEMBERS, siblings, MAX_SIBLINGS)


__all__ = ["CHILD", "DESCENDANT", "FieldReport", "GroupReport", "SchemaReport", "UnsupportedSelector", "check", "container", "flat", "node_identity", "parse", "subfield", "terminals"]
