"""All of a schema's selectors over one parsed page: plans become closures once, pages are parsed once."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from dataclasses import replace

from pageloom.operators.tree import Tree, fold, parse
from pageloom.plans.ir import ADJACENT, CHILD, DESCENDANT, Attr, Compound, Member, Query

_TOKENS = re.compile(r"[^ \t\n\f\r]+")
Test = Callable[[Tree, int], bool]


def _attribute(a: Attr) -> Test:
    name, op = a.name, a.op
    value = fold(a.value) if a.fold else a.value
    if not op:
        return lambda t, i: name in t.attributes(i)
    if op in ("^=", "$=", "*=") and not value:
        return lambda t, i: False
    tests: dict[str, Callable[[str], bool]] = {
        "=": lambda v: v == value,
        "^=": lambda v: v.startswith(value),
        "$=": lambda v: v.endswith(value),
        "*=": lambda v: value in v,
        "~=": lambda v: value in _TOKENS.findall(v),
        "|=": lambda v: v == value or v.startswith(value + "-"),
    }
    test = tests[op]

    def holds(t: Tree, i: int) -> bool:
        v = t.attributes(i).get(name)
        return v is not None and test(fold(v) if a.fold else v)

    return holds


def _always(t: Tree, i: int) -> bool:
    return True


def compound(c: Compound, tag_known: bool = False) -> Test:
    """Whether an element satisfies a compound."""
    tests: list[Test] = []
    if c.tag is not None and not tag_known:
        tests.append(lambda t, i: t.tag[i] == c.tag)
    if c.ids:
        ids = set(c.ids)
        tests.append((lambda t, i: t.attributes(i).get("id") == c.ids[0]) if len(ids) == 1 else (lambda t, i: False))
    for name in c.classes:
        tests.append(lambda t, i, name=name: name in t.attributes(i).get("class", "") and name in _TOKENS.findall(t.attributes(i)["class"]))
    tests += [_attribute(a) for a in c.attrs]
    if c.position is not None:
        p = c.position
        if p.only:
            tests.append(lambda t, i: t.siblings(i, p.same) == 1)
        elif p.back:
            tests.append(lambda t, i: p.holds(t.siblings(i, p.same) - (t.kind if p.same else t.child)[i] + 1))
        else:
            tests.append(lambda t, i: p.holds((t.kind if p.same else t.child)[i]))
    for inner in c.nots:
        no = compound(inner)
        tests.append(lambda t, i, no=no: not no(t, i))
    for members in c.either:
        any_of = [compound(m) for m in members]
        tests.append(lambda t, i, any_of=any_of: any(m(t, i) for m in any_of))
    if c.has is not None:
        inside = [(m.tag, compound(m, m.tag is not None)) for m in c.has.members]

        def marked(t: Tree) -> tuple[set[int], list[int]]:
            """Parents of elements that match, and how many match before each place; made once for a page."""
            found = t.cache.get(id(inside))
            if found is None:
                hit = {j for tag, m in inside for j in (t.by_tag(tag) if tag is not None else range(len(t.tag))) if m(t, j)}
                upto = [0]
                for j in range(len(t.tag)):
                    upto.append(upto[-1] + (j in hit))
                found = t.cache[id(inside)] = ({t.parent[j] for j in hit}, upto)
            return found

        if c.has.child:
            tests.append(lambda t, i: i in marked(t)[0])
        else:
            tests.append(lambda t, i: (upto := marked(t)[1])[t.last[i] + 1] > upto[i + 1])
    if c.text is not None:
        x = c.text
        if not x.direct:
            tests.append((lambda t, i: x.value in t.string(i)) if x.kind == "contains" else (lambda t, i: t.string(i) == x.value))
        elif x.kind == "equals":
            tests.append(lambda t, i: any(t.value[k] == x.value for k in t.texts(i)))
        else:
            tests.append(lambda t, i: x.value in (t.value[t.texts(i)[0]] if t.texts(i) else ""))
    if not tests:
        return _always
    if len(tests) == 1:
        return tests[0]
    return lambda t, i: all(test(t, i) for test in tests)


class Plan:
    """One member: which elements match, within a context (``scope``: an element's id, -1 for the page)."""

    def __init__(self, m: Member) -> None:
        self.member = m
        self.tests = [compound(c) for c in m.compounds]
        c = m.compounds[-1]
        # the rarest kind of index that the subject allows; what it tells isn't tested again
        if c.ids:
            self.index, self.name = "by_id", c.ids[0]
            c = replace(c, ids=c.ids[1:] if len(set(c.ids)) > 1 else ())
            self.subject = compound(replace(c, ids=()) if not c.ids else m.compounds[-1])
        elif c.classes:
            self.index, self.name = "by_class", c.classes[0]
            self.subject = compound(replace(c, classes=c.classes[1:]))
        elif c.tag is not None:
            self.index, self.name = "by_tag", c.tag
            self.subject = compound(c, True)
        else:
            self.index, self.name = None, ""
            self.subject = compound(c)

    def elements(self, t: Tree, scope: int = -1) -> list[int]:
        found: Iterable[int] = getattr(t, self.index)(self.name) if self.index is not None else range(len(t.tag))
        if scope >= 0:
            end = t.last[scope]
            found = found[bisect_left(found, scope) : bisect_right(found, end)] if self.index is not None else range(scope, end + 1)
        simple = len(self.tests) == 1
        if simple and self.subject is _always and not self.member.absolute:
            if not self.member.strict:
                return list(found)
            return [i for i in found if i > scope] if scope >= 0 else [i for i in found if t.parent[i] >= 0]
        memo: dict = {}
        return [i for i in found if self.subject(t, i) and (self._first(t, i, scope) if simple else self._behind(t, i, len(self.tests) - 1, scope, memo))]

    def _first(self, t: Tree, i: int, scope: int) -> bool:
        """Whether the chain may begin at this element."""
        if self.member.absolute and t.parent[i] >= 0:
            return False
        if self.member.strict:
            return i > scope if scope >= 0 else t.parent[i] >= 0
        return True

    def _behind(self, t: Tree, i: int, k: int, scope: int, memo: dict) -> bool:
        """Whether compounds 0 .. k - 1 match before element ``i``, which compound ``k`` has matched."""
        if k == 0:
            return self._first(t, i, scope)
        comb, test = self.member.combs[k - 1], self.tests[k - 1]
        if comb in (DESCENDANT, CHILD):
            step = t.parent
        else:
            step = t.before
        j = step[i]
        once = comb in (CHILD, ADJACENT)
        passed = []
        answer = False
        while j >= 0 and j >= scope:
            key = (k, comb, j)
            if not once and (known := memo.get(key)) is not None:
                answer = known
                break
            if test(t, j) and self._behind(t, j, k - 1, scope, memo):
                answer = True
                if not once:
                    passed.append(key)
                break
            if once:
                break
            passed.append(key)
            j = step[j]
        for key in passed:
            memo[key] = answer
        return answer


def _space(text: str) -> str:
    return " ".join(re.findall(r"[^ \t\r\n]+", text))


def nodes(t: Tree, m: Member, found: list[int]) -> Iterable[tuple[tuple, str]]:
    """(place in document order, value) of each node that a member's terminal yields."""
    kind = m.terminal.kind
    if kind == "outer":
        return [((t.at[i],), t.source(i)) for i in found]
    if kind == "text":
        if m.terminal.subtree:
            taken: set[int] = set()
            upto = -1
            for i in found:
                if i > upto:  # inside the last one otherwise
                    taken.update(t.inner(i))
                    upto = t.last[i]
            return [((t.text_at[k],), t.value[k]) for k in taken]
        return [((t.text_at[k],), t.value[k]) for i in found for k in t.texts(i)]
    name = m.terminal.name
    if m.terminal.subtree:
        wide: dict[int, None] = {}
        upto = -1
        for i in found:
            if i > upto:
                wide.update(dict.fromkeys(range(i, t.last[i] + 1)))
                upto = t.last[i]
        found = list(wide)
    out = []
    for i in found:
        values = t.attributes(i)
        if name in values:
            out.append(((t.at[i], list(values).index(name)), values[name]))
    return out


class Column:
    """A compiled query: members' nodes as one list in document order, each node once."""

    def __init__(self, q: Query | None) -> None:
        self.plans = [Plan(m) for m in q.members] if q is not None else []
        self.scalar = bool(self.plans) and self.plans[0].member.terminal.scalar

    def values(self, t: Tree, scope: int = -1) -> list[str]:
        if not self.plans:
            return []
        if self.scalar:
            return [self._space(t)]
        if len(self.plans) == 1:
            plan = self.plans[0]
            found, terminal = plan.elements(t, scope), plan.member.terminal
            if terminal.kind == "outer":
                return [t.source(i) for i in found]
            if not terminal.subtree:
                if terminal.kind == "attr":
                    return [v for i in found if (v := t.attributes(i).get(terminal.name)) is not None]
                if len(found) == 1:
                    return [t.value[k] for k in t.texts(found[0])]
            return [v for _, v in sorted(nodes(t, plan.member, found))]
        every: dict[tuple, str] = {}
        for plan in self.plans:
            every.update(nodes(t, plan.member, plan.elements(t, scope)))
        return [every[k] for k in sorted(every)]

    def first(self, t: Tree) -> list[str]:
        """The first value, in a list, or nothing; an element that is still open has none yet, nor has anything behind it."""
        best: tuple | None = None
        for plan in self.plans:
            found = plan.elements(t)
            if found:
                # the first in document order is a value of one of the first elements, unless these hold none
                for place, value in sorted(nodes(t, plan.member, found)) if plan.member.terminal.kind != "outer" else nodes(t, plan.member, found[:1]):
                    if plan.member.terminal.kind == "outer" and t.end[found[0]] < 0:
                        return []
                    if best is None or place < best[0]:
                        best = (place, value)
                    break
        return [best[1]] if best else []

    def _space(self, t: Tree) -> str:
        plan = self.plans[0]
        found = plan.elements(t)
        if plan.member.terminal.kind == "outer":
            return _space(t.string(found[0])) if found else ""
        got = sorted(nodes(t, plan.member, found))
        return _space(got[0][1]) if got else ""


class Group:
    def __init__(self, holder: Member | None, fields: list[tuple[str, Member | None]]) -> None:
        self.holder = Plan(holder) if holder is not None else None
        self.names = [name for name, _ in fields]
        self.fields = [Column(Query("", (m,)) if m is not None else None) for _, m in fields]

    def rows(self, t: Tree) -> list[list[list[str]]]:
        if self.holder is None:
            return []
        return [[f.values(t, i) for f in self.fields] for i in self.holder.elements(t)]


def _early(q: Query | None) -> bool:
    """Whether a query's first value is final as soon as it is found."""
    return q is None or not any(m.terminal.scalar or any(_waits(c) for c in m.compounds) for m in q.members)


def _waits(c: Compound) -> bool:
    return c.late or any(_waits(x) for x in c.nots) or any(_waits(x) for xs in c.either for x in xs)


class Schema:
    """Compiled once, applied to every page. ``first_only``: one value of each column is wanted, so a page is read no further than it takes to
    find them all; not where there are groups, or tests that wait for an element's or its parent's end."""

    def __init__(self, columns: list[Query | None], groups: list[tuple[Member | None, list[tuple[str, Member | None]]]], first_only: bool = False) -> None:
        self.columns = [Column(q) for q in columns]
        self.groups = [Group(*g) for g in groups]
        self.early = first_only and bool(columns) and not groups and all(map(_early, columns))

    def _first(self, text: str) -> list[list[str]]:
        found: list[list[str]] = [[] for _ in self.columns]

        def enough(t: Tree) -> bool:
            for k, column in enumerate(self.columns):
                if not found[k]:
                    found[k] = column.first(t)
            return all(found)

        enough(parse(text, enough))
        return found

    def apply(self, text: str) -> tuple[list[list[str]], list[list[list[list[str]]]]]:
        if self.early:
            return self._first(text), []
        t = parse(text)
        return [c.values(t) for c in self.columns], [g.rows(t) for g in self.groups]
