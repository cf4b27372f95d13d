"""CSS selectors with value terminals to plans."""

from __future__ import annotations

import re

from pageloom.plans.ir import ADJACENT, CHILD, DESCENDANT, GENERAL, Attr, Compound, Has, Member, Position, Terminal, TextTest, Unsupported

_SPACE = " \t\n\f\r"
_START = r"(?:-?(?:[a-zA-Z_]|[^\x00-\x7f]))"
_IDENT = re.compile(rf"{_START}(?:[a-zA-Z0-9_-]|[^\x00-\x7f])*")
_HASH = re.compile(r"(?:[a-zA-Z0-9_-]|[^\x00-\x7f])+")
_NTH = re.compile(r"(?:([+-]?[0-9]*)[nN](?:[ \t]*([+-])[ \t]*([0-9]+))?|([+-]?[0-9]+))")
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})(?:\r\n|[ \t\n\r\f])?|(\r\n|[\n\r\f])|([\s\S]))")
_ATTR_TERMINAL = re.compile(r"::attr\(")
DEEPEST = 32

_LATE = {
    "last-child": Position(0, 1, False, True),
    "last-of-type": Position(0, 1, True, True),
    "only-child": Position(0, 1, False, False, True),
    "only-of-type": Position(0, 1, True, False, True),
    "first-child": Position(0, 1),
    "first-of-type": Position(0, 1, True),
}
_FUNCTIONS = {"nth-child": (False, False), "nth-of-type": (True, False), "nth-last-child": (False, True), "nth-last-of-type": (True, True)}


def unescape(text: str) -> str:
    def put(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"
        return "" if m[2] else m[3]

    return _ESCAPE.sub(put, text)


def split(text: str, sign: str = ",") -> list[str]:
    """Parts between ``sign`` outside of brackets, parentheses, quotes and escapes."""
    parts, depth, quote, begin, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == sign and depth <= 0:
            parts.append(text[begin:i])
            begin = i + 1
        i += 1
    return [*parts, text[begin:]]


class _Reader:
    def __init__(self, text: str) -> None:
        self.s, self.i = text, 0

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def blank(self) -> bool:
        begin = self.i
        while self.i < len(self.s) and self.s[self.i] in _SPACE:
            self.i += 1
        return self.i > begin

    def ident(self, what: str) -> str:
        m = _IDENT.match(self.s, self.i)
        if m is None:
            raise Unsupported(f"expected {what} at {self.s[self.i:self.i + 12]!r}")
        self.i = m.end()
        if self.peek() == "\\":
            raise Unsupported("escapes in names are unsupported")
        return m[0]

    def string(self) -> str:
        quote, begin = self.peek(), self.i + 1
        i = begin
        while i < len(self.s) and self.s[i] != quote:
            i += 2 if self.s[i] == "\\" else 1
        if i >= len(self.s):
            raise Unsupported("unterminated string")
        self.i = i + 1
        return unescape(self.s[begin:i])

    def argument(self) -> str:
        """The text between the parentheses that begin here."""
        depth, quote, begin = 0, "", self.i + 1
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\":
                self.i += 1
            elif quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if not depth:
                    self.i += 1
                    return self.s[begin : self.i - 1]
            self.i += 1
        raise Unsupported("unterminated parenthesis")


def _attribute(r: _Reader) -> Attr:
    r.i += 1
    r.blank()
    name = r.ident("an attribute name")
    if r.peek() == "|" and r.s[r.i : r.i + 2] != "|=":
        raise Unsupported("namespaces are unsupported")
    r.blank()
    name = name.translate({c: c + 32 for c in range(65, 91)})
    if r.peek() == "]":
        r.i += 1
        return Attr(name)
    op = r.s[r.i : r.i + 2] if r.peek() in tuple("^$*~|") else r.peek()
    if op not in ("=", "^=", "$=", "*=", "~=", "|="):
        raise Unsupported(f"unknown attribute operator {op!r}")
    r.i += len(op)
    r.blank()
    if r.peek() in ("'", '"'):
        value = r.string()
    else:
        value = r.ident("a quoted value or a name")
    spaced = r.blank()
    flag = ""
    if r.peek() != "]":
        flag = r.peek()
        if not spaced or flag not in ("i", "I", "s", "S"):
            raise Unsupported("unknown attribute flag")
        r.i += 1
        r.blank()
    if r.peek() != "]":
        raise Unsupported("expected ']'")
    r.i += 1
    return Attr(name, op, value, flag in ("i", "I"))


def nth(text: str) -> tuple[int, int]:
    text = text.strip(_SPACE).lower()
    if text in ("odd", "even"):
        return 2, int(text == "odd")
    m = _NTH.fullmatch(text)
    if m is None:
        raise Unsupported(f"not a position: {text!r}")
    if m[4] is not None:
        return 0, int(m[4])
    a = {"": 1, "+": 1, "-": -1}.get(m[1])
    return int(m[1]) if a is None else a, int(f"{m[2]}{m[3]}") if m[2] else 0


def _simple(text: str, depth: int, what: str) -> Compound:
    """An argument that is one compound."""
    text = text.strip(_SPACE)
    if not text:
        raise Unsupported(f"empty member in {what}")
    r = _Reader(text)
    out = _compound(r, depth + 1)
    if r.i < len(text):
        raise Unsupported(f"a combinator inside {what} is unsupported")
    return out


def _compound(r: _Reader, depth: int = 0) -> Compound:
    if depth > DEEPEST:
        raise Unsupported("nested too deeply")
    begin, tag = r.i, None
    ids, classes, attrs, nots, either = [], [], [], [], []
    position = has = text = None
    if r.peek() == "*":
        r.i += 1
    elif _IDENT.match(r.s, r.i):
        tag = r.ident("a tag")
        if not tag.isascii():
            raise Unsupported("a tag that is not ASCII is unsupported")
        tag = tag.lower()
    if r.peek() == "|":
        raise Unsupported("namespaces are unsupported")
    while c := r.peek():
        if c == ".":
            r.i += 1
            classes.append(r.ident("a class"))
        elif c == "#":
            r.i += 1
            m = _HASH.match(r.s, r.i)
            if m is None:
                raise Unsupported("expected an id")
            r.i = m.end()
            if r.peek() == "\\":
                raise Unsupported("escapes in names are unsupported")
            ids.append(m[0])
        elif c == "[":
            attrs.append(_attribute(r))
        elif c == ":" and r.s[r.i : r.i + 2] != "::":
            r.i += 1
            name = r.ident("a pseudo-class").lower()
            argument = r.argument() if r.peek() == "(" else None
            where: Position | None = None
            if argument is None and name in _LATE:
                where = _LATE[name]
            elif argument is not None and name in _FUNCTIONS:
                where = Position(*nth(argument), *_FUNCTIONS[name])
            elif argument is not None and name == "not":
                for part in split(argument):
                    inner = _simple(part, depth, ":not()")
                    if inner.nots or inner.either:
                        raise Unsupported(":not() and :is() inside :not() are unsupported")
                    if inner.late:
                        raise Unsupported("this pseudo-class inside :not() is unsupported")
                    nots.append(inner)
            elif argument is not None and name in ("is", "where"):
                members = tuple(_simple(part, depth, f":{name}()") for part in split(argument))
                if any(m.position or m.has or m.text or m.either for m in members):
                    raise Unsupported(f"positions, :has(), :contains() and :is() inside :{name}() are unsupported")
                either.append(members)
            elif argument is not None and name == "has":
                if has is not None or position is not None:
                    raise Unsupported("two :has(), or :has() after a position, are unsupported")
                if text is not None:
                    raise Unsupported(":has() beside :contains() is unsupported")
                members, child = [], None
                for part in split(argument):
                    part = part.strip(_SPACE)
                    own = part.startswith(">")
                    if child is not None and own != child:
                        raise Unsupported("a :has() list that mixes relations is unsupported")
                    child = own
                    inner = _simple(part[1:] if own else part, depth, ":has()")
                    if inner.position or inner.has or inner.text or inner.either:
                        raise Unsupported("this pseudo-class inside :has() is unsupported")
                    members.append(inner)
                has = Has(tuple(members), bool(child))
            elif argument is not None and name == "contains":
                if text is not None:
                    raise Unsupported("a second :contains() on an element is unsupported")
                inner = _Reader(argument)
                inner.blank()
                value = inner.string() if inner.peek() in ("'", '"') else inner.ident("a string or a name")
                inner.blank()
                if inner.i < len(argument):
                    raise Unsupported(":contains() takes one string or name")
                text = TextTest("contains", value)
            else:
                raise Unsupported(f"unknown pseudo-class :{name}")
            if where is not None:
                if position is not None:
                    raise Unsupported("two positions on an element are unsupported")
                if where.same and tag is None:
                    raise Unsupported("a position of its type needs a tag")
                position = where
        elif c == "\\":
            raise Unsupported("escapes in names are unsupported")
        else:
            break
    if r.i == begin:
        raise Unsupported(f"expected a selector at {r.s[r.i:r.i + 12]!r}")
    if text is not None and (has is not None or (position is not None and position.late)):
        raise Unsupported(":contains() beside :has() or a position from the end is unsupported")
    if has is not None and position is not None and position.late:
        raise Unsupported(":has() beside a position from the end is unsupported")
    return Compound(tag, tuple(ids), tuple(classes), tuple(attrs), tuple(nots), tuple(either), position, has, text)


def _terminal(text: str) -> tuple[str, Terminal | None, bool]:
    """(what comes before the terminal, terminal, whether a blank stands between)."""
    if text.endswith("::text"):
        head, found = text[:-6], Terminal("text")
    else:
        at = text.rfind("::attr(")
        if at < 0 or not text.endswith(")"):
            return text, None, False
        r = _Reader(text[at + 6 :])
        name = r.argument()
        if r.i < len(r.s):
            return text, None, False
        name = name.strip(_SPACE)
        if len(name) > 1 and name[0] in "\"'" and name[-1] in "\"'":
            name = name[1:-1]
        name = unescape(name)
        first = name.removeprefix("-")[:1]
        if not first or first in "-0123456789" or any(c in _SPACE + "\"'()[]" for c in name):
            raise Unsupported("::attr() takes the name of an attribute")
        head, found = text[:at], Terminal("attr", name.translate({c: c + 32 for c in range(65, 91)}))
    return head, found, bool(head) and head[-1] in _SPACE


def member(text: str) -> Member:
    text = text.strip(_SPACE)
    if not text:
        raise Unsupported("an empty query is unsupported")
    head, terminal, spaced = _terminal(text)
    head = head.rstrip(_SPACE)
    if "::" in re.sub(r"\"[^\"]*\"|'[^']*'", "", head):
        raise Unsupported("unknown pseudo-element")
    if terminal is None:
        terminal = Terminal("outer")
    compounds, combs = [], []
    r = _Reader(head)
    implicit = not head
    r.blank()
    while r.i < len(head):
        compounds.append(_compound(r))
        spaced_here = r.blank()
        if r.i >= len(head):
            break
        c = r.peek()
        if c in (CHILD, ADJACENT, GENERAL):
            r.i += 1
            r.blank()
            if r.peek() in (CHILD, ADJACENT, GENERAL):
                raise Unsupported("two combinators in a row")
            combs.append(c)
            if r.i >= len(head):
                implicit = True
        elif spaced_here:
            combs.append(DESCENDANT)
        else:
            raise Unsupported(f"unexpected {c!r}")
    if implicit:
        if terminal.kind == "outer":
            raise Unsupported("a combinator without a selector behind it")
        # an attached universal of its own: its own values, not its subtree's
        compounds.append(Compound())
        return Member(tuple(compounds), tuple(combs), terminal)
    if terminal.kind != "outer":
        universal = compounds[-1] == Compound() and head.endswith("*")
        if spaced:
            if universal and len(compounds) == 1:
                terminal = Terminal(terminal.kind, terminal.name, True)
            else:
                terminal = Terminal(terminal.kind, terminal.name, True)
        elif universal and combs and combs[-1] == DESCENDANT:
            # "div *::text" takes all that the div holds
            return Member(tuple(compounds[:-1]), tuple(combs[:-1]), Terminal(terminal.kind, terminal.name, True))
    return Member(tuple(compounds), tuple(combs), terminal)


def compile(text: str) -> tuple[Member, ...]:  # noqa: A001
    return tuple(member(part) for part in split(text))
