"""The downward part of XPath to the same plans as CSS."""

from __future__ import annotations

import re
from dataclasses import replace
from itertools import product

from pageloom.plans.css import split
from pageloom.plans.ir import CHILD, DESCENDANT, GENERAL, Attr, Compound, Has, Member, Position, Terminal, TextTest, Unsupported

MOST = 32
_TAG = re.compile(r"[a-z_][a-z0-9_.-]*")
_NAME = re.compile(r"(?:[a-z_]|[^\x00-\x7f])(?:[a-z0-9_.-]|[^\x00-\x7f])*")
_LITERAL = r"(\"[^\"]*\"|'[^']*')"
_ATTR_TEST = re.compile(rf"@([^\s=(),\"'\]]+)\s*(?:=\s*{_LITERAL})?")
_FUNCTION = re.compile(rf"(contains|starts-with)\(\s*(\.|text\(\)|@[^\s=(),\"']+)\s*,\s*{_LITERAL}\s*\)")
_EQUALS = re.compile(rf"(\.|text\(\))\s*=\s*{_LITERAL}")
_LAST = re.compile(r"(?:position\(\)\s*=\s*)?last\(\)\s*(?:-\s*([0-9]+))?")


def is_xpath(query: str) -> bool:
    return query.startswith(("/", "./", "normalize-space("))


def _outside(text: str) -> str:
    """The text without its string literals."""
    return re.sub(r"\"[^\"]*\"|'[^']*'", '""', text)


def _attr_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise Unsupported(f"the attribute name {name!r} matches nothing: names are lower case and have no prefix")
    return name


def _words(text: str, word: str) -> list[str]:
    """Parts between the operator ``word`` outside of literals and parentheses."""
    parts, depth, quote, begin, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif not depth and text.startswith(word, i) and (i and text[i - 1] in " \t\n") and text[i + len(word) : i + len(word) + 1] in (" ", "\t", "\n"):
            parts.append(text[begin:i])
            begin = i = i + len(word)
            continue
        i += 1
    return [*parts, text[begin:]]


def _test(text: str) -> Attr | TextTest:
    text = text.strip()
    if m := _ATTR_TEST.fullmatch(text):
        return Attr(_attr_name(m[1]), "=" if m[2] else "", m[2][1:-1] if m[2] else "")
    if m := _FUNCTION.fullmatch(text):
        value = m[3][1:-1]
        if m[2].startswith("@"):
            return Attr(_attr_name(m[2][1:]), "*=" if m[1] == "contains" else "^=", value)
        if m[1] == "contains":
            return TextTest("contains", value, m[2] != ".")
    if m := _EQUALS.fullmatch(text):
        return TextTest("equals", m[2][1:-1], m[1] != ".")
    raise Unsupported(f"the predicate [{text}] is unsupported")


def _predicates(parts: list[str], tag: str | None) -> list[Compound]:
    """Alternatives of a step, one for each way through its predicates' ``or``."""
    alone = len(parts) == 1
    options: list[list[tuple]] = []
    for part in parts:
        part = part.strip()
        if re.fullmatch(r"[0-9]+", part) or _LAST.fullmatch(part):
            if not alone:
                raise Unsupported("a position beside another predicate is unsupported")
            if m := _LAST.fullmatch(part):
                return [Compound(tag, position=Position(0, int(m[1] or 0) + 1, tag is not None, True))]
            return [Compound(tag, position=Position(0, int(part), tag is not None))]
        either = []
        for choice in _words(part, "or"):
            tests = tuple(_test(x) for x in _words(choice, "and"))
            either.append(tests)
        if any(isinstance(t, TextTest) for tests in either for t in tests) and (not alone or len(either) > 1 or len(either[0]) > 1):
            raise Unsupported("a test of text beside another predicate is unsupported")
        options.append(either)
    out = []
    for chosen in product(*options):
        tests = [t for tests in chosen for t in tests]
        text = next((t for t in tests if isinstance(t, TextTest)), None)
        out.append(Compound(tag, attrs=tuple(t for t in tests if isinstance(t, Attr)), text=text))
        if len(out) > MOST:
            raise Unsupported(f"more than {MOST} alternatives")
    return out


def _step(text: str) -> list[Compound]:
    at = text.find("[")
    name = (text if at < 0 else text[:at]).strip()
    parts = []
    rest = "" if at < 0 else text[at:].strip()
    while rest:
        if rest[0] != "[":
            raise Unsupported(f"unexpected {rest[:10]!r}")
        depth, quote, i = 0, "", 0
        for i, c in enumerate(rest):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
                if not depth:
                    break
        else:
            raise Unsupported("unterminated predicate")
        parts.append(rest[1:i])
        rest = rest[i + 1 :].strip()
    if name != "*" and not _TAG.fullmatch(name):
        raise Unsupported(f"the step {name!r} is unsupported")
    return _predicates(parts, None if name == "*" else name)


def _tokens(path: str) -> list[tuple[str, str]]:
    """(separator, step) pairs."""
    out, i, n = [], 0, len(path)
    while i < n:
        if path[i] != "/":
            raise Unsupported("steps are separated by '/' or '//'")
        sep = "//" if path.startswith("//", i) else "/"
        i += len(sep)
        begin, depth, quote = i, 0, ""
        while i < n:
            c = path[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == "/" and depth <= 0:
                break
            i += 1
        step = path[begin:i].strip()
        if not step:
            raise Unsupported("an empty step")
        out.append((sep, step))
    return out


def _path(path: str) -> list[Member]:
    strict = path.startswith(".")
    if strict:
        path = path[1:]
        if not path.startswith("//"):
            raise Unsupported("a relative path begins with './/'")
    tokens = _tokens(path)
    if not tokens:
        raise Unsupported("an empty path")
    terminal = Terminal("outer")
    sep, last = tokens[-1]
    if last == "text()":
        terminal = Terminal("text", "", sep == "//")
        tokens = tokens[:-1]
    elif last.startswith("@"):
        terminal = Terminal("attr", _attr_name(last[1:].strip()), sep == "//")
        tokens = tokens[:-1]
    if not tokens:
        raise Unsupported("a value needs a step before it")
    absolute = tokens[0][0] == "/"
    if absolute and not re.match(r"html(?![a-z0-9_.:-])", tokens[0][1]):
        raise Unsupported("an absolute path begins with '/html' or '//'")
    for axis in ("ancestor::", "parent::"):
        if any(step.startswith(axis) for _, step in tokens):
            if strict or absolute or len(tokens) != 2 or not tokens[1][1].startswith(axis) or tokens[1][0] != "/":
                raise Unsupported(f"{axis} is supported in absolute paths of two steps")
            inner, outer = _step(tokens[0][1]), _step(tokens[1][1][len(axis) :])
            if any(c.position or c.text for c in [*inner, *outer]):
                raise Unsupported(f"{axis} with a position or a test of text is unsupported")
            return [Member((replace(o, has=Has(tuple(inner), axis == "parent::")),), (), terminal) for o in outer]
    choices, combs = [], []
    for k, (sep, step) in enumerate(tokens):
        if step.startswith("following-sibling::"):
            if k == 0 or sep != "/":
                raise Unsupported("following-sibling:: follows a single '/'")
            found = _step(step[19:])
            if any(c.position for c in found):
                raise Unsupported("a position on a sibling axis is unsupported")
            comb = GENERAL
        else:
            found, comb = _step(step), DESCENDANT if sep == "//" else CHILD
        if k:
            combs.append(comb)
        choices.append(found)
    count = 1
    for c in choices:
        count *= len(c)
    if count > MOST:
        raise Unsupported(f"more than {MOST} alternatives")
    return [Member(tuple(chosen), tuple(combs), terminal, strict, absolute) for chosen in product(*choices)]


def compile(query: str) -> tuple[Member, ...]:  # noqa: A001
    query = query.strip()
    if "$" in _outside(query):
        raise Unsupported("variables are unsupported")
    if query.startswith("normalize-space(") and query.endswith(")"):
        inner = query[16:-1].strip()
        if inner in ("", ".") or inner.startswith("normalize-space("):
            raise Unsupported("normalize-space() takes one path")
        members = compile(inner)
        if len(members) != 1:
            raise Unsupported("normalize-space() takes one path")
        return (replace(members[0], terminal=replace(members[0].terminal, scalar=True)),)
    out: list[Member] = []
    for part in split(query, "|"):
        out += _path(part.strip())
        if len(out) > MOST:
            raise Unsupported(f"more than {MOST} alternatives")
    return tuple(out)
