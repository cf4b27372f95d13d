"""HTML text to a tree in columns: one pass over the text, a stack of open elements, no node objects.

The tokens are those of HTML5; which start tags end open elements, and which end tags are ignored, follows the tables of libxml2 2.14.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import html5

_FONT = "abbr acronym bdo br cite code dfn em iframe img kbd map q samp strong sub sup var"
_SIZED = "big s small strike tt"
_BLOCKS = "blockquote body div frameset hr xmp"
_HEADINGS = "h1 h2 h3 h4 h5 h6"
_LISTED = "address dir head listing menu p pre"
#: Incoming start tags (several share a rule) and the names that they close on top of the stack.
_CLOSERS = (
    ("a", "a head"),
    (f"{_FONT} {_SIZED} b i font span u", "head"),
    ("address", "head p ul"),
    (f"{_BLOCKS} dir {_HEADINGS} listing ol", "head p"),
    ("caption", "p"),
    ("center", "b i font head p"),
    ("col", "caption p"),
    ("colgroup", "caption colgroup p"),
    ("dd", f"{_LISTED} dt"),
    ("dl", f"{_LISTED} dt"),
    ("dt", f"{_LISTED} dd dl"),
    ("fieldset", f"a {_HEADINGS} head legend listing p pre"),
    ("form", f"{_LISTED} dl form {_HEADINGS} ol ul"),
    ("head title", "p"),
    ("li", f"address dl {_HEADINGS} head li listing p pre"),
    ("menu pre", "head p ul"),
    ("optgroup option", "option"),
    ("p", f"{_SIZED} b i {_HEADINGS} head p u"),
    ("table", f"a {_HEADINGS} head listing p pre"),
    ("tbody", "caption colgroup p tbody td th tfoot thead tr"),
    ("td th", "a b i font p span td th u"),
    ("tfoot", "caption colgroup p tbody td th thead tr"),
    ("thead", "caption colgroup"),
    ("tr", "caption colgroup p td th tr"),
    ("ul", _LISTED),
)
CLOSES: dict[str, frozenset[str]] = {name: frozenset(closed.split()) for names, closed in _CLOSERS for name in names.split()}
CLOSES["dt"] = frozenset("address dd dir head listing menu p pre".split())
CLOSES["dd"] = frozenset("address dir dt head listing menu p pre".split())
CLOSES["dl"] = frozenset("address dir dt head listing menu p pre".split())
VOID = frozenset("area base basefont br col frame hr img input isindex link meta param".split())
RAW = frozenset("iframe noembed noframes script style xmp".split())
RCDATA = frozenset("textarea title".split())
RANK = {"body": 6, "table": 5, "tbody": 4, "tfoot": 4, "thead": 4, "tr": 3, "td": 2, "th": 2, "div": 1}
FRAME = frozenset(("html", "head", "body"))
HEAD_CONTENT = frozenset("base link meta script style title".split())
NEUTRAL = frozenset("body frame frameset head html noframes".split())
MINIMIZED = frozenset("checked compact declare defer disabled ismap multiple nohref noresize noshade nowrap readonly selected".split())
LEGACY = {name: value for name, value in html5.items() if not name.endswith(";")}

_SPACE = " \t\n\f\r"
_TOKENS = re.compile(r"[^ \t\n\f\r]+")
_NAMED = re.compile("class|id", re.IGNORECASE)
_NAME = re.compile(r"[^ \t\n\f\r/>]+")
_SKIP = re.compile(r"[ \t\n\f\r/]*")
_BLANK = re.compile(r"[ \t\n\f\r]*")
_ATTR_NAME = re.compile(r"=?[^ \t\n\f\r/>=]*")
_BARE = re.compile(r"[^ \t\n\f\r>]*")
#: The common case: quoted values without a stray sign.
_PLAIN = re.compile(r"(?:[ \t\n\f\r]+[a-zA-Z_:][^ \t\n\f\r/>=\"'<]*(?:=(?:\"[^\"]*\"|'[^']*'|[^ \t\n\f\r>\"'=<`/]+))?)*[ \t\n\f\r]*(/?)>")
_PAIR = re.compile(r"([a-zA-Z_:][^ \t\n\f\r/>=\"'<]*+)(?:(=)(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\f\r>\"'=<`/]++)))?+")
#: A tag of the common case: what opens it, attributes, what ends it.
_TAG = re.compile(r"(</?[a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\n\f\r]++[a-zA-Z_:][^ \t\n\f\r/>=\"'<]*+(?:=(?:\"[^\"]*+\"|'[^']*+'|[^ \t\n\f\r>\"'=<`/]++))?+)*+[ \t\n\f\r]*+)(/?>)")
_SCRIPT = re.compile(r"<!--|-->|<script(?=[ \t\n\f\r/>])|</script(?=[ \t\n\f\r/>])", re.IGNORECASE)
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(?:#([xX][0-9a-fA-F]+|[0-9]+);?|([0-9A-Za-z]+)(;?))")
_CP1252 = dict(zip(range(0x80, 0xA0), bytes(range(0x80, 0xA0)).decode("cp1252", "replace")))
_CP1252.update({c: chr(c) for c in (0x81, 0x8D, 0x8F, 0x90, 0x9D)})
_FOLD = {c: c + 32 for c in range(65, 91)}


def fold(text: str) -> str:
    """Lower case of ASCII letters alone."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def class_names(value: str) -> list[str]:
    return _TOKENS.findall(value)


def _point(digits: str) -> str:
    number = int(digits[1:], 16) if digits[0] in "xX" else int(digits) if len(digits) < 12 else 0x110000
    if number in _CP1252:
        return _CP1252[number]
    return "�" if number == 0 or 0xD800 <= number <= 0xDFFF or number > 0x10FFFF else chr(number)


def decode(text: str, attribute: bool = False) -> str:
    """Character references replaced; one without its semicolon counts for the old names, and in attributes only where no letter follows."""
    if "&" not in text:
        return text

    def put(m: re.Match) -> str:
        digits, name, end = m.groups()
        if digits:
            return _point(digits)
        if end and (value := html5.get(name + ";")) is not None:
            return value
        for n in range(min(6, len(name)), 0, -1):
            if (value := LEGACY.get(name[:n])) is not None:
                follows = name[n : n + 1] or end or text[m.end() : m.end() + 1]
                if attribute and (follows == "=" or (follows.isascii() and follows.isalnum())):
                    break
                return value + name[n:] + end
        return m[0]

    return _REFERENCE.sub(put, text)


def prepare(text: str) -> str:
    """Edges stripped, a byte order mark that this lays open dropped, then NULs; one kind of line end."""
    text = text.strip(" \t\n\v\f\r")
    if text.startswith("﻿"):
        text = text[1:]
    if "\0" in text:
        text = text.replace("\0", "")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text


def _attributes(text: str, at: int) -> tuple[list | None, bool, int]:
    """(attributes, whether the tag closes itself, place behind the tag) by the tokenizer's states; -1 where the text ends first."""
    found, n = [], len(text)
    while True:
        to = _SKIP.match(text, at).end()
        if to >= n:
            return None, False, -1
        if text[to] == ">":
            return found, to > at and text[to - 1] == "/", to + 1
        m = _ATTR_NAME.match(text, to)
        name, at = m[0], m.end()
        after = _BLANK.match(text, at).end()
        if after < n and text[after] == "=":
            at = _BLANK.match(text, after + 1).end()
            if at >= n:
                return None, False, -1
            quote = text[at]
            if quote in "\"'":
                end = text.find(quote, at + 1)
                if end < 0:
                    return None, False, -1
                value, at = text[at + 1 : end], end + 1
            else:
                m = _BARE.match(text, at)
                value, at = m[0], m.end()
            found.append((fold(name), value))
        else:
            found.append((fold(name), None))


#: Names of attributes as written and in lower case, a thousand at most.
_folded: dict[str, str] = {}


def _fold_name(written: str) -> str:
    if len(_folded) >= 1000:
        _folded.clear()
    name = _folded[written] = fold(written)
    return name


def _plain(text: str, at: int, to: int) -> list:
    """Attributes of the common case, between a tag's name and its end."""
    return [(fold(p), (q or r or s) if sign else None) for p, sign, q, r, s in _PAIR.findall(text, at, to)]


class Tree:
    """Elements and text nodes in document order, as columns.

    ``at`` of elements and texts is their common order. An element's descendants are the elements id + 1 .. last.
    """

    __slots__ = ("text", "tag", "parent", "last", "attrs", "begin", "end", "at", "child", "kind", "before", "made", "children", "owner", "value", "text_at", "_by_tag", "_by_class", "_by_id", "_texts", "_parsed", "cache")

    def __init__(self, text: str) -> None:
        self.text = text
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.attrs: list = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.at: list[int] = []
        self.child: list[int] = []
        self.kind: list[int] = []
        self.before: list[int] = []
        self.made: list[bool] = []
        self.children: list[dict] = []
        self.owner: list[int] = []
        self.value: list[str] = []
        self.text_at: list[int] = []
        self._parsed: dict[int, dict] = {}
        self.renew()

    def renew(self) -> None:
        """Forgets what was derived from the columns, as they have grown."""
        self._by_tag = self._by_class = self._by_id = self._texts = None
        #: What selectors' tests keep about this tree.
        self.cache: dict = {}

    def attributes(self, i: int) -> dict[str, str]:
        """Decoded attributes in source order, the first of each name."""
        found = self._parsed.get(i)
        if found is None:
            found = {}
            held = self.attrs[i]
            if type(held) is str:
                for written, sign, q, r, s in _PAIR.findall(held):
                    name = _folded.get(written) or _fold_name(written)
                    if name not in found:
                        value = q or r or s
                        found[name] = (decode(value, True) if "&" in value else value) if sign else name if name in MINIMIZED else ""
            else:
                for name, value in _plain(self.text, *held) if type(held) is tuple else held or ():
                    if name not in found:
                        found[name] = (name if name in MINIMIZED else "") if value is None else decode(value, True)
            self._parsed[i] = found
        return found

    def attributed(self) -> list[int]:
        """Elements with attributes."""
        return [i for i, attrs in enumerate(self.attrs) if attrs]

    def memo(self) -> dict:
        """For what the tags' order alone decides; pages of one shape share it."""
        return self.cache

    def siblings(self, i: int, same: bool) -> int:
        counts = self.children[self.parent[i]]
        return counts.get(self.tag[i], 0) if same else counts[""]

    def by_tag(self, tag: str) -> list[int]:
        if self._by_tag is None:
            self._by_tag = {}
            for i, name in enumerate(self.tag):
                self._by_tag.setdefault(name, []).append(i)
        return self._by_tag.get(tag, [])

    def _index(self) -> None:
        self._by_class, self._by_id = {}, {}
        for i, attrs in enumerate(self.attrs):
            if attrs and (type(attrs) is not tuple or _NAMED.search(self.text, *attrs)):
                own = self.attributes(i)
                if (names := own.get("class")) is not None:
                    for name in dict.fromkeys(_TOKENS.findall(names)):
                        self._by_class.setdefault(name, []).append(i)
                if (name := own.get("id")) is not None:
                    self._by_id.setdefault(name, []).append(i)

    def by_class(self, name: str) -> list[int]:
        if self._by_class is None:
            self._index()
        return self._by_class.get(name, [])

    def by_id(self, name: str) -> list[int]:
        if self._by_id is None:
            self._index()
        return self._by_id.get(name, [])

    def texts(self, i: int) -> list[int]:
        """Direct text nodes of an element."""
        if self._texts is None:
            self._texts = {}
            for t, owner in enumerate(self.owner):
                self._texts.setdefault(owner, []).append(t)
        return self._texts.get(i, [])

    def inner(self, i: int) -> range:
        """Text nodes of an element and its descendants."""
        from bisect import bisect_left

        upto = self.at[self.last[i] + 1] if self.last[i] + 1 < len(self.at) else None
        a = bisect_left(self.text_at, self.at[i])
        z = len(self.text_at) if upto is None else bisect_left(self.text_at, upto)
        while a < z and not i <= self.owner[z - 1] <= self.last[i]:
            z -= 1  # what follows the element before the next one opens
        return range(a, z)

    def string(self, i: int) -> str:
        return "".join([self.value[t] for t in self.inner(i)])

    def source(self, i: int) -> str:
        return self.text[self.begin[i] : self.end[i]]


class _Shaped(Tree):
    """A page of a shape that is known: what the tags' order decides is the shape's, the page's own are its texts and attributes."""

    __slots__ = ("shape", "parts", "_places")

    def __init__(self, text: str, shape: "_Shape", parts: list[str]) -> None:
        self.text, self.shape, self.parts = text, shape, parts
        own = shape.tree
        self.tag, self.parent, self.last, self.at, self.child, self.kind = own.tag, own.parent, own.last, own.at, own.child, own.kind
        self.before, self.made, self.children, self.owner, self.text_at = own.before, own.made, own.children, own.owner, own.text_at
        held = parts[2::4]
        self.attrs = [None if k is None else held[k] for k in shape.token]
        texts = parts[::4]
        if shape.whole is None:
            self.value = ["".join([_piece(texts[k], part, references) for k, part, references in pieces]) for pieces in shape.pieces]
        elif "&" in text:
            self.value = ["".join([_piece(texts[k], part, references) for k, part, references in pieces]) if "&" in texts[pieces[0][0]] else texts[pieces[0][0]] for pieces in shape.pieces]
        else:
            self.value = [texts[k] for k in shape.whole]
        self._by_tag, self._texts, self._by_class, self._by_id, self._places = shape.by_tag, shape.texts, {}, {}, None
        self._parsed, self.cache = {}, {}

    def attributed(self) -> list[int]:
        return self.shape.held

    def memo(self) -> dict:
        return self.shape.memo

    def _holding(self, value: str) -> list[int]:
        """Elements of which an attribute may have this in its value."""
        attrs = self.attrs
        return [i for i in self.shape.held if value in (held := attrs[i]) or "&" in held]

    def by_class(self, name: str) -> list[int]:
        found = self._by_class.get(name)
        if found is None:
            found = self._by_class[name] = [i for i in self._holding(name) if name in _TOKENS.findall(self.attributes(i).get("class", ""))]
        return found

    def by_id(self, name: str) -> list[int]:
        found = self._by_id.get(name)
        if found is None:
            found = self._by_id[name] = [i for i in self._holding(name) if self.attributes(i).get("id") == name]
        return found

    def inner(self, i: int) -> range:
        found = self.shape.inner.get(i)
        if found is None:
            found = self.shape.inner[i] = super().inner(i)
        return found

    def places(self) -> list[int]:
        """Where tags begin and end."""
        if self._places is None:
            self._places = _places(self.parts)
        return self._places

    @property
    def begin(self) -> list[int]:  # type: ignore[override]
        return [self.places()[k] for k in self.shape.begin]

    @property
    def end(self) -> list[int]:  # type: ignore[override]
        return [self.places()[k] for k in self.shape.end]

    def source(self, i: int) -> str:
        places = self.places()
        return self.text[places[self.shape.begin[i]] : places[self.shape.end[i]]]


def _piece(text: str, part: int, references: bool) -> str:
    """Part of a text between tags: all, its leading blanks, or what follows these."""
    if part:
        rest = text.lstrip(_SPACE)
        text = rest if part == 2 else text[: len(text) - len(rest)]
    return decode(text) if references else text


def _places(parts: list[str]) -> list[int]:
    """The page's beginning, each tag's beginning and end, and the page's end."""
    found, at = [0], 0
    for k in range(1, len(parts), 4):
        at += len(parts[k - 1])
        found.append(at)
        at += len(parts[k]) + len(parts[k + 1]) + len(parts[k + 2])
        found.append(at)
    found.append(at + len(parts[-1]))
    return found


#: Pages up to so many characters are held against the shapes that are known; as many elements are kept in shapes, and so many shapes are
#: remembered as seen once.
SHAPED, SHAPE_ELEMENTS, SEEN = 4096, 20_000, 20_000
_shapes: dict[tuple, "_Shape | None"] = {}
_seen: set[int] = set()
_kept = [0]


class _Shape:
    """What the order of a page's tags, and where text stands between them, say about its tree."""

    def __init__(self, tree: Tree, parts: list[str], log: list[tuple[int, int, int]]) -> None:
        """``log``: (number of the text node, place, length) of each run of text that the tree was built of."""
        self.tree = Tree("")
        for name in ("tag", "parent", "last", "at", "child", "kind", "before", "made", "children", "owner", "text_at"):
            setattr(self.tree, name, getattr(tree, name))
        places = _places(parts)
        number = {at: k for k, at in enumerate(places)}
        opens = {at: k for k, at in enumerate(places[1:-1:2])}
        self.begin, self.end = [number[at] for at in tree.begin], [number[at] for at in tree.end]
        self.token = [None if made else opens[at] for at, made in zip(tree.begin, tree.made)]
        self.token = [k if k is not None and parts[4 * k + 2] != "" else None for k in self.token]
        self.held = [i for i, k in enumerate(self.token) if k is not None]
        starts = {at: k for k, at in enumerate(places[::2])}
        leads = {at + len(x) - len(x.lstrip(_SPACE)): k for at, x, k in zip(places[::2], parts[::4], range(len(parts)))}
        self.pieces: list[list[tuple[int, int, bool]]] = [[] for _ in tree.value]
        for node, at, size in log:
            k = starts.get(at)
            part = 0
            if k is None:
                k, part = leads[at], 2
            elif size < len(parts[4 * k]):
                part = 1
            raw = k > 0 and fold(parts[4 * k - 3][1:]) in RAW and parts[4 * k - 1] == ">"
            self.pieces[node].append((k, part, not raw))
        self.whole = [p[0][0] for p in self.pieces] if all(len(p) == 1 and p[0][1] == 0 for p in self.pieces) else None
        self.by_tag: dict[str, list[int]] = {}
        for i, name in enumerate(tree.tag):
            self.by_tag.setdefault(name, []).append(i)
        self.texts: dict[int, list[int]] = {}
        for k, owner in enumerate(tree.owner):
            self.texts.setdefault(owner, []).append(k)
        self.inner: dict[int, range] = {}
        self.memo: dict = {}


def _regular(parts: list[str]) -> bool:
    """Whether elements whose content isn't markup hold text alone."""
    for k in range(1, len(parts), 4):
        name = fold(parts[k][1:])
        if name == "plaintext" or (name in RAW or name in RCDATA) and parts[k + 2] == ">" and (k + 4 >= len(parts) or fold(parts[k + 4]) != f"</{name}"):
            return False
    return True


def _known(text: str) -> "Tree | None":
    """The tree of a page by its shape, from the second page of a shape on; None where the page isn't made of common tags and text alone."""
    parts = _TAG.split(text)
    if len(parts) < 5 or text.count("<") != len(parts) // 4:
        return None
    kinds = bytes([0 if not x else 3 if x[0] not in _SPACE else 1 if x.lstrip(_SPACE) else 2 for x in parts[::4]])
    key = ("".join(parts[1::4]), "".join(parts[3::4]), kinds, bytes([not x for x in parts[2::4]]))
    if key in _shapes:
        shape = _shapes[key]
        return None if shape is None else _Shaped(text, shape, parts)
    if (mark := hash(key)) not in _seen:
        if len(_seen) >= SEEN:
            _seen.clear()
        _seen.add(mark)
        return None
    if _kept[0] >= SHAPE_ELEMENTS:
        _shapes.clear()
        _kept[0] = 0
    log: list[tuple[int, int, int]] = []
    tree = _build(text, None, log)
    try:
        _shapes[key] = _Shape(tree, parts, log) if _regular(parts) else None
    except KeyError:  # an element begins or ends within a text
        _shapes[key] = None
    _kept[0] += len(tree.tag) + 1
    return tree


class _Builder:
    log: list[tuple[int, int, int]] | None = None

    def __init__(self, text: str) -> None:
        self.tree, self.text = Tree(text), text
        self.stack: list[int] = []
        self.open_names: dict[str, int] = {}
        self.runs: list[str] = []
        self.clock = 0
        self.run_owner = self.run_at = -1
        self.phantoms = 0
        self.head_seen = self.body_seen = False
        self.roots: dict = {"": 0}
        self.last_root = -1
        self.last_child: list[int] = []

    # elements

    def open(self, name: str, attrs: list | None, at: int, made: bool = False) -> int:
        t = self.tree
        i = len(t.tag)
        if self.stack:
            up = self.stack[-1]
            counts, before = t.children[up], self.last_child[up]
            self.last_child[up] = i
        else:
            up, counts, before, self.last_root = -1, self.roots, self.last_root, i
        counts[""] += 1
        counts[name] = counts.get(name, 0) + 1
        t.tag.append(name)
        t.parent.append(up)
        t.last.append(i)
        t.attrs.append(attrs)
        t.begin.append(at)
        t.end.append(-1)
        t.at.append(self.clock)
        self.clock += 1
        t.child.append(counts[""])
        t.kind.append(counts[name])
        t.before.append(before)
        t.made.append(made)
        t.children.append({"": 0})
        self.last_child.append(-1)
        self.stack.append(i)
        self.open_names[name] = self.open_names.get(name, 0) + 1
        if name == "head":
            self.head_seen = True
        elif name == "body":
            self.body_seen = True
        return i

    def close(self, at: int) -> None:
        i, t = self.stack.pop(), self.tree
        t.end[i] = at
        t.last[i] = len(t.tag) - 1
        self.open_names[t.tag[i]] -= 1

    def is_open(self, name: str) -> bool:
        return self.open_names.get(name, 0) > 0

    def top(self) -> str:
        return self.tree.tag[self.stack[-1]] if self.stack else ""

    def flush(self) -> None:
        if self.runs:
            t = self.tree
            t.owner.append(self.run_owner)
            t.value.append("".join(self.runs))
            t.text_at.append(self.run_at)
            self.runs = []

    def frame(self, name: str, at: int) -> None:
        """Opens the parts of the document's frame that a start tag leaves out."""
        if not self.stack and name != "html":
            self.flush()
            self.open("html", None, at, True)
        if self.body_seen or name in FRAME or self.is_open("head"):
            return
        part = None
        if name in HEAD_CONTENT:
            part = "body" if self.is_open("frameset") else None if self.head_seen else "head"
        elif name not in NEUTRAL:
            part = "body"
        if part:
            self.flush()
            self.open(part, None, at, True)

    def redundant(self, name: str) -> bool:
        if name == "html":
            return bool(self.stack)
        if name == "body":
            return self.is_open("body")
        return not (len(self.stack) == 1 and self.top() == "html")

    def start(self, name: str, attrs: list, closed: bool, at: int, end: int) -> None:
        if not self.body_seen or not self.stack:
            self.frame(name, at)
        closes = CLOSES.get(name, ())
        in_frame = name in FRAME
        if in_frame and self.redundant(name) and self.top() not in closes:
            self.phantom(closed, at)
            return
        self.flush()
        tag, stack, headless = self.tree.tag, self.stack, False
        while stack and tag[stack[-1]] in closes:
            headless |= tag[stack[-1]] == "head"
            self.close(at)
        if headless and not in_frame and not self.body_seen and name not in HEAD_CONTENT and name not in NEUTRAL:
            self.open("body", None, at, True)
        if in_frame and self.redundant(name):
            self.phantom(closed, at)
            return
        self.open(name, attrs, at)
        if closed or name in VOID:
            self.close(end)

    def phantom(self, closed: bool, at: int) -> None:
        self.phantoms += 1
        if closed and self.stack:
            self.flush()
            self.close(at)

    def finish(self, name: str, at: int, end: int) -> None:
        if name in FRAME and self.phantoms:
            self.phantoms -= 1
            return
        if not self.open_names.get(name):
            return
        tag, stack = self.tree.tag, self.stack
        k = len(stack) - 1
        rank, free, above = RANK.get(name, 0), name in FRAME, 0
        while k >= 0 and tag[stack[k]] != name:
            above = max(above, RANK.get(tag[stack[k]], 0))
            k -= 1
        if k < 0 or (not free and above > rank):
            return
        self.flush()
        while len(stack) > k + 1:
            self.close(at)
        self.close(end)

    def put(self, run: str, at: int, verbatim: bool = False, references: bool = True) -> None:
        """A run of text; ``verbatim``: the content of a raw or RCDATA element."""
        if not run:
            return
        if not verbatim:
            stack = self.stack
            if not self.body_seen:
                top = self.top()
                if not stack or top == "head" or (top == "html" and len(stack) == 1):
                    rest = run.lstrip(_SPACE)
                    if len(rest) < len(run) and stack:
                        self.append(decode(run[: len(run) - len(rest)]), at, len(run) - len(rest))
                    if not rest:
                        return
                    at += len(run) - len(rest)
                    run = rest
                    self.flush()
                    if not stack:
                        self.open("html", None, at, True)
                    if top == "head":
                        self.close(at)
                    if not stack:
                        self.open("html", None, at, True)
                    self.open("body", None, at, True)
            elif not stack or self.top() == "head":
                rest = run.lstrip(_SPACE)
                if len(rest) < len(run) and stack:
                    self.append(decode(run[: len(run) - len(rest)]), at, len(run) - len(rest))
                if not rest:
                    return
                at += len(run) - len(rest)
                run = rest
                self.flush()
                if stack:
                    self.close(at)
                if not stack:
                    self.open("html", None, at, True)
        self.append(decode(run) if references else run, at, len(run))

    def append(self, value: str, at: int, size: int) -> None:
        """``at`` and ``size`` are those of the run, before references were replaced."""
        if self.log is not None:
            self.log.append((len(self.tree.value), at, size))
        if not self.runs:
            self.run_owner = self.stack[-1]
            self.run_at = self.clock
            self.clock += 1
        self.runs.append(value)


def _script_end(text: str, at: int) -> int:
    """Where the script that begins at ``at`` ends: comments in it may hold script elements of their own."""
    state = 0
    while True:
        m = _SCRIPT.search(text, at)
        if m is None:
            return len(text)
        sign = m[0]
        at = m.end()
        if sign == "<!--":
            if state == 0:
                state = 1
            at = m.start() + 2
            if text.startswith("-->", at):  # "<!-->"
                state, at = 0, at + 3
        elif sign == "-->":
            state = 0
        elif sign[1] == "/":
            if state < 2:
                return m.start()
            state = 1
        elif state == 1:
            state = 2


#: Characters after which ``parse`` asks for the first time whether it may stop; then after twice as many each time.
FIRST_LOOK = 2048


def parse(text: str, enough: Callable[[Tree], bool] | None = None) -> Tree:
    """The tree of one page, or of its beginning if that is ``enough``. A beginning's last text node is left out, as it may go on."""
    text = prepare(text)
    if enough is None and len(text) <= SHAPED and (tree := _known(text)) is not None:
        return tree
    return _build(text, enough)


def _build(text: str, enough: Callable[[Tree], bool] | None, log: list[tuple[int, int, int]] | None = None) -> Tree:
    b = _Builder(text)
    b.log = log
    n, at, begin = len(text), 0, 0
    find, match_plain, match_name = text.find, _PLAIN.match, _NAME.match
    ends: dict[str, re.Pattern] = {}
    look = FIRST_LOOK if enough is not None else n
    while at < n:
        if at >= look:
            look = 2 * at
            b.tree.renew()
            for i in b.stack:
                b.tree.last[i] = len(b.tree.tag) - 1
            if enough(b.tree):
                return b.tree
        lt = find("<", at)
        if lt < 0 or lt + 1 >= n:
            b.put(text[begin:], begin)
            begin = n
            break
        c = text[lt + 1]
        if c.isascii() and c.isalpha():
            if begin < lt:
                b.put(text[begin:lt], begin)
            name_end = match_name(text, lt + 1).end()
            name = fold(text[lt + 1 : name_end])
            if name_end < n and text[name_end] == ">":
                attrs, closed, at = None, False, name_end + 1
            elif (m := match_plain(text, name_end)) is not None:
                attrs, closed, at = None, bool(m[1]), m.end()
                if m.end() - name_end > 2:
                    attrs = (name_end, m.end())  # read when they are asked for
            else:
                attrs, closed, at = _attributes(text, name_end)
                if at < 0:
                    begin = n
                    break
            b.start(name, attrs, closed, lt, at)
            begin = at
            if not closed and (name in RAW or name in RCDATA or name == "plaintext"):
                if name == "plaintext":
                    end = n
                elif name == "script":
                    end = _script_end(text, at)
                else:
                    rx = ends.get(name) or ends.setdefault(name, re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.IGNORECASE))
                    m = rx.search(text, at)
                    end = m.start() if m else n
                b.put(text[at:end], at, True, name in RCDATA)
                at = begin = end
            continue
        if c == "/":
            if lt + 2 >= n:
                at = n
                b.put(text[begin:], begin)
                begin = n
                break
            c = text[lt + 2]
            if begin < lt:
                b.put(text[begin:lt], begin)
            if c.isascii() and c.isalpha():
                name_end = match_name(text, lt + 2).end()
                name = fold(text[lt + 2 : name_end])
                if name_end < n and text[name_end] == ">":
                    at = name_end + 1
                else:
                    _, _, at = _attributes(text, name_end)
                    if at < 0:
                        begin = n
                        break
                b.finish(name, lt, at)
            else:
                end = find(">", lt + 2)
                if c != ">":
                    b.flush()
                at = n if end < 0 else end + 1
            begin = at
            continue
        if c == "!" or c == "?":
            if begin < lt:
                b.put(text[begin:lt], begin)
            if text.startswith("--", lt + 2):
                b.flush()
                if text.startswith(">", lt + 4):
                    at = lt + 5
                elif text.startswith("->", lt + 4):
                    at = lt + 6
                else:
                    m = _COMMENT_END.search(text, lt + 4)
                    at = m.end() if m else n
            else:
                if c == "?" or fold(text[lt + 2 : lt + 9]) != "doctype":
                    b.flush()
                end = find(">", lt + 2)
                at = n if end < 0 else end + 1
            begin = at
            continue
        at = lt + 1
    if begin < n:
        b.put(text[begin:], begin)
    b.flush()
    while b.stack:
        b.close(n)
    tree = b.tree
    tree.renew()
    tree.children.append(b.roots)  # found by parent -1
    return tree
