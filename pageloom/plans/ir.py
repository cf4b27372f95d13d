"""The logical plan of one query: members, each a chain of compounds with a value terminal."""

from __future__ import annotations

from dataclasses import dataclass, field

DESCENDANT, CHILD, ADJACENT, GENERAL = " ", ">", "+", "~"


class Unsupported(ValueError):
    """A query that no plan answers faithfully; the message says why."""


@dataclass(frozen=True)
class Attr:
    name: str
    op: str = ""  # "", =, ^=, $=, *=, ~=, |=
    value: str = ""
    fold: bool = False


@dataclass(frozen=True)
class Position:
    """``a n + b`` counted among siblings, or among those of the same tag; from the end if ``back``; ``only``: there is no other."""

    a: int
    b: int
    same: bool = False
    back: bool = False
    only: bool = False

    @property
    def late(self) -> bool:
        return self.back or self.only

    def holds(self, p: int) -> bool:
        return p == self.b if self.a == 0 else (p - self.b) % self.a == 0 and (p - self.b) // self.a >= 0


@dataclass(frozen=True)
class Has:
    members: tuple["Compound", ...]
    child: bool


@dataclass(frozen=True)
class TextTest:
    """``kind``: contains or equals, over the string value (``direct`` False) or direct text nodes."""

    kind: str
    value: str
    direct: bool = False


@dataclass(frozen=True)
class Compound:
    tag: str | None = None
    ids: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    attrs: tuple[Attr, ...] = ()
    nots: tuple["Compound", ...] = ()
    either: tuple[tuple["Compound", ...], ...] = ()
    position: Position | None = None
    has: Has | None = None
    text: TextTest | None = None

    @property
    def late(self) -> bool:
        """Whether it is decided only when the element, or its parent, ends."""
        return self.has is not None or self.text is not None or (self.position is not None and self.position.late)


@dataclass(frozen=True)
class Terminal:
    kind: str  # text, attr, outer
    name: str = ""
    subtree: bool = False
    scalar: bool = False  # normalize-space


@dataclass(frozen=True)
class Member:
    compounds: tuple[Compound, ...]
    combs: tuple[str, ...]
    terminal: Terminal
    strict: bool = False  # the first compound lies below the context
    absolute: bool = False  # the first compound is the document's root


@dataclass(frozen=True)
class Query:
    source: str
    members: tuple[Member, ...] = field(default_factory=tuple)
    xpath: bool = False
