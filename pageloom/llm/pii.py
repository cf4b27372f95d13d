"""Personal data by a skip-chain conditional random field over the tokens of a document.

Tokens are runs of characters other than blanks, quotes, brackets and the signs that join values (``_SIGNS``); the brackets around a phone number's
first three digits, and the colons of an IPv6 address, belong to their token. All tokens of a document are in the field, and a sign between two of them counts
as one. Potentials: a linear model of a token's shape and surroundings; the labels of neighbours; and, for each two successive
occurrences of an equal token, or of one with the same last seven digits, however far apart, whether their labels agree. Loopy belief
propagation runs over a document as a whole, so that a mention whose context leaves it open follows those that are plain.

Most tokens are words of which no feature but that tells anything. They share one potential, so a run of them is summed over exactly by a power of
the transition matrix and needs no messages of its own; the weights are such that whatever stands beside them their best label is O (``plain_is_o``). Nodes with
messages are the others: tokens with a digit or ``@``, capitalised words near a word that announces names or streets, and other mentions of these.

Weights are fitted by pseudo-likelihood on made-up lines and on a bounded sample of the documents that strict rules label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import text_id
from pageloom.llm.tokens import hash_spans, mix, raw, spans, steps, strings

LABELS = ("O", "EMAIL", "PHONE", "CARD", "SSN", "IP", "IBAN", "PERSON", "ADDRESS")
#: Labels of which neighbouring tokens are one entity, and the fewest and most digits that an entity has.
JOINED = ("PHONE", "CARD", "IBAN", "PERSON", "ADDRESS")
DIGITS = {"PHONE": (7, 15), "CARD": (13, 19)}
#: Words before names; streets' words.
TITLES = "mr mrs ms dr prof professor herr frau monsieur madame mme mlle señor señora name named vorname nachname prénom nombre apellido contact dear".split()
STREETS = "street road avenue lane boulevard blvd platz allee gasse rue calle avenida plaza straße strasse str".split()
#: Documents of which the rules' labels are used in fitting, besides the made-up lines.
SAMPLE = 600
LINES = 1800
EPOCHS = 120
#: Sweeps that are made beyond the number of tokens, if messages still move.
SWEEPS = 12
#: A message that would move by less stays.
STILL = 1e-5
#: Share of the old message that is kept in each sweep.
DAMPING = 0.2
SCHEMA = "doc_id long, label string, begin int, end int, value string"

_RULES = (
    ("EMAIL", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")),
    ("CARD", re.compile(r"(?<![\d.])(?:\d{16}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?!\d)")),
    ("PHONE", re.compile(r"(?<!\d)(?:\+\d{1,3}[ -])?(?:\(\d{3}\)[ -]?|\d{3}[ .-])\d{3}[.-]\d{4}(?!\d)")),
    ("PHONE", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]\d{1,8}){2,5}(?!\d)")),
    ("SSN", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("IBAN", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?!\w)")),
    ("IP", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])")),
)
_SIGNS = ",;:=/|\"'`[]{}<>()"
_SIGN = np.zeros(256, bool)
_SIGN[[*_SIGNS.encode()]] = True
_TOKEN = ~_SIGN
_TOKEN[[9, 10, 11, 12, 13, 32]] = False
_FREE = np.zeros(256, bool)
_FREE[[64, *range(48, 58)]] = True
_EDGE = "\"'`.,;:!?*#$%&|<>[]{}"


def _shape(token: str) -> str:
    """Digits as their number, letters as ``a``, other signs as they are."""
    out = re.sub(r"[^\W\d_]+", "a", token)
    return re.sub(r"[0-9]+", lambda m: f"{len(m[0])}d" if len(m[0]) < 20 else "Nd", out)


def keys(token: str) -> list[str]:
    """What ties a token to equal and similar ones."""
    core = token.strip(_EDGE).lower()
    digits = re.sub(r"\D", "", core) if "@" not in core else ""
    return [core] + ([f"~{digits[-7:]}"] if len(digits) >= 7 else [])


def luhn(digits: str) -> bool:
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits, (len(digits) + 1) % 2))
    return total % 10 == 0


_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_CALLED, _STREET = frozenset(TITLES), frozenset(STREETS)


def _word(token: str) -> str:
    """What a word tells about its neighbours."""
    core = token.strip(_EDGE)
    low = core.lower()
    if low in _CALLED:
        return "title"
    if low in _STREET or low.endswith(("straße", "strasse")):
        return "street"
    return "" if not core else "number" if any(c.isdigit() for c in core) else "Cap" if core[0].isupper() else "low"


def features(token: str, before: str, after: str, earlier: str = "") -> list[str]:
    """``earlier``: the token before the one before."""
    core = token.strip(_EDGE)
    if not re.search(r"[0-9@]", core):
        kind = [_word(x) for x in (earlier, before, token, after)]
        return [f"W:{kind[2]}", f"W1:{kind[1]}|{kind[2]}", f"W2:{kind[0]}|{kind[1]}|{kind[2]}", f"W3:{kind[2]}|{kind[3]}", f"W4:{kind[1]}|{kind[2]}|{kind[3]}"]
    shape = _shape(core)
    digits = sum(c.isdigit() for c in core)
    around = [x if any(c.isdigit() for c in x) else "a" for x in (_shape(before.strip(_EDGE)), _shape(after.strip(_EDGE)))]
    at = core.find("@")
    streets = [_word(x) for x in (before, after)]
    out = [f"s:{shape}", f"n:{min(digits, 20)}", "c:" + re.sub(r"[0-9]+d|Nd", "d", shape), f"t:{around[0]}|{shape}|{around[1]}", f"p:{_shape(before.strip(_EDGE))}|{shape}", f"f:{shape}|{_shape(after.strip(_EDGE))}", f"w:{before.lower().strip(_EDGE)}"]
    if "street" in streets or streets[1] == "Cap":
        out.append(f"st:{streets[0]}|{streets[1]}|{min(digits, 6)}")
    if core.startswith("+"):
        out.append("plus")
    if before.strip(_EDGE).startswith("+"):
        out.append(f"after plus:{min(digits, 9)}")
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}([A-Z0-9]*)", core):
        out.append("iban" if len(core) > 14 else "iban opens" if len(core) == 4 else "iban?")
    if at > 0 and "." in core[at:] and _MAIL.fullmatch(core):
        out.append("mail")
    if core.isdigit() and 13 <= len(core) <= 19:
        out.append(f"card:{luhn(core)}")
    if core.count(":") > 1:
        out.append("v6")
    if any(c.isalpha() for c in core):
        out.append("alpha")
    return out


@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    unary: np.ndarray  # [feature, label]
    chain: np.ndarray  # [label, label]
    agree: float
    plain: np.ndarray | None = None  # [label]: potential of a plain word

    def gaps(self) -> np.ndarray:
        """[plain words between, label, label]: potentials of two nodes with so many plain words between them, these summed over. The last one stands
        for all longer runs: it doesn't change any more."""
        plain = np.zeros(len(self.chain)) if self.plain is None else self.plain
        step, at, out = np.exp(self.chain - self.chain.max()), np.exp(plain - plain.max()), []
        now = step
        for _ in range(LONGEST + 1):
            out.append(np.log(np.maximum(now / now.max(), 1e-300)))
            now = now / now.max() * at[None, :] @ step
        out[0] = self.chain
        return np.stack(out)


    def ends(self) -> np.ndarray:
        """[side, plain words, label]: what so many plain words before a document's first node, or behind its last one, add to its potential."""
        plain = np.zeros(len(self.chain)) if self.plain is None else self.plain
        step, at = np.exp(self.chain - self.chain.max()), np.exp(plain - plain.max())
        out = np.zeros((2, LONGEST + 1, len(plain)))
        for side, move in enumerate((step.T, step)):
            now = np.ones(len(plain))
            for g in range(1, LONGEST + 1):
                now = move @ (at * now)
                now /= now.max()
                out[side, g] = np.log(now)
        return out


#: Plain words in a row, from which on their number makes no difference.
LONGEST = 60


@dataclass
class Field:
    """Nodes of one or more documents: unary potentials, and edges (i, j, whether it is a skip edge)."""

    unary: np.ndarray
    left: np.ndarray
    right: np.ndarray
    skip: np.ndarray
    gap: np.ndarray | None = None  # plain words between the ends of a chain edge


_V6 = re.compile(rb"(?<![0-9A-Za-z:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?)(?![0-9A-Za-z:])")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TRIM = np.zeros(256, bool)
_TRIM[[*b".,;:!?*#$%&|"]] = True


def _known(words: list[str]) -> np.ndarray:
    each = [np.frombuffer(w.encode(), np.uint8) for w in words]
    return np.unique(np.array([hash_spans(w, np.array([0]), np.array([len(w)]))[0] for w in each]))


_TITLE_HASHES, _STREET_HASHES = _known(TITLES), _known(STREETS)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, offsets of tokens by text, numbers of the nodes, whether a sign stands before each token)."""
    data, offsets = raw(column)
    marked = data.copy()
    opens = np.flatnonzero(data[:-4] == 40)
    opens = opens[data[opens + 4] == 41]
    opens = opens[((data[opens[:, None] + np.arange(1, 4)] - 48).astype(np.uint8) < 10).all(axis=1)]
    opens = opens[np.searchsorted(offsets, opens, "right") == np.searchsorted(offsets, opens + 4, "right")]
    marked[opens] = marked[opens + 4] = 48
    colons = np.flatnonzero(data == 58)
    close = np.flatnonzero(np.diff(colons) <= 5)
    if len(close):
        upto = -1
        for p in colons[close].tolist():
            if p >= upto:
                text = int(np.searchsorted(offsets, p, "right"))
                begin = max(int(offsets[text - 1]), p - 45)
                for m in _V6.finditer(data[begin : min(int(offsets[text]), p + 45)].tobytes()):
                    if m.end() - m.start() > 2 and begin + m.end() > p:
                        marked[begin + m.start() : begin + m.end()] = 48
                        upto = begin + m.end()
                        break
    start, end = spans(marked, offsets, _TOKEN)
    ptr = np.searchsorted(start, offsets)
    total = np.concatenate([[0], np.cumsum(_FREE[data])])
    signs = np.concatenate([[0], np.cumsum(_SIGN[marked])])
    apart = np.r_[False, signs[start[1:]] > signs[end[:-1]]] if len(start) else np.zeros(0, bool)
    return data, start, end, ptr, _nodes(data, start, end, ptr, total[end] > total[start]), apart


def _nodes(data: np.ndarray, start: np.ndarray, end: np.ndarray, ptr: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Tokens that aren't plain: those given, capitalised words announced as names or beside streets' words, and other mentions of these."""
    if not len(start):
        return np.zeros(0, np.int64)
    core = np.maximum(end - _TRIM[data[end - 1]], start + 1)
    h = hash_spans(_LOWER[data], start, core)
    first, second = data[start], data[np.minimum(start + 1, len(data) - 1)]
    cap = ((first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)) & ~node
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    title = np.isin(h, _TITLE_HASHES)
    street = np.isin(h, _STREET_HASHES)
    for ending in (b"stra\xc3\x9fe", b"strasse"):
        at = np.flatnonzero(core - start > len(ending))
        street[at[(data[core[at, None] - len(ending) + np.arange(len(ending))] == np.frombuffer(ending, np.uint8)).all(axis=1)]] = True

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        """Whether it holds for the token ``by`` places before, in the same text."""
        out = np.zeros(len(x), bool)
        if by > 0:
            out[by:] = x[:-by] & (doc[by:] == doc[:-by])
        else:
            out[:by] = x[-by:] & (doc[:by] == doc[-by:])
        return out

    named = cap & moved(title, 1)
    for _ in range(3):  # further names, and initials
        named |= cap & moved(named, 1)
    named |= cap & (street | moved(street, -1) | moved(street, 1)) | street & (moved(cap, 1) | moved(node, -1) | moved(node, 1))
    if named.any():
        key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        named |= cap & np.isin(key, key[named & cap])
    return np.flatnonzero(node | named)


def beside(token: str, apart: bool) -> str:
    """A token's neighbour as ``features`` takes it: behind a sign another value is not part of this one, and counts as a word."""
    return "x" if apart and re.search(r"[0-9@]", token) else token


def edges(docs: np.ndarray, number: np.ndarray, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chain edges between successive nodes of a document, with the plain words between them; skip edges between successive occurrences of a key."""
    left, right, skip, gap = [], [], [], []
    seen: dict[tuple[int, str], int] = {}
    for i, (doc, token) in enumerate(zip(docs.tolist(), tokens)):
        if i and docs[i - 1] == doc:
            left.append(i - 1)
            right.append(i)
            skip.append(False)
            gap.append(min(LONGEST, int(number[i] - number[i - 1]) - 1))
        linked = set()
        for key in keys(token):
            j = seen.get((doc, key))
            if j is not None and j not in linked:
                linked.add(j)
                left.append(j)
                right.append(i)
                skip.append(True)
                gap.append(0)
            seen[doc, key] = i
    return np.array(left, np.int64), np.array(right, np.int64), np.array(skip, bool), np.array(gap, np.int64)


def with_ends(unary: np.ndarray, docs: np.ndarray, number: np.ndarray, first: np.ndarray, last: np.ndarray, model: Model) -> np.ndarray:
    """Potentials of nodes, with the plain words before a document's first node and behind its last one summed over; ``first`` and ``last``: the numbers
    of the first and last token of each document."""
    out, ends = unary.copy(), model.ends()
    heads = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    tails = np.append(heads[1:], len(docs)) - 1
    out[heads] += ends[0, np.minimum(LONGEST, number[heads] - first[docs[heads]])]
    out[tails] += ends[1, np.minimum(LONGEST, last[docs[tails]] - number[tails])]
    return out


def marginals(field: Field, model: Model, sweeps: int | None = None, damping: float = DAMPING) -> np.ndarray:
    """Beliefs [token, label] by loopy sum-product; exact where the edges form no loop.

    Each sweep renews the messages that leave a token which one that moved has reached, so that a chain of any length is covered for little
    more than its length. Without ``sweeps`` it ends when none moves; loops that still swing after as many sweeps as there are tokens are damped
    more, and as many again are their bound.
    """
    n, k = field.unary.shape
    if not len(field.left):
        return _softmax(field.unary)
    same = model.agree * np.eye(k)
    chain = model.chain[None] if field.gap is None else model.gaps()[field.gap]
    pair = np.where(field.skip[:, None, None], same[None], chain)
    source, target = np.concatenate([field.left, field.right]), np.concatenate([field.right, field.left])
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
    m = len(field.left)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, k))
    belief = field.unary.copy()
    by_source = np.argsort(source, kind="stable")
    first = np.searchsorted(source[by_source], np.arange(n + 1))
    open_ = np.arange(2 * m)
    for sweep in range(2 * n + SWEEPS if sweeps is None else sweeps):
        keep = damping if sweep < n + SWEEPS else max(damping, 0.5)
        x = (belief[source[open_]] - message[back[open_]])[:, :, None] + pair[open_]
        top = x.max(axis=1, keepdims=True)
        new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        change = (1 - keep) * (new - message[open_])
        message[open_] += change
        np.add.at(belief, target[open_], change)
        moved = np.abs(change).max(axis=1) >= STILL
        open_ = open_[moved]
        if not len(open_):
            break
        reached = np.unique(target[open_])
        count = first[reached + 1] - first[reached]
        onward = by_source[np.repeat(first[reached] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        open_ = np.unique(np.concatenate([open_, onward]))
    return _softmax(field.unary + np.stack([np.bincount(target, message[:, c], n) for c in range(k)], axis=1))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return x / x.sum(axis=1, keepdims=True)


def _weak(text: str, begin: list[int], end: list[int]) -> list[int]:
    """The rules' label of each token, by the characters that it shares with a match."""
    out = [0] * len(begin)
    for label, rule in _RULES:
        for m in rule.finditer(text):
            a, z = m.span()
            for i in range(int(np.searchsorted(end, a, "right")), len(begin)):
                if begin[i] >= z:
                    break
                out[i] = out[i] or LABELS.index(label)
    return out


def lines(count: int = LINES, seed: int = 5) -> list[tuple[str, list[tuple[str, int]]]]:
    """Made-up lines as (token, label): every kind in several forms, repeated mentions with and without context, and harmless numbers."""
    rng = np.random.default_rng(seed)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstu"), int(rng.integers(2, 9))))
    out = []
    for _ in range(count):
        row: list[tuple[str, int]] = []

        def plain(n: int, row: list = row) -> None:
            row.extend((word(), 0) for _ in range(n))

        a, b, c = d(3), d(3), d(4)
        name = lambda: word().capitalize()
        phone = [[(f"+{d(1)}", 2), (f"({a})", 2), (f"{b}-{c}", 2)], [(f"({a})", 2), (f"{b}-{c}", 2)], [(f"{a}-{b}-{c}", 2)], [(f"{a}.{b}.{c}", 2)], [(f"+{d(1)}-{a}-{b}-{c}", 2)]]
        phone.append([(f"+{rng.integers(20, 99)}", 2), *((d(int(rng.integers(2, 5))), 2) for _ in range(int(rng.integers(2, 4)))), (d(int(rng.integers(2, 7))), 2)])
        phone.append([(f"+{rng.integers(20, 99)}", 2), (d(int(rng.integers(1, 4))), 2), (d(int(rng.integers(5, 9))), 2)])
        phone.append([(f"+{rng.integers(20, 999)}{d(int(rng.integers(7, 11)))}", 2)])
        kind = int(rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]))
        plain(int(rng.integers(1, 4)))
        if kind == 0:
            row.append((f"{word()}{rng.choice(['.', '_', '', '-'])}{d(int(rng.integers(0, 4)))}@{word()}{d(int(rng.integers(0, 2)))}.{rng.choice(['example.com', 'org', 'net', 'co.uk'])}", 1))
        elif kind == 1:
            row.extend(phone[int(rng.integers(0, len(phone)))])
            if rng.random() < 0.4 and row[-1][0].endswith(f"{b}-{c}"):  # said again, without the marks
                plain(3)
                row.append(((a + b + c) if rng.random() < 0.5 else b + c, 2))
        elif kind == 2:
            row.extend([(d(int(rng.choice([13, 15, 16, 16, 16, 19]))), 3)] if rng.random() < 0.6 else [(d(4), 3) for _ in range(4)] if rng.random() < 0.6 else [("-".join(d(4) for _ in range(4)), 3)])
        elif kind == 3:
            row.append((f"{d(3)}-{d(2)}-{d(4)}", 4))
        elif kind == 4:
            six = [f"{x:x}" for x in rng.integers(0, 65536, 8)]
            v6 = ":".join(six) if rng.random() < 0.5 else ":".join(six[: int(rng.integers(1, 4))]) + "::" + ":".join(six[: int(rng.integers(1, 4))])
            row.append((v6 if rng.random() < 0.3 else ".".join(str(x) for x in rng.integers(0, 256 if rng.random() < 0.6 else 12, 4)), 5))
        elif kind == 5:
            land, whole = str(rng.choice(["DE", "GB", "FR", "ES", "NL"])) + d(2), d(int(rng.integers(12, 24)))
            row.extend([(land + whole, 6)] if rng.random() < 0.5 else [(land, 6), *((whole[k : k + 4], 6) for k in range(0, len(whole), 4))])
        elif kind == 6:
            row.append((str(rng.choice(TITLES)).capitalize() if rng.random() < 0.7 else str(rng.choice(TITLES)), 0))
            if rng.random() < 0.3:
                row[-1] = (row[-1][0] + ".", 0)
            full = [name() for _ in range(int(rng.integers(1, 4)))]
            row.extend((x, 7) for x in full)
            if rng.random() < 0.5:  # the last name again, on its own
                plain(3)
                row.append((full[-1], 7))
        elif kind == 7:
            street = str(rng.choice(STREETS[:11])).capitalize()
            row.extend([(d(int(rng.integers(1, 4))), 8), (name(), 8), (street, 8)] if rng.random() < 0.5 else [(street, 8), (name(), 8), (d(int(rng.integers(1, 4))), 8)] if rng.random() < 0.5 else [(name() + "straße", 8), (d(int(rng.integers(1, 4))), 8)])
        elif kind == 8:  # harmless words of the kind
            row.extend([(name(), 0), (word(), 0), (name(), 0)] if rng.random() < 0.5 else [(str(rng.choice(["name", "contact", "dear", "street", "road"])), 0), (word(), 0), (word(), 0)])
        else:
            for _ in range(int(rng.integers(1, 5))):
                form = [d(int(rng.integers(1, 5))), d(4), d(4), f"{rng.integers(1900, 2040)}", f"{d(1)}.{d(int(rng.integers(1, 3)))}", f"{d(4)}-{d(2)}-{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{word()}{d(2)}", f"{d(1)},{d(3)}", f"{d(2)}%", f"@{word()}", d(7), d(10), d(int(rng.integers(5, 13))), d(int(rng.integers(20, 26))), f"{d(3)}{word()}{d(4)}{word()[:2]}{d(3)}"]
                row.append((str(form[int(rng.integers(0, len(form)))]), 0))
        plain(int(rng.integers(1, 4)))
        out.append(row)
    return [(" ".join(t for t, _ in row), row) for row in out]


def fit(rows: list[str] | None = None, epochs: int = EPOCHS) -> Model:
    """Weights from the made-up lines and the texts given, which the rules label: gradient ascent on the pseudo-likelihood."""
    texts, given = [], []
    for text, row in lines():
        texts.append(text)
        parts = tokens_of(pa.array([text]))[1:3]
        ends = np.cumsum([len(t.encode()) + 1 for t, _ in row])
        given.append([row[int(np.searchsorted(ends, p, 'right'))][1] for p in parts[0].tolist()])
    for text in rows or []:
        texts.append(text)
        given.append(None)
    feature, label, docs, number, tokens = [], [], [], [], []
    for k, (text, own) in enumerate(zip(texts, given)):
        data, start, end, _, node, apart = tokens_of(pa.array([text]))
        whole = data.tobytes()
        all_ = [whole[a:z].decode("utf-8", "replace") for a, z in zip(start.tolist(), end.tolist())]
        places = np.arange(len(all_)) + np.cumsum(apart)
        chosen = node
        if own is None:
            into = np.cumsum(np.r_[0, (data & 0xC0) != 0x80])  # bytes to characters
            own = _weak(text, into[start].tolist(), into[end].tolist())
        else:  # of made-up lines the plain words too
            chosen = np.arange(len(all_))
        marks = set(node.tolist())
        for i in chosen.tolist():
            feature.append(_around(all_, apart, i) if i in marks else ["plain"])
            label.append(own[i])
            docs.append(k)
            number.append(int(places[i]))
            tokens.append(all_[i])
    index: dict[str, int] = {"plain": 0}
    n, k = len(label), len(LABELS)
    at = [[index.setdefault(f, len(index)) for f in fs] for fs in feature]
    row = np.repeat(np.arange(n), [len(x) for x in at])
    column = np.array([f for x in at for f in x], np.int64)
    y = np.array(label)
    left, right, skip, gap = edges(np.array(docs), np.array(number), tokens)
    one = np.eye(k)[y]
    near_ = skip | (gap == 0)  # a plain word between is labelled O: two edges to that
    cl, cr, sl, sr = left[near_ & ~skip], right[near_ & ~skip], left[skip], right[skip]
    ol, or_ = left[~near_], right[~near_]
    near = np.zeros((n, k))
    np.add.at(near, sl, one[sr])
    np.add.at(near, sr, one[sl])
    unary, chain, agree = np.zeros((len(index), k)), np.zeros((k, k)), 0.5
    g_unary, g_chain, g_agree = np.full_like(unary, 1e-6), np.full_like(chain, 1e-6), 1e-6
    for _ in range(epochs):
        score = np.stack([np.bincount(row, unary[column, c], n) for c in range(k)], axis=1) + agree * near
        np.add.at(score, cr, chain[y[cl]])
        np.add.at(score, cl, chain[:, y[cr]].T)
        np.add.at(score, or_, chain[0][None, :].repeat(len(or_), 0))
        np.add.at(score, ol, chain[:, 0][None, :].repeat(len(ol), 0))
        delta = (one - _softmax(score)) / n
        du = np.stack([np.bincount(column, delta[row, c], len(index)) for c in range(k)], axis=1) - 2e-6 * unary
        dc = np.zeros_like(chain)
        np.add.at(dc, y[cl], delta[cr])
        np.add.at(dc.T, y[cr], delta[cl])
        dc[0] += delta[or_].sum(axis=0)
        dc[:, 0] += delta[ol].sum(axis=0)
        da = float((delta * near).sum())
        g_unary, g_chain, g_agree = g_unary + du**2, g_chain + dc**2, g_agree + da**2
        unary += 0.5 * du / np.sqrt(g_unary)
        chain += 0.3 * dc / np.sqrt(g_chain)
        agree = float(np.clip(agree + 0.3 * da / np.sqrt(g_agree), 0.5, 6.0))
    plain = unary[0].copy()
    plain[1:] = np.minimum(plain[1:], plain[0] - _room(chain)[1:] - 0.1)
    return Model(index, unary, chain, agree, plain)


def _room(chain: np.ndarray) -> np.ndarray:
    """By how much neighbours can favour each label over O at most."""
    return -((chain[:, :1] - chain).min(axis=0) + (chain[:1] - chain).min(axis=1))


def plain_is_o(model: Model) -> bool:
    """Whether O is a plain word's best label whatever its neighbours send."""
    return model.plain is not None and bool((model.plain[0] - model.plain[1:] > _room(model.chain)[1:]).all())


def _around(tokens: list[str], apart: np.ndarray, i: int) -> list[str]:
    """A token's features among its text's tokens; behind a sign others are no part of it."""
    before = beside(tokens[i - 1], apart[i]) if i else ""
    earlier = tokens[i - 2] if i > 1 and not apart[i] and not apart[i - 1] else ""
    after = beside(tokens[i + 1], apart[i + 1]) if i + 1 < len(tokens) else ""
    out = features(tokens[i], before, after, earlier)
    j = i
    while j and not apart[j] and i - j < BACK and re.fullmatch(r"[0-9.()-]+", tokens[j]):
        j -= 1
    if j < i:
        out.append("digits behind plus" if tokens[j].startswith("+") else "digits behind iban" if re.fullmatch(r"[A-Z]{2}[0-9]{2}", tokens[j]) else f"digits behind {min(i - j, 3)}")
    return out


#: Groups of digits that are looked back over for what opens them.
BACK = 8


def entities(column: pa.Array, model: Model) -> Iterator[tuple[int, str, int, int, bytes]]:
    """(row, label, first byte, byte behind the last, value): neighbouring tokens of one label are one entity."""
    for a, z in steps(column):
        part = column.slice(a, z - a)
        data, start, end, ptr, free, apart = tokens_of(part)
        if not len(free):
            continue
        _, offsets = raw(part)
        docs = np.searchsorted(ptr, free, "right") - 1
        number = free + np.cumsum(apart)[free]
        whole = data.tobytes()

        def text(i: int) -> str:
            return whole[start[i] : end[i]].decode("utf-8", "replace")

        tokens = [text(i) for i in free.tolist()]
        unary = np.zeros((len(free), len(LABELS)))
        for r, (i, doc, token) in enumerate(zip(free.tolist(), docs.tolist(), tokens)):
            p, q = int(ptr[doc]), int(ptr[doc + 1])
            lo = max(p, i - BACK)
            held = [text(j) if j != i else token for j in range(lo, min(q, i + 2))]
            signs = apart[lo : min(q, i + 2)].copy()
            signs[0] = signs[0] and lo > p
            for f in _around(held, signs, i - lo):
                if (c := model.index.get(f)) is not None:
                    unary[r] += model.unary[c]
        left, right, skip, gap = edges(docs, number, tokens)
        place = np.arange(len(start)) + np.cumsum(apart)
        bound = np.minimum(ptr, len(start) - 1)
        unary = with_ends(unary, docs, number, place[bound[:-1]], place[np.maximum(ptr[1:] - 1, 0)], model)
        label = marginals(Field(unary, left, right, skip, gap), model).argmax(axis=1)
        for r, s in _runs(label, docs, number, tokens):
            b, e = int(start[free[r]]), int(end[free[s]])
            while b < e and chr(whole[b]) in _EDGE:
                b += 1
            while e > b and chr(whole[e - 1]) in _EDGE:
                e -= 1
            if b < e:
                o = int(offsets[docs[r]])
                yield a + int(docs[r]), LABELS[label[r]], b - o, e - o, whole[b:e]


_OPENS = re.compile(r"\W*[A-Z]{2}[0-9]{2}")


def _runs(label: np.ndarray, docs: np.ndarray, number: np.ndarray, tokens: list[str]) -> Iterator[tuple[int, int]]:
    """First and last node of each entity; a run with too many digits is several, and one with too few is none. An address has several tokens, an
    IBAN begins with its country."""
    r, n = 0, len(label)
    digits = [len(re.sub(r"\D", "", t)) for t in tokens]
    while r < n:
        if not label[r]:
            r += 1
            continue
        name, s, count = LABELS[label[r]], r, digits[r]
        least, most = DIGITS.get(name, (0, 10**9))
        full = 16 if name == "CARD" else most
        while name in JOINED and s + 1 < n and docs[s + 1] == docs[r] and number[s + 1] == number[s] + 1 and label[s + 1] == label[r] and (count + digits[s + 1] <= most and count < full):
            s += 1
            count += digits[s]
        if least <= count <= most and (name != "ADDRESS" or s > r) and (name != "IBAN" or _OPENS.match(tokens[r])):
            yield r, s
        r = s + 1


def _scan(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        column = strings(batch.column("text"))
        out = [(ids[row], label, b, e, value.decode("utf-8", "replace")) for row, label, b, e, value in entities(column, model)]
        if out:
            a, b, c, d, e = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b), pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(e)], ["doc_id", "label", "begin", "end", "value"])


def sample(docs: DataFrame, most: int = SAMPLE) -> list[str]:
    """About ``most`` texts, chosen by a hash of doc_id."""
    known = text_id(docs).where("doc_id is not null and text is not null")
    n = known.select("doc_id").count()
    if not n:
        return []
    limit = min(2**63 - 1, int(-(2**63) + min(1.0, most / n) * 2**64))
    chosen = known.where(F.xxhash64("doc_id", F.lit("pii-model")) <= limit)
    return [r["text"] for r in chosen.orderBy("doc_id", "text").collect()]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per piece of personal data: doc_id, label, byte span [begin, end) in the UTF-8 text, value. Neighbouring tokens of one label are one
    piece where that is of several tokens (``JOINED``); phone and card numbers have as many digits as ``DIGITS`` says.

    Without a model, one is fitted on ``sample(docs)`` and the made-up lines; it is the same for the same rows. Null and empty
    texts have none; a null doc_id and repeated rows are scanned like others, each for itself; other columns are not read. Of labels that are
    equally likely the first in ``LABELS`` counts. An empty table gives no rows. No exchange but the count of rows.
    """
    model = model or fit(sample(docs))
    return text_id(docs).mapInArrow(lambda batches: _scan(batches, model), SCHEMA)
