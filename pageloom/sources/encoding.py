"""How the bytes of a page become text: marks, labels, what the page declares, and the decoders of the web."""

from __future__ import annotations

import codecs
import re

#: Canonical name, Python's codec, labels (the standard's table of encodings, by the names that pages use).
_TABLE = """
UTF-8|utf-8|unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8
IBM866|cp866|866 cp866 csibm866 ibm866
ISO-8859-2|iso8859-2|csisolatin2 iso-8859-2 iso-ir-101 iso8859-2 iso88592 iso_8859-2 iso_8859-2:1987 l2 latin2
ISO-8859-3|iso8859-3|csisolatin3 iso-8859-3 iso-ir-109 iso8859-3 iso88593 iso_8859-3 iso_8859-3:1988 l3 latin3
ISO-8859-4|iso8859-4|csisolatin4 iso-8859-4 iso-ir-110 iso8859-4 iso88594 iso_8859-4 iso_8859-4:1988 l4 latin4
ISO-8859-5|iso8859-5|csisolatincyrillic cyrillic iso-8859-5 iso-ir-144 iso8859-5 iso88595 iso_8859-5 iso_8859-5:1988
ISO-8859-6|iso8859-6|arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6 iso-8859-6-e iso-8859-6-i iso-ir-127 iso8859-6 iso88596 iso_8859-6 iso_8859-6:1987
ISO-8859-7|iso8859-7|csisolatingreek ecma-118 elot_928 greek greek8 iso-8859-7 iso-ir-126 iso8859-7 iso88597 iso_8859-7 iso_8859-7:1987 sun_eu_greek
ISO-8859-8|iso8859-8|csiso88598e csisolatinhebrew hebrew iso-8859-8 iso-8859-8-e iso-ir-138 iso8859-8 iso88598 iso_8859-8 iso_8859-8:1988 visual
ISO-8859-8-I|iso8859-8|csiso88598i iso-8859-8-i logical
ISO-8859-10|iso8859-10|csisolatin6 iso-8859-10 iso-ir-157 iso8859-10 iso885910 l6 latin6
ISO-8859-13|iso8859-13|iso-8859-13 iso8859-13 iso885913
ISO-8859-14|iso8859-14|iso-8859-14 iso8859-14 iso885914
ISO-8859-15|iso8859-15|csisolatin9 iso-8859-15 iso8859-15 iso885915 iso_8859-15 l9
ISO-8859-16|iso8859-16|iso-8859-16
KOI8-R|koi8-r|cskoi8r koi koi8 koi8-r koi8_r
KOI8-U|koi8-u|koi8-ru koi8-u
macintosh|mac-roman|csmacintosh mac macintosh x-mac-roman
windows-874|cp874|dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874
windows-1250|cp1250|cp1250 windows-1250 x-cp1250
windows-1251|cp1251|cp1251 windows-1251 x-cp1251
windows-1252|cp1252|ansi_x3.4-1968 ascii cp1252 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii windows-1252 x-cp1252
windows-1253|cp1253|cp1253 windows-1253 x-cp1253
windows-1254|cp1254|cp1254 csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5 windows-1254 x-cp1254
windows-1255|cp1255|cp1255 windows-1255 x-cp1255
windows-1256|cp1256|cp1256 windows-1256 x-cp1256
windows-1257|cp1257|cp1257 windows-1257 x-cp1257
windows-1258|cp1258|cp1258 windows-1258 x-cp1258
x-mac-cyrillic|mac-cyrillic|x-mac-cyrillic x-mac-ukrainian
GBK|gb18030|chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk
gb18030|gb18030|gb18030
Big5|big5hkscs|big5 big5-hkscs cn-big5 csbig5 x-x-big5
EUC-JP|euc-jp|cseucpkdfmtjapanese euc-jp x-euc-jp
ISO-2022-JP|iso2022-jp|csiso2022jp iso-2022-jp
Shift_JIS|cp932|csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis
EUC-KR|cp949|cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949
replacement||csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr replacement
UTF-16BE|utf-16-be|unicodefffe utf-16be
UTF-16LE|utf-16-le|csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le
x-user-defined||x-user-defined
"""
LABELS: dict[str, str] = {}
_CODECS: dict[str, str] = {}
for _line in _TABLE.strip().splitlines():
    _name, _codec, _labels = _line.split("|")
    _CODECS[_name] = _codec
    LABELS.update(dict.fromkeys(_labels.split(), _name))

_BLANK = " \t\n\f\r"
_CHARSET = re.compile(r"charset[ \t\n\f\r]*=[ \t\n\f\r]*(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\f\r;\"']+))", re.IGNORECASE)
_XML = re.compile(rb"<\?xml[^>]*?encoding[ \t\n\f\r]*=[ \t\n\f\r]*(?:\"([^\"]*)\"|'([^']*)')[^>]*>")
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^ \t\n\f\r/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!/?][^>]*>", re.DOTALL)
_PAIR = re.compile(r"([^ \t\n\f\r/>=]+)(?:[ \t\n\f\r]*=[ \t\n\f\r]*(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\f\r>]+)))?")
_HEAD = frozenset("html head base basefont bgsound link meta noscript script style title template noframes textarea".split())
_OPAQUE = frozenset("script style title textarea".split())
#: A declaration counts anywhere in so many bytes; behind them only in the head.
PRESCAN = 1024


def resolve_label(label: str | None) -> str | None:
    """The canonical name of a label, None if there is none."""
    return LABELS.get(label.strip(_BLANK).lower()) if label else None


def caller_label(label: str | None) -> str | None:
    """As ``resolve_label``, but Python's spellings are understood, and a label that nobody knows is an error."""
    if label is None:
        return None
    found = resolve_label(label)
    if found:
        return found
    try:
        name = codecs.lookup(label.strip()).name
    except LookupError:
        raise ValueError(f"unknown encoding {label!r}") from None
    return resolve_label(name) or resolve_label(name.replace("_", "-")) or resolve_label(name.replace("iso8859", "iso-8859"))


def column_label(label: str | None) -> str | None:
    """As ``caller_label``, but a label that nobody knows is passed over: one bad row doesn't end a job."""
    try:
        return caller_label(label)
    except ValueError:
        return None


def _declared(label: str) -> str | None:
    found = resolve_label(label)
    return {"UTF-16LE": "UTF-8", "UTF-16BE": "UTF-8", "x-user-defined": "windows-1252"}.get(found, found)


def prescan(body: bytes) -> str | None:
    """What the page declares: an XML declaration at its very beginning, else the first meta element with a label that is known."""
    if body.startswith(b"<?xml") and (m := _XML.match(body)):
        found = _declared((m[1] or m[2] or b"").decode("latin-1"))
        if found:
            return found
    text, at, head = body.decode("latin-1"), 0, True
    while m := _PIECE.search(text, at):
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            head = head and name != "head"
            continue
        head = head and name in _HEAD
        if m.start() >= PRESCAN and not head:
            return None
        if name in _OPAQUE:
            end = re.compile(rf"</{name}", re.IGNORECASE).search(text, at)
            at = end.start() if end else len(text)
        elif name == "meta":
            attrs: dict[str, str] = {}
            for key, a, b, c in _PAIR.findall(m[3]):
                attrs.setdefault(key.lower(), a or b or c)
            label = attrs.get("charset")
            if label is None and attrs.get("http-equiv", "").lower() == "content-type" and (c := _CHARSET.search(attrs.get("content", ""))):
                label = c[1] or c[2] or c[3]
            if label and (found := _declared(label)):
                return found
    return None


def resolve(body: bytes, label: str | None = None) -> str:
    """Canonical name of a page's encoding: its mark, UTF-16 by its first signs, the caller's label, what it declares, UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"), (b"<\0?\0", "UTF-16LE"), (b"\0<\0?", "UTF-16BE")):
        if body.startswith(mark):
            return name
    return label or prescan(body) or "UTF-8"


def decode(body: bytes, name: str) -> str:
    for mark in (b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff"):
        if body.startswith(mark):
            body = body[len(mark) :]
            break
    if name == "replacement":
        return "�" if body else ""
    if name == "x-user-defined":
        return body.decode("latin-1").translate({c: 0xF700 + c for c in range(128, 256)})
    if name == "windows-1252" or name.startswith(("windows-125", "windows-874")):
        return body.decode(_CODECS[name], "c1")
    return body.decode(_CODECS[name], "replace")


def _c1(error: UnicodeError) -> tuple[str, int]:
    """Bytes that a code page leaves open are the control characters of their number."""
    body = error.object[error.start : error.end]  # type: ignore[attr-defined]
    return "".join(chr(c) if c < 0xA0 else "�" for c in body), error.end  # type: ignore[attr-defined]


codecs.register_error("c1", _c1)


def detect_encoding(html: bytes | str, encoding: str | None = None) -> str:
    if isinstance(html, str):
        return "UTF-8"
    return resolve(bytes(html), resolve_label(encoding))


def text_of(html: bytes | bytearray | memoryview | str | None, label: str | None = None) -> str:
    """A page's text; str is text already, and a label other than UTF-8 is an error with it."""
    if html is None:
        return ""
    if isinstance(html, str):
        if label not in (None, "UTF-8"):
            raise ValueError(f"a page that is text has no encoding {label!r}")
        return html
    body = bytes(html)
    return decode(body, resolve(body, label))
