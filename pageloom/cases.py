"""Small pages with what each operator must give for them, as queries: pages travel as bytes through the DataFrame path, and what is expected
stands in the SQL as literals. For those operators that data rendered from tables doesn't reach."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.audit import schemas as audited
from pageloom.functions import Plan, check, detect_encoding_column, extract, node_identity, resolve_label, terminals, to_absolute
from pageloom.page import Page
from pageloom.plans import verdict
from pageloom.plans.xpath import is_xpath
from pageloom.scan import scan_source
from pageloom.spec import Many, One, PageObject, field

Case = tuple[bytes | str, str | None, str, list[str]]
_LONG = "x" * 1100
_E9 = b"<p>\xe9"
_CYRILLIC = b"<meta charset=windows-1251>"

#: name: (page, label, selector, values).
PAGES: dict[str, list[Case]] = {
    "b02_prescan": [
        (b"<meta charset=iso-8859-1>" + _E9, None, "p::text", ["é"]),
        (b'<meta http-equiv="Content-Type" content="text/html; charset=windows-1251">' + _E9, None, "p::text", ["й"]),
        (b"<!-- <meta charset=koi8-r> -->" + _CYRILLIC + _E9, None, "p::text", ["й"]),
        (b'<script>"<meta charset=koi8-r>"</script>' + _CYRILLIC + _E9, None, "p::text", ["й"]),
        (b"<title><meta charset=koi8-r></title>" + _CYRILLIC + _E9, None, "p::text", ["й"]),
        (b"<meta charset=nonsense>" + _CYRILLIC + _E9, None, "p::text", ["й"]),
        (b"<body><i>" + _LONG.encode() + b"</i>" + _CYRILLIC + _E9, None, "p::text", ["�"]),
        (b"<head>" + b"<meta name=a>" * 100 + _CYRILLIC + b"</head>" + _E9, None, "p::text", ["й"]),
    ],
    "b03_xml_declaration": [
        (b'<?xml version="1.0" encoding="windows-1251"?><meta charset=koi8-r>' + _E9, None, "p::text", ["й"]),
        (b'\n<?xml version="1.0" encoding="windows-1251"?><meta charset=koi8-r>' + _E9, None, "p::text", ["И"]),
    ],
    "b04_declared_fixups": [("<meta charset=utf-16><p>é", None, "p::text", ["é"]), (b"<meta charset=x-user-defined>" + _E9, None, "p::text", ["é"])],
    "b05_labels": [
        (_E9, " Latin1 ", "p::text", ["é"]),
        (_E9, "CP1251", "p::text", ["й"]),
        (b"<p>\xa4", "iso8859_15", "p::text", ["€"]),
        (_CYRILLIC + _E9, "nobody-knows", "p::text", ["й"]),
        (_CYRILLIC + _E9, "koi8-r", "p::text", ["И"]),
    ],
    "b07_transcode": [
        ("<p>é日".encode("utf-16"), None, "p::text", ["é日"]),
        (b"\xfe\xff" + "<p>ü".encode("utf-16-be"), "koi8-r", "p::text", ["ü"]),
        ('<?xml version="1.0"?><p>x'.encode("utf-16-le"), None, "p::text", ["x"]),
        ("<p>日本".encode("iso2022_jp"), "iso-2022-jp", "p::text", ["日本"]),
        (b"<p>x", "iso-2022-kr", "p::text", []),
        (b"<p>a\xffb", None, "p::text", ["a�b"]),
    ],
    "b08_decoders": [
        (b"<p>\x80\x93\x94", "windows-1252", "p::text", ["€“”"]),
        (b"<p>\x80", "x-user-defined", "p::text", [""]),
        ("<p>中".encode("gbk"), "gb2312", "p::text", ["中"]),
        ("<p>中".encode("big5"), "big5", "p::text", ["中"]),
        ("<p>한".encode("euc-kr"), "korean", "p::text", ["한"]),
        ("<p>日".encode("shift_jis"), "x-sjis", "p::text", ["日"]),
        ("<p>日".encode("euc-jp"), "euc-jp", "p::text", ["日"]),
        (b"<p>\xa7", "koi8-u", "p::text", ["ї"]),
        (b"<p>\xe9", "macintosh", "p::text", ["È"]),
    ],
    "b09_edges": [(b"  \n\xef\xbb\xbf<p>k\0m", None, "p::text", ["km"]), (b"\0<p>k\0\0m</p>\0", None, "p::text", ["km"]), ("\x0b\n <b>k</b>\t ", None, "b", ["<b>k</b>"])],
    "b10_line_ends": [("<p>k\r\nm\rn", None, "p::text", ["k\nm\nn"]), ('<a t="k\r\nm">', None, "a::attr(t)", ["k\nm"]), ("<b>\r\n</b>", None, "b", ["<b>\n</b>"]), ("<p>k&#13;m", None, "p::text", ["k\rm"])],
    "b12_comments": [
        ("<p>k<!-- c -->m", None, "p::text", ["k", "m"]),
        ("<p>k<!-->m-->n", None, "p::text", ["k", "m-->n"]),
        ("<p>k<!--->m", None, "p::text", ["k", "m"]),
        ("<p>k<!-- c --!>m", None, "p::text", ["k", "m"]),
        ("<p>k<!-- never closed <b>m</b>", None, "p::text", ["k"]),
    ],
    "b13_doctype": [("<p>k<!DocType x>m", None, "p::text", ["km"]), ("<p>k</>m", None, "p::text", ["km"]), ("<!doctype html><p>k", None, "p::text", ["k"])],
    "b14_declarations": [("<p>k<!other>m", None, "p::text", ["k", "m"]), ("<p>k<![CDATA[c]]>m", None, "p::text", ["k", "m"]), ("<p>k<?php c ?>m", None, "p::text", ["k", "m"])],
    "b15_end_tags": [
        ('<p>k</p t="1>2">m', None, "body::text", ["m"]),
        ("<p>k</9>m", None, "p::text", ["k", "m"]),
        ("<p>k</", None, "p::text", ["k</"]),
        ("<p>k</P  >m", None, "p::text", ["k"]),
    ],
    "b16_attributes": [
        ("<input a='1' b=\"2\" c=3 d>", None, "input::attr(a), input::attr(b), input::attr(c), input::attr(d)", ["1", "2", "3", ""]),
        ("<input checked>", None, "input::attr(checked)", ["checked"]),
        ("<a =x=1>k</a>", None, "a::attr(x)", []),
        ("<a/href=/y/>k</a>", None, "a::attr(href)", ["/y/"]),
        ("<a t=1 t=2 T=3>", None, "a::attr(t)", ["1"]),
        ('<p>k</p><a href="m', None, "a::attr(href)", []),
    ],
    "b17_names": [("<p<img>k", None, "p::text", []), ("<p/class=k>m", None, "p::attr(class)", ["k"]), ("<DIV>k</dIv>", None, "div::text", ["k"])],
    "b18_data_modes": [
        ("<script>k<b>m</b></script>", None, "script::text", ["k<b>m</b>"]),
        ("<textarea>k<b>&amp;</textarea>", None, "textarea::text", ["k<b>&"]),
        ("<xmp><i>k&amp;</xmp>", None, "xmp::text", ["<i>k&amp;"]),
        ("<noscript><i>k</i></noscript>", None, "noscript i::text", ["k"]),
        ("<p>k<plaintext><b>m</plaintext>", None, "plaintext::text", ["<b>m</plaintext>"]),
        ("<style>k</stylex></style><p>m", None, "style::text", ["k</stylex>"]),
    ],
    "b19_script_states": [
        ("<script><!--<script>k</script>m--></script><p>n", None, "script::text", ["<!--<script>k</script>m-->"]),
        ("<script><!--<script>k</script>m--></script><p>n", None, "p::text", ["n"]),
        ("<script><!--k</script><p>n", None, "p::text", ["n"]),
    ],
    "b20_self_closing": [("<div/>k", None, "div::text", []), ("<div/>k", None, "body::text", ["k"]), ("<script/><p>k", None, "p::text", ["k"]), ("<i/><b>k</b>", None, "i b::text", [])],
    "b21_void": [
        ("<div><param><i>k</i></div>", None, "div > i::text", ["k"]),
        ("<div><isindex><i>k</i></div>", None, "div > i::text", ["k"]),
        ("<div><embed><i>k</i></div>", None, "embed > i::text", ["k"]),
        ("<div><wbr>k</div>", None, "wbr::text", ["k"]),
        ("<div><br>k<hr>m</div>", None, "div::text", ["k", "m"]),
    ],
    "b22_implied_close": [
        ("<table><tr><td>k<td>m<tr><td>n</table>", None, "tr > td::text", ["k", "m", "n"]),
        ("<dl><dt>k<dd>m<dt>n</dl>", None, "dl > dt::text", ["k", "n"]),
        ("<dl><dt>k<dt>m</dl>", None, "dl > dt::text", ["k"]),
        ("<select><option>k<option>m</select>", None, "select > option::text", ["k", "m"]),
        ("<div><i>k<p>m</div>", None, "div > p::text", ["m"]),
        ("<div><em>k<p>m</div>", None, "div > p::text", []),
        ("<table><colgroup><col><thead><tr><th>K<tbody><tr><td>M</table>", None, "table > tbody td::text", ["M"]),
        ("<div><a>k<a>m</div>", None, "div > a::text", ["k", "m"]),
        ("<ruby><rt>k<rt>m</ruby>", None, "ruby > rt::text", ["k"]),
        ("<div><p>k<h3>m</h3><p>n</div>", None, "div > p::text", ["k", "n"]),
        ("<div><legend>K<fieldset>m</div>", None, "div > fieldset::text", ["m"]),
        ("<div><form>k<form>m</div>", None, "div > form::text", ["k", "m"]),
    ],
    "b23_end_tag_scope": [
        ("<div><table><tr><td>K</div>M</td></tr></table>", None, "td::text", ["KM"]),
        ("<nav><ul><div>K</nav>M", None, "div::text", ["KM"]),
        ("<span><table><tr><td>K</span>M", None, "td::text", ["KM"]),
        ("<table><tbody><tr><td>K</tbody>M</table>", None, "table::text", ["M"]),
        ("<nav><blockquote>K</nav>M", None, "blockquote::text", ["K"]),
        ("<div><table><tr><td>K</body>M", None, "td::text", ["K"]),
        ("<tr><table>K</tr>M", None, "table::text", ["KM"]),
    ],
    "b24_text_rejoin": [("<p>k</b>m<!doctype q></>n</p>", None, "p::text", ["kmn"]), ("<p>k&am</b>p;m</p>", None, "p::text", ["k&amp;m"]), ("<p>k</b><!-- c --></b>m</p>", None, "p::text", ["k", "m"])],
    "b25_frame": [
        ("k", None, "html > body::text", ["k"]),
        ("<title>T</title>k", None, "html > head > title::text", ["T"]),
        ("<frameset x=1>", None, "html > frameset::attr(x)", ["1"]),
        ("<frameset x=1>", None, "body frameset::attr(x)", []),
        ("  <p>k", None, "html::text", []),
    ],
    "b26_redundant_frame_tags": [
        ("<html lang=k><html lang=m><p>n", None, "html::attr(lang)", ["k"]),
        ("<body class=k><body class=m>n", None, "body::attr(class)", ["k"]),
        ("<body>k<body>m</body>n</body>", None, "body::text", ["kmn"]),
        ("<body><p>k</p><head><title>T</title></head>", None, "head::attr(x)", []),
    ],
    "b27_body_after_head": [("<head><title>T</title><p>k", None, "body > p::text", ["k"]), ("<head><meta name=a>k", None, "body::text", ["k"]), ("<head><i>k</i>", None, "head i::text", [])],
    "b28_after_html": [("<html><body><p>k</body></html><div>m</div>", None, "div::text", ["m"]), ("<html><body><p>k</body></html><div>m</div>", None, "body div::text", [])],
    "b29_self_closed_frame_tag": [("<html><body><div><html/>k", None, "div::text", []), ("<html><body><div><html/>k", None, "body::text", ["k"])],
    "b30_references": [
        ("<p>&eacute;&#x41;&#66;&#128;", None, "p::text", ["éAB€"]),
        ("<p>&notit;&nope;&", None, "p::text", ["¬it;&nope;&"]),
        ("<p>&#0;&#xD800;&#1114112;", None, "p::text", ["���"]),
        ('<a t="&ampx &amp=1 &lt;">', None, "a::attr(t)", ["&ampx &amp=1 <"]),
        ("<p>&copy&reg", None, "p::text", ["©®"]),
    ],
    "c13_unquoted_value": [("<a x=k><a x=k2>", None, "[x=k]::attr(x)", ["k"]), ("<a x=k-1>", None, "[x=k-1]::attr(x)", ["k-1"])],
    "c14_escapes": [("<a x=k>", None, '[x="\\6b"]::attr(x)', ["k"]), ("<a data-k=m>", None, "a::attr(data-\\6b)", ["m"]), ("<a x=k>", None, "a::attr('x')", ["k"]), ("<a x='k\"m'>", None, '[x="k\\"m"]::attr(x)', ['k"m'])],
    "e08_universal_scope": [
        ("<div>k<b>m<i>n</i></b></div>", None, "div *::text", ["k", "m", "n"]),
        ("<div>k<b>m<i>n</i></b></div>", None, "div * ::text", ["m", "n"]),
        ("<div>k<b>m<i>n</i></b></div>", None, "div > *::text", ["m"]),
    ],
    "f04_text_tests_in_groups": [("<p>k</p><b>m</b><b>k</b>", None, 'p:contains("k")::text, b:contains("m")::text', ["k", "m"]), ("<b>m</b><p>k</p>", None, 'p:contains("k")::text, b:contains("k")::text', ["k"])],
}

#: name: (role, selector, whether it runs).
VERDICTS: dict[str, list[tuple[str, str, bool]]] = {
    "c13_unquoted_refused": [("flat", "[x=2]::attr(x)", False), ("flat", '[x="2"]::attr(x)', True), ("flat", "[x=a.b]::attr(x)", False), ("flat", "[x=_a]::attr(x)", True)],
    "c14_escapes_refused": [("flat", ".\\6b::text", False), ("flat", "#\\6b::text", False), ("flat", "p::attr(1)", False), ("flat", "p::attr(\\31)", False), ("flat", "p::attr(--x)", False), ("flat", "p::attr(data-1)", True), ("flat", 'p::attr("x")', True)],
    "e08_scope_refused": [("flat", "div*::text", False), ("flat", "div *::text", True)],
    "f05_mixes": [
        ("flat", "b, b::text", False),
        ("flat", "li:last-child::text, a::text", False),
        ("flat", "p:has(b)::text, a::text", False),
        ("flat", 'p::attr(id), p:contains("k")::attr(class)', False),
        ("flat", 'p ::text, p:contains("k")::text', False),
        ("flat", "b::text, a::attr(href)", True),
        ("flat", "b, i", True),
    ],
    "g08_subfield_limits": [
        ("subfield", ".//a/@href", True),
        ("subfield", "p::text, a::text", False),
        ("subfield", "p:has(a)::text", False),
        ("subfield", "a + b::text", False),
        ("subfield", "::attr(id)", True),
        ("subfield", "p:last-child::text", False),
        ("container", ".card", True),
        ("container", "div, span", False),
        ("container", "div:has(a)", False),
        ("container", ".card::text", False),
    ],
    "i02_verdicts": [
        ("flat", "dt +", False),
        ("flat", "a >> b", False),
        ("flat", "p::first-line", False),
        ("flat", "ns|p", False),
        ("flat", "a:hover", False),
        ("flat", "//DIV", False),
        ("flat", "//a/..", False),
        ("flat", "//p[position()<3]/text()", False),
        ("flat", "//a[@href]/@href", True),
        ("flat", "ul > li:nth-child(2n)::text", True),
        ("flat", "p:not(.a, .b)::text", True),
        ("flat", "li:last-child > b::text", False),
        ("flat", "li:last-child b::text", True),
    ],
}
_ROLES = {"flat": verdict.flat, "container": verdict.container, "subfield": verdict.subfield}


def _runs(role: str, selector: str) -> bool:
    try:
        _ROLES[role](selector)
    except verdict.Unsupported:
        return False
    return True


def _raises(kind: type[Exception], call: Callable) -> str:
    try:
        call()
    except kind:
        return "refused"
    return "taken"


class Base(PageObject):
    title = field("h1::text").typed_as("string")
    price = field(".price::text", meta={"unit": "EUR"}).re_first(r"([0-9]+)")
    tags = field(".tag::text", all=True)

    class Processors:
        title = [F.upper]
        price = [lambda c: F.concat(c, F.lit("!"))]


class Derived(Base):
    price = field("b::text", out=[])
    box = field("div.box").as_node()
    frame = field("body").as_node()
    items = field("li", all=True).as_node()
    link = field("a::attr(href)", out=[lambda c: to_absolute(F.lit("http://host/dir/page"))(c)])
    rows = Many("li", name=field("i::text").map(F.upper), all=field("i::text", all=True))
    first = One("li", name="i::text")
    tags = None


@dataclass
class Row:
    b: str
    a: str


class Typed(PageObject):
    rows = Many("li", item=Row, a="i::text", b="::attr(id)")


_PAGE = "<h1>k</h1><span class=price>12 EUR</span><b>7</b><div class=box id=z>in<i>side</i></div><a href=../q>l</a><span class=tag>t1</span><span class=tag>t2</span><ul><li id=l1><i>x</i><i>y</i><li id=l2></ul>"


def _objects(cls: type[PageObject], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """Values of a page object's columns, as text, one row each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = cls.select_from(spark.createDataFrame([(_PAGE,)], "html string"))
        shown = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.expr(e).cast("string"), F.lit("NULL")).alias("found")) for c, e in (x.split("=", 1) for x in columns)])
        return found.select(F.inline(shown))

    return run


def _told(rows: Callable[[], list[tuple[str, object]]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.createDataFrame([(k, str(v)) for k, v in rows()], "asked string, found string")


_SOURCE = 'r.css("p::text")\nr.xpath("a/b")\nx = page.field("t", name)\nloader.add_css("f", "a >> b")\nMany(".card", a="b::text")\n'
_TOLD: dict[str, tuple[Callable[[], list[tuple[str, object]]], list[tuple[str, str]]]] = {
    "a03_bytes_like": (
        lambda: [(kind.__name__, extract(kind("<p>é".encode()), ["p::text"])[0][0]) for kind in (bytes, bytearray, memoryview)],
        [("bytes", "é"), ("bytearray", "é"), ("memoryview", "é")],
    ),
    "h09_schema": (lambda: [("fields", ",".join(n for n, _ in Derived.schema()["fields"])), ("groups", ",".join(n for n, *_ in Derived.schema()["groups"]))], [("fields", "title,price,box,frame,items,link"), ("groups", "rows,first")]),
    "h05_guards": (
        lambda: [
            ("joined", _raises(TypeError, lambda: field("p", join=",").as_node())),
            ("value", _raises(TypeError, lambda: field("p::text").as_node())),
            ("element", _raises(TypeError, lambda: field("p").as_node())),
            ("in a group", _raises(TypeError, lambda: Many("li", x=field("p").as_node()))),
            ("frame", _raises(TypeError, lambda: field("*").as_node())),
            ("frame by name", _raises(TypeError, lambda: field("body").as_node())),
            ("mapped", _raises(TypeError, lambda: type("Mapped", (PageObject,), {"x": field("p").as_node().map(F.upper)}))),
            ("undecided", _raises(TypeError, lambda: type("Undecided", (PageObject,), {"x": field("p", out=[F.upper])}))),
            ("decided", _raises(TypeError, lambda: type("Decided", (PageObject,), {"x": field("p", out=[F.upper]).as_value()}))),
            ("re_first of a list", _raises(TypeError, lambda: field("p::text", all=True).re_first("x"))),
        ],
        [("joined", "refused"), ("value", "refused"), ("element", "taken"), ("in a group", "refused"), ("frame", "refused"), ("frame by name", "taken"), ("mapped", "refused"), ("undecided", "refused"), ("decided", "taken"), ("re_first of a list", "refused")],
    ),
    "i01_check": (
        lambda: [
            ("mapping", check({"a": "p::text", "b": "dt +"}).ok),
            ("list", len(check(["p::text", "a"]).fields)),
            ("pairs", check([("n", "p::text")]).fields[0].name),
            ("string", _raises(TypeError, lambda: check("p::text"))),
            ("groups", [f.supported for f in check(groups={"g": ("li", {"a": "b::text", "c": "b:has(i)::text"})}).groups[0].subfields]),
            ("reason", bool(check(["dt +"]).unsupported[0].reason)),
        ],
        [("mapping", "False"), ("list", "2"), ("pairs", "n"), ("string", "refused"), ("groups", "[True, False]"), ("reason", "True")],
    ),
    "i03_reasons": (
        lambda: [(q, str(check([q]).fields[0].reason is not None)) for q in ("p::first-line", "//a/..", "b, b::text", "p::text")],
        [("p::first-line", "True"), ("//a/..", "True"), ("b, b::text", "True"), ("p::text", "False")],
    ),
    "i04_strict": (
        lambda: [("strict", _raises(verdict.UnsupportedSelector, lambda: extract("<p>k", ["dt +"]))), ("lenient", extract("<p>k", ["dt +", "p::text"], strict=False)), ("page", _raises(ValueError, lambda: Page().field("x", "dt +")))],
        [("strict", "refused"), ("lenient", "[[], ['k']]"), ("page", "refused")],
    ),
    "i05_budgets": (
        lambda: [("members", check([f".c{i}::text" for i in range(129)]).over_budget), ("within", check([f".c{i}::text" for i in range(128)]).over_budget), ("siblings", check([f"a ~ b{i}::text" for i in range(65)]).over_budget), ("raised", _raises(ValueError, check([f".c{i}::text" for i in range(129)]).raise_for_status))],
        [("members", "True"), ("within", "False"), ("siblings", "True"), ("raised", "refused")],
    ),
    "i06_terminals": (
        lambda: [(q, terminals(q)) for q in ("a::text", "a ::attr(x)", "a", "normalize-space(//a)", "a::text, a::attr(x)", "a >", "//a/@x")],
        [("a::text", "text"), ("a ::attr(x)", "attr"), ("a", "outer"), ("normalize-space(//a)", "normalize-space"), ("a::text, a::attr(x)", "None"), ("a >", "None"), ("//a/@x", "attr")],
    ),
    "i07_node_identity": (
        lambda: [(q, node_identity(q)) for q in ("div.a", "*", "body", "body.a", "div, span", "p, p.x", "dt +")],
        [("div.a", "('div', False)"), ("*", "(None, True)"), ("body", "('body', True)"), ("body.a", "('body', False)"), ("div, span", "(None, False)"), ("p, p.x", "('p', False)"), ("dt +", "(None, True)")],
    ),
    "i08_resolve_label": (lambda: [(x, resolve_label(x)) for x in (" Latin1 ", "utf8", "x-sjis", "nope", "")], [(" Latin1 ", "windows-1252"), ("utf8", "UTF-8"), ("x-sjis", "Shift_JIS"), ("nope", "None"), ("", "None")]),
    "i09_audit": (lambda: [(name, report.ok) for name, report in sorted(audited("pageloom.cases").items())], [("Base", "True"), ("Derived", "True"), ("Typed", "True")]),
    "i10_source_scan": (
        lambda: [(f"{s.line} {s.call}", s.verdict()[0]) for s in (*scan_source(_SOURCE), *scan_source("f(("))],
        [("1 css", "True"), ("2 xpath", "False"), ("3 field", "None"), ("4 add_css", "False"), ("5 Many", "True"), ("1 <syntax-error>", "None")],
    ),
    "i11_routing": (lambda: [(q, is_xpath(q)) for q in ("//p", "./p", "normalize-space(//p)", "p", ".p", "count(//p)")], [("//p", "True"), ("./p", "True"), ("normalize-space(//p)", "True"), ("p", "False"), (".p", "False"), ("count(//p)", "False")]),
    "i12_guards": (
        lambda: [("string", _raises(TypeError, lambda: extract("", "p::text"))), ("mapping", _raises(TypeError, lambda: extract("", {"a": "p"}))), ("number", _raises(TypeError, lambda: extract("", [1]))), ("label of text", _raises(ValueError, lambda: extract("x", ["p"], "latin1"))), ("unknown label", _raises(ValueError, lambda: extract(b"", ["p"], "nope")))],
        [("string", "refused"), ("mapping", "refused"), ("number", "refused"), ("label of text", "refused"), ("unknown label", "refused")],
    ),
    "i13_plan": (
        lambda: [("again", [Plan(["p::text"]).extract(x)[0] for x in ("<p>k", "<p>m<p>n")]), ("groups", Plan(["b::text"], [("li", {"x": "i::text"})]).extract_grouped("<b>k</b><li><i>m</i><li>"))],
        [("again", "[['k'], ['m', 'n']]"), ("groups", "([['k']], [[[['m']], [[]]]])")],
    ),
}


def _pages(cases: list[Case]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        selectors = list(dict.fromkeys(c[2] for c in cases))
        page = Page()
        for k, s in enumerate(selectors):
            page.field_all(f"v{k}", s)
        rows = [(i, bytearray(p if isinstance(p, bytes) else p.encode()), label, selectors.index(s)) for i, (p, label, s, _) in enumerate(cases)]
        found = page.select(spark.createDataFrame(rows, "case int, body binary, label string, which int"), "body", "label", ["case", "which"])
        return found.withColumn("v", F.get(F.array(*[f"v{k}" for k in range(len(selectors))]), F.col("which"))).select("case", F.size("v").alias("n"), F.array_join("v", "|").alias("found"))

    return run


def _literal(value: object) -> str:
    return str(value) if isinstance(value, (bool, int)) else "'" + str(value).replace("'", "''") + "'"


def _values(names: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({names})"


def b06_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of encodings of bodies with and without marks, labels and declarations."""
    rows = [(i, bytearray(body), label) for i, (body, label, _) in enumerate(_DETECTED)]
    df = spark.createDataFrame(rows, "case int, body binary, label string")
    return df.select("case", detect_encoding_column("body", "label").alias("found"))


_DETECTED = [
    (b"\xef\xbb\xbfx", "koi8-r", "UTF-8"), (b"\xff\xfex\0", None, "UTF-16LE"), (b"\xfe\xff\0x", None, "UTF-16BE"), (b"<\0?\0", None, "UTF-16LE"), (b"\0<\0?", None, "UTF-16BE"),
    (b"x", "latin1", "windows-1252"), (b"x", "nobody-knows", "UTF-8"), (b"<meta charset=big5>", None, "Big5"), (b"<meta charset=big5>", "gbk", "GBK"), (b"<meta charset=utf-16>", None, "UTF-8"), (b"", None, "UTF-8"), (b"\xff\xfe\0\0", None, "UTF-16LE"),
]


def g09_first_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First values alone: pages, each followed by a thousand more paragraphs, are read no further than these are found."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("html", F.lit("<p>more <a href=/z>z</a></p>" * 1000)).alias("html"))
    return Page().field("title", "title::text").field("link", "nav a::attr(href)").select(pages)


def a04_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with the encoding that came with them, and text; which columns they are in is the page object's to say."""

    class Custom(Base):
        @classmethod
        def page_input(cls, df: DataFrame) -> tuple:
            return F.concat(F.lit("<h1>c"), F.col("part")), None

    bodies = spark.createDataFrame([(bytearray("<h1>é".encode("latin-1")), "latin1")], "body binary, charset string")
    texts, parts = spark.createDataFrame([("<h1>é",)], "html string"), spark.createDataFrame([("é",)], "part string")
    found = [(name, cls.select_from(df, [])) for name, cls, df in (("response", Base, bodies), ("browser", Base, texts), ("custom", Custom, parts))]
    out = None
    for name, df in found:
        one = df.select(F.lit(name).alias("asked"), F.col("title").alias("found"))
        out = one if out is None else out.unionAll(one)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"b06_detected": b06_detected, "g09_first_only": g09_first_only, "a04_response": a04_response}
SQL: dict[str, str] = {
    "b06_detected": _values('"case", found', [(i, name) for i, (_, _, name) in enumerate(_DETECTED)]),
    "g09_first_only": "SELECT page_id, replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&') AS title, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS link FROM pages",
    "a04_response": _values("asked, found", [("response", "É"), ("browser", "É"), ("custom", "CÉ")]),
}
for _name, _cases in PAGES.items():
    QUERIES[_name] = _pages(_cases)
    SQL[_name] = _values('"case", n, found', [(i, len(v), "|".join(v)) for i, (_, _, _, v) in enumerate(_cases)])
for _name, _asked in VERDICTS.items():
    QUERIES[_name] = lambda spark, sf_dir, asked=_asked: spark.createDataFrame([(r, s, _runs(r, s)) for r, s, _ in asked], "role string, selector string, runs boolean")
    SQL[_name] = _values("role, selector, runs", _asked)
for _name, (_rows, _want) in _TOLD.items():
    QUERIES[_name], SQL[_name] = _told(_rows), _values("asked, found", _want)
_OBJECTS = {
    "h03_typed": (Base, ["title=title", "tags=array_join(tags, '+')"], ["K", "t1+t2"]),
    "h04_processors": (Derived, ["own=price", "inherited=title"], ["7", "K"]),
    "h01_map": (Base, ["price=price"], ["12!"]),
    "h05_node": (Derived, ["tag=box.tag", "id=box.attrs['id']", "string=box.string", "frame=frame.tag", "items=array_join(transform(items, x -> x.attrs['id']), '+')", "source=box.source"], ["div", "z", "inside", "body", "l1+l2", '<div class="box" id=z>'.replace('"', "") + "in<i>side</i></div>"]),
    "h07_inheritance": (Derived, ["title=title", "price=price"], ["K", "7"]),
    "h08_groups": (Derived, ["n=size(rows)", "name=rows[0].name", "all=array_join(rows[0].all, '+')", "missing=rows[1].name", "first=first.name"], ["2", "X", "x+y", "NULL", "x"]),
    "h08_item": (Typed, ["columns=to_json(rows[0])"], ['{"b":"l1","a":"x"}']),
    "h11_absolute": (Derived, ["link=link"], ["http://host/q"]),
}
for _name, (_cls, _columns, _found) in _OBJECTS.items():
    QUERIES[_name] = _objects(_cls, *_columns)
    SQL[_name] = _values('"column", found', [(c.split("=", 1)[0], f) for c, f in zip(_columns, _found)])


def h06_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Base.select_from(spark.createDataFrame([(_PAGE,)], "html string"))
    return spark.createDataFrame([(f.name, str(f.metadata.get("unit"))) for f in found.schema.fields], "asked string, found string")


def h10_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Base.select_from(spark.createDataFrame([(_PAGE,)], "html string")).withColumn("both", F.concat_ws("/", "title", "price"))
    return found.select(F.lit("both").alias("asked"), F.col("both").alias("found"))


QUERIES |= {"h06_metadata": h06_metadata, "h10_hand_written": h10_hand_written}
SQL |= {"h06_metadata": _values("asked, found", [("title", "None"), ("price", "EUR"), ("tags", "None")]), "h10_hand_written": _values("asked, found", [("both", "K/12!")])}
