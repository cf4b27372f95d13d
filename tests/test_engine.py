import pytest

from pageloom import Page, Plan, UnsupportedSelector, check, detect_encoding, extract, extract_grouped, node_identity, resolve_label, terminals
from pageloom.operators import tree
from pageloom.operators.tree import decode

VALUES = [
    # omitted end tags and the tables of start and end tags
    ("<ul><li>a<li>b<li>c</ul>", "ul > li::text", ["a", "b", "c"]),
    ("<table><tr><td>a<td>b</tr><tr><td>c</table>", "tr > td::text", ["a", "b", "c"]),
    ("<dl><dt>a<dt>b</dl>", "dl > dt::text", ["a"]),
    ("<ruby><rt>a<rt>b</ruby>", "ruby > rt::text", ["a"]),
    ("<select><option>a<option>b</select>", "select > option::text", ["a", "b"]),
    ("<table><colgroup><col><thead><tr><th>H<tbody><tr><td>D</table>", "table > tbody td::text", ["D"]),
    ("<div><h1>T<p>x</div>", "div > p::text", ["x"]),
    ("<div><em>x<p>y</div>", "div > p::text", []),
    ("<div><a>x<a>y</div>", "div > a::text", ["x", "y"]),
    ("<div><p>x<col>y</div>", "div > p::text", ["x"]),
    ("<div><table><tr><td>A</div>B</td></tr></table>", "td::text", ["AB"]),
    ("<div><table><tr><td>A</table>B</div>", "div::text", ["B"]),
    ("<p>a</b>b</p>", "p::text", ["ab"]),
    # the document's frame
    ("<p>x", "html > body > p::text", ["x"]),
    ("<title>t</title><p>x", "head > title::text", ["t"]),
    ("<html><body><p>in</p></body></html><div>late</div>", "div::text", ["late"]),
    ("<html><body><p>in</p></body></html><div>late</div>", "body div::text", []),
    ("<html lang=a><html lang=b><p>x", "html::attr(lang)", ["a"]),
    ("<div><span>s</span></div>", "*", ["<div><span>s</span></div>"] * 3 + ["<span>s</span>"]),
    # text nodes
    ("<p>a<!-- c -->b", "p::text", ["a", "b"]),
    ("<p>a<!doctype x>b", "p::text", ["ab"]),
    ("<p>a</%>b</p>", "p::text", ["a", "b"]),
    ("<p>a</>b</p>", "p::text", ["ab"]),
    ("<p>a</", "p::text", ["a</"]),
    ("<p>a<b", "p::text", ["a"]),
    ("<p>1 < 2", "p::text", ["1 < 2"]),
    ("<p>A&am</p>p;B", "p::text", ["A&am"]),
    ("<p>a\r\nb\rc", "p::text", ["a\nb\nc"]),
    ("<p>a&#13;b", "p::text", ["a\rb"]),
    # data modes
    ('<script>var t="</p>";</script><p>y', "script::text", ['var t="</p>";']),
    ("<script><!--<script></script>--></script><p>y", "p::text", ["y"]),
    ("<title>a &amp; <b></title>", "title::text", ["a & <b>"]),
    ("<style>a>b{}</style><p>y", "style::text", ["a>b{}"]),
    ("<p>a<plaintext><b>c", "plaintext::text", ["<b>c"]),
    # attributes
    ("<input checked disabled='' a=1 a=2>", "input::attr(checked)", ["checked"]),
    ("<input checked disabled='' a=1 a=2>", "input::attr(disabled)", [""]),
    ("<input checked disabled='' a=1 a=2>", "input::attr(a)", ["1"]),
    ("<a href=/x/>t</a>", "a::attr(href)", ["/x/"]),
    ("<a =b=c>", "a::attr(x)", []),
    ('<a t="&ampx &lt;">', "a::attr(t)", ["&ampx <"]),
    # selectors
    ("<ul><li>1<li>2<li>3</ul>", "li:last-child::text", ["3"]),
    ("<ul><li>1<li>2<li>3</ul>", "li:not(:first-child)::text", ["2", "3"]),
    ("<ul><li>1<li>2<li>3</ul>", "li:nth-last-child(2)::text", ["2"]),
    ("<ul><li>1</ul><ul><li>2<li>3</ul>", "li:only-child::text", ["1"]),
    ("<div>a<b>c</b></div>", "div *::text", ["a", "c"]),
    ("<div>a<b>c</b></div>", "div * ::text", ["c"]),
    ("<div>a<b>c</b></div>", "div > *::text", ["c"]),
    ("<dt>P</dt><dd>5</dd><dt>S</dt><dd>6</dd>", 'dt:contains("P") + dd::text', ["5"]),
    ("<dt>P</dt><dd>5</dd><dt>S</dt><dd>6</dd>", '//dt[.="P"]/following-sibling::dd/text()', ["5", "6"]),
    ("<div id=x class='a b'><a href=1>x</a></div>", "div.a:has(a)::attr(id)", ["x"]),
    ("<div><a href=2 title=t>x</a></div>", "a::attr(title), a::attr(href)", ["2", "t"]),
    ("<p id=a>", "#a#b::attr(id), p::attr(id)", ["a"]),
    ("<a x=CAFÉ>", '[x="café" i]::attr(x)', []),
    ("<a x=VI>", "[x=vi i]::attr(x)", ["VI"]),
    ("<a x=''>", '[x^=""]::attr(x)', []),
    ("<a x='\\61 '>", '[x="\\61"]::attr(x)', []),
    ("<a x=a>", '[x="\\61"]::attr(x)', ["a"]),
    ("<h1> a  b </h1>", "normalize-space(//h1)", ["a b"]),
    ("<h1> a  b </h1>", "normalize-space(//h2)", [""]),
    ("<div><p>x</div>", ".//p/text()", ["x"]),
    ("<p>x<b>y</b>z", '//p[text()="z"]/text()', ["x", "z"]),
    ("<p>x<b>y</b>z", '//p[contains(text(), "z")]/text()', []),
    ("<td class='x y'>1", "//td[contains(@class,'y') or @id]/text()", ["1"]),
    ("", "p::text", []),
    ("\0﻿<p>x", "p::text", ["x"]),
]


@pytest.mark.parametrize("html,selector,want", VALUES)
def test_values(html, selector, want):
    assert extract(html, [selector]) == [want]


UNSUPPORTED = [
    "", "dt +", "a >> b", "> a", "p:contains(2)::text", 'p:contains("a"):contains("b")::text', "div:has(> a, img)::attr(id)", "p:not(.a, )::text", "[type=submit x]::attr(id)", "[a=2]",
    'div:is(#a, [data-x=")"]::attr(id)', "li:last-child > b::text", "li:last-child", "b, b::text", "*:nth-last-of-type(1)::text", "a:first-child:has(b)::text", "a:not(:is(.x))::text", "p::first-line",
    "ns|p", "café::text", ".\\73::text", "div:has(a b)::text", "a:hover", "div*::text", "li:last-child::text, a::text", 'p::attr(id), p:contains("x")::attr(class)',
    "//*[@id=$pid]", "//span[@x=2]/text()", "//DIV", "./x", "/body", "//p[@x][1]/text()", "//a//following-sibling::b", "//a/ancestor-or-self::b", "normalize-space(.)", "count(//a)", "//text()", "//a/..",
    "//p | //p/text()", '//p[@x and .="y"]/text()', "//p[position()<3]/text()", ":is(" * 40 + "a" + ")" * 40, "a(" * 3000,
]


@pytest.mark.parametrize("selector", UNSUPPORTED)
def test_refusals(selector):
    report = check([selector])
    assert not report.ok and report.unsupported[0].reason
    with pytest.raises(UnsupportedSelector):
        Plan([selector])
    assert extract("<p class=a>x<a>y</a></p>", [selector], strict=False) == [[]]


def test_group_verdicts():
    report = check(groups={"g": (".card", {"a": ".//a/@href", "b": "p::text, a::text", "c": "p:has(a)::text", "d": "a + b::text"})})
    assert [f.supported for f in report.groups[0].subfields] == [True, False, False, False]
    for bad in ("div, span", "div:has(a)", "p::text"):
        assert not check(groups=[(bad, {"x": "a::text"})]).groups[0].container.supported


def test_groups_and_items():
    html = "<div class=c><a href=1>1</a><div class=c><a>2</a></div></div><div class=c></div>"
    assert extract_grouped(html, [], [(".c", {"a": "a::text", "h": ".//a/@href"})])[1] == [[[["1", "2"], ["1"]], [["2"], []], [[], []]]]
    page = Page().field("t", "h1::text").field_all("a", "a::text").field_join("j", "a::text", "-").many("c", ".c", {"a": ("a::text", "all")}).one("o", ".c", {"a": "a::text"})
    item = page.extract(html)
    assert item.to_dict() == {"t": None, "a": ["1", "2"], "j": "1-2", "c": [{"a": ["1", "2"]}, {"a": ["2"]}, {"a": []}], "o": {"a": "1"}}
    assert item.empty_fields() == ["t"] and item.get("a") == "1" and len(item) == 5
    with pytest.raises(ValueError):
        page.field("t", "b::text")
    with pytest.raises(UnsupportedSelector):
        page.field("x", "dt +")


def test_budget():
    report = check([f".c{i}::text" for i in range(129)])
    assert report.over_budget and not report.unsupported
    with pytest.raises(ValueError):
        report.raise_for_status()


def test_terminals():
    assert [terminals(q) for q in ("a::text", "a::attr(x)", "a", "normalize-space(//a)", "a::text, a::attr(x)", "a >")] == ["text", "attr", "outer", "normalize-space", None, None]
    assert node_identity("div.a") == ("div", False) and node_identity("*") == (None, True)


@pytest.mark.parametrize("text,want", [("&amp;&eacute;&#x41;&#65", "&éAA"), ("&notit;", "¬it;"), ("&nope; &", "&nope; &"), ("&#0;&#xD800;&#128;&#1114112;", "��€�")])
def test_references(text, want):
    assert decode(text) == want


def test_encodings():
    text = "<p>é</p>"
    assert extract(text.encode("utf-16"), ["p::text"]) == [["é"]]
    assert extract(b"<meta charset=latin1><p>\x80\x81", ["p::text"]) == [["€\x81"]]
    assert extract("<p>日本".encode("shift_jis"), ["p::text"], "sjis") == [["日本"]]
    assert extract("<p>é".encode("cp1252"), ["p::text"], "cp1252") == [["é"]]
    assert detect_encoding(b'<?xml version="1.0" encoding="koi8-r"?><meta charset=utf-8>') == "KOI8-R"
    assert detect_encoding(b"<!-- <meta charset=koi8-r> --><title><meta charset=big5></title><meta http-equiv=content-type content='text/html; charset=gbk'>") == "GBK"
    assert detect_encoding(b"<body><p>" + b"x" * 2000 + b"<meta charset=koi8-r>") == "UTF-8"
    assert detect_encoding(b"<head>" + b"<meta name=a>" * 200 + b"<meta charset=koi8-r>") == "KOI8-R"
    assert detect_encoding(b"<meta charset=utf-16>") == "UTF-8" and detect_encoding("x") == "UTF-8" and detect_encoding(b"", "nope") == "UTF-8"
    assert resolve_label(" Latin1 ") == "windows-1252" and resolve_label("nope") is None
    for bad in ("nope",):
        with pytest.raises(ValueError):
            extract(b"", ["p::text"], bad)
    with pytest.raises(ValueError):
        extract("x", ["p::text"], "latin1")


def test_arguments():
    for bad in ("p::text", {"a": "p::text"}, [1]):
        with pytest.raises(TypeError):
            extract("", bad)
    with pytest.raises(TypeError):
        check("p::text")


def test_pages_of_one_shape_are_built_once(monkeypatch):
    built = []
    whole = tree._build
    monkeypatch.setattr(tree, "_build", lambda text, *more: built.append(text) or whole(text, *more))
    page = lambda k, n: f"<title>Order {k} &amp; lines</title><ul id=o{k}>" + "\n".join(f'<li id="l{i}" Class="R{k} x" data-k={k}{i} data-tax>{k + i} &lt;<b>{i}</b>' for i in range(n)) + " </ul>"
    for k in range(300):
        got, want = tree.parse(page(k, k % 4 + 1)), whole(page(k, k % 4 + 1), None)
        for name in ("tag", "parent", "last", "begin", "end", "at", "child", "kind", "before", "made", "children", "owner", "value", "text_at"):
            assert getattr(got, name) == getattr(want, name)
        for i in range(len(want.tag)):
            assert list(got.attributes(i).items()) == list(want.attributes(i).items())
            assert (got.source(i), got.string(i), got.texts(i)) == (want.source(i), want.string(i), want.texts(i))
        assert got.by_class(f"R{k}") == want.by_class(f"R{k}") and got.by_id("l1") == want.by_id("l1") and got.by_tag("b") == want.by_tag("b")
    assert len(built) <= 8


def test_shapes_leave_other_pages_alone():
    for a, b in (("<p title='a>b'>x<p>y", "<p title='c>d'>z<p>y"), ("<title>a<b>c</title><p>d", "<title>e<b>f</title><p>g"), ("<script>a</b>c</script>d", "<script>e</b>f</script>g"), ("<head></head> \n a<p>b", "<head></head> \n cc<p>d"), ("<p>a < b<p>c", "<p>d < e<p>f"), ("<b a='<'>x<p>y", "<b a='<'>z<p>y")):
        for text in (a, a, b, b, b):
            got, want = tree.parse(text), tree._build(tree.prepare(text), None)
            assert (got.tag, got.begin, got.end, got.value, got.owner) == (want.tag, want.begin, want.end, want.value, want.owner), text


def test_titles_with_references_that_the_sql_leaves():
    """Such titles are in the table of pages (F14, F15)."""
    assert extract("<title>a &quot;b&quot; &amp; c&amp</title><h1>d &quot;e&amp</h1>", ["title::text", "h1::text"]) == [['a "b" & c&'], ['d "e&']]
