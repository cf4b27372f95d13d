import json
import subprocess
import sys
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from pageloom import Page, extract, register
from pageloom.functions import detect_encoding_column, extract_column
from pageloom.operators.relational import Nested, Relational, html_nodes, html_texts
from pageloom.page import compile_schema, re_first
from pageloom.scan import scan_source
from pageloom.sources import corpus
from pageloom.spec import Many, One, PageObject, field
from pageloom.streaming import counts, extract_stream, read_pages

PAGES = [
    (1, '<title>A &amp; B</title><ul id=u class="x y"><li class=R data-n=1>one<b>1</b><li class=A>two <i>t<i>wo</i></i><li class="R N" data-n=22>three<b>3</b></ul><dl><dt>Price<dd>5<dt>Size<dd>6</dl>'),
    (2, "<p>a</p><div id=d><p class=q>b<a href=/x>l</a></p>tail<div><a href=/y title=t>m</a></div></div>"),
    (3, ""),
    (4, None),
    (5, "<html><body><p>in</body></html><div class=R>late <b>x</b></div>"),
]
SELECTORS = [
    "li::text", "li ::text", ".R::text", "#u::attr(class)", "[data-n]::attr(data-n)", '[data-n^="2"]::text', "li:not(.R)::text", "li:is(.A, .N)::text", "li:nth-child(odd)::text", "li:last-child::text", "ul:has(b)::attr(id)",
    "div:has(> p)::attr(id)", 'li:contains("three")::text', "ul > li b::text", "li.R + li::text", "li.R ~ li::text", "a::attr(href), a::attr(title)", "div ::attr(href)", "b", "//dt/following-sibling::dd/text()", '//dt[.="Size"]/text()',
    "//li[2]/text()", "//li[last()]/text()", "normalize-space(//ul)", "normalize-space(//dd/text())", "//a/ancestor::div/@id", "/html/body/ul/li/text()", "div:has(a) a::attr(href)", "//p/text() | //b/text()", "li:nth-of-type(-n+2)::text",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, html string")


def test_relations_agree_with_the_fused_engine(spark, pages):
    nodes = html_nodes(pages, source=True).cache()
    texts = html_texts(pages).cache()
    both = Relational(nodes, texts)
    found = None
    for k, selector in enumerate(SELECTORS):
        part = both.values(selector).withColumn("k", F.lit(k))
        found = part if found is None else found.unionByName(part)
    got = {}
    for r in found.collect():
        got.setdefault((r["k"], r["page"]), {})[r["ord"]] = r["value"]
    for k, selector in enumerate(SELECTORS):
        for page, html in PAGES:
            if html:
                values = got.get((k, page), {})
                assert [values[i] for i in range(len(values))] == extract(html, [selector])[0], (selector, page)


def test_nested_joins_agree_with_the_fused_engine(spark, pages):
    found = None
    for k, selector in enumerate(SELECTORS):
        part = Nested(pages).values(selector).withColumn("k", F.lit(k))
        found = part if found is None else found.unionByName(part)
    got = {}
    for r in found.collect():
        got.setdefault((r["k"], r["page"]), {})[r["ord"]] = r["value"]
    for k, selector in enumerate(SELECTORS):
        for page, html in PAGES:
            values = got.get((k, page), {})
            assert [values[i] for i in range(len(values))] == (extract(html, [selector])[0] if html else []), (selector, page)
    subs = {"n": "li::attr(data-n)", "id": ".//b/text()", "u": "::text"}
    rows = Nested(pages).groups("li", subs).where("page = 1").orderBy("row").collect()
    assert [[r[n] for n in subs] for r in rows] == compile_schema([], [("li", list(subs.items()))]).apply(PAGES[0][1])[1][0]


def test_joined_queries_neither_exchange_nor_keep_nodes(spark, pages):
    from pageloom import queries

    plan = Nested(pages).values("ul > li.R + li b::text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Join" not in plan
    plan = queries.QUERIES["d03_adjacent_joined"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "InMemoryTableScan" not in plan


def test_node_rows_of_many_pages_go_together(spark, monkeypatch):
    many = spark.range(700).selectExpr("id as page_id", "concat('<p>', id, '<b>x</b><i class=\"a b\">', id, '</i>') as html").coalesce(1)
    sizes = html_nodes(many).mapInArrow(lambda batches: (b.select(["page"]).slice(0, 1) for b in batches), "page long").count()
    assert sizes <= 4
    assert html_nodes(many).where("tag = 'i' and classes = array('a', 'b')").count() == 700 and html_texts(many).where("value = 'x'").count() == 700


def test_groups_both_ways(spark, pages):
    subs = {"n": "li::attr(data-n)", "id": ".//b/text()"}
    page = Page().many("g", "li", {k: (v, "all") for k, v in subs.items()}).one("o", "li", {"b": "b::text"}).field("t", "title::text").field_join("j", "dd::text", "+")
    rows = page.select(pages).select("page_id", "g", "o", "t", "j").orderBy("page_id").collect()
    first = rows[0]
    assert [tuple(r) for r in first["g"]] == [(["1"], ["1"]), ([], []), (["22"], ["3"])]
    assert first["o"]["b"] == "1" and first["t"] == "A & B" and first["j"] == "5+6"
    assert rows[3]["g"] == [] and rows[3]["o"] is None and rows[3]["t"] is None and rows[3]["j"] == ""
    joined = Relational(html_nodes(pages), html_texts(pages)).groups("li", subs).where("page = 1").orderBy("row").collect()
    assert [(r["n"], r["id"]) for r in joined] == [tuple(r) for r in first["g"]]


def test_one_pass_without_exchange(spark, pages):
    plan = Page().field("t", "title::text").field_all("a", "a::attr(href)").select(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_json_and_maps(spark, pages):
    page = Page().field("n", "li::attr(data-n)", map=lambda c: c.cast("int")).field("m", "title::text", map=re_first(r"(\w) &")).field("z", "h1::text")
    items = [json.loads(r["item"]) for r in page.to_json(pages).orderBy("page_id").collect()]
    assert items[0] == {"n": 1, "m": "A", "z": None}


def test_bytes_and_sql(spark):
    df = spark.createDataFrame([(b"<meta charset=latin1><p>\xe9", None), ("<p>é".encode("utf-16"), None), (b"<p>\xe9", "latin1"), (b"<p>x", "nope")], "body binary, charset string")
    out = df.select(F.get(extract_column("body", "p::text", "charset"), F.lit(0)).alias("v"), detect_encoding_column("body", "charset").alias("e")).collect()
    assert [tuple(r) for r in out] == [("é", "windows-1252"), ("é", "UTF-16LE"), ("é", "windows-1252"), ("x", "UTF-8")]
    register(spark)
    r = spark.sql("select page_first('<p>a<p>b', 'p::text') as f, page_extract('<p>a<p>b', '//p/text()') as v, resolve_label('latin1') as l, selector_supported('a >') as s").first()
    assert (r["f"], r["v"], r["l"], r["s"]) == ("a", ["a", "b"], "windows-1252", False)
    assert [r["tag"] for r in spark.sql("select tag from html_nodes('<p>a<b>c') order by id").collect()] == ["html", "body", "p", "b"]
    assert spark.sql("select * from html_texts('<p>a<b>c')").count() == 2
    assert spark.sql("select * from scan_selectors('x.py', 's.css(\"a >\")')").first()["supported"] is False


def test_page_objects(spark, pages):
    @dataclass
    class Row:
        b: str
        n: str

    class Base(PageObject):
        title = field("title::text")
        items = field("li::text", all=True)

        class Processors:
            title = [F.upper]

    class Child(Base):
        items = field("li::attr(class)", join=",")
        number = field("li::attr(data-n)").typed_as("int")
        plain = field("title::text", out=[])
        list_ = field("ul").as_node()
        rows = Many("li", item=Row, n=field("::attr(data-n)").map(lambda c: c.cast("int")), b="b::text")
        top = One("li.A", t=field("::text"))

    r = Child.select_from(pages).where("page_id = 1").first()
    assert r["title"] == "A & B".upper() and r["items"] == "R,A,R N" and r["number"] == 1 and r["plain"] == "A & B"
    assert r["list_"]["tag"] == "ul" and r["list_"]["attrs"]["id"] == "u"
    assert [tuple(x) for x in r["rows"]] == [("1", 1), (None, None), ("3", 22)] and r["top"]["t"] == "two "
    assert Child.schema()["groups"][0][:2] == ("rows", "li") and Child.check().ok
    assert Child.to_item(PAGES[0][1])["items"] == "R,A,R N"
    with pytest.raises(TypeError):
        field("p::text").as_node()
    with pytest.raises(TypeError):
        field("p::text", all=True).re_first("x")
    with pytest.raises(TypeError):
        Many("li", x=field("a::text", cached=True))
    with pytest.raises(ValueError):
        type("Bad", (PageObject,), {"x": field("dt +")})


def test_stream(spark, tmp_path, pages):
    stamped = pages.withColumn("at", F.timestamp_seconds(F.col("page_id") * 60))
    stamped.write.parquet(str(tmp_path / "in"))
    page = Page().field("t", "title::text")
    stream = extract_stream(read_pages(spark, str(tmp_path / "in"), stamped.schema), page)
    query = stream.writeStream.format("memory").queryName("extracted").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("extracted").count() == len(PAGES) and spark.table("extracted").where("t is not null").count() == 1
    query = counts(stream, "at", "t").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("counted").agg(F.sum("pages"), F.sum("missing")).first()[:] == (5, 4)


def test_corpus(spark, tmp_path):
    (tmp_path / "shop/pages").mkdir(parents=True)
    (tmp_path / "shop/selectors.json").write_text('{"t": "p::text"}')
    (tmp_path / "shop/pages/a.html").write_bytes(b"<p>x")
    pages, selectors = corpus(spark, str(tmp_path))
    r = Page().field("t", selectors["shop"]["t"]).select(pages, "body").first()
    assert (r["page_object"], r["page"], r["t"]) == ("shop", "a.html", "x")


def test_scan_and_audit(tmp_path):
    source = 's.css("a::text"); s.xpath("b/c"); l.add_css("n", "dt +"); LinkExtractor(restrict_css=[".a", x])\np.many("g", ".c", {"a": "p:has(a)::text"}); field(f"{x}")'
    verdicts = [(s.call, s.verdict()[0]) for s in scan_source(source)]
    assert ("css", True) in verdicts and ("xpath", False) in verdicts and ("add_css", False) in verdicts and ("restrict_css", None) in verdicts and ("many", True) in verdicts and ("many", False) in verdicts and ("field", None) in verdicts
    assert scan_source("def")[0].call == "<syntax-error>"
    (tmp_path / "mod_a.py").write_text('from pageloom import Page\nP = Page(strict=False).field("a", "a >")\nREGISTRY = {"x": Page().field("b", "b::text")}\n')
    run = lambda *a: subprocess.run([sys.executable, "-m", "pageloom.audit", *a], capture_output=True, text=True, env={"PYTHONPATH": f"{tmp_path}:.", "PATH": "/usr/bin"})
    assert run("mod_a").returncode == 1 and run("mod_a:REGISTRY").returncode == 0 and run("nothing_there").returncode == 2
    assert json.loads(run("--scan", "--json", str(tmp_path)).stdout)
