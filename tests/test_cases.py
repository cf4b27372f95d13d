import duckdb
import pytest

from pageloom import cases
from pageloom.functions import absolute
from pageloom.page import Page, compile_schema
from pageloom.sources import corpus

NAMES = [n for n in cases.QUERIES if n != "g09_first_only"]


@pytest.mark.parametrize("name", NAMES)
def test_case(spark, name):
    got = cases.QUERIES[name](spark, "")
    want = duckdb.sql(cases.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(*sorted(f"`{c}`" for c in got.columns)).toPandas().values.tolist())) == sorted(map(str, want.df()[sorted(want.columns)].values.tolist()))


def test_first_values_alone():
    html = "<h1>a</h1><ul>" + "<li class=x><a href=1>k</a>" * 400 + "</ul><h2>end</h2>"
    queries = ["h1::text", "li.x > a::attr(href)", "li a, b", "h2::text", "h3::text"]
    for n in range(1, 6):
        assert compile_schema(queries[:n], [], True, True).apply(html)[0] == [v[:1] for v in compile_schema(queries[:n], []).apply(html)[0]]
    assert not compile_schema(["li:last-child::text"], [], True, True).early and not compile_schema(["//li[last()]/@x"], [], True, True).early


def test_names_that_clash(spark):
    df = spark.createDataFrame([("<p>k", 1, 2)], "html string, url int, page int")
    with pytest.raises(ValueError):
        Page().field("URL", "p::text").select(df)
    assert Page().field("x", "p::text").select(df).columns == ["url", "page", "x"]


def test_absolute(spark):
    df = spark.createDataFrame([("../q", "http://h/a/b"), (None, "http://h"), ("x", None), ("//k/y", "https://h/"), ("http://[", "http://h")], "link string, url string")
    assert [r[0] for r in df.select(absolute("link", "url")).collect()] == ["http://h/q", None, "x", "https://k/y", "http://["]


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "shop" / "pages").mkdir(parents=True)
    (tmp_path / "shop" / "selectors.json").write_text('{"t": "h1::text"}')
    (tmp_path / "shop" / "pages" / "one.html").write_text("<h1>k")
    pages, selectors = corpus(spark, str(tmp_path))
    assert selectors == {"shop": {"t": "h1::text"}} and [(r["page_object"], r["page"]) for r in pages.collect()] == [("shop", "one.html")]
