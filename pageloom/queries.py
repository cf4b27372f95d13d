"""Queries over the test tables that apply each operator to whole tables, and the same in DuckDB SQL.

Orders and their lines are rendered as pages (end tags left out where HTML allows it), so that what a selector means has a relational
counterpart: a position is a row number, a sibling is a lag, a descendant is a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import cases
from pageloom.functions import detect_encoding_column
from pageloom.operators.relational import Nested
from pageloom.page import Page, re_first

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _render(line: Column, place: Column) -> Column:
    text = lambda name: line[name].cast("string")
    return F.concat(
        F.lit('<li id="l'), place.cast("string"), F.lit('" class="'), text("l_returnflag"), F.lit(" "), text("l_linestatus"), F.lit('" data-part="'), text("l_partkey"),
        F.lit('" data-k='), text("l_returnflag"), F.lit("-"), text("l_linestatus"), F.when(line["l_tax"] > 0, F.lit(" data-tax>")).otherwise(F.lit(">")), text("l_partkey"), F.lit("<b>"), text("l_suppkey"), F.lit("</b>"),
    )


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order with lines: page_id, html."""
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_tax"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *columns)
    grouped = lines.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("lines"))
    items = F.array_join(F.transform("lines", lambda x, i: _render(x, i + 1)), "\n")
    return grouped.select("page_id", F.concat(F.lit("<title>Order "), F.col("page_id").cast("string"), F.lit(' &amp; lines</title><ul id="o'), F.col("page_id").cast("string"), F.lit('">'), items, F.lit("</ul>")).alias("html"))


_LINES = """WITH li AS (SELECT *, row_number() OVER o AS p, count(*) OVER (PARTITION BY l_orderkey) AS n, lag(l_returnflag) OVER o AS prev_flag,
 lag(l_partkey::VARCHAR || l_suppkey::VARCHAR) OVER o AS prev_string,
 coalesce(bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_r
 FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_tax))
"""


def _rows(found: DataFrame) -> DataFrame:
    return found.select("page_id", F.posexplode("v").alias("ord", "value"))


def _fused(selector: str) -> Query:
    return lambda spark, sf_dir: _rows(Page().field_all("v", selector).select(order_pages(spark, sf_dir)))


def _relational(selector: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Nested(order_pages(spark, sf_dir)).values(selector).select(F.col("page").alias("page_id"), "ord", "value")

    return run


def _lines_sql(value: str, where: str = "true") -> str:
    return f"{_LINES}SELECT l_orderkey AS page_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY p) - 1)::INT AS ord, {value} AS value FROM li WHERE {where}"


_PART, _SUPP = "l_partkey::VARCHAR", "l_suppkey::VARCHAR"
_STRING = f"{_PART} || {_SUPP}"
_ORDERS = "SELECT l_orderkey AS page_id, 0 AS ord, 'o' || l_orderkey AS value FROM lineitem GROUP BY l_orderkey"
#: name: (selector, DuckDB SQL)
LINES: dict[str, tuple[str, str]] = {
    "c01_type": ("li::text", f"{_LINES}SELECT l_orderkey AS page_id, k::INT AS ord, value FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, q) - 1 AS k, value FROM (SELECT l_orderkey, p, 0 AS q, {_PART} AS value FROM li UNION ALL SELECT l_orderkey, p, 1, chr(10) FROM li WHERE p < n))"),
    "c02_universal": ("ul > *::attr(data-part)", _lines_sql(_PART)),
    "c03_class": (".R::attr(data-part)", _lines_sql(_PART, "l_returnflag = 'R'")),
    "c04_id": ("#l3::attr(data-part)", _lines_sql(_PART, "p = 3")),
    "c05_attr_presence": ("[data-tax]::attr(data-part)", _lines_sql(_PART, "l_tax > 0")),
    "c06_attr_equals": ('li[id="l2"]::attr(data-part)', _lines_sql(_PART, "p = 2")),
    "c07_attr_prefix": ('[data-part^="1"]::attr(data-part)', _lines_sql(_PART, "starts_with(l_partkey::VARCHAR, '1')")),
    "c08_attr_suffix": ('[data-part$="7"]::attr(data-part)', _lines_sql(_PART, "ends_with(l_partkey::VARCHAR, '7')")),
    "c09_attr_substring": ('[data-part*="42"]::attr(data-part)', _lines_sql(_PART, "contains(l_partkey::VARCHAR, '42')")),
    "c10_attr_token": ("li[class~=F]::attr(data-part)", _lines_sql(_PART, "l_linestatus = 'F'")),
    "c11_attr_dash": ("[data-k|=A]::attr(data-part)", _lines_sql(_PART, "l_returnflag = 'A'")),
    "c12_attr_fold": ('[data-k="r-o" i]::attr(data-part)', _lines_sql(_PART, "l_returnflag = 'R' AND l_linestatus = 'O'")),
    "c15_not": ("li:not(.R, #l1)::attr(data-part)", _lines_sql(_PART, "l_returnflag <> 'R' AND p <> 1")),
    "c16_is": ("li:is(.R, .A):where(.F, #l1)::attr(data-part)", _lines_sql(_PART, "l_returnflag IN ('R', 'A') AND (l_linestatus = 'F' OR p = 1)")),
    "c17_nth_child": ("li:nth-child(2n+1)::attr(data-part)", _lines_sql(_PART, "p % 2 = 1")),
    "c17_first_child": ("li:first-child::attr(data-part)", _lines_sql(_PART, "p = 1")),
    "c18_nth_of_type": ("li:nth-of-type(-n+3)::attr(data-part)", _lines_sql(_PART, "p <= 3")),
    "c19_last_child": ("li:last-child::attr(data-part)", _lines_sql(_PART, "p = n")),
    "c20_nth_last_of_type": ("li:nth-last-of-type(2)::attr(data-part)", _lines_sql(_PART, "p = n - 1")),
    "c21_only_child": ("li:only-child::attr(data-part)", _lines_sql(_PART, "n = 1")),
    "c22_has": ("ul:has(.R)::attr(id)", "SELECT l_orderkey AS page_id, 0 AS ord, 'o' || l_orderkey AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey"),
    "c22_has_child": ("ul:has(> li.A, > li.N)::attr(id)", "SELECT l_orderkey AS page_id, 0 AS ord, 'o' || l_orderkey AS value FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_orderkey"),
    "c23_contains": ('li:contains("77")::attr(data-part)', _lines_sql(_PART, f"contains({_STRING}, '77')")),
    "c24_string_equals": ('//b[.="42"]/text()', _lines_sql(_SUPP, "l_suppkey = 42")),
    "c25_string_contains": ('//li[contains(., "77")]/@data-part', _lines_sql(_PART, f"contains({_STRING}, '77')")),
    "c26_text_equals": ('//li[text()="42"]/@id', _lines_sql("'l' || p", "l_partkey = 42")),
    "c27_text_contains": ('//li[contains(text(), "42")]/@id', _lines_sql("'l' || p", "contains(l_partkey::VARCHAR, '42')")),
    "c28_xpath_attr": ('//li[starts-with(@data-part, "2")]/@data-part', _lines_sql(_PART, "starts_with(l_partkey::VARCHAR, '2')")),
    "c29_xpath_and_or": ('//li[@data-k="R-F" and @data-tax or @id="l1"]/@data-part', _lines_sql(_PART, "l_returnflag = 'R' AND l_linestatus = 'F' AND l_tax > 0 OR p = 1")),
    "c30_xpath_position": ("//li[2]/@data-part", _lines_sql(_PART, "p = 2")),
    "c31_xpath_last": ("//li[last()-1]/@data-part", _lines_sql(_PART, "p = n - 1")),
    "d01_descendant": ("ul b::text", _lines_sql(_SUPP)),
    "d02_child": ("ul > li > b::text", _lines_sql(_SUPP)),
    "d03_adjacent": ("li.R + li::attr(data-part)", _lines_sql(_PART, "prev_flag = 'R'")),
    "d04_general": ("li.R ~ li::attr(data-part)", _lines_sql(_PART, "after_r")),
    "d05_sibling_chain": ("ul > li.R + li b::text", _lines_sql(_SUPP, "prev_flag = 'R'")),
    "d06_parent": ("//b/parent::li/@data-part", _lines_sql(_PART)),
    "d07_ancestor": ('//li[@data-tax]/ancestor::ul/@id', "SELECT l_orderkey AS page_id, 0 AS ord, 'o' || l_orderkey AS value FROM lineitem WHERE l_tax > 0 GROUP BY l_orderkey"),
    "d10_late_sibling": ('li:contains("77") + li::attr(data-part)', _lines_sql(_PART, "contains(prev_string, '77')")),
    "d11_late_ancestor": ("li:last-child b::text", _lines_sql(_SUPP, "p = n")),
    "d12_absolute": ("/html/body/ul/li/b/text()", _lines_sql(_SUPP)),
    "e02_text_subtree": ("b ::text", _lines_sql(_SUPP)),
    "e03_attr": ("ul::attr(id)", _ORDERS),
    "e04_attr_subtree": ("ul ::attr(data-part)", _lines_sql(_PART)),
    "e05_outer": ("b", _lines_sql(f"'<b>' || {_SUPP} || '</b>'")),
    "e06_normalize_space": ("normalize-space(//li[1])", f"{_LINES}SELECT l_orderkey AS page_id, 0 AS ord, {_STRING} AS value FROM li WHERE p = 1"),
    "e07_implicit": ("li > ::text", _lines_sql(_SUPP)),
    "f01_group": (".R::attr(data-part), .A::attr(data-part)", _lines_sql(_PART, "l_returnflag IN ('R', 'A')")),
    "f02_union": ("//li/@id | //b/text()", f"{_LINES}SELECT l_orderkey AS page_id, (2 * (p - 1) + q)::INT AS ord, CASE q WHEN 0 THEN 'l' || p ELSE {_SUPP} END AS value FROM li, (VALUES (0), (1)) AS x(q)"),
    "f03_mixed": ("li::attr(data-part), li::attr(id)", f"{_LINES}SELECT l_orderkey AS page_id, (2 * (p - 1) + q)::INT AS ord, CASE q WHEN 0 THEN 'l' || p ELSE {_PART} END AS value FROM li, (VALUES (0), (1)) AS x(q)"),
    "b30_entities": ("title::text", "SELECT l_orderkey AS page_id, 0 AS ord, 'Order ' || l_orderkey || ' & lines' AS value FROM lineitem GROUP BY l_orderkey"),
}
#: Those that are also run as joins over the relation of nodes.
JOINED = ("c03_class", "c16_is", "c17_nth_child", "c19_last_child", "c22_has", "c23_contains", "c27_text_contains", "d02_child", "d03_adjacent", "d04_general", "d11_late_ancestor", "e02_text_subtree", "e05_outer", "e06_normalize_space", "f02_union")

_CARDS = _LINES + "SELECT l_orderkey AS page_id, (p - 1)::INT AS row, l_partkey::VARCHAR AS part, l_suppkey::VARCHAR AS supp, 'l' || p AS id FROM li"


def g04_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Page().many("lines", "li", {"part": "li::attr(data-part)", "supp": ".//b/text()", "id": "::attr(id)"})
    return page.select(order_pages(spark, sf_dir)).select("page_id", F.posexplode("lines").alias("row", "x")).select("page_id", "row", "x.part", "x.supp", "x.id")


def g04_many_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Nested(order_pages(spark, sf_dir)).groups("li", {"part": "li::attr(data-part)", "supp": ".//b/text()", "id": "::attr(id)"})
    return found.select(F.col("page").alias("page_id"), "row", *[F.get(n, F.lit(0)).alias(n) for n in ("part", "supp", "id")])


def g05_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First value, all as one string, the first row of a group, a field that is missing."""
    page = Page().field("first", "b::text").field_join("joined", "b::text", ",").field("none", "h1::text").one("top", "li.R", {"part": "::attr(data-part)", "supps": ("b::text", "join", "+")})
    found = page.select(order_pages(spark, sf_dir))
    return found.select("page_id", "first", "joined", "none", F.col("top.part").alias("top_part"), F.col("top.supps").alias("top_supps"))


def g10_empty_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Page().field("returned", ".R::attr(id)").field("open", ".O::attr(id)").field("title", "title::text")
    found = order_pages(spark, sf_dir).select("page_id", page.parse("html").alias("page"))
    return found.select("page_id", F.array_join(page.empty(), ",").alias("empty"))


def a09_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Page().field("id", "ul::attr(id)").field("none", "h1::text").field_all("supps", "b::text")
    return page.to_json(order_pages(spark, sf_dir))


def h02_re_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Page().field("number", "title::text", map=[re_first(r"Order (\d+)"), lambda c: c.cast("bigint")]).field("absent", "title::text", map=re_first("Invoice"))
    return page.select(order_pages(spark, sf_dir))


def b06_detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes: with the declaration that they have, and as UTF-16 by its mark; their titles are the same."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    coded = pages.select("page_id", F.encode("html", "UTF-8").alias("body"), F.encode("html", "UTF-16").alias("wide"))
    page = Page().field("title", "title::text")
    narrow = F.get(page.parse("body").getField("title"), F.lit(0))
    wide = F.get(page.parse("wide").getField("title"), F.lit(0))
    return coded.select("page_id", detect_encoding_column("body").alias("encoding"), detect_encoding_column("wide").alias("wide_encoding"), (narrow == wide).alias("same"))


def pages_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, heading, language, footer and the number of links and paragraphs of each page: the flagship query."""
    page = Page().field("title", "title::text").field("h1", "h1::text").field("lang", "html::attr(lang)").field("ad", "div.ad::text").field_join("footer", "footer::text", "").field_all("links", "nav a::attr(href)").field_all("paragraphs", "article p")
    found = page.select(table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.withColumn("links", F.array_join("links", " ")).withColumn("paragraphs", F.size("paragraphs"))


_DECODED = "replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


def _page_sql() -> str:
    one = lambda pattern: _DECODED.format(f"regexp_extract(html, '{pattern}', 1)")
    return (
        f"SELECT page_id, {one('<title>([^<]*)</title>')} AS title, {one('<h1>([^<]*)</h1>')} AS h1, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, {one('<div class=\"ad\">([^<]*)</div>')} AS ad, "
        f"{one('<footer>([^<]*)</footer>')} AS footer, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), ' ') AS links, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs FROM pages"
    )


QUERIES: dict[str, Query] = {"pages_fields": pages_fields}
SQL: dict[str, str] = {"pages_fields": _page_sql()}
for _name, (_selector, _sql) in LINES.items():
    QUERIES[_name], SQL[_name] = _fused(_selector), _sql
for _name in JOINED:
    QUERIES[f"{_name}_joined"], SQL[f"{_name}_joined"] = _relational(LINES[_name][0]), LINES[_name][1]
QUERIES |= {f.__name__: f for f in (g04_many, g04_many_joined, g05_cardinality, g10_empty_fields, a09_json, h02_re_first, b06_detect_encoding)}
SQL |= {
    "g04_many": _CARDS,
    "g04_many_joined": _CARDS,
    "g05_cardinality": f"{_LINES}SELECT l_orderkey AS page_id, arg_min({_SUPP}, p) AS first, string_agg({_SUPP}, ',' ORDER BY p) AS joined, NULL::VARCHAR AS none, arg_min({_PART}, p) FILTER (l_returnflag = 'R') AS top_part, arg_min({_SUPP}, p) FILTER (l_returnflag = 'R') AS top_supps FROM li GROUP BY l_orderkey",
    "g10_empty_fields": "SELECT l_orderkey AS page_id, concat_ws(',', CASE WHEN NOT bool_or(l_returnflag = 'R') THEN 'returned' END, CASE WHEN NOT bool_or(l_linestatus = 'O') THEN 'open' END) AS empty FROM lineitem GROUP BY l_orderkey",
    "a09_json": f"{_LINES}SELECT l_orderkey AS page_id, '{{\"id\":\"o' || l_orderkey || '\",\"none\":null,\"supps\":[' || string_agg('\"' || l_suppkey || '\"', ',' ORDER BY p) || ']}}' AS item FROM li GROUP BY l_orderkey",
    "h02_re_first": "SELECT l_orderkey AS page_id, l_orderkey AS number, NULL::VARCHAR AS absent FROM lineitem GROUP BY l_orderkey",
    "b06_detect_encoding": "SELECT page_id, 'UTF-8' AS encoding, 'UTF-16BE' AS wide_encoding, true AS same FROM pages",
}
QUERIES |= cases.QUERIES
SQL |= cases.SQL
