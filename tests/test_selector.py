"""The selector language: grammar, quirks and plans."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumine.functions import js
from vellumine.operators.entityset import EntitySet
from vellumine.plans import selector as sel
from vellumine.sources import schema, views

DATA = "/root/testdata/sf0.001"


def row(n, **more):
    base = dict.fromkeys(schema.ENTITY_COLUMNS)
    return base | {"doc_id": "d", "id": f"x{n}", "type": "text", "text": f"Text {n}", "page_index": n // 3, "verified": False, "verification_status": "pending", "confidence": 0.5 + n / 20, "bbox": (0.1, n / 10, 0.2, n / 10), "ord": (0, 0.0, 0, n, 0, 0)} | more


ROWS = [
    row(0, type="table", text="| a |", value_num=0.9), row(1, type="currency", value_num=1234.0, confidence=float("nan")), row(2, type="currency", value_num=0.65, flag_reason=""), row(3, type="label", text=None, verified=True, confidence=None),
    row(4, value_str="12px", extra={"reviewer": "ann", "pageIndex": "7"}), row(5, id="x1", type="figure", text="ÄÖ (a, b]", flag_reason="blur"), row(6, table_id="t", row_index=0, col_index=2, verification_status="flagged"),
]


@pytest.fixture(scope="module")
def s(spark):
    return EntitySet(spark.createDataFrame([tuple(r[c] for c in schema.ENTITY_COLUMNS) for r in ROWS], schema.ENTITIES))


CASES = {
    "*": [0, 1, 2, 3, 4, 5, 6], "": [0, 1, 2, 3, 4, 5, 6], " ": [], ",": [], "table": [], "span.table": [0], ".table .currency": [], ".table": [0], "#x1": [1, 5], "#nope": [],
    "[confidence>0.6]": [4, 5, 6], "[confidence>=0.5]": [0, 2, 4, 5, 6], "[confidence<0.55]": [0], "[confidence!=0.5]": [1, 2, 3, 4, 5, 6], "[confidence=0.50]": [], "[confidence=0.5]": [0], "[confidence > 0.6]": [], "[value=1234]": [1], "[value>0.7]": [0, 1],
    "[value]": [0, 1, 2, 4], "[value=12px]": [4], "[value>1]": [1], '[flagReason=""]': [0, 1, 2, 3, 4, 6], "[flagReason]": [2, 5], "[flagReason!=blur]": [0, 1, 2, 3, 4, 6], "[flagReason^=bl]": [5], "[text$=4]": [4], "[text*=ext]": [1, 2, 4, 6],
    "[verified]": [0, 1, 2, 3, 4, 5, 6], "[verified=true]": [3], "[verified>0]": [3], "[verified>=false]": [0, 1, 2, 3, 4, 5, 6], "[reviewer=ann]": [4], "[reviewer]": [4], "[reviewer!=ann]": [0, 1, 2, 3, 5, 6], "[pageIndex=7]": [4], "[rowIndex=0]": [6], "[colIndex>1]": [6], "[tableId=t]": [6],
    ":contains(äö)": [5], ':contains("TEXT 1")': [1], ":contains()": [0, 1, 2, 4, 5, 6], ":contains((a, b)": [5], ":page(1)": [0, 1, 2], ":page(2abc)": [3, 4, 5], ":page(x)": [], ":page(>2)": [6], ":page(<=1)": [0, 1, 2], ":pages(2-3)": [3, 4, 5, 6], ":pages(2 - 3)": [],
    ".currency:first": [1], ".currency:last": [2], ".currency:eq(1)": [2], ".currency:eq(9)": [], ":even": [0, 2, 4, 6], ":odd": [1, 3, 5], ":gt(4)": [5, 6], ":lt(2)": [0, 1], ".currency:first ": [], ":first.currency": [], ".figure, .table": [5, 0], ".currency:last , .table:first ": [2, 0], "#x1, *": [1, 0, 2, 3, 4, 6],
    "[unclosed": [], "[a=1]]": [], "[nothing>abc]": [], ":unknown(1)": [], "[confidence>abc]": [],
}


@pytest.mark.parametrize("selector", list(CASES))
def test_selection(s, selector):
    got = [r.ord.source for r in s.select(selector).ordered().collect()]
    assert got == CASES[selector]


def test_filter_and_not(s):
    places = lambda x: [r.ord.source for r in x.ordered().collect()]
    assert places(s.filter(".currency, .table")) == [] and places(s.filter(".currency:first")) == [] and places(s.filter("")) == []
    assert places(s.not_(".currency, .table")) == [0, 1, 2, 3, 4, 5, 6] == places(s.not_("[confidence>99]"))
    assert places(s.not_("[confidence>0.6]")) == [0, 1, 2, 3]
    assert places(s.filter(F.col("page_index") == 0)) == [0, 1, 2] and places(s.not_(lambda df: df["page_index"] == 0)) == [3, 4, 5, 6]
    assert places(s.contains("TEXT")) == [1, 2, 4, 6] and places(s.contains("")) == [0, 1, 2, 4, 5, 6]
    assert places(s.matches("^T.*[12]$")) == [1, 2] and places(s.in_table("t")) == [6] and places(s.by_id("x1")) == [1, 5]


def test_slices(s):
    places = lambda x: [r.ord.source for r in x.ordered().collect()]
    for n in range(-8, 9):
        assert places(s.take(n)) == list(range(7))[:n] and places(s.skip(n)) == list(range(7))[n:]
    assert places(s.eq(-1)) == [] and s.first().id == "x0" and s.last().id == "x6" and s.select("#none").first() is None
    assert s.text() == "| a |" and s.values() == [0.9, 1234.0, 0.65, None, "12px", None, None] and s.types()[:2] == ["table", "currency"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list(".#[]():,*=<>!^$ abT1-_'\""), max_size=25))
def test_any_text_parses(text):
    for b in sel.parse(text) or []:
        assert all(p == "*" or p[0] in ".#[:" for p in b.parts)


def test_splitting():
    assert sel.split_or(".a[x=1,2], :contains(a, b),.c") == [".a[x=1,2]", ":contains(a, b)", ".c"]
    assert sel.split_parts(".a[b='c]']#d:e(f(g)h)*") == (".a", "[b='c]", "#d", ":e(f(g)h)", "*")
    assert sel.peel_index(".t:eq(3)") == sel.Branch((".t",), sel.Index("eq", 3)) and sel.peel_index(":first").parts == ("*",)


def test_literals():
    assert [js.literal(x) for x in ("true", "0.9abc", "2024-01", "'x'", '"', "1e3", ".5", "-")] == [True, 0.9, 2024.0, "x", "", 1000.0, 0.5, "-"]
    assert [js.literal_text(x) for x in (True, 1.0, 0.65, 1e21, 1e-7, 12345678.0, 1.5e300, 0.000001)] == ["true", "1", "0.65", "1e+21", "1e-7", "12345678", "1.5e+300", "0.000001"]
    assert [js.literal_number(x) for x in ("", "abc", " 12 ", "0x10", False)] == [0.0, None, 12.0, 16.0, 0.0]
    assert js.to_fixed(98.5, 0) == "99" and js.to_fixed(1.005, 2) == "1.00"


def test_number_text_and_trim(spark):
    xs = [1.0, 0.9, 12345678.0, 1.5e300, 1e21, 1e20, 1e-7, 0.000001, 123456.789, 1e7 + 0.5, -0.0, float("nan"), float("inf"), 0.1 + 0.2, 5e-324, 9007199254740993.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(js.number_text(F.col("x"))).collect()]
    want = ["1", "0.9", "12345678", "1.5e+300", "1e+21", "100000000000000000000", "1e-7", "0.000001", "123456.789", "10000000.5", "0", "NaN", "Infinity", "0.30000000000000004", None, "9007199254740992"]
    assert [g for g, w in zip(got, want, strict=True) if w] == [w for w in want if w]
    texts = ["  a﻿\n", "　", " b", "5d", " 5 ", "", "0x1F", "1e3", "+.5", "Infinity", "1_0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(js.trim(F.col("t"))).collect()][:3] == ["a", "", "b"]
    assert [r[0] for r in df.select(js.to_number(F.col("t"))).collect()][3:] == [None, 5.0, 0.0, 31.0, 1000.0, 0.5, float("inf"), None]


def test_patterns():
    assert js.java_pattern("a$") == "a\\z" and js.java_pattern("[$&]x", True) == "(?iu)[$\\&]x"
    with pytest.raises(ValueError):
        js.java_pattern(r"(?<a>x)\k<a>")


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_predicates_reach_the_scan(spark, tmp_path):
    views.events_entities(spark, DATA).write.parquet(f"{tmp_path}/e")
    s = EntitySet(spark.read.parquet(f"{tmp_path}/e"))
    text = plan(s.select(".currency[confidence>0.9]:page(3)").df.select("id"))
    assert "GreaterThan(confidence,0.9)" in text and "EqualTo(type,currency)" in text and "EqualTo(page_index,2)" in text
    assert "struct<id:string,type:string,page_index:int,confidence:double>" in text
    assert "Window" not in text and "Exchange" not in text
    union = plan(s.select(".currency, .header").df.select("id"))
    assert union.count("Scan parquet") <= 2 and union.count("Exchange") <= 2


def test_properties(spark):
    s = EntitySet(views.events_entities(spark, DATA))
    n = s.count()
    for x in (".currency[value>100]", "[flagReason]", ":contains(view)"):
        assert s.filter(x).count() + s.not_(x).count() == n
    assert s.select(":even").count() + s.select(":odd").count() == n
    assert s.take(2).count() + s.skip(2).count() == n
    assert sum(r["count"] for r in s.count_by_type().collect()) == n
    assert sorted(s.sort_by_position().ids()) == sorted(s.ids()) and s.select(".text, .text").count() == s.select(".text").count()
