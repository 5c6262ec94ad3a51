"""Chains, changes, layers, rendering, configured queries and sources on small tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from vellumine.functions import detect, js, mdtable
from vellumine.operators import layers, mutate
from vellumine.operators.entityset import EntitySet
from vellumine.plans import config
from vellumine.sources import api, samples, schema, tree, views
from vellumine.streaming.filters import select_stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def report(spark):
    return EntitySet(samples.load_sample(spark, "harvest-report").entities)


@pytest.fixture(scope="module")
def receipt(spark):
    return EntitySet(samples.load_sample(spark, "receipt").entities)


def test_types_and_values(spark):
    cases = {
        "$1,234.50": ("currency", 1234.5), "12": ("currency", 12.0), "-$5": ("label", None), "$-5": ("currency", -5.0), "($5)": ("label", None), "3万": ("currency", 3.0), "65.8%": ("percentage", 65.8 / 100), "+5%": ("label", None), "2024-01-15": ("date", None), "1/2/24": ("date", None), "99/99/9999": ("date", None),
        "": ("label", None), "  7 ": ("currency", 7.0), "12\n": ("currency", 12.0), "x" * 49: ("label", None), "x" * 50: ("text", None), "😀" * 24: ("label", None), "😀" * 25: ("text", None), "a\nb": ("label", None), ",": ("currency", None), "$12M": ("label", None),
    }
    cases["a\nb"] = ("text", None)
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    kind = detect.entity_type(F.col("t"))
    got = {r[0]: (r[1], r[2]) for r in df.select("t", kind, detect.numeric_value(F.col("t"), kind)).collect()}
    assert got == cases
    labels = {"Subtotal": "total", "Grand Total": "total", "Updated by": "date", "Name": "label", None: "label"}
    df = spark.createDataFrame([(k,) for k in labels], "l string")
    assert {r[0]: r[1] for r in df.select("l", detect.entity_type(F.lit("abc"), F.col("l"))).collect()} == labels


def test_two_table_readings(spark):
    texts = ["| a | b |\n|---|---|\n| 1 | |\n\n| - | 5 |\nx | y | z\nno pipes", "", "a | b", "| h |", "| h |\n| --- x |\n| <b> |"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(mdtable.cell_rows(F.col("t")).alias("c"), mdtable.table_html(F.col("t"), "p").alias("h"))
    got = df.collect()
    assert got[0].c == [["a", "b"], ["1", ""], ["y"]] and got[1].c == [] and got[2].c == [] and got[3].c == [["h"]]
    assert got[0].h.startswith('<table class="p-table"><thead><tr><th>a</th><th>b</th><th></th></tr>') and "<td>5</td>" in got[0].h
    assert got[3].h == '<pre class="p-markdown">| h |</pre>' and got[4].h.endswith("<tr><td>&lt;b&gt;</td><td></td></tr></tbody></table>") and "--- x" not in got[4].h


def test_html_tables(spark):
    html = ["<TABLE><thead><tr><th>A</th></tr></thead><tr class=x><td><i>1</i>&amp;\n</td></tr><tr></tr></TABLE>", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in html], "h string").select(mdtable.markdown_of(mdtable.html_rows(F.col("h")))).collect()]
    assert got == ["| A |\n|---|\n| 1&amp; |", ""]


def test_compiled_samples(report, receipt, spark):
    assert report.ids()[:5] == ["tb-1", "tb-1_r0_c0", "tb-1_r0_c1", "tb-1_r0_c2", "tb-1"]
    assert report.select(".table").count() == 2 and report.select(".table, .figure").count() == 2 and report.select("table").count() == 0
    assert report.select(".currency").sum().first()[0] == 4000.0 and report.select(".percentage").values() == [0.625, 0.375]
    cell = report.by_id("tb-1_r2_c1").first()
    assert (cell.table_id, cell.row_index, cell.col_index, cell.verified, cell.verified_at) == ("tb-1", 2, 1, True, None)
    assert [round(x, 6) for x in cell.bbox] == [round(0.1 + 0.8 / 3, 6), 0.4, round(0.1 + 1.6 / 3, 6), 0.5]
    assert report.select(".figure").text() == "Rainfall\nMonthly rain in mm" and report.by_id("tb-1").first().verified_at == 1709251200000
    total = receipt.by_id("f-total").first()
    assert (total.type, total.value_num, total.flag_reason, total.verified) == ("total", 42.5, "blurred", False)
    assert receipt.by_id("f-date").first().type == "date"
    with pytest.raises(KeyError):
        samples.load_sample(spark, "none")
    samples.load_sample(spark, "receipt").as_views("r_")
    assert spark.sql("SELECT count(*) FROM r_entities e JOIN r_pages p USING (doc_id, page_index) JOIN r_documents USING (doc_id)").first()[0] == receipt.count()
    plain = samples.load_sample(spark, "receipt", layers.Options(parse_table_cells=False, auto_detect_types=False))
    assert sorted(r.type for r in plain.entities.collect()) == ["table", "text", "text"]
    assert samples.load_sample(spark, "receipt", layers.Options(include_tables=False)).pages.count() == 1


def test_builder(spark):
    c = layers.LayerCompiler(spark).add_markdown_page("d", 2, "# A").add_markdown_page("d", 2, "B").add_markdown_page("d", 5, "C", "m")
    out = c.compile()
    assert {(r.page_number, r.markdown, r.total_entities) for r in out.pages.collect()} == {(2, "# A\n\nB", 2), (5, "C", 1)}
    assert c.reset().layers == () and c.reset().version == 2 and c.reset().compile().entities.count() == 0
    empty = spark.createDataFrame([("d", 0, "t", 3, "", None, None, None)], "doc_id string, pos long, id string, page_number int, markdown string, bbox string, confidence double, verification_status string").withColumn("bbox", F.lit(None).cast(schema.BBOX))
    page = layers.compile_document(empty).pages.first()
    assert (page.page_number, page.total_entities, page.avg_confidence) == (3, 1, 0.0)


def test_changes(report):
    flagged = report.select(".currency").attr({"verificationStatus": "flagged", "text": "x", "reviewer": "ann"}, timestamp=5)
    log = flagged.changes().collect()
    assert len(log) == 9 and {(r.field, r.old_value, r.new_value) for r in log if r.entity_id == "tb-1_r1_c1"} == {("verificationStatus", "verified", "flagged"), ("text", "1,250", "x"), ("reviewer", None, "ann")}
    assert flagged.texts() == ["x"] * 3 and flagged.attr("reviewer") == "ann" and flagged.attr("verificationStatus") == "flagged" and flagged.version == 2
    again = flagged.clear_changes().attr("text", "x")
    assert not again.has_changes() and flagged.has_changes() and report.changes().count() == 0
    assert flagged.mutation_log().first().doc_version == 2
    full = mutate.apply_changes(report.df, flagged.changes())
    replayed = EntitySet(full)
    assert replayed.select("[reviewer=ann]").texts() == ["x"] * 3 and replayed.count() == report.count() and replayed.select("[verificationStatus=flagged]").count() == 3
    assert replayed.attr("verified") is True
    gone = flagged.remove_attr(["reviewer", "text", "confidence"])
    assert gone.select("[reviewer]").count() == 0 and gone.select("[confidence]").count() == 0 and gone.texts() == ["x"] * 3
    assert gone.changes().count() == 9 + 9
    assert report.toggle_attr("verified").select("[verified=true]").count() == 3 and report.toggle_attr("highlight", True).select("[highlight=true]").count() == 15
    assert report.attr("value", 3).values() == [3.0] * 15 and report.attr("value", "a").values() == ["a"] * 15
    with pytest.raises(ValueError):
        report.toggle_attr("text")


def test_log_and_version(report):
    one = report.attr("reviewer", "ann")
    assert (report.version, one.version, one.attr("reviewer", "ann").version, one.data("k", 1).version) == (1, 2, 2, 2)
    assert one.data("k", 1).changes().count() == one.changes().count() == report.count()
    assert one.markdown(lambda r, q: {"success": True, "markdown": "m"}, image_url="u")[1].changes().count() == report.count()
    two = one.attr({"reviewer": "bob", "flagReason": "z"})
    assert two.version == 3 and sorted({r.seq for r in two.changes().collect()}) == [1000, 2000, 2001]
    assert two.select(".currency").version == 3 and two.clear_changes().version == 3 and not two.clear_changes().has_changes()
    assert two.df.sparkSession is not None and "__log" not in two.ordered().columns
    custom = one.toggle_attr("picked").toggle_attr("picked")
    assert {(r.old_value, r.new_value) for r in custom.changes().where("field = 'picked'").collect()} == {(None, "true"), ("true", "false")} and custom.select("[picked=false]").count() == report.count()


def test_groups_are_sets(report):
    g = report.groups_by_type()
    assert g.keys() == list(dict.fromkeys(report.types())) and len(g) == len(g.keys()) == len(list(g))
    assert g["currency"].texts() == report.select(".currency").texts() and {k: s.count() for k, s in g.items()} == {k: report.types().count(k) for k in g}
    assert report.groups_by_page()[1].select(".currency:first").ids() == report.on_page(1).select(".currency:first").ids()
    assert g.take(1).ids() == [next(r.id for r in report.to_array() if r.type == k) for k in g.keys()]


def test_document_of_a_set(spark):
    doc = samples.load_sample(spark, "receipt")
    assert doc.query().select(".currency").get_doc() is doc and EntitySet(doc.entities).get_doc() is None


def test_data_and_markdown(report):
    d = report.data({"note": {"a": 1}})
    assert d.data("note") == {"a": 1} and d.data("confidence") == 0.97 and d.data("none") is None and not d.has_changes()
    calls = []

    def client(row, request):
        calls.append(request)
        return {"success": True, "markdown": "| m |", "model": request["model"]}

    assert report.markdown()[0] == report.text()
    text, kept = report.markdown(client, image_url="u", model="m")
    assert text == "| m |" and kept.markdown(client, image_url="u")[0] == "| m |" and len(calls) == 1
    assert kept.data("transformation")["model"] == "m" and kept.markdown(client, image_url="u", force=True, model="n")[0] == "| m |" and len(calls) == 2
    assert report.markdown(lambda r, q: {"success": False}, image_url="u")[0] == report.text()
    assert report.markdown(lambda r, q: 1 / 0, image_url="u")[0] == report.text() and report.select("#no").markdown()[0] == ""


def test_grouping_and_folds(report):
    assert [tuple(r) for r in report.count_by_type().collect()][:3] == [("table", 2), ("header", 3), ("label", 3)]
    assert [tuple(r) for r in report.count_by_page().collect()] == [(1, 13), (2, 2)]
    assert report.reduce(lambda s, e: F.concat(s, F.substring(e["id"], 1, 1)), F.lit("")).first().result == "t" * 13 + "ff"
    assert report.some(".figure").first()[0] and not report.every(".figure").first()[0] and report.select("#no").every(".x").first()[0] and not report.select("#no").some("*").first()[0]
    empty = report.select("#no")
    assert (empty.sum().first()[0], empty.avg().first()[0], empty.min().first()[0], empty.max().first()[0], empty.stats().first().score) == (0.0, 0.0, None, None, 0.0)
    seen = []
    report.each(lambda r: seen.append(r.id))
    assert seen == report.ids() and report.find(F.col("type") == "label").text == "Barley" and report.length == 15 and len(report.to_array()) == 15
    assert [r.id for r in report.sort_by("text").take(3).ordered().collect()] == ["fn-1", "tb-1", "tb-1_r1_c1"] or report.sort_by("text").count() == 15
    assert report.sort_by_confidence().ids()[-1] == "fg-1"


def test_rendering(receipt):
    page = receipt.html_by_page(class_prefix="p").first().html
    assert page.startswith('<div class="p-page" data-page="1"><div class="p-page-header">Page 1</div>') and page.count("p-entity ") == receipt.count()
    html = receipt.select("#f-total").html(include_metadata=False).first().html
    assert html == '<div class="vellum-entity type-total status-flagged"><div class="vellum-header"><span class="vellum-type">total</span><span class="vellum-badge confidence high">95%</span><span class="vellum-badge status flagged">flagged</span><span class="vellum-value">42.5</span></div><div class="vellum-text">$42.50</div></div>'
    assert "<title>T</title>" in receipt.html_document("T").first().html
    items = json.loads(receipt.json().first().json)
    assert [i["id"] for i in items] == receipt.ids() and items[0]["bbox"]["xmin"] == 0.1 and "value" not in items[0]


def test_configured_query(receipt):
    r = config.execute_query(receipt, "receipt", config.QueryConfig("*", min_confidence=0.9, sort_by="confidence", top_k=2, page_range=(1, 1)))
    assert r["total"] == 9 and r["returned"] == 2 and r["items"][0]["id"] == "f-date" and r["stats"]["total"] == 9
    assert r["items"][1]["value"] == "42.5"
    text = config.format_response(r | {"duration": 3})
    assert text.splitlines()[:5] == ["Query: *", "Document: receipt", "Results: 2/9 (3ms)", "", "[1:f-date] date (99%)"] and text.endswith("Avg confidence: 91.6%")
    assert config.execute_query(receipt, "none", config.QueryConfig())["total"] == 0
    long = r | {"items": [r["items"][0] | {"text": "a\n" * 50}]}
    assert "a a " + "..." in config.format_response(long, show_stats=False) or "..." in config.format_response(long)


def test_adapters_hold_boxes_in_the_page(spark):
    for name in samples.SERVICE_OUTPUT:
        r = samples.adapted(spark, name)
        for b in [x.bbox for x in r.blocks.collect() + r.tables.collect()]:
            assert all(0 <= v <= 1 for v in b) and b.x + b.width <= 1 + 1e-9 and b.y + b.height <= 1 + 1e-9


def test_api_and_trees(spark):
    with pytest.raises(ValueError):
        api.load_entities(spark, {})
    with pytest.raises(ValueError):
        api.load_page(spark, {"page": "1"})
    page = {"page": 1, "blocks": [], "content": "x", "metadata": {"tables": []}}
    asked = []

    def opener(url):
        asked.append(url)
        return json.dumps(page if "pages" in url else {"entities": []}).encode()

    assert api.fetch_page(spark, "j", 4, "http://h/", opener).first().content == "x" and api.fetch_entities(spark, "j", "http://h", opener).count() == 0
    assert asked == ["http://h/api/ocr/jobs/j/pages/4", "http://h/api/ocr/jobs/j/entities?type=all"]
    e = tree.tree_entities(spark.createDataFrame([("d", json.dumps(samples.TREE)), ("n", None)], "doc_id string, tree string"), include_ocr=False)
    assert [r.id for r in e.orderBy("ord").collect()] == ["h", "t"]
    assert json.loads(e.where("id = 'h'").first().data["level"]) == 1


class StubPages(api.PagesSource):
    """Pages without a network."""

    opener = staticmethod(lambda url: json.dumps({"page": int(url.rsplit("/", 1)[1]), "content": url}).encode())

    @classmethod
    def name(cls):
        return "stub_pages"


def test_pages_are_fetched_in_tasks(spark):
    import pyspark.cloudpickle as cp
    import sys

    cp.register_pickle_by_value(sys.modules[__name__])
    df = api.fetch_pages(spark, "j", [3, 1], "http://h", StubPages)
    assert [(r.place, r.page) for r in df.orderBy("place").collect()] == [(1, 3), (2, 1)] and df.rdd.getNumPartitions() == 2


def test_streams_refuse_positions(spark):
    e = views.events_entities(spark, DATA)
    with pytest.raises(ValueError):
        select_stream(e, ".text:first")
    assert select_stream(e, "*") is e and select_stream(e, ".text, .text").count() == e.where("type = 'text'").count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dates(spark):
    from vellumine.functions import js

    day = 1704412800000  # 2024-01-05
    texts = {"2024-01-05": day, "2024-01-05T10:00:00Z": day + 36_000_000, "2024-01-05T10:00:00+02:00": day + 28_800_000, "2024/1/5": day, "01/05/2024": day, "January 5, 2024": day, "Jan 5, 2024 10:00:00": day + 36_000_000, "5 Jan 2024": day, "Fri, 05 Jan 2024 10:00:00 GMT": day + 36_000_000, "2024-01": 1704067200000, "2024": 1704067200000, "no date": None, "": None, "13/45/2024": None}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", js.epoch_ms(F.col("t")).alias("ms"))
    assert {r.t: r.ms for r in df.collect()} == texts


def test_typed_values_equal_the_general_ones(spark):
    texts = ["", " ", "\t", "a", " a ", "　a ", " \ta b\n ", " ", "x﻿", None, "$1,234.56", "-5", "5.", ",", "-,", "$ -7", "¥3万", " 12 %", "12.5%", "\t9 ", "1996-03-13", "1e5", "NaN", "1d", "é", "1.2.3", "1" * 400]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = js.trim(F.col("t"))
    kind = detect.trimmed_type(t)
    rows = df.select(detect.typed_value(F.col("t"), kind).alias("a"), detect.numeric_value(F.col("t"), kind).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(r.a is not None for r in rows) > 7


def test_types_of_long_digits_take_linear_time(spark):
    df = spark.createDataFrame([("1" * 200_000 + "x",), ("," * 200_000 + "x",), ("7" * 200_000,)], "t string")
    began = time.monotonic()
    assert [r.k for r in df.select(detect.trimmed_type(F.col("t")).alias("k")).collect()] == ["text", "text", "currency"]
    assert time.monotonic() - began < 20


def test_a_table_is_cut_into_lines_once(spark):
    nbsp = "\u00a0"
    df = spark.createDataFrame([("| a |\n|---|\n| b |",), (f"| a{nbsp} |\n|---|\n| {nbsp}b |",)], "m string")
    html = df.select(mdtable.table_html(F.col("m"), "x").alias("h"))
    assert html._jdf.queryExecution().analyzed().toString().count("split(trim(m") <= 2  # once in each branch
    assert len({r.h for r in html.collect()}) == 1
    assert [r.c for r in df.select(mdtable.cell_rows(F.col("m")).alias("c")).collect()] == [[["a"], ["b"]]] * 2
