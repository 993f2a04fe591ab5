import random

import pytest
from pyspark.sql import functions as F

from quarterlight.functions import text as T
from quarterlight.operators import classify, extract


def found(df):
    return {(r["doc_id"], r["field"]): r["value"] for r in df.collect()}


LINES = "財務報表\n營業收入淨額：8,410,220\n營業毛利（損）：3,119,008\n營業利益：1,702,455\n本期淨利：905,310\n基本每股盈餘：3.07\n" + "　" * 80


def test_line_cascade(spark):
    codes = "科目\n營業收入淨額 4000 營業收入 $7,310,045\n營業毛利（毛損） 5900 營業毛利 1,604,871\n" + "x" * 90
    docs = spark.createDataFrame([("a", LINES), ("b", codes), ("short", "營業收入 1,234"), ("null", None), ("comma", "營業收入，　, 千元" + "\n" * 100 + "x")], "doc_id string, text string")
    got = found(extract.smart_fields(docs))
    assert {f: v for (d, f), v in got.items() if d == "a"} == {"net_revenue": 8410220, "gross_profit": 3119008, "operating_income": 1702455, "net_income": 905310, "eps": 3.07}
    # An account code behind the label wins.
    assert {f: v for (d, f), v in got.items() if d == "b"} == {"net_revenue": 4000, "gross_profit": 5900}
    assert not [d for d, _ in got if d in ("short", "null", "comma")]
    assert {r["confidence"] for r in extract.ocr_fields(docs).collect()} == {0.7}


def test_order_and_plausibility(spark):
    pad = "\n" + "x" * 100
    docs = spark.createDataFrame([("later", "營業收入 999\n營業收入 5,000\n營業收入 7,000" + pad), ("wide", "營業收入　$1,234" + pad), ("eps", "每股盈餘 0.00\n每股盈餘 250.0" + pad), ("both", "負債及權益總計 8,000\n營業淨利 9,000" + pad)], "doc_id string, text string")
    assert found(extract.smart_fields(docs)) == {("later", "net_revenue"): 5000, ("wide", "net_revenue"): 1234, ("both", "equity"): 8000, ("both", "operating_income"): 9000, ("both", "net_income"): 9000}


def test_document_cascade(spark):
    docs = spark.createDataFrame([("a", "營收　：5 Net Revenue: 1,234"), ("b", "EPS: 1.2.3 Earnings per Share: 12"), ("c", "營業毛利(損)：(１，２)毛利: 0"), ("d", "營收 77"), ("e", None)], "doc_id string, text string")
    assert found(extract.by_document(docs)) == {("a", "net_revenue"): 5, ("b", "eps"): 12, ("c", "gross_profit"): 1}


def test_table_cascade(spark):
    rows = [
        ("a", 1, 0, ["h"], [["資產總計", None, "1,000"], ["權益總計", "(1,234)"]]),
        ("b", 1, 0, ["h"], [["資產總計", "1"], ["資產總計", "2"]]),
        ("c", 1, 0, ["h"], [["基本每股盈餘", "1.59"], [], ["資產總計"]]),
        ("d", 2, 0, ["h"], [["資產總計", "5"]]),
        ("d", 1, 1, ["h"], [["資產總計", "4"]]),
        ("e", 1, 0, [], [["資產總計", "5"]]),
    ]
    tables = spark.createDataFrame(rows, "doc_id string, page int, table_index int, headers array<string>, rows array<array<string>>")
    got = found(extract.by_table(tables))
    assert got == {("a", "total_assets"): 1000, ("a", "total_equity"): 1234, ("b", "total_assets"): 2, ("d", "total_assets"): 5}
    text = spark.createDataFrame([("a", "total_assets", 7.0), ("a", "eps", 0.0), ("z", "eps", 1.0)], "doc_id string, field string, value double")
    assert found(extract.combined(text, extract.by_table(tables)))[("a", "total_assets")] == 1000
    assert ("a", "eps") not in found(extract.combined(text, extract.by_table(tables)))


def test_document_types(spark):
    def pages(n, chars):
        return [(i, "字" * (chars if i == 0 else 0)) for i in range(n)]

    cases = {"mixed63": (63, 425), "text73": (73, 1746), "scanned": (5, 100), "mixed1": (1, 101), "text1": (1, 151), "text5": (5, 1001)}
    rows = [(d, i, t) for d, c in cases.items() for i, t in pages(*c)]
    rows += [("late", i, "字" * 1000 if i > 4 else "") for i in range(9)]
    got = {r["doc_id"]: (r["doc_type"], round(r["text_ratio"], 4)) for r in classify.document_types(spark.createDataFrame(rows, "doc_id string, page_no int, text string")).collect()}
    assert got == {"mixed63": ("mixed", 0.17), "text73": ("text_based", 0.6984), "scanned": ("scanned", 0.04), "mixed1": ("mixed", 0.202), "text1": ("text_based", 0.302), "text5": ("text_based", 0.4004), "late": ("scanned", 0.0)}


def test_links_and_labels(spark):
    page = '<a href="/download/202401_2330_AI1.pdf">202401_2330_AI1.pdf</a><A HREF="x.pdf">report 202401_2330_AI1 1,234 bytes</A><a href="other.pdf">no</a>'
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    got = [(r["position"], r["url"], r["size"]) for r in extract.document_links(pages, "202401_2330_AI1.pdf").collect()]
    assert got == [(0, "/download/202401_2330_AI1.pdf", 0), (1, "x.pdf", 1234)]
    # Markup inside an anchor hides it; "byte" and "bytes" count, "BYTES" doesn't; any number of attributes may stand before.
    page = '<a class="x"\nhref=\'a.PDF?q=1\'>t 1 byte</a><a href="t.pdf"><b>t</b></a><a href="t.pdf">7 BYTES, 1,2 bytes</a><a href="u.pdf"> no </a><ahref="t.pdf">t</a>'
    got = extract.document_links(spark.createDataFrame([(1, page)], "page_id int, html string"), "t.pdf")
    assert [(r["position"], r["url"], r["text"], r["size"], r["filename"]) for r in got.collect()] == [(0, "a.PDF?q=1", "t 1 byte", 1, "t.pdf"), (1, "t.pdf", "7 BYTES, 1,2 bytes", 12, "t.pdf")]
    assert [r["position"] for r in extract.first_links(got).collect()] == [0]
    sizes = spark.createDataFrame([(0,), (512,), (1536,), (1048576,), (1 << 40,), (-1,)], "n long").select(T.size_label(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in sizes] == ["0 B", "512.0 B", "1.5 KB", "1.0 MB", None, None]
    urls = spark.createDataFrame([("http://a/b",), ("/c",), ("d",)], "u string").select(T.absolute_url(F.col("u"), "https://h.example/x/y").alias("u")).collect()
    assert [r["u"] for r in urls] == ["http://a/b", "https://h.example/c", "https://h.example/x/d"]


def line_patterns():
    """The line cascade as it is defined: a regex for each keyword."""
    amount = lambda f: r"([0-9]+\.[0-9]{1,3})" if f == "eps" else r"([0-9,]+)"
    dollar = lambda f: r"\$?\s*" if f in ("net_revenue", "net_income") else ""
    return extract.Catalog({f: [T.unicode_pattern(k + r"[^\d]*" + dollar(f) + amount(f)) for k in ks] for f, ks in extract.LINE_KEYWORDS.items()})


def label_patterns():
    amount = lambda f, x: r"([\d.]+)" if f == "eps" else r"\(?([\d,]+)\)?" if x.endswith(r"\)") else r"([\d,]+)"
    return extract.Catalog({f: [T.unicode_pattern(x + r"\s*[：:]\s*" + amount(f, x)) for x in xs] for f, xs in extract.LABELS.items()})


def mixed_text(rng, words, n):
    return "".join(rng.choice(words) for _ in range(rng.randrange(n)))


BITS = ["4000", "5900", "1,234", "12", "3.25", "0.5", ".", ",", "，", "$", " ", "　", "\t", "字", "x", "(", ")", "５", "６,7", "٣", "1.2.3", "98765", "1234567", "\n", "\n", "-"]


@pytest.mark.parametrize("seed", range(3))
def test_keywords_find_what_patterns_find(spark, seed):
    rng = random.Random(seed)
    words = [k.text for k in extract.line_keywords()] + ["存 貨", "存　\t貨", "營業收入淨額"] + BITS * 2
    docs = spark.createDataFrame([(i, mixed_text(rng, words, 40)) for i in range(1500)], "doc_id int, text string")
    got, want = (extract.by_line(docs, c, at_least=0, accept=lambda v, f: v > 0) for c in (extract.line_keywords(), line_patterns()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 1000


@pytest.mark.parametrize("seed", range(3))
def test_labels_find_what_patterns_find(spark, seed):
    rng = random.Random(seed)
    words = [x.text for x in extract.labels()] + ["營業收入淨額", "營業收入額淨淨", "淨營收", "net revenue", "eps", "Earnıngs per ſhare", "TOTAL ASSETS", "淨"] + ["：", ":", "： ", " :\n", "：("] * 12 + BITS
    docs = spark.createDataFrame([(i, mixed_text(rng, words, 60)) for i in range(2000)] + [(-1, None), (-2, "")], "doc_id int, text string")
    got, want = extract.by_document(docs), extract.by_document(docs, label_patterns())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 500


def test_pages_as_one_text(spark):
    """The cascades over pages find what they find in the joined text, with its line numbers."""
    rng = random.Random(4)
    words = [k.text for k in extract.line_keywords()] + [x.text for x in extract.labels()] + ["：", ":"] * 6 + BITS
    rows = [(f"d{i}", j, rng.choice([None, "", " \n", *[mixed_text(rng, words, 60)] * 7])) for i in range(60) for j in rng.sample(range(1, 5000), rng.randrange(1, 9))]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string").repartition(3)
    whole = classify.joined_text(pages)
    for least in (0, 150):
        got, want = extract.by_page(pages, extract.line_keywords(), least), extract.by_line(whole, extract.line_keywords(), at_least=least)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    got, want = extract.by_labelled_page(pages), extract.by_document(whole, label_patterns())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    plan = extract.by_page(pages, extract.line_keywords())._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_sort" not in plan


def test_line_plan(spark):
    """An alternation and a number for each line, and a keyword's own pattern where that can't tell; no replacement."""
    docs = spark.createDataFrame([("a", LINES)], "doc_id string, text string")
    plan = extract.smart_fields(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("regexp_extract_all(") == 1 and plan.count("regexp_extract(") == 2
    assert "SortAggregate" not in extract.smart_fields(docs)._jdf.queryExecution().executedPlan().toString()
