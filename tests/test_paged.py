from pyspark.sql import functions as F

from quarterlight.operators import classify, extract
from quarterlight.plans import enhance
from quarterlight.sources import paged


def upper(content: bytes) -> str:
    return content.decode("utf-8").upper()


def folder_of(tmp_path, files):
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_pages_and_errors(spark, tmp_path):
    files = {
        "a.paged": paged.written([b"one", b" \n", "三".encode(), b"\xff\xfe", b"five\nlines"]),
        "B.PAGED": paged.written([]),
        "bad.paged": b"[1, 2]\nabcdef",
        "none.paged": b"no list\nabc",
        "cut.paged": b"no line at all",
        "other.txt": paged.written([b"no"]),
    }
    folder = folder_of(tmp_path, files)
    rows = paged.paged(spark, folder).withColumn("name", F.element_at(F.split("path", "/"), -1)).collect()
    assert sorted((r["name"], r["page_no"], r["text"]) for r in rows if not r["error"]) == [("a.paged", 1, "one"), ("a.paged", 3, "三"), ("a.paged", 5, "five\nlines")]
    assert sorted((r["name"], r["page_no"] or 0, r["error"].split(":")[0]) for r in rows if r["error"]) == [("a.paged", 4, "PDF_PARSE_ERROR"), *((n, 0, "PDF_PARSE_ERROR") for n in ("bad.paged", "cut.paged", "none.paged"))]
    assert paged.paged(spark, folder_of(tmp_path / "empty" if (tmp_path / "empty").mkdir() is None else tmp_path, {})).collect() == []


def test_ranges_of_pages(spark, tmp_path):
    """A file is many partitions, and pages keep their numbers."""
    pages = [f"page {i} ".encode() * (i % 7 + 1) for i in range(200)]
    folder = folder_of(tmp_path, {"big.paged": paged.written(pages), "one.paged": paged.written([b"x" * 5000])})
    df = paged.paged(spark, folder, range_bytes=500)
    got = {(r["path"].rsplit("/", 1)[1], r["page_no"]): r["text"].encode() for r in df.collect()}
    assert got == {("big.paged", i + 1): p for i, p in enumerate(pages)} | {("one.paged", 1): b"x" * 5000}
    assert df.rdd.getNumPartitions() > 10 and paged.paged(spark, folder).rdd.getNumPartitions() == 2


def test_gate_and_decoder(spark, tmp_path):
    folder = folder_of(tmp_path, {"small.paged": paged.written([b"a"]), "large.paged": paged.written([b"b" * 2000])})
    assert [r["page_no"] for r in paged.paged(spark, folder, least_bytes=1000).collect()] == [1]
    assert {r["text"][0] for r in paged.paged(spark, folder, decoder="tests.test_paged:upper").collect()} == {"A", "B"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = paged.paged(spark, folder).filter("size > 1000 and page_no = 1")
        assert [r["text"][0] for r in df.collect()] == ["b"] and df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = paged.GatedReader({"path": folder})
    assert list(reader.pushFilters([paged.GreaterThanOrEqual(("size",), 1001), paged.GreaterThan(("page_no",), 3)])) == [paged.GreaterThan(("page_no",), 3)] and reader.least == 1000 and len(reader.partitions()) == 1


def test_pages_into_the_plan(spark, tmp_path):
    """Pages of the source are classified and read by the page-wise cascades."""
    full = "字" * 400
    folder = folder_of(tmp_path, {"f1.paged": paged.written([full.encode(), "營業收入 5,000".encode(), "營業收入 7,000".encode()]), "f2.paged": paged.written([f"Net Revenue: 12\n{full}".encode()])})
    pages = paged.paged(spark, folder, range_bytes=10).filter("error is null").select(F.regexp_extract("path", r"([^/]*)\.paged$", 1).alias("doc_id"), "page_no", "text")
    assert {r["doc_id"]: r["total_pages"] for r in classify.document_types(pages).collect()} == {"f1": 3, "f2": 1}
    assert [(r["value"], r["line_no"]) for r in extract.by_page(pages, extract.line_keywords()).collect()] == [(5000.0, 3)]
    tables = spark.createDataFrame([], "doc_id string, page int, table_index int, headers array<string>, rows array<array<string>>")
    assert {(r["doc_id"], r["field"], r["value"]) for r in enhance.extracted(pages, tables).collect()} == {("f1", "net_revenue", 5000.0), ("f2", "net_revenue", 12.0)}
