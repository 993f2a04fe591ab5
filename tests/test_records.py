import json

import pytest
from pyspark.sql import functions as F

from quarterlight import config, registry, schemas
from quarterlight.functions import periods as P
from quarterlight.operators import catalog, classify, merge, tracking, validate
from quarterlight.plans import enhance
from quarterlight.sources import readers, writers

MAPS = "stock_code string, company_name string, report_year int, report_season string, financials map<string,string>, income_statement map<string,string>, balance_sheet map<string,string>, metadata map<string,string>"


def test_periods(spark):
    rows = spark.createDataFrame([("Q1",), ("q3",), ("3",), ("QQ1",), ("5",), (None,)], "s string")
    got = [tuple(r) for r in rows.select(P.normalize_season(F.col("s")), P.valid_season(F.col("s")), P.season_number(F.col("s"))).collect()]
    assert got == [("Q1", True, "01"), ("Q3", True, "q3"), ("Q3", True, "03"), ("Q1", True, "01"), ("5", False, "05"), (None, False, None)]
    names = spark.createDataFrame([("202403_2330_AI1.pdf",), ("2406_2330_AI1.pdf",), ("202404_2330_AI1.pdf",), ("x.pdf",)], "n string")
    got = [(tuple(r[0]) if r[0] else None, r[1]) for r in names.select(P.parse_name(F.col("n")), P.calendar_period(F.col("n"))).collect()]
    assert got == [((2024, "Q1", "2330"), "2024Q1"), ((2024, "Q2", "2330"), "未知"), ((2024, "Q1", "2330"), "2024Q2"), (None, "未知")]


def test_scores(spark):
    meta = lambda *k: {x: "1" for x in k} | {"file_size": "50000"}
    rows = [
        ("2454", "x", 2025, "Q1", {"total_assets": "1000", "total_liabilities": "10", "equity": "5"}, {"eps": "1"}, {}, meta("source", "file_name", "file_path", "created_at")),
        ("2330", "x", 2024, "Q1", {"cash_and_equivalents": "5"}, {"eps": "1"}, {}, meta("source", "file_name", "file_path")),
        ("2303", "x", 2025, "Q1", {}, {}, {}, meta("source", "file_name", "file_path", "created_at")),
        ("", None, 1999, "Q9", None, None, None, {}),
    ]
    got = validate.validated(spark.createDataFrame(rows, MAPS)).orderBy("stock_code").collect()
    by = {r["stock_code"]: r for r in got}
    assert round(by["2454"]["score"], 3) == 88.571 and by["2454"]["errors"] == [validate.UNBALANCED] and len(by["2454"]["warnings"]) == 2
    assert by["2330"]["score"] == 98.0 and by["2330"]["is_valid"]
    assert by["2303"]["score"] == 90.0 and len(by["2303"]["warnings"]) == 4
    assert len(by[""]["errors"]) == 4 and 0 <= by[""]["score"] <= 100 and validate.SUGGEST_EMPTY in by[""]["suggestions"]


def test_zero_assets_stop_the_checks(spark):
    figures = {"total_assets": "0", "total_liabilities": "1", "equity": "1", "net_revenue": "5", "gross_profit": "9"}
    rows = [("1111", "x", 2024, "Q1", figures, {"a": "1"}, {"a": "1"}, {}), ("2222", "x", 2024, "Q1", figures | {"total_assets": "2"}, {"a": "1"}, {"a": "1"}, {})]
    got = {r["stock_code"]: r["errors"] for r in validate.validated(spark.createDataFrame(rows, MAPS)).collect()}
    assert got == {"1111": [], "2222": [validate.GROSS_ABOVE_REVENUE]}


def test_quality_summary_of_nothing(spark):
    assert tuple(validate.quality_summary(validate.validated(spark.createDataFrame([], MAPS))).first()) == (0, 0, 0, 0, 0.0)


def test_present_wins(spark):
    rows = [('{"equity":5,"eps":1.5}', None, '{"equity":null}'), ('{"eps":1.0}', '{"eps":2.0}', None), ('{"eps":{"value":3.0}}', None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    merged = df.select(merge.present_wins(*[F.from_json(c, "map<string,string>") for c in "abc"]).alias("m"))
    assert [r["m"] for r in merged.collect()] == [{"equity": None, "eps": "1.5"}, {"eps": "2.0"}, {"eps": '{"value":3.0}'}]
    assert [r[0] for r in merged.select(*merge.written_values(F.col("m"), ("eps",))).collect()] == [1.5, 2.0, 3.0]
    assert [r[0] for r in merged.select(merge.non_null_count(F.col("m"))).collect()] == [1, 1, 1]


def test_backfill_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 3.0)], "k string, eps double, equity double")
    new = spark.createDataFrame([("a", None, 7.0), ("c", 9.0, 9.0)], "k string, eps double, equity double")
    once = merge.backfilled(old, new, "k", ("eps", "equity"))
    assert sorted(map(tuple, once.collect())) == [("a", 1.0, 7.0), ("b", 2.0, 3.0)] == sorted(map(tuple, merge.backfilled(once, new, "k", ("eps", "equity")).collect()))
    assert [tuple(r) for r in merge.changes(old, once, "k", ("eps", "equity")).collect()] == [("a", "equity", None, 7.0)]


EVENTS = "id string, seq int, kind string, status string, error_message string, processing_time double, pdf_path string"


def test_fold(spark):
    rows = [
        ("a", 1, "create", None, None, None, None), ("a", 2, "status", "failed", "boom", 0.0, None), ("a", 3, "status", "failed", "", 5.0, None), ("a", 4, "status", "processing", None, 0.0, None), ("a", 5, "paths", None, None, None, "p1"),
        ("b", 1, "create", None, None, None, None), ("b", 2, "status", "failed", "x", 1.0, None), ("b", 3, "create", None, None, None, None),
        ("ghost", 1, "status", "failed", "x", 1.0, None),
        ("c", 1, "create", None, None, None, "old"), ("c", 2, "status", "failed", "x", 1.0, None), ("c", 3, "create", None, None, None, None), ("c", 4, "status", "failed", "y", 0.0, None), ("c", 5, "status", "failed", "z", 2.0, None),
        ("d", 4, "create", None, None, None, None), (None, 1, "create", None, None, None, None), ("d", None, "status", "failed", "x", 1.0, None),
    ]
    got = {r["id"]: tuple(r)[1:] for r in tracking.folded(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {"a": ("processing", "boom", 1, 5.0, "p1"), "b": ("pending", None, 0, None, None), "c": ("failed", "z", 2, 2.0, None), "d": ("pending", None, 0, None, None)}


def test_reports_on_no_tasks(spark):
    empty = spark.createDataFrame([], "status string, processing_time double, retry_count int, error_message string")
    assert tuple(tracking.time_statistics(empty).first()) == (0.0, 0.0, 0.0)
    report = tracking.recommendations(tracking.progress(empty), F.array(F.lit("OCR failed"), F.lit("下載失敗"))).first()
    assert report["total"] == 0 and report["completion"] == 0 and report["recommendations"] == [tracking.OCR_ERRORS, tracking.NETWORK_ERRORS]
    with pytest.raises(ValueError):
        tracking.ordered(empty, "1; drop table")


def test_catalog(spark):
    index = spark.createDataFrame([("1", "2024", "a"), ("2", "2023", "b")], "id string, crawled_at string, company_name string")
    new = spark.createDataFrame([("1", "2022", "A"), ("3", "2021", "C")], index.schema)
    once = catalog.upserted(index, new)
    assert sorted(map(tuple, once.collect())) == [("1", "2022", "A"), ("2", "2023", "b"), ("3", "2021", "C")] == sorted(map(tuple, catalog.upserted(once, new).collect()))
    asked = spark.createDataFrame([("2330", "n", 2024, "q1"), ("2330", "n", 2019, "1"), ("ABCD", "n", 2024, "1"), ("23300", "n", 2024, "1"), ("2330", "n", 2024, "5"), ("2330", None, 2024, "1")], "stock_code string, company_name string, year int, season string")
    got = catalog.requests_checked(asked).collect()
    assert [r["is_valid"] for r in got] == [True] + [False] * 5 and got[0]["pdf_file"] == "202401_2330_AI1.pdf" and got[0]["season"] == "Q1"


def test_files(spark, tmp_path):
    record = {"stock_code": "2330", "company_name": "x", "report_year": 2024, "report_season": "Q1", "financials": {"equity": None}, "metadata": {"file_size": 5, "source": None}}
    (tmp_path / "202401_2330_AI1.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "202402_2330_AI1.json").write_text("not json")
    (tmp_path / "other.json").write_text("{}")
    got = {r["name"]: r for r in readers.reports(spark, str(tmp_path)).collect()}
    assert len(got) == 2 and got["202402_2330_AI1.json"]["corrupt"]
    good = got["202401_2330_AI1.json"]
    assert good["financials"] == {"equity": None} and good["metadata"] == {"file_size": "5", "source": None} and good["balance_sheet"] is None
    assert readers.files(spark, str(tmp_path), "*.json").count() == 3
    (tmp_path / "q1.json").write_text('{"queries": [{"stock_code": "1", "company_name": "c", "year": 2024, "season": "Q1"}]}')
    (tmp_path / "q2.json").write_text('[{"stock_code": "1", "company_name": "c", "year": 2024, "season": "Q1"}, {"stock_code": "2"}]')
    assert readers.batch_queries(spark, str(tmp_path / "q1.json")).count() == 1 and readers.batch_queries(spark, str(tmp_path / "q2.json")).count() == 2
    assert readers.index(spark, str(tmp_path / "none.json")).count() == 0
    frame = spark.createDataFrame([(2024, "Q1", None)], "report_year int, report_season string, eps double")
    path = writers.save_version(frame, str(tmp_path / "store"), "1")
    assert spark.read.parquet(path).count() == 1
    writers.export_json(frame, str(tmp_path / "export"))
    assert spark.read.text(str(tmp_path / "export")).first()[0] == '{"report_year":2024,"report_season":"Q1","eps":null}'
    writers.append_results(frame, str(tmp_path / "results"), "r1")
    writers.append_results(frame, str(tmp_path / "results"), "r2")
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2


def test_decoder_and_registry(spark):
    binary = spark.createDataFrame([("a", bytearray(b"one\ftwo\f ")), ("b", bytearray(b"\xff"))], "path string, content binary")
    got = {(r["path"], r["page_no"]): (r["text"], r["error"]) for r in readers.decoded(binary, lambda c: enumerate(c.decode().split("\f"), 1)).collect()}
    assert got[("a", 1)] == ("one", None) and ("a", 3) not in got and len([1 for k in got if k[0] == "b"]) == 1

    @registry.register("double")
    def double(df):
        return df.withColumn("n", F.col("n") * 2)

    assert spark.createDataFrame([(2,)], "n int").transform(registry.get("double")).first()["n"] == 4
    with pytest.raises(KeyError):
        registry.get("none")
    out = registry.mapped(spark.createDataFrame([(1,), (0,)], "n long"), lambda r: {"x": 1 / r["n"]}, "x double").collect()
    assert out[0]["x"] == 1.0 and "ZeroDivisionError" in out[1]["error"]


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"text_gate": 7, "unknown": 1}')
    assert config.load(str(tmp_path / "s.json")).text_gate == 7
    assert config.load(str(tmp_path / "absent.json")) == config.Settings()


def test_enhance_plan(spark):
    pages = [("text", 1, "Net Revenue: 5,000 " + "字" * 400), ("lines", 1, "營業收入 6,000\n" + "字" * 400), ("scan", 1, "Net Revenue: 5,000"), ("none", 1, "字" * 400)]
    tables = spark.createDataFrame([("text", 1, 0, ["h"], [["Total Assets", "9,000"]])], "doc_id string, page int, table_index int, headers array<string>, rows array<array<string>>")
    out = enhance.extracted(spark.createDataFrame(pages, "doc_id string, page_no int, text string"), tables)
    got = {(r["doc_id"], r["field"]): (r["value"], r["confidence"]) for r in out.collect()}
    assert got == {("text", "net_revenue"): (5000.0, "high"), ("text", "total_assets"): (9000.0, "high"), ("lines", "net_revenue"): (6000.0, "medium"), ("none", None): (None, "medium"), ("scan", None): (None, "low")}
    assert {r["doc_id"]: r["note"] for r in out.collect()}["scan"] == classify.SCANNED_NOTE
    words = spark.createDataFrame([("d", 1, 2, "b", 0.9), ("d", 1, 1, "a", 0.5), ("d", 1, 3, "c", 0.1)], "doc_id string, page_no int, position int, word string, confidence double")
    assert classify.recognised_text(words).first()["text"] == "a b"


@pytest.mark.parametrize(("year", "errors"), [
    ("2024", []), ("null", []), ("1999", ["報告年度應在合理範圍內(2000-2030) (值太小: 1999)"]), ("true", ["報告年度應在合理範圍內(2000-2030) (值太小: True)"]),
    ('"2024"', ["報告年度應為整數 (實際類型: str)", "驗證規則執行錯誤: '<' not supported between instances of 'str' and 'int'"]), ("2024.5", ["報告年度應為整數 (實際類型: float)"]),
    ("2030.5", ["報告年度應為整數 (實際類型: float)", "報告年度應在合理範圍內(2000-2030) (值太大: 2030.5)"]), ("[1]", ["報告年度應為整數 (實際類型: list)", "驗證規則執行錯誤: '<' not supported between instances of 'list' and 'int'"]),
])
def test_year_is_judged_as_it_stands_in_json(spark, tmp_path, year, errors):
    (tmp_path / "x_AI1.json").write_text('{"stock_code": "２３３０", "company_name": "x", "report_season": "Q1", "report_year": ' + year + "}")
    got = validate.validated(readers.reports(spark, str(tmp_path))).first()
    assert got["errors"] == errors and got["is_valid"] == (not errors)


def test_pages_and_tables_of_broken_files(spark):
    def pages(content):
        yield 1, "one"
        yield 2, ValueError("no page")
        yield 3, "three"

    def tables(content):
        if content == b"bad":
            raise TimeoutError("late")
        yield 1, 0, [["h"], ["a", 5, None]]
        yield 1, 1, [["only a header"]]

    binary = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"bad"))], "path string, content binary")
    got = {(r["page_no"], r["text"], r["error"]) for r in readers.decoded(binary, pages).collect()}
    assert got == {(1, "one", None), (2, None, "PDF_PARSE_ERROR: no page"), (3, "three", None)}
    decoded = readers.decoded_tables(binary, tables)
    assert [r["error"] for r in decoded.filter("error is not null").collect()] == ["TIMEOUT_ERROR: late"]
    assert [(r["doc_id"], r["headers"], r["rows"]) for r in readers.kept_tables(decoded).collect()] == [("a", ["h"], [["a", "5", None]])]
    assert {e.split(":")[0] for e in ("PDF_PARSE_ERROR: x", "TIMEOUT_ERROR: y")} <= set(schemas.ERROR_CODES)


def test_statuses_and_files(spark):
    rows = spark.createDataFrame([("a", "failed"), ("b", "unheard")], "id string, status string")
    assert tracking.known_statuses(rows.filter("id = 'a'")).first()["status"] == "failed"
    with pytest.raises(Exception, match="unknown status: unheard"):
        tracking.known_statuses(rows).collect()
    files = spark.createDataFrame([("a.PDF", 1001), ("b.pdf", 1000), ("c.txt", 5000)], "name string, size long")
    assert [r["name"] for r in readers.acceptable_pdf(files).collect()] == ["a.PDF"]
    assert [r["p"] for r in spark.createDataFrame([("a\\b.pdf",)], "p string").transform(readers.normal_paths, "p").collect()] == ["a/b.pdf"]
    tasks = spark.createDataFrame([("a", '{"k": 1}'), ("b", None)], "id string, metadata string")
    assert [r["metadata"] for r in readers.tasks(tasks).orderBy("id").collect()] == [{"k": "1"}, None]


def test_quality_report_is_saved(spark, tmp_path):
    records = spark.createDataFrame([("2330", "x", 2024, "Q1", {"equity": "1"}, {"eps": "1"}, {"a": "1"}, {"file_size": "500000"})], MAPS)
    summary = enhance.save_quality_report(records, str(tmp_path), "v1")
    assert summary.first()["total"] == 1 and spark.read.parquet(f"{tmp_path}/version=v1/issues").count() >= 1
    with pytest.raises(Exception):  # a version is never overwritten
        enhance.save_quality_report(records, str(tmp_path), "v1")


def test_states_merge_in_any_order(spark):
    """Parts of a log in any order, overlapping, with a task of very many failures, give the fold of the whole."""
    import itertools
    import random

    rng = random.Random(2)
    kinds = ["create", "status", "status", "status", "paths"]
    rows = []
    for i in range(900):
        kind = rng.choice(kinds)
        key = "hot" if i % 3 == 0 else f"t{rng.randrange(40)}"
        rows.append((key, i, kind, rng.choice(["failed", "failed", "processed"]) if kind == "status" else None, rng.choice([None, "", "bad", "worse"]), rng.choice([None, 0.0, 1.5, 2.5]), "a.pdf" if kind == "paths" else None))
    rows.append((None, 1000, "create", None, None, None, None))
    schema = "id string, seq long, kind string, status string, error_message string, processing_time double, pdf_path string"
    whole = sorted(map(repr, tracking.folded(spark.createDataFrame(rows, schema)).collect()))
    rng.shuffle(rows)
    parts = [tracking.partial(spark.createDataFrame(rows[a:b], schema)) for a, b in ((0, 350), (300, 700), (650, 901))]
    parts = [tuple(f.cache() for f in p) for p in parts]
    for a, b, c in list(itertools.permutations(parts))[::2]:
        out = tracking.merged(tracking.merged(a, tracking.merged(b, c)), a)
        assert sorted(map(repr, tracking.finished(*out).collect())) == whole
    empty = tracking.partial(spark.createDataFrame([], schema))
    assert tracking.finished(*tracking.merged(empty, empty)).collect() == []
    plan = tracking.partial(spark.createDataFrame(rows, schema))[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_batches_are_halved(spark):
    """The same rows and errors as row by row, in few calls."""
    rows = spark.createDataFrame([(i if i % 97 else 0,) for i in range(1000)], "n long").repartition(2)
    calls = spark.sparkContext.accumulator(0)

    def whole(batch):
        calls.add(1)
        if (batch["n"] == 0).any():
            raise ZeroDivisionError("division by zero")
        return batch.assign(x=1 / batch["n"], y=batch["n"].astype(str))

    got = registry.mapped_batches(rows, whole, "x double, y string").collect()
    want = registry.mapped(rows, lambda r: {"x": 1 / r["n"], "y": str(r["n"])}, "x double, y string").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r["error"] is not None for r in got) == 11
    assert calls.value < 300
    assert {r["error"] for r in registry.mapped_batches(rows, lambda b: b.iloc[:0], "x double").collect()} == {"ValueError: 0 rows for 1"}
    assert registry.mapped_batches(rows.limit(0), whole, "x double, y string").collect() == []


def test_report_totals_are_observed(spark, tmp_path):
    rows = [(f"{i:04d}" if i % 3 else "x", "n" if i % 4 else None, 1990 + i, "Q1", {"total_assets": "10", "total_liabilities": "5", "equity": str(i % 9)}, {"a": "1"}, {"a": "1"}, {}) for i in range(80)]
    for name, records in (("some", spark.createDataFrame(rows, MAPS).repartition(3)), ("none", spark.createDataFrame([], MAPS))):
        saved = enhance.save_quality_report(records, str(tmp_path / name), "v")
        details, summary, issues = enhance.quality_report(records)
        assert saved.collect() == summary.collect() and saved.columns == summary.columns
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}/version=v/issues").collect())) == sorted(map(tuple, issues.collect()))
        assert spark.read.parquet(f"{tmp_path}/{name}/version=v/details").count() == details.count()


def test_search_by_index(spark):
    names = ["Tsmc Ltd", "TSMC", "ts", "", None, "aaa", "aaaa", "台積電股份", "Äpfel & Co", "tsmtsmc"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    postings = catalog.name_index(rows, "id", "name")
    for part in ("tsm", "TSMC", "aaaa", "a", "", "積電股", "äPF", "tsmcx", "c l"):
        got = {r["id"] for r in catalog.found_by_index(rows, postings, part, "id", "name").collect()}
        assert got == {r["id"] for r in catalog.files_named(rows, part).collect()}, part


def test_codes_without_a_set(spark):
    codes = ["0000", "9999", "2330", "2330", "23301", "abc", None, "２３３０", "0007", ""]
    row = catalog.stats(spark.createDataFrame([(c,) for c in codes], "stock_code string")).first()
    assert (row["total_reports"], row["codes"]) == (10, sorted({c for c in codes if c is not None})) and row["n_codes"] == 8
    empty = catalog.stats(spark.createDataFrame([], "stock_code string")).first()
    assert tuple(empty) == (0, 0, [])
    plan = catalog.stats(spark.createDataFrame([("1",)], "stock_code string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_settings_take_effect(spark, tmp_path):
    """A changed settings file changes what the plan finds."""
    (tmp_path / "s.json").write_text(json.dumps({"text_gate": 5, "sampled_pages": 1, "ocr_confidence": 0.9, "ocr_gate": 0, "max_retries": 9, "min_download_bytes": 10}), encoding="utf-8")
    own = config.load(str(tmp_path / "s.json"))
    pages = spark.createDataFrame([("a", 1, "字" * 110), ("a", 2, "營業收入 5,000"), ("b", 1, "字" * 80), ("b", 2, "字" * 900)], "doc_id string, page_no int, text string")
    tables = spark.createDataFrame([], "doc_id string, page int, table_index int, headers array<string>, rows array<array<string>>")
    kinds = lambda settings: {r["doc_id"]: r["doc_type"] for r in enhance.extracted(pages, tables, settings).collect()}
    assert kinds(config.Settings()) == {"a": "mixed", "b": "text_based"} and kinds(own) == {"a": "mixed", "b": "scanned"}
    words = spark.createDataFrame([("a", 1, i, w, c) for i, (w, c) in enumerate([("營業收入", 0.95), ("5,000", 0.95), ("7,000", 0.5)])] + [("b", 1, 0, "字" * 60, 0.5), ("b", 2, 0, "存貨", 0.5), ("b", 2, 1, "9,000", 0.5)], "doc_id string, page_no int, position int, word string, confidence double")
    values = lambda settings: {(r["doc_id"], r["field"], r["value"], r["confidence"]) for r in enhance.recognised(words, settings).collect()}
    assert values(config.Settings()) == {("b", "inventory", 9000.0, 0.7)} and values(own) == {("a", "net_revenue", 5000.0, 0.7)}
    tasks = spark.createDataFrame([("t", "failed", 5)], "id string, status string, retry_count int")
    files = spark.createDataFrame([("x.pdf", 500)], "name string, size long")
    assert [f.count() for f in enhance.work_left(tasks, files)] == [0, 0] and [f.count() for f in enhance.work_left(tasks, files, own)] == [1, 1]
