import json

from pyspark.sql import functions as F

from quarterlight.functions import periods as P
from quarterlight.functions import session
from quarterlight.functions import text as T
from quarterlight.operators import catalog, records, validate
from quarterlight.sources import readers


def test_kinds_and_texts(spark):
    whole = {"i": 7, "big": 10**25, "f": 2.0, "e": 1e300, "s": "x.y", "b": False, "n": None, "o": {"k": {"deep": [1]}}, "l": [], "a'b": 1}
    rows = spark.createDataFrame([(json.dumps(whole),), ("[1]",), ("no json",), (None,)], "j string").select("j", records.parsed(F.col("j")).alias("record"))
    got = {r["path"]: (r["kind"], r["value"]) for r in records.paths(rows.limit(1), [], ["i", "big", "f", "e", "s", "b", "n", "o", "o.k.deep", "l", "l.0", "i.x", "s.length", "zz"]).collect()}
    assert got == {
        "i": ("int", "7"), "big": ("int", str(10**25)), "f": ("float", "2.0"), "e": ("float", "1.0E300"), "s": ("str", "x.y"), "b": ("bool", "False"), "n": ("null", None), "o": ("dict", '{"k":{"deep":[1]}}'),
        "o.k.deep": ("list", "[1]"), "l": ("list", "[]"), "l.0": ("absent", None), "i.x": ("absent", None), "s.length": ("absent", None), "zz": ("absent", None),
    }
    assert [r["k"] for r in rows.select(records.kind(records.at(F.col("record"), "i")).alias("k")).collect()] == ["int", "absent", "absent", "absent"]


def test_rules_agree_with_those_on_maps(spark):
    files = [{"stock_code": "2330", "company_name": "x", "report_year": 2024, "report_season": "Q1", "financials": {"equity": 5}, "income_statement": {"eps": 1}, "balance_sheet": {"a": 1}, "metadata": {"file_size": 50000}}, {"stock_code": "23", "report_year": 1999, "report_season": "Q9", "financials": {}, "metadata": {"file_size": 5}}, {}]
    rows = spark.createDataFrame([(json.dumps(f),) for f in files], "j string").select(records.parsed(F.col("j")).alias("record"))
    got = [(r["errors"], r["warnings"]) for r in records.judged(rows).collect()]
    assert got[0] == ([], [])
    assert got[1] == (["股票代碼應為4位數字 (格式不符: 23)", "公司名稱為必要欄位", "報告年度應在合理範圍內(2000-2030) (值太小: 1999)", "報告季度應為Q1-Q4格式 (格式不符: Q9)"], ["財務數據欄位為必要 (欄位為空)", "損益表數據為必要", "資產負債表數據為必要", "檔案大小異常 (值太小: 5)"])
    assert got[2] == (["股票代碼為必要欄位", "公司名稱為必要欄位"], ["財務數據欄位為必要", "損益表數據為必要", "資產負債表數據為必要"])
    odd = (validate.Rule("a.b", "type", "t", "error", {"type": "list"}), validate.Rule("a.b", "range", "r", "error", {"max": 3}))
    rows = spark.createDataFrame([('{"a": {"b": [1]}}',), ('{"a": {"b": 4}}',), ('{"a": 5}',)], "j string").select(records.parsed(F.col("j")).alias("record"))
    assert [r["errors"] for r in records.judged(rows, odd).collect()] == [["驗證規則執行錯誤: '>' not supported between instances of 'list' and 'int'"], ["t (實際類型: int)", "r (值太大: 4)"], []]


def test_records_of_a_folder(spark, tmp_path):
    (tmp_path / "a_AI1.json").write_text(json.dumps({"pages": [{"n": 1, "t": [1.5, None]}], "report_year": "2024"}), encoding="utf-8")
    (tmp_path / "b_AI1.json").write_text("[1, 2]", encoding="utf-8")
    (tmp_path / "c_AI1.json").write_text("{broken", encoding="utf-8")
    got = {r["name"]: (r["corrupt"], r["k"], r["p"]) for r in readers.records(spark, str(tmp_path)).select("name", "corrupt", records.kind(records.at(F.col("record"), "report_year")).alias("k"), records.text(records.at(F.col("record"), "pages")).alias("p")).collect()}
    assert got == {"a_AI1.json": (False, "str", '[{"n":1,"t":[1.5,null]}]'), "b_AI1.json": (True, "absent", None), "c_AI1.json": (True, "absent", None)}


def test_functions_for_sql(spark):
    session.register(spark)
    seasons = spark.createDataFrame([("Q1",), ("q3",), ("QQ1",), ("5",), ("",), (None,)], "s string")
    got = spark.sql("SELECT normalize_season(s) AS a, validate_season(s) AS b FROM {t}", t=seasons).collect()
    assert got == seasons.select(P.normalize_season(F.col("s")).alias("a"), P.valid_season(F.col("s")).alias("b")).collect()
    codes = spark.createDataFrame([("2330",), ("２３３０",), ("23300",), ("2330\n",), (None,)], "c string")
    assert spark.sql("SELECT validate_stock_code(c) AS a FROM {t}", t=codes).collect() == codes.select(P.valid_stock_code(F.col("c")).alias("a")).collect()
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 512, 1023, 1024, 1536, 10**6, 1 << 20, 5 * 10**9, (1 << 40) - 1, 1 << 40, -1, None)], "n long")
    assert spark.sql("SELECT file_size_label(n) AS a FROM {t}", t=sizes).collect() == sizes.select(T.size_label(F.col("n")).alias("a")).collect()


def test_search_as_a_table_function(spark):
    rows = [("a", "2330", "Tsmc Ltd", 2024, "Q1"), ("b", "2454", "MediaTek", 2024, "QQ2"), ("c", None, None, None, None), ("d", "2330", "TSMC", 2023, "2")]
    index = spark.createDataFrame(rows, "id string, stock_code string, company_name string, year int, season string")
    session.register_catalog(spark, index, "filed")
    wanted = [("2330", None, None, None), (None, "tsmc", None, None), ("", "", 0, ""), (None, None, 2024, "q2"), (None, "mc", 2023, "Q2"), ("9999", None, None, None)]
    for w in wanted:
        args = {k: v for k, v in zip(("c", "n", "y", "s"), w, strict=True)}
        got = {r["id"] for r in spark.sql("SELECT id FROM search_filed(CAST(:c AS STRING), CAST(:n AS STRING), CAST(:y AS INT), CAST(:s AS STRING))", args=args).collect()}
        assert got == {r["id"] for r in catalog.searched(index, *w).collect()}
