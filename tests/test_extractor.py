import json

import pytest
from pyspark.errors import AnalysisException

from quarterlight.schemas import ERROR_CODES
from quarterlight.sources import extractor, readers
from quarterlight.sources.extractor import Decoded, ExtractionError


def decode(content: bytes) -> Decoded:
    """A JSON file with pages, tables and fields; "raise" names an error, inside or for the whole file."""
    got = json.loads(content)
    if "raise" in got:
        kinds = {"timeout": TimeoutError("slow"), "password": type("PDFPasswordIncorrect", (Exception,), {})("locked"), "odd": RuntimeError("odd")}
        raise kinds.get(got["raise"]) or ExtractionError(got["raise"], "own")
    pages = [(i + 1, EOFError("cut off") if p is None else p) for i, p in enumerate(got.get("pages", []))]
    tables = [(1, i, KeyError("cells") if t is None else t) for i, t in enumerate(got.get("tables", []))]
    return Decoded(pages, tables, got.get("fields", {}))


NAME = "tests.test_extractor:decode"


def test_one_call_three_outputs(spark, tmp_path):
    good = {"pages": ["one", None, "三"], "tables": [[["a", None], [1, "2"]], None], "fields": {"eps": 1.5, "equity": 7}}
    files = {"good": good, "empty": {}, "timeout": {"raise": "timeout"}, "password": {"raise": "password"}, "odd": {"raise": "odd"}}
    for name, content in files.items():
        (tmp_path / f"{name}.bin").write_text(json.dumps(content), encoding="utf-8")
    (tmp_path / "broken.bin").write_bytes(b"{no json")
    binary = spark.read.format("binaryFile").load(str(tmp_path))
    rows = [r.asDict() | {"path": r["path"].rsplit("/", 1)[1]} for r in extractor.extracted_files(binary, NAME).collect()]
    mine = [r for r in rows if r["path"] == "good.bin"]
    assert [(r["part"], r["page_no"], r["table_index"], r["name"], r["text"], r["cells"], r["value"], r["code"]) for r in mine] == [
        ("text", 1, None, None, "one", None, None, None), ("text", 2, None, None, None, None, None, "PDF_CORRUPTION"), ("text", 3, None, None, "三", None, None, None),
        ("table", 1, 0, None, None, [["a", None], ["1", "2"]], None, None), ("table", 1, 1, None, None, None, None, "DATA_EXTRACTION_ERROR"),
        ("field", None, None, "eps", None, None, 1.5, None), ("field", None, None, "equity", None, None, 7.0, None),
    ]
    assert {r["path"]: (r["part"], r["code"]) for r in rows if r["path"] != "good.bin"} == {"timeout.bin": ("file", "TIMEOUT_ERROR"), "password.bin": ("file", "PDF_PASSWORD_PROTECTED"), "odd.bin": ("file", "UNKNOWN_ERROR"), "broken.bin": ("file", "DATA_CONVERSION_ERROR")}
    # Tables go on as the reader's tables do.
    tables = extractor.extracted_files(binary, NAME).filter("part = 'table' and code is null").selectExpr("path AS doc_id", "page_no AS page", "table_index", "cells AS raw_data")
    assert [(r["headers"], r["rows"]) for r in readers.kept_tables(tables).collect()] == [(["a", None], [["1", "2"]])]


def test_every_code_can_arise(spark):
    rows = spark.createDataFrame([(c, json.dumps({"raise": c}).encode()) for c in ERROR_CODES] + [("null", None)], "path string, content binary")
    got = {r["path"]: r["code"] for r in extractor.extracted_files(rows, NAME).collect()}
    assert got == {c: c for c in ERROR_CODES} | {"null": "FILE_NOT_FOUND"} and len(got) == 18
    with pytest.raises(ValueError, match="unknown error code"):
        ExtractionError("NO_SUCH_CODE")


def test_a_wrong_decoder_fails_at_once(spark):
    rows = spark.createDataFrame([("a", b"{}")], "path string, content binary")
    with pytest.raises(AnalysisException):
        extractor.extracted_files(rows, "tests.test_extractor:nothing")
