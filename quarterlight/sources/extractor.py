"""Text, tables and fields of a file in one decoding, as a table function.

    register(spark)
    spark.sql("SELECT f.* FROM files, LATERAL extract_file(path, content, 'package.module:decode') f")

``decode`` takes a file's bytes and gives Decoded.  Each page, table and field is a row, in this order; a page or table
that can't be had may be given as an exception, and is a row with an error, as is a file whose decoding fails."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..schemas import ERROR_CODES

ROWS = StructType()
for _name, _type in {"path": StringType(), "part": StringType(), "page_no": IntegerType(), "table_index": IntegerType(), "name": StringType(), "text": StringType(), "cells": ArrayType(ArrayType(StringType())), "value": DoubleType(), "code": StringType(), "message": StringType()}.items():
    ROWS.add(_name, _type)


@dataclass
class Decoded:
    """pages: (number, text); tables: (page, place on the page, rows of cells); fields: values by name."""

    pages: Iterable[tuple[int, str | Exception]] = ()
    tables: Iterable[tuple[int, int, list | Exception]] = ()
    fields: dict[str, float] = field(default_factory=dict)


class ExtractionError(Exception):
    """A failure with one of the error codes."""

    def __init__(self, code: str, message: str = ""):
        if code not in ERROR_CODES:
            raise ValueError(f"unknown error code: {code}")
        super().__init__(message)
        self.code = code


#: Codes of failures that don't bring their own, by the first class that fits, and of decoders' classes by name.
BY_CLASS: tuple[tuple[type, str], ...] = (
    (FileNotFoundError, "FILE_NOT_FOUND"), (TimeoutError, "TIMEOUT_ERROR"), (ConnectionError, "NETWORK_ERROR"), (OSError, "FILE_READ_ERROR"), (UnicodeError, "DATA_CONVERSION_ERROR"),
    (json.JSONDecodeError, "DATA_CONVERSION_ERROR"), (KeyError, "DATA_EXTRACTION_ERROR"), (IndexError, "DATA_EXTRACTION_ERROR"), (AssertionError, "DATA_VALIDATION_ERROR"), (ImportError, "CONFIG_ERROR"), (ValueError, "PDF_PARSE_ERROR"), (EOFError, "PDF_CORRUPTION"),
)
BY_NAME = {"PDFPasswordIncorrect": "PDF_PASSWORD_PROTECTED", "PDFSyntaxError": "PDF_CORRUPTION", "PSEOF": "PDF_CORRUPTION", "TesseractError": "OCR_ENGINE_ERROR", "TesseractNotFoundError": "OCR_ENGINE_ERROR"}


def code_of(e: Exception) -> str:
    own = getattr(e, "code", None)
    if own in ERROR_CODES:
        return own
    return BY_NAME.get(type(e).__name__) or next((code for kind, code in BY_CLASS if isinstance(e, kind)), "UNKNOWN_ERROR")


def decoder_of(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


@udtf
class ExtractFile:
    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument, decoder: AnalyzeArgument) -> AnalyzeResult:
        if not decoder.isConstantExpression or not isinstance(decoder.value, str):
            raise ValueError("the decoder is a constant, 'module:function'")
        decoder_of(decoder.value)  # a wrong name fails before anything runs
        return AnalyzeResult(ROWS)

    def eval(self, path, content, decoder):
        failed = lambda part, page, k, e: (path, part, page, k, None, None, None, None, code_of(e), str(e))
        try:
            if content is None:
                raise FileNotFoundError("no content")
            out = decoder_of(decoder)(bytes(content))
            for n, text in out.pages:
                yield failed("text", n, None, text) if isinstance(text, Exception) else (path, "text", n, None, None, text, None, None, None, None)
            for page, k, rows in out.tables:
                cells = rows if isinstance(rows, Exception) else [[None if c is None else str(c) for c in r] for r in rows]
                yield failed("table", page, k, rows) if isinstance(rows, Exception) else (path, "table", page, k, None, None, cells, None, None, None)
            for name, value in out.fields.items():
                yield (path, "field", None, None, name, None, None, float(value), None, None)
        except Exception as e:  # noqa: BLE001  any decoder may fail in its own way
            yield failed("file", None, None, e)


def register(spark: SparkSession, name: str = "extract_file") -> None:
    spark.udtf.register(name, ExtractFile)


def extracted_files(binary: DataFrame, decoder: str) -> DataFrame:
    """The rows of binaryFile rows (path, content)."""
    register(binary.sparkSession)
    return binary.sparkSession.sql("SELECT f.* FROM {files} b, LATERAL extract_file(b.path, b.content, :decoder) f", args={"decoder": decoder}, files=binary.select("path", "content"))
