"""Readers.  Every schema is explicit; a bad file is a row with an error, not a stop."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import BATCH_QUERY, INDEX, PAGES, SECTIONS, TABLES

#: Report files among the other JSON of a folder.
REPORTS = "*_AI1.json"


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, name, stem, size, modified) of a folder's files, not of its subfolders; contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def reports(spark: SparkSession, folder: str, pattern: str = REPORTS) -> DataFrame:
    """Records of both generations in map form: a key with a null differs from no key.

    ``corrupt`` marks files that are not JSON objects; their fields are null.  report_year_raw and
    report_year_type keep the year as it stands and its type, for the rules that judge them."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("json"))
    top = raw.withColumn("top", F.from_json("json", "map<string,string>"))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("json"), "$.report_year", "variant"))
    kind = F.regexp_extract(kind, "^[A-Z]+", 0)
    python = F.when(kind == "BIGINT", "int").when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool").when(kind.isin("DOUBLE", "DECIMAL", "FLOAT"), "float").when(kind == "OBJECT", "dict").when(kind == "ARRAY", "list")
    get = lambda k: F.try_element_at("top", F.lit(k))
    as_map = lambda c: F.from_json(c, "map<string,string>")
    return top.select(
        "name", "bytes", (F.col("top").isNull() | (F.size("top") == 0)).alias("corrupt"), get("stock_code").alias("stock_code"), get("company_name").alias("company_name"),
        get("report_year").try_cast("int").alias("report_year"), get("report_season").alias("report_season"),
        get("report_year").alias("report_year_raw"), python.alias("report_year_type"), *[as_map(get(s)).alias(s) for s in SECTIONS], F.coalesce(as_map(get("metadata")), F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def records(spark: SparkSession, folder: str, pattern: str = REPORTS) -> DataFrame:
    """(name, bytes, record, corrupt): each file's JSON object as a variant, whatever its fields; null where it is none."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes"), F.try_parse_json("value").alias("record"))
    whole = F.coalesce(F.startswith(F.schema_of_variant("record"), F.lit("OBJECT")), F.lit(False))
    return raw.select("name", "bytes", F.when(whole, F.col("record")).alias("record"), (~whole).alias("corrupt"))


def batch_queries(spark: SparkSession, path: str) -> DataFrame:
    """Requests from a JSON list, one object, or an object with a list named queries."""
    fields = ", ".join(c.replace(" ", ": ") for c in BATCH_QUERY.split(", "))
    read = spark.read.schema(f"{BATCH_QUERY}, queries array<struct<{fields}>>").option("multiLine", True).json(path)
    own = F.array(F.struct("stock_code", "company_name", "year", "season"))
    return read.select(F.inline(F.coalesce("queries", own)))


def index(spark: SparkSession, path: str) -> DataFrame:
    """The catalog file's records; a missing or corrupt file is an empty catalog."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], INDEX)
    fields = ", ".join(c.replace(" ", ": ", 1) for c in INDEX.split(", "))
    return spark.read.schema(f"reports array<struct<{fields}>>").option("multiLine", True).json(path).select(F.inline("reports"))


def tasks(df: DataFrame) -> DataFrame:
    """Stored tasks with their metadata decoded."""
    return df.withColumn("metadata", F.from_json("metadata", "map<string,string>"))


def error_of(e: Exception) -> str:
    """CODE: message of a decoder's failure."""
    named = {"FileNotFoundError": "FILE_NOT_FOUND", "PermissionError": "FILE_READ_ERROR", "TimeoutError": "TIMEOUT_ERROR", "PDFPasswordIncorrect": "PDF_PASSWORD_PROTECTED"}
    return f"{named.get(type(e).__name__, 'PDF_PARSE_ERROR')}: {e}"


def decoded_tables(binary: DataFrame, decoder: Callable[[bytes], Iterable[tuple[int, int, list]]]) -> DataFrame:
    """(doc_id, page, table_index, raw_data, error) of binaryFile rows by a table decoder, which
    gives (page, place on the page, rows of cells); ``kept_tables`` makes tables of them."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out = [(path, page, k, [[None if c is None else str(c) for c in r] for r in rows], None) for page, k, rows in decoder(content)]
                except Exception as e:  # noqa: BLE001  any decoder may fail in its own way
                    out = [(path, None, None, None, error_of(e))]
                yield pd.DataFrame(out, columns=["doc_id", "page", "table_index", "raw_data", "error"])

    return binary.select("path", "content").mapInPandas(run, "doc_id string, page int, table_index int, raw_data array<array<string>>, error string")


def decoded(binary: DataFrame, decoder: Callable[[bytes], Iterable[tuple[int, str]]], retries: int = 1) -> DataFrame:
    """(path, page_no, text, error) of binaryFile rows by a page decoder, (page number, text) for each page.

    Blank pages go.  A decoder may give an exception in place of a page's text: that page is a row with an
    error, the others stay.  A file that can't be decoded is one row with an error, after ``retries`` tries.
    Each file's pages go out by themselves, so a task holds one file's pages."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for attempt in range(retries):
                    try:
                        out = [(path, n, None, error_of(t)) if isinstance(t, Exception) else (path, n, t, None) for n, t in decoder(content) if isinstance(t, Exception) or t and t.strip()]
                        break
                    except Exception as e:  # noqa: BLE001  any decoder may fail in its own way
                        out = [(path, None, None, error_of(e))]
                yield pd.DataFrame(out, columns=["path", "page_no", "text", "error"])

    return binary.select("path", "content").mapInPandas(run, "path string, page_no int, text string, error string")


def pdf_decoder() -> Callable[[bytes], Iterable[tuple[int, str]]]:
    """The page decoder of pdfplumber, where that is installed."""
    import io

    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("pdfplumber is not installed; pass another decoder") from e

    def decode(content: bytes):
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            for n, page in enumerate(pdf.pages, 1):
                try:
                    text = page.extract_text() or ""
                except Exception as e:  # noqa: BLE001  the other pages can still be read
                    text = e
                yield n, text

    return decode


def pages(df: DataFrame, doc_id: Column, page_no: Column, text: Column) -> DataFrame:
    """Any table as pages."""
    return df.select(doc_id.cast("string").alias("doc_id"), page_no.cast("int").alias("page_no"), text.alias("text"))


def kept_tables(tables: DataFrame) -> DataFrame:
    """Extracted tables with more than one row: the first is the header; table_index stays the place before filtering."""
    return tables.filter(F.size("raw_data") > 1).select("doc_id", "page", "table_index", F.element_at("raw_data", 1).alias("headers"), F.slice("raw_data", F.lit(2), F.size("raw_data")).alias("rows"))


def acceptable_pdf(df: DataFrame, least: int = 1000) -> DataFrame:
    return df.filter(F.lower("name").endswith(".pdf") & (F.col("size") > least))


def normal_paths(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: T.forward_slashes(F.col(c)) for c in columns})


SCHEMAS = {"pages": PAGES, "tables": TABLES, "index": INDEX, "queries": BATCH_QUERY}
