"""Explicit schemas and fixed value lists."""

from __future__ import annotations

# The eleven fields of a record, by section.
FINANCIALS = ("cash_and_equivalents", "accounts_receivable", "inventory", "total_assets", "total_liabilities", "equity")
INCOME_STATEMENT = ("net_revenue", "gross_profit", "operating_income", "net_income", "eps")
FIELDS = (*INCOME_STATEMENT, *FINANCIALS)
SECTIONS = ("financials", "income_statement", "balance_sheet", "cash_flow")

# Currency and unit of every record.
CURRENCY, UNIT = "TWD", "千元"

# Task states.
STATUSES = ("pending", "downloading", "downloaded", "processing", "processed", "enhanced", "failed", "skipped")

# Error codes.
ERROR_CODES = (
    "UNKNOWN_ERROR", "CONFIG_ERROR", "VALIDATION_ERROR", "FILE_NOT_FOUND", "FILE_READ_ERROR", "FILE_WRITE_ERROR", "PDF_PARSE_ERROR", "PDF_CORRUPTION", "PDF_PASSWORD_PROTECTED",
    "OCR_ENGINE_ERROR", "OCR_RECOGNITION_FAILED", "DATA_EXTRACTION_ERROR", "DATA_VALIDATION_ERROR", "DATA_CONVERSION_ERROR", "NETWORK_ERROR", "CRAWLER_ERROR", "TIMEOUT_ERROR",
)

# The metadata keys that completeness counts.
METADATA_KEYS = ("source", "file_name", "file_path", "file_size", "created_at")

# Figures that completeness and the missing-figures warning look for.
KEY_FIGURES = ("net_revenue", "gross_profit", "operating_income", "net_income", "total_assets", "total_liabilities", "equity")

PAGES = "doc_id string, page_no int, text string"
TABLES = "doc_id string, page int, table_index int, headers array<string>, rows array<array<string>>"
TASKS = (
    "id string, stock_code string, company_name string, year int, season string, status string, created_at string, updated_at string, "
    "pdf_path string, json_path string, processed_path string, enhanced_path string, error_message string, processing_time double, "
    "retry_count int, metadata string"
)
INDEX = (
    "id string, stock_code string, company_name string, year int, season string, period string, pdf_file string, json_file string, "
    "file_size long, download_success boolean, crawled_at string, file_exists boolean"
)
BATCH_QUERY = "stock_code string, company_name string, year int, season string"
REPORT_MAPS = "map<string,string>"
TASK_COLUMNS = tuple(c.split()[0] for c in TASKS.split(", "))
